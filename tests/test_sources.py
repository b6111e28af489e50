"""Parsers of formats, row sources and sinks."""

import io
import zipfile

import pytest

from corpusmill.sources import formats
from corpusmill.sources.documents import diagnostics, parse_file, read_documents

MD = """# Top {#id}

First *line* with `a*b*` and
a [link](http://x.example/y "t").

- one
- [x] two **bold**

> quoted
> text

```py
x = 1

y = 2
```

| a | b |
|---|:-:|
| 1 | 2 |
| 3 |

Sub
---
***
$$
x^2
$$
Note[^1] snake_case_name 2 * 3 * 4.

[^1]: Under *it*.
"""


def kinds(blocks):
    return [(b["kind"], b["level"], b["text"]) for b in blocks]


def test_markdown():
    blocks = formats.parse_markdown(MD.encode())
    assert kinds(blocks) == [
        ("heading", 1, "Top"),
        ("paragraph", None, "First line with a*b* and a link."),
        ("list", None, "one\n[x] two bold"),
        ("quote", None, "quoted text"),
        ("code", None, "x = 1\n\ny = 2"),
        ("table", None, "a\tb\n1\t2\n3\t"),
        ("heading", 2, "Sub"),
        ("rule", None, ""),
        ("math", None, "x^2"),
        ("paragraph", None, "Note[^1] snake_case_name 2 * 3 * 4."),
        ("paragraph", None, "Under it."),
    ]
    assert blocks[1]["links"] == ["http://x.example/y"] and blocks[4]["language"] == "py" and blocks[-1]["region"] == "footnote:1"
    assert formats.parse_markdown(b"") == []


def test_nested_lists_images_and_citations():
    text = "- a\n  - b\n    1. c\n- [ ] d\n\n![alt](pic.png)\n\nSee [@doe2020, p. 3] and ![in](x.png) line.\n"
    blocks = formats.parse_markdown(text.encode())
    assert kinds(blocks) == [("list", None, "a\n  b\n    c\n[ ] d"), ("image", None, "alt"), ("paragraph", None, "See [@doe2020, p. 3] and in line.")]
    assert blocks[1]["links"] == ["pic.png"] and blocks[2]["links"] == ["@doe2020"]


def pdf_file(*pages: bytes, deflate: bool = False) -> bytes:
    import zlib

    kids = " ".join(f"{10 + 2 * k} 0 R" for k in range(len(pages)))
    out = f"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[{kids}]/Count {len(pages)}/Resources<</Font<</F1 3 0 R>>>>>>endobj\n3 0 obj<</Type/Font/BaseFont/Helvetica>>endobj\n".encode()
    for k, page in enumerate(pages):
        raw = zlib.compress(page) if deflate else page
        head = f"<</Length {len(raw)}{'/Filter/FlateDecode' if deflate else ''}>>"
        out += f"{10 + 2 * k} 0 obj<</Type/Page/Parent 2 0 R/Contents {11 + 2 * k} 0 R>>endobj\n{11 + 2 * k} 0 obj{head}\nstream\n".encode() + raw + b"\nendstream\nendobj\n"
    return out + b"trailer<</Root 1 0 R>>\n%%EOF"


def test_pdf_text_layer_and_recognised_pages(spark):
    from corpusmill.sources import documents, pdf

    one = b"BT /F1 12 Tf 72 700 Td (First \\(line\\)) Tj 0 -14 Td [(sec) -20 (ond) -400 (x)] TJ 0 -40 Td <416674> Tj ET"
    two = b"BT /F1 12 Tf 1 0 0 1 72 700 Tm (Page two) Tj ET"
    for deflate in (False, True):
        blocks = pdf.parse_pdf(pdf_file(one, two, deflate=deflate))
        assert [(b["text"], b["page"]) for b in blocks] == [("First (line)\nsecond x", 1), ("Aft", 1), ("Page two", 2)]
    blank = pdf_file(one, b"q 10 0 0 10 0 0 cm /Im1 Do Q")
    with pytest.raises(formats.Refused, match="pdf-ocr-required"):
        pdf.parse_pdf(blank)
    files = spark.createDataFrame([("a.pdf", bytearray(blank)), ("b.pdf", bytearray(b"no")), ("c.pdf", bytearray(pdf_file(two)))], "path string, content binary")
    got = documents.parse_files(files, lambda page, data: f"seen {page}").collect()
    assert {(r.path, r.page, r.text, r.error) for r in got} == {("a.pdf", 1, "First (line)\nsecond x", None), ("a.pdf", 1, "Aft", None), ("a.pdf", 2, "seen 2", None), ("b.pdf", None, None, "not-a-pdf"), ("c.pdf", 1, "Page two", None)}


def test_html():
    page = b"<html><head><title>no</title></head><body>out<main><h2>A &amp; b</h2><p>x<br>y <a href='/z'>z</a></p>loose<script>no</script><ul><li>i</ul></main><p>after</p></body></html>"
    assert kinds(formats.parse_html(page)) == [("heading", 2, "A & b"), ("paragraph", None, "x\ny z"), ("paragraph", None, "loose"), ("paragraph", None, "i")]
    assert kinds(formats.parse_html("<p>é</p>".encode("latin-1").replace(b"<p>", b"<meta charset=latin-1><p>"))) == [("paragraph", None, "é")]
    with pytest.raises(formats.Refused):
        formats.parse_html(b"<p>\xe9</p>")


def test_tables_and_json():
    assert kinds(formats.parse_csv("﻿item, qty\n\n pen,3\nx\n".encode())) == [("table", 1, "item\tqty\npen\t3\nx\t")]
    assert [b["text"] for b in formats.parse_json(b'{"a": {"b": [1, "x", ""], "c": {}}, "d": null, "e": 1.50, "f": true, "g": []}')] == ["a.b[0]: 1", "a.b[1]: x", "a.b[2]:", "a.c: {}", "d: null", "e: 1.5", "f: true", "g: []"]
    assert [b["text"] for b in formats.parse_jsonl(b'{"a": 1}\r\n\n[2]\n')] == ["record[0].a: 1", "record[1][0]: 2"]
    for bad in (b'{"a": NaN}', b'{"a": 1, "a": 2}', b"{", b"\xff"):
        with pytest.raises(formats.Refused):
            formats.parse_json(bad)


def docx(body: str, notes: str = "") -> bytes:
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/footnotes.xml", f"<w:footnotes {ns}>{notes}</w:footnotes>")
    return data.getvalue()


def test_docx():
    p = lambda text, style="", more="": f'<w:p><w:pPr>{f"""<w:pStyle w:val="{style}"/>""" if style else ""}{more}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    number = '<w:numPr><w:numId w:val="7"/></w:numPr>'
    body = p("T", "Title") + p("h", "Heading2") + "<w:p><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del><w:r><w:footnoteReference w:id=\"2\"/></w:r></w:p>"
    body += p("a", more=number) + p("b", more=number) + p("x", "Code") + p("y", "Code") + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc/></w:tr></w:tbl>"
    blocks = formats.parse_docx(docx(body, f'<w:footnote w:id="2">{p("below")}</w:footnote>'))
    assert kinds(blocks) == [("heading", 1, "T"), ("heading", 2, "h"), ("paragraph", None, "new[^2]"), ("list", None, "a\nb"), ("code", None, "x\ny"), ("table", None, "1\t"), ("paragraph", None, "below")]
    assert blocks[-1]["region"] == "footnote:2"
    deep = '<w:numPr><w:ilvl w:val="1"/><w:numId w:val="7"/></w:numPr>'
    more = p("a", more=number) + p("b", more=deep) + p("Contents 1", "TOC1") + "<w:p><w:r><w:instrText> TOC \\o </w:instrText></w:r></w:p>" + '<w:p><w:pPr><w:pBdr><w:bottom w:val="single"/></w:pBdr></w:pPr></w:p>'
    assert kinds(formats.parse_docx(docx(more))) == [("list", None, "a\n  b"), ("rule", None, "")]
    assert parse_file("a.docx", b"no")[0]["error"] == "not-a-zip"


def test_folders_of_files(spark, tmp_path):
    for name, data in {"a.md": b"# A\n\nb", "b.txt": b"x\n \ny", "c.py": b"z = 1\n", "d.bin": b"", "e.json": b"{", "f.txt": b""}.items():
        (tmp_path / name).write_bytes(data)
    blocks = read_documents(spark, str(tmp_path), exclude=r"/d\.bin$")
    got = {(r.path.rsplit("/", 1)[-1], r.block, r.kind, r.text, r.error) for r in blocks.collect()}
    assert got == {("a.md", 0, "heading", "A", None), ("a.md", 1, "paragraph", "b", None), ("b.txt", 0, "paragraph", "x", None), ("b.txt", 1, "paragraph", "y", None), ("c.py", 0, "code", "z = 1\n", None), ("e.json", None, None, None, "not-json")}
    assert {(r.path[-6:], r.status) for r in diagnostics(blocks).collect()} >= {("e.json", "refused")}


def test_row_containers_hold_the_same_rows(spark, tmp_path):
    import pyarrow as pa

    from corpusmill.sources import row_sources, sinks

    data = [("a", 'x "q", é'), ("b", "y\nz")]
    frame = spark.createDataFrame(data, "k string, v string")
    want = {'{"k":"a","v":"x \\"q\\", é"}', '{"k":"b","v":"y\\nz"}'}
    frame.write.parquet(str(tmp_path / "p"))
    frame.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(str(tmp_path / "c"))
    frame.write.json(str(tmp_path / "l"))
    sinks.write_arrow(frame, str(tmp_path / "a"))
    (tmp_path / "j.json").write_text('{"rows": [{"k":"a","v":"x \\"q\\", é"}, {"k":"b","v":"y\\nz"}]}')
    for form, place in {"parquet": "p", "csv": "c", "jsonl": "l", "arrow": "a", "json": "j.json"}.items():
        rows = row_sources.read_rows(spark, str(tmp_path / place), form)
        assert {r.payload for r in row_sources.accepted(rows).collect()} == want, form
    with pytest.raises(FileExistsError):
        sinks.write_arrow(frame, str(tmp_path / "a"))
    assert pa.ipc.open_file(next((tmp_path / "a").glob("*.arrow"))).schema.names == ["k", "v"]


def test_lines_are_numbered_and_one_bad_line_refuses_a_file(spark, tmp_path):
    from corpusmill.sources import row_sources

    (tmp_path / "a.jsonl").write_bytes(b'{"a": 1}\r\n\n{"a": 2}\n')
    (tmp_path / "b.jsonl").write_bytes(b'{"a": 3}\n[4]\nno\n')
    rows = row_sources.read_jsonl(spark, str(tmp_path)).collect()
    assert sorted((r.path[-7:], r.row_index, r.payload, r.error) for r in rows) == [("a.jsonl", 1, '{"a": 1}', None), ("a.jsonl", 3, '{"a": 2}', None), ("b.jsonl", 1, '{"a": 3}', None), ("b.jsonl", 2, "[4]", "not-an-object"), ("b.jsonl", 3, "no", "not-json")]
    assert {r.payload for r in row_sources.accepted(row_sources.read_jsonl(spark, str(tmp_path))).collect()} == {'{"a": 1}', '{"a": 2}'}
    big = tmp_path / "big.jsonl"
    big.write_text("".join(f'{{"a": {i}}}\n' for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = row_sources.numbered_lines(spark, str(big)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r.line == f'{{"a": {r.row_index - 1}}}' for r in got) and len(got) == 5000


def test_bundles_and_profiles(spark, tmp_path):
    from corpusmill.sources import sinks

    data = [("train", i, f"r{i}", f'{{"text":"t{i % 3}"}}') for i in range(5)] + [("evaluation", 0, "r9", '{"text":"é"}')]
    rows = spark.createDataFrame(data, "partition string, ordinal long, record_id string, payload string")
    path = str(tmp_path / "bundle")
    sinks.write_bundle(rows, path)
    assert {(r.partition, r.rows, r.intact) for r in sinks.verify_bundle(spark, path).collect()} == {("train", 5, True), ("evaluation", 1, True)}
    swapped = rows.withColumn("ordinal", 4 - rows.ordinal).filter("partition = 'train'")
    assert sinks.fingerprint(swapped).first().fingerprint != sinks.fingerprint(rows.filter("partition = 'train'")).first().fingerprint
    victim = next((tmp_path / "bundle" / "rows" / "partition=evaluation").glob("part-*"))
    victim.write_text('{"text":"e"}\n')
    for crc in victim.parent.glob(".*.crc"):
        crc.unlink()
    assert {(r.partition, r.intact) for r in sinks.verify_bundle(spark, path).collect()} == {("train", True), ("evaluation", False)}
    pairs = spark.createDataFrame([("train", "p", "c"), ("evaluation", "q", "d")], "partition string, prompt string, completion string")
    for profile in sinks.PROFILES:
        sinks.write_profile(pairs, str(tmp_path / profile), profile)
    assert spark.read.json(str(tmp_path / "llama-factory" / "train")).first().conversations[1].value == "c"
    assert spark.read.json(str(tmp_path / "mlx" / "valid")).first().prompt == "q"
    sinks.zip_folder(path, str(tmp_path / "one.zip"))
    sinks.zip_folder(path, str(tmp_path / "two.zip"))
    assert (tmp_path / "one.zip").read_bytes() == (tmp_path / "two.zip").read_bytes()
