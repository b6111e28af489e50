"""Bytes of one file -> blocks. Plain Python on the standard library, run inside Arrow batches by `documents`.

A block is a dict of region (body, or footnote:<id>), kind, level, language, text and links. A file that cannot be
read exactly raises Refused with a reason.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

# Suffixes of source code.
CODE = ("py", "js", "ts", "java", "go", "rs", "c", "cpp", "rb", "sh")
#: Limits on what an archive may declare before anything is inflated.
MAX_MEMBERS, MAX_MEMBER_BYTES = 10_000, 512 * 1024 * 1024


class Refused(ValueError):
    """Why a file has no blocks."""


def _block(kind: str, text: str, level: int | None = None, language: str | None = None, links: list[str] | None = None, region: str = "body") -> dict:
    return {"region": region, "kind": kind, "level": level, "language": language, "text": text, "links": links or []}


def _decoded(data: bytes) -> str:
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise Refused("not-utf-8") from e


def parse_text(data: bytes) -> list[dict]:
    """Paragraphs between blank lines."""
    return [_block("paragraph", p.strip()) for p in re.split(r"\n\s*\n", _decoded(data)) if p.strip()]


def parse_code(data: bytes, language: str) -> list[dict]:
    """One block, text as it is."""
    return [_block("code", _decoded(data), language=language)]


# --- Markdown: a line-anchored subset -------------------------------------------------------------------------------

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^\s`]*)")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_ITEM = re.compile(r"( *)(?:[-*+]|(\d{1,9})[.)])[ \t]+(.*)")
_NOTE = re.compile(r"\[\^([^\]\s]+)\]:[ \t]*(.*)")
_DELIMITERS = re.compile(r" *\|?(?: *:?-+:? *\|)+(?: *:?-+:? *)?\|? *$")
_TASK = re.compile(r"\[([ xX])\] ")
_LINK = re.compile(r"(!?)\[([^\]\[]*)\]\(\s*<?([^\s)>]*)>?(?:\s+\"[^\"]*\")?\s*\)")
_ATTRIBUTES = re.compile(r"\s*\{[#.][^{}]*\}\s*$")


_CITATION = re.compile(r"\[@([A-Za-z0-9_][A-Za-z0-9_:.#$%&+?<>~/-]*)(?:,\s*[^\]]*)?\]")
_IMAGE = re.compile(r"!\[([^\]]*)\]\(\s*<?([^\s)>]*)>?(?:\s+\"[^\"]*\")?\s*\)$")


def _inline(text: str) -> tuple[str, list[str]]:
    """Readable text of inline Markdown, and the targets of its links and the keys of its citations (as @key); code spans are taken as they are."""
    links: list[str] = []
    spans: list[str] = []

    def keep(m: re.Match) -> str:
        spans.append(m.group(2).strip())
        return f"\0{len(spans) - 1}\0"

    def link(m: re.Match) -> str:
        if not m.group(1):
            links.append(m.group(3))
        return m.group(2)

    text = re.sub(r"(`+)(.+?)\1(?!`)", keep, text.replace("\0", ""))
    text = _LINK.sub(link, text)
    links += [f"@{m.group(1)}" for m in _CITATION.finditer(text)]
    for mark in (r"\*\*", "__", "~~", r"\*", r"(?<!\w)_", r"\^", "~"):
        close = r"_(?!\w)" if mark.endswith("_") and mark != "__" else mark
        text = re.sub(rf"{mark}(?=\S)([^\n]*?\S)(?<!\\){close}" if mark not in (r"\^", "~") else rf"(?<!\[){mark}([^\s^~\]\[]+){mark}", r"\1", text)
    text = re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text)
    return re.sub("\0(\\d+)\0", lambda m: spans[int(m.group(1))], text), links


def _paragraph(lines: list[str]) -> str:
    """Lines joined by blanks; two blanks or a backslash at a line's end break it."""
    out = ""
    for k, line in enumerate(lines):
        hard = line.endswith("  ") or line.rstrip().endswith("\\")
        out += line.strip().removesuffix("\\" if hard else "\0")
        out += "" if k == len(lines) - 1 else "\n" if hard else " "
    return out


def _cells(line: str) -> list[str]:
    return [_inline(c.strip().replace("\\|", "|"))[0] for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))]


def parse_markdown(data: bytes, region: str = "body") -> list[dict]:
    """Headings, fences, tables, lists, quotes, rules, display math, footnotes and paragraphs."""
    lines = _decoded(data).replace("\r\n", "\n").split("\n")
    out: list[dict] = []
    notes: list[dict] = []
    open_lines: list[str] = []

    def flush() -> None:
        if open_lines and (image := _IMAGE.match(_paragraph(open_lines).strip())):  # a paragraph of one image is an image
            out.append(_block("image", image.group(1), links=[image.group(2)], region=region))
            open_lines.clear()
        elif open_lines:
            text, links = _inline(_paragraph(open_lines))
            if text.strip():
                out.append(_block("paragraph", text.strip(), links=links, region=region))
            open_lines.clear()

    def nested(part: list[str]) -> str:
        return "\n\n".join(b["text"] for b in parse_markdown("\n".join(part).encode()))

    k = 0
    while k < len(lines):
        line = lines[k]
        if not line.strip():
            flush()
        elif fence := _FENCE.match(line):
            flush()
            end, body = fence.group(1), []
            while (k := k + 1) < len(lines) and not re.match(rf" {{0,3}}{re.escape(end[0])}{{{len(end)},}}[ \t]*$", lines[k]):
                body.append(lines[k])
            out.append(_block("code", "\n".join(body), language=fence.group(2) or None, region=region))
        elif line.strip() == "$$":
            flush()
            body = []
            while (k := k + 1) < len(lines) and lines[k].strip() != "$$":
                body.append(lines[k])
            out.append(_block("math", "\n".join(body), region=region))
        elif heading := _HEADING.match(line):
            flush()
            text, links = _inline(_ATTRIBUTES.sub("", heading.group(2) or ""))
            out.append(_block("heading", text.strip(), level=len(heading.group(1)), links=links, region=region))
        elif open_lines and re.match(r" {0,3}(=+|-+)[ \t]*$", line):
            text, links = _inline(_paragraph(open_lines))
            open_lines.clear()
            out.append(_block("heading", text.strip(), level=1 if "=" in line else 2, links=links, region=region))
        elif _RULE.match(line):
            flush()
            out.append(_block("rule", "", region=region))
        elif note := _NOTE.match(line):
            flush()
            body = [note.group(2)]
            while k + 1 < len(lines) and (lines[k + 1].startswith("    ") or (not lines[k + 1].strip() and k + 2 < len(lines) and lines[k + 2].startswith("    "))):
                k += 1
                body.append(lines[k].strip())
            notes.extend(parse_markdown("\n".join(body).encode(), f"footnote:{note.group(1)}"))
        elif line.lstrip().startswith(">"):
            flush()
            body = []
            while k < len(lines) and lines[k].lstrip().startswith(">"):
                body.append(re.sub(r"^\s*> ?", "", lines[k]))
                k += 1
            k -= 1
            out.append(_block("quote", nested(body), region=region))
        elif _ITEM.match(line) and (not open_lines or not _ITEM.match(line).group(2) or _ITEM.match(line).group(2) == "1"):
            flush()
            items, links, depths = [], [], []
            while k < len(lines) and ((item := _ITEM.match(lines[k])) or (lines[k].strip() and lines[k].startswith(" "))):
                task = _TASK.match(item.group(3)) if item else None
                text, found = _inline(item.group(3)[task.end() :] if task else item.group(3) if item else lines[k].strip())
                if item:
                    # an item is nested below the items that begin further left; a task keeps its mark
                    depth = len(item.group(1))
                    while depths and depths[-1] >= depth:
                        depths.pop()
                    depths.append(depth)
                    items.append("  " * (len(depths) - 1) + (f"[{task.group(1).lower()}] " if task else "") + text)
                else:
                    items[-1] += f" {text}"
                links += found
                k += 1
            k -= 1
            out.append(_block("list", "\n".join(items), links=links, region=region))
        elif "|" in line and not open_lines and k + 1 < len(lines) and _DELIMITERS.match(lines[k + 1]):
            header = _cells(line)
            table = [header]
            k += 1
            while k + 1 < len(lines) and "|" in lines[k + 1] and lines[k + 1].strip():
                k += 1
                table.append((_cells(lines[k]) + [""] * len(header))[: len(header)])
            out.append(_block("table", "\n".join("\t".join(r) for r in table), region=region))
        else:
            open_lines.append(line)
        k += 1
    flush()
    return out + sorted(notes, key=lambda b: b["region"])


# --- HTML -----------------------------------------------------------------------------------------------------------

_SKIPPED = {"script", "style", "noscript", "template", "svg", "canvas", "iframe", "object"}
_BLOCKS = {"p", "li", "blockquote", "pre", "td", "th", *(f"h{k}" for k in range(1, 7))}
_EDGES = {"div", "section", "main", "article", "body", "ul", "ol", "table", "tr", "header", "footer", "nav", "aside", "br"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, dict]] = []  # the scope a block ends in, and the block
        self.text, self.links, self.kind, self.skip = "", [], "p", 0
        self.scope: list[str] = []
        self.seen: set[str] = set()

    def end_block(self) -> None:
        lines = [re.sub(r"[ \t\f\v]+", " ", l).strip() for l in self.text.split("\n")]
        text = "\n".join(l for l in lines if l) if self.kind != "pre" else self.text.strip("\n")
        if text:
            block = _block("heading", text, int(self.kind[1]), links=self.links) if re.fullmatch(r"h[1-6]", self.kind) else _block("paragraph", text, links=self.links)
            self.out.append((self.scope[0] if self.scope else "", block))
        self.text, self.links, self.kind = "", [], "p"

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skip += 1
        elif tag == "br":
            self.text += "\n"
        elif tag in _BLOCKS or tag in _EDGES:
            self.end_block()
            self.kind = tag if tag in _BLOCKS else "p"
            if tag in ("main", "article") and tag not in self.seen and tag not in self.scope:
                self.seen.add(tag)
                self.scope.insert(0, tag) if tag == "main" else self.scope.append(tag)
        elif tag == "a" and not self.skip:
            self.links += [v for k, v in attrs if k == "href" and v]

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in _BLOCKS or tag in _EDGES:
            self.end_block()
            if tag in self.scope:
                self.scope.remove(tag)

    def handle_data(self, data):
        if not self.skip:
            self.text += data if self.kind == "pre" else data.replace("\n", " ").replace("\r", " ")


def parse_html(data: bytes) -> list[dict]:
    """Headings and paragraphs of the first main, else of the first article, else of the page; never a guessed charset."""
    try:
        text = data.decode("utf-16") if data[:2] in (b"\xff\xfe", b"\xfe\xff") else data.decode("utf-8-sig")
    except UnicodeDecodeError:
        declared = re.search(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", data[:4096])
        try:
            text = data.decode(declared.group(1).decode()) if declared else None
        except (LookupError, UnicodeDecodeError) as e:
            raise Refused("charset") from e
        if text is None:
            raise Refused("charset") from None
    head = re.search(r"(?is)<body[\s>]", text)
    reader = _Reader()
    reader.feed(text[head.start() :] if head else re.sub(r"(?is)<head[\s>].*?</head>", "", text))
    reader.close()
    reader.end_block()
    scopes = {s for s, _ in reader.out}
    scope = next((s for s in ("main", "article") if s in scopes), None)
    return [b for s, b in reader.out if scope is None or s == scope]


# --- CSV and JSON as documents --------------------------------------------------------------------------------------


def _number(cell: str) -> bool:
    try:
        return bool(cell.strip()) and float(cell) is not None
    except ValueError:
        return False


def parse_csv(data: bytes) -> list[dict]:
    """One table: cells trimmed, blank rows dropped, short rows padded. `level` 1 marks a header: no number in it, one in the next five rows."""
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(_decoded(data), newline=""))]
    rows = [r for r in rows if any(r)]
    if not rows:
        raise Refused("empty")
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    header = not any(map(_number, rows[0])) and any(_number(c) for r in rows[1:6] for c in r)
    return [_block("table", "\n".join("\t".join(r) for r in rows), level=int(header))]


def _refuse_constant(name: str):
    raise Refused(f"number:{name}")


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise Refused("duplicate-key")
    return out


def load_json(text: str):
    """Strict JSON: no NaN or infinity, no key twice."""
    try:
        return json.loads(text, object_pairs_hook=_unique, parse_constant=_refuse_constant)
    except (json.JSONDecodeError, RecursionError) as e:
        raise Refused("not-json") from e


def flatten(value: object, path: str = "$") -> list[str]:
    """`path: value` lines of the leaves, in order; the stack is explicit, so depth is no limit."""
    out, stack = [], [(path, value)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict) and v:
            stack.extend((str(k) if at == "$" else f"{at}.{k}", x) for k, x in reversed(v.items()))
        elif isinstance(v, list) and v:
            stack.extend((f"{at}[{i}]", v[i]) for i in range(len(v) - 1, -1, -1))
        elif v == "" and isinstance(v, str):
            out.append(f"{at}:")
        else:
            out.append(f"{at}: {v if isinstance(v, str) else repr(v) if isinstance(v, float) else json.dumps(v)}")
    return out


def parse_json(data: bytes) -> list[dict]:
    """The lines of one value."""
    return [_block("paragraph", line) for line in flatten(load_json(_decoded(data)))]


def parse_jsonl(data: bytes) -> list[dict]:
    """The lines of each record; one bad line refuses the file."""
    records = [line.removesuffix("\r") for line in _decoded(data).split("\n")]
    values = [load_json(line) for line in records if line.strip()]
    return [_block("paragraph", line) for i, v in enumerate(values) for line in flatten(v, f"record[{i}]")]


# --- DOCX -----------------------------------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DROPPED = {f"{_W}{t}" for t in ("del", "moveFrom", "delText", "instrText")}


def _run_text(node: ElementTree.Element) -> str:
    """Text with insertions accepted and deletions dropped."""
    if node.tag in _DROPPED:
        return ""
    if node.tag == f"{_W}t":
        return node.text or ""
    if node.tag in (f"{_W}tab", f"{_W}br", f"{_W}cr"):
        page = node.get(f"{_W}type") == "page"
        return "" if page else "\t" if node.tag.endswith("tab") else "\n"
    if node.tag == f"{_W}footnoteReference":
        return f"[^{node.get(f'{_W}id')}]"
    if node.tag == f"{_W}pPr":
        return ""
    return "".join(map(_run_text, node))


def _docx_blocks(parent: ElementTree.Element, region: str) -> list[dict]:
    out: list[dict] = []
    for node in parent:
        if node.tag in (f"{_W}ins", f"{_W}moveTo", f"{_W}sdt", f"{_W}sdtContent"):
            out += _docx_blocks(node, region)
        elif node.tag == f"{_W}tbl":
            rows = [[" ".join(filter(None, (_run_text(p).strip() for p in c.iter(f"{_W}p")))) for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]
            out.append(_block("table", "\n".join("\t".join(r) for r in rows), region=region))
        elif node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "").lower().replace(" ", "") if style is not None else ""
            text = _run_text(node).strip()
            level = 1 if name == "title" else int(name[7:]) if re.fullmatch(r"heading[1-9]", name) else None
            listed = node.find(f"{_W}pPr/{_W}numPr/{_W}numId")
            field = "".join(t.text or "" for t in node.iter(f"{_W}instrText")) + "".join(f.get(f"{_W}instr") or "" for f in node.iter(f"{_W}fldSimple"))
            if re.match(r"\s*TOC\b", field) or re.fullmatch(r"toc[0-9]+", name):
                continue  # a table of contents repeats the headings
            if not text and node.find(f"{_W}pPr/{_W}pBdr/{_W}bottom") is not None:
                out.append(_block("rule", "", region=region))
                continue
            depth = node.find(f"{_W}pPr/{_W}numPr/{_W}ilvl")
            kind = "heading" if level else "code" if "code" in name else "quote" if "quote" in name else "list" if listed is not None or name.startswith("list") else "paragraph"
            key = (kind, listed.get(f"{_W}val") if listed is not None else name)
            if kind == "list" and depth is not None:
                text = "  " * min(int(depth.get(f"{_W}val") or 0), 8) + text
            if kind in ("code", "quote", "list") and out and out[-1].get("key") == key:
                out[-1]["text"] += ("\n\n" if kind == "quote" else "\n") + text
            elif text or kind == "heading":
                out.append({**_block(kind, text, level=min(level, 6) if level else None, region=region), "key": key})
    return out


def parse_docx(data: bytes) -> list[dict]:
    """Headings by style, runs of list, quote and code paragraphs as one block, tables, and footnotes."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if len(z.infolist()) > MAX_MEMBERS or any(i.file_size > MAX_MEMBER_BYTES for i in z.infolist()):
                raise Refused("archive-limits")
            parts = {n: z.read(n) for n in ("word/document.xml", "word/footnotes.xml") if n in z.namelist()}
    except zipfile.BadZipFile as e:
        raise Refused("not-a-zip") from e
    if "word/document.xml" not in parts or any(b"<!DOCTYPE" in p for p in parts.values()):
        raise Refused("no-document")
    try:
        trees = {n: ElementTree.fromstring(p) for n, p in parts.items()}
    except ElementTree.ParseError as e:
        raise Refused("not-xml") from e
    body = trees["word/document.xml"].find(f"{_W}body")
    out = _docx_blocks(body if body is not None else [], "body")
    if "word/footnotes.xml" in trees:
        for note in trees["word/footnotes.xml"].findall(f"{_W}footnote"):
            if note.get(f"{_W}type") is None:
                out += _docx_blocks(note, f"footnote:{note.get(f'{_W}id')}")
    for block in out:
        block.pop("key", None)
    return out


PARSERS = {
    **dict.fromkeys(("txt", "text"), parse_text),
    **dict.fromkeys(("md", "markdown"), parse_markdown),
    **dict.fromkeys(("html", "htm"), parse_html),
    "csv": parse_csv,
    "json": parse_json,
    "jsonl": parse_jsonl,
    "docx": parse_docx,
    **{suffix: (lambda data, s=suffix: parse_code(data, s)) for suffix in CODE},
}
