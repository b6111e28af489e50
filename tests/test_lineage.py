"""Provenance steps, construction, mapping codes, validation and dataset folders on small data."""

import json
import os
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import identity
from corpusmill.functions.arrays import match_spans, prefix_sums
from corpusmill.operators import construction, goals, lineage, mapping, validation
from corpusmill.sources import sinks, tables


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_prefix_sums_and_spans(spark):
    values = [[], [3], list(range(1000))]
    got = rows(spark, [(v,) for v in values], "v array<int>").select(prefix_sums(F.col("v")).alias("s")).collect()
    assert [r.s for r in got] == [[sum(v[: k + 1]) for k in range(len(v))] for v in values]
    spans = rows(spark, [("é12🤦345x6",), ("",)], "t string").select(match_spans(F.col("t"), "[0-9]+").alias("m")).collect()
    assert [[tuple(x) for x in r.m] for r in spans] == [[(1, 3, "12"), (4, 7, "345"), (8, 9, "6")], []]


def test_folded_like_the_standard(spark):
    from corpusmill.functions.text import folded

    texts = ["Straße ΣΑΣ ﬁn ŉ", "plain", "", "İI", "ẞ", None]
    got = rows(spark, [(t,) for t in texts], "t string").select(folded(F.col("t")).alias("f")).collect()
    assert [r.f for r in got] == [t if t is None else t.casefold() for t in texts]


def test_steps_replay_and_refuse_what_differs(spark):
    text = "one two  three"
    frame = rows(spark, [(text,)], "t string")
    edits = lambda *e: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(x).alias("expected"), F.lit(y).alias("replacement")) for a, b, x, y in e]).cast(lineage.EDITS)
    good = lineage.edits_step(F.col("t"), edits((3, 4, " ", "_"), (7, 9, "  ", " "))).cast(lineage.STEP)
    made = "one_two three"
    cut = lineage.slice_step(F.lit(made), F.lit(4), F.lit(7)).cast(lineage.STEP)
    got = frame.select(lineage.replayed(F.col("t"), F.array(good, cut)).alias("a"), lineage.replayed(F.lit("other"), F.array(good)).alias("b")).first()
    assert (got.a, got.b) == ("two", None)
    for bad in (edits((0, 3, "two", "")), edits((0, 5, "one t", ""), (4, 6, "tw", "")), edits((10, 99, "x", ""))):
        assert frame.select(lineage.edited(F.col("t"), bad).alias("x")).first().x is None
    assert frame.select(lineage.edited(F.col("t"), edits((0, 0, "", ">"))).alias("x")).first().x == ">" + text
    assert frame.select(lineage.sliced(F.col("t"), F.lit(2), F.lit(99)).alias("x")).first().x is None
    parts = F.array(F.lit("a"), F.lit("bc"), F.lit(""))
    step = lineage.join_step(parts, "--")
    one = frame.select(lineage.joined(parts, step).alias("x"), lineage.joined(F.array(F.lit("a"), F.lit("b")), step).alias("y")).first()
    assert (one.x, one.y) == ("a--bc--", None)


def test_diffs_lead_from_one_text_to_the_other(spark):
    pairs = [(1, "The Cat SAT", "the cat sat"), (2, "", "new"), (3, "same", "same"), (4, None, None), (5, "é🤦x", "🤦yx")]
    frame = rows(spark, pairs, "doc_id long, before string, after string")
    got = lineage.diff_edits(frame).join(frame, "doc_id").select("doc_id", "after", lineage.edited(F.coalesce("before", F.lit("")), F.col("edits")).alias("made"), F.size("edits").alias("n")).collect()
    assert {r.doc_id: (r.made, r.n > 0) for r in got} == {i: (a or "", (b or "") != (a or "")) for i, b, a in pairs}


def test_constructors_by_name(spark):
    chunks = rows(spark, [("s1", 0, "first second", "H"), ("s1", 1, "x", None), ("s0", 0, "other", None)], "source string, seq int, text string, heading string")
    sources = rows(spark, [("s1", "b"), ("s0", "c"), ("s9", "a")], "source string, locator string")
    got = construction.construct(chunks, sources, "full_text").orderBy("ordinal").collect()
    assert [(r.ordinal, r.source, r.seq, r.target) for r in got] == [(1, "s1", 0, "first second"), (2, "s1", 1, "x"), (3, "s0", 0, "other")]
    assert [r.context for r in construction.construct(chunks, sources, "section_reconstruction").collect()] == ["H"]
    assert [r.source for r in construction.diagnostics(chunks, sources).collect()] == ["s9"]
    for objective in (*mapping.IMPORT_ONLY, "nothing"):
        with pytest.raises(ValueError):
            construction.constructor(objective)
    assert construction.repeated_keys(chunks, "source").first().source == "s1"


def test_codes_of_lists(spark):
    turn = lambda **k: k
    user, end = turn(role="user", content="q"), turn(role="assistant", content="a")
    call = turn(role="assistant", content="c", tool_calls=[{"id": "1", "name": "f", "arguments": "{}"}])
    tool = turn(role="tool", content="r", tool_call_id="1")
    cases = [
        ([user, call, tool, end], None), ([user, end], "invalid-messages"), ([user, end, end], "invalid-messages"), ([user, call, tool], "invalid-messages"),
        ([user, {**call, "tool_calls": []}, end], "invalid-messages"), ([user, {**tool, "tool_call_id": ""}, end], "empty-required-string"), ([{**user, "content": ""}, call, end], "empty-required-string"),
        ([{**user, "x": 1}, call, end], "invalid-messages"), ([user, {**call, "tool_calls": [{"id": "1", "name": "f"}]}, end], "invalid-messages"), ([{"role": "who", "content": "x"}, call, end], "invalid-messages"), ("text", "invalid-messages"),
    ]
    payload = rows(spark, [(json.dumps({"conversation_id": "c", "turns": t}),) for t, _ in cases], "p string")
    got = payload.select(mapping.contract_code(F.col("p"), "tool-call-conversation").alias("c")).collect()
    assert [r.c for r in got] == [c for _, c in cases]
    steps = [(["a", "b"], None), (["a"], "empty-required-string"), (["a", ""], "empty-required-string"), (["a", 1], "empty-required-string"), ("ab", "empty-required-string")]
    payload = rows(spark, [(json.dumps({"prompt": "p", "steps": s}),) for s, _ in steps] + [('{"prompt":"p"}',), ('{"prompt":"p","steps":["a","b"],"x":1}',), ("[]",)], "p string")
    assert [r.c for r in payload.select(mapping.contract_code(F.col("p"), "stepwise-trace").alias("c")).collect()] == [c for _, c in steps] + ["wrong-keys"] * 3


def test_pointers_with_odd_keys(spark):
    payload = json.dumps({"0": "digit", "it's": "quote", 'say "x"': "double", "both'\"": "both", "a/b": {"~": "tilde"}, "l": ["x", {"y": "z"}], "n": 1.5, "t": True, "v": None, "": "blank"})
    frame = rows(spark, [(payload,)], "p string")
    pointers = {"0": "digit", "it's": "quote", 'say "x"': "double", "both'\"": "both", "/a~1b/~0": "tilde", "/l/0": "x", "/l/1/y": "z", "/l/2": None, "/l/x": None, "n": "1.5", "t": "true", "v": None, "gone": None}
    got = frame.select(*[mapping.resolve(F.col("p"), k).alias(f"c{i}") for i, k in enumerate(pointers)]).first()
    assert list(got) == list(pointers.values())
    codes = {"/l/2": "missing-source-path", "/l/x": "invalid-mapped-fields", "/n/a": "invalid-mapped-fields", "gone": "missing-source-path", "/l/1/y": None}
    assert list(frame.select(*[mapping.pointer_code(F.col("p"), k).alias(f"c{i}") for i, k in enumerate(codes)]).first()) == list(codes.values())
    strict = {"/l/0": ("x", "identity-string"), "/l/00": None, "/t": ("true", "json-scalar-v1"), "/v": ("null", "json-scalar-v1"), "/n": None, "/l": None}
    got = frame.select(*[mapping.strict_scalar(F.col("p"), k).alias(f"c{i}") for i, k in enumerate(strict)]).first()
    assert [tuple(x) if x else None for x in got] == list(strict.values())


def test_plans_are_confirmed_and_accept_something(spark):
    plan = mapping.template("prompt-completion")
    digest = mapping.confirmation(plan, {"a.jsonl": "0" * 64})
    assert mapping.confirmed(plan, {"a.jsonl": "0" * 64}, digest) == plan and plan["row_schema"] == "prompt_completion"
    with pytest.raises(ValueError):
        mapping.confirmed(plan, {"a.jsonl": "1" * 64}, digest)
    data = rows(spark, [('{"prompt":"p","completion":"c"}',), ('{"prompt":"p","completion":3}',)], "payload string")
    good, bad = mapping.mapped(data, "payload", plan["fields"], plan["row_schema"])
    assert [(r.prompt, r.completion) for r in good.collect()] == [("p", "c")] and [r.reason_code for r in bad.collect()] == ["non-string-value"]
    with pytest.raises(ValueError):
        mapping.mapped(data.limit(0), "payload", plan["fields"])
    assert set(mapping.TEMPLATES.values()) <= set(mapping.DETECTORS) and {mapping.template(t)["row_schema"] for t in mapping.TEMPLATES} == set(mapping.ROW_SCHEMAS)


def test_goals(spark):
    assert goals.resolve("continue-a-passage", "conversation") == {"objective": "continuation", "row_schema": "messages", "loss_policy": "final-assistant-suffix"}
    for bad in (("nothing", None), ("learn-the-text", "conversation")):
        with pytest.raises(ValueError):
            goals.resolve(*bad)
    with pytest.raises(ValueError):
        goals.by_mode(rows(spark, [("a.txt",)], "path string"), "other")
    assert all(g.objective in mapping.ROLES for g in goals.GOALS.values())


def test_admission_of_imported_rows(spark):
    assert goals.compatible("continuation", "messages") and not goals.compatible("full_text", "messages")
    data = rows(spark, [(1, "s", "p"), (2, "s", ""), (3, None, "p")], "record_id long, source string, prompt string")
    assert {r.record_id: r.refusal for r in goals.admitted(data, "stepwise").collect()} == {1: None, 2: "missing-shared-prompt", 3: "missing-source"}
    assert set(goals.ADMISSIONS) == set(mapping.IMPORT_ONLY)


def test_archives_and_plans(spark, tmp_path):
    import hashlib
    import zipfile

    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("a")
    (tmp_path / "f" / "b.txt").write_text("b")
    target = str(tmp_path / "x.zip")
    sinks.zip_folder(str(tmp_path / "f"), target)
    data = open(target, "rb").read()
    assert sinks.verify_zip(target, hashlib.sha256(data).hexdigest()) == [] and sinks.verify_zip(target, "0" * 64) == ["digest"]
    with zipfile.ZipFile(str(tmp_path / "y.zip"), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("b", "x")
        z.writestr("../a", "y")
    assert {w.split(":")[0] for w in sinks.verify_zip(str(tmp_path / "y.zip"))} == {"order", "name", "form"}
    open(str(tmp_path / "z.zip"), "wb").write(b"no")
    assert sinks.verify_zip(str(tmp_path / "z.zip")) == ["not-a-zip"]
    frame = rows(spark, [("train", "p", "c")], "partition string, prompt string, completion string")
    assert sinks.export_plan(frame, "trl") == {"export": "trl", "columns": ["partition", "prompt", "completion"], "rows": {"train": 1}}
    with pytest.raises(ValueError):
        sinks.export_plan(frame, "bundle")


def test_names_and_ids(spark):
    paths = ["a/b", "/a", "a//b", "a/./b", "..", "a\\b", "C:x", "", "a\0", "é", "a/..b", None]
    got = rows(spark, [(p,) for p in paths], "p string").select(identity.logical_path_ok(F.col("p")).alias("ok")).collect()
    assert [r.ok for r in got] == [p in ("a/b", "é", "a/..b") for p in paths]
    one = rows(spark, [("é", ["b", "a"], ["a", "b", "a"])], "t string, x array<string>, y array<string>")
    r = one.select(identity.nfc("t").alias("n"), identity.set_id("k", "m", F.col("x")).alias("a"), identity.set_id("k", "m", F.col("y")).alias("b"), identity.artifact_id("k", F.col("t"), F.col("x"), "me", "1", "0").alias("c"), identity.artifact_id("k", F.col("t"), F.col("y"), "me", "1", "0").alias("d")).first()
    assert r.n == unicodedata.normalize("NFC", "é") and r.a == r.b and r.c.startswith("art-v1-") and r.d is None


def test_collections_have_limits(spark):
    files = rows(spark, [("b.txt", 1, "x"), ("a.txt", 1, "x"), ("c.md", 9, "y"), ("d/.e/f.txt", 1, "z"), ("g.exe", 1, "w"), ("h.txt", 1, "v"), ("i.txt", 1, "u")], "path string, size long, sha256 string")
    got = {r.path: (r.status, r.reason) for r in tables.collection(files, max_files=2, max_bytes=5).collect()}
    assert got == {"a.txt": ("accepted", None), "b.txt": ("duplicate", "duplicate-bytes:a.txt"), "c.md": ("refused", "too-large"), "d/.e/f.txt": ("ignored", "hidden"), "g.exe": ("ignored", "unsupported-suffix"), "h.txt": ("accepted", None), "i.txt": ("refused", "too-many-files")}
    got = {r.path for r in tables.collection(files, include=("*.txt",), exclude=("b*",)).filter("status = 'accepted'").collect()}
    assert got == {"a.txt", "h.txt", "i.txt"}


def test_a_listing_of_any_length(spark, tmp_path):
    from corpusmill.plans import checks

    spark.range(16_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.status: r["count"] for r in checks.collected_files(spark, str(tmp_path)).groupBy("status").count().collect()}
    taken = sum(1 for k in range(16_000) if k % 11 and k % 7 and k % 13)
    assert "refused" not in got and got["accepted"] == taken
    files = spark.range(10_005).select(F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(".txt")).alias("path"), F.lit(1).alias("size"), F.col("id").cast("string").alias("sha256"))
    assert tables.collection(files).filter("reason = 'too-many-files'").count() == 5 and tables.collection(files, max_files=None).filter("status = 'accepted'").count() == 10_005


def test_documents_and_folders_of_a_dataset(spark, tmp_path):
    data = [("train", 1, 10, '{"text":"b"}'), ("train", 0, 11, '{"text":"a \\"q\\""}'), ("evaluation", 0, 12, '{"text":"é"}')]
    frame = rows(spark, data, "partition string, ordinal long, record_id long, payload string")
    sinks.write_json(frame, str(tmp_path / "one"))
    got = json.loads("".join(r.value for r in spark.read.text(str(tmp_path / "one")).collect()))
    assert got["splits"] == {"evaluation": [{"text": "é"}], "train": [{"text": 'a "q"'}, {"text": "b"}]} and [p["record_id"] for p in got["provenance"]["train"]] == ["11", "10"]
    sinks.write_dataset_folder(frame, str(tmp_path / "folder"))
    assert json.load(open(tmp_path / "folder" / "dataset_dict.json")) == {"splits": ["evaluation", "train"]}
    state = json.load(open(tmp_path / "folder" / "train" / "state.json"))
    tables_ = [pa.ipc.open_stream(str(tmp_path / "folder" / "train" / f["filename"])).read_all() for f in state["_data_files"]]
    assert sorted(x for t in tables_ for x in t["record_id"].to_pylist()) == [10, 11]
    sent = sinks.handoff(frame)
    assert sinks.consumed(frame, sent) and not sinks.consumed(frame.filter("record_id <> 12"), sent)
    assert os.path.isdir(tmp_path / "folder" / "evaluation")


def test_a_document_is_made_and_read_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "DOCUMENT_ROWS", 2, raising=False)
    data = [("train", k, k, f'{{"text":"{k} \\"a\\":["}}') for k in range(500)] + [("a \"b\"", 1, 7, '{"x":\n[]}'), ("a \"b\"", 1, 7, '{"x":\n[]}'), ("é", 0, 8, '"s"')]
    frame = rows(spark, data, "partition string, ordinal long, record_id long, payload string").repartition(7)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        sinks.write_json(frame, str(tmp_path / "one"))
        whole = json.loads((tmp_path / "one").read_text(encoding="utf-8"))
        read = sinks.read_json(spark, str(tmp_path / "one"))
        assert read.rdd.getNumPartitions() > 10
        got = sorted((r.partition, r.payload) for r in read.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((p, x.replace("\n", " ")) for p, _, _, x in data)
    assert whole["splits"] == {"a \"b\"": [{"x": []}] * 2, "train": [{"text": f'{k} "a":['} for k in range(500)], "é": ["s"]}
    assert [p["record_id"] for p in whole["provenance"]["train"]] == [str(k) for k in range(500)] and not os.path.exists(tmp_path / "one.parts")
    with pytest.raises(FileExistsError):
        sinks.write_json(frame, str(tmp_path / "one"))
    sinks.write_json(frame.limit(0), str(tmp_path / "none"))
    assert json.loads((tmp_path / "none").read_text()) == {"provenance": {}, "splits": {}} and sinks.read_json(spark, str(tmp_path / "none")).count() == 0


def test_gates_of_an_empty_and_a_tiny_dataset(spark):
    record = rows(spark, [("d", 1, "s", "c", "t" * 300), ("d", 2, "s", "c2", "u" * 300)], "dataset string, record_id long, source string, context string, target string")
    decisions = rows(spark, [("d", 1, "included"), ("d", 2, "included")], "dataset string, record_id long, status string")
    sides = rows(spark, [("d", 1, "g1", "train"), ("d", 2, "g2", "evaluation")], "dataset string, record_id long, group_id string, partition string")
    payload = record.join(sides, ["dataset", "record_id"]).select("dataset", "record_id", "partition", F.lit("continuation").alias("objective"), mapping.payload_json("prompt_completion", F.col("context"), F.col("target")).alias("payload"))
    got = validation.validate(record, record, decisions, sides, payload, validation.manifest(payload)).orderBy("place").collect()
    assert [r.gate for r in got] == list(validation.GATES) and {r.status for r in got} == {"passed"}
    none = [d.limit(0) for d in (record, record, decisions, sides, payload)]
    assert validation.validate(*none, validation.manifest(payload.limit(0))).count() == 0
    one_side = payload.filter("partition = 'train'")
    got = {r.gate: r.status for r in validation.validate(record, record, decisions, sides, one_side, validation.manifest(payload)).collect()}
    assert got["row-binding"] == "failed" and got["schema"] == got["partition-nonempty"] == "blocked" and got["snapshot"] == "failed" and got["split"] == "passed"


def test_specifications_are_strict():
    from corpusmill.operators import recipe

    spec = recipe.load('{"window": {"size": 10, "overlap": 2}}')
    assert spec["window"] == {"size": 10, "overlap": 2} and spec["curation"] == recipe.DEFAULTS["curation"]
    bad = ['[]', '{"x": 1}', '{"window": {"y": 1}}', '{"window": 3}', '{"cleaning": ["nothing"]}', '{"goal": "none"}', '{"window": {"overlap": 1000}}', '{"split": {"evaluation_ppm": 0}}', '{"instruction": "x"}', '{"representation": "instruction-and-output"}', '{"curation": {"cap": "3"}}']
    for text in bad:
        with pytest.raises(ValueError):
            recipe.load(text)


def test_workspaces_keep_history(spark, tmp_path):
    from corpusmill.sources.workspace import Cancelled, Workspace, cancel, stages

    space = Workspace(spark, str(tmp_path / "w"))
    assert space.history() == [] and space.verify() == []
    first, second = rows(spark, [(1, "a"), (2, None)], "id long, t string"), rows(spark, [(3, "c")], "id long, t string")
    space.commit("clean", first)
    space.commit("split", second)
    space.commit("clean", second)
    assert [e["stage"] for e in space.history()] == ["clean", "split", "clean"] and space.verify() == []
    assert space.read("clean").collect() == second.collect() and space.replayed("clean", second) and not space.replayed("clean", first)
    with pytest.raises(ValueError):
        space.read("none")
    folder = space.history()[1]["folder"]
    first.write.mode("overwrite").parquet(str(tmp_path / "w" / folder))
    assert space.verify() == ["2: table"]
    done = []
    with pytest.raises(Cancelled):
        stages(spark, [("a", lambda: done.append("a")), ("b", lambda: done.append("b"))], "run-1", stop=lambda: bool(done))
    assert done == ["a"]
    cancel(spark, "run-1")


def test_previews_and_reviews_of_nothing(spark):
    from corpusmill.operators import exchange, preview

    none = rows(spark, [], "source long, path string, text string")
    assert preview.preflight(none, "continue-a-passage").count() == 0
    items = rows(spark, [("q", 1, True, "c", "t")], "queue string, subject long, required boolean, context string, target string")
    sent = exchange.packets(items)
    assert exchange.unresolved(sent, exchange.submitted(sent, rows(spark, [], "packet string, evidence string, verdict string, sequence int"))).count() == 1
    good = sent.selectExpr("packet", "evidence", "'rejected' as verdict", "1 as sequence").union(sent.selectExpr("packet", "evidence", "'waived'", "2"))
    assert exchange.unresolved(sent, exchange.submitted(sent, good)).count() == 0


def _shuffled(spark):
    """Bytes that this session has written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    every = sc.statusStore().executorList(False)
    return sum(every.apply(k).totalShuffleWrite() for k in range(every.size()))


def test_a_recipe_moves_digests_rather_than_texts(spark):
    from corpusmill.operators import recipe

    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: F.sha2(F.concat_ws("-", "id", k), 256)), " ")
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 10 == 7, F.lit("x" * 900)).otherwise(text).alias("text"))
    spec = recipe.load(json.dumps({"window": {"size": 1000, "overlap": 100}, "curation": {"cap": 9}}))
    before = _shuffled(spark)
    got = recipe.run(docs, spec).collect()
    assert _shuffled(spark) - before < 3_000_000  # of 5.2 million characters
    assert sorted(tuple(r.record_id) for r in got) == [(0, k) for k in range(9)] and {r.partition for r in got} == {"train", "evaluation"}
    for r in got:
        row = json.loads(r.payload)
        assert len(row["prompt"]) == len(row["completion"]) == 500


def test_gates_move_digests_rather_than_texts(spark):
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: F.sha2(F.concat_ws("-", "record_id", k), 256)), " ")
    record = spark.range(400).select(F.lit("d").alias("dataset"), F.col("id").alias("record_id"), F.concat(F.lit("s"), (F.col("id") % 20).cast("string")).alias("source"), F.col("id").cast("string").alias("context"), F.col("id").alias("n")).withColumn("target", text).drop("n")
    key = F.col("record_id")
    decisions = record.select("dataset", "record_id", F.lit("included").alias("status"))
    sides = record.select("dataset", "record_id", F.concat(F.lit("g"), key.cast("string")).alias("group_id"), F.when(key % 10 == 0, "evaluation").otherwise("train").alias("partition"))
    side = F.when(key % 10 == 0, "evaluation").otherwise("train").alias("partition")
    said = F.when(key == 1, F.concat("target", F.lit("!"))).otherwise(F.col("target"))
    payload = record.select("dataset", "record_id", side, F.lit("continuation").alias("objective"), mapping.payload_json("prompt_completion", F.col("context"), said).alias("payload"))
    replay = record.withColumn("context", F.when(key == 2, "other").otherwise(F.col("context")))
    before = _shuffled(spark)
    got = {r.gate: r.faults for r in validation.validate(record, replay, decisions, sides, payload, validation.manifest(payload)).collect()}
    assert _shuffled(spark) - before < 1_000_000  # of three times 7.8 million characters
    assert {g for g, n in got.items() if n} == {"construction-replay", "masking"} and got["masking"] == got["construction-replay"] == 1


def test_included_records_are_those_of_curation(spark):
    from corpusmill.operators import curation

    data = [(k, [None, "a", "b"][k % 3], [None, "c", "d", "e"][k // 3 % 4], [None, "", "tt", "uu", "tt"][k * k // 7 % 5]) for k in range(200)] + [(500 + k, "a", f"c{k // 2}", "vv") for k in range(9)]
    records = rows(spark, data, "record_id long, source string, context string, target string")
    for least in (0, 1, 2):
        for cap in (0, 2, 100):
            want = {r.record_id for r in curation.curate(records, least, cap).filter("status = 'included'").collect()}
            assert {r.record_id for r in curation.included(records, least, cap).collect()} == want, (least, cap)
