"""Small cases of the reference operators."""

from pyspark.sql import functions as F

from corpusmill.functions.text import char_shingles, jaccard_ppm, normalized
from corpusmill.operators import chunking, cleaning, curation, reports, splitting


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_page_numbers_go_and_inline_numbers_stay(spark):
    docs = rows(spark, [(1, "some long enough text 12 here\n 42 \nPage 3 of 9\nand the end of the text"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in cleaning.clean(docs, ("page-numbers",)).collect()}
    assert got == {1: "some long enough text 12 here\nand the end of the text", 2: None}


def test_a_rule_that_removes_too_much_is_skipped(spark):
    docs = rows(spark, [(1, "see http://example.org/long/address x")], "doc_id long, text string")
    assert cleaning.clean(docs, ("urls",)).first().text == "see http://example.org/long/address x"


def test_windows_overlap_and_short_texts_have_one(spark):
    docs = rows(spark, [(1, "".join(chr(97 + i % 26) for i in range(100))), (2, "short"), (3, ""), (4, None)], "doc_id long, text string")
    got = [(r.doc_id, r.start, r.chunk) for r in chunking.fixed_windows(docs, 30, 10).orderBy("doc_id", "seq").collect()]
    one = [c for d, _, c in got if d == 1]
    assert all(a[-10:] == b[:10] for a, b in zip(one, one[1:])) and got[-1] == (2, 0, "short")


def test_paragraphs_pack_greedily(spark):
    docs = rows(spark, [(1, "aaaa\n\nbb\n\n" + "c" * 20 + "\n\nd")], "doc_id long, text string")
    assert [r.chunk for r in chunking.paragraphs(docs, 10).orderBy("seq").collect()] == ["aaaa\n\nbb", "c" * 20, "d"]


def test_curation_order(spark):
    data = [(1, "a", "x", "t" * 9), (2, "a", "x", "t" * 9), (3, "a", "y", "u" * 9), (4, "a", "y", "v" * 9), (5, "a", "y", "s"), (6, "a", "z", "w" * 9), (7, "a", "q", None)]
    got = {r.record_id: r.reason for r in curation.curate(rows(spark, data, "record_id long, source string, context string, target string"), 5, 1).collect()}
    assert got == {1: None, 2: "exact-duplicate", 3: "conflict", 4: "conflict", 5: "target-too-short", 6: "source-cap", 7: "target-too-short"}


def test_split_keeps_groups_whole_and_clamps(spark):
    data = [(i, f"g{i % 3}") for i in range(9)]
    for ppm, groups in ((1, 1), (999_999, 2)):
        got = splitting.split_groups(rows(spark, data, "record_id long, group_id string"), "s", ppm).collect()
        assert len({r.group_id for r in got if r.partition == "evaluation"}) == groups
        assert len({(r.group_id, r.partition) for r in got}) == 3
    assert {r.partition for r in splitting.split_groups(rows(spark, [(1, "g")], "record_id long, group_id string")).collect()} == {"train"}


def test_similarity_of_normalised_texts(spark):
    docs = rows(spark, [("The  Same\tText ", "the same text"), ("", ""), ("abcdefg", "zzzzzzz")], "a string, b string")
    got = [r.j for r in docs.select(jaccard_ppm(char_shingles(normalized(F.col("a"))), char_shingles(normalized(F.col("b")))).alias("j")).collect()]
    assert got == [1_000_000, 1_000_000, 0]


def test_detectors_hit_once_for_each_document(spark):
    docs = rows(spark, [(1, "a@b.org c@d.org <SCRIPT >"), (2, None), (3, "AKIA" + "A" * 16)], "doc_id long, text string")
    assert sorted((r.doc_id, r.detector) for r in reports.detector_hits(docs).collect()) == [(1, "pii-email"), (1, "unsafe-script-tag"), (3, "secret-aws-access-key")]


def test_pairs_of_the_prefix_join_equal_all_pairs(spark):
    import random

    from corpusmill.operators.similarity import similar_pairs

    rng = random.Random(7)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 14))) for _ in range(60)]
    norm = [" ".join(t.split()).lower() for t in texts]
    sets = [{t[k : k + 5] for k in range(max(1, len(t) - 4))} if t else set() for t in norm]
    frame = rows(spark, list(enumerate(texts)), "id long, text string")
    for ppm in (300_000, 800_000, 1_000_000):
        want = {(i, j, len(sets[i] & sets[j]) * 1_000_000 // len(sets[i] | sets[j])) for i in range(60) for j in range(i + 1, 60) if sets[i] and sets[j]}
        got = {(r.a, r.b, r.similarity_ppm) for r in similar_pairs(frame, "id", "text", ppm).collect()}
        assert got == {w for w in want if w[2] >= ppm}


def test_groups_are_transitive(spark):
    from corpusmill.operators.graph import leakage_groups

    chain = [(i, f"t{i}") for i in range(30)] + [(i + 1, f"t{i}") for i in range(29)] + [(99, "alone"), (None, "t1"), (98, None)]
    got = {r.record_id: r.group_id for r in leakage_groups(rows(spark, chain, "record_id long, token string")).collect()}
    assert got == {**dict.fromkeys(range(30), 0), 99: 99}


def test_a_long_chain_in_any_order_is_one_group(spark):
    import random

    from corpusmill.operators.graph import leakage_groups

    ids = random.Random(3).sample(range(1, 1001), 1000)
    chain = [(ids[i], f"t{i + d}") for i in range(1000) for d in (0, 1)] + [(2000, "own")]
    got = {r.record_id: r.group_id for r in leakage_groups(rows(spark, chain, "record_id long, token string")).collect()}
    assert got == {i: 1 for i in ids} | {2000: 2000}


def test_edges_that_still_move_are_an_error(spark):
    import pytest

    from corpusmill.operators.graph import leakage_groups

    chain = [(7 * i % 101, f"t{i + d}") for i in range(100) for d in (0, 1)]
    with pytest.raises(RuntimeError):
        leakage_groups(rows(spark, chain, "record_id long, token string"), 1)


def test_mapping_rejects_the_first_bad_field(spark):
    from corpusmill.operators.mapping import map_rows

    data = [('{"a": {"b/c": ["x", "y"]}, "t": "u"}',), ('{"a": {"b/c": ["x"]}, "t": "u"}',), ('{"a": {"b/c": ["x", "y"]}, "t": ""}',)]
    got = map_rows(rows(spark, data, "payload string"), "payload", {"prompt": "/a/b~1c/1", "completion": "t"}).collect()
    assert [(r.prompt, r.reject) for r in got] == [("y", None), (None, "missing-source-path"), ("y", "empty-required-string")]


def test_keyed_hash_equals_the_standard_one(spark):
    import hmac

    from corpusmill.operators.review import hmac_sha256, review_sample

    for key in (b"k", b"long" * 30):
        got = rows(spark, [("é1",), ("",)], "s string").select(hmac_sha256(key, F.col("s")).alias("h")).collect()
        assert [r.h for r in got] == [hmac.new(key, m.encode(), "sha256").hexdigest() for m in ("é1", "")]
    assert review_sample(rows(spark, [(f"s{i}",) for i in range(9)], "subject string"), 3, "seed").count() == 3


def test_counts_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    from corpusmill.streaming.windows import event_counts

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    run.awaitTermination(60)
    key = lambda r: (str(r.start), r.event_type, r.n)
    assert sorted(map(key, spark.table("counts").collect())) == sorted(map(key, event_counts(events).collect()))


def test_written_rows_come_back(spark, tmp_path):
    from corpusmill.sources.tables import collect_files, read_texts, write_rows

    data = rows(spark, [("a", 'say "x", y\nz'), ("b", "é")], "split string, text string")
    for form in ("parquet", "jsonl", "csv"):
        write_rows(data, str(tmp_path / form), form)
    assert sorted(map(tuple, spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv")).collect())) == sorted(map(tuple, data.collect()))
    assert spark.read.json(str(tmp_path / "jsonl")).count() == spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    for name, text in (("a.txt", "one\n \ntwo"), ("b.txt", "one\n \ntwo"), ("c.txt", "three")):
        (tmp_path / "docs").mkdir(exist_ok=True)
        (tmp_path / "docs" / name).write_text(text)
    assert sorted(r.status.split(":")[0] for r in collect_files(spark, str(tmp_path / "docs")).collect()) == ["accepted", "accepted", "duplicate-bytes"]
    assert [r.text for r in read_texts(spark, str(tmp_path / "docs" / "a.txt")).orderBy("block").collect()] == ["one", "two"]


def test_blocks_of_a_page_have_levels_and_sections(spark):
    from corpusmill.sources.html import blocks

    page = "<html><script>var t='<p>no</p>'</script><h1 class=a>Top &amp; one</h1><p>First <b>bold</b>\n text</p><h2>Two</h2><p> </p><li>x</li></html>"
    got = [tuple(r) for r in blocks(rows(spark, [(1, page), (2, None), (3, "plain")], "page_id long, html string")).orderBy("block").collect()]
    assert got == [(1, 0, 1, 1, "Top & one"), (1, 1, 0, 1, "First bold text"), (1, 2, 2, 2, "Two"), (1, 3, 0, 2, "x")]


def test_sentences_end_where_readers_expect(spark):
    texts = {
        1: "Dr. Who came. He left! \"Why?\" asked e.g. the crowd. no capital. 3 went.",
        2: "\u4f60\u597d\u3002\u518d\u89c1\u3002",
        3: "\u041f\u0440\u0438\u0432\u0435\u0442. \u041a\u0430\u043a?",
        4: None,
        5: "  ",
    }
    got = chunking.sentences(rows(spark, list(texts.items()), "doc_id long, text string"), 1).orderBy("doc_id", "seq").collect()
    assert [(r.doc_id, r.chunk) for r in got] == [
        (1, "Dr. Who came."),
        (1, "He left!"),
        (1, "\"Why?\" asked e.g. the crowd. no capital."),
        (1, "3 went."),
        (2, "\u4f60\u597d\u3002"),
        (2, "\u518d\u89c1\u3002"),
        (3, "\u041f\u0440\u0438\u0432\u0435\u0442."),
        (3, "\u041a\u0430\u043a?"),
    ]


def test_heading_paths_follow_levels(spark):
    data = [(1, 0, 0, "a"), (1, 1, 1, "A"), (1, 2, 3, "C"), (1, 3, 0, "b"), (1, 4, 2, "B"), (1, 5, 1, "D"), (1, 6, 2, "E")]
    got = chunking.heading_paths(rows(spark, data, "page_id long, block long, level long, text string")).orderBy("block").collect()
    assert [r.path for r in got] == [[], ["A"], ["A", "C"], ["A", "C"], ["A", "B"], ["D"], ["D", "E"]]


def test_blocks_lie_in_the_windows_they_touch(spark):
    docs = rows(spark, [(1, "aaaa\nbb\n \ncccccccccc\nd"), (2, "")], "doc_id long, text string")
    placed = chunking.line_blocks(docs)
    at = {r.block: (r.start, r.end) for r in placed.collect()}
    assert at == {0: (0, 4), 1: (6, 8), 2: (10, 20), 3: (22, 23)}
    got = {(r.block, r.seq) for r in chunking.blocks_in_windows(placed, 5, 2).collect()}
    assert got == {(b, k) for b, (s, e) in at.items() for k in range(9) if s < 3 * k + 5 and e > 3 * k}


def test_own_rules_and_repeated_lines(spark):
    docs = rows(spark, [(1, "Head\nx1\n head\nHead\nHead "), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in cleaning.drop_repeated_lines(docs).collect()} == {1: "x1\n head", 2: None}
    assert docs.select(cleaning.custom(r"(x)(\d)", r"\2$\1")(F.col("text")).alias("t")).first().t == "Head\n1$x\n head\nHead\nHead "


def test_tool_traces_and_steps(spark):
    from corpusmill.operators.mapping import messages_ok, steps_ok, tool_turns_ok

    call = [("c1", "f", "{}")]
    good = [("user", "q", None, None), ("assistant", "a", None, call), ("tool", "r", "c1", None), ("assistant", "end", None, None)]
    cases = {
        1: good,
        2: good[:3],
        3: [good[0], ("assistant", "a", None, None), good[3]],
        4: [good[0], ("assistant", "a", None, [("c1", "", "{}")]), *good[2:]],
        5: [("user", "q", "id", None), *good[1:]],
        6: None,
        7: [good[0], good[1], ("tool", "r", None, None), good[3]],
    }
    turns = "array<struct<role string, content string, tool_call_id string, tool_calls array<struct<id string, name string, arguments string>>>>"
    got = rows(spark, list(cases.items()), f"id long, t {turns}").select("id", tool_turns_ok(F.col("t")).alias("ok")).collect()
    assert {r.id for r in got if r.ok} == {1}
    got = rows(spark, [(["a", "b"],), (["a"],), (["a", ""],), (None,)], "s array<string>").select(steps_ok(F.col("s")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, False, False, False]
    pair = [("user", "x"), ("assistant", "y")]
    got = rows(spark, [(pair,), (pair[::-1],), (pair[:1],), ([("user", ""), pair[1]],), (None,)], "m array<struct<role string, content string>>")
    assert [r.ok for r in got.select(messages_ok(F.col("m")).alias("ok")).collect()] == [True, False, False, False, False]


def test_rows_are_refused_for_the_first_reason(spark):
    from corpusmill.operators.mapping import reject_code

    cases = ['{"a":"x","b":"y"}', '{"a":"x","b":"y","c":1}', '{"a":"x"}', '{"a":"x","b":null}', '{"a":3,"b":"y"}', '{"a":"","b":"y"}', "[1]", "no json", None]
    got = rows(spark, [(c,) for c in cases], "p string").select(reject_code(F.col("p"), {"f": "a", "g": "/b"}).alias("r")).collect()
    assert [r.r for r in got] == [None, "unmapped-keys", "missing-source-path", "non-string-value", "non-string-value", "empty-required-string", *["missing-source-path"] * 3]
    kept = rows(spark, [('{"a":"x","partition":"train"}',), ('{"a":"x"}',), ('{"a":"x","partition":"dev"}',)], "p string").select(reject_code(F.col("p"), {"f": "a"}, "kept").alias("r")).collect()
    assert [r.r for r in kept] == [None, "invalid-partition", "invalid-partition"]


def test_payloads_have_sorted_keys(spark):
    from corpusmill.operators.mapping import payload_json

    got = rows(spark, [("c", "t", "e", ["s", "u"])], "c string, t string, e string, s array<string>").select(
        *[payload_json(k, F.col("c"), F.col("s" if k == "stepwise-trace" else "t"), F.col("e")).alias(k.replace("-", "_")) for k in ("preference-pair", "stepwise-trace", "messages")]
    ).first()
    assert got.preference_pair == '{"chosen":"t","prompt":"c","rejected":"e"}' and got.stepwise_trace == '{"prompt":"c","steps":["s","u"]}'
    assert got.messages == '{"messages":[{"content":"c","role":"user"},{"content":"t","role":"assistant"}]}'


def test_a_token_that_all_share_leaves_no_evaluation(spark):
    from corpusmill.operators.graph import keyed_groups

    data = [(i, "one source", None) for i in range(6)]
    groups = keyed_groups(rows(spark, data, "id long, source string, annotator string"), "id", ("source", "annotator"))
    assert {r.partition for r in splitting.split_groups(groups).collect()} == {"train"}
    alone = keyed_groups(rows(spark, data, "id long, source string, annotator string"), "id", ("annotator",))
    assert {r.record_id: r.group_id for r in alone.collect()} == {i: i for i in range(6)}


def test_reviews_decide_in_their_order(spark):
    candidates = rows(spark, [(1,), (2,), (3,)], "record_id long")
    reviews = rows(spark, [(1, 1, "accepted"), (1, 2, "rejected"), (2, 1, "accepted")], "record_id long, sequence long, verdict string")
    assert {r.record_id: r.status for r in curation.promote(candidates, reviews, True).collect()} == {1: "rejected", 2: "accepted", 3: "pending"}
    assert {r.status for r in curation.promote(candidates, reviews, False).collect()} == {"accepted"}


def test_facts_of_empty_tables_are_zero(spark):
    from corpusmill.operators import facts

    none = rows(spark, [], "record_id long, source string, lang string, target string, status string, reason string, partition string")
    out = facts.distribution_facts(none).unionByName(facts.detector_facts(none)).unionByName(facts.crossing_facts(none))
    assert all(r.value == 0 for r in out.collect())
    assert not any(r.reached for r in facts.gates(out).collect())


def test_family_facts_count_ties_gaps_and_lone_feedback(spark):
    from corpusmill.operators import facts

    columns = "label string, item string, rank string, tool_name string, tool_role string, feedback string, paired boolean"
    data = [("a", "i", "1", "t", None, "f", False), ("a", "i", "1", "t", "r", "f", True), ("", "i", "2", None, None, None, None), (None, None, "1", "", None, None, None)]
    got = {r.name: r.value for r in facts.family_facts(rows(spark, data, columns)).collect()}
    assert got == {"missing-labels": 1, "singleton-label-set": 1, "tool-role-gaps": 1, "unpaired-feedback": 1, "ranking-ties": 1}


def test_recognised_pages_are_judged_by_confidence(spark):
    from corpusmill.operators.facts import ocr_action

    got = rows(spark, [(None, None), (90.0, 29.0), (59.0, 40.0), (79.0, 40.0), (80.0, 30.0)], "mean double, least double").select(ocr_action(F.col("mean"), F.col("least")).alias("a")).collect()
    assert [r.a for r in got] == ["review", "refuse", "review", "warn", "accept"]


def test_a_gate_without_its_fact_is_null(spark):
    from corpusmill.operators import facts

    some = rows(spark, [("detector-hits", "pii", 0), ("missing-labels", "", 2)], "name string, key string, value long")
    got = {r.gate: (r.observed, r.reached) for r in facts.gates(some).collect()}
    assert got.pop("preview-detector-pii") == (0, False) and got.pop("preview-family-missing-label") == (2, True)
    assert set(got.values()) == {(None, None)}
