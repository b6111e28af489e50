"""Decontamination, substring dedup, URL filter, near-duplicates and the pipeline against plain versions."""

import random
from collections import Counter
from hashlib import sha256
from itertools import combinations

import duckdb
import numpy as np
import pytest

from corpusmill.llm import decontamination, near_duplicates, substrings, urls

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(t):
    w = (t or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near_copies(rng):
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts


def plain_components(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, set()).add(shingles(t))
    best = {i: i for i in sets}

    def find(i):
        while best[i] != i:
            i = best[i]
        return i

    for a, b in combinations([i for i in sets if i is not None], 2):
        for x in sets[a]:
            for y in sets[b]:
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    u, v = find(a), find(b)
                    best[max(u, v)] = min(u, v)
    return {i: find(i) for i in best}


def test_near_duplicates_equal_all_pairs(spark, awkward, nothing):
    texts = near_copies(random.Random(3))
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()] + [(1000 + k, t) for k, t in enumerate(texts)]
    want = plain_components(rows)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter((i, len(shingles(t)), want[i], i is None or want[i] == i) for i, t in rows)
    assert near_duplicates.near_duplicates(nothing).count() == 0


def by_id(rows):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows)


def test_rows_of_one_id_with_different_texts_keep_their_links(spark):
    rng = random.Random(14)
    rows = []
    for k in range(40):  # 1 ~ 2, 2 has another text, which 3 resembles
        x, y = ([f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(2))
        a, b, c = 3 * k, 3 * k + 1, 3 * k + 2
        rows += [(a, " ".join(x)), (b, " ".join([*x[:-1], "end"])), (b, " ".join([*y[:-1], "end"])), (c, " ".join(y)), (c, "")]
    want = plain_components(rows)
    assert all(want[3 * k + j] == 3 * k for k in range(40) for j in range(3))
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert by_id(got) == Counter((i, len(shingles(t)), want[i] if t else i, i == (want[i] if t else i)) for i, t in rows)


def test_large_buckets_are_shared_out(spark, monkeypatch):
    """A template of which all copies are just under the limit, some just over it, in several cells."""
    monkeypatch.setattr(near_duplicates, "CELL", 200)
    rng = random.Random(15)
    template = [f"t{k}" for k in range(230)]
    rows = []
    for k in range(600):
        own = list(template)
        for a in (20, 100, 180, 226)[: 4 if k % 50 else 3]:  # each edit costs five shingles
            own[a] = f"u{rng.randrange(10**9)}"
        rows.append((k, " ".join(own)))
    sets = [shingles(t) for _, t in rows]
    assert 100 * len(sets[1] & sets[2]) < 85 * len(sets[1] | sets[2]) <= 101.5 * len(sets[1] & sets[2])
    want = plain_components(rows)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert by_id(got) == Counter((i, len(shingles(t)), want[i], want[i] == i) for i, t in rows) and 500 < len(set(want.values())) < 600


def test_components_of_a_long_chain_in_any_order(spark):
    ids = list(range(700))
    random.Random(16).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "u long, v long")
    got = near_duplicates.components(edges).collect()
    assert sorted((r.node, r.comp) for r in got) == [(k, 0) for k in range(700)]


def test_sketches_never_part_similar_sets(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    for n in (20, 150, 900, 6000):
        bits, sizes = [], []
        for _ in range(200):
            base = rng.integers(0, 1 << 63, int(n * 1.0811), dtype=np.uint64) * np.uint64(2)
            cut = len(base) - n
            a, b = np.unique(base[: len(base) - cut // 2 - 0]), np.unique(base[cut - cut // 2 :])
            x = near_duplicates.odd_sketch(a) ^ near_duplicates.odd_sketch(b)
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                bits.append(sum(int(v).bit_count() if v >= 0 else (int(v) + (1 << 64)).bit_count() for v in x.tolist()))
                sizes.append((len(a), len(b)))
        if bits:
            limit = spark.range(1).select(near_duplicates.most_differing_bits(F.lit(min(sizes)[0]), F.lit(min(sizes)[1]), 85).alias("m")).first().m
            assert max(bits) <= limit


def plain_repeats(rows, k=13):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: float("inf") if i is None else i
    for i, w in split:
        for s in range(len(w) - k + 1):
            x = tuple(w[s : s + k])
            first[x] = min(first.get(x, float("inf")), order(i))
    out = Counter()
    for i, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] < order(i):
                gone[s : s + k] = [True] * k
        out[(i, len(w), sum(gone), sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())] += 1
    return out


def test_repeats_equal_a_plain_scan(spark, awkward, nothing):
    rng = random.Random(8)
    texts = near_copies(rng)
    texts += [" ".join(rng.choice(texts).split()[a : a + 40] + rng.choice(texts).split()[:b]) for a, b in [(rng.randint(0, 20), rng.randint(0, 60)) for _ in range(60)]]
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()] + [(1000 + k, t) for k, t in enumerate(texts)]
    got = substrings.repeats_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_repeats(rows)
    assert substrings.repeats_report(nothing).count() == 0


def test_a_minimiser_of_every_document_is_split(spark, monkeypatch):
    """Half of all documents hold a phrase with the least piece in different surroundings, some surroundings repeat."""
    monkeypatch.setattr(substrings, "SPLIT", 8)
    rng = random.Random(18)
    phrase = "the same five words here".split()
    rows = []
    for k in range(300):
        own = [f"w{rng.randrange(40)}" for _ in range(9)] + phrase + [f"w{rng.randrange(40)}" for _ in range(9)]
        if k % 3 == 0 and rows:
            own = rng.choice(rows)[1].split()[:20] + own
        rows.append((k, " ".join(own)))
    got = substrings.repeats_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_repeats(rows)
    words, at = substrings._flat([t for _, t in rows])
    hashes = substrings._word_hashes(words, len(words))
    first, stop, _, keys, before = substrings._keyed(hashes, at, np.empty(0, np.uint64), 13, 5, 64)
    top = Counter(before.tolist()).most_common(1)[0][0]
    first2, stop2, _, keys2, before2 = substrings._keyed(hashes, at, np.array([top], np.uint64), 13, 5, 64)
    assert len(set((keys2[before2 == top] >> np.uint64(32)).tolist())) > 10
    cover = lambda a, b: sorted(w for x, y in zip(a.tolist(), b.tolist()) for w in range(x, y))
    assert cover(first, stop) == cover(first2, stop2)


def test_super_kmers_cover_each_window_once():
    texts = ["a b c d e f g h i j k l m n o p q r s t", "", "too short", " ".join("xyxxyxyyxyxyxyxyxxyy")]
    words, at = substrings._flat(texts)
    first, stop, text, _ = substrings.super_kmers(substrings._word_hashes(words, len(words)), at)
    seen = [s for a, b in zip(first.tolist(), stop.tolist()) for s in range(a, b)]
    assert seen == [s for a, b in zip(at.tolist(), at[1:].tolist()) for s in range(a, b - 12)]


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_leaks_are_found_and_clean_documents_are_not(spark, nothing, threshold):
    """With anchors broadcast, and with sort-merge joins throughout."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        leaks(spark, nothing)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def leaks(spark, nothing):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(500)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [text(rng.randint(15, 60)) for _ in range(20)] + [["three", "short", "words"], []]
    docs, want = [], set()
    for k in range(80):
        body = text(rng.randint(0, 300))
        if k % 3 == 0:
            j = rng.randrange(20)
            leak = list(items[j])
            if k % 2:
                leak[-1] = leak[-1].upper() + "!"
            body[len(body) // 2 : len(body) // 2] = leak
            want.add((k, j))
        if k % 7 == 0:
            body += items[(k + 1) % 20][:9]  # a part is no leak
        docs.append((k, " ".join(body)))
    docs += [(100, None), (101, ""), (None, " ".join(items[4])), (102, "Three, short: words")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)] + [(None, None)], "item_id long, text string")
    got = decontamination.find_leaks(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want | {(None, 4), (102, 20)}
    assert sorted(r.doc_id for r in decontamination.decontaminate(frame, bench).collect()) == [i for i in [*range(80), 100, 101] if i not in {a for a, _ in want}]
    assert decontamination.find_leaks(nothing, bench).count() == 0


def plain_windows(docs, items, limit=0.8):
    """(doc, item) -> best (similarity, first start) over every window of the item's size."""
    gram = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    out = {}
    for i, text in docs:
        w = text.lower().split()
        for j, item in items:
            v = item.split()
            want, size = gram(v), len(v) - 4
            known = [tuple(w[k : k + 5]) in want for k in range(len(w) - 4)]
            for a in range(len(w) - len(v) + 1):
                if sum(known[a : a + size]) * 1.8 < size:
                    continue
                common = sum((gram(w[a : a + len(v)]) & want).values())
                score = common / (2 * size - common)
                if score >= limit and score > out.get((i, j), (0, 0))[0]:
                    out[(i, j)] = (score, a)
    return out


def test_every_window_is_tried(spark):
    """Edits, moved halves, repeated words and near items: all windows of all sizes against the operator."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [text(rng.choice([15, 24, 40, 80])) for _ in range(24)]
    items.append([*items[3][:-2], "x", "y"])  # a near copy of another item
    items.append(["ho"] * 30)  # one shingle, many times
    items.append(items[5])
    docs = []
    for k in range(260):
        v = list(items[rng.randrange(len(items))])
        if k % 4 == 0:
            v = v[len(v) // 2 :] + v[: len(v) // 2]
        for _ in range(rng.randint(0, max(1, len(v) // 25))):
            v[rng.randrange(len(v))] = "edit"
        if k % 5 == 0:
            v = v[:3] + v[:-3]
        docs.append((k, " ".join(text(rng.randint(0, 30)) + v + text(rng.randint(0, 30)))))
    bench = list(enumerate(" ".join(v) for v in items))
    want = plain_windows(docs, bench)
    got = {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert set(got) <= set(want) and all(abs(r.similarity_ppm / 1e6 - want[k][0]) < 2e-6 and r.start == want[k][1] for k, r in got.items() if k in want and want[k][0] > 0.86)
    assert {k for k, (score, _) in want.items() if score >= 0.86} <= set(got)
    assert len(got) >= 0.98 * len(want) and sum(score < 0.9 for score, _ in want.values()) > 20


def test_swapped_halves_are_leaks(spark):
    rng = random.Random(12)
    items = [[f"w{rng.randrange(500)}" for _ in range(80)] for _ in range(20)]
    docs = [(k, " ".join([*"a b c d e f g h".split(), *v[40:], *v[:40], *"i j k l m".split()])) for k, v in enumerate(items)]
    bench = [(k, " ".join(v)) for k, v in enumerate(items)]
    got = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(20)}


def test_extra_columns_and_long_texts_of_decontamination(spark):
    rng = random.Random(13)
    item = " ".join(f"w{rng.randrange(900)}" for _ in range(30))
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(60_000))
    rows = [(1, long + " " + item, 1, 2, "a"), (1, "other", 1, 2, "b"), (2, long, 1, 2, "c"), (None, item, 1, 2, "d"), (3, None, 1, 2, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, h int, item_id string")
    bench = spark.createDataFrame([(7, item, 1), (8, item, 2)], "item_id long, text string, n int")
    got = decontamination.find_leaks(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.start) for r in got) == [(0, 7, 0), (0, 8, 0), (1, 7, 60_000), (1, 8, 60_000)]
    assert [r.item_id for r in decontamination.decontaminate(docs, bench).orderBy("item_id").collect()] == ["c", "e"]


def test_blocks_find_all_fingerprints_within_the_radius():
    rng = random.Random(1)
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), decontamination.RADIUS))
        assert any(not (flips >> a) & ((1 << (b - a)) - 1) for a, b in zip(decontamination.EDGES, decontamination.EDGES[1:]))


def test_url_rules_and_reputation_equal_sql(spark):
    data = [(1, "http://A.example.net/en/x?y"), (2, "https://example.net"), (3, "http://example.net/de/"), (4, "ftp://x.example.com/de/1#z"), (5, None), (6, "no scheme"), (7, "http://b.org/fr/"),
            (8, "http://badexample.net/en/"), (None, "http://bad.example.org/a"), (9, "http://É.shop.co.uk/?q")]
    data += [(20 + k, f"http://bad.example.org/{k}") for k in range(40)] + [(100 + k, f"http://good.example.org/{k}") for k in range(40)] + [(1, "http://A.example.net/en/x?y")]
    labels = [(20 + k, 0, 1) for k in range(40)] + [(100 + k, 1, 0) for k in range(40)] + [(None, 0, 0), (2, None, None), (3, 1, None)]
    pages, marks = spark.createDataFrame(data, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = urls.judge_urls(pages, marks).collect()
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    con.register("labels", marks.toArrow())
    assert Counter(map(tuple, got)) == Counter(con.execute(urls.SQL).fetchall())
    by = {r.page_id: r for r in got}
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert by[2].rule is None and by[3].rule == "net/" and by[4].verdict == "block" and (by[5].host, by[6].path) == ("", "")
    assert by[25].verdict == "block" and by[101].verdict == "allow"


def test_registered_domains(spark, nothing):
    hosts = {"a.b.example.co.uk": "co.uk example.co.uk", "me.github.io": "github.io me.github.io", "x.y.com.mx": "com.mx y.com.mx", "shop.example.com": "com example.com", "com": "com com",
             "github.io": "github.io github.io", "u:p@www.example.org:8080": "org example.org", "example.org.": "org example.org", "10.0.0.1:80": "10.0.0.1 10.0.0.1", "[::1]:8080": "[::1] [::1]",
             "a.b.c.ck": "c.ck b.c.ck", "www.ck": "ck www.ck", "": " ", "b.city.own.test": "own.test city.own.test"}
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r.host: f"{r.suffix} {r.domain}" for r in urls.with_domains(frame, [*urls.SUFFIXES, "// a comment", "", "own.test"]).collect()}
    assert got == hosts


def test_url_tables_without_rows_and_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://x.example.org/fr/", "h", "b", 1, 2), (None, None, None, None, None, None)], "page_id long, url string, host string, bad string, n int, suffix int")
    labels = spark.createDataFrame([(1, 1, 0, "x")], "doc_id long, quality int, toxic int, host string")
    for marks in (labels, labels.limit(0)):
        got = sorted(urls.judge_urls(pages, marks).collect(), key=str)
        assert [(r.page_id, r.host, r.rule, r.verdict) for r in got] == [(1, "x.example.org", "org/fr/", "allow"), (None, "", None, "allow")]
    assert urls.judge_urls(pages.limit(0), labels).count() == 0


def test_pipeline_of_awkward_and_empty_tables(spark, awkward, nothing, tmp_path):
    """Nulls, repeats, long texts and columns with the operators' own names; and no rows at all."""
    import corpus_pipeline

    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    extra = awkward.selectExpr("*", "'b' as base", "'m' as more", "'f' as found", "1 as n", "'r' as `row`", "'x' as `__gone`", "'y' as `__leaked`")
    extra.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs = extra
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, f"{tmp_path}/a").toArrow(), docs.schema)
        assert docs.columns == extra.columns, name
    assert 0 < docs.count() < extra.count()
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert Counter(r.decoded_sha256 for r in got) == Counter(sha256((r.text or "").encode()).hexdigest() for r in docs.collect())
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    nothing.write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).toArrow())
        assert docs.columns == columns, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    want = {r.doc_id: sha256(r.text.encode()).hexdigest() for r in docs.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in last} == want
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(want)
