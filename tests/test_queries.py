"""Each registered reference query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from corpusmill.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    result = con.execute(queries.ORACLE_SQL[name])
    order = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted((tuple(r[k] for k in order) for r in result.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == want


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_near_copies_of_included_targets_equal_all_pairs(spark):
    from corpusmill.operators.facts import PREVIEW_PPM

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(r.record_id for r in queries.QUERIES["curate_documents"](spark, SF).filter("status = 'included'").collect())
    norm = {i: " ".join(docs[i][40:].split()).casefold() for i in ids}
    sets = {i: {t[k : k + 5] for k in range(max(1, len(t) - 4))} for i, t in norm.items()}
    ppm = {(a, b): len(sets[a] & sets[b]) * 1_000_000 // len(sets[a] | sets[b]) for a in ids for b in ids if a < b}
    want = {}
    for least in PREVIEW_PPM:
        label = {i: i for i in ids}
        for (a, b), p in ppm.items():
            if p >= least:
                label = {i: label[a] if x == label[b] else x for i, x in label.items()}
        sizes = [n for n in (list(label.values()).count(x) for x in set(label.values())) if n > 1]
        want |= {("near-duplicate-clusters", str(least)): len(sizes), ("near-duplicate-members", str(least)): sum(sizes)}
    got = {(r.name, r.key): r.value for r in queries.QUERIES["near_duplicate_targets"](spark, SF).collect()}
    assert got == want and want["near-duplicate-members", "800000"] > 0
    pairs = {(r.a, r.b): r.similarity_ppm for r in queries.QUERIES["similar_targets"](spark, SF).collect()}
    assert pairs == {k: p for k, p in ppm.items() if p >= 800_000}


def test_gates_of_the_report_see_near_duplicates_and_families(spark):
    got = {r.gate: (r.observed, r.reached) for r in queries.QUERIES["report_gates"](spark, SF).collect()}
    near = {(r.name, r.key): r.value for r in queries.QUERIES["near_duplicate_targets"](spark, SF).collect()}
    assert got["preview-near-duplicate-members"] == (near["near-duplicate-members", "800000"], True)
    assert got["preview-family-ranking-tie"][1] and got["preview-family-missing-label"] == (0, False)
    assert got["preview-split-malformed-role"][0] is not None and got["preview-family-unpaired-without-policy"][1]
