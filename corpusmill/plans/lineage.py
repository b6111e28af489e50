"""Queries on provenance, construction and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import set_id
from ..operators import chunking, cleaning, construction, curation, lineage
from ..sources import html
from ..sources.shared import written
from ..sources.tables import read_table
from .queries import _CURATED, _guarded_sql, _records
from .registry import digest, query
from .segments import _LINES, _PLACED

CLEANING = ("page-numbers", "whitespace", "urls", "emails")
_PATTERNS = {"page-numbers": (cleaning.PAGE_NUMBERS, ""), "whitespace": (cleaning.WHITESPACE, " "), "urls": (cleaning.URLS, ""), "emails": (cleaning.EMAILS, "")}


def _chain_sql(rules: tuple[str, ...], first: str, keys: str) -> str:
    """CTEs w0..wn over `first` (keys, t0): the text after each rule, and for each rule matches that change something, digests and a warning."""
    out, last = f"w0 AS ({first})", "w0"
    for k, rule in enumerate(rules):
        pattern, new = _PATTERNS[rule]
        out += f""",
u{k} AS (SELECT *, regexp_replace(t{k}, '{pattern}', '{new}', 'g') AS u, len(list_filter(regexp_extract_all(t{k}, '{pattern}'), lambda x: x <> '{new}')) AS n FROM {last}),
w{k + 1} AS (SELECT * EXCLUDE (u, n), {_guarded_sql(f"t{k}", "u")} AS t{k + 1}, CASE WHEN u <> t{k} THEN n ELSE 0 END AS e{k}, (length(t{k}) - length(u)) * 10 > length(t{k}) * {cleaning.MAX_REMOVED_TENTHS} AS x{k} FROM u{k})"""
        last = f"w{k + 1}"
    return out


_STEPS = " + ".join(f"(t{k} <> t{k + 1})::INT" for k in range(4))
_EDITS = " + ".join(f"CASE WHEN x{k} THEN 0 ELSE e{k} END" for k in range(4))


@query(
    f"WITH {_chain_sql(CLEANING, 'SELECT doc_id, text AS t0 FROM documents', 'doc_id')} SELECT doc_id, ({_STEPS})::BIGINT AS steps, ({_EDITS})::BIGINT AS edits, sha256(t4) AS cleaned_sha256, true AS replays FROM w4"
)
def cleaning_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning as steps, and whether a replay of the steps gives the cleaned text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = lineage.cleaning_steps(docs, CLEANING)
    edits = F.aggregate("steps", F.lit(0), lambda a, s: a + F.size(s["edits"])).cast("long")
    rows = rows.select("doc_id", F.size("steps").cast("long").alias("steps"), edits.alias("edits"), lineage.replay_ok(rows).alias("replays"), "cleaned")
    return digest(rows, "cleaned")


_RULES = ("page-numbers", "whitespace", "emails")
_BLOCK_CHAIN = _PLACED + ", " + _chain_sql(_RULES, "SELECT doc_id, block, part AS t0 FROM placed", "doc_id, block")
_DONE = _BLOCK_CHAIN + ", done AS (" + " UNION ALL ".join(f"SELECT doc_id, block, {k} AS rule_index, '{r}' AS rule, e{k}::INT AS edits, sha256(t{k}) AS input_sha256, sha256(t{k + 1}) AS output_sha256, x{k} AS warned FROM w3" for k, r in enumerate(_RULES)) + ")\n"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.line_blocks(read_table(spark, sf_dir, "documents"))


def _done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.transforms(_blocks(spark, sf_dir), _RULES)


@query(_DONE + "SELECT * FROM done")
def block_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _done(spark, sf_dir)


@query(_DONE + "SELECT doc_id, count(DISTINCT CASE WHEN edits > 0 AND NOT warned THEN block END) AS changed, 0::BIGINT AS breaks FROM done GROUP BY 1")
def transform_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed blocks of each document, and transforms that don't begin where the one before ended."""
    done = written(_done(spark, sf_dir), "transforms")
    broken = lineage.chain_breaks(done).groupBy("doc_id").agg(F.count(F.lit(1)).alias("breaks"))
    changed = lineage.changed_blocks(done).groupBy("doc_id").agg(F.count(F.lit(1)).alias("changed"))
    return done.select("doc_id").distinct().join(changed, "doc_id", "left").join(broken, "doc_id", "left").select("doc_id", F.coalesce("changed", F.lit(0)).alias("changed"), F.coalesce("breaks", F.lit(0)).alias("breaks"))


_WINDOWS = """wb AS (SELECT doc_id, block, seq FROM placed JOIN (
  SELECT doc_id, unnest(range(0, last // 900 + 1)) AS seq FROM (SELECT doc_id, max("end") AS last FROM placed GROUP BY 1)) w USING (doc_id)
WHERE "start" < seq * 900 + 1000 AND "end" > seq * 900)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.blocks_in_windows(_blocks(spark, sf_dir))


@query(_DONE.rstrip() + f", {_WINDOWS} SELECT wb.doc_id, seq, bool_or(hit IS NOT NULL) AS transformed FROM wb LEFT JOIN (SELECT DISTINCT doc_id, block, true AS hit FROM done WHERE edits > 0 AND NOT warned) c ON c.doc_id = wb.doc_id AND c.block = wb.block GROUP BY 1, 2")
def transformed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construction.transformed_chunks(_windows(spark, sf_dir), lineage.changed_blocks(_done(spark, sf_dir)))


@query(_DONE.rstrip() + f", {_WINDOWS} SELECT doc_id, seq, count(*) AS transforms FROM wb JOIN done USING (doc_id, block) WHERE edits > 0 AND NOT warned GROUP BY 1, 2")
def window_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lineage.relevant(_done(spark, sf_dir), _windows(spark, sf_dir))
    return found.groupBy("doc_id", "seq").agg(F.count(F.lit(1)).alias("transforms"))


@query(_PLACED.rstrip() + f", {_WINDOWS} SELECT doc_id, block, min(seq) AS seq FROM wb GROUP BY 1, 2")
def first_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construction.first_chunks(_windows(spark, sf_dir))


@query(_PLACED.rstrip() + f", {_WINDOWS} SELECT doc_id, block FROM placed WHERE part <> '' AND (doc_id, block) NOT IN (SELECT (doc_id, block) FROM wb WHERE seq % 2 = 0)")
def uncovered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that are lost if only every other window is kept."""
    return construction.coverage_gaps(_blocks(spark, sf_dir), _windows(spark, sf_dir).filter("seq % 2 = 0"))


@query(
    """SELECT doc_id, seq, seq * 900 AS "start", least(length(text), seq * 900 + 1000) AS "end", sha256(text) AS input_sha256, sha256(substr(text, seq * 900 + 1, 1000)) AS output_sha256, true AS replays, true AS bound FROM (
  SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 1000 THEN 1 ELSE ceil((length(text) - 1000) / 900.0)::BIGINT + 1 END)) AS seq FROM documents WHERE length(text) > 0)"""
)
def chunk_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slice step of each window, its replay, and whether the window is bound to its place."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = chunking.fixed_windows(docs).join(docs, "doc_id")
    start, end = F.col("start").cast("int"), (F.col("start") + F.length("chunk")).cast("int")
    rows = rows.withColumn("step", lineage.slice_step(F.col("text"), start, end).cast(lineage.STEP))
    again = F.coalesce(lineage.replayed(F.col("text"), F.array("step")) == F.col("chunk"), F.lit(False))
    return rows.select("doc_id", "seq", "start", end.cast("long").alias("end"), "step.input_sha256", "step.output_sha256", again.alias("replays"), construction.evidence_ok(F.col("chunk"), F.col("text"), start, end).alias("bound"))


@query(
    f"""WITH {_LINES}
SELECT doc_id, count(*) AS parts, sha256(string_agg(part, '' ORDER BY pos)) AS input_sha256, sha256(string_agg(part, chr(10) || chr(10) ORDER BY pos)) AS output_sha256, sum(length(part))::BIGINT AS characters, true AS replays FROM s GROUP BY 1"""
)
def joined_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step that joins the lines of a document, and its replay."""
    docs = read_table(spark, sf_dir, "documents")
    parts = F.filter(F.transform(F.split("text", "\n"), lambda b: F.regexp_replace(b, r"(?U)^\s+|\s+$", "")), lambda b: b != "")
    rows = docs.select("doc_id", parts.alias("parts")).filter(F.size("parts") > 0).withColumn("step", lineage.join_step(F.col("parts"), "\n\n"))
    again = F.sha2(lineage.joined(F.col("parts"), F.col("step")), 256).eqNullSafe(F.col("step.output_sha256"))
    total = F.aggregate("step.lengths", F.lit(0), lambda a, x: a + x).cast("long")
    return rows.select("doc_id", F.size("parts").cast("long").alias("parts"), "step.input_sha256", "step.output_sha256", total.alias("characters"), again.alias("replays"))


def _selected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Windows of all documents, and two documents in three as selected sources; some sources have no window."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = chunking.fixed_windows(docs).select(F.col("doc_id").alias("source"), "seq", F.col("chunk").alias("text"))
    more = docs.select((F.col("doc_id") + 1_000_000).alias("doc_id")).filter("doc_id % 100 = 0")
    sources = docs.select("doc_id").unionByName(more).filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("source"), F.concat(F.lit("docs/"), F.reverse(F.col("doc_id").cast("string"))).alias("locator"))
    return chunks, sources


_SELECTED = """WITH c AS (SELECT doc_id AS source, unnest(range(0, CASE WHEN length(text) <= 1000 THEN 1 ELSE ceil((length(text) - 1000) / 900.0)::BIGINT + 1 END)) AS seq, text FROM documents WHERE length(text) > 0),
s AS (SELECT doc_id AS source, 'docs/' || reverse(doc_id::VARCHAR) AS locator FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id + 1000000 FROM documents WHERE (doc_id + 1000000) % 100 = 0) WHERE doc_id % 3 <> 0),
t AS (SELECT locator, source, seq, substr(text, seq * 900 + 1, 1000) AS w FROM c JOIN s USING (source)),
k AS (SELECT *, greatest(1, least(length(w) - 1, length(w) * 500000 // 1000000)) AS cut FROM t WHERE length(w) >= 2)
"""


@query(_SELECTED + "SELECT row_number() OVER (ORDER BY locator, source, seq) AS ordinal, locator, source, seq, '' AS suffix, sha256(substr(w, 1, cut)) AS context_sha256, sha256(substr(w, cut + 1)) AS target_sha256 FROM k")
def constructed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, sources = _selected(spark, sf_dir)
    return digest(construction.construct(chunks, sources, "continuation"), "context", "target")


@query(_SELECTED + "SELECT source, 'source-chunks-unavailable' AS code FROM s WHERE source NOT IN (SELECT source FROM c)")
def construction_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construction.diagnostics(*_selected(spark, sf_dir))


@query(f"WITH p AS ({html.SQL}) SELECT DISTINCT page_id, section, block // 3 AS seq FROM p WHERE section > 0")
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which chunks of three blocks touch which section of a page."""
    blocks = html.blocks(read_table(spark, sf_dir, "pages"))
    return construction.chunks_of_sections(blocks.filter("section > 0"), blocks.withColumn("seq", F.expr("block div 3")))


@query(
    """WITH r AS (SELECT doc_id AS record_id, source, substr(text, 1, 12) AS c, substr(text, 41) AS t FROM documents),
g AS (SELECT source, c, count(DISTINCT t) AS variants, count(*) - 1 AS related FROM r GROUP BY 1, 2)
SELECT record_id, variants, related FROM r JOIN g USING (source, c) WHERE variants > 1"""
)
def conflict_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "source", F.substring("text", 1, 12).alias("context"), F.substring("text", F.lit(41), F.length("text")).alias("target"))
    return construction.conflicts(docs)


_COVERAGE = """, dd AS (SELECT record_id, status, [decided.source, 'lang:' || lang] AS sources FROM decided JOIN documents ON doc_id = record_id),
e AS (SELECT status, unnest(sources) AS source, unnest([0, 1]) AS nth FROM (SELECT status, list_transform(sources, lambda s: coalesce(s, 'none')) AS sources FROM dd)),
n AS (SELECT source, count(*) AS records, count(*) FILTER (status = 'included') AS included, count(*) FILTER (status = 'excluded') AS excluded, count(*) FILTER (status = 'quarantined') AS quarantined,
  count(*) FILTER (status = 'included' AND nth = 0) AS primary_included FROM e GROUP BY 1),
kk AS (SELECT coalesce(source, 'none') AS source, count(*) AS candidates FROM documents GROUP BY 1 UNION ALL SELECT 'extra', 7),
s AS (SELECT DISTINCT source FROM e UNION SELECT unnest(['extra', 'ghost']))
SELECT source, coalesce(candidates, 0) AS candidates, coalesce(records, 0) AS records, coalesce(included, 0) AS included, coalesce(excluded, 0) AS excluded, coalesce(quarantined, 0) AS quarantined,
  coalesce(primary_included, 0) AS primary_included, array_to_string(list_filter([CASE WHEN candidates IS NULL THEN 'no-constructed-candidates' END, CASE WHEN records IS NULL THEN 'no-dataset-records' END,
  CASE WHEN coalesce(included, 0) = 0 THEN 'no-included-contribution' END], lambda x: x IS NOT NULL), ',') AS blockers FROM s LEFT JOIN n USING (source) LEFT JOIN kk USING (source)"""


@query(_CURATED.rstrip() + _COVERAGE)
def coverage_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that count for their source and for their language, and selected sources without any."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.coalesce("source", F.lit("none")).alias("s"), F.coalesce(F.concat(F.lit("lang:"), "lang"), F.lit("none")).alias("l"))
    decided = curation.curate(_records(spark, sf_dir)).select("record_id", "status").join(docs, "record_id").select("record_id", F.array("s", "l").alias("sources"), "status")
    made = docs.select("record_id", F.array("s").alias("sources")).unionByName(spark.range(7).select((-F.col("id") - 1).alias("record_id"), F.array(F.lit("extra")).alias("sources")))
    known = docs.select(F.explode(F.array("s", "l")).alias("source")).unionByName(spark.createDataFrame([("extra",), ("ghost",)], "source string"))
    return construction.coverage(known, made, decided)


@query(
    _CURATED.rstrip()
    + """, keep AS (SELECT record_id AS keeper FROM decided WHERE status = 'included'),
m AS (SELECT record_id, record_id AS keeper FROM decided WHERE status = 'included' UNION ALL SELECT d.record_id, d.first FROM (SELECT j.record_id, f.first, k.reason FROM j JOIN f USING (source, c, t) JOIN decided k ON k.record_id = j.record_id) d WHERE reason = 'exact-duplicate')
SELECT keeper AS record_id, array_to_string(list_sort(list(DISTINCT r.lang)), ',') AS sources FROM m SEMI JOIN keep USING (keeper) JOIN documents r ON r.doc_id = m.record_id GROUP BY 1"""
)
def representative_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of each included record and of the copies that it stands for, as its origins."""
    records = _records(spark, sf_dir)
    decided = construction.representatives(records, curation.curate(records))
    origins = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.col("lang").alias("source"))
    return construction.representative_sources(origins, decided).select("record_id", F.array_join("sources", ",").alias("sources"))


@query(
    """SELECT source, 'lset-v1-' || sha256('corpusmill' || chr(0) || 'lset' || chr(0) || 'v1' || chr(0) || to_json({'labels': list_sort(list(DISTINCT quality::VARCHAR))})) AS label_set,
  'pset-v1-' || sha256('corpusmill' || chr(0) || 'pset' || chr(0) || 'v1' || chr(0) || to_json({'pairs': list_sort(list(DISTINCT {'chosen': lang, 'prompt': quality::VARCHAR, 'rejected': toxic::VARCHAR}))})) AS pair_set
FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL AND lang IS NOT NULL GROUP BY 1"""
)
def set_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of the label set of each source, and of a set of triples."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(read_table(spark, sf_dir, "labels"), "doc_id").filter("quality is not null and toxic is not null and lang is not null")
    triple = F.struct(F.col("lang").alias("chosen"), F.col("quality").cast("string").alias("prompt"), F.col("toxic").cast("string").alias("rejected"))
    sets = rows.groupBy("source").agg(F.collect_set(F.col("quality").cast("string")).alias("a"), F.collect_set(triple).alias("b"))
    return sets.select("source", set_id("lset", "labels", F.col("a")).alias("label_set"), set_id("pset", "pairs", F.col("b")).alias("pair_set"))
