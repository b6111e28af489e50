"""The registered queries over the reference tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..operators import chunking, cleaning, curation, graph, mapping, reports, similarity, splitting
from ..sources import html
from ..sources.tables import read_table
from ..streaming import windows
from .registry import ORACLE_SQL, QUERIES, digest, query

#: The query that `entry` runs.
FLAGSHIP = "curate_documents"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]


def _guarded_sql(before: str, after: str) -> str:
    return f"CASE WHEN (length({before}) - length({after})) * 10 > length({before}) * {cleaning.MAX_REMOVED_TENTHS} THEN {before} ELSE {after} END"


@query(
    f"""WITH a AS (SELECT doc_id, text AS t0, regexp_replace(text, '{cleaning.PAGE_NUMBERS}', '', 'g') AS u FROM documents),
b AS (SELECT doc_id, {_guarded_sql("t0", "u")} AS t1 FROM a),
c AS (SELECT doc_id, t1, regexp_replace(t1, '{cleaning.WHITESPACE}', ' ', 'g') AS u FROM b),
d AS (SELECT doc_id, {_guarded_sql("t1", "u")} AS t2 FROM c),
e AS (SELECT doc_id, t2, regexp_replace(t2, '{cleaning.URLS}', '', 'g') AS u FROM d),
f AS (SELECT doc_id, {_guarded_sql("t2", "u")} AS t3 FROM e),
g AS (SELECT doc_id, t3, regexp_replace(t3, '{cleaning.EMAILS}', '', 'g') AS u FROM f)
SELECT doc_id, sha256({_guarded_sql("t3", "u")}) AS text_sha256 FROM g"""
)
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(cleaning.clean(docs, ("page-numbers", "whitespace", "urls", "emails")), "text")


@query(
    """SELECT doc_id, line, count(*) AS n FROM (
  SELECT doc_id, regexp_replace(regexp_replace(l, '^[\\s\\v\\x1c-\\x1f]+', ''), '[\\s\\v\\x1c-\\x1f]+$', '') AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents))
WHERE length(line) BETWEEN 1 AND 80 GROUP BY 1, 2 HAVING count(*) >= 3"""
)
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.repeated_lines(read_table(spark, sf_dir, "documents"))


@query(
    """SELECT doc_id, seq, seq * 900 AS start, sha256(substr(text, seq * 900 + 1, 1000)) AS chunk_sha256 FROM (
  SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 1000 THEN 1 ELSE ceil((length(text) - 1000) / 900.0)::BIGINT + 1 END)) AS seq
  FROM documents WHERE length(text) > 0)"""
)
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(chunking.fixed_windows(read_table(spark, sf_dir, "documents")), "chunk")


@query(
    """WITH c AS (SELECT doc_id, text, greatest(1, least(length(text) - 1, length(text) * 500000 // 1000000)) AS cut FROM documents WHERE length(text) >= 2)
SELECT doc_id, sha256(substr(text, 1, cut)) AS prompt_sha256, sha256(substr(text, cut + 1)) AS completion_sha256 FROM c"""
)
def continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(chunking.continuation(read_table(spark, sf_dir, "documents")), "prompt", "completion")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("record_id"), "source", F.substring("text", 1, 40).alias("context"), F.substring("text", F.lit(41), F.length("text")).alias("target"))


_CURATED = """WITH r AS (SELECT doc_id AS record_id, source, substr(text, 1, 40) AS c, substr(text, 41) AS t FROM documents),
k AS (SELECT source, c, count(DISTINCT t) > 1 AS clash FROM r WHERE length(t) >= 200 GROUP BY 1, 2),
j AS (SELECT r.*, clash FROM r LEFT JOIN k ON r.source = k.source AND r.c = k.c),
f AS (SELECT source, c, t, min(record_id) AS first FROM j WHERE length(t) >= 200 AND NOT clash GROUP BY 1, 2, 3),
o AS (SELECT first, row_number() OVER (PARTITION BY source ORDER BY first) AS rank FROM f),
d AS (SELECT j.record_id, j.source, CASE WHEN length(j.t) < 200 THEN 'target-too-short' WHEN clash THEN 'conflict'
    WHEN j.record_id <> f.first THEN 'exact-duplicate' WHEN o.rank IS NULL OR o.rank > 30 THEN 'source-cap' END AS reason
  FROM j LEFT JOIN f ON j.source = f.source AND j.c = f.c AND j.t = f.t LEFT JOIN o ON j.record_id = o.first),
decided AS (SELECT record_id, source, CASE WHEN reason IS NULL THEN 'included' WHEN reason = 'conflict' THEN 'quarantined' ELSE 'excluded' END AS status, reason FROM d)
"""


@query(_CURATED + "SELECT record_id, source, status, reason FROM decided")
def curate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.curate(_records(spark, sf_dir))


@query(
    _CURATED
    + """SELECT source, count(*) AS records, sum((status = 'included')::BIGINT)::BIGINT AS included, sum((status = 'excluded')::BIGINT)::BIGINT AS excluded,
  sum((status = 'quarantined')::BIGINT)::BIGINT AS quarantined, CASE WHEN sum((status = 'included')::BIGINT) = 0 THEN 'no-included-record' END AS blocker FROM decided GROUP BY 1"""
)
def coverage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.coverage(curation.curate(_records(spark, sf_dir)))


_SPLIT = """WITH r AS (SELECT doc_id AS record_id, source, sha256(text) AS group_id FROM documents),
g AS (SELECT group_id, count(*) AS size, sha256('seed' || group_id) AS h FROM r GROUP BY 1),
w AS (SELECT group_id, sum(size) OVER (ORDER BY h, group_id) AS running, (SELECT sum(size) FROM g) AS total FROM g),
b AS (SELECT coalesce(arg_min(running, struct_pack(gap := gap, cut := running)), 0) AS cut FROM (
  SELECT running, abs(running - greatest(1, least(total - 1, (total * 100000 + 500000) // 1000000))) AS gap FROM w WHERE running < total)),
assigned AS (SELECT record_id, source, group_id, CASE WHEN running <= cut THEN 'evaluation' ELSE 'train' END AS partition FROM r JOIN w USING (group_id), b)
"""


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_groups(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.sha2("text", 256).alias("group_id")))


@query(_SPLIT + "SELECT record_id, group_id, partition FROM assigned")
def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir)


@query(
    _SPLIT
    + """SELECT source, train, evaluation, abs(train - evaluation) * 1000000 // (train + evaluation) AS imbalance_ppm FROM (
  SELECT source, sum((partition = 'train')::BIGINT)::BIGINT AS train, sum((partition = 'evaluation')::BIGINT)::BIGINT AS evaluation FROM assigned GROUP BY 1)"""
)
def split_comparability(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "source")
    return reports.comparability(_assigned(spark, sf_dir).join(sources, "record_id"))


@query("SELECT length(text) AS length, count(*) AS n FROM documents GROUP BY 1")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.length_histogram(read_table(spark, sf_dir, "documents"))


@query("SELECT lang AS value, count(*) AS n FROM documents GROUP BY 1")
def language_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tally(read_table(spark, sf_dir, "documents"), "lang")


@query("SELECT role AS value, count(*) AS n FROM conversations GROUP BY 1")
def role_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tally(read_table(spark, sf_dir, "conversations"), "role")


@query(" UNION ALL ".join(f"SELECT doc_id, '{f}' AS family, '{n}' AS detector FROM documents WHERE regexp_matches(text, '{p}')" for f, n, p in reports.DETECTORS))
def detector_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.detector_hits(read_table(spark, sf_dir, "documents"))


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM benchmark)")
def reference_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.reference_leakage(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query(
    """WITH m AS (SELECT conv_id, count(*) AS n, list(role ORDER BY turn) AS roles, bool_or(coalesce(text, '') = '') AS blank FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN n <> 2 THEN 'turn-count' WHEN roles[1] <> 'user' OR roles[2] <> 'assistant' THEN 'role-order' WHEN blank THEN 'empty-content' END AS reason FROM m"""
)
def message_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.message_rejects(read_table(spark, sf_dir, "conversations"))


@query("SELECT doc_id, greatest(1, ceil(length(text) / 4.0))::BIGINT AS tokens FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


@query(
    """WITH RECURSIVE t AS (SELECT doc_id, sha256(text) AS token FROM documents UNION SELECT doc_id, 'line:' || string_split(text, chr(10))[1] FROM documents),
r AS (SELECT DISTINCT doc_id AS node, doc_id AS label FROM t UNION SELECT b.doc_id, r.label FROM r JOIN t a ON a.doc_id = r.node JOIN t b ON a.token = b.token)
SELECT node AS record_id, min(label) AS group_id FROM r GROUP BY 1"""
)
def leakage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "text")
    same = docs.select("record_id", F.sha2("text", 256).alias("token"))
    line = docs.select("record_id", F.concat(F.lit("line:"), F.substring_index("text", "\n", 1)).alias("token"))
    return graph.leakage_groups(same.union(line))


@query(
    """WITH n AS (SELECT item_id, replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss') AS t FROM benchmark),
s AS (SELECT DISTINCT item_id, substr(t, i, 5) AS g FROM (SELECT item_id, t, unnest(range(1, greatest(2, length(t) - 3))) AS i FROM n) WHERE t <> ''),
z AS (SELECT item_id, count(*) AS size FROM s GROUP BY 1),
p AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.item_id < y.item_id GROUP BY 1, 2)
SELECT a, b, c * 1000000 // (u.size + v.size - c) AS similarity_ppm FROM p JOIN z u ON u.item_id = a JOIN z v ON v.item_id = b
WHERE c * 1000000 // (u.size + v.size - c) >= 30000"""
)
def similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_pairs(read_table(spark, sf_dir, "benchmark"), "item_id", "text", 30_000)


@query(
    """WITH u AS (SELECT conv_id, min(turn) AS ut FROM conversations WHERE role = 'user' GROUP BY 1),
a AS (SELECT c.conv_id, ut, min(turn) AS reply FROM conversations c JOIN u USING (conv_id) WHERE role = 'assistant' AND turn > ut GROUP BY 1, 2)
SELECT a.conv_id, sha256(x.text) AS instruction_sha256, '' AS input, sha256(y.text) AS output_sha256 FROM a
JOIN conversations x ON x.conv_id = a.conv_id AND x.turn = ut JOIN conversations y ON y.conv_id = a.conv_id AND y.turn = reply"""
)
def alpaca_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapping.alpaca(mapping.first_exchanges(read_table(spark, sf_dir, "conversations")))
    return digest(rows, "instruction", "output")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.event_counts(read_table(spark, sf_dir, "events"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '(?i)<p[ >]'))::BIGINT AS paragraphs FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", F.trim(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("title"), F.regexp_count("html", F.lit("(?i)<p[ >]")).cast("long").alias("paragraphs"))


@query("SELECT lang, quality, toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2, 3")
def label_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(read_table(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query(html.SQL)
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.blocks(read_table(spark, sf_dir, "pages"))


from . import facts, rows, segments  # noqa: E402, F401, I001 (they register their queries)
from . import checks, lineage, previews  # noqa: E402, F401
