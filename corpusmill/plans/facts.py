"""Queries on quality facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..operators import curation, facts, similarity, splitting
from ..operators.reports import DETECTORS
from ..sources.shared import written
from ..sources.tables import read_table
from .queries import _CURATED, _SPLIT, _records
from .registry import query


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their curation and split decisions, written once for the facts to share."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "source", "lang", F.substring("text", F.lit(41), F.length("text")).alias("target"), F.sha2("text", 256).alias("group_id"))
    decided = curation.curate(_records(spark, sf_dir)).select("record_id", "status", "reason")
    sides = splitting.split_groups(docs).select("record_id", "partition")
    return written(docs.drop("group_id").join(decided, "record_id").join(sides, "record_id"), "judged")


_JUDGED = (
    _CURATED
    + ", "
    + _SPLIT.removeprefix("WITH ").replace("r AS (SELECT doc_id AS record_id, source, sha256(text)", "sr AS (SELECT doc_id AS record_id, source, sha256(text)").replace("FROM r GROUP", "FROM sr GROUP").replace("FROM r JOIN w", "FROM sr JOIN w").rstrip()
    + """,
judged AS (SELECT record_id, documents.source, lang, substr(text, 41) AS target, status, reason, partition FROM documents
  JOIN decided ON doc_id = record_id JOIN (SELECT record_id, partition FROM assigned) USING (record_id)),
inside AS (SELECT * FROM judged WHERE status = 'included'),
facts(name, key, value) AS (
"""
)
_DISTRIBUTIONS = " UNION ALL ".join(
    [f"SELECT '{s}-records', '', count(*) FROM judged WHERE status = '{s}'" for s in ("included", "excluded", "quarantined")]
    + ["SELECT 'empty-targets', '', count(*) FROM inside WHERE target = ''"]
    + [f"SELECT '{c}-distribution', {c}, count(*) FROM inside WHERE {c} IS NOT NULL GROUP BY 2" for c in ("source", "lang", "partition")]
    + ["SELECT 'reason-distribution', reason, count(*) FROM judged WHERE reason IS NOT NULL GROUP BY 2"]
    + ["SELECT 'target-length-distribution', length(target)::VARCHAR, count(*) FROM inside GROUP BY 2"]
)
_HITS = " UNION ALL ".join(
    "SELECT 'detector-hits', '{}', count(*) FROM inside WHERE {}".format(f, " OR ".join(f"regexp_matches(target, '{p}')" for g, _, p in DETECTORS if g == f)) for f in dict.fromkeys(g for g, _, _ in DETECTORS)
)
_CROSSING = "SELECT 'crossing-targets', '', count(*) FROM (SELECT 1 FROM inside GROUP BY target HAVING count(DISTINCT partition) > 1)"
_TOKENS = """SELECT 'token-distribution', greatest(1, ceil(length(target) / 4.0))::BIGINT::VARCHAR, count(*) FROM inside GROUP BY 2
  UNION ALL SELECT 'truncated-records', '', count(*) FROM inside WHERE ceil(length(target) / 4.0) > 512"""
_FACTS = _JUDGED + " UNION ALL ".join([_DISTRIBUTIONS, _HITS, _CROSSING, _TOKENS]) + ")\n"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts_of(_judged(spark, sf_dir))


def _facts_of(rows: DataFrame) -> DataFrame:
    out = facts.distribution_facts(rows).unionByName(facts.detector_facts(rows)).unionByName(facts.crossing_facts(rows))
    return out.unionByName(facts.token_facts(rows, token_estimate(F.col("target")), 512))


@query(_FACTS + "SELECT name, key, value::BIGINT AS value FROM facts")
def quality_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir)


_GATE_ROWS = ", ".join(f"('{g}', '{n}', '{k}', {t})" for g, (n, k, t) in facts.GATES.items())


@query(
    _FACTS
    + f"""SELECT gate, sum(value)::BIGINT AS observed, sum(value) >= least_value AS reached
FROM (VALUES {_GATE_ROWS}) v(gate, n, k, least_value) LEFT JOIN facts ON name = n AND key = k GROUP BY gate, least_value"""
)
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates on the facts of `quality_facts` alone, null for other facts. `report_gates` has all of them."""
    return facts.gates(_facts(spark, sf_dir))


@query(
    _CURATED
    + """SELECT count(*) AS records, count(*) FILTER (status = 'included') AS included, count(*) FILTER (status = 'excluded') AS excluded, count(*) FILTER (status = 'quarantined') AS quarantined,
  min(n) AS least, max(n) AS most, sum(n)::BIGINT AS characters FROM (
  SELECT status, CASE WHEN status = 'included' THEN length(t) END AS n FROM decided JOIN r USING (record_id))"""
)
def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    return facts.statistics(curation.curate(rows).select("record_id", "status").join(rows.select("record_id", "target"), "record_id"))


@query(_CURATED + "SELECT 'conflict' AS queue, record_id AS subject, false AS required FROM decided WHERE reason = 'conflict'")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.review_queue(curation.curate(_records(spark, sf_dir)))


def _family_facts_of(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """Family facts of rows (label, item), whose label is also the rank, and of turns: late ones name a tool, even ones its role; answers are feedback, the second turn's is paired."""
    text = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    labelled = rows.select("label", "item", F.col("label").alias("rank"), *text("tool_name", "tool_role", "feedback"), F.lit(False).alias("paired"))
    told = [F.when(F.col("turn") >= 2, F.col("role")).alias("tool_name"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("tool_role"), F.when(F.col("role") == "assistant", "x").alias("feedback")]
    return facts.family_facts(labelled.unionByName(turns.select(*text("label", "item", "rank"), *told, (F.col("turn") == 1).alias("paired"))))


_TURN_FACTS = """SELECT unnest(['tool-role-gaps', 'unpaired-feedback', 'malformed-roles']) AS name, '' AS key,
    unnest([count(*) FILTER (turn >= 2 AND turn % 2 = 1 AND coalesce(role, '') <> ''), count(*) FILTER (role = 'assistant' AND turn IS DISTINCT FROM 1),
      (SELECT count(*) FROM (SELECT count(*) AS n, arg_min(role, turn) AS a, arg_max(role, turn) AS b FROM conversations GROUP BY conv_id) WHERE n = 2 AND (a IS DISTINCT FROM 'user' OR b IS DISTINCT FROM 'assistant'))]) AS value FROM conversations"""


@query(
    f"""SELECT name, '' AS key, value::BIGINT AS value FROM (
  SELECT unnest(['missing-labels', 'singleton-label-set']) AS name,
    unnest([count(*) FILTER (quality IS NULL), (count(DISTINCT quality) = 1)::BIGINT]) AS value FROM labels
  UNION ALL SELECT name, value FROM ({_TURN_FACTS}) WHERE name <> 'malformed-roles'
  UNION ALL SELECT 'ranking-ties', coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY source, quality))"""
)
def family_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("item"))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("label"))
    return _family_facts_of(labels.join(docs, "doc_id", "left"), read_table(spark, sf_dir, "conversations"))


@query(
    """WITH RECURSIVE n AS (SELECT item_id, replace(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))), 'ß', 'ss') AS t FROM benchmark),
s AS (SELECT DISTINCT item_id, substr(t, i, 5) AS g FROM (SELECT item_id, t, unnest(range(1, greatest(2, length(t) - 3))) AS i FROM n) WHERE t <> ''),
z AS (SELECT item_id, count(*) AS size FROM s GROUP BY 1),
p AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.item_id <> y.item_id GROUP BY 1, 2),
e AS (SELECT a, b, c * 1000000 // (u.size + v.size - c) AS ppm FROM p JOIN z u ON u.item_id = a JOIN z v ON v.item_id = b
  UNION ALL SELECT x.item_id, y.item_id, 1000000 FROM n x JOIN n y ON x.t = y.t AND x.item_id <> y.item_id AND x.t = ''),
k AS (SELECT unnest([50000, 200000]) AS ppm),
r AS (SELECT DISTINCT k.ppm, item_id AS node, item_id AS label FROM n, k UNION SELECT r.ppm, e.b, r.label FROM r JOIN e ON e.a = r.node AND e.ppm >= r.ppm),
m AS (SELECT ppm, label, count(*) AS members FROM (SELECT ppm, node, min(label) AS label FROM r GROUP BY 1, 2) GROUP BY 1, 2)
SELECT name, ppm::VARCHAR AS key, value FROM (
  SELECT 'near-duplicate-clusters' AS name, k.ppm, count(label) AS value FROM k LEFT JOIN m ON m.ppm = k.ppm AND members > 1 GROUP BY 2
  UNION ALL SELECT 'near-duplicate-members', k.ppm, coalesce(sum(members), 0)::BIGINT FROM k LEFT JOIN m ON m.ppm = k.ppm AND members > 1 GROUP BY 2)"""
)
def near_duplicate_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of benchmark items; the items differ much, so the thresholds are low."""
    return facts.near_duplicate_preview(read_table(spark, sf_dir, "benchmark"), "item_id", "text", (50_000, 200_000))


#: Pairs of included targets and clusters of them at each threshold; white space as in `normalized`.
_NEAR = f"""nt AS (SELECT record_id AS id, replace(lower(trim(regexp_replace(coalesce(target, ''), '[\\s\\v\\x85\\pZ]+', ' ', 'g'))), 'ß', 'ss') AS t FROM inside),
ns AS (SELECT DISTINCT id, substr(t, i, 5) AS g FROM (SELECT id, t, unnest(range(1, greatest(2, length(t) - 3))) AS i FROM nt) WHERE t <> ''),
nz AS (SELECT id, count(*) AS size FROM ns GROUP BY 1),
np AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM ns x JOIN ns y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2),
nq AS (SELECT a, b, c * 1000000 // (u.size + v.size - c) AS ppm FROM np JOIN nz u ON u.id = a JOIN nz v ON v.id = b),
ne AS (SELECT a, b, ppm FROM nq UNION ALL SELECT b, a, ppm FROM nq UNION ALL SELECT x.id, y.id, 1000000 FROM nt x JOIN nt y ON x.t = y.t AND x.id <> y.id AND x.t = ''),
nk AS (SELECT unnest({list(facts.PREVIEW_PPM)}) AS ppm),
nr AS (SELECT DISTINCT nk.ppm, id AS node, id AS label FROM nt, nk UNION SELECT nr.ppm, ne.b, nr.label FROM nr JOIN ne ON ne.a = nr.node AND ne.ppm >= nr.ppm),
nm AS (SELECT ppm, label, count(*) AS members FROM (SELECT ppm, node, min(label) AS label FROM nr GROUP BY 1, 2) GROUP BY 1, 2)"""
_NEAR_FACTS = """SELECT 'near-duplicate-clusters', nk.ppm::VARCHAR, count(label) FROM nk LEFT JOIN nm ON nm.ppm = nk.ppm AND members > 1 GROUP BY 2
  UNION ALL SELECT 'near-duplicate-members', nk.ppm::VARCHAR, coalesce(sum(members), 0)::BIGINT FROM nk LEFT JOIN nm ON nm.ppm = nk.ppm AND members > 1 GROUP BY 2"""
_TARGETS = _JUDGED.replace("WITH ", "WITH RECURSIVE ", 1).removesuffix("facts(name, key, value) AS (\n") + _NEAR


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, target of the included records."""
    return _judged(spark, sf_dir).filter("status = 'included'").select("record_id", "target")


@query(_TARGETS + f", near_facts(name, key, value) AS ({_NEAR_FACTS}) SELECT name, key, value::BIGINT AS value FROM near_facts")
def near_duplicate_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the targets of all included records at the preview's own thresholds."""
    return facts.near_duplicate_preview(_targets(spark, sf_dir), "record_id", "target")


@query(_TARGETS + " SELECT a, b, ppm AS similarity_ppm FROM nq WHERE ppm >= 800000")
def similar_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_pairs(_targets(spark, sf_dir), "record_id", "target")


_FAMILY = f"""SELECT unnest(['missing-labels', 'singleton-label-set']), '',
    unnest([count(*) FILTER (quality IS NULL), (count(DISTINCT quality) = 1)::BIGINT]) FROM labels JOIN inside ON doc_id = record_id
  UNION ALL {_TURN_FACTS}
  UNION ALL SELECT 'ranking-ties', '', coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM labels JOIN inside ON doc_id = record_id WHERE quality IS NOT NULL GROUP BY source, quality)"""
_REPORT = _TARGETS + ", facts(name, key, value) AS (\n" + " UNION ALL ".join([_DISTRIBUTIONS, _HITS, _CROSSING, _TOKENS, _NEAR_FACTS, _FAMILY]) + ")\n"


@query(
    _REPORT
    + f"""SELECT gate, sum(value)::BIGINT AS observed, sum(value) >= least_value AS reached
FROM (VALUES {_GATE_ROWS}) v(gate, n, k, least_value) LEFT JOIN facts ON name = n AND key = k GROUP BY gate, least_value"""
)
def report_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gates on the facts of the included records, with near-duplicate, family and role facts."""
    rows = _judged(spark, sf_dir)
    inside = rows.filter("status = 'included'")
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("record_id"), F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("label"))
    near = facts.near_duplicate_preview(inside.select("record_id", "target"), "record_id", "target")
    turns = read_table(spark, sf_dir, "conversations")
    family = _family_facts_of(labels.join(inside.select("record_id", F.col("source").alias("item")), "record_id"), turns)
    return facts.gates(_facts_of(rows).unionByName(near).unionByName(family).unionByName(facts.role_facts(turns)))
