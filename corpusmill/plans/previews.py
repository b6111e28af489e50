"""Queries on previews, reviews that leave and come back, recipes and exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import construction, curation, exchange, facts, graph, mapping, preview, recipe
from ..sources.tables import read_table
from .queries import _CURATED, _records
from .registry import ORACLE_SQL, digest, query

_GOAL = "continue-a-passage"
_SUFFIXES = ("txt", "md", "py", "xyz")


def _split_sql(rows: str, ppm: int = 100_000) -> str:
    """CTEs up to sides(record_id, partition) over rows (record_id, group_id)."""
    return f"""gr AS (SELECT group_id, count(*) AS size FROM {rows} GROUP BY 1),
wr AS (SELECT group_id, sum(size) OVER (ORDER BY sha256('seed' || group_id), group_id) AS running, (SELECT sum(size) FROM gr) AS total FROM gr),
br AS (SELECT coalesce(arg_min(running, struct_pack(gap := gap, cut := running)), 0) AS cut FROM (SELECT running, abs(running - greatest(1, least(total - 1, (total * {ppm} + 500000) // 1000000))) AS gap FROM wr WHERE running < total)),
sides AS (SELECT record_id, CASE WHEN running <= cut THEN 'evaluation' ELSE 'train' END AS partition FROM {rows} JOIN wr USING (group_id), br)"""


def _curated_sql(rows: str, min_target: int = 200, cap: int = 30) -> str:
    """CTEs up to decided(record_id, source, status, reason) over rows (record_id, source, c, t)."""
    sql = _CURATED.removeprefix("WITH ").rstrip()
    sql = sql.split("\n", 1)[1].replace("FROM r ", f"FROM {rows} ").replace("SELECT r.*", f"SELECT {rows}.*").replace("ON r.source", f"ON {rows}.source").replace("AND r.c", f"AND {rows}.c")
    return sql.replace(">= 200", f">= {min_target}").replace("< 200", f"< {min_target}").replace("> 30", f"> {cap}")


_PREFLIGHT = f"""WITH s AS (SELECT doc_id, text, ['{"', '".join(_SUFFIXES)}'][doc_id % 4 + 1] AS suffix FROM documents WHERE text IS NOT NULL),
q AS (SELECT *, 'd/' || doc_id || '.' || suffix AS path, CASE suffix WHEN 'txt' THEN 'plain-text' WHEN 'md' THEN 'markdown' WHEN 'py' THEN 'source-code' END AS family,
  CASE WHEN suffix = 'xyz' THEN 'unsupported-suffix' WHEN strlen(text) > 9000 THEN 'over-preview-limit' END AS refusal FROM s),
m AS (SELECT doc_id AS record_id, path AS source, substr(text, 1, cut) AS c, substr(text, cut + 1) AS t FROM (SELECT *, greatest(1, least(length(text) - 1, length(text) * 500000 // 1000000)) AS cut FROM q WHERE refusal IS NULL AND length(text) >= 2)),
{_curated_sql("m")},
inn AS (SELECT m.record_id, sha256(t) AS group_id FROM m JOIN decided USING (record_id) WHERE status = 'included'),
{_split_sql("inn")}
SELECT 'source' AS name, coalesce(refusal, 'usable') AS key, count(*) AS n FROM q GROUP BY 2 UNION ALL SELECT 'family', family, count(*) FROM q WHERE family IS NOT NULL GROUP BY 2
UNION ALL SELECT 'candidate', 'continuation', count(*) FROM m HAVING count(*) > 0 UNION ALL SELECT 'decision', coalesce(reason, status), count(*) FROM decided GROUP BY 2 UNION ALL SELECT 'partition', partition, count(*) FROM sides GROUP BY 2"""


@query(_PREFLIGHT)
def preflight_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry run over documents as files of four kinds, those over 9,000 bytes left to the run itself."""
    suffix = F.get(F.array(*map(F.lit, _SUFFIXES)), (F.col("doc_id") % 4).cast("int"))
    docs = read_table(spark, sf_dir, "documents").filter("text is not null")
    sources = docs.select(F.col("doc_id").alias("source"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit("."), suffix).alias("path"), "text")
    return preview.preflight(sources, _GOAL, limit=9_000)


@query(
    _CURATED.rstrip()
    + """, i AS (SELECT source, min(record_id) AS record_id FROM decided WHERE status = 'included' GROUP BY 1),
x AS (SELECT i.source, record_id, c, t, to_json({'completion': t, 'prompt': c})::VARCHAR AS payload FROM i JOIN r USING (record_id))
SELECT source, record_id, sha256(CASE WHEN strlen(payload) > 2000 THEN '' ELSE payload END) AS row_sha256, sha256(sha256(c) || sha256(t)) AS evidence, CASE WHEN strlen(payload) > 2000 THEN 'row-exceeds-limit' END AS omission FROM x"""
)
def goal_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each source, left out over 2,000 bytes."""
    records = _records(spark, sf_dir)
    rows = preview.first_rows(records, curation.curate(records), "prompt_completion", limit=2_000)
    return digest(rows.select("source", "record_id", F.coalesce("row", F.lit("")).alias("row"), "evidence", "omission"), "row")


@query(
    f"""WITH e AS ({ORACLE_SQL['alpaca_rows'].replace("sha256(x.text) AS instruction_sha256, '' AS input, sha256(y.text) AS output_sha256", "x.text AS c, y.text AS t")}),
v AS (SELECT doc_id::VARCHAR AS record_id, 'document' AS origin, source, substr(text, 1, 40) AS context, substr(text, 41) AS target FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT conv_id::VARCHAR, 'row', 'chat', c, t FROM e WHERE c IS NOT NULL AND t IS NOT NULL)
SELECT record_id, origin, source, length(context) AS context_length, length(target) AS target_length, sha256(to_json({{'context': context, 'target': target}})) AS digest FROM v"""
)
def record_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of documents and of conversations in one view."""
    made = _records(spark, sf_dir).filter("context is not null and target is not null")
    rows = mapping.first_exchanges(read_table(spark, sf_dir, "conversations")).filter("prompt is not null and completion is not null")
    return preview.one_view(made, rows.select(F.col("conv_id").alias("record_id"), F.lit("chat").alias("source"), F.col("prompt").alias("context"), F.col("completion").alias("target")))


@query("SELECT doc_id AS record_id, CASE doc_id % 9 WHEN 1 THEN 'missing' WHEN 2 THEN 'repeated' WHEN 3 THEN 'changed' END AS fault FROM documents WHERE text IS NOT NULL AND doc_id % 9 IN (1, 2, 3) UNION ALL SELECT -doc_id - 1, 'extra' FROM documents WHERE text IS NOT NULL AND doc_id % 9 = 4")
def export_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of an export in which rows are missing, repeated, changed and added."""
    planned = read_table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("record_id"), mapping.payload_json("text", F.lit(""), F.col("text")).alias("payload"))
    kind = F.col("record_id") % 9
    found = planned.filter(kind != 1).withColumn("payload", F.when(kind == 3, F.lit("{}")).otherwise(F.col("payload")))
    found = found.unionByName(planned.filter(kind == 2)).unionByName(planned.filter(kind == 4).withColumn("record_id", -F.col("record_id") - 1))
    return preview.membership(planned, found)


_ITEMS = """it AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'conflict' ELSE 'pending' END AS queue, doc_id AS subject, doc_id % 2 = 1 AS required, sha256(sha256(substr(text, 1, 40)) || sha256(substr(text, 41))) AS evidence FROM documents WHERE text IS NOT NULL),
pk AS (SELECT 'rvw-v1-' || sha256('corpusmill' || chr(0) || 'rvw' || chr(0) || 'v1' || chr(0) || to_json({'evidence': evidence, 'queue': queue, 'subject': subject::VARCHAR})) AS packet, * FROM it),
vd AS (SELECT CASE WHEN toxic = 1 AND quality = 0 THEN 'lost-' || doc_id ELSE packet END AS packet, subject, doc_id % 7 = 0 AS other, CASE WHEN doc_id % 5 = 0 THEN 'perhaps' WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS verdict, evidence, doc_id FROM pk JOIN labels ON doc_id = subject WHERE quality IS NOT NULL AND toxic IS NOT NULL)"""
_REFUSED = "CASE WHEN starts_with(packet, 'lost-') THEN 'unknown-packet' WHEN other THEN 'other-evidence' WHEN verdict = 'perhaps' THEN 'unknown-verdict' END"


def _reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = read_table(spark, sf_dir, "documents").filter("text is not null")
    items = docs.select(F.when(F.col("doc_id") % 2 == 0, "conflict").otherwise("pending").alias("queue"), F.col("doc_id").alias("subject"), (F.col("doc_id") % 2 == 1).alias("required"), F.substring("text", 1, 40).alias("context"), F.substring("text", F.lit(41), F.length("text")).alias("target"))
    sent = exchange.packets(items)
    marks = read_table(spark, sf_dir, "labels").filter("quality is not null and toxic is not null")
    rows = sent.join(marks, F.col("doc_id") == F.col("subject"))
    packet = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), F.concat(F.lit("lost-"), F.col("doc_id").cast("string"))).otherwise(F.col("packet"))
    seen = F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.col("evidence"))
    verdict = F.when(F.col("doc_id") % 5 == 0, "perhaps").when(F.col("quality") == 1, "accepted").otherwise("rejected")
    return sent, rows.select(packet.alias("packet"), seen.alias("evidence"), verdict.alias("verdict"), F.lit(1).alias("sequence"))


@query(f"WITH {_ITEMS} SELECT packet, CASE WHEN NOT starts_with(packet, 'lost-') THEN subject END AS subject, CASE WHEN {_REFUSED} IS NULL THEN verdict END AS verdict, {_REFUSED} AS refusal FROM vd GROUP BY ALL")
def submitted_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts that come back, some on lost packets, on other evidence, or without a known verdict."""
    return exchange.submitted(*_reviews(spark, sf_dir))


@query(f"WITH {_ITEMS} SELECT packet, queue, subject, required, evidence FROM pk WHERE required AND packet NOT IN (SELECT packet FROM vd WHERE {_REFUSED} IS NULL AND verdict = 'accepted')")
def unresolved_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent, verdicts = _reviews(spark, sf_dir)
    return exchange.unresolved(sent, exchange.submitted(sent, verdicts))


@query(
    """WITH l AS (SELECT conv_id AS subject, turn AS sequence, role AS kind, text AS payload, 'cor-v1-' || sha256('corpusmill' || chr(0) || 'cor' || chr(0) || 'v1' || chr(0) || to_json({'kind': role, 'payload': text, 'sequence': turn, 'subject': conv_id::VARCHAR})) AS correction FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL AND turn IS NOT NULL)
SELECT subject, sequence, correction, lag(correction) OVER w AS previous, lead(correction) OVER w IS NULL AS current FROM l WINDOW w AS (PARTITION BY subject ORDER BY sequence)"""
)
def correction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as entries of a log of corrections."""
    turns = read_table(spark, sf_dir, "conversations").filter("role is not null and text is not null and turn is not null")
    return exchange.corrections(turns.select(F.col("conv_id").alias("subject"), F.col("turn").alias("sequence"), F.col("role").alias("kind"), F.col("text").alias("payload")))


#: The specification of the query below; its defaults come from `recipe.DEFAULTS`.
SPEC = json.dumps({"representation": "instruction-and-output", "instruction": "Give the exact source remainder.", "cleaning": ["whitespace"], "window": {"size": 500, "overlap": 50}, "curation": {"cap": 400}, "split": {"evaluation_ppm": 250_000}})


@query(
    f"""WITH d0 AS (SELECT doc_id, source, text, regexp_replace(text, '[ \\t]+', ' ', 'g') AS u FROM documents),
d1 AS (SELECT doc_id, source, CASE WHEN (length(text) - length(u)) * 10 > length(text) * 3 THEN text ELSE u END AS text FROM d0),
wd AS (SELECT doc_id, source, seq, substr(text, seq * 450 + 1, 500) AS w FROM (SELECT *, unnest(range(0, CASE WHEN length(text) <= 500 THEN 1 ELSE ceil((length(text) - 500) / 450.0)::BIGINT + 1 END)) AS seq FROM d1 WHERE length(text) > 0)),
m AS (SELECT {{'doc_id': doc_id, 'seq': seq}} AS record_id, source, substr(w, 1, cut) AS c, substr(w, cut + 1) AS t FROM (SELECT *, greatest(1, least(length(w) - 1, length(w) * 500000 // 1000000)) AS cut FROM wd WHERE length(w) >= 2)),
{_curated_sql("m", cap=400)},
inn AS (SELECT m.record_id, c, t, sha256(t) AS group_id FROM m JOIN decided USING (record_id) WHERE status = 'included'),
{_split_sql("inn", 250_000)}
SELECT record_id.doc_id AS doc_id, record_id.seq AS seq, partition, sha256(to_json({{'input': c, 'instruction': 'Give the exact source remainder.', 'output': t}})) AS payload_sha256 FROM sides JOIN inn USING (record_id)"""
)
def recipe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a whole specification makes."""
    rows = recipe.run(read_table(spark, sf_dir, "documents"), recipe.load(SPEC))
    return digest(rows.select("record_id.doc_id", "record_id.seq", "partition", "payload"), "payload")


@query(
    f"""SELECT sha256(string_agg(record_id::VARCHAR, ',' ORDER BY record_id::VARCHAR)) AS cluster, count(*) AS size FROM ({ORACLE_SQL['leakage_groups']}) GROUP BY group_id HAVING count(*) BETWEEN 2 AND 65536"""
)
def group_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leakage groups of two records or more, named by their members."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "text")
    same = docs.select("record_id", F.sha2("text", 256).alias("token"))
    line = docs.select("record_id", F.concat(F.lit("line:"), F.substring_index("text", "\n", 1)).alias("token"))
    return construction.clusters(graph.leakage_groups(same.union(line)).withColumnRenamed("record_id", "member"))


@query(
    _CURATED.rstrip()
    + """, n AS (SELECT len(string_split(t, ' ')) AS tokens FROM decided JOIN r USING (record_id) WHERE status = 'included')
SELECT 'token-distribution' AS name, tokens::VARCHAR AS key, count(*) AS value FROM n GROUP BY 2 UNION ALL SELECT 'truncated-records', '', count(*) FILTER (tokens > 128) FROM n"""
)
def injected_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token facts by an injected encoder, a Python function that the workers call batch by batch."""
    records = _records(spark, sf_dir)
    rows = curation.curate(records).select("record_id", "status").join(records.select("record_id", "target"), "record_id")
    return facts.token_facts(rows, facts.encoder(lambda text: len(text.split(" ")))("target"), 128)


@query(
    _CURATED.rstrip()
    + """, nn AS (SELECT source, record_id, row_number() OVER (PARTITION BY source ORDER BY record_id) AS nth FROM decided WHERE status = 'included')
SELECT source, record_id FROM nn WHERE nth <= 3"""
)
def first_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three included records of each source."""
    return construction.latest_first(curation.curate(_records(spark, sf_dir)).filter("status = 'included'").select("source", "record_id"), "source", "record_id", 3)

