"""Queries on mapped rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curation, graph, mapping, splitting
from ..sources import generator, sinks
from ..sources.tables import read_table
from .registry import ORACLE_SQL, digest, query


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_type(json_extract(props, '$.k')) IN ('VARCHAR') AS is_text FROM events")
def json_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    return events.select("event_id", mapping.resolve(F.col("props"), "/k").alias("k"), (mapping.kind_at(F.col("props"), "/k") == "STRING").alias("is_text"))


_EXCHANGES = ORACLE_SQL["alpaca_rows"].replace("sha256(x.text) AS instruction_sha256, '' AS input, sha256(y.text) AS output_sha256", "x.text AS prompt, y.text AS completion")


def _exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.first_exchanges(read_table(spark, sf_dir, "conversations"))


@query(
    """WITH d AS (SELECT role AS prompt, text AS completion, turn AS extra FROM conversations)
SELECT reason_code, count(*) AS n FROM (
  SELECT CASE WHEN extra > 3 THEN 'unmapped-keys' WHEN prompt = 'system' THEN 'missing-source-path' WHEN extra = 2 THEN 'non-string-value' WHEN completion = '' THEN 'empty-required-string' END AS reason_code FROM d)
GROUP BY 1"""
)
def row_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as rows, spoilt in four ways: a late turn has a key too many, a system turn no prompt, a second turn a number as completion."""
    turn = F.col("turn")
    fields = F.struct(
        F.when(F.col("role") != "system", F.col("role")).alias("prompt"),
        F.when(turn != 2, F.col("text")).alias("completion"),
        F.when(turn > 3, turn).alias("other"),
    )
    spoilt = F.when(turn == 2, F.regexp_replace(F.to_json(fields), r"\}$", ',"completion":2}')).otherwise(F.to_json(fields))
    rows = read_table(spark, sf_dir, "conversations").select(spoilt.alias("payload"))
    return mapping.rejections(rows, "payload", {"prompt": "prompt", "completion": "completion"})


@query(
    """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS label FROM documents),
flags(row_schema, proposed) AS (SELECT 'text', bool_and(text <> '') FROM documents UNION ALL SELECT 'label-classification', bool_and(text <> '' AND label <> '') FROM documents JOIN d USING (doc_id)
  UNION ALL SELECT 'preference-pair', bool_and(text <> '' AND lang <> '' AND source <> '') FROM documents)
SELECT detector, row_schema, coalesce(proposed, false) AS proposed FROM (VALUES """
    + ", ".join(f"('{d}', '{s}')" for d, (s, _) in mapping.DETECTORS.items())
    + ") v(detector, row_schema) LEFT JOIN flags USING (row_schema)"
)
def detected_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows with the keys of three schemas; labels are blank in every other row."""
    text = F.col("text")
    fields = F.struct(text.alias("text"), text.alias("context"), F.when(F.col("doc_id") % 2 == 0, text).otherwise("").alias("label"), F.lit("me").alias("annotator"), text.alias("prompt"), F.col("lang").alias("chosen"), F.col("source").alias("rejected"))
    return mapping.detect(read_table(spark, sf_dir, "documents").select(F.to_json(fields).alias("payload")), "payload")


_CODES = ["NULL", "'missing-source-path'", "'invalid-mapped-fields'", "'non-string-value'", "'empty-required-string'", "'unmapped-keys'", "'invalid-partition'", "NULL"]


@query(
    f"""SELECT reason_code, count(*) AS n FROM (SELECT CASE doc_id % 8 {" ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(_CODES))} END AS reason_code FROM documents WHERE text <> '') GROUP BY 1"""
)
def pointer_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows that are read by pointers with an index, a quote and a slash in keys, spoilt in six ways."""
    kind, text = F.col("doc_id") % 8, F.to_json(F.array("text"))
    asked = F.when(kind == 1, F.lit("[]")).when(kind == 2, F.lit('"a word"')).when(kind == 3, F.lit("[7]")).when(kind == 4, F.lit('[""]')).when(kind == 7, F.concat(F.lit('{"0":'), F.substring(text, 2, F.length(text) - 2), F.lit("}"))).otherwise(text)
    side = F.when(kind == 6, "dev").when(kind == 0, "train").otherwise("evaluation")
    payload = F.concat(F.lit('{"q":'), asked, F.lit(""","it's/a":"yes","partition":\""""), side, F.lit('"'), F.when(kind == 5, ',"more":1').otherwise(""), F.lit("}"))
    rows = read_table(spark, sf_dir, "documents").filter("text <> ''").select(payload.alias("payload"))
    return mapping.rejections(rows, "payload", {"prompt": "/q/0", "completion": "/it's~1a"}, "proposed")


@query(
    f"""SELECT reason_code, count(*) AS n FROM (SELECT CASE conv_id % 6 WHEN 1 THEN 'invalid-messages' WHEN 2 THEN 'invalid-messages' WHEN 3 THEN 'empty-required-string' WHEN 4 THEN 'missing-source-path' WHEN 5 THEN 'invalid-messages' END AS reason_code
  FROM ({_EXCHANGES}) WHERE prompt <> '' AND completion <> '') GROUP BY 1"""
)
def message_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges as message rows: as they are, with swapped roles, as a text, with an empty answer, without the key, and with a third key in a turn."""
    kind = F.col("conv_id") % 6
    user, other = F.when(kind == 1, "assistant").otherwise("user"), F.when(kind == 1, "user").otherwise("assistant")
    turns = F.array(F.struct(user.alias("role"), F.col("prompt").alias("content"), F.when(kind == 5, 1).alias("at")), F.struct(other.alias("role"), F.when(kind == 3, "").otherwise(F.col("completion")).alias("content"), F.lit(None).cast("int").alias("at")))
    payload = F.when(kind == 2, F.to_json(F.struct(F.col("prompt").alias("messages")))).when(kind == 4, "{}").otherwise(F.to_json(F.struct(turns.alias("messages"))))
    rows = _exchanges(spark, sf_dir).filter("prompt <> '' and completion <> ''").select(payload.alias("payload"))
    return mapping.rejections(rows, "payload", {"messages": "messages"}, row_schema="messages")


@query(
    """SELECT event_id, json_extract_string(props, '$.k') AS value, 'identity-string' AS encoding FROM events WHERE json_type(json_extract(props, '$.k')) = 'VARCHAR'
UNION ALL SELECT event_id, json_extract(props, '$.k')::VARCHAR, 'json-scalar-v1' FROM events WHERE json_type(json_extract(props, '$.k')) IN ('BIGINT', 'UBIGINT', 'BOOLEAN', 'NULL')"""
)
def strict_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", mapping.strict_scalar(F.col("props"), "/k").alias("s"))
    return events.filter("s is not null").select("event_id", "s.value", "s.encoding")


@query(
    """WITH p AS (SELECT doc_id, to_json({'text': text})::VARCHAR AS payload, text FROM documents)
SELECT doc_id, CASE WHEN text = '' THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN text = '' THEN 'empty-required-string' END AS reason_code,
  sha256(CASE WHEN text <> '' AND strlen(payload) <= 4096 THEN payload ELSE '' END) AS sample_sha256, CASE WHEN text <> '' AND strlen(payload) > 4096 THEN 'sample-exceeds-4096-bytes' END AS omission FROM p WHERE text IS NOT NULL"""
)
def mapping_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.to_json(F.struct("text")).alias("payload"))
    seen = mapping.preview(docs, "payload", {"text": "text"}, "text", limit=4096)
    return digest(seen.select("doc_id", "status", "reason_code", "omission", F.coalesce("sample", F.lit("")).alias("sample")), "sample")


@query(f"SELECT conv_id, sha256(to_json({{'conversations': [{{'from': 'human', 'value': prompt}}, {{'from': 'gpt', 'value': completion}}]}})) AS row_sha256 FROM ({_EXCHANGES})")
def sharegpt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapping.sharegpt(_exchanges(spark, sf_dir))
    return digest(rows.select("conv_id", F.to_json(F.struct("conversations")).alias("row")), "row")


@query(f"SELECT conv_id, sha256('answer briefly' || chr(10) || prompt) AS prompt_sha256, sha256(completion) AS completion_sha256 FROM ({_EXCHANGES})")
def assembled_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _exchanges(spark, sf_dir).select("conv_id", F.lit("answer briefly").alias("instruction"), F.col("prompt").alias("input"), F.col("completion").alias("output"))
    return digest(mapping.assemble_prompt(rows), "prompt", "completion")


@query(
    f"""SELECT conv_id, sha256(to_json({{'completion': completion, 'prompt': prompt}})) AS prompt_completion_sha256,
  sha256(to_json({{'messages': [{{'content': prompt, 'role': 'user'}}, {{'content': completion, 'role': 'assistant'}}]}})) AS messages_sha256,
  sha256(to_json({{'input': prompt, 'instruction': 'answer', 'output': completion}})) AS instruction_output_sha256 FROM ({_EXCHANGES})"""
)
def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt, completion = F.col("prompt"), F.col("completion")
    shapes = {"prompt_completion": None, "messages": None, "instruction_output": F.lit("answer")}
    rows = _exchanges(spark, sf_dir).select("conv_id", *[mapping.payload_json(s, prompt, completion, e).alias(s) for s, e in shapes.items()])
    return digest(rows, *shapes)


@query("SELECT doc_id, sha256(to_json({'annotator': 'quality', 'context': text, 'label': quality::VARCHAR})) AS row_sha256 FROM documents JOIN labels USING (doc_id) WHERE text <> '' AND quality IS NOT NULL")
def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", "text")
    rows = docs.join(read_table(spark, sf_dir, "labels").filter("quality is not null").select("doc_id", "quality"), "doc_id")
    return digest(rows.select("doc_id", mapping.payload_json("label-classification", F.col("text"), F.col("quality").cast("string"), F.lit("quality")).alias("row")), "row")


@query("SELECT doc_id, 'rec-v1-' || sha256('corpusmill' || chr(0) || 'rec' || chr(0) || 'v1' || chr(0) || to_json({'text': text})) AS record_id FROM documents WHERE text IS NOT NULL")
def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", mapping.derived_id("rec", mapping.payload_json("text", F.lit(""), F.col("text"))).alias("record_id"))


_HINTED = "SELECT doc_id AS record_id, source, CASE WHEN lang = 'en' THEN 'evaluation' ELSE 'train' END AS hint FROM documents"


@query(f"SELECT source, count(DISTINCT hint) > 1 AS refused, count(*) AS records FROM ({_HINTED}) GROUP BY 1")
def authoritative_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = F.when(F.col("lang") == "en", "evaluation").otherwise("train")
    return splitting.authoritative(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "source", hint.alias("hint")))


@query(f"SELECT record_id, partition, row_number() OVER (PARTITION BY partition ORDER BY record_id) - 1 AS ordinal FROM ({ORACLE_SQL['split_documents']})")
def partition_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.sha2("text", 256).alias("group_id"))
    return splitting.ordinals(splitting.split_groups(docs).select("record_id", "partition"))


@query(
    f"""WITH o AS ({ORACLE_SQL['partition_ordinals']}),
p AS (SELECT partition, ordinal, ordinal // 65536 AS g, sha256(to_json({{'text': text}})) AS d FROM o JOIN documents ON doc_id = record_id),
i AS (SELECT partition, g, sha256(string_agg(d, '' ORDER BY ordinal)) AS d, count(*) AS n FROM p GROUP BY 1, 2),
k AS (SELECT partition, g // 65536 AS h, sha256(string_agg(d, '' ORDER BY g)) AS d, sum(n) AS n FROM i GROUP BY 1, 2)
SELECT partition, sum(n)::BIGINT AS rows, sha256(string_agg(d, '' ORDER BY h)) AS fingerprint FROM k GROUP BY 1"""
)
def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), mapping.payload_json("text", F.lit(""), F.col("text")).alias("payload"))
    return sinks.fingerprint(partition_ordinals(spark, sf_dir).join(texts, "record_id"))


@query(
    """WITH RECURSIVE u AS (SELECT conv_id, min(turn) FILTER (role = 'user') AS first_turn FROM conversations GROUP BY 1),
k AS (SELECT u.conv_id AS record_id, text AS prompt FROM u LEFT JOIN conversations c ON c.conv_id = u.conv_id AND turn = first_turn),
r AS (SELECT record_id AS node, record_id AS label FROM k UNION SELECT b.record_id, label FROM r JOIN k a ON a.record_id = node JOIN k b ON a.prompt = b.prompt)
SELECT node AS record_id, min(label) AS group_id FROM r GROUP BY 1"""
)
def shared_prompt_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    prompt = F.min(F.when(F.col("role") == "user", F.struct("turn", "text")))["text"].alias("prompt")
    return graph.keyed_groups(turns.groupBy("conv_id").agg(prompt), "conv_id", ("prompt",))


@query("SELECT source, min(doc_id) AS record_id, sha256(arg_min(text, doc_id)) AS text_sha256 FROM documents GROUP BY 1")
def preview_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("record_id"), "text")
    return digest(curation.first_by_source(docs), "text")


@query(f"SELECT h.record_id, h.hint, a.partition FROM ({_HINTED}) h JOIN ({ORACLE_SQL['split_documents']}) a USING (record_id) WHERE hint <> partition")
def hint_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    assigned = splitting.split_groups(docs.select(F.col("doc_id").alias("record_id"), F.sha2("text", 256).alias("group_id")))
    hint = F.when(F.col("lang") == "en", "evaluation").otherwise("train")
    return splitting.hint_mismatches(assigned, docs.select(F.col("doc_id").alias("record_id"), hint.alias("hint")))


@query(
    """SELECT i AS record_id, sha256(substr(string_agg(sha256('seed-' || CASE WHEN i >= 950 THEN 0 ELSE i END || '-' || k), '' ORDER BY k), 1, 300)) AS text_sha256
FROM range(1000) a(i), range(5) b(k) GROUP BY 1"""
)
def generated_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(generator.generate(spark, 1000, 300, 50_000), "text")
