"""Looks ahead and back: a dry run before a dataset is made, examples of its rows, one view of records whatever their origin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import construction, curation, goals, mapping, splitting

#: Bytes of a source, and of a sample, that a preview reads or shows.
SOURCE_BYTES = SAMPLE_BYTES = 65_536


def preflight(sources: DataFrame, goal: str, min_target: int = 200, cap: int = 30, limit: int = SOURCE_BYTES) -> DataFrame:
    """name, key, n for sources (source, path, text): what a run for the goal would refuse, make, leave out and split.

    Sources over `limit` bytes are counted and left out: a preview is bounded by that, the run itself is not.
    """
    judged = goals.eligible(sources, goal).withColumn("refusal", F.coalesce("refusal", F.when(F.octet_length("text") > limit, "over-preview-limit")))
    count = lambda rows, name, key: rows.groupBy(F.coalesce(key, F.lit("")).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "key", "n")
    objective = goals.resolve(goal)["objective"]
    usable = judged.filter("refusal is null")
    chunks = usable.select("source", F.lit(0).alias("seq"), "text", F.col("path").alias("locator"), F.lit(None).cast("string").alias("heading"))
    drafts = construction.constructor(objective)(chunks).select(F.col("source").alias("record_id"), F.col("locator").alias("source"), "context", "target")
    decided = curation.curate(drafts, min_target, cap)
    inside = drafts.join(decided.filter("status = 'included'").select("record_id"), "record_id")
    sides = splitting.split_groups(inside.select("record_id", F.sha2("target", 256).alias("group_id")))
    parts = [
        count(judged, "source", F.coalesce("refusal", F.lit("usable"))),
        count(judged.filter("family is not null"), "family", F.col("family")),
        count(drafts, "candidate", F.lit(objective)),
        count(decided, "decision", F.coalesce("reason", F.col("status"))),
        count(sides, "partition", F.col("partition")),
    ]
    return reduce(DataFrame.unionByName, parts)


def first_rows(records: DataFrame, decisions: DataFrame, row_schema: str, extra: Column | None = None, limit: int = SAMPLE_BYTES) -> DataFrame:
    """source, record_id, context, target, row, evidence, omission: the first included record of each source as its row.

    Texts of rows over `limit` bytes are left out and said to be; `evidence` is the digest of context and target.
    """
    inside = decisions.filter("status = 'included'").groupBy("source").agg(F.min("record_id").alias("record_id"))
    rows = inside.join(records.select("record_id", "context", "target"), "record_id")
    rows = rows.withColumn("row", mapping.payload_json(row_schema, F.col("context"), F.col("target"), extra))
    large = F.octet_length("row") > limit
    kept = lambda c: F.when(~large, F.col(c)).alias(c)
    proof = F.sha2(F.concat(F.sha2("context", 256), F.sha2("target", 256)), 256)
    return rows.select("source", "record_id", kept("context"), kept("target"), kept("row"), proof.alias("evidence"), F.when(large, "row-exceeds-limit").alias("omission"))


def one_view(made: DataFrame, imported: DataFrame) -> DataFrame:
    """record_id, origin, source, context_length, target_length, digest for made records and imported rows (record_id, source, context, target) alike."""

    def view(rows: DataFrame, origin: str) -> DataFrame:
        size = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")
        digest = F.sha2(F.to_json(F.struct("context", "target")), 256)
        return rows.select(F.col("record_id").cast("string").alias("record_id"), F.lit(origin).alias("origin"), "source", size("context").alias("context_length"), size("target").alias("target_length"), digest.alias("digest"))

    return view(made, "document").unionByName(view(imported, "row"))


def membership(planned: DataFrame, candidates: DataFrame) -> DataFrame:
    """record_id, fault: rows of an export (record_id, payload) that are not those planned: missing, extra, repeated or changed."""
    digest = F.sha2("payload", 256).alias("d")
    side = lambda rows, name: rows.groupBy("record_id").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.max(digest).alias(f"d_{name}"))
    both = side(planned, "planned").join(side(candidates, "found"), "record_id", "full")
    fault = (
        F.when(F.col("n_found").isNull(), "missing")
        .when(F.col("n_planned").isNull(), "extra")
        .when((F.col("n_found") > 1) | (F.col("n_planned") > 1), "repeated")
        .when(F.col("d_found") != F.col("d_planned"), "changed")
    )
    return both.select("record_id", fault.alias("fault")).filter("fault is not null")
