"""Curation: length filter, conflict quarantine, exact dedup, per-source cap, coverage ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def curate(records: DataFrame, min_target: int = 200, cap: int = 30) -> DataFrame:
    """record_id, source, status, reason for records (record_id, source, context, target), in this order:

    targets under `min_target` characters are excluded (target-too-short); records of one source
    and context with different targets are quarantined (conflict); of equal records the smallest id
    stays (exact-duplicate); of each source the first `cap` ids stay (source-cap).
    """
    rows = records.select("record_id", "source", "target", F.sha2("context", 256).alias("c"), F.sha2("target", 256).alias("t"), F.coalesce(F.length("target"), F.lit(0)).alias("n")).drop("target")
    long = rows.filter(F.col("n") >= min_target)
    clash = long.groupBy("source", "c").agg((F.min("t") != F.max("t")).alias("clash"))
    rows = rows.join(clash, ["source", "c"], "left")
    clear = rows.filter((F.col("n") >= min_target) & ~F.col("clash"))
    keep = clear.groupBy("source", "c", "t").agg(F.min("record_id").alias("first"))
    # top-k of a window: each task keeps its own first rows before the shuffle
    rank = F.row_number().over(Window.partitionBy("source").orderBy("first"))
    capped = keep.withColumn("rank", rank).filter(F.col("rank") <= cap).select(F.col("first").alias("record_id"), F.lit(True).alias("inside"))
    rows = rows.join(keep, ["source", "c", "t"], "left").join(capped, "record_id", "left")
    reason = (
        F.when(F.col("n") < min_target, "target-too-short")
        .when(F.col("clash"), "conflict")
        .when(F.col("record_id") != F.col("first"), "exact-duplicate")
        .when(F.col("inside").isNull(), "source-cap")
    )
    status = F.when(F.col("reason").isNull(), "included").when(F.col("reason") == "conflict", "quarantined").otherwise("excluded")
    return rows.withColumn("reason", reason).select("record_id", "source", status.alias("status"), "reason")


def included(records: DataFrame, min_target: int = 200, cap: int = 30) -> DataFrame:
    """record_id, target_sha256 of the records that `curate` includes, without a row for the others.

    Records of one source and context without a conflict have one target, so one aggregate by both finds conflicts and first ids; only
    digests travel, and no record is joined.
    """
    sha = lambda c: F.unhex(F.sha2(c, 256))
    rows = records.filter((F.coalesce(F.length("target"), F.lit(0)) >= min_target) & F.col("source").isNotNull() & F.col("context").isNotNull())
    rows = rows.select("record_id", "source", sha("context").alias("c"), sha("target").alias("t"))
    blank = F.col("t").isNull()
    firsts = [F.min(F.when(~blank, F.col("record_id"))).alias("first")] + ([F.min(F.when(blank, F.col("record_id"))).alias("none")] if min_target <= 0 else [])
    groups = rows.groupBy("source", "c").agg(F.min("t").alias("low"), F.max("t").alias("high"), *firsts).filter("low = high")
    keep = groups.select("source", F.col("first").alias("record_id"), F.col("low").alias("t"))
    if min_target <= 0:  # a record without target stands beside those with one
        keep = keep.unionByName(groups.filter("none is not null").select("source", F.col("none").alias("record_id"), F.lit(None).cast("binary").alias("t")))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("record_id"))
    return keep.withColumn("rank", rank).filter(F.col("rank") <= cap).select("record_id", F.lower(F.hex("t")).alias("target_sha256"))


def coverage(decisions: DataFrame) -> DataFrame:
    """Per source: counts by status and a blocker where nothing is included."""
    count = lambda s: F.sum((F.col("status") == s).cast("long")).alias(s)
    out = decisions.groupBy("source").agg(F.count(F.lit(1)).alias("records"), count("included"), count("excluded"), count("quarantined"))
    return out.withColumn("blocker", F.when(F.col("included") == 0, "no-included-record"))


def first_by_source(rows: DataFrame, source: str = "source", key: str = "record_id") -> DataFrame:
    """The row of the smallest key of each source, a partial minimum rather than a sort."""
    rest = [c for c in rows.columns if c not in (source, key)]
    least = rows.groupBy(source).agg(F.min(F.struct(key, *rest)).alias("r"))
    return least.select(source, "r.*")


def promote(candidates: DataFrame, reviews: DataFrame, required: bool) -> DataFrame:
    """record_id, status: accepted without review; where review is required, the verdict of the latest review, else pending."""
    if not required:
        return candidates.select("record_id", F.lit("accepted").alias("status"))
    latest = reviews.groupBy("record_id").agg(F.max(F.struct("sequence", "verdict"))["verdict"].alias("verdict"))
    return candidates.select("record_id").join(latest, "record_id", "left").select("record_id", F.coalesce("verdict", F.lit("pending")).alias("status"))
