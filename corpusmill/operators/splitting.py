"""Leakage groups and the seeded train/evaluation split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ppm_target
from ..sources.shared import written

#: Hex digits of the order hash that make a bucket: 65536 buckets, so the running sum over buckets is bounded.
BUCKET_DIGITS = 4


def boundary(records: DataFrame, seed: str = "seed", evaluation_ppm: int = 100_000) -> DataFrame:
    """One row (last_h, last_group): the last group for evaluation of records (group_id), nulls where there is none.

    Groups are ordered by a hash of seed and id; the proper prefix whose record count is nearest to the
    target is for evaluation (ties: the shorter). Running sums go bucket by bucket of the hash, so
    no task orders all groups. A single group goes to training.
    """
    groups = records.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")).withColumn("h", _order(seed))
    groups = groups.withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    buckets = groups.groupBy("bucket").agg(F.sum("size").alias("inside"))
    before = F.coalesce(F.sum("inside").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.select("bucket", before.alias("before"))  # at most 65536 rows
    running = F.sum("size").over(Window.partitionBy("bucket").orderBy("h", "group_id").rowsBetween(Window.unboundedPreceding, 0))
    groups = groups.withColumn("running", running).join(buckets, "bucket").select("h", "group_id", (F.col("running") + F.col("before")).alias("running"))
    total = groups.agg(F.max("running").alias("total"))
    scored = groups.crossJoin(F.broadcast(total)).filter("running < total")  # one row: proper prefixes only
    gap = F.abs(F.col("running") - ppm_target(F.col("total"), evaluation_ppm))
    best = scored.agg(F.min(F.struct(gap.alias("gap"), "running", "h", "group_id")).alias("best"))
    return best.select(F.col("best.h").alias("last_h"), F.col("best.group_id").alias("last_group"))


def _order(seed: str) -> Column:
    return F.sha2(F.concat(F.lit(seed), "group_id"), 256)


def with_sides(records: DataFrame, last: DataFrame, seed: str = "seed") -> DataFrame:
    """`records` (group_id, ...) with `partition` by the last group for evaluation: each is decided where it stands, none travels. Records without a group are left out."""
    h = _order(seed)
    inside = (h < F.col("last_h")) | ((h == F.col("last_h")) & (F.col("group_id") <= F.col("last_group")))
    sides = records.filter("group_id is not null").crossJoin(F.broadcast(last))
    return sides.select(*[F.col(f"`{c}`") for c in records.columns], F.when(inside, "evaluation").otherwise("train").alias("partition"))


def split_groups(records: DataFrame, seed: str = "seed", evaluation_ppm: int = 100_000) -> DataFrame:
    """record_id, group_id, partition for records (record_id, group_id); see `boundary`."""
    return with_sides(records.select("record_id", "group_id"), boundary(records, seed, evaluation_ppm), seed)


def authoritative(records: DataFrame) -> DataFrame:
    """source, refused, records for records (source, hint): a source whose given partitions differ cannot be kept as given."""
    return records.groupBy("source").agg((F.min("hint") != F.max("hint")).alias("refused"), F.count(F.lit(1)).alias("records"))


def ordinals(assigned: DataFrame) -> DataFrame:
    """record_id, partition, ordinal: places from 0 in the order of record_id inside each partition.

    A range sort spreads the rows over all tasks; each task numbers its own, and only counts by task meet in a window.
    """
    placed = written(assigned.select("record_id", "partition").orderBy("partition", "record_id").withColumn("at", F.monotonically_increasing_id()), "ordinals")
    placed = placed.withColumn("task", F.shiftright("at", 33))
    tasks = placed.groupBy("partition", "task").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("partition").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = tasks.select("partition", "task", (before - F.col("low")).alias("shift"))  # a row for each task of the sort
    return placed.join(tasks, ["partition", "task"]).select("record_id", "partition", (F.col("at") + F.col("shift")).alias("ordinal"))


def hint_mismatches(assigned: DataFrame, hints: DataFrame) -> DataFrame:
    """record_id, hint, partition where a given partition is not the assigned one."""
    return assigned.select("record_id", "partition").join(hints.select("record_id", "hint"), "record_id").filter(F.col("hint") != F.col("partition"))


def crossing_targets(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """digest of targets that occur in both partitions."""
    rows = assigned.select("record_id", "partition").join(targets.select("record_id", F.sha2("target", 256).alias("digest")), "record_id")
    return rows.groupBy("digest").agg(F.min("partition").alias("a"), F.max("partition").alias("b")).filter("a <> b").select("digest")
