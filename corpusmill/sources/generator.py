"""A deterministic corpus for scale runs, made where it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generate(spark: SparkSession, n: int, chars: int = 1024, duplicate_ppm: int = 0, seed: str = "seed") -> DataFrame:
    """record_id, text: n texts of `chars` hex characters; the given share at the end are copies of the first."""
    copies = min(max(n - 1, 0), n * duplicate_ppm // 1_000_000)
    source = F.when(F.col("id") >= n - copies, F.lit(0)).otherwise(F.col("id"))
    block = lambda k: F.sha2(F.concat_ws("-", F.lit(seed), F.col("origin").cast("string"), k.cast("string")), 256)
    blocks = F.transform(F.sequence(F.lit(0), F.lit(max(0, (chars - 1) // 64))), block)
    rows = spark.range(n).select("id", source.cast("long").alias("origin"))
    return rows.select(F.col("id").alias("record_id"), F.substring(F.array_join(blocks, ""), 1, chars).alias("text"))
