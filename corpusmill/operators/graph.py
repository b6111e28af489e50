"""Leakage groups: connected components over shared tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def leakage_groups(tokens: DataFrame, rounds: int = 100) -> DataFrame:
    """record_id, group_id (smallest record_id) for rows (record_id, token): records that share a token belong together.

    Each record is tied to the smallest record of its tokens; alternating large and small stars then run until the
    edges stay the same, in rounds that grow with the logarithm of a chain's length. Each round is written, so lineage
    stays short. Edges that still move after `rounds` rounds raise an error: no group is cut.
    """
    rows = written(tokens.select("record_id", "token").filter("record_id is not null and token is not null").distinct(), "tokens")
    least = rows.groupBy("token").agg(F.min("record_id").alias("u"))
    edges = written(rows.join(least, "token").select("u", F.col("record_id").alias("v")).filter("u < v").distinct(), "edges")
    mark = _mark(edges)
    for _ in range(rounds):
        # large star: neighbours above a node go to its smallest neighbour
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct()
        # small star: neighbours below a node, and the node, go to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
        edges = written(small.filter("a < b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    else:
        raise RuntimeError(f"groups still change after {rounds} rounds")
    labels = rows.select("record_id").distinct().join(edges.select(F.col("v").alias("record_id"), "u"), "record_id", "left")
    return labels.select("record_id", F.coalesce("u", "record_id").alias("group_id"))


def _mark(edges: DataFrame) -> tuple:
    """Count and sum of hashes: the same for the same edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def keyed_groups(rows: DataFrame, id_col: str, keys: tuple[str, ...]) -> DataFrame:
    """record_id, group_id: rows with an equal value in any of the key columns belong together; null keys bind nothing.

    A row whose keys are all null is a group of its own.
    """
    own = rows.select(F.col(id_col).alias("record_id"), F.concat(F.lit("own:"), F.col(id_col).cast("string")).alias("token"))
    tokens = [rows.select(F.col(id_col).alias("record_id"), F.concat(F.lit(f"{k}:"), F.sha2(F.col(k).cast("string"), 256)).alias("token")) for k in keys]
    for token in tokens:
        own = own.unionByName(token)
    return leakage_groups(own)
