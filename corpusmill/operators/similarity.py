"""Exact set-similarity self join with prefix and length filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_shingles, jaccard_ppm, normalized


def similar_pairs(rows: DataFrame, id_col: str, text_col: str, threshold_ppm: int = 800_000) -> DataFrame:
    """a, b, similarity_ppm: pairs of different ids whose character shingles reach the threshold; empty texts are left out.

    Shingles are ordered by how rare they are; a similar pair shares one in a prefix of each set, so only
    prefixes are joined. Common shingles behind the last one seen in both prefixes are at most as many as the shorter
    rest has, so a pair that cannot reach the threshold is dropped before its sets are fetched. Shingles are joined by
    64-bit hashes (equal hashes of different ones only add candidates); similarities are counted on the shingles themselves.
    """
    sets = rows.select(F.col(id_col).alias("id"), char_shingles(normalized(F.col(text_col))).alias("s")).filter(F.size("s") > 0)
    hashed = sets.select("id", F.explode(F.transform("s", lambda g: F.xxhash64(g))).alias("g"))
    counts = hashed.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    ranked = hashed.join(counts, "g").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("o"))
    size = F.size("o")
    prefix = (size - F.ceil(size * F.lit(threshold_ppm).cast("long") / 1_000_000) + 1).cast("int")
    keyed = ranked.select("id", size.alias("n"), F.posexplode(F.slice("o", F.lit(1), prefix)).alias("at", "p")).select("id", "n", "at", F.col("p.g").alias("g"))
    near = keyed.alias("x").join(keyed.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.id") < F.col("y.id")) & (F.least("x.n", "y.n").cast("long") * 1_000_000 >= F.greatest("x.n", "y.n").cast("long") * threshold_ppm))
    near = near.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m")).agg(F.count(F.lit(1)).alias("seen"), F.max("x.at").alias("i"), F.max("y.at").alias("j"))
    most = F.col("seen") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) - 1
    pairs = near.filter(most * (1_000_000 + threshold_ppm) >= (F.col("n") + F.col("m")).cast("long") * threshold_ppm).select("a", "b")
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", jaccard_ppm(F.col("sa"), F.col("sb")).alias("similarity_ppm"))
    return scored.filter(F.col("similarity_ppm") >= threshold_ppm)
