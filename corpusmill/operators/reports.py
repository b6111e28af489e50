"""Quality reports: distributions, detectors, comparability, leakage against a reference corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Detector family, name, pattern.
DETECTORS = (
    ("pii", "pii-email", r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"),
    ("secret", "secret-aws-access-key", r"AKIA[0-9A-Z]{16}"),
    ("secret", "secret-pem-private-key", r"BEGIN [A-Z ]*PRIVATE KEY"),
    ("unsafe", "unsafe-script-tag", r"(?i)<script[\s>]"),
    ("license", "license-gpl-3", r"\bGPL-3\.0\b"),
)


def tally(rows: DataFrame, column: str) -> DataFrame:
    """value, n: how often each value occurs."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def length_histogram(rows: DataFrame, column: str = "text") -> DataFrame:
    """length, n: exact histogram of character lengths."""
    return rows.groupBy(F.length(column).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def detector_hits(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, family, detector: at most one row for each document and detector."""
    hits = F.array_compact(F.array(*[F.when(F.col(text_col).rlike(p), F.struct(F.lit(f).alias("family"), F.lit(n).alias("detector"))) for f, n, p in DETECTORS]))
    return docs.select("doc_id", F.explode(hits).alias("hit")).select("doc_id", "hit.family", "hit.detector")


def comparability(assigned: DataFrame) -> DataFrame:
    """Per source: train and evaluation counts, and their imbalance in millionths."""
    count = lambda p: F.sum((F.col("partition") == p).cast("long"))
    out = assigned.groupBy("source").agg(count("train").alias("train"), count("evaluation").alias("evaluation"))
    return out.withColumn("imbalance_ppm", F.floor(F.abs(F.col("train") - F.col("evaluation")) * 1_000_000 / (F.col("train") + F.col("evaluation"))).cast("long"))


def reference_leakage(docs: DataFrame, reference: DataFrame) -> DataFrame:
    """doc_id of documents whose text equals a text of the reference corpus."""
    digests = reference.select(F.sha2("text", 256).alias("digest")).distinct()
    return docs.select("doc_id", F.sha2("text", 256).alias("digest")).join(digests, "digest", "left_semi").select("doc_id")


def message_rejects(turns: DataFrame) -> DataFrame:
    """conv_id, reason: why a conversation is not exactly one user and one assistant turn with content; null if it is.

    The first and last turn and a count decide, so a conversation of any length is a partial aggregate.
    """
    turn = F.struct("turn", "role", "text")
    blank = F.bool_or(F.coalesce("text", F.lit("")) == "").alias("blank")
    rows = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min(turn)["role"].alias("a"), F.max(turn)["role"].alias("b"), blank)
    wrong = ~(F.col("a").eqNullSafe("user") & F.col("b").eqNullSafe("assistant"))
    return rows.select("conv_id", F.when(F.col("n") != 2, "turn-count").when(wrong, "role-order").when(F.col("blank"), "empty-content").alias("reason"))
