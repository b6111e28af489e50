"""Reviews that leave the engine and come back: packets bound to their evidence, verdicts, corrections, blocked releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import derived_id

VERDICTS = ("accepted", "rejected", "waived")


def evidence(context: Column, target: Column) -> Column:
    """The digest that binds a review to what was reviewed."""
    return F.sha2(F.concat(F.sha2(context, 256), F.sha2(target, 256)), 256)


def packets(items: DataFrame) -> DataFrame:
    """packet, queue, subject, required, evidence for review items (queue, subject, required, context, target)."""
    proof = evidence(F.col("context"), F.col("target"))
    body = F.to_json(F.struct(proof.alias("evidence"), F.col("queue").alias("queue"), F.col("subject").cast("string").alias("subject")))
    return items.select(derived_id("rvw", body).alias("packet"), "queue", "subject", "required", proof.alias("evidence"))


def submitted(sent: DataFrame, verdicts: DataFrame) -> DataFrame:
    """packet, subject, verdict, refusal for verdicts (packet, evidence, verdict, sequence) on packets: the last of a packet counts.

    An unknown packet, another evidence than was sent, or an unknown verdict is refused, and then there is none.
    """
    last = verdicts.groupBy("packet").agg(F.max(F.struct("sequence", "evidence", "verdict")).alias("v")).select("packet", F.col("v.evidence").alias("seen"), "v.verdict")
    rows = last.join(sent.select("packet", "subject", "evidence"), "packet", "left")
    refusal = F.when(F.col("subject").isNull(), "unknown-packet").when(F.col("seen") != F.col("evidence"), "other-evidence").when(~F.col("verdict").isin(*VERDICTS), "unknown-verdict")
    return rows.select("packet", "subject", F.when(refusal.isNull(), F.col("verdict")).alias("verdict"), refusal.alias("refusal"))


def unresolved(sent: DataFrame, done: DataFrame) -> DataFrame:
    """The required packets without an accepted or waived verdict: any of them holds back a release."""
    settled = done.filter("verdict in ('accepted', 'waived')").select("packet")
    return sent.filter("required").join(settled, "packet", "left_anti")


def corrections(log: DataFrame) -> DataFrame:
    """subject, sequence, correction, previous, current for an append-only log (subject, sequence, kind, payload).

    Each entry is an identity over its content; `previous` is the entry that it supersedes, and the last one is current.
    """
    rows = log.withColumn("correction", derived_id("cor", F.to_json(F.struct("kind", "payload", F.col("sequence").cast("long").alias("sequence"), F.col("subject").cast("string").alias("subject")))))
    order = Window.partitionBy("subject").orderBy("sequence")
    return rows.select("subject", "sequence", "correction", F.lag("correction").over(order).alias("previous"), F.lead("correction").over(order).isNull().alias("current"))
