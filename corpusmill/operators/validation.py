"""Checks of finished datasets: seventeen gates in order, each with the number of faults it sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .mapping import contract_code, resolve

# The gates in order, and those that each failing gate blocks.
GATES = (
    "construction-replay", "record-lifecycle", "curation", "deduplication", "quality", "balance", "coverage", "split", "leakage", "row-binding", "objective", "schema", "encoding", "masking",
    "partition-nonempty", "handoff-row-shape", "snapshot",
)
BLOCKS = {"construction-replay": GATES[1:16], "curation": GATES[3:16], "split": GATES[8:16], "row-binding": GATES[10:16]}
PARTITIONS = ("train", "evaluation")


def checksum(payload: Column) -> Column:
    """An order-free checksum of payloads: the sum of the first twelve digits of their digests."""
    return F.sum(F.conv(F.substring(F.sha2(payload, 256), 1, 12), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")


def manifest(rows: DataFrame) -> DataFrame:
    """dataset, partition, n, checksum of rows (dataset, partition, payload)."""
    return rows.groupBy("dataset", "partition").agg(F.count(F.lit(1)).alias("n"), checksum(F.col("payload")).alias("checksum"))


def _text_digest(context: Column, target: Column) -> Column:
    return F.unhex(F.sha2(F.to_json(F.struct(context.alias("context"), target.alias("target"))), 256))


def by_record(records: DataFrame, replay: DataFrame, decisions: DataFrame, assignments: DataFrame, rows: DataFrame, row_schema: str = "prompt_completion") -> DataFrame:
    """One row for each dataset and record id that any table names: how often each names it, and what it says. One shuffle for all five.

    Texts and payloads are judged where they stand: what travels of them is lengths, digests and verdicts.
    """
    key = ("dataset", "record_id")
    col = F.col
    said = "struct<source:string,texts:binary>"
    fields = {"record": said, "replay": said, "n_target": "int", "status": "string", "group_id": "string", "side": "string", "partition": "string", "objective": "string", "misshapen": "boolean", "recoded": "boolean", "row_texts": "binary"}

    def shaped(df: DataFrame, kind: str, **values: Column) -> DataFrame:
        return df.select(*key, F.lit(kind).alias("kind"), *[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields.items()])

    whole = F.struct(col("source").cast("string").alias("source"), _text_digest(col("context"), col("target")).alias("texts"))
    payload = col("payload")
    # a row that is no object has no canonical form, and differs from none
    recoded = F.to_json(F.try_parse_json(payload)) != payload
    every = (
        shaped(records, "record", record=whole, n_target=F.length("target"))
        .unionByName(shaped(replay, "replay", replay=whole))
        .unionByName(shaped(decisions, "decision", status=col("status")))
        .unionByName(shaped(assignments, "assignment", group_id=col("group_id"), side=col("partition")))
        .unionByName(shaped(rows, "row", partition=col("partition"), objective=col("objective"), misshapen=contract_code(payload, row_schema).isNotNull(), recoded=recoded, row_texts=_text_digest(resolve(payload, "prompt"), resolve(payload, "completion"))))
    )
    count = lambda kind: F.sum((col("kind") == kind).cast("int")).alias(f"n_{kind}")
    found = every.groupBy(*key).agg(*[count(k) for k in ("record", "replay", "decision", "assignment", "row")], *[F.max(n).alias(n) for n in fields])
    return found.withColumn("replayed", col("record").eqNullSafe(col("replay"))).drop("replay")


def faults(joined: DataFrame, rows: DataFrame, expected: DataFrame, min_target: int, cap: int, objective: str) -> DataFrame:
    """dataset, gate, faults over `by_record` (written, as several passes read it), the rows and their expected manifest."""
    col, flag = F.col, lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    inside = F.coalesce(col("status") == "included", F.lit(False))
    has_row = col("n_row") > 0
    null = F.lit(None).cast("string")
    wrong_text = col("row_texts") != F.coalesce(col("record.texts"), _text_digest(null, null))
    direct = {
        "construction-replay": flag(((col("n_record") > 0) | (col("n_replay") > 0)) & ~col("replayed")),
        "record-lifecycle": flag((col("n_record") > 1) | (col("n_decision") > 1)),
        "curation": flag(((col("n_record") > 0) | (col("n_decision") > 0)) & ((col("n_record") == 0) | (col("n_decision") != 1))),
        "quality": flag(inside & (col("n_target") < min_target)),
        "split": flag((inside.cast("int") != col("n_assignment")) | ((col("n_assignment") > 0) & ~col("side").isin(*PARTITIONS))),
        "row-binding": flag((inside.cast("int") != col("n_row")) | (has_row & ~col("partition").eqNullSafe(col("side")))),
        "objective": flag(has_row & ~col("objective").eqNullSafe(objective)),
        "schema": flag(has_row & col("misshapen")),
        "encoding": flag(has_row & col("recoded")),
        "masking": flag(has_row & wrong_text),
        "handoff-row-shape": flag(has_row & (col("misshapen") | (F.coalesce("n_target", F.lit(0)) == 0))),
        "partition-nonempty": F.lit(2) - F.count_distinct(F.when(has_row & col("partition").isin(*PARTITIONS), col("partition"))),
    }
    one = joined.groupBy("dataset").agg(*[v.cast("long").alias(g) for g, v in direct.items()])
    parts = [one.select("dataset", F.inline(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(f"`{g}`").alias("faults")) for g in direct])))]
    kept = joined.filter(inside)
    copies = kept.groupBy("dataset", "record").agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("a"), F.max("side").alias("b"))
    copies = copies.groupBy("dataset").agg(F.sum(col("n") - 1).alias("again"), flag(col("a") != col("b")).alias("crossing"))
    groups = joined.filter("n_assignment > 0").groupBy("dataset", "group_id").agg(F.min("side").alias("a"), F.max("side").alias("b"))
    groups = groups.groupBy("dataset").agg(flag(col("a") != col("b")).alias("split_groups"))
    sources = joined.filter("n_record > 0").groupBy("dataset", col("record.source").alias("source")).agg(F.sum(inside.cast("long")).alias("n"))
    sources = sources.groupBy("dataset").agg(flag(col("n") > cap).alias("over"), flag(col("n") == 0).alias("none"))
    both = manifest(rows).join(expected.select("dataset", "partition", col("n").alias("m"), col("checksum").alias("c")), ["dataset", "partition"], "full")
    snapshot = both.groupBy("dataset").agg(flag(~(col("n").eqNullSafe(col("m")) & col("checksum").eqNullSafe(col("c")))).alias("snapshot"))
    rest = one.select("dataset").join(copies, "dataset", "left").join(groups, "dataset", "left").join(sources, "dataset", "left").join(snapshot, "dataset", "left").fillna(0)
    named = {"deduplication": col("again"), "leakage": col("crossing") + col("split_groups"), "balance": col("over"), "coverage": col("none"), "snapshot": col("snapshot")}
    parts.append(rest.select("dataset", F.inline(F.array(*[F.struct(F.lit(g).alias("gate"), v.cast("long").alias("faults")) for g, v in named.items()]))))
    return parts[0].unionByName(parts[1])


def gates(found: DataFrame) -> DataFrame:
    """dataset, gate, place, status, faults: passed, failed or blocked; a gate that failed blocks those that rely on it."""
    at = F.array(*[F.lit(g) for g in GATES])
    cells = found.groupBy("dataset").agg(F.map_from_entries(F.collect_list(F.struct("gate", "faults"))).alias("m"))  # seventeen entries
    wrong = lambda g: F.coalesce(F.element_at("m", F.lit(g)), F.lit(0)) > 0
    blocked = {g: [b for b, those in BLOCKS.items() if g in those] for g in GATES}

    def one(g: str) -> Column:
        stop = F.lit(False)
        for b in blocked[g]:
            stop = stop | wrong(b)
        status = F.when(stop, "blocked").when(wrong(g), "failed").otherwise("passed")
        return F.struct(F.lit(g).alias("gate"), F.array_position(at, F.lit(g)).cast("long").alias("place"), status.alias("status"), F.coalesce(F.element_at("m", F.lit(g)), F.lit(0)).alias("faults"))

    return cells.select("dataset", F.inline(F.array(*[one(g) for g in GATES])))


def validate(records: DataFrame, replay: DataFrame, decisions: DataFrame, assignments: DataFrame, rows: DataFrame, expected: DataFrame, min_target: int = 200, cap: int = 30, objective: str = "continuation", row_schema: str = "prompt_completion") -> DataFrame:
    """The gates of any number of datasets at once (column `dataset` in every table).

    records and replay (record_id, source, context, target), decisions (record_id, status), assignments (record_id, group_id,
    partition), rows (record_id, partition, objective, payload), expected (partition, n, checksum) as `manifest` gives it.
    """
    joined = written(by_record(records, replay, decisions, assignments, rows, row_schema), "by-record")
    return gates(faults(joined, rows, expected, min_target, cap, objective))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows that one table has more often than the other, with `side` (left or right): none if a replay is the same."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def crossing(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Tokens (kind, value) that both partitions have."""
    return train.select("kind", "value").intersect(evaluation.select("kind", "value"))
