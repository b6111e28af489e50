"""Quality facts, (name, key, value) rows that reports are made of, and gates over them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.text import normalized
from ..sources.shared import written
from .graph import leakage_groups
from .reports import DETECTORS, message_rejects
from .similarity import similar_pairs

# Thresholds at which near-duplicate clusters are previewed, in millionths.
PREVIEW_PPM = (500_000, 800_000, 900_000, 990_000)
#: A gate reports when its fact reaches this value; it never blocks.
GATES = {
    "preview-detector-pii": ("detector-hits", "pii", 1),
    "preview-detector-secret": ("detector-hits", "secret", 1),
    "preview-family-missing-label": ("missing-labels", "", 1),
    "preview-family-ranking-tie": ("ranking-ties", "", 1),
    "preview-family-singleton-label-set": ("singleton-label-set", "", 1),
    "preview-family-tool-role-gap": ("tool-role-gaps", "", 1),
    "preview-family-unpaired-without-policy": ("unpaired-feedback", "", 1),
    "preview-leakage-cross-partition": ("crossing-targets", "", 1),
    "preview-near-duplicate-members": ("near-duplicate-members", "800000", 1),
    "preview-split-empty-target": ("empty-targets", "", 1),
    "preview-split-malformed-role": ("malformed-roles", "", 1),
}


def _long(rows: DataFrame, values: dict[tuple[str, str], Column]) -> DataFrame:
    """One aggregation, unfolded into a row for each fact."""
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("key"), F.coalesce(v, F.lit(0)).cast("long").alias("value")) for (n, k), v in values.items()])
    return rows.agg(cells.alias("f")).select(F.inline("f"))


def distribution_facts(records: DataFrame, tallies: tuple[str, ...] = ("source", "lang", "reason", "partition")) -> DataFrame:
    """name, key, value for records (status, target, and the tallied columns): counts by status, tallies, and exact histograms.

    Tallies and lengths cover included records, reasons the others; null keys are left out. One pass groups by
    all tallied columns together, and the tallies are sums over that small table.
    """
    size = F.coalesce(F.length("target"), F.lit(0)).cast("long")
    cells = records.groupBy("status", *tallies).agg(F.count(F.lit(1)).alias("n"), F.sum((size == 0).cast("long")).alias("empty"))
    cells = written(cells, "cells")
    counts = [F.sum(F.when(F.col("status") == s, F.col("n"))) for s in ("included", "excluded", "quarantined")]
    empty = F.sum(F.when(F.col("status") == "included", F.col("empty")))
    parts = [_long(cells, {("included-records", ""): counts[0], ("excluded-records", ""): counts[1], ("quarantined-records", ""): counts[2], ("empty-targets", ""): empty})]
    for column in tallies:
        which = F.col("status") != "included" if column == "reason" else F.col("status") == "included"
        tally = cells.filter(which & F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.sum("n").alias("value"))
        parts.append(tally.select(F.lit(f"{column}-distribution").alias("name"), "key", "value"))
    lengths = records.filter("status = 'included'").groupBy(size.alias("key")).agg(F.count(F.lit(1)).alias("value"))
    parts.append(lengths.select(F.lit("target-length-distribution").alias("name"), F.col("key").cast("string").alias("key"), "value"))
    return reduce(DataFrame.unionByName, parts)


def detector_facts(records: DataFrame) -> DataFrame:
    """name, key, value: records for each family of detectors, a record counted once; one scan."""
    families = list(dict.fromkeys(f for f, _, _ in DETECTORS))
    hit = {f: reduce(Column.__or__, [F.coalesce(F.col("target").rlike(p), F.lit(False)) for g, _, p in DETECTORS if g == f]) for f in families}
    return _long(records.filter("status = 'included'"), {("detector-hits", f): F.sum(hit[f].cast("long")) for f in families})


def crossing_facts(records: DataFrame) -> DataFrame:
    """name, key, value: how many targets of included records occur in both partitions."""
    rows = records.filter("status = 'included'").groupBy(F.sha2("target", 256).alias("d")).agg((F.min("partition") != F.max("partition")).alias("both"))
    return _long(rows, {("crossing-targets", ""): F.sum(F.col("both").cast("long"))})


def encoder(count: Callable[[str], int]) -> Callable[[str], Column]:
    """A tokenizer's count as a column function: Arrow batches, null texts as empty. A negative count is an error."""

    @F.pandas_udf(LongType())
    def encode(texts: pd.Series) -> pd.Series:
        out = texts.map(lambda t: count(t or ""))
        if (out < 0).any():
            raise ValueError("a token count is negative")
        return out

    return lambda column: encode(F.col(column))


def token_facts(records: DataFrame, count: Column, max_tokens: int) -> DataFrame:
    """name, key, value: a histogram of token counts of included records, and how many exceed the limit."""
    rows = records.filter("status = 'included'").groupBy(count.cast("long").alias("tokens")).agg(F.count(F.lit(1)).alias("value"))
    over = _long(rows, {("truncated-records", ""): F.sum(F.when(F.col("tokens") > max_tokens, F.col("value")))})
    return rows.select(F.lit("token-distribution").alias("name"), F.col("tokens").cast("string").alias("key"), "value").unionByName(over)


def family_facts(rows: DataFrame) -> DataFrame:
    """name, key, value over rows (label, item, rank, tool_name, tool_role, feedback, paired), any of them null.

    Missing labels (empty, not null), a label set of one, ties of rank inside an item, tools without a role, feedback without a pair.
    """
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    flag = lambda c: F.sum(c.cast("long"))
    label = F.when(has("label"), F.col("label"))
    ranks = rows.filter(has("item") & has("rank")).groupBy("item", "rank").agg(F.count(F.lit(1)).alias("n"))
    direct = {
        ("missing-labels", ""): flag(F.coalesce(F.col("label") == "", F.lit(False))),
        ("singleton-label-set", ""): (F.min(label) == F.max(label)).cast("long"),
        ("tool-role-gaps", ""): flag(has("tool_name") & ~has("tool_role")),
        ("unpaired-feedback", ""): flag(F.col("feedback").isNotNull() & ~F.coalesce("paired", F.lit(False))),
    }
    return _long(rows, direct).unionByName(_long(ranks, {("ranking-ties", ""): F.sum(F.col("n") - 1)}))


def role_facts(turns: DataFrame) -> DataFrame:
    """name, key, value: conversations of two turns that are not a user's and an assistant's."""
    return _long(message_rejects(turns), {("malformed-roles", ""): F.sum((F.col("reason") == "role-order").cast("long"))})


def near_duplicate_preview(rows: DataFrame, id_col: str, text_col: str, thresholds: tuple[int, ...] = PREVIEW_PPM) -> DataFrame:
    """name, key (threshold), value: clusters of two members or more, and their members.

    Equal normalised texts form a class first (two empty texts are equal); only class representatives are joined, so
    copies never make pairs among themselves.
    """
    base = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    classes = base.groupBy(F.sha2(normalized(F.col("text")), 256).alias("d")).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes, "classes")
    first = base.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    pairs = written(similar_pairs(first, "id", "text", min(thresholds)), "pairs")
    # one run for all thresholds: a record is (threshold, id), and so is the smallest of its group
    levels = F.explode(F.array(*[F.lit(ppm) for ppm in thresholds])).alias("ppm")
    near = pairs.select("*", levels).filter(F.col("similarity_ppm") >= F.col("ppm"))
    token = F.concat_ws("-", "ppm", "a", "b").alias("token")
    tokens = near.select(F.struct("ppm", F.col("a").alias("id")).alias("record_id"), token).unionByName(near.select(F.struct("ppm", F.col("b").alias("id")).alias("record_id"), token))
    own = classes.select("*", levels).select(F.struct("ppm", F.col("rep").alias("id")).alias("record_id"), "copies", F.concat(F.lit("class-"), "ppm", F.lit("-"), "d").alias("token"))
    groups = leakage_groups(tokens.unionByName(own.select("record_id", "token"))).join(own.select("record_id", "copies"), "record_id")
    groups = groups.groupBy("group_id").agg(F.sum("copies").alias("members")).filter("members > 1")
    values = {}
    for ppm in thresholds:
        at = F.col("group_id.ppm") == ppm
        values |= {("near-duplicate-clusters", str(ppm)): F.sum(at.cast("long")), ("near-duplicate-members", str(ppm)): F.sum(F.when(at, F.col("members")))}
    return _long(groups, values)


def gates(facts: DataFrame, gate_values: dict[str, tuple[str, str, int]] = GATES) -> DataFrame:
    """gate, observed, reached: each gate's fact against its threshold; both are null where the fact was not computed."""
    observed = {g: F.sum(F.when((F.col("name") == n) & (F.col("key") == k), F.col("value"))) for g, (n, k, _) in gate_values.items()}
    cells = [F.struct(F.lit(g).alias("gate"), v.cast("long").alias("observed"), (v >= gate_values[g][2]).alias("reached")) for g, v in observed.items()]
    return facts.agg(F.array(*cells).alias("g")).select(F.inline("g"))


def statistics(records: DataFrame) -> DataFrame:
    """records, included, excluded, quarantined, and least, most and summed target lengths of the included; one pass."""
    size = F.when(F.col("status") == "included", F.length("target").cast("long"))
    count = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0)).alias(s)
    return records.agg(F.count(F.lit(1)).alias("records"), count("included"), count("excluded"), count("quarantined"), F.min(size).alias("least"), F.max(size).alias("most"), F.sum(size).alias("characters"))


def rare_shapes(rows: DataFrame, payload: str) -> DataFrame:
    """shape: sets of keys, in order, that occur in one row only."""
    shape = F.array_join(F.json_object_keys(payload), ",").alias("shape")
    return rows.groupBy(shape).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("shape")


def review_queue(decisions: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """queue, subject, required: pending candidates (required, they hold back a release) and quarantined conflicts."""
    conflicts = decisions.filter("status = 'quarantined' and reason = 'conflict'").select(F.lit("conflict").alias("queue"), F.col("record_id").alias("subject"), F.lit(False).alias("required"))
    if candidates is None:
        return conflicts
    return conflicts.unionByName(candidates.filter("status = 'pending'").select(F.lit("pending").alias("queue"), F.col("record_id").alias("subject"), F.lit(True).alias("required")))


def ocr_action(mean: Column, least: Column) -> Column:
    """What to do with a recognised page by the confidence of its words: none, review; least under 30, refuse; mean under 60, review; under 80, warn."""
    return F.when(mean.isNull(), "review").when(least < 30, "refuse").when(mean < 60, "review").when(mean < 80, "warn").otherwise("accept")


def ocr_pages(words: DataFrame) -> DataFrame:
    """page, mean, least, words, action over recognised words (page, level, conf, text); pages without a word stay, for review.

    A word has level 5, a confidence of 0 or more and a text that is not blank.
    """
    real = (F.col("level") == 5) & (F.col("conf") >= 0) & (F.trim("text") != "")
    conf = F.when(real, F.col("conf"))
    pages = words.groupBy("page").agg(F.avg(conf).alias("mean"), F.min(conf).alias("least"), F.count(conf).alias("words"))
    return pages.withColumn("action", ocr_action(F.col("mean"), F.col("least")))
