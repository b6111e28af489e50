"""Construction of records from passages: a registry of constructors, ordered drafts, coverage and evidence checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chunking, mapping
from .splitting import ordinals

#: A constructor turns chunks (locator, source, seq, text, heading) into drafts with `suffix`, `context` and `target`.
Constructor = Callable[[DataFrame], DataFrame]
KEYS = ("locator", "source", "seq", "suffix")


def full_text(chunks: DataFrame) -> DataFrame:
    return chunks.select("locator", "source", "seq", F.lit("").alias("suffix"), F.col("text").alias("context"), F.col("text").alias("target"))


def continuation(chunks: DataFrame, split_ppm: int = 500_000) -> DataFrame:
    rows = chunks.filter(F.length("text") >= 2)
    n = F.length("text")
    cut = F.greatest(F.lit(1), F.least(n - 1, F.floor(n.cast("long") * split_ppm / 1_000_000).cast("int")))
    return rows.select("locator", "source", "seq", F.lit("").alias("suffix"), F.substring("text", F.lit(1), cut).alias("context"), F.substring("text", cut + 1, n).alias("target"))


def section_reconstruction(chunks: DataFrame) -> DataFrame:
    return chunks.filter("heading is not null and text <> ''").select("locator", "source", "seq", F.lit("").alias("suffix"), F.col("heading").alias("context"), F.col("text").alias("target"))


def before_after_transformation(chunks: DataFrame) -> DataFrame:
    """Chunks with a column `raw`: the text before cleaning."""
    return chunks.filter(chunking.before_after(F.col("raw"), F.col("text"))).select("locator", "source", "seq", F.lit("").alias("suffix"), F.col("raw").alias("context"), F.col("text").alias("target"))


def structured_field(chunks: DataFrame) -> DataFrame:
    """Chunks with a column `fields` (array of name, value): a draft for each field."""
    rows = chunks.select("locator", "source", "seq", "text", F.explode("fields").alias("f"))
    return rows.select("locator", "source", "seq", F.col("f.name").alias("suffix"), F.col("text").alias("context"), F.col("f.value").alias("target"))


CONSTRUCTORS: dict[str, Constructor] = {
    "full_text": full_text,
    "continuation": continuation,
    "section_reconstruction": section_reconstruction,
    "before_after_transformation": before_after_transformation,
    "structured_field": structured_field,
}


def constructor(objective: str) -> Constructor:
    """The constructor of an objective; objectives whose records only rows can supply are refused."""
    if objective in mapping.IMPORT_ONLY:
        raise ValueError(f"{objective} needs rows: a document cannot supply it")
    if objective not in CONSTRUCTORS:
        raise ValueError(f"unknown objective {objective}")
    return CONSTRUCTORS[objective]


def selected(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks (source, ...) of the selected sources (source, locator), with their locator."""
    return chunks.join(sources.select("source", "locator"), "source")


def construct(chunks: DataFrame, sources: DataFrame, objective: str) -> DataFrame:
    """ordinal (from 1), locator, source, seq, suffix, context, target: drafts of the selected sources in order of locator, source, seq and suffix."""
    drafts = constructor(objective)(selected(chunks, sources)).withColumn("record_id", F.struct(*KEYS))
    placed = ordinals(drafts.select("record_id", F.lit(objective).alias("partition"))).select("record_id", (F.col("ordinal") + 1).alias("ordinal"))
    return drafts.join(placed, "record_id").select("ordinal", *KEYS, "context", "target")


def diagnostics(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """source, code: selected sources that have no chunk."""
    return sources.select("source").join(chunks.select("source").distinct(), "source", "left_anti").withColumn("code", F.lit("source-chunks-unavailable"))


def coverage_gaps(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, block: blocks with text (doc_id, block, text) that no chunk (doc_id, seq, block) holds."""
    return blocks.filter("text <> ''").select("doc_id", "block").join(chunks.select("doc_id", "block").distinct(), ["doc_id", "block"], "left_anti")


def repeated_keys(chunks: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one chunk has."""
    return chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def first_chunks(chunks: DataFrame) -> DataFrame:
    """doc_id, block, seq: the first chunk that holds a block."""
    return chunks.groupBy("doc_id", "block").agg(F.min("seq").alias("seq"))


def transformed_chunks(chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """doc_id, seq, transformed: whether a chunk holds a changed block (doc_id, block)."""
    marked = chunks.select("doc_id", "seq", "block").join(changed.withColumn("hit", F.lit(True)), ["doc_id", "block"], "left")
    return marked.groupBy("doc_id", "seq").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("transformed"))


def chunks_of_sections(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """section, seq (with the key of a page): chunks that share a block with a section (page_id, section, block)."""
    return sections.select("page_id", "section", "block").join(chunks.select("page_id", "seq", "block"), ["page_id", "block"]).select("page_id", "section", "seq").distinct()


def evidence_ok(value: Column, text: Column, start: Column, end: Column) -> Column:
    """Whether a value is what its place in a text says."""
    return F.coalesce(F.substring(text, start + 1, end - start) == value, F.lit(False))


def representative_sources(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """record_id, sources: the sources of each included record, and of the excluded copies (representative) that it stands for."""
    kept = decisions.filter("status = 'included'").select("record_id", F.col("record_id").alias("keeper"))
    gone = decisions.filter("reason = 'exact-duplicate'").select("record_id", F.col("representative").alias("keeper"))
    rows = kept.unionByName(gone).join(records.select("record_id", "source"), "record_id")
    inside = rows.join(kept.select("keeper"), "keeper", "left_semi")
    return inside.groupBy(F.col("keeper").alias("record_id")).agg(F.array_sort(F.collect_set("source")).alias("sources"))


def representatives(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """`decisions` with `representative`: for exact copies, the included record of equal source, context and target."""
    keys = ("source", F.sha2("context", 256).alias("c"), F.sha2("target", 256).alias("t"))
    placed = decisions.join(records.select("record_id", *keys), ["record_id", "source"] if "source" in decisions.columns else "record_id")
    first = placed.filter("reason is null or reason = 'source-cap' or reason = 'exact-duplicate'").groupBy("source", "c", "t").agg(F.min("record_id").alias("representative"))
    out = placed.join(first, ["source", "c", "t"], "left")
    return out.select("record_id", "source", "status", "reason", F.when(F.col("reason") == "exact-duplicate", F.col("representative")).alias("representative"))


def conflicts(records: DataFrame, keys: tuple[str, ...] = ("source", "context")) -> DataFrame:
    """record_id, variants, related: records of one key with different targets, how many targets there are, and how many other records take part.

    The key may be the context alone, as for imported rows. Groups are counted, never gathered.
    """
    rows = records.select("record_id", *[F.sha2(F.col(k).cast("string"), 256).alias(f"k{i}") for i, k in enumerate(keys)], F.sha2("target", 256).alias("t"))
    names = [f"k{i}" for i in range(len(keys))]
    each = rows.groupBy(*names, "t").agg(F.count(F.lit(1)).alias("n"))
    groups = each.groupBy(*names).agg(F.count(F.lit(1)).alias("variants"), (F.sum("n") - 1).alias("related")).filter("variants > 1")
    return rows.join(groups, names).select("record_id", "variants", "related")


def coverage(sources: DataFrame, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """source, candidates, records, included, excluded, quarantined, primary_included, blockers for every selected source, those without a row too.

    candidates (candidate_id, sources) and decisions (record_id, sources, status) count for each of their sources; the first source is primary.
    """
    made = candidates.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("candidates"))
    rows = decisions.select("status", F.posexplode("sources").alias("at", "source"))
    count = lambda c, n: F.sum(c.cast("long")).alias(n)
    is_ = lambda s: F.col("status") == s
    done = rows.groupBy("source").agg(F.count(F.lit(1)).alias("records"), count(is_("included"), "included"), count(is_("excluded"), "excluded"), count(is_("quarantined"), "quarantined"), count(is_("included") & (F.col("at") == 0), "primary_included"))
    out = sources.select("source").distinct().join(made, "source", "left").join(done, "source", "left").fillna(0)
    marks = {"candidates": "no-constructed-candidates", "records": "no-dataset-records", "included": "no-included-contribution"}
    blockers = F.array_sort(F.array_compact(F.array(*[F.when(F.col(c) == 0, F.lit(m)) for c, m in marks.items()])))
    return out.withColumn("blockers", F.array_join(blockers, ","))


def clusters(members: DataFrame) -> DataFrame:
    """cluster, size, rank for rows (group_id, member): a digest of the members in order, and places by it among clusters of two or more.

    Meant for previews: a cluster's members are gathered in one row, 65,536 at most; larger ones are named by count and ends.
    """
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.min("member").alias("low"), F.max("member").alias("high")).filter("size > 1")
    small = members.join(sizes.filter("size <= 65536").select("group_id"), "group_id").groupBy("group_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("member").cast("string"))), ","), 256).alias("digest"))
    named = sizes.join(small, "group_id", "left").withColumn("cluster", F.coalesce("digest", F.sha2(F.concat_ws(":", "size", "low", "high"), 256)))
    return named.select("cluster", "size")


def latest_first(rows: DataFrame, key: str, order: str, n: int = 1) -> DataFrame:
    """The first `n` rows of each key by an order column; each task keeps its own first rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")
