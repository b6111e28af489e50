"""Spans of regular-expression matches as DataFrame expressions.

Spark gives the matches of a pattern and the pieces between them, but no positions; both
lists together have them: a match starts after all pieces and matches before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, even where `use` mentions it many times or inside a lambda.

    The optimizer may put a column's expression in place of its name, and then a lambda
    evaluates it for each element; a lambda's own variable is safe from that.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(values: Column) -> Column:
    """An array cut into arrays of _BLOCK elements; it must not be empty."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")),
        lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)),
    )


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running fold of an array of non-negative integers: sums, or greatest values.

    Blocks and block totals are computed once; an element costs half a block, so that tens of
    thousands of elements stay cheap.
    """

    def fold(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), step)

    def inside(totals: Column) -> Callable[[Column, Column], Column]:
        return lambda part, k: let(
            fold(F.slice(totals, F.lit(1), k)),
            lambda before: F.transform(part, lambda _, i: F.aggregate(F.slice(part, F.lit(1), i + 1), before, step)),
        )

    def of_blocks(blocks: Column) -> Column:
        return let(F.transform(blocks, fold), lambda totals: F.flatten(F.transform(blocks, inside(totals))))

    none = F.array().cast("array<int>")
    return let(values, lambda v: F.when(F.size(v) > 0, let(_blocks(v), of_blocks)).otherwise(none))


def running_sums(values: Column) -> Column:
    """Inclusive prefix sums of an array."""
    return running(values, lambda a, x: a + x)


def in_blocks(found: Column) -> Column:
    """Sorted spans as blocks (low, high, rows), in which `any_span` looks spans up; empty for none."""
    cut = let(
        found,
        lambda f: F.transform(
            _blocks(f),
            lambda rows: F.struct(F.get(rows, F.lit(0))["start"].alias("low"), F.array_max(F.transform(rows, lambda s: s["end"])).alias("high"), rows.alias("rows")),
        ),
    )
    return F.when(F.size(found) > 0, cut)


def any_span(blocks: Column, start: Column, end: Column) -> Column:
    """Whether some span of the blocks has start <= `start` and end >= `end`; false for none."""
    inside = F.exists(blocks, lambda b: (b["low"] <= start) & (b["high"] >= end) & F.exists(b["rows"], lambda s: (s["start"] <= start) & (s["end"] >= end)))
    return F.coalesce(inside, F.lit(False))


def no_spans(kind: str = "") -> Column:
    return F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")


def spans(text: Column, hits: Column, pattern: str, kind: str, rank: int) -> Column:
    """Array of (start, rank, end, kind, value) of all matches; `hits` must be regexp_extract_all(text, pattern, 0).

    Offsets are code points, `end` is exclusive. Only texts with a match are split.
    """
    pieces = F.split(text, pattern, -1)
    gaps = F.transform(
        F.slice(pieces, F.lit(1), F.size(hits)),
        lambda p, i: F.length(p) + F.when(i > 0, F.length(F.get(hits, i - 1))).otherwise(0),
    )
    found = F.zip_with(
        running_sums(gaps),
        hits,
        lambda s, h: F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + F.length(h)).alias("end"), F.lit(kind).alias("kind"), h.alias("value")),
    )
    return F.when(F.size(hits) > 0, found).otherwise(no_spans())


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def replaced(text: Column, found: Column) -> Column:
    """The text with each span, or each union of overlapping spans, replaced by <KIND> of its first span.

    `found` is sorted by start. Characters are cut once into an array, and unions come from the running
    greatest end, so cost is linear in the text and its spans.
    """

    def unions(f: Column, ends: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(f) - 1), lambda i: (i == 0) | (F.get(f, i)["start"] >= F.get(ends, i - 1)))
        return let(
            heads,
            lambda hs: F.transform(
                hs,
                lambda h, j: F.struct(
                    F.get(f, h)["start"].alias("start"),
                    F.get(ends, F.coalesce(F.get(hs, j + 1), F.size(f)) - 1).alias("end"),
                    F.get(f, h)["kind"].alias("kind"),
                ),
            ),
        )

    def build(spans_: Column, cps: Column) -> Column:
        parts = F.transform(
            spans_,
            lambda s, i: let(
                F.coalesce(F.get(spans_, i - 1)["end"], F.lit(0)),
                lambda last: F.concat(F.array_join(F.slice(cps, last + 1, s["start"] - last), ""), F.lit("<"), F.upper(s["kind"]), F.lit(">")),
            ),
        )
        tail = F.array_join(F.slice(cps, F.try_element_at(spans_, F.lit(-1))["end"] + 1, F.size(cps)), "")
        return F.concat(F.array_join(parts, ""), tail)

    def of(x: Column) -> Column:
        merged = let(running(F.transform(x["found"], lambda s: s["end"]), lambda a, x: F.greatest(a, x)), lambda ends: unions(x["found"], ends))
        cut = let(F.split(x["text"], ""), lambda cps: let(merged, lambda m: build(m, cps)))
        return F.when(F.size(x["found"]) > 0, cut).otherwise(x["text"])

    return let(F.struct(text.alias("text"), found.alias("found")), of)
