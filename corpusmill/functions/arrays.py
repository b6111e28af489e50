"""Array expressions whose cost stays near linear in the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an array of whole numbers: sums of blocks first, then inside each block."""
    add = lambda part, start: F.aggregate(part, start, lambda a, x: a + x)
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)))

    def joined(parts: Column, totals: Column) -> Column:
        inner = lambda part, before: F.transform(part, lambda _, i: add(F.slice(part, F.lit(1), i + 1), before))
        return F.flatten(F.transform(parts, lambda part, k: let(add(F.slice(totals, F.lit(1), k), F.lit(0)), lambda before: inner(part, before))))

    whole = lambda v: let(cut(v), lambda parts: let(F.transform(parts, lambda p: add(p, F.lit(0))), lambda totals: joined(parts, totals)))
    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<int>")))


def match_spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches of a pattern, in code points, end exclusive."""

    def of(x: Column) -> Column:
        gaps = F.transform(x["hits"], lambda h, i: F.length(F.get(x["pieces"], i)) + F.when(i > 0, F.length(F.get(x["hits"], i - 1))).otherwise(0))
        return F.zip_with(prefix_sums(gaps), x["hits"], lambda s, h: F.struct(s.alias("start"), (s + F.length(h)).alias("end"), h.alias("value")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("pieces"))
    return let(both, of)
