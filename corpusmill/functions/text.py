"""Column functions on text, all inside the JVM."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


@lru_cache(1)
def _folds() -> dict[str, str]:
    """Lower-case characters that full case folding changes further, such as the sharp s and the final sigma."""
    low = {chr(c).lower() for c in range(0x20000) if not 0xD800 <= c < 0xE000}
    return {x: x.casefold() for x in sorted(low) if len(x) == 1 and x.casefold() != x}


def folded(text: Column) -> Column:
    """Text with case folded: lowered, and the few characters that need more replaced.

    Single characters and the sharp s are replaced as they come; only texts with one of the rare others are cut up.
    """
    folds = _folds()
    single, rare = {k: v for k, v in folds.items() if len(v) == 1}, {k: v for k, v in folds.items() if len(v) > 1 and k != "ß"}
    table = F.create_map(*[F.lit(v) for pair in rare.items() for v in pair])
    each = lambda low: F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    some = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in rare) + "]"
    plain = F.replace(F.translate(F.lower(text), "".join(single), "".join(single.values())), F.lit("ß"), F.lit("ss"))
    return let(plain, lambda low: F.when(low.rlike(some), each(low)).otherwise(low))


def normalized(text: Column) -> Column:
    """White space runs become one blank, ends are trimmed, case is folded."""
    return folded(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def char_shingles(text: Column, n: int = 5) -> Column:
    """Distinct runs of n characters; a shorter text is one, an empty one none. One pass: `text` is not evaluated for each run."""
    grams = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)))
    return let(text, lambda t: F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) <= n, F.array(t)).otherwise(grams(t)))


def jaccard_ppm(a: Column, b: Column) -> Column:
    """Intersection over union in whole millionths; two empty sets are equal."""
    common = F.size(F.array_intersect(a, b)).cast("long")
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1_000_000)).otherwise(F.floor(common * 1_000_000 / F.greatest(union, F.lit(1)))).cast("long")


def ppm_target(total: Column, ppm: int) -> Column:
    """The share of a total, rounded half up, at least 1 and at most total - 1."""
    return F.greatest(F.lit(1), F.least(total - 1, F.floor((total * ppm + 500_000) / 1_000_000))).cast("long")
