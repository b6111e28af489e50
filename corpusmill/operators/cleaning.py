"""Text cleaning rules with a safety valve: a rule that would remove too much of a text is skipped."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the stock rules.
PAGE_NUMBERS = r"(?im)^[ \t]*(?:\d{1,4}|(?:page|p\.?)\s*\d{1,4}(?:\s*of\s*\d{1,4})?)[ \t]*(?:\n|$)"
WHITESPACE = r"[ \t]+"
URLS = r"(?i)https?://[^\s]+"
EMAILS = r"(?i)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SPECIAL = r"""(?U)[^\w\s.,!?;:'"()/\-\p{M}]"""
#: A rule may remove three tenths of a text at most.
MAX_REMOVED_TENTHS = 3

RULES = {
    "page-numbers": lambda t: F.regexp_replace(t, PAGE_NUMBERS, ""),
    "whitespace": lambda t: F.regexp_replace(t, WHITESPACE, " "),
    "urls": lambda t: F.regexp_replace(t, URLS, ""),
    "emails": lambda t: F.regexp_replace(t, EMAILS, ""),
    "special-chars": lambda t: F.regexp_replace(t, SPECIAL, ""),
    "lowercase": lambda t: F.lower(t),
}


def guarded(before: Column, after: Column) -> Column:
    """`after`, unless more than the allowed share of `before` is gone."""
    return F.when((F.length(before) - F.length(after)) * 10 > F.length(before) * MAX_REMOVED_TENTHS, before).otherwise(after)


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _applied(rule: str, text: Column) -> Column:
    """One guarded rule. Lambda variables name the text and its rewrite, so that the chain of rules stays linear in size."""
    pair = F.transform(F.array(text), lambda t: F.struct(t.alias("before"), RULES[rule](t).alias("after")))
    return F.get(F.transform(pair, lambda p: guarded(p["before"], p["after"])), F.lit(0))


def clean(docs: DataFrame, rules: tuple[str, ...] = ("page-numbers", "whitespace"), text_col: str = "text") -> DataFrame:
    """`docs` with the rules applied to its text in order; a null text stays null."""
    text = F.col(text_col)
    for rule in rules:
        text = _applied(rule, text)
    return docs.withColumn(text_col, text)


def custom(pattern: str, replacement: str):
    """A rule of the user's: a pattern (case ignored, Unicode classes, lines on their own) and a replacement with groups as backslash and digit."""
    groups = re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))
    return lambda t: F.regexp_replace(t, F.lit(f"(?imU){pattern}"), F.lit(groups))


def audit(before: Column, after: Column) -> Column:
    """What a rewrite did: characters and bytes removed (0 at least), and digests of both texts."""
    gone = lambda size: F.greatest(F.lit(0), size(before) - size(after)).cast("long")
    return F.struct(gone(F.length).alias("chars_removed"), gone(F.octet_length).alias("bytes_removed"), F.sha2(before, 256).alias("input_sha256"), F.sha2(after, 256).alias("output_sha256"))


def drop_repeated_lines(docs: DataFrame, threshold: int = 3, longest: int = 80, text_col: str = "text") -> DataFrame:
    """`docs` without short lines (stripped) that occur `threshold` times or more in their text; decided inside the row."""
    strip = lambda l: F.regexp_replace(l, r"(?U)^\s+|\s+$", "")
    parts = F.split(text_col, "\n")
    short = F.array_sort(F.filter(F.transform(parts, strip), lambda l: (l != "") & (F.length(l) <= longest)))
    # in sorted order, a line equal to the one threshold - 1 places on is repeated
    repeated = _let(short, lambda s: F.array_distinct(F.filter(s, lambda l, i: F.get(s, i + threshold - 1) == l)))
    both = F.struct(parts.alias("parts"), repeated.alias("repeated"))
    kept = _let(both, lambda z: F.array_join(F.filter(z["parts"], lambda l: ~F.array_contains(z["repeated"], strip(l))), "\n"))
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), kept))


def repeated_lines(docs: DataFrame, threshold: int = 3, longest: int = 80) -> DataFrame:
    """doc_id, line, n: short lines (stripped) that occur at least `threshold` times in a document."""
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("doc_id", F.regexp_replace("line", r"^[\s\x1c-\x1f\x85]+|[\s\x1c-\x1f\x85]+$", "").alias("line"))
    lines = lines.filter((F.length("line") > 0) & (F.length("line") <= longest))
    return lines.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= threshold)
