"""Blocks of HTML pages by expressions: a flat subset (no nested blocks), without a parser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import prefix_sums

#: What carries no text of the page.
SKIPPED = r"(?is)<(?:script|style|noscript|template|svg|canvas|iframe|object)[ >].*?</(?:script|style|noscript|template|svg|canvas|iframe|object)>|<!--.*?-->"
BLOCK = r"(?is)<(?:h[1-6]|p|li|blockquote|pre|td|th)(?:\s[^>]*)?>.*?</(?:h[1-6]|p|li|blockquote|pre|td|th)>"
HEADING = r"(?i)^<h([1-6])"
TAG = r"(?s)<[^>]*>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def blocks(pages: DataFrame) -> DataFrame:
    """page_id, block, level (0 for a paragraph), section, text: blocks with text in page order.

    `section` counts the headings so far. Pages without blocks, and null pages, have no rows.
    """
    raw = F.regexp_extract_all(F.regexp_replace(F.coalesce("html", F.lit("")), SKIPPED, " "), F.lit(BLOCK), F.lit(0))

    def read(tag):
        text = F.regexp_replace(tag, TAG, " ")
        for name, char in ENTITIES:
            text = F.replace(text, F.lit(name), F.lit(char))
        level = F.regexp_extract(tag, HEADING, 1)
        return F.struct(F.when(level == "", "0").otherwise(level).cast("int").alias("level"), F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " ")).alias("text"))

    found = F.filter(F.transform(raw, read), lambda b: b["text"] != "")
    rows = pages.select("page_id", found.alias("b"))
    # headings up to each block, counted inside the row: no window over pages
    counts = prefix_sums(F.transform("b", lambda x: (x["level"] > 0).cast("int")))
    numbered = F.zip_with("b", counts, lambda x, n: F.struct(x["level"].alias("level"), n.alias("section"), x["text"].alias("text")))
    rows = rows.select("page_id", F.posexplode(numbered).alias("block", "x"))
    return rows.select("page_id", F.col("block").cast("long").alias("block"), F.col("x.level").cast("long").alias("level"), F.col("x.section").cast("long").alias("section"), F.col("x.text").alias("text"))


def _sql() -> str:
    text = f"regexp_replace(tag, '{TAG}', ' ', 'g')"
    for name, char in ENTITIES:
        text = "replace({}, '{}', '{}')".format(text, name, char.replace("'", "''"))
    return f"""WITH raw AS (SELECT row_number() OVER () AS rid, page_id, regexp_extract_all(regexp_replace(coalesce(html, ''), '{SKIPPED}', ' ', 'g'), '{BLOCK}') AS tags FROM pages),
tag AS (SELECT rid, page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM raw),
read AS (SELECT rid, page_id, pos, coalesce(try_cast(regexp_extract(tag, '{HEADING}', 1) AS BIGINT), 0) AS level,
  trim(regexp_replace({text}, '[ \\t\\r\\n\\f]+', ' ', 'g')) AS text FROM tag)
SELECT page_id, row_number() OVER w - 1 AS block, level, (sum((level > 0)::BIGINT) OVER w)::BIGINT AS section, text FROM read WHERE text <> ''
WINDOW w AS (PARTITION BY rid ORDER BY pos)"""


SQL = _sql()
