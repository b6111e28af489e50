"""Queries on segmentation and construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, cleaning
from ..sources import html
from ..sources.tables import read_table
from .registry import ORACLE_SQL, digest, query

_TRIM = r"regexp_replace(regexp_replace({}, '^[\s\v]+', ''), '[\s\v]+$', '')"

#: Greedy packing as a recursion over the parts of a text, one part a step.
_PACKED = """, f AS (SELECT {key}, pos, part AS buf, 1 AS seq FROM s WHERE pos = 1
  UNION ALL SELECT s.{key}, s.pos, CASE WHEN length(buf) + {glue_length} + length(part) > 1000 THEN part ELSE buf || {glue} || part END,
  CASE WHEN length(buf) + {glue_length} + length(part) > 1000 THEN seq + 1 ELSE seq END FROM f JOIN s ON s.{key} = f.{key} AND s.pos = f.pos + 1)
SELECT {key}, seq::BIGINT - 1 AS seq, sha256(arg_max(buf, pos)) AS chunk_sha256 FROM f GROUP BY 1, seq"""

_ABBREVIATED = "|".join(a.replace(".", r"\.") for a in chunking.ABBREVIATIONS)
_OPENS = r"[\p{Nd}\p{Lu}\p{Lo}\"''\x{201C}\x{2018}(\[]"
#: Marks stand where a sentence may not end (1) and where it ends (2).
_MARKED = rf"""regexp_replace(regexp_replace(text, '(?i)({_ABBREVIATED})(\s)', '\1' || chr(1) || '\2', 'g'),
  '([.!?][\"''\x{{201D}}\x{{2019}})\]]?)[\s\v]+({_OPENS})', '\1' || chr(2) || '\2', 'g')"""


@query(
    f"""WITH RECURSIVE cut AS (SELECT doc_id, string_split(replace({_MARKED}, chr(1), ''), chr(2)) AS l FROM documents),
u AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM cut),
s AS (SELECT doc_id, {_TRIM.format("p")} AS part, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM u WHERE {_TRIM.format("p")} <> '')"""
    + _PACKED.format(key="doc_id", glue="' '", glue_length=1)
)
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(chunking.sentences(read_table(spark, sf_dir, "documents")), "chunk")


_LINES = f"""u AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
s AS (SELECT doc_id, {_TRIM.format("p")} AS part, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM u WHERE {_TRIM.format("p")} <> '')"""


@query(f"WITH RECURSIVE {_LINES}" + _PACKED.format(key="doc_id", glue="chr(10) || chr(10)", glue_length=2))
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(chunking.paragraphs(read_table(spark, sf_dir, "documents"), separator="\n"), "chunk")


_PLACED = f"""WITH {_LINES},
b AS (SELECT doc_id, pos - 1 AS block, part, (sum(length(part) + 2) OVER (PARTITION BY doc_id ORDER BY pos) - length(part) - 2)::BIGINT AS "start" FROM s),
placed AS (SELECT doc_id, block, "start", ("start" + length(part))::BIGINT AS "end", part FROM b)
"""


@query(_PLACED + 'SELECT doc_id, block, "start", "end", sha256(part) AS text_sha256 FROM placed')
def canonical_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(chunking.line_blocks(read_table(spark, sf_dir, "documents")), "text")


@query(
    _PLACED
    + """SELECT doc_id, block, seq FROM placed JOIN (
  SELECT doc_id, unnest(range(0, last // 900 + 1)) AS seq FROM (SELECT doc_id, max("end") AS last FROM placed GROUP BY 1)) w USING (doc_id)
WHERE "start" < seq * 900 + 1000 AND "end" > seq * 900"""
)
def window_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.blocks_in_windows(chunking.line_blocks(read_table(spark, sf_dir, "documents")))


@query(
    f"""WITH p AS ({html.SQL})
SELECT b.page_id, b.block, coalesce(string_agg(h.text, ' > ' ORDER BY h.level), '') AS path FROM p b LEFT JOIN (
  SELECT x.page_id, x.block, x.level, x.text, min(y.block) AS until FROM p x LEFT JOIN p y ON y.page_id = x.page_id AND y.block > x.block AND y.level BETWEEN 1 AND x.level
  WHERE x.level > 0 GROUP BY 1, 2, 3, 4) h ON h.page_id = b.page_id AND h.block <= b.block AND (h.until IS NULL OR h.until > b.block)
GROUP BY 1, 2"""
)
def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.heading_paths(html.blocks(read_table(spark, sf_dir, "pages")))
    return rows.select("page_id", "block", F.array_join("path", " > ").alias("path"))


@query(
    f"""WITH p AS ({html.SQL})
SELECT page_id, section, max(CASE WHEN level > 0 THEN text END) AS heading, sha256(string_agg(text, chr(10) || chr(10) ORDER BY block) FILTER (level = 0)) AS body_sha256
FROM p WHERE section > 0 GROUP BY 1, 2 HAVING count(*) FILTER (level = 0) > 0"""
)
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(chunking.sections(html.blocks(read_table(spark, sf_dir, "pages"))), "body")


@query(
    f"""WITH RECURSIVE p AS ({html.SQL}),
s AS (SELECT page_id, section, text AS part, row_number() OVER (PARTITION BY page_id ORDER BY block) AS pos FROM p),
f AS (SELECT page_id, section, pos, part AS buf, 0::BIGINT AS seq FROM s WHERE pos = 1
  UNION ALL SELECT s.page_id, s.section, s.pos, CASE WHEN s.section = f.section AND length(buf) + 2 + length(part) <= 1000 THEN buf || chr(10) || chr(10) || part ELSE part END,
  CASE WHEN s.section = f.section AND length(buf) + 2 + length(part) <= 1000 THEN seq ELSE seq + 1 END FROM f JOIN s ON s.page_id = f.page_id AND s.pos = f.pos + 1)
SELECT page_id, seq, max(section) AS section, sha256(arg_max(buf, pos)) AS chunk_sha256 FROM f GROUP BY 1, 2"""
)
def structure_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(chunking.structure(html.blocks(read_table(spark, sf_dir, "pages"))), "chunk")


_LINK = r"""(?is)<a\s[^>]*href="([^"]*)"[^>]*>"""


@query(f"SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS href FROM pages) GROUP BY 1, 2")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("href"))
    return found.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH c AS ({ORACLE_SQL["clean_documents"].replace("sha256(", "(").replace("text_sha256", "cleaned")})
SELECT doc_id, sha256(text) AS before_sha256, sha256(cleaned) AS after_sha256 FROM documents JOIN c USING (doc_id) WHERE text <> cleaned AND {_TRIM.format("cleaned")} <> ''"""
)
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("before"))
    after = cleaning.clean(docs, ("page-numbers", "whitespace", "urls", "emails")).withColumnRenamed("text", "after")
    return digest(after.filter(chunking.before_after(F.col("before"), F.col("after"))).select("doc_id", "before", "after"), "before", "after")


@query(
    f"""WITH c AS ({ORACLE_SQL["clean_documents"].replace("sha256(", "(").replace("text_sha256", "cleaned")})
SELECT doc_id, greatest(0, length(text) - length(cleaned))::BIGINT AS chars_removed, greatest(0, strlen(text) - strlen(cleaned))::BIGINT AS bytes_removed,
  sha256(text) AS input_sha256, sha256(cleaned) AS output_sha256 FROM documents JOIN c USING (doc_id)"""
)
def cleaning_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("before"))
    after = cleaning.clean(docs, ("page-numbers", "whitespace", "urls", "emails"))
    return after.select("doc_id", cleaning.audit(F.col("before"), F.col("text")).alias("a")).select("doc_id", "a.*")


_STRIPPED = _TRIM.format("line")


@query(
    f"""WITH l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
n AS (SELECT doc_id, line, i, {_STRIPPED} AS bare, count(*) OVER (PARTITION BY doc_id, {_STRIPPED}) AS n FROM l)
SELECT doc_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (bare = '' OR length(bare) > 80 OR n < 3), '')) AS text_sha256 FROM n GROUP BY 1"""
)
def headers_and_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(cleaning.drop_repeated_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "text")
