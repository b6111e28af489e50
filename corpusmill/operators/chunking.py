"""Segmentation of texts into passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let, prefix_sums


def fixed_windows(docs: DataFrame, size: int = 1000, overlap: int = 100, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, seq, start, chunk: windows of `size` characters; the last is the first to reach the end. Columns of `keep` follow.

    A null or empty text has no window. The text is cut once into pieces of a step, of which windows are made, so cost is
    linear in the text.
    """
    step = max(1, size - overlap)
    n = F.length(text_col)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
    pieces = F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    span = -(-size // step)
    windows = let(
        F.struct(pieces.alias("p"), last.alias("last")),
        lambda x: F.transform(F.sequence(F.lit(0), x["last"]), lambda k: F.substring(F.array_join(F.slice(x["p"], k + 1, F.lit(span)), ""), 1, size)),
    )
    rows = docs.filter(n > 0).select("doc_id", *keep, F.posexplode(windows).alias("seq", "chunk"))
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), (F.col("seq") * step).cast("long").alias("start"), "chunk", *keep)


def _pack(blocks: Column, longest: int, glue: str = "\n\n") -> Column:
    """Greedy packing: a block joins the group unless the group would grow over `longest`; a long block stays whole."""

    def add(acc: Column, block: Column) -> Column:
        grown = F.concat(acc["open"], F.lit(glue), block)
        fits = (acc["open"] == "") | (F.length(grown) <= longest)
        return F.when(
            fits, F.struct(acc["done"].alias("done"), F.when(acc["open"] == "", block).otherwise(grown).alias("open"))
        ).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), block.alias("open")))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    return F.aggregate(blocks, start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def paragraphs(docs: DataFrame, longest: int = 1000, separator: str = r"(?U)\n\s*\n", text_col: str = "text") -> DataFrame:
    """doc_id, seq, chunk: paragraphs packed greedily in order, joined by an empty line."""
    blocks = F.filter(F.transform(F.split(text_col, separator), lambda b: F.trim(b)), lambda b: b != "")
    return docs.select("doc_id", F.posexplode(_pack(blocks, longest)).alias("seq", "chunk")).withColumn("seq", F.col("seq").cast("long"))


def continuation(docs: DataFrame, split_ppm: int = 500_000, text_col: str = "text") -> DataFrame:
    """doc_id, prompt, completion: each text of two characters or more is cut at the given share of its length."""
    n = F.length(text_col)
    cut = F.greatest(F.lit(1), F.least(n - 1, F.floor(n.cast("long") * split_ppm / 1_000_000).cast("int")))
    return docs.filter(n >= 2).select("doc_id", F.substring(text_col, F.lit(1), cut).alias("prompt"), F.substring(text_col, cut + 1, n).alias("completion"))


# Abbreviations that do not end a sentence.
ABBREVIATIONS = ("mr.", "mrs.", "ms.", "dr.", "prof.", "st.", "vs.", "etc.", "e.g.", "i.e.", "p.m.", "a.m.", "u.s.", "u.k.", "no.", "fig.", "approx.", "dept.", "est.")
_NOT_ABBREVIATED = "(?<!(?iu:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + "))"
#: A digit, an opening quote or bracket, a capital, or a letter of a script without case begins a sentence.
_OPENER = r"""(?=[\p{Nd}\p{Lu}\p{Lo}"'\x{201C}\x{2018}(\[])"""
SENTENCE_END = (
    rf"""(?U)(?:(?<=[.!?])|(?<=[.!?]["'\x{{201D}}\x{{2019}})\]])){_NOT_ABBREVIATED}\s+{_OPENER}"""
    rf"|(?<=[\x{{3002}}\x{{FF01}}\x{{FF1F}}])\s*{_OPENER}"
)
_EDGES = r"(?U)^\s+|\s+$"


def sentences(docs: DataFrame, longest: int = 1000, text_col: str = "text") -> DataFrame:
    """doc_id, seq, chunk: sentences packed greedily in order, joined by a blank; null and blank texts have none."""
    found = F.filter(F.transform(F.split(text_col, SENTENCE_END), lambda s: F.regexp_replace(s, _EDGES, "")), lambda s: s != "")
    return docs.select("doc_id", F.posexplode(_pack(found, longest, " ")).alias("seq", "chunk")).withColumn("seq", F.col("seq").cast("long"))


def line_blocks(docs: DataFrame, separator: str = "\n", text_col: str = "text") -> DataFrame:
    """doc_id, block, start, end, text: non-blank parts of a text and their places in the stream that joins them by an empty line.

    Places are running sums inside the row, so nothing is shuffled.
    """
    parts = F.filter(F.transform(F.split(text_col, separator), lambda b: F.regexp_replace(b, _EDGES, "")), lambda b: b != "")
    placed = let(parts, lambda p: F.struct(p.alias("parts"), F.transform(prefix_sums(F.transform(p, lambda b: F.length(b) + 2)), lambda e: (e - 2).cast("long")).alias("ends")))
    rows = docs.select("doc_id", placed.alias("x")).select("doc_id", "x.parts", "x.ends")
    rows = rows.select("doc_id", F.posexplode(F.arrays_zip("parts", "ends")).alias("block", "z"))
    return rows.select("doc_id", F.col("block").cast("long").alias("block"), (F.col("z.ends") - F.length("z.parts")).alias("start"), F.col("z.ends").alias("end"), F.col("z.parts").alias("text"))


def blocks_in_windows(blocks: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """doc_id, block, seq: the windows that a block touches, worked out from its place; no join."""
    step = max(1, size - overlap)
    first = F.greatest(F.lit(0), F.floor((F.col("start") - size) / step) + 1).cast("long")
    last = (F.ceil(F.col("end") / step) - 1).cast("long")
    ends = blocks.filter(F.col("end") > F.col("start")).select("doc_id", "block", F.explode(F.sequence(first, F.greatest(first, last))).alias("seq"))
    return ends


def heading_paths(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """`blocks` (key, block, level, text) with `path`: the headings in effect, outermost first, a heading's own included.

    A heading of a level counts until one of the same or a higher level comes. Rows of one page meet in one window;
    a page's blocks are bounded by its size.
    """
    so_far = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("level") == k, F.struct("block", "text")), ignorenulls=True).over(so_far).alias(f"h{k}") for k in range(1, 7)]
    rows = blocks.select("*", *last)
    valid = []
    for k in range(1, 7):
        above = [F.coalesce(F.col(f"h{j}.block"), F.lit(-1)) for j in range(1, k)]
        alive = F.col(f"h{k}.block") > (F.greatest(*above) if len(above) > 1 else above[0]) if above else F.col(f"h{k}").isNotNull()
        valid.append(F.when(alive, F.col(f"h{k}.text")))
    return rows.select(*blocks.columns, F.array_compact(F.array(*valid)).alias("path"))


def sections(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """key, section, heading, body: a heading and the texts up to the next one, joined by an empty line; empty bodies are left out.

    Texts before the first heading belong to no section.
    """
    inside = blocks.filter("section > 0").groupBy(key, "section").agg(
        F.max(F.when(F.col("level") > 0, F.col("text"))).alias("heading"),
        F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("block", "text")))).alias("b"),
    )
    return inside.filter(F.size("b") > 0).select(key, "section", "heading", F.array_join("b.text", "\n\n").alias("body"))


def structure(blocks: DataFrame, longest: int = 1000, key: str = "page_id") -> DataFrame:
    """key, seq, section, chunk: blocks packed greedily inside each section, numbered through the page."""
    packed = blocks.groupBy(key, "section").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("b"))
    packed = packed.select(key, "section", F.posexplode(_pack(F.col("b.text"), longest, "\n\n")).alias("at", "chunk"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("section", "at")) - 1
    return packed.select(key, number.cast("long").alias("seq"), "section", "chunk")


def before_after(raw: Column, cleaned: Column) -> Column:
    """Whether a pair of texts teaches a change: they differ and the cleaned one is not blank."""
    return (raw != cleaned) & (F.regexp_replace(cleaned, _EDGES, "") != "")
