"""Benchmark decontamination by SimHash over item-sized windows.

Windows of a document that have the size of a benchmark item get a 64-bit SimHash of their word
shingles, as items do. Fingerprints are cut into RADIUS + 1 blocks: two that differ in at most
RADIUS bits agree on a block at least. The exact weighted similarity of the shingles then decides.

Blocks of three or four bits select little by themselves, and most windows of a corpus resemble no
item. Anchors select: a window at SIMILARITY_PERCENT has all but a ninth of an item's shingles, so it
has one of any ninth and one more of them. Each item names its rarest ones as anchors, and a window
and an item meet where size, anchor, block and value agree. Every window around an anchor is
fingerprinted, wherever the anchor stands in it, so moved and reordered passages are met like copies.

Three narrow tables lead there: places of anchors in documents, the shingles around them, and
candidates. Texts are never shuffled unless anchors are found in too many documents for a broadcast;
that choice is left to the optimizer, which knows the sizes of the written tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import removed, written
from ._spans import let

WORDS, SIMILARITY_PERCENT = 5, 80
BITS, RADIUS = 64, 19


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column) -> Column:
    """Hashes of all shingles by position; fewer words than a shingle make one; none, none."""
    n = F.size(w)
    return (
        F.when(n >= WORDS, F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)])))
        .when(n > 0, F.array(F.xxhash64(F.array_join(w, " "))))
        .otherwise(F.array().cast("array<long>"))
    )


def _bit(h: Column, b: Column) -> Column:
    return F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.expr("1L")).cast("int")


def _bit_counts(hashes: Column) -> Column:
    """How many of the hashes have each bit."""
    return F.aggregate(hashes, F.array_repeat(F.lit(0), BITS), lambda acc, h: F.transform(acc, lambda v, b: v + _bit(h, b)))


def _fingerprint(counts: Column, size: Column) -> Column:
    """The bits that more than half of `size` hashes have."""
    bits = F.transform(counts, lambda v, b: F.when(2 * v > size, F.call_function("shiftleft", F.expr("1L"), b)).otherwise(F.expr("0L")))
    return F.aggregate(bits, F.expr("0L"), lambda acc, x: acc.bitwiseOR(x))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash: each bit is the sign of the sum over shingles, each as often as it occurs."""
    return let(hashes, lambda h: _fingerprint(_bit_counts(h), F.size(h)))


def window_prints(hashes: Column, size: Column) -> Column:
    """SimHash of each window of `size` hashes, from left to right: counts of bits change by one hash that enters and one that leaves."""

    def of(x: Column) -> Column:
        h, n = x["h"], x["n"]
        first = _bit_counts(F.slice(h, F.lit(1), n))
        start = let(first, lambda c: F.struct(c.alias("counts"), F.array(_fingerprint(c, n)).alias("prints")))

        def slide(state: Column, i: Column) -> Column:
            gone, here = F.get(h, i - 1), F.get(h, i + n - 1)
            moved = let(
                F.struct(gone.alias("gone"), here.alias("here")),
                lambda m: F.transform(state["counts"], lambda v, b: v - _bit(m["gone"], b) + _bit(m["here"], b)),
            )
            return let(moved, lambda c: F.struct(c.alias("counts"), F.concat(state["prints"], F.array(_fingerprint(c, n))).alias("prints")))

        steps = F.when(F.size(h) > n, F.sequence(F.lit(1), F.size(h) - n)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, slide, lambda s: s["prints"])

    return let(F.struct(hashes.alias("h"), size.alias("n")), of)


#: First bit of each of the RADIUS + 1 blocks, and the end.
EDGES = [BITS * k // (RADIUS + 1) for k in range(RADIUS + 2)]


def block_value(fingerprint: Column, block: Column) -> Column:
    """The bits of one block of a fingerprint."""
    edges = F.array(*map(F.lit, EDGES))
    low = F.get(edges, block)
    mask = F.call_function("shiftleft", F.expr("1L"), F.get(edges, block + 1) - low) - F.expr("1L")
    return F.coalesce(F.call_function("shiftrightunsigned", fingerprint, low).bitwiseAND(mask), F.expr("-1L"))


def similarity_ppm(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two shingle lists in millionths: sum of least over sum of greatest multiplicities.

    One walk through both sorted lists, which counts what they share.
    """

    def of(x: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            return let(
                F.struct(F.get(x["a"], state["i"]).alias("p"), F.get(x["b"], state["j"]).alias("q")),
                lambda t: F.struct(
                    (state["i"] + F.when(t["p"] <= t["q"], 1).otherwise(0)).alias("i"),
                    (state["j"] + F.when(t["q"] <= t["p"], 1).otherwise(0)).alias("j"),
                    (state["common"] + F.when(t["p"] == t["q"], 1).otherwise(0)).alias("common"),
                ),
            )

        zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("common"))
        # beyond the end of a list nothing is equal, and the walk stands still
        common = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(x["a"]) + F.size(x["b"]))), zero, step, lambda s: s["common"])
        total = F.size(x["a"]) + F.size(x["b"])
        return let(common, lambda c: F.floor(c * F.lit(1_000_000.0) / F.greatest(F.lit(1), total - c)).cast("long"))

    return let(F.struct(F.array_sort(a).alias("a"), F.array_sort(b).alias("b")), of)


def _measured(text: Column) -> Column:
    """struct(n, s): number of words and shingle hashes."""
    return let(words(text), lambda w: F.struct(F.size(w).alias("n"), shingles(w).alias("s")))


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """item_id, item_no; and item_no, n, item, anchors, f for each distinct item with words."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _measured(F.col("text")).alias("m"))
    rows = rows.select("item_id", "m.n", F.col("m.s").alias("item")).filter("n > 0").distinct()
    rows = written(rows.withColumn("same", F.xxhash64("n", "item")), "items")
    # items with equal shingles are judged once; `same` only deals them, equality decides
    distinct = rows.groupBy("same", "n", "item").agg(F.min("item_id").alias("low")).withColumn("item_no", F.monotonically_increasing_id())
    distinct = written(distinct, "distinct-items")
    members = rows.join(distinct, ["same", "n", "item"]).select("item_id", "item_no")
    each = distinct.select("item_no", "n", F.size("item").alias("size"), F.explode("item").alias("h"))
    often = each.groupBy("n", "h").agg(F.count(F.lit(1)).alias("often"))
    rarest = W.partitionBy("item_no").orderBy("often", "h", "copy")
    # a shingle that an item has several times is several anchors: the window needs as many
    copies = each.groupBy("item_no", "n", "size", "h").agg(F.count(F.lit(1)).alias("k")).select("*", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("copy"))
    ranked = copies.join(often, ["n", "h"]).withColumn("rank", F.row_number().over(rarest))
    # a window at p percent shares at least 2 p s / (100 + p) of an item's s shingles
    needed = F.ceil(F.col("size") * (2 * SIMILARITY_PERCENT) / (100 + SIMILARITY_PERCENT))
    anchors = ranked.filter(F.col("rank") <= F.col("size") - needed + 1).groupBy("item_no").agg(F.collect_set("h").alias("anchors"))
    whole = distinct.select("item_no", "n", "item").join(anchors, "item_no")
    return members, written(whole.withColumn("f", simhash(F.col("item"))), "item-prints")


def _same_row() -> list[Column]:
    """What tells a row's text: its id, and a hash of its text among rows of one id."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")]


def _places(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_hash, hits (at, n, h): where anchors of items of n words stand in a document."""
    wanted = written(items.select("n", F.explode("anchors").alias("h")).distinct(), "anchors")
    rows = docs.select(*_same_row(), _measured(F.col("text"))["s"].alias("s"))
    found = rows.select("doc_id", "text_hash", F.posexplode("s").alias("at", "h")).join(wanted, "h")
    return written(found.distinct().groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("at", "n", "h")).alias("hits")), "places")


def _spots(docs: DataFrame, places: DataFrame) -> DataFrame:
    """spot, doc_id, text_hash, n, h, size, base, near, prints: shingles around each anchor, and the fingerprints of the windows that hold it."""
    places = places.select(F.col("doc_id").alias("own"), F.col("text_hash").alias("own_hash"), "hits")
    rows = docs.select(*_same_row(), "text").join(places, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("text_hash") == F.col("own_hash")))

    def cut(m: Column) -> Column:
        def one(hit: Column) -> Column:
            size = F.greatest(F.lit(1), hit["n"] - (WORDS - 1))
            low = F.greatest(F.lit(0), hit["at"] - size + 1)
            return F.struct(
                hit["n"].alias("n"),
                hit["h"].alias("h"),
                size.alias("size"),
                low.alias("base"),
                F.slice(m["s"], low + 1, F.least(hit["at"] + size, F.size(m["s"])) - low).alias("near"),
            )

        return F.filter(F.transform(F.col("hits"), one), lambda x: F.size(x["near"]) >= x["size"])

    near = rows.select("doc_id", "text_hash", F.explode(let(_measured(F.col("text")), cut)).alias("x")).select("doc_id", "text_hash", "x.*").distinct()
    return written(near.withColumn("prints", window_prints(F.col("near"), F.col("size"))).withColumn("spot", F.monotonically_increasing_id()), "spots")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, similarity_ppm: the best window of each document for each item that it repeats.

    Words are lower-cased runs of letters and digits, shingles have five of them, and a
    window counts at a similarity of 0.8 or more; `start` is a word offset, the first of ties. Null or
    empty texts, and items without words, match nothing. An item of fewer than five words is one shingle
    and matches documents that consist of just these words. Rows with one doc_id are judged together; rows
    with a null id give rows with a null id. Other columns are not read.
    """
    members, items = _items(benchmark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    places = _places(docs, items)
    spots = _spots(docs, places)
    removed(places)
    block = F.explode(F.sequence(F.lit(0), F.lit(RADIUS))).alias("block")
    left = spots.select("spot", "doc_id", "text_hash", "base", "n", "h", F.posexplode("prints").alias("shift", "f")).withColumn("start", F.col("base") + F.col("shift")).select("*", block).withColumn("value", block_value(F.col("f"), F.col("block")))
    right = items.select("item_no", "n", F.col("f").alias("g"), F.explode("anchors").alias("h")).select("*", block).withColumn("value", block_value(F.col("g"), F.col("block")))
    near = left.join(right, ["n", "h", "block", "value"]).withColumn("x", F.col("f").bitwiseXOR(F.col("g"))).filter(F.bit_count("x") <= RADIUS)
    # a pair that agrees on several blocks counts at the first of them only
    earlier = F.exists(F.sequence(F.lit(0), F.lit(RADIUS)), lambda k: (k < F.col("block")) & (block_value(F.col("x"), k) == 0))
    # and one that has several anchors, around one of them
    near = near.filter(~earlier).groupBy("doc_id", "text_hash", "start", "item_no").agg(F.min("spot").alias("spot")).select("spot", "start", "item_no")
    scored = near.join(spots.select("spot", "doc_id", "size", "base", "near"), "spot").join(items.select("item_no", "item"), "item_no")
    window = F.slice("near", F.col("start") - F.col("base") + 1, F.col("size")).alias("window")
    scored = scored.select("doc_id", "item_no", "start", "item", window)
    scored = scored.withColumn("similarity_ppm", similarity_ppm(F.col("window"), F.col("item")))
    good = scored.filter(F.col("similarity_ppm") >= SIMILARITY_PERCENT * 10_000)
    best = good.groupBy("doc_id", "item_no").agg(F.max(F.struct("similarity_ppm", (-F.col("start")).alias("start"))).alias("best"))
    return best.join(members, "item_no").select("doc_id", "item_id", (-F.col("best.start")).alias("start"), F.col("best.similarity_ppm").alias("similarity_ppm"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without those whose doc_id has a leak, with all columns; null ids are compared as equal."""
    leaked = find_leaks(docs, benchmark).select(F.col("doc_id").alias("__leaked")).distinct()
    return docs.join(leaked, docs["doc_id"].cast("long").eqNullSafe(leaked["__leaked"]), "left_anti")
