"""MinHash near-duplicates with odd sketches.

One pass over the texts gives each document the MinHash samples of its word shingles, the
keys of its bands, and an odd sketch: a bitmap in which each sample flips one bit. The bits in
which two sketches differ count the samples in which they differ, so a pair that shares a
band is weighed without its texts. What passes is confirmed on the full sets.

Links are only needed as far as they connect something new:

1. copies (equal sets) become one class with a representative;
2. in each band bucket all members meet one member drawn at random (a star: as many pairs
   as members), confirmed links are merged into components, and that is done again with the
   members outside the bucket's largest component;
3. all pairs of a bucket that still lie in different components and whose sketches are close
   enough are confirmed, so no link between components is missed; the members of a large bucket are
   dealt into a grid of cells, so that its pairs are shared out among tasks.

Classes have numbers of their own, as one doc_id may have rows with different texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._batches import id_and_text, map_texts, steps
from ._shared import partitions, removed, written

WORDS = 5
#: Rows of a band, and bands. A pair at 85 % shares a band but for one case in a million.
ROWS, BANDS = 7, 36
SAMPLES = ROWS * BANDS
#: Ranges that give a sample each to the sketch, and bits of the sketch.
SKETCH_BINS, SKETCH_BITS = 1024, 1024
#: Standard deviations that a pair's sketch may fall short of the wanted similarity.
SLACK = 5.0
HASH_ENTRIES = 150_000
#: Star turns before the remaining pairs are taken up one by one.
TURNS = 2
#: Members of a bucket that meet in one cell, and bytes of sets that one task of the confirmation holds.
CELL, PART_BYTES = 4096, 32 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_P = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Word -> 64-bit hash, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > HASH_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(1)
def _words() -> _WordHashes:
    return _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `n` words; fewer words are one shingle; no words, none."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    n = min(n, len(hashes))
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mixed(out * _P + hashes[k : len(hashes) - n + 1 + k])
    return np.unique(out)


@lru_cache(1)
def _factors() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """SAMPLES MinHash values of a set."""
    best = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 2048):
        best = np.minimum(best, np.multiply.outer(_factors(), hashes[a : a + 2048]).min(1))
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; bands never share keys on purpose."""
    rows = samples.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mixed(key * _P + rows[:, k])
    return key.view(np.int64)


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """Bitmap of SKETCH_BITS as 64-bit integers: each one-permutation MinHash sample flips a bit.

    The samples are the least hashes of SKETCH_BINS equal ranges, so a set smaller than that is
    sampled almost whole, and a larger one by one value for each range.
    """
    ranges = hashes >> np.uint64(64 - SKETCH_BINS.bit_length() + 1)
    samples = hashes[np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]]))]
    at = _mixed(samples * _P) % np.uint64(SKETCH_BITS)
    bits = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def most_differing_bits(a: Column, b: Column, percent: int) -> Column:
    """Bits in which the sketches of two sets of sizes a and b at `percent` similarity differ at most.

    Of the union's `u` values, `m` are samples; a sample outside the intersection flips one bit, and
    another one if the other set has a value in that range. Their number is hypergeometric; SLACK
    standard deviations are added to the mean. Flips that meet cancel out.
    """
    t = percent / 100
    u = (a + b) / (1 + t)
    empty = F.exp(-u / SKETCH_BINS)
    m = SKETCH_BINS * (1 - empty)
    mean = (1 - t) * m * (2 - empty)
    spread = m * t * (1 - t) * F.greatest(F.lit(0.0), (u - m) / F.greatest(u - 1, F.lit(1.0)))
    variance = spread * (2 - empty) ** 2 + (1 - t) * m * empty * (1 - empty) + mean * mean / SKETCH_BITS
    flips = mean + SLACK * F.sqrt(variance) + 2
    return SKETCH_BITS / 2 * (1 - F.exp(-2 * flips / SKETCH_BITS)) + 1


_SIGNATURES = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("text_hash", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))]
)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, fp (digest of the set, null if empty), text_hash (xxhash64 of the text), bands, sketch for each row."""
    from hashlib import blake2b

    def work(ids: list, texts: list) -> dict:
        import xxhash

        out = {"doc_id": ids, "n_shingles": [], "fp": [], "text_hash": [], "bands": [], "sketch": []}
        for t in texts:
            s = shingle_set(t, n)
            out["n_shingles"].append(len(s))
            out["text_hash"].append(int(np.uint64(xxhash.xxh64_intdigest((t or "").encode(), seed=42)).view(np.int64)))
            if len(s):
                samples = min_hashes(s)
                out["fp"].append(blake2b(s.tobytes(), digest_size=16).digest())
                out["bands"].append(band_keys(samples))
                out["sketch"].append(odd_sketch(s))
            else:
                for k in ("fp", "bands", "sketch"):
                    out[k].append(None)
        return out

    return map_texts(id_and_text(docs, id_col, text_col), work, _SIGNATURES, "doc_id long, n_shingles long, fp binary, text_hash long, bands array<long>, sketch array<long>")


def _close(a: str, b: str, percent: int) -> Column:
    """Whether sizes and sketches of two sides allow the similarity."""
    sizes = (100 * F.least(f"{a}n", f"{b}n") >= percent * F.greatest(f"{a}n", f"{b}n"))
    bits = sum((F.bit_count(F.get(f"{a}sketch", F.lit(k)).bitwiseXOR(F.get(f"{b}sketch", F.lit(k)))) for k in range(1, SKETCH_BITS // 64)), F.bit_count(F.get(f"{a}sketch", F.lit(0)).bitwiseXOR(F.get(f"{b}sketch", F.lit(0)))))
    return sizes & (bits <= most_differing_bits(F.col(f"{a}n"), F.col(f"{b}n"), percent))


def _sets(docs: DataFrame, wanted: DataFrame, parts: int, n: int) -> DataFrame:
    """node, part, hashes (raw 64-bit integers): full sets of the wanted classes (node, rep, text_hash), from the text of one row of each."""
    wanted = wanted.withColumnRenamed("text_hash", "own_hash")
    texts = id_and_text(docs).join(wanted, (F.col("doc_id") == F.col("rep")) & (F.xxhash64("text") == F.col("own_hash"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, rows in steps(batches):
            yield pa.RecordBatch.from_pydict({"node": nodes, "hashes": [shingle_set(t, n).tobytes() for t in rows]}, schema=pa.schema([("node", pa.int64()), ("hashes", pa.binary())]))

    got = texts.mapInArrow(run, "node long, hashes binary")
    return got.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int"))


def confirm(pairs: DataFrame, sets: DataFrame, parts: int, percent: int) -> DataFrame:
    """u, v of the pairs (hub, other) whose full sets reach the similarity.

    A hub's set travels once to each part of the others' sets, not once for each pair.
    """
    asked = pairs.withColumn("part", F.pmod(F.xxhash64("other"), F.lit(parts)).cast("int"))
    # no list is longer than its part has sets, whose bytes are bounded
    asked = asked.groupBy("hub", "part").agg(F.collect_set("other").alias("others"))
    asked = asked.join(sets.select(F.col("node").alias("hub"), F.col("hashes").alias("hub_set")), "hub").select("part", "hub", "others", "hub_set")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = {i: np.frombuffer(h, np.uint64) for i, h in zip(left["node"].to_pylist(), left["hashes"].to_pylist())}
        u, v = [], []
        for k in range(right.num_rows):
            hub, hashes = right["hub"][k].as_py(), np.frombuffer(right["hub_set"][k].as_py(), np.uint64)
            for other in right["others"][k].as_py():
                s = own[other]
                both = np.concatenate([s, hashes])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    u.append(min(hub, other))
                    v.append(max(hub, other))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return sets.select("part", "node", "hashes").groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(run, "u long, v long").distinct()


def _twins(sig: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (u, v) between the classes of rows that share a doc_id."""
    own = sig.filter("fp is not null and doc_id is not null").select("doc_id", "fp", F.xxhash64("fp").alias("h"))
    several = own.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low < high").select("doc_id")
    ends = own.join(several, "doc_id").join(reps.select("fp", "node"), "fp").select("doc_id", "node").distinct()
    least = ends.groupBy("doc_id").agg(F.min("node").alias("u"))
    return ends.join(least, "doc_id").filter("u < node").select("u", F.col("node").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) for all nodes with an edge (u, v): alternating large and small stars until nothing changes."""
    edges = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct(), "edges")
    mark = None
    while True:
        # large star: neighbours above a node go to its smallest neighbour
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        # small star: neighbours below a node, and the node, go to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("m").alias("a"), F.col("u").alias("b"), "v")
        pairs = small.select("a", F.explode(F.array("b", "v")).alias("b")).filter("a < b")
        last, edges = edges, written(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
        removed(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("comp")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("comp")).distinct())


def near_duplicates(docs: DataFrame, percent: int = 85, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of `docs`.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; a component's id is
    its smallest doc_id, and that document is kept. Null, empty or blank texts have no shingles and
    link with nothing: they keep their own doc_id. Rows with one doc_id count as one document: those with words share
    the component of their linked rows and stay or go together. Rows with a null id link with nothing, have a null
    component and are kept. An empty table gives an empty table; other columns are not read.
    """
    docs = id_and_text(docs, id_col, text_col)
    sig = written(signatures(docs, n=n), "signatures")
    classes = sig.filter("fp is not null and doc_id is not null").groupBy("fp")
    first = F.min(F.struct("doc_id", "text_hash")).alias("row")
    reps = classes.agg(first, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = written(reps.select("fp", "row.doc_id", "row.text_hash", "n", "bands", "sketch").withColumnRenamed("doc_id", "rep").withColumn("node", F.monotonically_increasing_id()), "representatives")
    parts = max(2 * partitions(docs.sparkSession), 8 * (reps.agg(F.sum("n")).first()[0] or 0) // PART_BYTES)
    # members of buckets with more than one class
    keyed = reps.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    members = written(keyed.join(shared, "key"), "members")
    light = reps.select("node", "n", "sketch")
    sets = written(_sets(docs, reps.select("node", "rep", "text_hash").join(members.select("node").distinct(), "node"), parts, n), "sets")

    links = written(_twins(sig, reps), "links")
    comp = None if links.isEmpty() else written(components(links), "components")
    asked = None
    for turn in range(TURNS):
        tagged = members.withColumn("comp", F.col("node"))
        if comp is not None:
            tagged = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        # the hub of a bucket: a member drawn by a hash, from the largest component
        draw = F.struct(F.xxhash64(F.lit(turn), "key", "node").alias("h"), F.col("node").alias("node"))
        groups = tagged.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"), F.min(draw).alias("hub"))
        hubs = groups.groupBy("key").agg(F.max(F.struct("size", (-F.col("comp")).alias("c"), "hub")).alias("top"), F.count(F.lit(1)).alias("comps"))
        hubs = hubs.filter("comps > 1").select("key", F.col("top.hub.node").alias("hub"), (-F.col("top.c")).alias("hub_comp"))
        star = tagged.join(hubs, "key").filter("comp <> hub_comp").select("hub", F.col("node").alias("other")).distinct()
        star = star.join(light.select(*[F.col(c).alias("a_" + c) for c in light.columns]), F.col("hub") == F.col("a_node"))
        star = star.join(light.select(*[F.col(c).alias("b_" + c) for c in light.columns]), F.col("other") == F.col("b_node"))
        star = written(star.filter(_close("a_", "b_", percent)).select("hub", "other"), "star")
        asked = star if asked is None else asked.union(star)
        new = confirm(star, sets, parts, percent)
        links = written(new.union(links) if comp is None else _contracted(new, comp).union(links), "links")
        comp = written(components(links), "components")

    # what still lies in different components of one bucket
    heavy = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    groups = heavy.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
    mixed = groups.groupBy("key").agg(F.max(F.struct("size", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"), F.sum("size").alias("size")).filter("comps > 1")
    mixed = mixed.select("key", F.col("top.comp").alias("main"), F.ceil(F.col("size") / CELL).cast("int").alias("cells"))
    heavy = written(heavy.join(mixed, "key").join(reps.select("node", "n", "sketch", "bands"), "node"), "mixed")
    cell, all_cells = F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    fields = ("node", "comp", "n", "sketch", "bands")
    odd = heavy.filter("comp <> main").select("key", cell.alias("row"), all_cells.alias("column"), *[F.col(c).alias("a_" + c) for c in fields])
    rest = heavy.select("key", all_cells.alias("row"), cell.alias("column"), "main", *[F.col(c).alias("b_" + c) for c in fields])
    # a pair counts in the first bucket that it shares
    same = F.transform(F.arrays_zip(F.col("a_bands").alias("x"), F.col("b_bands").alias("y")), lambda z: F.when(z["x"] == z["y"], z["x"]))
    first = F.get(F.filter(same, lambda k: k.isNotNull()), F.lit(0))
    apart = (F.col("a_comp") != F.col("b_comp")) & ((F.col("b_comp") == F.col("main")) | (F.col("a_node") < F.col("b_node")))
    met = (F.col("o.key") == F.col("r.key")) & (F.col("o.row") == F.col("r.row")) & (F.col("o.column") == F.col("r.column"))
    pairs = odd.alias("o").join(rest.alias("r"), met & apart & _close("a_", "b_", percent) & (first == F.col("o.key")))
    pairs = pairs.select(F.col("a_node").alias("hub"), F.col("b_node").alias("other")).distinct()
    tried = asked.select(F.least("hub", "other").alias("x"), F.greatest("hub", "other").alias("y"))
    pairs = pairs.join(tried, (F.least("hub", "other") == F.col("x")) & (F.greatest("hub", "other") == F.col("y")), "left_anti")
    links = _contracted(confirm(written(pairs, "pairs"), sets, parts, percent), comp).union(links)
    comp = written(components(links), "components")
    for done in (members, sets, heavy):  # the result only reads signatures, representatives and components
        removed(done)

    # a component is named by its smallest doc_id
    found = reps.select("fp", "rep", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = found.groupBy("comp").agg(F.min("rep").alias("component"))
    found = found.join(names, "comp").select("fp", "component")
    rows = sig.select("doc_id", "n_shingles", "fp").join(found, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    rows = rows.select("doc_id", "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _contracted(links: DataFrame, comp: DataFrame) -> DataFrame:
    """Links between components instead of nodes."""
    for end in ("u", "v"):
        links = links.join(comp.select(F.col("node").alias(end), F.col("comp").alias("c")), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    return links.select("u", "v").filter("u <> v")


def drop_near_duplicates(docs: DataFrame, percent: int = 80, n: int = WORDS) -> DataFrame:
    """The rows of `docs`, with all their columns, without documents that are not the first of their component."""
    gone = near_duplicates(docs, percent, n).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == gone["__gone"], "left_anti")
