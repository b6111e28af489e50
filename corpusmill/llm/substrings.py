"""Substring dedup by super-k-mers.

A window is K consecutive words. Its minimiser is the least-hashed M-word piece in it;
consecutive windows that share one form a super-k-mer. Equal windows have equal
minimisers, so when each super-k-mer travels as one packed string to the bucket of its
minimiser, all copies of a window meet there, and sorting the windows of a bucket tells
exactly in which document each starts first.

Documents are dealt into parts of bounded size, and everything travels at most once for each
part, however often it occurs in it: a passage that stands in a third of all documents costs a
row for each part, not for each document.

1. Each part tells each bucket its distinct minimisers and about how often it has them; a minimiser that
   comes only once has no copies, so its super-k-mers need not travel. One that comes very often is
   split: its windows are dealt by a second minimiser of longer pieces as well.
2. Each part sends its distinct super-k-mers with shared minimisers, and the smallest doc_id of each.
3. Each bucket sorts their windows and sends back the super-k-mers of each part that have windows which start in
   a smaller document; the part finds them by their words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import id_and_text, steps
from ._shared import partitions

WINDOW, PIECE = 13, 5
#: Words of the pieces that split a frequent minimiser, and super-k-mers from which on it is split.
LONG_PIECE, SPLIT = 9, 50_000
#: Bytes of text in a part, and of texts whose super-k-mers go to one bucket.
PART_BYTES, BUCKET_BYTES = 16 << 20, 32 << 20
_BASE = 0x9E3779B97F4A7C15
#: Stands for a null id: it is larger than any other.
_LAST = np.iinfo(np.int64).max


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _word_hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    """Hashes of n words that are the same in every process."""
    return _mixed(np.fromiter(map(zlib.crc32, words), np.uint64, n) + np.uint64(1))


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, doubled up from shorter runs."""
    if len(hashes) < n:
        return hashes[:0]
    out, done, have, width = None, 0, hashes, 1
    while True:
        power = np.uint64(pow(_BASE, width, 1 << 64))
        if n & width:
            out = have if out is None else out[: len(hashes) - done - width + 1] * power + have[done : len(hashes) - width + 1]
            done += width
        if done == n:
            return _mixed(out[: len(hashes) - n + 1])
        have = have[:-width] * power + have[width:]
        width *= 2


def _flat(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts, and where each text begins (with an end)."""
    each = [(t or "").encode().split() for t in texts]
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))])
    return list(chain.from_iterable(each)), at


def _sliding_min(values: np.ndarray, want: int) -> np.ndarray:
    """Least of each `want` consecutive values, by doubling."""
    width = 1
    while width < want:
        step = min(width, want - width)
        values = np.minimum(values[:-step], values[step:])
        width += step
    return values


def super_kmers(hashes: np.ndarray, at: np.ndarray, k: int = WINDOW, m: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, window after the last, text and minimiser of each super-k-mer of all texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    least = _sliding_min(_runs(hashes, m), k - m + 1)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    whole = np.arange(n) + k <= at[text + 1]  # windows that end in the text they start in
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    stop = np.concatenate([np.flatnonzero((new | ~whole)[1:]) + 1, [n]])
    return first, stop[np.searchsorted(stop, first, "right")], text[first], least[first]


def _keys(minimisers: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper and minimiser in the lower 32 bits."""
    return (minimisers % np.uint64(buckets)) << np.uint64(32) | minimisers >> np.uint64(32)


def _keyed(hashes: np.ndarray, at: np.ndarray, hot: np.ndarray, k: int, m: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, window after the last, text, key and first key of each super-k-mer; those with a hot key are cut by the long pieces."""
    first, stop, text, mini = super_kmers(hashes, at, k, m)
    keys = _keys(mini, buckets)
    is_hot = np.isin(keys, hot)
    if not is_hot.any():
        return first, stop, text, keys, keys
    long = min(LONG_PIECE, k)
    least = _sliding_min(_runs(hashes, long), k - long + 1)
    sizes = (stop - first)[is_hot]
    of = np.repeat(np.flatnonzero(is_hot), sizes)
    window = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[of]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (least[window[1:]] != least[window[:-1]])
    begin = np.flatnonzero(new)
    last = np.concatenate([begin[1:], [len(of)]]) - 1
    own = of[begin]
    split = _keys(_mixed(mini[own] * np.uint64(_BASE) ^ least[window[begin]]), buckets)
    rest = np.flatnonzero(~is_hot)
    return (
        np.concatenate([first[rest], window[begin]]),
        np.concatenate([stop[rest], window[last] + 1]),
        np.concatenate([text[rest], text[own]]),
        np.concatenate([keys[rest], split]),
        np.concatenate([keys[rest], keys[own]]),
    )


def _press(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(3).compress(data)


def _unpress(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


_FACTS = np.dtype([("id", "<i8"), ("mini", "<u4"), ("more", "?")])
#: Windows of a string in an answer, from `first` up to `stop`, and the smallest doc_id that has them.
_RUN = np.dtype([("string", "<u4"), ("first", "<u4"), ("stop", "<u4"), ("low", "<i8")])


def _blocks(docs: pa.Table) -> Iterator[tuple[list[int], list[str | None]]]:
    """Ids and texts of a part in blocks of bounded size; null ids become the largest id."""
    for ids, texts in steps(docs.select(["doc_id", "text"]).to_batches()):
        yield [_LAST if i is None else i for i in ids], texts


def _part_minimisers(docs: pa.Table, k: int, m: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a part, and the rounded-up binary logarithm of how often it has each."""
    found = [np.empty(0, np.uint64)]
    for _, texts in _blocks(docs):
        words, at = _flat(texts)
        found.append(_keys(super_kmers(_word_hashes(words, len(words)), at, k, m)[3], buckets))
    keys, count = np.unique(np.concatenate(found), return_counts=True)
    return keys, np.ceil(np.log2(count)).astype(np.uint8)


class _Sent:
    """The distinct super-k-mers that a part sends to one bucket."""

    def __init__(self) -> None:
        self.strings: dict[bytes, tuple[int, int, bool]] = {}  # packed -> smallest doc_id of the part, minimiser, whether other documents have it
        self.hot: set[int] = set()  # first keys that were split


def _part_strings(docs: pa.Table, shared: np.ndarray, hot: np.ndarray, k: int, m: int, buckets: int) -> dict[int, _Sent]:
    """What a part sends to each bucket."""
    out: dict[int, _Sent] = {}
    for ids, texts in _blocks(docs):
        words, at = _flat(texts)
        first, stop, text, keys, before = _keyed(_word_hashes(words, len(words)), at, hot, k, m, buckets)
        use = np.flatnonzero(np.isin(before, shared))
        for s, e, t, key, old in zip(first[use].tolist(), stop[use].tolist(), text[use].tolist(), keys[use].tolist(), before[use].tolist()):
            own, packed = ids[t], b" ".join(words[s : e + k - 1])
            sent = out.get(key >> 32)
            if sent is None:
                sent = out[key >> 32] = _Sent()
            if key != old:
                sent.hot.add(old)
            found = sent.strings.get(packed)
            if found is None:
                sent.strings[packed] = own, key & 0xFFFFFFFF, False
            elif own != found[0]:
                sent.strings[packed] = min(own, found[0]), key & 0xFFFFFFFF, True
    return out


def _bucket_minima(parts: list[int], strings: list[list[bytes]], facts: list[np.ndarray], k: int) -> dict[int, tuple[list[bytes], np.ndarray, np.ndarray]]:
    """part -> its super-k-mers with windows that it has in a document after the first one, their minimisers, and those windows as _RUN rows.

    The windows of super-k-mers whose minimiser comes more than once are sorted by hash; equal
    neighbours are compared word by word.
    """
    if not strings:
        return {}
    every = np.concatenate(facts)
    owners = np.repeat(parts, [len(g) for g in strings])
    flat = [s for group in strings for s in group]
    _, back, count = np.unique(every["mini"], return_inverse=True, return_counts=True)
    keep = np.flatnonzero((count[back] > 1) | every["more"])
    if not len(keep):
        return {}
    each = [flat[r].split(b" ") for r in keep.tolist()]
    owner, least, more = owners[keep], every["id"][keep], every["more"][keep]
    words = list(chain.from_iterable(each))
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    where = np.repeat(np.arange(len(each)), sizes)[: len(words) - k + 1]
    whole = np.flatnonzero(np.arange(len(where)) + k <= np.cumsum(sizes)[where])
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(code.__getitem__, words), np.int32, len(words))
    hashes = _runs(_word_hashes(code, len(code))[codes], k)
    order = whole[np.argsort(hashes[whole], kind="stable")]
    same = hashes[order[1:]] == hashes[order[:-1]]
    twins = np.flatnonzero(same)
    for j in range(k):
        twins = twins[codes[order[twins] + j] == codes[order[twins + 1] + j]]
    if len(twins) < same.sum():  # different windows under one hash: their order by words decides
        order = order[np.lexsort([*(codes[order + j] for j in reversed(range(k))), hashes[order]])]
        same = np.all([codes[order[1:] + j] == codes[order[:-1] + j] for j in range(k)], 0)
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    group = np.cumsum(np.concatenate([[True], ~same])) - 1
    rows = where[order]
    low = np.minimum.reduceat(least[rows], first)[group]
    lows, late = np.zeros(len(where), np.int64), np.zeros(len(where), bool)
    lows[order], late[order] = low, (least[rows] > low) | more[rows]  # a part that only has the first document needs no answer
    at = np.flatnonzero(late)
    if not len(at):
        return {}
    string = where[at]
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (string[1:] != string[:-1]) | (lows[at[1:]] != lows[at[:-1]])])
    begin = np.flatnonzero(new)
    last = np.concatenate([begin[1:], [len(at)]]) - 1
    string = string[begin]
    word = (np.cumsum(sizes) - sizes)[string]  # of the string's first window
    runs = np.zeros(len(begin), _RUN)
    runs["first"], runs["stop"], runs["low"] = at[begin] - word, at[last] + 1 - word, lows[at[begin]]
    to = owner[string]
    edges = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
    out = {}
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        ids, number = np.unique(string[a:b], return_inverse=True)
        runs["string"][a:b] = number
        out[int(to[a])] = [flat[r] for r in keep[ids].tolist()], every["mini"][keep[ids]], runs[a:b]
    return out


def mark_repeats(docs: DataFrame, k: int = WINDOW, m: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (binary): each word under a window that also starts in a smaller doc_id goes.

    Words are runs of anything but ASCII white space; windows are judged on the input. A null or
    empty text has no words. Rows with one doc_id don't remove each other's words; a null id counts as
    larger than all others, and null ids don't remove each other's. Texts shorter than a window stay.
    One row out for each row in; other columns are not read.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts, buckets = max(4 * partitions(spark), size // PART_BYTES), max(partitions(spark), size // BUCKET_BYTES)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_parts)).cast("int"))
    split = SPLIT

    def tell(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        keys, often = _part_minimisers(table, k, m, buckets)
        edges = np.searchsorted(keys >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        full = [b for b in range(buckets) if edges[b + 1] > edges[b]]
        low = keys.astype(np.uint32)
        return pa.table(
            {
                "part": pa.array([part] * len(full), pa.int32()),
                "bucket": pa.array(full, pa.int32()),
                "minis": pa.array([low[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()),
                "often": pa.array([_press(often[edges[b] : edges[b + 1]].tobytes()) for b in full], pa.binary()),
            }
        )

    def share(table: pa.Table) -> pa.Table:
        bucket = np.uint64(table["bucket"][0].as_py() << 32)
        minis = [np.frombuffer(x.as_py(), np.uint32) for x in table["minis"]]
        often = [np.frombuffer(_unpress(x.as_py()), np.uint8) for x in table["often"]]
        distinct, back, count = np.unique(np.concatenate(minis), return_inverse=True, return_counts=True)
        shared = distinct[count > 1]
        hot = distinct[(count > 1) & (np.bincount(back, np.exp2(np.concatenate(often))) > split)]
        own = [y[np.isin(y, shared) | (z > 0)] for y, z in zip(minis, often)]
        full = [j for j, y in enumerate(own) if len(y)]
        raw = lambda y: (y.astype(np.uint64) | bucket).tobytes()
        return pa.table(
            {
                "part": table["part"].take(pa.array(full, pa.int64())).cast(pa.int32()),
                "keys": pa.array([raw(own[j]) for j in full], pa.binary()),
                "hot": pa.array([raw(own[j][np.isin(own[j], hot)]) for j in full], pa.binary()),
            }
        )

    def numbers(column: pa.ChunkedArray, kind: type) -> np.ndarray:
        return np.concatenate([np.empty(0, kind), *[np.frombuffer(x.as_py(), kind) for x in column]])

    def send(docs_: pa.Table, shares: pa.Table) -> pa.Table:
        shared = numbers(shares["keys"], np.uint64)
        found = _part_strings(docs_, shared, numbers(shares["hot"], np.uint64), k, m, buckets) if len(shared) else {}
        part = docs_["part"][0].as_py() if docs_.num_rows else None
        return pa.table(
            {
                "part": pa.array([part] * len(found), pa.int32()),
                "bucket": pa.array(list(found), pa.int32()),
                "packed": pa.array([_press(b"\n".join(r.strings)) for r in found.values()], pa.binary()),
                "facts": pa.array([_press(np.array(list(r.strings.values()), _FACTS).tobytes()) for r in found.values()], pa.binary()),
                "hot": pa.array([np.array(sorted(r.hot), np.uint64).tobytes() for r in found.values()], pa.binary()),
            }
        )

    def meet(table: pa.Table) -> pa.Table:
        bucket, parts = table["bucket"][0].as_py(), table["part"].to_pylist()
        strings = [_unpress(x.as_py()).split(b"\n") for x in table["packed"]]
        facts = [np.frombuffer(_unpress(x.as_py()), _FACTS) for x in table["facts"]]
        hot = dict(zip(parts, table["hot"].to_pylist()))
        found = _bucket_minima(parts, strings, facts, k)
        return pa.table(
            {
                "part": pa.array(list(found), pa.int32()),
                "packed": pa.array([_press(b"\n".join(texts)) for texts, _, _ in found.values()], pa.binary()),
                "keys": pa.array([np.unique(minis.astype(np.uint64) | np.uint64(bucket << 32)).tobytes() for _, minis, _ in found.values()], pa.binary()),
                "runs": pa.array([_press(runs.tobytes()) for _, _, runs in found.values()], pa.binary()),
                "hot": pa.array([hot[part] for part in found], pa.binary()),
            }
        )

    def remove(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        keys, hot = numbers(answers["keys"], np.uint64), numbers(answers["hot"], np.uint64)
        known: dict[bytes, list[tuple[int, int, int]]] = {}  # super-k-mer -> windows and their smallest doc_id
        for packed, raw in zip(answers["packed"], answers["runs"]):
            texts = _unpress(packed.as_py()).split(b"\n")
            for j, a, b, low in np.frombuffer(_unpress(raw.as_py()), _RUN).tolist():
                known.setdefault(texts[j], []).append((a, b, low))
        n_words, n_removed, kept = [], [], []
        for ids, texts in _blocks(docs_):
            words, at = _flat(texts)
            gone = np.zeros(len(words) + 1, np.int64)
            if known and len(words) >= k:
                first, stop, text, own_keys, _ = _keyed(_word_hashes(words, len(words)), at, hot, k, m, buckets)
                use = np.flatnonzero(np.isin(own_keys, keys))
                begin, end = [], []
                for s, e, t in zip(first[use].tolist(), stop[use].tolist(), text[use].tolist()):
                    for a, b, low in known.get(b" ".join(words[s : e + k - 1]), ()):
                        if low < ids[t]:
                            begin.append(s + a)
                            end.append(s + b + k - 1)
                gone += np.bincount(np.array(begin, np.int64), minlength=len(gone)) - np.bincount(np.array(end, np.int64), minlength=len(gone))
            out = np.cumsum(gone[:-1]) > 0
            removed = np.concatenate([[0], np.cumsum(out)])[at]
            for a, b, c in zip(at.tolist(), at[1:].tolist(), np.diff(removed).tolist()):
                n_words.append(b - a)
                n_removed.append(c)
                kept.append(b" ".join(list(compress(words[a:b], (~out[a:b]).tolist())) if c else words[a:b]))
        return pa.table(
            {"doc_id": docs_["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary())}
        )

    dealt = rows.repartition(n_parts, "part")
    told = dealt.groupBy("part").applyInArrow(tell, "part int, bucket int, minis binary, often binary")
    shares = told.groupBy("bucket").applyInArrow(share, "part int, keys binary, hot binary")
    sent = dealt.groupBy("part").cogroup(shares.groupBy("part")).applyInArrow(send, "part int, bucket int, packed binary, facts binary, hot binary")
    answers = sent.groupBy("bucket").applyInArrow(meet, "part int, packed binary, keys binary, runs binary, hot binary")
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept_text binary")


def repeats_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each document."""
    return mark_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
