"""Token counts without token ids.

1. Each block of documents becomes a list of its distinct pre-tokens, and for each document their places
   in that list with how often it has them. The list is dealt into buckets by a hash of the pre-token.
2. Each bucket counts the pieces of its distinct pre-tokens once, for the whole corpus, and answers each block.
3. Each block joins the answers to its documents' frequencies by place, and sums.

A frequent pre-token travels once for each block that has it, not for each document. Places are ranks by
frequency, in order, as differences, so that frequencies take a twelfth of the text's bytes.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import id_and_text
from ._shared import partitions, written

#: Characters of text in a block (one longer text is a block of its own), and bytes of text whose pre-tokens make a bucket.
BLOCK_CHARS, BUCKET_BYTES = 12_000_000, 64 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PreTokens:
    """Pre-tokens of texts, and their numbers of pieces as the library gives them."""

    def __init__(self, path: str):
        import os

        import regex
        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec.get("normalizer") or spec.get("post_processor"):
            raise ValueError("a byte-level vocabulary without prefix space, normaliser and post-processor is needed")
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        marks = [t["content"] for t in spec.get("added_tokens", [])]
        self.marks = set(marks)
        # added tokens are cut out of the raw text before pre-tokenisation, the longest first
        self.cut = regex.compile("|".join(f"({regex.escape(m)})" for m in sorted(marks, key=len, reverse=True))) if marks else None

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-tokens of a text with their counts, and how many added tokens stand in it."""
        if not any(m in text for m in self.marks):
            return Counter(self.find(text)), 0
        parts, last, n = Counter(), 0, 0
        for m in self.cut.finditer(text):
            parts.update(self.find(text[last : m.start()]))
            last, n = m.end(), n + 1
        parts.update(self.find(text[last:]))
        return parts, n

    def pieces(self, tokens: list[str]) -> list[int]:
        """Number of pieces of each pre-token."""
        return [len(e) for e in self.library.encode_batch_fast(tokens, add_special_tokens=False)]


@lru_cache(2)
def _pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, str | None]]]:
    """Rows in blocks of about BLOCK_CHARS characters, across batches."""
    rows, size = [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = t.as_py()
            n = len(text) if text is not None else 0
            if rows and size + n > BLOCK_CHARS:
                yield rows
                rows, size = [], 0
            rows.append((i, text))
            size += n
    if rows:
        yield rows


_ROW = pa.schema(
    [
        ("block", pa.int64()), ("bucket", pa.int32()), ("tokens", pa.binary()), ("places", pa.binary()),
        ("ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("sizes", pa.binary()), ("times", pa.binary()),
    ]
)
_ROW_DDL = "block long, bucket int, tokens binary, places binary, ids array<long>, n_bytes array<long>, marks array<long>, sizes binary, times binary"


def _press(values: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte: the upper bytes are mostly zero."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(1).compress(planes.tobytes())


def _unpress(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _pack(tokens: list[bytes]) -> bytes:
    import zstandard

    sizes = np.fromiter(map(len, tokens), "<u4", len(tokens))
    return zstandard.ZstdCompressor(3).compress(np.uint32(len(tokens)).tobytes() + sizes.tobytes() + b"".join(tokens))


def _unpack(data: bytes) -> list[str]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 * (n + 1)
    starts = np.concatenate([[4 * (n + 1)], ends[:-1]]) if n else ends
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]


def _block_rows(number: int, rows: list[tuple[int | None, str | None]], buckets: int, path: str) -> pa.RecordBatch:
    """A row of frequencies, and a row for each bucket with its pre-tokens of the block and their places."""
    frequencies, index = _pre_tokens(path).frequencies, {}
    marks, found, times = [], [], []
    for _, text in rows:
        own, n = frequencies(text or "")
        marks.append(n)
        found.append(np.fromiter((index.setdefault(t, len(index)) for t in own), np.int64, len(own)))
        times.append(np.fromiter(own.values(), np.int64, len(own)))
    documents = np.bincount(np.concatenate(found), minlength=len(index)) if rows else np.empty(0, np.int64)
    rank = np.empty(len(index), np.int64)
    rank[np.argsort(-documents, kind="stable")] = np.arange(len(index))
    for k, places in enumerate(found):
        places = rank[places]
        order = np.argsort(places)
        found[k], times[k] = np.diff(places[order], prepend=0), times[k][order]
    keys = [t.encode() for t in index]
    dealt = np.fromiter((zlib.crc32(t) % buckets for t in keys), np.int64, len(keys))
    order = np.lexsort([rank, dealt])
    edges = np.flatnonzero(np.concatenate([[True], np.diff(dealt[order]) > 0, [True]])) if len(keys) else np.zeros(1, np.int64)
    parts = [order[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
    head = {
        "ids": [[i for i, _ in rows]],
        "n_bytes": [[len((t or "").encode()) for _, t in rows]],
        "marks": [marks],
        "sizes": [_press(np.fromiter(map(len, found), np.int64, len(found)))],
        "times": [_press(np.concatenate(times))],
    }
    none = [None] * len(parts)
    values = {
        "block": [number] * (1 + len(parts)),
        "bucket": [None, *(int(dealt[p[0]]) for p in parts)],
        "tokens": [None, *(_pack([keys[j] for j in p.tolist()]) for p in parts)],
        "places": [_press(np.concatenate(found)), *(_press(np.diff(rank[p], prepend=0)) for p in parts)],
        **{name: v + none for name, v in head.items()},
    }
    return pa.RecordBatch.from_pydict(values, schema=_ROW)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens: one row for each row of `docs`.

    A null text counts as empty: 0 bytes, 0 tokens. Null ids and repeated rows are kept as
    they are, an empty table gives an empty table, other columns are not read. Added tokens
    that stand in a text (such as an end mark) are one token each.
    """
    path = vocabulary or default_vocabulary()
    rows = id_and_text(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), size // BUCKET_BYTES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32  # a task that runs again gives its blocks the same numbers
        for k, block in enumerate(_gathered(batches)):
            yield _block_rows(first + k, block, buckets, path)

    def count(table: pa.Table) -> pa.Table:
        lists = [_unpack(x.as_py()) for x in table["tokens"]]
        pieces = dict.fromkeys(chain.from_iterable(lists))
        distinct = list(pieces)
        for a in range(0, len(distinct), 20_000):
            part = distinct[a : a + 20_000]
            pieces.update(zip(part, _pre_tokens(path).pieces(part)))
        counts = [_press(np.fromiter(map(pieces.__getitem__, tokens), np.int64, len(tokens))) for tokens in lists]
        return pa.table({"block": table["block"], "places": table["places"], "pieces": pa.array(counts, pa.binary())})

    def total(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        known = [(np.cumsum(_unpress(p.as_py())), _unpress(n.as_py())) for p, n in zip(answers["places"], answers["pieces"])]
        pieces = np.zeros(sum(len(p) for p, _ in known), np.int64)
        for places, n in known:
            pieces[places] = n
        out = {"doc_id": [], "n_bytes": [], "n_tokens": []}
        for k in range(blocks.num_rows):  # one, as blocks have numbers of their own
            row = {name: blocks[name][k] for name in ("ids", "n_bytes", "marks", "sizes", "places", "times")}
            ends = np.concatenate([[0], np.cumsum(_unpress(row["sizes"].as_py()))])
            steps = np.concatenate([[0], np.cumsum(_unpress(row["places"].as_py()))])
            places = steps[1:] - np.repeat(steps[ends[:-1]], np.diff(ends))  # differences begin anew with each document
            sums = np.concatenate([[0], np.cumsum(pieces[places] * _unpress(row["times"].as_py()))])
            out["doc_id"].append(row["ids"].values)
            out["n_bytes"].append(row["n_bytes"].values)
            out["n_tokens"].append(pa.array(np.diff(sums[ends]) + np.array(row["marks"].as_py(), np.int64), pa.int64()))
        return pa.table({name: pa.chunked_array(v, pa.int64()) for name, v in out.items()})

    blocks = written(rows.mapInArrow(cut, _ROW_DDL), "token-blocks")
    lists = blocks.filter("bucket is not null").select("block", "bucket", "tokens", "places")
    answers = lists.groupBy("bucket").applyInArrow(count, "block long, places binary, pieces binary")
    whole = blocks.filter("bucket is null").select("block", "ids", "n_bytes", "marks", "sizes", "places", "times")
    return whole.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(total, "doc_id long, n_bytes long, n_tokens long")


def token_report(docs: DataFrame, limit: int = 512, vocabulary: str | None = None) -> DataFrame:
    """count_tokens with over_limit: n_tokens > limit."""
    return count_tokens(docs, vocabulary).withColumn("over_limit", F.col("n_tokens") > limit)
