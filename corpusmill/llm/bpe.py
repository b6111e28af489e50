"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Each code point becomes a symbol (letter, number, other, apostrophe that opens a
contraction, white space by kind and by what follows it). A deterministic automaton over
those symbols says where a pre-token starts. Automata compose: the effect of a block of
symbols is a function state -> state, and functions compose associatively, so blocks are
reduced independently, combined by a scan, and then all positions get their state at once.
The slices between boundaries go through a bounded cache of merged pieces.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import id_and_text, map_texts

#: Entries of the merge cache of one Python worker; it is emptied beyond that.
CACHE_ENTRIES = 150_000
BLOCK = 128
#: The pre-token pattern that the automaton follows; fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# White space of the Unicode property White_Space (fixed values).
_SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Symbols; the same plus 8 where a document starts.
_L, _N, _O, _A1, _A2, _SP_LAST, _WS_LAST, _WS_IN = range(8)
# States after a character.
_FRESH, _IN_L, _IN_N, _IN_O, _IN_SP, _IN_WS, _LEFT1, _LEFT2 = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next state and starts-a-token, both indexed by symbol * 8 + state."""
    nxt, cut = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    for sym in range(8):
        for state in range(8):
            if state == _LEFT2:
                to, new = _LEFT1, False
            elif state == _LEFT1:
                to, new = _FRESH, False
            elif sym in (_L, _N, _O):
                to = {_L: _IN_L, _N: _IN_N, _O: _IN_O}[sym]
                new = state not in (to, _IN_SP)
            elif sym in (_A1, _A2):
                joins = state in (_IN_O, _IN_SP)
                to, new = (_IN_O, False) if joins else (_LEFT1 if sym == _A1 else _LEFT2, True)
            elif sym == _WS_IN:
                to, new = _IN_WS, state != _IN_WS
            else:
                to, new = (_IN_SP if sym == _SP_LAST else _FRESH), True
            nxt[sym, state], cut[sym, state] = to, new
        nxt[sym + 8], cut[sym + 8] = nxt[sym, _FRESH], True
    return nxt.ravel(), cut.ravel()


_NEXT, _CUT = _automaton()


@lru_cache(1)
def _classes() -> np.ndarray:
    """Letter, number, other or white space (_WS_IN) for each code point."""
    import regex

    table = np.full(0x110000, _O, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, code in ((r"\p{L}+", _L), (r"\p{N}+", _N)):
        for m in regex.finditer(pattern, every):
            shift = [0 if p < 0xD800 else 0x800 for p in m.span()]
            table[m.start() + shift[0] : m.end() + (shift[1] if m.end() > 0xD800 else 0)] = code
    table[0xD800:0xE000] = _O
    table[_SPACES] = _WS_IN
    return table


def symbols(cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Automaton symbols of code points; `starts`: where each non-empty document begins."""
    n = len(cps)
    cls = _classes()[cps]
    space = cls == _WS_IN
    last = np.zeros(n, bool)
    last[starts[1:] - 1] = True
    last[-1:] = True
    sym = cls.copy()
    before_word = np.zeros(n, bool)
    before_word[:-1] = space[:-1] & ~space[1:]
    before_word &= ~last
    sym[before_word] = _WS_LAST
    sym[before_word & (cps == 32)] = _SP_LAST
    quotes = np.flatnonzero((cps == 39) & ~last)
    if len(quotes):
        one = cps[quotes + 1]
        sym[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = _A1
        room = quotes + 2 < n
        two = np.where(room, cps[np.minimum(quotes + 2, n - 1)], 0)
        room &= ~last[quotes + 1]
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        sym[quotes[room & pair]] = _A2
    sym[starts] += 8
    return sym


def boundaries(sym: np.ndarray) -> np.ndarray:
    """Positions where a token starts, by a blocked scan over transition functions."""
    n = len(sym)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, _L, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T) << 3
    # 1. the transition function of each block: state at entry -> state at exit
    fun = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    j = 0
    while j < BLOCK and (j % 8 or (fun != fun[:, :1]).any()):
        fun = _NEXT[grid[j][:, None] + fun]
        j += 1
    if j < BLOCK:  # all are constant by now, and a constant stays one
        state = fun[:, 0]
        for j in range(j, BLOCK):
            state = _NEXT[grid[j] + state]
        fun = np.repeat(state[:, None], 8, 1)
    # 2. inclusive scan of the block functions by doubling
    step = 1
    while step < rows and (fun[step:] != fun[step:, :1]).any():
        fun = np.concatenate([fun[:step], np.take_along_axis(fun[step:], fun[:-step], 1)])
        step *= 2
    entry = np.concatenate([np.zeros(1, np.uint8), fun[:-1, _FRESH]])
    # 3. all blocks at once from their entry states
    cut = np.empty((BLOCK, rows), bool)
    for j in range(BLOCK):
        at = grid[j] + entry
        cut[j] = _CUT[at]
        entry = _NEXT[at]
    return np.flatnonzero(cut.T.ravel()[:n])


def slices(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All pre-tokens of the texts as bytes, the first pre-token of each text (with an end), and byte offsets."""
    flat = "".join(texts)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lens)
    if not flat:
        return [], np.zeros(len(texts) + 1, np.int64), np.zeros(1, np.int64)
    cps = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
    raw = flat.encode()
    cuts = boundaries(symbols(cps, (ends - lens)[lens > 0]))
    first = np.concatenate([[0], np.searchsorted(cuts, ends)])
    if len(raw) == len(cps):
        at = np.append(cuts, len(cps))
    else:
        width = 1 + (cps > 0x7F).astype(np.int64) + (cps > 0x7FF) + (cps > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(width)])[np.append(cuts, len(cps))]
    edges = at.tolist()
    return [raw[a:b] for a, b in zip(edges, edges[1:])], first, at


class Merger(dict):
    """Piece -> its ids as little-endian 32-bit integers; pieces not yet known are merged by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        ranks = self.ranks
        whole = ranks.get(piece)
        ids = [whole] if whole is not None else [ranks[p] for p in (self.short(piece) if len(piece) < 100 else self.long(piece))]
        out = b"".join([i.to_bytes(4, "little") for i in ids])
        self[piece] = out
        return out

    def short(self, piece: bytes) -> list[bytes]:
        get, parts = self.ranks.get, [piece[i : i + 1] for i in range(len(piece))]
        far = 1 << 40
        costs = [get(a + b, far) for a, b in zip(parts, parts[1:])]
        while costs:
            least = min(costs)
            if least == far:
                break
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = get(parts[i] + parts[i + 1], far)
            if i:
                costs[i - 1] = get(parts[i - 1] + parts[i], far)
        return parts

    def long(self, piece: bytes) -> list[bytes]:
        """The same merges, from a heap: n log n for pieces of any length."""
        n, get = len(piece), self.ranks.get
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not alive[i] or mid >= n or not alive[mid] or end[mid] != stop or mid == stop:
                continue
            alive[mid], end[i] = False, stop
            if stop < n:
                prev[stop] = i
                if (r := get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [piece[i : end[i]] for i in range(n) if alive[i]]


@lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(2)
def _merger(path: str) -> Merger:
    return Merger(load_ranks(path))


@lru_cache(2)
def _pieces(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, i in ranks.items():
        out[i] = piece
    return out


def default_ranks() -> str:
    """The ranks that belong to PATTERN; another pattern needs another automaton."""
    import public_tokenizers

    if public_tokenizers.PATTERN != PATTERN:
        raise ValueError("the vocabulary's pre-token pattern is not the one that the automaton follows")
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode_texts(texts: list[str], path: str) -> Iterator[tuple[bytes, bytes]]:
    """For each text its ids and the byte offset of each pre-token, as little-endian 32-bit integers."""
    merger = _merger(path)
    if len(merger) > CACHE_ENTRIES:
        merger.clear()
    pieces, first, at = slices(texts)
    ids = list(map(merger.__getitem__, pieces))
    for a, b in zip(first.tolist(), first[1:].tolist()):
        yield b"".join(ids[a:b]), (at[a:b] - at[a]).astype("<u4").tobytes()


def _decoded(ids: bytes, pieces: list[bytes]) -> bytes:
    return b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """doc_id, ids binary (little-endian unsigned 32-bit), offsets binary (byte offset of each pre-token).

    With `decode`, also decoded binary, made from the ids in the same pass. One row out for each row in;
    a null or empty text has no ids; repeated rows and null ids are kept as they are; other
    columns are not read. Every single byte must have a rank.
    """
    path = ranks_path or default_ranks()

    def work(ids: list, texts: list) -> dict:
        both = list(encode_texts([t or "" for t in texts], path))
        out = {"doc_id": ids, "ids": [x for x, _ in both], "offsets": [y for _, y in both]}
        if decode:
            pieces = _pieces(path)
            out["decoded"] = [_decoded(x, pieces) for x, _ in both]
        return out

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("offsets", pa.binary())] + [("decoded", pa.binary())] * decode)
    ddl = "doc_id long, ids binary, offsets binary" + ", decoded binary" * decode
    return map_texts(id_and_text(docs, id_col, text_col), work, schema, ddl)


def decode_documents(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id, ids, offsets, decoded binary from what encode_documents returns; null ids give empty bytes."""
    path = ranks_path or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            decoded = [_decoded(x.as_buffer(), pieces) if x.is_valid else b"" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(decoded, pa.binary())], names=["doc_id", "ids", "offsets", "decoded"])

    return encoded.select("doc_id", "ids", "offsets").mapInArrow(run, "doc_id long, ids binary, offsets binary, decoded binary")


def decode_slice(ids: bytes, offsets: bytes, start: int, stop: int, ranks_path: str | None = None) -> bytes:
    """The bytes of pre-tokens start..stop of one encoded document, by its retained offsets."""
    pieces, at = _pieces(ranks_path or default_ranks()), np.frombuffer(offsets, "<u4")
    whole = b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    begin = int(at[start]) if start < len(at) else len(whole)
    return whole[begin : int(at[stop]) if stop < len(at) else len(whole)]


def bpe_digests(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each document."""
    done = encode_documents(docs, ranks_path, decode=True)
    return done.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
