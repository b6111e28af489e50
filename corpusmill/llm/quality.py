"""Quality rules from repetition coverage: how much of a text lies inside repeated n-grams and lines.

Word hashes are rolled into n-gram hashes of several lengths in numpy; positions whose
hash occurs twice or more are marked, and the marks are weighed by the characters of the
words under them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._batches import id_and_text, map_texts

_WHITE = b"\t\n\x0b\x0c\r "
_SYMBOLS = b"#*$%&|<>"

#: n-gram length -> largest share of word characters inside repeated n-grams of that length.
NGRAM_LIMITS = {5: 0.60, 8: 0.50, 10: 0.45}
#: Largest share of characters in lines that repeat an earlier one.
LINE_LIMIT = 0.40
#: Largest number of symbols for each word.
SYMBOL_LIMIT = 0.5

SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64())]
    + [("dup_line_chars", pa.int64())]
    + [(f"dup_chars_{n}", pa.int64()) for n in NGRAM_LIMITS]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_())]
)
DDL = ", ".join(f"{f.name} {'boolean' if f.type == pa.bool_() else 'long'}" for f in SCHEMA)


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams (at least n words): out[i] covers hashes[i : i + n]; windows double in length."""
    base = 0x9E3779B97F4A7C15
    out, done, have, width = None, 0, hashes, 1
    while True:
        power = np.uint64(pow(base, width, 1 << 64))
        if n & width:
            if out is None:
                out = have
            else:
                m = len(hashes) - done - width + 1
                out = out[:m] * power + have[done : done + m]
            done += width
        if done == n:
            return out
        have = have[:-width] * power + have[width:]
        width *= 2


def covered(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-gram that occurs at least twice."""
    marks = np.zeros(len(hashes) + 1, np.int32)
    if len(hashes) > n:
        grams = rolled(hashes, n)
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        if same.any():
            twice = np.zeros(len(grams), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            at = np.flatnonzero(twice)
            np.add.at(marks, at, 1)
            np.add.at(marks, at + n, -1)
    return np.cumsum(marks[:-1]) > 0


def measure(text: str | None) -> tuple:
    """The measures of one text, in the order of SCHEMA without doc_id."""
    raw = (text or "").encode()
    words = raw.split()
    n_words = len(words)
    spaces = len(raw) - len(raw.translate(None, _WHITE))
    word_chars = len(text or "") - spaces
    n_symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    extra = {line: k - 1 for line, k in Counter(lines).items() if k > 1} if len(lines) > 1 else {}
    dup_lines = sum(extra.values())
    line_chars = sum(k * len(line.translate(None, _WHITE).decode()) for line, k in extra.items())
    repeat_words, shares = 0, [0] * len(NGRAM_LIMITS)
    if n_words > min(NGRAM_LIMITS):
        hashes = np.array(list(map(hash, words)), np.int64).view(np.uint64)
        # a repeated n-gram needs its last words to repeat, so a text without a repeated word needs no n-grams
        if len(np.unique(hashes)) < n_words:
            marks = {n: covered(hashes, n) for n in sorted({8, *NGRAM_LIMITS})}
            repeat_words = int(marks[8].sum())
            if any(m.any() for m in marks.values()):
                if len(raw) == len(text):
                    sizes = np.fromiter(map(len, words), np.int64, n_words)
                else:
                    sizes = np.fromiter((len(w.decode()) for w in words), np.int64, n_words)
                shares = [int(sizes[marks[n]].sum()) for n in NGRAM_LIMITS]
    base_failed = n_words < 20 or 100 * repeat_words > 30 * n_words
    kept = (
        not base_failed
        and all(s <= limit * word_chars for s, limit in zip(shares, NGRAM_LIMITS.values()))
        and line_chars <= LINE_LIMIT * word_chars
        and n_symbols <= SYMBOL_LIMIT * n_words
    )
    return (n_words, word_chars, n_symbols, dup_lines, repeat_words, line_chars, *shares, base_failed, kept)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict (`kept`) for each row of `docs`.

    A null or empty text has no words and fails the base rule; repeated rows and null ids each
    get their own row; an empty table gives an empty table; other columns are not read.
    """

    def work(ids: list, texts: list) -> dict:
        rows = [(i, *measure(t)) for i, t in zip(ids, texts)]
        return {f.name: [r[k] for r in rows] for k, f in enumerate(SCHEMA)}

    return map_texts(id_and_text(docs, id_col, text_col), work, SCHEMA, DDL)


def keep_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns, decided row by row without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            yield batch.filter(pa.array([measure(t.as_py())[-1] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
