"""Language identification: averaged hashed subword embeddings under a linear softmax.

Trained by stochastic gradient descent in numpy on windows of a bounded sample of labelled rows.
Scores are calibrated on whole texts that the descent does not see: one half of them fits a
temperature, the other half a rejection threshold and the reported error and rejection rates.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import id_and_text, map_texts
from ._shared import written

#: Rows of each language that the sample takes at most, and rows that all languages share; each language gets one at least.
SAMPLE_PER_LANGUAGE, SAMPLE_TOTAL = 800, 160_000
#: One row of the sample in so many is kept for calibration.
CALIBRATION = 5
#: Windows of characters that training draws from each sampled text, and their length.
WINDOWS, WINDOW_CHARS = 3, 240
BUCKETS, DIM, EPOCHS, RATE = 1 << 15, 16, 8, 0.1
LENGTHS = (1, 2, 3)
#: Characters that are scored at a time.
SCORED_CHARS = 300_000
#: Share of correct predictions that the rejection threshold keeps on the calibration part.
KEEP_CORRECT = 0.995
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return table


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed subwords of all texts in one array, and where each text begins (with an end).

    Lower-cased letters count, each other run of characters is one blank; subwords of all
    LENGTHS are taken inside a text.
    """
    lowered = [(t or "").lower() for t in texts]
    flat = " ".join(lowered) + " "
    cps = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered)))
    ok = _letters()[cps]
    keep = ok.copy()
    keep[1:] |= ok[:-1]  # the first blank after a letter stays
    codes = np.where(ok, cps, 32)[keep].astype(np.uint32)
    ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]
    return codes, ends


def hashed(codes: np.ndarray) -> list[np.ndarray]:
    """Bucket of the subword of each length that ends at each position."""
    out, h = [], np.zeros(len(codes), np.uint32)
    for n in range(max(LENGTHS)):
        prev = np.concatenate([np.full(min(n, len(codes)), 32, np.uint32), codes[: len(codes) - n]])
        h = (h * np.uint32(0x01000193)) ^ (prev * np.uint32(0x85EBCA6B) + np.uint32(n + 1))
        if n + 1 in LENGTHS:
            x = h ^ (h >> np.uint32(15))
            out.append((x * np.uint32(0x2C1B3C6D) >> np.uint32(17)).astype(np.int64) & (BUCKETS - 1))
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language: embedding times output weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    #: Share of wrong predictions among accepted ones, and of rejected ones, on the texts that set the threshold.
    error: float = 0.0
    rejected: float = 0.0

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scores before calibration, by text and language, and whether a text has a letter."""
        codes, at = features(texts)
        sums = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(at[1:] > at[:-1])
        if len(full):
            buckets = hashed(codes)
            for k in range(len(self.languages)):
                column = np.ascontiguousarray(self.table[:, k])
                total = sum(column[b] for b in buckets)
                sums[full, k] = np.add.reduceat(total, at[:-1][full], dtype=np.float64)
        sizes = np.maximum(1, at[1:] - at[:-1])[:, None] * len(LENGTHS)
        return sums / sizes + self.bias, at[1:] > at[:-1]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, calibrated probability and acceptance of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        logits, some = self.logits(texts)
        p = _softmax(logits / self.temperature)
        best, score = p.argmax(1), np.minimum(1.0, p.max(1))
        lang = [self.languages[k] if s else UNKNOWN for k, s in zip(best.tolist(), some.tolist())]
        return lang, np.where(some, score, 0.0).tolist(), (some & (score >= self.threshold)).tolist()

    def calibrate(self, logits: np.ndarray, labels: list[str]) -> None:
        """Fit the temperature on every other row, and the threshold and rates on the rest."""
        y = np.array([self.languages.index(x) for x in labels], np.int64)

        def loss(t: float) -> float:
            s = logits[::2] / t
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), y[::2]]).mean())

        if len(y) < 2:
            return
        self.temperature = min((2.0**k for k in np.arange(-6, 4.01, 0.25)), key=loss)
        p = _softmax(logits[1::2] / self.temperature)
        score, right = np.minimum(1.0, p.max(1)), p.argmax(1) == y[1::2]
        self.threshold = float(np.quantile(score[right], 1 - KEEP_CORRECT)) if right.any() else 0.0
        taken = score >= self.threshold
        self.error, self.rejected = float((~right[taken]).mean()) if taken.any() else 0.0, float((~taken).mean())


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def train(pieces: list[str], labels: list[str], seed: int = 7) -> Model:
    """Fit embeddings and output weights to pieces of text."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    codes, at = features(pieces)
    if not len(codes):
        return Model(languages, np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages)))
    buckets = np.stack([b.astype(np.uint16) for b in hashed(codes)], 1)
    del codes
    number = {x: k for k, x in enumerate(languages)}
    y = np.array([number[x] for x in labels])
    use = np.flatnonzero(at[1:] > at[:-1])
    emb = (rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM
    out = rng.standard_normal((DIM, len(languages)), np.float32) / DIM
    bias = np.zeros(len(languages), np.float32)
    weight = 1 / np.maximum(1, np.bincount(y[use], minlength=len(languages)))
    weight = weight / weight[y[use]].mean()

    def hidden(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        idx = np.concatenate([buckets[at[r] : at[r + 1]].ravel() for r in rows])
        sizes = np.array([(at[r + 1] - at[r]) * len(LENGTHS) for r in rows])
        return np.add.reduceat(emb[idx], np.cumsum(sizes) - sizes, 0) / sizes[:, None].astype(np.float32), idx, sizes

    # steps are scaled by the gradients seen so far, so that rare and frequent subwords learn alike
    seen_emb, seen_out = np.full((BUCKETS, 1), 1e-8, np.float32), np.full(out.shape, 1e-8, np.float32)
    for epoch in range(EPOCHS):
        rate = np.float32(RATE * (1 - epoch / EPOCHS))
        order = rng.permutation(use)
        for a in range(0, len(order), 64):
            rows = order[a : a + 64]
            h, idx, sizes = hidden(rows)
            z = h @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p = (p * weight[y[rows]][:, None] / len(rows)).astype(np.float32)
            back = (p @ out.T) / sizes[:, None].astype(np.float32)
            grad = h.T @ p
            seen_out += grad**2
            out -= rate * grad / np.sqrt(seen_out)
            bias -= rate * p.sum(0)
            sort = np.argsort(idx, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(idx[sort]) > 0]))
            own = np.add.reduceat(np.repeat(back, sizes, 0)[sort], first, 0)
            at_emb = idx[sort][first]
            seen_emb[at_emb] += (own**2).mean(1, keepdims=True)
            emb[at_emb] -= rate * own / np.sqrt(seen_emb[at_emb])
    return Model(languages, emb @ out, bias.astype(np.float64))


def held_out(doc_id: F.Column, folds: int = 4, fold: int = 2) -> F.Column:
    """Whether crc32 of the id as text falls into the fold that training must not see (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, total: int = SAMPLE_TOTAL) -> DataFrame:
    """doc_id, text, lang, calibration: about `per_language` labelled rows of each language, drawn by a hash of the id.

    All languages take part; where they would come to more than `total` rows, each gets an equal share. The share to
    draw follows from counts of all rows, so a language's sample does not depend on the order or the partitions of the table.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = rows.filter("doc_id is not null and text is not null and lang is not null").filter(~held_out(F.col("doc_id")))
    counts = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "languages")
    each, space = max(1, min(per_language, total // max(1, counts.count()))), 1 << 30
    draw = lambda what: F.xxhash64(F.lit(what), "doc_id")
    taken = rows.join(counts, "lang").filter(F.pmod(draw("sample"), F.lit(space)) * F.col("size") < F.lit(space * each))
    return taken.select("doc_id", "text", "lang", (F.pmod(draw("calibration"), F.lit(CALIBRATION)) == 0).alias("calibration"))


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Train on windows of the sample and calibrate on whole texts of its other rows.

    Windows are cut, and whole texts scored, in the executors: the driver gets windows and one row of scores for each
    calibration text, both bounded by the sample's size, whatever the table's. The model has BUCKETS numbers for each language.
    """

    def cut(batches):
        for batch in batches:
            ids, parts, langs = [], [], []
            for i, t, label in zip(*(c.to_pylist() for c in batch.columns)):
                rng = np.random.default_rng(zlib.crc32(str(i).encode()))
                for _ in range(WINDOWS):
                    a = int(rng.integers(0, max(1, len(t) - WINDOW_CHARS + 1)))
                    parts.append(t[a : a + WINDOW_CHARS])
                    ids.append(i)
                    langs.append(label)
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "text": parts, "lang": langs}, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string())]))

    sample = labelled_sample(docs, per_language)
    got = sample.filter("not calibration").select("doc_id", "text", "lang").mapInArrow(cut, "doc_id long, text string, lang string").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("text", "ascending"), ("lang", "ascending")])
    model = train(got["text"].to_pylist(), got["lang"].to_pylist())
    if not model.languages:
        return model

    def score(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("logits", pa.list_(pa.float32()))])
        for batch in batches:
            for k in range(batch.num_rows):  # one whole text at a time
                logits, some = model.logits([batch.column(1)[k].as_py()])
                if some[0] and batch.column(2)[k].as_py() in model.languages:
                    yield pa.RecordBatch.from_pydict({"doc_id": [batch.column(0)[k].as_py()], "lang": [batch.column(2)[k].as_py()], "logits": [logits[0].astype(np.float32)]}, schema=schema)

    got = sample.filter("calibration").select("doc_id", "text", "lang").mapInArrow(score, "doc_id long, lang string, logits array<float>").toArrow()
    rows = sorted(zip(got["doc_id"].to_pylist(), got["lang"].to_pylist(), got["logits"].to_pylist()))
    if rows:
        model.calibrate(np.array([r[2] for r in rows], np.float64), [r[1] for r in rows])
    return model


def predict_language(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, accepted for each row of `docs`, from its whole text only.

    A null text or one without letters gives `und` with score 0; repeated rows and null ids are
    kept; a model without languages gives `und` throughout; `accepted` is false where the
    calibrated score is under the model's threshold.
    """

    def work(ids: list, texts: list) -> dict:
        lang, score, ok = model.predict(texts)
        return {"doc_id": ids, "lang_pred": lang, "score": score, "accepted": ok}

    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])
    return map_texts(id_and_text(docs, id_col, text_col), work, schema, "doc_id long, lang_pred string, score double, accepted boolean", SCORED_CHARS)


def language_report(docs: DataFrame) -> DataFrame:
    """Train on the other folds, predict all rows: doc_id, held_out, lang_pred, score, accepted."""
    return predict_language(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
