"""Shared plumbing for the Arrow-batched operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text that one numpy step holds at a time.
STEP_CHARS = 700_000


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so that other columns never clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def steps(batches: Iterator[pa.RecordBatch], limit: int = STEP_CHARS) -> Iterator[tuple[list, list[str | None]]]:
    """Cut Arrow batches into lists of ids and texts of about `limit` characters (one longer text stands alone)."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = t.as_py()
            n = len(t) if t is not None else 0
            if ids and size + n > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += n
        if ids:
            yield ids, texts


def map_texts(docs: DataFrame, work: Callable[[list, list], dict], schema: pa.Schema, ddl: str, limit: int = STEP_CHARS) -> DataFrame:
    """Run `work(ids, texts) -> columns` over (doc_id, text) rows, about `limit` characters at a time, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in steps(batches, limit):
            yield pa.RecordBatch.from_pydict(work(ids, texts), schema=schema)

    return docs.mapInArrow(run, ddl)
