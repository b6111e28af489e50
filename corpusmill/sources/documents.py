"""Files of any known format as blocks: one scan of bytes, parsed batch by batch where they are read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats, pdf

DDL = "path string, region string, block long, kind string, level int, language string, text string, links array<string>, page int, error string"
_SCHEMA = pa.schema([
    ("path", pa.string()), ("region", pa.string()), ("block", pa.int64()), ("kind", pa.string()), ("level", pa.int32()),
    ("language", pa.string()), ("text", pa.string()), ("links", pa.list_(pa.string())), ("page", pa.int32()), ("error", pa.string()),
])


def parse_file(path: str, data: bytes | None, recognise: pdf.Recogniser | None = None) -> list[dict]:
    """Rows of one file; a refused file is one row with an error and no text. A recogniser reads the pages of PDF files that have no text."""
    suffix = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    empty = dict.fromkeys(_SCHEMA.names) | {"path": path}
    if suffix not in formats.PARSERS and suffix != "pdf":
        return [empty | {"error": "unsupported-suffix"}]
    try:
        blocks = pdf.parse_pdf(data or b"", recognise) if suffix == "pdf" else formats.PARSERS[suffix](data or b"")
    except formats.Refused as e:
        return [empty | {"error": str(e)}]
    return [empty | block | {"block": k} for k, block in enumerate(blocks)]


def parse_files(files: DataFrame, recognise: pdf.Recogniser | None = None) -> DataFrame:
    """path, region, block, kind, level, language, text, links, page, error for rows (path, content); `recognise` runs in the Python workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1)):
                rows = parse_file(path.as_py(), data.as_py(), recognise)
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return files.select("path", "content").mapInArrow(run, DDL)


def read_documents(spark: SparkSession, path: str, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Blocks of the files under a path; `include` and `exclude` are regular expressions on the path, the latter wins."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if include:
        files = files.filter(F.col("path").rlike(include))
    if exclude:
        files = files.filter(~F.col("path").rlike(exclude))
    return parse_files(files)


def diagnostics(blocks: DataFrame) -> DataFrame:
    """path, status (complete or refused), blocks, error."""
    out = blocks.groupBy("path").agg(F.count("block").alias("blocks"), F.max("error").alias("error"))
    return out.select("path", F.when(F.col("error").isNull(), "complete").otherwise("refused").alias("status"), "blocks", "error")
