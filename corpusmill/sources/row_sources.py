"""Row sources: JSONL, JSON, CSV, Parquet and Arrow files as rows (path, row_index, payload, error), payload a JSON object."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written


def _checked(rows: DataFrame) -> DataFrame:
    kind = F.schema_of_variant(F.try_parse_json("payload"))
    return rows.withColumn("error", F.when(kind.isNull(), "not-json").when(~kind.startswith("OBJECT"), "not-an-object"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, row_index (from 1), line: lines end at a line feed only, one carriage return before it is dropped.

    Files are read in splits; each split numbers its own lines, and a window over the splits of a file adds those before.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    lines = written(lines, "lines")
    splits = lines.groupBy("path", "split").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("path", "split", (before - F.col("low") + 1).alias("shift"))
    return lines.join(splits, ["path", "split"]).select("path", (F.col("at") + F.col("shift")).alias("row_index"), F.regexp_replace("value", "\r$", "").alias("line"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object a line; blank lines are skipped but numbered."""
    lines = numbered_lines(spark, path).filter(F.trim("line") != "")
    return _checked(lines.select("path", "row_index", F.col("line").alias("payload")))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, or an object with one of `records` and `rows`; any other file is one row with an error."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("v"))
    either = [F.get_json_object("v", f"$.{k}") for k in ("records", "rows")]
    both = either[0].isNotNull() & either[1].isNotNull()
    inner = F.when(F.ltrim("v").startswith("["), F.col("v")).when(~both, F.coalesce(*either))
    items = F.from_json(inner, "array<string>")
    rows = files.select("path", both.alias("both"), F.posexplode_outer(items).alias("pos", "payload"))
    rows = _checked(rows.select("path", (F.coalesce("pos", F.lit(0)) + 1).cast("long").alias("row_index"), "payload", "both"))
    return rows.withColumn("error", F.when(F.col("both"), "two-lists").otherwise(F.col("error"))).drop("both")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of files with a header; jagged rows fail the read, cells stay text, and a cell that begins like JSON is an error."""
    rows = spark.read.options(header=True, multiLine=True, mode="FAILFAST", escape='"', enforceSchema=False, nullValue="\0", emptyValue="").csv(path)
    nested = F.lit(False)
    for n in rows.columns:
        nested = nested | F.coalesce(F.col(f"`{n}`").rlike(r"^\s*[{\[]"), F.lit(False))
    payload = F.to_json(F.struct(*[F.col(f"`{n}`") for n in sorted(rows.columns)]))
    out = rows.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), payload.alias("payload"), nested.alias("nested"))
    # a file with quoted line ends is read by one task, so the numbers of its rows follow each other
    out = written(out, "cells")
    first = out.groupBy("path").agg(F.min("at").alias("low"))
    return out.join(first, "path").select("path", (F.col("at") - F.col("low") + 1).alias("row_index"), "payload", F.when(F.col("nested"), "nested-cell").alias("error"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Rows of Parquet files; a row with a null anywhere at the top is an error."""
    rows = spark.read.parquet(path)
    blank: Column = F.lit(False)
    for n in rows.columns:
        blank = blank | F.col(f"`{n}`").isNull()
    payload = F.to_json(F.struct(*[F.col(f"`{n}`") for n in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    out = rows.select(F.col("_metadata.file_path").alias("path"), (F.col("_metadata.row_index") + 1).alias("row_index"), payload.alias("payload"), blank.alias("blank"))
    return out.select("path", "row_index", "payload", F.when(F.col("blank"), "null-value").alias("error"))


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Rows of Arrow IPC files, decoded where the bytes are read."""
    schema = pa.schema([("path", pa.string()), ("row_index", pa.int64()), ("payload", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for files in batches:
            for name, data in zip(files.column(0), files.column(1)):
                at = 0
                with pa.ipc.open_file(data.as_buffer()) as reader:
                    for k in range(reader.num_record_batches):
                        rows = reader.get_batch(k).to_pylist()
                        payloads = [json.dumps(r, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str) for r in rows]
                        yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows)), pa.array(range(at + 1, at + len(rows) + 1), pa.int64()), pa.array(payloads, pa.string())], schema=schema)
                        at += len(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(path).select("path", "content")
    return _checked(files.mapInArrow(run, "path string, row_index long, payload string"))


READERS = {"jsonl": read_jsonl, "json": read_json, "csv": read_csv, "parquet": read_parquet, "arrow": read_arrow}


def read_rows(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """Rows of a container, by its suffix unless named."""
    form = form or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if form not in READERS:
        raise ValueError(f"unknown container {form}")
    return READERS[form](spark, path)


def accepted(rows: DataFrame) -> DataFrame:
    """Rows of files without an error: one bad row refuses its file."""
    bad = rows.filter("error is not null").select("path").distinct()
    return rows.join(bad, "path", "left_anti").drop("error")
