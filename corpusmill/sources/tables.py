"""Readers and writers for rows."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of files that a parser knows.
SUFFIXES = ("txt", "text", "md", "markdown", "html", "htm", "csv", "json", "jsonl", "docx", "py", "js", "ts", "java", "go", "rs", "c", "cpp", "rb", "sh")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def collect_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size, sha256, status: a file with the bytes of an earlier path is a duplicate of it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    rows = files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    owners = rows.groupBy("sha256").agg(F.min("path").alias("owner"))
    return rows.join(owners, "sha256").select("path", "size", "sha256", F.when(F.col("path") == F.col("owner"), "accepted").otherwise(F.concat(F.lit("duplicate-bytes:"), "owner")).alias("status"))


def glob_pattern(glob: str) -> str:
    """A shell pattern (`*`, `?`, `[...]`) as a regular expression for whole paths; `*` also takes slashes."""
    return fnmatch.translate(glob).replace(r"\Z", "$").replace("(?s:", "(?s:^", 1)


def collection(files: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), suffixes: tuple[str, ...] = SUFFIXES, max_files: int | None = 10_000, max_bytes: int = 512 << 20) -> DataFrame:
    """`files` (path, size, sha256) with status and reason: accepted, duplicate, ignored or refused.

    Hidden names, paths outside the globs (exclude wins) and unknown suffixes are ignored, files over `max_bytes` refused. Of
    equal bytes the first path is accepted; accepted files beyond the first `max_files` in path order are refused (None: as many as there are).
    """
    path = F.col("path")
    hit = lambda globs: path.rlike("|".join(glob_pattern(g) for g in globs))
    reason = F.when(path.rlike(r"(?:^|/)\.[^/]"), "hidden")
    if exclude:
        reason = reason.when(hit(exclude), "excluded-by-glob")
    if include:
        reason = reason.when(~hit(include), "excluded-by-glob")
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    reason = reason.when(~suffix.isin(*suffixes), "unsupported-suffix").when(F.col("size") > max_bytes, "too-large")
    rows = files.withColumn("reason", reason)
    owners = rows.filter("reason is null").groupBy("sha256").agg(F.min("path").alias("owner"))
    rows = rows.join(owners, "sha256", "left")
    over = F.lit(False)
    if max_files is not None:
        # the last path that still fits: the greatest of the first `max_files`, found as a bounded top-k
        taken = rows.filter("reason is null and path = owner").select("path").orderBy("path").limit(max_files).agg(F.max("path").alias("last"))
        rows = rows.join(F.broadcast(taken), F.lit(True))
        over = path > F.col("last")
    own = F.col("path") == F.col("owner")
    status = F.when(F.col("reason") == "too-large", "refused").when(F.col("reason").isNotNull(), "ignored").when(~own, "duplicate").when(over, "refused").otherwise("accepted")
    why = F.when(F.col("reason").isNotNull(), F.col("reason")).when(~own, F.concat(F.lit("duplicate-bytes:"), "owner")).when(over, "too-many-files")
    return rows.select(*[c for c in files.columns], status.alias("status"), why.alias("reason"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, block, text: UTF-8 files cut into paragraphs at empty lines."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("t"))
    blocks = F.filter(F.transform(F.split("t", r"(?U)\n\s*\n"), lambda b: F.trim(b)), lambda b: b != "")
    return files.select("path", F.posexplode(blocks).alias("block", "text"))


def write_rows(rows: DataFrame, path: str, form: str, partition_col: str | None = None) -> None:
    """Parquet (uncompressed), JSON lines, or fully quoted CSV; refuses to replace."""
    writer = rows.write.mode("error")
    writer = writer.partitionBy(partition_col) if partition_col else writer
    if form == "parquet":
        writer.option("compression", "none").parquet(path)
    elif form == "jsonl":
        writer.json(path)
    elif form == "csv":
        writer.option("quoteAll", True).option("escape", '"').option("header", True).csv(path)
    else:
        raise ValueError(f"unknown form {form}")
