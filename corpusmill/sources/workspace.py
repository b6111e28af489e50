"""A workspace: each stage's table in a folder of its own, and a history of revisions that can be checked and replayed."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "revision long, stage string, folder string, n long, checksum string, parent string, digest string"


def _marks(table: DataFrame) -> tuple[int, str]:
    """Rows of a table and an order-free checksum of them."""
    columns = sorted(table.columns)
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}), 256)
    got = table.select(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(20,0)").alias("h")).agg(F.count(F.lit(1)), F.sum("h")).first()
    return got[0], str(got[1] or 0)


class Workspace:
    """Revisions of stages under a folder that all machines share; committed tables are never replaced."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def history(self) -> list[dict]:
        """Revisions in order; an empty workspace has none."""
        log = f"{self.path}/history"
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(log)
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return []
        return [r.asDict() for r in self.spark.read.schema(SCHEMA).json(log).orderBy("revision").collect()]  # one row a commit

    def commit(self, stage: str, table: DataFrame) -> dict:
        """Write a stage's table and add it to the history; the table is complete before the history names it."""
        past = self.history()
        folder = f"{stage}-{uuid.uuid4().hex}"
        table.write.mode("error").parquet(f"{self.path}/{folder}")
        n, checksum = _marks(self.spark.read.parquet(f"{self.path}/{folder}"))
        entry = {"revision": len(past) + 1, "stage": stage, "folder": folder, "n": n, "checksum": checksum, "parent": past[-1]["digest"] if past else ""}
        entry["digest"] = self._digest(entry)
        self.spark.createDataFrame([tuple(entry.values())], SCHEMA).coalesce(1).write.mode("append").json(f"{self.path}/history")
        return entry

    @staticmethod
    def _digest(entry: dict) -> str:
        import hashlib

        body = {k: entry[k] for k in ("revision", "stage", "folder", "n", "checksum", "parent")}
        return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def read(self, stage: str) -> DataFrame:
        """The latest table of a stage."""
        found = [e for e in self.history() if e["stage"] == stage]
        if not found:
            raise ValueError(f"no revision of {stage}")
        return self.spark.read.parquet(f"{self.path}/{found[-1]['folder']}")

    def verify(self) -> list[str]:
        """What is wrong: broken links of the history, entries and tables that were changed; nothing if all is well."""
        wrong, parent = [], ""
        for k, e in enumerate(self.history(), 1):
            if e["revision"] != k or e["parent"] != parent:
                wrong.append(f"{e['revision']}: history")
            if self._digest(e) != e["digest"]:
                wrong.append(f"{e['revision']}: entry")
            if _marks(self.spark.read.parquet(f"{self.path}/{e['folder']}")) != (e["n"], e["checksum"]):
                wrong.append(f"{e['revision']}: table")
            parent = e["digest"]
        return wrong

    def replayed(self, stage: str, again: DataFrame) -> bool:
        """Whether a stage that is made again has the rows of its latest table."""
        found = [e for e in self.history() if e["stage"] == stage]
        return bool(found) and _marks(again) == (found[-1]["n"], found[-1]["checksum"])


class Cancelled(RuntimeError):
    """A run that was told to stop."""


def stages(spark: SparkSession, work: list, tag: str, stop=lambda: False) -> list:
    """Run (name, function) pairs one after the other under a job tag; `stop` is asked between them, and `cancel` ends what runs."""
    out = []
    spark.sparkContext.addJobTag(tag)
    try:
        for name, function in work:
            if stop():
                raise Cancelled(name)
            out.append(function())
    finally:
        spark.sparkContext.removeJobTag(tag)
    return out


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop the jobs that run under a tag."""
    spark.sparkContext.cancelJobsWithTag(tag)
