"""Tables written to the folder that all executors share, to cut lineage and to outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.

    Where it is unset, a local folder on one machine (as in tests), and an error on a cluster, whose
    machines would not see each other's files.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet under the shared folder, and read back."""
    spark = df.sparkSession
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def removed(df: DataFrame) -> None:
    """Delete a table made by `written` that nothing will read any more."""
    files = df.inputFiles()
    if files and f"{_tables(df.sparkSession).rsplit(':', 1)[-1]}/" in files[0]:
        _remove(df.sparkSession, files[0].rsplit("/", 1)[0])


def remove_tables(spark: SparkSession) -> None:
    """Delete all tables that this session has written, once no result that reads them is wanted any more."""
    _remove(spark, _tables(spark))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which the caller sizes to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
