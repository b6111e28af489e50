"""Review sampling by a keyed hash."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a text in lowercase hex, inside the JVM."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def review_sample(subjects: DataFrame, n: int, seed: str, column: str = "subject") -> DataFrame:
    """The n subjects with the smallest keyed hash."""
    keyed = subjects.select(column).distinct().withColumn("h", hmac_sha256(seed.encode(), F.col(column).cast("string")))
    return keyed.orderBy("h", column).limit(n).select(column)
