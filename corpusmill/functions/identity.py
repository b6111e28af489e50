"""Identities and portable names."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfc(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text in Unicode normal form C; null stays null. Spark has no function for it."""
    for v in values:
        yield v.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def logical_path_ok(path: Column) -> Column:
    """Whether a path is portable: relative, with slashes, without empty parts, `.`, `..`, a drive, a backslash or a null character."""
    bad = r"(?s)^$|\\|\x00|^/|^[A-Za-z]:|(?:^|/)\.{0,2}(?:/|$)"
    return path.isNotNull() & ~path.rlike(bad)


def derived_id(kind: str, payload: Column, version: int = 1) -> Column:
    """An identity of a JSON text: kind, version, and a digest separated by kind and version."""
    return F.concat(F.lit(f"{kind}-v{version}-"), F.sha2(F.concat(F.lit(f"corpusmill\0{kind}\0v{version}\0"), payload), 256))


def source_id(path: Column, raw_sha256: Column) -> Column:
    """The identity of a source: where it stands and its bytes; null where the path is not portable or the digest malformed."""
    body = F.to_json(F.struct(path.alias("logical_path"), raw_sha256.alias("raw_sha256")))
    return F.when(logical_path_ok(path) & raw_sha256.rlike("^[0-9a-f]{64}$"), derived_id("src", body))


def artifact_id(kind: str, content_sha256: Column, source_ids: Column, producer: str, version: str, config_digest: str) -> Column:
    """The identity of an artifact: its content, the sources it comes from (sorted, no source twice), and what made it."""
    sources = F.array_sort(F.array_distinct(source_ids))
    body = F.to_json(
        F.struct(
            F.lit(config_digest).alias("config_digest"),
            content_sha256.alias("content_sha256"),
            F.lit(kind).alias("kind"),
            F.lit(producer).alias("producer_id"),
            F.lit(version).alias("producer_version"),
            sources.alias("source_ids"),
        )
    )
    return F.when(F.size(sources) == F.size(source_ids), derived_id("art", body))


def set_id(kind: str, field: str, members: Column) -> Column:
    """The identity of a set of values, whatever their order and copies; null for an empty set or an empty member.

    Members are texts, or structs whose fields are all texts.
    """
    unique = F.array_sort(F.array_distinct(members))
    return F.when(F.size(unique) > 0, derived_id(kind, F.to_json(F.struct(unique.alias(field)))))
