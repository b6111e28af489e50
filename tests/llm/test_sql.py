"""The operators' queries against their SQL, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from corpusmill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    result = con.execute(queries.ORACLE_SQL[name])
    order = [[d[0] for d in result.description].index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(tuple(r[k] for k in order) for r in result.fetchall())
