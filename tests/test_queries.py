"""Every query of the curation catalogue against its oracle SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from quillmesh.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(value(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_flagship(spark):
    got = catalogue.flagship(spark, SF)
    assert got.columns == ["lang", "verdict", "n", "fired"] and got.count() > 0


@pytest.mark.parametrize("name", ["q_stratified_split", "q_balance", "q_surrogate_id", "q_first_appearance", "q_deck_draw"])
def test_independent_of_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(rows(QUERIES[name](spark, SF).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
