"""Registration of queries with the SQL that an independent engine runs for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(df: DataFrame) -> DataFrame:
    """Small integer columns as long, the type that results are compared in."""
    small = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select(*[F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, small) else F.col(f"`{f.name}`") for f in df.schema])


def query(name: str, oracle: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a function (documents-like reader) -> DataFrame under a name.

    The function takes ``t``, which reads a table by name.
    """

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: whole(fn(lambda table_name: table(spark, sf_dir, table_name)))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


# Fragments of oracle SQL
CLEAN = r"trim(regexp_replace(coalesce({0}, ''), '[\s\p{{Z}}]+', ' ', 'g'))"


def clean(column: str = "text") -> str:
    return CLEAN.format(column)


def count(pattern: str, column: str = "text") -> str:
    return f"len(regexp_extract_all(coalesce({column}, ''), '{pattern.replace(chr(39), chr(39) * 2)}'))::BIGINT"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def micro(expression: str) -> str:
    return f"round(({expression}) * 1000000)::BIGINT"


#: Stands in for a detector's probability and a card's candidate, which the tables lack.
P_FAKE = "((doc_id * 7919) % 1000) / 1000.0::DOUBLE"
CANDIDATE = "['C-A', 'C-B', 'C-C'][(doc_id % 3 + 1)::INT]"
