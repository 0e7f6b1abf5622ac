"""Where queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def keep(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stands for the row's name in a template.
NAME = "{n}"


def worded(spark: SparkSession, sf_dir: str, **columns: list) -> DataFrame:
    """A row for each part: id, and columns whose templates take turns by key, with the part's name in place of ``NAME``; a template may be a list of texts."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    turn = lambda xs: F.get(F.array(*[F.array(*[F.lit(y) for y in x]).cast("array<string>") if isinstance(x, list) else F.lit(x) for x in xs]), (F.col("p_partkey") % len(xs)).cast("int"))
    named = lambda c: F.replace(c, F.lit(NAME), F.col("p_name"))
    return p.select(F.col("p_partkey").alias("id"), *[(F.transform(turn(xs), named) if isinstance(xs[0], list) else named(turn(xs))).alias(c) for c, xs in columns.items()])


def worded_sql(**columns: list) -> str:
    """What is expected of worded(): for each column its values (or their templates) by turn."""

    def value(x: object) -> str:
        if x is None:
            return "NULL"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower()

    def column(c: str, xs: list) -> str:
        got = f"[{', '.join(map(value, xs))}][p_partkey % {len(xs)} + 1]"
        return f"replace({got}, '{NAME}', p_name) AS {c}" if any(isinstance(x, str) for x in xs) else f"{got}::{'BOOLEAN' if any(isinstance(x, bool) for x in xs) else 'DOUBLE'} AS {c}"

    return f"SELECT p_partkey AS id, {', '.join(column(c, xs) for c, xs in columns.items())} FROM part"
