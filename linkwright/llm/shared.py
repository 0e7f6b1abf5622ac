"""Small things that several operators of this subpackage need on the Spark side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.sources.store import dropped, saved

WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table in the shared folder and reads it back, which cuts the lineage for good."""
    return saved(df, tag)


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables made by written() as soon as nothing will read them again; anything else is an error."""
    dropped(*tables)


def row_digest() -> Column:
    """Tells rows apart that share a doc_id or have none."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def ordered(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """A written table with a column ``_range`` that cuts groups into ranges of the order, as running_total() wants them, whatever their size."""
    return written(df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_range", F.spark_partition_id()), "ranges")
