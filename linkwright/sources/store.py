"""Tables that a job writes and reads back."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    It is the one that spark.checkpoint.dir names. Where that is unset, a session of one machine takes
    its temporary folder; a cluster has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return os.path.join(tempfile.gettempdir(), "linkwright-work")
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


_collecting: list[list[str]] = []


@contextmanager
def collected() -> Iterator[list[str]]:
    """The folders of all tables that are written meanwhile, in order."""
    paths: list[str] = []
    _collecting.append(paths)
    try:
        yield paths
    finally:
        _collecting[:] = [x for x in _collecting if x is not paths]


def saved(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Writes a table of its own name below work_dir() and reads it back; ``by`` are columns that partition it."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for paths in _collecting:
        paths.append(path)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folders_dropped(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders of tables, each a folder right below work_dir(); raises an error for any other before one is deleted."""
    path_of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    top = path_of(work_dir(spark)).getFileSystem(conf).makeQualified(path_of(work_dir(spark)))
    found = []
    for folder in folders:
        path = path_of(folder)
        files = path.getFileSystem(conf)
        found.append((files, files.makeQualified(path)))
        if not found[-1][1].getParent() or not found[-1][1].getParent().equals(top):
            raise ValueError(f"not a table of this job: {folder}")
    for files, path in found:
        files.delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that saved() returned, once nothing will read them again.

    Raises an error for a frame that reads anything outside work_dir(), so an input is never deleted.
    """
    for t in tables:
        spark = t.sparkSession
        top = qualified(spark, work_dir(spark)).rstrip("/") + "/"
        files = [qualified(spark, f) + "/" for f in {f.rsplit("/", 1)[0] for f in t.inputFiles()}]
        if any(not f.startswith(top) for f in files):
            raise ValueError(f"not tables of this job: {files}")
        # files may stand in folders of partitions
        folders_dropped(spark, sorted({top + f[len(top) :].split("/", 1)[0] for f in files}))


def qualified(spark: SparkSession, name: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


class Tables:
    """Tables of a job that go when it is done, also when it fails."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(saved(df, name))
        return self.made[-1]

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *failure: object) -> None:
        dropped(*self.made)


def write_batches(rows: DataFrame, playlist: str, track: str, kind: str, size: int = 50) -> DataFrame:
    """Additions to lists, written in batches of ``size`` in order and read back: playlist, batch, place, track, kind."""
    from linkwright.operators.tables import chunked

    placed = chunked(rows.select(F.col(playlist).alias("playlist"), F.col(track).alias("track"), F.col(kind).alias("kind")), "track", size, "playlist")
    return saved(placed.select("playlist", F.col("chunk").alias("batch"), "track", "kind"), "additions")


def delete_by_key(table: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows left, counts of rows deleted by key): the table without all rows of the keys, written and read back. Keys that no row has count 0."""
    gone = keys.select(*on).distinct()
    left = saved(table.join(gone, on, "left_anti"), "left")
    counts = gone.join(table.groupBy(*on).agg(F.count("*").alias("deleted")), on, "left").select(*on, F.coalesce("deleted", F.lit(0)).cast("long").alias("deleted"))
    return left, counts


def write_unmatched(tracks: DataFrame, results: DataFrame) -> DataFrame:
    """Tracks without a selected candidate, written and read back with their decision (no_match where there is no result)."""
    decided = results.select("id", "decision")
    left = tracks.join(decided, "id", "left").withColumn("decision", F.coalesce("decision", F.lit("no_match")))
    return saved(left.where(~F.col("decision").isin("auto_accept", "review")), "unmatched")


def sync_counts(before: DataFrame, after: DataFrame, group: str, key: str) -> DataFrame:
    """(group, added, removed, kept) keys of two states of a table; repeated rows of a key count once."""
    sides = before.select(group, key).distinct().withColumn("old", F.lit(1)).join(after.select(group, key).distinct().withColumn("new", F.lit(1)), [group, key], "full")
    return sides.groupBy(group).agg(F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("new").isNull()).alias("removed"), F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull()).alias("kept"))
