"""A small preparation pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept. Its result is written as Parquet and read again as the next
stage's docs; tables that no later stage reads are deleted.

In all stages rows are told apart by doc_id and text, so rows that share a doc_id, or have none, are judged each by
its own text; columns beyond those of documents are left out; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.llm import decontaminate, mixing, near_duplicates, sharding, toxicity
from linkwright.llm.shared import row_digest, table, written
from linkwright.sources.store import collected, folders_dropped

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
N_SHARDS = 40

#: Models, decoding and shingle joins have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; null and empty texts are scored too."""
    keyed = docs.select(*COLUMNS)
    scored = toxicity.score_toxicity(keyed, table(spark, sf_dir, "labels"), extra=COLUMNS[1:])
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id (none comes last), and of repeated rows one. Texts without words, null ones too, all stay."""
    found = near_duplicates.near_duplicates(docs).where("component is not null")
    rows = found.groupBy("component", "row").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    lead = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "copies")).alias("lead"))
    gone = rows.join(lead, "component").where("row != lead.row").select("row")
    kept = docs.select(*COLUMNS, row_digest().alias("row")).join(gone, "row", "left_anti")
    repeated = written(lead.where("lead.copies > 1").select("lead.row"), "repeated")
    if not repeated.isEmpty():
        once = kept.join(repeated, "row", "left_semi").dropDuplicates(["row"])
        kept = kept.join(repeated, "row", "left_anti").unionByName(once)
    return kept.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts hold none."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("row").distinct()
    return docs.select(*COLUMNS, row_digest().alias("row")).join(found, "row", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number; those it takes less than half of go, and so do texts without words."""
    taken = mixing.mix_sources(docs, row=row_digest()).where("size > 0").select("row", F.round(F.col("taken") / F.col("size")).cast("int").alias("times"))
    taken = taken.groupBy("row").agg(F.max("times").alias("times")).where("times > 0")
    return docs.select(*COLUMNS, row_digest().alias("row")).join(taken, "row").select(*COLUMNS, F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("_")).drop("_")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and place of every row of the mix; rows without a doc_id go to the shard of 0."""
    return sharding.shard_documents(docs, N_SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a written table. All others that the stages wrote are deleted."""
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with collected() as made:
            result = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # the result is the last
        folders_dropped(spark, made[:-1] + ([old] if old else []))
        docs, old = result, made[-1]
    return docs
