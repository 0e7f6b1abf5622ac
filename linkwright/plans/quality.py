"""Quality of a linkage job against known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.plans import search


def recalled(tracks: DataFrame, catalog: DataFrame, truth: DataFrame, k: int = 20, front: str = "cn") -> DataFrame:
    """(id, found): whether the true row of a track (id, truth) is among the first k candidates of its planned searches."""
    hits = search.candidates(search.retrieve(search.planned(tracks, front), catalog.select("id", "title", F.array_join("artists", " ").alias("artist")), k))
    met = hits.join(truth, "id").where(F.col("match_id") == F.col("truth")).select("id").distinct().withColumn("found", F.lit(True))
    return truth.where("truth is not null").select("id").join(met, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


def quality(results: DataFrame, truth: DataFrame, found: DataFrame) -> DataFrame:
    """Per bucket and overall (bucket null): tracks, recall at k, share of right automatic decisions, and false ones.

    ``truth`` has id, bucket and truth (null: the catalog doesn't have the recording). An automatic decision is right only for the true row.
    """
    both = truth.join(results.select("id", "match_id", "decision"), "id", "left").join(found, "id", "left")
    auto = F.coalesce(F.col("decision") == "auto_accept", F.lit(False))
    right = auto & F.coalesce(F.col("match_id") == F.col("truth"), F.lit(False))
    has = F.col("truth").isNotNull()
    rows = both.select("bucket", has.alias("has"), right.alias("right"), (auto & ~right).alias("false_accept"), "found")
    return rows.rollup("bucket").agg(
        F.count("*").alias("tracks"), F.avg(F.when(F.col("has"), F.col("found").cast("int"))).alias("recall"),
        F.avg(F.when(F.col("has"), F.col("right").cast("int"))).alias("accepted"), F.count_if("false_accept").alias("false_accepts"),
    )
