"""Identity of candidates that several queries found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.functions.text import normalize_plain

#: Lengths this near each other are of one recording, where nothing better tells.
BUCKET_MS = 4000


def identity_key(match_id: Column, isrc: Column, version: Column, language: Column, title: Column, artist: Column, duration_ms: Column) -> Column:
    """What a candidate is known by: its id, else its code with version and language, else its text with a length bucket and language.

    Each candidate has one key only, so merging never chains through several kinds of keys.
    """
    filled = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    code = F.upper(F.trim(filled(isrc)))
    bucket = F.floor(F.coalesce(duration_ms, F.lit(0)) / BUCKET_MS)
    by_text = F.concat_ws("\x1f", F.lit("text"), normalize_plain(filled(title)), normalize_plain(filled(artist)), bucket.cast("string"), filled(language))
    by_code = F.concat_ws("\x1f", F.lit("code"), code, F.when(filled(version) == "", "original").otherwise(version), filled(language))
    return F.when(filled(match_id) != "", F.concat_ws("\x1f", F.lit("id"), match_id.cast("string"))).when(code != "", by_code).otherwise(by_text)


def merged(found: DataFrame) -> DataFrame:
    """One row per track and identity, of (id, ord, query, path, mapped, match_id, isrc, version, language, title, artists, duration_ms); ``ord`` is the order of arrival.

    The first candidate stands for all, with ``queries`` in the order in which they found it first. A candidate that came over an
    equivalent mapping marks the identity as mapped, and gives its path if the first one wasn't mapped. A track has at most as many candidates as its queries return.
    """
    key = identity_key(*[F.col(c) for c in ("match_id", "isrc", "version", "language", "title")], F.get("artists", F.lit(0)), F.col("duration_ms"))
    own = [c for c in found.columns if c not in ("id", "ord", "query", "path", "mapped")]
    arrivals = F.array_sort(F.collect_list(F.struct("ord", "query")))
    first_mapped = F.min(F.when(F.col("mapped"), F.struct("ord", "path")))
    groups = found.withColumn("key", key).groupBy("id", "key").agg(
        F.min("ord").alias("ord"), F.min_by(F.struct("path", *own), "ord").alias("_first"),
        F.array_distinct(F.filter(F.transform(arrivals, lambda a: a["query"]), lambda q: q.isNotNull())).alias("queries"), first_mapped.alias("_mapped"),
    )
    return groups.select("id", "key", "ord", "queries", F.col("_mapped").isNotNull().alias("mapped"), F.coalesce("_mapped.path", "_first.path").alias("path"), *[F.col(f"_first.{c}").alias(c) for c in own])
