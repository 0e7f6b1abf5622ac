"""Stored results of matches and of lookups: kept under several keys, scored again where rules have changed, and written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.config import LinkConfig
from linkwright.functions.text import normalize_plain, usable_id, usable_isrc
from linkwright.functions.titles import artist_parts, title_parts
from linkwright.operators import tables as T
from linkwright.operators.aliases import Groups
from linkwright.plans import match as L
from linkwright.sources.store import Tables, dropped, saved

#: Decisions that are stored, and that a hit may have.
SURE = ("auto_accept", "user_confirmed")
LIFE_DAYS = 30
BUCKETS = 64
_SONG = "title string, artists array<string>, album string, duration_ms bigint, isrc string"
#: A row for each key of a result.
STORED = f"storefront string, key string, match_id bigint, decision string, complete boolean, source struct<{_SONG.replace(' ', ':').replace(',:', ',')}>, candidates array<struct<match_id:bigint,{_SONG.replace(' ', ':').replace(',:', ',')}>>, policy int, alias int, scoring int, created_at timestamp, expires_at timestamp"
_FIELDS = ("title", "artists", "album", "duration_ms", "isrc")


def result_keys(tracks: DataFrame) -> DataFrame:
    """(id, place, key): the keys of a track's result in the order in which they are tried: code, source and id there, then text with version tags."""
    t = T.dealt(tracks.select("id", "title", "artists", "isrc", "source", "original_id")).withColumn("_t", title_parts("title")).withColumn("_a", artist_parts("artists"))
    core = F.lower(F.trim("_t.core"))
    tags = F.when(F.size("_t.tags") > 0, F.array_join(F.array_sort(F.array_distinct("_t.tags")), ",")).otherwise("standard")
    text = F.when(core != "", F.concat_ws("\x1f", F.lit("text"), core, normalize_plain(F.coalesce("_a.primary", F.lit(""))), tags))
    code = F.when(usable_isrc(F.col("isrc")), F.concat_ws("\x1f", F.lit("code"), F.upper(F.trim("isrc"))))
    source = F.when(usable_id(F.col("original_id"), F.col("source")), F.concat_ws("\x1f", F.lit("source"), "source", F.trim("original_id")))
    return t.select("id", F.posexplode(F.array(code, source, text)).alias("place", "key")).where("key is not null")


def versions(now: dict[str, int]) -> list[Column]:
    return [F.lit(now[k]).alias(k) for k in ("policy", "alias", "scoring")]


def results_to_store(results: DataFrame, tracks: DataFrame, candidates: DataFrame, front: str, at: Column, current: dict[str, int]) -> DataFrame:
    """STORED rows of sure and complete results (id, match_id, decision, incomplete), one for each key of the track; ``candidates`` are (id, rank, match_id, title, artists, album, duration_ms, isrc)."""
    sure = results.where(F.col("decision").isin(*SURE) & ~F.coalesce("incomplete", F.lit(False))).select("id", "match_id", "decision")
    listed = candidates.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct("match_id", *_FIELDS).alias("c")))), lambda x: x["c"]).alias("candidates"))
    both = sure.join(tracks.select("id", F.struct(*_FIELDS).alias("source")), "id").join(listed, "id", "left").join(result_keys(tracks), "id")
    rows = both.select(F.lit(front.lower()).alias("storefront"), "key", F.col("match_id").cast("long").alias("match_id"), "decision", F.lit(True).alias("complete"), "source", F.coalesce("candidates", F.array().cast(dict(both.dtypes)["candidates"])).alias("candidates"), *versions(current), at.alias("created_at"), (at + F.make_dt_interval(F.lit(LIFE_DAYS))).alias("expires_at"))
    # two tracks with one key, at one time: the smaller match stays
    return T.first_of(rows, ["storefront", "key"], [F.col("match_id")])


def put(spark: SparkSession, path: str, changes: DataFrame) -> None:
    """Writes STORED rows into the table at ``path``: of its partitions (storefront and a digest of the key) only those with changes are written anew."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")
    changes = saved(changes.withColumn("bucket", bucket), "changes")
    merged = changes
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        old = spark.read.schema(changes.schema).parquet(path).join(changes.select("storefront", "bucket").distinct(), ["storefront", "bucket"], "left_semi")
        merged = T.upsert(old.select(changes.columns), changes, ["storefront", "key"], "created_at")
    # a table can't be read and overwritten in one go
    whole = saved(merged, "merged")
    # each partition is one task's, so it is one file
    whole.repartition("storefront", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("storefront", "bucket").parquet(path)
    dropped(changes, whole)


def at_path(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED + ", bucket int").parquet(path).drop("bucket")


def _pairs(asked: DataFrame) -> DataFrame:
    """(id, source, candidates) -> a row for each candidate, as score_pairs() wants it."""
    each = asked.select("id", "source", F.posexplode("candidates").alias("insertion", "c"))
    return each.select("id", "insertion", F.col("c.match_id").alias("match_id"), *[F.col(f"source.{f}").alias(f"a_{f}") for f in _FIELDS], *[F.col(f"c.{f}").alias(f"b_{f}") for f in _FIELDS])


def lookup(tracks: DataFrame, stored: DataFrame, front: str, now: Column, current: dict[str, int], groups: Groups = None, config: LinkConfig = LinkConfig()) -> tuple[DataFrame, DataFrame]:
    """(hits, rescored): stored results of tracks, and STORED rows that were scored again under the ``current`` versions, for put().

    hits are (id, match_id, decision, place, how): of a track's keys in order the first whose result counts. A result under the code or the
    source counts if it is sure; after a change of rules it is scored again first, or is a miss, as cache_state() says. A result under the text
    counts only if its candidates, scored against the asking track itself, are accepted. What a person confirmed is never scored again
    under its own keys. All stored pairs of a run are scored in one pass. Returns written tables.
    """
    with Tables() as tables:
        keys = tables.save(result_keys(tracks), "keys")
        live = T.valid_at(stored.where(F.lower("storefront") == front.lower()), now).where("complete")
        state = T.cache_state({k: F.col(k) for k in ("policy", "alias", "scoring")}, {k: F.lit(v) for k, v in current.items()}, F.col("decision"))
        met = tables.save(keys.join(live, "key").withColumn("state", state).where("state != 'miss'"), "met")
        by_text = F.col("key").startswith("text")
        old = met.where("state = 'rescore'").select(F.concat(F.lit("k"), "key").alias("id"), "source", "candidates").dropDuplicates(["id"])
        own = met.where(by_text).join(tracks.select("id", F.struct(*_FIELDS).alias("asking")), "id").select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("id"), F.col("asking").alias("source"), "candidates")
        scored = L.score_pairs(_pairs(old.unionByName(own)), groups)
        tables.made.append(scored)
        made = tables.save(L.decided(scored, config=config).select(F.col("id").alias("_of"), F.when(F.col("decision").isin("auto_accept", "review"), F.col("match_id")).alias("_match"), F.col("decision").alias("_decision")), "decided")
        of = F.when(by_text, F.concat(F.lit("t"), F.col("id").cast("string"))).when(F.col("state") == "rescore", F.concat(F.lit("k"), "key"))
        both = met.withColumn("_of", of).join(made, "_of", "left")
        again = by_text | (F.col("state") == "rescore")
        result = both.select("id", "place", F.when(again, F.col("_match")).otherwise(F.col("match_id")).alias("match_id"), F.when(again, F.col("_decision")).otherwise(F.col("decision")).alias("decision"), F.when(by_text, "verified").when(F.col("state") == "rescore", "rescored").otherwise("stored").alias("how"))
        counts = F.when(F.col("how") == "verified", F.col("decision") == "auto_accept").otherwise(F.col("decision").isin(*SURE))
        hits = saved(T.first_of(result.where(counts), ["id"], [F.col("place")]).select("id", "match_id", "decision", "place", "how"), "stored-hits")
        fresh = met.where("state = 'rescore'").drop("id", "place", "state").dropDuplicates(["storefront", "key"]).join(made, F.concat(F.lit("k"), "key") == F.col("_of"))
        rescored = fresh.select("storefront", "key", F.col("_match").alias("match_id"), F.col("_decision").alias("decision"), "complete", "source", "candidates", *versions(current), now.alias("created_at"), "expires_at")
        return hits, saved(rescored, "rescored")


#: What a lookup told, and how many days that holds.
STATES = {"hit": 7, "negative": 1}


def answered(asked: DataFrame, cache: DataFrame, now: Column, key: str = "key") -> DataFrame:
    """(key, state, payload): ``hit`` with its payload, ``negative`` where the source is known not to have it, ``unknown`` where nobody has asked or the answer is too old."""
    live = T.valid_at(cache, now).select(key, "state", "payload")
    return asked.select(key).distinct().join(live, key, "left").select(key, F.coalesce("state", F.lit("unknown")).alias("state"), F.when(F.col("state") == "hit", F.col("payload")).alias("payload"))


def told(asked: DataFrame, found: DataFrame, cache: DataFrame, now: Column, key: str = "key", lives: dict[str, int] | None = None) -> DataFrame:
    """The cache after a lookup: what was found as hits, what was asked and not found as negative, each with its own life; rows of other keys stay."""
    lives = lives or STATES
    payload = found.groupBy(key).agg(F.min("payload").alias("payload"))
    rows = asked.select(key).distinct().join(payload.withColumn("_has", F.lit(True)), key, "left")
    state = F.when(F.col("_has"), "hit").otherwise("negative")
    life = F.when(F.col("_has"), lives["hit"]).otherwise(lives["negative"])
    return T.upsert(cache, rows.select(key, state.alias("state"), "payload", now.alias("at"), (now + F.make_dt_interval(life)).alias("expires_at")), [key], "at")
