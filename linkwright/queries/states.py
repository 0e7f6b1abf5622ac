"""Caches, budgets, quotas, metrics and written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkwright.operators import tables as T
from linkwright.plans import stored as R
from linkwright.queries.registry import query, read
from linkwright.sources import store as W

NOW = 1_705_000_000
SEC = "epoch(ts)"
CACHE_SQL = "SELECT event_id, user_id, event_type, (epoch_us(ts) // 1000000 + 86400 * (CASE WHEN event_type IN ('view', 'click') THEN 7 ELSE 1 END))::BIGINT AS expires_at, (epoch_us(ts) // 1000000)::BIGINT AS created_at FROM events"


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint")
    days = F.when(F.col("event_type").isin("view", "click"), 7).otherwise(1)
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (at + 86_400 * days).alias("expires_at"), at.alias("created_at"))


@query(f"SELECT event_id, expires_at FROM ({CACHE_SQL}) WHERE expires_at > {NOW}")
def cache_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.valid_at(cache(spark, sf_dir), F.lit(NOW)).select("event_id", "expires_at")


@query(f"SELECT event_id FROM events WHERE event_id % 3 = 2")
def ttl_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that expire a second before, at and after the time that is asked for: only the last are valid."""
    near = read(spark, sf_dir, "events").select("event_id", (F.lit(NOW) - 1 + F.col("event_id") % 3).alias("expires_at"))
    return T.valid_at(near, F.lit(NOW)).select("event_id")


@query(f"""WITH a AS (SELECT user_id AS key, min(event_id) FILTER (event_type = 'click') AS payload FROM events WHERE event_type IN ('view', 'click') GROUP BY 1),
 u AS (SELECT DISTINCT user_id AS key FROM events) SELECT hours, u.key, CASE WHEN a.key IS NULL OR (a.payload IS NULL AND hours >= 24) OR hours >= 168 THEN 'unknown' WHEN a.payload IS NULL THEN 'negative' ELSE 'hit' END AS state,
 CASE WHEN hours < 168 THEN a.payload END AS payload FROM u LEFT JOIN a USING (key), (VALUES (12), (24), (167), (168)) h(hours)""")
def lookup_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache says of every user after a lookup that found those with clicks and not those with views alone: at four ages."""
    e = read(spark, sf_dir, "events").withColumnRenamed("user_id", "key")
    start = F.timestamp_seconds(F.lit(NOW))
    empty = e.limit(0).select("key", F.lit("").alias("state"), F.col("event_id").alias("payload"), start.alias("at"), start.alias("expires_at"))
    cache = R.told(e.where("event_type IN ('view', 'click')"), e.where("event_type = 'click'").withColumnRenamed("event_id", "payload"), empty, start)
    out = None
    for hours in (12, 24, 167, 168):
        told = R.answered(e, cache, F.timestamp_seconds(F.lit(NOW + 3600 * hours))).select(F.lit(hours).alias("hours"), "key", "state", "payload")
        out = told if out is None else out.unionByName(told)
    return out


STORED_SQL = """WITH s AS (SELECT p_partkey AS id, p_partkey % 12 = 0 AS confirmed, p_partkey % 12 IN (2, 4) AS weak, p_partkey % 5 = 0 AS policy, p_partkey % 7 = 0 AS scoring, p_partkey % 3 = 0 AS code, p_partkey % 4 = 0 AS source FROM part WHERE p_partkey % 2 = 0),
 t AS (SELECT *, CASE WHEN confirmed THEN 'use' WHEN policy AND weak THEN 'miss' WHEN policy OR scoring THEN 'rescore' ELSE 'use' END AS state FROM s), u AS (SELECT *, (code OR source) AND (state = 'rescore' OR NOT weak) AS own FROM t WHERE state <> 'miss')
 SELECT id, id AS match_id, CASE WHEN own AND confirmed THEN 'user_confirmed' ELSE 'auto_accept' END AS decision, CASE WHEN own AND code THEN 0 WHEN own THEN 1 ELSE 2 END AS place, CASE WHEN own AND state = 'rescore' THEN 'rescored' WHEN own THEN 'stored' ELSE 'verified' END AS how FROM u"""


@query(STORED_SQL)
def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of every other part, written under up to three keys and looked up for all parts after rules have changed for some.

    Some results are confirmed, some have become weaker decisions, and some were made under an old policy or an old scoring.
    """
    p, k = read(spark, sf_dir, "part"), F.col("id")
    key = F.col("p_partkey").cast("string")
    tracks = p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", F.initcap("p_name"), F.lit("No"), key).alias("title"), F.array("p_brand").alias("artists"), F.col("p_type").alias("album"), F.lit(200_000).cast("bigint").alias("duration_ms"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("ISRC"), F.lpad(key, 8, "0"))).alias("isrc"), F.lit("list").alias("source"), F.when(F.col("p_partkey") % 4 == 0, key).alias("original_id"))
    old = tracks.where("id % 2 = 0")
    now, current = F.timestamp_seconds(F.lit(NOW)), {"policy": 2, "alias": 1, "scoring": 3}
    results = old.select("id", F.col("id").alias("match_id"), F.when(k % 12 == 0, "user_confirmed").otherwise("auto_accept").alias("decision"), F.lit(False).alias("incomplete"))
    rows = R.results_to_store(results, old, old.select("id", F.lit(1).alias("rank"), F.col("id").alias("match_id"), "title", "artists", "album", "duration_ms", "isrc"), "cn", now, current)
    m = F.col("match_id")
    rows = rows.withColumn("decision", F.when((m % 12).isin(2, 4), "review").otherwise(F.col("decision"))).withColumn("policy", F.when(m % 5 == 0, 1).otherwise(F.col("policy"))).withColumn("scoring", F.when(m % 7 == 0, 2).otherwise(F.col("scoring")))
    folder = f"{W.work_dir(spark)}/results-{uuid.uuid4().hex}"
    R.put(spark, folder, rows)
    hits, rescored = R.lookup(tracks, R.at_path(spark, folder), "cn", now, current)
    W.dropped(rescored, R.at_path(spark, folder))
    return hits


@query(f"SELECT user_id, event_type, max(event_id) AS event_id, arg_max(expires_at, event_id) AS expires_at FROM (SELECT *, max(event_id) FILTER (event_id % 3 <> 0) OVER (PARTITION BY user_id, event_type) AS changed FROM ({CACHE_SQL})) WHERE changed IS NULL OR event_id % 3 <> 0 GROUP BY 1, 2")
def cache_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table of every third write, and all others as changes: keys without changes stay, the others take their last change even where the table's row is newer."""
    c = cache(spark, sf_dir).select("user_id", "event_type", "event_id", "expires_at")
    stored = T.first_of(c.where("event_id % 3 = 0"), ["user_id", "event_type"], [-F.col("event_id")])
    return T.upsert(stored, c.where("event_id % 3 != 0"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "expires_at")


@query(f"SELECT event_type, count(*) AS n, sum(CASE WHEN expires_at > {NOW} THEN 1 ELSE 0 END)::BIGINT AS valid FROM ({CACHE_SQL}) GROUP BY 1")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("expires_at") > NOW).alias("valid"))


@query(f"SELECT event_id FROM ({CACHE_SQL}) WHERE event_type = 'purchase' OR expires_at > {NOW}")
def cache_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual decisions stay whatever their age."""
    return cache(spark, sf_dir).where((F.col("event_type") == "purchase") | (F.col("expires_at") > NOW)).select("event_id")


@query("SELECT event_id, CASE WHEN d = 'user_confirmed' THEN 'use' WHEN (p <> 2 AND d IN ('review', 'no_match')) OR (s <> 1 AND d = 'no_match') THEN 'miss' WHEN p <> 2 OR s <> 1 THEN 'rescore' ELSE 'use' END AS state FROM (SELECT event_id, event_id % 3 AS p, event_id % 2 AS s, ['user_confirmed', 'review', 'no_match', 'auto_accept', 'review'][event_id % 5 + 1] AS d FROM events)")
def cache_version_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    d = F.get(F.array(*[F.lit(x) for x in ("user_confirmed", "review", "no_match", "auto_accept", "review")]), (i % 5).cast("int"))
    state = T.cache_state({"policy": i % 3, "alias": F.lit(2), "scoring": i % 2}, {"policy": F.lit(2), "alias": F.lit(2), "scoring": F.lit(1)}, d)
    return read(spark, sf_dir, "events").select("event_id", state.alias("state"))


@query("SELECT event_type, sum(a)::BIGINT AS old, sum(b)::BIGINT AS v FROM (SELECT event_type, 1 AS a, 1 AS b FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_type, 0, 2 FROM events WHERE event_id % 2 = 1) GROUP BY 1")
def cache_schema_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    old = e.where("event_id % 2 = 0").select("event_type", F.lit(1).alias("old"))
    new = e.where("event_id % 2 = 1").select("event_type", F.lit(2).alias("version"))
    m = T.merge_schema(old, new, defaults={"version": F.lit(1), "old": F.lit(0)})
    return m.groupBy("event_type").agg(F.sum("old").alias("old"), F.sum("version").alias("v"))


@query("""WITH k AS (SELECT o_orderkey, unnest([{'p': 1, 'k': 'i' || o_custkey}, {'p': 2, 'k': 's' || o_orderkey % 500}, {'p': 3, 'k': 't' || o_orderpriority}]) AS u FROM orders), c AS (SELECT 'i' || c_custkey AS k, c_custkey AS v FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 's' || s_suppkey, s_suppkey + 1000000 FROM supplier)
 SELECT o_orderkey, arg_min(c.v, u.p) AS hit FROM k JOIN c ON u.k = c.k GROUP BY 1""")
def multi_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a row are tried in order; all are looked up in one join and the first hit counts."""
    o = read(spark, sf_dir, "orders")
    keys = F.array(F.concat(F.lit("i"), F.col("o_custkey").cast("string")), F.concat(F.lit("s"), (F.col("o_orderkey") % 500).cast("string")), F.concat(F.lit("t"), "o_orderpriority"))
    k = o.select("o_orderkey", F.posexplode(keys).alias("p", "k"))
    c = read(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.concat(F.lit("i"), F.col("c_custkey").cast("string")).alias("k"), F.col("c_custkey").alias("v"))
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("k"), (F.col("s_suppkey") + 1_000_000).alias("v"))
    return k.join(c.unionByName(s), "k").groupBy("o_orderkey").agg(F.min_by("v", "p").alias("hit"))


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent FROM events")
def rolling_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.rolling_count(read(spark, sf_dir, "events"), "event_type", "ts", 3600).select("event_id", "recent")


@query("WITH i AS (SELECT *, event_type = 'error' AS f, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) SELECT event_id, sum(f::INT) OVER (PARTITION BY user_id, g ORDER BY event_id)::BIGINT AS run FROM i")
def breaker_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.failure_runs(read(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error").select("event_id", "run")


@query("SELECT event_id, coalesce(bool_or(event_type = 'error' AND value > 90) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS unprocessed FROM events")
def batch_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.aborted_after(read(spark, sf_dir, "events"), "user_id", "event_id", (F.col("event_type") == "error") & (F.col("value") > 90)).select("event_id", "unprocessed")


@query("WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(n) AS n, round(avg(value), 6)::DOUBLE AS mean, max(CASE WHEN i = least(floor(n * 0.95)::BIGINT, n - 1) THEN value END) AS p95 FROM p GROUP BY 1")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    p = T.nearest_rank(e, "event_type", "value", 0.95).withColumnRenamed("value_p", "p95")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).join(p, "event_type")


@query("SELECT user_id, arg_min(event_type, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'click' THEN 4 ELSE 5 END) AS kind FROM events GROUP BY 1")
def outcome_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.failure_of(read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind")), "user_id", ["error", "purchase", "signup", "click", "view"])


@query("SELECT sum((d = 'auto_accept')::INT)::BIGINT AS accepted, sum((d IN ('review', 'user_confirmed'))::INT)::BIGINT AS reviewed, sum((d <> 'auto_accept' OR v < 10)::INT)::BIGINT AS other FROM (SELECT ['auto_accept', 'review', 'no_match', 'user_confirmed'][event_id % 4 + 1] AS d, value AS v FROM events)")
def decision_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.get(F.array(*[F.lit(x) for x in ("auto_accept", "review", "no_match", "user_confirmed")]), (F.col("event_id") % 4).cast("int"))
    return read(spark, sf_dir, "events").select(d.alias("d"), "value").agg(F.count_if(F.col("d") == "auto_accept").alias("accepted"), F.count_if(F.col("d").isin("review", "user_confirmed")).alias("reviewed"), F.count_if((F.col("d") != "auto_accept") | (F.col("value") < 10)).alias("other"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS a FROM events), s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM r WHERE a <= 3) SELECT event_id, user_id, a AS in_front, b AS in_all FROM s WHERE b <= 6")
def rematch_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three queries per storefront and six in all, in order."""
    e = read(spark, sf_dir, "events").withColumn("in_front", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))).where("in_front <= 3")
    e = e.withColumn("in_all", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("in_all <= 6")
    return e.select("event_id", "user_id", F.col("in_front").cast("bigint").alias("in_front"), F.col("in_all").cast("bigint").alias("in_all"))


@query("WITH p AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) SELECT event_id FROM p WHERE coalesce(before, 0) < 2")
def early_stop_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps up to and with the one that brings the second hit."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum((F.col("event_type") == "purchase").cast("int")).over(w), F.lit(0))
    return read(spark, sf_dir, "events").withColumn("before", before).where("before < 2").select("event_id")


@query("SELECT user_id, arg_min(event_type, event_id) AS path FROM events GROUP BY 1")
def first_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("path"))


@query("SELECT o_custkey AS playlist, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5)::INT AS batch, o_orderkey AS track, CASE WHEN o_orderkey % 2 = 0 THEN 'library-songs' ELSE 'songs' END AS kind FROM orders")
def write_playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additions written in batches of five and read back."""
    o = read(spark, sf_dir, "orders").withColumn("kind", F.when(F.col("o_orderkey") % 2 == 0, "library-songs").otherwise("songs"))
    return W.write_batches(o, "o_custkey", "o_orderkey", "kind", 5)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 1000)")
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that is left, as written and read back."""
    gone = read(spark, sf_dir, "customer").where("c_acctbal < 1000").select(F.col("c_custkey").alias("o_custkey"))
    return W.delete_by_key(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"])[0]


@query("SELECT c_custkey AS o_custkey, count(o_orderkey) AS deleted FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 1000 GROUP BY 1")
def delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = read(spark, sf_dir, "customer").where("c_acctbal < 1000").select(F.col("c_custkey").alias("o_custkey"))
    return W.delete_by_key(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"])[1]


@query("WITH a AS (SELECT DISTINCT o_orderstatus AS s, o_custkey AS k, 1 AS x FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_orderstatus AS s, o_custkey AS k, 1 AS x FROM orders WHERE o_orderkey % 3 = 0) SELECT s AS status, sum((a.x IS NULL)::INT)::BIGINT AS added, sum((b.x IS NULL)::INT)::BIGINT AS removed, sum((a.x IS NOT NULL AND b.x IS NOT NULL)::INT)::BIGINT AS kept FROM a FULL JOIN b USING (s, k) GROUP BY 1")
def sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("status", F.col("o_orderstatus"))
    return W.sync_counts(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), "status", "o_custkey")


@query("SELECT user_id, coalesce(arg_min(value, event_id) FILTER (event_id % 3 = 0), 10.0)::DOUBLE AS retry_after FROM events WHERE event_type = 'error' GROUP BY 1")
def retry_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ordinal"), F.when(F.col("event_type") == "error", "rate_limited").otherwise("ok").alias("kind"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("retry_after"))
    return T.retry_after(e, "user_id")
