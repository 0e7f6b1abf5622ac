"""Keys, deduplication, ordinals, states and keyed result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.functions.text import usable_id, usable_isrc
from linkwright.sources.store import saved


def stable_key(isrc: Column, source: Column, original_id: Column, *recording: Column) -> Column:
    """The code if usable, else source and id, else the recording's own fields."""
    parts = F.concat_ws("\x1f", F.lit("recording"), *[F.coalesce(r.cast("string"), F.lit("")) for r in recording])
    return F.when(usable_isrc(isrc), F.concat_ws("\x1f", F.lit("isrc"), F.upper(F.trim(isrc)))).when(usable_id(original_id, source), F.concat_ws("\x1f", source, F.trim(original_id.cast("string")))).otherwise(parts)


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key. The minimum of a struct is pre-aggregated, so a hot key isn't sorted in one task."""
    rest = [c for c in df.columns if c not in key]
    marks = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    return df.groupBy(*key).agg(F.min(F.struct(*marks, *rest)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def dealt(df: DataFrame) -> DataFrame:
    """Rows spread over all cores however few bytes they have, for parsers, whose cost is not in bytes."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def upsert(table: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """The last write of every key: changes replace rows of the table, later changes earlier ones."""
    rest = [c for c in changes.columns if c not in key]
    last = changes.groupBy(*key).agg(F.max(F.struct(version, *[c for c in rest if c != version])).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return table.join(last, key, "left_anti").unionByName(last, allowMissingColumns=True)


def valid_at(table: DataFrame, now: Column) -> DataFrame:
    """Rows that have not expired; a row that expires now has."""
    return table.where(F.col("expires_at") > now)


def cache_state(row_version: dict[str, Column], current: dict[str, Column], decision: Column) -> Column:
    """What to do with a stored result: use, rescore or miss.

    Manual decisions are used as they are. Old policies or aliases drop review and
    no_match, an old scoring drops no_match; what stays is rescored.
    """
    differs = {k: row_version[k] != current[k] for k in row_version}
    any_old = F.lit(False)
    for d in differs.values():
        any_old = any_old | d
    dropped = (differs["policy"] | differs["alias"]) & decision.isin("review", "no_match") | differs["scoring"] & (decision == "no_match")
    return F.when(decision == "user_confirmed", "use").when(dropped, "miss").when(any_old, "rescore").otherwise("use")


def chunked(df: DataFrame, order: str, size: int, group: str) -> DataFrame:
    """Adds the number of the chunk of ``size`` rows within the group."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def rolling_count(df: DataFrame, group: str, ts: str, seconds: int) -> DataFrame:
    """Adds how many rows of the group fall in the last ``seconds``, the row itself included; the far end is open.

    Time is cut into stretches of that length. A moment's rows are those of its stretch up to it and those of the stretch before that are
    less than ``seconds`` away: running counts of distinct moments, each read once, so neither many rows within ``seconds`` nor at one moment cost more than their number.
    """
    micros = seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    moments = df.select(F.col(group).alias("_g"), at.alias("_at")).groupBy("_g", "_at").agg(F.count("*").alias("_c"))
    # each moment also asks the stretch before, at the same place in it, where it counts nothing
    points = moments.select("_g", F.explode(F.array(F.struct(F.col("_at").alias("_place"), F.lit(0).cast("long").alias("_later"), F.col("_c")), F.struct((F.col("_at") - micros).alias("_place"), F.lit(micros).cast("long").alias("_later"), F.lit(0).cast("long").alias("_c")))).alias("_p")).select("_g", "_p.*").where("_place is not null or _later = 0")
    w = Window.partitionBy("_g", F.floor(F.col("_place") / micros))
    up_to = F.sum("_c").over(w.orderBy("_place").rangeBetween(Window.unboundedPreceding, 0))
    seen = points.withColumn("_n", F.when(F.col("_later") == 0, up_to).otherwise(F.sum("_c").over(w) - up_to))
    counts = seen.groupBy("_g", (F.col("_place") + F.col("_later")).alias("_at")).agg(F.sum("_n").alias("recent"))
    both = df.withColumn("_own", at).join(counts, F.col(group).eqNullSafe(F.col("_g")) & F.col("_own").eqNullSafe(F.col("_at")))
    return both.drop("_own", "_g", "_at")


def failure_runs(df: DataFrame, group: str, order: str, failed: Column) -> DataFrame:
    """Adds the length of the run of failures that ends at each row; a success resets it."""
    w = Window.partitionBy(group).orderBy(order)
    out = df.withColumn("_failed", failed).withColumn("_island", F.sum(F.when(F.col("_failed"), 0).otherwise(1)).over(w))
    inside = Window.partitionBy(group, "_island").orderBy(order)
    return out.withColumn("run", F.sum(F.col("_failed").cast("int")).over(inside)).drop("_failed", "_island")


def aborted_after(df: DataFrame, group: str, order: str, fatal: Column) -> DataFrame:
    """Adds whether an earlier row of the group was fatal."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("unprocessed", F.coalesce(F.max(fatal).over(w), F.lit(False)))


def nearest_rank(df: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """The value at the 0-based place min(floor(n * share), n - 1) of each group in order.

    Equal values are counted first, and running totals are taken by ranges of values, so a group with most of the rows isn't sorted in one task.
    """
    counted = df.groupBy(group, value).agg(F.count("*").alias("_c"))
    dealt = saved(counted.repartitionByRange(F.col(group), F.col(value)).withColumn("_range", F.spark_partition_id()), "ranges")
    placed = running_total(dealt, [group], "_range", [F.col(value)], F.col("_c"), "_before")
    wanted = dealt.groupBy(F.col(group).alias("_g")).agg(F.sum("_c").alias("_n")).withColumn("_place", F.least(F.floor(F.col("_n") * share), F.col("_n") - 1))
    both = placed.join(wanted, F.col(group).eqNullSafe(F.col("_g")))
    return both.where((F.col("_before") <= F.col("_place")) & (F.col("_place") < F.col("_before") + F.col("_c"))).select(group, F.col(value).alias(f"{value}_p"))


def running_total(df: DataFrame, group: list[str], chunk: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each row of its group.

    Rows are ordered by ``chunk`` (a column that cuts a group into even pieces)
    and then by ``order``. Only the sums of chunks meet in one place: a group of
    any size is spread over its chunks.
    """
    valued = df.withColumn("_v", value)
    sums = valued.groupBy(*group, chunk).agg(F.sum("_v").alias("_s"))
    each = Window.partitionBy(*[F.col(g) for g in group]).orderBy(chunk)
    sums = sums.withColumn("_sums_before", F.coalesce(F.sum("_s").over(each.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*[F.col(g) for g in group], F.col(chunk)).orderBy(*order)
    valued = valued.withColumn("_in", F.coalesce(F.sum("_v").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = valued.alias("a").join(sums.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group, chunk)])
    return both.select("a.*", (F.col("b._sums_before") + F.col("a._in")).cast("long").alias(name)).drop("_v", "_in")


def merge_schema(*tables: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Union of tables of different ages; missing columns get defaults."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    for c, v in (defaults or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), v) if c in out.columns else v)
    return out


def failure_of(outcomes: DataFrame, key: str, kinds: list[str], default: str = "no_match") -> DataFrame:
    """(key, kind): of each key's outcomes (key, kind) the kind that stands first in ``kinds``; ``default`` where it has none of them."""
    place = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    gravest = F.min(F.when(place > 0, F.struct(place.alias("place"), "kind")))
    return outcomes.groupBy(key).agg(F.coalesce(gravest.getField("kind"), F.lit(default)).alias("kind"))


def retry_after(outcomes: DataFrame, key: str, default: float = 10.0) -> DataFrame:
    """(key, retry_after): the wait that the first rate-limited outcome with one asks for, for keys with a rate-limited outcome."""
    limited = outcomes.where("kind = 'rate_limited'")
    first = F.min(F.when(F.col("retry_after").isNotNull(), F.struct("ordinal", "retry_after")))
    return limited.groupBy(key).agg(F.coalesce(first.getField("retry_after").cast("double"), F.lit(default)).alias("retry_after"))
