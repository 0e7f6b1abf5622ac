"""Searches for videos of tracks: queries in order, until enough of the first tier are found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwright.operators import score as S
from linkwright.operators import tables as T
from linkwright.sources.store import Tables, saved

#: So many videos of the first tier end the searches of a track.
ENOUGH = 4
LIMIT = 8
#: A bracket without brackets in it.
_INNER = r"[(（【\[][^()（）【】\[\]]*[)）】\]]"


def queries(tracks: DataFrame) -> DataFrame:
    """(id, title, artist) -> id, ord, query, sorting: by relevance or by clicks, with the first artist before and after the title, then the title alone.

    Quotes and brackets, nested ones too, are left out of titles unless nothing else is left.
    """
    quoted = F.regexp_replace(F.coalesce("title", F.lit("")), "[《》「」『』\"“”'‘’]", " ")
    depth = F.size(F.regexp_extract_all(quoted, F.lit(r"[)）】\]]"), F.lit(0)))
    bare = F.aggregate(F.sequence(F.lit(0), depth), quoted, lambda t, _: F.regexp_replace(t, _INNER, " "))
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), r"\s*[-–—/]\s*$", ""))
    title = F.when(bare != "", bare).otherwise(F.trim(F.coalesce("title", F.lit(""))))
    first = F.regexp_extract(F.regexp_replace(F.coalesce("artist", F.lit("")), "[/\\\\,，、&]", " "), r"^\s*(\S+)", 1)
    t = tracks.select("id", title.alias("title"), first.alias("first"))
    asked = lambda text, sorting: F.struct(text.alias("query"), F.lit(sorting).alias("sorting"))
    alone = [asked(F.col("title"), "relevance"), asked(F.col("title"), "clicks")]
    named = [asked(F.trim(F.concat_ws(" ", "first", "title")), "relevance"), asked(F.trim(F.concat_ws(" ", "title", "first")), "clicks")]
    listed = F.when(F.col("first") != "", F.array(*named, *alone)).otherwise(F.array(*alone))
    return t.select("id", F.posexplode(listed).alias("pos", "q")).select("id", (F.col("pos") + 1).alias("ord"), "q.query", "q.sorting").where("query != ''")


def first_seen(hits: DataFrame) -> DataFrame:
    """Of hits (id, ord, hit, media, tier, plays, seconds) that may be recordings the first of each track's video; those without an id of the video are none."""
    return T.first_of(hits.where(F.coalesce(F.col("media").cast("string") != "", F.lit(False)) & S.length_gate(F.col("seconds"))), ["id", "media"], [F.col("ord"), F.col("hit")])


def ranked(seen: DataFrame, limit: int = LIMIT, enough: int = ENOUGH) -> DataFrame:
    """(id, rank, media, score, way, searches) of first_seen() hits: those of searches up to the one that makes ``enough`` of the first tier, by score, then by arrival; of videos that one hit brings the larger id comes first, so reruns agree.

    ``searches`` is the ordinal of the last search with a video that counts. Videos are counted by search before searches are put in order, so no track's hits are sorted whole.
    """
    each = seen.groupBy("id", "ord").agg(F.count_if(F.col("tier") == 1).alias("n"))
    so_far = each.withColumn("all", F.sum("n").over(Window.partitionBy("id").orderBy("ord")))
    ends = so_far.groupBy("id").agg(F.coalesce(F.min(F.when(F.col("all") >= enough, F.col("ord"))), F.max("ord")).alias("searches"))
    kept = seen.join(ends, "id").where(F.col("ord") <= F.col("searches")).withColumn("score", S.media_score(F.col("tier"), F.col("plays"), F.col("seconds")))
    w = Window.partitionBy("id").orderBy(F.col("score").desc(), "ord", "hit", F.col("media").desc())
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("id", "rank", "media", "score", S.fetch_gate(F.col("tier")).alias("way"), "searches")


def stepwise(asked: DataFrame, find: Callable[[DataFrame], DataFrame], limit: int = LIMIT, enough: int = ENOUGH, steps: list[int] | None = None) -> DataFrame:
    """ranked() of what ``find`` returns for queries(), one ordinal at a time and only for tracks that haven't enough: the same rows as of all searches at once.

    ``find`` takes rows of ``asked`` and returns hits. ``steps`` gets how many queries each phase asked. Returns a written table.
    """
    with Tables() as tables:
        asked = tables.save(asked, "media-queries")
        last = asked.agg(F.max("ord")).first()[0] or 0
        done, hits = None, find(asked.limit(0))
        seen = tables.save(first_seen(hits), "media-seen")
        for n in range(1, last + 1):
            now = asked.where(F.col("ord") == n)
            now = now if done is None else now.join(done, "id", "left_anti")
            if steps is not None:
                steps.append(now.count())
            seen = tables.save(first_seen(seen.unionByName(find(now).select(seen.columns))), "media-seen")
            done = tables.save(seen.where("tier = 1").groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= enough).select("id"), "media-done")
            if asked.where(F.col("ord") > n).join(done, "id", "left_anti").isEmpty():
                break
        return saved(ranked(seen, limit, enough), "media")
