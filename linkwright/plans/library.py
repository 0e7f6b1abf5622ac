"""A listener's library: pages of it, lists, searches, files at hand, and what is added to a list while songs still arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.functions.text import normalize_plain
from linkwright.functions.titles import artist_parts, title_parts
from linkwright.plans.search import best_in_library
from linkwright.sources.store import Tables, saved

# What is shown for fields that a song doesn't have, and language tags of storefronts.
SHOWN = {"title": "未知歌曲", "artist": "未知歌手", "album": "未知专辑"}
LANGUAGES = {"cn": ["zh-Hans-CN", "en-US"], "jp": ["ja-JP", "en-US"], "us": ["en-US", "es-MX"], "tw": ["zh-Hant-TW", "en-US"], "hk": ["zh-Hant-HK", "en-US"], "gb": ["en-GB"], "ca": ["en-CA", "fr-CA"], "kr": ["ko-KR", "en-US"]}
#: Rows of a page, and of all pages of a reading from start to end.
PAGE, MOST = 100, 5_000
#: Longest pieces of a title by which files are looked up.
PIECE = 3


def shown(songs: DataFrame) -> DataFrame:
    """Songs with what is shown for a missing title, artist or album."""
    return songs.withColumns({c: F.coalesce(c, F.lit(other)) for c, other in SHOWN.items() if c in songs.columns})


def order_of(sort: str) -> list[Column]:
    """Newest or oldest first, or by name either way; ties by id, songs without a date or name last."""
    column = {"dateAdded": "date_added", "name": "title"}.get(sort.lstrip("-"))
    if column is None:
        raise ValueError(f"unknown order: {sort}")
    return [F.col(column).desc_nulls_last() if sort.startswith("-") else F.col(column).asc_nulls_last(), F.col("id").asc()]


def page(songs: DataFrame, sort: str = "-dateAdded", offset: int = 0, limit: int = PAGE, everything: bool = False) -> DataFrame:
    """A page of (id, title, artist, album, date_added, ...) with ``rank``, the place in the whole order from 0; ``everything`` reads on to ``MOST`` songs.

    Only the rows up to the page's end are ordered, and only its own are numbered.
    """
    size = MOST if everything else min(limit, PAGE)
    by = order_of(sort)
    own = songs.orderBy(*by).offset(offset).limit(size)
    return shown(own.withColumn("rank", (F.row_number().over(Window.orderBy(*by)) - 1 + offset).cast("bigint")))


def list_tracks(entries: DataFrame, everything: bool = True, limit: int = PAGE, by: str = "playlist", place: str = "place") -> DataFrame:
    """The tracks of each list in order, up to ``MOST`` (or one page) of a list, with ``rank`` from 0."""
    size = MOST if everything else min(limit, PAGE)
    w = Window.partitionBy(by).orderBy(place)
    return shown(entries.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < size))


def found(songs: DataFrame, term: str | None, limit: int = PAGE) -> DataFrame:
    """Songs whose title, artist or album holds the term, whatever its case; the first by id. A blank term finds nothing."""
    asked = (term or "").strip().lower()
    held = [F.coalesce(F.contains(F.lower(c), F.lit(asked)), F.lit(False)) for c in ("title", "artist", "album")]
    hits = songs.where(held[0] | held[1] | held[2]) if asked else songs.limit(0)
    return shown(hits.orderBy("id").limit(min(limit, PAGE)))


def languages(front: Column, told: Column) -> Column:
    """Language tags of a storefront: those that it told, the known ones, or its own name and English. No storefront is that of China."""
    name = F.coalesce(F.nullif(F.lower(F.trim(front)), F.lit("")), F.lit("cn"))
    known = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(t) for t in x]) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.when(F.size(told) > 0, told), F.try_element_at(known, name), F.array(name, F.lit("en-US")))


def _pieces(text: Column, size: Column) -> Column:
    """The distinct pieces of ``size`` letters; none if the text is shorter."""
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, size)))).otherwise(F.array().cast("array<string>"))


def files_at_hand(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """(id, title, artist) and (path, tier, readable) -> id, path, tier: the first file of each track, by tier and path.

    A file's name must hold the title, as parsed or as it is. In tier 0, the media library, the artist must stand in the
    path; in later ones it may be missing if the title stands in the name as parsed. Files that can't be read are passed over. Holding is no
    equality, so titles meet the files that have their rarest piece of three letters (of all letters, if they have fewer); a title with a piece that no file has is in none.
    Tracks of one title and artist are looked up once, and rows of one path and tier are one file.
    """
    with Tables() as tables:
        core, artist = title_parts("title")["core"], F.when(F.length(F.trim(F.coalesce("artist", F.lit("")))) > 0, artist_parts(F.array("artist"))["primary"])
        lower = lambda c: F.trim(F.lower(F.coalesce(c, F.lit(""))))
        asked = tables.save(tracks.select("title", "artist").distinct(), "asked")
        t = tables.save(asked.select(F.col("title").alias("_title"), F.col("artist").alias("_artist"), lower(core).alias("clean"), normalize_plain(F.col("title")).alias("norm"), lower(artist).alias("artist")), "wanted")
        path = F.lower("path")
        f = files.where("readable").select("path", "tier").distinct().select("path", "tier", path.alias("_path"), normalize_plain(F.substring_index("path", "/", -1)).alias("_name"))
        f = tables.save(f.withColumn("_stem", F.regexp_replace(F.lower(F.substring_index("path", "/", -1)), r"\.[^.]*$", "")), "files")
        pieces = F.array_distinct(F.flatten(F.array(*[_pieces(F.col("_name"), F.lit(n)) for n in range(1, PIECE + 1)])))
        names = tables.save(f.dropDuplicates(["path"]).select("path", F.explode(pieces).alias("piece")), "pieces")
        forms = t.select(F.explode(F.array("clean", "norm")).alias("form")).where("form != ''").distinct()
        own = forms.select("form", F.explode(_pieces(F.col("form"), F.least(F.lit(PIECE), F.length("form")))).alias("piece"))
        often = own.join(names.groupBy("piece").agg(F.count("*").alias("df")), "piece", "left")
        rarest = often.groupBy("form").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "piece")).alias("k")).where("k.df > 0").select("form", F.col("k.piece").alias("piece"))
        hits = rarest.join(names, "piece").join(f, "path").where(F.contains("_name", F.col("form"))).select("form", "path", "tier", "_path", "_name", "_stem")
        both = t.withColumn("form", F.explode(F.array_distinct(F.array("clean", "norm")))).join(hits, "form")
        named = (F.col("artist") == "") | F.contains("_name", F.col("artist"))
        library = named | F.contains("_path", F.col("artist"))
        other = named | (F.col("clean") == "") | F.contains("_stem", F.col("clean"))
        kept = both.where(F.when(F.col("tier") == 0, library).otherwise(other))
        best = kept.groupBy("_title", "_artist").agg(F.min(F.struct("tier", "path")).alias("m"))
        own = tracks.join(best, F.col("title").eqNullSafe(F.col("_title")) & F.col("artist").eqNullSafe(F.col("_artist")))
        return saved(own.groupBy("id").agg(F.min("m").alias("m")).select("id", "m.path", "m.tier"), "at-hand")


def synced(items: DataFrame, library_at: Callable[[int], DataFrame], tries: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is added to lists while some songs are still on their way into the library: (additions, pending, counts), written tables.

    ``items`` are (list, place, id, title, artist, local). Songs of the catalog are added by their id, those
    without one are left out. Local ones are added by their id if it is one of the library ("i."), else by the library's best song,
    looked up in ``library_at(n)`` (song_id, title, artist), the library at the n-th try; only those still pending are looked up
    again. ``additions`` are (list, ord, song_id): the catalog's in order, then the local ones by try and place, each once a list. ``counts`` are
    (list, added, local_added, local_pending), with repeated local items counted each.
    """
    with Tables() as tables:
        given = tables.save(items.withColumn("_id", F.col("id").cast("string")).withColumn("_local", F.coalesce("local", F.lit(False))), "given")
        local = given.where("_local").select("list", "place", "_id", "title", F.coalesce("artist", F.lit("")).alias("artist"))
        own = F.coalesce(F.startswith("_id", F.lit("i.")), F.lit(False))
        done = local.where(own).select("list", "place", F.lit(1).alias("tried"), F.col("_id").alias("song_id"))
        pending = tables.save(local.where(~own), "pending")
        for n in range(1, tries + 1):
            if pending.isEmpty():
                break
            asked = pending.select(F.struct("list", "place").alias("id"), "list", "place", "title", "artist")
            hits = tables.save(asked.join(best_in_library(asked.select("id", "title", "artist"), library_at(n)).select("id", "song_id"), "id").select("list", "place", F.lit(n).alias("tried"), F.col("song_id").cast("string").alias("song_id")), f"found-{n}")
            done = done.unionByName(hits)
            pending = tables.save(pending.join(hits, ["list", "place"], "left_anti"), f"pending-{n}")
        catalog = given.where("not _local and coalesce(_id, '') != ''").select("list", "place", F.lit(0).alias("tried"), F.col("_id").alias("song_id"))
        firsts = catalog.unionByName(done).groupBy("list", "song_id").agg(F.min(F.struct("tried", "place")).alias("o"))
        additions = saved(firsts.select("list", F.row_number().over(Window.partitionBy("list").orderBy("o", "song_id")).alias("ord"), "song_id"), "added")
        left = saved(pending.select("list", "place", "title", "artist"), "left")
        some = lambda df, name: df.groupBy("list").agg(F.count("*").alias(name))
        counts = given.select("list").distinct()
        for part in (some(additions, "added"), some(done, "local_added"), some(left, "local_pending")):
            counts = counts.join(part, "list", "left")
        return additions, left, saved(counts.fillna(0), "counts")
