"""Readers of lists of tracks: text lines, CSV, pasted text, and platform payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.functions.text import present, strip

TITLE_NAMES = ["title", "name", "track", "歌名", "标题"]
ARTIST_NAMES = ["artist", "artists", "singer", "歌手", "艺人"]


def source_of(text: Column) -> Column:
    """Which reader takes an input; the first that matches."""
    t = F.trim(text)
    return (
        F.when(F.regexp_like(t, F.lit(r"163\.com|163cn\.tv")) | F.regexp_like(t, F.lit(r"^[0-9]{6,}$")), "netease")
        .when(F.regexp_like(t, F.lit(r"y\.qq\.com|c6\.y\.qq\.com")), "qq")
        .when(F.regexp_like(t, F.lit(r"open\.spotify\.com|^spotify:")), "spotify")
        .when(F.regexp_like(t, F.lit(r"(?i)\.(?:txt|csv)$")), "file")
    )


def track_line(line: Column, delimiters: tuple[str, ...] = (" - ", "\t", ",")) -> Column:
    """struct(title, artists) of a line: the first delimiter that is present splits once."""
    t = strip(line)
    title, artist = t, F.lit(None).cast("string")
    for d in reversed(delimiters):
        at = F.instr(t, d)
        title = F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(title)
        artist = F.when(at > 0, F.substring(t, at + len(d), F.length(t))).otherwise(artist)
    artists = F.filter(F.transform(F.split(F.coalesce(artist, F.lit("")), "/"), lambda a: strip(a)), lambda a: a != "")
    return F.struct(strip(title).alias("title"), artists.alias("artists"))


def parse_lines(lines: DataFrame, column: str, delimiters: tuple[str, ...] = (" - ", "\t", ",")) -> DataFrame:
    """Lines that aren't blank or comments, with title and artists."""
    return lines.where((strip(F.col(column)) != "") & ~F.startswith(strip(F.col(column)), F.lit("#"))).withColumn("_t", track_line(F.col(column), delimiters)).select("*", "_t.title", "_t.artists").drop("_t")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path), "value").select("title", "artists")


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Files with or without a header, each by its own first row; a byte order mark is no part of the first name. Without a header the columns are title, artist.

    ``multi_line`` allows line breaks inside quotes, for which a file is read by one task. ``line`` orders the rows of a file.
    """
    # no line has more columns than this, so no header has
    widest = spark.read.text(path).agg(F.max(F.size(F.split("value", ",")))).first()[0]
    columns = [f"c{i}" for i in range(max(2, widest or 0))]
    reader = spark.read.schema(", ".join(f"{c} string" for c in columns)).option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    raw = reader.csv(path).select(F.array(*columns).alias("v"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    tidy = F.transform("v", lambda x: F.lower(strip(F.replace(F.coalesce(x, F.lit("")), F.lit("\ufeff"), F.lit("")))))
    # rows of one file are numbered in its order, so the first has the least number
    first = raw.groupBy("file").agg(F.min(F.struct("at", "v")).alias("f")).select("file", "f.at", F.col("f.v").alias("v")).select("file", F.col("at").alias("first"), tidy.alias("names"))
    known = F.array(*[F.lit(n) for n in TITLE_NAMES + ARTIST_NAMES])
    rows = raw.join(first.withColumn("header", F.arrays_overlap("names", known)), "file").where(~F.col("header") | (F.col("at") != F.col("first")))

    def pick(wanted: list[str], place: int | None) -> Column:
        named = F.filter(F.transform("names", lambda n, i: F.when(n.isin(*wanted), i)), lambda i: i.isNotNull())
        at = F.when(F.col("header"), F.get(named, F.lit(0))).otherwise(F.lit(place).cast("int"))
        return F.replace(F.get(F.col("v"), at), F.lit("\ufeff"), F.lit(""))

    artists = F.filter(F.transform(F.split(F.coalesce(pick(ARTIST_NAMES, 1), F.lit("")), "/"), lambda a: strip(a)), lambda a: a != "")
    out = rows.select(F.coalesce(strip(pick(TITLE_NAMES, 0)), F.lit("")).alias("title"), artists.alias("artists"), present(pick(["album", "专辑"], None)).alias("album"), F.upper(present(pick(["isrc"], None))).alias("isrc"), (F.col("at") - F.col("first")).alias("line"), "header")
    # a file with a header has tracks in named columns; one without is a list, whose rows all count
    return out.where("title != '' or not header").drop("header")


NETEASE = "struct<songs:array<struct<id:bigint,name:string,ar:array<struct<name:string>>,al:struct<name:string>,dt:bigint,tns:array<string>,alia:array<string>>>>"
QQ = "struct<songlist:array<struct<songname:string,name:string,title:string,singer:array<struct<name:string>>,albumname:string,album:struct<name:string>,interval:bigint,songmid:string,songid:string,isrc:string,subtitle:string>>>"
SPOTIFY = "struct<items:array<struct<track:struct<id:string,name:string,artists:array<struct<name:string>>,album:struct<name:string>,duration_ms:bigint,external_ids:struct<isrc:string>>>>,next:string>"


def netease_tracks(payloads: DataFrame, column: str) -> DataFrame:
    s = payloads.select(F.posexplode(F.from_json(F.col(column), NETEASE)["songs"]).alias("pos", "s"))
    return s.select("pos", F.col("s.name").alias("title"), F.col("s.ar.name").alias("artists"), F.col("s.al.name").alias("album"), F.col("s.dt").alias("duration_ms"), F.lit(None).cast("string").alias("isrc"), F.col("s.id").cast("string").alias("original_id"), F.get("s.tns", F.lit(0)).alias("trans_title"), F.coalesce("s.alia", F.array().cast("array<string>")).alias("aliases"))


def qq_tracks(payloads: DataFrame, column: str) -> DataFrame:
    s = payloads.select(F.posexplode(F.from_json(F.col(column), QQ)["songlist"]).alias("pos", "s"))
    first = lambda *cs: F.coalesce(*[present(F.col(f"s.{c}")) for c in cs])
    sub = present(F.col("s.subtitle"))
    return s.select("pos", first("songname", "name", "title").alias("title"), F.col("s.singer.name").alias("artists"), first("albumname", "album.name").alias("album"), (F.col("s.interval") * 1000).alias("duration_ms"), F.when(F.length(first("isrc")) >= 8, F.upper(first("isrc"))).alias("isrc"), first("songmid", "songid").alias("original_id"), sub.alias("trans_title"), F.filter(F.array(sub), lambda x: x.isNotNull()).alias("aliases"))


def spotify_tracks(payloads: DataFrame, column: str) -> DataFrame:
    """All tracks of pages of items; items without a track are left out."""
    s = payloads.select(F.posexplode(F.from_json(F.col(column), SPOTIFY)["items"]).alias("pos", "i")).where("i.track is not null").select("pos", F.col("i.track").alias("s"))
    return s.select("pos", F.col("s.name").alias("title"), F.col("s.artists.name").alias("artists"), F.col("s.album.name").alias("album"), F.col("s.duration_ms"), F.upper(F.col("s.external_ids.isrc")).alias("isrc"), F.col("s.id").alias("original_id"))


EMBED = "struct<props:struct<pageProps:struct<state:struct<data:struct<entity:struct<name:string,trackList:array<struct<title:string,subtitle:string,duration:bigint,uri:string>>>>>>>>"
#: Embed pages list fewer tracks than this.
EMBED_MOST = 100


def embed_tracks(pages: DataFrame, key: str, html: str, total: str) -> DataFrame:
    """Tracks in the page data of embed pages: key, pos, title, artists, duration_ms, original_id.

    A page counts only if it lists some tracks, fewer than ``EMBED_MOST``, and no fewer than its ``total`` says (null: unknown).
    """
    data = F.regexp_extract(html, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    listed = F.from_json(data, EMBED)["props"]["pageProps"]["state"]["data"]["entity"]["trackList"]
    whole = pages.select(F.col(key).alias("key"), listed.alias("l"), F.col(total).alias("total")).where((F.size("l") > 0) & (F.size("l") < EMBED_MOST) & (F.col("total").isNull() | (F.size("l") >= F.col("total"))))
    t = whole.select("key", F.posexplode("l").alias("pos", "t"))
    artists = F.filter(F.transform(F.split(F.coalesce("t.subtitle", F.lit("")), ","), lambda a: strip(F.replace(a, F.lit("\u00a0"), F.lit(" ")))), lambda a: a != "")
    return t.select(F.col("key").alias(key), "pos", F.col("t.title").alias("title"), artists.alias("artists"), F.col("t.duration").alias("duration_ms"), F.element_at(F.split("t.uri", ":"), -1).alias("original_id"))


def playlist_id(text: Column) -> Column:
    """The id in a link or share text of any platform."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"[?&]id=([0-9]+)", r"playlist/([A-Za-z0-9]+)", r"/playsquare/([0-9]+)", r"^([0-9]{6,})$")]
    return F.coalesce(*found)


def catalog_items(payloads: DataFrame, column: str) -> DataFrame:
    """Nested catalog items, flat: first preview, first album, all artist ids."""
    shape = "struct<id:string,attributes:struct<name:string,artistName:string,albumName:string,durationInMillis:bigint,isrc:string,previews:array<struct<url:string>>>,relationships:struct<artists:struct<data:array<struct<id:string>>>,albums:struct<data:array<struct<id:string>>>>>"
    i = payloads.select(F.from_json(F.col(column), shape).alias("i"))
    return i.select("i.id", F.col("i.attributes.name").alias("title"), F.col("i.attributes.artistName").alias("artist"), F.col("i.attributes.albumName").alias("album"), F.col("i.attributes.durationInMillis").alias("duration_ms"), F.col("i.attributes.isrc").alias("isrc"), F.get("i.attributes.previews", F.lit(0))["url"].alias("preview_url"), F.col("i.relationships.artists.data.id").alias("artist_ids"), F.get("i.relationships.albums.data", F.lit(0))["id"].alias("album_id"))


def audio_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("mp3", "m4a", "flac", "wav", "aac", "ogg", "wma")) -> DataFrame:
    """Files below a folder: title and artist from "Artist - Title" names, the newest of each kept (of equally new ones the last path); a missing time is the oldest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    files = files.withColumn("ext", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))).where(F.col("ext").isin(*extensions))
    name = F.regexp_extract(F.url_decode("path"), r"([^/]+)\.[A-Za-z0-9]+$", 1)
    named = files.withColumn("title", F.when(name.contains(" - "), F.substring_index(name, " - ", -1)).otherwise(name)).withColumn("artist", F.when(name.contains(" - "), F.substring_index(name, " - ", 1)).otherwise(""))
    return named.groupBy(F.lower("title").alias("t"), F.lower("artist").alias("a")).agg(F.max_by(F.struct("path", "title", "artist", "modificationTime", "length"), F.struct(F.coalesce("modificationTime", F.lit(0).cast("timestamp")), "path")).alias("f")).select("f.*")
