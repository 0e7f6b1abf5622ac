"""Text functions over the given tables; where these have no such text, over templates that each row's name goes into."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkwright.functions import arrow, notes, text, titles
from linkwright.operators import readings
from linkwright.queries.registry import query, read, worded, worded_sql
from linkwright.sources import payloads, readers, store

NOTES = ["Live", "{n} Remix", "2024 Acoustic Live", "Live at {n}", "The {n}", "Japanese Ver. Live", "feat. {n}", "吉他版", "Recorded at {n}", "{n} Tour Live", "Guitar Ver.", "{n} and Let Die", "ost", "Theme Song from {n}", "《{n}》电视剧片头曲", "电影插曲", "{n}", "演唱会", "a {n} mix", "x"]
NO_NOTES, WORKS = {4, 11, 16, 18}, {12, 13, 14, 15}
KANA = ["さくら {n}", "サクラ {n}", "カタカナ と {n}", "夜に {n}", "{n}", "前前前世", "ミラージュ {n}", "コーヒー {n}", "きゃっと {n}", ""]
HIRAGANA = ["さくら {n}", "さくら {n}", "かたかな と {n}", "夜に {n}", "{n}", "前前前世", "みらーじゅ {n}", "こーひー {n}", "きゃっと {n}", ""]
ROMAJI = ["sakura {n}", "sakura {n}", "katakana to {n}", "夜ni {n}", "{n}", "前前前世", "miraju {n}", "kohi {n}", "kyatto {n}", ""]
PAIRS = ["不虚此行 {n}", "{n} 复梦天使", "夜に駆ける {n}", "{n}", "歌 OP 1", "夜曲 live", "晴天 {n} Day"]
BRACKETS = ["夜に駆ける ({n})", "{n} [スパークル]", "{n} (Live)", "{n}", "{n} (x)", "{n} （现场版）", "{n} (D E) f"]


@query("SELECT p_partkey, trim(lower(p_name)) AS norm, regexp_replace(trim(regexp_replace(p_brand || ' (' || p_type || ')', '[()\\[\\]\"]', ' ', 'g')), '\\s+', ' ', 'g') AS phrase FROM part")
def normalize_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", text.normalize_plain(F.col("p_name")).alias("norm"), text.query_text(F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")"))).alias("phrase"))


@query("SELECT page_id, regexp_replace(trim(regexp_replace(url, '[()\\[\\]\"]', ' ', 'g')), '\\s+', ' ', 'g') AS phrase FROM pages")
def clean_query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.query_text(F.col("url")).alias("phrase"))


@query("SELECT doc_id, md5(strip_accents(text)) AS plain FROM documents")
def strip_diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(arrow.strip_diacritics("text")).alias("plain"))


@query(worded_sql(norm=["abc {n}", "{n} 1", "fine {n}", "{n}", "x y {n}"]))
def normalize_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worded(spark, sf_dir, v=["ＡＢＣ {n}", "{n} ①", "ﬁne {n}", "　{n}　", "Ｘ Y {n}"]).select("id", arrow.normalize_nfkc("v").alias("norm"))


@query("SELECT doc_id, translate(text, 'éèü', 'eeu') AS mapped FROM documents")
def trad_to_simp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one character substitution with a table given as a parameter (here three letters)."""
    return read(spark, sf_dir, "documents").select("doc_id", F.translate("text", "éèü", "eeu").alias("mapped"))


@query(worded_sql(hira=HIRAGANA))
def kana_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worded(spark, sf_dir, v=KANA).select("id", text.swap_kana(F.col("v"), True).alias("hira"))


SCRIPT_SQL = """SELECT id, hiragana, katakana, han, latin, CASE WHEN v = '' THEN 0.0 WHEN hiragana AND katakana THEN 1.0 WHEN hiragana THEN 0.95 WHEN katakana THEN 0.9 WHEN han THEN 0.35 WHEN latin THEN 0.1 ELSE 0.05 END::DOUBLE AS japanese,
 han AND NOT hiragana AND NOT katakana AS ambiguous FROM (SELECT id, v, regexp_matches(v, '[\\x{3040}-\\x{309F}]') AS hiragana, regexp_matches(v, '[\\x{30A0}-\\x{30FF}]') AS katakana, regexp_matches(v, '[\\x{4E00}-\\x{9FFF}]') AS han, regexp_matches(v, '[a-zA-Z]') AS latin FROM """


@query(SCRIPT_SQL + f"({worded_sql(v=KANA)} UNION ALL SELECT -1 - doc_id, text FROM documents))")
def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("id"), F.col("text").alias("v"))
    return worded(spark, sf_dir, v=KANA).unionByName(d).select("id", text.script_profile(F.col("v")).alias("s")).select("id", "s.*")


@query("SELECT page_id, len(regexp_split_to_array(replace(url, '/', ' - '), '\\s+[-/]\\s+')) AS n, regexp_split_to_array(replace(url, '/', ' - '), '\\s+[-/]\\s+')[1] AS head FROM pages")
def split_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.segments(F.replace("url", F.lit("/"), F.lit(" - ")))
    return read(spark, sf_dir, "pages").select("page_id", F.size(s).cast("bigint").alias("n"), F.element_at(s, 1).alias("head"))


@query(worded_sql(v=NOTES, note=[i not in NO_NOTES for i in range(len(NOTES))], work=[i in WORKS for i in range(len(NOTES))]))
def version_note_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worded(spark, sf_dir, v=NOTES).select("id", "v", notes.is_note(F.col("v")).alias("note"), notes.is_work_source(F.col("v")).alias("work"))


@query("SELECT p_partkey, regexp_matches(p_name || ' ost from ' || p_type, '(?i)(theme\\s+song|insert\\s+song|soundtrack|ost)\\s+(from|for|of)\\b') AS work FROM part")
def work_source_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", notes.is_work_source(F.concat("p_name", F.lit(" ost from "), "p_type")).alias("work"))


TITLES = ["{n} (Live) (feat. Ana {n})", "夜に駆ける ({n})", "{n} - Remix", "{n} (《{n}》电影主题曲)", "{n} [Cover: Someone]", "{n}", "{n} – {n}", "{n} (Japanese Ver.)", "{n} Guitar", ""]


@query(worded_sql(core=["{n}", "夜に駆ける", "{n}", "{n}", "{n}", "{n}", "{n}", "{n}", "{n} Guitar", ""], tags=["live", "", "remix", "", "cover", "", "", "", "", ""], language=[None] * 7 + ["japanese", None, None], credits=["Ana {n}"] + [""] * 9, work_source=[None] * 3 + ["《{n}》电影主题曲"] + [None] * 6, covered=[None] * 4 + ["Someone"] + [None] * 5))
def title_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = worded(spark, sf_dir, v=TITLES).select("id", titles.title_parts("v").alias("t"))
    return t.select("id", "t.core", F.array_join("t.tags", ",").alias("tags"), "t.language", F.array_join("t.credits", ",").alias("credits"), "t.work_source", "t.covered")


@query("SELECT p_partkey AS id, 0 AS pos, p_name AS text, 'bracket' AS provenance, false AS speculative FROM part WHERE p_partkey % 10 = 1")
def title_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = worded(spark, sf_dir, v=TITLES).select("id", F.posexplode(titles.title_parts("v")["variants"]))
    return t.select("id", "pos", "col.text", "col.provenance", "col.speculative")


@query(worded_sql(primary=["A", "A", "{n}", "", "HOYO-MiX", "X"], others=["{n}", "{n}", "Voice", "", "{n}", "{n},Z"], project=[None] * 4 + ["HOYO-MiX", None]))
def artist_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = worded(spark, sf_dir, names=[["A & {n}"], ["A feat. {n}"], ["{n} (CV: Voice)"], ["群星"], ["HOYO-MiX", "{n}"], ["X", "{n} (Z)"]])
    a = names.select("id", titles.artist_parts("names").alias("a"))
    return a.select("id", "a.primary", F.array_join("a.others", ",").alias("others"), "a.project")


@query(worded_sql(romaji=ROMAJI))
def romaji_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worded(spark, sf_dir, v=KANA).select("id", arrow.kana_to_romaji("v").alias("romaji"))


@query(worded_sql(sim=[1.0, 10 / 13, 1.0, 2 / 9, 0.5, 1.0]))
def loanword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loanwords in katakana against Latin words; the part's key picks the pair."""
    pairs = worded(spark, sf_dir, a=["ミラージュ", "スパークル", "レモン", "サクラ", "コーヒー", "リング"], b=["mirage", "sparkle", "lemon", "blue", "coffee", "ring"])
    x, y = text.loanword_stem(arrow.kana_to_romaji("a")), text.loanword_stem(F.col("b"))
    return pairs.select("id", F.when(x == y, 1.0).otherwise(arrow.sequence_ratio(x, y)).alias("sim"))


@query("""SELECT event_id, CASE WHEN len(p) = 2 THEN p[1]::BIGINT * 60 + p[2]::BIGINT WHEN len(p) = 3 THEN p[1]::BIGINT * 3600 + p[2]::BIGINT * 60 + p[3]::BIGINT ELSE 0 END AS secs
 FROM (SELECT event_id, string_split(CASE event_id % 3 WHEN 0 THEN (user_id % 60) || ':07' WHEN 1 THEN '1:02:' || (user_id % 60) ELSE event_id || '' END, ':') AS p FROM events)""")
def parse_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    shown = F.when(F.col("event_id") % 3 == 0, F.concat((F.col("user_id") % 60).cast("string"), F.lit(":07"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("1:02:"), (F.col("user_id") % 60).cast("string"))).otherwise(F.col("event_id").cast("string"))
    return e.select("event_id", text.seconds_of(shown).alias("secs"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id * 10000 WHEN 1 THEN user_id * 100000000 ELSE 0 END::BIGINT AS n FROM events")
def parse_play_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id").cast("string")
    shown = F.when(F.col("event_id") % 3 == 0, F.concat(u, F.lit("万"))).when(F.col("event_id") % 3 == 1, F.concat(u, F.lit("亿"))).otherwise(F.lit("none"))
    return read(spark, sf_dir, "events").select("event_id", text.count_of(shown).alias("n"))


@query("""SELECT page_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.2f GB', n / 1073741824.0) END AS size, lpad((s // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS dur
 FROM (SELECT page_id, (length(html) * [1, 1000, 1000000][page_id % 3 + 1])::BIGINT AS n, (length(html) % 3000)::BIGINT AS s FROM pages)""")
def format_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of bytes, thousands and millions of bytes, and lengths of time."""
    n = F.length("html") * F.get(F.array(*[F.lit(x).cast("bigint") for x in (1, 1000, 1_000_000)]), (F.col("page_id") % 3).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", text.show_size(n).alias("size"), text.show_duration((F.length("html") % 3000).cast("bigint")).alias("dur"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(secret=)[A-Za-z0-9_\-.]{10,}', '\1[REDACTED]', 'g'), '(?i)(key=)[A-Za-z0-9_\-.]{10,}', '\1[REDACTED]', 'g'), '/home/[^/]+', '[USER_HOME]', 'g')) AS h FROM documents")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.redact(F.col("text"))).alias("h"))


@query("SELECT page_id, replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS plain FROM pages")
def html_title_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.without_tags(F.col("html")).alias("plain"))


@query("SELECT page_id, CASE page_id % 5 WHEN 4 THEN NULL WHEN 1 THEN 'ab' || page_id WHEN 3 THEN (1000000 + page_id)::VARCHAR ELSE page_id::VARCHAR END AS id FROM pages")
def extract_ids_from_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of lists in links of several platforms, in share texts, and alone."""
    k = F.col("page_id")
    i = k.cast("string")
    links = [F.concat(F.lit("look: https://music.163.com/#/playlist?x=1&id="), i, F.lit("&y=2")), F.concat(F.lit("https://open.spotify.com/playlist/ab"), i, F.lit("?si=x")), F.concat(F.lit("https://y.qq.com/n/ryqq/playsquare/"), i), (k + 1_000_000).cast("string"), F.col("url")]
    return read(spark, sf_dir, "pages").select("page_id", readers.playlist_id(F.get(F.array(*links), (k % 5).cast("int"))).alias("id"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://a.b/' || page_id || '/640x480.jpg' WHEN 1 THEN 'https://' || page_id END AS cover, lpad('', 76, 'ab') || '_' || page_id % 1000 AS file FROM pages")
def cover_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covers in a size, links without a scheme, and long names of files with signs that names can't have."""
    i = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("//a.b/"), i, F.lit("/{w}x{h}.jpg"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://"), i)).otherwise(F.lit(""))
    name = F.concat(F.repeat(F.lit("ab"), 38), F.lit("?"), (F.col("page_id") % 1000).cast("string"), F.lit(" "))
    return read(spark, sf_dir, "pages").select("page_id", text.with_scheme(text.artwork(url, 640, 480)).alias("cover"), text.file_name(name).alias("file"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 <> 3 THEN 1700000000 + c_custkey END AS expires FROM customer")
def token_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When tokens of customers expire; the payloads need no, one or two signs to be filled up, and some are no tokens."""
    k = F.col("c_custkey")
    payload = F.to_json(F.struct(F.concat(F.repeat(F.lit("é>?"), (k % 5).cast("int")), F.lit("x")).alias("sub"), (k + 1_700_000_000).alias("exp")))
    coded = F.replace(F.translate(F.base64(F.encode(payload, "UTF-8")), "+/", "-_"), F.lit("="), F.lit(""))
    token = F.when(k % 4 == 3, F.when(k % 8 == 3, "no token").otherwise("a.!!.b")).otherwise(F.concat(F.lit("e30."), coded, F.lit(".x")))
    return read(spark, sf_dir, "customer").select("c_custkey", text.token_expiry(token).alias("expires"))


@query("SELECT page_id, CASE WHEN u LIKE '%163.com%' THEN 'netease' WHEN u LIKE '%y.qq.com%' THEN 'qq' WHEN u LIKE '%open.spotify.com%' THEN 'spotify' WHEN regexp_matches(u, '(?i)\\.(txt|csv)$') THEN 'file' END AS source FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://music.163.com/playlist?id=' || page_id WHEN 1 THEN 'https://y.qq.com/n/ryqq/playlist/' || page_id WHEN 2 THEN 'https://open.spotify.com/playlist/' || page_id WHEN 3 THEN 'list' || page_id || '.CSV' ELSE url END AS u FROM pages)")
def source_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, m = F.col("page_id").cast("string"), F.col("page_id") % 5
    u = F.when(m == 0, F.concat(F.lit("https://music.163.com/playlist?id="), i)).when(m == 1, F.concat(F.lit("https://y.qq.com/n/ryqq/playlist/"), i)).when(m == 2, F.concat(F.lit("https://open.spotify.com/playlist/"), i)).when(m == 3, F.concat(F.lit("list"), i, F.lit(".CSV"))).otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", readers.source_of(u).alias("source"))


LINES_SQL = """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations), k AS (SELECT conv_id, turn, trim(line) AS t FROM l WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#'))
 SELECT conv_id, turn, count(*) AS n, sum(CASE WHEN instr(t, ',') > 0 THEN 1 ELSE 0 END)::BIGINT AS with_artist, min(trim(CASE WHEN instr(t, ',') > 0 THEN substr(t, 1, instr(t, ',') - 1) ELSE t END)) AS first_title FROM k GROUP BY ALL"""


@query(LINES_SQL)
def parse_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    t = readers.parse_lines(lines, "line", (",",))
    return t.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.sum(F.contains(F.col("line"), F.lit(",")).cast("bigint")).alias("with_artist"), F.min("title").alias("first_title"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.k')::BIGINT * 1000 AS ms FROM events")
def parse_json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return read(spark, sf_dir, "events").select("event_id", k.alias("k"), (k * 1000).alias("ms"))


@query("SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END), ''), c_mktsegment) AS label FROM customer")
def coalesce_key_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", F.coalesce(text.present(F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name"))), "c_mktsegment").alias("label"))


@query("SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, 'Song ' || o_orderkey AS title, o_orderstatus || '/' || o_orderpriority AS artists, 'List ' || o_custkey AS album, (o_orderkey * 1000)::BIGINT AS duration_ms, 'US' || (1000000000 + o_orderkey) AS isrc, 't' || o_orderkey AS original_id FROM orders WHERE o_orderkey % 5 <> 0")
def flatten_nested_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made of every customer's orders; each fifth order is an item without a track."""
    o = read(spark, sf_dir, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey", F.col("o_orderkey") % 5 == 0).orderBy("o_orderkey")))
    key = F.col("o_orderkey").cast("string")
    track = F.struct(F.concat(F.lit("t"), key).alias("id"), F.concat(F.lit("Song "), key).alias("name"), F.array(F.struct(F.col("o_orderstatus").alias("name")), F.struct(F.col("o_orderpriority").alias("name"))).alias("artists"), F.struct(F.concat(F.lit("List "), F.col("o_custkey").cast("string")).alias("name")).alias("album"), (F.col("o_orderkey") * 1000).alias("duration_ms"), F.struct(F.concat(F.lit("us"), (F.col("o_orderkey") + 1_000_000_000).cast("string")).alias("isrc")).alias("external_ids"))
    item = F.struct(F.when(F.col("o_orderkey") % 5 != 0, track).alias("track"))
    # items without a track come last, so that places are those of tracks
    pages = o.groupBy("o_custkey").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct((F.col("o_orderkey") % 5 == 0).alias("z"), "o_orderkey", item.alias("i")))), lambda x: x["i"]).alias("items"))).alias("payload"))
    t = readers.spotify_tracks(pages, "payload")
    return t.select(F.regexp_extract("album", "[0-9]+", 0).cast("bigint").alias("o_custkey"), F.col("pos").cast("bigint").alias("pos"), "title", F.array_join("artists", "/").alias("artists"), "album", "duration_ms", "isrc", "original_id")


@query("""SELECT p_partkey, p_name AS title, p_brand AS artists, p_type AS album, (p_size * 1000)::BIGINT AS duration_ms, CASE WHEN p_partkey % 2 = 1 THEN upper('CN-A1-' || (10000000 + p_partkey)) END AS isrc, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'm' END || p_partkey AS original_id,
 CASE WHEN p_partkey % 2 = 0 THEN 'T' || p_partkey ELSE 'sub' END AS trans_title FROM part""")
def platform_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of two platforms made of parts, each with the names that the platform has for a field."""
    p, key = read(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    name = lambda c: F.struct(F.col(c).alias("name"))
    song = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array(name("p_brand")).alias("ar"), name("p_type").alias("al"), (F.col("p_size") * 1000).alias("dt"), F.array(F.concat(F.lit("T"), key)).alias("tns"), F.array().cast("array<string>").alias("alia"))
    other = F.struct(F.lit("").alias("songname"), F.col("p_name").alias("name"), F.array(name("p_brand")).alias("singer"), F.lit("").alias("albumname"), name("p_type").alias("album"), F.col("p_size").alias("interval"), F.concat(F.lit("m"), key).alias("songmid"), F.concat(F.lit("CN-A1-"), (F.col("p_partkey") + 10_000_000).cast("string")).alias("isrc"), F.lit("sub").alias("subtitle"))
    a = readers.netease_tracks(p.where("p_partkey % 2 = 0").select(F.to_json(F.struct(F.array(song).alias("songs"))).alias("p")), "p")
    b = readers.qq_tracks(p.where("p_partkey % 2 = 1").select(F.to_json(F.struct(F.array(other).alias("songlist"))).alias("p")), "p")
    return a.unionByName(b).select(F.regexp_extract("original_id", "[0-9]+", 0).cast("bigint").alias("p_partkey"), "title", F.array_join("artists", "/").alias("artists"), "album", "duration_ms", "isrc", "original_id", "trans_title")


@query("SELECT p_partkey, p_name AS title, p_brand AS artist, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS album, CASE WHEN p_partkey % 2 = 0 THEN upper('usabc' || (1000000 + p_partkey)) END AS isrc FROM part")
def read_csv_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as CSV of two kinds, read back together: with a byte order mark, a header and its own order of columns, and without a header."""
    p = read(spark, sf_dir, "part").withColumn("title", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")))
    folder = f"{store.work_dir(spark)}/csv-{uuid.uuid4().hex}"
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    named = p.where("p_partkey % 2 = 0").select(F.concat_ws(",", quoted(F.concat(F.lit("usabc"), (F.col("p_partkey") + 1_000_000).cast("string"))), quoted("p_brand"), quoted("title"), quoted("p_type")).alias("value"))
    header = spark.createDataFrame([("\ufeffisrc,Artist,Title,Album",)], "value string")
    # one file, so that the header comes first
    header.withColumn("o", F.lit(0)).unionByName(named.withColumn("o", F.lit(1))).repartition(1).sortWithinPartitions("o").select("value").write.text(f"{folder}/named")
    p.where("p_partkey % 2 = 1").select(F.concat_ws(",", quoted("title"), quoted("p_brand")).alias("value")).write.text(f"{folder}/plain")
    rows = readers.read_csv(spark, f"{folder}/*")
    key = F.element_at(F.split("title", " "), -1).cast("bigint")
    return rows.select(key.alias("p_partkey"), F.regexp_replace("title", " [0-9]+$", "").alias("title"), F.array_join("artists", "/").alias("artist"), "album", "isrc")


@query("SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, 'Song ' || o_orderkey AS title, o_orderstatus || '/' || o_orderpriority AS artists, (o_orderkey * 1000)::BIGINT AS duration_ms, 'id' || o_orderkey AS original_id FROM orders WHERE o_custkey % 3 <> 0 AND o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) < 100)")
def embed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embed pages made of every customer's orders; pages that promise more tracks than they list are left to the other reader."""
    o = read(spark, sf_dir, "orders")
    track = F.struct(F.concat(F.lit("Song "), F.col("o_orderkey").cast("string")).alias("title"), F.concat_ws(",\u00a0", "o_orderstatus", "o_orderpriority").alias("subtitle"), (F.col("o_orderkey") * 1000).cast("bigint").alias("duration"), F.concat(F.lit("spotify:track:id"), F.col("o_orderkey").cast("string")).alias("uri"))
    pages = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", track.alias("t")))).alias("l")).select("o_custkey", F.transform("l", lambda x: x["t"]).alias("trackList"))
    data = F.to_json(F.struct(F.struct(F.struct(F.struct(F.struct(F.struct("trackList").alias("entity")).alias("data")).alias("state")).alias("pageProps")).alias("props")))
    html = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script></html>"))
    pages = pages.select("o_custkey", html.alias("html"), (F.size("trackList") + F.when(F.col("o_custkey") % 3 == 0, 1).otherwise(0)).alias("total"))
    return readers.embed_tracks(pages, "o_custkey", "html", "total").select("o_custkey", F.col("pos").cast("bigint").alias("pos"), "title", F.array_join("artists", "/").alias("artists"), "duration_ms", "original_id")


@query("SELECT p_partkey::VARCHAR AS id, p_name AS title, p_brand AS artist, p_type AS album, (p_size * 1000)::BIGINT AS duration_ms FROM part")
def catalog_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested catalog items made of parts, flat again."""
    attributes = F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("artistName"), F.col("p_type").alias("albumName"), (F.col("p_size") * 1000).alias("durationInMillis"))
    items = read(spark, sf_dir, "part").select(F.to_json(F.struct(F.col("p_partkey").cast("string").alias("id"), attributes.alias("attributes"))).alias("item"))
    return readers.catalog_items(items, "item").select("id", "title", "artist", "album", "duration_ms")


@query("SELECT p_partkey AS id, ['sanz', 'sanz', 'abc', 'abc', 'beyonce'][p_partkey % 5 + 1] || replace(p_name, ' ', '') AS key FROM part")
def canonical_artist_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worded(spark, sf_dir, v=["Sān-Z {n}", "San Z {n}", "A.B.C {n}", "ＡＢＣ {n}", "Beyoncé {n}"]).select("id", arrow.canonical_artist("v").alias("key"))


@query(worded_sql(base=["夜に駆ける", "{n}", "{n} (Live)", "{n}", "{n} (x)", "{n} （现场版）", "{n} f"], inner=["{n}", "スパークル", None, None, None, None, "D E"]))
def bracket_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worded(spark, sf_dir, v=BRACKETS).select("id", text.bracket_translation(F.col("v")).alias("b")).select("id", "b.base", "b.inner")


STEM = "regexp_replace(lower(regexp_replace(p_name, '[^a-zA-Z]', '', 'g')), '(aa)+a?', 'a', 'g')"
for _v in "eiou":
    STEM = f"regexp_replace({STEM}, '{_v}{_v}+', '{_v}', 'g')"
for _p, _o in [("ph", "f"), ("c([eiy])", "s\\1"), ("ck", "k"), ("[cq]", "k"), ("v", "b"), ("l", "r"), ("th", "s"), ("(j[ui]|ge|dge|je)$", "g"), ("j[ui]", "g")]:
    STEM = f"regexp_replace({STEM}, '{_p}', '{_o}', 'g')"


@query(f"SELECT p_partkey, CASE WHEN length(s) > 3 THEN regexp_replace(regexp_replace(s, '[uo]$', ''), 'e$', '') ELSE s END AS stem FROM (SELECT p_partkey, {STEM} AS s FROM part)")
def loanword_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", text.loanword_stem(F.col("p_name")).alias("stem"))


@query(worded_sql(pair=["不虚此行|{n}", "复梦天使|{n}", "", "", "", "", "晴天|{n} Day"]))
def bilingual_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worded(spark, sf_dir, v=PAIRS).select("id", F.array_join(text.bilingual_pair(F.col("v")), "|").alias("pair"))


CREDITS = [("{n} & B", ["{n}", "B"]), ("Earth, {n} & Fire", ["Earth, {n} & Fire"]), ("A, {n} & C", ["A", "{n}", "C"]), ("X feat. {n}", ["X", "{n}"]), ("{n}, The Creator & Z", ["{n}, The Creator", "Z"]), ("{n}", [])]


@query(worded_sql(names=["{n}|B", "Earth, {n} & Fire", "A|{n}|C", "X|{n}", "{n}, The Creator|Z", "{n}"]))
def credit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = worded(spark, sf_dir, known=[k for _, k in CREDITS], display=[d for d, _ in CREDITS])
    return c.select("id", F.array_join(arrow.credit_names("display", "known"), "|").alias("names"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'Unknown Artist' ELSE p_brand || ' / ' || p_type END AS shown FROM part")
def display_artist(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.when(F.col("p_partkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", "p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", text.display_artist(names).alias("shown"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 30.0 ELSE greatest(value, 0.5) END::DOUBLE AS wait FROM events")
def retry_after_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.when(F.col("event_id") % 3 == 2, "soon").otherwise(F.col("value").cast("string"))
    return read(spark, sf_dir, "events").select("event_id", text.retry_after(header, F.lit(0), 30.0).alias("wait"))


@query("SELECT c_custkey, sha256(c_name || '|' || c_mktsegment) AS fp FROM customer")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", text.fingerprint(F.col("c_name"), F.col("c_mktsegment")).alias("fp"))


@query("SELECT o_orderkey, length(code) >= 8 AS isrc_ok, code NOT IN ('none') AS id_ok FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'none' ELSE 'AB' || o_orderkey END AS code FROM orders)")
def key_usable_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("o_orderkey") % 7 == 0, "none").otherwise(F.concat(F.lit("AB"), F.col("o_orderkey").cast("string")))
    return read(spark, sf_dir, "orders").select("o_orderkey", text.usable_isrc(code).alias("isrc_ok"), text.usable_id(code, F.lit("list")).alias("id_ok"))


@query("SELECT p_partkey, length(string_split(p_name, ' ')[1]) <= 4 AS short FROM part")
def short_title_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", text.is_short_title(F.element_at(F.split("p_name", " "), 1)).alias("short"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_brand || ',' || p_type END AS names FROM part")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array("p_brand", F.when(F.col("p_partkey") % 2 == 0, "Unknown Artist").otherwise(F.col("p_type")))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(text.without_placeholders(names), ",").alias("names"))


@query(worded_sql(regional=[x not in ("{n}", "") for x in KANA]))
def region_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worded(spark, sf_dir, v=KANA).select("id", text.is_regional(F.col("v")).alias("regional"))


SUGGEST_SQL = """WITH t AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS w FROM conversations), a AS (SELECT conv_id, w FROM t WHERE turn = 0),
 m AS (SELECT t.conv_id, t.turn, row_number() OVER (PARTITION BY t.conv_id ORDER BY t.turn) AS place FROM t JOIN a USING (conv_id) WHERE t.turn > 0 AND list_has_any(t.w, a.w)) SELECT conv_id, turn FROM m WHERE place <= 2"""


@query(SUGGEST_SQL)
def suggestion_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two later turns of a conversation that share a word with its first one."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)))
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("w"))
    first = t.where("turn = 0").select("conv_id", F.col("w").alias("first"))
    hit = t.where("turn > 0").join(first, "conv_id").where(F.arrays_overlap("w", "first"))
    return hit.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("place <= 2").select("conv_id", "turn")



COMPOUNDS = [(1, "夜空", "yozora"), (2, "夜", "yoru"), (3, "空の", "sora no"), (4, "空", "sora")]
LETTERS = [("花", 1, "hana"), ("花", 2, "ka"), ("火", 1, "hi"), ("火", 2, "bi")]


@query(worded_sql(reading=["yozora {n}", "sora no {n}", "yoru sora no {n}", "{n}"]))
def compound_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with compounds of a table, the first in its order taking its letters from the others."""
    t = worded(spark, sf_dir, v=["夜空 {n}", "空の{n}", "夜 空の{n}", "{n}"])
    compounds = readings.checked(spark.createDataFrame(COMPOUNDS, "place int, written string, read string"))
    read_ = readings.compound_reading(t.select(F.col("v").alias("text")).distinct(), compounds)
    return t.join(read_, F.col("v") == F.col("text")).select("id", "reading")


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN concat('hana no ', p_name, '|hanano', c, '|ka no ', p_name, '|kano', c) WHEN 1 THEN concat('sakura ', p_name, '|sakura', c) WHEN 2 THEN '' ELSE 'hana yozora|hanayozora|yozora hana|yozorahana' END AS variants FROM (SELECT *, replace(p_name, ' ', '') AS c FROM part)""")
def reading_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of titles by compounds, kana and letters with several readings; and of an artist's name of two words, turned round."""
    t = worded(spark, sf_dir, v=["花 の {n}", "さくら {n}", "火 {n}", "はな 夜空"])
    compounds = readings.checked(spark.createDataFrame(COMPOUNDS, "place int, written string, read string"))
    letters = spark.createDataFrame(LETTERS, "letter string, place int, read string")
    distinct = t.select(F.col("v").alias("text")).distinct()
    name = F.col("text") == "はな 夜空"
    titles_ = readings.reading_variants(distinct.where(~name), compounds, letters)
    names = readings.reading_variants(distinct.where(name), compounds, letters, artist=True)
    return t.join(titles_.unionByName(names), F.col("v") == F.col("text")).select("id", F.array_join("variants", "|").alias("variants"))


SONG, ODD = '{"id":"t {n}"}', '{"id":"first {n}"}'
ANSWERS = ['{"data":[%s],"meta":{"filters":{"equivalents":{"a":%s}}}}' % pair for pair in [  # noqa: UP031
    (f"{ODD},{SONG}", f"[{SONG}]"), (f"{ODD},{SONG}", '["t {n}"]'), (f"{ODD},{SONG}", SONG), (f"{ODD},{SONG}", '"t {n}"'), (f"{ODD},{SONG}", "[]"), (f"{ODD},{SONG}", '"gone"'), ("", '"t {n}"')
]]


@query("""SELECT p_partkey AS id, 'a' AS asked, CASE WHEN p_partkey % 7 < 4 THEN 't ' || p_name WHEN p_partkey % 7 = 6 OR p_partkey % 2 = 1 THEN NULL ELSE 'first ' || p_name END AS target FROM part
 UNION ALL SELECT p_partkey, 'b', NULL FROM part WHERE p_partkey % 2 = 1""")
def equivalent_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with targets in every shape, to requests for one id, and for two by odd parts."""
    t = worded(spark, sf_dir, body=ANSWERS)
    two = F.filter(F.array(F.lit("a"), F.when(F.col("id") % 2 == 1, "b")), lambda x: x.isNotNull())
    asked = t.select(F.col("id").alias("request"), F.explode(two).alias("id"))
    found = payloads.equivalents(asked, t.select(F.col("id").alias("request"), F.parse_json("body").alias("body")))
    return found.select(F.col("request").alias("id"), F.col("id").alias("asked"), "target")


@query(worded_sql(name=["{n}", "{n}", "未命名歌单"], description=["About {n}", "Plain {n}", ""]))
def playlist_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playlists whose description is an object, a text, or missing."""
    item = '{"data":[{"id":"p","attributes":%s}]}'
    bodies = [item % a for a in ('{"name":"{n}","description":{"standard":"About {n}","short":"x"}}', '{"name":"{n}","description":"Plain {n}"}', '{"canEdit":true}')]
    t = worded(spark, sf_dir, body=bodies).select(F.col("id").alias("request"), F.parse_json("body").alias("v"))
    return payloads.playlists(t, "v", by=["request"]).select(F.col("request").alias("id"), "name", "description")


@query("""SELECT event_id, '{"a":[{"b":"Bearer [REDACTED]","type":"' || event_type || '"},"key=[REDACTED]",' || (props::JSON->>'k') || '],"at":"[USER_HOME]/' || user_id || '"}' AS shown FROM events""")
def safe_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested data of every event without credentials at any depth."""
    e = read(spark, sf_dir, "events")
    k = F.variant_get(F.parse_json("props"), "$.k", "int")
    inner = F.struct(F.lit("Bearer abcdefghijklmnop").alias("b"), F.col("event_type").alias("type"), F.lit("x").alias("accessToken"))
    parts = F.concat(F.lit('{"session":{"deep":1},"a":['), F.to_json(inner), F.lit(',"key=abcdefghijk",'), k.cast("string"), F.lit('],"at":"/home/me/'), F.col("user_id").cast("string"), F.lit('"}'))
    return e.select("event_id", F.to_json(payloads.sanitized(F.parse_json(parts))).alias("shown"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat('夜空 ', p_name, ':original:strong|yozora ', p_name, ':hepburn:weak|yozora', c, ':hepburn_compact:weak') WHEN 1 THEN concat('夜 さくら', ':original:strong|yoru sakura:hepburn:medium|yorusakura:hepburn_compact:weak|夜 サクラ:kana_swap:weak') ELSE concat(p_name, ':original:strong') END AS forms FROM (SELECT *, replace(p_name, ' ', '') AS c FROM part)""")
def ranked_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of titles in order, read by compounds where they have some."""
    t = worded(spark, sf_dir, v=["夜空 {n}", "夜 さくら", "{n}"])
    compounds = readings.checked(spark.createDataFrame(COMPOUNDS, "place int, written string, read string"))
    said = t.join(readings.spoken(t.select(F.col("v").alias("text")).distinct(), compounds), F.col("v") == F.col("text"), "left")
    listed = F.transform("x", lambda x: F.concat_ws(":", x["text"], x["provenance"], x["level"]))
    return said.select("id", arrow.variants("v", "spoken").alias("x")).select("id", F.array_join(listed, "|").alias("forms"))
