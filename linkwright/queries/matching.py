"""Searches, similarities and whole matches; their UDFs have no SQL form, so tests compare with tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkwright.functions import arrow, text
from linkwright.operators import credits
from linkwright.operators import score as S
from linkwright.operators import similarity as M
from linkwright.plans import library, match, media, quality, search
from linkwright.queries.registry import query, read, worded, worded_sql
from linkwright.sources import readers

GROUPS = [["周华健", "Emil Wakin Chau"], ["Jay Chou", "周杰伦"]]
TITLE_PAIRS = [("{n}", "{n}"), ("{n} (Live)", "{n}"), ("さくら", "Sakura"), ("夜に駆ける ({n})", "{n}"), ("{n}!", "{n}"), ("", "{n}"), ("晴天", "{n}")]
ARTIST_PAIRS = [(["A", "{n}"], ["{n}", "A"]), (["周华健"], ["Emil Wakin Chau"]), (["Name Taro"], ["Taro Name"]), (["{n} feat. C"], ["{n}"]), ([], ["{n}"]), (["{n}"], ["{n} & Solo"])]


def list_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(tracks, catalog): the parts of even and of odd keys. Every row is a recording of its own, so its code is its own too."""
    p = read(spark, sf_dir, "part")
    t = p.select(F.col("p_partkey").alias("id"), F.initcap("p_name").alias("title"), F.array("p_brand").alias("artists"), F.col("p_type").alias("album"), (F.col("p_size") * 10_000).cast("long").alias("duration_ms"), F.concat(F.lit("ISRC"), (F.col("p_partkey") + 10_000).cast("string")).alias("isrc"), F.lit("list").alias("source"), F.lit(None).cast("string").alias("original_id"), F.lit(None).cast("string").alias("trans_title"), F.array().cast("array<string>").alias("aliases"))
    return t.where("id % 2 = 0"), t.where("id % 2 = 1")


@query(worded_sql(similarity=[1.0, 0.98, 0.98, 0.98, 0.99, 0.0, 0.0], method=["exact", "normalized", "romaji_exact", "variant_exact", "punctuation_stripped", "empty", "ratio"], mismatch=[False] * 7, unverified=[False] * 6 + [True]))
def title_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = worded(spark, sf_dir, a=[a for a, _ in TITLE_PAIRS], b=[b for _, b in TITLE_PAIRS])
    return t.select("id", M.title_udf("a", "b").alias("t")).select("id", "t.*")


def credited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of credit lists in turn, with what the aliases say about their names."""
    none = F.array().cast("array<string>")
    t = worded(spark, sf_dir, a_artists=[a for a, _ in ARTIST_PAIRS], b_artists=[b for _, b in ARTIST_PAIRS]).withColumn("a_credits", none).withColumn("b_credits", none)
    return credits.with_roles(credits.with_roles(t, "a", GROUPS), "b", GROUPS)


@query(worded_sql(similarity=[1.0, 1.0, 1.0, 1.0, 0.0, 1.0]))
def artist_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credited(spark, sf_dir).select("id", M.artist_udf("a_artists", "b_artists", "a_credits", "b_credits", "a_known", "b_known").alias("similarity"))


@query()
def album_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = read(spark, sf_dir, "part").select("p_type").distinct()
    both = kinds.select(F.col("p_type").alias("a")).join(kinds.select(F.col("p_type").alias("b")), F.substring("a", 1, 1) == F.substring("b", 1, 1))
    return both.select("a", "b", M.album_udf("a", "b").alias("similarity"))


def to_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worded(spark, sf_dir, title=["夜に駆ける ({n})", "さくら {n}", "晴天 {n} Day", "{n}"], artists=[["YOASOBI"], ["もり"], ["周杰伦"], []], trans_title=[None, "Cherry {n}", None, None], aliases=[[], ["{n} Song"], [], []])


@query()
def plan_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.planned(to_plan(spark, sf_dir))


@query()
def plan_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.relaxed_plans(search.plans(to_plan(spark, sf_dir)), ["cn", "hk", "tw", "us"])


@query()
def manual_search_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches typed phrases and scores what they find against the given tracks."""
    tracks, catalog = list_of(spark, sf_dir)
    phrases = tracks.select("id", F.lit(1).alias("ord"), F.concat_ws(" ", "title", F.element_at("artists", 1)).alias("query"))
    found = search.candidates(search.retrieve(phrases, catalog.select("id", "title", F.array_join("artists", " ").alias("artist")), 8))
    scored = match.score_pairs(match.pair_up(tracks, catalog, found.select("id", "match_id", "insertion")))
    return scored.select("id", "match_id", "score", "confidence", "method")


@query()
def link_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks, catalog = list_of(spark, sf_dir)
    return match.match(tracks, catalog, GROUPS).withColumn("candidates", F.size("candidates"))


@query()
def link_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks, catalog = list_of(spark, sf_dir)
    return match.rematch(tracks, catalog, ["cn", "hk"], GROUPS).drop("candidates")


@query(worded_sql(form=["A {n}", "カ キ {n}", "x {n}"]))
def jp_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worded(spark, sf_dir, v=["Ａ　{n}", "カ・キ {n}", " x  {n} "]).select("id", arrow.normalize_japanese("v").alias("form"))


@query("""SELECT p_partkey AS id, (i - 1)::INT AS pos, replace(v[1], '{n}', p_name) AS text, v[2] AS provenance, v[3] AS level FROM (SELECT p_partkey, p_name, x, unnest(range(1, len(x) + 1)) AS i, x[i] AS v FROM (SELECT p_partkey, p_name, CASE p_partkey % 3
 WHEN 0 THEN [['さくら {n}', 'original', 'strong'], ['sakura {n}', 'hepburn', 'medium'], ['sakura' || replace(p_name, ' ', ''), 'hepburn_compact', 'weak'], ['サクラ {n}', 'kana_swap', 'weak']]
 WHEN 1 THEN [['{n} [スパークル]', 'original', 'strong'], ['スパークル', 'source_translation', 'strong'], ['{n}', 'base', 'strong'], ['{n} [supakuru]', 'hepburn', 'medium']] ELSE [['{n}', 'original', 'strong']] END AS x FROM part))""")
def script_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = worded(spark, sf_dir, v=["さくら {n}", "{n} [スパークル]", "{n}"])
    return t.select("id", F.posexplode(arrow.variants("v")).alias("pos", "x")).select("id", "pos", "x.*")


@query(worded_sql(same=[True, True, False, False, False, False]))
def greedy_artist_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = lambda side: credits.name_keys(f"{side}_artists", f"{side}_known")
    return credited(spark, sf_dir).select("id", credits.same_names(keys("a"), keys("b")).alias("same"))


@query(worded_sql(best=[1.0, 1.0, 1.0]))
def variant_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ratio over all variants of two titles, each of which has a variant that the other has too."""
    t = worded(spark, sf_dir, a=["{n}", "さくら {n}", "{n} [スパークル]"], b=["{n}", "sakura {n}", "スパークル"])
    crossed = t.select("id", F.explode(arrow.variants("a")).alias("x"), "b").select("id", "x", F.explode(arrow.variants("b")).alias("y"))
    return crossed.select("id", arrow.sequence_ratio(F.lower("x.text"), F.lower("y.text")).alias("r")).groupBy("id").agg(F.max("r").alias("best"))


@query()
def library_link_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's best other row of the same brand's library that shares a word of its title."""
    p = read(spark, sf_dir, "part")
    wanted = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"))
    return search.best_in_library(wanted, p.select(F.col("p_partkey").alias("song_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist")), but_own=True)


@query("""WITH a AS (SELECT p_partkey, unnest([{'p': 1, 's': k % 11, 'v': 'title'}, {'p': 2, 's': k % 7 + 4, 'v': 'translation'}, {'p': 3, 's': k % 3 + 7, 'v': 'alias'}]) AS u FROM (SELECT p_partkey, p_partkey AS k FROM part)),
 r AS (SELECT p_partkey, coalesce(arg_min(u, u.p) FILTER (u.s >= 10), arg_min(u, -u.s * 10 + u.p)) AS w FROM a GROUP BY 1) SELECT p_partkey, w.v AS method, (w.s / 10.0)::DOUBLE AS similarity, w.s < 8 OR w.s >= 10 AS mismatch FROM r""")
def best_alternative_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison that counts of a title, its translation and another name, all of which are in doubt at first."""
    k = F.col("p_partkey")
    ways = [F.struct((s / F.lit(10.0)).alias("similarity"), F.lit(v).alias("method"), F.lit(True).alias("mismatch"), F.lit(True).alias("unverified")) for v, s in (("title", k % 11), ("translation", k % 7 + 4), ("alias", k % 3 + 7))]
    return read(spark, sf_dir, "part").select("p_partkey", S.best_way(F.array(*ways)).alias("w")).select("p_partkey", "w.method", "w.similarity", "w.mismatch")


@query("""SELECT p_partkey, CASE WHEN k % 4 <> 0 THEN 1.0 ELSE c END::DOUBLE AS score, CASE WHEN k % 4 <> 0 THEN 'strong' ELSE 'conflict' END AS level, CASE WHEN k % 4 <> 0 THEN 'auto_accept' WHEN k % 8 = 0 OR c < 0.55 THEN 'no_match' ELSE 'review' END AS decision FROM
 (SELECT *, CASE WHEN k % 8 = 0 THEN least(s, 0.4) WHEN t >= 0.5 OR a >= 0.5 THEN greatest(least(s, 0.95), 0.65) ELSE 0.4 END AS c FROM (SELECT p_partkey, p_partkey AS k, (p_partkey % 101) / 100.0::DOUBLE AS s, (p_partkey % 13) / 13.0::DOUBLE AS t, (p_partkey % 17) / 17.0::DOUBLE AS a FROM part WHERE p_partkey % 3 = 0))""")
def isrc_fast_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    conflicts = F.when(k % 8 == 0, F.array(F.lit("title_mismatch"))).when(k % 4 == 0, F.array(F.lit("duration_conflict"))).otherwise(F.array().cast("array<string>"))
    made = S.code_path(k % 3 == 0, conflicts, (k % 101) / F.lit(100.0), (k % 13) / F.lit(13.0), (k % 17) / F.lit(17.0))
    return read(spark, sf_dir, "part").select("p_partkey", made.alias("m")).where("m is not null").select("p_partkey", "m.*")


@query("SELECT p_partkey, k = 0 OR k = 3 AS identity, CASE k WHEN 1 THEN 'primary_artist_mismatch' WHEN 2 THEN 'artist_mismatch' ELSE '' END AS conflicts, NULL::VARCHAR AS role FROM (SELECT p_partkey, p_partkey % 4 AS k FROM part)")
def credit_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits of every part: the same names turned round, a guest's track, strangers, and one of two collaborators."""
    k, mine, theirs = F.col("p_partkey") % 4, F.concat(F.lit("Singer "), "p_brand"), F.concat(F.lit("Other "), "p_type")
    b = F.when(k == 0, F.array(theirs, mine)).when(k == 1, F.array(F.concat_ws(" feat. ", theirs, mine))).when(k == 2, F.array(theirs)).otherwise(F.array(theirs, mine))
    none = F.array().cast("array<string>")
    p = read(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, F.array(mine, theirs)).otherwise(F.array(mine)).alias("a_artists"), b.alias("b_artists"), none.alias("a_credits"), none.alias("b_credits"))
    c = credits.credit_analysis(F.col("a_roles"), F.col("b_roles"), F.lit(0.3))
    roled = credits.with_roles(credits.with_roles(p, "a"), "b").select("p_partkey", c.alias("c"))
    return roled.select("p_partkey", "c.identity", F.array_join("c.conflicts", ",").alias("conflicts"), "c.role")


@query("SELECT user_id, CASE WHEN max(value) > 95 THEN 'matched' WHEN max(value) > 80 THEN 'review' WHEN bool_or(event_type = 'error') THEN 'rate_limited' ELSE 'no_match' END AS status FROM events GROUP BY 1")
def result_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("v"), F.collect_set(F.when(F.col("event_type") == "error", "rate_limited")).alias("kinds"))
    decision = F.when(F.col("v") > 95, "auto_accept").when(F.col("v") > 80, "review").otherwise("no_match")
    return e.select("user_id", S.status(decision, F.col("kinds")).alias("status"))


@query("WITH h AS (SELECT l_partkey AS id, 1 + l_linenumber % 4 AS ord, l_suppkey % 20 AS match_id, 1 + l_orderkey % 10 AS hit FROM lineitem) SELECT id, match_id, min(ord)::BIGINT AS first_query, array_to_string(list_sort(list_distinct(list(ord))), ',') AS queries, min(ord * 1000 + hit)::BIGINT AS insertion FROM h GROUP BY 1, 2")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates (suppliers) of parts that several searches (lines) found: the first that did, and all."""
    hits = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), (1 + F.col("l_linenumber") % 4).cast("bigint").alias("ord"), (F.col("l_suppkey") % 20).alias("match_id"), (1 + F.col("l_orderkey") % 10).alias("hit"))
    return search.candidates(hits).select("id", "match_id", "first_query", F.array_join("queries", ",").alias("queries"), "insertion")


@query("SELECT p_partkey, s BETWEEN 5 AND 3600 AND (abs(s - 250) > 45 OR (abs(s - 250) >= 20 AND abs(s - 250) / greatest(s, 250) >= 0.08)) AS far FROM (SELECT p_partkey, p_size * 10 - 7 AS s FROM part)")
def duration_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts with a fixed duration of 250 s (sizes stand for ten seconds each, less seven)."""
    return read(spark, sf_dir, "part").select("p_partkey", S.duration_conflict(F.col("p_size").cast("long") * 10_000 - 7000, F.lit(250_000)).alias("far"))


@query("WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS a FROM events), s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM r WHERE a <= CASE WHEN event_type = 'view' THEN 4 ELSE 2 END) SELECT event_id, b AS ord FROM s WHERE b <= 8")
def query_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caps per phase and in all."""
    w = F.row_number()
    e = read(spark, sf_dir, "events").withColumn("a", w.over(Window.partitionBy("user_id", "event_type").orderBy("event_id")))
    e = e.where(F.col("a") <= F.when(F.col("event_type") == "view", 4).otherwise(2))
    return e.withColumn("ord", w.over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint")).where("ord <= 8").select("event_id", "ord")


@query("WITH k AS (SELECT o_custkey, list(o_orderkey % 5) AS a, list(o_orderkey % 7) FILTER (o_orderkey % 2 = 0) AS b FROM orders GROUP BY 1) SELECT o_custkey, coalesce(list_has_any(a, b), false) AS shared FROM k")
def artist_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two lists of ids of every customer have one in common; some lists are empty."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(k % 5).alias("a"), F.collect_set(F.when(k % 2 == 0, k % 7)).alias("b"))
    return o.select("o_custkey", S.shares_artist(F.col("a"), F.col("b")).alias("shared"))


@query("""WITH f AS (SELECT p_partkey AS k, p_partkey % 3 AS tier, CASE p_partkey % 3 WHEN 0 THEN '/media/' || lower(p_brand) || '/' ELSE '/other/' END || CASE WHEN p_partkey % 6 = 1 THEN p_brand || ' - ' ELSE '' END || upper(p_name) || ' ' || p_type || '.m4a' AS path FROM part WHERE p_partkey % 5 <> 0),
 t AS (SELECT p_partkey AS id, p_name AS title, lower(p_brand) AS artist FROM part WHERE p_partkey % 4 = 0) SELECT id, arg_min(path, (tier, path)) AS path, min(tier)::INT AS tier FROM t JOIN f ON contains(lower(path), title) AND (tier > 0 OR contains(lower(path), artist)) GROUP BY 1""")
def local_file_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of parts in three places for every fourth part; every fifth file can't be read, and those of the media library stand in folders of artists."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    folder = F.when(k % 3 == 0, F.concat(F.lit("/media/"), F.lower("p_brand"), F.lit("/"))).otherwise(F.lit("/other/"))
    name = F.concat(F.when(k % 6 == 1, F.concat("p_brand", F.lit(" - "))).otherwise(F.lit("")), F.upper("p_name"), F.lit(" "), "p_type", F.lit(".m4a"))
    files = p.select(F.concat(folder, name).alias("path"), (k % 3).cast("int").alias("tier"), (k % 5 != 0).alias("readable"))
    return library.files_at_hand(p.where("p_partkey % 4 = 0").select(k.alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist")), files)


@query()
def local_scan_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below a folder, one per title and artist (here the tables' own files)."""
    return readers.audio_files(spark, sf_dir, ("parquet",)).select("title", "artist", "length")


@query("""SELECT p_partkey, count(*) AS queries, string_agg(query, '|' ORDER BY ord) AS phrases FROM (SELECT p_partkey, unnest(range(1, len(x) + 1)) AS ord, x[ord] AS query FROM
 (SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN [p_name || ' ' || p_brand, p_name] ELSE [p_name || ' ' || p_brand, 'Song ' || p_partkey || ' ' || p_brand, p_name] END AS x FROM part)) GROUP BY 1""")
def planned_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases planned for tracks with Latin titles: with the artist, as translated, and alone."""
    p = read(spark, sf_dir, "part")
    t = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array("p_brand").alias("artists"), F.when(F.col("p_partkey") % 2 == 1, F.concat(F.lit("Song "), F.col("p_partkey").cast("string"))).alias("trans_title"), F.array().cast("array<string>").alias("aliases"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "query"))), lambda x: x["query"])
    return search.planned(t).groupBy(F.col("id").alias("p_partkey")).agg(F.count("*").alias("queries"), F.array_join(listed, "|").alias("phrases"))


@query("SELECT p_partkey AS id, min(q.p_partkey) AS match_id FROM part p JOIN part q ON p.p_partkey % 700 = q.p_partkey % 700 WHERE p.p_partkey % 2 = 0 AND q.p_partkey % 2 = 1 GROUP BY 1".replace("SELECT p_partkey", "SELECT p.p_partkey"))
def code_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks and the first catalog row of their code."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("ISRC"), (F.col("p_partkey") % 700 + 10_000).cast("string")).alias("isrc"))
    return match.by_code(p.where("id % 2 = 0"), p.where("id % 2 = 1"))


@query()
def link_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks, catalog = list_of(spark, sf_dir)
    return match.match(tracks.where("id = 10"), catalog, GROUPS).withColumn("candidates", F.size("candidates"))


KANA_SETS = ["さくら", "ほしの", "なみだ", "かぜの", "ゆめみ"], ["はなび", "みらい", "ひかり", "こころ", "とけい"]
#: Positives by how their text differs from the catalog's; the last three kinds have no true row.
BUCKETS = ["same", "case", "other_kana", "romaji", "han", "bracket", "featured", "stranger", "other_version", "unheard"]


def quality_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tracks, catalog, truth): ten tracks for each nation, seven of which the catalog has in another form."""
    n, k = F.initcap(F.lower("n_name")), F.col("n_nationkey")
    kana = F.concat(*[F.get(F.array(*[F.lit(w) for w in words]), (k / 5 if i else k % 5).cast("int")) for i, words in enumerate(KANA_SETS)])
    han = F.concat(F.lit("夜空"), F.get(F.array(*[F.lit(c) for c in "东南西北中春夏秋冬晨昏山河湖海花草木石云风雨雪霜露"]), k.cast("int")), F.lit("之歌"))
    words = lambda head, tail: F.concat_ws(" ", F.lit(head), n, F.lit(tail))
    mine = [words("Bright", "Morning"), F.concat(F.upper(words("Quiet", "Evening")), F.lit("!")), kana, kana, han, F.concat(F.lit("静 ("), words("Silent", "River"), F.lit(")")), F.concat(words("Golden", "Valley"), F.lit(" (feat. Guest "), n, F.lit(")")), words("Bright", "Morning"), F.concat(words("Bright", "Morning"), F.lit(" (Instrumental)")), words("Unheard", "Anthem")]
    theirs = [words("Bright", "Morning"), words("Quiet", "Evening"), text.swap_kana(kana, to_hiragana=False), arrow.kana_to_romaji(kana), han, words("Silent", "River"), words("Golden", "Valley")]
    kind = F.posexplode(F.array(*mine)).alias("b", "title")
    singer = F.concat(F.lit("Singer "), n)
    rest = [F.lit("Album").alias("album"), F.lit(200_000).cast("bigint").alias("duration_ms"), F.lit(None).cast("string").alias("isrc"), F.lit("list").alias("source"), F.lit(None).cast("string").alias("original_id"), F.lit(None).cast("string").alias("trans_title"), F.array().cast("array<string>").alias("aliases")]
    table = read(spark, sf_dir, "nation")
    t = table.select("n_nationkey", singer.alias("singer"), kind)
    tracks = t.select((k * 100 + F.col("b")).alias("id"), "title", F.array(F.when(F.col("b") == 7, F.concat(F.lit("Stranger "), k.cast("string"))).otherwise(F.col("singer"))).alias("artists"), *rest)
    # one song of two kana stands for both the kana and the romaji track of a nation, so only every other nation has either
    c = table.select("n_nationkey", singer.alias("singer"), F.posexplode(F.array(*theirs)).alias("b", "title")).where(~((F.col("b") == 2) & (k % 2 == 1)) & ~((F.col("b") == 3) & (k % 2 == 0)))
    catalog = c.select((k * 100 + F.col("b")).alias("id"), "title", F.array("singer").alias("artists"), *rest)
    other = F.when(F.col("b").isin(2, 3), F.when(k % 2 == 1, 3).otherwise(2)).otherwise(F.col("b"))
    truth = t.select((k * 100 + F.col("b")).alias("id"), F.get(F.array(*[F.lit(x) for x in BUCKETS]), F.col("b")).alias("bucket"), F.when(F.col("b") < 7, k * 100 + other).alias("truth"))
    return tracks, catalog, truth


@query()
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 20, right automatic decisions and false ones, per bucket and overall."""
    tracks, catalog, truth = quality_corpus(spark, sf_dir)
    return quality.quality(match.match(tracks, catalog), truth, quality.recalled(tracks, catalog, truth.select("id", "truth")))


@query("""WITH h AS (SELECT l_partkey AS id, 1 + l_linenumber % 4 AS ord, l_orderkey * 10 + l_linenumber AS hit, l_suppkey % 20 AS media, 1 + l_suppkey % 20 % 3 AS tier, l_orderkey AS plays, l_orderkey % 1000 AS secs FROM lineitem),
 f AS (SELECT * FROM h WHERE secs = 0 OR secs BETWEEN 20 AND 900 QUALIFY row_number() OVER (PARTITION BY id, media ORDER BY ord, hit) = 1),
 c AS (SELECT *, sum((tier = 1)::INT) OVER (PARTITION BY id ORDER BY ord) AS n FROM f), e AS (SELECT id, coalesce(min(ord) FILTER (n >= 4), max(ord)) AS searches FROM c GROUP BY id),
 s AS (SELECT f.*, searches, (CASE tier WHEN 1 THEN 1000000 WHEN 2 THEN 200000 WHEN 3 THEN 30000 ELSE 1000 END + round(log10(greatest(plays, 1) + 10) * 10000, 3) + CASE WHEN secs BETWEEN 120 AND 360 THEN 10000 WHEN secs < 60 OR secs > 600 THEN -30000 ELSE 0 END)::DOUBLE AS score FROM f JOIN e USING (id) WHERE ord <= searches)
 SELECT id, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord, hit) AS rank, media, score, CASE WHEN tier <= 2 THEN 'auto' ELSE 'manual' END AS way, searches FROM s QUALIFY rank <= 8""")
def media_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos (suppliers) that up to four searches (lines) found for each part: first seen, until four are of the first tier, best first."""
    k, video = F.col("l_orderkey"), F.col("l_suppkey") % 20
    hits = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), (1 + F.col("l_linenumber") % 4).alias("ord"), (k * 10 + F.col("l_linenumber")).alias("hit"), video.alias("media"), (1 + video % 3).cast("int").alias("tier"), k.alias("plays"), (k % 1000).alias("seconds"))
    return media.ranked(media.first_seen(hits))
