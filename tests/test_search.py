"""Bounded retrieval, search by phases, identity of candidates, and tables that go away."""

import os

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from linkwright.functions.text import tokens
from linkwright.operators import score as S
from linkwright.plans import identity, link, match, search
from linkwright.plans import stored as R
from linkwright.queries.matching import GROUPS, quality_corpus
from linkwright.sources import store
from linkwright.sources.store import dropped

SF = "/root/testdata/sf0.001"


def folders(spark):
    at = store.work_dir(spark)
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def plain_topk(queries, catalog, limit):
    """Every row that shares a word, counted and ranked."""
    words = lambda *cs: F.explode(tokens(F.concat_ws(" ", *cs)))
    q = queries.select("id", "ord", words("query").alias("word"))
    c = catalog.select(F.col("id").alias("match_id"), words("title", "artist").alias("word"))
    hits = q.join(c, "word").groupBy("id", "ord", "match_id").agg(F.count("*").alias("common"))
    w = Window.partitionBy("id", "ord").orderBy(F.col("common").desc(), "match_id")
    return hits.withColumn("hit", F.row_number().over(w)).where(F.col("hit") <= limit).select("id", "ord", "match_id", "hit")


def test_retrieval_matches_the_plain_join(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    often = 1 / np.arange(1, 61)
    text = lambda n: " ".join(rng.choice(words, n, p=often / often.sum()))
    catalog = spark.createDataFrame([(i, text(int(rng.integers(1, 7))), text(2)) for i in range(800)] + [(2000 + i, "w0 w1", "w2") for i in range(60)] + [(3000, None, None)], "id long, title string, artist string")
    queries = spark.createDataFrame([(i, 1 + i % 3, text(int(rng.integers(1, 12)))) for i in range(200)] + [(500, 1, "w0 w1 w2"), (501, 1, "unheard"), (502, 1, ""), (503, 1, None), (504, 1, "w0 unheard")], "id long, ord int, query string")
    for limit in (1, 5, 10):
        assert sorted(map(tuple, search.retrieve(queries, catalog, limit).collect())) == sorted(map(tuple, plain_topk(queries, catalog, limit).collect()))


def test_retrieval_grows_with_the_table(spark):
    """Ten times the parts: the plain join meets a hundred times the pairs, the bounded search about as many as the sets of words."""
    met = {}
    for sf in ("sf0.001", "sf0.01"):
        p = spark.read.parquet(f"/root/testdata/{sf}/part.parquet")
        catalog = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"))
        sets = search.library_sets(catalog, 10)
        steps = []
        with store.Tables() as tables:
            asked = sets.select("set", "words")
            best = search.top_sets(asked, tables.save(sets, "sets"), 10, tables, steps=steps)
            assert best.count() > 0
        met[sf] = sum(s["pairs"] for s in steps), asked.count()
        assert [s["queries"] for s in steps] == sorted((s["queries"] for s in steps), reverse=True)
        words = catalog.select(F.explode(tokens(F.concat_ws(" ", "title", "artist"))).alias("w")).groupBy("w").count()
        assert met[sf][0] < words.agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    rows = {sf: pairs / asked for sf, (pairs, asked) in met.items()}
    assert rows["sf0.01"] < 12 * rows["sf0.001"]


@pytest.fixture(scope="module")
def corpus(spark):
    tracks, catalog, _ = quality_corpus(spark, SF)
    return tracks.where("id < 600").cache(), catalog.where("id < 600").cache()


def test_phases_match_a_replay_of_all_prefixes(spark, corpus):
    """All candidates of all queries are scored at once, and each prefix is decided on its own."""
    tracks, catalog = corpus
    found = search.candidates(search.retrieve(search.planned(tracks, "cn"), catalog.select("id", "title", F.array_join("artists", " ").alias("artist")), 10))
    scored = match.score_pairs(match.pair_up(tracks, catalog, found.select("id", "match_id", "insertion", "first_query")), GROUPS).cache()
    last = {r.id: r.n for r in search.planned(tracks, "cn").groupBy("id").agg(F.max("ord").alias("n")).collect()}
    want = {}
    for n in range(1, 9):
        for r in match.decided(scored.where(F.col("first_query") <= n)).collect():
            if r.id not in want or want[r.id][1] != "auto_accept":
                want[r.id] = (r.match_id, r.decision, r.score, n if r.decision == "auto_accept" else last[r.id])
    for bands in (match.BANDS, ((1, 8),), tuple((i, i) for i in range(1, 4)) + ((4, 8),)):
        steps = []
        got = match.stepwise(tracks, catalog, None, GROUPS, bands=bands, steps=steps)
        assert {r.id: (r.match_id, r.decision, r.score, r.prefix) for r in got.collect()} == want
        opened = [s["tracks"] for s in steps]
        assert opened == sorted(opened, reverse=True) and (len(opened) < 2 or opened[-1] < opened[0])
        store.dropped(got)


def test_match_stops_early_and_leaves_one_table(spark, corpus):
    tracks, catalog = corpus
    before = folders(spark)
    out = match.match(tracks, catalog, GROUPS)
    rows = {r.id: r for r in out.collect()}
    assert len(rows) == tracks.count() and {r.queries for r in rows.values() if r.decision == "auto_accept"} >= {1}
    left = folders(spark) - before
    assert len(left) == 1
    store.dropped(out)
    assert folders(spark) == before


def test_only_own_tables_are_dropped(spark, tmp_path):
    mine = store.saved(spark.range(3), "mine")
    outside = str(tmp_path / "input")
    spark.range(5).write.parquet(outside)
    with pytest.raises(ValueError):
        store.dropped(spark.read.parquet(outside))
    with pytest.raises(ValueError):
        store.dropped(mine.join(spark.read.parquet(outside), "id"))
    assert mine.count() == 3 and spark.read.parquet(outside).count() == 5
    store.dropped(mine)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(mine.inputFiles()[0]).count()


def test_identity_matches_one_by_one(spark):
    """Candidates as they arrive, each kept under the one key that it has."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        pick = lambda xs: xs[int(rng.integers(0, len(xs)))]
        rows.append((int(rng.integers(0, 12)), i, pick(["q1", "q2", "q3", None]), pick(["native", "script", "mapped"]), bool(rng.random() < 0.2), pick([None, None, 1, 2]), pick([None, "", " ab1", "AB1 "]), pick([None, "live"]), pick([None, "japanese"]), pick(["Song", "song ", None]), pick([["X"], ["x", "Y"], []]), pick([None, 1000, 3999, 4000])))
    found = spark.createDataFrame(rows, "id int, ord int, query string, path string, mapped boolean, match_id int, isrc string, version string, language string, title string, artists array<string>, duration_ms long")
    want = {}
    for r in rows:
        track, ord_, query, path, mapped, match_id, isrc, version, language, title, artists, ms = r
        if match_id is not None:
            key = ("id", str(match_id))
        elif (isrc or "").strip():
            key = ("code", isrc.strip().upper(), version or "original", language or "")
        else:
            key = ("text", (title or "").strip().lower(), (artists[0] if artists else "").lower(), str((ms or 0) // 4000), language or "")
        own = want.setdefault((track, "\x1f".join(key)), {"ord": ord_, "queries": [], "mapped": mapped, "path": path, "title": title})
        if query is not None and query not in own["queries"]:
            own["queries"].append(query)
        if mapped and not own["mapped"]:
            own |= {"mapped": True, "path": path}
    got = {(r.id, r.key): {"ord": r.ord, "queries": r.queries, "mapped": r.mapped, "path": r.path, "title": r.title} for r in identity.merged(found).collect()}
    assert got == want


def test_stored_results_survive_changes_of_rules(spark, tmp_path):
    """A result is written under its keys; a second look takes it, scores it again or misses it; what a person confirmed stays."""
    schema = "id long, title string, artists array<string>, album string, duration_ms long, isrc string, source string, original_id string"
    tracks = spark.createDataFrame([(1, "Blue Sky", ["Ana"], "A", 200_000, "USAB12345678", "list", "k1"), (2, "Red Sea (Live)", ["Bo"], None, 100_000, None, "list", "k2"), (3, "Green", ["Cy"], None, None, None, "unknown", None), (4, "Review Me", ["Di"], None, None, "USAB00000004", "list", "k4")], schema)
    results = spark.createDataFrame([(1, 11, "auto_accept", False), (2, 12, "user_confirmed", False), (3, 13, "auto_accept", True), (4, 14, "review", False)], "id long, match_id long, decision string, incomplete boolean")
    candidates = tracks.select("id", F.lit(1).alias("rank"), (F.col("id") + 10).alias("match_id"), "title", "artists", "album", "duration_ms", "isrc")
    now, current = F.lit("2026-01-01").cast("timestamp"), {"policy": 1, "alias": 1, "scoring": 1}
    path = str(tmp_path / "results")
    R.put(spark, path, R.results_to_store(results, tracks, candidates, "CN", now, current))
    keys = {r.key.split("\x1f")[0] + str(r.match_id) for r in R.at_path(spark, path).collect()}
    assert keys == {"code11", "source11", "text11", "source12", "text12"}
    see = lambda **more: {r.id: (r.match_id, r.decision, r.place, r.how) for r in R.lookup(tracks, R.at_path(spark, path), "cn", more.pop("at", now), current | more)[0].collect()}
    assert see() == {1: (11, "auto_accept", 0, "stored"), 2: (12, "user_confirmed", 1, "stored")}
    assert see(scoring=2) == {1: (11, "auto_accept", 0, "rescored"), 2: (12, "user_confirmed", 1, "stored")}
    assert see(at=F.lit("2026-03-01").cast("timestamp")) == {}
    other = tracks.withColumn("isrc", F.lit(None).cast("string")).withColumn("original_id", F.lit(None).cast("string"))
    hits, rescored = R.lookup(other, R.at_path(spark, path), "cn", now, current | {"alias": 2})
    assert {r.id: (r.match_id, r.how) for r in hits.collect()} == {1: (11, "verified"), 2: (12, "verified")}
    R.put(spark, path, rescored)
    assert {(r.key.split("\x1f")[0], r.alias) for r in R.at_path(spark, path).where("match_id = 11").collect()} == {("code", 1), ("source", 1), ("text", 2)}


def test_code_path_column(spark):
    """No key without a code."""
    t = spark.createDataFrame([(1, "short", "x"), (2, None, "x")], "id long, isrc string, title string")
    assert match.by_code(t, t).count() == 0


def test_best_pairs_match_all_pairs_and_grow_with_the_table(spark):
    """Titles of one to four words, some of them frequent; equal rows, rows without album or duration, and rows without a title."""
    words = ["the", "love", "of", "night", *[f"w{i}" for i in range(12)]]

    def rows(n, seed):
        import random

        r = random.Random(seed)
        return [(i, None if i % 41 == 0 else " ".join(r.choice(words[:4] if r.random() < 0.5 else words) for _ in range(r.randint(1, 4))), r.choice(["x", "y", None]), r.choice(["p", "q", None]), r.choice([None, 100_000, 104_000, 180_000])) for i in range(n)]

    schema = "id long, title string, artist string, album string, duration_ms long"
    a, b = spark.createDataFrame(rows(90, 1), schema), spark.createDataFrame(rows(250, 2), schema)
    columns = ["a_id", "b_id", "score", "rank"]
    for limit in (1, 2, 5):
        every = S.ranked(link.scored(link.token_pairs(a, b)), "a_id", "score", "b_id").where(F.col("rank") <= limit)
        best = link.best_pairs(a, b, limit, salts=2)
        assert sorted(best.select(columns).collect()) == sorted(every.select(columns).collect())
        dropped(best)

    # every artist has more songs with one frequent word, which none of the rare titles ever meets
    def frequent(n):
        common = [(i, f"common t{i}", "x", None, None) for i in range(n)]
        asked = spark.createDataFrame([(i, f"common t{i}", "x", None, None) for i in range(0, n, 5)], schema)
        steps = []
        dropped(link.best_pairs(asked, spark.createDataFrame(common, schema), 1, salts=2, steps=steps))
        return sum(s["pairs"] for s in steps)

    assert frequent(400) == 80 and frequent(800) == 160


def test_best_pairs_of_many_albums_and_durations(spark):
    """Titles with many albums and durations, in steps of the score, missing ones and ones that tell nothing: equal to all pairs, without scoring them."""
    import random

    schema = "id long, title string, artist string, album string, duration_ms long"
    r = random.Random(7)
    times = [None, 1_000, *[200_000 + s * 1_000 for s in (0, 3, 4, 6, 7, 8, 9, 15, 16, 17, 40)]]
    rows = lambda n: [(i, r.choice(["one", "one two", "two three", "one two three"]), r.choice(["x", "y"]), r.choice([None, "p", "q", "r"]), r.choice(times)) for i in range(n)]
    a, b = spark.createDataFrame(rows(80), schema), spark.createDataFrame(rows(300), schema)
    columns = ["a_id", "b_id", "score", "rank", "title_score", "album_score", "duration_score", "conflict"]
    for limit in (1, 3):
        every = S.ranked(link.scored(link.token_pairs(a, b)), "a_id", "score", "b_id").where(F.col("rank") <= limit)
        best = link.best_pairs(a, b, limit, salts=2)
        assert sorted(map(repr, best.select(columns).collect())) == sorted(map(repr, every.select(columns).collect()))
        dropped(best)

    def scored(n):
        asked, held = ([(i, "one", "x", f"album {i % 20}", 10_000 * (i % 300) + 20_000) for i in range(start, start + n)] for start in (0, 1))
        steps = []
        dropped(link.best_pairs(spark.createDataFrame(asked, schema), spark.createDataFrame(held, schema), 2, salts=2, steps=steps))
        return steps[-1]["scored"]

    assert scored(150) <= 150 * 8 and scored(300) <= 300 * 8
