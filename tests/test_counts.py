"""Counts of pairs by values of their rows against the pairs themselves; no query makes those."""

import random

import pytest
from pyspark.sql import functions as F

from linkwright.functions.text import show_size
from linkwright.operators import tables as T
from linkwright.plans import library, link, match, media, search, stored
from linkwright.queries import QUERIES
from linkwright.sources.store import Tables, dropped

SF = "/root/testdata/sf0.001"
ROWS = "id long, title string, artist string, album string, duration_ms long"


@pytest.mark.parametrize("name", ["blocked_pairs", "composite_score", "confidence_band", "duration_score"])
def test_reports_make_no_pairs(spark, name, monkeypatch):
    def pairs(*_, **__):
        raise AssertionError("all pairs")

    monkeypatch.setattr(link, "token_pairs", pairs)
    assert QUERIES[name](spark, SF).count() > 0


def test_counts_match_pairs(spark):
    r = random.Random(5)
    pick = lambda n: [(i, r.choice(["a b", "b a", "a c d", "d", " A ", "", None, "e f"]), r.choice(["x", "y", None]), r.choice(["p", "q", None]), r.choice([None, 0, 10_000, 13_000, 16_500, 80_000])) for i in range(n)]
    a, b = spark.createDataFrame(pick(150), ROWS), spark.createDataFrame(pick(150), ROWS)
    pairs = link.scored(link.token_pairs(a, b)).select("a_id", "score", F.coalesce("conflict", F.lit(False)).alias("conflict")).collect()
    want, bands = {}, {}
    for p in pairs:
        lo, hi, n = want.get(p.a_id, (9.0, -1.0, 0))
        want[p.a_id] = (min(lo, p.score), max(hi, p.score), n + 1)
        bands[p.score, p.conflict] = bands.get((p.score, p.conflict), 0) + 1
    with Tables() as tables:
        counts = tables.save(link.score_counts(a, b, tables), "counts")
        each = counts.groupBy("artist", "words", "a_album", "a_duration_ms").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.sum("n").alias("n"))
        got = {x.id: (x.lo, x.hi, x.n) for x in link.of_tracks(a, each, ("album", "duration_ms")).collect()}
        told = {(x.score, x.conflict): x.n for x in counts.groupBy("score", "conflict").agg(F.sum(F.col("n") * F.col("rows")).alias("n")).collect()}
    assert got == want and told == bands and len(pairs) > 1000
    with Tables() as tables:
        assert link.score_counts(a.limit(0), b, tables).count() == 0


def test_copies_add_no_work(spark):
    """Two hundred times the rows are the same counted rows."""
    one = [(i, f"{x} {y}", "z", x, 10_000) for i, (x, y) in enumerate([("a", "b"), ("b", "c"), ("d", "e")])]
    few = spark.createDataFrame(one, ROWS)
    many = few.crossJoin(spark.range(200).withColumnRenamed("id", "n")).withColumn("id", F.col("id") + 10 * F.col("n")).drop("n")
    with Tables() as tables:
        small, large = (link.met_sets(t, t, ("album",), tables) for t in (few, many))
        assert [x.count() for x in small] == [x.count() for x in large] and large[1].agg(F.sum("n")).first()[0] == 200 * small[1].agg(F.sum("n")).first()[0] == 1000


def test_files_of_one_path_are_looked_up_once(spark, monkeypatch):
    """Copies of files and tracks add no row to what is compared, and each track has its file."""
    sizes = {}
    save = library.Tables.save

    def counted(self, df, name):
        table = save(self, df, name)
        sizes[name] = table.count()
        return table

    monkeypatch.setattr(library.Tables, "save", counted)
    files = spark.createDataFrame([(p, t, True) for p, t in (("/m/x/abc one.m4a", 0), ("/o/abc two.m4a", 1), ("/o/abc two.m4a", 2), ("/o/zed.m4a", 1))] * 50, "path string, tier int, readable boolean")
    tracks = spark.createDataFrame([(i, ("Abc", "Zed", None, "Abc")[i % 4], ("X", None, "X", "Y")[i % 4]) for i in range(80)], "id long, title string, artist string")
    got = library.files_at_hand(tracks, files)
    assert {x.id: (x.path, x.tier) for x in got.collect()} == {i: (("/m/x/abc one.m4a", 0), ("/o/zed.m4a", 1), None, ("/o/abc two.m4a", 1))[i % 4] for i in range(80) if i % 4 != 2}
    dropped(got)
    assert sizes["wanted"] == 4 and sizes["files"] == 4 and sizes["pieces"] < 150


def test_videos_of_one_hit_keep_their_order(spark):
    """Whatever the order of rows, videos that score and arrive alike have the same ranks."""
    rows = [(1, 1, 7, m, 3, 50, 200) for m in range(10)]
    ranks = []
    for part in (rows, rows[::-1], rows[5:] + rows[:5]):
        seen = spark.createDataFrame(part, "id int, ord int, hit int, media int, tier int, plays long, seconds int").coalesce(1)
        ranks.append({x["rank"]: x.media for x in media.ranked(seen).collect()})
    assert ranks[0] == ranks[1] == ranks[2] == {i + 1: 9 - i for i in range(8)}


def test_sizes_are_rounded_as_c_does(spark):
    """Exact halves go to the even digit: 1.25 KB is 1.2 KB, 3.75 KB is 3.8 KB; no size has none."""
    r = random.Random(2)
    ns = [0, 1023, 1024, 1280, 3840, 1_048_575, 1_310_720, 3_932_160, 2**30 - 1, 2**30, 2**30 + 2**27, 2**30 * 3 + 2**27 * 3, 5 * 10**14] + [r.randrange(2 ** r.randint(1, 45)) for _ in range(3000)] + [k * 128 for k in range(3000)]
    want = lambda n: f"{n} B" if n < 1024 else "%.1f KB" % (n / 1024) if n < 2**20 else "%.1f MB" % (n / 2**20) if n < 2**30 else "%.2f GB" % (n / 2**30)
    got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", show_size(F.col("n")).alias("s")).collect()
    assert [x for x in got if x.s != want(x.n)] == []
    assert spark.range(1).select(show_size(F.lit(None).cast("long")).alias("s")).first().s is None


def test_equal_tracks_are_planned_once(spark):
    """Of two hundred tracks of two kinds two reach the parsers, and plans are those of each alone."""
    kinds = [("夜に駆ける (x)", ["YOASOBI"], None, ["y"]), ("b", None, "c", None)]
    t = spark.createDataFrame([(i, *kinds[i % 2]) for i in range(200)], "id long, title string, artists array<string>, trans_title string, aliases array<string>")
    got = {}
    for x in search.planned(t).orderBy("id", "ord").collect():
        got.setdefault(x.id, []).append(tuple(x)[1:])
    alone = [[tuple(x)[1:] for x in search.planned(t.where(F.col("id") == i)).orderBy("ord").collect()] for i in (0, 1)]
    assert len(got) == 200 and all(got[i] == alone[i % 2] for i in got)
    plan = search.planned(t)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("ArrowEvalPython") < plan.rindex("Aggregate [title")
    fronts = ["cn", "hk", "cn", "us"]
    relaxed = lambda df: sorted(tuple(x) for x in df.collect())
    few = t.where("id < 2")
    rows = relaxed(search.relaxed_plans(search.plans(few), fronts))
    assert rows == relaxed(search.relaxed(search.planned(few), fronts))
    assert [(o, f) for i, o, _, f in rows if i == 0] == [(1, "cn"), (2, "cn"), (3, "cn"), (4, "hk"), (5, "hk"), (6, "hk")]


def test_rolling_counts_of_crowded_moments(spark):
    """Equal to a count one by one, with many rows at a moment, none of a group's, times before 1970 and missing ones; no frame slides over rows."""
    r = random.Random(4)
    rows = [(i, r.choice(["a", "b", None]), r.choice([None, *range(-3, 9000, 450)])) for i in range(600)]
    t = spark.createDataFrame(rows, "n int, g string, at long").withColumn("ts", F.timestamp_seconds("at"))
    counted = T.rolling_count(t, "g", "ts", 3600)
    want = {n: sum(h == g and (b == a if a is None or b is None else a - 3600 < b <= a) for _, h, b in rows) for n, g, a in rows}
    assert {x.n: x.recent for x in counted.collect()} == want and counted.columns == [*t.columns, "recent"]
    assert "-3599999999" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_not_sorted_for_their_roles(spark, monkeypatch):
    """Lists of names are told apart by a distinct; the first row of a group would sort all pairs with all that was parsed of them."""

    def first(*_, **__):
        raise AssertionError("sorted aggregate")

    monkeypatch.setattr(match.F, "first", first)
    rows = [(i, i, i, "Song", ["A", "B"][: 1 + i % 2], "x", 200_000, None, "Song", ["B", "A"], "x", 200_000, None) for i in range(40)]
    sides = ", ".join(f"{s}_title string, {s}_artists array<string>, {s}_album string, {s}_duration_ms long, {s}_isrc string" for s in "ab")
    scored = match.score_pairs(spark.createDataFrame(rows, f"id long, match_id long, insertion int, {sides}"))
    got = {x.id: (x.title_score, x.artist_score) for x in scored.collect()}
    assert len(got) == 40 and all(got[i] == got[i % 2] for i in got) and got[0] == got[1] == (1.0, 1.0)
    dropped(scored)


def test_keys_are_parsed_on_all_cores(spark):
    """Titles of a small file are parsed by as many tasks as there are cores; artists of a batch once each."""
    t = spark.createDataFrame([(i, f"Song {i}", ["A"], None, "list", str(i)) for i in range(100)], "id long, title string, artists array<string>, isrc string, source string, original_id string").coalesce(1)
    keys = stored.result_keys(t)
    assert keys.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    assert {(x.id, x.place, x.key.split("\x1f")[-3]) for x in keys.collect() if x.place == 2} == {(i, 2, f"song {i}") for i in range(100)}
