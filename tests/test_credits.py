"""Roles of credits, the code path, assembled results, written tables and readers, with exact values."""

import pytest
from pyspark.sql import functions as F

from linkwright.operators import credits as C
from linkwright.operators import score as S
from linkwright.operators import tables as T
from linkwright.plans import match
from linkwright.sources import readers, store

PRIMARY = ["primary_artist_mismatch"]


@pytest.mark.parametrize("a, b, title_credits, likeness, identity, artist, role, conflicts", [
    (["A One"], ["A One"], ([], []), 1.0, True, 1.0, None, []),
    (["Taro Yamada"], ["Yamada Taro"], ([], []), 1.0, True, 1.0, None, []),
    (["A One", "B Two"], ["B Two", "A One"], ([], []), 1.0, True, 1.0, None, []),
    (["A One"], ["B Two & A One"], ([], []), 1.0, True, 1.0, None, []),
    (["周华健"], ["Emil Wakin Chau"], ([], []), 1.0, True, 1.0, None, []),
    (["さくら"], ["Sakura"], ([], []), 1.0, True, 1.0, None, []),
    (["C Three"], ["A One feat. C Three"], ([], []), 0.6, False, 0.6, None, PRIMARY),
    (["John Williams"], ["John Williamson"], ([], []), 0.9, False, 0.9, None, []),
    (["A One"], ["Z Nine"], ([], []), 0.2, False, 0.2, None, ["artist_mismatch"]),
    (["A One"], ["Z Nine"], ([], []), 0.5, False, 0.5, None, PRIMARY),
    (["A One"], ["HOYO-MiX"], ([], ["A One"]), 0.92, True, 0.92, "vocalist", []),
    (["HOYO-MiX", "A One"], ["HOYO-MiX"], ([], []), 1.0, False, 0.92, "project", []),
    (["HOYO-MiX", "A One"], ["HOYO-MiX", "Z Nine"], ([], []), 1.0, False, 0.5, None, PRIMARY),
    ([], ["A One"], ([], []), 0.0, False, 0.0, None, []),
])
def test_credit_analysis(spark, a, b, title_credits, likeness, identity, artist, role, conflicts):
    df = spark.createDataFrame([(a, b, *title_credits)], "a_artists array<string>, b_artists array<string>, a_credits array<string>, b_credits array<string>")
    groups = [["周华健", "Emil Wakin Chau"]]
    roled = C.with_roles(C.with_roles(df, "a", groups), "b", groups)
    got = roled.select(C.credit_analysis(F.col("a_roles"), F.col("b_roles"), F.lit(likeness)).alias("c")).first().c
    assert (got.identity, round(got.artist, 6), got.role, got.conflicts) == (identity, artist, role, conflicts)


@pytest.mark.parametrize("conflicts, score, title, artist, want", [
    ([], 0.3, 0.1, 0.1, (1.0, "strong", "auto_accept")), (["duration_conflict"], 0.99, 0.9, 0.9, (0.95, "conflict", "review")), (["duration_conflict"], 0.2, 0.6, 0.1, (0.65, "conflict", "review")),
    (["duration_conflict"], 0.9, 0.46, 0.45, (0.4, "conflict", "no_match")), (["title_mismatch"], 0.9, 0.9, 0.9, (0.4, "conflict", "no_match")),
])
def test_code_path(spark, conflicts, score, title, artist, want):
    df = spark.createDataFrame([(conflicts, score, title, artist)], "c array<string>, s double, t double, a double")
    assert tuple(df.select(S.code_path(F.lit(True), F.col("c"), F.col("s"), F.col("t"), F.col("a")).alias("m")).first().m) == want
    assert df.select(S.code_path(F.lit(False), F.col("c"), F.col("s"), F.col("t"), F.col("a")).alias("m")).first().m is None


def test_assembled(spark):
    results = spark.createDataFrame([(1, 10, "auto_accept", [10]), (2, 20, "review", [20]), (3, 30, "no_match", [30]), (4, None, "no_match", []), (5, None, "no_match", None), (6, None, "no_match", [])], "id int, match_id int, decision string, candidates array<int>")
    outcomes = spark.createDataFrame([(1, 0, "timeout", None), (3, 0, "rate_limited", 7.0), (4, 0, "timeout", None), (4, 1, "rate_limited", None), (4, 2, "rate_limited", 3.0), (5, 0, "rate_limited", None), (6, 0, "ok", None)], "id int, ordinal int, kind string, retry_after double")
    got = {r.id: (r.search_status, r.selected_id, r.retry_after, r.incomplete) for r in match.assembled(results, outcomes).collect()}
    assert got == {1: ("matched", 10, None, True), 2: ("review", 20, None, False), 3: ("no_match", None, None, True), 4: ("rate_limited", None, 3.0, True), 5: ("rate_limited", None, 10.0, True), 6: ("no_match", None, None, False)}
    assert {r.id: r.retry_after for r in T.retry_after(outcomes, "id").collect()} == {3: 7.0, 4: 3.0, 5: 10.0}
    assert {r.id: r.kind for r in T.failure_of(outcomes, "id", ["auth_failed", "rate_limited", "timeout"]).collect()} == {1: "timeout", 3: "rate_limited", 4: "rate_limited", 5: "rate_limited", 6: "no_match"}


def test_gates(spark):
    df = spark.createDataFrame([(None, 1), (0, 2), (19, 3), (20, 4), (900, 1), (901, 2)], "s int, t int")
    assert [tuple(r) for r in df.select(S.length_gate(F.col("s")), S.fetch_gate(F.col("t"))).collect()] == [(True, "auto"), (True, "auto"), (False, "manual"), (True, "manual"), (True, "auto"), (False, "auto")]


def test_written_tables(spark):
    rows = spark.createDataFrame([(1, i, "song") for i in range(7)] + [(2, 9, "song")], "p int, t int, k string")
    got = store.write_batches(rows, "p", "t", "k", 3).orderBy("playlist", "track").collect()
    assert [(r.playlist, r.batch, r.track) for r in got] == [(1, i // 3, i) for i in range(7)] + [(2, 0, 9)]
    left, counts = store.delete_by_key(rows, spark.createDataFrame([(1,), (1,), (5,)], "p int"), ["p"])
    assert left.count() == 1 and {r.p: r.deleted for r in counts.collect()} == {1: 7, 5: 0}
    tracks = spark.createDataFrame([(i,) for i in range(4)], "id int")
    results = spark.createDataFrame([(0, "auto_accept"), (1, "review"), (2, "no_match")], "id int, decision string")
    assert sorted((r.id, r.decision) for r in store.write_unmatched(tracks, results).collect()) == [(2, "no_match"), (3, "no_match")]
    assert store.sync_counts(rows.where("t < 5"), rows.where("t > 2"), "k", "t").first().asDict() == {"k": "song", "added": 3, "removed": 3, "kept": 2}


def test_counts_in_time_and_ranks_of_hot_groups(spark):
    ticks = spark.createDataFrame([("a", float(t)) for t in (0, 1, 3599, 3600, 3601, 9000)], "g string, at double").withColumn("ts", F.timestamp_seconds("at"))
    assert {r.at: r.recent for r in T.rolling_count(ticks, "g", "ts", 3600).collect()} == {0: 1, 1: 2, 3599: 3, 3600: 3, 3601: 3, 9000: 1}
    values = spark.createDataFrame([("a", i % 10) for i in range(1000)] + [("b", 5), (None, 1), (None, 2)], "g string, v int")
    assert {r.g: r.v_p for r in T.nearest_rank(values, "g", "v", 0.95).collect()} == {"a": 9, "b": 5, None: 2}


def test_csv_with_a_header_of_its_own_in_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Artist,歌名,ISRC\n"X/Y","Line\nbreak",usabc1234567\nArtist,歌名,ISRC\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("Plain,Someone\nAgain,\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("", encoding="utf-8")
    got = sorted((r.title, tuple(r.artists), r.isrc) for r in readers.read_csv(spark, str(tmp_path)).collect())
    assert got == sorted([("Line\nbreak", ("X", "Y"), "USABC1234567"), ("歌名", ("Artist",), "ISRC"), ("Plain", ("Someone",), None), ("Again", (), None)])


def test_newest_file_of_a_name(spark, tmp_path):
    import os

    for name, time in (("a/One - Song.mp3", 100), ("b/One - Song.mp3", 300), ("c/one - song.mp3", 200)):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_bytes(b"x" * time)
        os.utime(tmp_path / name, (time, time))
    assert [(r.length, r.title) for r in readers.audio_files(spark, str(tmp_path)).collect()] == [(300, "Song")]
