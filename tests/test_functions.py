from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from linkwright.functions import arrow, notes, text, titles
from linkwright.operators import score as S
from linkwright.operators import tables as T
from linkwright.sources import readers


@pytest.mark.parametrize("kana, latin", [("さくら", "sakura"), ("キャット", "kyatto"), ("じゅん", "jun"), ("っ", ""), ("ティー", "ti"), ("がっこう", "gakkou"), ("x", "x"), (None, "")])
def test_romaji(kana, latin):
    assert arrow.romaji(kana) == (latin if kana != "っ" else "っ")


@pytest.mark.parametrize("a, b", [("abc", "abd"), ("red widget", "blue widget"), ("", "x"), ("same", "same"), ("abcdefgh", "zzzzyyyy")])
def test_ratio_bounds(a, b):
    r = arrow.ratio(a, b)
    assert 0 <= r <= 1
    if len(a) > 3 and set(a) & set(b) and a != b and len(set(a) & set(b)) / min(len(a), len(b)) >= 0.2:
        assert r == SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("display, known, names", [("A & B", ["A", "B"], ["A", "B"]), ("Earth, Wind & Fire", ["Earth, Wind & Fire"], ["Earth, Wind & Fire"]), ("A, B & C", ["A", "B", "C"], ["A", "B", "C"]), ("", ["Z"], ["Z"]), ("A & B", [], ["A", "B"])])
def test_credits(display, known, names):
    assert arrow.split_credits(display, known) == names


def test_title_parts():
    t = titles.parse_title("Song (Live) (feat. Ana)")
    assert (t["core"], t["tags"], t["credits"]) == ("Song", ["live"], ["Ana"])
    assert titles.parse_title("夜に駆ける (Racing into the Night)")["variants"][0]["text"] == "Racing into the Night"
    assert titles.parse_title(None)["core"] == ""
    assert titles.parse_artists(["群星"])["primary"] == ""


def test_notes(spark):
    rows = spark.createDataFrame([("Live", True), ("The Show", False), ("Live and Let Die", False), ("吉他版", True), ("Guitar Ver.", True), ("", True)], "v string, want boolean")
    assert [r for r in rows.select("v", "want", notes.is_note(F.col("v")).alias("got")).collect() if r["want"] != r["got"]] == []


def test_durations(spark):
    rows = spark.createDataFrame([(10_000, 12_000, 1.0), (10_000, 15_000, 0.9), (10_000, 18_000, 0.4), (10_000, 30_000, 0.0), (1, 10_000, None), (None, 10_000, None)], "a long, b long, want double")
    got = rows.select("want", S.duration_similarity(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_upsert_last_write_wins(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(2, 3, "d"), (2, 2, "c"), (3, 1, "e")], "k int, v int, x string")
    assert sorted((r.k, r.x) for r in T.upsert(old, new, ["k"], "v").collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# list\n\nOne - A/B\nTwo\tC\nThree\n")
    assert [(r.title, r.artists) for r in readers.read_text(spark, str(tmp_path / "a.txt")).collect()] == [("One", ["A", "B"]), ("Two", ["C"]), ("Three", [])]
    (tmp_path / "b.csv").write_text('﻿artist,title,isrc\nA/B,"Hello, World",us123\nC,,x\n')
    got = readers.read_csv(spark, str(tmp_path / "b.csv")).collect()
    assert [(r.title, r.artists, r.isrc) for r in got] == [("Hello, World", ["A", "B"], "US123")]
    (tmp_path / "c.csv").write_text("One,A\nTwo\n")
    assert [(r.title, r.artists) for r in readers.read_csv(spark, str(tmp_path / "c.csv")).orderBy("line").collect()] == [("One", ["A"]), ("Two", [])]


def test_csv_with_many_columns_and_empty_titles(spark, tmp_path):
    (tmp_path / "wide.csv").write_text(",".join([f"x{i}" for i in range(40)] + ["title", "artist"]) + "\n" + ",".join(["v"] * 40 + ["Far Right", "A/B"]) + "\n" + ",".join(["v"] * 40 + ["", "C"]) + "\n")
    (tmp_path / "bare.csv").write_text('"Multi\nLine",A\n,B\nPlain\n')
    rows = {(r.title, tuple(r.artists)) for r in readers.read_csv(spark, str(tmp_path / "*.csv")).collect()}
    assert rows == {("Far Right", ("A", "B")), ("Multi\nLine", ("A",)), ("", ("B",)), ("Plain", ())}


def test_config():
    from linkwright.config import LinkConfig

    assert LinkConfig(storefront="HK").storefronts == ("hk", "tw", "us")


NOTES = ["Live", "x", "", "Guitar Ver", "Guitar Ver.", "The Show", "Live and Let Die", "Live at Wembley", "recorded in Rome", "Eras Tour", "World Tour Live", "Take 2", "First Take 2", "吉他版", "音乐节 现场", "《剧》电视剧片头曲", "电影插曲", "Theme Song from X", "OST", "cover: 某人", "Cover Me", "covers", "2024 Acoustic Live", "Japanese Ver. Live", "翻唱", "the remix", "a mix", "Club-Mix", "Guitar Song", "(live)", "director's cut", "夜曲", "Part 2"]


def test_notes_by_column_and_by_value_agree(spark):
    rows = spark.createDataFrame([(v,) for v in NOTES], "v string")
    assert {r.v: r.n for r in rows.select("v", notes.is_note(F.col("v")).alias("n")).collect()} == {v: notes.annotates(v) for v in NOTES}
    assert all(notes.annotates(v) for v in ("Live at Wembley", "Guitar Ver", "First Take 2", "音乐节 现场", "电影插曲", "OST", "翻唱")) and not any(notes.annotates(v) for v in ("The Show", "Live and Let Die", "Guitar Song", "夜曲", "Part 2", "covers"))


def test_ratio_by_column_and_by_value_agree(spark):
    pairs = [("", ""), ("", "a"), ("a", "a"), ("a", "ab"), ("ab", "ab"), ("abcdefgh", "abcdefghi"), ("abcd", "wxyz"), ("abcd", "a" * 40), ("night song", "nights song"), (None, "x"), ("abcdefg", "gfedcba")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    assert [round(r.r, 12) for r in rows.select(arrow.sequence_ratio("a", "b").alias("r")).collect()] == [round(arrow.ratio(a, b), 12) for a, b in pairs]
