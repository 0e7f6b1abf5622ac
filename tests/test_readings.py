"""Readings by tables against plain versions, and payloads whose values vary in shape."""

import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from linkwright.functions import arrow
from linkwright.operators import readings as R
from linkwright.sources import payloads as P

COMPOUNDS = [(1, "夜空", "yozora"), (2, "夜", "yoru"), (3, "空の", "sora no"), (4, "空", "sora"), (5, "qq", "x y"), (6, "夜", "never"), (7, None, "z"), (8, "花火", None), (9, "打上花火", "uchiage hanabi")]
LETTERS = [("花", 1, "hana"), ("花", 2, "ka"), ("火", 1, "hi"), ("火", 2, "ka"), ("火", 3, "bi"), ("山", 1, "yama"), ("山", 2, "san"), ("川", 1, "kawa"), ("海", 1, "umi"), ("海", 2, "kai"), ("星", 1, "hoshi"), ("星", 2, "sei"), ("星", 3, "sho"), ("月", 1, "tsuki"), ("月", 2, "getsu"), ("月", 3, "gatsu")]


def plain_spoken(text):
    for _, written, read in COMPOUNDS:
        if written and read is not None:
            text = text.replace(written, f" {read} ")
    return text


def plain_variants(text, artist):
    said = plain_spoken(text)
    if said == text and not re.search("[぀-ヿ]", text):
        return []
    clean = lambda s: re.sub(r"\s+", " ", s).strip().lower()
    found = [clean(arrow.romaji(said))]
    found.append(re.sub(r"[^\w]", "", found[0]))
    table = {}
    for letter, _, read in LETTERS:
        table.setdefault(letter, []).append(read)
    slots = [table.get(c, [arrow.romaji(c).lower()]) for c in text]
    size = 1
    for s in slots:
        size *= len(s)
    if 0 < sum(c in table for c in text) <= 4 and size <= 32:
        for combo in itertools.product(*slots):
            found += [clean("".join(combo)), re.sub(r"[^\w]", "", "".join(combo)).lower()]
    kept = list(dict.fromkeys(f for f in found if f and not re.search("[一-龥]", f)))
    if artist:
        kept += [x for v in kept if len(v.split(" ")) == 2 for x in (" ".join(v.split(" ")[::-1]), "".join(v.split(" ")[::-1]))]
    return list(dict.fromkeys(kept))


def test_readings_match_one_by_one(spark):
    rng = random.Random(9)
    pieces = ["夜空", "夜", "空", "の", "さ", "く", "ら", "qq", "q", "花", "火", "山", "川", "海", "星", "月", " ", "X", "ー", "打上", "!", "東", "っ"]
    texts = sorted({"".join(rng.choice(pieces) for _ in range(rng.randint(0, 7))) for _ in range(400)} | {"打上花火", "", "夜" * 3000, "さくら 花"})
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    compounds = R.checked(spark.createDataFrame(COMPOUNDS, "place int, written string, read string")).cache()
    letters = spark.createDataFrame(LETTERS, "letter string, place int, read string")
    got = {r.text: r.reading for r in R.compound_reading(df, compounds).collect()}
    assert got == {t: re.sub(r"\s+", " ", arrow.romaji(plain_spoken(t))).strip().lower() for t in texts} | {None: ""}
    for artist in (False, True):
        got = {r.text: r.variants for r in R.reading_variants(df, compounds, letters, artist).collect()}
        assert got == {t: plain_variants(t, artist) for t in texts} | {None: []}
        assert max(len(v) for v in got.values()) > 10
    assert R.reading_variants(df.limit(0), compounds, letters).count() == 0


@pytest.mark.parametrize("row", [(1, "a b", "x"), (1, "ka", "kaka")])
def test_tables_that_would_replace_replaced_text(spark, row):
    with pytest.raises(ValueError):
        R.checked(spark.createDataFrame([row], "place int, written string, read string"))


def test_equivalents(spark):
    body = lambda data, by: json.dumps({"data": [{"id": d} for d in data], "meta": {"filters": {"equivalents": by}}})
    answers = [(1, body(["x", "y", "z"], {"a": [{"id": "y"}], "b": ["z"], "c": {"id": "x"}, "d": "y", "e": "gone", "f": [], "g": 5, "h": [[1]]})), (2, body(["x"], {})), (3, body(["x"], {"a": "gone"})), (4, body([], {"a": "x"})), (5, "{}"), (6, "[1]"), (7, None), (9, '{"data": "odd"}')]
    asked = [(1, i) for i in "abcdefghi"] + [(2, "a"), (3, "a"), (3, "b"), (4, "a"), (5, "a"), (6, "a"), (7, "a"), (8, "a"), (9, "a"), (9, None), (2, "a")]
    got = P.equivalents(spark.createDataFrame(asked, "request int, id string"), spark.createDataFrame(answers, "request int, j string").select("request", F.try_parse_json("j").alias("body")))
    want = {(1, i): t for i, t in zip("abcdefghi", ["y", "z", "x", "y", None, None, None, None, None], strict=True)} | {(2, "a"): "x", (3, "a"): None, (3, "b"): None, (4, "a"): None, (5, "a"): None, (9, "a"): None}
    assert {(r.request, r.id): r.target for r in got.collect()} == want


def test_playlists_and_sanitized(spark):
    lists = {"data": [{"id": "1", "attributes": {"name": "N", "description": {"standard": "S", "short": "x"}, "canEdit": True, "artwork": {"url": "u"}}}, {"id": "2", "attributes": {"description": "T"}}, {"id": "3", "attributes": {"description": {}}}, {"id": "4"}]}
    df = spark.createDataFrame([(json.dumps(lists),), ("{}",), (None,)], "j string").select(F.try_parse_json("j").alias("v"))
    got = [(r.pos, r.id, r.name, r.description, r.can_edit, r.artwork_url) for r in P.playlists(df, "v").orderBy("pos").collect()]
    assert got == [(0, "1", "N", "S", True, "u"), (1, "2", P.UNNAMED, "T", False, None), (2, "3", P.UNNAMED, None, False, None), (3, "4", P.UNNAMED, "", False, None)]
    made = {"Token": "x", "a": [{"userPassword": 1, "b": "Bearer abcdefghijklmnop"}, "key=abcdefghijk", ["/home/me/x", None, 1.5, True, 7]], "deep": {"deeper": {"SESSION_ID": 2, "ok": "C:\\Users\\me\\f"}}, "t": ""}
    rows = spark.createDataFrame([(json.dumps(made),), ("5",), (None,), ('"secret=0123456789"',)], "j string").select("j", F.to_json(P.sanitized(F.try_parse_json("j"))).alias("s")).collect()
    assert json.loads(rows[0].s) == {"a": [{"b": "Bearer [REDACTED]"}, "key=[REDACTED]", ["[USER_HOME]/x", None, 1.5, True, 7]], "deep": {"deeper": {"ok": "[USER_HOME]\\f"}}, "t": ""}
    assert [r.s for r in rows[1:]] == ["5", None, '"secret=[REDACTED]"']
