"""Searches for videos that stop when enough are found."""

import random

from pyspark.sql import functions as F

from linkwright.plans import media
from linkwright.sources.store import dropped


def test_queries(spark):
    t = spark.createDataFrame([(1, "「Song」 (a [b] c) - ", "X Y / Z"), (2, "(all)", None), (3, None, "X"), (4, "", "")], "id int, title string, artist string")
    got = {}
    for r in media.queries(t).orderBy("id", "ord").collect():
        got.setdefault(r.id, []).append((r.query, r.sorting))
    assert got == {1: [("X Song", "relevance"), ("Song X", "clicks"), ("Song", "relevance"), ("Song", "clicks")], 2: [("(all)", "relevance"), ("(all)", "clicks")], 3: [("X", "relevance"), ("X", "clicks")]}


def test_phases_match_all_searches_and_a_loop(spark):
    rng = random.Random(3)
    rows = [(i, o, h, rng.choice(["", None, *"abcdefghijkl"]), rng.choice([1, 1, 2, 3, 4]), rng.choice([0, 10, 10**6]), rng.choice([None, 0, 19, 20, 200, 900, 901])) for i in range(60) for o in range(1, 5) for h in range(rng.randint(0, 5))]
    hits = spark.createDataFrame(rows, "id int, ord int, hit int, media string, tier int, plays long, seconds int")
    asked = spark.range(62).select(F.col("id").cast("int").alias("id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("ord"))
    want = {}
    for i in range(60):
        seen, last = {}, 0
        for o in range(1, 5):
            for r in (r for r in rows if r[:2] == (i, o)):
                if r[3] and r[3] not in seen and (not r[6] or 20 <= r[6] <= 900):
                    seen[r[3]], last = r, o
            if sum(r[4] == 1 for r in seen.values()) >= 4:
                break
        if seen:
            want[i] = (set(seen), last)
    steps = []
    phased = media.stepwise(asked, lambda q: hits.join(q.select("id", "ord"), ["id", "ord"]), limit=99, steps=steps)
    at_once = media.ranked(media.first_seen(hits), limit=99)
    a, b = (sorted(tuple(r) for r in x.collect()) for x in (phased, at_once))
    assert a == b and steps == sorted(steps, reverse=True) and steps[-1] < steps[0] == 62
    got = {i: ({r[2] for r in a if r[0] == i}, max(r[5] for r in a if r[0] == i)) for i in {r[0] for r in a}}
    assert got == want
    assert media.ranked(media.first_seen(hits.limit(0))).count() == 0
    dropped(phased)
