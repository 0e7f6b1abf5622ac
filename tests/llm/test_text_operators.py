"""Near duplicates, decontamination, toxicity and the pipeline against brute force and edge cases."""

import re
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from linkwright.llm import decontaminate, near_duplicates, queries, toxicity

WORDS = [f"w{i}" for i in range(400)]


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows):
    sets, where = [shingles(t) for _, t in rows], defaultdict(list)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in where[x]).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            where[x].append(i)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return {rows[i][0]: min(groups[find(i)]) for i in range(len(rows))}, {rows[i][0]: len(sets[i]) for i in range(len(rows))}


@pytest.mark.parametrize(("seed", "rounds", "cell", "block"), [(1, 4, 256, 2048), (2, 4, 4, 8), (3, 0, 256, 2048), (4, 0, 4, 8)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, seed, rounds, cell, block):
    """Groups of near copies in chains, a passage that most texts hold, short texts, copies."""
    rng = np.random.default_rng(seed)
    passage = list(rng.choice(WORDS, 30))
    rows = []
    for i in range(150):
        base = list(rng.choice(WORDS, int(rng.integers(2, 90))))
        if i % 3:
            base[1:1] = passage
        for _ in range(int(rng.integers(1, 6))):
            rows.append((len(rows), " ".join(base)))
            base = list(base)
            for _ in range(int(rng.integers(0, 3))):
                base[int(rng.integers(len(base)))] = str(rng.choice(WORDS))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", None, "   ", "A b", "a B", "one", rows[0][1]])]
    for name, value in (("ROUNDS", rounds), ("CELL_MEMBERS", cell), ("BLOCK_MEMBERS", block)):
        monkeypatch.setattr(near_duplicates, name, value)  # with no round, all is left to the last step
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    component, size = brute_components(rows)
    assert {r.doc_id: r.component_id for r in got} == component
    assert {r.doc_id: r.n_shingles for r in got} == size


def test_near_duplicates_edge_cases(spark):
    rows = [(1, "a b c d e f g", 0), (1, "a b c d e f g", 0), (None, "a b c d e f g", 0), (2, "\U0001f600 " * 50_000, 0)]
    # a chain through a text that only rows without a doc_id have, more than once
    w = [f"x{i}" for i in range(40)]
    chain = [" ".join(w), " ".join([*w[:36], "y", "y", "y", "y"]), " ".join(["z", "z", "z", "z", *w[4:36], "y", "y", "y", "y"])]
    rows += [(5, chain[0], 0), (None, chain[1], 0), (None, chain[1], 0), (6, chain[2], 0)]
    # two texts of one doc_id
    rows += [(7, "one text of this number", 0), (7, "and quite another text with it", 0)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, vertex int")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (0, 5), (0, 5), (1, 1), (1, 1), (2, 2), (5, 5), (6, 5), (7, 7), (7, 7)]
    assert near_duplicates.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_dual_traversal_finds_every_link():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, int(rng.integers(3, 80)), dtype=np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[: -max(1, len(base) // 15)], rng.integers(0, 2**63, 1, dtype=np.uint64)]))]
    sets.sort(key=len)
    bitmaps = np.zeros((len(sets), 2048), bool)
    for i, s in enumerate(sets):
        bitmaps[i, s >> np.uint64(53)] = True
    packed = np.packbits(bitmaps, axis=1).view(np.uint64)
    n = len(sets)
    forest = near_duplicates.Forest(np.array([0, n]), np.array([len(s) for s in sets]), packed, np.arange(n))
    pieces = [pair for i, j in near_duplicates.dual_traversal(forest, np.zeros(1, int), np.zeros(1, int), 80) for pair in zip(i, j, strict=True)]
    found = set(pieces)
    assert len(found) == len(pieces)
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                assert (i, j) in found
    assert len(found) < len(sets) ** 2 / 4


def test_contaminated(spark):
    rng = np.random.default_rng(7)
    items = [(i, " ".join(rng.choice(WORDS, int(rng.integers(12, 50))))) for i in range(30)] + [(100, None), (101, ""), (102, "short one")]
    docs, want = [(0, None), (1, "")], set()
    for i, text in items[:30]:
        w = text.split()
        for edits in (0, 1, max(1, len(w) // 10)):
            x = list(w)
            for at in rng.choice(len(w), edits, replace=False):
                x[at] = "zz"
            if edits <= len(w) // 10:
                want.add((len(docs), i))
            docs.append((len(docs), " ".join([*rng.choice(WORDS, 80), *x, *rng.choice(WORDS, 40)]).upper().replace(" ", ", ")))
        docs.append((len(docs), " ".join(rng.choice(WORDS, 150))))
    docs.append((len(docs), "quite a short one here"))
    want.add((len(docs) - 1, 102))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    assert got <= want and len(got & want) >= 0.95 * len(want)
    assert decontaminate.contaminated(d.limit(0), b).count() == 0
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0


@pytest.mark.parametrize("place", ["front", "middle", "end", "uniform"])
def test_contaminated_by_long_items_with_edits_anywhere(spark, place):
    """All of the allowed edits in one place: no window at one end of the item is enough."""
    rng = np.random.default_rng(13)
    items, docs = [], []
    for i in range(60):
        n = (59, 100, 200)[i % 3]
        w = [f"i{i}x{j}" for j in range(n)]
        items.append((i, " ".join(w)))
        edits = n // 10
        lo, hi = {"front": (0, 30), "middle": (n // 2 - 12, n // 2 + 12), "end": (n - 30, n), "uniform": (0, n)}[place]
        for at in sorted(rng.choice(np.arange(lo, hi), edits, replace=False), reverse=True):
            w[at : at + 1] = [["zz"], [], ["zz", w[at]]][int(rng.integers(3))]
        docs.append((i, " ".join([*rng.choice(WORDS, 40), *w, *rng.choice(WORDS, 40)])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    assert got <= {(i, i) for i in range(60)} and len(got) >= 57


def test_edit_distance():
    def plain(a, b):
        best = None
        for lo in range(len(b) + 1):
            for hi in range(lo, len(b) + 1):
                row = list(range(hi - lo + 1))
                for i, x in enumerate(a, 1):
                    new = [i]
                    for j, y in enumerate(b[lo:hi], 1):
                        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
                    row = new
                best = row[-1] if best is None else min(best, row[-1])
        return best

    rng = np.random.default_rng(11)
    for _ in range(30):
        a, b = rng.integers(0, 4, 6).astype(np.uint64), rng.integers(0, 4, 9).astype(np.uint64)
        assert decontaminate.edit_distance_within(a, b)[0] == plain(list(a), list(b))


@pytest.fixture(scope="module")
def decoder(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return toxicity.Decoder(toxicity.letter_model(toxicity.count_trigrams(docs)))


@pytest.mark.parametrize("seen, meant", [("m0r0n", "moron"), ("s t u p i d", "stupid"), ("stuuuupid", "stupid"), ("l.o.s.e.r", "loser"), ("tr4sh", "trash"), ("cl0wn", "clown"), ("d1$gust1ng", "disgusting")])
def test_decoding(decoder, seen, meant):
    assert decoder.restore(seen) == meant


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labels).where("held_out").join(labels, "doc_id")
    rate = {r.toxic: r.p for r in got.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert rate[1] > 0.9 and rate[0] < 0.02


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "some text", "x"), (3, "1 2 3 4 5 6 !!! 000", "x"), (3, "1 2 3 4 5 6 !!! 000", "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, none).collect()
    assert len(got) == 5 and all(r.score == 0 and r.predicted == 0 for r in got)
    some = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(docs, some).collect())
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    assert oracle.differences(spark, name, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.001") == ""


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), "text", "lang", "source", "n_chars").unionByName(docs.limit(2))
    docs = docs.unionByName(extra)
    seen = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        seen[name] = docs = spark.read.parquet(str(tmp_path / name))
        assert name == "sharding" or docs.columns == p.COLUMNS
    assert seen["toxicity"].count() <= 203
    kept = seen["near_duplicates"].where("doc_id is not null")
    component, _ = brute_components([(r.doc_id, r.text) for r in seen["toxicity"].where("doc_id is not null").dropDuplicates(["doc_id"]).collect()])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(component.values()))
    clean = {re.sub("[^a-z0-9]+", " ", r.text.lower()) for r in seen["decontamination"].where("text is not null").collect()}
    items = [re.sub("[^a-z0-9]+", " ", r.text.lower()).strip() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if r.text.isascii()]
    assert not [i for i in items for t in clean if f" {i} " in f" {t} "]
    assert seen["sharding"].count() == seen["mixing"].count()
