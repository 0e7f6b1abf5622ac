"""Lexical search, exact search and the audit of filters against plain versions, and their edge cases."""

import math
import re
from itertools import permutations

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from linkwright.llm import exact_search, filter_audit, lexical, neighbours, queries
from linkwright.llm.oracles import oracle_sql

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_exact_search", "op13_filter_audit"])
def test_query_matches_sql(spark, name):
    assert oracle.differences(spark, name, queries.queries()[name], oracle_sql()[name], SF) == ""


def ranked(docs, items, k):
    """Scores document by document; docs is a list of (doc_id, text)."""
    rows = [(i, TERM.findall(lower(t))) for i, t in docs]
    rows = [(i, w) for i, w in rows if w]
    n_docs, total = len(rows), sum(len(w) for _, w in rows)
    df = {}
    for _, w in rows:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item in {i for i, _ in items}:
        terms = {t for i, x in items if i == item for t in TERM.findall(lower(x))}
        scores = []
        for i, w in rows:
            m = 10 + (90 * len(w) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 8 * m)) for t in terms if t in df and t in w)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def lexical_rows(spark, docs, items, k=10, **more):
    d = spark.createDataFrame([(*r, 0, 0) for r in docs], "doc_id long, text string, score int, terms int")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, n string")
    return sorted([tuple(r) for r in lexical.lexical_search(d, b, k, **more).collect()], key=repr)


def test_lexical_search_matches_a_plain_version(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"t{i}" for i in range(120)] + ["Ünï", "été", "ß9"]
    often = 1 / np.arange(1, len(vocabulary) + 1)
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=often / often.sum()))
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "... !!"), (None, text(40)), (None, text(30)), (5, text(20)), (7, docs[7][1]), (1003, docs[9][1]), (1004, docs[9][1]), (1005, text(30_000))]
    items = [(i, text(int(rng.integers(1, 30)))) for i in range(25)] + [(100, None), (101, "nowhere"), (102, "T1-t2.T3"), (3, text(5)), (None, "t4 t5")]
    for more in ({}, {"block_rows": 50, "chunk_items": 6}):
        assert lexical_rows(spark, docs, items, **more) == ranked(docs, items, 10)
    assert lexical_rows(spark, docs, items, 3) == ranked(docs, items, 3)


def test_lexical_search_of_nothing(spark):
    assert lexical_rows(spark, [], [(1, "a")]) == [] and lexical_rows(spark, [(1, "a b")], []) == [] and lexical_rows(spark, [(1, None)], [(1, "a")]) == []


def test_many_copies_tie_by_doc_id(spark):
    docs = [(i, "red fox jumps") for i in range(200, 0, -1)] + [(900 + i, "green frog") for i in range(20)]
    got = lexical_rows(spark, docs, [(1, "fox")], block_rows=16)
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == list(range(1, 11)) and len({r[3] for r in got}) == 1


def test_carries_and_slices():
    """Sums by bitmaps are sums, whatever the terms' places."""
    rng = np.random.default_rng(4)
    total, plain = np.zeros((45, 5), np.uint64), np.zeros(320, np.int64)
    for _ in range(30):
        places = rng.permutation(320)[: int(rng.integers(1, 320))]
        values = rng.integers(1, 1 << int(rng.integers(1, 38)), len(places))
        lexical.add(total, lexical.BitSlices(places, values))
        plain[places] += values
    assert (lexical.sums_at(total, np.arange(320)) == plain).all()
    for k in (1, 7, 64, 500):
        assert sorted(lexical.top(total, k)) == sorted(np.lexsort((np.arange(320), -plain))[: min(k, int((plain > 0).sum()))])


def nearest(rows, k, every=50):
    out = []
    use = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sizes = {}
    for _, v in use:
        sizes[len(v)] = sizes.get(len(v), 0) + 1
    use = [(i, v) for i, v in use if len(v) == min(sizes, key=lambda d: (-sizes[d], d))]
    for a, (i, v) in enumerate(use):
        if i % every == 0:
            scores = sorted((-max(1 - (1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(v, w, strict=True)))), j) for b, (j, w) in enumerate(use) if b != a)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def exact_rows(spark, rows, k=5, every=50, block=None):
    v = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, row int, block int")
    more = {"rows_of": lambda n: block} if block else {}
    return sorted(tuple(r) for r in exact_search.exact_search(v, F.col("vec_id") % every == 0, k, **more).collect())


def clusters(rng, n, d, spread, norms=0.0):
    centres = rng.normal(size=(12, d))
    x = centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, d))
    return x * np.exp(norms * rng.normal(size=(n, 1)))


@pytest.mark.parametrize(("spread", "norms", "block"), [(0.05, 0.0, 60), (0.3, 0.6, 100), (1.0, 0.0, None)])
def test_exact_search_matches_a_scan(spark, spread, norms, block):
    x = clusters(np.random.default_rng(7), 700, 8, spread, norms)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    assert exact_rows(spark, rows, every=10, block=block) == nearest(rows, 5, every=10)


def test_exact_search_of_odd_rows(spark):
    rng = np.random.default_rng(8)
    v = lambda: [float(c) for c in rng.normal(size=4)]
    same = v()
    rows = [(i, v()) for i in range(1, 120)] + [(0, v()), (50, v()), (50, v()), (50, rows_ := v()), (50, rows_), (200, None), (250, [1.0, None, 2.0, 3.0]), (300, [math.nan] * 4), (350, [math.inf, 0.0, 0.0, 0.0]), (400, [0.0] * 4), (450, [1.0] * 3), (None, v())]
    rows += [(1000 + i, same) for i in range(40)] + [(2000, [1e300, 1.0, -1e300, 5.0]), (2001, [1e9, 1e9, 1e9, 1e9])]
    for block in (None, 16):
        assert exact_rows(spark, rows, block=block) == nearest(rows, 5)
    assert exact_rows(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)] and exact_rows(spark, [(0, [1.0])]) == [] and exact_rows(spark, []) == []


def test_bounds_leave_rows_unread():
    """On clustered vectors most of an annulus is ruled out by the triangle inequality, and the result is that of a scan."""
    rng = np.random.default_rng(9)
    x = exact_search.whole(clusters(rng, 20_000, 6, 0.02))
    most = float(np.sqrt((x * x).sum(axis=1).max()))
    pivots = exact_search.choose_pivots(x[:2000], most)
    d = exact_search.distances(exact_search.lifted(x, most), pivots)
    read, q = 0, x[17]
    from_pivots = exact_search.distances(np.append(q, 0)[None], pivots)[0]
    best, ids = exact_search.Best(5, None), np.arange(len(x))
    for p in np.argsort(from_pivots):
        own = np.flatnonzero(d.argmin(axis=1) == p)
        own = own[np.argsort(d[own, p])]
        read += exact_search.search_annulus(x[own], own, own, d[own, p], q, 17, from_pivots[p], float(q @ q) + most * most, exact_search.SLACK * most, best)
    scores = (x @ q).astype(np.int64)
    want = [i for i in np.lexsort((ids, -scores)) if i != 17][:5]
    assert best.ids.tolist() == want and read < len(x) / 2


def audited(docs, labels):
    """Filters applied one after another to each document."""
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}
        own = [(q, x) for j, q, x in labels if j == i and i is not None]
        rows.append((lang or "", {k for k, v in fails.items() if v}, any(q == 1 for q, _ in own), any(x == 1 for _, x in own)))
    out = []
    for part in {r[0] for r in rows}:
        mine, removed = [r for r in rows if r[0] == part], {}
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed[order, step] = len(gone)
                out.append([part, order, step, len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)])
        for r in out:
            if r[0] == part:
                r.append(sum(v for (o, s), v in removed.items() if o[s - 1] == r[1][r[2] - 1]))
    return sorted(map(tuple, out))


def test_audit_matches_filters_one_by_one(spark):
    rng = np.random.default_rng(11)
    word = lambda: str(rng.choice(["aa", "Bb", "CCC", "d#", "é", *map(str, range(300))]))
    texts = [" ".join(word() for _ in range(int(n))) for n in rng.choice([0, 3, 190, 200, 260], 60)] + ["x " * 60_000, "UPPER CASE & more", "same same " * 150, None, None, ""]
    docs = [(int(i), texts[int(rng.integers(0, len(texts)))], str(lang) if lang != "-" else None) for i, lang in enumerate(rng.choice(["en", "de", "-", ""], 150))]
    docs += [(docs[3][0], docs[3][1], "en"), (docs[3][0], docs[3][1], "en"), (None, docs[3][1], "en"), (None, "a", None)]
    labels = [(int(i), int(q), int(t)) for i, q, t in rng.integers(0, 2, (120, 3)) * [1, 1, 1] + np.arange(120)[:, None] * [1, 0, 0]] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9, None, 1)]
    d = spark.createDataFrame([(*r, 0, "m") for r in docs], "doc_id long, text string, lang string, digest int, mask string")
    lab = spark.createDataFrame([(*r, "p") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit_filters(d, lab).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()
    assert sorted(tuple(r) for r in got) == audited(docs, labels)
    assert filter_audit.audit_filters(d.limit(0), lab).count() == 0 and filter_audit.audit_filters(d, lab.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


@pytest.mark.parametrize("sigma", [0.0, 0.5, 1.0])
@pytest.mark.parametrize("n", [500, 2000, 20_000])
def test_few_candidates_find_most_neighbours(n, sigma):
    """Recall of 20 in a block of directions spread evenly, with norms that differ by ``sigma``: the candidates are a shrinking share of the rows."""
    rng, d = np.random.default_rng(n), 64
    x = rng.normal(size=(n, d))
    x *= np.exp(sigma * rng.normal(size=(n, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    asked = rng.choice(n, 40, replace=False)
    scores = x[asked] @ x.T
    scores[np.arange(40), asked] = -np.inf
    true = np.argsort(-scores, axis=1)[:, :20]
    pivots, length = neighbours.axis_pivots(d), neighbours.prefix_length(d)
    found = neighbours.search_block(np.arange(n), np.arange(n), x, asked, asked, x[asked], pivots, length, 20, neighbours.cosine_table(pivots, length))
    assert np.mean([len(set(ids[~own][:20]) & set(t)) / 20 for (ids, _, own), t in zip(found, true, strict=True)]) >= 0.93
    assert neighbours.candidates_of(n, 20) <= 0.3 * n and neighbours.candidates_of(4 * n, 20) <= 2 * neighbours.candidates_of(n, 20) + 1
