"""Brute-force versions of operators without SQL, and rows that are odd: clashing columns, repeated rows, no doc_id, very long texts."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwright.llm import decontaminate, language, licenses, mixing, near_duplicates, toxicity

WORDS = [f"w{i}" for i in range(400)]


def edits_within(item, text, most):
    """Whether some piece of ``text`` is within ``most`` edits of ``item``."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row) <= most


def test_contaminated_matches_a_scan_of_all_windows(spark):
    """Every document against every item, word by word; edits of some items go beyond what is allowed."""
    rng = np.random.default_rng(23)
    items = [list(rng.choice(WORDS, int(n))) for n in (3, 7, 9, 12, 20, 33, 60, 120)]
    docs = [list(rng.choice(WORDS, int(rng.integers(0, 120)))) for _ in range(20)]
    for item in items:
        for edits in (0, 1, len(item) // 10, len(item) // 10 + 2):
            x = list(item)
            for at in rng.choice(len(x), min(edits, len(x)), replace=False):
                x[at] = "zz"
            docs.append([*rng.choice(WORDS, 20), *x, *rng.choice(WORDS, 15)])
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    want = {(i, j) for i, x in enumerate(docs) for j, y in enumerate(items) if edits_within(y, x, len(y) // 10 if len(y) >= 8 else 0)}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_contaminated_odd_rows(spark):
    item = " ".join(f"i{k}" for k in range(30))
    long = " ".join(["filler"] * 60_000 + [item] + ["filler"] * 10)
    rows = [(1, f"x {item} y", 0, 0), (1, f"x {item} y", 0, 0), (1, f"other {item}", 0, 0), (None, item, 0, 0), (None, None, 0, 0), (2, long, 0, 0), (3, "", 0, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, row int, keys int")
    b = spark.createDataFrame([(7, item, 0), (7, item, 0), (None, item, 0), (8, None, 0)], "item_id long, text string, n int")
    got = sorted((r.doc_id or 0, r.item_id or 0, r.first_word) for r in decontaminate.contaminated(d, b).collect())
    assert got == sorted([(d_, i, w) for d_, w in ((1, 1), (1, 1), (0, 0), (2, 60_000)) for i in (0, 7)])


def test_language_matches_a_plain_version(spark):
    """Vectors, prototypes and cosines, letter by letter."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("el gato come pan", "es"), ("der Hund und die Katze", "de"), ("la casa de la abuela", "es"), ("a dog and the hat", "en"), ("und dann kam er", "de"), ("12 !!", "de"), ("\U00030000\U00030001\U00030002", "en"), ("éà ünï", None)] * 4)]
    dims = 256

    def vector(text):
        word, out = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ", np.zeros(dims)
        letters = re.sub(" +", " ", word)
        of = lambda c: np.ones(dims) if c == " " else np.random.default_rng(ord(c) + 7919).integers(0, 2, dims, dtype=np.int8) * 2.0 - 1
        for i in range(len(letters) - 2):
            out += np.roll(of(letters[i]), 2) * np.roll(of(letters[i + 1]), 1) * of(letters[i + 2])
        return out / max(np.linalg.norm(out), 1e-9)

    got = {r.doc_id: r for r in language.identify_languages(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, score int"), dimensions=dims).collect()}
    sums = {}
    for i, t, lang in rows:
        if lang and not got[i].held_out and any(c.isalpha() for c in t):
            sums[lang] = sums.get(lang, 0) + vector(t)
    langs = sorted(sums)
    protos = np.array([sums[k] / np.linalg.norm(sums[k]) for k in langs])
    for i, t, _ in rows:
        cosines = protos @ vector(t)
        if not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
        else:
            assert got[i].lang_pred == langs[int(cosines.argmax())] and got[i].score == pytest.approx(max(0, cosines.max()), abs=1e-4)


def test_licenses_odd_rows(spark):
    known = licenses.known_licenses(spark)
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string"), known).count() == 0
    bsd = licenses.TEXTS["BSD-2-Clause"][0]
    rows = [
        (1, "Copyright 2020 Jane Doe. Licensed under the MIT License."), (2, "the the MIT license"), (3, f"Copyright (c) 2021 X Corp. All rights reserved. {bsd}"), (4, bsd.upper()),
        (5, "Copyright 2020 Jane Doe"), (6, licenses.TEXTS["MIT"][1].replace("Permission", "Copyright (c) 2020 X Permission", 1)), (7, licenses.TEXTS["Unlicense"][0]), (8, "licensed under version the license"),
    ]
    d = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, digest int, license int")
    got = {r.doc_id: (r.text_license, r.notice_licenses) for r in licenses.scan_licenses(d, known).collect()}
    assert got[1] == ("MIT", "MIT") and got[2][0] is None and got[3][0] == got[4][0] == "BSD-2-Clause" and got[5] == (None, "")
    assert got[6][0] == "MIT" and got[7][0] == "Unlicense"
    # two licences of one digest: the first by name
    tied = spark.createDataFrame([("Z", "some words"), ("A", "Some words!")], "license string, text string")
    assert [r.text_license for r in licenses.scan_licenses(spark.createDataFrame([(1, "SOME WORDS")], "doc_id long, text string"), tied).collect()] == ["A"]


def test_canonical_forms_are_their_own(spark):
    lines = ["The the version MIT Licence", "open source open source", "open the source sub the licence", "fulfil fulfil the", "non commercial", "https http x"]
    df = spark.createDataFrame([(x,) for x in lines], "x string").select(licenses.canonical(F.col("x")).alias("once"))
    assert all(r.once == r.twice for r in df.select("once", licenses.canonical(F.col("once")).alias("twice")).collect())


def test_mixing_odd_rows(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d e", "s"), (None, "d e", None), (2, "w " * 50_000, "t"), (3, None, "t")]
    d = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "doc_id long, text string, source string, size int, target int, block int")
    out = mixing.mix_sources(d).collect()
    assert len(out) == 6 and all(r.taken <= 3 * r["size"] for r in out)
    by = {}
    for r in out:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(taken) - target) <= max(1, 0.05 * target) for (_, target), taken in by.items())
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_sources(d).collect()))


def test_blocks_go_to_shards_by_quota(spark):
    sizes = spark.createDataFrame([("a", 6000), ("b", 3000), ("c", 1000)], "source string, source_size long")
    targets = mixing.source_targets(sizes, (6, 3, 1))
    won = mixing.seats(targets, 100, 4).collect()
    quotas = {(q.source, q.shard): q.quota for q in mixing.sainte_lague(targets, 100, 4).collect()}
    assert len(won) == 100 and len({(s.source, s.k) for s in won}) == 100
    assert all(sum(s.source == source and s.shard == shard for s in won) == n for (source, shard), n in quotas.items())
    assert all(sum(n for (_, s), n in quotas.items() if s == shard) == 25 for shard in range(4))
    for source in "abc":  # blocks are taken in order, shard by shard
        own = sorted((s.k, s.shard) for s in won if s.source == source)
        assert [k for k, _ in own] == list(range(len(own))) and [s for _, s in own] == sorted(s for _, s in own)


def test_toxicity_of_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "word " * 60_000, 0), (2, "x" * 200_000, 0)], "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == 2 and all(0 <= r.score <= 1 for r in got)


@pytest.fixture
def small(tmp_path, spark):
    spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(20)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_odd_rows(spark, small):
    """Rows are judged by their own texts, whatever their doc_id."""
    import corpus_pipeline as p

    copy, item = " ".join(f"x{k}" for k in range(40)), " ".join(f"b{k}" for k in range(20))
    rows = [(5, copy), (None, copy), (None, copy), (6, copy + " end"), (7, f"clean text of {item} and many more words that stand behind it here"), (None, f"more {item}"), (8, "first text of this number"), (8, "second one that differs from it"), (9, None), (9, None), (None, "")]
    docs = spark.createDataFrame([(i, t, None, None, 0, 0, 0) for i, t in rows], SHAPE + ", row int, component int")
    key = lambda r: (r.doc_id or 0, r.text or "")
    for d in (docs, docs.drop("row", "component")):
        kept = p.drop_near_duplicates(spark, d, small)
        assert kept.columns == p.COLUMNS
        assert sorted(map(key, kept.collect())) == sorted([(5, copy), (7, rows[4][1]), (0, rows[5][1]), (8, rows[6][1]), (8, rows[7][1]), (9, ""), (9, ""), (0, "")])
        clean = p.drop_contaminated(spark, kept, small)
        assert sorted(map(key, clean.collect())) == sorted([(5, copy), (8, rows[6][1]), (8, rows[7][1]), (9, ""), (9, ""), (0, "")])
        mixed = p.mix(spark, clean, small)
        assert {key(r) for r in mixed.collect()} == {(5, copy), (8, rows[6][1]), (8, rows[7][1])}
    assert p.drop_near_duplicates(spark, spark.createDataFrame([(None, copy, None, None, 0)] * 3, SHAPE), small).count() == 1


def test_pipeline_of_an_empty_table(spark, small):
    import corpus_pipeline as p

    docs = spark.createDataFrame([], SHAPE)
    for _, stage in p.STAGES:
        assert stage(spark, docs, small).count() == 0


def test_near_duplicates_of_large_groups(spark):
    """A group beyond the size of a block: copies with a word changed here and there, in chains and stars."""
    rng = np.random.default_rng(3)
    base = [f"v{k}" for k in range(200)]
    rows = []
    for i in range(2600):
        w = list(base)
        for at in rng.choice(200, int(rng.integers(1, 3)), replace=False):
            w[at] = f"n{i}x{at}"
        rows.append((i, " ".join(w)))
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("component_id = 0").count() == 2600
