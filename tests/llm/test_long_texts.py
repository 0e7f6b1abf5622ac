"""A megabyte of letters, of Han text and of one disguised token, each within seconds; tables that go away."""

import os
import re
import time

import numpy as np
import oracle
import pyarrow as pa
from pyspark.sql import functions as F

from linkwright.llm import language, queries, secrets, toxicity
from linkwright.llm.oracles import oracle_sql
from linkwright.llm.text_arrays import slices
from linkwright.sources.store import dropped, work_dir

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def test_secrets_in_a_megabyte_of_letters(spark):
    """No pattern starts again at each letter of a run, and many matches are added up in chunks."""
    many = "login: someone " + "token=abcdefgh1234, " * 3000 + "x" * 50
    rows = [(1, "login: someone " + "abcdefghij" * 100_000), (2, "login: x1x " + "0" * 1_000_000), (3, many)]
    began = time.time()
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(rows, DOCS)).collect()}
    assert time.time() - began < 60
    assert (got[1].n_assign, got[1].n_hex, got[2].n_hex, got[3].n_assign) == (0, 0, 1, 3000)
    at = [int(s.split(":")[1]) for s in got[3].spans.split(",") if s.startswith("assign")]
    assert at == [m.start() for m in re.finditer("token", many)]


def test_keys_read_once_are_the_same_keys(spark):
    rng = np.random.default_rng(3)
    pieces = ["abc", "12", "a1", "Zz9", "_", "-", "/", " ", ".", "AAAAAAAAAA", "0000000000", "x9y8z7w6v5u4t3s2"]
    rows = [(i, "".join(rng.choice(pieces, int(rng.integers(1, 40))))) for i in range(400)]
    d = spark.createDataFrame(rows, DOCS)
    each = lambda p: {r.doc_id: r.m for r in d.select("doc_id", F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("m")).collect()}
    assert each(secrets.KEY) == each(secrets.KEY_ONCE)


def test_secret_query_matches_sql(spark):
    assert oracle.differences(spark, "op9_secret_scan", queries.op9_secret_scan, oracle_sql()["op9_secret_scan"], SF) == ""


def test_language_of_a_megabyte_of_han_text():
    rng = np.random.default_rng(1)
    han = "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 350_000)))
    encoder, began = language.Encoder(), time.time()
    vectors = [v for part in slices(pa.array([han, han[:500], "plain text"])) for v in encoder.vectors(part)[0]]
    assert time.time() - began < 30 and len(encoder.table) < 50_000
    assert np.allclose(vectors[1], language.Encoder().vectors(next(slices(pa.array([han[:500]]))))[0][0])


def test_many_letters_give_the_same_vectors(monkeypatch):
    texts = ["the cat sat on the mat", "el gato come pan ñandú", "x " * 50, "", "12 3", None]
    part = next(slices(pa.array(texts)))
    plain = language.Encoder(256).vectors(part)
    monkeypatch.setattr(language, "SMALL", 3)
    monkeypatch.setattr(language, "TRIGRAMS_AT_ONCE", 5)
    encoder = language.Encoder(256)
    for _ in range(2):
        again = encoder.vectors(part)
        assert np.allclose(plain[0], again[0]) and (plain[1] == again[1]).all()


def plain_restore(model, token):
    """Every spelling of a short token, scored one by one."""
    token, options, at = token.lower(), [], 0
    while at < len(token):
        c, end = token[at], at + 1
        while end < len(token) and token[end] == c:
            end += 1
        if c in toxicity.SEPARATORS:
            options.append([("", toxicity.SEPARATOR_COST)])
        elif c in toxicity.IMITATES:
            options += [[(x, toxicity.IMITATION_COST) for x in toxicity.IMITATES[c]] + ([] if c.isdigit() else [("", 6.0)])] * (end - at)
        elif c.isalpha() and end - at >= 3:
            options.append([(c, toxicity.REPEAT_COST), (c * 2, toxicity.REPEAT_COST)])
        else:
            options += [[(c, 0.0)]] * (end - at)
        at = end
    spelled = [("", 0.0)]
    for choice in options:
        spelled = [(t + x, cost + k) for t, cost in spelled for x, k in choice]

    def score(text, cost):
        s = [0, 0, *toxicity._symbols(text), 0]
        return sum(model[a][b][c] for a, b, c in zip(s, s[1:], s[2:], strict=False)) - cost

    return max(score(*x) for x in spelled), lambda t: max(score(x, k) for x, k in spelled if x == t)


def test_decoding_matches_all_spellings():
    rng = np.random.default_rng(5)
    model = toxicity.letter_model(rng.integers(0, 50, toxicity.SYMBOLS**3).astype(float))
    decoder = toxicity.Decoder(model)
    for token in ("h3ll0", "a.s.s", "b@@d", "$h!t", "fuuuck", "s7up1d", "noooo", "1d10t", "a-b", "x"):
        best, of = plain_restore(model.tolist(), token)
        assert of(decoder.restore(token)) - best > -1e-9


def test_a_megabyte_of_one_disguised_token():
    decoder, began = toxicity.Decoder(toxicity.letter_model(np.ones(toxicity.SYMBOLS**3))), time.time()
    assert len(decoder.restore("a1*" * 330_000)) >= 330_000 and time.time() - began < 90
    assert decoder._known.cache_info().currsize == 0


def test_operators_leave_their_result_alone(spark):
    at = work_dir(spark)
    os.makedirs(at, exist_ok=True)
    before = set(os.listdir(at))
    for name in ("op9_secret_scan", "op11_lexical_search", "op12_exact_search", "op13_filter_audit", "pipeline"):
        out = queries.queries()[name](spark, SF)
        assert out.count() > 0 and len(set(os.listdir(at)) - before) == 1, name
        dropped(out)
        assert set(os.listdir(at)) == before
