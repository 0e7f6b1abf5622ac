"""Toxicity scores on text restored by a noisy-channel decoder.

Disguised words (leetspeak, letters spaced or dotted apart, letters repeated) are
character lattices: every character stands for itself or for the letters it may
imitate, separators may vanish, and a run of one letter may be shorter. Viterbi
decoding under a letter trigram model, counted over all documents, restores the
word. Restored words join the words of the text, and the document is scored by a
linear model over hashed words and word beginnings.

What is learned from labels: a shrunk log-odds weight per feature, and a logistic
curve over the weights a document collects, both from a bounded sample of labelled
rows (``SAMPLE_ROWS`` distinct texts about, chosen by a digest of doc_id).

Edge cases: null and empty texts are scored like texts without words; with no
labelled rows every score is 0; repeated rows each get a row; null labels are not
learned from; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linkwright.llm.shared import drop_written, written
from linkwright.llm.text_arrays import ALNUM, WHITE, Slice, Words, mix, slices, words

SAMPLE_ROWS = 20_000
BUCKET_BITS = 20
THRESHOLD = 0.3
PRIOR_WEIGHT = 10.0
LEAST_LOG_ODDS = 1.2
LEAST_ROWS = 3
PREFIX_BYTES = (4, 5, 6)

#: Fixed table of characters that imitate letters.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t",
    "*": "aeiou", "#": "aeiou",
}
SEPARATORS = " .-_~'"
SYMBOLS = 28
IMITATION_COST, SEPARATOR_COST, REPEAT_COST = 1.0, 0.1, 0.3

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_MASKS = np.zeros(256, bool)
_MASKS[[ord(c) for c in IMITATES]] = True
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[ord(c) for c in SEPARATORS]] = True
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[0xC0:] = 27


def _symbols(text: str) -> list[int]:
    return [ord(c) - 96 if "a" <= c <= "z" else 27 if ord(c) > 127 and c.isalpha() else 0 for c in text]


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Letter trigram counts over all texts; a task sends one row per trigram at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                s = _SYMBOL[part.data[(part.data < 0x80) | (part.data >= 0xC0)]]
                s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])] if len(s) else s
                s = np.concatenate([[0, 0], s, [0, 0]])
                total += np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["code", "n"])

    out = np.zeros(SYMBOLS**3, np.float64)
    for r in docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r["code"]] = r["n"]
    return out


def letter_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), smoothed with the pair and single letter models."""
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    return np.log((three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5))


#: Longer tokens are decoded anew each time, so that a cache of them stays small.
KEPT_LETTERS = 64


def _spelled(chain: tuple | None) -> str:
    letters = []
    while chain is not None:
        letters.append(chain[0])
        chain = chain[1]
    return "".join(reversed(letters))


class Decoder:
    """Restores disguised words by Viterbi decoding of their lattices."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self._known = lru_cache(maxsize=200_000)(self._restore)

    def restore(self, token: str) -> str:
        """The likeliest word that a token disguises; only short ones are kept for the next time."""
        return self._known(token) if len(token) <= KEPT_LETTERS else self._restore(token)

    def _restore(self, token: str) -> str:
        token = token.lower()
        options = []
        at = 0
        while at < len(token):
            c = token[at]
            end = at + 1
            while end < len(token) and token[end] == c:
                end += 1
            n = end - at
            if c in SEPARATORS:
                options.append([("", SEPARATOR_COST)])
            elif c in IMITATES:
                options += [[(x, IMITATION_COST) for x in IMITATES[c]] + ([] if c.isdigit() else [("", 6.0)])] * n
            elif c.isalpha() and n >= 3:
                options.append([(c, REPEAT_COST), (c * 2, REPEAT_COST)])
            else:
                options += [[(c, 0.0)]] * n
            at = end
        # a state is the last two symbols; its best history is kept as a chain of choices, each with the one before
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for choice in options:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, chain) in best.items():
                for letters, cost in choice:
                    s, x, y = score - cost, a, b
                    for z in _symbols(letters):
                        s, x, y = s + self.model[x][y][z], y, z
                    if (x, y) not in after or s > after[x, y][0]:
                        after[x, y] = (s, (letters, chain) if letters else chain)
            best = after
        ends = [(score + self.model[a][b][0], chain) for (a, b), (score, chain) in best.items()]
        most = max(score for score, _ in ends)
        # of equally likely words the last in order
        return max(_spelled(chain) for score, chain in ends if score == most)


def disguised(part: Slice) -> list[tuple[int, int, int]]:
    """(text, start, end) of byte spans that may hold a disguised word."""
    w = words(part, WHITE == False)  # noqa: E712
    if not len(w.starts):
        return []
    data = part.data
    letters = np.concatenate([[0], np.cumsum(_LETTERS[data])])
    masks = np.concatenate([[0], np.cumsum(_MASKS[data])])
    seps = np.concatenate([[0], np.cumsum(_SEPARATES[data])])
    triple = np.zeros(len(data), np.int64)
    triple[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTERS[data[2:]] & (data[2:] < 128)
    triples = np.concatenate([[0], np.cumsum(triple)])
    # closing punctuation such as "!" is no mask
    ends = w.ends.copy()
    for _ in range(3):
        last = data[np.maximum(ends - 1, w.starts)]
        ends = np.where((ends - 1 > w.starts) & ~_LETTERS[last] & ~((last >= 48) & (last < 58)) & (last != 36) & (last != 64), ends - 1, ends)
    n_letters, n_masks = letters[ends] - letters[w.starts], masks[ends] - masks[w.starts]
    n_seps = seps[ends] - seps[w.starts]
    begins_triple = np.minimum(w.starts + 2, ends)
    hit = (n_letters >= 1) & ((n_masks >= 1) | (triples[ends] - triples[begins_triple] >= 1) | ((n_seps >= 2) & (n_letters <= n_seps + 1)))
    hit &= n_letters + n_masks >= 3
    text_of = np.searchsorted(w.bounds, np.arange(len(w.starts)), "right") - 1
    found = [(int(text_of[i]), int(w.starts[i]), int(ends[i])) for i in np.flatnonzero(hit)]
    # letters that stand alone, four or more in a row
    first = data[w.starts]
    size = ends - w.starts
    alone = ((size == 1) & (_LETTERS[first] | _MASKS[first])) | ((size == 2) & (first >= 0xC0))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], alone.astype(np.int8), [0]])))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        for i in range(int(text_of[a]), int(text_of[b - 1]) + 1):
            lo, hi = max(a, w.bounds[i]), min(b, w.bounds[i + 1])
            if hi - lo >= 4:
                found.append((i, int(w.starts[lo]), int(ends[hi - 1])))
    return found


def _features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of each word and of its beginnings."""
    number = [np.arange(len(w.starts))]
    value = [w.hashes()]
    for n in PREFIX_BYTES:
        long = np.flatnonzero(w.ends - w.starts > n)
        number.append(long)
        value.append(mix(w.hash_of(w.starts[long], w.starts[long] + n) + np.uint64(n)))
    return np.concatenate(number), (np.concatenate(value) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _parts(column: pa.Array, decoder: Decoder) -> Iterator[tuple[Slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices with (text, bucket) pairs of their features and the number of words of each text."""
    for part in slices(column):
        w = words(part, ALNUM)
        text_of = np.searchsorted(w.bounds, np.arange(len(w.starts)), "right") - 1
        number, bucket = _features(w)
        texts = text_of[number]
        raw = part.data
        restored: dict[int, list[str]] = {}
        for i, a, b in disguised(part):
            restored.setdefault(i, []).append(decoder.restore(raw[a:b].tobytes().decode("utf-8", "replace")))
        if restored:
            own = sorted(restored)
            joined = [" ".join(restored[i]).encode() for i in own]
            more = Slice(0, np.frombuffer(b"".join(joined), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in joined])]))
            x = words(more, ALNUM)
            number, extra = _features(x)
            which = np.searchsorted(x.bounds, np.arange(len(x.starts)), "right") - 1
            texts = np.concatenate([texts, np.array(own)[which[number]]])
            bucket = np.concatenate([bucket, extra])
        yield part, texts, bucket, np.diff(w.bounds)


def _distinct(texts: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = np.unique(texts << BUCKET_BITS | bucket)
    return pair >> BUCKET_BITS, pair & ((1 << BUCKET_BITS) - 1)


def labelled_features(rows: DataFrame, decoder_model: np.ndarray) -> DataFrame:
    """(text, toxic, fold) -> toxic, fold, n_words, buckets."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(decoder_model)
        for batch in batches:
            for part, texts, bucket, n_words in _parts(batch.column("text"), decoder):
                texts, bucket = _distinct(texts, bucket)
                bounds = np.searchsorted(texts, np.arange(len(part) + 1))
                own = batch.slice(part.first, len(part))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(bucket, pa.int32()))
                yield pa.RecordBatch.from_arrays([own.column("toxic"), own.column("fold"), pa.array(n_words, pa.int64()), lists], names=["toxic", "fold", "n_words", "buckets"])

    return rows.select("text", "toxic", "fold").mapInArrow(extract, "toxic int, fold int, n_words long, buckets array<int>")


def _weights(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Shrunk log-odds per bucket, 0 where they are weak. counts: [label, bucket]."""
    rate = min(max(totals[1] / max(totals.sum(), 1), 1e-6), 1 - 1e-6)
    odds = (counts[1] + PRIOR_WEIGHT * rate) / (counts[0] + PRIOR_WEIGHT * (1 - rate))
    weight = np.log(odds) - np.log(rate / (1 - rate))
    return np.where((weight > LEAST_LOG_ODDS) & (counts[1] >= LEAST_ROWS), weight, 0.0)


def _signals(sums: np.ndarray, most: np.ndarray, hits: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(sums)), np.log1p(sums), most, np.log1p(hits), np.log1p(n_words)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _collected(lists: pa.ListArray | None, weight: np.ndarray, bounds: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """[sum, maximum, number] of the weights that each text has."""
    w = weight[flat]
    out = np.zeros((3, len(bounds) - 1))
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[0, full] = np.add.reduceat(w, bounds[full])
        out[1, full] = np.maximum.reduceat(w, bounds[full])
        out[2, full] = np.add.reduceat((w > 0).astype(np.float64), bounds[full])
    return out


def learn(train: DataFrame, model: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(text, toxic, fold 0/1) -> (weights, curve). Weights of one fold give the signals of the other, so the curve isn't fitted to its own rows."""
    spark = train.sparkSession
    kept = written(labelled_features(train, model), "toxicity-features")
    counts = np.zeros((2, 2, 1 << BUCKET_BITS))
    rows = kept.select("toxic", "fold", F.explode("buckets").alias("b")).groupBy("b").agg(
        *[F.count_if((F.col("toxic") == t) & (F.col("fold") == f)).alias(f"n{t}{f}") for t in (0, 1) for f in (0, 1)]
    )
    totals = np.zeros((2, 2))
    for r in kept.groupBy("toxic", "fold").count().collect():
        totals[r["toxic"], r["fold"]] = r["count"]
    if not totals[1].sum() or not totals[0].sum():
        drop_written(kept)
        return None
    # 2^BUCKET_BITS rows at most
    got = rows.where("n10 + n11 > 0").toArrow()
    at = got.column("b").to_numpy()
    for t in (0, 1):
        for f in (0, 1):
            counts[t, f, at] = got.column(f"n{t}{f}").to_numpy()
    folds = spark.sparkContext.broadcast([_weights(counts[:, 1 - f], totals[:, 1 - f]) for f in (0, 1)])

    def signals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            bounds = lists.offsets.to_numpy()
            flat = lists.values.to_numpy()
            fold = batch.column("fold").to_numpy()
            both = [_collected(lists, w, bounds, flat) for w in folds.value]
            own = np.where(fold == 0, both[0], both[1])
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array(x) for x in own], batch.column("n_words")], names=["toxic", "s", "m", "h", "n"])

    got = kept.mapInArrow(signals, "toxic int, s double, m double, h double, n long").toArrow()
    x = _signals(*[got.column(c).to_numpy() for c in ("s", "m", "h", "n")])
    y = got.column("toxic").to_numpy().astype(np.float64)
    order = np.lexsort([*x.T, y])
    curve = _logistic(x[order], y[order])
    drop_written(kept)
    return _weights(counts.sum(axis=1), totals.sum(axis=1)), curve


def score_texts(docs: DataFrame, model: np.ndarray, learned: tuple[np.ndarray, np.ndarray] | None, extra: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, text) -> doc_id, held_out, score, predicted, and the columns named in ``extra``."""
    extra = extra or []
    shared = docs.sparkSession.sparkContext.broadcast((model, learned))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, learned = shared.value
        decoder = Decoder(model)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if learned is not None:
                weight, curve = learned
                for part, texts, bucket, n_words in _parts(batch.column("text"), decoder):
                    held = weight[bucket] > 0
                    texts, bucket = _distinct(texts[held], bucket[held])
                    signals = _signals(*_collected(None, weight, np.searchsorted(texts, np.arange(len(part) + 1)), bucket), n_words)
                    out[part.first : part.first + len(part)] = 1 / (1 + np.exp(-np.clip(signals @ curve, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32)), *[batch.column(c) for c in extra]], names=["doc_id", "held_out", "score", "predicted", *extra])

    schema = StructType().add("doc_id", "long").add("held_out", "boolean").add("score", "double").add("predicted", "integer")
    for c in extra:
        schema = schema.add(c, docs.schema[c].dataType)
    return docs.select("doc_id", "held_out", *dict.fromkeys(["text", *extra])).mapInArrow(score, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, sample: int = SAMPLE_ROWS, extra: list[str] | None = None) -> DataFrame:
    """Learns from labelled rows outside the held-out fold and scores every row of ``docs``."""
    place = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    held_out = F.coalesce(place % folds == held, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), *dict.fromkeys(["text", *(extra or [])]))
    model = letter_model(count_trigrams(docs))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~(place % folds == held)).distinct()
    share = sample / max(1, known.count())
    # a digest of doc_id decides, so the sample has about SAMPLE_ROWS rows whatever the input
    known = known.where(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 30) - 1)) < int(min(1.0, share) * (1 << 30)))
    train = rows.join(F.broadcast(known), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    train = train.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    train = train.select("text", "toxic", F.pmod("h", F.lit(2)).cast("int").alias("fold"))
    return score_texts(rows, model, learn(train, model), extra)
