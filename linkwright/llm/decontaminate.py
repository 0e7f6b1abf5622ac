"""Benchmark passages in documents, found through CGK embeddings and bit sampling.

Words (runs of letters, digits and non-ASCII bytes, A-Z lower-cased) are the
symbols. A CGK walk reads a window from its start: at step j it puts out the symbol
under its pointer and moves on if a random bit of (j, symbol) says so, which
turns a small edit distance into a small Hamming distance. Bit sampling hashes a
few steps of the walk; a few walks are made and each is sampled several times, so that windows
with edits meet their item with the wanted recall, and equal windows always do.
A walk sees little more than the first half of a long window, so an item of
``LEAST_PARTED`` words or more posts several windows of a length class, each with its offset:
what their walks see covers the item, wherever its edits stand. A text's
windows begin at every word.

Before the walk, windows with too many foreign words are left out: some window
of an item within the distance has no more edits than its share (no word is in more
than ``overlap`` of them), the words left must be words of some item, and most pairs of neighbours must stand in some item. These
bounds and the wanted keys go to the tasks as bitmaps of ``FILTER_BITS`` bits a value (one key in a
thousand passes by chance), and of 2^``MOST_FILTER`` bits at most. Beyond that size more windows
pass, and none is lost, for keys are then joined by Spark. Only documents with a wanted key
leave their task, as word hashes. Each candidate is compared exactly: first
the words that both sides hold, then the edit distance.

Edge cases: null and empty texts and items take no part; items of fewer than
``LEAST_WORDS`` words are compared as wholes of that length, without edits;
repeated rows give one result; a null doc_id or item_id is kept as null (rows of one doc_id, or of none, give
one result for each item and text); very long texts are read whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.shared import drop_written, row_digest, written
from linkwright.llm.text_arrays import ALNUM, mix, runs, slices, words

FILTER_BITS = 64
MOST_FILTER = 28
LEAST_WORDS = 8
#: Length classes: an item of n words belongs to the largest that is at most n.
CLASSES = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 19, 24, 30, 38, 48)
WALKS = 4
SAMPLES = 12
STEPS_IN_KEY = 3
MOST_STEPS = 64
#: Items of so many words or more are looked for by several windows.
LEAST_PARTED = 16
WINDOWS_AT_ONCE = 1 << 16


def allowed_edits(n_words: np.ndarray | int, share: float) -> np.ndarray:
    n = np.asarray(n_words)
    return np.where(n < LEAST_WORDS, 0, np.floor(n * share)).astype(np.int64)


def _class_of(n_words: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(CLASSES), n_words, "right") - 1


def pair_hashes(symbols: np.ndarray) -> np.ndarray:
    """Hashes of words that follow each other."""
    return mix(symbols[:-1] * np.uint64(0xD6E8FEB86659FD93) + symbols[1:])


def _steps(size: int) -> int:
    return int(min(MOST_STEPS, max(2, 2 * size - size // 3)))


def item_windows(n_words: int, share: float) -> tuple[int, np.ndarray, int]:
    """Length class and offsets of the windows an item posts, and the edits that the least edited of them has at most."""
    edits = int(allowed_edits(n_words, share))
    if n_words < LEAST_PARTED:
        return int(_class_of(np.array([n_words]))[0]), np.zeros(1, np.int64), edits
    class_id = int(_class_of(np.array([n_words // 2]))[0])
    size = CLASSES[class_id]
    # a walk moves on at every other step
    count = -(-n_words // (_steps(size) // 2))
    offsets = np.linspace(0, n_words - size, count).astype(np.int64)
    overlap = int((np.searchsorted(offsets, offsets + size) - np.arange(count)).max())
    return class_id, offsets, min(edits, -(-edits * overlap // count))


def _sampled_steps(walk: int, size: int) -> np.ndarray:
    """[SAMPLES, STEPS_IN_KEY]: steps of a walk over ``size`` words, which takes about two steps a word."""
    most = _steps(size)
    rng = np.random.default_rng(1000 * walk + size)
    # one step from each of equal stretches, so that the steps of a key see different words
    return ((np.arange(STEPS_IN_KEY) + rng.random((SAMPLES, STEPS_IN_KEY))) * most / STEPS_IN_KEY).astype(np.int64)


def coin_tosses(symbols: np.ndarray) -> list[np.ndarray]:
    """For each walk, 64 random bits of every symbol; bit j decides step j."""
    return [mix(symbols + np.uint64(0x9E3779B97F4A7C15 * (walk + 1) % (1 << 64))) for walk in range(WALKS)]


def cgk_keys(symbols: np.ndarray, tosses: list[np.ndarray], starts: np.ndarray, ends: np.ndarray, class_id: int) -> np.ndarray:
    """[window, WALKS * SAMPLES] keys of the windows that begin at ``starts``; nothing is read at or beyond ``ends``."""
    size = CLASSES[class_id]
    keys = np.zeros((len(starts), WALKS * SAMPLES), np.uint64)
    for walk in range(WALKS):
        steps = _sampled_steps(walk, size)
        hashed = np.zeros((SAMPLES, len(starts)), np.uint64)
        coins = tosses[walk]
        at = starts.copy()
        stop = np.minimum(ends, starts + size)
        last = len(symbols) - 1
        for j in range(int(steps.max()) + 1):
            sampled = np.flatnonzero((steps == j).any(axis=1))
            if len(sampled):
                symbol = np.where(at < stop, symbols[np.minimum(at, last)], np.uint64(0))
                for s in sampled:
                    hashed[s] = (hashed[s] ^ symbol) * np.uint64(0x9FB21C651E98DF25) + np.uint64(j)
            # the pointer rests at the end of the window
            at += ((coins[np.minimum(at, last)] >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
            np.minimum(at, stop, out=at)
        for s in range(SAMPLES):
            keys[:, walk * SAMPLES + s] = mix(hashed[s] + np.uint64(((walk * SAMPLES + s) << 8) | class_id))
    return keys


class Filter:
    """A bitmap that holds values by ``probes`` bits each."""

    def __init__(self, words: np.ndarray, bits: int, probes: int):
        self.words, self.bits, self.probes = words, bits, probes

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(values.shape, bool)
        for probe in range(self.probes):
            # stretches of bits from the upper end of a hash
            at = (values << np.uint64(probe * 31)) >> np.uint64(64 - self.bits)
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def bit_filter(values: DataFrame, probes: int) -> Filter:
    """The filter of a column of hashes. Spark sets the bits: a sixty-fourth of their number comes back at most."""
    name = values.columns[0]
    bits = int(np.clip(np.ceil(np.log2(max(1, FILTER_BITS * values.count()))), 16, MOST_FILTER))
    at = F.array(*[F.shiftrightunsigned(F.shiftleft(name, probe * 31), 64 - bits) for probe in range(probes)])
    places = values.select(F.explode(at).alias("at"))
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    found = places.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(one).alias("v")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    if found.num_rows:
        words[found.column("w").to_numpy()] = found.column("v").to_numpy().view(np.uint64)
    return Filter(words, bits, probes)


def item_table(items: DataFrame, share: float) -> DataFrame:
    """(item_id, text) -> item_id, item (a key), n, class_id, edits (of a window), symbols, hashes of its pairs of words, and the keys of all windows with their offsets."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                w = words(part, ALNUM)
                h = w.hashes()
                ids, numbers = (batch.column(c).slice(part.first, len(part)) for c in ("item_id", "item"))
                sizes = np.diff(w.bounds)
                out = [], [], [], [], [], [], [], [], []
                for i in np.flatnonzero(sizes):
                    own = h[w.bounds[i] : w.bounds[i + 1]]
                    c, offsets, edits = item_windows(len(own), share)
                    keys = cgk_keys(own, coin_tosses(own), offsets, np.full(len(offsets), len(own)), c)
                    keys, offsets = keys.view(np.int64).ravel().tolist(), np.repeat(offsets, keys.shape[1]).tolist()
                    for column, value in zip(out, (ids[int(i)].as_py(), numbers[int(i)].as_py(), len(own), c, edits, own.view(np.int64).tolist(), pair_hashes(own).view(np.int64).tolist(), offsets, keys), strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["item_id", "item", "n", "class_id", "edits", "symbols", "pairs", "offsets", "keys"])

    kinds = "item_id long, item long, n int, class_id int, edits int, symbols array<long>, pairs array<long>, offsets array<long>, keys array<long>"
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return rows.select("item_id", F.xxhash64("item_id", "text").alias("item"), "text").mapInArrow(make, kinds)


def candidates(docs: DataFrame, vocabulary: Filter, pairs: Filter, wanted: Filter, classes: dict[int, int]) -> DataFrame:
    """(doc_id, text) -> doc_id, row, symbols, keys, starts: the documents with a wanted key. classes: the most edits in a window of each."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, pairs, wanted))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, pairs, wanted = shared.value
        for batch in batches:
            for part in slices(batch.column("text")):
                w = words(part, ALNUM)
                h = w.hashes()
                n = len(h)
                if not n:
                    continue
                tosses = coin_tosses(h)
                known = np.concatenate([[0], np.cumsum(vocabulary(h))])
                known_pairs = np.concatenate([[0], np.cumsum(pairs(pair_hashes(h))), [0]])
                text_of = np.repeat(np.arange(len(part)), np.diff(w.bounds))
                end = w.bounds[text_of + 1]
                out = [], []
                for c, edits in classes.items():
                    size = CLASSES[c]
                    # an edit costs one known word at most, and two known pairs
                    stop = np.minimum(np.arange(n) + size, end)
                    enough = (known[stop] - known[:-1] >= size - edits) & (known_pairs[stop - 1] - known_pairs[:-1] >= size - 1 - 2 * edits)
                    fits = np.flatnonzero(enough & (stop - np.arange(n) >= size - edits))
                    for lo in range(0, len(fits), WINDOWS_AT_ONCE):
                        starts = fits[lo : lo + WINDOWS_AT_ONCE]
                        keys = cgk_keys(h, tosses, starts, end[starts], c)
                        row, column = np.nonzero(wanted(keys))
                        out[0].append(starts[row])
                        out[1].append(keys[row, column])
                if not sum(map(len, out[0])):
                    continue
                starts, keys = (np.concatenate(x) for x in out)
                order = np.argsort(starts, kind="stable")
                starts, keys = starts[order], keys[order]
                at = runs(text_of[starts])
                texts = text_of[starts[at[:-1]]]
                rows = batch.select(["doc_id", "row"]).take(pa.array(part.first + texts))
                own = np.concatenate([h[w.bounds[t] : w.bounds[t + 1]] for t in texts])
                lists = lambda bounds, values: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, lists(np.concatenate([[0], np.cumsum(np.diff(w.bounds)[texts])]), own.view(np.int64)), lists(at, keys.view(np.int64)), lists(at, starts - w.bounds[text_of[starts]])],
                    names=["doc_id", "row", "symbols", "keys", "starts"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_digest().alias("row"), "text")
    return texts.mapInArrow(find, "doc_id long, row long, symbols array<long>, keys array<long>, starts array<long>")


def edit_distance_within(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smallest edit distance of ``item`` to any piece of ``text``: (distance, begin, end of the piece)."""
    n = len(text)
    row = np.zeros(n + 1, np.int64)
    begin = np.arange(n + 1)
    ramp = np.arange(n + 1)
    for k, symbol in enumerate(item, 1):
        change = row[:-1] + (text != symbol)
        drop = row + 1
        best = np.empty(n + 1, np.int64)
        from_ = np.empty(n + 1, np.int64)
        best[0], from_[0] = k, 0
        diagonal = change <= drop[1:]
        best[1:] = np.where(diagonal, change, drop[1:])
        from_[1:] = np.where(diagonal, begin[:-1], begin[1:])
        # insertions run along the row: a running minimum of best - position
        low = np.minimum.accumulate(best - ramp)
        source = np.maximum.accumulate(np.where(best - ramp == low, ramp, 0))
        row, begin = low + ramp, from_[source]
    end = int(row.argmin())
    return int(row[end]), int(begin[end]), end


def _stretches(starts: list[int], n: int, edits: int) -> Iterator[tuple[int, int]]:
    """Candidate windows with room for the edits; those that overlap are one stretch."""
    lo = hi = None
    for start in starts:
        if hi is not None and start <= hi:
            hi = start + n + edits
            continue
        if hi is not None:
            yield lo, hi
        lo, hi = max(0, start - edits), start + n + edits
    if hi is not None:
        yield lo, hi


def common_words(item: np.ndarray, text: np.ndarray) -> int:
    """How many words of ``item`` the text holds, repeats counted: all others cost an edit."""
    kinds, wanted = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(kinds, text), len(kinds) - 1)
    return int(np.minimum(np.bincount(at[kinds[at] == text], minlength=len(kinds)), wanted).sum())


def verified(pairs: DataFrame, texts: DataFrame, items: DataFrame, share: float) -> DataFrame:
    """(row, item, start) candidates -> those whose exact edit distance is allowed."""
    near = pairs.groupBy("row", "item").agg(F.array_sort(F.collect_set("start")).alias("starts")).join(items.select("item", "item_id", "n", F.col("symbols").alias("words")), "item")
    near = near.groupBy("row").agg(F.collect_list(F.struct("item_id", "n", "starts", "words")).alias("c"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = batch.column("symbols")
            bounds, flat = symbols.offsets.to_numpy(), symbols.values.to_numpy()
            ids, rows, all_pairs = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("c")
            out = [], [], [], [], [], []
            for i, doc_id in enumerate(ids):
                own = flat[bounds[i] : bounds[i + 1]]
                for x in all_pairs[i].as_py():
                    item = np.array(x["words"], np.int64)
                    edits = int(allowed_edits(x["n"], share))
                    for lo, hi in _stretches(x["starts"], x["n"], edits):
                        if common_words(item, own[lo:hi]) < x["n"] - edits:
                            continue
                        distance, begin, end = edit_distance_within(item, own[lo:hi])
                        if distance <= edits:
                            for column, value in zip(out, (doc_id, rows[i], x["item_id"], lo + begin, lo + end, distance), strict=True):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "row", "item_id", "first_word", "end_word", "distance"])

    once = texts.select("doc_id", "row", "symbols").dropDuplicates(["row"])
    found = once.join(near, "row").select("doc_id", "row", "symbols", "c").mapInArrow(verify, "doc_id long, row long, item_id long, first_word long, end_word long, distance long")
    best = found.groupBy("doc_id", "row", "item_id").agg(F.min(F.struct("distance", "first_word", "end_word")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.distance").alias("distance"), F.col("b.first_word").alias("first_word"), F.col("b.end_word").alias("end_word"), "row")


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.1) -> DataFrame:
    """One row per document and benchmark item it holds within ``share`` of the item's words: doc_id, item_id, distance, place, row (its row's digest)."""
    items = written(item_table(benchmark, share), "items")
    vocabulary = bit_filter(items.select(F.explode("symbols").alias("s")).distinct(), 1)
    keys = items.select("item", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("offsets").alias("offset"))))
    wanted = bit_filter(keys.select("key"), 2)
    classes = {r["class_id"]: r["edits"] for r in items.groupBy("class_id").agg(F.max("edits").alias("edits")).orderBy("class_id").collect()}
    followers = bit_filter(items.select(F.explode("pairs").alias("s")).distinct(), 2)
    texts = written(candidates(docs, vocabulary, followers, wanted, classes), "candidates")
    found = texts.select("row", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("starts").alias("start"))))
    # where the item would begin
    pairs = found.join(keys, "key").select("row", "item", (F.col("start") - F.col("offset")).alias("start")).distinct()
    out = written(verified(pairs, texts, items, share), "contaminated")
    drop_written(items, texts)
    return out
