"""Interactions of filters, from counts of failure masks by a subset-zeta transform.

Texts are read once: each document becomes a mask of the filters it fails. Per part, documents are counted by
mask (2^n counts at most, whatever the number of documents). A zeta transform over subsets, one pass a filter,
turns the counts into the survivors of every set of filters: those whose mask misses the set. A step of an order is then
the difference between the survivors of neighbouring subsets, with and without its filter; the same is done for
documents with a label. No document is looked at again for any order.

Edge cases: a null text is empty, without words, and fails no filter of its own; empty and null texts are
identical. Of identical texts those fail whose doc_id is above the smallest; a null doc_id neither fails for being identical nor makes
others fail, and has no labels; rows that share their doc_id and text count each, and none is identical to a *smaller* one. A label holds if any row of
the doc_id has it. A null part is the empty string. An empty table has no parts, so gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.llm.shared import drop_written, written
from linkwright.llm.text_arrays import WHITE, slices, words

#: Limits of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 3
MARKS = b"#$%&*|"
LETTERS = "ABCDE"
_SAME = np.arange(256, dtype=np.uint8)


def _table(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_UPPER, _MARK, _INSIDE = _table(bytes(range(65, 91))), _table(MARKS), _table(bytes(range(128, 192)))


def text_masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask, digest): filters A to D that each text fails as bits 0 to 3, and a digest of the text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                w = words(s, ~WHITE, _SAME)
                h, n = w.hashes(), np.diff(w.bounds)
                doc = np.repeat(np.arange(len(s)), n)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                distinct = np.bincount(doc[first], minlength=len(s))
                # how many bytes of a kind each text has
                upper, marks, inside = (np.diff(np.concatenate(([0], np.cumsum(kind[s.data])))[s.offsets]) for kind in (_UPPER, _MARK, _INSIDE))
                points = np.diff(s.offsets) - inside
                fails = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * upper > MOST_UPPER * points, marks > 0)
                mask = sum(f.astype(np.int32) << i for i, f in enumerate(fails))
                digests = [hashlib.blake2b(s.data[a:b].tobytes(), digest_size=16).digest() for a, b in zip(s.offsets[:-1], s.offsets[1:], strict=True)]
                own = [batch.column(c).slice(s.first, len(s)) for c in ("doc_id", "part")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(mask.astype(np.int32)), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    return texts.mapInArrow(make, "doc_id long, part string, mask int, digest binary")


def with_duplicates(masks: DataFrame, bit: int = 4) -> DataFrame:
    """Sets a bit in the mask of documents whose text a smaller doc_id has too. Only texts of several doc_ids are joined back."""
    first = masks.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    both = masks.join(first, "digest", "left")
    return both.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(F.col("doc_id") > F.col("first"), F.lit(1 << bit)).otherwise(F.lit(0))).alias("mask"))


def with_labels(masks: DataFrame, labels: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """Adds a boolean for each of ``marks`` (name: condition on labels)."""
    has = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(c, F.lit(False)).alias(k) for k, c in marks.items()])
    has = has.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(k).alias(k) for k in marks])
    both = masks.join(has, "doc_id", "left")
    return both.select(*masks.columns, *[F.coalesce(k, F.lit(False)).alias(k) for k in marks])


def zeta(counts: Column, n: int) -> Column:
    """Array by subset -> for each subset the sum over all its subsets: one pass over the array for each of the ``n`` elements."""
    places = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    with_one = lambda a, s, one: F.get(a, s) + F.when(s.bitwiseAND(one) != 0, F.get(a, s - one)).otherwise(F.lit(0))
    return F.aggregate(F.array(*[F.lit(1 << i) for i in range(n)]), counts, lambda a, one: F.transform(places, lambda s: with_one(a, s, one)))


def survivors(masked: DataFrame, n: int, marks: list[str]) -> DataFrame:
    """(part, all, and one column a mark): arrays by subset of filters of the documents that fail none of it."""
    kinds = {"all": F.lit(True), **{m: F.col(m) for m in marks}}
    counts = masked.groupBy("part", "mask").agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])
    # a row of 2^n sums for each part
    arrays = counts.groupBy("part").agg(*[F.array(*[F.sum(F.when(F.col("mask") == m, F.col(k)).otherwise(0)) for m in range(1 << n)]).alias(k) for k in kinds])
    # who fails none of a subset fails only filters of its complement
    return arrays.select("part", *[F.reverse(zeta(F.col(k), n)).alias(k) for k in kinds])


def audit(arrays: DataFrame, letters: str, marks: dict[str, str]) -> DataFrame:
    """All orders of the filters, step by step, for each part of survivors(); ``marks`` are names of losses and the marks they count.

    The number of filters is the length of ``letters``; orders are listed, so it is a small one.
    """
    n = len(letters)
    full = (1 << n) - 1
    orders = " ".join("".join(p) for p in permutations(letters))
    steps = arrays.withColumn("filter_order", F.explode(F.split(F.lit(orders), " "))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    bit_of = lambda letter: F.pow(F.lit(2), F.position(letter, F.lit(letters)) - 1).cast("int")
    steps = steps.withColumn("own", bit_of(F.substring("filter_order", F.col("step"), F.lit(1))))
    earlier = F.when(F.col("step") > 1, F.slice(F.split("filter_order", ""), F.lit(1), F.col("step") - 1)).otherwise(F.array().cast("array<string>"))
    steps = steps.withColumn("before", F.aggregate(earlier, F.lit(0), lambda a, x: a + bit_of(x)))
    at = lambda k, s: F.get(F.col(k), s)
    lost = lambda k, s: at(k, s) - at(k, s + F.col("own"))
    removed = lost("all", F.col("before"))
    # a subset of s filters comes first, then this one, in s! * (n - 1 - s)! orders
    times = F.array(*[F.lit(factorial(s) * factorial(n - 1 - s)) for s in range(n)])
    without = F.filter(F.sequence(F.lit(0), F.lit(full)), lambda s: s.bitwiseAND(F.col("own")) == 0)
    shapley = F.aggregate(without, F.lit(0).cast("long"), lambda a, s: a + F.get(times, F.bit_count(s)) * lost("all", s))
    return steps.select(
        "part", "filter_order", "step", at("all", F.col("before") + F.col("own")).alias("kept"), removed.alias("removed"), (lost("all", F.lit(0)) - removed).alias("redundant"),
        lost("all", F.lit(full) - F.col("own")).alias("unique_fails"), *[lost(m, F.col("before")).alias(name) for name, m in marks.items()], shapley.alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over ``docs``, by language: every order and step, with the documents of good quality and the toxic ones that it loses."""
    masks = written(text_masks(docs), "masks")
    marked = with_labels(with_duplicates(masks), labels, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    arrays = written(survivors(marked, len(LETTERS), ["good", "toxic"]), "survivors")
    out = written(audit(arrays, LETTERS, {"good_lost": "good", "toxic_lost": "toxic"}), "audit")
    drop_written(masks, arrays)
    return out
