"""Exact top-k search by integer inner product, through a pivot-distance index.

Each component x counts as floor(256 * x). A vector of norm |x| gets one more coordinate, sqrt(M^2 - |x|^2) with
M the largest norm, and a query 0: then |q - x|^2 = |q|^2 + M^2 - 2 * score, so the largest scores are the
nearest vectors, and distances obey the triangle inequality. The index keys each vector by its nearest pivot and its distance
from it, and is cut along that key into blocks; what a block holds of one pivot is an annulus with a least and a largest distance.

A query first searches its own block, which gives a score that its k-th best has at least, so a radius. It then goes to
those blocks only that have an annulus which the radius reaches (by the distances from pivots, and as an annulus lies
nearer its pivot than any other). In a block, rows are read outwards from the query's own distance to the pivot on
both sides, and reading stops as soon as the triangle inequality rules out all rows beyond. Bounds have a slack far
above rounding errors, and scores are exact, so results are those of a scan. Where bounds prune little (directions
spread evenly in many dimensions) the work is that of a scan: queries times rows.

Queries are a stated set against all rows, in blocks. Pivots are drawn from a sample of at most ``SAMPLE`` rows.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do those whose length
isn't the most common one (the smallest such length if tied), nor null vec_ids; zero vectors do take part. Each of several rows with one
vec_id is a row of its own: a query with its own ranks, and a candidate for the others. Ties go to the smaller vec_id; with fewer candidates than ``k`` all are
returned; an empty table gives no rows. Vectors with components so large that doubles don't hold all products exactly
are kept apart and compared by Python's integers without bounds; scores beyond 64 bits are cut at their ends. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.llm.neighbours import rows_at_once
from linkwright.llm.shared import drop_written, written

SCALE = 256
PIVOTS = 48
SAMPLE = 4096
#: Rows read at once on a side of an annulus.
STEP = 1024
#: Share of the largest length by which bounds give way to rounding errors.
SLACK = 1e-6
#: The pivot number of rows that are compared without bounds.
APART = -1
#: Copies of the list of annuli that share the queries of a hot pivot.
SALTS = 16
_WIRE = "row long, vec_id long, v binary, pivot int, dist double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, but for their length."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def largest_exact(dimension: int) -> int:
    """Components up to this size have inner products that doubles hold exactly, whatever the order of the sum."""
    return int(np.sqrt(2.0**52 / max(dimension, 1)))


def whole(v: np.ndarray) -> np.ndarray:
    """floor(256 * x) as doubles; the largest doubles are whole, and times 256 may leave their range."""
    with np.errstate(over="ignore"):
        return np.floor(v * SCALE)


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with their further coordinate."""
    return np.concatenate([x, np.sqrt(np.maximum(most * most - (x * x).sum(axis=1, keepdims=True), 0))], axis=1)


def choose_pivots(sample: np.ndarray, most: float, count: int = PIVOTS, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres of a sample of vectors, in lifted space: seeded k-means."""
    x = lifted(sample, most)
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:count]]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T - (centres * centres).sum(axis=1) / 2, axis=1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """[row, pivot] distances of lifted vectors."""
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def _stack(column: pa.ChunkedArray, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), dimension)


def keyed(vectors: DataFrame, dimension: int, most: float, pivots: np.ndarray) -> DataFrame:
    """(row, vec_id, v, pivot, dist): whole components, the nearest pivot and the distance from it."""
    limit = largest_exact(dimension)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = whole(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension))
            near = (np.abs(v) <= limit).all(axis=1) & (len(pivots) > 0)
            pivot, dist = np.full(len(v), APART, np.int32), np.zeros(len(v))
            if near.any():
                d = distances(lifted(v[near], most), pivots)
                pivot[near], dist[near] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(pivot), pa.array(dist)], ["row", "vec_id", "v", "pivot", "dist"])

    return vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v").mapInArrow(make, _WIRE)


def products(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as integers."""
    if exact:
        return (x @ q).astype(np.int64)
    big = lambda v: [int(c) if np.isfinite(c) else int(np.sign(c)) << 1032 for c in v]
    own = big(q)
    return np.array([max(1 - (1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(big(r), own, strict=True)))) for r in x], np.int64)


class Best:
    """The k best (score, vec_id) so far, and the score that further ones must have at least."""

    def __init__(self, k: int, least: int | None):
        self.k, self.least = k, least
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.least is not None:
            keep = scores >= self.least
            scores, ids = scores[keep], ids[keep]
        if not len(scores):
            return
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def search_annulus(x: np.ndarray, rows: np.ndarray, ids: np.ndarray, dist: np.ndarray, q: np.ndarray, own_row: int, from_pivot: float, square: float, slack: float, best: Best) -> int:
    """Reads an annulus (in order of distance) outwards from a query's own distance; returns how many rows were read. ``square`` is |q|^2 + M^2."""
    left = right = int(np.searchsorted(dist, from_pivot))
    read = 0
    while left > 0 or right < len(x):
        # the nearer side first; a side is done when even its next row is too far
        down = from_pivot - dist[left - 1] if left > 0 else np.inf
        up = dist[right] - from_pivot if right < len(x) else np.inf
        if best.least is not None and max(min(down, up) - slack, 0) ** 2 > square - 2 * best.least + slack * slack:
            break
        lo, hi = (max(0, left - STEP), left) if down <= up else (right, min(len(x), right + STEP))
        left, right = min(left, lo), max(right, hi)
        other = rows[lo:hi] != own_row
        best.take(products(x[lo:hi], q, True)[other], ids[lo:hi][other])
        read += hi - lo
    return read


def search_block(block: pa.Table, asked: pa.Table, k: int, pivots: np.ndarray, most: float, dimension: int) -> pa.Table:
    """The best of a block for the queries (row, vec_id, v, least) that reach it, no worse than ``least``."""
    found: dict[str, list] = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
    if len(block) and len(asked):
        block = block.sort_by([("pivot", "ascending"), ("dist", "ascending")])
        x, q = _stack(block.column("v"), dimension), _stack(asked.column("v"), dimension)
        rows, ids, dist, pivot = (block.column(c).to_numpy() for c in ("row", "vec_id", "dist", "pivot"))
        limit, slack = largest_exact(dimension), SLACK * max(most, 1.0)
        small = (np.abs(q) <= limit).all(axis=1)
        from_pivots = distances(np.concatenate([np.where(small[:, None], q, 0), np.zeros((len(q), 1))], axis=1), pivots)
        numbers, starts = np.unique(pivot, return_index=True)
        stops = np.append(starts[1:], len(x))
        for i, (row, query_id, least) in enumerate(zip(*(asked.column(c).to_pylist() for c in ("row", "vec_id", "least")), strict=True)):
            best = Best(k, least)
            # annuli whose pivots are near come first, as they are likely to raise the bound
            for j in sorted(range(len(numbers)), key=lambda j: from_pivots[i, numbers[j]] if numbers[j] != APART else np.inf):
                own = slice(starts[j], stops[j])
                if numbers[j] != APART and small[i]:
                    search_annulus(x[own], rows[own], ids[own], dist[own], q[i], row, from_pivots[i, numbers[j]], float(q[i] @ q[i]) + most * most, slack, best)
                else:
                    other = rows[own] != row
                    best.take(products(x[own][other], q[i], bool(small[i] and numbers[j] != APART)), ids[own][other])
            found["query_row"] += [row] * len(best.ids)
            found["query_id"] += [query_id] * len(best.ids)
            found["vec_id"] += best.ids.tolist()
            found["score"] += best.scores.tolist()
    return pa.table(found, schema=pa.schema([(c, pa.int64()) for c in found]))


_FOUND = "query_row long, query_id long, vec_id long, score long"


def reached(queries: DataFrame, annuli: DataFrame, pivots: np.ndarray, most: float, dimension: int) -> DataFrame:
    """(row, block): blocks that may hold a row no worse than the query's ``least``, by the annuli (pivot, block, lo, hi) in them."""
    limit, slack = largest_exact(dimension), SLACK * max(most, 1.0)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _stack(b.column("v"), dimension)
            small = (np.abs(q) <= limit).all(axis=1)
            d = distances(np.concatenate([np.where(small[:, None], q, 0), np.zeros((len(q), 1))], axis=1), pivots)
            least = b.column("least").to_numpy(zero_copy_only=False).astype(float)
            bounded = small & ~np.isnan(least)
            square = (np.where(small[:, None], q, 0) ** 2).sum(axis=1) + most * most - 2 * np.nan_to_num(least)
            radius = np.where(bounded, np.sqrt(np.maximum(square, 0)) + 2 * slack, np.inf)
            # a vector of an annulus is nearer its pivot than any other
            near = (d - d.min(axis=1, keepdims=True, initial=np.inf)) / 2 <= radius[:, None]
            at, number = np.nonzero(near)
            # rows kept apart are compared with all
            at, number, lo, hi = (np.concatenate(z) for z in ((at, np.arange(len(q))), (number, np.full(len(q), APART)), ((d - radius[:, None])[at, number], np.full(len(q), -np.inf)), ((d + radius[:, None])[at, number], np.full(len(q), np.inf))))
            rows = b.column("row").to_numpy()[at]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(number.astype(np.int32)), pa.array(lo), pa.array(hi)], ["row", "pivot", "lo", "hi"])

    wants = queries.select("row", "v", "least").mapInArrow(reach, "row long, pivot int, lo double, hi double").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    there = annuli.select("block", "pivot", F.col("lo").alias("nearest"), F.col("hi").alias("farthest"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return wants.join(there, ["pivot", "salt"]).where("nearest <= hi and farthest >= lo").select("row", "block").distinct()


def exact_search(vectors: DataFrame, is_query: Column, k: int = 5, rows_of: Callable[[int], int] = rows_at_once) -> DataFrame:
    """The ``k`` best of all other rows for each row of ``vectors`` (vec_id, embedding) for which ``is_query`` holds, by vec_id: query_id, rank, vec_id, score.

    ``rows_of`` gives the rows of a block for a number of rows.
    """
    v = usable(vectors)
    sizes = v.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    total, dimension = (sizes[0]["count"], sizes[0]["d"]) if sizes else (0, 0)
    if not total or not dimension:
        return v.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where(F.lit(False))
    v = v.where(F.size("v") == dimension)
    limit = largest_exact(dimension)
    near = v.where(~F.exists("v", lambda x: F.abs(x * SCALE) > limit - 1))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.floor(x * SCALE).cast("double") * F.floor(x * SCALE).cast("double"))
    most = float(np.sqrt(near.agg(F.coalesce(F.max(squares), F.lit(0.0))).first()[0]))
    # the rows with the smallest digests: the same sample in every run
    sample = near.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).select("v").toArrow().column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    pivots = choose_pivots(whole(sample), most) if len(sample) else np.zeros((0, dimension + 1))
    blocks = -(-total // rows_of(total))
    rows = written(keyed(v, dimension, most, pivots), "keyed")
    # equal vectors are told apart by their row, so that many of them fill several blocks
    index = written(rows.repartitionByRange(blocks, "pivot", "dist", F.xxhash64("row")).withColumn("block", F.spark_partition_id()), "annuli")
    annuli = written(index.groupBy("block", "pivot").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi")), "directory")
    asked = index.where(is_query)
    search = lambda block, queries: search_block(block, queries, k, pivots, most, dimension)

    def seed(block: pa.Table) -> pa.Table:
        queries = block.filter(block.column("asks"))
        return search(block, queries.append_column("least", pa.nulls(len(queries), pa.int64())))

    seeds = written(index.withColumn("asks", F.coalesce(is_query, F.lit(False))).groupBy("block").applyInArrow(seed, _FOUND), "seeds")
    least = seeds.groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    queries = written(asked.join(least, asked["row"] == least["query_row"], "left").select("row", "vec_id", "v", "least", F.col("block").alias("own")), "asked")
    pairs = reached(queries, annuli, pivots, most, dimension).join(queries, "row").where("block <> own").drop("own")
    n_asked = max(1, queries.count())
    chunks = -(-n_asked // rows_of(n_asked))
    pairs = pairs.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
    copies = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    rest = copies.groupBy("block", "chunk").cogroup(pairs.groupBy("block", "chunk")).applyInArrow(search, _FOUND)
    both = seeds.unionByName(rest)
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k)
    out = written(ranked.select("query_id", "rank", "vec_id", "score"), "exact")
    drop_written(rows, index, annuli, seeds, queries)
    return out
