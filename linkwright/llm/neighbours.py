"""Nearest neighbours by largest inner product, through a permutation index.

A vector is represented by its nearest pivots in order (its permutation prefix), and
posted with their places in the inverted files of these pivots alone, three eighths of all.
The index is cut into blocks by a digest of the row. A query reads the files of the
pivots in its own prefix and adds up what each posting says about the footrule distance;
rows that it doesn't meet have the largest. It reads
the cosine off the distance (prefixes know directions only), times the vector's norm, keeps
six times the root of the block's rows (all ties included) and reranks these by the exact
measure in double precision. The best of all blocks are merged.

Queries are a stated set against all rows, in blocks: a block of the index and a chunk of the
queries meet in a task, so a vector is sent once for each chunk, and a query once for each block. Both
grow with the table up to ``MOST_ROWS``, so that few copies are sent.

Pivots are the axes of a seeded random rotation and their opposites: they lie evenly
in all directions, so places in a prefix follow the measure more closely than with
pivots drawn from the data.

Edge cases: vectors that are null, all zero, or hold null or non-finite
components take no part, nor do those whose length isn't the most common one (the
smallest such length if tied), as no inner product with others is defined; a null vec_id takes no part. Each of
several rows with the same vec_id is a row of its own: a candidate for all others, and a query whose ranks are
told apart by query_row, the digits of its vector's digest; equal rows of one vec_id are one query, and only one of them is its own. Ties go to the smaller
vec_id; with fewer candidates than ``k`` all are returned; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_ROWS = 8192
MOST_ROWS = 65536
#: Blocks of a table of middling size.
BLOCKS = 64
#: Candidates of a query in a block of n rows: this times the root of n, so they grow slower than the table.
CANDIDATES = 6


def candidates_of(rows: int, k: int) -> int:
    return max(k + 1, int(np.ceil(CANDIDATES * np.sqrt(rows))))


def rows_at_once(total: int) -> int:
    """Rows of a block of the index, or queries of a chunk."""
    return int(np.clip(total // BLOCKS, LEAST_ROWS, MOST_ROWS))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, row): vectors that take part; row is a digest of the vector, the same for equal vectors."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~bad & F.exists("v", lambda x: x != 0))
    return v.withColumn("row", F.xxhash64("v"))


def axis_pivots(dimension: int, seed: int = 11) -> np.ndarray:
    """[2 * dimension, dimension]: a random rotation's axes and their opposites."""
    axes, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimension, dimension)))
    return np.concatenate([axes, -axes])


def prefixes(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """[row, length] pivot numbers, nearest first; ties go to the smaller number."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :length].astype(np.int16)


def prefix_length(dimension: int) -> int:
    return max(min(dimension, 8), dimension * 3 // 4)


class InvertedFiles:
    """For each pivot the rows that have it in their prefix, and its places there."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, length: int):
        own = prefixes(x, pivots, length)
        order = np.argsort(own.ravel(), kind="stable")
        bounds = np.searchsorted(own.ravel()[order], np.arange(len(pivots) + 1))
        rows, places = (order // length).astype(np.int32), (order % length).astype(np.int32)
        self.files = [(rows[lo:hi], places[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
        self.n, self.length = len(x), length

    def footrule(self, prefix: np.ndarray) -> np.ndarray:
        """Footrule distances of a query's prefix to all rows; a pivot outside a prefix has the place ``length``."""
        m = self.length
        out = np.full(self.n, m * (m + 1), np.int32)
        for place, pivot in enumerate(prefix):
            rows, places = self.files[pivot]
            # both sides have the pivot: not length less each place, but the places' difference
            out[rows] += np.abs(places - place) - (2 * m - place) + places
        return out


def cosine_table(pivots: np.ndarray, length: int, seed: int = 12) -> np.ndarray:
    """The cosine that each footrule distance stands for, from pairs of random directions with known cosines; it never rises."""
    rng = np.random.default_rng(seed)
    cosines = np.linspace(1, -1, 81)
    a, b = rng.normal(size=(2, 64, pivots.shape[1]))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-9)
    files = InvertedFiles(a, pivots, length)
    mean = [np.mean([files.footrule(p)[i] for i, p in enumerate(prefixes(c * a + np.sqrt(1 - c * c) * b, pivots, length))]) for c in cosines]
    return np.interp(np.arange(length * (length + 1) + 1), np.maximum.accumulate(mean), cosines)


def search_block(ids: np.ndarray, own_rows: np.ndarray, x: np.ndarray, query_ids: np.ndarray, query_rows: np.ndarray, q: np.ndarray, pivots: np.ndarray, length: int, k: int, cosine: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query its best k + 1 of the block, its own row among them if it is one: (vec_ids, scores, whether it may be its own)."""
    by_id = np.argsort(ids, kind="stable")
    ids, x, own_rows = ids[by_id], x[by_id], own_rows[by_id]
    # equal vectors are one entry of the index, so that many copies don't fill the candidates
    x, entry = np.unique(x, axis=0, return_inverse=True)
    order = np.argsort(entry.ravel(), kind="stable")
    bounds = np.searchsorted(entry.ravel()[order], np.arange(len(x) + 1))
    files = InvertedFiles(x, pivots, length)
    norms = np.linalg.norm(x / np.abs(x).max(), axis=1)
    own = prefixes(q, pivots, length)
    wanted = min(len(x), candidates_of(len(x), k))
    out = []
    for i in range(len(q)):
        far = -norms * cosine[files.footrule(own[i])]
        near = np.flatnonzero(far <= np.partition(far, wanted - 1)[wanted - 1])
        scores = np.einsum("ij,j->i", x[near], q[i])
        if len(near) > k + 1:
            # one row is the query itself
            enough = np.flatnonzero(scores >= np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1])
            near, scores = near[enough], scores[enough]
        # an entry's first ids are its smallest
        rows = [order[bounds[e] : min(bounds[e + 1], bounds[e] + k + 1)] for e in near]
        scores = np.repeat(scores, [len(r) for r in rows])
        found = np.concatenate(rows)
        best = found[np.lexsort((ids[found], -scores))[: k + 1]]
        scores = np.sort(scores)[::-1][: k + 1]
        out.append((ids[best], scores, (ids[best] == query_ids[i]) & (own_rows[best] == query_rows[i])))
    return out


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``queries`` has the vec_id of rows of ``vectors``. Returns query_id, rank, vec_id, score, query_row."""
    v = usable(vectors)
    sizes = v.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    total, dimension = (sizes[0]["count"], sizes[0]["d"]) if sizes else (0, 0)
    # of equal rows of one vec_id no more than k + 1 can be in a result
    v = v.where(F.size("v") == dimension).groupBy("vec_id", "row").agg(F.min("v").alias("v"), F.least(F.count("*"), F.lit(k + 1)).cast("int").alias("copies"))
    pivots, length = axis_pivots(dimension), prefix_length(dimension)
    asked = v.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi").drop("copies")
    n_asked = asked.count()
    blocks, chunks = -(-max(total, 1) // rows_at_once(total)), -(-max(n_asked, 1) // rows_at_once(n_asked))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # many rows may share a vec_id, or a vector: both go into the digest
    index = v.select("vec_id", "v", "row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_")).drop("_").select("*", F.pmod(F.xxhash64("vec_id", "row"), F.lit(blocks)).cast("int").alias("block")).select("*", every(chunks).alias("chunk"))
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), F.col("v").alias("q"), F.pmod(F.xxhash64("vec_id", "row", F.lit(2)), F.lit(chunks)).cast("int").alias("chunk")).select("*", every(blocks).alias("block"))
    shared = vectors.sparkSession.sparkContext.broadcast((pivots, cosine_table(pivots, length) if dimension else np.zeros(1)))

    def search(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if block.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "query_row": [], "found": []})
        stack = lambda c: np.array(c.tolist(), np.float64)
        best = search_block(*(block[c].to_numpy() for c in ("vec_id", "row")), stack(block["v"]), *(queries[c].to_numpy() for c in ("query_id", "query_row")), stack(queries["q"]), shared.value[0], length, k, shared.value[1])
        found = [[{"score": s, "vec_id": int(i), "own": bool(o)} for i, s, o in zip(*x, strict=True)] for x in best]
        return pd.DataFrame({"query_id": queries["query_id"], "query_row": queries["query_row"], "found": found})

    parts = index.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInPandas(search, "query_id long, query_row long, found array<struct<score:double,vec_id:long,own:boolean>>")
    merged = parts.groupBy("query_id", "query_row").agg(F.flatten(F.collect_list("found")).alias("f"))
    ordered = F.array_sort(F.transform("f", lambda x: F.struct((-x["score"]).alias("n"), x["vec_id"].alias("vec_id"), x["score"].alias("score"), x["own"].alias("own"))))
    # of rows that equal the query's, one is its own
    first = F.array_position(F.transform("o", lambda x: x["own"]), F.lit(True)).cast("int")
    others = F.when(first > 0, F.concat(F.slice("o", F.lit(1), first - 1), F.slice("o", first + 1, F.size("o")))).otherwise(F.col("o"))
    ranked = merged.select("query_id", "query_row", ordered.alias("o")).select("query_id", "query_row", F.posexplode(F.slice(others, 1, k)).alias("pos", "x"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"), "query_row")
