"""Ranked lexical search through a bit-sliced impact index.

Texts are read once: each document becomes its number of terms and its counts of those terms that stand in
some item (posting lists, written). From them come the sums that impacts need, and the index: documents are cut
into blocks, and within a block each term has one bitmap per bit of its impact, bit i telling document i. A
block keeps only the 64-bit words of a bitmap in which the term has documents. An item's scores are the sum of
its terms' bitmaps, added by bitwise carry arithmetic for all documents of the block at once; its best are
found by descending the sum's slices from the most significant one. The best of all blocks are merged.

Items are a stated query set against all rows, in blocks: a block of the index and a chunk of the items meet in
a task. Terms are told apart by 64-bit hashes. What goes to all tasks is one filter of at most
2^``MOST_FILTER`` bits over the items' terms; one that is too full only leaves out less.

Edge cases: null and empty texts have no terms and count nowhere; a null doc_id takes part, and comes
after others of its score; each of several rows with one doc_id is a document; rows of one item_id are one item, whose terms
are those of all its texts, and a null item_id is an item too; items without a document that has one of their terms
give no rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.llm.decontaminate import Filter, bit_filter
from linkwright.llm.shared import drop_written, written
from linkwright.llm.text_arrays import ALNUM, runs, slices, words

#: Weights of a document's length in the fixed formula of the score.
BASE_LENGTH, LENGTH_SHARE, SCALE = 10, 90, 1_000_000_000
BLOCK_ROWS, BLOCK_POSTINGS, CHUNK_ITEMS = 16_384, 4_000_000, 2048
#: Bytes of bitmaps that a task keeps for the items to come; beyond it, they are made again when next needed.
KEPT_BYTES = 128 << 20
_ONE = np.uint64(1)


def postings(docs: DataFrame, wanted: Filter | None = None) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with at least one term: all its terms that pass ``wanted``, as hashes in order, and their counts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for part in slices(batch.column("text")):
                w = words(part, ALNUM)
                h, n = w.hashes(), np.diff(w.bounds)
                doc = np.repeat(np.arange(len(part)), n)
                if wanted is not None:
                    keep = wanted(h)
                    h, doc = h[keep], doc[keep]
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(first)
                tf = np.diff(np.append(at, len(h)))
                bounds = np.searchsorted(doc[at], np.arange(len(part) + 1)).astype(np.int32)
                full = pa.array(n > 0)
                out = [ids.slice(part.first, len(part)), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(bounds, h[at].view(np.int64)), pa.ListArray.from_arrays(bounds, tf.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n", "terms", "tfs"]).filter(full)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, n long, terms array<long>, tfs array<long>")


def weight(n_docs: Column, df: Column) -> Column:
    """floor(1000 * ln((2 * N + 2) / (2 * df + 1)))"""
    return F.floor(1000 * F.ln((2 * n_docs + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a weight of one is worth in documents of ``n`` terms that have the term ``tf`` times."""
    length = BASE_LENGTH + (LENGTH_SHARE * n * n_docs) // n_terms
    return (SCALE * tf) // (1000 * tf + 8 * length)


class BitSlices:
    """Bitmaps of the bits of one term's impacts: ``bits[b, j]`` is the 64-bit word ``at[j]`` of the bitmap of bit b."""

    def __init__(self, places: np.ndarray, values: np.ndarray):
        order = np.argsort(places, kind="stable")
        places, values = places[order], values[order].astype(np.uint64)
        word = places >> 6
        starts = runs(word)[:-1]
        self.at = word[starts]
        shift = (places & 63).astype(np.uint64)
        width = int(values.max()).bit_length()
        self.bits = np.stack([np.bitwise_or.reduceat(((values >> np.uint64(b)) & _ONE) << shift, starts) for b in range(width)])


def add(total: np.ndarray, term: BitSlices) -> None:
    """Adds a term to ``total``, [slice, word], with carries from bit to bit."""
    own = total[:, term.at]
    carry = np.zeros(len(term.at), np.uint64)
    for b in range(len(total)):
        if b < len(term.bits):
            x, y = own[b], term.bits[b]
            half = x ^ y
            own[b], carry = half ^ carry, (x & y) | (carry & half)
        elif carry.any():
            own[b], carry = own[b] ^ carry, own[b] & carry
        else:
            break
    total[:, term.at] = own


def _set(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def top(total: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest sums above 0, fewer if there are none; ties go to smaller places. Slices are read from the most significant."""
    sure, open_ = np.zeros(total.shape[1], np.uint64), np.bitwise_or.reduce(total, axis=0)
    if _count(open_) <= k:
        return _set(open_)
    for bits in total[::-1]:
        with_bit = open_ & bits
        n = _count(sure) + _count(with_bit)
        if n > k:
            open_ = with_bit
        else:
            sure |= with_bit
            open_ &= ~bits
            if n == k:
                return _set(sure)
    return np.concatenate([_set(sure), _set(open_)[: k - _count(sure)]])


def sums_at(total: np.ndarray, places: np.ndarray) -> np.ndarray:
    word, shift = places >> 6, (places & 63).astype(np.uint64)
    return sum((((bits[word] >> shift) & _ONE).astype(np.int64) << b for b, bits in enumerate(total)), np.zeros(len(places), np.int64))


def search_block(n: np.ndarray, bounds: np.ndarray, terms: np.ndarray, tfs: np.ndarray, items: list[dict[int, int]], n_docs: int, n_terms: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each item (term: weight) places and scores of its best ``k`` rows of the block; rows stand in the order that breaks ties."""
    order = np.argsort(terms, kind="stable")
    row = np.repeat(np.arange(len(n)), np.diff(bounds))[order]
    terms, value = terms[order], impacts(tfs[order], n[row], n_docs, n_terms)
    starts = runs(terms)
    files = dict(zip(terms[starts[:-1]].tolist(), zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True), strict=True))
    index: dict[int, BitSlices] = {}
    kept, out = 0, []
    for item in items:
        largest = {t: w * int(value[files[t][0] : files[t][1]].max()) for t, w in item.items() if t in files}
        known = [t for t, v in largest.items() if v > 0]
        most = sum(largest.values())
        total = np.zeros((most.bit_length(), -(-len(n) // 64)), np.uint64)
        for t in known:
            if t not in index:
                lo, hi = files[t]
                if kept > KEPT_BYTES:
                    index, kept = {}, 0
                index[t] = BitSlices(row[lo:hi], value[lo:hi] * item[t])
                kept += index[t].bits.nbytes
            add(total, index[t])
        places = top(total, k) if most else np.zeros(0, np.int64)
        out.append((places, sums_at(total, places)))
    return out


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """The ``k`` best documents of each item (item_id, text): item_id, rank, doc_id, score."""
    asked = postings(items.select(F.col("item_id").cast("long").alias("doc_id"), "text")).select(F.col("doc_id").alias("item_id"), F.explode("terms").alias("term")).distinct()
    asked = written(asked, "item-terms")
    vocabulary = asked.select("term").distinct()
    posted = written(postings(docs, bit_filter(vocabulary, 1)), "postings")
    # both sides of the score are 64-bit integers; no row: no documents
    whole = posted.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).first()
    n_docs, n_terms = whole["docs"], whole["terms"]
    dfs = posted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weighed = asked.join(dfs, "term").select("item_id", "term", weight(F.lit(n_docs), F.col("df")).alias("w"))
    chunks = -(-max(1, asked.select("item_id").distinct().count()) // chunk_items)
    blocks = max(1, -(-n_docs // block_rows), -(-whole["postings"] // BLOCK_POSTINGS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # rows that share a doc_id are dealt by what they hold, too
    block = F.pmod(F.xxhash64("doc_id", "n", F.slice("terms", 1, 8), F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    index = posted.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs", block.alias("block")).select("*", every(chunks).alias("chunk"))
    listed = weighed.groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("tw")).select("item_id", F.transform("tw", lambda x: x["term"]).alias("terms"), F.transform("tw", lambda x: x["w"]).alias("weights"))
    listed = listed.withColumn("chunk", F.pmod(F.xxhash64("item_id"), F.lit(chunks)).cast("int")).select("*", every(blocks).alias("block"))

    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: dict[str, list] = {"item_id": [], "block": [], "doc_id": [], "score": []}
        if len(rows) and len(queries):
            rows = rows.sort_by([("doc_id", "ascending")]).combine_chunks()  # nulls come last
            lists, ids = rows.column("terms").combine_chunks(), rows.column("doc_id").to_pylist()
            bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            tfs = rows.column("tfs").combine_chunks().flatten().to_numpy()
            asked = [dict(zip(q["terms"], q["weights"], strict=True)) for q in queries.to_pylist()]
            number = rows.column("block")[0].as_py()
            for item, (places, scores) in zip(queries.column("item_id").to_pylist(), search_block(rows.column("n").to_numpy(), bounds, lists.flatten().to_numpy(), tfs, asked, n_docs, n_terms, k), strict=True):
                found["item_id"] += [item] * len(places)
                found["block"] += [number] * len(places)
                found["doc_id"] += [ids[p] for p in places]
                found["score"] += scores.tolist()
        return pa.table(found, schema=pa.schema([("item_id", pa.int64()), ("block", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())]))

    parts = index.groupBy("block", "chunk").cogroup(listed.groupBy("block", "chunk")).applyInArrow(search, "item_id long, block int, doc_id long, score long")
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # the best of many blocks meet in two steps
    few = parts.withColumn("_r", F.row_number().over(Window.partitionBy("item_id", F.pmod("block", F.lit(64))).orderBy(*best))).where(F.col("_r") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best))).where(F.col("rank") <= k)
    out = written(ranked.select("item_id", "rank", "doc_id", "score"), "ranked")
    drop_written(asked, posted)
    return out
