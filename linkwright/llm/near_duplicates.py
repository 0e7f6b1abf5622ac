"""Jaccard join on word shingles with signature trees.

Documents are sets of hashed shingles. Equal sets are one vertex, whatever the
number of copies. Links are found in these steps:

1. Spark deals the vertices to groups: in any fixed order of shingles, two sets that
   link share a shingle of their prefixes, so each shingle of a prefix names a group.
   Frequent shingles come last in the order, so passages that many documents hold
   hardly ever name one. Groups with much the same members are one.
2. In each group the vertices are the leaves of signature trees, in order of size; nodes
   hold an OR-combined bitmap, the range of sizes and the components below. A dual traversal
   goes down a pair of nodes only if their largest possible overlap may reach the
   threshold and they aren't all of one component. It is the only source of candidates.
3. Rounds of joining: each member of a group that has candidates keeps its best and its first one; large
   groups are cut into small cells for this. These pairs, two a vertex at most, are compared exactly,
   and links join components. Members of small groups without a candidate are done.
   Later rounds take the rest, and of large groups one vertex of each component.
4. What is left is done in full: groups that still hold several components are cut into blocks by size and
   hash, and each pair of blocks whose sizes allow a link is a task with trees for each
   block. Vertices that have a candidate there get their whole set sent to the task,
   which compares exactly and puts out no more links than join its components.

No step puts out more than a few rows for each vertex of a group, so groups of copies of any
size give rows in proportion to their members. Comparisons are exact, and links left out
join vertices that are in one component already: components are those of all links.

Edge cases: null and empty texts and texts without words have the empty set, are
linked with nothing and form their own component; repeated rows are copies; a
null doc_id takes part and never names a component; an empty table gives no
rows; other columns are ignored. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.llm.components import connected_components
from linkwright.llm.shared import drop_written, row_digest, written
from linkwright.llm.text_arrays import WHITE, Slice, mix, runs, slices, words

SHINGLE = 5
PERCENT = 80
#: Bits of the bitmap of a set of at most ``BITMAP_SET`` shingles; twice as many for each doubling of the set, up to class ``MOST_CLASS``.
BITMAP_BITS = 2048
BITMAP_SET = 512
MOST_CLASS = 6
HOT_TABLE = 1 << 17
HOT_IN_TASK = 8
COUNT_AT_ONCE = 1 << 22
#: Members and shingles of a block of the last step, at most on average.
BLOCK_MEMBERS = 2048
BLOCK_SHINGLES = 1 << 20
#: Members of a cell of the rounds of joining, on average.
CELL_MEMBERS = 256
LEAF = 16
FANOUT = 8
#: Pairs of nodes that a task compares at a time.
NODE_PAIRS = 1 << 13
FILTER_BITS = 1 << 26
#: Shingles of this rank (eight times the binary logarithm of the count) have long lists.
SALTED_RANK = 80
SALTS = 16
#: Rounds of joining at most, and the share of compared pairs that must link for another; the last step is exact after any number of them.
ROUNDS = 4
WORTHWHILE = 0.05


def shingle_hashes(part: Slice, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): all shingles of each text in order. A text of fewer words is one shingle."""
    w = words(part, ~WHITE)
    h = w.hashes()
    counts = np.diff(w.bounds)
    n = len(h)
    total = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        total = (total + h[k : n - size + 1 + k] if n >= size else total) * np.uint64(0xD6E8FEB86659FD93)
    whole = np.maximum(counts - size + 1, 0)
    short = (counts > 0) & (counts < size)
    sizes = np.where(short, 1, whole)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(bounds[-1], np.uint64)
    first = np.repeat(w.bounds[:-1] - bounds[:-1], sizes)
    at = np.arange(bounds[-1]) + first
    is_short = np.repeat(short, sizes)
    out[~is_short] = mix(total[at[~is_short]])
    for i in np.flatnonzero(short):
        x = np.uint64(counts[i])
        for y in h[w.bounds[i] : w.bounds[i + 1]]:
            x = mix(np.array([x ^ y], np.uint64))[0] + np.uint64(1)
        out[bounds[i]] = x
    return out, bounds


def _sets(column: pa.Array, order: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of texts that have words."""
    for part in slices(column):
        h, bounds = shingle_hashes(part)
        if order is not None:
            h = ordered_tokens(h, order)
        for i in range(len(part)):
            own = h[bounds[i] : bounds[i + 1]]
            if len(own):
                own = np.sort(own)
                yield part.first + i, own[np.concatenate([[True], own[1:] != own[:-1]])]


def ordered_tokens(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Shingles as numbers that sort rare ones first; hot: sorted frequent shingles and their ranks (1 to 255)."""
    out = h >> np.uint64(8)
    if len(hot):
        at = np.minimum(np.searchsorted(hot[0], h), len(hot[0]) - 1)
        out |= np.where(hot[0][at] == h, hot[1][at], np.uint64(0)) << np.uint64(56)
    return out


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def vertex_of(s: np.ndarray) -> int:
    """A digest of a set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))[0].view(np.int64))


def bitmap_class(n: np.ndarray | int) -> np.ndarray:
    """Sets that link are of one class or of two that follow."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1) / BITMAP_SET)), 0, MOST_CLASS).astype(np.int64)


def bitmap_of(s: np.ndarray) -> bytes:
    """The bitmap of a set. The upper half laid over the lower one is the bitmap of half as many bits."""
    bits = BITMAP_BITS << int(bitmap_class(len(s)))
    out = np.zeros(bits, bool)
    out[s & np.uint64(bits - 1)] = True
    return np.packbits(out).tobytes()


def documents_and_hot(docs: DataFrame) -> DataFrame:
    """(kind, id, row, n, vertex, bitmap): kind 0 has documents with their row's digest and their set's size, vertex and bitmap, kind 1 shingles that a task saw often and their counts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "id", "row", "n", "vertex", "bitmap"]
        waiting: list[np.ndarray] = []
        held = 0
        counts: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def merged() -> tuple[np.ndarray, np.ndarray]:
            x, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            x, n = np.concatenate([x[n > 1], counts[0]]), np.concatenate([n[n > 1], counts[1]])
            x, at = np.unique(x, return_inverse=True)
            n = np.bincount(at, n, minlength=len(x)).astype(np.int64)
            keep = np.argsort(-n, kind="stable")[:HOT_TABLE]
            return x[keep], n[keep]

        for batch in batches:
            n, vertex, bitmaps = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows, [None] * batch.num_rows
            for i, s in _sets(batch.column("text")):
                n[i], vertex[i] = len(s), vertex_of(s)
                bitmaps[i] = bitmap_of(s)
                waiting.append(s)
                held += len(s)
                if held > COUNT_AT_ONCE:
                    counts, waiting, held = merged(), [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int32)), batch.column("doc_id"), batch.column("row"), pa.array(n), pa.array(vertex, pa.int64()), pa.array(bitmaps, pa.binary())], names=names)
        counts = merged()
        often = counts[1] >= HOT_IN_TASK
        x, n = counts[0][often], counts[1][often]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(x), np.int32)), pa.array(x.view(np.int64)), pa.nulls(len(x), pa.int64()), pa.array(n), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.binary())], names=names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_digest().alias("row"), "text")
    return texts.mapInArrow(make, "kind int, id long, row long, n long, vertex long, bitmap binary")


def hot_order(found: DataFrame) -> np.ndarray:
    """[2, shingles]: the HOT_TABLE most frequent shingles at most, and the logarithm of their counts. Any order is exact; this one is quick."""
    rows = found.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "id").limit(HOT_TABLE).toArrow()
    x = rows.column("id").to_numpy().view(np.uint64) if rows.num_rows else np.zeros(0, np.uint64)
    rank = np.clip(np.log2(np.maximum(rows.column("n").to_numpy(), 1)) * 8, 1, 255).astype(np.uint64) if rows.num_rows else np.zeros(0, np.uint64)
    at = np.argsort(x)
    return np.stack([x[at], rank[at]]) if len(x) else np.zeros((2, 0), np.uint64)


def postings(docs: DataFrame, hot: np.ndarray, percent: int) -> DataFrame:
    """(token, vertex), once per task for each vertex."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        seen: set[int] = set()
        for batch in batches:
            tokens, vertices, held = [], [], 0
            # the order of a shingle keeps its upper 56 bits, so the vertex comes from the full hashes
            for part in slices(batch.column("text")):
                h, bounds = shingle_hashes(part)
                o = ordered_tokens(h, order if order.shape[1] else np.zeros((0, 0)))
                for i in range(len(part)):
                    own = np.unique(h[bounds[i] : bounds[i + 1]])
                    if not len(own):
                        continue
                    v = vertex_of(own)
                    if v in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(v)
                    t = np.unique(o[bounds[i] : bounds[i + 1]])
                    t = t[: prefix_length(len(own), percent)]
                    tokens.append(t)
                    vertices.append(np.full(len(t), v, np.int64))
                    held += len(t)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(vertices))], names=["token", "vertex"])
                    tokens, vertices, held = [], [], 0
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(vertices))], names=["token", "vertex"])

    return docs.select("text").mapInArrow(make, "token long, vertex long")


def shared_tokens(posted: DataFrame) -> DataFrame:
    """(token, lead, vertex) for lists with two vertices or more; lead is the smallest of the list, or of the salted part of a long list.

    Only the lead is kept while a list passes by, so a list may have any length.
    """
    # frequent shingles have their rank in the upper 8 bits; their lists are spread by salt
    salt = F.when(F.shiftrightunsigned("token", 56) >= SALTED_RANK, F.pmod(F.xxhash64("vertex"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    spread = posted.withColumn("salt", salt).repartition("token", "salt").sortWithinPartitions("token", "salt", "vertex")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last list may go on in the next batch: (token, salt, lead, last vertex, whether the lead is out)
        open_list: tuple[int, int, int, int, bool] | None = None
        for batch in batches:
            t, s, v = (batch.column(c).to_numpy() for c in ("token", "salt", "vertex"))
            if not len(t):
                continue
            begins = np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])])
            goes_on = open_list is not None and open_list[:2] == (t[0], s[0])
            new = np.concatenate([[True], v[1:] != v[:-1]]) | begins
            if goes_on:
                new[0] = v[0] != open_list[3]
            first = np.maximum.accumulate(np.where(begins, np.arange(len(t)), 0))
            lead = v[first]
            if goes_on:
                lead = np.where(first == 0, open_list[2], lead)
            member = new & (v != lead)
            lists = np.zeros(len(t), bool)
            lists[first[member]] = True
            # a lead is put out once, with its first other member; leads of salted parts always, as the rest of the list is elsewhere
            lists |= begins & ((t.view(np.uint64) >> np.uint64(56)) >= SALTED_RANK)
            leads = lists & begins
            out_t, out_l, out_v = [t[member], t[leads]], [lead[member], lead[leads]], [v[member], lead[leads]]
            last_first = first[-1]
            was_out = bool(lists[last_first]) or (goes_on and last_first == 0 and open_list[4])
            if goes_on:
                if lists[0]:
                    if open_list[4]:  # the lead is out already
                        keep = ~(out_l[1] == open_list[2]) | ~(out_t[1] == t[0])
                        out_t[1], out_l[1], out_v[1] = out_t[1][keep], out_l[1][keep], out_v[1][keep]
            open_list = (t[-1], s[-1], lead[-1], v[-1], was_out)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_t, out_l, out_v)], names=["token", "lead", "vertex"])

    return spread.mapInArrow(find, "token long, lead long, vertex long")


def sets_of(docs: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vertex, n, shingles) of wanted vertices, from the texts; vertices: (vertex, doc_id) with one document of each.

    A filter of a fixed size at most tells tasks which documents to take; the join behind it is exact.
    """
    spark = docs.sparkSession
    bits = 1 << 16
    while bits < min(16 * vertices.count(), FILTER_BITS):
        bits *= 2
    wanted = np.zeros(bits, bool)
    at = vertices.select(F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("b")).distinct().toArrow().column("b").to_numpy()
    wanted[at] = True
    shared = spark.sparkContext.broadcast(np.packbits(wanted))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            batch = batch.filter(pa.array(wanted[batch.column("b").to_numpy()]))
            ids = batch.column("doc_id")
            out: list[list] = [[], [], []]
            held = 0
            for i, s in _sets(batch.column("text")):
                for column, value in zip(out, (ids[i].as_py(), vertex_of(s), s.view(np.int64)), strict=True):
                    column.append(value)
                held += len(s)
                if held > 500_000:
                    yield _as_batch(*out)
                    out, held = [[], [], []], 0
            if out[0]:
                yield _as_batch(*out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(bits)))
    made = rows.mapInArrow(make, "doc_id long, vertex long, n long, shingles array<long>")
    # rows that share a doc_id, or have none, may hold several texts: the vertex decides
    wanted_rows = vertices.select(F.col("vertex").alias("v"), F.col("doc_id").alias("d"))
    return made.join(wanted_rows, (F.col("vertex") == F.col("v")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi").drop("doc_id")


def _as_batch(ids: list, vertex: list, sets: list) -> pa.RecordBatch:
    sizes = [len(s) for s in sets]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(sets)))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vertex, pa.int64()), pa.array(sizes, pa.int64()), lists], names=["doc_id", "vertex", "n", "shingles"])


class Comparer:
    """Compares pairs of sets exactly. Sets are made from the texts once and kept in the shared folder for later pairs."""

    def __init__(self, docs: DataFrame, vertices: DataFrame, percent: int):
        self.docs, self.vertices, self.percent, self.kept = docs, vertices, percent, []

    def _kept(self) -> DataFrame:
        out = self.kept[0]
        for t in self.kept[1:]:
            out = out.unionByName(t)
        return out

    def sets(self, members: DataFrame) -> DataFrame:
        """(vertex, n, shingles) with all of ``members`` (vertex), which are made now if they weren't before."""
        members = members.distinct()
        if self.kept:
            members = members.join(self._kept().select("vertex"), "vertex", "left_anti")
        members = written(self.vertices.select("vertex", "doc_id").join(members, "vertex"), "members")
        if not self.kept or not members.isEmpty():
            self.kept.append(written(sets_of(self.docs, members), "shingles"))
        drop_written(members)
        # repeated rows give a set more than once
        return self._kept().dropDuplicates(["vertex"])

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The (a, b) pairs that link."""
        sets = self.sets(pairs.select(F.col("a").alias("vertex")).unionByName(pairs.select(F.col("b").alias("vertex"))))
        x = sets.select(F.col("vertex").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
        y = sets.select(F.col("vertex").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
        both = pairs.select("a", "b").join(x, "a").join(y, "b")
        inter = F.size(F.array_intersect("sa", "sb")).cast("long")
        return written(both.where(100 * inter >= self.percent * (F.col("na") + F.col("nb") - inter)).select("a", "b"), "linked")

    def close(self) -> None:
        drop_written(*self.kept)


class Classes:
    """Components of vertices, which links join step by step."""

    def __init__(self) -> None:
        self.roots: DataFrame | None = None

    def of(self, df: DataFrame, vertex: str, name: str) -> DataFrame:
        """Adds the component of a vertex, itself if it has no link."""
        if self.roots is None:
            return df.withColumn(name, F.col(vertex))
        named = self.roots.select(F.col("node").alias(vertex), F.col("root").alias(name))
        return df.join(named, vertex, "left").withColumn(name, F.coalesce(name, vertex))

    def join(self, links: DataFrame) -> bool:
        """Whether there were links between components."""
        ends = self.of(self.of(links, "a", "ra"), "b", "rb").where("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        ends = written(ends, "links")
        if ends.isEmpty():
            drop_written(ends)
            return False
        above = written(connected_components(ends), "roots")
        drop_written(ends)
        if self.roots is not None:
            # of(): nodes of roots that moved have a new root now; new nodes come from above
            moved = self.roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            new = above.join(self.roots.select("node"), "node", "left_anti").select("node", "root")
            old, self.roots = self.roots, written(moved.unionByName(new), "roots")
            drop_written(old, above)
        else:
            self.roots = above
        return True


class Forest:
    """Signature trees over consecutive rows: ``bounds`` says where the rows of each tree begin, and where the last ends.

    Level 0 has the rows themselves, in order of size within a tree; every tree has one node at the top level.
    """

    def __init__(self, bounds: np.ndarray, sizes: np.ndarray, bitmaps: np.ndarray, components: np.ndarray):
        self.levels = [(bitmaps, sizes, sizes, np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64), components, components)]
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        step = LEAF
        while len(self.levels) == 1 or (np.diff(bounds) > 1).any():
            bitmap, low, high, bits, first, last = self.levels[-1]
            nodes = -(-np.diff(bounds) // step)
            above = np.concatenate([[0], np.cumsum(nodes)])
            at = np.repeat(bounds[:-1], nodes) + step * (np.arange(above[-1]) - np.repeat(above[:-1], nodes))
            self.children.append((at, np.append(at[1:], bounds[-1])))
            self.levels.append((np.bitwise_or.reduceat(bitmap, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(bits, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))
            bounds, step = above, FANOUT


def may_link(level: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether members below nodes i and j may link and aren't all of one component.

    A member of i has at most its size, less its bits that no member of j sets, in
    common with one of j; its bits that j sets are at most the common bits of the nodes.
    """
    bitmap, low, high, bits, first, last = level
    common = np.bitwise_count(bitmap[i] & bitmap[j]).sum(axis=1, dtype=np.int64)
    overlap = np.minimum(high[i] - np.maximum(bits[i] - common, 0), high[j] - np.maximum(bits[j] - common, 0))
    one = (first[i] == last[i]) & (first[j] == last[j]) & (first[i] == first[j])
    return (100 * overlap >= percent * np.maximum(low[i], low[j])) & ((100 + percent) * overlap >= percent * (low[i] + low[j])) & ~one


def dual_traversal(forest: Forest, trees_a: np.ndarray, trees_b: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the trees a and b, one by one, that may link, in pieces; of a tree with itself each pair once.

    Goes down depth first with NODE_PAIRS pairs at a time, so its memory does not depend on how many pairs there are.
    """
    todo = [(len(forest.levels) - 1, trees_a, trees_b)]
    while todo:
        level, i, j = todo.pop()
        if len(i) > NODE_PAIRS:
            todo.append((level, i[NODE_PAIRS:], j[NODE_PAIRS:]))
            i, j = i[:NODE_PAIRS], j[:NODE_PAIRS]
        keep = may_link(forest.levels[level], i, j, percent)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if not level:
            yield i, j
            continue
        first, end = forest.children[level - 1]
        wide = end[j] - first[j]
        pairs = (end[i] - first[i]) * wide
        at = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        wide = np.repeat(wide, pairs)
        a, b = np.repeat(first[i], pairs) + at // wide, np.repeat(first[j], pairs) + at % wide
        # a node with itself: each pair of children once
        once = ~np.repeat(i == j, pairs) | (a < b) | ((a == b) & (level > 1))
        todo.append((level - 1, a[once], b[once]))


def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by ``task`` as tables of whole tasks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and held[0].column("task")[0] != batch.column("task")[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        last = int(runs(batch.column("task").to_numpy())[-2])
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def candidates(table: pa.Table, bitmaps: list[bytes], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, weight): pairs of rows of a task that may link: side 0 with side 1, side 2 with itself. The weight is the share of common bits in 4096.

    For each class of bitmaps there is a forest: its sets, and those of the next class with their bitmaps folded.
    """
    task, side, n, component = (table.column(c).to_numpy() for c in ("task", "side", "n", "component"))
    classes = bitmap_class(n)
    for c in np.unique(classes):
        at = np.flatnonzero((classes == c) | (classes == c + 1))
        above = classes[at] > c
        words = BITMAP_BITS << int(c) >> 6
        bits = np.zeros((len(at), words), np.uint64)
        bits[~above] = np.frombuffer(b"".join(bitmaps[i] for i in at[~above]), np.uint64).reshape(-1, words)
        wide = np.frombuffer(b"".join(bitmaps[i] for i in at[above]), np.uint64).reshape(-1, 2 * words)
        bits[above] = wide[:, :words] | wide[:, words:]
        # a tree for each task, side and class
        bounds = np.unique(np.concatenate([runs(task[at]), runs(side[at]), runs(above)]))
        t, s, u = task[at][bounds[:-1]], side[at][bounds[:-1]], above[bounds[:-1]]
        own = np.flatnonzero((s == 2) & ~u)
        a, b = [own], [own]
        for step in (1, 2, 3):
            x = np.arange(max(len(t) - step, 0))
            y = x + step
            x = x[(t[x] == t[y]) & ~(u[x] & u[y]) & (((s[x] == 0) & (s[y] == 1)) | ((s[x] == 2) & (s[y] == 2)))]
            a.append(x)
            b.append(x + step)
        forest = Forest(bounds, n[at], bits, component[at])
        count = forest.levels[0][3]
        for i, j in dual_traversal(forest, np.concatenate(a), np.concatenate(b), percent):
            common = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64)
            yield at[i], at[j], (common << 12) // np.maximum(count[i] + count[j] - common, 1)


TASK_COLUMNS = ["task", "side", "vertex", "n", "component"]


def partners(members: DataFrame, percent: int) -> DataFrame:
    """(task, b, near, first, weight): members b of tasks that have candidates, with the one with most common bits and the first one."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_task(batches):
            vertex, task = table.column("vertex").to_numpy(), table.column("task")
            n = len(vertex)
            best, lead = np.full(n, -1, np.int64), np.full(n, n, np.int64)
            order = np.argsort(vertex, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            for i, j, weight in candidates(table, table.column("bitmap").to_pylist(), percent):
                for x, y in ((i, j), (j, i)):
                    np.maximum.at(best, x, (weight << 32) + (n - rank[y]))
                    np.minimum.at(lead, x, rank[y])
            has = np.flatnonzero(best >= 0)
            near, first = vertex[order[n - (best[has] & 0xFFFFFFFF)]], vertex[order[lead[has]]]
            yield pa.RecordBatch.from_arrays([task.take(pa.array(has)).combine_chunks(), *map(pa.array, (vertex[has], near, first, best[has] >> 32))], names=["task", "b", "near", "first", "weight"])

    return members.mapInArrow(find, "task long, b long, near long, first long, weight long")


def flagged(members: DataFrame, percent: int) -> DataFrame:
    """The members of tasks that have a candidate of another component there."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_task(batches):
            component = table.column("component").to_numpy()
            has = np.zeros(len(component), bool)
            for i, j, _ in candidates(table, table.column("bitmap").to_pylist(), percent):
                other = component[i] != component[j]
                has[i[other]] = has[j[other]] = True
            yield from table.select(TASK_COLUMNS).filter(pa.array(has)).to_batches()

    return members.mapInArrow(find, "task long, side int, vertex long, n long, component long")


def links_of_tasks(members: DataFrame, percent: int) -> DataFrame:
    """(task, side, vertex, n, component, shingles) -> (a, b): exact links that join the components of a task."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_task(batches):
            vertex, component, task = (table.column(c).to_numpy() for c in ("vertex", "component", "task"))
            lists = table.column("shingles").combine_chunks()
            bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            sets = [np.sort(flat[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
            above: dict[tuple[int, int], tuple[int, int]] = {}

            def root(x: tuple[int, int], above: dict = above) -> tuple[int, int]:
                while x in above:
                    x = above[x]
                return x

            out: list[tuple[int, int]] = []
            for i, j, _ in candidates(table, [bitmap_of(s) for s in sets], percent):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    p, q = root((int(task[x]), int(component[x]))), root((int(task[y]), int(component[y])))
                    if p == q:
                        continue
                    s, t = sets[x], sets[y]
                    inter = int(np.count_nonzero(t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s))
                    if 100 * inter >= percent * (len(s) + len(t) - inter):
                        above[max(p, q)] = min(p, q)
                        out.append((int(vertex[x]), int(vertex[y])))
            a, b = (np.array([x[k] for x in out], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return members.mapInArrow(find, "a long, b long")


def groups_of(shared: DataFrame, vertices: DataFrame) -> DataFrame:
    """(task, vertex, n): the lists of shingles with much the same members as one group of all their members.

    A passage gives many such lists, each with the same pairs. Two minima of hashes of the members are the key: lists that share them are alike.
    """
    hot = F.shiftrightunsigned("token", 56) >= SALTED_RANK
    first, second = F.min(F.xxhash64("vertex", F.lit("first"))), F.min(F.xxhash64("vertex", F.lit("second")))
    keys = shared.groupBy("token").agg(F.xxhash64(first, second).alias("task"))
    # long lists meet their key in parts
    keys = keys.select("token", "task", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    salted = shared.select("token", "vertex", F.when(hot, F.pmod(F.xxhash64("vertex"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("salt"))
    return salted.join(keys, ["token", "salt"]).select("task", "vertex").distinct().join(vertices.select("vertex", "n"), "vertex")


def mixed_groups(groups: DataFrame, classes: Classes, percent: int) -> DataFrame:
    """(task, vertex, n, component, size) of groups that hold several components; of a small group the members that have another of a size that allows a link."""
    whole = written(classes.of(groups.select("task", "vertex", "n"), "vertex", "component"), "whole")
    mixed = written(whole.groupBy("task").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo != hi").select("task", "size"), "mixed")
    found = whole.join(mixed, "task").select("task", "vertex", "n", "component", "size")
    by_size = Window.partitionBy("task").orderBy("n", "vertex")
    small = found.where(F.col("size") <= BLOCK_MEMBERS).withColumn("below", F.lag("n").over(by_size)).withColumn("over", F.lead("n").over(by_size))
    small = small.where((100 * F.col("below") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("over"))).drop("below", "over")
    out = written(small.unionByName(found.where(F.col("size") > BLOCK_MEMBERS)), "groups")
    drop_written(whole, mixed)
    return out


def planted_rows(rows: DataFrame, vertices: DataFrame) -> DataFrame:
    """Rows of tasks with their bitmaps, dealt and in the order of the trees."""
    rows = rows.select(*TASK_COLUMNS).join(vertices.select("vertex", "bitmap"), "vertex")
    return rows.repartition("task").sortWithinPartitions("task", "side", "n", "vertex").select(*TASK_COLUMNS, "bitmap")


def cells(groups: DataFrame, number: int) -> DataFrame:
    """Small groups, and large ones cut into cells by hash: after the first round one member of each component, another one each time."""
    small, large = (groups.where(F.col("size") <= BLOCK_MEMBERS), groups.where(F.col("size") > BLOCK_MEMBERS))
    if number:
        one = large.groupBy("task", "component").agg(F.min(F.struct(F.xxhash64("vertex", F.lit(number)).alias("h"), "vertex", "n", "size")).alias("m"))
        large = one.select("task", "component", "m.vertex", "m.n", "m.size")
    cell = F.pmod(F.xxhash64("vertex", F.lit(-1 - number)), F.ceil(F.col("size") / CELL_MEMBERS).cast("long"))
    large = large.withColumn("task", F.xxhash64("task", cell))
    return small.select("task", F.lit(2).alias("side"), "vertex", "n", "component").unionByName(large.select("task", F.lit(2).alias("side"), "vertex", "n", "component"))


def blocks(groups: DataFrame, percent: int) -> DataFrame:
    """All pairs of blocks of the groups whose sizes allow a link, as tasks; a small group is one block.

    A block holds sets of one class of sizes. Classes meet if their ranges of sizes allow a link, which few of a group's classes do.
    """
    small = groups.where(F.col("size") <= BLOCK_MEMBERS).select("task", F.lit(2).alias("side"), "vertex", "n", "component")
    large = groups.where(F.col("size") > BLOCK_MEMBERS).withColumn("class", F.floor(F.log(F.col("n").cast("double")) / np.log(100 / percent)).cast("int"))
    number = F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    ranges = large.groupBy("task", "class").agg(number.alias("blocks"), F.min("n").alias("low"), F.max("n").alias("high"))
    other = ranges.select("task", F.col("class").alias("other"), F.col("blocks").alias("others"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    allowed = (100 * F.col("high2") >= percent * F.col("low")) & (100 * F.col("high") >= percent * F.col("low2"))
    near = ranges.join(other, "task").where(allowed).select("task", "class", "blocks", "other", "others")
    met = large.join(near, ["task", "class"]).withColumn("block", F.pmod(F.xxhash64("vertex"), F.col("blocks").cast("long")).cast("int"))
    met = met.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    here, there = F.struct("class", "block"), F.struct(F.col("other").alias("class"), F.col("at").alias("block"))
    side = F.when(here == there, 2).when(here < there, 0).otherwise(1)
    met = met.select(F.xxhash64("task", F.least(here, there), F.greatest(here, there)).alias("task"), side.alias("side"), "vertex", "n", "component")
    return small.unionByName(met)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, row (its row's digest) and component (a digest; null without words)."""
    found = written(documents_and_hot(docs), "sets")
    rows = found.where("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "vertex", "row")
    vertices = written(found.where("vertex is not null").groupBy("vertex").agg(F.min("id").alias("doc_id"), F.max("n").alias("n"), F.max("bitmap").alias("bitmap")), "vertices")
    shared = written(shared_tokens(postings(docs, hot_order(found), percent)), "lists")
    groups = written(groups_of(shared, vertices), "groups")
    drop_written(shared)
    compare, classes = Comparer(docs, vertices, percent), Classes()
    compared: list[DataFrame] = []
    for number in range(ROUNDS):
        old, groups = groups, mixed_groups(groups, classes, percent)
        drop_written(old)
        nearest = written(partners(planted_rows(cells(groups, number), vertices), percent), "nearest")
        # members of small groups without a candidate are done; what is left of a group goes on
        old_groups, groups = groups, written(groups.where(F.col("size") > BLOCK_MEMBERS).unionByName(groups.join(nearest.select("task", F.col("b").alias("vertex")), ["task", "vertex"], "left_semi").where(F.col("size") <= BLOCK_MEMBERS)), "groups")
        best = nearest.groupBy("b").agg(F.max(F.struct("weight", "near")).getField("near").alias("near"), F.min("first").alias("first"))
        pairs = best.select("b", F.explode(F.array("near", "first")).alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for old in compared:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        compared.append(written(pairs, "pairs"))
        drop_written(old_groups, nearest)
        n_pairs = compared[-1].count()
        if not n_pairs:
            break
        links = compare.linked(compared[-1])
        n_links = links.count()
        classes.join(links)
        drop_written(links)
        if n_links < WORTHWHILE * n_pairs:
            break
    drop_written(*compared)
    old, groups = groups, mixed_groups(groups, classes, percent)
    drop_written(old)
    rest = written(flagged(planted_rows(blocks(groups, percent), vertices), percent), "rest")
    if not rest.isEmpty():
        sets = compare.sets(rest.select("vertex")).select("vertex", "shingles")
        links = written(links_of_tasks(rest.join(sets, "vertex").repartition("task").sortWithinPartitions("task", "side", "n", "vertex").select(*TASK_COLUMNS, "shingles"), percent), "linked")
        classes.join(links)
        drop_written(links)
    drop_written(rest, groups)
    compare.close()
    inner = classes.of(vertices.select("vertex", "doc_id"), "vertex", "root")
    least = inner.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = inner.join(least, "root").select("vertex", "component_id", F.col("root").alias("component"))
    joined = rows.join(named, "vertex", "left")
    out = written(joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "row", "component"), "duplicates")
    drop_written(found, vertices, *([classes.roots] if classes.roots is not None else []))
    return out
