"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is a number of equal blocks of words; sources whose targets are but a few
blocks share finer blocks among themselves, so that each comes near its target. Seats (blocks) go to the sources
by the highest quotients target / (2k + 1); house sizes grow shard by shard, so
each shard has integer quotas of its own and the quotas of all shards add up to
those of the whole.

A source's documents stand in a seeded order (a digest of seed, doc_id and size), which is read again from its start
when it ends, three times at most, and cut into blocks of that size. Its seats take the blocks in turn, shard by shard: its k-th seat
has the k-th block. What the mix takes of a document is what the seats' blocks hold of it.

Edge cases: a null text has size 0 and is never taken; null sources form one
source that sorts last; an empty table gives an empty result; repeated rows
count each; very long texts are cut where a block ends; a source without words has target 0. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.llm.shared import drop_written, ordered, word_count, written
from linkwright.operators.tables import running_total

MOST_REPEATS = 3
#: A source's target has so many blocks at least, unless blocks are single words.
LEAST_BLOCKS = 20
FINER = 20


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) -> also weight and target.

    Weights repeat along the sources in code point order, null last. What a
    source can't take beyond ``most`` times its size is shared anew by weight: with
    sources in the order of cap / weight, those that hit their cap come first.
    ``sizes`` has one row per source.
    """
    name = F.col("source").asc_nulls_last()
    dealt = ordered(sizes, [], [name])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = running_total(dealt, [], "_range", [name], F.lit(1), "_rank").select("source", "source_size", weight.alias("weight"), (F.lit(most) * F.col("source_size")).alias("_cap"))
    tight_first = [F.col("_cap") / F.col("weight"), name]
    by_cap = ordered(ranked, [], tight_first)
    drop_written(dealt)
    total, weight_of_all = by_cap.agg(F.sum("source_size"), F.sum("weight")).first()
    sums = running_total(running_total(by_cap, [], "_range", tight_first, F.col("_cap"), "_caps"), [], "_range", tight_first, F.col("weight"), "_weights")
    share = (F.lit(total or 0) - F.col("_caps")) / (F.lit(weight_of_all or 0) - F.col("_weights"))
    shared = written(sums.withColumn("_share", share).withColumn("_capped", F.col("_cap") <= F.col("weight") * F.col("_share")), "shares")
    drop_written(by_cap)
    # the first source below its cap has the share of all that follow; those computed after it are lower
    level = shared.where(~F.col("_capped")).agg(F.max("_share")).first()[0]
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.col("weight") * F.lit(level).cast("double"))
    return shared.select("source", "source_size", "weight", F.lit(total or 0).alias("_total"), F.least(target, F.col("_cap").cast("double")).alias("target"))


def seats(targets: DataFrame, blocks: int, shards: int, most: int = MOST_REPEATS, least: int = 1) -> DataFrame:
    """(source, source_size, k, shard, block): the seats that sources win, with the size of their blocks in words.

    Sources with a target below ``least`` blocks have finer
    blocks and a house of their own: by powers of ``FINER``, until the target has ``least``
    blocks or a block is one word. A source gets no seat beyond ``most`` times its
    own blocks. Only seats are ranked: about ``blocks``, and at most ``least * FINER`` and one for each source with finer blocks.
    """
    block = F.greatest(F.lit(1), F.ceil(F.col("_total") / F.lit(blocks))).cast("long")
    steps = F.greatest(F.lit(0), F.ceil(F.log(block * least / F.col("target")) / F.log(F.lit(float(FINER))) - 1e-9))
    t = targets.where("target > 0").withColumn("block", F.greatest(F.lit(1), F.floor(block / F.pow(F.lit(float(FINER)), steps))).cast("long"))
    # rounded: targets are shares of whole words
    houses = t.groupBy("block").agg(F.round(F.sum("target"), 3).alias("_words")).select("block", F.ceil(F.col("_words") / F.col("block")).cast("long").alias("_house"))
    last = F.least(F.ceil(F.col("target") / F.col("block")), most * F.ceil(F.col("source_size") / F.col("block")) - 1).cast("long")
    asked = t.join(houses, "block").select("source", "source_size", "block", "_house", "target", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    order = [(F.col("target") / (2 * F.col("k") + 1)).desc(), F.col("source").asc_nulls_last(), F.col("k")]
    dealt = ordered(asked, ["block"], order)
    won = running_total(dealt, ["block"], "_range", order, F.lit(1), "seat").where("seat < _house")
    won = written(won.select("source", "source_size", "k", F.floor(F.col("seat") * shards / F.col("_house")).cast("int").alias("shard"), "block"), "seats")
    drop_written(dealt)
    return won


def sainte_lague(targets: DataFrame, blocks: int, shards: int, most: int = MOST_REPEATS, least: int = 1) -> DataFrame:
    """Integer quotas: (source, shard, quota, block), one row per source and shard that has blocks of ``block`` words."""
    return seats(targets, blocks, shards, most, least).groupBy("source", "shard", "block").agg(F.count("*").alias("quota"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), blocks: int = 20000, shards: int = 8, seed: str = "mix-1", row: Column | None = None) -> DataFrame:
    """One row per document with the words the mix takes of it, repeats counted, the shard that reads its first word first, and what ``row`` says of it."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.col("size").cast("string")))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), (F.lit(None).cast("long") if row is None else row).alias("row"))
    rows = written(rows.withColumn("_order", order), "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    won = seats(targets, blocks, shards, least=LEAST_BLOCKS)
    words = won.groupBy(F.col("source").alias("_s")).agg(F.max("block").alias("block"), F.sum("block").alias("_words"))
    plan = targets.join(words, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "block", F.least(F.coalesce("_words", F.lit(0)), MOST_REPEATS * F.col("source_size")).alias("_words"))
    placed = running_total(rows.withColumn("_chunk", F.substring("_order", 1, 3)), ["source"], "_chunk", [F.col("_order"), F.col("doc_id"), F.col("size")], F.col("size"), "_start")
    both = placed.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "p.source_size", "p.target", "p.block", "p._words")
    # all words once for each time that the blocks go through the whole source, and those before the last block's end once more
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("_words") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("_words") - whole * F.col("source_size") - F.col("_start")))
    both = both.withColumn("taken", (whole * F.col("size") + part).cast("long"))
    first = won.select(F.col("source").alias("_s"), F.col("k").alias("_k"), "shard")
    both = both.join(first, F.col("source").eqNullSafe(F.col("_s")) & (F.floor(F.col("_start") / F.col("block")) == F.col("_k")), "left")
    out = written(both.select("doc_id", "size", "source_size", "target", "taken", F.when(F.col("taken") > 0, F.col("shard")).alias("shard"), "row"), "mix")
    drop_written(rows, won, targets)
    return out
