"""Latin readings of Han and kana by tables: compounds replaced in the order of a list, and products of the readings of single letters.

The tables are the caller's and are joined, so they may be of any size. Each distinct text is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.functions.arrow import READINGS, kana_to_romaji
from linkwright.functions.text import swap_kana

#: Letters with several readings that a text may have, and combinations of readings that are tried.
MOST_LETTERS, MOST_READINGS = 4, 32
SALTS = 8
HAN = "[一-龥]"


def checked(compounds: DataFrame) -> DataFrame:
    """(place, written, read) without rows that lack a value. Raises an error for a written form with white space, and for a reading that holds a written form: replaced text would be replaced again."""
    table = compounds.where("place is not null and written != '' and read is not null").select("place", "written", "read")
    if not table.where(F.regexp_like("written", F.lit(r"\s"))).isEmpty():
        raise ValueError("written forms have no white space")
    inside = _met(table.select(F.col("read").alias("text")).distinct(), table)
    if not inside.isEmpty():
        raise ValueError("a reading holds a written form")
    return table


def _met(texts: DataFrame, compounds: DataFrame) -> DataFrame:
    """(text, place, written, read) of distinct texts and the compounds that they hold, met by the first two letters; a frequent start is spread over tasks by text."""
    at = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)))
    starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(F.substr("text", i, F.lit(1)), F.substr("text", i, F.lit(2))))))
    asked = texts.select("text", F.explode(starts).alias("start")).withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)))
    table = compounds.withColumn("start", F.substring("written", 1, 2)).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return asked.join(table, ["start", "salt"]).where(F.contains("text", F.col("written"))).select("text", "place", "written", "read")


def spoken(texts: DataFrame, compounds: DataFrame) -> DataFrame:
    """Distinct (text) -> (text, spoken), for texts that hold a compound: each compound replaced by its reading between blanks, in the order of places.

    A compound whose letters an earlier one has taken is not there any more, as if the list were gone through one by one. ``compounds`` are checked().
    """
    found = _met(texts, compounds).groupBy("text").agg(F.array_sort(F.collect_set(F.struct("place", "written", "read"))).alias("c"))
    return found.select("text", F.aggregate("c", F.col("text"), lambda done, c: F.replace(done, c["written"], F.concat(F.lit(" "), c["read"], F.lit(" ")))).alias("spoken"))


def romaji(text: Column) -> Column:
    """Kana in Latin letters, single blanks, lower case."""
    return F.lower(F.trim(F.regexp_replace(kana_to_romaji(text), r"\s+", " ")))


def compound_reading(texts: DataFrame, compounds: DataFrame) -> DataFrame:
    """Distinct (text) -> (text, reading): compounds, then kana; the text itself, lower-cased, where it has neither. Null and empty texts read as empty."""
    both = texts.join(spoken(texts, compounds), "text", "left")
    return both.select("text", romaji(F.coalesce("spoken", "text", F.lit(""))).alias("reading"))


def _bare(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_]", ""))


def _products(letters: Column, known: Column) -> Column:
    """All texts that letters may read as, the readings of the last letter changing fastest; none where no letter has readings of its own or a bound is passed."""
    kana = F.create_map(*[F.lit(x) for k, v in READINGS.items() if len(k) == 1 for x in (k, v)], *[F.lit(x) for k in "ー〜～" for x in (k, "")])
    one = lambda c: F.coalesce(F.try_element_at(kana, swap_kana(c, to_hiragana=True)), F.lower(c))
    slots = F.transform(letters, lambda c: F.coalesce(F.try_element_at(known, c), F.array(one(c))))
    several = F.size(F.filter(letters, lambda c: F.map_contains_key(known, c)))
    size = F.aggregate(slots, F.lit(1), lambda n, s: F.least(n * F.size(s), F.lit(MOST_READINGS + 1)))
    every = F.aggregate(slots, F.array(F.lit("")), lambda done, s: F.flatten(F.transform(done, lambda head: F.transform(s, lambda x: F.concat(head, x)))))
    return F.when(known.isNotNull() & (several > 0) & (several <= MOST_LETTERS) & (size <= MOST_READINGS), every).otherwise(F.array().cast("array<string>"))


def reading_variants(texts: DataFrame, compounds: DataFrame, letters: DataFrame, artist: bool = False) -> DataFrame:
    """Distinct (text) -> (text, variants): Latin readings in order, each spaced and compact, distinct.

    Only texts with kana or a compound have any. First comes the reading by ``compounds`` (checked()), then the product of the readings of
    single ``letters`` (letter, place, read), of up to ``MOST_LETTERS`` letters of that table and ``MOST_READINGS`` combinations;
    texts beyond have the first only. Readings with Han left are none. ``artist`` adds names of two words turned round, after all others.
    """
    said = texts.join(spoken(texts, compounds), "text", "left")
    said = said.where(F.regexp_like("text", F.lit("[぀-ヿ]")) | F.col("spoken").isNotNull())
    own = said.select("text", F.explode(F.array_distinct(F.split("text", ""))).alias("letter")).withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)))
    table = letters.groupBy("letter").agg(F.transform(F.array_sort(F.collect_set(F.struct("place", "read"))), lambda x: x["read"]).alias("reads"))
    table = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    known = own.join(table, ["letter", "salt"]).groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("letter", "reads"))).alias("known"))
    both = said.join(known, "text", "left").withColumn("base", romaji(F.coalesce("spoken", "text")))
    products = F.flatten(F.transform(_products(F.split("text", ""), F.col("known")), lambda x: F.array(F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))), _bare(x))))
    every = F.concat(F.array("base", _bare(F.col("base"))), products)
    kept = F.array_distinct(F.filter(every, lambda x: (x != "") & ~F.regexp_like(x, F.lit(HAN))))
    out = both.select("text", kept.alias("variants"))
    if artist:
        two = F.filter("variants", lambda v: F.size(F.split(v, " ")) == 2)
        turned = lambda v, mark: F.concat_ws(mark, F.element_at(F.split(v, " "), 2), F.element_at(F.split(v, " "), 1))
        out = out.withColumn("variants", F.array_distinct(F.concat("variants", F.flatten(F.transform(two, lambda v: F.array(turned(v, " "), turned(v, "")))))))
    none = F.array().cast("array<string>")
    return texts.join(out, "text", "left").select("text", F.coalesce("variants", none).alias("variants"))
