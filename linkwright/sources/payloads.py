"""Payloads whose values have several shapes, as VARIANT columns: equivalents of songs, playlists, and data made safe to show."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from linkwright.functions.text import REDACTED, SECRET_NAMES


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit(kind)), F.lit(False))


def _id(value: Column) -> Column:
    return F.try_variant_get(value, "$.id", "string")


def target_of(value: Column) -> Column:
    """The id in a value that is a list (of objects or ids; the first counts), an object, or the id itself; anything else has none."""
    first = F.try_variant_get(value, "$[0]", "variant")
    listed = F.when(_is(first, "OBJECT"), _id(first)).when(_is(first, "STRING"), F.try_variant_get(first, "$", "string"))
    found = F.when(_is(value, "ARRAY"), listed).when(_is(value, "OBJECT"), _id(value)).when(_is(value, "STRING"), F.try_variant_get(value, "$", "string"))
    return F.nullif(found, F.lit(""))


def equivalents(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(request, id) and (request, body) -> request, id, target, song: what each id stands for in the other storefront.

    ``body`` is the VARIANT of an answer: songs under ``data``, and targets by id under ``meta.filters.equivalents``. A target counts if its song
    was sent; where a request asks for one id only, the first song counts without. Ids that were answered and have none get a null target; ids of requests
    without an answer, or whose body is null or no object, have no row, as nothing is known of them. Repeated ids count once; of several answers of a request the first as text counts.
    """
    ids = asked.select("request", "id").where("id is not null").distinct()
    sole = ids.groupBy("request").agg(F.count("*").alias("n"))
    body = answers.where(_is(F.col("body"), "OBJECT")).groupBy("request").agg(F.min(F.to_json("body")).alias("b")).select("request", F.parse_json("b").alias("body"))
    both = ids.join(sole, "request").join(body, "request")
    songs = F.coalesce(F.try_variant_get("body", "$.data", "array<variant>"), F.array().cast("array<variant>"))
    targets = F.try_variant_get("body", "$.meta.filters.equivalents", "map<string,variant>")
    row = both.select("request", "id", "n", songs.alias("songs"), target_of(F.try_element_at(targets, F.col("id"))).alias("target"))
    sent = F.get(F.filter("songs", lambda s: _id(s) == F.col("target")), F.lit(0))
    first = F.when(F.col("n") == 1, F.get("songs", F.lit(0)))
    song = row.select("request", "id", F.coalesce(sent, first).alias("song"))
    with_id = F.coalesce(_id(F.col("song")) != "", F.lit(False))
    return song.select("request", "id", F.when(with_id, _id(F.col("song"))).alias("target"), F.when(with_id, F.col("song")).alias("song"))


#: Name of a playlist that has none (fixed value).
UNNAMED = "未命名歌单"


def playlists(answers: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """A row for each playlist of VARIANT answers: the columns ``by`` of the answer, pos, id, name, description, can_edit, has_catalog, is_public, artwork_url, date_added.

    A description is an object with a standard form (none: null) or the text itself; one that is missing is empty. Answers without a list have no row.
    """
    by = by or []
    d = answers.select(*by, F.posexplode(F.try_variant_get(F.col(column), "$.data", "array<variant>")).alias("pos", "p"))
    get = lambda path, kind="string": F.try_variant_get("p", f"$.attributes.{path}", kind)
    description = get("description", "variant")
    told = F.when(_is(description, "OBJECT"), get("description.standard")).otherwise(F.coalesce(F.when(_is(description, "STRING"), get("description")), F.lit("")))
    flag = lambda path: F.coalesce(get(path, "boolean"), F.lit(False))
    return d.select(*by, "pos", _id(F.col("p")).alias("id"), F.coalesce(get("name"), F.lit(UNNAMED)).alias("name"), told.alias("description"), flag("canEdit").alias("can_edit"), flag("hasCatalog").alias("has_catalog"), flag("isPublic").alias("is_public"), get("artwork.url").alias("artwork_url"), get("dateAdded").alias("date_added"))


_SECRET = re.compile(SECRET_NAMES)
_RULES = [(re.compile(pattern), other.replace("$1", r"\1")) for pattern, other in REDACTED]


def _safe(value: object) -> object:
    if isinstance(value, dict):
        return {k: _safe(v) for k, v in value.items() if not _SECRET.search(k.lower())}
    if isinstance(value, list):
        return [_safe(v) for v in value]
    if isinstance(value, str):
        for pattern, other in _RULES:
            value = pattern.sub(other, value)
    return value


@F.pandas_udf(StringType())
def _safe_json(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(_safe(json.loads(text)), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return pd.Series([one(t) for t in texts], dtype="object")


def sanitized(value: Column) -> Column:
    """A VARIANT without entries whose names speak of credentials and with redacted texts, at any depth.

    Numbers are read as doubles where they aren't whole. Null stays null, and so does what is nested too deep to be read.
    """
    return F.parse_json(_safe_json(F.to_json(value)))
