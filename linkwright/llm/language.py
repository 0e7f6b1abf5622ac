"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, seeded by its code point. A letter
trigram is bound from its letters' vectors, each permuted (rotated) by its
place; a document bundles (adds) its trigrams, and a language's prototype bundles
the unit vectors of its training documents. The language with the largest cosine wins.

Edge cases: null texts and texts without letters get ``und`` and score 0; ties
go to the language that sorts first; with no training rows every text gets
``und``; repeated rows each get a row; very long texts are read whole; an empty table gives no rows; other
columns are ignored; more than ``MOST_LANGUAGES`` languages are an error, none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.text_arrays import Slice, slices

DIMENSIONS = 1024
#: Prototypes have 8 KB each; a column with more different values doesn't hold languages, and is an error.
MOST_LANGUAGES = 20_000
SMALL = 128
ROWS_AT_ONCE = 256
#: Distinct trigrams whose vectors are made at once, where a text has too many letters for a table of all.
TRIGRAMS_AT_ONCE = 4096

_LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])


class Encoder:
    """Turns texts into document vectors; keeps the vectors of trigrams it has met."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.symbol = np.full(0x110000, -1, np.int32)
        self.symbol[32] = 0
        self.letters = [np.ones(dimensions, np.int8)]
        self.row_of = np.full(SMALL**3, -1, np.int32)
        self.table = np.zeros((0, dimensions), np.float32)

    def _learn_letters(self, points: np.ndarray) -> None:
        for p in np.unique(points[self.symbol[points] < 0]):
            self.symbol[p] = len(self.letters)
            self.letters.append(np.random.default_rng(int(p) + 7919).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1)

    def _forget(self) -> None:
        """Starts anew when there are more letters than the table of trigrams is made for: they are drawn again when next met."""
        self.symbol[:], self.row_of[:] = -1, -1
        self.symbol[32] = 0
        self.letters, self.table = self.letters[:1], np.zeros((0, self.dimensions), np.float32)

    def _bound(self, first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
        own, place = np.unique(np.concatenate([first, second, third]), return_inverse=True)
        v = np.array([self.letters[i] for i in own])
        first, second, third = np.split(place, 3)
        return (np.roll(v[first], 2, axis=1) * np.roll(v[second], 1, axis=1) * v[third]).astype(np.float32)

    def _rows(self, codes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of the trigrams in codes, and which of them each code has."""
        distinct = np.flatnonzero(np.bincount(codes, minlength=1))
        new = distinct[self.row_of[distinct] < 0]
        if len(new):
            self.row_of[new] = len(self.table) + np.arange(len(new))
            self.table = np.concatenate([self.table, self._bound(new // base**2, new // base % base, new % base)])
        return self.table, self.row_of[codes]

    def _bundled(self, codes: np.ndarray, row: np.ndarray, rows: int, base: int) -> np.ndarray:
        """[rows, dimensions]: sums of the vectors of the trigrams of each row, ``TRIGRAMS_AT_ONCE`` distinct ones at a time."""
        order = np.lexsort((row, codes))
        codes, row = codes[order], row[order]
        first = np.ones(len(codes), bool)
        first[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(first)
        times = np.diff(np.append(at, len(codes))).astype(np.float32)
        codes, row = codes[at], row[at]
        distinct, place = np.unique(codes, return_inverse=True)
        out = np.zeros((rows, self.dimensions), np.float32)
        for lo in range(0, len(distinct), TRIGRAMS_AT_ONCE):
            some = distinct[lo : lo + TRIGRAMS_AT_ONCE]
            own = slice(*np.searchsorted(place, (lo, lo + len(some))))
            counts = np.zeros((rows, len(some)), np.float32)
            counts[row[own], place[own] - lo] = times[own]
            out += counts @ self._bound(some // base**2, some // base % base, some % base)
        return out

    def vectors(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """(vector of each text, whether it has a letter)."""
        if len(self.letters) > SMALL:
            self._forget()
        raw, at = part.data.tobytes(), part.offsets
        texts = [" " + raw[at[i] : at[i + 1]].decode("utf-8", "replace").lower() + " " for i in range(len(part))]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        is_letter = _LETTER[points]
        points = np.where(is_letter, points, 32)
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        keep[begins[:-1]] = True
        self._learn_letters(points[is_letter])
        kept_before = np.concatenate([[0], np.cumsum(keep)])
        codes = self.symbol[points[keep]].astype(np.int64)
        bounds = kept_before[begins]
        base = SMALL if len(self.letters) <= SMALL else len(self.letters)
        out = np.zeros((len(part), self.dimensions), np.float32)
        lettered = np.array([np.any(is_letter[begins[i] : begins[i + 1]]) for i in range(len(part))])
        if len(codes) < 3:
            return out, lettered
        three = codes[:-2] * base**2 + codes[1:-1] * base + codes[2:]
        # two spaces in a row stand between texts only
        across = ((codes[:-2] == 0) & (codes[1:-1] == 0)) | ((codes[1:-1] == 0) & (codes[2:] == 0))
        if base > SMALL:
            for lo in range(0, len(part), ROWS_AT_ONCE):
                hi = min(lo + ROWS_AT_ONCE, len(part))
                own = slice(bounds[lo], max(bounds[lo], min(bounds[hi], len(three))))
                kept = np.flatnonzero(~across[own]) + own.start
                out[lo:hi] = self._bundled(three[kept], np.searchsorted(bounds, kept, "right") - 1 - lo, hi - lo, base)
            return out, lettered
        table, place = self._rows(np.where(across, 0, three), base)
        for lo in range(0, len(part), ROWS_AT_ONCE):
            hi = min(lo + ROWS_AT_ONCE, len(part))
            counts = np.zeros((hi - lo, len(table)), np.float32)
            for i in range(lo, hi):
                own = slice(bounds[i], max(bounds[i], min(bounds[i + 1], len(place))))
                if own.stop > own.start:
                    counts[i - lo] = np.bincount(place[own][~across[own]], minlength=len(table))
            out[lo:hi] = counts @ table
        if len(table) > 40_000:
            self.table, self.row_of[:] = np.zeros((0, self.dimensions), np.float32), -1
        return out, lettered


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def learn_prototypes(train: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """(text, lang) -> languages in order and their unit prototypes; with more than MOST_LANGUAGES it raises an error."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dimensions), {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for part in slices(batch.column("text")):
                vectors, lettered = encoder.vectors(part)
                vectors = _unit(vectors)
                own = langs[part.first : part.first + len(part)]
                for lang in set(own[lettered]):
                    sums[lang] = sums.get(lang, 0) + vectors[(own == lang) & lettered].sum(axis=0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = train.select("text", "lang").where("lang is not null and text is not null").mapInArrow(bundle, "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    rows = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).select("lang", F.transform("v", lambda s: s["x"]).alias("v")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    return [r["lang"] for r in rows], _unit(np.array([r["v"] for r in rows])) if rows else np.zeros((0, dimensions))


def predict_language(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """(doc_id, held_out, text) -> doc_id, held_out, lang_pred, score."""
    dimensions = prototypes.shape[1]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dimensions)
        for batch in batches:
            names, scores = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            for part in slices(batch.column("text")) if langs else ():
                vectors, lettered = encoder.vectors(part)
                cosines = _unit(vectors) @ prototypes.T
                best = cosines.argmax(axis=1)
                own = slice(part.first, part.first + len(part))
                names[own] = np.where(lettered, np.array(langs, object)[best], "und")
                scores[own] = np.where(lettered, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, folds: int = 5, held: int = 0, dimensions: int = DIMENSIONS) -> DataFrame:
    """Learns from rows outside the held-out fold and predicts the language of every row."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text", "lang")
    langs, prototypes = learn_prototypes(rows.where(~F.col("held_out")), dimensions)
    return predict_language(rows, langs, prototypes)
