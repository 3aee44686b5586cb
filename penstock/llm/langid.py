"""Language identification by n-gram filters with a language bitmask.

A language's filter has all its n-grams whose share of them reaches a floor; shares sum to one, so these are at most
1 / FLOOR whatever the corpus. With a floor of 0 a filter has each n-gram that the language ever had: Spark makes the
positions, and the driver gets the filter alone, never the n-grams. The bit-sliced Bloom filter is one array of bitmasks: k positions of an n-gram, ANDed, give all the languages that have
it; more than 64 languages take several words a position. A document's count of each language is corrected for that
language's rate of false positives.

Defined cases: a text that is null or has no letter is ``und`` with score 0; null languages are not learned from;
ties go to the language that comes first by code point; repeated rows count each; with no labelled row every text
is ``und``; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, materialise

#: Least share of an n-gram in its language, characters of an n-gram, filter positions.
FLOOR, GRAM, PROBES = 5e-5, 3, 4
#: Characters handled at a time, and languages of a mask's word.
BLOCK, WORD = 1 << 18, 64
_letter = regex.compile(r"\p{L}")
_other = regex.compile(r"[^\p{L}\p{M}]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of a text's words in lower case with a blank at either side, in blocks."""
    if not text or not _letter.search(text):
        return
    plain = " " + _other.sub(" ", text.lower()).strip() + " "
    points = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for begin in range(0, len(points) - GRAM + 1, BLOCK):
        part = points[begin : begin + BLOCK + GRAM - 1]
        made = np.zeros(len(part) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            made = (made << np.uint64(21)) | part[k : k + len(made)]
        yield made[part[1 : 1 + len(made)] != 32]  # not around the blank between two words


@dataclass
class Filters:
    """languages by code point; bits: a mask of one or more words for each position; rates: false positives of each language."""

    languages: list[str]
    bits: np.ndarray
    rates: np.ndarray

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """For each key the words of its mask: all languages that have it, and some by chance."""
        out = np.full((len(keys), self.bits.shape[1]), ~np.uint64(0))
        for place in places(keys, len(self.bits)):
            out &= self.bits[place]
        return out

    def has(self, masks: np.ndarray, k: int) -> np.ndarray:
        return masks[:, k // WORD] & np.uint64(1 << k % WORD) != 0

    def predict(self, text: str | None) -> tuple[str, float]:
        n, hits = 0, np.zeros(len(self.languages))
        for keys in grams(text):
            found = self.masks(keys)
            n += len(keys)
            hits += [np.count_nonzero(self.has(found, k)) for k in range(len(hits))]
        if not n or not len(hits):
            return "und", 0.0
        share = np.clip((hits / n - self.rates) / np.maximum(1 - self.rates, 1e-9), 0, 1)
        best = int(share.argmax())
        return self.languages[best], float(share[best] / share.sum()) if share.sum() > 0 else 0.0


def size_for(n: int) -> int:
    """Positions of filters whose largest has ``n`` n-grams: 12 or more for each."""
    return 1 << max(10, (12 * n).bit_length()) if n else 1024


def filters_of(languages: list[str], size: int, place: np.ndarray, word: np.ndarray, mask: np.ndarray) -> Filters:
    """Filters of masks by position and word of the mask."""
    bits = np.zeros((size, max(1, -(-len(languages) // WORD))), np.uint64)
    np.bitwise_or.at(bits, (place, word), mask)
    made = Filters(languages, bits, np.zeros(len(languages)))
    made.rates = np.array([np.count_nonzero(made.has(bits, k)) / size for k in range(len(languages))]) ** PROBES
    return made


def build(languages: list[str], keys: np.ndarray, lang: np.ndarray) -> Filters:
    """Filters of (key, place of its language) pairs."""
    size = size_for(int(np.bincount(lang).max()) if len(keys) else 0)
    place = np.concatenate([*places(keys, size)]) if len(keys) else np.zeros(0, np.int64)
    return filters_of(languages, size, place.astype(np.int64), np.tile(lang // WORD, PROBES), np.tile(np.uint64(1) << (lang % WORD).astype(np.uint64), PROBES))


def places(keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
    mixed = (keys ^ (keys >> np.uint64(31))) * _A
    step = ((mixed ^ (mixed >> np.uint64(29))) * _B) | np.uint64(1)
    for k in range(PROBES):
        yield ((mixed + np.uint64(k) * step) >> np.uint64(20)) & np.uint64(size - 1)


def count_grams(df: DataFrame, *, text_col: str, lang_col: str) -> DataFrame:
    """(lang, key, n) over all rows of ``df``; a task adds up its own batches before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for keys in grams(text.as_py()):
                    old = by.get(lang)
                    made = np.unique(keys, return_counts=True)
                    if old is None:
                        by[lang] = made
                        continue
                    both, back = np.unique(np.concatenate([old[0], made[0]]), return_inverse=True)
                    by[lang] = both, np.bincount(back, np.concatenate([old[1], made[1]])).astype(np.int64)
            for lang, (keys, n) in by.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "key", "n"])

    rows = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    return arrow_map(rows, run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", floor: float = FLOOR) -> Filters:
    """Filters of all rows of ``df``; the driver gets their positions, at most 24 times the n-grams of the largest language."""
    counts = materialise(count_grams(df, text_col=text_col, lang_col=lang_col), "grams")
    sums = materialise(counts.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    languages = sorted(r["lang"] for r in sums.select("lang").collect())  # a row a language
    kept = counts.join(sums.withColumnRenamed("lang", "l"), F.col("lang") == F.col("l")).filter(F.col("n") >= floor * F.col("total")).select("lang", "key")
    kept = materialise(kept, "kept")
    size = size_for(kept.groupBy("lang").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0])
    at = {x: k for k, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, keys = np.array([at[x] for x in batch.column(0).to_pylist()], np.int64), batch.column(1).to_numpy().view(np.uint64)
            for place in places(keys, size):
                mask = (np.uint64(1) << (lang % WORD).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64)), pa.array(lang // WORD), pa.array(mask)], names=["place", "word", "mask"])

    masks = arrow_map(kept, run, "place long, word long, mask long").groupBy("place", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    discard(counts, sums, kept)
    return filters_of(languages, size, masks["place"].to_numpy(), masks["word"].to_numpy(), masks["mask"].to_numpy().view(np.uint64))


def identify(df: DataFrame, filters: Filters, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text: one narrow pass with the filters, a few MB, sent to the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [filters.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.float64())], names=["key", "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")), run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", id_col)
