"""Ranked lexical search by a threshold-seeded join.

Items are taken in blocks of ITEMS, so what tasks are given of them is bounded; all documents are searched for a block.

1. A forward index: the length of each document and its occurrences of the block's terms.
2. Weights of the terms from their document frequencies, then each term's K largest impacts over all documents; the
   K-th and the largest of each term are stored. As impacts are not negative, a term's K-th impact times its
   occurrences in an item is a lower bound of the item's K-th score: the seed of its threshold.
3. An item's terms are ordered by their largest possible part of a score. The suffix sums of these say which terms
   cannot lift a document to the threshold by themselves; only the documents that hold one of the other, essential
   terms are candidates, and of these the ones whose part by essential terms plus the suffix bound reaches the
   threshold are scored exactly. A task raises an item's threshold to the K-th score that it has found itself.
4. Each task keeps K documents an item; Spark ranks these.

Bounds are only compared with "below": a document that can equal the threshold is scored, so ties are kept.

Defined cases: null and empty texts have no term and count in neither N nor L; a null or empty item has no result;
each row of the items is an item of its own, also where ids repeat; each row of the documents is a document; equal
scores go by ascending id, null ids last; empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, arrow_map, discard, hold, materialise

#: Documents an item; items of a block; share of the length norm, as in (100 - B) + B * length / mean length.
K, ITEMS, B = 20, 1024, 25
#: ASCII but digits and letters separates terms; A-Z becomes a-z.
_PLAIN = bytes(32 if c < 128 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_PLAIN).split() if text else []


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Block:
    """A block of items by numbers: their terms, and (term, item, times) sorted by term."""

    def __init__(self, texts: list[str | None]):
        bags = [Counter(terms_of((t or "").encode("utf-8", "surrogatepass"))) for t in texts]
        self.terms = sorted(set().union(*bags))
        self.number = {t: k for k, t in enumerate(self.terms)}
        flat = sorted((self.number[t], k, n) for k, bag in enumerate(bags) for t, n in bag.items())
        self.term, self.item, self.times = np.array(flat, np.int64).reshape(-1, 3).T
        self.items = len(texts)


def forward(docs: DataFrame, block: Block, id_col: str, text_col: str) -> DataFrame:
    """(key, n, term, tf): lengths of all documents, and the occurrences of the block's terms by number."""
    number = block.number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, terms, tfs, ends = [], [], [], [0]
            for text in batch.column(1).cast(pa.binary()):
                bag = Counter(terms_of(text.as_py()))
                lengths.append(bag.total())
                held = bag.keys() & number.keys()
                terms += [number[t] for t in held]
                tfs += [bag[t] for t in held]
                ends.append(len(terms))
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), lists(terms, pa.int32()), lists(tfs, pa.int64())], names=["key", "n", "term", "tf"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")), run, f"key {kind}, n long, term array<int>, tf array<long>")


def _impacts(batch: pa.RecordBatch, weights: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, impact) of the postings of a batch of the forward index."""
    lists = batch.column(2)
    row = pc.list_parent_indices(lists).to_numpy()
    term = lists.flatten().to_numpy().astype(np.int64)
    tf = batch.column(3).flatten().to_numpy()
    norm = 100 - B + B * batch.column(1).to_numpy() * n // max(total, 1)
    return row, term, weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * norm[row]))


def _largest(group: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values of each group."""
    order = np.lexsort((-value, group))
    g = group[order]
    begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    place = np.arange(len(g)) - np.repeat(begin, np.diff(np.r_[begin, len(g)]))
    return order[place < k]


def stored_impacts(index: DataFrame, weights: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """(term, kth, top): the k-th largest impact of each term (0 if fewer documents hold it) and its largest, by their places in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term = impact = np.zeros(0, np.int64)
        for batch in batches:
            _, t, i = _impacts(batch, weights, n, total)
            term, impact = np.r_[term, t], np.r_[impact, i]
            keep = _largest(term, impact, k)
            term, impact = term[keep], impact[keep]
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(impact)], names=["term", "impact"])

    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))
    best = arrow_map(index, run, "term long, impact long").withColumn("place", place).filter(F.col("place") <= k)
    return best.groupBy("term").agg(F.coalesce(F.min(F.when(F.col("place") == k, F.col("impact"))), F.lit(0)).alias("kth"), F.max("impact").alias("top"))


class Search:
    """A block's search in one task: thresholds, essential terms, the best documents so far."""

    def __init__(self, block: Block, weights: np.ndarray, kth: np.ndarray, top: np.ndarray, k: int):
        self.b, self.k, self.weights = block, k, weights
        self.most = block.times * top[block.term]  # largest part of a score by (term, item)
        self.least = np.ones(block.items, np.int64)  # thresholds: scores above 0 count
        np.maximum.at(self.least, block.item, block.times * kth[block.term])
        self.order = np.lexsort((self.most, block.item))
        self.best: pa.Table | None = None
        self._split()

    def _split(self) -> None:
        """Of each item's terms in ascending order of ``most``, those whose sum stays below the threshold are not essential."""
        item, most = self.b.item[self.order], self.most[self.order]
        upto = np.cumsum(most)
        begin = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, int)
        count = np.diff(np.r_[begin, len(item)])
        upto -= np.repeat(upto[begin] - most[begin], count)
        essential = np.empty(len(item), bool)
        essential[self.order] = upto >= self.least[item]
        self.rest = np.zeros(self.b.items, np.int64)  # what the other terms add at most
        np.add.at(self.rest, self.b.item[~essential], self.most[~essential])
        self.parts = []
        for chosen in (essential, ~essential):
            term = self.b.term[chosen]
            starts = np.searchsorted(term, np.arange(len(self.b.terms) + 1))
            self.parts.append((starts, self.b.item[chosen], self.b.times[chosen]))

    def _sums(self, part: int, row: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int, only: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Sums by row * items + item, and whether there are any; ``only``: the cells that are wanted."""
        starts, items, times = self.parts[part]
        count = starts[term + 1] - starts[term]
        at = np.repeat(starts[term] - np.cumsum(count) + count, count) + np.arange(count.sum())
        cell = np.repeat(row, count) * self.b.items + items[at]
        add = np.repeat(impact, count) * times[at]
        if only is not None:
            held = only[cell]
            cell, add = cell[held], add[held]
        size = rows * self.b.items
        # in two halves, each exact in doubles
        low, high = np.bincount(cell, add & 0xFFFFF, size), np.bincount(cell, add >> 20, size)
        return low.astype(np.int64) + (high.astype(np.int64) << 20), np.bincount(cell, minlength=size) > 0

    def take(self, batch: pa.RecordBatch, n: int, total: int) -> None:
        rows, items = batch.num_rows, self.b.items
        row, term, impact = _impacts(batch, self.weights, n, total)
        score, met = self._sums(0, row, term, impact, rows, None)
        met &= score + np.tile(self.rest, rows) >= np.tile(self.least, rows)
        more, _ = self._sums(1, row, term, impact, rows, met)
        score += more
        cell = np.flatnonzero(met & (score >= np.tile(self.least, rows)))
        if not len(cell):
            return
        found = pa.table({"item": pa.array(cell % items), "score": pa.array(score[cell]), "key": batch.column(0).take(pa.array(cell // items))})
        both = pa.concat_tables([self.best, found]) if self.best is not None else found
        both = both.take(pc.sort_indices(both, [("item", "ascending"), ("score", "descending"), ("key", "ascending")]))
        item = both["item"].to_numpy()
        begin = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        place = np.arange(len(item)) - np.repeat(begin, np.diff(np.r_[begin, len(item)]))
        self.best = both.filter(pa.array(place < self.k))
        full = place == self.k - 1
        if full.any():
            self.least[item[full]] = np.maximum(self.least[item[full]], both["score"].to_numpy()[full])
            self._split()


def _search_block(docs: DataFrame, texts: list[str | None], k: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(item's place in the block, key, score) with k rows an item and task at most; the index that it reads."""
    block = Block(texts)
    index = materialise(forward(docs, block, id_col, text_col), "forward")
    n, total = index.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = index.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()  # a row a term of the block
    weights, kth, top = np.zeros((3, len(block.terms)), np.int64)
    weights[found["term"].to_numpy()] = [weight(n, df) for df in found["df"].to_pylist()]
    stored = materialise(stored_impacts(index, weights, n, total, k), "impacts")
    bounds = stored.toArrow()
    kth[bounds["term"].to_numpy()], top[bounds["term"].to_numpy()] = bounds["kth"].to_numpy(), bounds["top"].to_numpy()
    discard(stored)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(block, weights, kth, top, k)
        step = max(1, BATCH_BYTES // (64 * max(1, block.items)))  # cells handled at a time
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                search.take(batch.slice(begin, step), n, total)
        if search.best is not None:
            yield from search.best.select(["item", "key", "score"]).combine_chunks().to_batches()

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(index, run, f"item long, key {kind}, score long"), index


def search(docs: DataFrame, items: DataFrame, *, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, id, score): the k best documents of each item, or all that score above 0 if they are fewer."""
    spark, made, batch = docs.sparkSession, [], []
    kind = items.schema[item_col].dataType

    def close() -> None:
        found, index = _search_block(docs, [r[1] for r in batch], k, id_col, text_col)
        order = [F.desc("score"), F.asc_nulls_last("key")]
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(p, r[0]) for p, r in enumerate(batch)], f"place long, name {kind.simpleString()}")
        out = ranked.join(names, F.col("item") == F.col("place"))
        made.append(hold(materialise(out.select(F.col("name").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("key").alias(id_col), "score"), "ranked")))
        discard(index)

    for r in items.select(item_col, item_text).toLocalIterator():
        batch.append(r)
        if len(batch) == ITEMS:
            close()
            batch = []
    if batch or not made:
        close()
    out = made[0]
    for x in made[1:]:
        out = out.unionByName(x)
    return out
