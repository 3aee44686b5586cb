"""Removal of repeated word windows by recompression.

Names are 64-bit hashes of what they stand for, so equal word sequences get equal names in every task. A pair round
replaces neighbours (a, b) by a name of the pair where a hash bit puts a left and b right; a run round replaces a run
of any length by a name of the repeated name and the count. A Spark round names, then aggregates the names over all
documents and drops those that no second document has: dropped names never combine again, so later rounds carry
repeats alone.

1. Three pair rounds leave symbols of 8 words at most, and all symbols more than 7 words inside a window depend on the
   window alone. Each window of 50 words is filed under one of them, the one of the longest surroundings (with its
   two neighbours). Names that one document has alone are dropped; the windows of the others are candidates.
2. On the stretches of candidate windows, run and pair rounds go on without a bound on length. Symbols of 50 words or
   more, and pairs of neighbours, that a document of a smaller id has too verify all the windows in them at once.
3. Windows that no such symbol covers (ends of repeats, short ones) are verified one by one.

What decides about a removal is 128 bits of hash over all the words of a symbol or window. Groups of equal texts are
reduced to their smallest id before any of this.

Defined cases: null and empty texts have no words; texts shorter than a window lose nothing; a null id is compared
with nothing and loses nothing; rows of one id are compared with other ids only, each by its own text; an empty table
gives an empty table. Columns of the input are kept; results replace columns of the same names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, arrow_map, discard, free_shuffles, hold, materialise, words_of

#: Words of a window; pair rounds before windows are filed; words at either edge of a window that these may change.
WINDOW, BASE = 50, 3
MARGIN = 2**BASE - 1
#: Pair rounds of each Spark round on the candidates.
ROUNDS = (6, 10)
#: Words whose hashes a worker remembers, and words that are handled at a time: bounds on memory only.
REMEMBERED, BLOCK = 500_000, 1 << 19
_known: dict[bytes, int] = {}
_M1, _M2, _ODD = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(33)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def names_of(words: list[bytes]) -> np.ndarray:
    known = _known
    if len(known) > REMEMBERED:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w) or 1
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


@dataclass
class Symbols:
    """Names of consecutive stretches, second names of the same, words of each, and whether it begins a sequence; name 0 is dropped."""

    name: np.ndarray
    other: np.ndarray | None
    size: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, parts: list[np.ndarray], second: bool = False) -> Symbols:
        name = np.concatenate(parts)
        first = np.zeros(len(name), bool)
        first[np.cumsum([0, *map(len, parts[:-1])])] = True
        return cls(name, _mixed(name ^ _ODD) if second else None, np.ones(len(name), np.int64), first)

    def _put(self, at: np.ndarray, name: np.ndarray, other: np.ndarray | None, keep: np.ndarray) -> Symbols:
        names = self.name.copy()
        names[at] = name
        others = self.other
        if others is not None:
            others = others.copy()
            others[at] = other
            others = others[keep]
        return Symbols(names[keep], others, np.add.reduceat(self.size, np.flatnonzero(keep)), self.first[keep])

    def runs(self) -> Symbols:
        """Runs of equal names, of any length, by one name each."""
        same = (self.name[1:] == self.name[:-1]) & ~self.first[1:] & (self.name[1:] != 0)
        keep = np.concatenate([[True], ~same])
        begin = np.flatnonzero(keep)
        count = np.diff(np.append(begin, len(keep)))
        at, count = begin[count > 1], count[count > 1].astype(np.uint64)
        if not len(at):
            return self
        return self._put(at, _mixed(self.name[at] * _M2 + _mixed(count + _ODD)), None if self.other is None else _mixed(self.other[at] * _M1 + _mixed(count * _ODD)), keep)

    def pairs(self, round_: int) -> Symbols:
        """Neighbours of which the first falls left and the second right by one name each."""
        side = (_mixed(self.name + np.uint64((round_ + 1) * int(_ODD) % 2**64)) >> np.uint64(63)).astype(bool)
        joined = ~side[:-1] & side[1:] & ~self.first[1:] & (self.name[:-1] != 0) & (self.name[1:] != 0)
        at = np.flatnonzero(joined)
        return self._put(at, joint(self.name[at], self.name[at + 1]), None if self.other is None else joint(self.other[at] ^ _M2, self.other[at + 1]), np.concatenate([[True], ~joined]))


def joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(a * _M1 + _mixed(b + _ODD))


def filed(parts: list[np.ndarray], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows of each part, place of each window's symbol, names by place) of word sequences of a window or more."""
    s = Symbols.of(parts)
    for k in range(BASE):
        s = s.pairs(k)
    n, begin = int(s.size.sum()), np.cumsum(s.size) - s.size
    name, key = np.zeros(len(s.name), np.uint64), np.full(len(s.name), ~np.uint64(0))
    name[1:-1] = joint(joint(s.name[:-2], s.name[1:-1]), s.name[2:])
    key[1:-1] = name[1:-1] >> (s.size[:-2] + s.size[1:-1] + s.size[2:]).astype(np.uint64)
    upto = np.zeros(n + 2, np.int64)  # symbols that begin before a word
    upto[begin + 1] = 1
    upto = np.cumsum(upto)
    count = np.array([len(p) - window + 1 for p in parts])
    at = np.repeat(np.cumsum([0, *map(len, parts[:-1])]) - np.cumsum(count) + count, count) + np.arange(count.sum())
    lo, hi = upto[at + MARGIN] + 1, upto[at + window - MARGIN + 1] - 3
    # least key of a range from two overlapping ranges of a power of two
    best, at_best = [np.arange(len(key))], np.frompyfunc(int.bit_length, 1, 1)(np.arange(1, window + 1)).astype(np.int64) - 1
    depth = at_best[hi - lo]
    for k in range(int(depth.max())):
        a, b = best[-1][: -(1 << k)], best[-1][1 << k :]
        best.append(np.where(key[a] <= key[b], a, b))
    out = np.empty(len(at), np.int64)
    for k in range(len(best)):
        of = np.flatnonzero(depth == k)
        a, b = best[k][lo[of]], best[k][hi[of] - (1 << k) + 1]
        out[of] = np.where(key[a] <= key[b], a, b)
    return count, out, name


def window_hashes(names: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of all the words of each window, from running sums."""
    made, n = [], len(names)
    for base, values in ((_ODD, names), (_M2, _mixed(names ^ _ODD))):
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse, np.uint64)]))
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - window, base, np.uint64)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values * down)])
        made.append(_mixed((sums[window:] - sums[:-window]) * up))
    return made[0], made[1]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, kind))


def _groups(sequences: Iterator[tuple[int, np.ndarray]]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """(row, begin, names) in groups of about BLOCK words; longer sequences are cut so that each window is in one part."""
    held, size = [], 0
    for row, names in sequences:
        for begin in range(0, len(names) - WINDOW + 1, BLOCK):
            part = names[begin : begin + BLOCK + WINDOW - 1]
            held.append((row, begin, part))
            size += len(part)
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for k, value in enumerate(column):
        words = words_of(value.as_py())
        if len(words) >= WINDOW:
            yield k, names_of(words)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, row, copy, text) to (key, row, copy, names): the names that the windows of each text are filed under."""
    for batch in batches:
        for group in _groups(_texts(batch.column(3))):
            count, of, name = filed([p for _, _, p in group])
            lists = [name[np.unique(x)] for x in np.split(of, np.cumsum(count)[:-1])]
            rows = pa.array([k for k, _, _ in group])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in range(3)), _lists(lists, pa.int64())], names=["key", "row", "copy", "names"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, row, text, shared names) to (key, row, at, words): names of the words of each stretch of candidate windows."""
    for batch in batches:
        shared = np.unique(np.asarray(batch.column(3).flatten(), np.int64).view(np.uint64))
        for group in _groups(_texts(batch.column(2))):
            count, of, name = filed([p for _, _, p in group])
            candidate = np.isin(name, shared)[of]
            rows, at, words = [], [], []
            for (row, begin, part), mask in zip(group, np.split(candidate, np.cumsum(count)[:-1])):
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                for a, b in edges.reshape(-1, 2).tolist():
                    rows.append(row)
                    at.append(begin + a)
                    words.append(part[a : b + WINDOW - 1])
            if rows:
                rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at, pa.int32()), _lists(words, pa.int64())], names=["key", "row", "at", "words"])


def _named(rounds: int, last: bool):
    """(key, row, at, name, other, size, found) to the same after run and pair rounds; names not in ``found`` are dropped before.

    After the last round the symbols of a window or more come out, and so do pairs of neighbours: (key, row, begin, end, name, other).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = [np.asarray(batch.column(c).flatten()) for c in (3, 4, 5)]
            if not len(whole[0]):
                continue
            lengths = np.asarray(pc.list_value_length(batch.column(3)))
            first = np.zeros(len(whole[0]) + 1, bool)
            first[np.cumsum(lengths) - lengths] = True
            s = Symbols(whole[0].view(np.uint64).copy(), whole[1].view(np.uint64), whole[2].astype(np.int64), first[:-1])
            s.name[~np.isin(s.name, np.asarray(batch.column(6).flatten(), np.int64).view(np.uint64))] = 0
            for k in range(rounds):
                s = s.runs().pairs(100 * last + k)
            cut = np.flatnonzero(s.first)
            if not last:
                sizes = np.diff(np.append(cut, len(s.name)))
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (s.name.view(np.int64), s.other.view(np.int64), s.size.astype(np.int32))]
                filled = batch.filter(pa.array(lengths > 0))
                yield pa.RecordBatch.from_arrays([*(filled.column(c) for c in range(3)), *lists], names=["key", "row", "at", "name", "other", "size"])
                continue
            owner = np.repeat(np.flatnonzero(lengths > 0), np.diff(np.append(cut, len(s.name))))
            before = np.cumsum(s.size) - s.size
            begin = before - before[cut][np.cumsum(s.first) - 1] + np.asarray(batch.column(2))[owner]
            live = s.name != 0
            two = np.flatnonzero(live[:-1] & live[1:] & ~s.first[1:])
            name = np.concatenate([s.name, joint(s.name[two], s.name[two + 1])])
            other = np.concatenate([s.other, joint(s.other[two] ^ _M2, s.other[two + 1])])
            size = np.concatenate([s.size, s.size[two] + s.size[two + 1]])
            owner, begin = np.concatenate([owner, owner[two]]), np.concatenate([begin, begin[two]])
            long = np.flatnonzero((name != 0) & (size >= WINDOW))
            rows = pa.array(owner[long])
            columns = [pa.array(begin[long], pa.int32()), pa.array((begin + size)[long], pa.int32()), pa.array(name[long].view(np.int64)), pa.array(other[long].view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *columns], names=["key", "row", "begin", "end", "name", "other"])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, row, at, words, spans) to (key, row, begin, name, other): windows that no span covers."""
    for batch in batches:
        rows, begins, names, others, held = [], [], [], [], 0

        def made() -> pa.RecordBatch:
            owner = pa.array(np.repeat(np.array(rows, np.int64), [len(x) for x in begins]))
            columns = [pa.array(np.concatenate(begins).astype(np.int32)), pa.array(np.concatenate(names).view(np.int64)), pa.array(np.concatenate(others).view(np.int64))]
            return pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), *columns], names=["key", "row", "begin", "name", "other"])

        for k in range(batch.num_rows):
            words, at, spans = np.asarray(batch.column(3)[k].values).view(np.uint64), batch.column(2)[k].as_py(), batch.column(4)[k].as_py() or []
            open_ = np.zeros(len(words) - WINDOW + 2, np.int64)
            for span in spans:
                begin, end = max(span["begin"] - at, 0), min(span["end"] - at, len(words))
                if end - begin >= WINDOW:
                    open_[begin] += 1
                    open_[end - WINDOW + 1] -= 1
            free = np.flatnonzero(np.cumsum(open_[:-1]) == 0)
            if len(free):
                name, other = window_hashes(words)
                rows.append(k)
                begins.append(free + at)
                names.append(name[free])
                others.append(other[free])
                held += len(free)
                if held > BLOCK:
                    yield made()
                    rows, begins, names, others, held = [], [], [], [], 0
        if rows:
            yield made()


def _shared(flat: DataFrame, by: list[str], what: str) -> DataFrame:
    """(by, lo): the names that two documents have, with the smallest id; partial sums go before the shuffle."""
    seen = flat.groupBy(*by).agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    return materialise(seen.filter("lo < hi").drop("hi").withColumnsRenamed({c: f"s_{c}" for c in by}), what)


def _same(by: list[str]) -> Column:
    out = F.col(by[0]) == F.col(f"s_{by[0]}")
    for c in by[1:]:
        out = out & (F.col(c) == F.col(f"s_{c}"))
    return out


def _older(flat: DataFrame, what: str) -> DataFrame:
    """Those rows of ``flat`` (key, name, other, ...) whose name a smaller id has."""
    by = ["name", "other"]
    return flat.join(_shared(flat, by, what), _same(by) & (F.col("lo") < F.col("key")))


def repeated(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, row, whole, spans): what each text loses; ``row``: hash of the text; ``whole``: a smaller id has an equal text."""
    kind = df.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    rows = df.select(F.col(id_col).alias("key"), F.xxhash64(text).alias("row"), text.alias("text")).filter("key is not null and text is not null")
    scanned = rows.select("key", "row", F.xxhash64(F.lit("copy"), "text").alias("copy"), "text")
    scanned = materialise(arrow_map(scanned, _scan, f"key {kind}, row long, copy long, names array<long>"), "names")
    first = scanned.groupBy(F.col("row").alias("r"), F.col("copy").alias("c")).agg(F.min("key").alias("first"), F.max("key").alias("last"))
    first = materialise(first.filter("first < last").drop("last"), "copies")
    marked = scanned.join(first, (F.col("row") == F.col("r")) & (F.col("copy") == F.col("c")), "left")
    marked = materialise(marked.select("key", "row", "names", F.coalesce(F.col("key") > F.col("first"), F.lit(False)).alias("whole")), "marked")
    discard(scanned)
    copies = materialise(marked.filter("whole").select("key", "row").distinct(), "whole")
    # the first Spark round: names that one document has alone are dropped
    pairs = marked.filter("not whole").select("key", "row", F.explode("names").alias("name"))
    shared = _shared(pairs, ["name"], "shared")
    of = materialise(pairs.join(shared, _same(["name"])).groupBy(F.col("key").alias("k"), F.col("row").alias("r")).agg(F.collect_set("name").alias("names")), "shared-of")
    discard(marked, shared)
    found = rows.join(of, (F.col("key") == F.col("k")) & (F.col("row") == F.col("r"))).select("key", "row", "text", "names")
    stretches = materialise(arrow_map(found, _stretches, f"key {kind}, row long, at int, words array<long>"), "stretches")
    discard(of)
    free_shuffles(df.sparkSession)
    # Spark rounds on the candidates alone
    state = stretches.select("key", "row", "at", F.col("words").alias("name"), F.col("words").alias("other"), F.transform("words", lambda _: F.lit(1)).alias("size"), F.col("words").alias("found"))
    long = None
    for k, rounds in enumerate(ROUNDS):
        last = k + 1 == len(ROUNDS)
        made = f"key {kind}, row long, " + ("begin int, end int, name long, other long" if last else "at int, name array<long>, other array<long>, size array<int>")
        named = materialise(arrow_map(state, _named(rounds, last), made), "named")
        if last:
            long = named
            break
        flat = named.select("key", "row", "at", F.explode("name").alias("name"))
        shared = _shared(flat.filter("name <> 0"), ["name"], "shared")
        live = flat.join(shared, _same(["name"])).groupBy(F.col("key").alias("k"), F.col("row").alias("r"), F.col("at").alias("p")).agg(F.collect_set("name").alias("found"))
        same = (F.col("key") == F.col("k")) & (F.col("row") == F.col("r")) & (F.col("at") == F.col("p"))
        state = named.join(live, same).select("key", "row", "at", "name", "other", "size", "found")
    spans = materialise(_older(long, "long").select("key", "row", "begin", "end").distinct(), "spans")
    held = spans.groupBy(F.col("key").alias("k"), F.col("row").alias("r")).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    open_ = stretches.join(held, (F.col("key") == F.col("k")) & (F.col("row") == F.col("r")), "left").select("key", "row", "at", "words", "spans")
    windows = materialise(arrow_map(open_, _windows, f"key {kind}, row long, begin int, name long, other long"), "windows")
    discard(stretches, long)
    short = _older(windows, "least").select("key", "row", "begin", (F.col("begin") + WINDOW).alias("end"))
    lost = hold(materialise(spans.unionByName(short).groupBy("key", "row").agg(F.collect_set(F.struct("begin", "end")).alias("spans")), "lost"))
    discard(windows, spans)
    free_shuffles(df.sparkSession)
    return lost.select("key", "row", F.lit(False).alias("whole"), "spans").unionByName(copies.select("key", "row", F.lit(True).alias("whole"), F.lit(None).cast(lost.schema["spans"].dataType).alias("spans")))


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the text's kept words joined by one space, and n_words, n_removed.

    A text that loses nothing keeps its own white space; kept_sha256 is always of the joined form.
    """
    lost = repeated(df, id_col=id_col, text_col=text_col).withColumnsRenamed({"key": "__key", "row": "__row", "whole": "__whole", "spans": "__spans"})
    rest = [c for c in df.columns if c not in (text_col, "n_words", "n_removed", "kept_sha256")]
    joined = df.join(lost, (df[id_col] == lost["__key"]) & (F.xxhash64(df[text_col]) == lost["__row"]), "left").select(*rest, F.col(text_col).alias("__text"), "__whole", "__spans")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*rest).schema]
    out = ", ".join([*fields, "`__kept` string", "n_words long", "n_removed long", "kept_sha256 string"])
    where = {c: k for k, c in enumerate(joined.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch, begin: int, results: list[tuple]) -> pa.RecordBatch:
            columns = [batch.column(where[c]).slice(begin, len(results)) for c in rest]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(list(x), t) for x, t in zip(zip(*results), kinds))], names=[*rest, "__kept", "n_words", "n_removed", "kept_sha256"])

        for batch in batches:
            results, size, begin = [], 0, 0
            for k in range(batch.num_rows):
                text, spans = batch.column(where["__text"])[k].as_py(), batch.column(where["__spans"])[k].as_py()
                words = words_of(text)
                n, kept, gone = len(words), text, 0
                if batch.column(where["__whole"])[k].as_py():
                    words, kept, gone = [], "", n
                elif spans:
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, [s["begin"] for s in spans], 1)
                    np.add.at(change, [s["end"] for s in spans], -1)
                    stay = np.cumsum(change[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                    kept, gone = b" ".join(words).decode("utf-8", "surrogatepass"), n - len(words)
                results.append((kept, n, gone, hashlib.sha256(b" ".join(words)).hexdigest()))
                size += len(kept or "")
                if size > BATCH_BYTES:
                    yield made(batch, begin, results)
                    begin, results, size = k + 1, [], 0
            if results:
                yield made(batch, begin, results)

    done = arrow_map(joined, run, out).withColumnRenamed("__kept", text_col)
    return done.select(*[c for c in df.columns if c in rest or c == text_col], "n_words", "n_removed", "kept_sha256")
