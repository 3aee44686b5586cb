"""The prefix trie of conversations: a Cartesian tree over the LCP array of the sorted conversations.

1. Each conversation is a sequence of turn names (128-bit hashes of role and text). Equal sequences are one row with a
   count, so groups of copies are reduced before anything is gathered.
2. The sequences are sorted by Spark: one range a block. A block has the longest common prefix (LCP) of each sequence
   with the one before; those at the borders of blocks are found by a join of last and first rows.
3. In a block, nearest smaller values on both sides of each LCP, and of each sequence's own length, are the interval
   of a node of the Cartesian tree: the sequences with that prefix. Nodes of equal LCP in one interval are one node.
   A depth between a node and its parent has the same interval: those are filled in. What a node sums comes from
   prefix sums over the interval, its least member from a table of minima over powers of two.
4. An interval that has no smaller value up to a border of its block, as the minimum of the block shows, goes on in the
   next one. Of such a node each block gives the part of the sums that it has itself, under the hash of the prefix, and
   Spark adds them up. All that a node needs is such a sum: the bytes saved are those of all members less those of
   the distinct turns, each counted where its node begins.

Tasks hold one block (BLOCK sequences on average) or one conversation's turns. The driver holds a few integers a block.

Defined cases: a null turn comes first, ties of turn go by role, then by the MD5 of the text; null role or text is empty; rows of a null
conversation id are left out; repeated rows are turns of their own; an empty table has no node; only the named columns
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, hold, materialise

#: Distinct sequences of a block on average; bytes of a piece of a list of ids.
BLOCK, PIECE = 50_000, 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, i, name, size): turns in their order by conversation, from 0; name of role and text, bytes of the text.

    A range sort over all rows, so that a conversation of any length is dealt over many tasks; a block needs to know of
    the ones before it only how many turns of its first conversation they have.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.md5(text.cast("binary")).alias("text"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("name"), F.octet_length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv", F.asc_nulls_first("turn"), "role", "text", "row"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv", "name", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            begin = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            i = np.arange(len(conv)) - np.repeat(begin, np.diff(np.r_[begin, len(conv)]))
            if last == conv[0]:
                i[: begin[1] if len(begin) > 1 else len(conv)] += held
            last, held = conv[-1], i[-1] + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), block, np.int32)), pa.array(i.astype(np.int64)), *batch.columns], names=["block", "i", "conv", "name", "size"])

    out = materialise(arrow_map(rows, run, "block int, i long, conv long, name binary, size long"), "numbered")
    ends = out.groupBy("block").agg(F.min("conv").alias("first"), F.max("conv").alias("last"), F.max_by("i", F.struct("conv", "i")).alias("i")).orderBy("block").collect()  # a row a block
    add, held, of = {}, 0, None
    for r in ends:
        if of == r["first"]:
            add[r["block"]] = held
        held = r["i"] + 1 + (held if r["first"] == r["last"] == of else 0)
        of = r["last"]
    if not add:
        return out.drop("block")
    spark = turns.sparkSession
    first = spark.createDataFrame([(r["block"], r["first"], add[r["block"]]) for r in ends if r["block"] in add], "b int, c long, more long")
    # a row a block at most, so it may be broadcast
    out = out.join(F.broadcast(first), (F.col("block") == F.col("b")) & (F.col("conv") == F.col("c")), "left")
    return out.select("conv", (F.col("i") + F.coalesce("more", F.lit(0))).alias("i"), "name", "size")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, seq: array of (name, size)) of (conv, i, name, size): the first h turns of conversation conv - conv % 5, then its own after its first h."""
    h = F.crc32(F.col("conv").cast("string")) % 9
    own = turns.filter(F.col("i") >= h).select("conv", F.lit(1).alias("part"), "i", "name", "size")
    convs = turns.select("conv").distinct()
    head = turns.filter("conv % 5 = 0 and i < 8").select(F.col("conv").alias("of"), "i", "name", "size")
    begun = convs.withColumn("h", h).join(head, (F.col("of") == F.col("conv") - F.col("conv") % 5) & (F.col("i") < F.col("h")))
    rows = begun.select("conv", F.lit(0).alias("part"), "i", "name", "size").unionByName(own)
    made = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "i", "name", "size"))).alias("x"))
    made = made.select("conv", F.transform("x", lambda t: F.struct(t["name"].alias("name"), t["size"].alias("size"))).alias("seq"))
    return convs.join(made, "conv", "left").select("conv", F.coalesce("seq", F.array().cast(made.schema["seq"].dataType)).alias("seq"))


def _digests(members: DataFrame) -> DataFrame:
    """(of, ends) of (of, conv): SHA-256 of each group's ids in order, comma-joined.

    Ids are sorted over all tasks and joined to pieces there; the pieces of a group are then hashed as they stream by,
    as the hash is a chain.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, first, held, size, out = None, None, [], 0, []
        for batch in batches:
            for g, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if g != of or size > PIECE:
                    if held:
                        out.append((of, first, ",".join(held)))
                    of, first, held, size = g, c, [], 0
                held.append(str(c))
                size += 8
            if len(out) > 100:
                yield _records(out)
                out = []
        if held:
            out.append((of, first, ",".join(held)))
        if out:
            yield _records(out)

    def _records(out: list[tuple]) -> pa.RecordBatch:
        a, b, c = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["of", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, it, out = None, None, []
        for batch in batches:
            for g, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if g != of:
                    if it:
                        out.append((of, it.hexdigest()))
                    of, it = g, hashlib.sha256(ids.as_py().encode())
                else:
                    it.update(b"," + ids.as_py().encode())
            yield pa.RecordBatch.from_pylist([{"of": a, "ends": b} for a, b in out], pa.schema([("of", pa.int64()), ("ends", pa.string())]))
            out = []
        if it:
            yield pa.RecordBatch.from_pylist([{"of": of, "ends": it.hexdigest()}], pa.schema([("of", pa.int64()), ("ends", pa.string())]))

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = arrow_map(members.select("of", "conv").repartitionByRange(parts, "of", "conv").sortWithinPartitions("of", "conv"), pieces, "of long, first long, ids string")
    return arrow_map(cut.repartition("of").sortWithinPartitions("of", "first").select("of", "ids"), hashed, "of long, ends string")


def _sorted(seqs: DataFrame, blocks: int) -> DataFrame:
    """(block, k, lcp, sizes, least, n, ends, edge) of (seq, least, n, ends): the distinct sequences in order; the names only of a block's first and last."""
    rows = seqs.select(F.transform("seq", lambda t: t["name"]).alias("names"), F.transform("seq", lambda t: t["size"]).alias("sizes"), "least", "n", "ends")
    rows = rows.repartitionByRange(blocks, "names").sortWithinPartitions("names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, k, before = TaskContext.get().partitionId(), 0, None
        schema = pa.schema([("block", pa.int32()), ("k", pa.int64()), ("lcp", pa.int64()), *[(n, t) for n, t in (("sizes", pa.list_(pa.int64())), ("least", pa.int64()), ("n", pa.int64()), ("ends", pa.string()))], ("edge", pa.list_(pa.binary()))])
        last = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                names, lcp = r.pop("names"), 0
                if before is not None:
                    lcp = next((d for d, (a, b) in enumerate(zip(before, names)) if a != b), min(len(before), len(names)))
                if last:
                    out.append(last)
                last = r | {"block": block, "k": k, "lcp": lcp, "edge": None if k else names}
                before, k = names, k + 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if last:
            yield pa.RecordBatch.from_pylist([last | {"edge": before}], schema)

    return arrow_map(rows, run, "block int, k long, lcp long, sizes array<long>, least long, n long, ends string, edge array<binary>")


def _borders(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """For each block its LCPs at its left and right border, -1 at the ends of the array."""
    edge = rows.filter("edge is not null").select("block", "k", "edge")
    blocks = [r["block"] for r in edge.select("block").distinct().orderBy("block").collect()]  # integers
    if len(blocks) < 2:
        return {b: (-1, -1) for b in blocks}
    following = rows.sparkSession.createDataFrame(list(zip(blocks, blocks[1:])), "b int, c int")
    last = edge.groupBy("block").agg(F.max_by("edge", "k").alias("x"))
    first = edge.filter("k = 0").select(F.col("block").alias("c"), F.col("edge").alias("y"))
    same = F.zip_with("x", "y", lambda a, b: a.eqNullSafe(b))
    met = last.join(following, F.col("block") == F.col("b")).join(first, "c").select("b", "c", (F.array_position(same, False) - 1).alias("lcp")).collect()
    left, right = {r["c"]: r["lcp"] for r in met}, {r["b"]: r["lcp"] for r in met}
    return {b: (left.get(b, -1), right.get(b, -1)) for b in blocks}


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the nearest smaller value before and after each; -1 and len(values) where there is none."""
    n, values = len(values), values.tolist()
    before, after, open_ = [-1] * n, [n] * n, []
    for k, v in enumerate(values):
        while open_ and values[open_[-1]] > v:
            after[open_.pop()] = k
        if open_:
            before[k] = before[open_[-1]] if values[open_[-1]] == v else open_[-1]
        open_.append(k)
    return np.array(before), np.array(after)


def next_below(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each k the first place after k with a value below ``bounds[k]``, which is above ``values[k]``; len(values) if there is none."""
    out, open_ = np.full(len(bounds), len(values)), []
    for k, v in enumerate(values.tolist()):
        while open_ and v < bounds[open_[-1]]:
            out[open_.pop()] = k
        if k < len(bounds):
            open_.append(k)
    return out


class Minima:
    """Least value of any range: minima over powers of two."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while 2 * (step := 1 << len(self.rows) - 1) <= len(x):
            self.rows.append(np.minimum(self.rows[-1][:-step], self.rows[-1][step:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.empty(len(lo), np.int64)
        level = np.frompyfunc(lambda x: int(x).bit_length() - 1, 1, 1)(hi - lo).astype(int)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.rows[k][lo[at]], self.rows[k][hi[at] - (1 << k)])
        return out


def prefix_hashes(names: np.ndarray, upto: int) -> list[str]:
    """Hashes of the first 0, 1, ... ``upto`` names."""
    it, out = hashlib.sha256(), [hashlib.sha256().hexdigest()]
    for x in names[: max(upto, 0)]:
        it.update(x)
        out.append(it.hexdigest())
    return out


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "bytes", "ends", "key", "parent_key"]
NODE_SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, bytes long, ends string, key string, parent_key string"


def block_nodes(rows: pd.DataFrame, left: int, right: int) -> pd.DataFrame:
    """The nodes of one block's sorted rows: those inside it, and with a key its part of those that go on beyond a border.

    saved: bytes of all members' turns from the node's own on; bytes: those of the distinct ones that begin in the block.
    """
    m = len(rows)
    sizes = [np.asarray(s, np.int64) for s in rows["sizes"]]
    length = np.array([len(s) for s in sizes])
    lcp = np.r_[left, rows["lcp"].to_numpy()[1:], right]
    before, after = nearest_smaller(lcp)
    # explicit nodes: branches at an LCP, those of one interval once, and ends of sequences
    k = np.flatnonzero((before[:m] >= 0) & (after[:m] <= m))
    stop = next_below(lcp, length)
    e = np.flatnonzero(stop <= m)
    nodes = np.unique(np.concatenate([np.stack([before[k], after[k], lcp[k]], 1), np.stack([e, stop[e], length[e]], 1)]), axis=0).astype(np.int64)
    # the depths between a node and its parent have the same interval
    top = np.maximum(lcp[nodes[:, 0]], lcp[nodes[:, 1]])
    times = nodes[:, 2] - top
    lo, hi, own, up = (np.repeat(x, times) for x in (*nodes.T, top))
    depth = up + 1 + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    chain = depth - 1 > up
    above_lo, above_hi = np.where(chain | (lcp[lo] < up), lo, before[lo]), np.where(chain | (lcp[hi] < up), hi, after[hi])
    inside = (above_lo >= 0) & (above_hi <= m)
    # the depths that a border's LCP carries into the next block: one interval each, up to the first or from the last smaller LCP
    first, last = prefix_hashes(rows["edge"].iloc[0], left), prefix_hashes(rows["edge"].iloc[-1], right)
    high = lambda x, d: np.searchsorted(-np.minimum.accumulate(x), -d, "right") if len(x) else np.zeros(len(d), int)
    d_left, d_right = np.arange(left + 1), np.arange(right + 1)
    to, begin = 1 + high(lcp[1:m], d_left), m - 1 - high(lcp[1:m][::-1], d_right)
    once = (begin > 0) | (d_right > left)  # else it spans the block and has been counted from the left
    d_right, begin = d_right[once], begin[once]
    L, R, T = np.r_[lo, np.zeros(left + 1, int), begin], np.r_[hi, to, np.full(len(begin), m)], np.r_[depth, d_left, d_right]
    D = np.r_[own, d_left, d_right]

    n, sums = rows["n"].to_numpy(), lambda x: np.r_[0, np.cumsum(x)]
    upto = np.concatenate([np.r_[0, np.cumsum(s)] for s in sizes])  # bytes of the first 0, 1, ... turns of each row
    at = np.cumsum(length + 1) - length - 1
    total = upto[at + length]
    count, leaves, weight, new = sums(n), sums(length > lcp[1:]), sums(n * total), sums(total - upto[at + np.maximum(lcp[:m], 0)])
    minima = Minima(rows["least"].to_numpy())
    members = count[R] - count[L]
    saved = weight[R] - weight[L] - members * upto[at[L] + np.maximum(T - 1, 0)]
    distinct = new[R] - new[L + 1] + total[L] - upto[at[L] + np.maximum(np.maximum(T - 1, lcp[L]), 0)]
    # children: one in a chain, else those that begin in the interval at the node's depth
    begun = np.zeros(len(T), np.int64)
    order = np.lexsort((np.arange(m), lcp[:m]))
    ranks = lcp[:m][order] * (m + 1) + order
    begun = np.searchsorted(ranks, T * (m + 1) + R) - np.searchsorted(ranks, T * (m + 1) + L + 1)
    children = np.where(T < D, 1, begun + ((length[L] > T) & (lcp[L] <= T)))
    parent = np.zeros(len(T), np.int64)
    parent[np.flatnonzero(inside)] = minima(above_lo[inside], above_hi[inside])
    key = lambda hashes, d: None if d < 0 else f"{d}:{hashes[d]}"
    borders = [(first, d) for d in d_left.tolist()] + [(last, d) for d in d_right.tolist()]
    ups = [None if i else key(first if a < 0 else last, d - 1) for i, a, d in zip(inside, above_lo.tolist(), depth.tolist())]
    out = {
        "conv_id": minima(L, R), "depth": T, "parent_conv_id": pd.array(parent, "Int64"), "n_convs": members, "n_children": children, "n_leaves": leaves[R] - leaves[L], "saved": saved, "bytes": distinct,
        "ends": np.where(length[L] == T, rows["ends"].to_numpy()[L], None), "key": [None] * len(depth) + [key(*x) for x in borders], "parent_key": ups + [key(h, d - 1) for h, d in borders],
    }
    out = pd.DataFrame(out)
    out.loc[~np.r_[inside, np.zeros(len(borders), bool)], "parent_conv_id"] = pd.NA
    return out[NODE]


def trie(seqs: DataFrame) -> DataFrame:
    """The nodes of (conv, seq)."""
    spark = seqs.sparkSession
    seqs = materialise(seqs.withColumn("name", F.md5(F.array_join(F.transform("seq", lambda t: F.hex(t["name"])), "").cast("binary"))), "sequences")
    groups = materialise(seqs.groupBy("name").agg(F.min("conv").alias("least"), F.count(F.lit(1)).alias("n")), "groups")
    of = groups.withColumnRenamed("name", "g")
    # of groups of several the ids are hashed in order; one alone is its own list
    several = seqs.join(of.filter("n > 1"), F.col("name") == F.col("g")).select(F.col("least").alias("of"), "conv")
    digests = _digests(several).withColumnRenamed("ends", "many")
    rows = seqs.join(of, (F.col("conv") == F.col("least")) & (F.col("name") == F.col("g"))).join(digests, F.col("least") == F.col("of"), "left")
    rows = rows.select("seq", "least", "n", F.coalesce("many", F.sha2(F.col("least").cast("string").cast("binary"), 256)).alias("ends"))
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-groups.count() // BLOCK))
    ordered = materialise(_sorted(rows, blocks), "ordered")
    borders = _borders(ordered)

    def nodes(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("k", ignore_index=True)
        return block_nodes(block, *borders[int(block["block"].iloc[0])])

    made = materialise(ordered.groupBy("block").applyInPandas(nodes, NODE_SCHEMA), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved", "bytes")]
    beyond = made.filter("key is not null").groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *sums, F.max("ends").alias("ends"), F.max("parent_key").alias("parent_key"))
    beyond = materialise(beyond, "beyond")
    inside = made.filter("key is null")
    top = beyond.select(F.col("key").alias("k"), F.col("conv_id").alias("p"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "bytes", "ends", "parent_key"]
    rest = beyond.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns)
    # only children of nodes beyond a border look for their parent; the others have it
    asked = inside.filter("parent_key is not null").select(*columns).unionByName(rest).join(top, F.col("parent_key") == F.col("k"), "left").withColumn("parent_conv_id", F.col("p"))
    out = inside.filter("parent_key is null").select(*columns).unionByName(asked.select(*columns))
    for x in (made, beyond):
        hold(x)
    discard(seqs, groups, ordered)
    saved = F.col("saved") - F.col("bytes")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns."""
    return trie(rebuilt(materialise(numbered(turns, conv_col, turn_col, role_col, text_col), "turns")))
