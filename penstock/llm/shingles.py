"""Groups of texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more: SimHash and a join of the sets.

Fingerprints of similar texts often differ by more than a covering code can bridge (a tenth of 64 bits at 0.8), so
SimHash links are candidates, and what they miss comes from a join. The shingles of a set are ordered, those that a
sample finds often last, else by hash; two sets that are similar enough share one among the first fifth (plus one) of
each, and all of that part is joined, so no link between them is missed.

In each bucket of sets that share such a shingle, all meet LEADS of them; of its leads each set keeps 2 * TOP by the
buckets that they share and TOP of these by their bitmaps, and is compared with those. The first round takes a set's
first FIRST shingles, which find most links. Of all buckets, those whose sets still belong to several groups then go
through further rounds, with new leads out of different groups, as long as a round finds links, ROUNDS of them at
most. The sets of different groups that are left in one bucket are compared each with each, a pair in
the first bucket that it shares. Compared means by the whole sets. Shingles and sets are named by 64-bit hashes.

Defined cases: words are split and lower-cased as for SimHash; a text of fewer than 5 words is one shingle; texts
without a word are one set; rows of one id are one group; rows with a null id are compared like any other, each for
itself, and link what is near to them, but none of them is the least of a group: they go if a row of their group has an
id, and a group of null ids alone stays whole; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, arrow_map, discard, free_shuffles, hold, materialise
from .graph import components
from .simhash import LOWER, links, majority
from .substrings import joint, names_of

#: Words of a shingle; similarity as a fraction.
SHINGLE, ABOVE, BELOW = 5, 4, 5
#: One text of so many is sampled for frequent shingles, seen so often in the sample, and so many of them are known.
SAMPLE, OFTEN, MOST = 16, 3, 100_000
#: Bits of a set's bitmap; shingles of a set in the first round; leads of a bucket; leads that a set is compared with.
BITS, FIRST, LEADS, TOP = 1024, 24, 16, 3
#: Rounds against leads.
ROUNDS = 4


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the shingles of a text, ascending: hashes of the words' hashes."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    names = names_of(words)
    count = max(1, len(names) - n + 1)
    out = np.full(count, np.uint64(min(n, len(names))))
    for k in range(min(n, len(names))):
        out = joint(out, names[k : k + count])
    return np.unique(out)


def _among(s: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``s`` are in the ascending ``known``."""
    return known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s if len(known) else np.zeros(len(s), bool)


def _frequent(df: DataFrame) -> np.ndarray:
    """Hashes of shingles that many of the sampled texts have, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [np.zeros(0, np.uint64)], 0
            for k, value in enumerate(batch.column(0)):
                held.append(shingle_set(value.as_py()))
                size += 8 * len(held[-1])
                if size > BATCH_BYTES or k + 1 == batch.num_rows:
                    keys, n = np.unique(np.concatenate(held), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])
                    held, size = [np.zeros(0, np.uint64)], 0

    rows = df.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    often = arrow_map(rows, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    return np.sort(often.orderBy(F.desc("n"), "key").limit(MOST).select("key").toArrow()["key"].to_numpy().view(np.uint64))


def _bitmap(s: np.ndarray) -> np.ndarray:
    """Which of BITS classes of hashes have an odd number of the set's shingles: two sets differ in at least the bits that their bitmaps differ in."""
    odd = np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(df: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(key, row, node, n, first, bits, fp) of (key, row, text): the set's name, size, ordered first fifth, bitmap and SimHash fingerprint."""

    def lists(parts: list[np.ndarray]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(np.concatenate(parts).view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names, counts, firsts, bits, fps = [], [], [], [], []
            for value in batch.column(2):
                s = shingle_set(value.as_py())
                late = _among(s, frequent)
                names.append(xxhash.xxh64_intdigest(s.tobytes()))
                counts.append(len(s))
                firsts.append(np.concatenate([s[~late], s[late]])[: len(s) * (BELOW - ABOVE) // BELOW + 1])
                bits.append(_bitmap(s))
                fps.append(majority(s))
            names = pa.array(np.array(names, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names, pa.array(counts, pa.int32()), lists(firsts), lists(bits), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["key", "row", "node", "n", "first", "bits", "fp"])

    kind = df.schema["key"].dataType.simpleString()
    return arrow_map(df.select("key", "row", "text"), run, f"key {kind}, row long, node long, n int, first array<long>, bits array<long>, fp long")


def _whole(rows: DataFrame) -> DataFrame:
    """(node, s) of (node, text): the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, size, sets = 0, 0, []
            for k, value in enumerate(batch.column(1)):
                sets.append(shingle_set(value.as_py()).view(np.int64))
                size += 8 * len(sets[-1])
                if size > BATCH_BYTES or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(sets)), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])
                    begin, size, sets = k + 1, 0, []

    return arrow_map(rows, run, "node long, s array<long>")


def _may(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sets of n and m shingles whose first common one has places i and j can be similar enough."""
    return (ABOVE + BELOW) * F.least(n - i, m - j) >= ABOVE * (n + m)


def _differ(a: Column, b: Column) -> Column:
    """Bits that two bitmaps differ in."""
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(BITS // 64)), F.lit(0))


def _near_enough(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b, differ): those of the pairs that their bitmaps do not rule out; differ: the share of the bits' lower bound."""
    side = lambda x: distinct.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    met = pairs.distinct().join(side("a"), "a").join(side("b"), "b").withColumn("bound", _differ(F.col("bitsa"), F.col("bitsb")))
    met = met.filter((ABOVE + BELOW) * F.col("bound") <= (BELOW - ABOVE) * (F.col("na") + F.col("nb")))
    return met.select("a", "b", (F.col("bound") / (F.col("na") + F.col("nb"))).alias("differ"))


def _verified(pairs: DataFrame, sets: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough by their whole sets."""
    pairs = materialise(pairs.select("a", "b").distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("w")).unionByName(pairs.select(F.col("b").alias("w"))).distinct()
    # one row of each set gives it again
    one = sets.select("key", "row", "node").join(wanted, F.col("node") == F.col("w")).groupBy("node").agg(F.min(F.struct("key", "row")).alias("x"))
    one = materialise(one.select("node", F.col("x.key").alias("k"), F.col("x.row").alias("r")), "one")
    # sort-merge at every size: both sides grow with the corpus
    held = rows.join(one.hint("merge"), F.col("key").eqNullSafe(F.col("k")) & (F.col("row") == F.col("r"))).select("node", "text")
    whole = materialise(_whole(held), "held")
    held = whole.dropDuplicates(["node"])
    both = pairs.join(held.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").join(held.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    common, total = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    out = materialise(both.filter((ABOVE + BELOW) * common >= ABOVE * total).select("a", "b"), "similar")
    discard(whole, one, pairs)
    free_shuffles(rows.sparkSession)
    return out


def _near(distinct: DataFrame) -> DataFrame:
    """(a, b): sets to be compared because SimHash links their fingerprints; each fingerprint stands for its smallest set."""
    least = materialise(distinct.groupBy("fp").agg(F.min("node").alias("of")), "fingerprints")
    same = distinct.join(least.withColumnRenamed("fp", "f"), F.col("fp") == F.col("f")).filter("node > of").select(F.col("of").alias("a"), F.col("node").alias("b"))
    side = lambda x: least.select(F.col("fp").alias(f"f{x}"), F.col("of").alias(x))
    linked = links(least.select("fp")).distinct().withColumnsRenamed({"a": "x", "b": "y"})
    linked = linked.join(side("a"), F.col("x") == F.col("fa")).join(side("b"), F.col("y") == F.col("fb"))
    return same.unionByName(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def similar(firsts: DataFrame, sets: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): links of the sets of ``rows`` (key, row, text) whose components are those of all similar pairs.

    ``firsts`` (node, n, first, bits, fp), a written table of the distinct sets, and each table made here are deleted as
    soon as they are read for the last time: together they would grow with the rounds.
    """
    flat = firsts.select("node", "n", F.posexplode("first").alias("i", "shingle"))
    shared = flat.groupBy("shingle").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    shared = materialise(shared.select(F.col("shingle").alias("s")), "shared")
    # sort-merge at every size here and below: both sides grow with the corpus, and Spark takes exploded rows for a table as small as theirs
    met = materialise(flat.join(shared.hint("merge"), F.col("shingle") == F.col("s")).select("s", "node", "n", "i", F.col("node").alias("root")), "met")
    # what follows reads no more than FIRST shingles of a set besides ``met``
    distinct = materialise(firsts.withColumn("first", F.slice("first", 1, FIRST)), "distinct")
    discard(firsts, shared)
    free_shuffles(rows.sparkSession)
    led, leads = _led(met.filter(F.col("i") < FIRST), distinct, 0)
    led = led.unionByName(_near_enough(_near(distinct), distinct).select("a", "b"))
    found = _verified(led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), sets, rows)
    discard(leads)
    left, more = met, None
    for k in range(1, ROUNDS + 1):
        roots = materialise(components(found).withColumnRenamed("node", "of"), "roots")
        rest = materialise(left.drop("root").join(roots, F.col("node") == F.col("of"), "left").select("s", "node", "n", "i", F.coalesce("root", "node").alias("root")), "rest")
        mixed = materialise(rest.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select(F.col("s").alias("m")), "mixed")
        discard(left)
        left = materialise(rest.join(mixed, F.col("s") == F.col("m")).drop("m"), "left")
        discard(rest, mixed, roots)
        if k == ROUNDS or (more is not None and more.isEmpty()) or left.isEmpty():
            break
        led, leads = _led(left, distinct, k)
        more = _verified(led, sets, rows)
        discard(leads)
        found = materialise(found.unionByName(more), "found")
    # each with each, if its bitmaps do not rule it out: a pair where its lists first meet, or, if not within FIRST, in each bucket
    whole = left.join(distinct.select(F.col("node").alias("of"), "first", "bits"), F.col("node") == F.col("of")).drop("of")
    other = whole.select(F.col("s").alias("t"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("root").alias("rb"), F.col("first").alias("fb"), F.col("bits").alias("bb"))
    may = (F.col("node") < F.col("b")) & (F.col("root") != F.col("rb")) & _may(F.col("n"), F.col("i"), F.col("nb"), F.col("ib"))
    may = may & ((ABOVE + BELOW) * _differ(F.col("bits"), F.col("bb")) <= (BELOW - ABOVE) * (F.col("n") + F.col("nb"))) & (F.coalesce(F.get(F.array_intersect("first", "fb"), F.lit(0)), F.col("s")) == F.col("s"))
    pairs = whole.join(other.hint("merge"), (F.col("s") == F.col("t")) & may).select(F.col("node").alias("a"), "b")
    out = found.unionByName(_verified(pairs, sets, rows))
    discard(distinct, left)
    free_shuffles(rows.sparkSession)
    return out


def _led(met: DataFrame, distinct: DataFrame, round_: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): each set with the leads of its buckets that it is to be compared with; leads belong to other groups than it does. And the table of leads that it reads."""
    order = F.xxhash64("node", F.lit(round_))
    leads = met.groupBy("s", F.pmod(F.xxhash64("root", F.lit(round_)), F.lit(LEADS)).alias("class")).agg(F.min_by(F.struct("node", "n", "i", "root"), order).alias("x"))
    leads = materialise(leads.select(F.col("s").alias("t"), F.col("x.node").alias("lead"), F.col("x.n").alias("m"), F.col("x.i").alias("j"), F.col("x.root").alias("r")), "leads")
    led = met.join(leads.hint("merge"), (F.col("s") == F.col("t")) & (F.col("node") != F.col("lead")) & (F.col("root") != F.col("r")) & _may(F.col("n"), F.col("i"), F.col("m"), F.col("j")))
    # a set has as many leads as its buckets have: a list in proportion to its text
    led = led.groupBy("node", "lead").agg(F.count(F.lit(1)).alias("shared")).groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("shared")).alias("k"), "lead"))), 1, 2 * TOP).alias("x"))
    led = _near_enough(led.select(F.explode("x.lead").alias("a"), F.col("node").alias("b")), distinct)
    best = led.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("differ", "a"))), 1, TOP).alias("x")).select("b", F.explode("x.a").alias("a"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), leads


def spare(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row: Column) -> DataFrame:
    """(id, row, twin) of the rows that are not to be kept: all of a group but the one of the least (id, row); none if all ids of the group are null.

    ``row`` is a hash of a row's columns. With ``twin``, the row to be kept is there more than once.
    """
    rows = df.select(F.col(id_col).alias("key"), row.alias("row"), F.col(text_col).alias("text"))
    made = materialise(_sets(rows, _frequent(rows)), "made")
    sets = materialise(made.select("key", "row", "node"), "sets")
    firsts = materialise(made.groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("first").alias("first"), F.any_value("bits").alias("bits"), F.any_value("fp").alias("fp")), "firsts")
    discard(made)
    # rows of one id are one group
    several = materialise(sets.filter("key is not null").groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select(F.col("key").alias("id"), "lo"), "several")
    same = sets.join(several, F.col("key") == F.col("id")).filter("node > lo").select(F.col("lo").alias("a"), F.col("node").alias("b"))
    roots = materialise(components(similar(firsts, sets, rows).unionByName(same)).withColumnRenamed("node", "of"), "roots")
    named = sets.join(roots, F.col("node") == F.col("of"), "left").select("key", "row", F.coalesce("root", "node").alias("root"))
    counts = materialise(named.groupBy("root", "key", "row").agg(F.count(F.lit(1)).alias("n")), "counts")
    least = materialise(counts.filter("key is not null").groupBy("root").agg(F.min(F.struct("key", "row")).alias("least")).withColumnRenamed("root", "r"), "least")
    met = counts.join(least, F.col("root") == F.col("r"))
    stays = F.col("key").eqNullSafe(F.col("least.key")) & (F.col("row") == F.col("least.row"))
    out = hold(materialise(met.filter(~stays | (F.col("n") > 1)).select(F.col("key").alias("__id"), F.col("row").alias("__row"), stays.alias("__twin")), "spare"))
    discard(sets, counts, least)
    free_shuffles(df.sparkSession)
    return out
