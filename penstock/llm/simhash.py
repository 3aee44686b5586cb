"""SimHash near-duplicates by anchor points of a covering code.

A 64-bit fingerprint has two halves of 32 bits. Two fingerprints that differ in at most 3 bits differ in at most
one bit in one of the halves. The anchors of a half are the codewords of the perfect Hamming code of 31 bits (the
spare bit is left out): every point lies within one bit of exactly one anchor (covering radius 1). A fingerprint is
at home at that anchor and is replicated to every anchor within radius plus threshold (1 + 1), 16 at most; pairs
are compared at each anchor. So no link is missed, and a replica count is a constant.

Defined cases: null and empty texts and texts without a word have fingerprint zero and are linked like any other;
equal fingerprints are one node, so groups of copies cost one row; repeated ids share a row's component; an empty
table gives an empty table; only id and text are carried, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialise
from .graph import components

#: Bits that may differ, words of a shingle, seed of the hash.
THRESHOLD, SHINGLE, SEED = 3, 3, 42
#: Shingles hashed and counted at a time: a bound on memory for very long texts.
BLOCK = 1 << 16
#: ASCII capitals to small letters, as bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return 0
    total, ones = max(1, len(words) - n + 1), np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for begin in range(0, total, BLOCK):
        part = words[begin : begin + BLOCK + n - 1] if len(words) >= n else words
        grams = map(b" ".join, zip(*(part[k:] for k in range(n)))) if len(words) >= n else [b" ".join(words)]
        hashes = np.array([digest(g, SEED) for g in grams], np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[begin : begin + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every whole text: one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["key", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")), run, f"key {kind}, fp long").withColumnRenamed("key", id_col)


def _syndrome(half: Column) -> Column:
    """Of the bits 1 to 31 of a half, the exclusive or of the places that are set: 0 at a codeword."""
    out = F.lit(0)
    for j in range(5):
        mask = sum(1 << p for p in range(1, 32) if p >> j & 1)
        out = out + F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(mask))) % 2, j)
    return out


def _flip(point: Column, place: Column) -> Column:
    """The point with bit ``place`` (1 to 31) turned; place 0 turns nothing."""
    return point.bitwiseXOR(F.when(place > 0, F.call_function("shiftleft", F.lit(1).cast("long"), place)).otherwise(F.lit(0).cast("long")))


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) with a < b: all pairs of the distinct fingerprints ``fps`` (fp) at ``threshold`` or fewer differing bits, each four times at most."""
    if not 0 <= threshold <= 3:
        raise ValueError("two halves cover 3 differing bits at most")
    halves = F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))
    parts = fps.select("fp", F.posexplode(halves).alias("half", "bits"))
    parts = parts.select("fp", "half", F.col("bits").bitwiseAND(F.lit(0xFFFFFFFE)).alias("point")).withColumn("s", _syndrome(F.col("point")))
    home = parts.select("half", "fp", _flip(F.col("point"), F.col("s")).alias("anchor"))
    # anchors within two bits: the home, and with s = i xor j the point with i and j turned; with s = 0 the home alone
    place = F.explode(F.sequence(F.lit(0), F.lit(31)))
    near = parts.select("half", "fp", "point", "s", place.alias("i"))
    other = F.col("s").bitwiseXOR(F.col("i"))
    near = near.filter(((F.col("s") == 0) & (F.col("i") == 0)) | ((F.col("s") != 0) & (F.col("i") < other)))
    near = near.select(F.col("half").alias("h2"), F.col("fp").alias("b"), _flip(_flip(F.col("point"), F.col("i")), other).alias("at"))
    close = (F.col("fp") != F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= threshold)
    # sort-merge at every size: Spark takes the exploded replicas, 16 a half, for a table as small as fps and would broadcast them
    found = home.join(near.hint("merge"), (F.col("half") == F.col("h2")) & (F.col("anchor") == F.col("at")) & close)
    return found.select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b"))


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(id, fingerprint: 16 hexadecimal digits, component_id: smallest id reachable over links)."""
    made = materialise(fingerprints(df, id_col=id_col, text_col=text_col), "fingerprints")
    nodes = materialise(made.groupBy("fp").agg(F.min(id_col).alias("least_id")), "nodes")
    roots = components(links(nodes.select("fp"), threshold))
    # fingerprints meet ids here: the smallest id of a component over all its fingerprints
    named = materialise(nodes.join(roots, nodes["fp"] == roots["node"], "left").select(nodes["fp"], "least_id", F.coalesce("root", nodes["fp"]).alias("root")), "named")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = materialise(named.join(least, "root").select(F.col("fp").alias("__fp"), "component_id"), "components")
    out = made.join(of, made["fp"] == of["__fp"])
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
