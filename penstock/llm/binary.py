"""Token ids as raw shards with a minimal perfect hash index.

A shard is a file of little-endian ids, 2 bytes each where the vocabulary allows and else 4, documents in key order.
The index is cut into parts by a hash of the document's name: its key and a hash of its text. A part has a
displacement for each bucket of names that sends its n names to n slots without a collision; a slot holds the name's
fingerprint, shard, first byte and ids. A lookup reads one displacement and one slot; an unknown name is recognised by
its fingerprint.

Defined cases: null and empty texts are a document of the end id alone; null keys stand first and are addressed like
any key; rows of one key are told apart by their texts; rows of equal key and text are written each, and the index
gives the first of them for all; an empty table has no shards; other columns are not carried.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import codec
from .common import arrow_map, discard, fresh_folder, materialise, open_fs

#: Documents of an index part, keys of a displacement bucket, bytes read at a time from a shard, displacements tried.
PART, BUCKET, READ, TRIES = 50_000, 4, 8 << 20, 1 << 20
SLOT = np.dtype([("mark", "<u8"), ("shard", "<i4"), ("offset", "<i8"), ("n", "<i8")])


def _hashes(names: list[str], seed: int) -> tuple[np.ndarray, np.ndarray]:
    data = [n.encode("utf-8", "surrogatepass") for n in names]
    return tuple(np.array([xxhash.xxh64_intdigest(x, 2 * seed + k) for x in data], np.uint64) for k in (0, 1))


def _slot(h: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    x = (h ^ (displacement * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(32))) % np.uint64(n)


def perfect_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(displacements, slot of each hash) of 64-bit hashes, largest buckets first; None if two are equal or TRIES don't do."""
    n = len(h)
    count = max(1, n // BUCKET)
    bucket = ((h >> np.uint64(33)) % np.uint64(count)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=count))
    taken, out, shift = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(count, np.uint32)
    sizes = np.diff(np.concatenate([[0], ends]))
    for b in np.argsort(-sizes, kind="stable"):
        rows = order[ends[b] - sizes[b] : ends[b]]
        if not len(rows):
            break
        base = 0
        while True:  # a block of displacements at a time
            if base > TRIES:
                return None
            tries = np.arange(base, base + 64, dtype=np.uint64)
            slots = _slot(h[rows][None, :], tries[:, None], n).astype(np.int64)
            free = ~taken[slots].any(axis=1)
            if len(rows) > 1:
                ordered = np.sort(slots, axis=1)
                free &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if free.any():
                k = int(free.argmax())
                shift[b], out[rows] = base + k, slots[k]
                taken[slots[k]] = True
                break
            base += 64
    return shift, out


class IndexPart:
    """One part of the index, as read from its file."""

    def __init__(self, data: bytes):
        n, count, self.seed = (int(x) for x in np.frombuffer(data, "<i8", 3))
        self.shift = np.frombuffer(data, "<u4", count, 24)
        self.slots = np.frombuffer(data, SLOT, n, 24 + 4 * count)

    def find(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(slots, whether the part has the name) of the names."""
        if not len(self.slots):
            return np.zeros(len(names), SLOT), np.zeros(len(names), bool)
        h, mark = _hashes(names, self.seed)
        shift = self.shift[((h >> np.uint64(33)) % np.uint64(len(self.shift))).astype(np.int64)].astype(np.uint64)
        found = self.slots[_slot(h, shift, len(self.slots)).astype(np.int64)]
        return found, found["mark"] == mark


def index_bytes(names: list[str], shard: np.ndarray, offset: np.ndarray, n: np.ndarray) -> bytes:
    """A part of distinct names; hashes of another seed where those of one cannot be told apart."""
    seed = 0
    while True:
        h, mark = _hashes(names, seed)
        if made := perfect_hash(h):
            break
        seed += 1
    shift, slot = made
    slots = np.zeros(len(names), SLOT)
    slots["mark"][slot], slots["shard"][slot], slots["offset"][slot], slots["n"][slot] = mark, shard, offset, n
    return np.array([len(names), len(shift), seed], "<i8").tobytes() + shift.astype("<u4").tobytes() + slots.tobytes()


def name_of(key: Column, text: Column) -> Column:
    """A document as the index addresses it; a null key is a name that no other key has."""
    return F.concat_ws("#", F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null")), F.hex(F.xxhash64(F.coalesce(text, F.lit("")))))


@dataclass
class Index:
    """parts: how many; files: (part, index_path); shards: (shard, path, start)."""

    parts: int
    files: DataFrame
    shards: DataFrame
    width: int


def write_shards(df: DataFrame, vocabulary: str, pattern: str, *, end_id: int = 0, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write ``df``: (key, name, path, offset, n) of the documents, in a written table.

    Texts, not ids, are dealt by ranges of the key. A task's file has a name of its own, so a task that runs twice
    leaves a file that no row names.
    """
    folder = fresh_folder(df.sparkSession, "ids")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it, out, offset = codec(vocabulary, pattern), None, 0
        if len(it.bytes_of) > 1 << 8 * width:
            raise ValueError("ids need a width of 4")
        same, end = it.kind.itemsize == width, np.array([end_id], f"<u{width}").tobytes()
        fs, base = open_fs(folder)
        path = f"{base}/{uuid.uuid4().hex}.ids"
        try:
            for batch in batches:
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(path)
                begins, counts = [], []
                for packed in it.encode(batch.column(2).to_pylist()):
                    data = (packed if same else it.ids(packed).astype(f"<u{width}").tobytes()) + end
                    out.write(data)
                    begins.append(offset)
                    counts.append(len(data) // width)
                    offset += len(data)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([path] * len(begins), pa.string()), pa.array(begins, pa.int64()), pa.array(counts, pa.int64())], names=["key", "name", "path", "offset", "n"])
        finally:
            if out is not None:
                out.close()

    rows = df.select(F.col(id_col).alias("key"), name_of(F.col(id_col), F.col(text_col)).alias("name"), F.col(text_col).alias("text"))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = F.col("key").asc_nulls_first(), F.col("name").asc()
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialise(arrow_map(dealt, run, f"key {kind}, name string, path string, offset long, n long"), "written")


def write_index(written: DataFrame, *, width: int = 2) -> Index:
    """The index of written documents. One row per shard reaches the driver."""
    spark = written.sparkSession
    shards = written.groupBy("path").agg(F.sum("n").alias("total"), F.min(F.struct(F.col("key").isNotNull().alias("a"), F.col("key").alias("b"), F.col("name").alias("c"))).alias("least"))
    rows, start = [], 0
    for k, r in enumerate(shards.orderBy("least").select("path", "total").collect()):
        rows.append((k, r["path"], start))
        start += r["total"]
    table = materialise(spark.createDataFrame(rows, "shard int, path string, start long"), "shards")
    # rows of one name have the same ids: the first stands for all
    one = written.join(table, "path").groupBy("name").agg(F.min(F.struct("shard", "offset", "n")).alias("x"))
    one = materialise(one.select("name", "x.shard", "x.offset", "x.n"), "one")
    parts, folder = max(1, -(-one.count() // PART)), fresh_folder(spark, "index")

    def build(got: pa.Table) -> pa.Table:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        path = f"{base}/{uuid.uuid4().hex}.idx"
        with fs.open_output_stream(path) as out:
            out.write(index_bytes(got["name"].to_pylist(), *(got[c].to_numpy() for c in ("shard", "offset", "n"))))
        return pa.table({"part": got["part"].slice(0, 1), "index_path": pa.array([path])})

    files = materialise(one.withColumn("part", part_of("name", parts)).groupBy("part").applyInArrow(build, "part int, index_path string"), "index-parts")
    discard(one)
    return Index(parts, files, table, width)


def part_of(name: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")


def read_back(keys: DataFrame, index: Index, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each row, by keyed access: part, slot, fingerprint, then the shard's bytes.

    Distinct names meet their part, then narrow (shard, offset) rows are dealt by place; each is read once, and rows
    of one name share the result. A name that the index doesn't have is an error. ``start`` counts the ids before the
    document: those of earlier shards and those before it in its own.
    """
    width = index.width
    named = keys.select(F.col(id_col), name_of(F.col(id_col), F.col(text_col)).alias("__name"))
    named = materialise(named, "names-of")
    wanted = named.select(F.col("__name").alias("name")).distinct().withColumn("part", part_of("name", index.parts))

    def look(got: pa.Table) -> pa.Table:
        path = got["index_path"][0].as_py()
        if path is None:
            raise KeyError(f"the index has no part for {got['name'][0].as_py()!r}")
        fs, path = open_fs(path)
        with fs.open_input_stream(path) as f:
            part = IndexPart(f.read())
        slots, there = part.find(got["name"].to_pylist())
        if not there.all():
            raise KeyError(f"the index does not have {got['name'][int(np.flatnonzero(~there)[0])].as_py()!r}")
        return pa.table({"name": got["name"], **{c: pa.array(slots[c]) for c in ("shard", "offset", "n")}})

    at = wanted.join(index.files, "part", "left").groupBy("part").applyInArrow(look, "name string, shard int, offset long, n long")
    placed = at.join(index.shards, "shard").repartition("path", F.floor(F.col("offset") / READ)).sortWithinPartitions("path", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, f = None, None
        for batch in batches:
            crcs, starts = [], []
            for path, offset, n, start in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4))):
                if path != opened:
                    fs, name = open_fs(path)
                    opened, f = path, fs.open_input_file(name)
                crc, left, place = 0, n * width, offset
                while left:
                    data = f.read_at(min(left, READ), place)
                    if not data:
                        raise EOFError(f"{path} ends before byte {place + left}")
                    crc = zlib.crc32(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes(), crc)
                    left, place = left - len(data), place + len(data)
                crcs.append(crc)
                starts.append(start + offset // width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.int64()), batch.column(3), pa.array(crcs, pa.int64())], names=["name", "start", "n_tokens", "ids_crc32"])

    found = arrow_map(placed.select("name", "path", "offset", "n", "start"), read, "name string, start long, n_tokens long, ids_crc32 long")
    found = materialise(found, "found")
    return named.join(found, F.col("__name") == F.col("name")).select(id_col, "start", "n_tokens", "ids_crc32")
