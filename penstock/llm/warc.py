"""WARC archives: a writer over Arrow batches and a PySpark Python data source that reads them.

The reader plans one partition per archive file and takes equality, membership and prefix predicates on the record
type and the other header fields. Each record is a gzip member of its own, whose header says in an extra field (sl)
how long the member is: a record's headers are inflated first, and of a record that isn't wanted nothing else is read
or inflated. The option payload=false leaves all payloads undecoded. Members without the field, as other tools write
them, are inflated to find their end.

Defined cases: null html is an empty payload; null ids and urls are headers left out; equal payloads under the
least size stand alone; repeated ids are separate records; an empty table writes no file; other columns are not
carried; an archive that ends within a record is an error.
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

from .common import arrow_map, fresh_folder, materialise, open_fs

#: Least bytes of a payload that later copies revisit; bytes of an archive file after which another is begun.
LEAST_REVISIT, FILE_BYTES = 1000, 128 << 20
#: Bytes read at a time from an archive, and inflated at a time until the headers are there.
READ, HEAD = 1 << 20, 512
SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
FIELDS = ("record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes")


def record(kind: str, page: str | None, uri: str | None, digest: str, size: int, refers: str | None, payload: bytes) -> bytes:
    """One WARC 1.1 record as a gzip member; a revisit has no payload but its full size in a header."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>" if page is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"WARC-Payload-Length: {size}"]
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return member("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n")


def member(data: bytes) -> bytes:
    """A gzip member with its own length and that of its data in an extra field; a length over 4 GB is written as 0, unknown."""
    made = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = made.compress(data) + made.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total if total < 1 << 32 else 0, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def decide(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, html, digest, bytes, refers): refers is the record that holds the same payload, null for its holder."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    large = rows.filter(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.max("id").alias("holder"), F.count(F.lit(1)).alias("n"))
    again = materialise(large.filter("n > 1").select(F.col("digest").alias("d"), "holder"), "payloads")
    joined = rows.join(again, F.col("digest") == F.col("d"), "left")
    return joined.select("id", "url", "html", "digest", "bytes", F.when(F.col("id") < F.col("holder"), F.col("holder")).alias("refers"))


def write_warc(df: DataFrame, **columns: str) -> tuple[str, DataFrame]:
    """Write a record per row; the folder and a written table (path, records) of its files."""
    folder = fresh_folder(df.sparkSession, "warc")
    decided = decide(df, **columns)
    rows = decided.select(F.col("id").cast("string"), "url", F.when(F.col("refers").isNull(), F.col("html")).alias("html"), "digest", "bytes", F.col("refers").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        out, name, size, count = None, "", 0, 0
        done = []
        try:
            for batch in batches:
                for page, uri, html, digest, n, refers in zip(*(batch.column(k).to_pylist() for k in range(6))):
                    if out is None:
                        name = f"{base}/{uuid.uuid4().hex}.warc.gz"
                        out, size, count = fs.open_output_stream(name, compression=None), 0, 0
                    data = record("response" if refers is None else "revisit", page, uri, digest, n, refers, (html or "").encode("utf-8", "surrogatepass"))
                    out.write(data)
                    size, count = size + len(data), count + 1
                    if size > FILE_BYTES:
                        out.close()
                        out = None
                        done.append((name, count))
        finally:
            if out is not None:
                out.close()
                done.append((name, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], names=["path", "records"])

    return folder, materialise(arrow_map(rows, run, "path string, records long"), "archives")


class _Window:
    """A moving window on a file: bytes at a place, read READ or more at a time."""

    def __init__(self, file):
        self.file, self.size, self.at, self.data = file, file.size(), 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at``; fewer at the end of the file."""
        if not (self.at <= at and at + n <= self.at + len(self.data)) and self.at + len(self.data) < self.size or at < self.at:
            self.at, self.data = at, self.file.read_at(max(n, READ), at)
        return self.data[at - self.at : at - self.at + n]


def _length(head: bytes) -> int:
    """The length that a gzip header names in an extra field sl; 0 if it doesn't."""
    if len(head) < 24 or not head[3] & 4:
        return 0
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"sl" and size == 8 and at + 12 <= len(head):
            return struct.unpack_from("<I", head, at + 4)[0]
        at += 4 + size
    return 0


def members(file, payload: bool = True, wanted=lambda head: True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the wanted records of an archive; of others only the headers are inflated."""
    window, at = _Window(file), 0
    while at < window.size:
        inflate, data, fed = zlib.decompressobj(31), b"", at
        length = _length(window.get(at, 64))
        while b"\r\n\r\n" not in data and not inflate.eof:
            piece = window.get(fed, HEAD)
            if not piece:
                raise EOFError("an archive ends within a record")
            data += inflate.decompress(piece)
            fed += len(piece)
        head, _, rest = data.partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in x)
        take = wanted(headers)
        parts = [rest] if take and payload else None
        if parts is not None or not length:
            while not inflate.eof:
                piece = window.get(fed, READ if not length else max(1, min(READ, at + length - fed)))
                if not piece:
                    raise EOFError("an archive ends within a record")
                more = inflate.decompress(piece)
                fed += len(piece)
                if parts is not None:
                    parts.append(more)
        at = at + length if length else fed - len(inflate.unused_data)
        if at > window.size:
            raise EOFError("an archive ends within a record")
        if take:
            yield headers, b"".join(parts)[: int(headers["Content-Length"])] if parts is not None else None


def _value(head: dict[str, str], field: str):
    name = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To"}.get(field)
    if name:
        return head.get(name)
    if field == "payload_digest":
        return base64.b32decode(d[5:]).hex() if (d := head.get("WARC-Payload-Digest", "")).startswith("sha1:") else None
    return int(head.get("WARC-Payload-Length", head["Content-Length"]))


class _Part(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]
        self.manifest, self.payload = options.get("manifest"), options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            known = len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in FIELDS
            if known and isinstance(f, EqualTo) and f.value is not None:
                self.tests.append((f.attribute[0], "in", (f.value,)))
            elif known and isinstance(f, In):
                self.tests.append((f.attribute[0], "in", tuple(f.value)))
            elif known and isinstance(f, StringStartsWith):
                self.tests.append((f.attribute[0], "starts", (f.value,)))
            else:
                yield f

    def partitions(self):
        paths = self.paths
        if self.manifest:  # a Parquet table with a column path, as write_warc leaves it
            import pyarrow.dataset as ds

            fs, folder = open_fs(self.manifest)
            paths = [*paths, *ds.dataset(folder, filesystem=fs, format="parquet").to_table(columns=["path"])["path"].to_pylist()]
        return [_Part(p) for p in paths]

    def _wanted(self, head: dict[str, str]) -> bool:
        for field, how, values in self.tests:
            value = _value(head, field)
            if value is None or not (value in values if how == "in" else value.startswith(values)):
                return False
        return True

    def read(self, partition):
        fs, path = open_fs(partition.path)
        with fs.open_input_file(path) as file:
            for head, payload in members(file, self.payload, self._wanted):
                yield (*(_value(head, k) for k in FIELDS), head, payload)


class WarcSource(DataSource):
    """spark.read.format("warc") with option manifest (a table of paths) or paths (one a line); payload=false leaves payloads out."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_warc(spark, files: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the archives that a written table (path) names. Spark pushes filters into Python sources only with a setting on."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("manifest", files.written_to).option("payload", str(payload).lower()).load()


def round_trip(df: DataFrame, **columns: str) -> DataFrame:
    """Write ``df`` as archives and read them back: one row per record.

    A response's size and digest are taken from the payload read back; a revisit's, from its headers.
    """
    kind = df.schema[columns.get("id_col", "page_id")].dataType.simpleString()
    _, files = write_warc(df, **columns)
    if files.isEmpty():
        return df.sparkSession.createDataFrame([], f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)
    # payloads of responses are decoded; of revisits the headers alone
    whole = read_warc(df.sparkSession, files).filter("record_type = 'response'")
    whole = whole.select(page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))
    again = read_warc(df.sparkSession, files, payload=False).filter("record_type = 'revisit'")
    return whole.unionByName(again.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")))
