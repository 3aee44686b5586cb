"""Audio columns: 8-bit WAV clips and their features.

A clip is resampled by a polyphase filter (any rational ratio), cut into overlapped frames, turned into log-mel bands
and segmented by energy with hysteresis. Bands are kept in steps of 1 / STEPS as bytes and stored as tensors of one
fixed shape (TENSOR frames x MEL bands, the last one padded with zeros) with their time spans, in Arrow files whose
column has the fixed-shape tensor type; the segments' time spans stand beside them. What is reported of a clip is
read back from these files. Samples are handled in blocks; a clip's bands take a quarter of its bytes.

Defined cases: null and empty texts are a payload of 64 zero bytes; silence has no segment; equal payloads give
equal values; repeated rows stand for themselves; an empty table gives an empty table; only the named columns are
carried; a WAV file that isn't 8-bit mono PCM is an error.
"""

from __future__ import annotations

import hashlib
import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, arrow_map, fresh_folder, materialise, open_fs

#: Rates in Hz; frame, hop and transform in samples; bands; frames of a tensor; frames handled at a time; taps of a filter by rate.
RATE, TO, FRAME, HOP, FFT, MEL, TENSOR, BLOCK, HALF = 16_000, 8_000, 200, 80, 256, 32, 32, 4096, 15
#: Energy segments begin above HIGH and go on above LOW (mean log-mel); the floor keeps logarithms finite.
HIGH, LOW, FLOOR = -6.0, -8.0, 1e-6
#: Steps of a unit of log-mel above its floor.
STEPS = 12


def wav_bytes(payload: bytes, rate: int = RATE) -> bytes:
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n) + payload


def wav_payload(media: bytes) -> bytes:
    """The samples of a WAV file of 8-bit mono PCM; other chunks than its format and data are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV clip")
    at, known = 12, False
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, rate, bits) != (1, 1, RATE, 8):
                raise ValueError(f"not {RATE} Hz 8-bit mono PCM")
            known = True
        elif name == b"data" and known:
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV clip without format or data")


@lru_cache(maxsize=4)
def low_pass(up: int, down: int) -> np.ndarray:
    """A windowed sinc at ``up`` times the rate that passes half of the lower of the two rates."""
    widest = max(up, down)
    k = np.arange(-HALF * widest // 2 * (1 if widest > 1 else 0), HALF * widest // 2 + 1)
    return (np.sinc(k / widest) * np.hamming(len(k)) * up / widest).astype(np.float32)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(window, mel matrix)"""
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + TO / 2 / 700), MEL + 2) / 2595) - 1)
    freq = np.arange(FFT // 2 + 1) * TO / FFT
    up, down = (freq[:, None] - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - freq[:, None]) / np.diff(edges)[1:]
    return np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(up, down)).astype(np.float32)


def resample(samples: np.ndarray, rate: int = RATE, to: int = TO) -> np.ndarray:
    """The signal at another rate by the phases of a low-pass filter; the signal is padded with zeros.

    Output q * up + s is the s-th phase of the filter at input q * down + (s * down + centre) // up.
    """
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    low = low_pass(up, down)
    centre, count = len(low) // 2, -(-len(samples) * up // down)
    out = np.zeros(count, np.float32)
    for s in range(min(up, count)):
        n, (ahead, phase) = len(range(s, count, up)), divmod(s * down + centre, up)
        taps = low[phase::up]
        # input places that this phase needs: q * down + ahead - m for tap m
        padded = np.concatenate([np.zeros(len(taps) - 1, np.float32), samples, np.zeros(ahead + down, np.float32)])
        made = np.zeros(n, np.float32)
        for p in range(down):  # taps m = p modulo down meet one decimated stream each
            part = taps[p::down]
            if len(part):
                stream = padded[(ahead - p + len(taps) - 1) % down :: down]
                first = (ahead - p + len(taps) - 1) // down - (len(part) - 1)
                lead = max(0, -first)
                piece = np.concatenate([np.zeros(lead, np.float32), stream[max(0, first) :]])[: n + len(part) - 1]
                made += np.convolve(np.pad(piece, (0, n + len(part) - 1 - len(piece))), part, "valid")
        out[s::up] = made
    return out


def log_mel(payload: bytes) -> Iterator[np.ndarray]:
    """Blocks of at most BLOCK frames x MEL bands; a clip has one frame at least."""
    window, mel = _tables()
    data = np.frombuffer(payload, np.uint8)
    out = (len(data) * TO + RATE - 1) // RATE
    frames = max(1, 1 + -(-(out - FRAME) // HOP)) if out > FRAME else 1
    reach = len(low_pass(1, RATE // TO)) + 1  # samples around a block that its filter needs; a multiple of the ratio
    for begin in range(0, frames, BLOCK):
        count = min(BLOCK, frames - begin)
        first, last = begin * HOP, (begin + count - 1) * HOP + FRAME
        lo, hi = max(0, (first * RATE // TO) - reach), min(len(data), last * RATE // TO + reach)
        signal = resample((data[lo:hi].astype(np.float32) - 128) / 128)[first - lo * TO // RATE :][: last - first]
        signal = np.pad(signal, (0, last - first - len(signal)))
        cut = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP][:count] * window
        power = np.abs(np.fft.rfft(cut, FFT, axis=1)).astype(np.float32) ** 2 / FFT
        yield np.log(np.maximum(power @ mel, FLOOR)).astype(np.float32)


def in_steps(bands: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((bands - np.log(FLOOR)) * STEPS), 0, 255).astype(np.uint8)


def span(part: int, frames: int) -> tuple[float, float]:
    """(begin, end) in seconds of a tensor with so many frames."""
    return part * TENSOR * HOP / TO, ((part * TENSOR + frames - 1) * HOP + FRAME) / TO


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) frames of the segments: begun above HIGH, gone on with while above LOW."""
    low = np.concatenate([[False], energy > LOW, [False]]).astype(np.int8)
    begins, ends = np.flatnonzero(np.diff(low) == 1), np.flatnonzero(np.diff(low) == -1)
    return [(int(a), int(b)) for a, b in zip(begins, ends) if (energy[a:b] > HIGH).any()]


def store(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each text's bytes, padded with zeros to a positive multiple of 64, as a WAV clip; a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, made, sizes, size, begin = batch.column(0), [], [], 0, 0
            for k in range(batch.num_rows):
                data = (batch.column(1)[k].as_py() or "").encode("utf-8", "surrogatepass")
                made.append(wav_bytes(data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))))
                sizes.append(len(data))
                size += len(data)
                if size > BATCH_BYTES or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([keys.slice(begin, len(made)), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], names=["key", "n_bytes", "media"])
                    made, sizes, size, begin = [], [], 0, k + 1

    kind = df.schema[id_col].dataType.simpleString()
    return materialise(arrow_map(df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")), run, f"key {kind}, n_bytes long, media binary"), "media", "zstd").withColumnRenamed("key", id_col)


def tensor_type() -> pa.DataType:
    return pa.fixed_shape_tensor(pa.uint8(), (TENSOR, MEL), dim_names=("frame", "band"))


def layout(key: pa.DataType) -> pa.Schema:
    """Of a feature file: a row a tensor; what holds for the whole clip stands in the row of part 0."""
    clip = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("segments", pa.list_(pa.float64()))]
    return pa.schema([("key", key), ("part", pa.int32()), ("frames", pa.int32()), ("begin_s", pa.float64()), ("end_s", pa.float64()), ("tensor", tensor_type()), *clip])


def write_features(media: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(path, clips) of the Arrow files of the clips' tensors, a written table. A task's file has a name of its own."""
    folder = fresh_folder(media.sparkSession, "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        path, out, clips = f"{base}/{uuid.uuid4().hex}.arrow", None, 0
        try:
            for batch in batches:
                schema = layout(batch.schema.field(0).type)
                if out is None and batch.num_rows:
                    fs.create_dir(base, recursive=True)
                    sink = fs.open_output_stream(path)
                    out = pa.ipc.new_file(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                rows: list[tuple] = []
                parts: list[np.ndarray] = []

                def flush() -> None:
                    if rows:
                        columns = list(zip(*rows))
                        values = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(parts).ravel()), TENSOR * MEL)
                        keys = batch.column(0).take(pa.array(columns[0]))
                        made = {f.name: pa.array(list(c), f.type) for f, c in zip([f for f in schema if f.name not in ("key", "tensor")], columns[1:])}
                        made |= {"key": keys, "tensor": pa.ExtensionArray.from_storage(tensor_type(), values)}
                        out.write_batch(pa.RecordBatch.from_arrays([made[f.name] for f in schema], schema=schema))
                        rows.clear()
                        parts.clear()

                for k in range(batch.num_rows):
                    clip = batch.column(2)[k].as_py()
                    payload = wav_payload(clip)
                    energy, bands = [], []
                    for block in log_mel(payload):
                        energy.append(block.mean(axis=1))
                        bands.append(in_steps(block))
                    level, bands = np.concatenate(energy), np.concatenate(bands)
                    whole = (batch.column(1)[k].as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(clip), hashlib.sha256(clip).hexdigest(), [x for a, b in segments(level) for x in (a * HOP / TO, ((b - 1) * HOP + FRAME) / TO)])
                    for part in range(-(-len(bands) // TENSOR)):
                        piece = bands[part * TENSOR : (part + 1) * TENSOR]
                        rows.append((k, part, len(piece), *span(part, len(piece)), *(whole if not part else (None,) * len(whole))))
                        parts.append(np.pad(piece, ((0, TENSOR - len(piece)), (0, 0)))[None])
                        if len(rows) >= 2048:
                            flush()
                    clips += 1
                flush()
        finally:
            if out is not None:
                out.close()
                sink.close()
        if clips:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([clips], pa.int64())], names=["path", "clips"])

    rows = media.select(F.col(id_col).alias("key"), "n_bytes", "media")
    return materialise(arrow_map(rows, run, "path string, clips long"), "feature-files")


def read_features(path: str) -> Iterator[pa.RecordBatch]:
    """The batches of a feature file; a tensor column of another shape is an error."""
    fs, name = open_fs(path)
    with fs.open_input_file(name) as source:
        file = pa.ipc.open_file(source)
        if file.schema.field("tensor").type != tensor_type():
            raise ValueError(f"{path} has tensors of another type: {file.schema.field('tensor').type}")
        for k in range(file.num_record_batches):
            yield file.get_batch(k)


def summaries(files: DataFrame, key: str, *, id_col: str = "doc_id") -> DataFrame:
    """Per clip of the feature files: sizes, digests, and feature: frames, segments, their seconds, and mean and peak of the bands in steps.

    ``key``: the type of the ids. A task a file; a clip's tensors stand together.
    """
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths in batches:
            for path in paths.column(0).to_pylist():
                held: list = []  # of the clip whose tensors are still coming: row, frames, sum, peak

                def text(row: dict, frames: int, total: np.ndarray, peak: np.ndarray) -> str:
                    spans = row["segments"]
                    seconds = sum(b - a for a, b in zip(spans[::2], spans[1::2]))
                    return f"{frames};{len(spans) // 2};{seconds:.3f};" + ",".join(f"{x:.2f}" for x in total / frames) + ";" + ",".join(map(str, peak))

                for batch in read_features(path):
                    part, frames = batch.column("part").to_numpy(), batch.column("frames").to_numpy()
                    values = batch.column("tensor").storage.flatten().to_numpy().reshape(-1, TENSOR, MEL)
                    sums, peaks = values.sum(axis=1, dtype=np.int64), values.max(axis=1)  # padding is zero
                    first = np.flatnonzero(part == 0)
                    rows = batch.select(["key", *names, "segments"]).take(pa.array(first)).to_pylist()
                    edges = [0, *first[first > 0].tolist(), len(part)]
                    done, at = [], 0
                    for a, b in zip(edges, edges[1:]):
                        piece = [int(frames[a:b].sum()), sums[a:b].sum(axis=0), peaks[a:b].max(axis=0)]
                        if part[a] == 0:
                            if held:
                                done.append(held)
                            held, at = [rows[at], *piece], at + 1
                        else:
                            held = [held[0], held[1] + piece[0], held[2] + piece[1], np.maximum(held[3], piece[2])]
                    if done:
                        yield pa.RecordBatch.from_pylist([{c: x[0][c] for c in ("key", *names)} | {"feature": text(*x)} for x in done], schema)
                if held:
                    yield pa.RecordBatch.from_pylist([{c: held[0][c] for c in ("key", *names)} | {"feature": text(*held)}], schema)

    out = f"key {key}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(files.sparkSession.createDataFrame([], out).schema)
    paths = files.select("path").repartition(max(1, files.count()))
    return arrow_map(paths, run, out).withColumnRenamed("key", id_col)
