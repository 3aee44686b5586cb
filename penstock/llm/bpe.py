"""Byte-level BPE over Arrow batches with the tokenizers library.

Every byte is written as one printable character (the byte-to-character table), the BPE model of the
tokenizers library runs over those characters, and decoding maps the characters of a token back to bytes.
A token may hold part of a character only: bytes are joined over the whole document before anything is
read as text, and the offsets of such a token are those of the character that it belongs to.

Defined cases: null text counts as empty; an empty text has no ids and decodes to no bytes; rows are
independent, so ties and repeated rows give equal results; columns other than the id and the text are not
carried, so their names cannot clash; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, arrow_map

#: Pieces that a worker remembers, and the longest piece that it remembers: a bound on its memory only.
REMEMBERED, LONGEST = 400_000, 40
#: Fixed value: the pattern of the published 50k vocabularies.
PUBLISHED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of texts that are cut, and whose new pieces are encoded, together.
GROUP = 4 << 20


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    table = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [table[b] for b in range(256)]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """What the published pattern takes each code point for: 1 letter, 2 number, 3 white space, 0 other."""
    out, every = np.zeros(0x110000, np.uint8), "".join(map(chr, range(0x110000)))
    for k, runs in enumerate((r"\p{L}+", r"\p{N}+", r"\s+"), 1):
        for m in regex.finditer(runs, every):
            out[m.start() : m.end()] = k
    return out


def piece_begins(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether a piece of the published pattern begins at each code point; ``bounds``: places that no piece and no look-ahead crosses."""
    n = len(points)
    first = np.zeros(n + 3, bool)  # three more than the points: the look-ahead needs no check of its own
    first[bounds], first[:1], first[n:] = True, True, True
    kind = _classes()[points]
    space, begins = kind == 3, first[:n].copy()
    # a class ends a piece, but a letter, number or other sign takes one blank before it along
    begins[1:] |= kind[1:] != kind[:-1]
    begins[1:] &= first[1:n] | space[1:] | (points[:-1] != 32)
    # of white space before something else, the last one stands alone or goes along
    begins[:-1] |= space[:-1] & ~space[1:] & ~first[1:n]
    # a sign that begins a piece and is an apostrophe takes s, t, m, d, re, ve or ll
    at = np.flatnonzero((points == 39) & begins)
    at = at[~first[at + 1]]
    one, two = points[at + 1], np.where(first[at + 2], 0, points[np.minimum(at + 2, n - 1)])
    size = np.where(np.isin(one, [115, 116, 109, 100]), 2, np.where(np.isin(one, [114, 118]) & (two == 101) | (one == 108) & (two == 108), 3, 0))
    at, size = at[size > 0], size[size > 0]
    begins[at + 1] = False
    begins[(at + size)[at + size < n]] = True
    return begins


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The last merge that builds a token from lower-ranked ones; None if merging does not reach it."""
    parts, limit = [token[k : k + 1] for k in range(len(token))], ranks[token]
    while len(parts) > 2:
        at, best = -1, limit
        for k in range(len(parts) - 1):
            rank = ranks.get(parts[k] + parts[k + 1], limit)
            if rank < best:
                at, best = k, rank
        if at < 0:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def tokenizer_of_ranks(path: str):
    """A tokenizers.Tokenizer that encodes one piece by the ranks of a file; a whole piece that is a token is that token."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_characters()
    text = lambda token: "".join(chars[b] for b in token)
    merges = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__):
        if pair := _halves(token, ranks):
            merges.append((text(pair[0]), text(pair[1])))
    made = Tokenizer(models.BPE(vocab={text(t): i for t, i in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return made


def tokenizer_of_json(path: str):
    """The tokenizer of a JSON file, made to take single pieces."""
    from tokenizers import Tokenizer, pre_tokenizers

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return made


class Codec:
    """Encoder and decoder of one vocabulary: texts are cut by ``pattern``, each distinct piece is encoded once.

    The published pattern cuts by the class of each character, for many texts at a time; any other is matched.

    Ids are handled packed, little-endian, in 2 bytes where the vocabulary allows and else 4.
    """

    def __init__(self, path: str, pattern: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = tokenizer_of_json(path) if path.endswith(".json") else tokenizer_of_ranks(path)
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.findall = None if pattern == PUBLISHED else regex.compile(pattern).findall
        # added tokens of the file are found in a text before it is cut, as the library does
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized and self.tokenizer.normalizer for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that depend on what is around them are not supported")
        self.found = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))).finditer
        self.known: dict[str, bytes] = {}
        self.letters = np.array(list(map(ord, byte_characters())), "<u4")
        back = {c: b for b, c in enumerate(byte_characters())}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.kind = np.dtype("<u2" if len(self.bytes_of) <= 1 << 16 else "<u4")
        self.added = {t: np.array([i], self.kind).tobytes() for t, i in added.items()}
        self.known.update(self.added)

    def _added(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.found(text)] if any(t in text for t in self.added) else []

    def _pieces(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The pieces of the texts, one text after the other, and the number of pieces up to the end of each text."""
        ends = np.cumsum([len(t) for t in texts])
        spans = [(e - len(t) + a, e - len(t) + b) for t, e in zip(texts, ends.tolist()) for a, b in self._added(t)]
        whole = "".join(texts)
        if self.findall:
            bounds = sorted({0, *ends.tolist(), *chain.from_iterable(spans)})
            apart = set(spans)
            cuts = [[whole[a:b]] if (a, b) in apart else self.findall(whole[a:b]) for a, b in zip(bounds, bounds[1:])]
            counts = np.cumsum([0, *map(len, cuts)])
            return pa.array(list(chain.from_iterable(cuts)), pa.large_string()), counts[np.searchsorted(bounds, ends)]
        data = whole.encode()
        points = np.frombuffer(data, np.uint8) if whole.isascii() else np.frombuffer(whole.encode("utf-32-le"), "<u4")
        begins = piece_begins(points, np.array([*ends, *chain.from_iterable(spans)], np.int64))
        for a, b in spans:
            begins[a + 1 : b] = False
        at = np.append(np.flatnonzero(begins), len(points))
        place = at
        if not whole.isascii():
            size = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            place = np.concatenate([[0], np.cumsum(size)])[at]
        return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(place), pa.py_buffer(data)), np.searchsorted(at, ends)

    def cut(self, text: str) -> list[str]:
        return self._pieces([text])[0].to_pylist()

    def _learn(self, pieces: list[str]) -> None:
        """Encode the pieces and remember the packed ids of each."""
        data = [x.encode() for x in (map(self.normalizer.normalize_str, pieces) if self.normalizer else pieces)]
        written, begin, ids, ends = self.letters[np.frombuffer(b"".join(data), np.uint8)].tobytes().decode("utf-32-le"), 0, [], []
        for end in np.cumsum([len(x) for x in data]).tolist():
            ids += [t.id for t in self.model.tokenize(written[begin:end])]
            ends.append(len(ids) * self.kind.itemsize)
            begin = end
        packed = np.array(ids, self.kind).tobytes()
        self.known.update((p, packed[a:b]) for p, a, b in zip(pieces, [0, *ends], ends))

    def _group(self, texts: list[str | None]) -> Iterator[bytes]:
        pieces, ends = self._pieces([t or "" for t in texts])
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        made = list(map(self.known.get, names))
        new = [p for p, ids in zip(names, made) if ids is None]
        if new:
            if len(self.known) > REMEMBERED:
                self.known.clear()
                self.known.update(self.added)
                new = [p for p in names if p not in self.added]
            self._learn(new)
            made = list(map(self.known.__getitem__, names))
        packed = pa.array(made, pa.large_binary()).take(coded.indices)
        for p in new:
            if len(p) > LONGEST:
                del self.known[p]
        data, places = packed.buffers()[2] or b"", np.frombuffer(packed.buffers()[1], np.int64)
        stops = places[ends].tolist() if len(pieces) else [0] * len(texts)
        for a, b in zip([0, *stops], stops):
            yield bytes(data[a:b])

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The packed ids of each text; they are cut in groups of about GROUP characters."""
        begin, size = 0, 0
        for k, text in enumerate(texts):
            size += len(text or "")
            if size > GROUP or k + 1 == len(texts):
                yield from self._group(texts[begin : k + 1])
                begin, size = k + 1, 0

    def ids(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, self.kind)

    def decode(self, ids) -> bytes:
        """The bytes of the ids; joined first, so characters split over tokens come out whole."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, ids: np.ndarray, text: str) -> list[tuple[int, int]]:
        """(begin, end) of each token in characters of the text; part of a character counts as the character."""
        size = np.array([len(c.encode("utf-8", "surrogatepass")) for c in text], np.int64)
        owner = np.repeat(np.arange(len(text)), size)
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids]) if len(ids) else np.zeros(0, np.int64)
        begins = np.concatenate([[0], ends[:-1]]) if len(ids) else ends
        return [(int(owner[a]), int(owner[b - 1]) + 1) for a, b in zip(begins, ends, strict=True)]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker: building the merges of a rank file takes about a second."""
    return Codec(path, pattern)


def list_array(lists: list) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    values = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encode(df: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", decode: bool = False, offsets: bool = False) -> DataFrame:
    """Encode every whole text: (id, ids array<int>), with ``decode`` also (decoded binary), read back from the ids.

    With ``offsets`` also (begins array<int>, ends array<int>): each token's characters of the text.

    One narrow pass without a shuffle; a worker holds the vocabulary, its remembered pieces and one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = codec(vocabulary, pattern)
        for batch in batches:
            keys, texts, begin, size = batch.column(0), batch.column(1).to_pylist(), 0, 0
            lists: list[np.ndarray] = []

            def flush(upto: int, begin: int, lists: list[np.ndarray]) -> pa.RecordBatch:
                out = [keys.slice(begin, upto - begin), list_array(lists)]
                if decode:
                    out.append(pa.array([it.decode(x.tolist()) for x in lists], pa.binary()))
                if offsets:
                    spans = [it.offsets(x, texts[begin + k] or "") for k, x in enumerate(lists)]
                    out += [list_array([np.array([p[side] for p in x], np.int32) for x in spans]) for side in (0, 1)]
                return pa.RecordBatch.from_arrays(out, names=["key", "ids", *["decoded"] * decode, *["begins", "ends"] * offsets])

            for k, packed in enumerate(it.encode(texts)):
                ids = it.ids(packed)
                lists.append(ids)
                size += 8 * len(ids) * (1 + 2 * offsets)
                if size > BATCH_BYTES:
                    yield flush(k + 1, begin, lists)
                    begin, size, lists = k + 1, 0, []
            if lists:
                yield flush(len(texts), begin, lists)

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    out = arrow_map(rows, run, f"key {kind}, ids array<int>" + ", decoded binary" * decode + ", begins array<int>, ends array<int>" * offsets)
    return out.withColumnRenamed("key", id_col)


def decode_ids(df: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode an array column of ids: (id, decoded binary); null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = codec(vocabulary, pattern)
        for batch in batches:
            made = [it.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["key", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    out = arrow_map(df.select(F.col(id_col).alias("key"), F.col(ids_col).alias("ids")), run, f"key {kind}, decoded binary")
    return out.withColumnRenamed("key", id_col)


def digests(df: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of an encoded and decoded frame, computed in the JVM."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
