"""Language model scoring by a hashed maximum-entropy model with a class-factored softmax.

P(token | context) = P(class | context) * P(token | class, context). The CLASSES - 1 first classes hold WIDTH frequent
tokens each, by rank; the last one all others and the unknown token. Both factors are softmaxes over sums of weight
rows: of the word before, the two words before (n-grams) and the word but one before (skip), each hashed to a row. In
the last class tokens are distributed by their counts plus one; the counts are those of the whole corpus and grow with
it.

1. Counts of all tokens, by Spark. Of the most frequent ones a bounded table goes to the tasks.
2. Training: each of ROUNDS rounds takes its share of the documents by hash, so each document is used once. A task
   begins with the weights so far, makes gradient steps on its documents and gives the change of each row that it
   touched; Spark adds these up by row, weighted by use, and the driver takes their mean: a table of fixed size.
   Changes are summed as integers, so that the order of the sum does not matter.
3. Scoring: sums per document from numpy batches. Tokens outside the bounded table are looked up by a join with the
   counts, and their part is added.

Tokens are named by 64-bit polynomial hashes of their bytes, computed over whole batches. The table of weights has a
fixed size, whatever the corpus, so it can be sent to every task; the counts are joined.

Defined cases: null and empty texts have one token, the end; a null id is not held out; rows are scored each for
itself; with no document to learn from the model knows the unknown token alone and scores 0; an empty table gives an
empty table; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, hold, materialise

#: Classes and tokens of one, hashed rows (a power of two, 2**15 at most) of either softmax, rounds, step size, tokens of a gradient step.
CLASSES, WIDTH, ROWS, ROUNDS, RATE, STEP = 32, 32, 1 << 14, 3, 0.3, 1 << 13
#: Frequent tokens whose counts tasks hold; of these so many are told apart in a context.
HELD, CONTEXT = 1 << 18, 1 << 14
#: Bytes and tokens handled at a time; a unit of a summed change.
PIECE, PART, UNIT = 1 << 20, 1 << 13, 1 << 16
END = 1
_SPACE = np.isin(np.arange(256), (32, *range(9, 14)))
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64) + np.uint64(1)
_BASE, _M1, _M2 = 0x9E3779B97F4A7C15 | 1, np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, PIECE + 4096)
        steps = [np.full(size, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        for s in steps:
            s[0] = 1
        _powers, _inverse = (np.cumprod(s) for s in steps)
    return _powers, _inverse


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(names, ends) of a column of texts: the names of all tokens, an end for each text, and the place after each text's end."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    word = ~_SPACE[data]
    border = np.zeros(len(data) + 1, bool)  # where a text begins
    border[offsets] = True
    starts = np.flatnonzero(word & (np.r_[True, ~word[:-1]] | border[:-1]) if len(data) else word)
    stops = np.flatnonzero(word & (np.r_[~word[1:], True] | border[1:]) if len(data) else word) + 1
    names = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):  # pieces of some bytes that end with a word
        j = max(k + 1, int(np.searchsorted(stops, starts[k] + PIECE, "right")))
        a, b = starts[k], stops[j - 1]
        power, inverse = _tables(b - a)
        upto = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_LOWER[data[a:b]] * power[: b - a], out=upto[1:])
        s, e = starts[k:j] - a, stops[k:j] - a
        names[k:j] = (upto[e] - upto[s]) * inverse[s] + (e - s).astype(np.uint64) * _M2
        k = j
    names = _mixed(names)
    names[names <= END] += np.uint64(2)
    ends = np.searchsorted(starts, offsets[1:]) + np.arange(1, len(texts) + 1)
    out = np.full(len(names) + len(texts), END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = False
    out[inner] = names
    return out, ends


@dataclass
class Vocabulary:
    """The frequent tokens by name, with rank and count; totals of all tokens (n, v) and of those outside the classes."""

    names: np.ndarray
    ranks: np.ndarray
    counts: np.ndarray
    n: int
    v: int
    rest_n: int
    rest_v: int

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and counts; a token that is not held ranks behind all that are and all of the classes."""
        behind = max(len(self.names), (CLASSES - 1) * WIDTH)
        if not len(self.names):
            return np.full(len(names), behind), np.zeros(len(names), np.int64)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        held = self.names[at] == names
        return np.where(held, self.ranks[at], behind), np.where(held, self.counts[at], 0)


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(name, c) of all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, n = np.unique(tokens(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n, pa.int64())], names=["name", "c"])

    return arrow_map(docs.select(text_col), run, "name long, c long").groupBy("name").agg(F.sum("c").alias("c"))


def vocabulary(made: DataFrame) -> Vocabulary:
    n, v = made.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = made.orderBy(F.desc("c"), "name").limit(HELD).toArrow()  # HELD rows at most
    names, c = top["name"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order, own = np.argsort(names), min(len(names), (CLASSES - 1) * WIDTH)
    return Vocabulary(names[order], order, c[order], n, v, int(n - c[:own].sum()), v - own)


class Model:
    """Weights: (row, column) of classes and of tokens in a class; the first rows of ``bias`` are log probabilities without context."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        size = (CLASSES - 1) * WIDTH
        by_rank = np.zeros(size)
        by_rank[vocab.ranks[vocab.ranks < size]] = vocab.counts[vocab.ranks < size]
        mass = np.append(by_rank.reshape(CLASSES - 1, WIDTH).sum(1), vocab.rest_n + vocab.rest_v + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.class_bias = np.maximum(np.log(mass / mass.sum()), -1e4).astype(np.float32)
            inner = np.log(by_rank.reshape(CLASSES - 1, WIDTH) / mass[:-1, None])
        self.inner_bias = np.nan_to_num(np.maximum(inner, -1e4), nan=0, neginf=-1e4).astype(np.float32)
        self.weights = np.zeros((2 * ROWS, max(CLASSES, WIDTH)), np.float32)

    def features(self, ranks: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of each token's context: the word before, both words before, the word but one before."""
        top = CONTEXT
        ids = np.where(ranks < top, ranks, top + np.log2(np.maximum(ranks, 1)).astype(np.int64)).astype(np.uint64) + np.uint64(2)
        first = np.zeros(len(ids), np.int64)
        begins = np.r_[0, ends[:-1]]
        first[begins] = 1
        one, two = np.roll(ids, 1), np.roll(ids, 2)
        one[begins] = 1
        two[begins] = 0
        after = begins + 1
        two[after[after < ends]] = 1
        return np.stack([_mixed(one * _M1 + np.uint64(1)), _mixed((one * _M2 ^ _mixed(two)) + np.uint64(2)), _mixed(two * _M1 + np.uint64(3))])

    @staticmethod
    def rows(features: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
        """Rows of the weights: for classes, or for the tokens of the given classes."""
        if classes is None:
            return (features % np.uint64(ROWS)).astype(np.int64)
        return ROWS + (_mixed(features + classes.astype(np.uint64) * _M2) % np.uint64(ROWS)).astype(np.int64)

    def sums(self, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Sums of the weights by column, less the largest of a token."""
        z = self.weights.take(rows[0], 0)
        for r in rows[1:]:
            z += self.weights.take(r, 0)
        z += bias
        z -= z.max(1, keepdims=True)
        return z

    def log_of(self, rows: np.ndarray, bias: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probabilities of the given columns."""
        z = self.sums(rows, bias)
        out = z[np.arange(len(target)), target].astype(np.float64)
        return out - np.log(np.exp(z, out=z).sum(1))

    def score(self, ranks: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Natural log probability of each token; for one outside the classes, of their last class alone."""
        out = np.empty(len(ranks))
        for a in range(0, len(ranks), PART):
            f, r = features[:, a : a + PART], ranks[a : a + PART]
            c = np.minimum(r // WIDTH, CLASSES - 1)
            z = self.log_of(self.rows(f), self.class_bias, c)
            own = np.flatnonzero(c < CLASSES - 1)
            z[own] += self.log_of(self.rows(f[:, own], c[own]), self.inner_bias[c[own]], r[own] % WIDTH)
            out[a : a + PART] = z
        return out

    def learn(self, ranks: np.ndarray, features: np.ndarray, squares: np.ndarray, used: np.ndarray) -> None:
        """Gradient steps on the tokens; squares: sums of squared gradients by row; used: uses by row."""
        for a in range(0, len(ranks), STEP):
            f, r = features[:, a : a + STEP], ranks[a : a + STEP]
            c = np.minimum(r // WIDTH, CLASSES - 1)
            self._step(self.rows(f), self.class_bias, c, squares, used)
            own = np.flatnonzero(c < CLASSES - 1)
            if len(own):
                self._step(self.rows(f[:, own], c[own]), self.inner_bias[c[own]], r[own] % WIDTH, squares, used)

    def _step(self, rows: np.ndarray, bias: np.ndarray, target: np.ndarray, squares: np.ndarray, used: np.ndarray) -> None:
        g = self.sums(rows, bias)
        np.exp(g, out=g)
        g /= g.sum(1, keepdims=True)
        g[np.arange(len(target)), target] -= 1
        for r in rows:
            order = np.argsort(r.astype(np.uint16), kind="stable")  # 2 * ROWS fit 16 bits, which are sorted by digits
            at = r[order]
            begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            change, where = np.add.reduceat(g.take(order, 0), begin), at[begin]
            squares[where] += np.square(change).sum(1)
            used[where] += np.diff(np.r_[begin, len(at)])
            self.weights[where] -= RATE * change / np.sqrt(squares[where] + 1e-6)[:, None]


def _round(docs: DataFrame, model: Model, text_col: str) -> np.ndarray:
    """The weights after one round over ``docs``."""
    width = model.weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = model.weights.copy()
        squares, used = np.zeros(len(before), np.float32), np.zeros(len(before), np.int64)
        for batch in batches:
            names, ends = tokens(batch.column(0))
            if len(names):
                ranks = model.vocab.find(names)[0]
                model.learn(ranks, model.features(ranks, ends), squares, used)
        rows = np.flatnonzero(used)
        change = np.rint((model.weights[rows] - before[rows]).astype(np.float64) * UNIT).astype(np.int64) * used[rows, None]
        model.weights = before
        for a in range(0, len(rows), 1 << 13):
            part = slice(a, a + (1 << 13))
            yield pa.RecordBatch.from_arrays([pa.array(rows[part]), pa.array(used[rows[part]]), pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * width), len(rows[part]), [None, pa.py_buffer(change[part].tobytes())]).cast(pa.binary())], names=["row", "used", "change"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}  # the rows of one partition: a bounded table
        for batch in batches:
            for row, n, x in zip(*(c.to_pylist() for c in batch.columns)):
                s = sums.setdefault(row, [0, np.zeros(width, np.int64)])
                s[0] += n
                s[1] += np.frombuffer(x, np.int64)
        if sums:
            mean = [(s / (n * UNIT)).astype(np.float32).tobytes() for n, s in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(mean, pa.binary())], names=["row", "change"])

    changes = arrow_map(docs.select(text_col), run, "row long, used long, change binary").repartition("row")
    found = arrow_map(changes, add, "row long, change binary").toArrow()  # 2 * ROWS rows at most
    out = model.weights.copy()
    if len(found):
        out[found["row"].to_numpy()] += np.frombuffer(b"".join(found["change"].to_pylist()), np.float32).reshape(-1, width)
    return out


def fit(docs: DataFrame, *, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of all of ``docs`` and the counts (name, c) of all their tokens."""
    made = materialise(counts(docs, text_col), "counts")
    model = Model(vocabulary(made))
    for k in range(ROUNDS):
        model.weights = _round(docs.filter(F.pmod(F.xxhash64(text_col), F.lit(ROUNDS)) == k), model, text_col)
    return model, made


def score(docs: DataFrame, model: Model, made: DataFrame, *, keep: list[str | Column], text_col: str = "text") -> DataFrame:
    """The columns ``keep``, n_tokens, n_known, train_tokens, base_score and score of each row."""
    vocab, ten = model.vocab, np.log(10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            names, ends = tokens(batch.column(batch.num_columns - 1))
            ranks, c = vocab.find(names)
            held = c > 0
            part = model.score(ranks, model.features(ranks, ends))
            last = ranks >= (CLASSES - 1) * WIDTH
            inner = np.where(held, np.log10(c + 1.0), 0)
            part = part / ten + np.where(last, inner - np.log10(vocab.rest_n + vocab.rest_v + 1), 0)
            n = np.diff(np.r_[0, ends])
            begin = np.r_[0, ends[:-1]]
            of = lambda x: np.add.reduceat(x, begin)
            base = of(inner) - n * np.log10(vocab.n + vocab.v + 1)
            rare = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(of((~held).astype(np.int64)))], pa.int32()), pa.array(names[~held].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(row + np.arange(len(n))), pa.array(n), pa.array(of(held.astype(np.int64))), pa.array(base), pa.array(of(part)), rare], names=[*batch.schema.names[:-1], "__row", "n_tokens", "n_known", "base_score", "score", "__rare"])
            row += len(n)

    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    scored = hold(materialise(arrow_map(rows, run, f"{fields}, __row long, n_tokens long, n_known long, base_score double, score double, __rare array<long>"), "scored"))
    # tokens outside the bounded table: sort-merge at every size, both sides grow with the corpus
    rare = scored.select(F.col("__row").alias("__r"), F.explode("__rare").alias("__name")).groupBy("__r", "__name").agg(F.count(F.lit(1)).alias("__times"))
    met = rare.join(made.hint("merge"), F.col("__name") == F.col("name"))
    more = met.groupBy("__r").agg(F.sum("__times").alias("__known"), F.sum(F.col("__times") * F.log10(F.col("c") + F.lit(1.0))).alias("__more"))
    out = scored.drop("__rare").join(more.hint("merge"), F.col("__row") == F.col("__r"), "left")
    add = F.coalesce("__more", F.lit(0.0))
    columns = [F.col(f"`{f.name}`") for f in rows.schema.fields[:-1]]
    return out.select(*columns, "n_tokens", (F.col("n_known") + F.coalesce("__known", F.lit(0))).alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"), (F.col("base_score") + add).alias("base_score"), (F.col("score") + add).alias("score"))
