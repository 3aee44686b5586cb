"""Language model scoring, the prefix trie and ranked search against brute force, whole tables and planted edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex

from penstock.llm import lexical, maxent, trie
from penstock.llm import queries as Q

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 997}x{k}" for k in range(20_000))
EDGE = [
    (None, "null id a", "en", None, 0), (1, None, "en", None, 0), (2, "", None, "a", 0), (3, LONG, "en", "a", 1), (4, LONG, "en", "b", 1), (5, "the the THE \x0b the\x00n été É", "fr", "b", 2), (6, " ... ", None, None, 3), (7, "a " * 300, "en", "a", 4),
    (8, "a " * 300, "en", "a", 4), (8, "other text of id eight", "en", "a", 4), (9, "x" * 50_000, "es", "b", 4), (10, "Ñandú 🙂 a_b c-d 12", "es", "b", 9), (16, "w1x1 w2x2 the end", "es", "b", 9),
]
ITEMS = [(1, "the end of w1x1"), (2, None), (3, "zzz"), (4, "a a a b"), (None, "été É the"), (4, "nandú ñandú 🙂")]


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("edge")
    spark.createDataFrame(EDGE, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    turns = [(None, 1, "u", "lost"), (0, None, "u", "first"), (0, 2, None, None), (0, 1, "u", "x"), (0, 1, "u", "x"), (0, 1, "a", "y"), (3, 5, "u", "only"), (7, 1, "u", "é" * 40_000), (10, 1, "u", "x"), (11, 1, "u", "x"), (14, 0, "u", None)] + [(20, k, "u", f"t{k % 3}") for k in range(300)]
    turns += [(c, k, "u", f"s{k}") for c in range(30, 60) for k in range(12)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(5).write.parquet(f"{path}/conversations.parquet")
    empty = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    spark.createDataFrame([], "conv_id long, turn int, role string, text string").write.parquet(f"{empty}/conversations.parquet")
    return str(path), str(empty)


def test_empty_tables(spark, edge_dir):
    for query in (Q.op11_maxent, Q.op12_trie, Q.op13_search):
        assert query(spark, edge_dir[1]).collect() == []


# scores


@pytest.mark.parametrize("at", ["sf", "edge"])
def test_op11(spark, edge_dir, at):
    d = SF if at == "sf" else edge_dir[0]
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    bag = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    counts = Counter(w for r in rows if not held(r["doc_id"]) for w in bag(r["text"]))
    n, v = sum(counts.values()), len(counts)
    got = Q.op11_maxent(spark, d).collect()
    line = lambda k, h, t: (k is None, k or 0, h, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(line(r["doc_id"], held(r["doc_id"]), bag(r["text"])) for r in rows)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    if at == "sf":  # the model predicts what it hasn't seen better than the counts alone
        base, model, size = (sum(r[c] for r in got if r["held_out"]) for c in ("base_score", "score", "n_tokens"))
        assert model > base + 0.03 * size
    again = {(r["doc_id"], r["score"]) for r in Q.op11_maxent(spark, d).select("doc_id", "score").collect()}
    assert len(again) == len({(r["doc_id"], r["score"]) for r in got}) and all(any(a == r["doc_id"] and abs(s - r["score"]) < 1e-6 * abs(s) for a, s in again) for r in got)


def test_tokens_by_bytes(monkeypatch):
    texts = [None, "", "  ", "a b", "b  a\n", " été\x0bété", "A a", "x" * 5000, "w w", "\x00", "\x00\x00", None, "b"]
    column = pa.array(["skip", *texts])
    for size in (1 << 20, 7):
        monkeypatch.setattr(maxent, "PIECE", size)
        names, ends = maxent.tokens(column.slice(1))
        of, at = {}, 0
        for t, e in zip(texts, ends):
            words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").replace("A", "a"))
            assert e - at == len(words) + 1 and names[e - 1] == maxent.END
            assert all(of.setdefault(w, x) == x for w, x in zip(words, names[at:e].tolist()))
            at = e
        assert len(set(of.values())) == len(of) and maxent.END not in of.values() and at == len(names)


def test_model_sums_to_one():
    """Over all known tokens and the unknown one, whatever the context and the weights."""
    rng = np.random.default_rng(4)
    for kinds in (5, 700, 3000):
        names = np.sort(rng.choice(1 << 60, kinds, replace=False).astype(np.uint64))
        counts = np.sort(rng.integers(1, 50, kinds))[::-1]
        ranks = rng.permutation(kinds)
        own = min(kinds, (maxent.CLASSES - 1) * maxent.WIDTH)
        vocab = maxent.Vocabulary(names, ranks, counts[ranks], int(counts.sum()), kinds, int(counts[own:].sum()), kinds - own)
        model = maxent.Model(vocab)
        model.weights = rng.normal(0, 1, model.weights.shape).astype(np.float32)
        features = np.repeat(rng.integers(0, 1 << 63, (3, 1)).astype(np.uint64), kinds + 1, 1)
        every, c = vocab.find(np.append(names[np.argsort(ranks)], np.uint64(3)))
        p = np.exp(model.score(every, features))
        last = every >= (maxent.CLASSES - 1) * maxent.WIDTH
        assert last[-1] and c[-1] == 0 and (every[:-1] == np.arange(kinds)).all()
        assert abs(np.where(last, p * (c + 1) / (vocab.rest_n + vocab.rest_v + 1), p).sum() - 1) < 1e-4


# trie


def brute_trie(rows):
    turns = defaultdict(list)
    for r in rows:
        if r["conv_id"] is not None:
            role, text = r["role"] or "", r["text"] or ""
            turns[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, role.encode(), hashlib.md5(text.encode()).hexdigest(), text))
    turns = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in turns.items()}
    members = defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = turns.get(c - c % 5, [])[:h] + own[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, d == len(whole)))
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    least = {k: min(c for c, _ in m) for k, m in members.items()}
    ends = {k: hashlib.sha256(",".join(str(c) for c in sorted(c for c, e in m if e)).encode()).hexdigest() for k, m in members.items()}
    return sorted((least[k], len(k), least[k[:-1]] if k else -1, len(m), children[k], leaves[k], saved[k], ends[k]) for k, m in members.items())


def nodes(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def test_op12(spark, edge_dir):
    assert nodes(Q.op12_trie(spark, edge_dir[0])) == brute_trie(spark.read.parquet(f"{edge_dir[0]}/conversations.parquet").collect())
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    assert nodes(Q.op12_trie(spark, SF)) == brute_trie(rows.collect())


@pytest.mark.parametrize("blocks", ["1", "3", "40"])
def test_trie_over_block_borders(spark, monkeypatch, blocks):
    rng = random.Random(int(blocks))
    rows = [(c, k, "u", rng.choice("ab" if k < 6 else "abc")) for c in range(150) for k in range(rng.choice([0, 1, 2, 5, 9, 14]))]
    rows += [(c, k, "u", "a") for c in range(150, 200) for k in range(13)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(trie, "PIECE", 16)
    spark.conf.set("spark.sql.shuffle.partitions", blocks)
    try:
        assert nodes(trie.conversation_trie(df)) == brute_trie(df.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


# search


def brute_search(rows, items):
    terms = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in regex.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    bags = [(r["doc_id"], Counter(terms(r["text"]))) for r in rows]
    n, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for w, k in df.items()}
    out = []
    for item in items:
        asked, scores = Counter(terms(item["text"])), []
        for k, b in bags:
            m = 75 + (25 * b.total() * n) // total if total else 0
            s = sum(t * weight[w] * ((1_000_000_000 * b[w]) // (1000 * b[w] + 12 * m)) for w, t in asked.items() if b[w])
            if s > 0:
                scores.append((-s, k is None, k or 0))
        out += [(str(item["item_id"]), i + 1, None if null else k, -s) for i, (s, null, k) in enumerate(sorted(scores)[:20])]
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_op13(spark, edge_dir, monkeypatch, small):
    if small:  # batches of a few rows and several blocks of items
        monkeypatch.setattr(lexical, "BATCH_BYTES", 2000)
        monkeypatch.setattr(lexical, "ITEMS", 25)
    for d in (SF, edge_dir[0]):
        rows, items = (spark.read.parquet(f"{d}/{t}.parquet").collect() for t in ("documents", "benchmark"))
        got = [(str(r["item_id"]), r["rank"], r["doc_id"], r["score"]) for r in Q.op13_search(spark, d).collect()]
        assert sorted(got, key=str) == brute_search(rows, items)


@pytest.mark.parametrize("name", ["op12_trie", "op13_search"])
def test_matches_sql(spark, name):
    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = Q.queries()[name](spark, sf).toPandas()
    want = con.sql(Q.oracle_sql()[name]).df()[list(got.columns)]
    rows = lambda df: sorted(map(str, df.astype(object).where(df.notna(), -1).itertuples(index=False)))
    assert [x.replace(".0", "") for x in rows(got)] == [x.replace(".0", "") for x in rows(want)]
