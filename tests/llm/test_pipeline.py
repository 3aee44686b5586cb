"""The whole pipeline on a small corpus, compared with a brute-force version of every stage."""

import hashlib
import os
import random
import re
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as P
from penstock.llm import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")


def corpus():
    rng = random.Random(17)
    vocab = [f"word{k}" for k in range(4000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, out = text(70), []
    for k in range(60):
        body = text(rng.randrange(60, 200))
        if k % 6 == 0:  # a passage that many documents share
            body[20:20] = passage
        out.append((k, " ".join(body), ["a", "b", None][k % 3]))
    for k in range(60, 80):  # exact and near copies
        body = words(out[k - 60][1])
        if k % 2:
            body[5] = "changed"
        out.append((k, " ".join(body), "c"))
    out += [(80, "too short", "a"), (81, None, "a"), (82, "again and again " * 40, "b"), (83, "", None)]
    return [(k, t, "en", s, len(t or "")) for k, t, s in out]


def rules(rows):
    """Under 20 words or over 30 % of them in repeated runs of eight; no host is bad here."""
    kept = []
    for r in rows:
        w = words(r[1])
        runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        if len(w) >= 20 and 100 * len(covered) <= 30 * len(w):
            kept.append(r)
    return kept


def apart(rows):
    sets = [frozenset(tuple(words(r[1])[i : i + 5]) for i in range(len(words(r[1])) - 4)) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [r for k, r in enumerate(rows) if find(k) == k]


def without_repeats(rows):
    first = {}
    for r in sorted(rows):
        w = words(r[1])
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), r[0])
    out = []
    for r in rows:
        w = words(r[1])
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < r[0] for j in range(i, i + 50)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        if kept:
            out.append((r[0], kept, r[3]))
    return out


def test_stages_by_brute_force(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    from penstock.llm.bpe import read_ranks

    rows = corpus()
    path = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    d, made = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in P.STAGES[:-1]:
        d = P.materialise(stage(spark, d, path), name)
        made[name] = [tuple(r) for r in d.collect()]
    good = rules(rows)
    assert sorted(made["quality_rules"]) == sorted(good) and len(good) == 80
    alone = apart(good)
    assert sorted(made["simhash"]) == sorted(alone) and len(alone) == 60
    whole = without_repeats(alone)
    assert {(r[0], tuple(words(r[1])), r[3]) for r in made["substring_dedup"]} == {(k, tuple(w), s) for k, w, s in whole} and sum(map(len, (w for _, w, _ in whole))) < sum(len(words(r[1])) for r in alone)
    assert all(r[4] == len(r[1]) for r in made["substring_dedup"])
    # the mix takes each row 0, 1 or 2 times; sources a, b and null weigh 3, 1 and 2 and share 150 % of all words
    taken, size, long = Counter(r[0] for r in made["mixing"]), Counter(), defaultdict(int)
    source, length = {k: s for k, _, s in whole}, {k: len(w) for k, w, _ in whole}
    for k, n in length.items():
        size[source[k]] += n
        long[source[k]] = max(long[source[k]], n)
    assert set(taken) <= set(source) and max(taken.values()) <= 2 and {(r[0], r[1]) for r in made["mixing"]} <= {(r[0], r[1]) for r in made["substring_dedup"]}
    budget, open_, target = 1.5 * sum(size.values()), {"a": 3, "b": 1, None: 2}, {}
    while open_:
        left = budget - sum(target.values())
        over = {s for s, w in open_.items() if left * w / sum(open_.values()) > 2 * size[s]}
        target |= {s: 2 * size[s] for s in over} if over else {s: left * w / sum(open_.values()) for s, w in open_.items()}
        open_ = {s: w for s, w in open_.items() if s not in target}
    for s, aim in target.items():
        assert abs(sum(n * length[k] for k, n in taken.items() if source[k] == s) - aim) <= long[s]
    # the last stage, and the run of all of them
    it = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter((r[0], len(ids := it.encode_ordinary(r[1])), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for r in made["mixing"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in P.run(spark, path).collect()) == want


def folder(table):
    return table.written_to.removeprefix("file:").replace("//", "/")


def shuffle_files(spark):
    return {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}


def test_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    made = P.materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(100):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and made.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_near_copy_stage_keeps_no_table_that_nothing_reads(spark, tmp_path, monkeypatch):
    made, seen = [], []

    def told(df, name, *args):
        out = P.materialise(df, name, *args)
        made.append((name, out))
        if name == "held":  # texts and sets of a round are on the disk: what else is?
            seen.append([(n, t) for n, t in made if os.path.exists(folder(t))])
            longest = [t.agg(F.max(F.size("first"))).first()[0] for _, t in seen[-1] if "first" in t.columns]
            assert len(longest) == 1 and longest[0] <= shingles.FIRST
        return out

    monkeypatch.setattr(shingles, "materialise", told)
    docs = spark.createDataFrame(corpus(), SCHEMA).filter("doc_id < 80")
    assert max(len(words(r[1])) for r in corpus()) // 5 > shingles.FIRST
    P.near_duplicate_stage(spark, docs, "").collect()
    assert len(seen) > 2
    for tables in seen:
        count = Counter(n for n, _ in tables)
        assert count["left"] + count["met"] == 1 and count["leads"] <= 1
