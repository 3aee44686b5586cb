"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, byte-level BPE.

A stage's result is to be written before the next stage is called: a stage begins by deleting the work tables that
the last one's result was read from.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.llm import bpe, mixing, rules, shingles, substrings
from penstock.llm.common import discard, materialise, stage_work

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(fn):
    """A stage: work tables that its lazy result reads are deleted when the next stage begins."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage_work(spark):
            return fn(spark, docs, sf_dir)

    return run_stage


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: null and empty texts fail, rows are judged each for itself, a null source is a host."""
    return rules.quality_rules(docs, keep_text=True).filter("kept").select(*COLUMNS)


@stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (shingles of 5 words, Jaccard similarity 0.8 or more): that of the smallest id.

    SimHash links are compared by their whole sets; a join of the sets adds the copies that SimHash misses.
    Rows of one id are one group. Rows with a null id are compared like any other: they go if their group has a row with
    an id; where all ids of a group are null, none is the smallest and all stay.
    """
    docs = docs.select(*COLUMNS)
    row = F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS])  # a null leaves the hash as it was
    spare = shingles.spare(docs, row=row)
    of = F.col("doc_id").eqNullSafe(F.col("__id")) & (row == F.col("__row"))
    out = docs.join(spare.hint("merge"), of, "left_anti")  # sort-merge at every size: both sides grow with the corpus
    twins = spare.filter("__twin")
    return out if twins.isEmpty() else out.unionByName(docs.join(twins, of).select(*COLUMNS).dropDuplicates(["doc_id"]))


@stage
def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of a smaller id has; a document with no word left goes.

    A row of a null id loses nothing; rows of one id are compared with other ids only.
    """
    out = substrings.remove_repeats(docs.select(*COLUMNS)).filter("n_words > n_removed")
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


@stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it: not at all, once or twice. Rows of a null id are taken like any other."""
    taken = mixing.mix(docs.select(*COLUMNS)).filter("copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


@stage
def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, decoded again: counts and digests per row; a null text has no ids."""
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(bpe.encode(docs, path, public_tokenizers.PATTERN, decode=True))


STAGES = [("quality_rules", quality_stage), ("simhash", near_duplicate_stage), ("substring_dedup", substring_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]
#: SQL can express neither the host prior's rounds nor the hashes that the mix and the tokenizer use.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each one's result is written as Parquet and read again, and goes once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
            if before is not None:
                discard(before)
            before = docs
    return docs
