"""A corpus pipeline of five stages; each works on all that the one before kept, written as Parquet and read again."""

from __future__ import annotations

import posixpath

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kawara.llm import jaccard, packing, quality, secrets, substrings
from kawara.llm.common import durable, free, shared_folder
from kawara.operators.durable import scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule, and the base rules of op1."""
    return quality.apply_rules(docs).where("passes").select(docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of texts that share 0.8 of their five-word shingles.

    SimHash fingerprints that differ in at most three bits link first, each link checked by the shingles themselves; near
    copies that fingerprints are too far apart to show are then found by the shingles that fewest texts have.
    Where rows repeat a doc_id, those of the kept one whose texts differ all stay, and equal ones stay once. Rows
    without a doc_id can't be told apart, so they all stay.
    """
    kept = jaccard.near_copies(docs, shingle_words=5, radius=3).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("times"))
    (times,) = free(docs, "times")
    out = docs.join(durable(kept.withColumnRenamed("times", times)), "doc_id")
    once, more = out.where(F.col(times) == 1), out.where(F.col(times) > 1).dropDuplicates(["doc_id", "text"])
    return once.unionByName(more).drop(times).unionByName(docs.where("doc_id IS NULL")).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur more than once; texts with none are untouched, emptied ones go."""
    out = substrings.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return _with_text(out.where("n_removed = 0 OR n_removed < n_words").withColumn("text", text), docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret masked."""
    return _with_text(secrets.redact(secrets.scan(docs)), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its token ids and its place in a sequence."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


def _with_text(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints, their components and packing can't be said in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what each returns is kept in a folder of its own under the shared one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_folder(spark)
    for name, stage in STAGES[:-1]:
        out = posixpath.join(base, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
