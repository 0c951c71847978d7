"""A training-data pipeline over `documents`: quality rules, line dedup, near dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.llm import bpe, decontaminate, line_dedup, minhash, quality
from sheafline.llm.tasks import discard, written

#: Near duplicates: words in a shingle, and the least similarity in percent.
SHINGLE, LEAST_PERCENT = 5, 80
#: Documents of which more than this share is benchmark text go; of the others the benchmark passages go.
MAX_COVERAGE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no rule of policy v1 rejects."""
    return quality.keep_good(docs, "v1")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that occur before are cut; documents with nothing left go."""
    return line_dedup.line_dedup(docs, drop_emptied=True)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return minhash.keep_one(docs, SHINGLE, LEAST_PERCENT)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut; documents that mostly consist of them go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), MAX_COVERAGE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    out = bpe.bpe_round_trip(docs, bpe.default_tokenizer())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_near),
    ("benchmark_decontamination", remove_benchmark),
    ("bpe_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, done = written(stage(spark, docs, sf_dir), name), before
        if done is not None:  # what the stage before wrote is of no more use
            discard(done)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Encoding by merge ranks has no SQL; the stages are tested against brute force.
ORACLE_SQL = None
