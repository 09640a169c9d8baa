"""A corpus pipeline of five stages: toxic documents go, one of each group of near copies stays, benchmark passages go,
sources are mixed to their weights, and the rest is written as token ids.

Each stage takes the documents that the one before kept (columns of `documents`) and the folder of the tables; the last
returns (doc_id, start, n_tokens, ids_crc32) a written document, in the files' terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontaminate, jaccard, mixing, tokens, toxicity
from sparkloom.llm.common import staged, unstage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles and a similarity of 0.8, as for every near-duplicate stage without another contract."""
    return jaccard.keep_one_per_component(docs, k=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.token_report(docs)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_benchmark), ("mixing", mix), ("token_ids", write_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again as the next one's documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"stage-{name}")
            if before is not None:  # nothing reads it any more
                unstage(before)
            before = docs
    return docs


#: The learned score and the frames' order can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
