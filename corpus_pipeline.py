"""The corpus pipeline: five stages over documents, each calling one of the training-data operators.

Toxic documents go, one document of each group of near-duplicates stays, documents with passages of the benchmark
go, personal data is replaced, and the rest is mixed to target weights: the last stage returns a row for each
draw, with its output shard, its place there and the number of words taken. Each stage reads what its predecessor
kept; between stages tables are written to the shared folder, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from founderflow.llm import common, decontamination, mixing, neardup, pii, toxicity

ORACLE_SQL = None  # trained scores, signatures and alignments: tested against brute force instead
REJECT = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = common.fresh(docs, "toxicity")
    scored = toxicity.score(docs, toxicity.model_for(spark, sf_dir, docs), name=name)
    return scored.filter(F.col(name) < REJECT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.survivors(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.anonymise(docs, pii.query_key(spark)).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = common.table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.materialise(docs)
            if written is not None:
                common.forget(written)  # its successor is written
            written = docs
    return docs
