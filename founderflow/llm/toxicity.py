"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, word pairs and pairs one word apart, each present or
not. Weights are learned by follow-the-regularised-leader with per-coordinate rates; the L1 term keeps most
weights at exactly zero, so what is broadcast is a short sorted list, of 2**bits entries at most.

The training rows are a bounded sample: at most `most_rows` labelled rows, those with the smallest keyed hash of
their id, and of these as many as have features of `most_bytes` in all. All texts are scored, whole, in slices of some megabytes.

Defined results: null or empty texts score by the bias alone; labels that are null or not 0 or 1 are not learned
from; repeated labels of a document count as repeated rows; without any labelled row all scores are 0.5 and
nothing is rejected; an empty table gives no rows; extra columns pass through, and if one has the score's name that
gets an underscore at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BITS = 20
U64 = np.uint64
BIAS = 0


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature indices of each text (flat) and their offsets; index 0 is the bias, in every text."""
    words, at = common.hashed_words(texts, common.is_not_word, "unicode")
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    pair, pair_doc, _ = common.ngrams(words, at, 2)
    with np.errstate(over="ignore"):
        skip = common.mix(words[:-2] * U64(3) + common.mix(words[2:])) if len(words) > 2 else np.zeros(0, U64)
    near = np.flatnonzero(doc[:-2] == doc[2:]) if len(words) > 2 else np.zeros(0, np.int64)
    hashes = np.concatenate([words, pair, skip[near]])
    docs = np.concatenate([doc, pair_doc, doc[near]]).astype(np.int64)
    index = (hashes >> U64(64 - bits)).astype(np.int64)
    index[index == BIAS] = 1
    keys = np.unique(np.concatenate([(docs << 32) | index, np.arange(n, dtype=np.int64) << 32]))
    return (keys & 0xFFFFFFFF).astype(np.int64), np.searchsorted(keys, np.arange(n + 1, dtype=np.int64) << 32)


class Ftrl:
    """FTRL-proximal with per-coordinate rates alpha / (beta + sqrt(sum of squared gradients))."""

    def __init__(self, bits: int = BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, index: np.ndarray) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, index: np.ndarray, label: int) -> None:
        w = self.weights(index)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        index = np.flatnonzero(np.abs(self.z) > self.l1)
        return index, self.weights(index)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = 20_000, most_bytes: int = 400 << 20, epochs: int = 10, bits: int = BITS, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights (indices, values) from a bounded sample of labelled rows; their features are cut out on executors."""
    known = labels.select(F.col("doc_id").alias("ff_id"), F.col(label).cast("int").alias("ff_y")).filter(F.col("ff_y").isin(0, 1) & F.col("ff_id").isNotNull())
    picked = known.withColumn("ff_key", F.xxhash64(F.lit(17), F.col("ff_id"))).orderBy("ff_key", "ff_id", "ff_y").limit(most_rows)
    picked = F.broadcast(picked)  # most_rows ids at most
    rows = docs.select("doc_id", text).join(picked, docs["doc_id"] == picked["ff_id"]).select("ff_y", "ff_key", F.col(text).alias("ff_text"))

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts = batch.column(2)
            for start, n in common.batches(texts):
                index, at = features(texts.slice(start, n), bits)
                blobs = [index[at[i]:at[i + 1]].astype(np.uint32).tobytes() for i in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), batch.column(1).slice(start, n), pa.array(blobs, pa.binary())], ["y", "key", "f"])

    def learn(table: pa.Table) -> pa.Table:
        order = table.select(["key", "y"]).append_column("i", pa.array(np.arange(len(table)))).sort_by([("key", "ascending"), ("y", "ascending")]).column("i").to_numpy()
        labels, blobs = table.column("y").to_numpy(), table.column("f").combine_chunks()
        _, at, data = blobs.buffers()
        at = np.frombuffer(at, np.int32, len(blobs) + 1, blobs.offset * 4) // 4
        flat = np.frombuffer(data, np.uint32)  # views only: the sample is held once
        model = Ftrl(bits)
        for _ in range(epochs):
            for i in order:
                model.learn(flat[at[i]:at[i + 1]], int(labels[i]))
        index, value = model.sparse()
        return pa.table({"i": pa.array(index, pa.int64()), "w": pa.array(value, pa.float64())})

    # One task learns, as the method is sequential: most_rows rows and most_bytes at most reach it. Sizes alone are summed in order.
    held = common.materialise(rows.mapInArrow(common.lean(cut), "y int, key long, f binary").withColumns({"i": F.monotonically_increasing_id(), "n": F.length("f")}))
    upto = F.sum("n").over(W.orderBy("key", "y", "i").rowsBetween(W.unboundedPreceding, 0))
    within = held.select("key", "y", "i", "n").withColumn("upto", upto).filter(F.col("upto") <= most_bytes).select("i")
    cut_rows = held.join(within, "i").select("y", "key", "f")
    got = cut_rows.groupBy(F.lit(0).alias("all")).applyInArrow(learn, "i long, w double").toPandas()  # 2**bits rows at most
    common.forget(held)
    order = np.argsort(got["i"].to_numpy(np.int64))
    return got["i"].to_numpy(np.int64)[order], got["w"].to_numpy(np.float64)[order]


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], bits: int = BITS, text: str = "text", name: str = "score") -> DataFrame:
    """docs plus the score of each whole text; a map over rows, without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((weights[0].astype(np.int32), weights[1].astype(np.float32)))
    names, column = docs.columns, docs.columns.index(text)
    name = common.fresh(docs, name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, value = sent.value
        dense = np.zeros(1 << bits, np.float32)
        dense[index] = value
        for batch in found:
            for start, n in common.batches(batch.column(column)):
                part = batch.slice(start, n)
                f, at = features(part.column(column), bits)
                total = np.add.reduceat(dense[f].astype(np.float64), at[:-1]) if n else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))], [*names, name])

    return docs.mapInArrow(common.lean(run), schema)


def model_for(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights for the tables in sf_dir: only rows whose fold is not the held-out one are learned from."""
    docs = common.table(spark, sf_dir, "documents") if docs is None else docs
    labels = common.table(spark, sf_dir, "labels").filter(common.fold("doc_id", 3) != 1)
    return train(docs, labels)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, model_for(spark, sf_dir))
    return scored.select("doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
