"""Simulated barcodes: random parents, negative-binomial families, seeded mutation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASES = "ACGT"


def parents(spark: SparkSession, n: int, length: int, seed: int = 42) -> DataFrame:
    """(label, umi): n distinct random barcodes, reproducible by seed whatever the partitioning."""
    if n > 4**length:
        raise ValueError("there are not so many barcodes of that length")
    found, start, have = None, 0, 0
    while have < n:
        more = int((n - have) * 1.2) + 16
        digits = F.concat(*[F.sha2(F.concat_ws("|", F.lit(seed), "id", F.lit(k)), 256) for k in range(-(-length // 64))])
        fresh = spark.range(start, start + more).select("id", F.substring(F.translate(digits, "0123456789abcdef", BASES * 4), 1, length).alias("umi"))
        found = fresh if found is None else found.unionByName(fresh)
        start += more
        distinct = found.groupBy("umi").agg(F.min("id").alias("id"))
        have = distinct.count()
    picked = distinct.orderBy("id").limit(n)
    return picked.select((F.expr("row_number() over (order by id)") - 1).cast("long").alias("label"), "umi")


def reads(founders: DataFrame, error_rate: float, mean_children: float = 100, dispersion: float = 2.0, ratio: tuple[float, float, float] = (1, 1, 40), seed: int = 42) -> DataFrame:
    """(umi, parent_umi, parent_label, err) of every parent and its children; ratio: insertion, deletion, substitution.

    Each parent has a generator of its own, seeded by seed and label, so results do not depend on the partitioning.
    A family's size is negative binomial with the given mean and variance over mean; the parent itself is a read,
    marked sig if it has no child. Each base of a child changes with the error rate.
    """
    weights = np.array([3 * 4 * ratio[0], 12 * ratio[1], 4 * 3 * ratio[2]], float)
    weights = np.cumsum(weights / weights.sum())

    def mutate(rng: np.random.Generator, umi: str) -> tuple[str, str]:
        out, edits = [], []
        for i, base in enumerate(umi):
            new = base
            if rng.random() < error_rate:
                kind = int(np.searchsorted(weights, rng.random(), "right"))
                if kind == 0:
                    new = base + BASES[rng.integers(4)]
                elif kind == 1:
                    new = ""
                else:
                    new = BASES.replace(base, "")[rng.integers(3)] if base in BASES else BASES[rng.integers(4)]
                edits.append(f"{i}:{base}/{new}")
            out.append(new)
        return "".join(out), "_".join(edits)

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        variance = dispersion * mean_children
        p = mean_children / variance
        r = mean_children**2 / (variance - mean_children)
        for pdf in found:
            rows = []
            for label, umi in zip(pdf["label"], pdf["umi"]):
                rng = np.random.default_rng([seed, int(label)])
                n = int(rng.negative_binomial(r, p))
                rows.append((umi, umi, label, "" if n else "sig"))
                for _ in range(n):
                    child, err = mutate(rng, umi)
                    rows.append((child, umi, label, err))
            yield pd.DataFrame(rows, columns=["umi", "parent_umi", "parent_label", "err"])

    return founders.mapInPandas(run, "umi string, parent_umi string, parent_label long, err string")
