"""The whole run on files: estimate, cluster, recount, estimate again."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from founderflow.functions.sequences import distance_bound
from founderflow.operators import clustering, estimate
from founderflow.plans.storage import materialise
from founderflow.sources import tables


def correct(counts: DataFrame, max_length: int, distance: int = 1, error_rate: float | None = None, model: str = "auto", angle: int = 120, prob: float = 0.001, min_reads: int | None = None, greedy: bool = False, pool: int = 48_000, head: int = 1_000, strict_runs: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assignments, updated counts, estimate) of a count table with input_pos.

    The read cutoff for founders comes from the model on the input unless min_reads is given.
    """
    d = distance if error_rate is None else distance_bound(max_length, error_rate)
    rows = clustering.with_runs(counts) if strict_runs else counts
    if min_reads is None:
        got = estimate.estimate(counts, model, angle, prob).first()
        min_reads = int(got["rpu_cutoff"]) if got else 1
    assigned = materialise(clustering.cluster(rows, d, min_reads, max_length, greedy=(pool, head) if greedy else None))
    if strict_runs:
        assigned = assigned.withColumn("group_id", F.substring_index("group_id", "\x1f", 1))
    counted = materialise(clustering.founder_counts(assigned))
    return assigned, counted, estimate.estimate(counted, model, angle, prob)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="founderflow", description="Corrects molecular barcodes and estimates molecules.")
    p.add_argument("-i", "--in", dest="input", required=True)
    p.add_argument("-o", "--out", dest="output")
    p.add_argument("-l", "--maxL", type=int)
    p.add_argument("-m", "--minC", type=int)
    p.add_argument("-e", "--errorR", type=float)
    p.add_argument("-f", "--minF", type=int)
    p.add_argument("-n", "--nb", action="store_true")
    p.add_argument("-k", "--kp", action="store_true")
    p.add_argument("-a", "--auto", action="store_true")
    p.add_argument("-j", "--just", action="store_true")
    p.add_argument("-q", "--prob", type=float, default=0.001)
    p.add_argument("-b", "--angle", type=int, default=120)
    p.add_argument("-g", "--greedy", action="store_true")
    p.add_argument("-t", "--thread", type=int, default=10)
    p.add_argument("-p", "--pool", type=int, default=48_000)
    p.add_argument("-d", "--prod", type=int, default=1_000)
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.maxL is None and not a.just:
        p.error("-l is needed unless -j is given")
    if a.minC is not None and a.errorR is not None:
        p.error("-m and -e exclude each other")
    if a.minC is not None and a.minC < 0 or a.errorR is not None and not 0 < a.errorR <= 1 or (a.maxL or 0) < 0:
        p.error("a length or distance is negative, or the error rate isn't in (0, 1]")
    if a.nb and a.kp or a.thread < 2 or a.pool < 1 or a.prod < 1:
        p.error("-n and -k exclude each other; -t is 2 at least, -p and -d 1")
    spark = SparkSession.builder.appName("founderflow").getOrCreate()
    model = "nb" if a.nb else "knee" if a.kp else "auto"
    if a.just:
        print(tables.show_estimate(estimate.estimate(tables.read_counts_unordered(spark, a.input), model, a.angle, a.prob)))
        return 0
    out = a.output or f"{a.input}.UMI.clustered"
    assigned, counted, record = correct(tables.read_counts(spark, a.input), a.maxL, 1 if a.minC is None else a.minC, a.errorR, model, a.angle, a.prob, a.minF, a.greedy, a.pool, a.prod)
    tables.write_assignments(assigned, out)
    tables.write_counts(counted, f"{out}.umi.reads.count")
    tables.write_estimate(record, f"{out}.estimate")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
