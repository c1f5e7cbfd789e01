"""Molecule estimates: knee plot, negative binomial, and the choice between them.

Rows are taken in descending order of reads. Rows of equal reads are interchangeable, so all work is done on the
histogram of reads; only the knee's angles are evaluated row by row, in parallel, from each histogram bar's start.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from founderflow.functions.numbering import copies
from founderflow.functions.sequences import angle_at

RECORD = "model string, knee_angle int, median_rpu long, rpu_cutoff long, estimated_molecules long, after_rpu_cutoff_molecules long"


def histogram(counts: DataFrame) -> DataFrame:
    """(n, rows, first, last, before) by descending reads; rows without reads do not count. As many rows as distinct n."""
    bars = counts.filter(F.col("n_reads") > 0).groupBy(F.col("n_reads").cast("long").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    order = W.orderBy(F.col("n").desc()).rowsBetween(W.unboundedPreceding, 0)
    last = F.sum("rows").over(order) - 1
    return bars.select("n", "rows", (last - F.col("rows") + 1).alias("first"), last.alias("last"), (F.sum(F.col("n") * F.col("rows")).over(order) - F.col("n") * F.col("rows")).alias("before"))


def weighted_median(bars: DataFrame) -> DataFrame:
    """One row, median_rpu: the middle of n copies of each n; the mean of two middles is cut to an integer."""
    everything = W.partitionBy(F.lit(0))
    b = bars.withColumn("total", F.sum(F.col("n") * F.col("rows")).over(everything))
    covers = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("n") * F.col("rows"))
    half = F.floor(F.col("total") / 2)
    middle = F.max(F.when(covers(half), F.col("n")))
    other = F.max(F.when(covers(half - 1), F.col("n")))
    return b.agg(F.when(F.max("total") % 2 == 1, middle).otherwise(F.floor((middle + other) / 2)).cast("long").alias("median_rpu"))


def moments(counts: DataFrame) -> DataFrame:
    """One row: rows, mean and sample variance of positive reads, and their median absolute deviation."""
    x = counts.filter(F.col("n_reads") > 0).select(F.col("n_reads").cast("double").alias("x"))
    mid = x.agg(F.median("x").alias("m"))
    dev = x.crossJoin(F.broadcast(mid)).agg(F.median(F.abs(F.col("x") - F.col("m"))).alias("mad"))
    return x.agg(F.count("x").alias("n_umis"), F.avg("x").alias("mean_rpu"), F.var_samp("x").alias("var_rpu")).crossJoin(F.broadcast(dev))


def knee_angles(bars: DataFrame) -> DataFrame:
    """(i, n, angle) of all rows but the last two: the rounded angle at (i / rows, share of reads so far)."""
    everything = W.partitionBy(F.lit(0))
    b = bars.withColumn("size", F.sum("rows").over(everything)).withColumn("total", F.sum(F.col("n") * F.col("rows")).over(everything))
    each = copies(b.select("n", "rows", "first", "before", "size", "total"), F.col("rows"), "k", spread=True)
    i = F.col("first") + F.col("k")
    x, y = i / F.col("size"), (F.col("before") + (F.col("k") + 1) * F.col("n")) / F.col("total")
    return each.select(i.alias("i"), "n", "size", F.floor(angle_at(1.0, 1.0, x, y, 0.0, 0.0) + 0.5).cast("int").alias("angle")).filter("i < size - 2")


def knee(counts: DataFrame) -> DataFrame:
    """The knee record. Up to two rows: all of them, angle 0, cutoff 1."""
    bars = histogram(counts)
    angles = knee_angles(bars)
    low = angles.groupBy("angle").agg(F.max("i").alias("i")).agg(F.min("angle").alias("low"), F.collect_list(F.struct("angle", "i")).alias("lasts"))  # 181 angles at most
    of = lambda a: F.expr(f"try_element_at(transform(filter(lasts, s -> s.angle = {a}), s -> s.i), 1)")
    chosen = low.select((F.col("low") + 1).alias("knee_angle"), F.coalesce(of("low + 1"), of("low")).alias("idx"))
    everything = W.partitionBy(F.lit(0))
    up = W.orderBy("n")
    b = bars.withColumn("size", F.sum("rows").over(everything)).withColumn("larger", F.lead("n").over(up)).withColumn("tail", F.first("rows").over(up))
    hit = b.crossJoin(F.broadcast(chosen)).filter("idx between first and last")
    bump = (F.col("n") == 1) & (F.col("idx") < F.floor((F.col("first") + F.col("last")) / 2)) & F.col("larger").isNotNull()
    cut = hit.select("knee_angle", F.when(bump, F.col("larger")).otherwise(F.col("n")).alias("rpu_cutoff"), F.when((F.col("idx") == F.col("size") - 2) & (F.col("tail") > 1), F.col("size")).otherwise(F.col("idx") + 1).alias("estimated_molecules"))
    size = bars.agg(F.sum("rows").alias("size"))
    after = bars.crossJoin(F.broadcast(cut.select("rpu_cutoff"))).agg(F.sum(F.when(F.col("n") >= F.col("rpu_cutoff"), F.col("rows")).otherwise(0)).alias("after"))
    one = size.crossJoin(weighted_median(bars)).crossJoin(after).join(cut, F.lit(True), "left")
    few = F.col("knee_angle").isNull()
    return one.filter("size > 0").select(F.lit("KP").alias("model"), F.when(few, 0).otherwise(F.col("knee_angle")).cast("int").alias("knee_angle"), "median_rpu", F.when(few, F.lit(1)).otherwise(F.col("rpu_cutoff")).cast("long").alias("rpu_cutoff"), F.when(few, F.col("size")).otherwise(F.col("estimated_molecules")).cast("long").alias("estimated_molecules"), F.when(few, F.col("size")).otherwise(F.col("after")).cast("long").alias("after_rpu_cutoff_molecules"))


def lower_quantile(r: float, p: float, q: float) -> int:
    """Largest k with P(X <= k) <= q for a negative binomial, 0 if there is none: quantiles are rounded outwards."""
    total, k, best = 0.0, 0, 0
    while True:
        total += math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(p) + k * math.log1p(-p))
        if total > q:
            return best
        best, k = k, k + 1


def negative_binomial(counts: DataFrame, prob: float = 0.001) -> DataFrame:
    """The negative-binomial record; degenerate and under-dispersed data keep all rows, with the smallest count as cutoff."""
    spark: SparkSession = counts.sparkSession
    bars = histogram(counts)
    s = bars.agg(F.sum("rows").alias("n"), F.sum(F.col("n") * F.col("rows")).alias("s"), F.min("n").alias("low")).first()
    if not s["n"]:
        return spark.createDataFrame([], RECORD)
    mean = s["s"] / s["n"]
    dev = bars.agg(F.sum((F.col("n") - mean) * (F.col("n") - mean) * F.col("rows"))).first()[0]
    var = dev / (s["n"] - 1) if s["n"] > 1 else 0.0
    cutoff = s["low"]
    if var > mean > 0:
        cutoff = max(1, lower_quantile(mean * mean / (var - mean), mean / var, prob / 2))
    size = bars.agg(F.sum(F.when(F.col("n") >= cutoff, F.col("rows")).otherwise(0)).alias("m"))
    return size.crossJoin(weighted_median(bars)).select(F.lit("NB").alias("model"), F.lit(None).cast("int").alias("knee_angle"), "median_rpu", F.lit(cutoff).cast("long").alias("rpu_cutoff"), F.col("m").cast("long").alias("estimated_molecules"), F.col("m").cast("long").alias("after_rpu_cutoff_molecules"))


def auto(counts: DataFrame, angle: int = 120, prob: float = 0.001) -> DataFrame:
    """The knee if it is sharp enough, the negative binomial otherwise."""
    first = knee(counts)
    got = first.first()
    if got is None or got["knee_angle"] <= angle:
        return first
    return negative_binomial(counts, prob)


def estimate(counts: DataFrame, model: str = "auto", angle: int = 120, prob: float = 0.001) -> DataFrame:
    return {"auto": lambda: auto(counts, angle, prob), "knee": lambda: knee(counts), "nb": lambda: negative_binomial(counts, prob)}[model]()


def as_lines(record: DataFrame) -> DataFrame:
    """The record as key and value rows, in the order of a report file."""
    return record.select(F.expr("""stack(5, concat(model, '_estimate'), 'ON', 'median_rpu', cast(median_rpu as string), 'rpu_cutoff', cast(rpu_cutoff as string),
        'estimated_molecules', cast(estimated_molecules as string), 'after_rpu-cutoff_molecules', cast(after_rpu_cutoff_molecules as string)) as (key, value)"""))
