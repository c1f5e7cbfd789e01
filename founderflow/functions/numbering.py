"""Row numbers in an order, without bringing all rows, or all rows of a group, into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 1 << 16


def numbered(rows: DataFrame, name: str, within: list[str], coarse: list[tuple[Column, bool]], order: list[Column | str]) -> DataFrame:
    """Adds name, the row's number from 1 within its group, by the coarse values (each with: descending) and then by order.

    Rows are counted by coarse values first; a window over these counts gives where each range begins, and rows are
    numbered within their range only. So a task holds one range, or the counts of one group.
    """
    keys = [f"ff_range_{i}" for i in range(len(coarse))]
    ranged = rows.withColumns({k: value for k, (value, _) in zip(keys, coarse)})
    counts = ranged.groupBy(*within, *keys).agg(F.count(F.lit(1)).alias("ff_n"))
    along = [F.col(k).desc() if down else F.col(k).asc() for k, (_, down) in zip(keys, coarse)]
    before = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    start = F.sum("ff_n").over(before.orderBy(*along).rowsBetween(W.unboundedPreceding, 0)) - F.col("ff_n")
    starts = counts.select(*[F.col(c).alias(f"ff_of_{c}") for c in [*within, *keys]], start.alias("ff_start"))
    same = reduce(lambda a, b: a & b, (ranged[c].eqNullSafe(starts[f"ff_of_{c}"]) for c in [*within, *keys]))
    own = F.row_number().over(W.partitionBy(*within, *keys).orderBy(*order))
    return ranged.withColumn("ff_own", own).join(starts, same).select(*[ranged[c] for c in rows.columns if c != name], (F.col("ff_start") + F.col("ff_own")).cast("long").alias(name))


def runs(rows: DataFrame, value: str, position: str, name: str) -> DataFrame:
    """Adds name, the number of the contiguous run of equal values that a row is in, by position (unique), from 1."""
    block = F.floor(F.col(position) / BLOCK)
    inside = W.partitionBy("ff_block").orderBy(position)
    r = rows.withColumn("ff_block", block)
    r = r.withColumns({"ff_before": F.lag(value).over(inside), "ff_first": F.row_number().over(inside) == 1})
    r = r.withColumn("ff_new", F.when(~F.col("ff_first") & ~F.col("ff_before").eqNullSafe(F.col(value)), 1).otherwise(0))
    ends = r.groupBy("ff_block").agg(F.min_by(F.struct(value), position).alias("head"), F.max_by(F.struct(value), position).alias("tail"), F.sum("ff_new").alias("n"))
    along = W.partitionBy(F.lit(0)).orderBy("ff_block")  # a row a block of rows
    ends = ends.withColumn("opens", F.when(F.lag("tail").over(along).eqNullSafe(F.col("head")), 0).otherwise(1))
    ends = ends.select(F.col("ff_block").alias("ff_of"), (F.sum(F.col("n") + F.col("opens")).over(along) - F.col("n")).alias("ff_start"))
    run = F.col("ff_start") + F.sum("ff_new").over(inside.rowsBetween(W.unboundedPreceding, 0))
    return r.join(ends, F.col("ff_block") == F.col("ff_of")).select(*[r[c] for c in rows.columns], run.cast("long").alias(name))


def running(rows: DataFrame, flag: Column, position: str, name: str) -> DataFrame:
    """Adds name, how many rows up to this one, by position (unique), have the flag."""
    inside = W.partitionBy("ff_block").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    r = rows.withColumns({"ff_block": F.floor(F.col(position) / BLOCK), "ff_flag": F.when(flag, 1).otherwise(0)})
    ends = r.groupBy(F.col("ff_block").alias("ff_of")).agg(F.sum("ff_flag").alias("ff_n"))
    along = W.partitionBy(F.lit(0)).orderBy("ff_of").rowsBetween(W.unboundedPreceding, 0)  # a row a block of rows
    ends = ends.withColumn("ff_start", F.sum("ff_n").over(along) - F.col("ff_n"))
    own = r.withColumn("ff_own", F.sum("ff_flag").over(inside))
    return own.join(ends, F.col("ff_block") == F.col("ff_of")).select(*[own[c] for c in rows.columns], (F.col("ff_start") + F.col("ff_own")).cast("long").alias(name))


def copies(rows: DataFrame, n: Column, name: str, spread: bool = False) -> DataFrame:
    """Each row n times, numbered from 0; a large n is cut into blocks first, so no array is long. spread deals the blocks to tasks."""
    starts = F.sequence(F.lit(0).cast("long"), n - 1, F.lit(BLOCK).cast("long"))
    cut = rows.withColumn("ff_total", n.cast("long")).filter("ff_total > 0").withColumn("ff_from", F.explode(starts))
    if spread:
        cut = cut.repartition(*[F.col(f"`{c}`") for c in rows.columns], F.col("ff_from"))
    each = F.sequence(F.col("ff_from"), F.least(F.col("ff_from") + BLOCK, F.col("ff_total")) - 1)
    return cut.withColumn(name, F.explode(each)).drop("ff_total", "ff_from")
