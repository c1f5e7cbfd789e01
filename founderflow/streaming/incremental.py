"""Barcodes as a stream: running counts, and founders assigned in order of arrival (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from founderflow.functions.numbering import BLOCK, numbered
from founderflow.operators.clustering import TAIL, later_founders
from founderflow.plans.storage import exists, forget, materialise

PLACES = 1 << 40  # of a micro-batch
FOUNDERS = "group_id string, umi string, input_pos long"
ASSIGNED = "group_id string, umi string, founder string, dist int, is_founder boolean, input_pos long"


def count_stream(spark: SparkSession, path: str) -> DataFrame:
    """Running reads of each barcode from count files that arrive in a folder; use complete or update mode."""
    rows = spark.readStream.schema("group_id string, umi string, n_reads long").option("sep", "\t").csv(path)
    return rows.groupBy("group_id", "umi").agg(F.sum("n_reads").alias("n_reads"))


def founders_stream(rows: DataFrame, store: str, order: str, d: int = 1, tail: int = TAIL) -> DataStreamWriter:
    """A writer that assigns each row of a stream to its nearest founder among those that came before it.

    rows: group_id, umi and a number `order`, by which the rows of a micro-batch come; ties go by barcode. `store` is a
    folder that all tasks share: founders(store) is the state, assigned(store) the results. The rows of a batch are
    joined with the founders known by then, and those that meet none are settled among themselves as clustering does.
    So results are those of a batch run on all rows in the same order, whatever the batches; no group is in one task,
    and what a batch costs grows with its rows and the founders, not with the rows that came before.

    A batch that is run again after a failure replaces what it wrote: it reads the founders of earlier batches only.
    An empty batch writes nothing. Rows without a group or barcode are dropped. Barcodes without a 6-mer of A, C, G, T
    are founders, each time they come.
    """

    def settle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = batch.select("group_id", "umi", F.col(order).alias("at")).filter("group_id is not null and umi is not null")
        placed = numbered(materialise(own), "place", ["group_id"], [(F.floor(F.col("at") / BLOCK), False)], ["at", "umi"])
        new = materialise(placed.select("group_id", "umi", (F.lit(batch_id * PLACES) + F.col("place")).alias("input_pos")))
        if new.isEmpty():
            return
        known = founders(spark, store).filter(F.col("input_pos") < batch_id * PLACES)
        fresh, near = later_founders(new, known, d, tail)
        fresh = materialise(new.join(fresh, ["group_id", "input_pos"], "left_semi"))
        names = known.unionByName(fresh).select("group_id", F.col("input_pos").alias("b_pos"), F.col("umi").alias("founder"))
        best = near.groupBy("group_id", "a_pos").agg(F.min(F.struct("dist", "b_pos")).alias("x")).select("group_id", F.col("a_pos").alias("input_pos"), "x.*").join(names, ["group_id", "b_pos"])
        met = new.join(best, ["group_id", "input_pos"]).select("group_id", "umi", "founder", F.col("dist").cast("int").alias("dist"), F.lit(False).alias("is_founder"), "input_pos")
        first = fresh.select("group_id", "umi", F.col("umi").alias("founder"), F.lit(0).alias("dist"), F.lit(True).alias("is_founder"), "input_pos")
        met.unionByName(first).write.mode("overwrite").parquet(f"{store}/assigned/batch={batch_id}")
        fresh.write.mode("overwrite").parquet(f"{store}/founders/batch={batch_id}")
        forget(new, fresh)

    return rows.writeStream.foreachBatch(settle).option("checkpointLocation", f"{store}/progress")


def founders(spark: SparkSession, store: str) -> DataFrame:
    """All founders of a stream so far; input_pos is in order of arrival."""
    return _stored(spark, f"{store}/founders", FOUNDERS)


def assigned(spark: SparkSession, store: str) -> DataFrame:
    """A row for each row that came: its founder and the distance."""
    return _stored(spark, f"{store}/assigned", ASSIGNED)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*[c.split()[0] for c in schema.split(", ")])
