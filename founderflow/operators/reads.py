"""Reads and barcodes: extraction, counting, tagging and regrouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from founderflow.functions.sequences import sliced, tagged, untagged


def extract(r1: DataFrame, r2: DataFrame | None, range1: tuple[int, int] = (0, 0), range2: tuple[int, int] = (0, 0)) -> DataFrame:
    """Pairs the mates by read_id and cuts the barcode out of either or both; ranges are 1-based and inclusive.

    One row a read: read_id, umi, and for each mate name (with the barcode), seq and qual without the barcode.
    """
    def one(reads: DataFrame, k: int, start: int, end: int) -> DataFrame:
        umi, rest = sliced(F.col("seq"), start, end)
        _, qual = sliced(F.col("qual"), start, end)
        return reads.select("read_id", umi.alias(f"u{k}"), F.col("name").alias(f"name{k}"), rest.alias(f"seq{k}"), qual.alias(f"qual{k}"))

    out = one(r1, 1, *range1)
    if r2 is not None:
        out = out.join(one(r2, 2, *range2), "read_id")
    mates = (1, 2) if r2 is not None else (1,)
    out = out.withColumn("umi", F.concat(*[f"u{k}" for k in mates]))
    return out.select("read_id", "umi", *[c for k in mates for c in (tagged(F.col(f"name{k}"), F.col("umi")).alias(f"name{k}"), f"seq{k}", f"qual{k}")])


def count_barcodes(reads: DataFrame, group: str = "1") -> DataFrame:
    """The count table of one group; order it with clustering.with_positions."""
    return reads.groupBy("umi").agg(F.count(F.lit(1)).alias("n_reads")).select(F.lit(group).alias("group_id"), "umi", "n_reads")


def regroup(reads: DataFrame, assignments: DataFrame, by_group: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Tagged reads (name, seq, qual) renamed to their founder; reads of unknown barcodes drop out.

    By barcode alone, a barcode in several groups gives a row for each; with by_group, reads carry group_id.
    `keep` names columns of the reads that stay beside these.
    """
    name, umi = untagged(F.col("name"))
    own = reads.withColumns({"read_name": name, "umi": umi})
    keys = ["group_id", "umi"] if by_group else ["umi"]
    table = assignments.select("umi", "founder", *(["group_id"] if by_group else []))
    joined = own.join(table, keys)
    return joined.select(*keys, "founder", F.concat("read_name", F.lit("_"), "founder").alias("name"), "seq", "qual", *(keep or []))
