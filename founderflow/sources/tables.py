"""Readers and writers: count tables, assignments, estimates, FASTA, simulations, benchmark facts; FASTQ is in fastq.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from founderflow.functions.numbering import numbered, running
from founderflow.sources.fastq import read_fastq, write_fastq  # noqa: F401

COUNT_SCHEMA = "group_id string, umi string, n_reads long"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 0, line) in file order: lines are counted by input split, and numbered from their split's start."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("file", "start").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")  # a row a split
    splits = splits.withColumn("before", before)
    return lines.join(splits, ["file", "start"]).select((F.col("id") - F.col("first") + F.col("before")).alias("line_no"), "line")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """A headerless count table in file order: group_id, umi, n_reads, input_pos from 1. Lines that don't parse are
    dropped; `malformed_lines` counts them."""
    parts = F.split(F.trim("line"), r"\s+")
    rows = numbered_lines(spark, path).select((F.col("line_no") + 1).alias("input_pos"), parts[0].alias("group_id"), F.get(parts, F.lit(1)).alias("umi"), F.get(parts, F.lit(2)).try_cast("long").alias("n_reads"))
    return rows.filter(F.col("umi").isNotNull() & F.col("n_reads").isNotNull()).select("group_id", "umi", "n_reads", "input_pos")


def malformed_lines(spark: SparkSession, path: str) -> int:
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter((F.size(parts) < 3) | F.get(parts, F.lit(2)).try_cast("long").isNull()).count()


def read_counts_unordered(spark: SparkSession, path: str) -> DataFrame:
    """For statistics, which need no order: the splittable tab-separated reader with a fixed schema."""
    return spark.read.csv(path, sep="\t", schema=COUNT_SCHEMA, mode="DROPMALFORMED")


def read_weights(counts: DataFrame) -> DataFrame:
    """Rows with reads; a row stands for n_reads reads of itself and is never multiplied."""
    return counts.filter(F.col("n_reads") > 0)


def write_assignments(clustered: DataFrame, path: str) -> None:
    clustered.select("group_id", "umi", "founder").write.csv(path, sep="\t", header=False)


def write_counts(counts: DataFrame, path: str) -> None:
    """Descending by reads; ties by group and barcode."""
    counts.select("group_id", "umi", "n_reads").orderBy(F.col("n_reads").desc(), "group_id", "umi").write.csv(path, sep="\t", header=False)


def write_estimate(record: DataFrame, path: str) -> None:
    from founderflow.operators.estimate import as_lines

    as_lines(record).coalesce(1).write.csv(path, sep="\t", header=False)  # five lines


def show_estimate(record: DataFrame) -> str:
    """The record as text; a knee also tells its angle."""
    row = record.first()
    lines = [(f"{row['model']}_estimate", "ON"), *([("knee_angle", row["knee_angle"])] if row["model"] == "KP" else []), ("median_rpu", row["median_rpu"]), ("rpu_cutoff", row["rpu_cutoff"]), ("estimated_molecules", row["estimated_molecules"]), ("after_rpu-cutoff_molecules", row["after_rpu_cutoff_molecules"])]
    return "\n".join(f"{k}\t{v}" for k, v in lines)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(record_id from 0, name, seq): a record begins with a line that begins with >, its sequence may span lines."""
    heads = F.col("line").startswith(">")
    lines = running(numbered_lines(spark, path), heads, "line_no", "record").filter("record > 0")
    body = F.array_sort(F.collect_list(F.when(~heads, F.struct("line_no", "line"))))
    records = lines.groupBy((F.col("record") - 1).alias("record_id")).agg(F.max(F.when(heads, F.substring("line", 2, 1 << 30))).alias("name"), body.alias("body"))
    return records.select("record_id", "name", F.regexp_replace(F.array_join(F.transform("body", lambda x: x["line"]), ""), r"\s", "").alias("seq"))


def write_fasta(records: DataFrame, path: str) -> None:
    records.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.text(path)


def write_simulation(reads: DataFrame, out_path: str, labels_path: str) -> None:
    """umi, parent and edits; and umi with its parent's number."""
    reads.select("umi", "parent_umi", "err").write.csv(out_path, sep="\t", header=False)
    reads.select("umi", "parent_label").write.csv(labels_path, sep=" ", header=False)


def read_facts(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | None = None) -> DataFrame:
    """Benchmark facts of one file or a glob, united by column; unreadable files are skipped."""
    reader = spark.read.option("header", True).option("sep", sep).option("ignoreCorruptFiles", True).option("nullValue", "NA")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_facts(facts: DataFrame, path: str, order: list[str]) -> None:
    facts.orderBy(*order).write.csv(path, header=True)


def read_sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """One row a sample and platform: condition, replicate, platform, links. Platforms are all other columns."""
    wide = spark.read.csv(path, header=True)
    platforms = [c for c in wide.columns if c not in ("condition", "replicate")]
    stacked = F.inline(F.array(*[F.struct(F.lit(p).alias("platform"), F.split(F.trim(F.col(f"`{p}`")), r"\s+").alias("links")) for p in platforms]))
    return wide.select("condition", F.col("replicate").cast("int").alias("replicate"), stacked)


def dense_labels(clustered: DataFrame) -> DataFrame:
    """Adds label, the founder's dense rank by group and barcode, from 0. Founders are ranked on their own table."""
    names = clustered.select("group_id", "founder").distinct()
    ranked = numbered(names, "label", [], [(F.col("group_id"), False), (F.substring("founder", 1, 6), False)], ["founder"])
    return clustered.join(ranked.withColumn("label", (F.col("label") - 1).cast("int")), ["group_id", "founder"])
