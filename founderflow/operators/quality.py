"""Clustering quality, label statistics and summaries of benchmark facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from founderflow.functions.numbering import copies
from founderflow.functions.sequences import edit_kinds, ratio, read_type


def scores(labels: DataFrame, truth: str = "truth", predicted: str = "predicted", weight: str | None = None) -> DataFrame:
    """One row: homogeneity, completeness, v_measure of two labelings, by read or by weighted row."""
    w = F.col(weight) if weight else F.lit(1)
    cells = labels.groupBy(F.col(truth).alias("c"), F.col(predicted).alias("k")).agg(F.sum(w).cast("double").alias("n"))
    cells = cells.withColumn("nc", F.sum("n").over(W.partitionBy("c"))).withColumn("nk", F.sum("n").over(W.partitionBy("k")))
    total = cells.agg(F.sum("n").alias("t"))
    plogp = lambda whole: F.sum(-(F.col("n") / F.col("t")) * F.ln(F.col(whole) / F.col("t")))
    given = lambda whole: F.sum(-(F.col("n") / F.col("t")) * F.ln(F.col("n") / F.col(whole)))
    h = cells.crossJoin(F.broadcast(total)).agg(plogp("nc").alias("hc"), plogp("nk").alias("hk"), given("nk").alias("hck"), given("nc").alias("hkc"))
    hom = F.when(F.abs("hc") < 1e-15, 1.0).otherwise(1 - F.col("hck") / F.col("hc"))
    com = F.when(F.abs("hk") < 1e-15, 1.0).otherwise(1 - F.col("hkc") / F.col("hk"))
    v = F.when(F.col("h") + F.col("c") == 0, 0.0).otherwise(2 * F.col("h") * F.col("c") / (F.col("h") + F.col("c")))
    return h.select(hom.alias("h"), com.alias("c")).select(F.col("h").alias("homogeneity"), F.col("c").alias("completeness"), v.alias("v_measure"))


def scores_of_files(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(umi, label) of each read on both sides, paired by order within a barcode; different sizes score 0."""
    order = lambda t, name: t.select("umi", F.col("label").alias(name), F.row_number().over(W.partitionBy("umi").orderBy("label")).alias("i"))
    if truth.count() != predicted.count():
        return truth.sparkSession.createDataFrame([(0.0, 0.0, 0.0)], "homogeneity double, completeness double, v_measure double")
    return scores(order(truth, "truth").join(order(predicted, "predicted"), ["umi", "i"]))


def per_read(clustered: DataFrame) -> DataFrame:
    """(umi, label) once a read, from rows with a label and n_reads."""
    return copies(clustered.select("umi", "label", "n_reads"), F.col("n_reads"), "copy").select("umi", "label")


def cluster_count(clustered: DataFrame, by: list[str]) -> DataFrame:
    """(by, clusters): distinct founders."""
    return clustered.groupBy(*by).agg(F.countDistinct("founder").alias("clusters"))


def children(labels: DataFrame) -> DataFrame:
    """One row: mean and integer-cut sample variance of rows a label."""
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.avg("n").alias("mean_children"), F.floor(F.var_samp("n")).cast("long").alias("variance_children"))


def edit_totals(reads: DataFrame) -> DataFrame:
    """One row: reads with edits, with substitutions only, with insertions or deletions; edited bases by kind; ratio."""
    k = reads.select(edit_kinds(F.col("err")).alias("k")).select("k.*")
    indel = F.col("ins") + F.col("del")
    n = lambda test: F.sum(F.when(test, 1).otherwise(0)).alias
    out = k.agg(n(indel + F.col("sub") > 0)("edited"), n((indel == 0) & (F.col("sub") > 0))("substitution_only"), n(indel > 0)("with_indel"), F.sum("ins").alias("ins"), F.sum("del").alias("del"), F.sum("sub").alias("sub"))
    return out.withColumn("ratio", ratio(F.col("ins"), F.col("del"), F.col("sub")))


def summary(facts: DataFrame, value: str = "V-measure") -> DataFrame:
    """Mean, sample deviation and count by tool, read type and number of founders, rounded to 4 places."""
    f = facts.withColumn("read_type", read_type(F.col("umi_len")))
    v = F.col(f"`{value}`")
    return f.groupBy("tool", "read_type", "num_founder").agg(F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("std"), F.count(v).alias("n"))


def error_bars(facts: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(f"`{value}`")
    return facts.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), (3 * F.stddev_samp(v) / F.sqrt(F.count(v))).alias("three_se"))


def features(counts: DataFrame, value: str) -> DataFrame:
    """(tools, feature, log10 of the value) of rows of at least 1; a feature is platform, condition, replicate, clonotype."""
    key = F.concat_ws("_", "platform", "condition", F.col("replicate").cast("string"), "clonotype")
    v = F.col(f"`{value}`")
    return counts.filter(v >= 1).select("tools", key.alias("feature"), F.log10(v).alias("value"))


def pivoted(table: DataFrame, tools: list[str] | None = None) -> DataFrame:
    """Features by tools; name the tools to spare the pass that finds them."""
    return table.groupBy("feature").pivot("tools", tools).agg(F.first("value"))


def correlations(table: DataFrame) -> DataFrame:
    """Pearson correlation of each two tools over their common features."""
    a = table.select(F.col("tools").alias("tool_a"), "feature", F.col("value").alias("va"))
    b = table.select(F.col("tools").alias("tool_b"), "feature", F.col("value").alias("vb"))
    return a.join(b, "feature").groupBy("tool_a", "tool_b").agg(F.corr("va", "vb").alias("r"))


def unique_barcodes(counts: DataFrame) -> DataFrame:
    """One row: distinct barcodes, rows with reads, and the longest barcode."""
    return counts.agg(F.countDistinct("umi").alias("n_unique"), F.sum(F.when(F.col("n_reads") > 0, 1).otherwise(0)).cast("long").alias("n_with_reads"), F.max(F.length("umi")).alias("longest"))
