"""Founder election and assignment.

Within a group, rows are taken in input order: a row without an earlier founder within d (and a common 6-mer) is a
founder, any other row goes to its nearest founder, ties to the earliest. Rows below the read cutoff are never
founders; they go to the nearest founder of their group wherever it stands, or stay by themselves.

Election is the lexicographically first maximal independent set of the graph of similar pairs. It runs in rounds
over DataFrames: a row without an undecided or founding earlier neighbour is a founder, a row next to a founder is
not. Rounds are few, as chains of undecided rows are short. Once no more than `tail` edges are left, each group's
rest is settled in one task, in order, over integers.

Greedy mode takes the rows that may be founders in batches of `pool`. The first `head` rows of a batch go in order; each other
row goes to the nearest founder known by then, and only if there is none to the nearest of those founded since. A row
has a founder within d among the earlier ones or not, whichever way it asks: so founders are the same in both modes, and greedy mode only
prefers those that stand at its batch's limit or before. No batch waits for another, and no group is in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from founderflow.functions.numbering import BLOCK, numbered, runs
from founderflow.functions.sequences import K, truncated
from founderflow.operators.similarity import overhang_pairs, similar_pairs
from founderflow.plans.storage import forget, materialise

TAIL = 2_000_000


def with_positions(counts: DataFrame) -> DataFrame:
    """input_pos for a count table without one: most reads first, then by barcode, within each group."""
    return numbered(counts, "input_pos", ["group_id"], [(F.col("n_reads"), True), (F.substring("umi", 1, K), False)], ["umi"])


def with_runs(rows: DataFrame) -> DataFrame:
    """group_id made unique to each contiguous run of rows, for inputs in which an id may come back later."""
    marked = runs(rows, "group_id", "input_pos", "run")
    return marked.withColumn("group_id", F.concat_ws("\x1f", "group_id", F.col("run").cast("string"))).drop("run")


def elect(rows: DataFrame, edges: DataFrame, tail: int = TAIL) -> DataFrame:
    """(group_id, input_pos) of all founders among rows, from edges (group_id, a_pos, b_pos), a after b."""
    row = ["group_id", "input_pos"]
    found = rows.select(*row).join(edges.select("group_id", F.col("a_pos").alias("input_pos")), row, "left_anti")
    left = edges.select("group_id", "a_pos", "b_pos")
    written: list[DataFrame] = []
    while True:
        fresh = found.select("group_id", F.col("input_pos").alias("b_pos"))
        if left.count() <= tail:
            def settle(key: tuple, t: pa.Table) -> pa.Table:
                near: dict[int, list[int]] = {}
                for a, b in zip(t.column("a_pos").to_pylist(), t.column("b_pos").to_pylist()):
                    near.setdefault(a, []).append(b)
                is_founder: dict[int, bool] = {}
                for a in sorted(near):
                    is_founder[a] = not any(is_founder.get(b, True) for b in near[a])
                chosen = [a for a, yes in is_founder.items() if yes]
                return pa.table([pa.array([key[0].as_py()] * len(chosen), pa.string()), pa.array(chosen, pa.int64())], ["group_id", "input_pos"])

            # A neighbour that is not itself an a row here was settled before, as a founder: children's edges are gone.
            rest = left.groupBy("group_id").applyInArrow(settle, "group_id string, input_pos long")
            return found.unionByName(rest)
        child = left.join(fresh, ["group_id", "b_pos"], "left_semi").select("group_id", "a_pos").distinct()
        undecided = left.join(child, ["group_id", "a_pos"], "left_anti")
        after = undecided.join(child.select("group_id", F.col("a_pos").alias("b_pos")), ["group_id", "b_pos"], "left_anti").select("group_id", "a_pos", "b_pos")
        rows_left = undecided.select("group_id", "a_pos").distinct()
        free = rows_left.join(after.select("group_id", "a_pos").distinct(), ["group_id", "a_pos"], "left_anti")
        found, left = materialise(found.unionByName(free.select("group_id", F.col("a_pos").alias("input_pos")))), materialise(after)
        forget(*written)
        written = [found, left]


def _split(rows: DataFrame, head_rows: int, head_share: float) -> tuple[DataFrame, DataFrame]:
    """The first part of each group by position, and the rest; groups up to head_rows are all in the first part."""
    cut = F.when(F.count(F.lit(1)) <= head_rows, F.max("input_pos")).otherwise(F.percentile_approx("input_pos", head_share, 1000))
    marked = rows.join(rows.groupBy("group_id").agg(cut.alias("cut")), "group_id")
    return (marked.filter(F.col("input_pos") <= F.col("cut")).drop("cut"), marked.filter(F.col("input_pos") > F.col("cut")).drop("cut"))


def later_founders(rest: DataFrame, known: DataFrame, d: int, tail: int = TAIL, similar_pairs: Callable = similar_pairs) -> tuple[DataFrame, DataFrame]:
    """Founders (group_id, input_pos) among `rest`, all of which comes after the founders `known`, and the pairs of its rows and earlier founders."""
    row = ["group_id", "input_pos"]
    met = materialise(similar_pairs(rest, known, d))
    left = materialise(rest.join(met.select("group_id", F.col("a_pos").alias("input_pos")), row, "left_anti"))
    edges = materialise(similar_pairs(left, left, d))
    second = materialise(elect(left, edges, tail))
    late = similar_pairs(rest, left.join(second, row, "left_semi"), d)
    return second, met.unionByName(late)


def _founders(high: DataFrame, d: int, tail: int, head_rows: int, head_share: float, similar_pairs: Callable = similar_pairs) -> tuple[DataFrame, DataFrame]:
    """Founders (group_id, input_pos) of high, and all pairs of a row and an earlier founder.

    Most founders stand at the head of a group. The head is settled by itself; the others meet the head's founders
    only, and what they leave unmatched is settled among itself. So pairs of two children are never formed but in
    the head, and comparisons grow with rows times founders, not with rows squared.
    """
    row = ["group_id", "input_pos"]
    as_b = lambda f: f.select("group_id", F.col("input_pos").alias("b_pos"))
    head, rest = _split(high, head_rows, head_share)
    head, rest = materialise(head), materialise(rest)
    edges = materialise(similar_pairs(head, head, d))
    first = materialise(elect(head, edges, tail))
    near = edges.join(as_b(first), ["group_id", "b_pos"], "left_semi")
    if rest.isEmpty():
        return first, near
    second, later = later_founders(rest, head.join(first, row, "left_semi"), d, tail, similar_pairs)
    return first.unionByName(second), near.unionByName(later)


def _limits(high: DataFrame, pool: int, head: int) -> DataFrame:
    """(group_id, a_pos, limit) of the rows that greedy mode does not take in order: the last row known to them."""
    k = numbered(high.select("group_id", "input_pos"), "ff_k", ["group_id"], [(F.floor(F.col("input_pos") / BLOCK), False)], ["input_pos"]).withColumn("ff_k", F.col("ff_k") - 1)
    waiting = k.filter(F.col("ff_k") % pool >= head).select("group_id", F.col("input_pos").alias("a_pos"), F.floor(F.col("ff_k") / pool).alias("ff_batch"))
    last = k.filter((F.col("ff_k") + (1 - head)) % pool == 0).select("group_id", F.floor((F.col("ff_k") + (1 - head)) / pool).alias("ff_batch"), F.col("input_pos").alias("limit"))
    return waiting.join(last, ["group_id", "ff_batch"], "left").select("group_id", "a_pos", "limit")


def cluster(rows: DataFrame, d: int = 1, min_reads: int = 1, max_length: int | None = None, tail: int = TAIL, head_rows: int = 5_000, head_share: float = 0.05, greedy: tuple[int, int] | None = None, overhang: bool = False) -> DataFrame:
    """rows: group_id, umi, n_reads, input_pos (unique within a group). One row each: its founder and the distance.

    greedy: (pool, head). overhang: the distance of the padded barcode to the nearest part of the padded founder."""
    pairs = overhang_pairs if overhang else similar_pairs
    rows = rows.select("group_id", "umi", F.col("n_reads").cast("long").alias("n_reads"), F.col("input_pos").cast("long").alias("input_pos"))
    if max_length is not None:
        rows = rows.withColumn("umi", truncated(F.col("umi"), max_length))
    high = rows.filter(F.col("n_reads") >= min_reads)
    founders, near = _founders(high, d, tail, head_rows, head_share, pairs)
    if min_reads > 1:
        chosen = rows.join(founders, ["group_id", "input_pos"], "left_semi")
        near = near.unionByName(pairs(rows.filter(F.col("n_reads") < min_reads), chosen, d, ordered=False))
    late = F.lit(False)
    if greedy:
        near = near.join(_limits(high, *greedy), ["group_id", "a_pos"], "left")
        late = F.coalesce(F.col("b_pos") > F.col("limit"), late)
    best = near.groupBy("group_id", "a_pos").agg(F.min(F.struct(late.alias("late"), "dist", "b_pos")).alias("best"))
    best = best.select("group_id", F.col("a_pos").alias("input_pos"), F.col("best.b_pos").alias("founder_pos"), F.col("best.dist").alias("dist"))
    names = rows.select("group_id", F.col("input_pos").alias("founder_pos"), F.col("umi").alias("founder"))
    marked = founders.withColumn("is_founder", F.lit(True))
    out = rows.join(best, ["group_id", "input_pos"], "left").join(marked, ["group_id", "input_pos"], "left")
    own = F.col("founder_pos").isNull() | F.coalesce("is_founder", F.lit(False))
    out = out.withColumns({"founder_pos": F.when(own, F.col("input_pos")).otherwise(F.col("founder_pos")), "dist": F.when(own, F.lit(0)).otherwise(F.col("dist"))})
    return out.join(names, ["group_id", "founder_pos"]).select("group_id", "input_pos", "umi", "n_reads", "founder", "founder_pos", "dist", F.coalesce("is_founder", F.lit(False)).alias("is_founder"))


def founder_counts(clustered: DataFrame) -> DataFrame:
    """The updated count table: reads summed on founders, absorbed rows kept with 0."""
    sums = clustered.groupBy("group_id", F.col("founder_pos").alias("input_pos")).agg(F.sum("n_reads").alias("total"))
    return clustered.join(sums, ["group_id", "input_pos"], "left").select("group_id", "umi", F.coalesce("total", F.lit(0)).cast("long").alias("n_reads"))
