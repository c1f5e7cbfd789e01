"""Clustering against the serial model, a plain-Python definition and hand-made cases."""

import random

import models
import pytest
from pyspark.sql import functions as F

from founderflow.operators import clustering
from founderflow.operators.similarity import similar_pairs

SCHEMA = "group_id string, umi string, n_reads long, input_pos long"


def simulated(seed, parents=25, length=14, groups=2):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        seen = {}
        for _ in range(parents):
            p = "".join(rng.choice("ACGT") for _ in range(length))
            seen[p] = seen.get(p, 0) + rng.randint(10, 40)
            for _ in range(rng.randint(0, 8)):
                u = list(p)
                for _ in range(rng.choice([1, 1, 1, 2])):
                    k, at = rng.randint(0, 2), rng.randrange(len(u))
                    if k == 0:
                        u[at] = rng.choice("ACGTN")
                    elif k == 1:
                        del u[at]
                    else:
                        u.insert(at, rng.choice("ACGT"))
                u = "".join(u)
                seen[u] = seen.get(u, 0) + rng.randint(1, 4)
        order = sorted(seen.items(), key=lambda x: (-x[1], x[0]))
        rows += [(f"g{g}", u, n, i + 1) for i, (u, n) in enumerate(order)]
    return rows


@pytest.mark.parametrize("d,min_reads,tail,head", [(1, 1, 10**9, 10**6), (2, 1, 10**9, 10), (2, 3, 10**9, 10), (2, 1, 0, 10**6), (3, 1, 10**9, 10)])
def test_relational_equals_serial(spark, d, min_reads, tail, head):
    rows = simulated(d * 10 + min_reads)
    got = {(r.group_id, r.input_pos): (r.founder_pos, r.dist, r.is_founder) for r in clustering.cluster(spark.createDataFrame(rows, SCHEMA), d, min_reads, tail=tail, head_rows=head, head_share=0.2).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for pos, founder, dist, is_founder in models.serial([(u, n, i) for h, u, n, i in rows if h == g], d, min_reads):
            want[g, pos] = (founder, dist, is_founder)
    assert got == want


@pytest.mark.parametrize("d", [0, 1, 2, 3, 6])
def test_pairs_equal_brute_force(spark, d):
    rows = simulated(d + 77, parents=12, length=9, groups=1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.a_pos, r.b_pos, r.dist) for r in similar_pairs(df, df, d).collect()}
    want = set()
    for _, a, _, i in rows:
        for _, b, _, j in rows:
            if i > j and models._grams(a) & models._grams(b) and (x := models.within(a, b, d)) >= 0:
                want.add((i, j, x))
    assert got == want


def test_hand_made(spark):
    rows = [("a", "ACGTA", 9, 1), ("a", "ACGTA", 8, 2), ("a", "AANAANAANAAN", 7, 3), ("a", "AANAANAANAAN", 6, 4), ("a", "ACGTACGT", 5, 5), ("a", "ACGTACGT", 4, 6), ("b", "ACGTACGT", 1, 1)]
    got = {(r.group_id, r.input_pos): r.founder_pos for r in clustering.cluster(spark.createDataFrame(rows, SCHEMA), 1).collect()}
    assert got == {("a", 1): 1, ("a", 2): 2, ("a", 3): 3, ("a", 4): 4, ("a", 5): 5, ("a", 6): 5, ("b", 1): 1}


def test_truncation_and_counts(spark):
    rows = [("a", "ACGTACGTAA", 9, 1), ("a", "ACGTACGTTT", 4, 2), ("a", "GGGGCCCCAA", 3, 3)]
    c = clustering.cluster(spark.createDataFrame(rows, SCHEMA), 0, max_length=8)
    assert sorted((r.umi, r.n_reads) for r in clustering.founder_counts(c).collect()) == [("ACGTACGT", 0), ("ACGTACGT", 13), ("GGGGCCCC", 3)]


def test_empty_and_runs(spark):
    assert clustering.cluster(spark.createDataFrame([], SCHEMA), 2).count() == 0
    rows = [("a", "ACGTACGT", 3, 1), ("b", "ACGTACGT", 2, 2), ("a", "ACGTACGT", 1, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert clustering.cluster(clustering.with_runs(df), 1).filter("is_founder").count() == 3
    assert clustering.cluster(df, 1).filter("is_founder").count() == 2


def test_invariant_to_partitioning(spark):
    df = spark.createDataFrame(simulated(5), SCHEMA)
    one = sorted(map(tuple, clustering.cluster(df.repartition(1), 2).collect()))
    assert one == sorted(map(tuple, clustering.cluster(df.repartition(7, F.rand(3)), 2).collect()))


def serial_result(rows, d, min_reads=1, **mode):
    want = {}
    for g in {r[0] for r in rows}:
        for pos, founder, dist, is_founder in models.serial([(u, n, i) for h, u, n, i in rows if h == g], d, min_reads, **mode):
            want[g, pos] = (founder, dist, is_founder)
    return want


def result(clustered):
    return {(r.group_id, r.input_pos): (r.founder_pos, r.dist, r.is_founder) for r in clustered.collect()}


@pytest.mark.parametrize("pool,head,min_reads", [(50, 10, 1), (7, 0, 1), (30, 5, 3), (10, 10, 1)])
def test_greedy_equals_serial(spark, pool, head, min_reads):
    rows = [(g, u, n, 3 * i) for g, u, n, i in simulated(8)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = result(clustering.cluster(df, 2, min_reads, greedy=(pool, head)))
    assert got == serial_result(rows, 2, min_reads, greedy=True, pool=pool, head=head)
    assert {k for k, v in got.items() if v[2]} == {k for k, v in result(clustering.cluster(df, 2, min_reads)).items() if v[2]}


@pytest.mark.parametrize("d", [2, 3, 4])
def test_overhang_equals_serial(spark, d):
    rng = random.Random(d)
    rows = []
    for g, u, n, i in simulated(d + 40, parents=15):
        rows.append((g, u + "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 0, 1, 4, 6]))) if rng.random() < 0.5 else rng.choice(["N", "NN", ""]) + u, n, i))
    got = result(clustering.cluster(spark.createDataFrame(rows, SCHEMA), d, 2, head_rows=10, head_share=0.2, overhang=True))
    assert got == serial_result(rows, d, 2, overhang=True)
    assert got != result(clustering.cluster(spark.createDataFrame(rows, SCHEMA), d, 2)) or d < 3


def test_overhang():
    assert models.infix_within("ACGTACGT", "ACGTACGTTTTT", 3) == 3
    assert models.within("ACGTACGT", "ACGTACGTTTTT", 3) == -1


@pytest.mark.parametrize("d,length", [(3, 18), (3, 16), (4, 21), (5, 25)])
def test_pairs_of_many_edits_equal_brute_force(spark, d, length):
    """Pieces of four letters: all ways to cut, hot stretches in a third of all barcodes, lengths around the usual one."""
    rng = random.Random(length)
    rows = simulated(d, parents=10, length=length, groups=1)
    more = ["".join(rng.choice("ACGT") for _ in range(length)) for _ in range(40)]
    more += [u[:5] + "AAAAAA" + u[11:] for u in more[:20]] + [u[:9] + "N" + u[10:] for u in more[:3]] + more[:2]
    for u in more[:30]:
        v = list(u)
        for _ in range(d):
            k, at = rng.randint(0, 2), rng.randrange(len(v))
            v[at:at + 1] = [[rng.choice("ACGT")], [], [v[at], rng.choice("ACGT")]][k]
        more.append("".join(v))
    rows = [("g", u, 1, i) for i, u in enumerate([r[1] for r in rows] + more)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.a_pos, r.b_pos, r.dist) for r in similar_pairs(df, df, d).collect()}
    assert got == {(i, j, x) for _, a, _, i in rows for _, b, _, j in rows if i > j and models._grams(a) & models._grams(b) and (x := models.within(a, b, d)) >= 0}


def test_hot_stretches_do_not_pile_up(spark):
    """A third of all barcodes hold the same six letters; no piece that is joined on gathers as many."""
    rng = random.Random(4)
    some = ["".join(rng.choice("ACGT") for _ in range(18)) for _ in range(900)]
    rows = [("g", u[:7] + "AAAAAA" + u[13:] if i % 3 == 0 else u, 1, i) for i, u in enumerate(some)]
    df = spark.createDataFrame(rows, SCHEMA)
    from founderflow.operators import similarity

    most = similarity._rarest(similarity._cut(df, 3)).groupBy("group_id", "ln", "cut", "piece", "letters").count().agg(F.max("count")).first()[0]
    sixes = df.select(F.explode(similarity.kmers(F.col("umi"))).alias("g")).groupBy("g").count().agg(F.max("count")).first()[0]
    assert sixes >= 300 and most <= 0.1 * len(rows)
