"""Estimates on statistical edge cases and against a plain-Python knee."""

import math
import random

import pytest

from founderflow.functions.sequences import distance_bound
from founderflow.operators import estimate


def counts(spark, ns):
    return spark.createDataFrame([("1", f"u{i}", n) for i, n in enumerate(ns)], "group_id string, umi string, n_reads long")


def plain_knee(ns):
    ns = sorted((n for n in ns if n > 0), reverse=True)
    size, total, run, angles = len(ns), sum(ns), 0, []
    for i, n in enumerate(ns[:-2]):
        run += n
        x, y = i / size, run / total
        a, c = math.hypot(x, y), math.hypot(1 - x, 1 - y)
        angles.append(math.floor(math.acos(max(-1, min(1, (a * a + c * c - 2) / (2 * a * c)))) * 180 / 3.1415926535 + 0.5))
    low = min(angles)
    idx = max((i for i, v in enumerate(angles) if v == low + 1), default=None)
    idx = max(i for i, v in enumerate(angles) if v == low) if idx is None else idx
    cut = ns[idx]
    places = [i for i, n in enumerate(ns) if n == cut]
    if cut == 1 and idx < (places[0] + places[-1]) // 2 and max(ns) > 1:
        cut = min(n for n in ns if n > 1)
    found = size if idx == size - 2 and ns[-1] == ns[-2] else idx + 1
    return low + 1, cut, found, sum(n >= cut for n in ns)



@pytest.mark.parametrize("seed", range(4))
def test_knee(spark, seed):
    rng = random.Random(seed)
    ns = [max(0, int(rng.expovariate(1 / 20))) for _ in range(60)] + [1] * rng.randint(5, 80)
    r = estimate.knee(counts(spark, ns)).first()
    assert (r.knee_angle, r.rpu_cutoff, r.estimated_molecules, r.after_rpu_cutoff_molecules) == plain_knee(ns)
    reads = [n for n in sorted(ns, reverse=True) for _ in range(n)]
    mid = len(reads) // 2
    assert r.median_rpu == (reads[mid] if len(reads) % 2 else (reads[mid] + reads[mid - 1]) // 2)


@pytest.mark.parametrize("ns,want", [([5], (0, 1, 1)), ([5, 3], (0, 1, 2)), ([1, 1, 1, 1, 1], (None, *plain_knee([1] * 5)[1:3])), ([4, 4, 4], (None, *plain_knee([4] * 3)[1:3]))])
def test_small_knees(spark, ns, want):
    r = estimate.knee(counts(spark, ns)).first()
    assert (r.rpu_cutoff, r.estimated_molecules) == want[1:]
    assert want[0] is None or r.knee_angle == want[0]


@pytest.mark.parametrize("ns,want", [([7], (7, 1)), ([4, 4, 4], (4, 3)), ([5, 5, 6, 6], (5, 4)), ([0, 3], (3, 1))])
def test_degenerate_negative_binomial(spark, ns, want):
    r = estimate.negative_binomial(counts(spark, ns)).first()
    assert (r.rpu_cutoff, r.estimated_molecules) == want


def test_empty(spark):
    for model in ("auto", "knee", "nb"):
        assert estimate.estimate(counts(spark, [0, 0]), model).count() == 0


def test_quantile_rounds_outwards():
    def cdf(k, r, p):
        return sum(math.exp(math.lgamma(j + r) - math.lgamma(r) - math.lgamma(j + 1) + r * math.log(p) + j * math.log(1 - p)) for j in range(k + 1))

    k = estimate.lower_quantile(18.2634, 0.468223, 0.0005)
    assert cdf(k, 18.2634, 0.468223) <= 0.0005 < cdf(k + 1, 18.2634, 0.468223) and k == 3
    assert estimate.lower_quantile(0.5, 0.5, 0.0005) == 0


def test_report(spark):
    lines = [tuple(r) for r in estimate.as_lines(estimate.negative_binomial(counts(spark, [7, 1, 1, 20]))).collect()]
    assert [k for k, _ in lines] == ["NB_estimate", "median_rpu", "rpu_cutoff", "estimated_molecules", "after_rpu-cutoff_molecules"]


@pytest.mark.parametrize("length,rate,want", [(8, 0.03, 2), (12, 0.05, 3), (18, 0.005, 2), (18, 0.01, 2), (25, 0.05, 5), (26, 0.001, 2), (36, 0.05, 8), (50, 0.03, 7)])
def test_bounds(length, rate, want):
    assert distance_bound(length, rate) == want


def test_negative_binomial_cutoff_has_no_upper_end(spark):
    """Founders of many thousands of reads each: the cutoff is the quantile, wherever it lies."""
    reads = [12000 + 15 * (k - 150) for k in range(300)]
    mean = sum(reads) / len(reads)
    var = sum((n - mean) ** 2 for n in reads) / (len(reads) - 1)
    r, p = mean * mean / (var - mean), mean / var
    total, k = 0.0, 0
    while (total := total + math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(p) + k * math.log1p(-p))) <= 0.0005:
        k += 1
    got = estimate.negative_binomial(spark.createDataFrame([(n,) for n in reads], "n_reads long")).first()
    assert got["rpu_cutoff"] == k - 1 > 4999
