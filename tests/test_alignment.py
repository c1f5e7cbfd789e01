"""Alignment kernels and the methods built on them, against plain dynamic programming."""

import random
import re

import models
import pyarrow as pa
import pytest

from founderflow.operators import alignment, compare

rng = random.Random(12)
word = lambda n, letters="ACGT": "".join(rng.choice(letters) for _ in range(n))
BARCODES = "group_id string, input_pos long, umi string"


def pairs(n, letters, most=14):
    return [word(rng.randint(0, most), letters) for _ in range(n)], [word(rng.randint(0, most + 3), letters) for _ in range(n)]


def semi_global(a, b):
    last = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j - 1] + (x != y), last[j] + 1, now[-1] + 1))
        last = now
    return min(last), last.index(min(last))


@pytest.mark.parametrize("most", [14, 70])
def test_infix(most):
    a, b = pairs(1500 if most < 20 else 150, "ACN", most)
    got = alignment.infix(*alignment.matrix(pa.array(a), alignment.PAD_A, b"NNN"), *alignment.matrix(pa.array(b), alignment.PAD_B, b"NNN"))
    assert list(zip(*(x.tolist() for x in got))) == [semi_global(f"NNN{x}NNN", f"NNN{y}NNN") for x, y in zip(a, b)]


@pytest.mark.parametrize("letters", ["A", "AC", "ACGT"])
@pytest.mark.parametrize("width", [1, 3, 7, 15, 16, 31, 64])
def test_local_of_many_pairs_equals_its_rows(letters, width):
    """Cells of 16, 32 and 64 bits, and lanes side by side, against one row at a time."""
    rng = random.Random(width)
    a, b = (["".join(rng.choice(letters) for _ in range(rng.randint(0, width))) for _ in range(150)] + [letters[0] * width] for _ in range(2))
    sides = (*alignment.matrix(pa.array(a), alignment.PAD_A), *alignment.matrix(pa.array(b), alignment.PAD_B))
    for costs in ((1, -1, -1), (2, -3, -2)):
        assert [x.tolist() for x in alignment.local(*sides, *costs)] == [x.tolist() for x in alignment._local_rows(*sides, *costs)]
    assert list(zip(*(x.tolist() for x in alignment.local(*sides)))) == [models.local(x, y) for x, y in zip(a, b)]


def test_local_is_narrow(monkeypatch):
    """Many pairs are aligned side by side, not by the slower rows."""
    monkeypatch.setattr(alignment, "_local_rows", None)
    a, b = ["GATTACAGGT"] * 100, ["ACGATTACAGGTAC"] * 100
    got = alignment.local(*alignment.matrix(pa.array(a), alignment.PAD_A), *alignment.matrix(pa.array(b), alignment.PAD_B))
    assert [x.tolist() for x in got] == [[10] * 100, [2] * 100, [12] * 100]


def test_local():
    a, b = pairs(1500, "ACG")
    got = alignment.local(*alignment.matrix(pa.array(a), alignment.PAD_A), *alignment.matrix(pa.array(b), alignment.PAD_B))
    assert list(zip(*(x.tolist() for x in got))) == [models.local(x, y) for x, y in zip(a, b)]


def test_edit_paths():
    a, b = pairs(1500, "ACG")
    for x, y, path in zip(a, b, alignment.edits(*alignment.matrix(pa.array(a), alignment.PAD_A), *alignment.matrix(pa.array(b), alignment.PAD_B))):
        i = j = cost = 0
        for n, kind in re.findall(r"(\d+)(.)", path):
            n = int(n)
            if kind in "=X":
                assert all((x[i + k] == y[j + k]) == (kind == "=") for k in range(n))
            i, j, cost = i + n * (kind != "I"), j + n * (kind != "D"), cost + n * (kind != "=")
        assert (i, j, cost) == (len(x), len(y), models.within(x, y, 99))


def test_columns(spark):
    df = spark.createDataFrame([("ACGTACGT", "ACGTACGTTTTT"), (None, "A"), ("", None)], "a string, b string")
    assert [tuple(r) for r in alignment.with_infix(df, "a", "b").select("dist", "end").collect()] == [semi_global(f"NNN{a or ''}NNN", f"NNN{b or ''}NNN") for a, b in map(tuple, df.collect())]
    assert [r.path for r in alignment.with_path(df, "a", "b").collect()] == ["7=4I1=", "1I", ""]
    assert alignment.with_local(df.limit(0), "a", "b").count() == 0


def families(n, groups=2):
    out = []
    for g in range(groups):
        parents = [word(rng.choice([11, 12])) for _ in range(n)]
        for i in range(5 * n):
            u = list(rng.choice(parents))
            for _ in range(rng.choice([0, 1, 1, 2])):
                at = rng.randrange(len(u))
                u[at:at + 1] = rng.choice([[rng.choice("ACGT")], [], [u[at], rng.choice("ACGT")]])
            out.append((f"g{g}", 7 * i + 3, "".join(u)))
    return [*out, ("g0", 1, out[0][2]), ("g0", 2, out[0][2]), ("g1", 0, "AC"), ("g1", 1, "")]


def by_group(rows):
    groups = {}
    for g, i, u in sorted(rows):
        groups.setdefault(g, []).append((i, u))
    return groups


@pytest.mark.parametrize("threshold,stop,window", [(9, 0.0, 20), (7, 0.0, 20), (9, 1.5, 3), (10, 1.0, 2), (30, 0.0, 20)])
def test_threshold_clusters(spark, threshold, stop, window):
    rows = families(12)
    got = {(r.group_id, r.input_pos): (r.cluster, r["size"]) for r in compare.threshold_clusters(spark.createDataFrame(rows, BARCODES).repartition(5), threshold, stop, window).collect()}
    want = {}
    for g, some in by_group(rows).items():
        for place, cluster, size in models.threshold_clusters([u for _, u in some], threshold, stop, window):
            want[g, some[place][0]] = (cluster, size)
    assert got == want


def test_mean_size_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(compare, "BLOCK", 4)
    sizes = [("g", i, 5 if i < 9 else 1) for i in range(20)] + [("h", i, 9) for i in range(20)]
    got = compare._stops(spark.createDataFrame(sizes, "group_id string, cluster long, size long"), 1.0, 3).collect()
    assert [(r.group_id, r.stop) for r in got] == [("g", 12)]


def test_threshold_scan(spark, monkeypatch):
    monkeypatch.setattr(compare, "HEAD", 6)
    rows = families(8)
    got = {r.threshold: (r.mean_similarity, r.median_size) for r in compare.threshold_scan(spark.createDataFrame(rows, BARCODES), [3, 7, 9], samples=7, most=5).collect()}
    want = models.threshold_scan([[u for _, u in some] for some in by_group(rows).values()], [3, 7, 9], 7, 5)
    assert {t: (pytest.approx(s), m) for t, (s, m) in want.items()} == got
    assert compare.threshold_scan(spark.createDataFrame([], BARCODES), [3, 7]).count() == 0


@pytest.mark.parametrize("side", ["down", "up"])
def test_probe(spark, side):
    probe, flip = "GATTACAGGT", str.maketrans("ACGT", "TGCA")
    reads = []
    for i in range(200):
        p = list(probe)
        for _ in range(rng.choice([0, 1, 2, 5])):
            p[rng.randrange(len(p))] = rng.choice(["A", "C", "G", "T", ""])
        s = word(rng.randint(0, 12)) + "".join(p) + word(rng.randint(0, 12))
        reads.append((i, rng.choice([s, s[::-1].translate(flip)])))
    reads += [(900, ""), (901, None), (902, probe)]
    got = {r.read_id: (r.umi, r.score) for r in compare.extract_by_probe(spark.createDataFrame(reads, "read_id long, seq string"), probe, 4, 7, side).collect()}
    want = {}
    for i, s in reads:
        tries = [(models.local(probe, x), x) for x in (s or "", (s or "")[::-1].translate(flip))]
        (score, low, high), x = max(tries, key=lambda t: t[0][0])
        at = high if side == "down" else low - 4
        if score >= 7 and at >= 0 and at + 4 <= len(x):
            want[i] = (x[at:at + 4], score)
    assert got == want and len(got) > 40
