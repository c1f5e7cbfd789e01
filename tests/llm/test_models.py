"""Language model, decontamination, toxicity, near-duplicates, neighbours, quality, registry and pipeline."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from founderflow.llm import ann, common, decontamination, katz, neardup, quality, toxicity

DOCS = "doc_id long, text string, source string, lang string"
WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha", "ki") for b in ("ra", "sen", "til", "mo", "nu")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed, n=120, words=60):
    rng = random.Random(seed)
    return [(i, prose(rng, rng.randint(20, words)), f"s{i % 3}", "en") for i in range(n)]


ODD = [(9001, None, None, None), (9002, "", "s0", "en"), (None, "ba ra", "s0", None), (9003, "one", None, "en"), (9004, " ".join(WORDS * 900), "s1", "fr")]


def test_hashed_words():
    texts = ["The cat", "", None, "cat  the\tcat", "été"]
    w, at = common.hashed_words(pa.array(texts))
    assert np.diff(at).tolist() == [2, 0, 0, 3, 1] and w[0] == w[3] and w[1] == w[2] == w[4]
    joined, _ = common.hashed_words(pa.array(["x the cat y"]))
    assert joined[1] == w[0] and joined[2] == w[1]
    whole = pa.array(["a b", "c d e"])
    assert common.hashed_words(whole.slice(1))[0].tolist() == common.hashed_words(whole)[0][2:].tolist()


@pytest.mark.parametrize("order,parts,hot", [(2, 5, 1 << 16), (3, 256, 1 << 16), (3, 7, 3), (4, 3, 2)])
def test_katz(spark, monkeypatch, order, parts, hot):
    monkeypatch.setattr(katz, "HOT", hot)
    rows = corpus(3, 60, 40) + ODD[:4] + [(9003, "one", None, "en")]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = katz.Scorer(katz.packed(df, common.fold("doc_id", 10) == 0), order, parts).scores().collect()
    toks = [(r[0], (r[1] or "").split() + ["</s>"]) for r in rows]
    is_held = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 10 == 0
    grams = {n: Counter() for n in range(1, order + 1)}
    for i, t in toks:
        if not is_held(i):
            x = ["<s>"] * (order - 1) + t
            for k in range(order - 1, len(x)):
                for n in grams:
                    grams[n][tuple(x[k - n + 1:k + 1])] += 1
    d = {n: katz.Model._discounts([sum(v == r for v in grams[n].values()) for r in range(1, 7)]) for n in grams}
    cut = lambda n, c: d[n][min(c, 6)] * c
    total = sum(grams[1].values())
    left = 1 - sum(cut(1, c) for c in grams[1].values()) / total
    unknown, scale = (left, 1.0) if left > 1e-12 else (1 / (total + 1), total / (total + 1))
    after = {n: {} for n in grams}
    for n in grams:
        for g in grams[n]:
            after[n].setdefault(g[:-1], []).append(g[-1])

    def p(n, h, w):
        if n == 1:
            return scale * cut(1, grams[1][w,]) / total if (w,) in grams[1] else unknown
        if h not in after[n]:
            return p(n - 1, h[1:], w)
        size = sum(grams[n][h + (x,)] for x in after[n][h])
        kept = sum(cut(n, grams[n][h + (x,)]) for x in after[n][h]) / size
        rest = 1 - sum(p(n - 1, h[1:], x) for x in after[n][h])
        shrink, mass = (size / (size + 1), 1 / (size + 1)) if 1 - kept < 1e-9 else (1, 1 - kept)
        c = grams[n].get(h + (w,), 0)
        return cut(n, c) / size * shrink if c else mass / rest * p(n - 1, h[1:], w)

    for h in list(after[order])[:5]:
        assert sum(p(order, h, g[0]) for g in grams[1]) + p(order, h, "never seen") == pytest.approx(1, abs=1e-6)
    want = Counter()
    for i, t in toks:
        x = ["<s>"] * (order - 1) + t
        s = sum(math.log10(p(order, tuple(x[k - order + 1:k]), x[k])) for k in range(order - 1, len(x)))
        b = sum(math.log10((grams[1].get((w,), 0) + 0.1) / (total + 0.1 * (len(grams[1]) + 1))) for w in t)
        want[i, is_held(i), len(t), sum((w,) in grams[1] for w in t), total, round(b, 6), round(s, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want


@pytest.mark.parametrize("hot", [1 << 16, 3])
def test_katz_tables_score_other_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(katz, "HOT", hot)
    rows = corpus(4, 60, 40)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    held = common.fold("doc_id", 4) == 0
    model = katz.Scorer(katz.packed(df, held), 3, 7)
    want = {r.doc_id: (r.n_known, r.train_tokens, r.base_score, r.score) for r in model.scores().collect()}
    # Texts that it learned from or held out, in other blocks and as texts to score: the same from the tables alone.
    got = {r.doc_id: (r.n_known, r.train_tokens, r.base_score, r.score) for r in model.score(katz.packed(df.coalesce(1), F.lit(False))).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    alone = spark.createDataFrame([(1, rows[1][1], "s", "l"), (2, "never seen words", "s", "l"), (3, None, "s", "l")], DOCS)
    other = {r.doc_id: r for r in model.score(katz.packed(alone, F.lit(True))).collect()}
    assert other[2].n_known == 1 and other[1].score == pytest.approx(want[1][3]) and other[3].n_tokens == 1
    # A row a level and partition of counts and one of answers a block: linear in blocks.
    rows = model._state.selectExpr('size(answers) as n').collect()
    assert model.tables.count() <= 3 * 7 and all(r.n <= 3 * 7 for r in rows)


def test_frozen_arrays():
    arrays = [np.zeros(0, np.int64), np.array([0, 1, 2**40]), np.array([True, False]), np.array([0.5, -1.0]), np.array([2**64 - 1], np.uint64)]
    for x, y in zip(arrays, katz.thaw(katz.freeze(*arrays))):
        assert (x == (y.view(np.uint64) if x.dtype == np.uint64 else y)).all() and len(x) == len(y)
    for x in (np.array([5, 2**50, 5, 0]), np.array([2**62, 1, 2**62], np.int64), np.zeros(0, np.int64)):
        values, first, of = katz.distinct(x)
        assert (values[of] == x).all() and (x[first] == values).all() and (np.diff(values) > 0).all()


def test_katz_query_is_of_order_three(spark, frames):
    path = frames(documents=(corpus(3, 40, 40), DOCS))
    packed = katz.packed(common.table(spark, path, "documents"), common.fold("doc_id", 10) == 0)
    scores = lambda df: {r.doc_id: round(r.score, 9) for r in df.collect()}
    got = scores(katz.op3_katz_scores(spark, path))
    assert got == scores(katz.Scorer(packed, 3).scores()) != scores(katz.Scorer(packed, 2).scores())


def test_katz_empty(spark):
    assert katz.Scorer(katz.packed(spark.createDataFrame([], DOCS), common.fold("doc_id", 10) == 0)).scores().count() == 0
    only = spark.createDataFrame([(1, "a b", "s", "l")], DOCS)
    r = katz.Scorer(katz.packed(only, F.lit(True))).scores().first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_alignment_equals_plain():
    rng = np.random.default_rng(1)
    pairs = [(rng.integers(2, 6, rng.integers(1, 20)).astype(np.uint64), rng.integers(2, 6, rng.integers(1, 12)).astype(np.uint64)) for _ in range(50)]

    def plain(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        return h.max()

    assert decontamination.align([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [plain(a, b) for a, b in pairs]


def test_decontamination(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randint(15, 40))) for i in range(12)] + [(12, "ba ra"), (13, None), (14, "")]
    rows = corpus(5, 60)
    bad = set()
    for i in range(12):
        words = items[i][1].split()
        if i % 3 == 1:  # some words changed
            for k in range(4, len(words), 9):
                words[k] = "changed"
        if i % 3 == 2:  # some left out, some put in
            words = [w for k, w in enumerate(words) if k % 8 != 5]
            words.insert(7, "inserted")
        rows.append((1000 + i, f"{prose(rng, 30)} {' '.join(words)}, {prose(rng, 30)}".upper() if i == 0 else f"{prose(rng, 30)} {' '.join(words)} {prose(rng, 30)}", "s", "en"))
        bad.add(1000 + i)
    docs = spark.createDataFrame(rows + ODD[:2] + ODD[3:4], DOCS)
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontamination.hits(docs, table).collect() if r.item_id < 12}
    assert {d for d, _ in found} == bad and all((1000 + i, i) in found for i in range(12)) and found[1000, 0] == 1.0
    kept = {r.doc_id for r in decontamination.clean(docs, table.filter("item_id < 12")).collect()}
    assert kept == {r[0] for r in rows + ODD[:2] + ODD[3:4]} - bad
    assert decontamination.hits(docs, table.limit(0)).count() == 0 and decontamination.clean(docs.limit(0), table).count() == 0


def plain_hits(rows, items, threshold=decontamination.THRESHOLD):
    """Every document aligned with every item."""
    words = lambda t: common.hashed_words(pa.array([t], pa.string()), common.is_not_word, "unicode")[0]
    out = {}
    for i, t in items:
        w = words(t)
        for d, s in zip((r[0] for r in rows), decontamination.align([words(r[1]) for r in rows], [w] * len(rows))):
            if s >= min(threshold * 2 * len(w) - 1e-9, 2 * decontamination.EXCERPT):
                out[d, i] = round(s / (2 * len(w)), 9)
    return out


def test_decontamination_equals_alignment_of_all_pairs(spark):
    rng = random.Random(21)
    vocabulary = WORDS + [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(3, 60)))) for i in range(40)]
    rows = [(i, " ".join(text(rng.randint(0, 300))), "s", "en") for i in range(60)]
    for i, t in items:
        for every in (2, 3, 4, 5):  # evenly edited copies: replaced, left out, put in
            w = t.split()
            edited = [[f"x{k}" if k % every == every - 1 else x for k, x in enumerate(w)], [x for k, x in enumerate(w) if k % every], [y for k, x in enumerate(w) for y in ([x, "put"] if k % every == 0 else [x])]]
            edited.append([f"x{k}" if rng.random() < 1 / every else x for k, x in enumerate(w)])
            for e in edited:
                rows.append((len(rows), " ".join(text(rng.randint(0, 40)) + e + text(rng.randint(0, 40))), "s", "en"))
    docs, table = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = plain_hits(rows, items)
    assert {(r.doc_id, r.item_id): round(r.score, 9) for r in decontamination.hits(docs, table).collect()} == want
    assert len([s for s in want.values() if s < 0.6]) > 100
    assert {r.doc_id for r in decontamination.clean(docs, table).collect()} == {r[0] for r in rows} - {d for d, _ in want}


def test_decontamination_finds_excerpts_of_long_items(spark):
    item = [f"w{i}" for i in range(300)]
    other = " ".join(f"v{i}" for i in range(50))
    cut = {1: item[100:113], 2: item[:26], 3: item[280:], 4: item[50:62], 5: [x for k, x in enumerate(item[20:40]) if k % 8 != 5]}
    docs = spark.createDataFrame([(i, f"{other} {' '.join(w)} {other}", "s", "en") for i, w in cut.items()], DOCS)
    table = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: round(r.score * 600) for r in decontamination.hits(docs, table).collect()}
    assert got == {1: 26, 2: 52, 3: 40, 5: 2 * 18 - 2}  # 12 words are no excerpt
    assert [r.doc_id for r in decontamination.clean(docs, table).collect()] == [4]


def test_decontamination_query(spark, frames):
    """Best item, ties, null and repeated ids of documents and items, copies, null texts, an empty benchmark."""
    rng = random.Random(31)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    a, b, c = text(30), text(25), text(40)
    half = " ".join(b.split()[:13])
    items = [(5, a), (3, a), (7, b), (7, c), (None, c), (None, None), (9, ""), (5, a)]
    rows = [(1, f"{text(40)} {a} {text(9)}"), (2, f"{b} {text(50)}"), (None, f"{c} {text(5)}"), (None, b), (3, text(80)), (4, None), (5, ""), (6, f"{half} x {a}")]
    rows += [(1, f"{c} {text(3)}"), (8, a), (8, a), (9, a)]
    rows = [(d, t, "s", "en") for d, t in rows]
    path = frames(documents=(rows, DOCS), benchmark=(items, "item_id long, text string"))
    best = {}
    known = [(k, t) for k, (_, t) in enumerate(items) if t]
    numbered = [(k, r[1]) for k, r in enumerate(rows) if r[1]]
    for (d, k), score in plain_hits(numbered, known).items():
        best.setdefault(rows[d][0], {}).setdefault(items[k][0], []).append(score)
    want = {}
    for d, found in best.items():
        top = sorted(((-max(v), i is None, i) for i, v in found.items()), key=lambda x: (x[0], x[1], x[2] or 0))[0]
        want[d] = (top[2], -top[0], sorted(i for i in found if i is not None))
    got = {r.doc_id: (r.item_id, round(r.score, 9), r["items"]) for r in decontamination.op4_decontaminate(spark, path).collect()}
    assert got == want and want[1][0] == 3 and want[8][2] == [3, 5]
    docs, table = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    assert decontamination.hits(docs, table.limit(0)).count() == 0
    kept = decontamination.clean(docs.withColumn("ff_key", F.lit("k")).withColumn("item", F.lit(1)), table)
    assert kept.columns == [*docs.columns, "ff_key", "item"] and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]


def test_toxicity(spark, frames):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = prose(rng, 40).split()
        if toxic:
            words[rng.randrange(40)] = rng.choice(["vile", "nasty"])
            words[rng.randrange(40)] = "horrid"
        rows.append((i, " ".join(words), "s", "en"))
        labels.append((i, 1, int(toxic)))
    path = frames(documents=(rows + ODD, DOCS), labels=(labels + [(9001, None, None), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int"))
    got = toxicity.op5_toxicity(spark, path).collect()
    assert len(got) == 605 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    wrong = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600 and r.predicted != (r.doc_id % 6 == 0)]
    assert len(wrong) <= 4
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1) for r in got)
    again = toxicity.op5_toxicity(spark, path).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_toxicity_on_held_out_labels(spark):
    """Labels not learned from, on the given tables: order by score, and the share right at the threshold against always 0."""
    path = "/root/testdata/sf0.01"
    if not os.path.exists(f"{path}/labels.parquet"):
        pytest.skip("needs the given tables")
    truth = {r.doc_id: r.toxic for r in common.table(spark, path, "labels").collect()}
    got = [(r.score, r.predicted, truth[r.doc_id]) for r in toxicity.op5_toxicity(spark, path).collect() if r.held_out and truth.get(r.doc_id) is not None]
    bad, good = [p for p, _, y in got if y == 1], [p for p, _, y in got if y == 0]
    print("held out", len(got), len(bad), sum((b > g) + 0.5 * (b == g) for g in good for b in bad) / len(good) / len(bad), sum(p == y for _, p, y in got) / len(got))
    assert len(bad) > 10 and sum((b > g) + 0.5 * (b == g) for g in good for b in bad) / len(good) / len(bad) > 0.9
    assert sum(p == y for _, p, y in got) / len(got) > len(good) / len(got)


def test_ftrl_equals_plain():
    """Follow the regularised leader, coordinate by coordinate, over the whole history of gradients."""
    rng = np.random.default_rng(2)
    fast = toxicity.Ftrl(bits=5, alpha=0.7, beta=1.0, l1=0.3, l2=0.1)
    past: dict[int, list[tuple[float, float]]] = {}  # gradient and weight at the time

    def weight(i):
        n = z = 0.0
        for g, w in past.get(i, []):
            z += g - (math.sqrt(n + g * g) - math.sqrt(n)) / 0.7 * w
            n += g * g
        return 0.0 if abs(z) <= 0.3 else -(z - math.copysign(0.3, z)) / ((1.0 + math.sqrt(n)) / 0.7 + 0.1)

    for _ in range(200):
        index, label = np.unique(rng.integers(0, 32, 6)), int(rng.integers(0, 2))
        w = {int(i): weight(int(i)) for i in index}
        assert fast.weights(index).tolist() == pytest.approx(list(w.values()))
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i, x in w.items():
            past.setdefault(i, []).append((g, x))
        fast.learn(index, label)
    index, value = fast.sparse()
    assert dict(zip(index.tolist(), value)) == pytest.approx({i: weight(i) for i in range(32) if weight(i)}) and len(index) < 32


def test_toxicity_features_equal_plain():
    texts = ["One two, three two one two", "", None, "x", "é É ß"]
    index, at = toxicity.features(pa.array(texts), 30)
    word = lambda w: common.hashed_words(pa.array([w]), common.is_not_word, "unicode")[0]
    for k, t in enumerate(texts):
        w = [x for x in (t or "").lower().replace(",", " ").split()]
        want = {0}
        with np.errstate(over="ignore"):
            for i in range(len(w)):
                want.add(int(word(w[i])[0] >> np.uint64(34)))
                if i + 1 < len(w):
                    want.add(int(common.ngrams(np.concatenate([word(w[i]), word(w[i + 1])]), np.array([0, 2]), 2)[0][0] >> np.uint64(34)))
                if i + 2 < len(w):
                    want.add(int(common.mix(word(w[i]) * np.uint64(3) + common.mix(word(w[i + 2])))[0] >> np.uint64(34)))
        assert set(index[at[k]:at[k + 1]].tolist()) == want


def test_toxicity_of_clashing_columns(spark):
    row = toxicity.score(spark.createDataFrame([("a", 7)], "text string, SCORE long"), (np.array([0]), np.array([0.0]))).first()
    assert row["SCORE"] == 7 and row["score_"] == 0.5


def test_toxicity_without_labels(spark, frames):
    path = frames(documents=(ODD, DOCS), labels=([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in toxicity.op5_toxicity(spark, path).collect()} == {0.5}


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(1)
    off = []
    for _ in range(20):
        e = np.sort(rng.integers(1, 2**47, 40).astype(np.uint64))
        a, b = rng.integers(0, 9, 40), rng.integers(0, 9, 40)
        doc = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        s = neardup.signatures(doc, np.concatenate([e[a > 0], e[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 1024)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.03


def plain_classes(rows, t=0.8):
    bags = []
    for r in rows:
        w = (r[1] or "").lower().split()
        n = min(5, max(1, len(w)))
        bags.append(Counter(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if w else Counter())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, every = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if (both / every if every else 1.0) >= t:
                parent[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    name = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return Counter((r[0], name[find(i)], len(groups[find(i)])) for i, r in enumerate(rows))


@pytest.mark.parametrize("edits", [1, 2, 4])
def test_near_duplicates(spark, frames, edits):
    rng = random.Random(7)
    rows = corpus(9, 40, 120) + ODD + [(9002, "", "s0", "en"), (9010, None, "s", "l"), (9011, "ONE", "s", "l")]
    base = prose(rng, 150).split()
    for i in range(80):  # one large group around a text that differs by some words each
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(150)] = f"w{rng.randrange(10**6)}"
        rows.append((2000 + i, " ".join(words), "s", "en"))
    path = frames(documents=(rows, DOCS))
    got = neardup.op6_near_duplicates(spark, path).collect()
    want = plain_classes(rows)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    kept = neardup.survivors(spark.read.parquet(f"{path}/documents.parquet").withColumn("node", F.lit(1)).withColumn("key", F.lit(2)))
    assert kept.columns == ["doc_id", "text", "source", "lang", "node", "key"]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(c for c in {(c, n) for _, c, n in want} for c in [c[0]])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_near_duplicates_on_given_tables(spark):
    """Every pair of the documents that is similar, by plain multisets of words and an index of their shingles, is in one class, and no others."""
    path = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    bags, holders = [], {}
    for i, (_, text) in enumerate(rows):
        w = (text or "").lower().split()
        n = min(5, max(1, len(w)))
        bags.append(Counter(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if w else Counter())
        for g in bags[-1]:
            holders.setdefault(g, []).append(i)
    links, name = [], {i: r[0] for i, r in enumerate(rows)}
    for i, bag in enumerate(bags):
        size = sum(bag.values())
        for j in {j for g in bag for j in holders[g] if j < i}:
            if min(size, sum(bags[j].values())) >= 0.8 * max(size, sum(bags[j].values())) and sum((bag & bags[j]).values()) >= 0.8 * sum((bag | bags[j]).values()):
                links.append((i, j))
    empty = [i for i, bag in enumerate(bags) if not bag]
    links += list(zip(empty, empty[1:]))
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(name[i], name[j])
            changed |= name[i] != low or name[j] != low
            name[i] = name[j] = low
    got = {r.doc_id: r.class_id for r in neardup.op6_near_duplicates(spark, path).collect()}
    want = {rows[i][0]: c for i, c in name.items()}
    assert len(links) > 50 and sum(got[rows[i][0]] == got[rows[j][0]] for i, j in links) == len(links)
    assert got == want


def test_prefix_filter_is_exact(spark):
    rng = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(120)] = f"w{rng.randrange(10**6)}"
        texts.append((i, " ".join(words[:rng.randint(105, 120)])))
    df = spark.createDataFrame(texts, "node long, text string")
    marks = df.select("node", F.col("node").alias("root"), (F.col("node") % 2 == 0).alias("minor"))
    got = {(r.a, r.b) for r in neardup.verified(neardup.across(df, marks, 0.8), df, 0.8).collect()}
    every = df.select(F.col("node").alias("a")).crossJoin(df.select(F.col("node").alias("b"))).filter("a < b and (a % 2 = 0 or b % 2 = 0)")
    assert got == {(r.a, r.b) for r in neardup.verified(every, df, 0.8).collect()} and len(got) > 50


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, 5), (7, 3), (3, 9), (200, 100)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in [*range(101, 141), 200]} | {7: 3, 9: 3}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_empty(spark, frames):
    assert neardup.op6_near_duplicates(spark, frames(documents=([], DOCS))).count() == 0


def test_neighbours(spark, frames):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 20] + 0.7 * rng.normal(size=16)], 0) for i in range(1200)]
    rows += [(2000 + i, [1.0] * 16, 0) for i in range(60)] + [(3000, None, 0), (3050, [0.0] * 16, 0), (3100, [float("nan")] * 16, 0), (3150, [None] * 16, 0), (3200, [1.0], 0), (None, [1.0] * 16, 0), (0, rows[0][1], 1)]
    path = frames(embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    got = {}
    for r in ann.op8_nearest(spark, path).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    fine = {i: np.array(v, float) for i, v, _ in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    hit = total = 0
    for q in (i for i in fine if i % 50 == 0):
        best = sorted((-float(v @ fine[q] / np.sqrt(v @ v) / np.sqrt(fine[q] @ fine[q])), i) for i, v in fine.items() if i != q)[:5]
        hit += len({i for _, i in best} & {v for _, v, _ in got[q]})
        total += 5
        assert [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
        for _, v, s in got[q]:
            assert s == pytest.approx(fine[v] @ fine[q] / np.sqrt(fine[v] @ fine[v]) / np.sqrt(fine[q] @ fine[q]), abs=1e-12)
    assert hit / total >= 0.9 and not {3000, 3050, 3100, 3150} & set(got)
    assert [v for _, v, _ in sorted(got[2000])] == [2001, 2002, 2003, 2004, 2005]


def test_neighbours_few_and_none(spark, frames):
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    rows = ann.usable(two)
    assert [tuple(r)[:3] for r in ann.search(ann.build(rows, 5), rows.filter("vec_id = 0"), 5).collect()] == [(0, 1, 1)]
    assert ann.op8_nearest(spark, frames(embeddings=([], "vec_id long, embedding array<float>"))).count() == 0


def test_quality(spark, frames):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        junk = i % 5 == 0
        t = prose(rng, 40)
        rows.append((i, t.upper().replace(" ", "!! ") if junk else t.capitalize() + ".", f"s{i % 3}" if i % 50 else None, "en"))
        labels.append((i, int(not junk), 0))
    path = frames(documents=(rows + ODD, DOCS), labels=(labels + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    got = quality.op10_quality(spark, path).collect()
    assert len(got) == 305 and all(0 < r.posterior < 1 for r in got)
    assert all(r.keep == (r.doc_id % 5 != 0) for r in got if r.doc_id is not None and r.doc_id < 300)


def test_quality_shrinks_sparse_sites(spark):
    rows = [(i, "big", "p", 0.9 if i % 10 else 0.1) for i in range(1000)] + [(2000 + i, "bad", "p", 0.2) for i in range(400)] + [(3000, "one", "q", 0.5), (3001, None, None, 0.5)]
    got = {r.doc_id: r for r in quality.posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, p double")).collect()}
    mean = sum(r[3] for r in rows) / len(rows)
    assert abs(got[3000].host_posterior - mean) < abs(got[2000].host_posterior - mean) and got[2000].path_posterior < 0.35 < got[3000].posterior
    assert quality.posteriors(spark.createDataFrame([], "doc_id long, host string, path string, p double")).count() == 0


def test_quality_without_labels(spark, frames):
    path = frames(documents=(ODD, DOCS), labels=([], "doc_id long, quality int, toxic int"))
    assert {r.evidence for r in quality.op10_quality(spark, path).collect()} == {0.5}


def test_posteriors_equal_plain(spark):
    rng = random.Random(4)
    rows = []
    for i in range(500):
        host = rng.choice(["a", "a", "a", "b", "c", None, f"rare{rng.randrange(30)}"])
        path = rng.choice(["/x", "/y", None, f"/{rng.randrange(20)}"])
        rows.append((i, host, path, f"{path}/{rng.randrange(2)}", round(rng.random() ** (3 if host == "b" else 0.5), 3)))
    levels = ("host", "path", "deep")
    mu = sum(r[4] for r in rows) / len(rows)
    means = [{(): mu}]
    for depth in (1, 2, 3):
        groups = {}
        for r in rows:
            groups.setdefault(r[1:1 + depth], []).append(r[4])
        prior = {g: means[-1][g[:-1]] for g in groups}
        total = sum(map(len, groups.values()))
        m = {g: sum(v) / len(v) for g, v in groups.items()}
        spread = sum(len(v) * (m[g] - prior[g]) ** 2 for g, v in groups.items()) / total
        inside = sum(max(0, sum(x * x for x in v) - len(v) * m[g] ** 2) for g, v in groups.items()) / max(1, total - len(groups))
        k = max(1, min(1e6, sum(prior[g] * (1 - prior[g]) for g in groups) / len(groups) / max(1e-9, spread - inside * len(groups) / total) - 1))
        means.append({g: (k * prior[g] + sum(v)) / (k + len(v)) for g, v in groups.items()})
    logit = lambda x: math.log(x / (1 - x))
    got = {r.doc_id: r for r in quality.posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, deep string, p double"), levels).collect()}
    assert len(got) == 500
    for r in rows:
        g, v = got[r[0]], [x[4] for x in rows if x[1:4] == r[1:4]]
        local = min(1 - 1e-6, max(1e-6, (k * means[2][r[1:3]] + sum(v) - r[4]) / (k + len(v) - 1)))
        assert (g.host_posterior, g.path_posterior) == (pytest.approx(means[1][r[1:2]]), pytest.approx(means[2][r[1:3]]))
        assert g.deep_posterior == pytest.approx(local) and (r[4] in (0, 1) or g.posterior == pytest.approx(1 / (1 + math.exp(-(logit(r[4]) + logit(local) - logit(mu))))))


def test_quality_on_pages_by_url(spark):
    urls = ["https://User@Ex.org:80/a/b/c?q#f", "http://ex.org", "http://ex.org/", "no url", None, "https://x.y/one?z=/two"]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(*[c.alias(n) for n, c in quality.site_levels(F.col("url")).items()]).collect()
    assert list(map(tuple, got)) == [("ex.org", "/a", "/a/b"), ("ex.org", None, None), ("ex.org", None, None), (None, None, None), (None, None, None), ("x.y", "/one", None)]
    path = "/root/testdata/sf0.001"
    if not os.path.exists(f"{path}/pages.parquet"):
        pytest.skip("needs the given tables")
    pages = common.table(spark, path, "pages").withColumn("text", F.regexp_replace("html", "<[^>]*>", " "))
    model = quality.train(common.table(spark, path, "documents"), common.table(spark, path, "labels"))
    out = quality.classify(pages, model, quality.site_levels(F.col("url")), key="page_id").collect()
    assert len(out) == pages.count() and len({r.host for r in out}) > 1 and all(0 < r.posterior < 1 for r in out)


def test_quality_on_held_out_labels(spark):
    path = "/root/testdata/sf0.01"
    if not os.path.exists(f"{path}/labels.parquet"):
        pytest.skip("needs the given tables")
    truth = {r.doc_id: r.quality for r in common.table(spark, path, "labels").collect()}
    got = [(r.posterior, truth[r.doc_id]) for r in quality.op10_quality(spark, path).collect() if r.held_out and truth.get(r.doc_id) is not None]
    good, bad = [p for p, y in got if y == 1], [p for p, y in got if y == 0]
    assert len(bad) > 10 and sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad) > 0.98


def test_ngram_scores(spark):
    weights = np.random.default_rng(1).normal(size=(2, quality.BUCKETS)).round(9)
    rows = [("ba ra  Ce\nce",), ("one",), ("",), (None,)]
    df = spark.createDataFrame(rows, "text string").select("text", quality.ngram_score(weights, 1.0, 0.0), quality.ngram_score(weights, 0.0, 2.0), quality.ngram_score(weights, 3.0, 2.0))
    bucket = lambda x: spark.sql(f"select pmod({x}, {quality.BUCKETS}) as b").first().b
    for text, one, two, both in df.collect():
        w = [f"xxhash64('{x}')" for x in (text or "").lower().split(" ")]
        mean = sum(weights[0, bucket(x)] for x in w) / len(w)
        pairs = sum(weights[1, bucket(f"xxhash64({x}, {y})")] for x, y in zip(w, w[1:])) / max(1, len(w) - 1)
        assert (one, two, both) == (pytest.approx(mean), pytest.approx(2 * pairs), pytest.approx(3 * mean + 2 * pairs))


def test_pipeline(spark, frames):
    import corpus_pipeline

    rng = random.Random(12)
    item = prose(rng, 30)
    rows = [(*r, len(r[1])) for r in corpus(20, 80)]
    labels = []
    for i in range(80):
        if i % 4 == 0:
            rows[i] = (i, rows[i][1] + " vile horrid vile", *rows[i][2:])
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(500, rows[1][1], "s1", "en", 1), (501, f"{prose(rng, 20)} {item} {prose(rng, 20)}", "s1", "en", 1), (502, f"{prose(rng, 30)} mail me@mail3.example.com", "s2", "en", 1), (None, None, None, None, None)]
    path = frames(documents=(rows, DOCS + ", n_chars long"), labels=(labels, "doc_id long, quality int, toxic int"), benchmark=([(1, item)], "item_id long, text string"))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, path))
        seen[name] = docs
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in seen.items()}
    assert not {i for i in ids["toxicity"] if i is not None and i < 80 and i % 4 == 0}
    assert 500 not in ids["near_duplicates"] and 1 in ids["near_duplicates"] and 501 in ids["near_duplicates"]
    assert ids["decontamination"] == ids["near_duplicates"] - {501} and ids["pii"] == ids["decontamination"]
    assert seen["pii"].columns == ["doc_id", "text", "source", "lang", "n_chars"]
    text = seen["pii"].filter("doc_id = 502").first()
    assert "me@mail3" not in text.text and "@" in text.text and text.n_chars == len(text.text)
    assert sorted(map(repr, corpus_pipeline.run(spark, path).collect())) == sorted(map(repr, seen["mixing"].collect()))


def test_registry():
    from founderflow.llm import registry

    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(registry.ORACLES) <= set(registry.QUERIES)
