"""Quality by hierarchical empirical Bayes: a document classifier under host and path-level priors.

Evidence. A logistic classifier gives each document's probability p of good quality, from statistics of its text
(letter case, marks, digits, line and word repeats, lengths) and from two n-gram scores: the mean log odds of its words and
of its pairs of adjacent words, each looked up by hash in BUCKETS weights, which grouped counts of a half of the
labelled sample give. The classifier's coefficients are fitted on the other half, so it weighs n-gram scores as they
are on texts that did not make them.

Hierarchy. Sites are levels of groups, such as a host, its first path segment, its second. Grouped aggregates of p give
posterior means: each level's is shrunk to the level's above, the first to the global mean, with prior
strengths estimated by the method of moments, so sparse sites stay near their prior. A document's odds are its classifier
odds with the global prior exchanged for that of its last level, itself left out. `site_levels` cuts a URL into levels.

Only the weights and coefficients are fitted on a bounded sample: at most `most_rows` labelled rows with the smallest
keyed hash of their id. All texts are scored whole, once, and every aggregate covers all rows.

Defined results: null texts are empty; null hosts and paths are sites of their own; null labels are not learned
from; without labels of both classes p is 0.5 for all; an empty table gives no rows; repeated rows each count;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

EDGE = 1e-6
BUCKETS = 4096
Model = tuple[np.ndarray, float, np.ndarray]  # coefficients, intercept, weights of words and of pairs


def site_levels(url: Column, depth: int = 2) -> dict[str, Column]:
    """host and path_1 to path_depth of a URL: its first segments, cut off at the query; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    cut = lambda n: F.when(F.size(parts) >= n, F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    return {"host": F.when(host != "", host), **{f"path_{n}": cut(n) for n in range(1, depth + 1)}}


def _hashes(text: str) -> Column:
    return F.transform(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), " "), lambda w: F.xxhash64(w))


def _bucket(h: Column) -> Column:
    return (F.pmod(h, F.lit(BUCKETS)) + 1).cast("int")


def _buckets(text: str, pairs: bool) -> Column:
    """The buckets, from 1, of a text's words or of its pairs of adjacent words."""
    h = _hashes(text)
    if not pairs:
        return F.transform(h, _bucket)
    n = F.size(h) - 1
    return F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: _bucket(F.xxhash64(a, b)))


def ngram_score(weights: np.ndarray, words: float, pairs: float, text: str = "text") -> Column:
    """words * the mean weight of a text's words + pairs * that of its pairs, in one pass over the text."""
    one, two = (F.expr("array(" + ",".join(f"{w!r}D" for w in (c * row).tolist()) + ")") for c, row in zip((words, pairs), weights))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0).alias("n"))

    def step(acc: Column, h: Column) -> Column:
        pair = F.when(acc["last"].isNull(), F.lit(0.0)).otherwise(F.element_at(two, _bucket(F.xxhash64(acc["last"], h))))
        return F.struct(h.alias("last"), (acc["a"] + F.element_at(one, _bucket(h))).alias("a"), (acc["b"] + pair).alias("b"), (acc["n"] + 1).alias("n"))

    return F.aggregate(_hashes(text), start, step, lambda acc: acc["a"] / acc["n"] + acc["b"] / F.greatest(acc["n"] - 1, F.lit(1)))


def statistics(text: str = "text") -> list[Column]:
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    words = F.size(F.split(t, " "))
    lines = F.split(t, "\n")
    counted = lambda chars: n - F.length(F.translate(t, chars, ""))
    many = lambda pattern: F.regexp_count(t, F.lit(pattern))
    return [
        F.least(F.lit(1.0), 2 * many(r"\p{Lu}") / (n + 1)),
        F.least(F.lit(1.0), counted("!?") / words),
        F.least(F.lit(1.0), counted("%$#&*@^~") / words),
        F.least(F.lit(1.0), counted("|") / words),
        F.least(F.lit(40.0), n / words),
        F.log1p(words.cast("double")),
        F.size(F.array_distinct(lines)) / F.size(lines),
        counted("0123456789") / (n + 1),
        F.size(F.array_distinct(F.split(t, " "))) / words,
    ]


def fit(sample: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; coefficients for raw columns and the intercept."""
    mean, sd = sample.mean(0), sample.std(0) + 1e-9
    x = np.hstack([(sample - mean) / sd, np.ones((len(sample), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([l2] * sample.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / sd, float(w[-1] - (w[:-1] * mean / sd).sum())


def _weights(sample: DataFrame) -> np.ndarray:
    """Log odds by bucket, of words and of pairs, from counts of a labelled sample (ff_y, text); smoothed by one."""
    parts = [sample.select("ff_y", F.lit(k).alias("k"), F.explode(_buckets("text", bool(k))).alias("b")) for k in (0, 1)]
    rows = parts[0].unionByName(parts[1]).groupBy("k", "b", "ff_y").agg(F.count(F.lit(1)).alias("n")).collect()  # 4 * BUCKETS at most
    n = np.ones((2, 2, BUCKETS))
    for r in rows:
        n[r["ff_y"], r["k"], r["b"] - 1] += r["n"]
    logs = np.log(n / n.sum(axis=2, keepdims=True))
    return np.round(logs[1] - logs[0], 9)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 20_000, text: str = "text") -> Model:
    known = labels.select(F.col("doc_id").alias("ff_id"), F.col(label).cast("int").alias("ff_y")).filter(F.col("ff_y").isin(0, 1) & F.col("ff_id").isNotNull())
    picked = known.withColumn("ff_key", F.xxhash64(F.lit(23), F.col("ff_id"))).orderBy("ff_key", "ff_id", "ff_y").limit(most_rows)
    picked = F.broadcast(picked)  # most_rows ids at most
    rows = docs.select("doc_id", F.col(text).alias("text")).join(picked, docs["doc_id"] == picked["ff_id"])
    rows = common.materialise(rows.select("ff_y", "text", (F.pmod("ff_key", F.lit(2)) == 0).alias("first")))
    classes = {r["first"]: r["n"] for r in rows.groupBy("first").agg(F.countDistinct("ff_y").alias("n")).collect()}
    both = classes.get(True, 0) == classes.get(False, 0) == 2
    weights = _weights(rows.filter("first")) if both else np.zeros((2, BUCKETS))
    rest = rows.filter("not first") if both else rows
    each = [*statistics(), ngram_score(weights, 1.0, 0.0), ngram_score(weights, 0.0, 1.0)]
    found = rest.select("ff_y", F.array(*[x.cast("double") for x in each]).alias("x")).toPandas()  # most_rows rows at most
    common.forget(rows)
    if found["ff_y"].nunique() < 2:
        return np.zeros(len(each)), 0.0, weights
    order = sorted(range(len(found)), key=lambda i: (found["ff_y"][i], list(found["x"][i])))
    return (*fit(np.array(found["x"].tolist())[order], found["ff_y"].to_numpy(float)[order]), weights)


def evidence(model: Model, text: str = "text") -> Column:
    """The classifier's probability as one expression; its coefficients and weights are literals."""
    w, b, weights = model
    z = F.lit(float(b))
    for c, s in zip(w, statistics(text)):
        z = z + F.lit(float(c)) * s
    z = z + ngram_score(weights, float(w[-2]), float(w[-1]), text)
    return F.least(F.lit(1 - EDGE), F.greatest(F.lit(EDGE), 1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), z))))))


def _strength(groups: DataFrame, mean: Column, prior: Column) -> Column:
    """Beta prior strength by moments: spread of group means beyond what their sizes explain, against prior(1-prior)."""
    w = F.col("n").cast("double")
    total = F.sum(w)
    spread = F.sum(w * (mean - prior) * (mean - prior)) / total
    inside = F.sum(F.greatest(F.lit(0.0), F.col("sq") - w * mean * mean)) / F.greatest(F.lit(1.0), total - F.count(F.lit(1)))
    between = F.greatest(F.lit(1e-9), spread - inside * F.count(F.lit(1)) / total)
    return F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.avg(prior * (1 - prior)) / between - 1))


def posteriors(scored: DataFrame, levels: tuple[str, ...] = ("host", "path")) -> DataFrame:
    """scored: the levels' columns, p and more; adds a posterior for each level (the last without the row itself) and posterior."""
    sums = [F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("sq")]
    sites = common.materialise(scored.groupBy(*levels).agg(*sums))
    mean = F.col("s") / F.col("n")
    above = sites.agg((F.sum("s") / F.sum("n")).alias("mu")).withColumn("m0", F.col("mu"))  # one row
    names: list[str] = []
    for depth, _ in enumerate(levels, 1):
        groups = sites.groupBy(*levels[:depth]).agg(*[F.sum(c).alias(c) for c in ("n", "s", "sq")])
        if names:
            same = [groups[c].eqNullSafe(above[f"of_{c}"]) for c in names]
            groups = groups.join(above, same).drop(*[f"of_{c}" for c in names])
        else:
            groups = groups.crossJoin(F.broadcast(above))  # one row
        prior = F.col(f"m{depth - 1}")
        strong = groups.agg(_strength(groups, mean, prior).alias(f"k{depth}"))
        groups = groups.crossJoin(F.broadcast(strong)).withColumn(f"m{depth}", (F.col(f"k{depth}") * prior + F.col("s")) / (F.col(f"k{depth}") + F.col("n")))
        names = list(levels[:depth])
        last = depth == len(levels)
        above = common.materialise(groups.select(*[F.col(c).alias(f"of_{c}") for c in names], "mu", *[f"m{i}" for i in range(depth + 1)], *([f"k{depth}", "n", "s"] if last else [])))
    out = scored.join(above, [scored[c].eqNullSafe(above[f"of_{c}"]) for c in levels])
    bound = lambda c: F.least(F.lit(1 - EDGE), F.greatest(F.lit(EDGE), c))
    odds = lambda c: F.ln(c / (1 - c))
    k, prior = F.col(f"k{len(levels)}"), F.col(f"m{len(levels) - 1}")
    local = bound((k * prior + F.col("s") - F.col("p")) / (k + F.col("n") - 1))
    z = odds(bound(F.col("p"))) + odds(local) - odds(bound(F.col("mu")))
    between = [F.col(f"m{i}").alias(f"{c}_posterior") for i, c in enumerate(levels[:-1], 1)]
    return out.select(*[scored[c] for c in scored.columns], *between, local.alias(f"{levels[-1]}_posterior"), (1 / (1 + F.exp(-z))).alias("posterior"))


def classify(docs: DataFrame, model: Model, levels: dict[str, Column], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of docs: its key, levels, p and posteriors. Texts are evaluated once."""
    scored = docs.select(F.col(key), *[c.alias(name) for name, c in levels.items()], evidence(model, text).alias("p"))
    return posteriors(common.materialise(scored), tuple(levels))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; hosts are sources and paths the languages within them, as documents carry no URL. Labels are learned
    from only where the id's fold is not the held-out one."""
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels").filter(common.fold("doc_id", 3) != 1))
    out = classify(docs, model, {"host": F.col("source"), "path": F.col("lang")})
    return out.select("doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), F.col("p").alias("evidence"), "host_posterior", "path_posterior", "posterior", (F.col("posterior") >= 0.5).alias("keep"))
