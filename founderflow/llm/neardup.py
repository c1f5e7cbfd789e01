"""Near-duplicates of weighted word shingles: BagMinHash signatures, banding, verified multiset overlap.

A text is the multiset of its five-word shingles. For each shingle and each dyadic block of its discretised weight
([0,1), [1,2), [2,4), [4,8), ... in units of `unit`) a Poisson process, seeded by shingle and block, deals points to
the signature's components; a point's place in its block is refined bit by bit, so that it counts only if it lies
below the weight. The first point of each component is its value: two signatures agree in a component with
probability equal to the weighted Jaccard similarity. Points later than a text's horizon cannot win once all its
components are filled, so the horizon grows until they are; its start makes that rare. Work a text is in proportion
to its shingles plus components, whatever the weights.

Links. Texts with equal multisets are one node (by a 128-bit digest), pre-aggregated. Nodes that share a band are
compared with their bucket's most central node first (the one that meets most others in all its buckets), by exact
multiset overlap of whole texts; connected components then merge most buckets into one. Where a bucket still spans
components, the pairs across them are verified too: of small buckets as they are, of large ones after an exact
prefix filter. So
no link between different texts that share a band is lost, while no group of copies is expanded into its pairs.
Shingles are compared by 48 bits of their hash: two texts of 20,000 words have a chance of 2e-6 that two different ones are taken for one.
With 24 bands of 4 a pair at similarity 0.8 shares a band with probability 1 - 3e-6. Components come from
alternating large-star and small-star steps.

Nothing is collected: nodes, pairs and components are tables in the shared folder. Hot buckets meet in joins that
adaptive execution splits, and in partial aggregates. Defined results: null and empty texts have no shingle and
are one class; texts of fewer than five words are one shingle; a repeated row is a copy; a class is named by its
smallest doc_id (null if none has one); an empty table gives no rows; extra columns pass through `survivors`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 4
U64 = np.uint64
LOW48 = U64((1 << 48) - 1)
SMALL = 12  # members of a bucket up to which its pairs across components are listed
STEP = U64(0xD1342543DE82EF95)


def bags(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, multiplicity) of all shingles of a batch of at most 65,536 texts, sorted by text and element."""
    words, at = common.hashed_words(texts)
    h, doc, _ = common.ngrams(words, at, shingle)
    sizes = np.diff(at)
    for n in range(1, shingle):  # texts shorter than a shingle
        few = np.flatnonzero(sizes == n)
        if len(few):
            g, d, _ = common.ngrams(words, at, n)
            only = np.isin(d, few)
            h, doc = np.concatenate([h, g[only]]), np.concatenate([doc, d[only]])
    keys = np.sort((doc.astype(U64) << U64(48)) | (h & LOW48))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return (keys >> U64(48)).astype(np.int64), keys & LOW48, count


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """n by m signatures, each component the bits of its first point's time; texts without elements are all ones."""
    out = np.full((n, m), np.inf)
    total = np.bincount(doc, weight, n)
    todo = np.flatnonzero(total > 0)
    horizon = np.zeros(n)
    horizon[todo] = (np.log(m) + 4.0) / total[todo]
    with np.errstate(over="ignore"):
        while len(todo):
            wanted = np.zeros(n, bool)
            wanted[todo] = True
            rows = np.flatnonzero(wanted[doc])
            block, low = 0, 0
            while len(rows):
                length = max(1, low)
                _points(doc[rows], element[rows], weight[rows], block, low, length, horizon, out, m)
                block, low = block + 1, low + length
                rows = rows[weight[rows] > low]
            todo = todo[np.isinf(out[todo]).any(axis=1)]
            horizon[todo] *= 2
    return out.view(U64)


def _points(doc, element, weight, block, low, length, horizon, out, m):
    """The points, up to each text's horizon, of the processes of one block of weights, for many elements at once."""
    flat = out.reshape(-1)
    seed = common.mix(element * STEP + U64(block))
    t = np.zeros(len(doc))
    limit = horizon[doc]
    turn = 0
    while len(doc):
        draw = common.mix(seed + U64(3 * turn) * STEP)
        t = t - np.log(common.unit(draw)) / (m * length)
        alive = np.flatnonzero(t <= limit)
        doc, weight, seed, t, limit = doc[alive], weight[alive], seed[alive], t[alive], limit[alive]
        where = (common.mix(seed + U64(3 * turn + 1) * STEP) % U64(m)).astype(np.int64)
        place = doc * m + where
        when = t
        if length > 1:
            level = low + (common.unit(common.mix(seed + U64(3 * turn + 2) * STEP)) * length).astype(np.int64)
            inside = np.flatnonzero(level < weight)
            place, when = place[inside], t[inside]
        np.minimum.at(flat, place, when)
        turn += 1


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets given as (sorted elements, multiplicities); of two empty ones 1."""
    at = np.minimum(np.searchsorted(b[0], a[0]), max(0, len(b[0]) - 1))
    both = np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum() if len(a[0]) and len(b[0]) else 0
    every = a[1].sum() + b[1].sum() - both
    return float(both / every) if every else 1.0


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    for start, size in common.batches(texts):
        for k in range(start, start + size, 1 << 16):
            yield k, min(1 << 16, start + size - k)


def signed(docs: DataFrame, text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs plus ff_row, ff_digest and ff_bands, written to the shared folder so that row numbers are stable."""
    numbered = docs.withColumn("ff_row", F.monotonically_increasing_id())
    column, names = docs.columns.index(text), [*numbered.columns, "ff_digest", "ff_bands"]
    schema = T.StructType([*numbered.schema.fields, T.StructField("ff_digest", T.BinaryType()), T.StructField("ff_bands", T.ArrayType(T.LongType()))])
    m = bands * rows

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for start, n in _slices(batch.column(column)):
                part = batch.slice(start, n)
                doc, element, weight = bags(part.column(column))
                sig = signatures(doc, element, weight, n, m)
                with np.errstate(over="ignore"):
                    key = np.zeros((n, bands), U64) + np.arange(bands, dtype=U64)
                    for r in range(rows):
                        key = common.mix(key * common.BASE + sig[:, r::rows])
                    digest = np.zeros((n, 2), U64)
                    for k in (0, 1):
                        each = common.mix(element * STEP + weight.astype(U64) + U64(k) * common.BASE)
                        sums = np.concatenate([np.zeros(1, U64), np.cumsum(each)])
                        at = np.searchsorted(doc, np.arange(n + 1))
                        digest[:, k] = sums[at[1:]] - sums[at[:-1]]
                blobs = digest.tobytes()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(key.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([blobs[16 * i:16 * i + 16] for i in range(n)], pa.binary()), lists], names)

    return common.materialise(numbered.mapInArrow(common.lean(run), schema))


def likely(rows: DataFrame, nodes: DataFrame, node: str = "node", most_bits: int = 1 << 26) -> tuple[DataFrame, DataFrame]:
    """Rows whose node may be in nodes, and the others, by a Bloom filter of most_bits bits at most, which is sent to
    all tasks. It spares the following exact join most of the texts; what it lets through in error goes there."""
    at_column = rows.columns.index(node)
    bits = min(most_bits, max(1 << 12, 1 << int(16 * nodes.count()).bit_length()))

    def places(node: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            return [(common.mix(node.astype(np.int64).view(U64) * STEP + U64(k)) % U64(bits)).astype(np.int64) for k in range(4)]

    def mark(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            at = np.unique(np.concatenate(places(batch.column(0).to_numpy())))
            word = np.zeros(bits >> 6, np.int64)
            np.bitwise_or.at(word, at >> 6, np.left_shift(np.int64(1), at & 63))
            some = np.flatnonzero(word)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(word[some])], ["i", "w"])

    got = nodes.select("node").mapInArrow(common.lean(mark), "i long, w long").groupBy("i").agg(F.bit_or("w").alias("w")).toPandas()
    word = np.zeros(bits >> 6, np.int64)
    word[got["i"].to_numpy(np.int64)] = got["w"].to_numpy(np.int64)
    sent = rows.sparkSession.sparkContext.broadcast(word)

    def sieve(wanted: bool):
        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in found:
                may = np.ones(batch.num_rows, bool)
                for at in places(batch.column(at_column).to_numpy()):
                    may &= (np.right_shift(sent.value[at >> 6], at & 63) & 1).astype(bool)
                yield batch.filter(pa.array(may == wanted))

        return rows.mapInArrow(common.lean(run), rows.schema)

    return sieve(True), sieve(False)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose multisets overlap enough. texts: node and text of all nodes."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for start, n in _slices(batch.column(2)):
                part = batch.slice(start, n)
                sides = []
                for k in (2, 3):
                    doc, element, weight = bags(part.column(k))
                    at = np.searchsorted(doc, np.arange(n + 1))
                    sides.append([(element[at[i]:at[i + 1]], weight[at[i]:at[i + 1]]) for i in range(n)])
                near = [overlap(x, y) >= similarity for x, y in zip(*sides)]
                yield part.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(common.lean(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes with an edge (a, b); root is the smallest node of the component."""
    now = common.materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    state = mark(now)
    while True:
        sym = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sym.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        after = common.materialise(small)
        common.forget(now)
        now, before, state = after, state, mark(after)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _expanded(element: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A multiset as a set: the k-th copy of an element is an element of its own."""
    copy = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    with np.errstate(over="ignore"):
        return np.where(copy == 0, np.repeat(element, weight), common.mix(np.repeat(element, weight) + copy.astype(U64) * STEP) & LOW48)


def _least_overlap(x, y, similarity: float):
    return np.ceil(similarity / (1 + similarity) * (x + y) - 1e-9)


def across(texts: DataFrame, marks: DataFrame, similarity: float, cells: int = 1 << 18, width: float = 1.05) -> DataFrame:
    """All pairs (a, b) that may be similar and are in different components, one side of them being minor.

    marks: node, root, minor. An exact prefix filter: in one common order of all shingles, two sets of sizes x and y
    with an overlap of o or more share one among the first x - o + 1 of the one and y - o + 1 of the other. The order
    is by frequency in `cells` hash cells (bounded, sent to all tasks), rare ones first, so members of a large
    group of copies that differ from all others by their own edits meet nobody. Sizes are classed in steps of
    `width`, so that a prefix is no longer than the class of the other side needs.
    """
    spark = texts.sparkSession
    marked = common.materialise(texts.join(marks, "node").select("node", "root", "minor", "text"))

    def bags_of(batch: pa.RecordBatch):
        for start, n in _slices(batch.column(3)):
            part = batch.slice(start, n)
            doc, element, weight = bags(part.column(3))
            at = np.searchsorted(doc, np.arange(n + 1))
            for i in range(n):
                yield part.column(0)[i].as_py(), part.column(1)[i].as_py(), part.column(2)[i].as_py(), _expanded(element[at[i]:at[i + 1]], weight[at[i]:at[i + 1]])

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in found:
            for *_, tokens in bags_of(batch):
                total += np.bincount((tokens % U64(cells)).astype(np.int64), minlength=cells)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    often = np.zeros(cells, np.int64)
    got = marked.mapInArrow(common.lean(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    often[got["cell"].to_numpy()] = got["n"].to_numpy()
    sent = spark.sparkContext.broadcast(often)
    names = ["side", "token", "class", "node", "root", "place", "size"]

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of = lambda n: int(np.floor(np.log(n) / np.log(width)))
        for batch in found:
            out: list[list] = [[] for _ in names]

            def put(side, tokens, size_class, node, root, size):
                for column, value in zip(out, (np.full(len(tokens), side), tokens.view(np.int64), np.full(len(tokens), size_class), np.full(len(tokens), node), np.full(len(tokens), root), np.arange(len(tokens)), np.full(len(tokens), size))):
                    column.append(value)

            for node, root, minor, tokens in bags_of(batch):
                n = len(tokens)
                if not n:
                    continue
                tokens = tokens[np.lexsort((tokens, sent.value[(tokens % U64(cells)).astype(np.int64)]))]
                put(0, tokens[:int(n - np.ceil(similarity * n - 1e-9)) + 1], class_of(n), node, root, n)
                if minor:
                    for c in range(class_of(max(1, np.ceil(similarity * n - 1e-9))), class_of(n / similarity + 1) + 1):
                        least = max(np.ceil(width**c - 1e-9), np.ceil(similarity * n - 1e-9))
                        put(1, tokens[:max(0, int(n - _least_overlap(n, least, similarity)) + 1)], c, node, root, n)
            if out[0]:
                kinds = [np.int32, np.int64, np.int32, np.int64, np.int64, np.int32, np.int32]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(k)) for x, k in zip(out, kinds)], names)

    rows = marked.mapInArrow(common.lean(cut), "side int, token long, class int, node long, root long, place int, size int")
    y, x = (rows.filter(F.col("side") == k).select("token", "class", *[F.col(c).alias(f"{c}_{k}") for c in names[3:]]) for k in (0, 1))
    least = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("size_0") + F.col("size_1")) - 1e-9)
    near = (F.col("root_0") != F.col("root_1")) & (F.col("place_0") <= F.col("size_0") - least) & (F.col("place_1") <= F.col("size_1") - least)
    met = x.join(y, (x["token"] == y["token"]) & (x["class"] == y["class"]) & near)
    return met.select(F.least("node_0", "node_1").alias("a"), F.greatest("node_0", "node_1").alias("b")).distinct()


def classes(rows: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(ff_row, root) of all rows of signed(): equal roots are one class."""
    slim = rows.select("ff_row", "ff_digest", "ff_bands")
    nodes = common.materialise(slim.groupBy("ff_digest").agg(F.min("ff_row").alias("node"), F.first("ff_bands").alias("bands")))
    spread = nodes.select("node", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = common.materialise(spread.join(shared, "key").select("key", "node", "n"))
    central = held.groupBy("node").agg(F.sum(F.col("n") - 1).alias("met"))
    texts, _ = likely(rows.select(F.col("ff_row").alias("node"), F.col(text).alias("text")), central)
    texts = common.materialise(texts.join(central, "node", "left_semi"))
    lead = held.join(central, "node").groupBy("key").agg(F.max(F.struct("met", (-F.col("node")).alias("node"))).alias("x")).select("key", (-F.col("x.node")).alias("leader"))
    pairs = held.join(lead, "key").filter("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    edges = common.materialise(verified(pairs, texts, similarity))
    roots = components(edges)
    # What the leader's comparisons leave open: buckets whose other members are of several components.
    at = held.join(lead, "key").filter("node <> leader").join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    at = common.materialise(at)
    parts = at.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("x"), F.count(F.lit(1)).alias("k"))
    open_ = common.materialise(at.join(parts.filter("k > 1").select("key", F.col("x.root").alias("main")), "key"))
    few = open_.filter(F.col("n") <= SMALL).select("key", "node", "root")
    pairs = few.join(few.select("key", F.col("node").alias("other"), F.col("root").alias("oroot")), "key").filter("node < other and root <> oroot").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    marks = open_.filter(F.col("n") > SMALL).groupBy("node").agg(F.min("root").alias("root"), F.max(F.col("root") != F.col("main")).alias("minor"))
    marks = common.materialise(marks)
    if not marks.isEmpty():
        pairs = pairs.unionByName(across(texts, marks, similarity)).distinct()
    more = common.materialise(verified(pairs, texts, similarity))
    if not more.isEmpty():
        roots = components(edges.unionByName(more))
    named = nodes.select("ff_digest", "node").join(roots, "node", "left").select("ff_digest", F.coalesce("root", "node").alias("root"))
    return slim.select("ff_row", "ff_digest").join(named, "ff_digest").select("ff_row", "root")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its class, named by the smallest doc_id of its members, and the class's size."""
    rows = signed(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = common.materialise(classes(rows).join(rows.select("ff_row", "doc_id"), "ff_row").select("doc_id", "root"))
    named = found.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return found.join(named, "root").select("doc_id", "class_id", "class_size")


def survivors(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each class stays: that of the smallest doc_id, of equal ids the first written."""
    docs, named = common.shielded(docs, "ff_row", "ff_digest", "ff_bands", "ff_id")
    rows = signed(docs, text)
    found = classes(rows, text).join(rows.select("ff_row", F.col("doc_id").alias("ff_id")), "ff_row")
    keep = found.groupBy("root").agg(F.min(F.struct(F.col("ff_id").isNull(), "ff_id", "ff_row")).alias("k")).select(F.col("k.ff_row").alias("ff_row"))
    gone = common.materialise(rows.select("ff_row").join(keep, "ff_row", "left_anti"))
    maybe, sure = likely(rows.select(*docs.columns, "ff_row"), gone.withColumnRenamed("ff_row", "node"), "ff_row")
    return named(sure.unionByName(maybe.join(gone, "ff_row", "left_anti").select(*docs.columns, "ff_row")).select(*docs.columns))
