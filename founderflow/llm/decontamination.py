"""Benchmark decontamination: rare word pairs of test items seed a join with the passages, Smith-Waterman scores them.

Alignment. A stretch of a document is aligned with a test item word by word (match 2, mismatch -1, gap -1, local).
The score is divided by that of the whole item against itself; a document with a score of `threshold` or more for an
item is contaminated. So is one that holds an excerpt: an alignment worth EXCERPT matched words or more, however long
the item, so that its relative score may be below the threshold. Edits, insertions and dropped words lower the score
gently.

Seeds. Only pairs of a document and an item that may reach either bound are aligned, and all of them are: results
are those of aligning everything with everything. A score S of m matched words and k edits is 2 m - k. Of the m - 1
gaps between successive matches those with two edits or more use up k, so s = S / 2 - 1 gaps at least hold one edit or
none: there the two words are one or two places apart in the document, and one or two in the item, and each gap
begins at another word of the item. An item's ordered word pairs at distances one and two are ranked by how often
the corpus holds them. The most frequent are left out as long as they touch s - t words of the item at most, with
t = s / 3 rounded up: the pairs left, the rare seeds, then begin t of the s gaps at least, all within the 3 m - S words
that an alignment covers. So a join of seeds with the documents' pairs, and a count of the places met, lose nothing,
though no run of unchanged words is needed.

Steps, each over all rows, and none for each block of items: corpus counts of the items' pairs; the join of the seeds
with the documents' pairs, counted by text and item; texts met and their items' places sorted together, so that
a task holds one text at a time and cuts the stretches (other texts are not moved, but for those a Bloom filter lets through); stretches joined to their items and aligned in batches. Equal
texts are one (128-bit digests), so copies are aligned once. Sent to tasks: two tables of at most 2^24 flags and
that filter of at most 2^26 bits, which only spare the joins rows that meet nothing. Nothing else is collected; joins are Spark's to broadcast or shuffle.

Words are maximal runs of letters, digits and non-ASCII bytes, in lower case. Defined results: null and empty texts
and items without words hit nothing; items shorter than three words are hit where they occur whole, and longer
ones by two words at least, however low the threshold; items of a null id count and are reported with it; `hits` has
a row for each document row and item row, `op4` one for each document id (null is one id) with the best score of each item
id; ties of best items go to the smallest item id, a null one last; very long texts are cut to their stretches, one text in memory
at a time; an empty table on either side gives no hits; columns of any name pass through `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .neardup import likely

THRESHOLD, EXCERPT = 0.45, 13
MATCH, MISMATCH, GAP = 2, -1, -1
SHORT, STEPS, CELLS = 3, (1, 2), 1 << 18
FLAGS, SLICE, PART = 1 << 24, 1 << 20, 3


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return common.hashed_words(texts, common.is_not_word, "unicode")


def _pairs(words: np.ndarray, first: np.ndarray, step: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return common.mix(words[first] * common.BASE + words[first + step])


def _key(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def bounds(length: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of items of these lengths: the least score, the words an alignment covers at most, the gaps it holds at least."""
    least = np.where(length < SHORT, MATCH * length, np.maximum(MATCH + 1, np.minimum(MATCH * EXCERPT, np.ceil(threshold * MATCH * length - 1e-9)))).astype(np.int64)
    return least, 3 * length - least, np.maximum(1, -(-(least - MATCH) // 2))


def asked(items: DataFrame, threshold: float) -> DataFrame:
    """(digest, words, length, least, span, gaps, item) of the distinct texts of items that have words; item numbers them."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for start, size in common.batches(batch.column(1)):
                part = batch.slice(start, size)
                words, at = _words(part.column(1))
                length = np.diff(at)
                blobs = pa.array([words[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())
                numbers = [pa.array(x) for x in (length, *bounds(length, threshold))]
                out = pa.RecordBatch.from_arrays([part.column(0), blobs, *numbers], ["digest", "words", "length", "least", "span", "gaps"])
                yield out.filter(pa.array(length > 0))

    nodes = items.select(_key("text").alias("digest"), "text").filter("text is not null").groupBy("digest").agg(F.first("text").alias("text"))
    out = nodes.mapInArrow(common.lean(run), "digest binary, words binary, length long, least long, span long, gaps long")
    return common.materialise(out.withColumn("item", F.monotonically_increasing_id()))


def grams(table: DataFrame) -> DataFrame:
    """(item, value, place, a, b) of the items' word pairs and their two words; an item of one word has itself."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for item, blob in zip(batch.column(0), batch.column(1)):
                words = np.frombuffer(blob.as_py(), np.uint64)
                first = [np.arange(len(words) - step) for step in STEPS if len(words) > step]
                value = [_pairs(words, f, step) for f, step in zip(first, STEPS)]
                second = [words[f + step] for f, step in zip(first, STEPS)]
                if not first:
                    first, value, second = [np.zeros(1, np.int64)], [words], [words]
                place = np.concatenate(first)
                columns = [pa.array(np.concatenate(x).view(np.int64)) for x in (value, [words[place]], second)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), item.as_py())), columns[0], pa.array(place), *columns[1:]], ["item", "value", "place", "a", "b"])

    return table.select("item", "words").mapInArrow(common.lean(run), "item long, value long, place long, a long, b long")


def _flags(values: DataFrame) -> np.ndarray:
    """Where a hash's low bits are set, some of the values, of a single column, may be: at most FLAGS bytes."""
    flags = np.zeros(min(FLAGS, max(1 << 16, 1 << (32 * values.count()).bit_length())), bool)
    cell = F.expr(f"{values.columns[0]} & {len(flags) - 1}").cast("int").alias("cell")
    flags[values.select(cell).distinct().toPandas()["cell"].to_numpy(np.int64)] = True
    return flags


def _met(texts: pa.Array, word: np.ndarray, value: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, value) of the word pairs, and words if alone, that flags let through."""
    words, at = _words(texts)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = word[words & np.uint64(len(word) - 1)]
    first = [np.flatnonzero(inside[:-step] & inside[step:] & (doc[:-step] == doc[step:])) for step in STEPS]
    values = [_pairs(words, f, step) for f, step in zip(first, STEPS)]
    if alone:
        first, values = [*first, np.flatnonzero(inside)], [*values, words[inside]]
    first, values = np.concatenate(first), np.concatenate(values)
    may = np.flatnonzero(value[values & np.uint64(len(value) - 1)])
    first, values = first[may], values[may]
    return doc[first], first - at[doc[first]], values


def counted(docs: DataFrame, pairs: DataFrame, text: str, alone: bool) -> DataFrame:
    """(value, n): how often the documents hold the items' pairs; hashes that only resemble one are among them."""
    word, value = _flags(pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct()), _flags(pairs.select("value").distinct())
    sent = docs.sparkSession.sparkContext.broadcast((word, value))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for start, size in common.batches(batch.column(0), SLICE):
                _, _, got = _met(batch.column(0).slice(start, size), *sent.value, alone)
                got, n = np.unique(got, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(n)], ["value", "n"])

    return docs.select(text).mapInArrow(common.lean(run), "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))


def seeds(pairs: DataFrame, table: DataFrame, counts: DataFrame) -> DataFrame:
    """(item, value, span, least_met): the rare pairs of each item, and how many places of them an alignment holds."""
    ranked = pairs.join(counts, "value", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = [F.desc("n"), "value"]
    # A word of the item is touched by the more frequent of its two pairs; equal values are peers of one rank.
    ranked = ranked.withColumn("new", (F.row_number().over(Window.partitionBy("item", "place").orderBy(*order)) == 1).cast("int"))
    ranked = ranked.withColumn("touched", F.sum("new").over(Window.partitionBy("item").orderBy(F.struct((-F.col("n")).alias("n"), "value"))))
    ranked = ranked.join(table.select("item", "span", F.ceil(F.col("gaps") / PART).alias("least_met"), "gaps"), "item")
    return ranked.filter(F.col("touched") > F.col("gaps") - F.col("least_met")).select("item", "value", "span", "least_met").distinct()


def met(docs: DataFrame, rare: DataFrame, words: DataFrame, text: str, alone: bool) -> DataFrame:
    """(key, item, places, span, least_met) of texts and items with so many places of seeds within an alignment's span."""
    sent = docs.sparkSession.sparkContext.broadcast((_flags(words), _flags(rare.select("value").distinct())))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for start, size in common.batches(batch.column(1), SLICE):
                part = batch.slice(start, size)
                doc, place, value = _met(part.column(1), *sent.value, alone)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(place), pa.array(value.view(np.int64))], ["key", "place", "value"])

    places = docs.filter(F.col(text).isNotNull()).select(_key(text).alias("key"), text).mapInArrow(common.lean(run), "key binary, place long, value long")
    both = places.join(rare.select("item", "value"), "value").groupBy("key", "item").agg(F.collect_set("place").alias("places"))
    both = both.join(rare.select("item", "span", "least_met").distinct(), "item").filter(F.col("least_met") <= F.size("places"))
    both = both.withColumn("places", F.array_sort("places"))
    near = "exists(sequence(0, size(places) - cast(least_met as int)), j -> places[j + cast(least_met as int) - 1] - places[j] < span)"
    return both.filter(near)


def _stretches(places: np.ndarray, span: int, least_met: int, n: int) -> Iterator[tuple[int, int]]:
    """Where an alignment may lie in a text of n words: it holds least_met of the places and is no longer than the span."""
    first, last = places[:len(places) - least_met + 1], places[least_met - 1:]
    near = last - first < span
    low, high = np.maximum(last[near] - span, 0), np.minimum(first[near] + span + 1, n)
    start = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
    return zip(low[start].tolist(), high[np.append(start[1:], len(low)) - 1].tolist())


def stretches(docs: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """(key, item, stretch): word hashes of where the items may align. Texts and places are sorted together by text."""
    keys = common.materialise(found.select("key").distinct().withColumn("node", F.xxhash64("key")))
    rows = docs.filter(F.col(text).isNotNull()).select(_key(text).alias("key"), F.col(text).alias("text"))
    texts, _ = likely(rows.withColumn("node", F.xxhash64("key")), keys)  # so that a shuffle holds hardly more than the texts met
    texts = texts.select("key", "text").join(keys, "key", "left_semi")
    texts = texts.groupBy("key").agg(F.first("text").alias("text"))
    both = texts.select("key", F.lit(0).alias("kind"), "text", F.lit(None).cast("long").alias("item"), F.lit(None).cast("array<long>").alias("places"), F.lit(0).cast("long").alias("span"), F.lit(0).cast("long").alias("least_met"))
    both = both.unionByName(found.select("key", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("text"), "item", "places", "span", "least_met"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kinds = np.zeros(0, np.uint64), (pa.binary(), pa.int64(), pa.binary())
        for batch in batches:
            kind, span, least_met = (batch.column(k).to_pylist() for k in (1, 5, 6))
            out: list[tuple] = []
            size = 0
            for r in range(batch.num_rows):
                if kind[r] == 0:
                    words, _ = _words(batch.column(2).slice(r, 1))
                    continue
                key, item = batch.column(0)[r].as_py(), batch.column(3)[r].as_py()
                for low, high in _stretches(batch.column(4)[r].values.to_numpy(), span[r], least_met[r], len(words)):
                    out.append((key, item, words[low:high].tobytes()))
                    size += 8 * (high - low)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["key", "item", "stretch"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["key", "item", "stretch"])

    return both.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(common.lean(run), "key binary, item long, stretch binary")


def align(docs: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Local alignment scores of many pairs at once, row by row; the gap in a row is a running maximum."""
    if not docs:
        return np.zeros(0)
    rows, cols = max(map(len, items)), max(map(len, docs))
    a = np.zeros((len(docs), cols), np.uint64)
    b = np.zeros((len(docs), rows), np.uint64)
    b[:] = 1  # differs from the padding of a
    for k, (d, t) in enumerate(zip(docs, items)):
        a[k, :len(d)] = d
        b[k, :len(t)] = t
    ramp = -GAP * np.arange(cols + 1, dtype=np.int32)
    last = np.zeros((len(docs), cols + 1), np.int32)
    best = np.zeros(len(docs), np.int32)
    for r in range(rows):
        now = np.zeros_like(last)
        now[:, 1:] = np.maximum(last[:, :-1] + np.where(a == b[:, r:r + 1], MATCH, MISMATCH), last[:, 1:] + GAP)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp
        best = np.maximum(best, now.max(axis=1))
        last = now
    return best


def aligned(cut: DataFrame, table: DataFrame) -> DataFrame:
    """(key, item, score): the best relative score of each text and item that reaches the item's bound."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            least, length = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            sizes = np.array([len(x.as_buffer()) for x in batch.column(2)], np.int64) // 8
            order = np.lexsort((sizes, length))
            score = np.zeros(batch.num_rows)
            k = 0
            while k < len(order):
                # 256 pairs at once, and of long stretches fewer
                widest = np.maximum.accumulate(sizes[order[k:k + 256]])
                part = order[k:k + max(1, int(np.count_nonzero(widest * np.arange(1, len(widest) + 1) <= CELLS)))]
                k += len(part)
                sides = [[np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for i in part.tolist()] for c in (2, 3)]
                score[part] = align(*sides)
            high = np.flatnonzero(score >= least)
            some = pa.array(high)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(score[high] / (MATCH * length[high]))], ["key", "item", "score"])

    both = cut.join(table, "item").select("key", "item", "stretch", "words", "least", "length")
    return both.mapInArrow(common.lean(run), "key binary, item long, score double").groupBy("key", "item").agg(F.max("score").alias("score"))


def matches(docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, item, score) of the digests of texts and items that align at the threshold or above or by an excerpt."""
    table = asked(items.select("text"), threshold)
    pairs = common.materialise(grams(table))
    alone = not table.filter("length = 1").isEmpty()
    rare = common.materialise(seeds(pairs, table, counted(docs, pairs, text, alone)))
    words = pairs.join(rare.select("item", "value"), ["item", "value"], "left_semi").select(F.explode(F.array("a", "b")).alias("w")).distinct()
    found = common.materialise(met(docs, rare, words, text, alone))
    scored = aligned(stretches(docs, found, text), table).join(table.select("item", "digest"), "item")
    return common.materialise(scored.select("key", F.col("digest").alias("item"), "score"))


def hits(docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score) of aligned pairs at or above the threshold or an excerpt's worth; one row a document row and item row."""
    found = matches(docs, items, text, threshold)
    named = items.select(F.col("item_id").cast("long"), _key("text").alias("item"))
    rows = docs.select(F.col("doc_id").cast("long"), _key(text).alias("key"))
    return rows.join(found.join(named, "item"), "key").select("doc_id", "item_id", "score")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the contaminated rows: a join that leaves documents where they are while the contaminated digests are few."""
    docs, named = common.shielded(docs, "ff_key")
    gone = matches(docs, items, text, threshold).select(F.col("key").alias("ff_key")).distinct()
    return named(docs.withColumn("ff_key", _key(text)).join(gone, "ff_key", "left_anti"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents: each with its items found, the best of them and its alignment score."""
    found = hits(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    best = F.min_by("item_id", F.struct(-F.col("score"), F.col("item_id").isNull(), F.col("item_id")))
    return found.groupBy("doc_id").agg(best.alias("item_id"), F.max("score").alias("score"), F.array_sort(F.collect_set("item_id")).alias("items"))
