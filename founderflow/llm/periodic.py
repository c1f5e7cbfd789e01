"""Periodic runs in texts: stretches of words that repeat with a period, as loops of generated or scraped text do.

A run is a maximal stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
`exponent` periods and `least` words.

Method. A suffix automaton of the words; its states are sets of substrings that end at the same places. From the longest
states to the shortest, a state's ordered end positions are merged into its suffix link's, the smaller set into the
larger. Two ends that become neighbours there, one from either side, have exactly the state's length of words before
them in common, so that length cannot be extended to the left; if their distance d does not exceed it, a square of
period d begins at its start. Seeds of one start and period belong to one run, which extends to the last of their ends: in
a run with smallest period q the ends e - q and e have no end between them in any state of q words or more, so they become
neighbours at some state, for its last word e too. Only seeds that can belong to `exponent` periods are kept. Ends that
were neighbours until others came between them give multiples of the smallest period: they share its start and reach no further,
and go.

A filter without loss comes first: each word of a run stands at least `exponent` times in it, so words rarer than that in
their stretch split it, and so on until nothing changes; array passes over a whole batch do that. What is left of
ordinary text is little, and automata are built for that only.

Words are maximal runs of bytes other than ASCII white space. They are compared by 64-bit hashes of theirs: two of a text's million
words are confused with probability 3e-8. Defined results: a null text has no words, no runs and an empty collapsed
text; so have empty ones; repeated rows are worked on each; extra columns pass through, and where one has the name of a
result, that name gets an underscore at its end; an empty table gives no rows. A text is one row's work: memory is some
80 bytes for each of its repetitive words.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

EXPONENT, LEAST, ROUNDS = 4, 6, 32


class Automaton:
    """Suffix automaton of a list of small integers. A state's first transition is kept in arrays, others in a table."""

    def __init__(self, words: list[int]):
        self.size, self.link, self.own = array("q", [0]), array("q", [-1]), array("q", [-1])
        self.by, self.to, self.more = array("q", [-1]), array("q", [-1]), {}
        size, link, own, by, to, more = self.size, self.link, self.own, self.by, self.to, self.more

        def put(state: int, word: int, target: int) -> None:
            if by[state] in (-1, word):
                by[state], to[state] = word, target
            else:
                more.setdefault(state, {})[word] = target

        def got(state: int, word: int) -> int:
            return to[state] if by[state] == word else more[state].get(word, -1) if state in more else -1

        def new(length: int, end: int) -> int:
            for column, value in zip((size, link, own, by, to), (length, 0, end, -1, -1)):
                column.append(value)
            return len(size) - 1

        last = 0
        for end, word in enumerate(words):
            state = new(end + 1, end)
            p = last
            while p >= 0 and (target := got(p, word)) < 0:
                put(p, word, state)
                p = link[p]
            last = state
            if p < 0:
                continue
            if size[target] == size[p] + 1:
                link[state] = target
                continue
            clone = new(size[p] + 1, -1)
            by[clone], to[clone], link[clone] = by[target], to[target], link[target]
            if target in more:
                more[clone] = dict(more[target])
            link[target] = link[state] = clone
            while p >= 0 and got(p, word) == target:
                put(p, word, clone)
                p = link[p]

    def seeds(self, exponent: int) -> dict[tuple[int, int], int]:
        """(start, period) of squares that may belong to runs of that exponent: their last end."""
        size, link, own = self.size, self.link, self.own
        out: dict[tuple[int, int], int] = {}

        def meet(i: int, j: int, length: int) -> None:
            if (exponent - 1) * (j - i) <= length:
                key = i - length + 1, j - i
                if out.get(key, -1) < j:
                    out[key] = j

        ends: list[list[int] | None] = [None] * len(size)  # end positions, negated, so that the usual next one goes last
        for v in np.argsort(-np.frombuffer(size, np.int64), kind="stable").tolist():
            length, mine, p = size[v], ends[v], link[v]
            if own[v] >= 0:  # the least of the state's ends
                if mine is None:
                    mine = [-own[v]]
                else:
                    meet(own[v], -mine[-1], length)
                    mine.append(-own[v])
            ends[v] = None
            if p <= 0:
                continue
            held = ends[p]
            if held is None:
                ends[p] = mine
                continue
            few, many = (mine, held) if len(mine) < len(held) else (held, mine)
            length, before = size[p], None
            for x in few:
                k = bisect_left(many, x)
                if k < len(many):
                    meet(-many[k], -x, length)
                if k and many[k - 1] != before:
                    meet(-x, -many[k - 1], length)
                many.insert(k, x)
                before = x
            ends[p] = many
        return out


def runs_of(words: list[int], exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    out: list[tuple[int, int, int]] = []
    reach: dict[int, int] = {}
    for (start, period), end in sorted(Automaton(words).seeds(exponent).items()):
        if end > reach.get(start, -1):  # else the words up to this end have a smaller period
            reach[start] = end
            if end - start + 1 >= max(least, exponent * period):
                out.append((start, end - start + 1, period))
    return out


def stretches(words: np.ndarray, text: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that may be in runs, and the number of the stretch of each: stretches hold all runs."""
    place, part = np.arange(len(words)), text.astype(np.int64)
    for _ in range(ROUNDS):
        if not len(place):
            break
        with np.errstate(over="ignore"):
            key = common.mix(words[place] + part.astype(np.uint64) * common.BASE)
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        keep = times[which] >= exponent
        kept, of = place[keep], part[keep]
        new = np.ones(len(kept), bool)
        new[1:] = (kept[1:] != kept[:-1] + 1) | (of[1:] != of[:-1])
        part = np.cumsum(new) - 1
        long = np.bincount(part, minlength=1)[part] >= least if len(part) else part.astype(bool)
        done = keep.all() and long.all()
        place, part = kept[long], part[long]
        if done:
            break
    return place, part


def runs_in(words: np.ndarray, at: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of each text of a batch, from its words' hashes and the texts' offsets."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(at) - 1)]
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place, part = stretches(words, text, exponent, least)
    edge = np.flatnonzero(np.diff(part)) + 1
    for low, high in zip([0, *edge.tolist()], [*edge.tolist(), len(place)]):
        if low == high:
            continue
        here = place[low:high]
        _, symbols = np.unique(words[here], return_inverse=True)
        k = int(text[here[0]])
        first = int(here[0] - at[k])
        out[k] += [(first + s, n, q) for s, n, q in runs_of(symbols.tolist(), exponent, least)]
    return out


def _collapsed(text: bytes, order: np.ndarray | None, runs: list[tuple[int, int, int]]) -> str:
    words = text.split()
    if order is not None:
        words = [words[i] for i in order.tolist()]
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period:start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words).decode()


def with_runs(docs: DataFrame, text: str = "text", exponent: int = EXPONENT, least: int = LEAST, order: tuple[str, Callable[[object, int], np.ndarray | None]] | None = None) -> DataFrame:
    """docs plus runs, by start and period, and collapsed, the words joined by blanks without those that repeat a period.

    order: a column and a function of its value and the number of words, which gives the words' new order (places of the
    text's words) or None for the text as it is. A map over rows, without a shuffle."""
    names = docs.columns
    column, by = names.index(text), names.index(order[0]) if order else 0
    added = [common.fresh(docs, c) for c in ("runs", "collapsed")]
    run_type = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], run_type), T.StructField(added[1], T.StringType())])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for start, size in common.batches(batch.column(column)):
                part = batch.slice(start, size)
                words, at = common.hashed_words(part.column(column), lower="none")
                orders: list[np.ndarray | None] = [None] * size
                if order:
                    for i, value in enumerate(part.column(by).to_pylist()):
                        orders[i] = order[1](value, int(at[i + 1] - at[i]))
                    pieces = [words[at[i]:at[i + 1]] if o is None else words[at[i]:at[i + 1]][o] for i, o in enumerate(orders)]
                    words = np.concatenate(pieces)
                    at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
                runs = runs_in(words, at, exponent, least)
                texts = part.column(column).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
                collapsed = [_collapsed(t or b"", o, r) for t, o, r in zip(texts, orders, runs)]
                listed = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(listed, arrow), pa.array(collapsed, pa.string())], [*names, *added])

    return docs.mapInArrow(run, schema)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of all ids, an order of words that repeats from some word on: the query's known cases."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % p
    return out


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs and its text without their repetitions, after runs were planted in a tenth of them."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    got = with_runs(docs, order=("doc_id", planted)).select("doc_id", "runs", "collapsed")
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    got = got.withColumn("best", longest)
    return got.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.n")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(-F.col("best.n") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
