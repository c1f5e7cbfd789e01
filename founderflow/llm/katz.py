"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights, partitioned tables.

    P(w | h) = d(c) c(h w) / c(h)      if c(h w) > 0, with Katz's discount d for counts up to 5
             = a(h) P(w | shorter h)   otherwise; a(h) = (1 - sum of the upper line) / (1 - sum of P(w | shorter h)
                                       over the w of the upper line), so that all probabilities add up to 1
    P(w)     = d(c) c(w) / N, and what the discounts leave is the probability of the one unknown word

Tables. A level of the model is a table of n-grams: (context, word) -> 64-bit count, and context -> backoff weight. It
is partitioned by a hash of the context, so a context's counts, the sums over its continuations and its weight need
no further exchange. Contexts that occur `hot` times or more are partitioned by n-gram instead; their sums are added
up apart (at most 2^20 such contexts, as `hot` is at least a 2^20th of the tokens, so they can be sent to all tasks).
Words are numbered by the partition that counts them, and so is every n-gram; an n-gram's key is the number of
its context and the number of its last word, so only words are hashed, n-grams are exact: two of V words share a
64-bit hash with probability V^2 / 2^65 (3e-8 for a million words).

Exchange, a level at a time. Texts are packed in blocks of some megabytes. A block sends, by partition, each distinct
n-gram it holds once, with its count in training texts: so a very common n-gram is an entry a block, not one a token.
What a lower level has shown not to exist is not asked for. The partition adds up the counts, writes its piece of the
table and answers each block. N-grams longer than pairs go in ROUNDS, so that a share of them is on disk at a time. There are 256 partitions for each 512 blocks, so up to that size a block is 256
rows of the exchange and rows grow with the input; beyond it a row is a block's n-grams of one partition,
never more rows than n-grams. Nothing else is collected but the counts of counts. Shuffle files are removed as soon
as their level is written.

Every token of a text, its end included, is evaluated by the recursion; `Scorer.score` does so for texts that the model
has not seen, from the stored tables. If discounts leave nothing to a context (all its counts above 5), its counts are
divided by c(h) + 1. If counts of counts give no valid Good-Turing discount, absolute discounting n1 / (n1 + 2 n2)
stands in for it.

Defined results: null texts are empty and consist of the end alone; repeated rows each count; without training rows
all words are the unknown word of probability 1; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

U64 = np.uint64
END = U64(0xE4D0F7E9A1B2C3D5)
CUT = 5
TEXT_BYTES = 4 << 20
PARTS, BLOCKS_A_ROUND = 256, 512
HOT = 1 << 16
ROUNDS = 2  # in which n-grams longer than pairs are exchanged, a share of the partitions each: half the disk, some more time
UNKNOWN = -1  # of an n-gram; 0 is the beginning of a text, others are numbered from 1
BLOCK = "block long, doc_ids array<bigint>, held binary, vocab binary, tokens binary"
ASK = "part int, block long, blob binary"
ANSWER = "level int, part int, block long, blob binary, stats array<bigint>, hot array<struct<ctx:bigint,n:bigint,n1:bigint,n2:bigint,n3:bigint,n4:bigint,n5:bigint,lower:double>>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
TABLE, HEAD = -1, -2  # in place of a block's number: a piece of a table; what a piece sends to all
SUMS = ["n", *[f"n{r}" for r in range(1, CUT + 1)], "lower"]  # of a context: its count, its types by low counts, P of them a level lower


def freeze(*arrays: np.ndarray) -> bytes:
    """Arrays of doubles, or of integers from 0, as one compressed blob; integers as planes of as many bytes as needed."""
    head, body = [len(arrays)], []
    for x in arrays:
        width = 0
        if x.dtype.kind != "f":
            x = np.ascontiguousarray(x).astype(U64)
            width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
            x = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
        body.append(x.tobytes())
        head += [len(body[-1]) // (width or 8), width]
    raw = b"".join(body)
    return np.array([*head, len(raw)], np.int64).tobytes() + pa.Codec("zstd").compress(raw, asbytes=True)


def thaw(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    head = np.frombuffer(blob, np.int64, 2 * n + 1, 8).tolist()
    raw = pa.Codec("zstd").decompress(blob[16 * n + 16:], head[-1], asbytes=True)
    out, at = [], 0
    for size, width in zip(head[0:-1:2], head[1:-1:2]):
        if width:
            wide = np.zeros((size, 8), np.uint8)
            wide[:, :width] = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
            out.append(wide.reshape(-1).view(np.int64))
        else:
            out.append(np.frombuffer(raw, np.float64, size, at))
        at += size * (width or 8)
    return out


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct values of integers from 0, the first place of each, and each element's value's number."""
    n, x = len(x), x.view(U64)
    bits = U64(max(1, n - 1).bit_length())
    if int(x.max(initial=0)).bit_length() + int(bits) <= 64:  # value and place in one word: sorting needs no second array
        both = np.sort((x << bits) | np.arange(n, dtype=U64))
        order, values = (both & ((U64(1) << bits) - U64(1))).astype(np.int64), both >> bits
    else:
        order = np.argsort(x, kind="stable")
        values = x[order]
    new = np.ones(n, bool)
    new[1:] = values[1:] != values[:-1]
    of = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    of[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return values[first].view(np.int64), order[first], of


def by_part(part: np.ndarray) -> np.ndarray:
    return np.argsort(part.astype(np.uint16 if part.max(initial=0) < 1 << 16 else np.int64), kind="stable")


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (((hashes.view(U64) >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)


def packed(docs: DataFrame, held: Column, text: str = "text") -> DataFrame:
    """Blocks of whole texts, written to the shared folder, so that later passes see the same blocks."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        kept: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            ids, flags, sizes, tokens = zip(*kept)
            vocab, _, of = distinct(np.concatenate(tokens))
            blobs = (freeze(np.concatenate(flags), np.concatenate(sizes)), freeze(np.diff(vocab.view(U64), prepend=U64(0))), freeze(of))
            out = [pa.array([number], pa.int64()), pa.array([[i for x in ids for i in x.to_pylist()]], pa.list_(pa.int64())), *[pa.array([b], pa.binary()) for b in blobs]]
            number, size = number + 1, 0
            kept.clear()
            return pa.RecordBatch.from_arrays(out, [c.split()[0] for c in BLOCK.split(", ")])

        for batch in found:
            for start, n in common.batches(batch.column(1)):
                part = batch.slice(start, n)
                words, at = common.hashed_words(part.column(1))
                ends = at[1:] + np.arange(n)
                tokens = np.empty(len(words) + n, U64)
                inner = np.ones(len(tokens), bool)
                inner[ends] = False
                tokens[ends], tokens[inner] = END, words
                kept.append((part.column(0), np.asarray(part.column(2).to_numpy(zero_copy_only=False), bool), np.diff(at) + 1, tokens))
                size += part.column(1).nbytes
                if size >= TEXT_BYTES:
                    yield flush()
        if kept:
            yield flush()

    return common.materialise(docs.select(F.col("doc_id").cast("long"), F.col(text), held).mapInArrow(run, BLOCK), "uncompressed")


class Model:
    """What all blocks share: counts of counts by level, and the weights of hot contexts."""

    def __init__(self, order: int, parts: int):
        self.order, self.parts, self.total, self.texts, self.types = order, parts, 0, 0, 0
        self.unknown, self.scale, self.hot_from = 1.0, 1.0, HOT
        self.discounts: dict[int, np.ndarray] = {}
        self.hot: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def counted(self, level: int, stats: list[int]) -> None:
        """Takes a level's number of types, of tokens, of types seen 1 to CUT + 1 times, and of texts."""
        self.discounts[level] = self._discounts(stats[2:CUT + 3])
        if level == 1:
            self.types, self.total, self.texts = stats[0], stats[1], stats[-1]
            self.hot_from = max(HOT, self.total >> 20)
            left = sum((1 - self.discounts[1][r]) * r * stats[1 + r] for r in range(1, CUT + 1)) / max(1, self.total)
            self.unknown = left if left > 0 else 1 / (self.total + 1)
            self.scale = 1.0 if left > 0 else 1 - self.unknown
            if self.total == 0:
                self.unknown = 1.0

    @staticmethod
    def _discounts(n: list[int]) -> np.ndarray:
        """d(0..CUT+1) from the numbers n[0..CUT] of types seen 1 to CUT + 1 times."""
        d = np.ones(CUT + 2)
        if n[0] == 0:
            return d
        absolute = n[0] / (n[0] + 2 * n[1])
        common_part = (CUT + 1) * n[CUT] / n[0]
        for r in range(1, CUT + 1):
            x = ((r + 1) * n[r] / (r * n[r - 1]) - common_part) / (1 - common_part) if n[r - 1] and common_part < 1 else -1.0
            d[r] = x if 0 < x < 1 else (r - min(absolute, 0.9)) / r
        return d

    def kept(self, level: int, c: np.ndarray) -> np.ndarray:
        return self.discounts[level][np.minimum(c, CUT + 1)] * c

    def seen(self, level: int, c: np.ndarray, total: np.ndarray, full: np.ndarray) -> np.ndarray:
        """P of seen n-grams from their counts, their contexts' counts and whether discounts leave nothing to them."""
        if level == 1:
            return self.scale * self.kept(1, c) / max(1, self.total)
        return self.kept(level, c) / np.maximum(1, np.where(full, total + 1, total))

    def weight(self, level: int, n: np.ndarray, few: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backoff weights of contexts, and whether their discounts leave nothing, from their sums (few: n1 to n5)."""
        left = few @ ((1 - self.discounts[level][1:CUT + 1]) * np.arange(1, CUT + 1))
        return np.where(left > 0, left / np.maximum(1, n), 1 / (n + 1)) / np.maximum(1 - lower, 1e-12), left <= 0


class Block:
    """The tokens of a block and what has been answered: by level, each token's n-gram's number and count, whether discounts
    leave nothing to its context, and, of tokens that are not learned from, the context's weight."""

    def __init__(self, row: dict, model: Model, learn: bool):
        self.number, self.model, self.ids = row["block"], model, row["doc_ids"]
        held, self.n = thaw(row["held"])
        self.held = held.astype(bool)
        self.tokens = thaw(row["tokens"])[0]
        self.vocab = np.cumsum(thaw(row["vocab"])[0].view(U64), dtype=U64) if row.get("vocab") is not None else None
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.first = np.zeros(len(self.tokens), bool)
        self.first[self.at[:-1]] = True
        self.train = np.repeat(~self.held & learn, self.n)
        self.key, self.count, self.full, self.weight = {}, {}, {}, {}

    def _before(self, x: np.ndarray, at_start) -> np.ndarray:
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first] = at_start
        return out

    def total(self, level: int) -> np.ndarray:
        """The count of each token's context: as often as the shorter n-gram that it is, and a beginning as texts."""
        return np.where(self._before(self.key[level - 1], 0) >= 0, self._before(self.count[level - 1], self.model.texts), 0)

    def words(self) -> Iterator[tuple[int, bytes]]:
        """(partition, blob): word hashes and their counts in training texts."""
        counts = np.bincount(self.tokens[self.train], minlength=len(self.vocab))
        cut = np.searchsorted(part_of(self.vocab, self.model.parts), np.arange(self.model.parts + 1))
        for p in np.flatnonzero(np.diff(cut)):
            some = slice(cut[p], cut[p + 1])
            yield int(p), freeze(np.diff(self.vocab[some], prepend=U64(0)), counts[some])

    def take_words(self, answers: list[tuple[int, bytes]]) -> None:
        got = [(p, *thaw(b)) for p, b in answers]
        rank, count = np.concatenate([np.zeros(0, np.int64), *[g[1] for g in got]]), np.concatenate([np.zeros(0, np.int64), *[g[2] for g in got]])
        part = np.repeat([g[0] for g in got], [len(g[1]) for g in got]).astype(np.int64)
        self.key[1] = numbered(rank, part, self.model.parts)[self.tokens]
        self.count[1] = count[self.tokens]

    def grams(self, level: int) -> None:
        """The distinct n-grams of a level whose context and shorter n-gram are known, sorted by partition, context and word;
        word 0 stands for all others of a context, whose weight is asked for only."""
        m = self.model
        h = self._before(self.key[level - 1], 0)
        self.some = np.flatnonzero(h >= 0)
        ctx, ctx_first, ctx_of = distinct(h[self.some])
        word, _, word_of = distinct(np.where(self.key[level - 1] >= 0, self.key[1], 0)[self.some])
        gram, first, of = distinct(ctx_of.astype(np.int64) * max(1, len(word)) + word_of)
        at, w = gram // max(1, len(word)), word[gram % max(1, len(word))]
        with np.errstate(over="ignore"):
            where = common.mix(ctx.view(U64) + U64(level))
            self.hot = self.total(level)[self.some][ctx_first] >= m.hot_from
            where = np.where(self.hot[at], common.mix(where[at] * common.BASE + w.view(U64)), where[at])
        part = part_of(where, m.parts)
        self.order = by_part(part)
        self.of, self.grams_first, self.ctx, self.ctx_of, self.ctx_first = of, first, ctx, ctx_of, ctx_first
        self.gram_ctx, self.gram_word, part = at[self.order], w[self.order], part[self.order]
        new = np.ones(len(part), bool)
        new[1:] = (self.gram_ctx[1:] != self.gram_ctx[:-1]) | (part[1:] != part[:-1])
        self.run = np.flatnonzero(new)  # a run is a context's n-grams in a partition
        self.part = part
        need = np.bincount(ctx_of, ~self.train[self.some], len(ctx)) > 0
        self.need = need & ~self.hot

    def ask(self, level: int, turn: int = 0, turns: int = 1) -> Iterator[tuple[int, bytes]]:
        self.grams(level)
        pick = lambda x: x[self.some]
        counts = np.bincount(self.of, pick(self.train), len(self.grams_first)).astype(np.int64)[self.order]
        lower = pick(self.count[level - 1])[self.grams_first][self.order]
        cx = self.gram_ctx[self.run]
        if level > 2:
            lower_total, lower_full = (pick(x)[self.ctx_first][cx] for x in (self.total(level - 1), self.full[level - 1]))
        else:
            lower_total = lower_full = np.zeros(len(cx), np.int64)
        ctx, hot, need = self.ctx[cx], self.hot[cx], self.need[cx]
        size = np.diff(self.run, append=len(self.part))
        cut = np.searchsorted(self.part, np.arange(self.model.parts + 1))
        runs = np.searchsorted(self.run, cut)
        for p in np.flatnonzero(np.diff(cut)):
            if p % turns != turn:
                continue
            c, g = slice(runs[p], runs[p + 1]), slice(cut[p], cut[p + 1])
            yield int(p), freeze(np.diff(ctx[c], prepend=0), size[c], lower_total[c], lower_full[c] + 2 * hot[c] + 4 * need[c], self.gram_word[g], counts[g], lower[g])

    def take(self, level: int, answers: list[tuple[int, bytes]]) -> None:
        self.grams(level)
        got = [thaw(b) for _, b in answers]
        cat = lambda k, kind: np.concatenate([np.zeros(0, kind), *[g[k] for g in got]])
        key, count = np.empty(len(self.part), np.int64), np.empty(len(self.part), np.int64)
        rank = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(g[0]) for g in got]])
        counted = cat(1, np.int64)
        key[self.order], count[self.order] = numbered(np.where(counted > 0, rank, 0), self.part, self.model.parts), counted
        cx = self.gram_ctx[self.run]
        full, weight = np.zeros(len(self.ctx), bool), np.ones(len(self.ctx))
        full[cx] = cat(2, np.int64).astype(bool) | (self.model.discounts[level][1:] >= 1).all()
        asked = cx[self.need[cx]]
        weight[asked], _ = self.model.weight(level, self.total(level)[self.some][self.ctx_first[asked]], cat(3, np.int64).reshape(-1, CUT), cat(4, np.float64))
        if self.hot.any():
            ids, w, f = self.model.hot[level]
            at = np.searchsorted(ids, self.ctx[self.hot])
            full[self.hot], weight[self.hot] = f[at], w[at]

        def spread(values: np.ndarray, of: np.ndarray, other) -> np.ndarray:
            out = np.full(len(self.tokens), other, values.dtype)
            out[self.some] = values[of]
            return out

        self.key[level], self.count[level] = spread(key, self.of, UNKNOWN), spread(count, self.of, 0)
        self.full[level], self.weight[level] = spread(full, self.ctx_of, False), spread(weight, self.ctx_of, 1.0)[~self.train]

    def probabilities(self) -> np.ndarray:
        """log10 P of each token, by the recursion from words up."""
        m, c = self.model, self.count[1]
        logs = np.log10(np.where(c > 0, m.seen(1, c, c, c), m.unknown))
        for n in range(2, m.order + 1):
            c = self.count[n]
            share = m.seen(n, c, self.total(n), self.full[n])
            logs[~self.train] += np.log10(np.maximum(self.weight[n], 1e-300))
            logs = np.where(c > 0, np.log10(np.where(c > 0, share, 1.0)), logs)
        return logs

    def scores(self) -> pa.RecordBatch:
        m, c = self.model, self.count[1]
        base = np.log10((c + 0.1) / (m.total + 0.1 * (m.types + 1)))
        add = lambda x: np.add.reduceat(x, self.at[:-1])
        columns = [pa.array(self.ids, pa.int64()), pa.array(self.held), pa.array(self.n), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(self.n), m.total, np.int64)), pa.array(add(base)), pa.array(add(self.probabilities()))]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORES.split(", ")])


def numbered(rank: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """The number of the n-gram of a rank (from 1) in its partition: unique over all, known without a further pass."""
    return np.where(rank > 0, (rank - 1) * parts + part + 1, UNKNOWN)


def _few(at: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """By context, the numbers of types seen 1 to CUT times."""
    low = count <= CUT
    return np.bincount(at[low] * CUT + count[low] - 1, minlength=n * CUT).reshape(n, CUT)


def _stats(count: np.ndarray, texts: int = 0) -> list[int]:
    return [int((count > 0).sum()), int(count.sum()), *[int((count == r).sum()) for r in range(1, CUT + 2)], texts]


def _answer_rows(level: int, part: int, blocks: list[int], blobs: list[bytes], table: bytes | None, stats: list[int] | None, hot: list[dict] | None) -> pa.Table:
    blocks, blobs, more = list(blocks), list(blobs), [None] * len(blobs)
    if table is not None:
        blocks, blobs, more = [*blocks, TABLE, HEAD], [*blobs, table, b""], [*more, None, (stats, hot)]
    names = [c.split()[0] for c in ANSWER.split(", ", 5)]
    hot_type = pa.list_(pa.struct([(c, pa.float64() if c == "lower" else pa.int64()) for c in ("ctx", *SUMS)]))
    return pa.table([pa.array([level] * len(blocks), pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array(blocks, pa.int64()), pa.array(blobs, pa.binary()), pa.array([x and x[0] for x in more], pa.list_(pa.int64())), pa.array([x and x[1] for x in more], hot_type)], names)


def _split(t: pa.Table) -> tuple[int, list[int], list[bytes], bytes | None]:
    """A group of asks, and the stored piece of the table if there is one."""
    rows = list(zip(t.column("block").to_pylist(), t.column("blob").to_pylist()))
    asks = [r for r in rows if r[0] >= 0]
    return t.column("part")[0].as_py(), [b for b, _ in asks], [x for _, x in asks], next((x for b, x in rows if b == TABLE), None)


def _count_words(t: pa.Table) -> pa.Table:
    """A partition of words: their counts and numbers, from asks alone or from the stored piece."""
    part, blocks, blobs, stored = _split(t)
    asks = [thaw(x) for x in blobs]
    hashes = [np.cumsum(a[0].view(U64), dtype=U64) for a in asks]
    if stored is None:
        every, _, of = distinct(np.concatenate([np.zeros(0, U64), *hashes]))
        total = np.bincount(of, np.concatenate([np.zeros(0), *[a[1] for a in asks]]), len(every)).astype(np.int64)
        known, total = every.view(U64)[total > 0], total[total > 0]
        table = freeze(np.diff(known, prepend=U64(0)), total)
        ends = total[known == END]
        stats = _stats(total, int(ends[0]) if len(ends) else 0)
    else:
        known, total = thaw(stored)
        known, table, stats = np.cumsum(known.view(U64), dtype=U64), None, None
    rank = np.empty(len(known) + 1, np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(1, len(known) + 1)  # frequent words have small numbers, which pack well
    rank[-1], total, out = 0, np.append(total, 0), []
    for h in hashes:
        at = np.searchsorted(known, h)
        at = np.where(np.append(known, U64(0))[at] == h, at, len(known))
        out.append(freeze(rank[at], total[at]))
    return _answer_rows(1, part, blocks, out, table, stats, [])


def _count_grams(t: pa.Table, level: int, model: Model) -> pa.Table:
    """A partition of n-grams: their counts and numbers, their contexts' weights, and the partial sums of hot contexts."""
    part, blocks, blobs, stored = _split(t)
    asks = [thaw(x) for x in blobs]
    cat = lambda xs: np.concatenate([np.zeros(0, np.int64), *xs])
    ctx = cat(np.cumsum(a[0]) for a in asks)
    flags = cat(a[3] for a in asks)
    size, word = cat(a[1] for a in asks), cat(a[4] for a in asks)
    if stored is None:
        ctxs, ctx_first, ctx_of = distinct(ctx)
        of_entry = np.repeat(ctx_of, size)
        words, _, word_of = distinct(word)
        gram, first, of = distinct(of_entry.astype(np.int64) * max(1, len(words)) + word_of)
        total = np.bincount(of, cat(a[5] for a in asks), len(gram)).astype(np.int64)
        seen = total > 0
        gram, first, count = gram[seen], first[seen], total[seen]
        at = gram // max(1, len(words))
        entry_run = np.repeat(np.arange(len(ctx)), size)[first]
        lower_count, lower_total, lower_full = cat(a[6] for a in asks)[first], cat(a[2] for a in asks), flags & 1
        lower = model.seen(level - 1, lower_count, lower_total[entry_run], lower_full[entry_run] > 0)
        n, few, low = np.bincount(at, count, len(ctxs)).astype(np.int64), _few(at, count, len(ctxs)), np.bincount(at, lower, len(ctxs))
        partial = [dict(zip(["ctx", *SUMS], [int(ctxs[i]), int(n[i]), *few[i].tolist(), float(low[i])])) for i in np.flatnonzero((flags[ctx_first] & 2) > 0)]
        ranks = np.where(seen, np.cumsum(seen), 0)
        table = freeze(np.diff(ctxs, prepend=0), np.bincount(at, minlength=len(ctxs)), words[gram % max(1, len(words))], count, *([low] if level == 2 else [lower_count, lower_total[ctx_first], lower_full[ctx_first]]))  # whichever is less
        stats = _stats(count)
        rank, got = ranks[of], total[of]
    else:
        ctxs, sizes, known, count, *lower = thaw(stored)
        ctxs, table, stats, partial = np.cumsum(ctxs), None, None, None
        ctx_of = np.minimum(np.searchsorted(ctxs, ctx), max(0, len(ctxs) - 1))
        hit = ctxs[ctx_of] == ctx if len(ctxs) else np.zeros(len(ctx), bool)
        words, _, word_of = distinct(np.concatenate([known, word]))
        at = np.repeat(np.arange(len(ctxs)), sizes)
        few = _few(at, count, len(ctxs))
        low = lower[0] if level == 2 else np.bincount(at, model.seen(level - 1, lower[0], lower[1][at], lower[2][at] > 0), len(ctxs))
        keys = at * max(1, len(words)) + word_of[:len(known)]
        mine = np.where(np.repeat(hit, size), np.repeat(ctx_of.astype(np.int64), size) * max(1, len(words)) + word_of[len(known):], -1)
        at = np.minimum(np.searchsorted(keys, mine), max(0, len(keys) - 1))
        found = keys[at] == mine if len(keys) else np.zeros(len(mine), bool)
        rank, got = np.where(found, at + 1, 0), np.where(found, count[at], 0) if len(keys) else np.zeros(len(mine), np.int64)
        few, low = np.concatenate([few, np.zeros((1, CUT), np.int64)]), np.append(low, 0.0)
        ctx_of = np.where(hit, ctx_of, len(low) - 1)
    out, run, entry = [], 0, 0
    for a in asks:
        c, e = slice(run, run + len(a[0])), slice(entry, entry + len(a[4]))
        run, entry = c.stop, e.stop
        need = (flags[c] & 4) > 0
        out.append(freeze(np.diff(np.maximum.accumulate(rank[e]), prepend=0) if level < model.order else np.zeros(len(a[4]), np.int64), got[e], few[ctx_of[c]].sum(axis=1) == 0, few[ctx_of[c]][need].reshape(-1), low[ctx_of[c]][need]))
    return _answer_rows(level, part, blocks, out, table, stats, partial)


class Scorer:
    """Learns from the blocks' training texts; `scores` are those of all their texts, `score` those of any other blocks.

    `tables` holds the model: a row a level and partition, in the shared folder. With `own`, tables of blocks are deleted
    once the next step has written what it needs of them.
    """

    def __init__(self, blocks: DataFrame, order: int = 3, parts: int = PARTS, own: bool = False):
        self.spark = blocks.sparkSession
        self.model = Model(order, parts * max(1, -(-blocks.count() // BLOCKS_A_ROUND)))
        self.tables: DataFrame | None = None
        self._state = self._through(blocks, True, own)

    def _through(self, state: DataFrame, learn: bool, own: bool) -> DataFrame:
        """The blocks with the answers of all levels; the last level's are joined, not written."""
        for level in range(1, self.model.order + 1):
            turns = ROUNDS if level > 2 else 1
            parts = [self._exchange(state, level, learn, turn, turns) for turn in range(turns)]
            got = reduce(DataFrame.unionByName, parts)
            last = level == self.model.order
            if learn:
                self._learn(level, got.filter(F.col("block") == HEAD))
                piece = got.filter(F.col("block") == TABLE).select("level", "part", "block", "blob")
                piece = piece if last else common.materialise(piece, "uncompressed")
                self.tables = piece if level == 1 else self.tables.unionByName(piece)
            mine = got.filter(F.col("block") >= 0).groupBy("block").agg(F.collect_list(F.struct("level", "part", "blob")).alias("more"))
            after = state.drop("vocab").join(mine, "block")
            answers = F.concat("answers", "more") if "answers" in state.columns else F.col("more")
            after = after.select("block", "doc_ids", "held", "tokens", answers.alias("answers"))
            if not last:
                after = common.bucketed(after, "block")  # the next join moves answers only
                common.forget(*parts, *([state] if own or level > 1 else []))
            state = after
        return state

    def _learn(self, level: int, heads: DataFrame) -> None:
        rows = heads.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()  # a row a statistic
        stats = [0] * (CUT + 4)
        for r in rows:
            stats[r["i"]] = int(r["x"])
        hot = heads.select(F.explode("hot").alias("h")).groupBy("h.ctx").agg(*[F.sum(f"h.{c}").alias(c) for c in SUMS])
        hot = np.array(sorted(map(tuple, hot.collect())), object).reshape(-1, CUT + 3)  # 2^20 contexts at most
        self.model.counted(level, stats)
        self.model.hot[level] = (hot[:, 0].astype(np.int64), *self.model.weight(level, hot[:, 1].astype(float), hot[:, 2:-1].astype(float), hot[:, -1].astype(float)))

    def _over(self, blocks: DataFrame, work, schema: str, learn: bool) -> DataFrame:
        """Maps blocks, with all their answers so far, by work(block)."""
        model = self.spark.sparkContext.broadcast(self.model)

        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in found:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "answers"}
                    b = Block(row, model.value, learn)
                    if "answers" in batch.schema.names:
                        levels, parts, blobs = (batch.column("answers")[i].values.field(c) for c in ("level", "part", "blob"))
                        levels, parts = levels.to_numpy(), parts.to_numpy()
                        for level in np.unique(levels).tolist():
                            of = np.flatnonzero(levels == level)
                            mine = [(int(parts[k]), blobs[int(k)].as_py()) for k in of[np.argsort(parts[of])]]
                            b.take_words(mine) if level == 1 else b.take(level, mine)
                    yield from work(b)

        return blocks.mapInArrow(run, schema)

    def _exchange(self, blocks: DataFrame, level: int, learn: bool, turn: int, turns: int) -> DataFrame:
        def ask(b: Block) -> Iterator[pa.RecordBatch]:
            rows = list(b.words() if level == 1 else b.ask(level, turn, turns))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([b.number] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["part", "block", "blob"])

        asked = self._over(blocks, ask, ASK, learn)
        if not learn:
            asked = asked.unionByName(self.tables.filter((F.col("level") == level) & (F.col("part") % turns == turn)).select("part", "block", "blob"))
        model = self.spark.sparkContext.broadcast(self.model)

        def count(t: pa.Table) -> pa.Table:
            return _count_words(t) if level == 1 else _count_grams(t, level, model.value)

        return common.materialise(asked.groupBy("part").applyInArrow(count, ANSWER), "uncompressed")

    def scores(self) -> DataFrame:
        return self._over(self._state, lambda b: iter([b.scores()]), SCORES, True)

    def score(self, blocks: DataFrame) -> DataFrame:
        """Scores of other blocks, from the stored tables."""
        return self._over(self._through(blocks, False, False), lambda b: iter([b.scores()]), SCORES, False)


def op3_katz_scores(spark: SparkSession, sf_dir: str, order: int = 3) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return Scorer(packed(docs, common.fold("doc_id", 10) == 0), order, own=True).scores()
