r"""Token counts by a finite-state tokenizer compiled from a byte-pair vocabulary.

The transducer reads the symbols of words (bytes, and bytes that end a word). Its transitions are annotated with the
change in the number of emitted tokens. It rests on a property of byte-pair merges: every run of tokens of an encoding
is the encoding of its own text. So each prefix of a word has one last token, which is the longest token ending there
that is compatible with the last token before it; a state holds the longest suffix that still begins a token, and
for each place in it the last token and the count relative to now. The states are finite. Two tokens are compatible
if no pair of pieces at their border, one of the left token's last pieces and one of the right's first, merges
while both are there.

The driver compiles the states that the vocabulary's own words reach and sends them, with the merges, to all tasks
(bounded by the vocabulary); workers add a state when a text first reaches it and never open the file.

Counting. The symbols of a batch are cut into chunks of `chunk`, whatever the texts, and all chunks run side by side,
one array step a symbol. A chunk's state map sends entry states to exit states and counts. Its entries are the word
start and the exits of the chunk before it under that one's entries: those are added until none is missing, so the map
is closed. Maps compose associatively, as index maps with counts; a parallel prefix scan of log2(chunks) rounds gives
the state and count after every chunk, from which each text's total is read. A word may be of any length.

Normalisation and word boundaries are those of the vocabulary file: NFC, lower case by character, then its split
pattern, which drops white space; the two special strings are found in the raw text first and count one each. The library
has tables of different ages for these steps, which differ from Python's where characters are younger: LATE_* name those.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are each counted; extra columns pass
through, and where one has the name of a result that name gets an underscore at its end; an empty table gives no rows.
The states that a worker added are dropped when they reach `most_states`, which costs time only.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CHUNK = 512
BATCH_BYTES = 4 << 20
START = 0
U64 = np.uint64

# To the library's NFC (Unicode 9) these marks are like any other character: they neither move nor compose, and nothing passes them.
LATE_MARKS = (
    "\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c\U00010d24-\U00010d27\U00010eab-\U00010eac"
    "\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b\U0001145e\U00011839-\U0001183a\U00011930\U0001193d-\U0001193e"
    "\U00011943\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44-\U00011d45\U00011d97\U00011f41-\U00011f42\U00016ff0-\U00016ff1\U0001e08f"
    "\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef"
)
# Capitals that the library's lower-casing (Unicode 17) knows and Python's (15.1) doesn't.
LATE_CAPITALS = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
# Neither letters nor numbers to the library's pattern (Unicode 16), but to the regex module's.
LATE_LETTERS = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959"
    "\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2"
    "\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    "\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
LATE = re.compile(f"[{LATE_MARKS}{LATE_LETTERS}{''.join(map(chr, LATE_CAPITALS))}]")
BETWEEN_MARKS = re.compile(f"[^{LATE_MARKS}]+")


def _symbol_of() -> dict[str, int]:
    """Bytes by their printable stand-ins in byte-level vocabularies: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return {chr(b) if b in plain else chr(next(other)): b for b in range(256)}


class Transducer:
    """Transitions (state, symbol) -> (state, change in count); symbols are bytes, plus 256 if they end a word.

    Tokens are strings of one character a symbol. Transitions are kept in an open-addressed table of arrays.
    """

    def __init__(self, merges: list[tuple[str, str]], end: str, most_states: int = 1_000_000):
        byte = _symbol_of()

        def spelled(t: str) -> str:
            body = t.removesuffix(end)
            out = [byte[c] for c in body]
            if len(body) < len(t):
                out[-1] += 256
            return "".join(map(chr, out))

        self.most_states = most_states
        self.parts: dict[str, tuple[int, str, str]] = {chr(b): (-1, "", "") for b in range(512)}
        self.ranks: dict[tuple[str, str], int] = {}
        for rank, (a, b) in enumerate(merges):
            a, b = spelled(a), spelled(b)
            self.ranks[a, b] = rank
            self.parts.setdefault(a + b, (rank, a, b))
        self.ordered = all(r > self.parts[a][0] and r > self.parts[b][0] for (a, b), r in self.ranks.items())
        self.begins = {t[:n] for t in self.parts for n in range(1, len(t) + 1)}
        self.whole: dict[str, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.base: tuple | None = None
        self.reset()

    def reset(self) -> None:
        """Back to the states that were sent, or to none."""
        if self.base:
            detail, rows = self.base
            self.detail = list(detail)
        else:
            self.detail, rows = [("", ((None, 0),))], np.zeros((0, 3), np.int64)
        self.states = {d: i for i, d in enumerate(self.detail)}
        self.used = 0
        self.key = np.full(1 << 12, -1, np.int64)
        self.to, self.delta = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.put(rows)

    def __getstate__(self) -> dict:
        held = self.key >= 0
        rows = np.stack([self.key[held], self.to[held], self.delta[held]], 1)
        return {"base": (self.detail, rows), **{k: getattr(self, k) for k in ("most_states", "parts", "ranks", "ordered", "begins", "whole")}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, edges=({}, {}))
        self.reset()

    def merge(self, parts: list[str]) -> list[str]:
        """Plain byte-pair merging by rank, leftmost first."""
        parts = list(parts)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 60))
            if (pair := (parts[best], parts[best + 1])) not in self.ranks:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _is_whole(self, token: str) -> bool:
        if token not in self.whole:
            self.whole[token] = len(token) == 1 or self.merge(list(token)) == [token]
        return self.whole[token]

    def _edge(self, token: str, right: bool) -> list[tuple[str, float]]:
        """The pieces that lie at a token's end (or beginning), from the first to the last, each with the rank that ends it."""
        cache = self.edges[right]
        if token not in cache:
            out, ends, piece = [], float("inf"), token
            while True:
                rank, a, b = self.parts[piece]
                out.append((piece, ends))
                if rank < 0:
                    break
                piece, ends = (b if right else a), rank
            cache[token] = out[::-1]
        return cache[token]

    def compatible(self, left: str | None, right: str) -> bool:
        """Whether left and right, one after the other, are encoded as these two tokens."""
        if not self._is_whole(right) or left is not None and not self._is_whole(left):
            return False
        if left is None:
            return True
        if not self.ordered:
            return self.merge([*left, *right]) == [left, right]
        xs, ys, i, j = self._edge(left, True), self._edge(right, False), 0, 0
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            rank = self.ranks.get((x, y))
            if rank is not None and rank < x_ends and rank <= y_ends:  # of equal merges the leftmost comes first
                return False
            if x_ends == y_ends == float("inf"):
                return True
            if x_ends <= y_ends:
                i += 1
                if x_ends == y_ends:
                    j += 1
            else:
                j += 1

    def build(self, state: int, symbol: int) -> tuple[int, int, int]:
        """(key, next state, change in count) of the transition of a state by a symbol."""
        tail, lasts = self.detail[state]  # lasts[k]: last token and relative count before tail[k:]; lasts[-1] is now
        longer = tail + chr(symbol)
        for k in range(len(longer)):  # from the longest token that ends here
            token = longer[k:]
            if token in self.parts and self.compatible(lasts[k][0], token):
                delta = lasts[k][1] + 1
                break
        else:
            raise ValueError(f"no token ends at symbol {symbol}")
        if symbol >= 256:
            return state * 512 + symbol, START, delta
        keep = next((k for k in range(len(longer)) if longer[k:] in self.begins), len(longer))
        after = longer[keep:], (*((t, c - delta) for t, c in lasts[keep:]), (token, 0))
        if after not in self.states:
            self.states[after] = len(self.detail)
            self.detail.append(after)
        return state * 512 + symbol, self.states[after], delta

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - len(self.key).bit_length() + 1)).astype(np.int64)

    def put(self, rows: np.ndarray) -> None:
        """Adds transitions (key, next, change); the table is kept half empty."""
        if not len(rows):
            return
        if 2 * (self.used + len(rows)) > len(self.key):
            held = self.key >= 0
            rows = np.concatenate([np.stack([self.key[held], self.to[held], self.delta[held]], 1), rows])
            size = 1 << int(4 * len(rows)).bit_length()
            self.used, self.key = 0, np.full(size, -1, np.int64)
            self.to, self.delta = np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.used += len(rows)
        slot = self._slots(rows[:, 0])
        while len(rows):
            free = self.key[slot] < 0
            self.key[slot[free]] = rows[free, 0]  # of several for one slot the last stays
            won = self.key[slot] == rows[:, 0]
            self.to[slot[won]], self.delta[slot[won]] = rows[won, 1], rows[won, 2]
            rows, slot = rows[~won], (slot[~won] + 1) & (len(self.key) - 1)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One transition of many lanes."""
        key = state * 512 + symbol
        slot = self._slots(key)
        found = self.key[slot]
        off = np.flatnonzero(found != key)
        while len(off):
            empty = found[off] < 0
            if empty.any():
                new, size = np.unique(key[off[empty]]), len(self.key)
                self.put(np.array([self.build(*divmod(k, 512)) for k in new.tolist()], np.int64))
                if len(self.key) != size:  # the table has grown: slots found before are void
                    off = np.arange(len(key))
                slot[off] = self._slots(key[off])
            else:
                slot[off] = (slot[off] + 1) & (len(self.key) - 1)
            found[off] = self.key[slot[off]]
            off = off[found[off] != key[off]]
        return self.to[slot].astype(np.int64), self.delta[slot]

    def run(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray, into: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(exit state, count) of lanes that read `length` symbols each; `into` takes the change at each symbol."""
        order = np.argsort(-length, kind="stable")
        at, left, now = start[order], length[order], state[order].copy()
        total = np.zeros(len(order), np.int64)
        steps = int(left[0]) if len(left) else 0
        alive = np.searchsorted(-left, -np.arange(steps), "left")  # lanes with more than j symbols
        for j in range(steps):
            n = alive[j]
            now[:n], delta = self.step(now[:n], symbols[at[:n] + j])
            total[:n] += delta
            if into is not None:
                into[at[:n] + j] = delta
        out, count = np.empty_like(now), np.empty_like(total)
        out[order], count[order] = now, total
        return out, count


def scan(to: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The composition of the maps of all chunks up to each: parallel prefix, by doubling.

    to[k, i]: the entry of chunk k + 1 that entry i of chunk k leads to; count[k, i]: what chunk k then counts."""
    to, count, step = to.copy(), count.copy(), 1
    while step < len(to):
        first, then = to[:-step], to[step:]
        count[step:] = count[:-step] + np.take_along_axis(count[step:], first, 1)
        to[step:] = np.take_along_axis(then, first, 1)
        step *= 2
    return to, count


class Counter:
    """Token counts of texts for one tokenizer file of kind word-end byte-pair."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"]:
            raise ValueError("only word-end byte-pair vocabularies with NFC, white space and lower-case normalisation are compiled")
        self.machine = Transducer(pairs, model["end_of_word_suffix"])
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "|\n"
        self.late = "(?V1)" + regex.sub(r"\\p\{[LN]\}", lambda m: f"[{m[0]}--[{LATE_LETTERS}]]", self.pattern)
        self.specials = "|".join(map(regex.escape, sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)))

    def compile(self) -> Counter:
        """Builds the states that the vocabulary's own words reach."""
        words = [t for t in self.machine.parts if ord(t[-1]) >= 256]
        symbols = np.array([ord(c) for w in words for c in w], np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        self.machine.run(symbols, np.cumsum(sizes) - sizes, sizes, np.zeros(len(words), np.int64))
        return self

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of the words of all texts, and where each text's symbols end."""
        joined, pattern = "\n".join(t.replace("\n", " ") for t in texts), self.pattern
        if not joined.isascii():
            if LATE.search(joined):
                joined, pattern = BETWEEN_MARKS.sub(lambda m: unicodedata.normalize("NFC", m[0]), joined).translate(LATE_CAPITALS), self.late
            else:
                joined = unicodedata.normalize("NFC", joined)
            joined = joined.replace("Σ", "σ")  # by character: no final sigma
        data = np.frombuffer(" ".join(regex.findall(pattern, joined.lower())).encode() + b" ", np.uint8)
        gap = (data == 32) | (data == 10)
        out = data.astype(np.int64)
        out[:-1] += 256 * gap[1:]
        return out[~gap], np.append(np.cumsum(~gap)[data == 10], np.count_nonzero(~gap))

    def _chunk_maps(self, symbols: np.ndarray, change: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """Closed state maps of all chunks, as scan() takes them; counts are those beyond the count from the word start."""
        n = -(-len(symbols) // chunk)
        start = np.arange(n) * chunk
        length = np.minimum(chunk, len(symbols) - start)
        exits, _ = self.machine.run(symbols, start, length, np.full(n, START), change)
        ends = np.flatnonzero(symbols >= 256)
        first = np.append(ends, len(symbols))[np.searchsorted(ends, start)]  # where the entry state is forgotten
        reach = np.minimum(length, first + 1 - start)
        open_ = first >= start + length  # no word ends in the chunk
        inside = np.zeros(n, bool)  # begins within a word
        inside[1:] = symbols[start[1:] - 1] < 256
        upto = np.concatenate([[0], np.cumsum(change)])
        plain = upto[start + reach] - upto[start]
        entry = [np.full(n, START)]
        out, extra = [exits], [np.zeros(n, np.int64)]
        while True:
            known = np.stack(entry)
            wanted = np.full(n, -1)
            for o in out:  # the exit of the chunk before, under its entries, that is no entry yet
                before = np.append(-1, o[:-1])
                new = inside & (before >= 0) & (wanted < 0) & ~(known == before).any(axis=0)
                wanted[new] = before[new]
            lanes = np.flatnonzero(wanted >= 0)
            if not len(lanes):
                break
            got, count = self.machine.run(symbols, start[lanes], reach[lanes], wanted[lanes])
            ends_in, more = np.full(n, -1), np.zeros(n, np.int64)
            ends_in[lanes] = np.where(open_[lanes], got, exits[lanes])
            more[lanes] = count - plain[lanes]
            entry.append(wanted)
            out.append(ends_in)
            extra.append(more)
        known = np.stack(entry)
        to = np.zeros((n, len(out)), np.int64)
        for i, o in enumerate(out):
            to[:-1, i] = np.where(inside[1:], (known[:, 1:] == o[:-1]).argmax(axis=0), 0)
        return to, np.stack(extra, 1)

    def counts(self, texts: list[str | None], chunk: int = CHUNK) -> np.ndarray:
        if len(self.machine.detail) > self.machine.most_states:
            self.machine.reset()
        total = np.zeros(len(texts), np.int64)
        clean = []
        for i, t in enumerate(texts):
            t = t or ""
            if "<|" in t:
                t, total[i] = regex.subn(self.specials, " ", t)
            clean.append(t)
        symbols, ends = self.symbols(clean)
        if not len(symbols):
            return total
        change = np.zeros(len(symbols), np.int64)
        to, count = self._chunk_maps(symbols, change, chunk)
        _, upto = scan(to, count)
        change[np.arange(len(upto)) * chunk] += np.diff(upto[:, 0], prepend=0)  # what the chunks count beyond their plain runs
        return total + np.diff(np.concatenate([[0], np.cumsum(change)])[ends], prepend=0)

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        return int(self.counts([text], chunk)[0])


def with_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 2048, chunk: int = CHUNK) -> DataFrame:
    """docs plus n_bytes, n_tokens and over_limit; a map over rows, without a shuffle. path is read by the driver."""
    names, column = docs.columns, docs.columns.index(text)
    added = [common.fresh(docs, c) for c in ("n_bytes", "n_tokens", "over_limit")]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, t) for c, t in zip(added, (T.LongType(), T.LongType(), T.BooleanType()))]])
    sent = docs.sparkSession.sparkContext.broadcast(Counter(path).compile())

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for start, n in common.batches(batch.column(column), BATCH_BYTES):
                part = batch.slice(start, n)
                counts = sent.value.counts(part.column(column).to_pylist(), chunk)
                sizes = pc.fill_null(pc.binary_length(part.column(column)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, sizes, pa.array(counts), pa.array(counts > limit)], [*names, *added])

    return docs.mapInArrow(run, schema)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_counts(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
