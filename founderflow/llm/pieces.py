"""Encoding and decoding with a sentence-piece vocabulary of byte-pair merges, as array passes over whole batches.

Encoding. Spaces become the space mark, a text begins with one, and any two neighbouring symbols whose joined text is a piece may
merge: the best score first, the leftmost of equal ones. No piece has a space mark behind another character, so a batch is cut before
each space mark that follows another character, and each distinct word of the batch is encoded once.

Merge rounds. The symbols of all words lie in one flat array, with the rank of each neighbouring pair beside it. In a
round each word's least rank is found by a segmented minimum, and its leftmost pair of that rank merges, in all words at once; so
do the further pairs of that rank in the word that do not overlap, up to the first whose new neighbours rank as well or better,
as only then could the serial order differ. Merged symbols are compacted away, and words without a pair leave, until none
is left. Words that are not done after ROUNDS rounds (hundreds of characters without a space, or as many spaces) are
finished one by one with a heap, so a word of any length costs n log n.

Characters that are in no piece become the pieces of their bytes. Decoding gathers the bytes of all pieces of a batch,
drops the first space of a text, and takes byte sequences that are no UTF-8 for replacement characters.

The driver reads the vocabulary file and sends its tables to all tasks (bounded by the vocabulary and the characters of Unicode).

Defined results: a null or empty text has the begin and end ids only, and decodes to the empty text; space marks in texts
decode to spaces; repeated rows are each encoded; extra columns pass through, and where one has the name of a result,
that name gets an underscore at its end; an empty table gives no rows; null ids decode to the empty text.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NONE = np.iinfo(np.int32).max
SHIFT, SLOTS = 21, 1 << 20  # symbols are below 2^21
ROUNDS = 64


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of a message's fields: varints as numbers, all else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
        yield key >> 3, data[at:at + size]
        at += size


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges that begin at `starts`, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Pieces:
    """A vocabulary's tables: symbols of characters, merges of symbols, bytes of pieces."""

    def __init__(self, model: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        normal = {p: (i, score) for i, (p, score, kind) in enumerate(pieces) if kind == NORMAL}
        kinds = {kind for _, _, kind in pieces}
        plain = not normalizer.get(2) and normalizer.get(3, 1) == 1 and normalizer.get(4, 1) == 0
        if trainer.get(3) != 2 or trainer.get(35) != 1 or not plain or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE} or any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("only byte-pair vocabularies with byte pieces, plain text and spaces in front of pieces are read")
        self.count = len(pieces)
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        self.begin, self.end = signed(trainer.get(41, 1)), signed(trainer.get(42, 2))
        self.byte = np.zeros(256, np.int32)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte[int(p[3:5], 16)] = i
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.count  # of characters that are no piece
        for p, (i, _) in normal.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[ord(" ")] = self.symbol[ord(MARK)]
        rank_of = {s: k for k, s in enumerate(sorted({s for _, s in normal.values()}, reverse=True))}
        side = lambda t: normal[t][0] if t in normal else self.count + ord(t) if len(t) == 1 else None
        made = [((a << SHIFT) + b, rank_of[score], i) for p, (i, score) in normal.items() for k in range(1, len(p)) if (a := side(p[:k])) is not None and (b := side(p[k:])) is not None]
        key, rank, into = (np.array(c, t) for c, t in zip(zip(*made) if made else ([], [], []), (np.int64, np.int32, np.int32)))
        self.key, self.rank, self.into = np.full(SLOTS, -1), np.full(SLOTS, NONE, np.int32), np.full(SLOTS, -1, np.int32)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):  # a slot goes to the first that meets it, the others go on to the next
            _, first = np.unique(slot, return_index=True)
            first = first[self.key[slot[first]] < 0]
            at, of = slot[first], todo[first]
            self.key[at], self.rank[at], self.into[at] = key[of], rank[of], into[of]
            left = np.ones(len(todo), bool)
            left[first] = False
            todo, slot = todo[left], (slot[left] + 1) % SLOTS
        mark = {UNKNOWN: trainer.get(44, " ⁇ ".encode()), CONTROL: b""}
        spelled = [bytes([int(p[3:5], 16)]) if kind == BYTE else mark[kind] if kind in mark else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.length = np.array([len(s) for s in spelled], np.int64)
        self.place = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(spelled), np.uint8)
        self.spaced = np.array([kind == NORMAL and p.startswith(MARK) for p, _, kind in pieces])
        self.silent = self.length == 0

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (common.mix(key.astype(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs of symbols; NONE if they do not merge."""
        key = (left.astype(np.int64) << SHIFT) + right
        slot = self._slot(key)
        todo = np.arange(len(key))
        while True:
            held = self.key[slot[todo]]
            todo = todo[(held != key[todo]) & (held >= 0)]
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) % SLOTS
        found = self.key[slot] == key
        return np.where(found, self.rank[slot], NONE), self.into[slot]

    def _serial(self, symbols: list[int]) -> list[int]:
        """One word's merges in order, by a heap."""
        n = len(symbols)
        after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
        rank, into = self.pair(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64))
        heap = [(r, i, symbols[i], symbols[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), into.tolist())) if r < NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = merged, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0:
                    both = symbols[a], symbols[b]
                    if both not in known:
                        r, m = self.pair(np.array(both[:1]), np.array(both[1:]))
                        known[both] = int(r[0]), int(m[0])
                    if known[both][0] < NONE:
                        heapq.heappush(heap, (known[both][0], a, *both, known[both][1]))
        return [s for s in symbols if s >= 0]

    def merged(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words after all merges, and how many each word has."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        done_words, done_symbols = [], []

        def pairs(at: np.ndarray) -> None:
            """The pairs that begin at these places anew."""
            last = at + 1 >= len(word)
            inner = at[~last]
            inner = inner[word[inner] == word[inner + 1]]
            rank[at], into[at] = NONE, -1
            rank[inner], into[inner] = self.pair(symbols[inner], symbols[inner + 1])

        rank, into = np.full(len(word), NONE, np.int32), np.full(len(word), -1, np.int32)
        pairs(np.arange(len(word)))
        for _ in range(ROUNDS):
            if not len(word):
                break
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            count = np.diff(np.append(first, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, first), count)
            open_ = least < NONE
            done_words.append(word[~open_])
            done_symbols.append(symbols[~open_])
            word, symbols, rank, into, least = word[open_], symbols[open_], rank[open_], into[open_], least[open_]
            at = np.flatnonzero(rank == least)
            if not len(at):
                break
            joined = np.append(False, at[1:] == at[:-1] + 1)  # overlaps the candidate before: every second of such a row merges
            start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            own = word[at]
            several = np.zeros(len(at), bool)
            several[1:] = own[1:] == own[:-1]
            several[:-1] |= several[1:]
            if several.any():
                at = np.sort(np.concatenate([at[~several], self._in_order(at[several], word, symbols, into, least)]))
            symbols = symbols.copy()
            symbols[at] = into[at]
            keep = np.ones(len(word), bool)
            keep[at + 1] = False
            new = (np.cumsum(keep) - 1)[at]
            word, symbols, rank, into = word[keep], symbols[keep], rank[keep], into[keep]
            pairs(np.unique(np.concatenate([new, new[new > 0] - 1])))
        if len(word):
            edge = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            for low, high in zip(edge.tolist(), [*edge[1:].tolist(), len(word)]):
                rest = self._serial(symbols[low:high].tolist())
                done_words.append(np.full(len(rest), word[low]))
                done_symbols.append(np.array(rest, symbols.dtype))
        word, symbols = np.concatenate([word[:0], *done_words]), np.concatenate([symbols[:0], *done_symbols])
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(sizes))

    def _in_order(self, at: np.ndarray, word: np.ndarray, symbols: np.ndarray, into: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Of merges of one rank in a word, those up to the first that makes a pair of that rank or better."""
        made, n = into[at], len(word)
        left = symbols[at - 1]
        left[1:] = np.where(at[1:] == at[:-1] + 2, made[:-1], left[1:])
        has_left = (at > 0) & (word[at - 1] == word[at])
        right_at = np.minimum(at + 2, n - 1)
        has_right = (at + 2 < n) & (word[right_at] == word[at])
        before, _ = self.pair(left, made)
        behind, _ = self.pair(made, symbols[right_at])
        bad = ((before <= least[at]) & has_left) | ((behind <= least[at]) & has_right)
        earlier = np.cumsum(bad) - bad
        first = np.append(True, word[at[1:]] != word[at[:-1]])
        return at[earlier == np.repeat(earlier[first], np.diff(np.append(np.flatnonzero(first), len(at))))]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, with begin and end, and the texts' offsets."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, " ")
        texts = pc.binary_join_element_wise(pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ").cast(pa.large_string()), texts, pa.scalar("", pa.large_string()))
        n = len(texts)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
        body = np.frombuffer(data, np.uint8)[:at[-1]] if data is not None and at[-1] else np.zeros(0, np.uint8)
        blank = body == 32
        begins = blank & ~np.append(True, blank[:-1]) if len(body) else blank
        begins[at[:-1][np.diff(at) > 0]] = True
        cut = np.flatnonzero(begins)
        words = pa.LargeStringArray.from_buffers(len(cut), pa.py_buffer(np.append(cut, len(body)).astype(np.int64)), pa.py_buffer(body))
        coded = words.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        points = np.frombuffer("".join(coded.dictionary.to_pylist()).encode("utf-32-le"), np.uint32)
        symbols, sizes = self.merged(self.symbol[points], pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64))
        symbols, sizes = self._as_ids(symbols, sizes)
        start = np.cumsum(sizes) - sizes
        ids = symbols[_spread(start[which], sizes[which])]
        upto = np.concatenate([[0], np.cumsum(sizes[which])])[np.searchsorted(cut, at)]
        extra = int(self.begin >= 0), int(self.end >= 0)
        bounds = upto + np.arange(n + 1) * sum(extra)
        out = np.empty(bounds[-1] if n else 0, np.int32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n) * sum(extra) + extra[0], np.diff(upto))] = ids
        if extra[0]:
            out[bounds[:-1]] = self.begin
        if extra[1]:
            out[bounds[1:] - 1] = self.end
        return out, bounds

    def _as_ids(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as ids: characters that are no piece become the pieces of their bytes."""
        if not len(symbols) or symbols.max() < self.count:
            return symbols, sizes
        point = np.where(symbols < self.count, 0, symbols - self.count)
        wide = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
        of = np.repeat(np.arange(len(symbols)), wide)
        k = np.arange(len(of)) - np.repeat(np.cumsum(wide) - wide, wide)
        bits = point[of] >> (6 * (wide[of] - 1 - k))
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[wide[of]]
        byte = np.where(k == 0, lead | bits, 0x80 | bits & 0x3F)
        ids = np.where(symbols[of] < self.count, symbols[of], self.byte[byte & 255])
        word = np.repeat(np.arange(len(sizes)), sizes)
        return ids.astype(np.int32), np.bincount(word[of], minlength=len(sizes))

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of runs of ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.count):
            raise ValueError("ids outside the vocabulary")
        size, place = self.length[ids], self.place[ids].copy()
        loud = np.append(np.flatnonzero(~self.silent[ids]), len(ids))
        first = loud[np.searchsorted(loud, bounds[:-1])]
        first = first[first < bounds[1:]]
        first = first[self.spaced[ids[first]]]
        size[first] -= 1
        place[first] += 1
        data = self.data[_spread(place, size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[bounds].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def vocabulary(path: str) -> Pieces:
    with open(path, "rb") as f:
        return Pieces(f.read())


def encoded(docs: DataFrame, path: str, text: str = "text", decode: bool = False) -> DataFrame:
    """docs plus ids, little-endian 32-bit numbers in one value, and if asked for `decoded`, the text of the ids.

    A map over rows, without a shuffle; path is read by the driver."""
    names, column = docs.columns, docs.columns.index(text)
    added = [common.fresh(docs, c) for c in (["ids", "decoded"] if decode else ["ids"])]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, t) for c, t in zip(added, (T.BinaryType(), T.StringType()))]])
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for start, n in common.batches(batch.column(column)):
                part = batch.slice(start, n)
                ids, bounds = sent.value.encode(part.column(column))
                data, cut = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
                made = [pa.array([data[a:b] for a, b in zip(cut, cut[1:])], pa.binary())]
                if decode:
                    made.append(pa.array(sent.value.decode(ids, bounds), pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*names, *added])

    return docs.mapInArrow(run, schema)


def decoded(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows plus decoded, the texts of stored ids."""
    names, column = rows.columns, rows.columns.index(ids)
    name = common.fresh(rows, "decoded")
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for start, n in common.batches(batch.column(column)):
                part = batch.slice(start, n)
                held = [x or b"" for x in part.column(column).to_pylist()]
                flat = np.frombuffer(b"".join(held), "<u4").astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in held], dtype=np.int64)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sent.value.decode(flat, bounds), pa.string())], [*names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: the number of its ids, and digests of the ids and of the decoded text."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    got = encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), decode=True)
    return got.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
