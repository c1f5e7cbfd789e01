"""Alignment kernels over Arrow batches: all pairs of a batch side by side, a few array steps a base.

Barcodes and reads are compared byte by byte. Pairs come as two string columns; each kernel's cost is the pairs times the
bases of one side (a machine word holds the other) or of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIRS, WORD = 8192, 64
PAD_A, PAD_B = 254, 255
BITS = 20
LANES, FEW, LONG = 2048, 64, 1024


def matrix(strings: pa.Array, fill: int, pad: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings, a row each, filled up; and their lengths. pad is put before and behind each."""
    strings = strings.cast(pa.large_string())
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64, len(strings) + 1, strings.offset * 8)
    size = np.diff(at)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    side, width = len(pad), int(size.max(initial=1))
    out = np.full((len(size), width + 2 * side), fill, np.uint8)
    if len(size):
        out[:, side:side + width][np.arange(width) < size[:, None]] = body[at[0]:at[-1]]
    for k, byte in enumerate(pad):
        out[:, k] = byte
        out[np.arange(len(size)), side + size + k] = byte
    return out, size + 2 * side


def infix(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, end) of each a and the nearest substring of its b; end is the first at which that substring may end."""
    n, wide = len(a), a.shape[1]
    if wide > WORD:
        return _infix_rows(a, la, b, lb)
    row = np.arange(n)
    letters = np.zeros(256, np.int64)
    letters[a], letters[b] = 1, 1
    code = np.cumsum(letters) - 1
    a, b = code[a], code[b]
    holds = np.zeros((n, int(code[-1]) + 1), np.uint64)  # where each letter stands in a, a bit a place
    for i in range(wide):
        on = i < la
        holds[row[on], a[on, i]] |= np.uint64(1 << i)
    one, last = np.uint64(1), np.uint64(1) << np.maximum(la - 1, 0).astype(np.uint64)
    up, down = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)  # rises and falls along a column
    score, best, end = la.astype(np.int64), la.astype(np.int64), np.zeros(n, np.int64)
    for j in range(b.shape[1]):
        same = holds[row, b[:, j]]
        with np.errstate(over="ignore"):
            across = (((same & up) + up) ^ up) | same
        rise, fall = down | ~(across | up), up & across
        score = score + ((rise & last) != 0) - ((fall & last) != 0)
        keep = same | down
        rise, fall = rise << one, fall << one
        up, down = fall | ~(keep | rise), rise & keep
        better = (score < best) & (j < lb)
        best, end = np.where(better, score, best), np.where(better, j + 1, end)
    return best, end


def _infix_rows(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """infix() for barcodes longer than a machine word: a row of distances a base of a."""
    ramp = np.arange(b.shape[1] + 1)
    last = np.zeros((len(a), len(ramp)), np.int64)
    final = np.where(la[:, None] == 0, 0, last)
    for i in range(a.shape[1]):
        now = np.minimum(last + 1, i + 1)
        now[:, 1:] = np.minimum(now[:, 1:], last[:, :-1] + (a[:, i:i + 1] != b))
        last = np.minimum.accumulate(now - ramp, axis=1) + ramp
        final = np.where((la == i + 1)[:, None], last, final)
    final = np.where(ramp[None, :] <= lb[:, None], final, np.iinfo(np.int64).max)
    return final.min(axis=1), final.argmin(axis=1)


def local(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, match: int = 1, mismatch: int = -1, gap: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, start, end) of the best local alignment of each a in its b; of equal ones the first to end, then the shortest in b.

    A cell holds its score above room for its end above its start, so one maximum settles all; the pairs are side by side in
    the narrowest integers that hold a cell, LANES at a time, a row of the table each place of b."""
    n, wide = len(a), b.shape[1] + 1
    if n < FEW or wide > LONG:
        return _local_rows(a, la, b, lb, match, mismatch, gap)
    bits = int(wide).bit_length()
    room = 2 * bits + int(match * min(a.shape[1], b.shape[1]) + max(match, -mismatch, -gap, 1)).bit_length()
    kind = np.int16 if room < 16 else np.int32 if room < 32 else np.int64
    unit, mask = 1 << 2 * bits, (1 << bits) - 1
    places = np.arange(wide, dtype=kind)[:, None]
    ends = ((mask - places.astype(np.int64)) << bits).astype(kind)
    found = np.empty(n, np.int64)
    for at in range(0, n, LANES):
        x, y = np.ascontiguousarray(a[at:at + LANES].T), np.ascontiguousarray(b[at:at + LANES].T)
        size, some = la[at:at + LANES], x.shape[1]
        last, now, spare = (np.empty((wide, some), kind) for _ in range(3))
        last[:] = places
        best, key = np.full(some, ends[0, 0], kind), np.empty(some, kind)
        for i in range(len(x)):
            np.add(last, kind(gap * unit), out=now)
            np.maximum(now, places, out=now)
            np.multiply(x[i] == y, kind((match - mismatch) * unit), out=spare[1:], dtype=kind)
            spare[1:] += last[:-1]
            spare[1:] += kind(mismatch * unit)
            np.maximum(now[1:], spare[1:], out=now[1:])
            for j in range(1, wide):
                np.add(now[j - 1], kind(gap * unit), out=key)
                np.maximum(now[j], key, out=now[j])
            np.add(now, ends, out=spare)
            spare.max(axis=0, out=key)
            np.copyto(best, np.maximum(best, key), where=i < size)
            last, now = now, last
        found[at:at + LANES] = best
    return found >> 2 * bits, found & mask, mask - ((found >> bits) & mask)


def _local_rows(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, match: int, mismatch: int, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """local() for few pairs or long strings: a row of the table a base of a, gaps along it a running maximum."""
    places = np.arange(b.shape[1] + 1, dtype=np.int64)
    unit = np.int64(1 << BITS)
    ramp, ends = -gap * unit * places, (unit - 1 - places) << BITS
    last = np.broadcast_to(places, (len(a), len(places)))
    best = np.broadcast_to(ends[:1], (len(a),))
    for i in range(a.shape[1]):
        now = np.maximum(last + gap * unit, places)
        now[:, 1:] = np.maximum(now[:, 1:], last[:, :-1] + np.where(a[:, i:i + 1] == b, match * unit, mismatch * unit))
        last = np.maximum.accumulate(now + ramp, axis=1) - ramp
        key = (((last >> BITS) << (2 * BITS)) + ends + (last & (unit - 1))).max(axis=1)
        best = np.where(i < la, np.maximum(best, key), best)
    return best >> (2 * BITS), best & (unit - 1), unit - 1 - ((best >> BITS) & (unit - 1))


def edits(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> list[str]:
    """Edit paths that make each b of its a, as runs of = (same), X (other base), I (base of b only), D (base of a only).

    Paths are walked back from the end for all pairs at once; of equal steps a pair of bases goes before D, and D before I."""
    n, wide, long = len(a), a.shape[1], b.shape[1]
    ramp = np.arange(long + 1, dtype=np.int32)
    table = np.empty((wide + 1, n, long + 1), np.int32)
    table[0] = ramp
    for i in range(wide):
        now = table[i] + 1
        now[:, 1:] = np.minimum(now[:, 1:], table[i][:, :-1] + (a[:, i:i + 1] != b))
        table[i + 1] = np.minimum.accumulate(now - ramp, axis=1) + ramp
    row, i, j = np.arange(n), la.astype(np.int64), lb.astype(np.int64)
    steps = []
    while (i > 0).any() or (j > 0).any():
        here = table[i, row, j]
        same = a[row, np.maximum(i - 1, 0)] == b[row, np.maximum(j - 1, 0)]
        pair = (i > 0) & (j > 0) & (table[np.maximum(i - 1, 0), row, np.maximum(j - 1, 0)] + ~same == here)
        only_a = ~pair & (i > 0) & (table[np.maximum(i - 1, 0), row, j] + 1 == here)
        only_b = ~pair & ~only_a & (j > 0)
        steps.append(np.where(pair, np.where(same, ord("="), ord("X")), np.where(only_a, ord("D"), np.where(only_b, ord("I"), 0))))
        i, j = i - (pair | only_a), j - (pair | only_b)
    walked = np.array(steps[::-1], np.uint8).reshape(len(steps), n).T
    out = []
    for path in walked:
        path = path[path > 0]
        cut = np.flatnonzero(np.diff(path)) + 1
        out.append("".join(f"{k}{chr(c)}" for k, c in zip(np.diff([0, *cut.tolist(), len(path)]).tolist(), path[[0, *cut.tolist()]].tolist())) if len(path) else "")
    return out


def over_pairs(pairs: DataFrame, a: str, b: str, added: dict[str, T.DataType], kernel, pad: bytes = b"") -> DataFrame:
    """pairs plus the columns that kernel(a, la, b, lb) gives, one array each; a map over rows. Nulls count as empty strings."""
    names = pairs.columns
    ia, ib = names.index(a), names.index(b)
    schema = T.StructType([*pairs.schema.fields, *[T.StructField(c, t) for c, t in added.items()]])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for start in range(0, batch.num_rows, PAIRS):
                part = batch.slice(start, PAIRS)
                texts = [c.fill_null("") for c in (part.column(ia), part.column(ib))]
                got = kernel(*matrix(texts[0], PAD_A, pad), *matrix(texts[1], PAD_B, pad))
                made = [pa.array(x) if isinstance(x, list) else pa.array(x.astype(np.int32)) for x in (got if isinstance(got, tuple) else (got,))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*names, *added])

    return pairs.mapInArrow(run, schema)


def with_infix(pairs: DataFrame, a: str, b: str, side: int = 3) -> DataFrame:
    """Adds dist, the distance of the padded barcode a to the nearest substring of the padded b, and end, where that first ends
    in the padded b: what b has beyond a costs at most `side` on either end."""
    return over_pairs(pairs, a, b, {"dist": T.IntegerType(), "end": T.IntegerType()}, infix, b"N" * side)


def with_local(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds score, start and end (from 0, exclusive) of the best local alignment of a in b: 1 a match, -1 all else."""
    return over_pairs(pairs, a, b, {"score": T.IntegerType(), "start": T.IntegerType(), "end": T.IntegerType()}, local)


def with_probe(pairs: DataFrame, probe: str, a: str, b: str) -> DataFrame:
    """Adds strand, score, start and end of the best local alignment of a probe in either string: 0 for a, which wins ties, 1 for b."""
    body = np.frombuffer(probe.encode(), np.uint8)

    def better(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, ...]:
        sides = np.broadcast_to(body, (len(a), len(body))), np.full(len(a), len(body))
        one, two = local(*sides, a, la), local(*sides, b, lb)
        second = two[0] > one[0]
        return second, *(np.where(second, y, x) for x, y in zip(one, two))

    return over_pairs(pairs, a, b, {c: T.IntegerType() for c in ("strand", "score", "start", "end")}, better)


def path_edits(path: Column) -> Column:
    """Struct of the bases that are the same, substituted, inserted and deleted on a path."""
    count = lambda kind: F.aggregate(F.regexp_extract_all(path, F.lit(rf"(\d+){kind}"), F.lit(1)), F.lit(0), lambda n, x: n + x.cast("int"))
    return F.struct(count("=").alias("same"), count("X").alias("sub"), count("I").alias("ins"), count("D").alias("del"))


def with_path(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds path, the edits that make b of a: runs of =, X, I and D."""
    return over_pairs(pairs, a, b, {"path": T.StringType()}, edits)
