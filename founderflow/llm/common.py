"""Shared helpers of the training-data operators: tables, shared storage, hashed words."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from founderflow.plans.storage import CLEANUP, forget, materialise, shared_dir

__all__ = ["forget", "materialise"]

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """The name, or if df has a column of that name (in any case) the name with underscores at its end."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """materialise() into one bucket a shuffle partition by the column, so that joins and groups on it don't move these rows.

    A table of the session's catalog is made for the write and dropped, without its files, as soon as it is read."""
    spark = df.sparkSession
    path, name = shared_dir(spark), f"ff_{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(n, column).format("parquet").option("path", path).option("compression", "uncompressed").saveAsTable(name)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.table(name)
    spark.sql(f"drop table {name}")
    back._ff_path = path
    return back


def shielded(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with columns of these names renamed, and what gives df's columns back their names."""
    before, taken = df.columns, {n.lower() for n in names}
    now = [f"ff_kept_{i}" if c.lower() in taken else c for i, c in enumerate(before)]
    return df.toDF(*now), lambda out: out.select(*[F.col(f"`{c}`").alias(b) for c, b in zip(now, before)])


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def is_not_word(data: np.ndarray) -> np.ndarray:
    """ASCII other than letters and digits; bytes of other characters belong to words."""
    low = data | 32
    return ~((data >= 128) | ((data >= 48) & (data <= 57)) | ((low >= 97) & (low <= 122)))


_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C17)  # odd, 3 modulo 4
INVERSE = U64(pow(int(BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    if kind not in _powers or len(_powers[kind]) < n:
        with np.errstate(over="ignore"):
            x = np.full(max(n, 1 << 20), BASE if kind == "up" else INVERSE, U64)
            x[0] = U64(1)
            _powers[kind] = np.cumprod(x)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes to doubles in (0, 1]."""
    return ((x >> U64(11)).astype(np.float64) + 1.0) * (2.0**-53)


def hashed_words(texts: pa.Array, separators=is_space, lower: str = "ascii") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the offsets of each text's words. Null counts as empty.

    A word's hash is a polynomial of its bytes over random byte values, read off one prefix sum over the
    whole batch, so the cost is some array passes and no Python work per word.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower == "unicode":
        texts = pc.utf8_lower(texts)
    n = len(texts)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    if lower == "ascii":
        data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~separators(data)
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    sums = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE[data] * _power("up", len(data)), out=sums[1:])
        words = mix((sums[ends] - sums[starts]) * _power("down", len(data) + 1)[starts] + (ends - starts).astype(U64))
    return words, np.searchsorted(starts, at).astype(np.int64)


def ngrams(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams that stay within a text, the text of each, and its first word's position."""
    if len(words) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(words) - n + 1, U64)
        for k in range(n):
            h = h * BASE + words[k:len(words) - n + 1 + k]
        h = mix(h)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole = np.flatnonzero(doc[:len(h)] == doc[n - 1:])
    return h[whole], doc[whole], whole


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over batches that gives the memory it no longer needs back to the system as its task ends.

    Python workers outlive tasks and stages; without this each holds what its largest task took."""

    def lean_run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(found)
        finally:
            give_back()

    return lean_run


def give_back() -> None:
    """Returns freed memory, Arrow's and the C library's, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has one
    if trim:
        trim(0)


def batches(column: pa.Array, most: int = 2 << 20):
    """Slices (start, length) of a batch, each with at most that many bytes of text or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    total = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        end = int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right"))
        end = min(max(end, start + 1), len(sizes))
        yield start, end - start
        start = end
