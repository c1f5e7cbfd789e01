"""Column functions over barcodes, reads and edit records; all JVM-side."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

K = 6


def truncated(umi: Column, most: int) -> Column:
    return F.substring(umi, 1, most)


def padded(umi: Column, side: int = 3) -> Column:
    return F.concat(F.lit("N" * side), umi, F.lit("N" * side))


def padded_slot(umi: Column, most: int, side: int = 3) -> Column:
    """A founder in a slot of fixed width: padded in front, filled up to most + 2 * side with N."""
    return F.rpad(F.concat(F.lit("N" * side), umi), most + 2 * side, "N")


def kmers(umi: Column, k: int = K) -> Column:
    """Distinct k-mers in upper case; windows with another base than A, C, G, T have none."""
    every = F.transform(F.sequence(F.lit(1), F.length(umi) - (k - 1)), lambda i: F.upper(F.substring(umi, i, F.lit(k))))
    return F.when(F.length(umi) >= k, F.array_distinct(F.filter(every, lambda x: x.rlike(f"^[ACGT]{{{k}}}$")))).otherwise(F.array().cast("array<string>"))


def distance_bound(length: int, error_rate: float) -> int:
    """Largest edit distance expected of a barcode of that length under a per-base error rate."""
    z = 1.96 if length <= 15 else 2.576 if length <= 25 else 3.29 if length <= 35 else 3.89
    x = length * error_rate + z * math.sqrt(error_rate * (1 - error_rate) * length)
    return 1 + (math.floor(x) if length <= 15 else math.floor(x + 0.5))


def distance_bound_column(length: Column, error_rate: Column) -> Column:
    z = F.when(length <= 15, 1.96).when(length <= 25, 2.576).when(length <= 35, 3.29).otherwise(3.89)
    x = length * error_rate + z * F.sqrt(error_rate * (1 - error_rate) * length)
    return (1 + F.when(length <= 15, F.floor(x)).otherwise(F.floor(x + 0.5))).cast("int")


def sliced(seq: Column, start: int, end: int) -> tuple[Column, Column]:
    """(barcode, rest of the read) for a 1-based inclusive range; without a range the whole read stays."""
    if not end:
        return F.lit(""), seq
    return F.substring(seq, start, end - start + 1), F.substring(seq, F.lit(end + 1), F.greatest(F.length(seq) - end, F.lit(0)))


def tagged(name: Column, umi: Column) -> Column:
    """The barcode is put behind the read's name, before any comment."""
    return F.concat(F.substring_index(name, " ", 1), F.lit("_"), umi, F.when(F.instr(name, " ") > 0, F.concat(F.lit(" "), F.substring(name, F.instr(name, " ") + 1, F.length(name)))).otherwise(F.lit("")))


def untagged(name: Column) -> tuple[Column, Column]:
    """(name, barcode), split at the last underscore of the part before any comment."""
    first = F.substring_index(name, " ", 1)
    return F.regexp_extract(first, r"^(.*)_[^_]*$", 1), F.substring_index(first, "_", -1)


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def edit_kinds(err: Column) -> Column:
    """Struct of substitutions, insertions and deletions in a record like 3:A/T_7:C/CG_9:G/."""
    edits = F.filter(F.split(F.coalesce(err, F.lit("")), "_"), lambda x: x.contains("/"))
    alt = F.transform(edits, lambda x: F.length(F.substring_index(x, "/", -1)))
    n = lambda test: F.size(F.filter(alt, test))
    return F.struct(n(lambda x: x == 1).alias("sub"), n(lambda x: x > 1).alias("ins"), n(lambda x: x == 0).alias("del"))


def ratio(ins: Column, dele: Column, sub: Column) -> Column:
    """The three numbers over their minimum; NA without insertions or deletions."""
    low = F.least(ins, dele, sub)
    return F.when((ins == 0) | (dele == 0) | (low == 0), F.lit("NA")).otherwise(F.format_string("%.3f-%.3f-%.3f", (ins / low).cast("double"), (dele / low).cast("double"), (sub / low).cast("double")))


def read_type(umi_len: Column) -> Column:
    return F.when(umi_len.isin(12, 18), "short").when(umi_len.isin(25, 50), "long").otherwise("unknown")


def angle_at(ax: float, ay: float, x: Column, y: Column, cx: float, cy: float) -> Column:
    """Degrees of the angle at (x, y) between A and C, by the law of cosines; the cosine is kept within [-1, 1]."""
    square = lambda px, py: (x - px) * (x - px) + (y - py) * (y - py)
    a2, c2, b2 = square(cx, cy), square(ax, ay), (ax - cx) ** 2 + (ay - cy) ** 2
    cosine = (a2 + c2 - b2) / (2 * F.sqrt(a2) * F.sqrt(c2))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) * 180 / F.lit(3.1415926535)
