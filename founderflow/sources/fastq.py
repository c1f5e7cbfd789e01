"""FASTQ: records of four lines, read where their split of the file is and numbered in file order.

Lines come from Spark's text reader, so any file system and codec it opens will do. A task puts the records of its
splits together itself: a split that starts inside a file finds the first record by its own lines (a line that begins
with @ two lines before one that begins with + is a header, as no sequence begins with either). Only the lines of
records that cross a split's edge, six a split at most, are shuffled and joined. Reads move nowhere.

Defined results: an incomplete last record and blank lines at a file's end are dropped; names lose their @; anything
else that isn't four lines a record raises an error that names the file. Empty files and tables give no records.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from founderflow.plans.storage import materialise

HEADER, PLUS = "@", "+"
LOOK = 6  # lines in which a header and the + behind it are sure to be
FIELDS = "kind int, file string, start long, place long, name string, seq string, qual string"
RECORD, EDGE, TOTAL = 0, 1, 2  # a record; a line of a record that crosses an edge; a split's number of lines


def first_header(lines: list[str]) -> int | None:
    """Where the first record begins among some lines in a row; None if they don't tell."""
    for i in range(min(4, len(lines) - 2)):
        if lines[i].startswith(HEADER) and lines[i + 2].startswith(PLUS):
            return i
    return None


class _Split:
    """The lines of one split as they come: `held` are those not given out yet, from line `place` on."""

    def __init__(self, file: str, start: int, records: bool):
        self.file, self.start, self.place, self.records = file, start, 0, records
        self.held = pa.array([], pa.string())
        self.aligned = start == 0

    def _rows(self, kind: int, place, name, seq=None, qual=None) -> pa.RecordBatch:
        n = len(place)
        none = pa.nulls(n, pa.string())
        columns = [pa.array(np.full(n, kind, np.int32)), pa.repeat(pa.scalar(self.file, pa.string()), n), pa.array(np.full(n, self.start)), pa.array(place, pa.int64()), name, none if seq is None else seq, none if qual is None else qual]
        return pa.RecordBatch.from_arrays(columns, ["kind", "file", "start", "place", "name", "seq", "qual"])

    def _edge(self, n: int) -> Iterator[pa.RecordBatch]:
        if not self.records:
            yield self._rows(EDGE, np.arange(self.place, self.place + n), self.held.slice(0, n))
        self.held, self.place = self.held.slice(n), self.place + n

    def add(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        self.held = pa.concat_arrays([self.held, lines])
        if not self.aligned:
            if len(self.held) < LOOK:
                return
            at = first_header(self.held.slice(0, LOOK).to_pylist())
            if at is None:
                raise ValueError(f"no record of four lines near byte {self.start} of {self.file}")
            self.aligned = True
            if at:
                yield from self._edge(at)
        n = len(self.held) // 4
        if n:
            line = lambda k: self.held.take(pa.array(np.arange(k, 4 * n, 4)))
            head = line(0)
            if not (pc.all(pc.starts_with(head, HEADER)).as_py() and pc.all(pc.starts_with(line(2), PLUS)).as_py()):
                raise ValueError(f"a record isn't four lines behind line {self.place} of the split at byte {self.start} of {self.file}")
            if self.records:
                yield self._rows(RECORD, self.place + 4 * np.arange(n), pc.utf8_slice_codeunits(head, 1), line(1), line(3))
            self.held, self.place = self.held.slice(4 * n), self.place + 4 * n

    def end(self) -> Iterator[pa.RecordBatch]:
        if len(self.held):
            yield from self._edge(len(self.held))
        if not self.records:
            yield self._rows(TOTAL, [self.place], pa.nulls(1, pa.string()))


def _parse(batches: Iterator[pa.RecordBatch], records: bool) -> Iterator[pa.RecordBatch]:
    """Either the records within splits, or the splits' edges and totals; what isn't asked for isn't sent back."""
    split = None
    for batch in batches:
        if not batch.num_rows:
            continue
        n, file, start = batch.num_rows, batch.column(1), batch.column(2)
        change = pc.or_(*(pc.not_equal(c.slice(1), c.slice(0, n - 1)) for c in (file, start)))
        new = (np.flatnonzero(change.to_numpy(zero_copy_only=False)) + 1).tolist()
        for a, b in zip([0, *new], [*new, n]):
            here = file[a].as_py(), start[a].as_py()
            if split is None or (split.file, split.start) != here:
                if split is not None:
                    yield from split.end()
                split = _Split(*here, records)
            yield from split.add(batch.column(0).slice(a, b - a).cast(pa.string()))
    if split is not None:
        yield from split.end()


def _before(totals: DataFrame) -> DataFrame:
    """(file, start, lines, records): a file's lines before a split, and the records of the files before it. A row a split."""
    whole = W.partitionBy("file")
    inner = totals.withColumns({"lines": F.sum("place").over(whole.orderBy("start").rowsBetween(W.unboundedPreceding, 0)) - F.col("place"), "all": F.sum("place").over(whole)})
    files = inner.groupBy("file").agg(F.floor(F.max("all") / 4).alias("n"))
    files = files.withColumn("records", F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("file").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    return inner.join(files, "file").select("file", "start", "lines", "records")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(read_id from 0, name, seq, qual), numbered in order of file names and lines. The files are read twice: for
    split totals and edges, which are written at once, and for records when the result is used."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("start"))
    small = materialise(lines.mapInArrow(partial(_parse, records=False), FIELDS))
    before = materialise(_before(small.filter(F.col("kind") == TOTAL).select("file", "start", "place")))
    read_id = (F.col("records") + F.floor((F.col("lines") + F.col("place")) / 4)).alias("read_id")
    inside = lines.mapInArrow(partial(_parse, records=True), FIELDS).join(before, ["file", "start"]).select(read_id, "name", "seq", "qual")
    at = (F.col("lines") + F.col("place")).alias("line_no")
    edges = small.filter(F.col("kind") == EDGE).join(before, ["file", "start"]).select(read_id, (at % 4).alias("k"), F.col("name").alias("line"))
    part = lambda k: F.max(F.when(F.col("k") == k, F.col("line")))
    across = edges.groupBy("read_id").agg(F.substring(part(0), 2, 1 << 30).alias("name"), part(1).alias("seq"), part(2).alias("plus"), part(3).alias("qual"))
    wrong = ~(F.col("plus").startswith(PLUS)) | F.col("name").isNull()
    across = across.filter(F.col("qual").isNotNull()).withColumn("name", F.when(wrong, F.raise_error(F.lit("a record at a split's edge isn't four lines"))).otherwise(F.col("name")))
    return inside.unionByName(across.select("read_id", "name", "seq", "qual"))


def write_fastq(reads: DataFrame, path: str, order: list[str], compression: str | None = None) -> None:
    """Sorted by `order`, one record of four lines a row; nulls are written as empty lines."""
    name, seq, qual = (F.coalesce(F.col(c), F.lit("")) for c in ("name", "seq", "qual"))
    record = F.concat_ws("\n", F.concat(F.lit(HEADER), name), seq, F.lit(PLUS), qual)
    writer = reads.orderBy(*order).select(record.alias("value")).write
    (writer.option("compression", compression) if compression else writer).text(path)
