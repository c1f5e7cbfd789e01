"""Merkle manifest of a dataset: a digest for each row, a tree for each source, a tree over the sources.

A row's leaf is the hash of its columns, each written with its length, so no two rows are written alike. A source's leaves,
by doc_id, are hashed in runs of FANOUT until one node is left, its subroot; the subroots, by source, likewise give
the root. A leaf's proof is the other nodes of its runs, from the leaf to the root: whoever holds a row and its proof
can recompute the root without any other row.

How it runs. Texts are hashed where they are read; what moves is 32 bytes a row. Rows are ordered by ranges and each
range is numbered by itself, so a source of any size is spread over tasks. Runs are aligned, so FANOUT^LEVELS
consecutive nodes form a subtree that depends on no other node: each block is a contiguous digest matrix, reshaped by the
fanout and hashed level by level; all siblings are slices of these matrices, found by index arithmetic. Blocks are
written packed, a row each. Their roots are the nodes of the next stage, thousands of times fewer, so stages are few; then paths
go down the same blocks. A task holds blocks only, whatever the table's size.

Defined results: null columns are written as `-`; rows of one doc_id are ordered by their leaf, null doc_ids first;
repeated rows are leaves each; a null source is a source, first in order; an empty table gives no rows; extra columns
are neither hashed nor returned. A null doc_id counts as the empty text where ids are hashed.
"""

from __future__ import annotations

import binascii
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

FANOUT, LEVELS = 16, 3
HASHED = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: binary, after: binary>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(columns: dict[str, Column]) -> Column:
    """The hash of a row's columns, in the order of HASHED, as 32 bytes."""
    written = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in (columns[n] for n in HASHED)]
    return F.unhex(F.sha2(F.concat(*written), 256))


def numbered(rows: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """Adds pos, the row's number from 0 within its key by the order, and total, the rows of the key.

    Rows are dealt to ranges of (key, order); equal rows may lie in several. A range's rows are numbered as they are written,
    and the rows of a key in earlier ranges are summed over a row a range and key."""
    along = [F.col(c).asc_nulls_first() for c in [*within, *order, "ff_tie"]]
    ranged = rows.withColumn("ff_tie", F.monotonically_increasing_id()).repartitionByRange(*along).sortWithinPartitions(*along).drop("ff_tie")
    ranged = common.materialise(ranged.withColumn("ff_id", F.monotonically_increasing_id())).withColumn("ff_part", F.shiftright("ff_id", 33))
    counts = ranged.groupBy("ff_part", *within).agg(F.min("ff_id").alias("ff_first"), F.count(F.lit(1)).alias("ff_n"))
    key = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))  # a row a range
    before = F.sum("ff_n").over(key.orderBy("ff_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("ff_n")
    starts = counts.select(F.col("ff_part").alias("ff_of"), *[F.col(c).alias(f"ff_of_{c}") for c in within], (before - F.col("ff_first")).alias("ff_shift"), F.sum("ff_n").over(key).alias("total"))
    same = F.col("ff_part") == F.col("ff_of")
    for c in within:
        same = same & ranged[c].eqNullSafe(starts[f"ff_of_{c}"])
    return ranged.join(starts, same).select(*[ranged[c] for c in rows.columns], (F.col("ff_id") + F.col("ff_shift")).cast("long").alias("pos"), F.col("total").cast("long"))


def depth_of(total: int, most: int = LEVELS) -> int:
    """Levels of the tree over so many nodes, within a block of `most` levels."""
    depth = 0
    while depth < most and FANOUT**depth < total:
        depth += 1
    return depth


def levels_of(digests: bytes, depth: int) -> list[np.ndarray]:
    """Hex digest matrices (nodes, 64) of a block: its nodes, the hashes of their runs, and so on up to `depth`."""
    out = [np.frombuffer(binascii.hexlify(digests), np.uint8).reshape(-1, 64)]
    for _ in range(depth):
        nodes = out[-1]
        runs = -(-len(nodes) // FANOUT)
        whole = np.zeros((runs * FANOUT, 64), np.uint8)
        whole[: len(nodes)] = nodes
        rows = whole.reshape(runs, FANOUT * 64)
        size = np.minimum(FANOUT, len(nodes) - FANOUT * np.arange(runs)) * 64
        hashed = b"".join(hashlib.sha256(memoryview(r)[:n]).hexdigest().encode() for r, n in zip(rows, size.tolist()))
        out.append(np.frombuffer(hashed, np.uint8).reshape(-1, 64))
    return out


def siblings(levels: list[np.ndarray]) -> list[list[tuple[bytes, bytes]]]:
    """For each node of a block, level by level, the hex digests before and after it in its run."""
    node = np.arange(len(levels[0]))
    out: list[list[tuple[bytes, bytes]]] = [[] for _ in node]
    for k, matrix in enumerate(levels[:-1]):
        data, at = matrix.tobytes(), node // FANOUT**k
        low = at // FANOUT * FANOUT
        high = np.minimum(low + FANOUT, len(matrix))
        for mine, a, i, b in zip(out, (low * 64).tolist(), (at * 64).tolist(), (high * 64).tolist()):
            mine.append((data[a:i], data[i + 64:b]))
    return out


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a hex digest and its siblings give."""
    for before, after in path:
        digest = hashlib.sha256(before + digest + after).hexdigest().encode()
    return digest


def packed(nodes: DataFrame, keys: list[str], carried: list[str], levels: int) -> DataFrame:
    """A row a block of nodes (keys, pos, total, digest, carried columns): its digests, its carried rows, its root."""
    schema, size = nodes.schema, FANOUT**levels

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = len(table)
        digests = b"".join(table.column("digest").to_pylist())
        total, block = table.column("total")[0].as_py(), table.column("pos")[0].as_py() // size
        root = binascii.unhexlify(levels_of(digests, depth_of(total, levels))[-1].tobytes())
        items = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in carried], carried) if carried else pa.array([{}] * n, pa.struct([]))
        one = [table.column(c).slice(0, 1).combine_chunks() for c in keys]
        made = [pa.array([block], pa.int64()), pa.array([total], pa.int64()), pa.array([digests], pa.binary()), pa.array([root], pa.binary())]
        names = [*keys, "block", "total", "digests", "root"]
        if carried:
            made.append(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), items))
            names.append("items")
        return pa.Table.from_arrays([*one, *made], names)

    plain = lambda c: f"`{c}` {schema[c].dataType.simpleString()}"
    out = ", ".join([*map(plain, keys), "block long", "total long", "digests binary", "root binary"])
    if carried:
        out += ", items array<struct<" + ", ".join(f"`{c}`: {schema[c].dataType.simpleString()}" for c in carried) + ">>"
    grouped = nodes.select(*keys, "pos", "total", "digest", *carried).groupBy(*keys, F.floor(F.col("pos") / size).alias("ff_block"))
    return common.materialise(grouped.applyInArrow(run, out))


def built(nodes: DataFrame, keys: list[str], carried: list[str], levels: int = LEVELS) -> list[DataFrame]:
    """Packed blocks, stage by stage: the last stage has one block a key."""
    stages, size = [packed(nodes, keys, carried, levels)], FANOUT**levels
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most > size:
        most = -(-most // size)
        up = stages[-1].select(*keys, F.col("block").alias("pos"), F.ceil(F.col("total") / size).cast("long").alias("total"), F.col("root").alias("digest"))
        stages.append(packed(up, keys, [], levels))
    return stages


def _over_blocks(blocks: DataFrame, each: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """each(block's row) for each packed block, as rows of the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for i in range(batch.num_rows):
                rows = list(each(batch.slice(i, 1).to_pylist()[0]))
                columns = zip(*rows) if rows else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return blocks.mapInArrow(run, schema)


def _raw(path: list[tuple[bytes, bytes]]) -> list[dict]:
    return [{"before": binascii.unhexlify(b), "after": binascii.unhexlify(a)} for b, a in path]


def _hex(path: list[dict]) -> list[tuple[bytes, bytes]]:
    return [(binascii.hexlify(p["before"]), binascii.hexlify(p["after"])) for p in path]


def _with_paths(blocks: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    p = paths.select(*[F.col(c).alias(f"ff_{c}") for c in [*keys, "block"]], "path", "subroot", F.col("root").alias("whole"))
    same = blocks["block"] == p["ff_block"]
    for c in keys:
        same = same & blocks[c].eqNullSafe(p[f"ff_{c}"])
    return blocks.join(p, same).drop(*[f"ff_{c}" for c in [*keys, "block"]])


def _lowered(stages: list[DataFrame], paths: DataFrame, keys: list[str], source_type: str, depth: int) -> DataFrame:
    """Paths (keys, block, path, subroot, root) of the first stage's blocks, from those of the last stage's."""
    for blocks in reversed(stages[1:]):
        def each(row: dict) -> Iterator[tuple]:
            levels = levels_of(row["digests"], depth_of(row["total"], depth))
            for i, own in enumerate(siblings(levels)):
                yield *[row[c] for c in keys], row["block"] * FANOUT**depth + i, _raw(own) + row["path"], row["subroot"], row["whole"]

        schema = ", ".join([*[f"`{c}` {source_type}" for c in keys], "block long", f"path {PATH}", "subroot binary", "root binary"])
        paths = _over_blocks(_with_paths(blocks, paths, keys), each, schema)
    return paths


def manifest(docs: DataFrame, changed: Column | None = None, now: Column | None = None, depth: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root) of each row, in hex; proof is the siblings from the leaf to the root.

    folded_root is what the proof gives for the row as it is now: with the text `now` where `changed` holds, as after
    tampering, else unchanged. A block has FANOUT^depth nodes."""
    own = {c: F.col(c) for c in HASHED}
    other = F.when(changed, leaf(own | {"text": now})) if changed is not None else F.lit(None).cast("binary")
    source_type = docs.schema["source"].dataType.simpleString()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    leaves = common.materialise(docs.select("doc_id", "source", leaf(own).alias("digest"), other.alias("other")))
    stages = built(numbered(leaves, ["source"], ["doc_id", "digest"]), ["source"], ["doc_id", "other"], depth)
    subroots = stages[-1].select("source", F.col("root").alias("digest"))
    top = built(numbered(subroots, [], ["source"]), [], ["source"], depth)
    # The last stage's only block has no siblings above it.
    paths = top[-1].select("block", F.array().cast(PATH).alias("path"), F.lit(None).cast("binary").alias("subroot"), "root")
    paths = _lowered(top, paths, [], source_type, depth)

    def to_sources(row: dict) -> Iterator[tuple]:
        levels = levels_of(row["digests"], depth_of(row["total"], depth))
        for i, own in enumerate(siblings(levels)):
            yield row["items"][i]["source"], 0, _raw(own) + row["path"], row["digests"][32 * i:32 * i + 32], row["whole"]

    schema = f"`source` {source_type}, block long, path {PATH}, subroot binary, root binary"
    paths = common.materialise(_over_blocks(_with_paths(top[0], paths, []), to_sources, schema))
    paths = _lowered(stages, paths, ["source"], source_type, depth)

    def to_rows(row: dict) -> Iterator[tuple]:
        levels = levels_of(row["digests"], depth_of(row["total"], depth))
        above, nodes = _hex(row["path"]), levels[0].tobytes()
        rest = b"".join(x for p in above for x in p)
        subroot, root = row["subroot"].hex(), row["whole"].hex()
        for i, (own, item) in enumerate(zip(siblings(levels), row["items"])):
            mine = nodes[64 * i:64 * i + 64]
            now = mine if item["other"] is None else binascii.hexlify(item["other"])
            proof = b"".join(x for p in own for x in p) + rest
            yield item["doc_id"], mine.decode(), subroot, root, proof.decode(), fold(now, own + above).decode()

    return _over_blocks(_with_paths(stages[0], paths, ["source"]), to_rows, f"doc_id {id_type}, leaf string, subroot string, root string, proof string, folded_root string")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, verified after a fifth of them had their capitals changed."""
    docs = common.table(spark, sf_dir, "documents")
    got = manifest(docs, common.fold("doc_id", 5) == 0, F.translate("text", UPPER, LOWER))
    return got.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_written = lambda text: " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
_table = "(select list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as t)"
CRC32_SQL = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce({0}::varchar, ''), ''), lambda c: coalesce(ascii(c), -1)::bigint)), lambda a, b: case when b < 0 then a else xor(a >> 8, t[(xor(a, b) & 255) + 1]) end), 4294967295)"


def _tree_sql(name: str, key: str, from_: str) -> str:
    """Nodes of all levels of the trees of a table (key, pos, n, h), and the siblings of each node."""
    return f"""{name}_nodes as (select {key}, 0 as level, pos, n, h from {from_}
    union all select {key}, level + 1, pos // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' order by pos)) from {name}_nodes where n > 1 group by {key}, level, pos // {FANOUT}, n),
{name}_top as (select {key}, max(level) as levels, arg_max(h, level) as h from {name}_nodes group by {key}),
{name}_sib as (select a.{key}, a.level, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos < a.pos), '') as before, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos > a.pos), '') as after
    from {name}_nodes a join {name}_nodes b on a.{key} = b.{key} and a.level = b.level and a.pos // {FANOUT} = b.pos // {FANOUT} where a.n > 1 group by a.{key}, a.level, a.pos)"""


OP12_SQL = f"""with recursive crc as {_table},
d as (select doc_id, source, sha256({_written('text')}) as leaf, case when {CRC32_SQL.format('doc_id')} % 5 = 0 then sha256({_written(f"translate(text, '{UPPER}', '{LOWER}')")}) end as other from documents, crc),
s as (select source, row_number() over (order by source nulls first) - 1 as sid, count(*) over () as n from (select distinct source from d)),
l as (select d.*, s.sid, row_number() over (partition by s.sid order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by s.sid) as n from d join s on d.source is not distinct from s.source),
low_leaves as (select sid, pos, n, leaf as h from l),
{_tree_sql('low', 'sid', 'low_leaves')},
up_leaves as (select 0 as one, s.sid as pos, s.n, t.h from s join low_top t using (sid)),
{_tree_sql('up', 'one', 'up_leaves')},
steps as (select l.sid, l.pos as leaf_pos, x.level as step, x.before, x.after from l join low_sib x on x.sid = l.sid and x.pos = l.pos // ({FANOUT} ** x.level)::bigint
    union all select l.sid, l.pos, t.levels + x.level, x.before, x.after from l join low_top t using (sid) join up_sib x on x.pos = l.sid // ({FANOUT} ** x.level)::bigint),
proofs as (select sid, leaf_pos, sha256(string_agg(before || after, '' order by step)) as proof_sha256 from steps group by sid, leaf_pos),
walk as (select sid, pos as leaf_pos, 0 as step, coalesce(other, leaf) as h from l
    union all select w.sid, w.leaf_pos, w.step + 1, sha256(x.before || w.h || x.after) from walk w join steps x on x.sid = w.sid and x.leaf_pos = w.leaf_pos and x.step = w.step),
folded as (select sid, leaf_pos, arg_max(h, step) as h from walk group by sid, leaf_pos)
select l.doc_id, l.leaf, t.h as subroot, r.h as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, f.h as folded_root, f.h = r.h as verified
from l join low_top t using (sid) cross join up_top r join folded f on f.sid = l.sid and f.leaf_pos = l.pos left join proofs p on p.sid = l.sid and p.leaf_pos = l.pos"""
