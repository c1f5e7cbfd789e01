"""Approximate nearest neighbours by cosine: a navigable small-world graph per shard, as flat neighbour arrays.

Rows with equal vectors are one node of the graph (its smallest `k` + 1 ids are kept with it: no answer can use
more, as equal vectors tie and ties go to smaller ids). Nodes are dealt to shards of about `shard_rows` by a hash.
A shard's graph has levels: each node's highest is drawn geometrically, and a level links the nodes that reach it. A node is
linked to diverse ones of its `ef` nearest (those not nearer to one already chosen, nearest first), which in a
shard of bounded size are found by a matrix product, and is linked back by them as far as they have room, again
diverse ones first. Each shard is stored as a row of flat arrays: ids, vectors, levels and, a level, a fixed
number of neighbours a node, padded with -1.

Queries are packed in blocks, every block meets every shard once (a stated query set against all rows): a task loads a
shard, then its blocks stream past it. Each shard returns its best for each query, and the results are merged. Scores
are computed anew in double precision on the original vectors. Building is linear in rows; searching is queries times
shards times the logarithm of a shard.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; a vector meets
only vectors of its own length, which have graphs of their own; a row never finds itself, but finds its copies; rows
with a null id are no queries and no candidates; of repeated rows of one id that differ, each is a candidate and the
nearest counts, and the smallest vector is the query; with fewer than k candidates all are returned; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

INDEX = "shard int, dim int, size int, entry int, ids binary, id_at binary, vectors binary, levels binary, neighbours binary"


class Graph:
    """A hierarchical navigable small-world graph over unit vectors."""

    def __init__(self, vectors: np.ndarray, m: int = 12, ef: int = 60, seed: int = 7):
        self.x = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
        n = len(vectors)
        self.m = m
        self.levels = np.minimum(8, (-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(m)).astype(np.int32))
        top = int(self.levels.max(initial=0))
        self.links = [np.full((n, 2 * m if level == 0 else m), -1, np.int32) for level in range(top + 1)]
        self.degree = [np.zeros(n, np.int32) for _ in range(top + 1)]
        self.entry = int(np.argmax(self.levels)) if n else -1
        self.seen, self.turn = np.zeros(n, np.int32), 0
        for level in range(top + 1):
            self._link(level, np.flatnonzero(self.levels >= level), ef)

    def _link(self, level: int, nodes: np.ndarray, ef: int) -> None:
        """Links the nodes of a level, from the nearest `ef` of each among them."""
        links, degree, x = self.links[level], self.degree[level], self.x[nodes]
        most, near = min(ef, len(nodes) - 1), []
        if most < 1:
            return
        for at in range(0, len(nodes), 1024):
            sims = x[at:at + 1024] @ x.T
            sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -2.0
            part = np.argpartition(-sims, most - 1, axis=1)[:, :most]
            near.append(np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable"), 1))
        chosen = [nodes[row][self._diverse(x[i], nodes[row], self.m)] for i, row in enumerate(np.concatenate(near))]
        back: list[list[int]] = [[] for _ in range(len(self.x))]
        for i, to in zip(nodes.tolist(), chosen):
            for j in to.tolist():
                back[j].append(i)
        for i, to in zip(nodes.tolist(), chosen):
            ids = np.unique(np.concatenate([to, np.array(back[i], np.int64)]))
            if len(ids) > links.shape[1]:
                ids = ids[np.argsort(-(self.x[ids] @ self.x[i]), kind="stable")]
                ids = ids[self._diverse(self.x[i], ids, links.shape[1])]
            links[i, :len(ids)], degree[i] = ids, len(ids)

    def _diverse(self, v: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        """Of ids, nearest first: the places of those not nearer to one already chosen, filled up with the nearest left out."""
        near = self.x[ids] @ v
        closer = (self.x[ids] @ self.x[ids].T) >= near[:, None]
        kept: list[int] = []
        free = np.ones(len(ids), bool)
        for k in range(len(ids)):
            if len(kept) == most:
                break
            if free[k]:
                kept.append(k)
                free &= ~closer[:, k]
        if len(kept) < most:
            kept += [k for k in range(len(ids)) if k not in set(kept)][:most - len(kept)]
        return np.array(kept, np.int64)

    def search(self, q: np.ndarray, start: list[int], ef: int, level: int) -> list[tuple[float, int]]:
        """The best ef (similarity, node) found from the start nodes, best first."""
        self.turn += 1
        seen, turn, links, x = self.seen, self.turn, self.links[level], self.x
        seen[start] = turn
        near = x[start] @ q
        best = sorted(zip(near.tolist(), start))[-ef:]
        heapq.heapify(best)
        todo = [(-s, j) for s, j in best]
        heapq.heapify(todo)
        while todo:
            s, j = heapq.heappop(todo)
            if len(best) >= ef and -s < best[0][0]:
                break
            near_ids = links[j, :self.degree[level][j]]
            near_ids = near_ids[seen[near_ids] != turn]
            if len(near_ids) == 0:
                continue
            seen[near_ids] = turn
            for sim, k in zip((x[near_ids] @ q).tolist(), near_ids.tolist()):
                if len(best) < ef:
                    heapq.heappush(best, (sim, k))
                    heapq.heappush(todo, (-sim, k))
                elif sim > best[0][0]:
                    heapq.heapreplace(best, (sim, k))
                    heapq.heappush(todo, (-sim, k))
        return sorted(best, reverse=True)

    def nearest(self, q: np.ndarray, ef: int) -> list[int]:
        at = [self.entry]
        for level in range(int(self.levels[self.entry]), 0, -1):
            at = [self.search(q, at, 1, level)[0][1]]
        return [j for _, j in self.search(q, at, ef, 0)]

    def flat(self) -> bytes:
        """Neighbours of all levels, level after level; level 0 has 2m places a node, the others m."""
        return b"".join(x.tobytes() for x in self.links)

    @classmethod
    def load(cls, x: np.ndarray, levels: np.ndarray, entry: int, flat: bytes, m: int) -> Graph:
        g = cls.__new__(cls)
        g.x, g.levels, g.entry, g.m = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), levels, entry, m
        n, at = len(x), 0
        g.links, g.degree = [], []
        for level in range(int(levels.max(initial=0)) + 1):
            width = 2 * m if level == 0 else m
            g.links.append(np.frombuffer(flat, np.int32, n * width, at).reshape(n, width))
            g.degree.append((g.links[-1] >= 0).sum(axis=1))
            at += 4 * n * width
        g.seen, g.turn = np.zeros(n, np.int32), 0
        return g


def usable(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v) of the rows that take part; v keeps the original values, as doubles."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def build(rows: DataFrame, k: int, shard_rows: int = 8192, m: int = 12, ef: int = 60) -> DataFrame:
    """The index: one row of flat arrays a shard, written to the shared folder."""
    # One node for each vector, with its smallest ids; the keyed part goes first, so a very common vector meets in small pieces.
    part = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    smallest = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    pieces = rows.withColumn("part", part).groupBy("v", "part").agg(smallest(F.collect_set("vec_id")).alias("ids"))
    nodes = common.materialise(pieces.groupBy("v").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids")))
    shards = max(1, -(-nodes.count() // shard_rows))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0], F.lit(3)), F.lit(shards)).cast("int"))

    def graph(key: tuple, t: pa.Table) -> pa.Table:
        lists = t.column("v").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        outs = []
        for d in np.unique(sizes):  # another length is another space: a graph of its own
            at = np.flatnonzero(sizes == d)
            part = t.take(pa.array(at)).sort_by([("first", "ascending")])
            x = part.column("v").combine_chunks().flatten().to_numpy().reshape(-1, int(d))
            g = Graph(x, m, ef)
            ids = part.column("ids").combine_chunks()
            outs.append((key[0].as_py(), int(d), len(x), g.entry, ids.flatten().to_numpy().astype(np.int64).tobytes(), (ids.offsets.to_numpy() - ids.offsets[0].as_py()).astype(np.int64).tobytes(), x.tobytes(), g.levels.tobytes(), g.flat()))
        names = [c.split()[0] for c in INDEX.split(", ")]
        kinds = [pa.int32()] * 4 + [pa.binary()] * 5
        return pa.table([pa.array([o[i] for o in outs], kinds[i]) for i in range(len(names))], names)

    return common.materialise(dealt.select("shard", "v", "ids", F.col("ids")[0].alias("first")).groupBy("shard").applyInArrow(graph, INDEX))


def search(index: DataFrame, queries: DataFrame, k: int, ef: int = 200, m: int = 12, block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all shards for each query of (vec_id, v)."""
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // block))
    packed = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks)))
    packed = packed.groupBy("block").agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))  # `block` rows, by a hash of unique ids
    last = index.agg(F.max("shard")).first()[0]
    shards = F.sequence(F.lit(0), F.lit(last)) if last is not None else F.array().cast("array<int>")
    # A shard's rows of arrays come first, then every block once: sorted, so a task holds one shard and streams the rest.
    stored = index.select("shard", F.lit(-1).cast("long").alias("block"), F.struct(*[c for c in index.columns if c != "shard"]).alias("g"), F.lit(None).cast("array<struct<vec_id:bigint,v:array<double>>>").alias("q"))
    asked = packed.select(F.explode(shards).alias("shard"), "block", F.lit(None).cast(stored.schema["g"].dataType).alias("g"), "q")  # each block meets each shard once
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = stored.unionByName(asked).repartition(n, "shard").sortWithinPartitions("shard", "block")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, graphs = None, {}
        for batch in found:
            shard, stored_at = batch.column("shard").to_pylist(), batch.column("g").is_valid().to_pylist()
            for r in range(batch.num_rows):
                if shard[r] != now:
                    now, graphs = shard[r], {}
                if stored_at[r]:
                    s = batch.column("g")[r].as_py()
                    x = np.frombuffer(s["vectors"], np.float64).reshape(s["size"], s["dim"])
                    g = Graph.load(x, np.frombuffer(s["levels"], np.int32), s["entry"], s["neighbours"], m)
                    graphs[s["dim"]] = g, x, np.frombuffer(s["ids"], np.int64), np.frombuffer(s["id_at"], np.int64)
                    continue
                out = []
                for q in batch.column("q")[r].as_py():
                    v = np.array(q["v"], np.float64)
                    if len(v) not in graphs:
                        continue
                    g, x, ids, at = graphs[len(v)]
                    near = np.array(g.nearest((v / np.linalg.norm(v)).astype(np.float32), ef))
                    score = (x[near] * v).sum(axis=1) / (np.sqrt((x[near] * x[near]).sum(axis=1)) * np.sqrt((v * v).sum()))
                    own = [(-sc, int(i), q["vec_id"]) for j, sc in zip(near, score.tolist()) for i in ids[at[j]:at[j + 1]] if i != q["vec_id"]]
                    out += sorted(own)[:k]
                yield pa.RecordBatch.from_arrays([pa.array([o[2] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([-o[0] for o in out], pa.float64())], ["query_id", "vec_id", "score"])

    best = met.mapInArrow(run, "query_id long, vec_id long, score double")
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)  # at most k a shard and query
    merged = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).groupBy("query_id").agg(top.alias("t"))
    return merged.select("query_id", F.posexplode("t").alias("i", "x")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op8_nearest(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    rows = usable(common.table(spark, sf_dir, "embeddings"))
    index = build(rows, k)
    return search(index, rows.filter(F.col("vec_id") % 50 == 0), k)
