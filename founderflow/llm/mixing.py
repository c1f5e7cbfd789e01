"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame functions only).

Every source owns a quota of words: its share of all words by weight, water-filled under `most` times its size.
The quota is cut into whole copies of the source plus a rest. Documents are in a keyed order (a digest of their id) and
grouped in blocks by its first four digits, 65,536 a source at most. A source's units are its blocks, copy after copy;
those of the rest end with the block in which the quota is reached.

The tree deals exact quotas of units among output shards. Its root holds all units; at each node a keyed permutation
of the node's units is cut in half, which draws the left child's vector of counts by source from the multivariate
hypergeometric distribution. A leaf is a shard, its vector the shard's quota of each source. A source's shards
then take disjoint runs of its permuted units, as many as their quotas. What a document gives is what the leaves that
hold its block take of it, copy by copy; in the one block in which a source's quota ends, documents are counted to
the word. Within a shard, rows are shuffled by a second keyed digest, `place`.

Nothing of the size of the corpus meets in one task: running sums over blocks are taken in two steps of 256, the
ranks of units at a node by first counting 4,096 ranges of their digests, and document-level windows hold one
block of one source. A source's plan is a row with one boundary a shard. Water-filling sorts the sources, a row each.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; sources without
words and texts without words take nothing; repeated rows are each a document; a null doc_id is the empty text
to the key; an empty table gives an empty mix. Extra columns pass through; where one has the name of a
result, the result's name gets an underscore at its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row a source (source, source_size) in; adds target, the water-filled share of all words.

    The shares capped at `most` times the size are those with the smallest ratio of cap to weight, so one pass
    over the sources sorted by that ratio finds the level at which none is above its cap (the highest of those that hold).
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = W.orderBy("ratio", F.col("source").isNull(), "source")
    everything = W.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    s = s.withColumn("ratio", F.col("cap") / F.col("w"))
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    s = s.withColumn("caps", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("ws", F.coalesce(F.sum("w").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("level", (F.col("total") - F.col("caps")) / (F.col("all_w") - F.col("ws")))
    s = s.withColumn("cut", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    target = F.when(F.col("cut").isNull() | (F.col("cut") * F.col("w") > F.col("cap")), F.col("cap")).otherwise(F.col("cut") * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def _key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def _running(rows: DataFrame, within: list[str], coarse: Column, order: str, sums: dict[str, Column]) -> DataFrame:
    """Adds the sums over all rows before a row by `order` within its group: over coarse ranges first, then within one."""
    r = rows.withColumn("range", coarse)
    total = r.groupBy(*within, "range").agg(*[F.sum(c).alias(f"all_{k}") for k, c in sums.items()])
    before = W.partitionBy(*within).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    total = total.select(*[F.col(c).alias(f"t_{c}") for c in [*within, "range"]], *[F.coalesce(F.sum(f"all_{k}").over(before), F.lit(0)).alias(f"far_{k}") for k in sums])
    same = [r[c].eqNullSafe(total[f"t_{c}"]) for c in [*within, "range"]]
    near = W.partitionBy(*within, "range").orderBy(*order.split(",")).rowsBetween(W.unboundedPreceding, -1)
    met = r.join(total, same)
    out = met.select(*[r[c] for c in rows.columns], *[(F.col(f"far_{k}") + F.coalesce(F.sum(c).over(near), F.lit(0))).cast("long").alias(k) for k, c in sums.items()])
    return out


def _same(a: str, b: str, *columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def planned(slim: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, levels: int = 3) -> DataFrame:
    """A row a source, from rows (source, size, block): its size, target, whole copies, where the rest ends (block and words
    left there), its quota of units by shard, and for each shard with a quota its last unit (copy, block)."""
    blocks = common.materialise(slim.groupBy("source", "block").agg(F.sum("size").alias("words")))
    sizes = blocks.groupBy("source").agg(F.sum("words").alias("source_size"), F.count(F.when(F.col("words") > 0, 1)).alias("n_blocks"))
    quota = targets(sizes.drop("n_blocks"), weights, most).withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
    n, q = F.col("source_size"), F.col("quota")
    quota = quota.withColumn("copies", F.when(n > 0, F.floor(q / n)).otherwise(0).cast("long"))
    quota = quota.withColumn("rest", F.when(n > 0, q - F.col("copies") * n).otherwise(F.lit(0)))
    quota = quota.alias("q").join(sizes.alias("s"), _same("q", "s", "source")).select("q.*", "s.n_blocks")
    ordered = common.materialise(_running(blocks.filter("words > 0"), ["source"], F.substring("block", 1, 2), "block", {"before": F.col("words"), "rank": F.lit(1)}))
    # The rest ends in one block of each source: those before it are drawn whole, those after it not at all.
    end = ordered.alias("b").join(quota.alias("q"), _same("b", "q", "source")).filter("rest > 0 and before < rest and before + words >= rest")
    end = end.select("b.source", F.col("block").alias("end_block"), (F.col("rest") - F.col("before")).alias("end_words"), (F.col("rank") + 1).alias("end_rank"))
    plan = common.materialise(quota.alias("q").join(end.alias("e"), _same("q", "e", "source"), "left").select("q.*", "end_block", "end_words", F.coalesce("end_rank", F.lit(0)).alias("end_rank")))
    leaves = common.materialise(_tree(plan.select("source", (F.col("copies") * F.col("n_blocks") + F.col("end_rank")).alias("units")), levels))
    # A shard's run of units ends with this copy and block.
    last = leaves.alias("l").join(plan.select("source", "n_blocks").alias("p"), _same("l", "p", "source")).filter("l.n > 0")
    last = last.select("l.source", "l.node", (F.floor((F.col("l.high") - 1) / F.col("n_blocks")) + 1).alias("copy"), ((F.col("l.high") - 1) % F.col("n_blocks")).alias("rank"))
    last = last.alias("l").join(ordered.alias("b"), _same("l", "b", "source", "rank")).select("l.source", "l.node", "l.copy", "b.block")
    runs = last.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("copy", "block", "node"))).alias("runs"))  # 2**levels a source
    counts = leaves.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "n"))), lambda x: x["n"]).alias("quotas"))
    plan = plan.alias("p").join(runs.alias("r"), _same("p", "r", "source"), "left").join(counts.alias("c"), _same("p", "c", "source"), "left")
    return common.materialise(plan.select("p.source", "source_size", "target", "copies", "end_block", "end_words", "r.runs", "c.quotas"))


def _tree(units: DataFrame, levels: int) -> DataFrame:
    """(source, node, n, high): each leaf's quota of each source's units, and their running sum over the leaves.

    units: source and its number of units. At a node the units' keyed order is cut in half."""
    nodes = units.filter("units > 0").select("source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("units"))).alias("i"), F.lit(0).cast("long").alias("node"))
    for level in range(levels):
        keyed = nodes.withColumns({"key": _key(F.lit(f"level{level}"), F.col("source"), F.col("i")), "no_source": F.col("source").isNull()})
        ranked = _running(keyed, ["node"], F.substring("key", 1, 3), "key,no_source,source,i", {"before": F.lit(1)})
        half = nodes.groupBy(F.col("node").alias("h_node")).agg(F.ceil(F.count(F.lit(1)) / 2).alias("half"))
        nodes = ranked.join(half, F.col("node") == F.col("h_node")).select("source", "i", (F.col("node") * 2 + F.when(F.col("before") < F.col("half"), 0).otherwise(1)).alias("node"))
        nodes = common.materialise(nodes)
    counts = nodes.groupBy("source", "node").agg(F.count(F.lit(1)).alias("n"))
    every = units.filter("units > 0").select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2**levels - 1).cast("long"))).alias("node"))
    counts = every.alias("e").join(counts.alias("c"), _same("e", "c", "source", "node"), "left").select("e.source", "e.node", F.coalesce("c.n", F.lit(0)).cast("long").alias("n"))
    return counts.withColumn("high", F.sum("n").over(W.partitionBy("source").orderBy("node")))


RESULTS = ("mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_quotas", "mix_draws")


def draw(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, levels: int = 3) -> DataFrame:
    """All rows of docs plus RESULTS: the document's size, its source's size, target and quotas of units by shard; the words
    drawn, and for each draw its output shard (0 to 2**levels - 1), its place there and its words."""
    size = size_of() if size is None else size
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("of"), size.alias("size"), _key(F.col("doc_id")).alias("hash"))
    rows = rows.withColumn("block", F.substring("hash", 1, 4))
    plan = planned(rows.select(F.col("of").alias("source"), "size", "block"), weights, most, levels)
    # A row a source: below Spark's broadcast threshold no text is moved, above it hot sources are split.
    rows = rows.alias("d").join(plan.alias("p"), F.col("d.of").eqNullSafe(F.col("p.source")), "left")
    ending = F.coalesce(F.col("block") == F.col("end_block"), F.lit(False))
    within = W.partitionBy("of", "block").orderBy("hash", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    room = F.col("end_words") - F.coalesce(F.sum("size").over(within), F.lit(0))
    cut = rows.filter(ending).withColumn("part", F.greatest(F.lit(0), F.least(room, F.col("size"))).cast("long"))
    whole = rows.filter(~ending).withColumn("part", F.when(F.col("block") < F.col("end_block"), F.col("size")).otherwise(F.lit(0)).cast("long"))
    copies = F.sequence(F.lit(1).cast("long"), F.col("copies") + 1)

    def drawn(c: Column) -> Column:
        """What the leaf that holds this copy of the block takes."""
        leaf = F.get(F.filter("runs", lambda r: (r["copy"] > c) | ((r["copy"] == c) & (r["block"] >= F.col("block")))), F.lit(0))
        words = F.when(leaf.isNull(), F.lit(0)).when(c <= F.col("copies"), F.col("size")).otherwise(F.col("part"))
        return F.struct(leaf["node"].cast("int").alias("shard"), _key(F.lit("place"), F.col("id"), c).alias("place"), words.cast("long").alias("words"))

    draws = F.filter(F.transform(copies, drawn), lambda d: d["words"] > 0)
    out = whole.unionByName(cut).withColumn("draws", F.coalesce(draws, F.array().cast("array<struct<shard:int,place:string,words:bigint>>")))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    values = (F.col("size"), F.col("source_size"), F.col("target"), taken, F.col("quotas"), F.col("draws"))
    return out.select("row.*", *[v.alias(common.fresh(docs, name)) for name, v in zip(RESULTS, values)])


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: one row for each draw, with the columns of docs, mix_shard, mix_place and mix_words."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = draw(docs, **kw).select(*columns, F.explode(common.fresh(docs, "mix_draws")).alias(common.fresh(docs, "mix_draw")))
    one = common.fresh(docs, "mix_draw")
    return out.select(*columns, *[F.col(f"{one}.{f}").alias(common.fresh(docs, f"mix_{f}")) for f in ("shard", "place", "words")])


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shards: those of a document's draws, copy by copy; quotas: its source's units by shard, as the tree dealt them."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", size_of().alias("size"))
    out = draw(docs, size=F.col("size"))
    listed = lambda a: F.concat_ws(",", F.transform(a, lambda x: x.cast("string")))
    shards = listed(F.transform("mix_draws", lambda d: d["shard"]))
    return out.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), shards.alias("shards"), F.coalesce(listed(F.col("mix_quotas")), F.lit("")).alias("quotas"))


_NODE = """
t{next} as (select source, i, node * 2 + case when row_number() over (partition by node order by md5('mix-1|level{level}|' || coalesce(source, '') || '|' || i), source is null, source, i)
    <= ceil(count(*) over (partition by node) / 2.0) then 0 else 1 end as node from t{level}),"""


OP9_SQL = (r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5('mix-1|' || coalesce(doc_id::varchar, '')) as h from documents),
s0 as (select source, sum(size)::bigint as n from d group by source),
s1 as (select source, n, ([1.0, 2.0, 3.0])[((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::int]::double as w from s0),
s2 as (select *, 3.0::double * n as cap, 3.0::double * n / w as ratio, (sum(n) over ())::double as total, sum(w) over () as all_w from s1),
s3 as (select *, (total - coalesce(sum(cap) over (order by ratio, source is null, source rows between unbounded preceding and 1 preceding), 0))
    / (all_w - coalesce(sum(w) over (order by ratio, source is null, source rows between unbounded preceding and 1 preceding), 0)) as level from s2),
s4 as (select *, max(case when level <= ratio then level end) over () as cut from s3),
s5 as (select source, n, case when cut is null or cut * w > cap then cap else cut * w end as target from s4),
s6 as (select source, n, target, floor(target + 0.5)::bigint as q from s5),
s7 as (select *, case when n > 0 then q // n else 0 end as k, case when n > 0 then q % n else 0 end as r from s6),
bl as (select source, substr(h, 1, 4) as block, sum(size) as words from d group by all having sum(size) > 0),
b2 as (select *, row_number() over (partition by source order by block) as rank, sum(words) over (partition by source order by block) - words as before, count(*) over (partition by source) as nb from bl),
en as (select s7.source, min(rank) as er from s7 join b2 on s7.source is not distinct from b2.source where r > 0 and before + words >= r group by s7.source),
pl as (select s7.*, coalesce(m.nb, 0) as nb, coalesce(en.er, 0) as er from s7 left join (select source, max(nb) as nb from b2 group by source) m on m.source is not distinct from s7.source
    left join en on en.source is not distinct from s7.source),
t0 as (select source, unnest(generate_series(1, k * nb + er)) as i, 0::bigint as node from pl where k * nb + er > 0),"""
+ "".join(_NODE.format(level=n, next=n + 1) for n in range(3)) + r"""
lf as (select source, node, count(*) as n, sum(count(*)) over (partition by source order by node) as high from t3 group by source, node),
qs as (select p.source, string_agg(coalesce(lf.n, 0)::bigint::varchar, ',' order by g.node) as quotas from pl p cross join (select unnest(range(8)) as node) g
    left join lf on lf.source is not distinct from p.source and lf.node = g.node where p.k * p.nb + p.er > 0 group by p.source),
e as (select row_number() over () as row_id, d.*, pl.n, pl.target, pl.k, pl.r, pl.nb, b2.rank,
    coalesce(sum(size) over (partition by d.source order by h, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as before
    from d join pl on d.source is not distinct from pl.source left join b2 on b2.source is not distinct from d.source and b2.block = substr(h, 1, 4)),
dr as (select row_id, c, case when c <= k then size else greatest(0, least(r - before, size)) end as words,
    (select min(lf.node) from lf where lf.source is not distinct from e.source and lf.high >= (c - 1) * nb + rank) as shard from e, (select unnest(range(1, 5)) as c) where c <= k + 1 and rank is not null),
dd as (select row_id, sum(words) as taken, string_agg(shard::varchar, ',' order by c) as shards from dr where words > 0 and shard is not null group by row_id)
select doc_id, size, n as source_size, target, coalesce(taken, 0)::bigint as taken, coalesce(shards, '') as shards, coalesce(quotas, '') as quotas
from e left join dd using (row_id) left join qs on qs.source is not distinct from e.source
""")
