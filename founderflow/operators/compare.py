"""Other clustering methods over (group_id, umi, n_reads): adjacency, directional, cluster, percentile, unique; and
threshold clustering and probe extraction by local alignment.

Pairs: up to 25 barcodes of a group meet all others; above, those with an equal slice at the same place, of the
threshold + 1 slices of the group's first barcode's length. Slices are part of these methods' definition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from founderflow.functions.numbering import BLOCK, numbered
from founderflow.functions.sequences import reverse_complement
from founderflow.operators.alignment import with_local, with_probe
from founderflow.operators.clustering import elect, with_positions
from founderflow.plans.storage import forget, materialise

SMALL = 25


def ranked(counts: DataFrame) -> DataFrame:
    """Adds rank: most reads first, then by barcode."""
    return with_positions(counts).withColumn("rank", F.col("input_pos").cast("int")).drop("input_pos")


def near_pairs(counts: DataFrame, threshold: int = 1) -> DataFrame:
    """(group_id, umi_a, umi_b, n_a, n_b), umi_a < umi_b, within the threshold."""
    r = ranked(counts)
    sized = r.join(r.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.min_by(F.length("umi"), "rank").alias("len")), "group_id")
    k = threshold + 1
    base, extra = F.floor(F.col("len") / k).cast("int"), (F.col("len") % k).cast("int")
    start = lambda i: i * base + F.least(i, extra)
    slices = F.transform(F.sequence(F.lit(0), F.lit(threshold)), lambda i: F.struct(i.alias("i"), F.substring(F.col("umi"), start(i) + 1, base + F.when(i < extra, 1).otherwise(0)).alias("s")))
    small = F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("s")))
    each = sized.select("group_id", "umi", "n_reads", F.inline(F.when(F.col("size") > SMALL, slices).otherwise(small)))
    a = each.select("group_id", "i", "s", F.col("umi").alias("umi_a"), F.col("n_reads").alias("n_a"))
    b = each.select("group_id", "i", "s", F.col("umi").alias("umi_b"), F.col("n_reads").alias("n_b"))
    near = a.join(b, ["group_id", "i", "s"]).filter("umi_a < umi_b").filter(F.levenshtein("umi_a", "umi_b", threshold) >= 0)
    return near.select("group_id", "umi_a", "umi_b", "n_a", "n_b").distinct()


def adjacency_edges(counts: DataFrame, threshold: int = 1) -> DataFrame:
    """Directed both ways: (group_id, src, dst)."""
    p = near_pairs(counts, threshold)
    return p.select("group_id", F.col("umi_a").alias("src"), F.col("umi_b").alias("dst")).unionByName(p.select("group_id", F.col("umi_b").alias("src"), F.col("umi_a").alias("dst")))


def directional_edges(counts: DataFrame, threshold: int = 1) -> DataFrame:
    """src to dst where src has at least 2 * dst - 1 reads."""
    p = near_pairs(counts, threshold)
    down = p.filter("n_a >= 2 * n_b - 1").select("group_id", F.col("umi_a").alias("src"), F.col("umi_b").alias("dst"))
    up = p.filter("n_b >= 2 * n_a - 1").select("group_id", F.col("umi_b").alias("src"), F.col("umi_a").alias("dst"))
    return down.unionByName(up)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("group_id", "u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: group_id, u, v, undirected, integers. (group_id, u, v): every node that is not its component's least, and that least.

    Star contraction (Kiveris et al. 2014): in turn each node's larger neighbours are tied to its least one, then its smaller ones, so
    rounds grow with the logarithm of the longest path. Both steps join on a group's minima; no neighbourhood is gathered."""
    now = materialise(edges.select("group_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.unionByName(now.select("group_id", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("group_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialise(both.join(least, ["group_id", "u"]).filter("v > u").select("group_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("group_id", "u").agg(F.min("v").alias("m"))
        rest = large.join(low, ["group_id", "u"]).filter("v <> m").select("group_id", F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialise(rest.unionByName(low.withColumnRenamed("m", "v")).distinct())
        forget(now, large)
        now = after
    return now


def reached(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """(group_id, umi, n_reads, rank, lead): lead is the best rank from which edges lead to the barcode, its own included.

    Searches that start in rank order and skip barcodes already found give each barcode to the same lead. Barcodes tied by edges
    both ways have one lead, so they are contracted first, however long their chains; what is left is passed on hop by hop. Under
    directional edges a hop that has no way back halves the reads, so such hops are few.
    """
    rows = materialise(ranked(counts))
    at = lambda name, to: rows.select("group_id", F.col("umi").alias(name), F.col("rank").alias(to))
    directed = materialise(edges.join(at("src", "s"), ["group_id", "src"]).join(at("dst", "t"), ["group_id", "dst"]).select("group_id", "s", "t").distinct())
    back = directed.select("group_id", F.col("s").alias("t"), F.col("t").alias("s"))
    mutual = directed.join(back, ["group_id", "s", "t"], "left_semi")
    tied = components(mutual.select("group_id", F.col("s").alias("u"), F.col("t").alias("v")))
    roots = materialise(rows.join(tied.select("group_id", F.col("u").alias("rank"), F.col("v").alias("root")), ["group_id", "rank"], "left").withColumn("root", F.coalesce("root", "rank")))
    of = lambda name: roots.select("group_id", F.col("rank").alias(name), F.col("root").alias(f"{name}_root"))
    hops = directed.join(back, ["group_id", "s", "t"], "left_anti").join(of("s"), ["group_id", "s"]).join(of("t"), ["group_id", "t"])
    hops = materialise(hops.filter("s_root <> t_root").select("group_id", F.col("s_root").alias("s"), F.col("t_root").alias("t")).distinct())
    ends = hops.select("group_id", F.col("s").alias("root")).unionByName(hops.select("group_id", F.col("t").alias("root"))).distinct()
    now = materialise(ends.withColumn("lead", F.col("root")))
    forget(directed)
    while True:
        sent = hops.join(now.select("group_id", F.col("root").alias("s"), F.col("lead").alias("from")), ["group_id", "s"]).groupBy("group_id", F.col("t").alias("root")).agg(F.min("from").alias("from"))
        after = materialise(now.join(sent, ["group_id", "root"], "left").select("group_id", "root", F.least("lead", F.coalesce("from", "lead")).alias("lead"), (F.coalesce("from", "lead") < F.col("lead")).alias("moved")))
        forget(now)
        now = after
        if after.filter("moved").isEmpty():
            break
        now = after.drop("moved")
        now._ff_path = after._ff_path
    leads = now.select("group_id", "root", F.col("lead").alias("far"))
    return roots.join(leads, ["group_id", "root"], "left").select("group_id", "umi", "n_reads", "rank", F.coalesce("far", "root").alias("lead"))


def groups(counts: DataFrame, method: str = "directional", threshold: int = 1) -> DataFrame:
    """(group_id, umi, n_reads, lead): rows of one lead are a group, whose representative is the row of rank lead."""
    if method == "unique":
        return ranked(counts).withColumn("lead", F.col("rank"))
    if method == "percentile":
        r = ranked(counts)
        cut = r.groupBy("group_id").agg((F.median("n_reads") / 100).alias("cut"), F.count(F.lit(1)).alias("size"))
        return r.join(cut, "group_id").filter("size = 1 or n_reads > cut").select("group_id", "umi", "n_reads", "rank", F.col("rank").alias("lead"))
    if method == "directional":
        return reached(counts, directional_edges(counts, threshold))
    edges = adjacency_edges(counts, threshold)
    parts = reached(counts, edges)
    return parts if method == "cluster" else _least_leads(parts, edges)


def _least_leads(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """Adjacency groups: per component the fewest top-ranked barcodes that, with their neighbours, cover it.

    A barcode is covered once the best rank among itself and its neighbours is taken; the last to be covered tells how
    many must be. The others go to their best-ranked neighbour.
    """
    ranks = parts.select("group_id", F.col("umi").alias("dst"), F.col("rank").alias("near"))
    near = edges.join(ranks, ["group_id", "dst"]).groupBy("group_id", F.col("src").alias("umi")).agg(F.min("near").alias("near"))
    at = parts.join(near, ["group_id", "umi"], "left").withColumn("covered", F.least("rank", F.coalesce("near", "rank")))
    last = at.groupBy("group_id", "lead").agg(F.max("covered").alias("last"))
    lead = F.when(F.col("rank") <= F.col("last"), F.col("rank")).otherwise(F.col("covered"))
    return at.join(last, ["group_id", "lead"]).select("group_id", "umi", "n_reads", "rank", lead.alias("lead"))


def representatives(grouped: DataFrame, whitelist: DataFrame | None = None) -> DataFrame:
    """(group_id, umi, n_reads): each group's representative with its reads; those off the whitelist as one bucket."""
    sums = grouped.groupBy("group_id", "lead").agg(F.sum("n_reads").alias("n_reads"), F.min_by("umi", "rank").alias("umi"))
    out = sums.select("group_id", "umi", "n_reads")
    if whitelist is None:
        return out
    known = whitelist.select("umi").distinct().withColumn("ok", F.lit(True))
    name = F.when(F.col("ok"), F.col("umi")).otherwise("Non-whitelist UMI")
    return out.join(known, "umi", "left").withColumn("umi", name).groupBy("group_id", "umi").agg(F.sum("n_reads").alias("n_reads"))


def _shared_stretch(longest: int, threshold: int) -> int:
    """Letters that two barcodes have in common, unbroken, if their local score exceeds the threshold.

    A score above T with e edits has T + 1 + e matches at least, and no more than the longest barcode has letters; the edits cut
    them into e + 1 stretches."""
    most = longest - threshold - 1
    return min(-(-(threshold + 1 + e) // (e + 1)) for e in range(most + 1)) if most >= 0 else 0


def local_pairs(rows: DataFrame, threshold: int) -> DataFrame:
    """(group_id, a_pos, b_pos, score): all pairs of rows, b before a, whose local score exceeds the threshold.

    Such pairs have a stretch of letters in common, at places that differ by no more than the letters left over; pairs meet on
    the stretches and are aligned once for each that another one does not continue."""
    longest = rows.agg(F.max(F.length("umi"))).first()[0] or 0
    k = _shared_stretch(longest, threshold)
    if k < 1:
        return rows.sparkSession.createDataFrame([], "group_id string, a_pos long, b_pos long, score int")
    apart = longest - threshold - 1
    places = F.sequence(F.lit(1), F.length("umi") - (k - 1))
    held = rows.filter(F.length("umi") >= k).select("group_id", F.col("input_pos").alias("pos"), "umi", F.explode(places).alias("at"))
    held = held.withColumn("letters", F.substring(F.col("umi"), F.col("at"), F.lit(k)))
    b = held.select("group_id", "letters", F.col("at").alias("b_at"), F.col("pos").alias("b_pos"), F.col("umi").alias("b_umi"))
    a = held.withColumn("b_at", F.explode(F.sequence(F.col("at") - apart, F.col("at") + apart))).filter("b_at >= 1").select("group_id", "letters", "b_at", F.col("at").alias("a_at"), F.col("pos").alias("a_pos"), F.col("umi").alias("a_umi"))
    met = a.join(b, ["group_id", "letters", "b_at"]).filter("a_pos > b_pos")
    before = lambda umi, at: F.substring(F.col(umi), F.col(at) - 1, F.lit(1))
    first = (F.col("a_at") == 1) | (F.col("b_at") == 1) | (before("a_umi", "a_at") != before("b_umi", "b_at"))
    scored = with_local(met.filter(first).select("group_id", "a_pos", "b_pos", "a_umi", "b_umi"), "a_umi", "b_umi")
    return scored.filter(F.col("score") > threshold).groupBy("group_id", "a_pos", "b_pos").agg(F.max("score").alias("score"))


def _sized(members: DataFrame) -> DataFrame:
    return members.groupBy("group_id", "cluster").agg(F.count(F.lit(1)).alias("size"))


def _in_order(rows: DataFrame, name: str, by: str = "input_pos") -> DataFrame:
    return numbered(rows, name, ["group_id"], [(F.floor(F.col(by) / BLOCK), False)], [by]).withColumn(name, F.col(name) - 1)


def _stops(sizes: DataFrame, stop_below: float, window: int) -> DataFrame:
    """(group_id, stop): the number of clusters after which the mean size of the last `window` has fallen to stop_below.

    Clusters are averaged in blocks of their numbers; a block's last ones are seen by the next block too."""
    block = F.floor(F.col("cluster") / BLOCK)
    each = sizes.withColumn("ff_own", block).withColumn("ff_block", F.explode(F.array_distinct(F.array(block, F.floor((F.col("cluster") + window - 1) / BLOCK)))))
    over = W.partitionBy("group_id", "ff_block").orderBy("cluster").rowsBetween(1 - window, 0)
    low = each.withColumn("ff_mean", F.avg("size").over(over)).filter((F.col("ff_block") == F.col("ff_own")) & (F.col("cluster") >= window - 1) & (F.col("ff_mean") <= stop_below))
    return low.groupBy("group_id").agg((F.min("cluster") + 1).alias("stop"))


def threshold_clusters(barcodes: DataFrame, threshold: int, stop_below: float = 0.0, window: int = 20) -> DataFrame:
    """barcodes: group_id, input_pos (unique within a group), umi. (group_id, input_pos, umi, cluster, size): in order of input_pos, the
    first barcode left takes all left that align with a score above the threshold.

    First barcodes are those without an earlier first barcode that would take them; each other one goes to the earliest that does. It
    stops early once the mean size of the last `window` clusters falls to stop_below; the rest stay alone, numbered in order. Equal
    barcodes are rows each; a barcode no longer than the threshold stays alone; no rows give no rows."""
    rows = materialise(barcodes.select("group_id", F.col("input_pos").cast("long").alias("input_pos"), "umi"))
    edges = materialise(local_pairs(rows, threshold))
    firsts = materialise(_in_order(elect(rows, edges).select("group_id", "input_pos"), "cluster"))
    as_b = firsts.select("group_id", F.col("input_pos").alias("b_pos"), "cluster")
    taken = edges.join(as_b, ["group_id", "b_pos"]).groupBy("group_id", F.col("a_pos").alias("input_pos")).agg(F.min("cluster").alias("of"))
    marked = rows.join(firsts, ["group_id", "input_pos"], "left").join(taken, ["group_id", "input_pos"], "left")
    members = marked.select("group_id", "input_pos", "umi", F.coalesce("cluster", "of").alias("cluster"))
    sizes = _sized(members)
    if not stop_below:
        return members.join(sizes, ["group_id", "cluster"]).select("group_id", "input_pos", "umi", "cluster", "size")
    members, sizes = materialise(members), materialise(sizes)
    held = members.join(_stops(sizes, stop_below, window), "group_id", "left")
    formed = held.filter("stop is null or cluster < stop").drop("stop").join(sizes, ["group_id", "cluster"])
    alone = _in_order(held.filter("cluster >= stop"), "ff_k").withColumns({"cluster": F.col("stop") + F.col("ff_k"), "size": F.lit(1).cast("long")})
    columns = ["group_id", "input_pos", "umi", "cluster", "size"]
    return formed.select(*columns).unionByName(alone.select(*columns))


HEAD = 256


def _first_clusters(rows: DataFrame, thresholds: list[int], samples: int) -> DataFrame:
    """(threshold, group_id, cluster, input_pos, umi): the members of the first `samples` clusters of each group and threshold.

    Rounds: the first HEAD rows left of each group are scored among themselves, a bounded number of pairs whose scores serve
    all thresholds, and give the next first barcodes; these are then scored once against the rows left."""
    left = materialise(rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))))
    found, have = None, None
    while True:
        head = _numbered_by_threshold(left).filter(F.col("ff_k") < HEAD)
        if have is not None:
            head = head.join(have, ["threshold", "group_id"], "left").filter(F.coalesce("n", F.lit(0)) < samples).drop("n")
        head = materialise(head)
        if head.isEmpty():
            break
        some = head.select("group_id", "input_pos", "umi").distinct()
        b = some.select("group_id", F.col("input_pos").alias("b_pos"), F.col("umi").alias("b_umi"))
        pairs = some.withColumnRenamed("input_pos", "a_pos").withColumnRenamed("umi", "a_umi").join(b, "group_id").filter("a_pos > b_pos")
        scored = materialise(with_local(pairs, "a_umi", "b_umi").select("group_id", "a_pos", "b_pos", "score"))
        keyed = head.withColumn("key", F.concat_ws("\x1f", F.col("threshold").cast("string"), "group_id"))
        a_side = keyed.select("threshold", "group_id", "key", F.col("input_pos").alias("a_pos"))
        b_side = keyed.select("threshold", "group_id", F.col("input_pos").alias("b_pos"))
        edges = scored.join(a_side, ["group_id", "a_pos"]).join(b_side, ["threshold", "group_id", "b_pos"]).filter("score > threshold").select(F.col("key").alias("group_id"), "a_pos", "b_pos")
        chosen = elect(keyed.select(F.col("key").alias("group_id"), "input_pos"), materialise(edges)).select(F.col("group_id").alias("key"), "input_pos")
        new = keyed.join(chosen, ["key", "input_pos"], "left_semi").select("threshold", "group_id", "input_pos", "umi")
        before = new if have is None else new.join(have, ["threshold", "group_id"], "left")
        start = F.lit(0) if have is None else F.coalesce("n", F.lit(0))
        rank = F.row_number().over(W.partitionBy("threshold", "group_id").orderBy("input_pos")) - 1  # HEAD rows at most
        new = materialise(before.withColumn("cluster", (start + rank).cast("long")).filter(F.col("cluster") < samples).select("threshold", "group_id", "cluster", F.col("input_pos").alias("b_pos"), F.col("umi").alias("b_umi")))
        firsts = new.groupBy("group_id", "b_pos").agg(F.first("b_umi").alias("b_umi"), F.collect_list(F.struct("threshold", "cluster")).alias("of"))
        met = with_local(left.select("group_id", "input_pos", "umi").distinct().join(firsts, "group_id"), "umi", "b_umi")
        hits = met.select("group_id", "input_pos", "umi", "b_pos", "score", F.inline("of")).filter((F.col("score") > F.col("threshold")) | (F.col("input_pos") == F.col("b_pos"))).filter("input_pos >= b_pos")
        hits = hits.join(left.select("threshold", "group_id", "input_pos"), ["threshold", "group_id", "input_pos"], "left_semi")
        got = materialise(hits.groupBy("threshold", "group_id", "input_pos").agg(F.min("cluster").alias("cluster"), F.first("umi").alias("umi")))
        found = got if found is None else found.unionByName(got)
        ends = new.groupBy("threshold", "group_id").agg((F.max("cluster") + 1).alias("n"))
        have = materialise(ends if have is None else have.unionByName(ends).groupBy("threshold", "group_id").agg(F.max("n").alias("n")))
        after = materialise(left.join(got, ["threshold", "group_id", "input_pos"], "left_anti"))
        forget(left, head, scored, new)
        left = after
    return found if found is not None else left.withColumn("cluster", F.lit(0).cast("long"))


def _numbered_by_threshold(rows: DataFrame) -> DataFrame:
    return numbered(rows, "ff_k", ["threshold", "group_id"], [(F.floor(F.col("input_pos") / BLOCK), False)], ["input_pos"]).withColumn("ff_k", F.col("ff_k") - 1)


def threshold_scan(barcodes: DataFrame, thresholds: list[int], samples: int = 25, most: int = 200) -> DataFrame:
    """(threshold, mean_similarity, median_size, gain) over the first `samples` clusters of each group and threshold.

    barcodes: group_id, input_pos (unique within a group), umi. A cluster's similarity is the mean local score of the pairs among
    its first `most` members, 0 for a single one; both are part of the scan's definition. gain is the similarity's over the
    threshold before. Equal barcodes are members each."""
    rows = materialise(barcodes.select("group_id", F.col("input_pos").cast("long").alias("input_pos"), "umi"))
    members = materialise(_first_clusters(rows, sorted(set(thresholds)), samples))
    sizes = members.groupBy("threshold", "group_id", "cluster").agg(F.count(F.lit(1)).alias("size"))
    key = ["threshold", "group_id", "cluster"]
    placed = numbered(members, "place", key, [(F.floor(F.col("input_pos") / BLOCK), False)], ["input_pos"]).filter(F.col("place") <= most)
    a = placed.select(*key, F.col("input_pos").alias("a_pos"), F.col("umi").alias("a_umi"))
    pairs = a.join(placed.select(*key, F.col("input_pos").alias("b_pos"), F.col("umi").alias("b_umi")), key).filter("a_pos > b_pos")
    similar = with_local(pairs.select(*key, "a_umi", "b_umi"), "a_umi", "b_umi").groupBy(*key).agg(F.avg("score").alias("similarity"))
    per = sizes.join(similar, key, "left")
    out = per.groupBy("threshold").agg(F.avg(F.coalesce("similarity", F.lit(0.0))).alias("mean_similarity"), F.median("size").alias("median_size"))
    return out.withColumn("gain", F.col("mean_similarity") - F.lag("mean_similarity").over(W.partitionBy(F.lit(0)).orderBy("threshold")))  # a row a threshold


def elbow(scan: DataFrame, length: int, least: int = 15) -> DataFrame:
    """One row, threshold: the first from `least` whose successor, above half the length, gains less than 2 % of the length."""
    order = W.partitionBy(F.lit(0)).orderBy("threshold")
    flat = scan.withColumn("before", F.lag("threshold").over(order)).filter((F.col("gain") < length * 0.02) & (F.col("threshold") > length // 2) & (F.col("before") >= least))
    return flat.agg(F.min("before").alias("threshold"))


def extract_by_probe(reads: DataFrame, probe: str, length: int, min_score: int, side: str = "down") -> DataFrame:
    """(read_id, umi, score): the bases next to the probe's best alignment, on either strand; none if out of bounds. A row a read,
    which stays where it is: both strands are aligned in one pass, without a shuffle.

    A read whose score reaches min_score shares an unbroken stretch with the probe: reads (or their reverse complements) without
    any of the probe's stretches of that length are passed over before anything is aligned. The forward strand wins ties."""
    k = _shared_stretch(len(probe), min_score - 1)
    if k < 1:
        raise ValueError("the score cannot exceed the probe's length")
    grams = sorted({probe[i:i + k] for i in range(len(probe) - k + 1)})
    shares = lambda s: reduce(lambda x, y: x | y, (F.col(s).contains(g) for g in grams))
    each = reads.select("read_id", F.col("seq").alias("s0"), reverse_complement(F.col("seq")).alias("s1")).filter(shares("s0") | shares("s1"))
    scored = with_probe(each, probe, "s0", "s1").filter(F.col("score") >= min_score)
    at = F.col("end") if side == "down" else F.col("start") - length
    best = scored.select("read_id", at.alias("at"), F.when(F.col("strand") == 0, F.col("s0")).otherwise(F.col("s1")).alias("s"), "score")
    fits = best.filter((F.col("at") >= 0) & (F.col("at") + length <= F.length("s")))
    return fits.select("read_id", F.substring(F.col("s"), F.col("at") + 1, F.lit(length)).alias("umi"), "score")


def write_clusters(reads: DataFrame, path: str, least: int = 1) -> None:
    """One folder of FASTA records a cluster of at least that size."""
    reads.filter(F.col("size") >= least).select("cluster", F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.partitionBy("cluster").text(path)
