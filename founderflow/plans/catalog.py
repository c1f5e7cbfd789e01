"""All queries of the barcode engine, by name, with their SQL oracles.

The star-schema tables hold no barcodes, so they are derived from lineitem: a parent a part, one edit in some rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from founderflow.functions import numbering
from founderflow.functions import sequences as S
from founderflow.operators import alignment, clustering, compare, estimate, quality, reads, simulate
from founderflow.operators.similarity import similar_pairs
from founderflow.plans import pipeline
from founderflow.plans.storage import materialise, shared_dir
from founderflow.sources import tables
from founderflow.streaming import incremental

D = 2

READS_SQL = """
base as (select l_orderkey, l_linenumber, l_partkey, l_returnflag as group_id,
    translate(substr(md5(cast(l_partkey % 100 as string)), 1, 18), '0123456789abcdef', 'ACGTACGTACGTACGT') as parent,
    cast((l_orderkey * 7 + l_linenumber * 3) % 18 + 1 as int) as p, cast((l_orderkey + l_linenumber) % 12 as int) as m,
    substr('ACGT', cast((l_orderkey + l_suppkey) % 4 + 1 as int), 1) as base from lineitem),
reads as (select l_orderkey, l_linenumber, group_id, parent, p, m, base,
    case when m = 0 then concat(substr(parent, 1, p - 1), base, substr(parent, p + 1))
         when m = 1 then concat(substr(parent, 1, p - 1), substr(parent, p + 1))
         when m = 2 then concat(substr(parent, 1, p), base, substr(parent, p + 1)) else parent end as umi from base)"""
COUNTS_SQL = READS_SQL + """,
counts as (select group_id, umi, count(*) as n_reads from reads group by group_id, umi),
rows_ as (select group_id, umi, n_reads, row_number() over (partition by group_id order by n_reads desc, umi) as input_pos from counts)"""


def reads_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql("with " + READS_SQL.replace("from lineitem", "from {lineitem}") + " select * from reads", lineitem=lineitem)


def counts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = reads_view(spark, sf_dir).groupBy("group_id", "umi").agg(F.count(F.lit(1)).alias("n_reads"))
    return clustering.with_positions(counts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


KMERS = "list_distinct(list_filter(list_transform(range(1, greatest(length({0}) - 4, 1)), lambda i: upper(substr({0}, i, 6))), lambda x: regexp_full_match(x, '[ACGT]{{6}}')))"
EDGES_SQL = COUNTS_SQL + f""",
grams as (select group_id, input_pos, umi, unnest({KMERS.format('umi')}) as g from rows_),
edges as (select distinct a.group_id, a.input_pos as a_pos, b.input_pos as b_pos, levenshtein(a.umi, b.umi) as dist
    from grams a join grams b on a.group_id = b.group_id and a.g = b.g and a.input_pos > b.input_pos
    where abs(length(a.umi) - length(b.umi)) <= {D} and levenshtein(a.umi, b.umi) <= {D})"""
CLUSTER_SQL = """,
near as (select group_id, a_pos, list(b_pos) as nbs from high group by group_id, a_pos),
walk as (select group_id, 0::bigint as pos, []::bigint[] as founders from (select distinct group_id from rows_)
    union all select w.group_id, w.pos + 1, case when n.nbs is null or not list_has_any(n.nbs, w.founders) then list_append(w.founders, w.pos + 1) else w.founders end
    from walk w left join near n on n.group_id = w.group_id and n.a_pos = w.pos + 1
    where w.pos < (select max(input_pos) from rows_ r where r.group_id = w.group_id and r.n_reads >= {min_reads})),
founders as (select group_id, unnest(founders) as pos from (select group_id, arg_max(founders, pos) as founders from walk group by group_id)),
best as (select e.group_id, e.a_pos, min(e.dist * 10000000 + e.b_pos) as x from usable e join founders f on f.group_id = e.group_id and f.pos = e.b_pos group by e.group_id, e.a_pos),
clustered as (select r.group_id, r.input_pos, r.umi, r.n_reads, f.pos is not null as is_founder,
    case when f.pos is not null or b.x is null then r.input_pos else b.x % 10000000 end as founder_pos,
    case when f.pos is not null or b.x is null then 0 else b.x // 10000000 end as dist
    from rows_ r left join founders f on f.group_id = r.group_id and f.pos = r.input_pos left join best b on b.group_id = r.group_id and b.a_pos = r.input_pos),
named as (select c.*, r.umi as founder from clustered c join rows_ r on r.group_id = c.group_id and r.input_pos = c.founder_pos)"""
HIGH_SQL = "with recursive " + EDGES_SQL + ", high as (select * from edges), usable as (select * from edges)" + CLUSTER_SQL.format(min_reads=1)
CUT = 3
LOW_SQL = "with recursive " + EDGES_SQL + f""",
high as (select e.* from edges e join rows_ a on a.group_id = e.group_id and a.input_pos = e.a_pos where a.n_reads >= {CUT}),
usable as (select * from edges)""" + CLUSTER_SQL.format(min_reads=CUT)


@query("with " + COUNTS_SQL + " select group_id, umi, n_reads::bigint as n_reads, input_pos::bigint as input_pos from rows_")
def umi_read_counts(spark, sf_dir):
    return counts_view(spark, sf_dir)


@query("with " + COUNTS_SQL + " select group_id, substr(umi, 1, 12) as umi12, n_reads::bigint as n_reads, n_reads < 3 as is_low from rows_ where n_reads > 0")
def umi_truncate_split(spark, sf_dir):
    c = tables.read_weights(counts_view(spark, sf_dir))
    return c.select("group_id", S.truncated(F.col("umi"), 12).alias("umi12"), "n_reads", (F.col("n_reads") < 3).alias("is_low"))


@query("with " + COUNTS_SQL + f" select group_id, input_pos::bigint as input_pos, unnest({KMERS.format('umi')}) as kmer from rows_")
def umi_kmer_explode(spark, sf_dir):
    return counts_view(spark, sf_dir).select("group_id", "input_pos", F.explode(S.kmers(F.col("umi"))).alias("kmer"))


@query("with " + EDGES_SQL + " select group_id, a_pos::bigint as a_pos, b_pos::bigint as b_pos, dist::int as dist from edges")
def umi_similarity_pairs(spark, sf_dir):
    rows = materialise(counts_view(spark, sf_dir))
    return similar_pairs(rows, rows, D).select("group_id", F.col("a_pos").cast("long").alias("a_pos"), F.col("b_pos").cast("long").alias("b_pos"), "dist")


@query("with " + READS_SQL + """, e as (select group_id, count(*) filter (m <= 2)::double / (count(*) * 18) as err from reads group by group_id),
g as (select distinct group_id, length(umi)::int as len from reads), z as (select g.*, err, len * err + (case when len <= 15 then 1.96 when len <= 25 then 2.576 when len <= 35 then 3.29 else 3.89 end)::double * sqrt(err * (1 - err) * len) as x from g join e using (group_id))
select group_id, len, (1 + case when len <= 15 then floor(x) else floor(x + 0.5) end)::int as bound from z""")
def umi_dist_bound(spark, sf_dir):
    """The distance bound of each length of barcodes, under the edits a base of a group's reads."""
    r = reads_view(spark, sf_dir)
    rate = r.groupBy("group_id").agg((F.sum(F.when(F.col("m") <= 2, 1).otherwise(0)).cast("double") / (F.count(F.lit(1)) * 18)).alias("err"))
    lengths = r.select("group_id", F.length("umi").alias("len")).distinct().join(rate, "group_id")
    return lengths.select("group_id", "len", S.distance_bound_column(F.col("len"), F.col("err")).alias("bound"))


@query(HIGH_SQL + " select group_id, umi, founder, dist::int as dist, is_founder from named")
def umi_clusters(spark, sf_dir):
    return clustering.cluster(materialise(counts_view(spark, sf_dir)), D).select("group_id", "umi", "founder", "dist", "is_founder")


@query(LOW_SQL.replace("from usable e join founders", "from (select group_id, a_pos, b_pos, dist from edges union all select e.group_id, e.b_pos, e.a_pos, e.dist from edges e join rows_ l on l.group_id = e.group_id and l.input_pos = e.b_pos where l.n_reads < 3) e join founders") + " select group_id, umi, founder, dist::int as dist, is_founder from named")
def umi_lowread_assign(spark, sf_dir):
    return clustering.cluster(materialise(counts_view(spark, sf_dir)), D, min_reads=CUT).select("group_id", "umi", "founder", "dist", "is_founder")


@query(HIGH_SQL + ", sums as (select group_id, founder_pos, sum(n_reads) as s from named group by group_id, founder_pos) select n.group_id, n.umi, coalesce(s.s, 0)::bigint as n_reads from named n left join sums s on s.group_id = n.group_id and s.founder_pos = n.input_pos")
def umi_founder_counts(spark, sf_dir):
    return clustering.founder_counts(clustering.cluster(materialise(counts_view(spark, sf_dir)), D))


ORDERED_SQL = """,
d as (select n_reads::bigint as n, row_number() over (order by n_reads desc) - 1 as i, count(*) over () as size, sum(n_reads) over () as total,
    sum(n_reads) over (order by n_reads desc rows unbounded preceding) as cum from {table} where n_reads > 0)"""
MEDIAN_SQL = "(select case when max(total) % 2 = 1 then max(n) filter (cum - n <= total // 2 and total // 2 < cum) else (max(n) filter (cum - n <= total // 2 and total // 2 < cum) + max(n) filter (cum - n <= total // 2 - 1 and total // 2 - 1 < cum)) // 2 end from d)"
KNEE_SQL = ORDERED_SQL + f""",
xy as (select *, (i::double / size) as x, (cum::double / total) as y from d where i < size - 2),
angles as (select *, floor(acos(greatest(-1.0, least(1.0, (x * x + y * y + (x - 1) * (x - 1) + (y - 1) * (y - 1) - 2) / (2 * sqrt(x * x + y * y) * sqrt((x - 1) * (x - 1) + (y - 1) * (y - 1)))))) * 180 / 3.1415926535 + 0.5)::int as angle from xy),
low as (select min(angle) as low from angles),
pick as (select low + 1 as knee_angle, coalesce((select max(i) from angles where angle = low + 1), (select max(i) from angles where angle = low)) as idx from low),
val as (select p.*, d.n, d.size, (select min(i) from d e where e.n = d.n) as first, (select max(i) from d e where e.n = d.n) as last, (select min(n) from d e where e.n > d.n) as larger,
    (select count(*) from d e where e.n = (select min(n) from d)) as tail from pick p join d on d.i = p.idx),
cut as (select *, case when n = 1 and idx < (first + last) // 2 and larger is not null then larger else n end as rpu_cutoff from val),
knee as (select 'KP' as model, knee_angle::int as knee_angle, {MEDIAN_SQL}::bigint as median_rpu, rpu_cutoff::bigint as rpu_cutoff,
    (case when idx = size - 2 and tail > 1 then size else idx + 1 end)::bigint as estimated_molecules, (select count(*) from d where d.n >= rpu_cutoff)::bigint as after_rpu_cutoff_molecules from cut)"""
NB_SQL = f""",
mom as (select avg(n)::double as mean, var_samp(n) as var, min(n) as low from d),
rp as (select *, mean / var as p, mean * mean / (var - mean) as r from mom),
cdf as (select k, sum(exp(lgamma(k + r) - lgamma(r) - lgamma(k + 1) + r * ln(p) + k * ln(1 - p))) over (order by k) as c from rp, (select unnest(range(0, 5000)) as k) where var > mean),
nbcut as (select case when var > mean then greatest(1, coalesce((select max(k) from cdf where c <= 0.0005), 0)) else low end as rpu_cutoff from rp),
nb as (select 'NB' as model, null::int as knee_angle, {MEDIAN_SQL}::bigint as median_rpu, rpu_cutoff::bigint as rpu_cutoff, (select count(*) from d where d.n >= rpu_cutoff)::bigint as estimated_molecules,
    (select count(*) from d where d.n >= rpu_cutoff)::bigint as after_rpu_cutoff_molecules from nbcut)"""


@query("with " + COUNTS_SQL + KNEE_SQL.replace("{table}", "rows_") + " select * from knee")
def umi_knee(spark, sf_dir):
    return estimate.knee(materialise(counts_view(spark, sf_dir)))


@query("with " + COUNTS_SQL + ORDERED_SQL.replace("{table}", "rows_") + f" select count(*)::bigint as n_umis, round(avg(n), 6)::double as mean_rpu, round(var_samp(n), 6)::double as var_rpu, round(mad(n), 6)::double as mad, {MEDIAN_SQL}::bigint as median_rpu from d")
def umi_moments_weighted_median(spark, sf_dir):
    c = materialise(counts_view(spark, sf_dir))
    m = estimate.moments(c).crossJoin(F.broadcast(estimate.weighted_median(estimate.histogram(c))))
    return m.select("n_umis", F.round("mean_rpu", 6).alias("mean_rpu"), F.round("var_rpu", 6).alias("var_rpu"), F.round("mad", 6).alias("mad"), "median_rpu")


COUNTED_SQL = HIGH_SQL + ", counted as (select sum(n_reads) as n_reads from named group by group_id, founder_pos)"


@query(COUNTED_SQL + ORDERED_SQL.replace("{table}", "counted") + NB_SQL + " select model, median_rpu, rpu_cutoff, estimated_molecules, after_rpu_cutoff_molecules from nb")
def umi_nb_estimate(spark, sf_dir):
    counted = materialise(clustering.founder_counts(clustering.cluster(materialise(counts_view(spark, sf_dir)), D)))
    return estimate.negative_binomial(counted).drop("knee_angle")


@query(COUNTED_SQL + KNEE_SQL.replace("{table}", "counted") + NB_SQL + " select model, coalesce(knee_angle, -1) as knee_angle, median_rpu, rpu_cutoff, estimated_molecules, after_rpu_cutoff_molecules from (select * from knee where knee_angle <= 120 union all select * from nb where not exists (select 1 from knee where knee_angle <= 120))")
def umi_auto_estimate(spark, sf_dir):
    counted = materialise(clustering.founder_counts(clustering.cluster(materialise(counts_view(spark, sf_dir)), D)))
    return estimate.auto(counted).withColumn("knee_angle", F.coalesce("knee_angle", F.lit(-1)))


@query(HIGH_SQL + """, labels as (select r.group_id || r.parent as c, n.group_id || n.founder as k, count(*)::double as n from reads r join named n on n.group_id = r.group_id and n.umi = r.umi group by 1, 2),
m as (select *, sum(n) over (partition by c) as nc, sum(n) over (partition by k) as nk, sum(n) over () as t from labels),
h as (select sum(-n / t * ln(nc / t)) as hc, sum(-n / t * ln(nk / t)) as hk, sum(-n / t * ln(n / nk)) as hck, sum(-n / t * ln(n / nc)) as hkc from m),
s as (select 1 - hck / hc as h, 1 - hkc / hk as c from h) select round(h, 6) as homogeneity, round(c, 6) as completeness, round(2 * h * c / (h + c), 6) as v_measure from s""")
def umi_vmeasure(spark, sf_dir):
    c = clustering.cluster(materialise(counts_view(spark, sf_dir)), D).select("group_id", "umi", "founder")
    both = reads_view(spark, sf_dir).join(c, ["group_id", "umi"]).select(F.concat("group_id", "parent").alias("truth"), F.concat("group_id", "founder").alias("predicted"))
    got = quality.scores(both)
    return got.select(*[F.round(x, 6).alias(x) for x in got.columns])


FASTQ_SQL = ", fq as (select l_orderkey * 10 + l_linenumber as read_id, 'r' || l_orderkey || '_' || l_linenumber as name, umi || 'GATTACA' as seq, group_id, umi from reads)"


@query("with " + READS_SQL + FASTQ_SQL + " select read_id::bigint as read_id, substr(seq, 1, 12) as umi, name || '_' || substr(seq, 1, 12) as name1, substr(seq, 13) as seq1, repeat('F', length(substr(seq, 13))) as qual1 from fq")
def umi_tag_reads(spark, sf_dir):
    return reads.extract(_fastq(spark, sf_dir), None, (1, 12))


def _fastq(spark, sf_dir):
    r = reads_view(spark, sf_dir)
    seq = F.concat("umi", F.lit("GATTACA"))
    return r.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read_id"), F.concat(F.lit("r"), "l_orderkey", F.lit("_"), "l_linenumber").alias("name"), seq.alias("seq"), F.repeat(F.lit("F"), F.length(seq)).alias("qual"), "group_id", "umi")


@query(HIGH_SQL + FASTQ_SQL + " select f.group_id, f.umi, n.founder, f.name || '_' || n.founder as name, f.seq from fq f join named n on n.group_id = f.group_id and n.umi = f.umi")
def umi_regroup_reads(spark, sf_dir):
    c = clustering.cluster(materialise(counts_view(spark, sf_dir)), D)
    fq = _fastq(spark, sf_dir).withColumn("name", S.tagged(F.col("name"), F.col("umi"))).drop("umi")
    return reads.regroup(fq, c, by_group=True).drop("qual")


NEAR_SQL = COUNTS_SQL + """,
g as (select group_id, count(*) as size, arg_min(length(umi), input_pos) as len from rows_ group by group_id),
sl as (select r.group_id, r.umi, r.n_reads, s.i, case when g.size <= 25 then '' when s.i = 0 then substr(umi, 1, (len // 2 + len % 2)::int) else substr(umi, (len // 2 + len % 2 + 1)::int, (len // 2)::int) end as s from rows_ r join g using (group_id), (select 0 as i union all select 1) s),
near as (select distinct a.group_id, a.umi as ua, b.umi as ub, a.n_reads as na, b.n_reads as nb from sl a join sl b on a.group_id = b.group_id and a.i = b.i and a.s = b.s and a.umi < b.umi where levenshtein(a.umi, b.umi) <= 1)"""
ADJ_SQL = NEAR_SQL + ", adj as (select group_id, ua as src, ub as dst from near union all select group_id, ub, ua from near)"
DIR_SQL = NEAR_SQL + ", adj as (select group_id, ua as src, ub as dst from near where na >= 2 * nb - 1 union all select group_id, ub, ua from near where nb >= 2 * na - 1)"
REACH_SQL = """, reach as (select group_id, umi, input_pos as lead from rows_ union select r.group_id, a.dst, r.lead from reach r join adj a on a.group_id = r.group_id and a.src = r.umi)
select r.group_id, x.umi, x.n_reads::bigint as n_reads, min(r.lead)::bigint as lead from reach r join rows_ x on x.group_id = r.group_id and x.umi = r.umi group by all"""


@query("with " + ADJ_SQL + " select * from adj")
def umi_adjacency_edges(spark, sf_dir):
    return compare.adjacency_edges(materialise(counts_view(spark, sf_dir).drop("input_pos")))


@query("with " + DIR_SQL + " select * from adj")
def umi_directional_edges(spark, sf_dir):
    return compare.directional_edges(materialise(counts_view(spark, sf_dir).drop("input_pos")))


def _grouped(method):
    def f(spark, sf_dir):
        got = compare.groups(materialise(counts_view(spark, sf_dir).drop("input_pos")), method)
        return got.select("group_id", "umi", "n_reads", F.col("lead").cast("long").alias("lead"))

    f.__name__ = f"umi_groups_{method}"
    return f


query("with recursive " + ADJ_SQL + REACH_SQL)(_grouped("cluster"))
query("with recursive " + DIR_SQL + REACH_SQL)(_grouped("directional"))
query("with " + COUNTS_SQL + ", c as (select group_id, median(n_reads) / 100 as cut from rows_ group by group_id) select r.group_id, umi, n_reads::bigint as n_reads, input_pos::bigint as lead from rows_ r join c using (group_id) where n_reads > cut")(_grouped("percentile"))
query("with " + COUNTS_SQL + " select group_id, umi, n_reads::bigint as n_reads, input_pos::bigint as lead from rows_")(_grouped("unique"))
query("with recursive " + ADJ_SQL + REACH_SQL.replace("select r.group_id, x.umi, x.n_reads::bigint as n_reads", ", parts as (select r.group_id, x.umi, x.n_reads, x.input_pos as rank") + """),
cov as (select p.group_id, p.umi, p.n_reads, p.rank, p.lead, least(p.rank, coalesce(min(q.rank), p.rank)) as covered from parts p left join adj a on a.group_id = p.group_id and a.src = p.umi
    left join parts q on q.group_id = a.group_id and q.umi = a.dst group by p.group_id, p.umi, p.n_reads, p.rank, p.lead),
done as (select *, max(covered) over (partition by group_id, lead) as last from cov)
select group_id, umi, n_reads::bigint as n_reads, (case when rank <= last then rank else covered end)::bigint as lead from done""")(_grouped("adjacency"))


@query(("with recursive " + DIR_SQL + REACH_SQL).replace("select r.group_id, x.umi", ", t as (select r.group_id, x.umi") + ") select t.group_id, r.umi, sum(t.n_reads)::bigint as n_reads from t join rows_ r on r.group_id = t.group_id and r.input_pos = t.lead group by t.group_id, r.umi, t.lead")
def umi_representatives(spark, sf_dir):
    return compare.representatives(compare.groups(materialise(counts_view(spark, sf_dir).drop("input_pos"))))


FACTS_SQL = "facts as (select l_shipmode_ as tool, (l_linenumber * 6)::int as umi_len, (l_suppkey % 3)::int as num_founder, l_discount as v from (select *, 't' || (l_partkey % 4) as l_shipmode_ from lineitem))"


def _facts(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(F.concat(F.lit("t"), F.col("l_partkey") % 4).alias("tool"), (F.col("l_linenumber") * 6).cast("int").alias("umi_len"), (F.col("l_suppkey") % 3).cast("int").alias("num_founder"), F.col("l_discount").alias("V-measure"))


@query("with " + FACTS_SQL + " select tool, case when umi_len in (12, 18) then 'short' when umi_len in (25, 50) then 'long' else 'unknown' end as read_type, num_founder, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as std, count(v)::bigint as n from facts group by 1, 2, 3")
def umi_tool_summary(spark, sf_dir):
    return quality.summary(_facts(spark, sf_dir))


def _features(spark, sf_dir):
    r = reads_view(spark, sf_dir).groupBy(F.concat(F.lit("t"), (F.col("l_orderkey") % 4).cast("string")).alias("tools"), F.col("group_id").alias("platform"), (F.col("p") % 3).cast("string").alias("condition"), (F.col("m") % 2).alias("replicate"), F.substring("parent", 1, 4).alias("clonotype")).agg(F.count(F.lit(1)).alias("n"))
    return quality.features(r, "n")


FEATURES_SQL = READS_SQL + ", f as (select 't' || (l_orderkey % 4) as tools, concat_ws('_', group_id, (p % 3)::varchar, (m % 2)::varchar, substr(parent, 1, 4)) as feature, log10(count(*)) as value from reads group by 1, 2)"


@query("with " + FEATURES_SQL + " select a.tools as tool_a, b.tools as tool_b, round(corr(a.value, b.value), 6) as r from f a join f b using (feature) group by 1, 2")
def umi_tool_corr(spark, sf_dir):
    return quality.correlations(_features(spark, sf_dir)).withColumn("r", F.round("r", 6))


@query("with " + FEATURES_SQL + " select feature, " + ", ".join(f"round(max(value) filter (tools = 't{i}'), 6) as t{i}" for i in range(4)) + " from f group by feature")
def umi_pivot(spark, sf_dir):
    got = quality.pivoted(_features(spark, sf_dir), ["t0", "t1", "t2", "t3"])
    return got.select("feature", *[F.round(f"t{i}", 6).alias(f"t{i}") for i in range(4)])


ERR_SQL = ", e as (select case m when 0 then p || ':A/' || base when 1 then p || ':A/' when 2 then p || ':A/A' || base else '' end as err, m, parent from reads)"


def _errors(spark, sf_dir):
    r = reads_view(spark, sf_dir)
    p = F.col("p").cast("string")
    return r.select(F.when(F.col("m") == 0, F.concat(p, F.lit(":A/"), "base")).when(F.col("m") == 1, F.concat(p, F.lit(":A/"))).when(F.col("m") == 2, F.concat(p, F.lit(":A/A"), "base")).otherwise("").alias("err"), F.col("parent").alias("label"))


@query("with " + READS_SQL + """, k as (select count(*) filter (m = 0) as s, count(*) filter (m = 1) as d, count(*) filter (m = 2) as i from reads)
select (s + d + i)::bigint as edited, s::bigint as substitution_only, (d + i)::bigint as with_indel, i::bigint as ins, d::bigint as del, s::bigint as sub,
    printf('%.3f-%.3f-%.3f', i / least(i, d, s), d / least(i, d, s), s / least(i, d, s)) as ratio from k""")
def umi_edit_totals(spark, sf_dir):
    got = quality.edit_totals(_errors(spark, sf_dir))
    return got.select(*[F.col(c).cast("long").alias(c) for c in got.columns if c != "ratio"], "ratio")


@query("with " + READS_SQL + ", c as (select parent, count(*) as n from reads group by parent) select avg(n)::double as mean_children, floor(var_samp(n))::bigint as variance_children from c")
def umi_children(spark, sf_dir):
    return quality.children(_errors(spark, sf_dir))


@query("with " + COUNTS_SQL + " select count(distinct umi)::bigint as n_unique, count(*) filter (n_reads > 0)::bigint as n_with_reads, max(length(umi))::int as longest from rows_")
def umi_unique(spark, sf_dir):
    return quality.unique_barcodes(counts_view(spark, sf_dir))


@query(HIGH_SQL + " select group_id, umi, founder, (dense_rank() over (order by group_id, founder) - 1)::int as label from named")
def umi_dense_labels(spark, sf_dir):
    c = clustering.cluster(materialise(counts_view(spark, sf_dir)), D).select("group_id", "umi", "founder")
    return tables.dense_labels(c).select("group_id", "umi", "founder", "label")


@query("with " + COUNTS_SQL + " select group_id, umi, reverse(translate(umi, 'ACGT', 'TGCA')) as rc, 'NNN' || umi || 'NNN' as padded from rows_")
def umi_sequences(spark, sf_dir):
    u = F.col("umi")
    return counts_view(spark, sf_dir).select("group_id", "umi", S.reverse_complement(u).alias("rc"), S.padded(u).alias("padded"))


GREEDY_BEST = "coalesce(min(e.dist * 10000000 + e.b_pos) filter (e.b_pos <= ((e.a_pos - 1) // 500) * 500 + 50), min(e.dist * 10000000 + e.b_pos)) as x"


@query(HIGH_SQL.replace("min(e.dist * 10000000 + e.b_pos) as x", GREEDY_BEST) + " select group_id, input_pos::bigint as input_pos, umi, founder, founder_pos::bigint as founder_pos, dist::int as dist, is_founder from named")
def umi_greedy(spark, sf_dir):
    c = clustering.cluster(materialise(counts_view(spark, sf_dir)), D, greedy=(500, 50))
    return c.select("group_id", "input_pos", "umi", "founder", "founder_pos", "dist", "is_founder")


@query(HIGH_SQL + " select group_id, umi, founder, dist::int as dist, is_founder from named")
def umi_clusters_in_rounds(spark, sf_dir):
    """umi_clusters by rounds of DataFrame joins to the end, without a rest that is settled in order."""
    return clustering.cluster(materialise(counts_view(spark, sf_dir)), D, tail=0, head_rows=10).select("group_id", "umi", "founder", "dist", "is_founder")


@query(HIGH_SQL + " select group_id, count(distinct founder)::bigint as clusters from named group by group_id")
def umi_cluster_count(spark, sf_dir):
    return quality.cluster_count(clustering.cluster(materialise(counts_view(spark, sf_dir)), D), ["group_id"])


@query(HIGH_SQL + ", l as (select umi, (dense_rank() over (order by group_id, founder) - 1)::int as label, n_reads from named) select umi, label from (select umi, label, unnest(range(n_reads)) as copy from l)")
def umi_read_labels(spark, sf_dir):
    c = clustering.cluster(materialise(counts_view(spark, sf_dir)), D)
    return quality.per_read(tables.dense_labels(c))


_FIRST = "cutoff as (with " + ORDERED_SQL.replace("{table}", "rows_").lstrip(",\n") + KNEE_SQL.replace(ORDERED_SQL, "") + NB_SQL + " select rpu_cutoff as c from (select rpu_cutoff from knee where knee_angle <= 120 union all select rpu_cutoff from nb where not exists (select 1 from knee where knee_angle <= 120)))"
END_SQL = (
    "with recursive " + EDGES_SQL + ", " + _FIRST
    + ", high as (select e.* from edges e join rows_ a on a.group_id = e.group_id and a.input_pos = e.a_pos where a.n_reads >= (select c from cutoff))"
    + ", usable as (select group_id, a_pos, b_pos, dist from edges union all select e.group_id, e.b_pos, e.a_pos, e.dist from edges e join rows_ l on l.group_id = e.group_id and l.input_pos = e.b_pos where l.n_reads < (select c from cutoff))"
    + CLUSTER_SQL.format(min_reads="(select c from cutoff)")
    + ", counted as (select sum(n_reads) as n_reads from named group by group_id, founder_pos)"
)


@query(END_SQL + ORDERED_SQL.replace("{table}", "counted") + KNEE_SQL.replace(ORDERED_SQL, "") + NB_SQL + " select (select c from cutoff)::bigint as founder_cutoff, model, coalesce(knee_angle, -1) as knee_angle, median_rpu, rpu_cutoff, estimated_molecules, after_rpu_cutoff_molecules from (select * from knee where knee_angle <= 120 union all select * from nb where not exists (select 1 from knee where knee_angle <= 120))")
def umi_whole_run(spark, sf_dir):
    """Estimate the cutoff on the input, cluster under it, recount, estimate again."""
    counts = materialise(counts_view(spark, sf_dir))
    cutoff = int(estimate.estimate(counts).first()["rpu_cutoff"])
    _, _, record = pipeline.correct(counts, 64, distance=D, min_reads=cutoff)
    return record.select(F.lit(cutoff).cast("long").alias("founder_cutoff"), *[F.coalesce("knee_angle", F.lit(-1)).alias("knee_angle") if c == "knee_angle" else c for c in record.columns])


ONE_SQL = ", one as (select l_orderkey, l_linenumber, min(umi) as umi, min(group_id) as group_id from reads group by l_orderkey, l_linenumber)"
MATES_SQL = ONE_SQL + ", mates as (select l_orderkey * 10 + l_linenumber as read_id, 'r' || l_orderkey as name, umi || 'GATTACA' as s1, reverse(translate(umi, 'ACGT', 'TGCA')) || 'CC' as s2 from one)"


def _one_a_line(spark, sf_dir):
    """A read for each order and line number, which come more than once."""
    return reads_view(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.min("umi").alias("umi"), F.min("group_id").alias("group_id"))


@query("with " + READS_SQL + MATES_SQL + """ select read_id::bigint as read_id, substr(s1, 3, 6) || substr(s2, 1, 4) as umi, name || '_' || substr(s1, 3, 6) || substr(s2, 1, 4) || ' 1:N' as name1, substr(s1, 9) as seq1, repeat('F', length(substr(s1, 9))) as qual1,
    name || '_' || substr(s1, 3, 6) || substr(s2, 1, 4) || ' 2:N' as name2, substr(s2, 5) as seq2, repeat('F', length(substr(s2, 5))) as qual2 from mates""")
def umi_tag_mates(spark, sf_dir):
    """Barcodes from parts of both mates, put behind the names of both."""
    r = _one_a_line(spark, sf_dir)
    key, name = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read_id"), F.concat(F.lit("r"), "l_orderkey")
    one = lambda seq, comment: r.select(key, F.concat(name, F.lit(comment)).alias("name"), seq.alias("seq"), F.repeat(F.lit("F"), F.length(seq)).alias("qual"))
    return reads.extract(one(F.concat("umi", F.lit("GATTACA")), " 1:N"), one(F.concat(S.reverse_complement(F.col("umi")), F.lit("CC")), " 2:N"), (3, 8), (1, 4))


@query(("with recursive " + DIR_SQL + REACH_SQL).replace("select r.group_id, x.umi", ", t as (select r.group_id, x.umi") + "), rep as (select t.group_id, r.umi, sum(t.n_reads) as n from t join rows_ r on r.group_id = t.group_id and r.input_pos = t.lead group by t.group_id, r.umi, t.lead), white as (select distinct parent from reads where l_orderkey % 2 = 0) select group_id, case when umi in (select parent from white) then umi else 'Non-whitelist UMI' end as umi, sum(n)::bigint as n_reads from rep group by 1, 2")
def umi_whitelisted(spark, sf_dir):
    white = reads_view(spark, sf_dir).filter("l_orderkey % 2 = 0").select(F.col("parent").alias("umi"))
    return compare.representatives(compare.groups(materialise(counts_view(spark, sf_dir).drop("input_pos"))), white)


@query("with " + READS_SQL + ONE_SQL + """, o as (select group_id, umi, row_number() over (order by l_orderkey, l_linenumber) as input_pos from one),
c as (select *, case when lag(group_id) over (order by input_pos) is not distinct from group_id then 0 else 1 end as changed from o)
select input_pos::bigint as input_pos, umi, group_id || chr(31) || sum(changed) over (order by input_pos rows unbounded preceding)::bigint as group_id from c""")
def umi_strict_runs(spark, sf_dir):
    rows = numbering.numbered(_one_a_line(spark, sf_dir).select("group_id", "umi", "l_orderkey", "l_linenumber"), "input_pos", [], [(F.floor(F.col("l_orderkey") / 1024), False)], ["l_orderkey", "l_linenumber"])
    return clustering.with_runs(rows.select("group_id", "umi", "input_pos")).select("input_pos", "umi", "group_id")


@query("with " + FACTS_SQL + " select tool, num_founder, round(avg(v), 9) as mean, round(stddev_samp(v), 9) as sd, round(3 * stddev_samp(v) / sqrt(count(v)), 9) as three_se from facts group by 1, 2")
def umi_error_bars(spark, sf_dir):
    got = quality.error_bars(_facts(spark, sf_dir), ["tool", "num_founder"], "V-measure")
    return got.select("tool", "num_founder", *[F.round(c, 9).alias(c) for c in ("mean", "sd", "three_se")])


@query()
def umi_simulate(spark, sf_dir):
    """Families of simulated reads of the barcodes from which the table's reads come."""
    parents = reads_view(spark, sf_dir).select(F.col("parent").alias("umi")).distinct()
    numbered = numbering.numbered(parents, "label", [], [(F.substring("umi", 1, 4), False)], ["umi"])
    return simulate.reads(numbered, 0.005, mean_children=20)


@query("with " + EDGES_SQL.replace(f"<= {D}", "<= 3") + " select group_id, a_pos::bigint as a_pos, b_pos::bigint as b_pos, dist::int as dist from edges")
def umi_similarity_pairs_d3(spark, sf_dir):
    """Pairs within three edits, where pieces have four letters and barcodes choose how they are cut."""
    rows = materialise(counts_view(spark, sf_dir))
    return similar_pairs(rows, rows, 3).select("group_id", F.col("a_pos").cast("long").alias("a_pos"), F.col("b_pos").cast("long").alias("b_pos"), "dist")


# A fifth of all orders give reads that end within the barcode.
SHORT_READS_SQL = READS_SQL.replace("reads as (select", "whole as (select") + ", reads as (select * replace (case when l_orderkey % 5 = 3 then substr(umi, 1, 13) else umi end as umi) from whole)"
OVERHANG_EDGES_SQL = EDGES_SQL.replace(READS_SQL, SHORT_READS_SQL).replace(", levenshtein(a.umi, b.umi) as dist", ", case when levenshtein(a.umi, b.umi) <= 3 then levenshtein(a.umi, b.umi) else 3 end as dist").replace(
    f"abs(length(a.umi) - length(b.umi)) <= {D} and levenshtein(a.umi, b.umi) <= {D}", "levenshtein(a.umi, b.umi) <= 3 or (length(b.umi) > length(a.umi) and (starts_with(b.umi, a.umi) or ends_with(b.umi, a.umi)))")


def _short_counts(spark, sf_dir):
    r = reads_view(spark, sf_dir).withColumn("umi", F.when(F.col("l_orderkey") % 5 == 3, F.substring("umi", 1, 13)).otherwise(F.col("umi")))
    return clustering.with_positions(r.groupBy("group_id", "umi").agg(F.count(F.lit(1)).alias("n_reads")))


@query("with recursive " + OVERHANG_EDGES_SQL + ", high as (select * from edges), usable as (select * from edges)" + CLUSTER_SQL.format(min_reads=1) + " select group_id, umi, founder, dist::int as dist, is_founder from named")
def umi_clusters_overhang(spark, sf_dir):
    """Three edits by the padded distance: barcodes that end early go to the founders that begin like them."""
    return clustering.cluster(materialise(_short_counts(spark, sf_dir)), 3, overhang=True).select("group_id", "umi", "founder", "dist", "is_founder")


@query("with recursive " + SHORT_READS_SQL + """, p as (select distinct umi, parent from reads),
walk as (select umi, parent, 'NNN' || umi || 'NNN' as a, 'NNN' || parent || 'NNN' as b, 0 as j, range(0, length(umi) + 7)::integer[] as d from p
    union all select umi, parent, a, b, j + 1, list_reduce(list_prepend([0::integer], list_transform(range(1, length(a) + 1), lambda i: [least(d[i] + case when substr(a, i, 1) = substr(b, j + 1, 1) then 0 else 1 end, d[i + 1] + 1)::integer])),
        lambda x, y: list_append(x, least(y[1], x[-1] + 1)::integer)) from walk where j < length(b)),
best as (select umi, parent, min(d[-1] * 1000 + j) as x from walk group by umi, parent)
select umi, parent, (x // 1000)::int as dist, (x % 1000)::int as "end" from best""")
def umi_infix_ends(spark, sf_dir):
    """The padded distance of each barcode to the one it comes from, and where the nearest part of that ends first."""
    r = reads_view(spark, sf_dir).withColumn("umi", F.when(F.col("l_orderkey") % 5 == 3, F.substring("umi", 1, 13)).otherwise(F.col("umi")))
    return alignment.with_infix(r.select("umi", "parent").distinct(), "umi", "parent")


@query(HIGH_SQL + " select group_id, umi, founder, dist::int as dist, dist::int as edits, (length(umi) - length(founder))::int as longer, true as whole from named where not is_founder")
def umi_edit_paths(spark, sf_dir):
    """How each absorbed barcode comes from its founder: its path's edits are its distance, and account for every base of both."""
    c = clustering.cluster(materialise(counts_view(spark, sf_dir)), D).filter(~F.col("is_founder"))
    e = alignment.with_path(c.select("group_id", "umi", "founder", "dist"), "founder", "umi").withColumn("e", alignment.path_edits(F.col("path")))
    used = lambda *kinds: sum((F.col(f"e.{k}") for k in kinds[1:]), F.col(f"e.{kinds[0]}"))
    whole = (used("same", "sub", "del") == F.length("founder")) & (used("same", "sub", "ins") == F.length("umi"))
    return e.select("group_id", "umi", "founder", "dist", used("sub", "ins", "del").alias("edits"), (F.col("e.ins") - F.col("e.del")).alias("longer"), whole.alias("whole"))


def _local_sql(todo: str) -> str:
    """Best local score x of each (a, b) of a table, and the first place y of b at which it ends."""
    return f"""rows_of as (select a, b, 0 as i, list_transform(range(0, length(b) + 1), lambda j: 0) as h, 0 as x, 0 as y from {todo}
    union all select a, b, i + 1, n, case when list_max(n) > x then list_max(n) else x end, case when list_max(n) > x then list_position(n, list_max(n)) - 1 when list_max(n) = x then least(y, list_position(n, x) - 1) else y end
    from (select *, list_reduce(list_prepend([0], list_transform(range(1, length(b) + 1), lambda j: [greatest(0, h[j] + case when substr(a, i + 1, 1) = substr(b, j, 1) then 1 else -1 end, h[j + 1] - 1)::integer])),
        lambda p, q: list_append(p, greatest(q[1], p[-1] - 1)::integer)) as n from rows_of where i < length(a))),
scored as (select a, b, x, y from rows_of where i = length(a))"""


LOCAL = 16
THRESHOLD_SQL = "with recursive " + COUNTS_SQL + f""",
words as (select distinct umi, length(umi) as n from rows_),
grams as (select umi, i, substr(umi, i::int, 7) as g from words, unnest(range(1, n - 5)) as t(i)),
todo as (select distinct a.umi as a, b.umi as b from grams a join grams b on a.g = b.g and abs(a.i - b.i) <= 2 and a.umi < b.umi),
{_local_sql('todo')},
alike as (select a, b from scored where x > {LOCAL} union all select b, a from scored where x > {LOCAL}),
edges as (select r.group_id, r.input_pos as a_pos, s.input_pos as b_pos, 0 as dist from rows_ r join alike on a = r.umi join rows_ s on s.group_id = r.group_id and s.umi = b and s.input_pos < r.input_pos),
high as (select * from edges), usable as (select * from edges)""" + CLUSTER_SQL.format(min_reads=1)


@query(THRESHOLD_SQL + " select group_id, umi, input_pos::bigint as input_pos, (dense_rank() over (partition by group_id order by founder_pos) - 1)::bigint as cluster, count(*) over (partition by group_id, founder_pos) as size from named")
def umi_threshold_clusters(spark, sf_dir):
    """In order of reads, each barcode left takes all left whose local alignment with it scores above 16."""
    return compare.threshold_clusters(materialise(counts_view(spark, sf_dir)), LOCAL).select("group_id", "umi", "input_pos", "cluster", "size")


@query()
def umi_threshold_scan(spark, sf_dir):
    """Similarity within the first clusters under several thresholds, and the threshold at the elbow."""
    scan = materialise(compare.threshold_scan(materialise(counts_view(spark, sf_dir)), [9, 11, 13, 15, 17]))
    rounded = scan.select("threshold", F.round("mean_similarity", 9).alias("mean_similarity"), "median_size", F.round("gain", 9).alias("gain"))
    return rounded.join(F.broadcast(compare.elbow(rounded, 18, 9).withColumnRenamed("threshold", "elbow")))  # one row


PROBE = "GATTACAGGT"
PROBE_SQL = ", fq as (select l_orderkey * 10 + l_linenumber as read_id, substr(umi, 1, p) || case when m % 3 = 0 then 'GATTACAGGT' when m % 3 = 1 then 'GATACAGGT' else 'GATTCCAGGT' end || substr(umi, p) as s from reads)"


@query("with recursive " + READS_SQL + PROBE_SQL + f""", one as (select read_id, min(s) as s from fq group by read_id),
strands as (select read_id, 0 as strand, case when read_id % 2 = 0 then s else reverse(translate(s, 'ACGT', 'TGCA')) end as s from one union all select read_id, 1, case when read_id % 2 = 0 then reverse(translate(s, 'ACGT', 'TGCA')) else s end from one),
todo as (select distinct '{PROBE}' as a, s as b from strands), {_local_sql('todo')},
best as (select read_id, arg_max(struct_pack(x := x, y := y, s := s), x * 2 - strand) as z from strands join scored on b = s where x >= 7 group by read_id)
select read_id::bigint as read_id, substr(z.s, z.y + 1, 6) as umi, z.x::int as score from best where z.y + 6 <= length(z.s)""")
def umi_probe_barcodes(spark, sf_dir):
    """Six bases behind a probe that may hold an error, in reads of either strand."""
    r = reads_view(spark, sf_dir)
    p, kind = F.col("p"), F.col("m") % 3
    probe = F.when(kind == 0, PROBE).when(kind == 1, "GATACAGGT").otherwise("GATTCCAGGT")
    s = F.concat(F.substring(F.col("umi"), F.lit(1), p), probe, F.substring(F.col("umi"), p, F.length("umi")))
    one = r.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read_id"), s.alias("s")).groupBy("read_id").agg(F.min("s").alias("s"))
    fq = one.select("read_id", F.when(F.col("read_id") % 2 == 0, F.col("s")).otherwise(S.reverse_complement(F.col("s"))).alias("seq"))
    return compare.extract_by_probe(fq, PROBE, 6, 7)


FILES_SQL = MATES_SQL + """, fq as (select row_number() over (order by l_orderkey, l_linenumber) - 1 as read_id, 'r' || l_orderkey || '.' || l_linenumber as name, umi || 'GATTACA' as s1 from one),
cut as (select read_id, name, substr(s1, 1, 18) as umi, substr(s1, 19) as seq from fq), counts as (select '1' as group_id, umi, count(*) as n_reads from cut group by umi)"""
FILES_EDGES_SQL = EDGES_SQL.replace(",\ncounts as (select group_id, umi, count(*) as n_reads from reads group by group_id, umi)", ONE_SQL + FILES_SQL.replace(ONE_SQL, ""))


@query("with recursive " + FILES_EDGES_SQL + ", high as (select * from edges), usable as (select * from edges)" + CLUSTER_SQL.format(min_reads=1) + """ select read_id::bigint as read_id, name || '_' || founder as name, seq, repeat('F', length(seq)) as qual, 'GATTACA' || name as mate,
    row_number() over (order by founder, read_id) - 1 as place from cut join named using (umi)""")
def umi_fastq_in_out(spark, sf_dir):
    """From files to files: both mates as FASTQ, one of them zipped, barcodes cut, counted and corrected, reads grouped by founder and written."""
    r, base = materialise(_one_a_line(spark, sf_dir)), shared_dir(spark)
    keys, name = ["l_orderkey", "l_linenumber"], F.concat(F.lit("r"), "l_orderkey", F.lit("."), "l_linenumber")
    one = lambda seq, comment: r.select(*keys, F.concat(name, F.lit(comment)).alias("name"), seq.alias("seq"), F.repeat(F.lit("F"), F.length(seq)).alias("qual"))
    tables.write_fastq(one(F.concat("umi", F.lit("GATTACA")), " 1:N"), f"{base}/r1", keys)
    tables.write_fastq(one(F.concat(F.lit("GATTACA"), name), " 2:N"), f"{base}/r2", keys, "gzip")
    tagged = materialise(reads.extract(tables.read_fastq(spark, f"{base}/r1"), tables.read_fastq(spark, f"{base}/r2"), (1, 18)))
    founders = clustering.cluster(materialise(clustering.with_positions(reads.count_barcodes(tagged))), D)
    first = tagged.select("read_id", F.col("name1").alias("name"), F.col("seq1").alias("seq"), F.col("qual1").alias("qual"), "seq2")
    grouped = materialise(reads.regroup(first, founders, keep=["read_id", "seq2"]))
    tables.write_fastq(grouped, f"{base}/grouped", ["founder", "read_id"])
    back = tables.read_fastq(spark, f"{base}/grouped").withColumnRenamed("read_id", "place")
    mates = grouped.select("name", F.col("read_id").alias("first_id"), F.col("seq2").alias("mate"))
    return back.join(mates, "name").select(F.col("first_id").alias("read_id"), "name", "seq", "qual", "mate", "place")


@query(HIGH_SQL + " select group_id, umi, founder, dist::int as dist, is_founder from named")
def umi_stream_founders(spark, sf_dir):
    """umi_clusters by a stream that is stopped and started again: barcodes with many reads arrive first, those with one last."""
    counts, base = materialise(counts_view(spark, sf_dir)), shared_dir(spark)
    for part in ("n_reads > 8", "n_reads between 2 and 8", "n_reads < 2"):
        counts.filter(part).write.mode("append").parquet(f"{base}/in")
        rows = spark.readStream.schema(counts.schema).parquet(f"{base}/in")
        incremental.founders_stream(rows, f"{base}/store", "input_pos", D).trigger(availableNow=True).start().awaitTermination()
    return incremental.assigned(spark, f"{base}/store").drop("input_pos")
