"""Readers, writers, reads, quality, comparison methods, simulation and streams."""

import gzip
import random

import models
import pytest
from pyspark.sql import functions as F

from founderflow.functions import sequences as S
from founderflow.operators import compare, quality, reads, simulate
from founderflow.plans import pipeline
from founderflow.sources import fastq, tables
from founderflow.streaming import incremental


def test_counts_file(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("1\tACGTACGT\t9\n1\tACGTACGA\t2\nbroken\n1\tTTTTCCCC\tx\n2\tGGGGCCCC\t1\n")
    got = [tuple(r) for r in tables.read_counts(spark, str(tmp_path / "c.tsv")).orderBy("input_pos").collect()]
    assert got == [("1", "ACGTACGT", 9, 1), ("1", "ACGTACGA", 2, 2), ("2", "GGGGCCCC", 1, 5)]
    assert tables.malformed_lines(spark, str(tmp_path / "c.tsv")) == 2


@pytest.mark.parametrize("zipped", [False, True])
def test_fastq_round_trip(spark, tmp_path, zipped):
    text = "".join(f"@r{i} x y\nACGTTGCA{'ACGT'[i % 4]}\n+\nIIIIJJJJK\n" for i in range(9))
    path = tmp_path / ("r.fastq.gz" if zipped else "r.fastq")
    with gzip.open(path, "wt") if zipped else open(path, "w") as f:
        f.write(text)
    fq = tables.read_fastq(spark, str(path))
    assert fq.count() == 9
    out = reads.extract(fq, fq, (1, 4), (0, 0)).orderBy("read_id").first()
    assert (out.umi, out.name1, out.seq1, out.qual1, out.seq2) == ("ACGT", "r0_ACGT x y", "TGCAA", "JJJJK", "ACGTTGCAA")
    tables.write_fastq(fq.orderBy("read_id"), str(tmp_path / "out"), ["read_id"])
    assert tables.read_fastq(spark, str(tmp_path / "out")).count() == 9
    assert reads.extract(fq, fq, (1, 3), (2, 30)).first().seq2 == ""
    assert reads.count_barcodes(reads.extract(fq, None, (9, 9))).count() == 4


def _records(rng, n):
    quality = "@+I#5"
    return [(f"r{i} {rng.choice(['1:N', '@', '+'])}", "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 5, 30]))), "".join(rng.choice(quality) for _ in range(rng.choice([1, 5, 30])))) for i in range(n)]


@pytest.mark.parametrize("split", [25, 50, 333])
def test_fastq_across_splits(spark, tmp_path, split):
    """Records that cross the edges of splits, qualities that look like headers, several files, an unfinished end."""
    rng = random.Random(split)
    files = [_records(rng, n) for n in (12, 0, 1, 7)]
    for i, records in enumerate(files):
        (tmp_path / f"{i}.fastq").write_text("".join(f"@{a}\n{b}\n+{rng.choice(['', 'again'])}\n{c}\n" for a, b, c in records) + ["", "", "\n", "@half\nACG\n"][i])
    keys = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "8"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        fq = tables.read_fastq(spark, str(tmp_path))
        got = [tuple(r) for r in fq.orderBy("read_id").collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == [(i, *r) for i, r in enumerate(r for records in files for r in records)]


def test_fastq_passes_send_back_what_they_need():
    """The pass for totals and edges gives no records, the one for records nothing else."""
    import pyarrow as pa

    lines = [x for i in range(9) for x in (f"@r{i}", "ACGT", "+", "IIII")]
    batch = lambda start, part: pa.RecordBatch.from_arrays([pa.array(part), pa.array(["f"] * len(part)), pa.array([start] * len(part), pa.int64())], ["value", "file", "start"])
    both = pa.concat_tables([pa.Table.from_batches([batch(0, lines[:18])]), pa.Table.from_batches([batch(99, lines[18:])])]).combine_chunks().to_batches()
    kinds = {r: [k for b in fastq._parse(iter(both), records=r) for k in b.column(0).to_pylist()] for r in (False, True)}
    assert kinds == {False: [fastq.EDGE] * 2 + [fastq.TOTAL] + [fastq.EDGE] * 2 + [fastq.TOTAL], True: [fastq.RECORD] * 8}


def test_fastq_moves_no_reads(spark, tmp_path):
    (tmp_path / "r.fastq").write_text("".join(f"@r{i}\nACGT\n+\nIIII\n" for i in range(50)))
    fq = tables.read_fastq(spark, str(tmp_path / "r.fastq"))
    plan = fq._jdf.queryExecution().executedPlan().toString()
    inside = plan[:plan.index("MapInArrow")]
    assert "Union" in inside and "Exchange" not in inside.replace("BroadcastExchange", "")
    (tmp_path / "bad.fastq").write_text("@r\nACGT\nACGT\n+\nIIII\nIIII\n" * 4)
    with pytest.raises(Exception, match="four lines"):
        tables.read_fastq(spark, str(tmp_path / "bad.fastq")).count()
    (tmp_path / "none.fastq").write_text("")
    assert tables.read_fastq(spark, str(tmp_path / "none.fastq")).count() == 0


def test_fastq_of_nulls(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None, "I"), (2, None, "C", None)], "at int, name string, seq string, qual string")
    tables.write_fastq(rows, str(tmp_path / "out"), ["at"])
    assert [tuple(r) for r in tables.read_fastq(spark, str(tmp_path / "out")).orderBy("read_id").collect()] == [(0, "a", "", "I"), (1, "", "C", "")]


def test_regroup(spark):
    fq = spark.createDataFrame([("a_b_ACGT c", "GG", "II"), ("x_TTTT", "CC", "JJ"), ("x_AAAA", "CC", "JJ")], "name string, seq string, qual string")
    assigned = spark.createDataFrame([("1", "ACGT", "ACGG"), ("2", "ACGT", "ACCC"), ("1", "TTTT", "TTTT")], "group_id string, umi string, founder string")
    assert sorted(r.name for r in reads.regroup(fq, assigned).collect()) == ["a_b_ACCC", "a_b_ACGG", "x_TTTT"]


def test_fasta_and_sheet(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one\nACGT\nAC\n>two\nGG\n")
    assert [(r.name, r.seq) for r in tables.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("record_id").collect()] == [("one", "ACGTAC"), ("two", "GG")]
    (tmp_path / "s.csv").write_text("condition,replicate,P1,P2\nc,1,u1 u2,u3\n")
    assert tables.read_sample_sheet(spark, str(tmp_path / "s.csv")).count() == 2


def test_pipeline_command(spark, tmp_path):
    rng = random.Random(1)
    lines = []
    for _ in range(40):
        u = "".join(rng.choice("ACGT") for _ in range(18))
        lines += [(u, rng.randint(20, 60)), (u[:-1] + rng.choice("ACGT".replace(u[-1], "")), 1)]
    lines.sort(key=lambda x: (-x[1], x[0]))
    (tmp_path / "in").write_text("".join(f"1\t{u}\t{n}\n" for u, n in lines))
    assert pipeline.main(["-i", str(tmp_path / "in"), "-l", "18", "-e", "0.01", "-o", str(tmp_path / "out")]) == 0
    report = dict(line.split("\t") for p in (tmp_path / "out.estimate").glob("part-*") for line in p.read_text().splitlines())
    assert report["estimated_molecules"] == "40"
    assert pipeline.main(["-i", str(tmp_path / "in"), "-j"]) == 0
    with pytest.raises(SystemExit):
        pipeline.main(["-i", "x", "-l", "18", "-m", "1", "-e", "0.1"])


def test_scores(spark):
    labels = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 2)], "truth int, predicted int")
    r = quality.scores(labels).first()
    assert r.homogeneity == pytest.approx(1.0) and r.completeness == pytest.approx(2 / 3)
    one = quality.scores(spark.createDataFrame([(0, 0)], "truth int, predicted int")).first()
    assert tuple(one) == (1.0, 1.0, 1.0)
    t = spark.createDataFrame([("A", 1), ("A", 2)], "umi string, label int")
    assert quality.scores_of_files(t, t.limit(1)).first().v_measure == 0.0


def test_edits(spark):
    df = spark.createDataFrame([("3:A/T_7:C/CG_9:G/",), ("",), ("sig",), (None,), ("1:A/G",)], "err string")
    r = quality.edit_totals(df).first()
    assert (r.edited, r.substitution_only, r.with_indel, r.ins, r["del"], r["sub"], r.ratio) == (2, 1, 1, 1, 1, 2, "1.000-1.000-2.000")


def brute(rows, method, t=1):
    from models import within

    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    near = {u: [v for v, m in order if u != v and within(u, v, t) >= 0 and (method == "cluster" or n >= 2 * m - 1)] for u, n in order}
    seen, lead = set(), {}
    for rank, (u, _) in enumerate(order, 1):
        if u in seen:
            continue
        todo, got = [u], {u}
        while todo:
            for v in near[todo.pop()]:
                if v not in got:
                    got.add(v)
                    todo.append(v)
        for v in got - seen:
            lead[v] = rank
        seen |= got
    return lead


def brute_cover(rows):
    """Per component the fewest of the best ranked that cover it with their neighbours, tried one after the other."""
    from models import within

    order = [u for u, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    rank = {u: i for i, u in enumerate(order, 1)}
    near = {u: {v for v in order if u != v and within(u, v, 1) >= 0} for u in order}
    component, out = brute(rows, "cluster"), {}
    for c in set(component.values()):
        nodes = [u for u in order if component[u] == c]
        k = next(k for k in range(1, len(nodes) + 1) if set(nodes) <= set(nodes[:k]).union(*(near[u] for u in nodes[:k])))
        for u in nodes[k:]:
            out[u] = next(rank[v] for v in nodes[:k] if u in near[v])
        out |= {u: rank[u] for u in nodes[:k]}
    return out


@pytest.mark.parametrize("method", ["cluster", "directional"])
def test_methods(spark, method):
    rng = random.Random(3)
    rows = list({"".join(rng.choice("AC") for _ in range(6)): rng.randint(1, 30) for _ in range(24)}.items())
    df = spark.createDataFrame([("1", u, n) for u, n in rows], "group_id string, umi string, n_reads long")
    assert {r.umi: r.lead for r in compare.groups(df, method).collect()} == brute(rows, method)
    assert compare.groups(df, "unique").count() == len(rows)
    assert {r.umi: r.lead for r in compare.groups(df, "adjacency").collect()} == brute_cover(rows)
    bucket = compare.representatives(compare.groups(df, method), df.limit(1).select("umi")).agg(F.sum("n_reads")).first()[0]
    assert bucket == sum(n for _, n in rows)


def test_elbow(spark):
    many = spark.createDataFrame([(t, s) for t, s in ((10, 5.0), (15, 8.0), (20, 9.0), (25, 9.1), (30, 20.0))], "threshold int, mean_similarity double")
    from pyspark.sql import Window

    gains = many.withColumn("gain", F.col("mean_similarity") - F.lag("mean_similarity").over(Window.orderBy("threshold")))
    assert compare.elbow(gains, 18).first().threshold == 20 and compare.elbow(gains, 60).first().threshold is None


def test_simulation_and_fact_files(spark, tmp_path):
    made = simulate.reads(simulate.parents(spark, 5, 10), 0.1, 6)
    tables.write_simulation(made, str(tmp_path / "sim"), str(tmp_path / "labels"))
    lines = [x.split("\t") for f in (tmp_path / "sim").glob("part-*") for x in f.read_text().splitlines()]
    assert len(lines) == made.count() and all(len(x) == 3 for x in lines)
    assert sorted(int(x.split(" ")[1]) for f in (tmp_path / "labels").glob("part-*") for x in f.read_text().splitlines()) == sorted(r.parent_label for r in made.collect())
    facts = spark.createDataFrame([("a", 2, 0.5), ("b", 1, None)], "tool string, num_founder int, value double")
    tables.write_facts(facts, str(tmp_path / "facts"), ["num_founder"])
    back = tables.read_facts(spark, str(tmp_path / "facts"))
    assert sorted(map(tuple, back.collect())) == [("a", 2, 0.5), ("b", 1, None)]
    clustered = spark.createDataFrame([("1", "ACGT", "ACGA", 3), ("1", "ACGA", "ACGA", 9)], "group_id string, umi string, founder string, n_reads long")
    tables.write_assignments(clustered, str(tmp_path / "assigned"))
    tables.write_counts(clustered, str(tmp_path / "counts"))
    text = lambda name: [x for f in sorted((tmp_path / name).glob("part-*")) for x in f.read_text().splitlines()]
    assert sorted(text("assigned")) == ["1\tACGA\tACGA", "1\tACGT\tACGA"] and text("counts") == ["1\tACGA\t9", "1\tACGT\t3"]
    compare.write_clusters(spark.createDataFrame([(0, 2, "a", "AC"), (0, 2, "b", "GG"), (1, 1, "c", "TT")], "cluster long, size long, name string, seq string"), str(tmp_path / "clusters"), 2)
    assert sorted(x for f in (tmp_path / "clusters" / "cluster=0").glob("part-*") for x in f.read_text().splitlines()) == [">a", ">b", "AC", "GG"] and not (tmp_path / "clusters" / "cluster=1").exists()


def test_numbering(spark, tmp_path):
    from founderflow.functions import numbering

    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randint(0, 5), i) for i in rng.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "g string, n int, i int").repartition(7)
    got = {(r.g, r.i): r.at for r in numbering.numbered(df, "at", ["g"], [(F.col("n"), True), (F.floor(F.col("i") / 100), False)], ["i"]).collect()}
    for g in "ab":
        for at, (_, i) in enumerate(sorted((-n, i) for h, n, i in rows if h == g), 1):
            assert got[g, i] == at
    every = {r.i: r.at for r in numbering.numbered(df, "at", [], [(F.floor(F.col("i") / 50), False)], ["i"]).collect()}
    assert every == {i: at for at, i in enumerate(sorted(i for _, _, i in rows), 1)}
    big = [("a", 65_534), ("a", 65_535), ("a", 65_536), ("b", 65_537), (None, 65_538), (None, 131_072), ("a", 200_000), ("a", 200_001), ("b", 400_000)]
    found = numbering.runs(spark.createDataFrame(big, "g string, i long").repartition(5), "g", "i", "run").orderBy("i").collect()
    assert [r.run for r in found] == [1, 1, 1, 2, 3, 3, 4, 4, 5]
    some = spark.createDataFrame([("x", 3), ("y", 0), ("z", 150_000), ("w", None)], "k string, n long")
    for spread in (False, True):
        made = numbering.copies(some, F.col("n"), "c", spread).groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("c").alias("d"), F.min("c").alias("a"), F.max("c").alias("b")).collect()
        assert sorted(map(tuple, made)) == [("x", 3, 3, 0, 2), ("z", 150_000, 150_000, 0, 149_999)]
    (tmp_path / "lines").write_text("".join(f"line {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = tables.numbered_lines(spark, str(tmp_path / "lines"))
        assert lines.rdd.getNumPartitions() > 1 and all(r.line == f"line {r.line_no}" for r in lines.collect()) and lines.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_per_read_and_counts(spark):
    c = spark.createDataFrame([("1", "AC", "AC", 0, 3), ("1", "AG", "AC", 0, 0), ("1", "TT", "TT", 1, 1)], "group_id string, umi string, founder string, label int, n_reads long")
    assert sorted(map(tuple, quality.per_read(c).collect())) == [("AC", 0)] * 3 + [("TT", 1)]
    assert quality.cluster_count(c, ["group_id"]).first().clusters == 2


def test_shared_folder_is_needed_on_a_cluster():
    from founderflow.plans import storage

    class Session:
        conf = type("", (), {"get": staticmethod(lambda key, other=None: None)})
        sparkContext = type("", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        storage.shared_dir(Session())


def test_simulation(spark):
    p = simulate.parents(spark, 30, 10)
    assert p.select("umi").distinct().count() == 30
    a = sorted(map(tuple, simulate.reads(p, 0.05, 10).collect()))
    assert a == sorted(map(tuple, simulate.reads(p.repartition(5), 0.05, 10).collect()))
    assert {r[2] for r in a} == set(range(30))
    with pytest.raises(ValueError):
        simulate.parents(spark, 5, 1)


def test_names(spark):
    r = spark.createDataFrame([("read_1 c", "ACGT")], "n string, u string").select(S.tagged(F.col("n"), F.col("u")).alias("t")).select("t", S.untagged(F.col("t"))[0].alias("n"), S.untagged(F.col("t"))[1].alias("u")).first()
    assert tuple(r) == ("read_1_ACGT c", "read_1", "ACGT")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tsv").write_text("1\tACGTACGT\t3\n1\tACGTACGA\t1\n1\tACGTACGT\t2\n")
    q = incremental.count_stream(spark, str(tmp_path / "in")).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.umi, r.n_reads) for r in spark.table("counts").collect()} == {("ACGTACGT", 5), ("ACGTACGA", 1)}


@pytest.mark.parametrize("tail", [0, 1000])
def test_founders_of_a_stream(spark, tmp_path, tail):
    """Three micro-batches, a restart between them, repeats, nulls, and the last one run again: as one serial pass has it."""
    rng = random.Random(tail)
    parents = ["".join(rng.choice("ACGT") for _ in range(12)) for _ in range(6)]
    near = lambda u: u[:(p := rng.randint(0, 11))] + rng.choice(["", "A", "GT"]) + u[p + 1:]
    rows = [(rng.choice("12"), near(near(rng.choice(parents))), i) for i in range(150)] + [("1", "NNNNNNNN", 150), ("1", "NNNNNNNN", 151)]
    want = []
    for group in "12":
        own = [(u, 1, i) for g, u, i in rows if g == group]
        umi = {i: u for u, _, i in own}
        want += [(group, umi[i], umi[f], dist, first) for i, f, dist, first in sorted(models.serial(own, 2))]
    schema, store = "group_id string, umi string, at long", str(tmp_path / "store")

    def run():
        q = incremental.founders_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, "at", 2, tail).trigger(availableNow=True).start()
        q.awaitTermination()

    assert incremental.founders(spark, store).count() == incremental.assigned(spark, store).count() == 0
    for k, part in enumerate((rows[:40], [(None, "ACGTACGT", 0), ("1", None, 0)], rows[40:])):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    for again in (False, True):
        if again:
            (tmp_path / "store/progress/commits/2").unlink()
            (tmp_path / "store/progress/commits/.2.crc").unlink(missing_ok=True)
            run()
        got = incremental.assigned(spark, store).orderBy("group_id", "input_pos").collect()
        assert [(r.group_id, r.umi, r.founder, r.dist, r.is_founder) for r in got] == want
        assert incremental.founders(spark, store).count() == sum(w[4] for w in want)


def test_fasta_headers_may_hold_the_mark(spark, tmp_path):
    (tmp_path / "b.fa").write_text("; before\n>r1 A>C variant\nACG\nT A\n>r2\n>r3 >x\nGG\n\nTT\n")
    got = [tuple(r) for r in tables.read_fasta(spark, str(tmp_path / "b.fa")).orderBy("record_id").collect()]
    assert got == [(0, "r1 A>C variant", "ACGTA"), (1, "r2", ""), (2, "r3 >x", "GGTT")]


def test_running_counts_across_blocks(spark):
    from founderflow.functions import numbering

    rows = [(i,) for i in (0, 1, 65_535, 65_536, 131_080, 200_000)]
    got = numbering.running(spark.createDataFrame(rows, "i long").repartition(3), F.col("i") % 2 == 0, "i", "n").orderBy("i").collect()
    assert [r.n for r in got] == [1, 1, 1, 2, 3, 4]


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(compare, "_state", lambda edges, state=compare._state: rounds.append(1) or state(edges))
    rng = random.Random(9)
    names = list(range(10_000))
    rng.shuffle(names)
    edges = spark.createDataFrame([("g", a, b) for a, b in zip(names, names[1:])] + [("h", 5, 3), ("h", 3, 3)], "group_id string, u int, v int")
    got = compare.components(edges).collect()
    assert len(rounds) <= 20 and {(r.group_id, r.u, r.v) for r in got} == {("g", i, 0) for i in range(1, 10_000)} | {("h", 5, 3)}
