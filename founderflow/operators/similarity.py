"""Similarity join of barcodes: edit distance within d and at least one common 6-mer.

A pair within d edits has one of the d + 1 equal pieces of the indexed barcode unchanged in the other, at a shift
that the piece's number and the lengths' difference bound (multi-match-aware partition, Li et al. 2011). So the join
is an equi-join on (group, length, piece, letters) that Catalyst can shuffle and adaptive execution can split, with
few chance candidates. Where pieces would be shorter than 5 letters, frequent ones would be met by many barcodes: there each barcode may be cut
in one of CUTS ways, whose borders lie a letter apart, and is indexed under the one whose pieces are the rarest, by counts over all
barcodes. Any partition finds all pairs, so each barcode may choose its own; the other side probes all of them. Where
pieces would be shorter than 4, candidates share a 6-mer. The banded edit distance and then the common 6-mer, which is part of the result's
definition, are checked on candidates only.

With overhangs a barcode is compared, padded by N, to the nearest part of the other, padded too: what the other has beyond it
costs at most 3 on either end. Below 3 edits that is the plain distance of barcodes without N (each pad that meets
no pad is an edit, and a letter set against a pad could be a plain insertion), so only then and there the plain join serves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from founderflow.functions.sequences import K, kmers
from founderflow.operators.alignment import with_infix

CUTS = (0, 1, -1)  # shifts of the inner borders
CELLS = 1 << 14  # of the counts of pieces
SIDE = 3


def _fits(d: int) -> Column:
    """The common 6-mer test needs windows of 6; the pieces need a base each."""
    return F.length("umi") >= max(K, d + 1)


def _piece(length: Column, i: Column, d: int) -> Column:
    return F.floor(i * length / (d + 1)).cast("int")


def indexed(rows: DataFrame, d: int) -> DataFrame:
    """(group_id, ln, piece, letters, b_pos, b_umi): each barcode's d + 1 pieces."""
    n = F.length("umi")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(d)), lambda i: F.struct(i.alias("piece"), F.substring(F.col("umi"), _piece(n, i, d) + 1, _piece(n, i + 1, d) - _piece(n, i, d)).alias("letters")))
    return rows.filter(_fits(d)).select("group_id", n.alias("ln"), F.col("input_pos").alias("b_pos"), F.col("umi").alias("b_umi"), F.inline(pieces))


def probes(rows: DataFrame, d: int) -> DataFrame:
    """(group_id, ln, piece, letters, a_pos, a_umi): for each possible length, the letters at the admitted shifts."""
    la = F.length("umi")
    per_length = rows.filter(la >= K).withColumn("ln", F.explode(F.sequence(F.greatest(la - d, F.lit(max(K, d + 1))), F.greatest(la + d, F.lit(max(K, d + 1))))))
    ln, gap = F.col("ln"), F.length("umi") - F.col("ln")
    per_piece = per_length.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(d))))
    i = F.col("piece")
    low = F.greatest(-i, gap - (d - i))
    high = F.least(i, gap + (d - i))
    start, width = _piece(ln, i, d), _piece(ln, i + 1, d) - _piece(ln, i, d)
    shifts = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    cut = F.transform(F.filter(shifts, lambda s: (start + s >= 0) & (start + s + width <= F.length("umi"))), lambda s: F.substring(F.col("umi"), start + s + 1, width))
    return per_piece.select("group_id", "ln", "piece", F.explode(F.array_distinct(cut)).alias("letters"), F.col("input_pos").alias("a_pos"), F.col("umi").alias("a_umi"))


def similar_pairs(later: DataFrame, earlier: DataFrame, d: int, ordered: bool = True) -> DataFrame:
    """(group_id, a_pos, b_pos, dist): rows of `later` and `earlier` within d edits that share a 6-mer.

    With `ordered`, only pairs whose b row comes before its a row. Barcodes shorter than 6, or without a window of
    A, C, G, T, match nothing, not even equal ones.
    """
    shortest = earlier.filter(F.length("umi") >= K).agg(F.min(F.length("umi"))).first()[0] or 0
    if shortest < (K - 2) * (d + 1):  # pieces of fewer than 4 letters would meet more by chance than 6-mers do
        found = _by_kmers(later, earlier)
    elif shortest < K * (d + 1) - d:
        found = _probes_of_cuts(later, d).join(_rarest(_cut(earlier, d)), ["group_id", "ln", "cut", "piece", "letters"])
    else:
        found = probes(later, d).join(indexed(earlier, d), ["group_id", "ln", "piece", "letters"])
    if ordered:
        found = found.filter(F.col("a_pos") > F.col("b_pos"))
    near = found.withColumn("dist", F.levenshtein("a_umi", "b_umi", d)).filter("dist >= 0")
    # A common piece of 6 or more plain letters is a common 6-mer; only pairs without one have their 6-mers compared.
    plain = (F.length("letters") >= K) & F.col("letters").rlike("^[ACGTacgt]+$")
    pairs = near.groupBy("group_id", "a_pos", "b_pos").agg(F.min("dist").alias("dist"), F.max(plain).alias("plain"), F.min("a_umi").alias("a_umi"), F.min("b_umi").alias("b_umi"))
    shared = F.when(F.col("plain"), True).otherwise(F.arrays_overlap(kmers(F.col("a_umi")), kmers(F.col("b_umi"))))
    return pairs.filter(shared).select("group_id", "a_pos", "b_pos", "dist")


def _borders(length: Column, i: Column, d: int, shift: Column) -> Column:
    """Where piece i begins if the inner borders are shifted."""
    return _piece(length, i, d) + F.when((i > 0) & (i <= d), shift).otherwise(0)


def _cut(rows: DataFrame, d: int) -> DataFrame:
    """(group_id, ln, cut, piece, letters, b_pos, b_umi): the pieces of each barcode under all ways to cut it."""
    n, cut, i = F.length("umi"), F.col("cut"), F.col("piece")
    each = rows.filter(_fits(d)).withColumn("cut", F.explode(F.array(*map(F.lit, CUTS)))).withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(d))))
    start, end = _borders(n, i, d, cut), _borders(n, i + 1, d, cut)
    return each.select("group_id", n.alias("ln"), "cut", "piece", F.substring(F.col("umi"), start + 1, end - start).alias("letters"), F.col("input_pos").alias("b_pos"), F.col("umi").alias("b_umi"))


def _rarest(pieces: DataFrame) -> DataFrame:
    """The pieces of each barcode's best way to be cut: the one whose most frequent piece is the rarest.

    Pieces are counted in CELLS cells, a bounded table that is sent to all tasks; a shared cell costs candidates only."""
    cell = F.pmod(F.xxhash64("group_id", "ln", "cut", "piece", "letters"), F.lit(CELLS))
    counted = pieces.withColumn("ff_cell", cell)
    cells = counted.groupBy("ff_cell").agg(F.count(F.lit(1)).alias("ff_n"))
    marked = counted.join(F.broadcast(cells), "ff_cell")
    held = F.collect_list(F.struct("piece", "letters"))
    whole = marked.groupBy("group_id", "b_pos", "cut").agg(F.max("ff_n").alias("ff_n"), F.first("ln").alias("ln"), F.first("b_umi").alias("b_umi"), held.alias("ff_held"))
    best = whole.groupBy("group_id", "b_pos").agg(F.min_by(F.struct("ln", "cut", "b_umi", "ff_held"), F.struct("ff_n", F.abs("cut"), "cut")).alias("ff_best"))
    return best.select("group_id", "b_pos", "ff_best.*").select("group_id", "ln", "cut", "b_pos", "b_umi", F.inline("ff_held"))


def _probes_of_cuts(rows: DataFrame, d: int) -> DataFrame:
    """probes() for pieces under all ways to cut them."""
    la = F.length("umi")
    per_length = rows.filter(la >= K).withColumn("ln", F.explode(F.sequence(F.greatest(la - d, F.lit(max(K, d + 1))), F.greatest(la + d, F.lit(max(K, d + 1))))))
    each = per_length.withColumn("cut", F.explode(F.array(*map(F.lit, CUTS)))).withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(d))))
    ln, i, gap = F.col("ln"), F.col("piece"), la - F.col("ln")
    low, high = F.greatest(-i, gap - (d - i)), F.least(i, gap + (d - i))
    start = _borders(ln, i, d, F.col("cut"))
    width = _borders(ln, i + 1, d, F.col("cut")) - start
    shifts = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    letters = F.transform(F.filter(shifts, lambda s: (start + s >= 0) & (start + s + width <= F.length("umi"))), lambda s: F.substring(F.col("umi"), start + s + 1, width))
    return each.select("group_id", "ln", "cut", "piece", F.explode(F.array_distinct(letters)).alias("letters"), F.col("input_pos").alias("a_pos"), F.col("umi").alias("a_umi"))


def overhang_pairs(later: DataFrame, earlier: DataFrame, d: int, ordered: bool = True) -> DataFrame:
    """similar_pairs() by the distance of the padded a to the nearest part of the padded b."""
    if d >= SIDE:
        return _within_infix(_by_kmers(later, earlier), d, ordered)
    free, odd = (lambda rows: rows.filter(~F.col("umi").contains("N"))), (lambda rows: rows.filter(F.col("umi").contains("N")))
    with_n = _by_kmers(odd(later), earlier).unionByName(_by_kmers(free(later), odd(earlier)))
    return similar_pairs(free(later), free(earlier), d, ordered).unionByName(_within_infix(with_n, d, ordered))


def _within_infix(found: DataFrame, d: int, ordered: bool) -> DataFrame:
    if ordered:
        found = found.filter(F.col("a_pos") > F.col("b_pos"))
    # A pair may share many 6-mers: those that only continue another one are passed over.
    i, j = F.position("letters", F.upper("a_umi")), F.position("letters", F.upper("b_umi"))
    before = F.upper(F.substring(F.col("a_umi"), i - 1, F.lit(1)))
    continues = (i > 1) & (j > 1) & (before == F.upper(F.substring(F.col("b_umi"), j - 1, F.lit(1)))) & before.isin("A", "C", "G", "T")
    near = with_infix(found.filter(~continues), "a_umi", "b_umi", SIDE).filter(F.col("dist") <= d)
    return near.groupBy("group_id", "a_pos", "b_pos").agg(F.min("dist").alias("dist"))


def _by_kmers(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Candidates by common 6-mers, for distances at which pieces would be too short."""
    a = later.select("group_id", F.col("input_pos").alias("a_pos"), F.col("umi").alias("a_umi"), F.explode(kmers(F.col("umi"))).alias("letters"))
    b = earlier.select("group_id", F.col("input_pos").alias("b_pos"), F.col("umi").alias("b_umi"), F.explode(kmers(F.col("umi"))).alias("letters"))
    return a.join(b, ["group_id", "letters"])
