"""Duplicates, scaffolding, picking, and a whole run on a sequence with known gaps."""

import random

from pyspark.sql import functions as F

from seqloom.operators import dedup as D
from seqloom.operators import pick as K
from seqloom.operators.align import revcomp
from seqloom.operators.scaffold import scaffold_pairs, similar_coverage
from seqloom.plans import pipeline as P


def test_contained(spark):
    s = "ACGTTGCATGGACCATTGACAGT"
    rows = [("g", "a", s), ("g", "b", s), ("g", "c", s[3:20]), ("g", "d", None), ("h", "e", s), ("g", "f", "ACG")]
    alns = D.exact_containments(spark.createDataFrame(rows, "gap string, n string, s string"), "gap", "n", "s")
    names = lambda df: sorted(r.name for r in df.collect())
    assert names(D.perfectly_contained(alns)) == ["b", "c"] and names(D.perfectly_contained(alns, parity=True)) == ["a", "b", "c"]
    assert names(D.near_duplicates(alns, 0.9)) == ["b"] and names(D.contained_or_smaller(alns, 0.9)) == ["a", "c"]
    assert names(D.contained(alns, 0.9)) == ["a", "b", "c"] and names(D.mapped_on_other(alns, 0.9)) == ["a", "b", "c"]


def test_self_alignment_finds_the_reverse_strand(spark):
    rng = random.Random(8)
    s = "".join(rng.choice("ACGT") for _ in range(120))
    rows = [("g", "a", s), ("g", "b", revcomp(s[20:90]))]
    got = {(r.qname, r.rname, r.reverse, r.cigar) for r in D.self_alignments(spark.createDataFrame(rows, "gap string, n string, s string"), "gap", "n", "s").collect()}
    assert got == {("b", "a", True, "70M"), ("a", "b", True, "30S70M20S")}


def test_scaffold_pairs(spark):
    links = spark.createDataFrame([("a", "b", "+", "+", 5, 3.0), ("a", "c", "+", "+", 1, 3.0), ("b", "c", "+", "-", 2, -8.0)], "l_name string, r_name string, l_ori string, r_ori string, pairs long, mean_distance double")
    seqs = spark.createDataFrame([("a", "ACGTAAAA"), ("b", "TTGACCATGACATTGC"), ("c", "CCCCGCAATGTC")], "name string, seq string")
    got = {(r.l_name, r.r_name): (r.distance, r.seq) for r in scaffold_pairs(links, seqs).collect()}
    assert got == {("a", "b"): (3, "ACGTAAAANNNTTGACCATGACATTGC"), ("b", "c"): (-8, "TTGACCATGACATTGCGGGG")}
    cov = spark.createDataFrame([("a", 10.0), ("b", 9.0), ("c", 1.0)], "name string, coverage double")
    assert [(r.l_name, r.r_name) for r in similar_coverage(links, cov, 0.2).collect()] == [("a", "b")]


def test_pick(spark):
    contig = "A" * 10 + "CCGGTTAACC" + "T" * 10
    alns = [("g", "c", "left", 0, 1, "10M", 1), ("g", "c", "right", 0, 21, "10M", 2), ("g", "d", "left", 4, 1, "10M", 3)]
    df = spark.createDataFrame(alns, "gap_id string, contig string, side string, flag int, pos int, cigar string, ord int")
    got = K.pick_bridging(df, spark.createDataFrame([("g", "c", contig)], "gap_id string, contig string, seq string")).collect()
    assert [(r.contig, r.fill) for r in got] == [("c", "CCGGTTAACCT")]
    one = spark.createDataFrame([("g", "c", "left", 0, 1, "10M5S", 1)], df.schema)
    assert K.pick_extended(one, spark.createDataFrame([("g", "c", contig)], "gap_id string, contig string, seq string")).first().fill == contig[10:] + "NN"


def test_planted_gaps_are_filled(spark):
    rng = random.Random(21)
    truth = "".join(rng.choice("ACGT") for _ in range(2400))
    holes = [(800, 900), (1500, 1560)]
    draft = truth
    for a, b in holes:
        draft = draft[:a] + "N" * (b - a) + draft[b:]
    scaffolds = spark.createDataFrame([(0, "s", draft), (1, "e", ""), (2, "n", None)], "ord int, name string, seq string")
    gaps = P.find_gaps(scaffolds, 20)
    assert sorted((r.gap_id, r.gap_start, r.gap_end) for r in gaps.collect()) == [("0_1", 800, 900), ("0_2", 1500, 1560)]
    reads = []
    for g, (a, b) in (("0_1", holes[0]), ("0_2", holes[1])):
        for i in range(a - 350, b + 250, 7):
            r = truth[i : i + 100]
            reads.append((g, r if i % 2 else revcomp(r)))
    fills = P.fill_gaps(scaffolds, gaps, spark.createDataFrame(reads, "gap_id string, seq string"), ks=(31,), flank=300, rounds=((1, 60),))
    from seqloom.operators.pick import splice_gaps

    done = {r.name: r.seq for r in splice_gaps(scaffolds.select("name", "seq"), gaps, fills.select("gap_id", F.col("fill"))).collect()}
    assert done == {"s": truth, "e": "", "n": None}


def test_links_are_aligned_once(spark):
    """What is asked of the alignments doesn't make them again; links with a distance have none."""
    from seqloom.operators.scaffold import checked_links

    links = spark.createDataFrame([("a", "b", "+", "+", 5, -8.0), ("b", "a", "+", "+", 5, 3.0)], "l_name string, r_name string, l_ori string, r_ori string, pairs long, mean_distance double")
    seqs = spark.createDataFrame([("a", "TTTTACGTACGG"), ("b", "ACGTACGGCC")], "name string, seq string")
    out = checked_links(links, seqs)
    assert "Python" not in out.where("kept")._jdf.queryExecution().executedPlan().toString()
    assert {(r.l_name, r.overlap, r.kept) for r in out.collect()} == {("a", 8, True), ("b", 0, True)}


def test_flanks_are_aligned_once(spark):
    """Picking asks for either side's alignments, which are made once."""
    flanks = spark.createDataFrame([("g", "ACGTTGCAACGGATCC", "TTTACGGGTCATTCAG")], "gap_id string, left string, right string")
    contigs = spark.createDataFrame([("g", "c", "ACGTTGCAACGGATCCAAAAAATTTACGGGTCATTCAG")], "gap_id string, name string, seq string")
    out = P.align_flanks(flanks, contigs, 12)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.side, r.flag, r.pos, r.cigar) for r in out.collect()} == {("left", 0, 1, "16M"), ("right", 0, 23, "16M")}
