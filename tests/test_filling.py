"""The gap-filling run: gaps worked on at once and those whose k-mers are rows, and joins that don't pass through the driver."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import pick
from seqloom.operators.align import local, locals_of, revcomp
from seqloom.plans import pipeline as P


def _planted(n=4):
    rng = random.Random(7)
    seqs = ["".join(rng.choice("ACGT") for _ in range(320)) for _ in range(n)]
    return [(str(i), r) for i, s in enumerate(seqs) for r in ([s, s.lower()] if i % 2 else [s[:150], s[:150], s[130:], s[130:], s[120:160] + "N" + s[:50], None])]


@pytest.mark.parametrize("ks", [[31], [15, 31]])
def test_gaps_of_any_size_give_the_same_contigs(spark, ks):
    reads = spark.createDataFrame(_planted(), "gap_id string, seq string")
    one, rows = (sorted(map(tuple, P.assemble(reads, ks, 2, at_once=n).collect())) for n in (1 << 17, 0))
    assert one == rows and {r[0] for r in one} == {"0", "1", "2", "3"}


def test_merged_ones_of_any_size_are_the_same(spark):
    contigs = spark.createDataFrame([(g, f"{i:02d}", s) for i, (g, s) in enumerate(_planted())], "gap_id string, name string, seq string")
    one, rows = (sorted(map(tuple, P.merged_ones(contigs, at_once=n).collect())) for n in (1 << 17, 0))
    assert one == rows and {r[0] for r in one} == {"0", "2"}


def test_a_sequence_within_another_aligns_at_its_first_place():
    rng = random.Random(3)
    s = "".join(rng.choice("ACGT") for _ in range(60))
    pairs = [(s[5:30], s + s), (s[5:30].lower(), "n" + s), ("AAA", "CAAAAC"), ("ANA", "CANAC"), (s, s[10:20]), (s, "ß" + s)]
    assert locals_of(pairs) == [local(*p) for p in pairs]
    assert locals_of([(revcomp(s), s), ("", s)]) == [local(revcomp(s), s), local("", s)]


def test_no_join_of_the_run_is_broadcast(spark):
    """Tables that grow with the gaps would be held whole by the driver, however few bytes their files have."""
    contigs = spark.createDataFrame([("1", "a", "ACGT" * 30)], "gap_id string, name string, seq string")
    flanks = spark.createDataFrame([("1", "ACGT" * 10, "ACGT" * 10)], "gap_id string, left string, right string")
    gaps = spark.createDataFrame([("1", "x", 40, 80)], "gap_id string, scaffold string, gap_start int, gap_end int")
    scaffolds = spark.createDataFrame([("x", "ACGT" * 10 + "N" * 40 + "ACGT" * 10)], "name string, seq string")
    named, hits = contigs.withColumnRenamed("name", "contig"), P.align_flanks(flanks, contigs)
    fills = pick.pick_bridging(hits, named)
    for df in (P.flank_pairs(scaffolds, gaps), P.merged_ones(contigs), P.merged_ones(contigs, 0), fills, pick.pick_extended(hits, named), pick.splice_gaps(scaffolds, gaps, fills.select("gap_id", F.col("fill")))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
