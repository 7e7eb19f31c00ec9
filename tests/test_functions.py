"""Scalar functions: known answers and restatements in Python."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import cigar as C
from seqloom.functions import flags as B
from seqloom.functions import seq as S


def values(spark, column, rows, schema="x string"):
    return [r.v for r in spark.createDataFrame(rows, schema).coalesce(1).select(column.alias("v")).collect()]


def test_clips(spark):
    rows = [("100M", 0, "UNCLIP", 100), ("10S90M", 1, "LEFT", 90), ("90M10S", 2, "RIGHT", 90), ("5S90M5H", 3, "BOTH", 90), ("50M2D48M", 0, "UNCLIP", 98), ("*", 0, None, 0), (None, None, None, None)]
    c = F.col("x")
    got = [tuple(r) for r in spark.createDataFrame([(r[0],) for r in rows], "x string").coalesce(1).select("x", F.when(c.isNotNull(), C.clip_code(c)), C.clip_type(c), C.matched(c)).collect()]
    assert got == rows


def test_mapped(spark):
    rows = [("100M", True, True), ("99M1S", False, False), ("60M5D40M", True, False), ("80M", True, False)]
    c = F.col("x")
    got = [tuple(r) for r in spark.createDataFrame([(r[0],) for r in rows], "x string").coalesce(1).select("x", C.is_fully_mapped(c, 0.99, F.lit(100)), C.is_perfectly_mapped(c, F.lit(100))).collect()]
    assert got == rows


def test_cigar_validity_and_span(spark):
    rows = ["100M", "M100", "101", "", "*", "-101M", "50M50", "101m", "3S7M2D1N4=1X5I2H", "99999999999999999999M", "0M"]
    c = F.col("x")
    got = {r.x: (r.ok, r.span) for r in spark.createDataFrame([(r,) for r in rows], "x string").select("x", C.is_valid(c).alias("ok"), F.when(C.is_valid(c), C.reference_span(c)).alias("span")).collect()}
    assert got == {"100M": (True, 100), "M100": (False, None), "101": (False, None), "": (False, None), "*": (False, None), "-101M": (False, None), "50M50": (False, None), "101m": (False, None), "3S7M2D1N4=1X5I2H": (True, 15), "99999999999999999999M": (True, None), "0M": (True, 0)}


def test_parse_render(spark):
    assert values(spark, C.render(C.parse(F.col("x"))), [("10S90M2D5=",), ("*",)]) == ["10S90M2D5=", ""]


def test_clip_positions(spark):
    got = values(spark, C.clip_positions(F.lit(100), F.col("x")), [("10S90M",), ("90M10H",), ("5S80M2D5S",), ("90M",)])
    assert [tuple(g) for g in got] == [("LS", 100, -1), ("RH", -1, 190), ("B", 100, 182), ("N", -1, -1)]


def test_read_classes(spark):
    rows = [(0, "100M", "FULLMAP"), (0, "50S50M", "CLIP"), (0, "50M50I", "OTHER"), (2048, "50H50M", "CLIP"), (2048, "50S50M", "OTHER"), (4, "*", "UNMAP_MATE"), (12, None, "UNMAP_BOTH")]
    df = spark.createDataFrame([r[:2] for r in rows], "f int, c string").coalesce(1)
    assert [r.v for r in df.select(B.read_class(F.col("f"), F.col("c")).alias("v")).collect()] == [r[2] for r in rows]
    assert [r.v for r in df.select(B.pair_class(F.col("f")).alias("v")).collect()] == ["11"] * 5 + ["01", "00"]


def reference_gaps(s):
    """The rule as a loop."""
    out, i = [], 0
    while (a := s.find("N", i)) >= 0:
        e = a
        while e < len(s) and s[e] not in "ACGT":
            e += 1
        if e == len(s):
            break
        out.append((a, e))
        i = e + 2
    return out


def test_gaps(spark):
    assert reference_gaps("ACGTNNNNACNGTANNNaNNCNNN") == [(4, 8), (10, 11), (14, 20)] and reference_gaps("NNANNC") == [(0, 2), (4, 5)]
    rng = random.Random(5)
    rows = ["ACGTNNNNACNGTANNNaNNCNNN", "NNANNC", "ACGT", "NNNN", "", None] + ["".join(rng.choice("ACGTNNacgtRN") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    got = values(spark, S.gaps(F.col("x")), [(r,) for r in rows])
    assert [None if g is None else [tuple(x) for x in g] for g in got] == [None if r is None else reference_gaps(r) for r in rows]


def test_flanks(spark):
    seq = "abcdefghijklmnopqrstuvwxyz" * 3
    got = [tuple(r.v) for r in spark.createDataFrame([(seq, 20, 30), (seq, 10, 30), (seq, 3, 8)], "s string, a int, b int").coalesce(1).select(S.flanks(F.col("s"), F.col("a"), F.col("b"), 12).alias("v")).collect()]
    assert got == [(seq[8:15], seq[35:42]), (seq[0:5], seq[35:42]), ("", seq[13:20])]


def test_complement(spark):
    assert values(spark, S.reverse_complement(F.col("x")), [("ACGTacgtNR",), (None,)]) == ["RNACGTACGT", None]
    assert values(spark, S.reverse_complement(F.col("x"), "n"), [("ACGTNR",)]) == ["NNACGT"]
    assert values(spark, S.reverse_complement(S.reverse_complement(F.col("x"))), [("GATTACA",)]) == ["GATTACA"]


def test_kmers(spark):
    assert values(spark, S.kmers(F.col("x"), 3), [("ACGTA",), ("AC",), ("",), (None,)]) == [["ACG", "CGT", "GTA"], [], [], None]
    assert values(spark, S.unpack_kmer(S.pack_kmer(F.col("x")), 7), [("GATTACA",), ("NNNNNNN",)]) == ["GATTACA", "AAAAAAA"]
    assert values(spark, S.roll_kmer(S.pack_kmer(F.col("x")), F.lit("G"), 4), [("ACGT",)]) == values(spark, S.pack_kmer(F.col("x")), [("CGTG",)])
    assert sorted(values(spark, S.neighbours(F.col("x")), [("AC",)])[0]) == sorted(["CC", "GC", "TC", "AA", "AG", "AT"])
    assert values(spark, S.shifted(F.col("x")), [("AC",)])[0] == ["CA", "CC", "CG", "CT", "AA", "CA", "GA", "TA"]


@pytest.mark.parametrize(("parity", "want"), [(False, "AAAAGGCCCC"), (True, "AAAAGGCCC")])
def test_splice(spark, parity, want):
    fills = F.array(F.struct(F.lit(4).alias("gap_start"), F.lit(8).alias("gap_end"), F.lit("GG").alias("fill")))
    assert values(spark, S.splice(F.col("x"), fills, parity), [("AAAANNNNCCCC",)]) == [want]


def test_splice_leaves_unfilled_gaps(spark):
    fills = F.array(F.struct(F.lit(1).alias("gap_start"), F.lit(3).alias("gap_end"), F.lit(None).cast("string").alias("fill")), F.struct(F.lit(4).alias("gap_start"), F.lit(6).alias("gap_end"), F.lit("TT").alias("fill")))
    assert values(spark, S.splice(F.col("x"), fills), [("ANNCNNG",)]) == ["ANNCTTG"]


def test_small_ones(spark):
    assert values(spark, S.wrap(F.col("x"), 4), [("ACGTACGTA",), ("ACGT",), ("",)]) == ["ACGT\nACGT\nA", "ACGT", ""]
    assert values(spark, S.directional(F.col("x"), F.lit(2), F.lit(3), True), [("A-C-GT",)]) == ["CGT"]
    assert values(spark, S.directional(F.col("x"), F.lit(5), F.lit(2), False), [("A-C-GT",)]) == ["GC"]
    assert values(spark, S.base_code(F.col("x")), [("A",), ("t",), ("N",)]) == [0, 1, -1]
    assert values(spark, S.is_missing(F.col("x")), [("n",), ("A",)]) == [True, False]
    assert values(spark, S.is_gap(F.col("x")), [("-",), ("A",)]) == [True, False]
    assert values(spark, S.bridge_fill(F.col("x"), F.lit(1), F.lit(3), F.lit(8), F.lit(3), F.lit(False)), [("ACGTTTGGCA",)]) == ["TTTGG"]
    assert values(spark, S.contig_distance(F.lit(300), F.lit(500), F.lit(450), F.lit(20), 100), [("",)]) == [130]
