"""Queries p1 and p2 on small dirty tables."""

import datetime
from collections import Counter

import pytest

from seqloom.queries import problems as P

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "aln_id long, bam string, lib_id int, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, loaded_at timestamp_ntz"


def row(i, bam="b", flag=0, rname="s", pos=1, cigar="10M", late=0, tlen=0, seq="ACGT"):
    return (i, bam, 1, f"q{i}", flag, rname, pos, 60, cigar, "=", 1, tlen, seq, "*", T0 + datetime.timedelta(hours=late))


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(str(tmp_path / "alignments.parquet"))
        return str(tmp_path)

    return write


def test_periods(spark, folder):
    rows = [row(1), row(1, late=5), row(2, pos=11), row(3, pos=25, cigar="3S5M2D3M"), row(4, rname="s more", pos=40, cigar="2H3=1X"), row(5, flag=4, pos=100), row(6, rname=None), row(7, rname="*"), row(8, pos=0), row(9, pos=None),
            row(10, cigar=None), row(11, cigar="*"), row(12, cigar=""), row(13, cigar="M10"), row(14, cigar="5S"), row(15, flag=None, pos=70), row(16, bam=None, pos=7, cigar="1M"), row(17, pos=60, cigar="10m")]
    got = {tuple(r) for r in P.p1_found(spark, folder(rows)).collect()}
    assert got == {("b", "s", "period", 1, 20), ("b", "s", "gap", 21, 24), ("b", "s", "period", 25, 34), ("b", "s", "gap", 35, 39), ("b", "s", "period", 40, 43), (None, "s", "period", 7, 7)}


def test_modes(spark, folder):
    rows = [row(i, pos=p) for i, p in enumerate([5, 5, 3, 3, 9])] + [row(0, pos=5, late=3)] + [row(20, rname="t x", pos=7, flag=4), row(21, rname="u", pos=0), row(22, rname=None, pos=3), row(23, rname="v", pos=None)] + [row(None, pos=9), row(None, pos=9)]
    d = folder(rows)
    assert {tuple(r) for r in P.p2_found(spark, d).collect()} == {("s", 9), ("t", 7)}
    q = {(r.rname, r.q): r.pos for r in P.p2_quantiles(spark, d).collect()}
    assert q["s", 0.5] == 5 and q["s", 0.95] == 9 and q["t", 0.25] == 7


def test_empty_tables(spark, folder):
    d = folder([])
    assert P.p1_found(spark, d).count() == P.p2_found(spark, d).count() == P.p2_quantiles(spark, d).count() == 0


def test_many_ties(spark, folder):
    rows = [row(i, pos=i % 50 + 1) for i in range(500)]
    assert [tuple(r) for r in P.p2_found(spark, folder(rows)).collect()] == [("s", 1)] and max(Counter(r[6] for r in rows).values()) == 10
