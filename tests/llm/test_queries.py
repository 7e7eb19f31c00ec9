"""Queries p3 to p8 on small dirty tables."""

import datetime
import random

import pytest

from seqloom.llm import queries as Q

T0 = datetime.datetime(2024, 1, 1)
ALN = "aln_id long, bam string, lib_id int, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, loaded_at timestamp_ntz"
CTG = "rec_id long, qname string, gap_id string, flag int, rname string, pos int, mapq int, cigar string, seq string, loaded_at timestamp_ntz"
DOC = "doc_id long, text string, lang string, source string, n_chars long, project string, created_at timestamp_ntz, loaded_at timestamp_ntz"


def aln(i, flag=0, rname="s", tlen=0, seq=None, late=0, bam="b"):
    return (i, bam, 1, "q", flag, rname, 1, 60, "4M", "=", 1, tlen, seq, "*", T0 + datetime.timedelta(hours=late))


@pytest.fixture
def folder(spark, tmp_path):
    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def test_p3(spark, folder):
    rng = random.Random(1)
    s = "".join(rng.choice("ACGT") for _ in range(200))
    c = lambda i, seq, late=0: (i, "n", None, 0, None, None, 60, None, seq, T0 + datetime.timedelta(hours=late))
    rows = [c(1, s), c(1, s, 4), c(2, s[50:110].lower()), c(3, s[:47]), c(4, "*"), c(5, None), c(6, ""), c(7, s[120:170] + "N" + s[171:]), c(None, s)]
    d = folder(contig_alns=(rows, CTG))
    assert sorted(map(tuple, Q.p3_found(spark, d).collect())) == [(1, 50, 60), (1, 120, 50), (2, 0, 60), (7, 0, 50)]
    assert {r.rec_id: (r.bases, r.shared, r.spans) for r in Q.p3_shared(spark, d).where("rec_id IS NOT NULL").collect()} == {1: (200, 110, 2), 2: (60, 60, 1), 3: (47, 0, 0), 4: (0, 0, 0), 5: (0, 0, 0), 6: (0, 0, 0), 7: (80, 50, 1)}
    assert Q.p3_found(spark, folder(contig_alns=([], CTG))).count() == 0


def test_p4(spark, folder):
    rows = [aln(i, rname="a x", tlen=-400 if i % 2 else 500) for i in range(40)] + [aln(100 + i, rname="b", tlen=1200 if i < 3 else 100) for i in range(40)] + [aln(200 + i, rname="c", tlen=900) for i in range(39)]
    rows += [aln(239, rname="c", tlen=t) for t in (0,)] + [aln(240, rname="c", tlen=2147483647), aln(241, rname="c", tlen=-2147483648), aln(242, rname="c", tlen=None), aln(243, flag=4, rname="c", tlen=900), aln(200, rname="c", tlen=900, late=2), aln(300, rname=None, tlen=900), aln(301, flag=None, rname="c", tlen=900)]
    d = folder(alignments=(rows, ALN))
    assert {tuple(r) for r in Q.p4_found(spark, d).collect()} == {("a", 50), ("b", 95)}
    assert {r.n for r in Q.p4_quantiles(spark, d).where("rname = 'c'").collect()} == {39}
    assert {(r.bam, r.n) for r in Q.p4_by_bam(spark, d).collect()} == {("b", 119)}
    assert Q.p4_found(spark, folder(alignments=([], ALN))).count() == 0


def test_p5(spark, folder):
    rows = [aln(i, seq="ACGTACGTACGT") for i in range(500)] + [aln(0, seq="ACGTACGTACGT", late=1), aln(600, seq="ttttttttttt"), aln(601, seq="TTTTTNTTTTTTTTTT"), aln(602, seq="*"), aln(603, seq=None), aln(604, seq=""), aln(605, seq="GGGGGGGGGGGG")]
    d = folder(alignments=(rows, ALN))
    got = {r.kmer: (r.occurrences, r.records, r.mark) for r in Q.p5_counts(spark, d).collect()}
    assert got == {"ACGTACGTAC": (500, 500, "common"), "CGTACGTACG": (500, 500, "common"), "GTACGTACGT": (500, 500, "common"), "TTTTTTTTTT": (3, 2, "common"), "GGGGGGGGGG": (3, 1, "rare")}
    assert Q.p5_found(spark, folder(alignments=([], ALN))).count() == 0


def doc(i, text, source="forum"):
    return (i, text, "en", source, None, "p", None, T0)


def test_p6_p7(spark, folder):
    rows = [doc(1, "Hello world"), doc(2, None), doc(3, ""), doc(4, "word " * 50, " FORUM "), doc(5, "word " * 200, "Wiki"), doc(6, "text", None)]
    targets = ([("forum", 0.5, 1), ("wiki", 0.4, 2), ("none", 0.1, 9)], "source string, weight double, max_repeats int")
    d = folder(documents=(rows, DOC), mix_targets=targets)
    got = {r.doc_id: r.ids for r in Q.p6_ids(spark, d).collect()}
    assert got[1] == [15496, 995] and got[2] == got[3] == [] and len(got) == 6
    assert {r.source for r in Q.p7_found(spark, d).collect()} == {"forum", "none"}
    assert Q.p7_mix(spark, d).count() >= 0
    d = folder(documents=([], DOC), mix_targets=targets)
    assert Q.p6_ids(spark, d).count() == 0 and Q.p7_found(spark, d).count() == 0


def test_p8(spark, folder):
    rows = [doc(i, f"The gap {i} closed. The flank {i} stays open.") for i in range(40)] + [doc(100, "The gap 5 closed. The fla", " Wiki"), doc(101, None), doc(102, " ")]
    d = folder(documents=(rows, DOC))
    assert [r.doc_id for r in Q.p8_found(spark, d).collect()] == [100]
    assert {r.source: (r.texts, r.cut) for r in Q.p8_sources(spark, d).collect()} == {"forum": (41, 0), "wiki": (1, 1)}
    d = folder(documents=([], DOC))
    assert Q.p8_found(spark, d).count() == 0 and Q.p8_sources(spark, d).count() == 0
