"""Readers and writers: round trips and odd input."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from seqloom.plans import config
from seqloom.sources import bam as B
from seqloom.sources import sinks as K
from seqloom.sources import text as R


def test_fasta_round_trip(spark, tmp_path):
    rows = [("a one", "ACGT" * 40), ("b", ""), ("c", "NNacgt")]
    K.write_fasta(spark.createDataFrame(rows, "name string, seq string").coalesce(1), str(tmp_path / "x"))
    got = R.fasta(spark, str(tmp_path / "x"), whole_header=True)
    assert sorted((r.name, r.seq) for r in got.collect()) == sorted(rows)
    assert sorted(r.name for r in R.fasta(spark, str(tmp_path / "x")).collect()) == ["a", "b", "c"]
    (tmp_path / "y.fa.gz").write_bytes(gzip.compress(b">x d\nAC GT\r\nac\n>y\nG\n"))
    assert [(r.name, r.seq) for r in R.fasta(spark, str(tmp_path / "y.fa.gz"), upper=True).orderBy("ord").collect()] == [("x", "ACGTAC"), ("y", "G")]
    assert R.both_strands(spark.createDataFrame([("a", "ACR")], "name string, seq string")).first().rc == "NGT"
    assert R.substring_of(got, "a one", 2, 3).first().seq == "GTA" and R.substring_of(got, "c", 4).first().seq == "gt"


def test_fasta_with_strange_letters_is_an_error(spark, tmp_path):
    (tmp_path / "z.fa").write_text(">a\nAC1T\n")
    with pytest.raises(Exception, match="not a sequence"):
        R.fasta(spark, str(tmp_path / "z.fa")).collect()


def test_fastq(spark, tmp_path):
    (tmp_path / "r.fq").write_text("".join(f"@r{i}/1 x\nACGT\n+\n@III\n" for i in range(50)))
    got = R.fastq(spark, str(tmp_path / "r.fq")).orderBy("ord").collect()
    assert [(r.read_id, r.seq, r.qual) for r in got] == [(f"r{i}", "ACGT", "@III") for i in range(50)]
    K.write_fastq_per_gap(spark.createDataFrame([("g1", "r", "AC", "II"), ("g2", "s", "GG", "*")], "gap_id string, read_id string, seq string, qual string"), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(["@r", "AC", "+", "II", "@s", "GG", "+", "55"])


def test_sam_and_bam(spark, tmp_path):
    rows = [("q1", 65, "s1", 10, 60, "5S10M", "=", 50, 90, "ACGTACGTACGTACG", "I" * 15), ("q2", 77, "*", 0, 0, "*", "*", 0, 0, "NNACG", "*"), ("q3", 1, "s2", 1, 3, "4M", "s1", 7, -5, "ACGT", "!!!!")]
    B.write_bam(str(tmp_path / "x.bam"), [("s1", 100), ("s2", 50)], rows)
    df = B.bam(spark, str(tmp_path / "*.bam"))
    assert [tuple(r) for r in df.collect()] == rows and B.references(str(tmp_path / "x.bam")) == [("s1", 100), ("s2", 50)]
    assert [r.qname for r in df.where("rname = 's2'").collect()] == ["q3"]
    (tmp_path / "x.sam").write_text("@SQ\tSN:1_2-c7\tLN:100\n" + "".join("\t".join(map(str, r)) + "\tNM:i:0\tXX:Z:1\n" for r in rows))
    got = R.sam(spark, str(tmp_path / "x.sam"))
    assert [tuple(r)[:11] for r in got.collect()] == rows and got.first().tags == "NM:i:0\tXX:Z:1"
    ref = R.sam_references(spark, str(tmp_path / "x.sam")).where("name <> ''")
    assert [tuple(r) for r in ref.select(R.gap_and_contig(F.col("name")).alias("x"), "length").select("x.*", "length").collect()] == [("1_2", "c7", 100)]
    assert [(r.read_id, r.mate) for r in R.both_unmapped(got).collect()] == [("q2_1", 1)]


def test_tables(spark, tmp_path):
    (tmp_path / "a.fai").write_text("elem7\t6021\t21\t70\t71\nX\t185\t7868\t70\t71\n")
    assert [(r.name, r.length) for r in R.fai(spark, str(tmp_path / "a.fai")).orderBy("ord").collect()] == [("elem7", 6021), ("X", 185)]
    (tmp_path / "g.txt").write_text("5 9 4 s one\n\n1\t2\t1\tt\n")
    assert [tuple(r) for r in R.gap_table(spark, str(tmp_path / "g.txt")).collect()] == [(5, 9, 4, "s"), (1, 2, 1, "t")]
    (tmp_path / "r.bed").write_text("a\nb 5\nc 2 9\n")
    assert [tuple(r) for r in R.regions(spark, str(tmp_path / "r.bed")).collect()] == [("a", None, None), ("b", 4, 5), ("c", 2, 9)]
    (tmp_path / "k.txt").write_text("ACG 3\nACG 9\nTTT 1\n")
    assert sorted(tuple(r) for r in R.kmer_table(spark, str(tmp_path / "k.txt")).collect()) == [("ACG", 3.0), ("TTT", 1.0)]
    link = "1\ta\t100\t+\t2\tb\t90\t-\t4\t1\t9\t5.5"
    (tmp_path / "l.txt").write_text(link + "\n")
    assert [r.mean_distance for r in R.links(spark, str(tmp_path / "l.txt")).collect()] == [5.5]
    (tmp_path / "m.txt").write_text(link + "\ttrue\t8\n")
    assert [(r.merged, r.overlap) for r in R.links(spark, str(tmp_path / "m.txt"), checked=True).collect()] == [(True, 8)]
    (tmp_path / "b.txt").write_text("q\ts\t99.5\t50\t0\t0\t1\t51\t3\t53\t1e-9\t80\nq\tq\t100\t60\t0\t0\t1\t60\t1\t60\t0\t99\n")
    hits = R.blast(spark, str(tmp_path / "b.txt"))
    lengths = spark.createDataFrame([("q", 60)], "query string, q_len int")
    assert [r.subject for r in hits.where("query <> subject").join(lengths, "query").where("(q_end - q_start) / q_len >= 0.8").collect()] == ["s"]


def test_text_sinks(spark, tmp_path):
    m = spark.createDataFrame([("m1", ["a", "b_R"])], "name string, path array<string>")
    assert K.provenance_lines(m).first().value == "m1  a b_R"
    n, e = spark.createDataFrame([(0, "a")], "id int, label string"), spark.createDataFrame([(0, 1, -5.0)], "source int, target int, weight double")
    assert [r.value for r in K.gml_lines(n, e).collect()] == ['node [ id 0 label "a" ]', "edge [ source 0 target 1 weight -5.0 ]"]
    K.write_gaps(spark.createDataFrame([(1, 5, 4, "s")], "gap_start int, gap_end int, gap_len int, scaffold string"), str(tmp_path / "g"))
    assert [tuple(r) for r in R.gap_table(spark, str(tmp_path / "g")).collect()] == [(1, 5, 4, "s")]
    K.write_partitioned(spark.createDataFrame([("s", 1, "q"), ("t", 2, "r")], "scaffold string, mate int, qname string"), str(tmp_path / "p"), "scaffold", "mate")
    assert spark.read.parquet(str(tmp_path / "p")).where("scaffold = 't'").first().qname == "r"
    K.write_flanks(spark.createDataFrame([("g", "left", "AC")], "gap_id string, side string, seq string"), str(tmp_path / "f"))
    assert [r.value for r in spark.read.text(str(tmp_path / "f")).select("value").collect()] == [">g_left", "AC"]
    K.write_subset(spark.createDataFrame([("a", "A"), ("b", "C")], "name string, seq string"), spark.createDataFrame([("a",)], "name string"), str(tmp_path / "s"))
    assert [r.name for r in R.fasta(spark, str(tmp_path / "s")).collect()] == ["b"]
    assert K.link_lines(spark.createDataFrame([("a", 1)], "x string, y int")).first().value == "a\t1"


def test_config():
    good = {"draft_genome": {"fa": "d.fa"}, "raw_reads": [{"left": "1", "right": "2"}], "alignments": [{"bam": "b", "is": "300", "std": "50"}], "parameters": {"nthreads": "15", "min_gap_size": "100"}, "kmer_length": [{"k": "30", "k_velvet": [{"k": "29"}, {"k": "27"}]}]}
    c = config.load(json.dumps(good))
    assert c.libraries[0].insert_mean == 300 and c.kmers == [(30, [29, 27])] and c.threads == 15
    with pytest.raises(ValueError, match="missing setting: draft_genome"):
        config.load(json.dumps({k: v for k, v in good.items() if k != "draft_genome"}))
    with pytest.raises(ValueError, match="read sets"):
        config.load(json.dumps(good | {"alignments": []}))
    with pytest.warns(UserWarning, match="both mates"):
        config.load(json.dumps(good | {"raw_reads": [{"left": "1", "right": "1"}]}))


def test_stream(spark, tmp_path):
    from seqloom.streaming.ingest import selected_stream

    schema = "aln_id long, lib_id int, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, loaded_at timestamp"
    import datetime

    row = (1, 1, "r1", 65, "s", 900, 40, "80M20S", "=", 0, 500, datetime.datetime(2024, 1, 1))
    spark.createDataFrame([row, row], schema).write.parquet(str(tmp_path / "in"))
    gaps = spark.createDataFrame([("g", "s", 1000, 1100, 100)], "gap_id string, scaffold string, gap_start int, gap_end int, gap_len int")
    libs = spark.createDataFrame([(1, 300, 50)], "lib_id int, insert_mean int, insert_sd int")
    out = selected_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, gaps, libs, 450)
    q = out.writeStream.format("memory").queryName("picked").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.kind for r in spark.table("picked").collect()) == ["clip", "discordant"]


def test_every_query_with_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "p1_found" in e.queries()
