"""Joins: the central selectors on worked examples and against loops."""

import random

from pyspark.sql import functions as F

from seqloom.operators import joins as J

READ = "aln_id long, lib_id int, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int"


def test_read_selector(spark):
    reads = [
        (1, 1, "r1", 65, "s", 900, 40, "80M20S", "=", 0, 500), (2, 1, "r2", 129, "s", 1400, 60, "100M", "scfB", 0, 0), (3, 1, "r3", 73, "s", 1150, 10, "20S80M", "=", 0, 0),
        (4, 1, "r4", 65, "s", 550, 60, "100M", "=", 0, 9999), (5, 1, "r5", 65, "s", 551, 60, "100M", "=", 0, 9999), (6, 1, "r6", 65, "s", 700, 29, "100M", "=", 0, 9999),
        (7, 1, "r7", 65, "s", 900, 60, "100M", "=", 0, 300), (8, 1, "r8", 65, "s", 900, 60, "100M", "=", 0, 150), (9, 1, "r9", 65, None, 900, 60, "100M", "=", 0, 150), (10, 1, "r10", None, "s", None, None, None, None, None, None),
    ]
    gaps = spark.createDataFrame([("g", "s", 1000, 1100, 100)], "gap_id string, scaffold string, gap_start int, gap_end int, gap_len int")
    libs = spark.createDataFrame([(1, 300, 50)], "lib_id int, insert_mean int, insert_sd int")
    got = {(r.qname, r.kind, r.mate) for r in J.select_reads(spark.createDataFrame(reads, READ), gaps, libs, 450).collect()}
    assert got == {("r1", "clip", 1), ("r1", "discordant", 2), ("r2", "discordant", 1), ("r3", "clip", 1), ("r3", "unmap", 2), ("r5", "discordant", 2), ("r8", "discordant", 2)}


def test_asof(spark):
    points = spark.createDataFrame([(i, "s", p) for i, p in enumerate([800, 801, 1000, 1001, 1299, 1499, 1500])], "id int, k string, pos int")
    anchors = spark.createDataFrame([("s", 1000), ("s", 1200), ("s", 1200)], "k string, place int")
    got = {r.pos: r.place for r in J.asof_largest(points, anchors, "k", "id", "pos", "place", 199, 299).collect()}
    assert got == {801: 1000, 1000: 1000, 1001: 1200, 1299: 1200, 1499: 1200}


def test_asof_is_the_overwritten_dictionary(spark):
    rng = random.Random(4)
    places = sorted(rng.sample(range(5000), 40))
    cover = {}
    for p in places:
        for x in range(p - 199, p + 300):
            cover[x] = p
    points = spark.createDataFrame([(i, "s", i * 13) for i in range(400)], "id int, k string, pos int")
    got = {r.pos: r.place for r in J.asof_largest(points, spark.createDataFrame([("s", p) for p in places], "k string, place int"), "k", "id", "pos", "place", 199, 299, width=100).collect()}
    assert got == {i * 13: cover[i * 13] for i in range(400) if i * 13 in cover}


def test_range_join(spark):
    rng = random.Random(2)
    points = [(i, rng.choice(["a", "b", None]), rng.choice([None, rng.randint(-50, 300)])) for i in range(120)] + [(0, "a", 5)]
    ranges = [(j, rng.choice(["a", "b", None]), lo, lo + rng.randint(-3, 80)) for j in range(40) for lo in [rng.randint(-60, 300)]]
    got = sorted((r.i, r.j) for r in J.range_join(spark.createDataFrame(points, "i int, k string, p int"), spark.createDataFrame(ranges, "j int, k string, lo int, hi int"), "k", "p", "lo", "hi", width=16).collect())
    assert got == sorted((i, j) for i, k, p in points for j, k2, lo, hi in ranges if k is not None and k == k2 and p is not None and lo <= p <= hi)


def test_bridges(spark):
    rows = [("g", "c1", "left", "UNCLIP", 1, 100, 0), ("g", "c1", "right", "LEFT", 300, 90, 0), ("g", "c1", "right", "UNCLIP", 310, 95, 16), ("g", "c2", "left", "LEFT", 1, 50, 0), ("g", "c2", "right", "LEFT", 9, 50, 0), ("g", "c3", "left", "RIGHT", 5, 40, 16), ("g", "c3", "right", "LEFT", 1, 40, 16)]
    got = J.bridging_hits(spark.createDataFrame(rows, "gap_id string, contig string, side string, clip string, pos int, matched int, flag int")).collect()
    assert sorted((r.contig, r.sum, r.r_clip) for r in got) == [("c1", 190, "LEFT"), ("c3", 80, "LEFT")]


def test_rescue_and_remaining(spark):
    a = spark.createDataFrame([("q1", 1, "g1", 8, None), ("q2", 1, "g1", 0, "="), ("q3", 2, "g1", 0, "g2"), ("q4", 1, "g1", 0, "g1"), ("q5", 1, "g1", 8, None)], "qname string, mate int, gap_id string, flag int, mate_gap string")
    pairs = spark.createDataFrame([("q1", 2), ("q2", 2), ("q3", 1), ("q4", 2)], "qname string, mate int")
    assert sorted(map(tuple, J.rescue_mates(a, pairs).collect())) == [("q1", 2, "g1"), ("q3", 1, "g1")]
    gaps = spark.createDataFrame([("1_2",), ("1_3",)], "gap_id string")
    assert [r.gap_id for r in J.remaining(gaps, spark.createDataFrame([("1_2_NODE_7",)], "name string")).collect()] == ["1_3"]


def test_pairs_and_links(spark):
    reads = spark.createDataFrame([("q", 1, "A"), ("q", 2, "C"), ("r", 1, "G")], "qname string, mate int, seq string")
    assert [tuple(r) for r in J.pair_up(reads).collect()] == [("q", "A", "C")]
    links = spark.createDataFrame([("x", "+", "y", "-", 3), ("x", "+", "z", "+", 1)], "a string, a_ori string, b string, b_ori string, n int")
    assert sorted(map(tuple, J.symmetric_links(links, 2).collect())) == [("x", "y_R"), ("y_R", "x")]
    d = J.dispatch(reads.select("qname", "mate", "seq"), spark.createDataFrame([("q", 1, "g1"), ("q", 1, "g1"), ("q", 1, "g2")], "qname string, mate int, gap_id string"))
    assert d.count() == 2
    assert d.where(F.col("gap_id") == "g2").count() == 1


def test_a_salted_side_is_not_broadcast(spark, monkeypatch):
    """Rows repeated for salts are many more than the file they come from tells."""
    from seqloom import records

    monkeypatch.setattr(records, "FEW", 10)
    for n in (50, 2000):
        right = records.cut(spark.range(n).selectExpr("id AS k", "id AS v"))
        out = records.beside(spark.range(300).selectExpr("id % 100 AS k", "id AS uid"), right, ["k"])
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 3 * min(n, 100)
