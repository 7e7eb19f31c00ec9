"""Evaluation, lists of reads, numbers of names, walks, extension, seeded numbers: small dirty tables."""

import random

from pyspark.sql import functions as F

from seqloom.functions.seq import uniform
from seqloom.operators import align, evaluate, graph
from seqloom.plans import pipeline as P
from seqloom.sources import sinks, text


def test_hits(spark):
    rows = [("a", "0_1_x", "50M"), ("b", "0_1_x", "30S20M"), ("c", "0_2_y", "25S25M"), ("d", "9_9_z", "50M"), ("e", None, "50M"), ("f", "0_2_y", None), (None, "0_2_y", "*")]
    alns = spark.createDataFrame(rows, "qname string, rname string, cigar string")
    hits = evaluate.hit_list(alns)
    assert sorted(r["id"] for r in hits.collect()) == ["0_1_x", "9_9_z"]
    gaps = spark.createDataFrame([("0_1", 40), ("0_2", 7)], "gap_id string, gap_len int")
    assert [tuple(r) for r in evaluate.closed_gaps(hits, gaps).collect()] == [("0_1_x", "0_1", 40)]
    assert tuple(evaluate.hits_and_sequences(alns).first()) == (2, 6) and tuple(evaluate.hits_and_sequences(alns.where("false")).first()) == (0, 0)


def test_truth_and_cover(spark):
    t = "ACGTTGCAAGGCTTAACCGGATATCGCGTTAA"
    picked = spark.createDataFrame([("g", "p", t[4:20]), ("g", "r", "".join(dict(zip("ACGT", "TGCA"))[c] for c in reversed(t))), ("h", "q", t), ("g", "n", None)], "gap_id string, name string, seq string")
    got = {r["name"]: r for r in evaluate.against_truth(picked, spark.createDataFrame([("g", t), ("i", "")], "gap_id string, seq string")).collect()}
    assert set(got) == {"p", "r"} and got["p"]["covered"] == 0.5 and got["p"]["true_start"] == 5 and got["r"]["reverse"] and got["r"]["covered"] == 1.0
    hits = spark.createDataFrame([("a", "b", 1, 91), ("a", "a", 1, 100), ("b", "a", 1, 50), ("x", "a", 1, 9)], "query string, subject string, q_start int, q_end int")
    lengths = spark.createDataFrame([("a", 100), ("b", 100)], "name string, length int")
    assert [r["name"] for r in evaluate.covering_queries(hits, lengths, 0.9).collect()] == ["a"]


def test_stretches_between_flanks(spark):
    rows = [(1, "0_1", 10, True), (2, "0_1", 400, True), (3, "0_2", 900, True), (4, "0_2", 950, True), (5, "1_1", 5, False), (6, "1_1", 700, False), (7, None, 3, True), (8, "0_1", 20, True), (9, "0_1", 500, True), (10, "2_1", None, True)]
    df = spark.createDataFrame(rows, "o long, gap string, pos int, own boolean")
    assert sorted(map(tuple, evaluate.filled_stretches(df, "o", "gap", "pos", "own").collect())) == [("0_1", 315, 500)]


def test_lists_and_ids(spark, tmp_path):
    (tmp_path / "l.txt").write_text("r1 3 left discordant 120 = 77 50\nr2 4 right discordant 9 s2 5 8\nr3 3\n\nr4 1 left clip\nr5 5 left discordant 1 = 77 9\n")
    reads = text.gap_reads(spark, str(tmp_path / "l.txt"))
    assert [(r["qname"], r["gap_ord"], r["kind"]) for r in reads.orderBy("qname").collect()] == [("r1", 3, "discordant"), ("r2", 4, "discordant"), ("r3", 3, None), ("r4", 1, "clip"), ("r5", 5, "discordant")]
    assert sorted((r["rname"], r["place"], r["gaps"]) for r in text.discordant_places(reads, F.lit("s1")).collect()) == [("s1", 77, ["s1_3", "s1_5"]), ("s2", 5, ["s1_4"])]
    ids = text.ids_of(spark.createDataFrame([(30, "b"), (10, "c"), (20, "a b")], "ord int, name string"))
    sinks.write_id_names(ids, str(tmp_path / "ids"))
    assert sorted(map(tuple, text.id_names(spark, str(tmp_path / "ids")).collect())) == [(0, "c"), (1, "a b"), (2, "b")]


def test_walks_go_all_the_way(spark):
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(55)] + [("n000", None), ("x", "y"), ("y", "x")], "a string, b string")
    assert graph.reach(chain.limit(54), spark.createDataFrame([("n000",)], "node string"), "a", "b").agg(F.max("depth")).first()[0] == 54
    assert {r["component"] for r in graph.weak_components(chain, "a", "b").collect()} == {"n000", "x"}
    fork = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("d", "b"), ("c", "e"), ("a", "b"), (None, "a")], "s string, t string")
    assert sorted(tuple(r["path"]) for r in graph.maximal_paths(fork, "s", "t", 4).collect()) == [("a", "b", "c", "e"), ("a", "b", "d")]
    assert sorted(tuple(r["path"]) for r in graph.maximal_paths(fork, "s", "t", 3).collect()) == [("a", "b", "c"), ("a", "b", "d")]
    assert graph.maximal_paths(fork.where("false"), "s", "t").count() == 0


def test_a_large_group_comes_out_as_it_is(spark):
    df = spark.createDataFrame([("g", "a", "ACGT" * 20), ("g", "b", "TTGA" * 20)], "g string, n string, s string")
    assert sorted((r["name"], r["reason"]) for r in graph.merge_contigs(df, "g", "n", "s", most_bases=100).collect()) == [("a", "too many bases"), ("b", "too many bases")]


def brute_extension(a, b, mismatch=-2, indel=-2):
    t = {(0, 0): 0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                ways = []
                if i and j:
                    ways.append(t[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else mismatch))
                if i:
                    ways.append(t[i - 1, j] + indel)
                if j:
                    ways.append(t[i, j - 1] + indel)
                t[i, j] = max(ways)
    return max((s, -i, -j) for (i, j), s in t.items())


def test_extension_and_band():
    rng = random.Random(1)
    for _ in range(60):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 30)))
        b = a[: rng.randint(0, 30)] + "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 10)))
        e = align.extension(a, b)
        assert (e.score, -e.first_end, -e.second_end) == brute_extension(a, b)
        assert align.extension(a, b, band=40) == e
    long = "".join(rng.choice("ACGT") for _ in range(30_000))
    other = long[:9000] + "ACG" + long[9000:20_000] + long[20_005:]
    score, cigar = align.global_cigar(long, other)
    assert cigar.count("M") >= 3 and sum(int(x) for x in cigar.replace("I", "M").replace("D", " ").replace("M", " ").split()) > 0 and score > 29_000


def test_seeded_numbers(spark):
    x = spark.range(4000).select(uniform(7, F.col("id")).alias("u"), uniform(8, F.col("id")).alias("v"))
    r = x.agg(F.min("u"), F.max("u"), F.avg("u"), F.count_if(F.col("u") == F.col("v"))).first()
    assert 0 <= r[0] and r[1] < 1 and abs(r[2] - 0.5) < 0.02 and r[3] == 0
    assert x.collect() == x.repartition(5).sort("u").union(x.limit(0)).collect() or sorted(x.collect()) == sorted(x.repartition(3).collect())


def test_reads_of_no_scaffold_are_rescued(spark):
    rng = random.Random(6)
    c = "".join(rng.choice("ACGT") for _ in range(200))
    other = "".join(rng.choice("ACGT") for _ in range(80))
    rows = [("p", 1, c[20:100]), ("p", 2, other), ("q", 1, other[::-1]), ("q", 2, None), ("r", 1, c[:70]), ("r", 2, c[90:170])]
    got = P.rescued_reads(spark.createDataFrame(rows, "qname string, mate int, seq string"), spark.createDataFrame([("g", "c1", c)], "gap_id string, name string, seq string"))
    assert sorted(r["seq"] for r in got.collect()) == sorted([c[20:100], other, c[:70], c[90:170]])
