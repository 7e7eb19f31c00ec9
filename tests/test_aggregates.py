"""Aggregations against loops and worked examples."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from seqloom.operators import aggregates as A


def test_depth_is_the_count_of_every_base(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), a, a + rng.randint(-1, 20)) for a in (rng.randint(0, 100) for _ in range(80))]
    want = Counter((e, x) for e, a, b in rows for x in range(a, b + 1))
    got = {(r.e, x): r.depth for r in A.depth_runs(spark.createDataFrame(rows, "e string, first long, last long"), ["e"]).collect() for x in range(r.first, r.last + 1)}
    assert got == dict(want)
    c = {r.e: (r.covered, r.bases) for r in A.coverage(spark.createDataFrame(rows, "e string, first long, last long"), ["e"]).collect()}
    assert c == {e: (sum(1 for k in want if k[0] == e), sum(n for k, n in want.items() if k[0] == e)) for e in "ab"}


def test_linkage(spark):
    rows = [("a", "b", "+", "-", d) for d in (10, 20, 30)] + [("a", "c", "+", "+", d) for d in (5, 7)] + [("x", "y", "+", "+", 1)]
    k = A.linkage(spark.createDataFrame(rows, "l_name string, r_name string, l_ori string, r_ori string, distance int"), 1)
    assert sorted((r.r_name, r.pairs, r.min_distance, r.max_distance, r.mean_distance) for r in k.collect()) == [("b", 3, 10, 30, 20.0), ("c", 2, 5, 7, 6.0)]
    assert [r.r_name for r in A.strong_links(k).collect()] == ["b", "c"]


def test_greedy(spark):
    rows = [("e", 0, 9), ("e", 5, 14), ("e", 9, 20), ("e", 15, 30)]
    assert [r.total for r in A.greedy_total(spark.createDataFrame(rows, "e string, first int, last int"), ["e"]).collect()] == [22]
    rng = random.Random(9)
    rows = [("e", a, a + rng.randint(0, 30)) for a in (rng.randint(0, 300) for _ in range(120))]
    end, total = -1, 0
    for b, a in sorted((b, a) for _, a, b in rows):
        if a >= end:
            end, total = b, total + b - a + 1
    assert A.greedy_total(spark.createDataFrame(rows, "e string, first int, last int"), ["e"]).first().total == total


def test_consensus(spark):
    rows = [("g", "ACGT", 1), ("g", "ACGA", 2), ("g", "TCGA", 1), ("t", "A", 1), ("t", "T", 1), ("n", None, 1)]
    assert {r.g: r.consensus for r in A.consensus(spark.createDataFrame(rows, "g string, s string, w int"), "g", "s", "w").collect()} == {"g": "ACGA", "t": "A"}


def test_ratio_keeps_what_has_no_reads(spark):
    rows = [("a", 0, "100M"), ("a", 0, "50S50M"), ("b", 4, "*"), ("c", 0, "100M")]
    got = {r.c: (r.ratio, r.keep) for r in A.clip_ratio(spark.createDataFrame(rows, "c string, flag int, cigar string"), "c", 0.85).collect()}
    assert got == {"a": (0.5, False), "b": (None, True), "c": (1.0, True)}


def test_first_wins(spark):
    rows = [("a", 5, 2), ("a", 5, 1), ("a", 4, 0), ("b", None, 7)]
    assert sorted((r.g, r.o) for r in A.best_hits(spark.createDataFrame(rows, "g string, s int, o int"), ["g"], "s", "o").collect()) == [("a", 1), ("b", 7)]


def test_longest_paths_are_k_plus_one(spark):
    rows = [("r", i, f"p{i:02}") for i in range(30)]
    assert A.longest_per_root(spark.createDataFrame(rows, "root string, length int, name string"), "root", "length", "name", 20).count() == 21


def test_consecutive_rows(spark):
    rows = [(0, "g", "left"), (1, "g", "right"), (2, "g", "right"), (4, "g", "left"), (3, "h", "left"), (5, "g", "right")]
    got = A.consecutive_pairs(spark.createDataFrame(rows, "o int, gap string, side string"), "o", ["gap"], "side")
    assert sorted((r.before_o, r.o) for r in got.collect()) == [(0, 1), (4, 5)]


def test_latest(spark):
    from seqloom.records import latest, reference_name

    rows = [(1, "a", 1), (1, "b", 2), (None, "c", 1), (None, "c", 1), (2, None, None), (2, "x", 1)]
    df = spark.createDataFrame(rows, "id int, v string, loaded_at int")
    assert sorted(map(str, ((r.id, r.v) for r in latest(df, "id", ["id", "v"]).collect()))) == sorted(map(str, [(1, "b"), (2, "x"), (None, "c"), (None, "c")]))
    assert latest(df.limit(0), "id", ["id"]).count() == 0
    names = spark.createDataFrame([("s len=3",), ("*",), (None,), ("s\tx",), ("",)], "r string").coalesce(1)
    assert [r.v for r in names.select(reference_name(F.col("r")).alias("v")).collect()] == ["s", None, None, "s", None]


def test_unused_groups_dont_matter(spark):
    by = defaultdict(int)
    for r in A.unique_names(spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "n string, o int"), "n", "o").collect():
        by[r.n] = r.o
    assert by == {"a": 1, "b": 3}
