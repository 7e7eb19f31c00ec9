"""Alignments against plain dynamic programming, graphs on known answers."""

import random

import pytest

from seqloom.operators import align as L
from seqloom.operators import graph as G


def plain_local(a, b, match=1, mismatch=-3, start=5, extend=2):
    n, m = len(a), len(b)
    h = [[0] * (m + 1) for _ in range(n + 1)]
    e = [[-(10**6)] * (m + 1) for _ in range(n + 1)]
    f = [[-(10**6)] * (m + 1) for _ in range(n + 1)]
    best = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e[i][j] = max(e[i][j - 1], h[i][j - 1] - start) - extend
            f[i][j] = max(f[i - 1][j], h[i - 1][j] - start) - extend
            h[i][j] = max(0, h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


def plain_overlap(a, b, mismatch=-2, indel=-2):
    n, m = len(a), len(b)
    h = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            h[i][j] = max(h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else mismatch), h[i - 1][j] + indel, h[i][j - 1] + indel)
    return max([*h[n], *(h[i][m] for i in range(n + 1))])


@pytest.mark.parametrize("seed", range(25))
def test_scores(seed):
    rng = random.Random(seed)
    a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randint(1, 25))) for _ in range(2))
    if seed % 2:
        b = a[3:] + b
    o = L.overlap(a, b, clip=0)
    assert o.score == plain_overlap(a, b) and (o.row == len(a) or o.col == len(b))
    x = L.local(a, b)
    assert x.score == plain_local(a, b)
    if x.score:
        assert plain_local(a[x.first_start - 1 : x.first_end], b[x.second_start - 1 : x.second_end]) == x.score
    score, ops = L.global_cigar(a, b, band=1)
    assert L.global_cigar(a, b, band=100)[0] == score
    import re

    runs = [(int(n), o) for n, o in re.findall(r"(\d+)([MID])", ops)]
    assert sum(n for n, o in runs if o != "D") == len(a) and sum(n for n, o in runs if o != "I") == len(b)


def test_known_overlap():
    a, b = "GATTACAGATTACACCGGTTAACCGG", "CCGGTTAACCGGTGCATGCA"
    o = L.overlap(a, b)
    assert (o.score, o.row, o.col, o.clip) == (12, 26, 12, 0) and L.significance(o, len(a), len(b)) == 2
    assert L.merged(a, b, o) == "GATTACAGATTACACCGGTTAACCGGTGCATGCA"
    back = L.overlap(b, a)
    assert L.merged(b, a, back) == "GATTACAGATTACACCGGTTAACCGGTGCATGCA"
    assert L.overlap("", "A").score == 0 and L.local("", "A").score == 0


def test_smith_waterman():
    assert L.smith_waterman("TTACGT", "ACGA") == (6, 2, 0, "3M")
    assert L.smith_waterman("ACGTTTACG", "ACGTTACG")[0] == 15


def test_second_and_repeat():
    first, second = L.local_twice("ACGTACGTAC", "TTTACGTACGTACGGGGACGTACGTACTT")
    assert first.score == 10 and second.score == 10
    assert L.repeat_cover("ACGTTGCAAG", "TT" + L.revcomp("ACGTTGCAAG") + "TT") >= 10


def test_components_and_paths():
    edges = {"1": {"2": -1.0, "3": -1.0}, "2": {"3": -1.0, "4": -1.0}, "3": {"1": -1.0}}
    groups = G.components(["1", "2", "3", "4"], edges)
    assert groups == [["1", "2", "3"], ["4"]]
    roots, ends = G.roots_and_ends(groups, edges)
    assert roots == ["1"] and ends == ["1", "3", "4"]
    assert G.paths(["1", "2", "3", "4"], edges) == [(-2.0, ["1", "2", "3"]), (-2.0, ["1", "2", "4"]), (0.0, ["1"])]
    assert sorted(G.simple_paths("1", edges)) == [["1", "2", "3"], ["1", "2", "4"], ["1", "3"]]
    assert G.drop_mirrored([(0, ["a", "b_R"]), (0, ["b", "a_R"])]) == [(0, ["a", "b_R"])]
    assert G.drop_parts([(0, ["a", "b"]), (0, ["x", "a", "b"])]) == [(0, ["x", "a", "b"])]


def test_simple_paths_have_the_limits_of_the_reference():
    """50 nodes a path, some 20 uses of a node, any number of paths a root."""
    chain = {f"{i:02}": {f"{i + 1:02}": -1.0} for i in range(70)}
    assert G.simple_paths("00", chain) == [[f"{i:02}" for i in range(50)]]
    star = {"a": {f"b{i:02}": -1.0 for i in range(60)}} | {f"b{i:02}": {"c": -1.0} for i in range(60)}
    got = G.simple_paths("a", star)
    assert len(got) == 60 and {p[1] for p in got} == set(star["a"]) and sum("c" in p for p in got) == 21
    assert G.simple_paths(["a", "b", "c"], {"a": {"b": -1.0}, "b": {"c": -1.0}}) == [["c"], ["b", "c"], ["a", "b", "c"]]


def test_merging_contigs(spark):
    rng = random.Random(3)
    whole = "".join(rng.choice("ACGT") for _ in range(300))
    rows = [("g", "a", whole[:160]), ("g", "b", L.revcomp(whole[100:240])), ("g", "c", whole[200:]), ("g", "n", None), ("g", "e", ""), ("h", "x", whole[:50])]
    got = G.merge_contigs(spark.createDataFrame(rows, "gap string, n string, s string"), "gap", "n", "s", clip=0).collect()
    assert [r.gap for r in got] == ["g"] and got[0].seq in (whole, L.revcomp(whole)) and len(got[0].path) == 3


def test_unitigs(spark):
    s = "ACGTTGCATGGACCA"
    rows = [("g", s[i : i + 5], 2) for i in range(len(s) - 4)]
    assert [r.seq for r in G.unitigs(spark.createDataFrame(rows, "g string, k string, c int"), "g", "k", "c").collect()] == [s]


def test_weak_components_and_reach(spark):
    rows = [(f"n{i}", f"n{i + 1}") for i in range(12)] + [("x", "y"), ("z", "x"), (None, "y"), ("s", "s")]
    e = spark.createDataFrame(rows, "a string, b string")
    got = {r.node: r.component for r in G.weak_components(e, "a", "b").collect()}
    assert {got[f"n{i}"] for i in range(13)} == {"n0"} and got["y"] == got["z"] == "x" and got["s"] == "s"
    start = spark.createDataFrame([("n9",), ("z",)], "node string")
    assert {r.node: r.depth for r in G.reach(e, start, "a", "b").collect()} == {"n9": 0, "n10": 1, "n11": 2, "n12": 3, "z": 0, "x": 1, "y": 2}


def test_sequences_of_pairs_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([("x", "ACGTTGCAACGGATCC"), ("y", "ACGGATCCTTTTTTTT")], "name string, seq string").write.parquet(str(tmp_path / "c"))
    spark.createDataFrame([("x", "y")], "a string, b string").write.parquet(str(tmp_path / "p"))
    out = L.verify_pairs(spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "c")), "name", "seq")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 1


def test_many_pairs_at_once_are_as_one_by_one():
    rng = random.Random(1)
    letters = lambda n, of="ACGT": "".join(rng.choice(of) for _ in range(n))
    pairs = [("", ""), ("A", ""), ("A", "A"), ("N", "N"), ("ACGT" * 20, "ACGT" * 30)]
    for _ in range(150):
        base = letters(rng.randint(1, 200))
        s = list(base)
        for _ in range(rng.randint(0, 8)):
            s[rng.randrange(len(s))] = rng.choice(["", "A", "N", "ac", "T"])
        pairs.append(("".join(s)[rng.randint(0, 30) :], base[rng.randint(0, 40) :] + letters(rng.randint(0, 40), "ACGTacgtN")))
    assert L.locals_of(pairs) == [L.local(a, b) for a, b in pairs]
    twice = [(*L.local_twice(a, b), L.local_twice(a, b, rotate=False)[1].score) for a, b in pairs]
    assert L._twice_of(pairs) == twice


def test_locals_of_many_pairs_are_those_of_single_ones():
    """Lengths, letters and costs of all kinds; alignments that are much longer than their score, and long gaps."""
    rng = random.Random(9)
    letters = lambda n, of="ACGT": "".join(rng.choice(of) for _ in range(n))
    x = letters(120)
    pairs = [("", "A"), ("N", "N"), (x, x[:50] + letters(30) + x[50:]), (x[:60] + letters(25) + x[60:], letters(9) + x), (x, "".join(b if i % 6 else rng.choice("ACGTN") for i, b in enumerate(x)))]
    pairs += [(letters(rng.randint(1, 90), of), letters(rng.randint(1, 90), of)) for of in ("AC", "ACGT", "ACGTNacgt*") for _ in range(30)]
    for costs in ({}, {"match": 2, "mismatch": -1, "other": 0, "gap_open": 0, "gap_extend": 1}, {"match": 1, "mismatch": -1, "other": -1, "gap_open": 1, "gap_extend": 0}):
        assert L.locals_of(pairs, **costs) == [L.local(*p, **costs) for p in pairs]


def test_overlap_of_contained_sequences():
    """One that stands in the other, at either end, in the middle or several times, as by the whole table."""
    rng = random.Random(8)
    for _ in range(60):
        a = "".join(rng.choice("AC") for _ in range(rng.randint(1, 25)))
        i = rng.randrange(len(a))
        b = a[i : rng.randint(i + 1, len(a))]
        for x, y in ((a, b), (b, a)):
            o = L.overlap(x, y)
            assert o.score == plain_overlap(x, y) == len(b)
            assert x[o.row_start : o.row] == y[o.col_start : o.col] == b and o.clip == 0 and o.ends_first == (o.row == len(x))


def test_gaps_are_merged_in_many_tasks(spark):
    """A gap's contigs are few bytes; they are dealt out by gap, and summed up where they are."""
    rows = [(f"g{g}", n, s) for g in range(20) for n, s in (("a", "ACGTTGCAACGGATCCTAGATTC"), ("b", "CGGATCCTAGATTCGGGGTTTACG"))]
    out = G.merge_contigs(spark.createDataFrame(rows, "gap string, name string, seq string"), "gap", "name", "seq").where("reason IS NULL")
    assert "Join" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and plan.count("Exchange") == 1
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r.gap, max(r.seq, L.revcomp(r.seq))) for r in out.collect()} == {(f"g{g}", L.revcomp("ACGTTGCAACGGATCCTAGATTCGGGGTTTACG")) for g in range(20)}
