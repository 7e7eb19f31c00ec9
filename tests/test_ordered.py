"""Running columns over ranges against one pass in Python."""

import random

from pyspark.sql import functions as F

from seqloom.operators.ordered import scan


def test_scan(spark):
    rng = random.Random(5)
    data = [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.choice([None, rng.randint(-5, 5)])) for i in rng.sample(range(3000), 900)]
    df = spark.createDataFrame(data, "`k` string, at long, v long")
    for before in (False, True):
        want, state = set(), {}
        for k, at, v in sorted(data, key=lambda r: r[1]):
            s, last, n = state.get(k, (0, None, 0))
            new = (s + (v or 0), last if v is None else v, n + 1)
            want.add((k, at, *((s, last, n) if before else new)))
            state[k] = new
        got = scan(df, ["k"], ["at"], {"s": F.col("v"), "n": F.lit(1)}, {"last": F.col("v")}, before)
        assert {(r["k"], r["at"], r["s"], r["last"], r["n"]) for r in got.collect()} == want
        assert got.columns == ["k", "at", "v", "s", "n", "last"]


def test_scan_without_keys(spark):
    df = spark.createDataFrame([(i * 7 % 1000,) for i in range(1000)], "x long")
    assert [(r["x"], r["n"]) for r in scan(df, [], ["x"], {"n": F.lit(1)}).orderBy("x").collect()] == [(i, i + 1) for i in range(1000)]
    assert scan(df.where("x < 0"), [], ["x"], {"n": F.lit(1)}).count() == 0
