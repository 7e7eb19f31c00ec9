"""Exact selection against sorting."""

import math
import random
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from seqloom.operators import skew
from seqloom.operators.skew import _counted, _keys_values, exact_mode, exact_quantiles
from seqloom.records import cut


def rows(seed, n=600):
    rng = random.Random(seed)
    out = [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), rng.choice([rng.randint(-(2**31), 2**31 - 1), rng.randint(0, 40), None])) for _ in range(n)]
    return out + out[:30] + [("one", 7), ("ties", 3), ("ties", 3), ("ties", 9), ("ties", 9), ("low", -(2**31)), ("high", 2**31 - 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles(spark, seed):
    data = rows(seed)
    by = defaultdict(list)
    for k, v in data:
        if v is not None:
            by[k].append(v)
    want = {(k, q, sorted(vs)[max(1, math.ceil(q * len(vs))) - 1], len(vs)) for k, vs in by.items() for q in (0.0, 0.25, 0.5, 0.95, 1.0)}
    df = spark.createDataFrame([(k, v, 1) for k, v in data], "k string, v long, bin int")
    assert {tuple(r) for r in exact_quantiles(df, ["k"], "v", [0.0, 0.25, 0.5, 0.95, 1.0]).collect()} == want


@pytest.mark.parametrize("bits", [0, 3, 6, 20])
def test_mode(spark, bits):
    data = rows(3)
    by = defaultdict(Counter)
    for k, v in data:
        if v is not None:
            by[k][v] += 1
    want = {(k, min(v for v, n in c.items() if n == max(c.values())), max(c.values())) for k, c in by.items()}
    df = spark.createDataFrame([(k, v, 1) for k, v in data], "k string, v long, c int")
    assert {tuple(r) for r in exact_mode(df, ["k"], "v", bits).collect()} == want


def test_empty(spark):
    df = spark.createDataFrame([], "k string, v long")
    assert exact_quantiles(df, ["k"], "v", [0.5]).count() == 0 and exact_mode(df, ["k"], "v").count() == 0


def test_one_key_and_value_hold_half_of_all_rows(spark):
    """Rows are counted before they are moved: no task gets more than the different values."""
    hot = spark.range(40_000).select(F.lit("hot").alias("k"), F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 500).cast("long").alias("v"))
    df = hot.unionByName(spark.range(40_000).select(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")).alias("k"), (F.col("id") % 300).alias("v")))
    assert {r["k"]: (r["value"], r["n"]) for r in exact_mode(df, ["k"], "v").collect()}["hot"] == (5, 20_080)
    counts = _counted(*_keys_values(df, ["k"], "v"))
    assert max(counts.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()) < 4_000



def test_many_keys_are_salted(spark, monkeypatch):
    monkeypatch.setattr(skew, "few", lambda df: df)
    data = rows(5)
    df = spark.createDataFrame(data, "k string, v long")
    by = defaultdict(list)
    for k, v in data:
        if v is not None:
            by[k].append(v)
    assert {(r["k"], r["value"]) for r in exact_quantiles(df, ["k"], "v", [0.5]).collect()} == {(k, sorted(vs)[max(1, math.ceil(0.5 * len(vs))) - 1]) for k, vs in by.items()}


def test_many_bins_are_not_broadcast(spark, monkeypatch):
    """Bins of many keys, repeated for the salts, don't pass through the driver, however small the file they come from."""
    monkeypatch.setattr(skew, "few", lambda df: df)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        counts = cut(spark.range(300).selectExpr("id % 30 AS __k0", "id AS v", "1L AS c"))
        bins = cut(spark.range(30).selectExpr("id AS __k0", "id + 30 AS bin"))
        out = skew._beside(counts, bins, ["__k0"], F.col("c.v") == F.col("o.bin"))
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
