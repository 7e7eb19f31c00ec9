"""Covered periods and gaps against marking every base."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators.intervals import coverage_periods

SCHEMA = "e string, f string, first long, last long, kind string, a int"


def brute(rows):
    out = set()
    for key in {r[:2] for r in rows}:
        bases = set()
        for *k, a, b in rows:
            if tuple(k) == key and a is not None and b is not None:
                bases.update(range(a, b + 1))
        previous = None
        start = None
        for x in sorted(bases):
            if previous is None:
                start = x
            elif x > previous + 1:
                out.add((*key, "period", start, previous))
                out.add((*key, "gap", previous + 1, x - 1))
                start = x
            previous = x
        if previous is not None:
            out.add((*key, "period", start, previous))
    return out


def run(spark, rows, shard):
    # columns with the names of the result and of inner ones are in the way on purpose
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = [tuple(r) for r in coverage_periods(df, ["e", "f"], "first", "last", shard).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("shard", [1, 2, 7, 64, 100_000])
def test_random_intervals(spark, shard):
    rng = random.Random(shard)
    rows = []
    for _ in range(300):
        a = rng.randint(-50, 400)
        rows.append((rng.choice(["x", "y", None]), rng.choice(["u", None]), a, a + rng.choice([0, 1, 3, 10, 90, -2])))
    rows += rows[:20] + [("x", "u", None, 5), ("x", "u", 5, None)]
    assert run(spark, rows, shard) == brute(rows)


def test_intervals_of_many_shards_are_merged_first(spark):
    rows = [("x", "u", 0, 1000), ("x", "u", 900, 2500), ("x", "u", 3000, 3001), ("x", "u", 1200, 1201), ("y", "u", 5, 5), ("x", "u", 2503, 2900)]
    assert run(spark, rows, 4) == brute(rows)


def test_touching_at_a_shard_border_is_one_period(spark):
    rows = [("x", "u", 0, 9), ("x", "u", 10, 19), ("x", "u", 21, 29), ("x", "u", 30, 30)]
    assert run(spark, rows, 10) == {("x", "u", "period", 0, 19), ("x", "u", "gap", 20, 20), ("x", "u", "period", 21, 30)}


def test_empty(spark):
    assert run(spark, [], 10) == set()


def test_no_task_gets_an_entitys_rows(spark):
    """A third of all rows on one entity: what is moved is combined by place first."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("e"), (F.col("id") % 50).alias("first")).withColumn("last", F.col("first") + 5)
    got = coverage_periods(df, ["e"], "first", "last").where("e = 'hot'").collect()
    assert [(r.kind, r.first_base, r.last_base) for r in got] == [("period", 0, 54)]
