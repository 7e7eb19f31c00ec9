"""Per-key results where a few keys hold most rows: exact selection on mergeable value histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.records import cut, few, merge

#: Bits of the value resolved in one round, so a key's histogram has at most 2 ** BITS bins per open rank.
BITS = 8


def _keys_values(df: DataFrame, keys: Sequence[str], value: str) -> tuple[DataFrame, list[str]]:
    names = [f"__k{i}" for i in range(len(keys))]
    return df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("long").alias("v")).where("v IS NOT NULL"), names


def _named(df: DataFrame, keys: Sequence[str], names: list[str], *rest: str) -> DataFrame:
    return df.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], *rest)


def _same(names: list[str], left: str, right: str):
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return cond


def _counted(data: DataFrame, names: list[str]) -> DataFrame:
    """One row (keys..., v, c) per different value of a key, combined on the map side: all later rounds work on these."""
    return cut(data.groupBy(*names, "v").agg(F.count(F.lit(1)).alias("c")))


def _beside(counts: DataFrame, bins: DataFrame, names: list[str], more) -> DataFrame:
    """``counts`` (c) joined with the few rows a key has in ``bins`` (o). Where those are too many to be broadcast, they are repeated
    for up to 16 salts, so a key with many different values is spread, and merged: Spark doesn't see that there are so many of them."""
    small = few(bins)
    cond = _same(names, "c", "o") & more
    if small is not bins:
        return counts.alias("c").join(small.alias("o"), cond)
    salts = min(16, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = bins.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return counts.withColumn("__salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).alias("c").join(merge(salted.alias("o")), cond & (F.col("c.__salt") == F.col("o.__salt")))


def _select(counts: DataFrame, names: list[str], probabilities: Sequence[float], bits: int = BITS) -> DataFrame:
    """The value of every rank: rows (keys..., q, v, n) of counted values (keys..., v, c), by rounds of histograms.

    Only the bits in which the values differ are gone through, ``bits`` (0: ``BITS``) a round. A round adds up, on the map side, the counts of the
    one open bin per (key, q) by its next bits and keeps the bin that holds the rank, until a bin is one value.
    """
    low, high = counts.agg(F.min("v"), F.max("v")).first()
    shift = (high - low).bit_length() if low is not None else 0
    counts = counts.withColumn("v", F.col("v") - (low or 0))
    open_bins: DataFrame | None = None
    while open_bins is None or shift > 0:
        closed, shift = shift, max(0, shift - (bits or BITS))
        if open_bins is None:
            bins = counts.groupBy(*names, F.shiftright("v", shift).alias("bin")).agg(F.sum("c").alias("c"))
            total = bins.withColumn("n", F.sum("c").over(Window.partitionBy(*names)))
            ranks = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * F.col("n"))).cast("long").alias("rank")) for q in probabilities])
            parts = total.select(*names, "bin", "c", "n", F.inline(ranks))
        else:
            joined = _beside(counts, open_bins, names, F.shiftright(F.col("c.v"), closed) == F.col("o.bin"))
            parts = joined.groupBy(*[F.col(f"o.{n}").alias(n) for n in names], F.col("o.q").alias("q"), F.col("o.rank").alias("rank"), F.col("o.n").alias("n"), F.shiftright(F.col("c.v"), shift).alias("bin")).agg(F.sum("c.c").alias("c"))
        upto = Window.partitionBy(*names, "q").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        open_bins = parts.withColumn("upto", F.sum("c").over(upto)).where("upto >= rank AND upto - c < rank").select(*names, "q", "n", "bin", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"))
        if shift:
            open_bins = cut(open_bins)
    return open_bins.select(*names, "q", (F.col("bin") + (low or 0)).alias("v"), "n")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact quantiles of an integer column for every key: rows (keys..., q, value, n).

    The quantile of rank max(1, ceil(q * n)) of n values is an element of the data (the inverse of the empirical distribution).
    Equal values of a key are one counted row before anything is moved; then rounds of histograms with mergeable counts refine the
    bin that holds each rank until it is one value. A key's values are never brought together: a round moves at most
    2 ** BITS counts per key, q and map task.

    Null values are left out; a null key is a key of its own; ties and repeated rows count as often as they occur; an empty table
    gives no rows.
    """
    data, names = _keys_values(df, keys, value)
    return _named(_select(_counted(data, names), names, probabilities).withColumnRenamed("v", "value"), keys, names, "q", "value", "n")


def exact_mode(df: DataFrame, keys: Sequence[str], value: str, bits: int = BITS) -> DataFrame:
    """For every key the value with most rows, the smallest of ties, and its count: rows (keys..., value, n).

    Two exact selections on the counted values: the greatest rank among the counts of a key's different values is how often
    its commonest value occurs; the lowest rank among the values that occur so often is the mode. Both ranks are resolved
    by the rounds of histograms of :func:`exact_quantiles`; no key's rows or values are brought together.

    ``bits``: bits of a round. Null values are left out; a null key is a key of its own; an empty table gives no rows.
    """
    data, names = _keys_values(df, keys, value)
    counts = _counted(data, names)
    most = cut(_select(counts.select(*names, F.col("c").alias("v"), F.lit(1).cast("long").alias("c")), names, [1.0], bits).select(*names, F.col("v").alias("most")))
    modes = cut(_beside(counts, most, names, F.col("c.c") == F.col("o.most")).select(*[F.col(f"c.{n}").alias(n) for n in names], F.col("c.v").alias("v"), F.lit(1).cast("long").alias("c"), "most"))
    first = cut(_select(modes, names, [0.0], bits).select(*names, "v"))
    out = _beside(modes, first, names, F.col("c.v") == F.col("o.v"))
    return _named(out.select(*[F.col(f"c.{n}").alias(n) for n in names], F.col("c.v").alias("value"), F.col("most").alias("n")), keys, names, "value", "n")
