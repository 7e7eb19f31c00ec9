"""Orders that one task can't hold: running sums, numbers and neighbours over ranges of rows, stitched by small offsets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.records import cut


def _key(name: str) -> Column:
    return F.col(f"`{name}`")


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], parts: int | None = None) -> DataFrame:
    """``df`` with ``__range``: consecutive ranges of its rows by keys and order, about equally large; a hot key has several.

    The ranges are written once, as they rest on a sample.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the partition number is taken before partitions are merged, so it is asked of the sorted rows
    return cut(df.repartitionByRange(parts, *[_key(k) for k in keys], *order).withColumn("__range", F.spark_partition_id()))


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], sums: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None, before: bool = False) -> DataFrame:
    """``df`` with running columns over each key's rows in ``order``: ``sums`` (name to value) and ``lasts``, the last value that is not null.

    ``before``: without the row itself. A key is never brought together: rows are dealt out in ranges, summed up within each, and
    the sums of the ranges before, one row per range border at most, are added. Keys may be empty (one order over all) and null
    (a key of its own). ``order`` should tell all rows of a key apart; rows it doesn't are in no defined order. A sum over nothing is
    0, a last value null. An empty table stays empty. The names given are new columns, the others stay.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = in_ranges(df.withColumns({f"__v_{n}": c for n, c in (sums | lasts).items()}), keys, order)
    by = [_key(k) for k in keys] + [F.col("__range")]
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    local = ranged.withColumns({f"__l_{n}": F.sum(f"__v_{n}").over(inside) for n in sums} | {f"__l_{n}": F.last(f"__v_{n}", ignorenulls=True).over(inside) for n in lasts})
    # the last value of a range: over the whole range, from the running one of its last row
    whole = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ranged
    if lasts:
        ends = ends.withColumns({f"__v_{n}": F.last(f"__v_{n}", ignorenulls=True).over(whole) for n in lasts})
    totals = ends.groupBy(*by).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums], *[F.first(f"__v_{n}", ignorenulls=True).alias(f"__t_{n}") for n in lasts], F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*[_key(k) for k in keys] or [F.lit(0)]).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumns({f"__o_{n}": F.sum(f"__t_{n}").over(earlier) for n in sums} | {f"__o_{n}": F.last(f"__t_{n}", ignorenulls=True).over(earlier) for n in lasts} | {"__first": F.lag("__n").over(Window.partitionBy(*[_key(k) for k in keys] or [F.lit(0)]).orderBy("__range"))})
    # only keys that go on from an earlier range: one a range at most, so this is no larger than the number of ranges
    offsets = offsets.where("__first IS NOT NULL").select(*[_key(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__r"), *[f"__o_{n}" for n in [*sums, *lasts]])
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same = same & _key(k).eqNullSafe(F.col(f"__k{i}"))
    out = local.join(F.broadcast(offsets), same, "left")
    done = {n: F.coalesce(F.col(f"__l_{n}"), F.lit(0)) + F.coalesce(F.col(f"__o_{n}"), F.lit(0)) for n in sums} | {n: F.coalesce(F.col(f"__l_{n}"), F.col(f"__o_{n}")) for n in lasts}
    return out.withColumns(done).select(*[_key(c) for c in dict.fromkeys([*df.columns, *done])])
