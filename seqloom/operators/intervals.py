"""Overlapping and gapped intervals: continuous periods and the gaps between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Width of a shard in the intervals' unit; an entity has at most its extent / SHARD shards.
SHARD = 16_384
#: An interval of more shards than this is merged with the entity's other long ones before it is clipped.
LONG = 64


def merged_runs(df: DataFrame, part: list[str]) -> DataFrame:
    """Rows (part, a, b) to one row per maximal run: its a, its b, the end before it, and the greatest end of the part.

    For parts of bounded size: a part is sorted in one task. Ends are inclusive, runs that touch are one.
    """
    before = Window.partitionBy(*part).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part)
    following = Window.partitionBy(*part).orderBy("a")
    return (
        df.withColumn("__end", F.max("b").over(before))
        .withColumn("__last", F.max("b").over(whole))
        .where(F.col("__end").isNull() | (F.col("a") > F.col("__end") + 1))
        .withColumn("__next_end", F.lead("__end").over(following))
        .withColumn("__next_a", F.lead("a").over(following))
        .select(*part, "a", F.coalesce("__next_end", "__last").alias("b"), "__end", "__next_a", "__last")
    )


def coverage_periods(df: DataFrame, entity: Sequence[str], first: Column | str, last: Column | str, shard: int = SHARD) -> DataFrame:
    """Maximal covered periods of each entity's intervals and the gaps between neighbouring periods.

    Rows (entity..., kind, first_base, last_base): kind ``period`` or ``gap``, both ends inclusive. Intervals that overlap, nest
    or touch (last + 1 = first) are one period.

    Two levels: intervals are clipped into shards of fixed width and merged within (entity, shard); only the pieces that touch a
    shard's boundary, and one summary row per shard, go to the second level, which stitches them per entity. The first level
    pre-aggregates equal starts before each shuffle, so a task holds at most ``shard`` rows of one entity however many intervals
    it has; the second holds at most 3 rows per shard.

    Null ends or last < first: the interval covers nothing and is left out. A null entity column is a value of its own. Repeated
    rows change nothing. An empty table gives no rows. Other columns of ``df`` are not read, so their names can't clash.
    """
    entity, names = list(entity), [f"__e{i}" for i in range(len(entity))]
    of = lambda c: F.col(c) if isinstance(c, str) else c
    spans = df.select(*[F.col(e).alias(n) for e, n in zip(entity, names, strict=True)], of(first).cast("long").alias("a"), of(last).cast("long").alias("b")).where("a <= b")
    spans = spans.withColumns({"s": F.floor(F.col("a") / shard).cast("long"), "t": F.floor(F.col("b") / shard).cast("long")})

    def clipped(x: DataFrame, shards: Column) -> DataFrame:
        low = F.col("shard") * shard
        return x.select(*names, "a", "b", F.explode(shards).alias("shard")).select(*names, "shard", F.greatest("a", low).alias("a"), F.least("b", low + (shard - 1)).alias("b"))

    # a long interval gives its two ends here
    is_long = F.col("t") - F.col("s") > LONG
    short = clipped(spans, F.when(is_long, F.array("s", "t")).otherwise(F.sequence("s", F.when(is_long, F.col("s")).otherwise(F.col("t")))))
    # whole shards in between: at most one start per shard and entity, merged to disjoint runs before they are written out
    runs = spans.where(is_long).groupBy(*names, ((F.col("s") + 1) * shard).alias("a")).agg(F.max(F.col("t") * shard - 1).alias("b"))
    inner = clipped(merged_runs(runs, names).select(*names, "a", "b").withColumns({"s": F.floor(F.col("a") / shard).cast("long"), "t": F.floor(F.col("b") / shard).cast("long")}), F.sequence("s", "t"))
    pieces = short.unionByName(inner).groupBy(*names, "shard", "a").agg(F.max("b").alias("b"))

    low, high = F.col("shard") * shard, F.col("shard") * shard + (shard - 1)
    local = merged_runs(pieces, [*names, "shard"])
    inside = (F.col("a") > low) & (F.col("b") < high)
    row = lambda tag, a, b: F.struct(F.lit(tag).alias("tag"), a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    done = local.select(*names, F.inline(F.filter(F.array(
        F.when(inside, row("period", a, b)),
        F.when(F.col("__next_a").isNotNull(), row("gap", b + 1, F.col("__next_a") - 1)),
    ), lambda x: x.isNotNull())))
    border = local.select(*names, F.inline(F.filter(F.array(
        F.when(~inside, row("piece", a, b)),
        F.when(F.col("__end").isNull(), row("shard", a, F.col("__last"))),
    ), lambda x: x.isNotNull())))
    stitched = merged_runs(border, [*names, "tag"]).where("tag = 'piece' OR __end IS NOT NULL")
    is_piece = F.col("tag") == "piece"
    stitched = stitched.select(*names, F.when(is_piece, "period").otherwise("gap").alias("tag"), F.when(is_piece, a).otherwise(F.col("__end") + 1).alias("a"), F.when(is_piece, b).otherwise(a - 1).alias("b"))
    return done.unionByName(stitched).select(*[F.col(n).alias(e) for n, e in zip(names, entity, strict=True)], F.col("tag").alias("kind"), F.col("a").alias("first_base"), F.col("b").alias("last_base"))
