"""Aggregations over alignments, intervals, k-mers and links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions import cigar as C
from seqloom.functions import flags as B
from seqloom.functions import seq as S
from seqloom.operators.ordered import scan


def usable(flag: Column) -> Column:
    """Neither a duplicate nor a secondary alignment, and past quality control."""
    return ~B.has(flag, B.DUPLICATE) & B.is_primary(flag) & B.passes_qc(flag)


def clip_ratio(reads: DataFrame, contig: str, cutoff: float) -> DataFrame:
    """Per contig fully mapped / (fully mapped + clipped) reads, and whether it stays. Without either the ratio is null and it stays."""
    kind = B.read_class(F.col("flag"), F.col("cigar"))
    g = reads.groupBy(contig).agg(F.count_if(kind == "FULLMAP").alias("full"), F.count_if(kind == "CLIP").alias("clip"))
    ratio = F.when(F.col("full") + F.col("clip") > 0, F.col("full") / (F.col("full") + F.col("clip")))
    return g.withColumn("ratio", ratio).withColumn("keep", F.coalesce(F.col("ratio") >= cutoff, F.lit(True)))


def linkage(pairs: DataFrame, threshold: int) -> DataFrame:
    """Contig pairs by names and orientations: count, min, max and mean distance of those with more than ``threshold`` rows."""
    g = pairs.groupBy("l_name", "r_name", "l_ori", "r_ori").agg(F.count(F.lit(1)).alias("pairs"), F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"), F.avg("distance").alias("mean_distance"))
    return g.where(F.col("pairs") > threshold)


def read_pairs_across(reads: DataFrame, lengths: DataFrame, insert: int, sd: int, read_length: int) -> DataFrame:
    """First mates whose mate lies on another contig, both near enough to the facing ends: rows of ``linkage``'s input.

    ``reads``: (flag, rname, pos, rnext, pnext); ``lengths``: (name, length).
    """
    far = insert + 3 * sd - read_length
    r = reads.where(B.has(F.col("flag"), B.FIRST) & B.is_mapped(F.col("flag")) & B.is_mate_mapped(F.col("flag")) & (F.col("rnext") != "=") & (F.col("rnext") != F.col("rname")))
    ori = lambda bit: F.when(B.has(F.col("flag"), bit), "-").otherwise("+")
    r = r.select(F.col("rname").alias("l_name"), F.col("rnext").alias("r_name"), ori(B.REVERSE).alias("l_ori"), ori(B.MATE_REVERSE).alias("r_ori"), "pos", "pnext")
    r = r.join(lengths.select(F.col("name").alias("l_name"), F.col("length").alias("l_len")), "l_name")
    r = r.where((F.col("l_len") - F.col("pos") <= far) & (F.col("pnext") <= far))
    return r.withColumn("distance", S.contig_distance(F.lit(insert), F.col("l_len"), F.col("pos"), F.col("pnext"), read_length))


def depth_runs(spans: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Maximal runs of equal depth: rows (entity..., first, last, depth) of spans (entity..., first, last), depth above 0.

    A sweep over +1 / -1 events that are added up per place before they are moved; the sweep runs over ranges of places, so an
    entity with many of them is no single task.
    """
    e = list(entity)
    events = spans.where("first <= last").select(*e, F.inline(F.array(F.struct(F.col("first").cast("long").alias("at"), F.lit(1).alias("d")), F.struct((F.col("last") + 1).cast("long").alias("at"), F.lit(-1).alias("d")))))
    steps = events.groupBy(*e, "at").agg(F.sum("d").alias("d")).where("d <> 0")
    # each step closes the run before it
    runs = scan(steps, e, ["at"], {"depth": F.col("d")}, {"first": F.col("at")}, before=True)
    return runs.where("depth > 0").select(*e, "first", (F.col("at") - 1).alias("last"), "depth")


def coverage(spans: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Per entity the covered bases, the sum of depths and the mean depth where covered."""
    n = F.col("last") - F.col("first") + 1
    g = depth_runs(spans, entity).groupBy(*entity).agg(F.sum(n).alias("covered"), F.sum(n * F.col("depth")).alias("bases"), F.max("depth").alias("max_depth"))
    return g.withColumn("mean_depth", F.col("bases") / F.col("covered"))


def cutoff_coverage(reads: DataFrame, contig: str, length: str, read_length: int, cutoff: float) -> DataFrame:
    """Per contig the matched bases of reads whose M reaches ``cutoff`` of the read length, over the contig's length."""
    m = C.matched(F.col("cigar"))
    g = reads.where(usable(F.col("flag"))).groupBy(contig, length).agg(F.coalesce(F.sum(F.when(m >= cutoff * read_length, m)), F.lit(0)).alias("matched"))
    return g.withColumn("coverage", F.col("matched") / F.col(length))


def greedy_total(spans: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Per entity the total length of intervals taken greedily by their end, each beginning at or behind the last one's end.

    Intervals that begin at the same place only differ in their end, and only the nearest end can be taken, so they are one
    before they are gathered: an entity's list is bounded by its different starts. The lengths count both ends.
    """
    near = spans.groupBy(*entity, "first").agg(F.min("last").alias("last"))
    listed = near.groupBy(*entity).agg(F.array_sort(F.collect_list(F.struct("last", "first"))).alias("xs"))
    zero = F.struct(F.lit(-(1 << 62)).alias("end"), F.lit(0).cast("long").alias("total"))
    step = lambda acc, x: F.when(x["first"] >= acc["end"], F.struct(x["last"].cast("long").alias("end"), (acc["total"] + x["last"] - x["first"] + 1).alias("total"))).otherwise(acc)
    return listed.select(*entity, F.aggregate("xs", zero, step, lambda acc: acc["total"]).alias("total"))


def consensus(seqs: DataFrame, group: str, seq: str, weight: str) -> DataFrame:
    """The weighted majority letter of every column of a group's sequences; A, T, C, G, N is the order of ties."""
    at = seqs.select(group, F.posexplode(F.split(seq, "")).alias("at", "base"), F.col(weight).alias("w")).where("base <> ''")
    votes = at.groupBy(group, "at", "base").agg(F.sum("w").alias("w"))
    best = votes.groupBy(group, "at").agg(F.max(F.struct("w", (-F.instr(F.lit("ATCGN"), F.col("base"))).alias("first"), "base")).alias("m"))
    return best.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("m.base").alias("base")))), lambda x: x["base"]), "").alias("consensus"))


def best_hits(hits: DataFrame, by: Sequence[str], score: str, order: str) -> DataFrame:
    """The row of every group with the greatest score, of equal ones the first in ``order``."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), F.col(order))
    return hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def unique_names(seqs: DataFrame, name: str, order: str) -> DataFrame:
    """One row per name, the one of the lowest order."""
    w = Window.partitionBy(name).orderBy(order)
    return seqs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def strong_links(links: DataFrame) -> DataFrame:
    """Links with at least the mean support, rounded down, of the links from the same left name."""
    mean = F.floor(F.avg("pairs").over(Window.partitionBy("l_name")))
    return links.withColumn("mean_pairs", mean).where("pairs >= mean_pairs")


def longest_per_root(paths: DataFrame, root: str, length: str, name: str, k: int = 20) -> DataFrame:
    """The k + 1 longest paths of every root (the count is tested after it was raised)."""
    w = Window.partitionBy(root).orderBy(F.col(length).desc(), F.col(name))
    return paths.withColumn("__n", F.row_number().over(w)).where(f"__n <= {k + 1}").drop("__n")


def consecutive_pairs(rows: DataFrame, order: str, same: Sequence[str], side: str) -> DataFrame:
    """Rows with the one before them in file order, where all of ``same`` agree and ``side`` doesn't: (row..., before_...).

    File order is one order over all rows, taken apart by the first of ``same``: rows of other groups in between only break a pair
    if they stand between its two rows, which the distance in ``order`` tells. Neighbours are found over ranges of rows.
    """
    rest = [c for c in rows.columns if c != same[0]]
    x = scan(rows, [same[0]], [order], lasts={"__before": F.struct(*rest)}, before=True)
    x = x.select(*rows.columns, *[F.col(f"__before.{c}").alias(f"before_{c}") for c in rest])
    cond = (F.col(f"before_{side}") != F.col(side)) & (F.col(f"before_{order}") == F.col(order) - 1)
    for c in same[1:]:
        cond = cond & (F.col(f"before_{c}") == F.col(c))
    return x.where(cond)
