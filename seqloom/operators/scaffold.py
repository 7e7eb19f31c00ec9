"""Scaffolding: which contigs follow each other, from linkage and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators.aggregates import strong_links
from seqloom.operators.align import local_column, spread
from seqloom.records import cut, merge

#: Least length of an overlap where the distance is negative.
LEAST_OVERLAP = 7


def similar_coverage(links: DataFrame, coverage: DataFrame, cutoff: float) -> DataFrame:
    """Links whose contigs are covered alike: (larger - smaller) / larger at most ``cutoff``, the larger above 0.

    ``coverage``: (name, coverage), joined for both ends.
    """
    side = lambda p: coverage.select(F.col("name").alias(f"{p}_name"), F.col("coverage").alias(f"{p}_cov"))
    x = links.join(side("l"), "l_name").join(side("r"), "r_name")
    big, small = F.greatest("l_cov", "r_cov"), F.least("l_cov", "r_cov")
    return x.where((big > 0) & ((big - small) <= cutoff * big))


def _with_sequences(links: DataFrame, seqs: DataFrame) -> DataFrame:
    """Links with both contigs' sequences, ls and rs; merged, as sequences aren't few."""
    side = lambda p: merge(seqs.select(F.col("name").alias(f"{p}_name"), F.col("seq").alias(f"{p}s")))
    return links.join(side("l"), "l_name").join(side("r"), "r_name")


def checked_links(links: DataFrame, seqs: DataFrame) -> DataFrame:
    """All links with (merged, overlap, kept): those of negative mean distance are kept only if the left contig's end and the
    right one's beginning overlap by more than 7. ``seqs``: (name, seq); links of contigs without a sequence have no row."""
    strand = lambda s, o: F.when(F.col(o) == "-", S.reverse_complement(F.col(s))).otherwise(F.col(s))
    near, short = F.greatest(F.ceil(-F.col("mean_distance")).cast("int") + 50, F.lit(50)), F.col("mean_distance") < 0
    # a function is asked of every row, whatever stands around it: the others' sequences are null
    x = _with_sequences(links, seqs).withColumns({"ls": F.when(short, F.right(strand("ls", "l_ori"), near)), "rs": F.when(short, F.left(strand("rs", "r_ori"), near))})
    # written, else what is asked of the alignments further on is put before the spreading too, and they are made twice
    x = cut(spread(x).withColumn("o", local_column(F.col("ls"), F.col("rs"))).drop("ls", "rs"))
    size = F.coalesce(F.col("o.second_end") - F.col("o.second_start") + 1, F.lit(0))
    x = x.withColumn("overlap", size).withColumn("merged", F.col("mean_distance") < 0)
    return x.withColumn("kept", ~F.col("merged") | (F.col("overlap") > LEAST_OVERLAP)).drop("o")


def check_overlaps(links: DataFrame, seqs: DataFrame) -> DataFrame:
    """The links that are kept, with (merged, overlap)."""
    return checked_links(links, seqs).where("kept").drop("kept")


def discarded_links(links: DataFrame, seqs: DataFrame) -> DataFrame:
    """The links that aren't, in the same columns."""
    return checked_links(links, seqs).where("NOT kept").drop("kept")


def scaffold_pairs(links: DataFrame, seqs: DataFrame) -> DataFrame:
    """Pairs of contigs in order with their joined sequence: strong links, checked for overlap, one N a base of distance."""
    kept = strong_links(check_overlaps(links, seqs))
    strand = lambda s, o: F.when(F.col(o) == "-", S.reverse_complement(F.col(s))).otherwise(F.col(s))
    x = _with_sequences(kept, seqs)
    distance = F.when(F.col("merged"), -F.col("overlap")).otherwise(F.round("mean_distance").cast("int"))
    return x.select("l_name", "l_ori", "r_name", "r_ori", "pairs", distance.alias("distance"), S.join_scaffolds(strand("ls", "l_ori"), strand("rs", "r_ori"), distance).alias("seq"))
