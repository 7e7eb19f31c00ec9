"""k-mers as rows: counting, candidate pairs, shared counts, selection of reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.records import merge


def kmer_rows(seqs: DataFrame, keep: Sequence[str], seq: str, k: int) -> DataFrame:
    """One row per window of k letters, in upper case: (keep..., at, kmer), at 0-based. Shorter and null sequences have none.

    Places are generated and the letters cut out in generated code, which an array of windows built by a lambda isn't.
    """
    names = [f"__k{i}" for i in range(len(keep))]
    x = seqs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.upper(F.col(seq)).alias("__s")).where(F.length("__s") >= k)
    x = x.select(*names, "__s", F.explode(F.sequence(F.lit(0), F.length("__s") - k)).alias("at"))
    return x.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "at", F.substring("__s", F.col("at") + 1, F.lit(k)).alias("kmer"))


def kmer_counts(seqs: DataFrame, group: Sequence[str], seq: str, k: int, least: int = 1) -> DataFrame:
    """How often every k-mer of A, C, G and T occurs in a group: (group..., kmer, n), counted on the map side first."""
    return kmer_rows(seqs, group, seq, k).where(F.col("kmer").rlike(f"^[ACGT]{{{k}}}$")).groupBy(*group, "kmer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def overlap_candidates(contigs: DataFrame, group: str, id: str, seq: str, k: int = 10, end: int = 30) -> DataFrame:
    """Pairs of a group's contigs of which one has a k-mer of the other's first or last ``end`` bases: (group, a, b), a <= b, with itself.

    An equi-join on (group, k-mer); a group is one gap's contigs. The k-mers of ends are distinct, so those of whole contigs needn't be:
    a repeated one only repeats a pair. It is merged: k-mers are hundreds of times the size of the table they come from, which Spark goes by.
    """
    upper = F.upper(F.col(seq))
    every = kmer_rows(contigs, [group, id], seq, k).select(group, F.col(id).alias("i"), "kmer")
    tips = contigs.select(group, F.col(id).alias("j"), F.explode(F.array_distinct(F.concat(S.kmers(F.substring(upper, 1, end), k), S.kmers(F.right(upper, F.lit(end)), k)))).alias("kmer"))
    return every.join(merge(tips), [group, "kmer"]).select(group, F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def shared_counts(contigs: DataFrame, group: str, id: str, seq: str, k: int = 15) -> DataFrame:
    """How many different k-mers two contigs of a group share: (group, a, b, n), a < b. Merged, as in :func:`overlap_candidates`."""
    d = kmer_rows(contigs, [group, id], seq, k).select(group, id, "kmer").distinct()
    return d.select(group, F.col(id).alias("a"), "kmer").join(merge(d.select(group, F.col(id).alias("b"), "kmer")), [group, "kmer"]).where("a < b").groupBy(group, "a", "b").agg(F.count(F.lit(1)).alias("n"))


def reads_with_frequent(reads: DataFrame, id: str, seq: str, frequent: DataFrame, k: int, least: int) -> DataFrame:
    """Reads with at least ``least`` windows among the frequent k-mers: (id, n)."""
    return kmer_rows(reads, [id], seq, k).join(frequent.select("kmer").distinct(), "kmer", "left_semi").groupBy(id).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def weighted_map(counts: DataFrame, weight: str) -> DataFrame:
    """k-mers with their weights added up: (kmer, weight)."""
    return counts.groupBy("kmer").agg(F.sum(weight).alias("weight"))


def first_of_each(table: DataFrame, order: str) -> DataFrame:
    """A k-mer table in which a k-mer stands several times, its first value kept: (kmer, freq)."""
    return table.groupBy("kmer").agg(F.min(F.struct(order, "freq")).alias("m")).select("kmer", "m.freq")


def as_reads(counts: DataFrame, group: str) -> DataFrame:
    """Counted k-mers as reads of constant quality 5, named 0 .. n - 1 within their group in the k-mers' order."""
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy(group).orderBy("kmer")) - 1
    return counts.select(group, n.cast("string").alias("name"), F.col("kmer").alias("seq"), F.expr("repeat('5', length(kmer))").alias("qual"))
