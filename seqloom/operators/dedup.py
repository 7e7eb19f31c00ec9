"""Duplicate and contained sequences, decided on alignments of a set to itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import cigar as C
from seqloom.functions import seq as S
from seqloom.operators.align import local_column, spread
from seqloom.operators.kmers import shared_counts
from seqloom.records import merge


def self_alignments(contigs: DataFrame, group: str, name: str, seq: str, k: int = 15, seeds: int = 5) -> DataFrame:
    """Alignments of a group's contigs to each other: (group, qname, rname, qlen, rlen, reverse, pos, cigar), both directions.

    Seeds first (an equi-join on shared k-mers), then a local alignment of the candidates only. Clips and one M stand for the
    aligned stretch. Our own aligner; its scores aren't those of an external one.
    """
    both = contigs.select(group, F.concat(F.col(name), F.lit("\0+")).alias("__n"), F.upper(F.col(seq)).alias("__s")).unionByName(contigs.select(group, F.concat(F.col(name), F.lit("\0-")).alias("__n"), S.reverse_complement(F.upper(F.col(seq))).alias("__s")))
    pairs = shared_counts(both, group, "__n", "__s", k).where(F.col("n") >= seeds).select("a", "b")
    pairs = pairs.union(pairs.select("b", "a"))
    strand = F.substring(F.col("a"), -1, 1)
    bare = lambda c: F.expr(f"substring({c}, 1, length({c}) - 2)")
    pairs = pairs.where((F.substring(F.col("b"), -1, 1) == "+") & (bare("a") != bare("b")))
    s = both.select(group, F.col("__n"), "__s")
    both = pairs.join(merge(s.select(group, F.col("__n").alias("a"), F.col("__s").alias("q"))), "a").join(merge(s.select(F.col("__n").alias("b"), F.col("__s").alias("r"))), "b")
    hit = spread(both).withColumn("o", local_column(F.col("q"), F.col("r")))
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    cigar = F.concat(clip(F.col("o.first_start") - 1), (F.col("o.first_end") - F.col("o.first_start") + 1).cast("string"), F.lit("M"), clip(F.length("q") - F.col("o.first_end")))
    return hit.where("o.score > 0").select(group, bare("a").alias("qname"), bare("b").alias("rname"), F.length("q").alias("qlen"), F.length("r").alias("rlen"), (strand == "-").alias("reverse"), F.col("o.second_start").alias("pos"), cigar.alias("cigar"))


def exact_containments(contigs: DataFrame, group: str, name: str, seq: str, k: int = 15) -> DataFrame:
    """Contigs that stand letter for letter in another of their group: alignments like those of :func:`self_alignments`, ``{len}M``.

    The first k-mer of the contained one is the seed. Joins are merged: k-mers are far larger than the table they come from.
    """
    from seqloom.operators.kmers import kmer_rows

    s = contigs.select(group, F.col(name).alias("n"), F.upper(F.col(seq)).alias("s")).where(F.length("s") >= k)
    head = s.select(group, F.col("n").alias("qname"), F.col("s").alias("q"), F.substring("s", 1, k).alias("kmer"))
    places = kmer_rows(s, [group, "n"], "s", k).select(group, F.col("n").alias("rname"), "kmer").distinct()
    hit = head.join(merge(places), [group, "kmer"]).where("qname <> rname").join(merge(s.select(group, F.col("n").alias("rname"), F.col("s").alias("r"))), [group, "rname"])
    at = F.instr(F.col("r"), F.col("q"))
    return hit.withColumn("pos", at).where("pos > 0").select(group, "qname", "rname", F.length("q").alias("qlen"), F.length("r").alias("rlen"), F.lit(False).alias("reverse"), "pos", F.concat(F.length("q").cast("string"), F.lit("M")).alias("cigar"))


def within(contigs: list[tuple[str, str]], k: int = 15) -> set[str]:
    """Names of a group's contigs (name, sequence) that :func:`contained_or_smaller` finds on :func:`exact_containments`, in memory."""
    known = [(n, s) for n, x in contigs if len(s := x.upper()) >= k]
    heads: dict[str, list[tuple[str, str]]] = {}
    for n, s in known:
        heads.setdefault(s[:k], []).append((n, s))
    out: set[str] = set()
    for r, t in known:
        for i in range(len(t) - k + 1):
            for n, s in heads.get(t[i : i + k], ()):
                if n != r and (len(s), n) < (len(t), r) and t.startswith(s, i):
                    out.add(n)
    return out


def _fully(cutoff: float):
    return C.is_fully_mapped(F.col("cigar"), cutoff, F.col("qlen"))


def mapped_on_other(alns: DataFrame, cutoff: float) -> DataFrame:
    """Names of contigs of a second set that map fully on the first."""
    return alns.where(_fully(cutoff)).select(F.col("qname").alias("name")).distinct()


def contained_or_smaller(alns: DataFrame, cutoff: float) -> DataFrame:
    """Names of contigs that map fully on another; of two of equal length the smaller name goes."""
    return alns.where(_fully(cutoff) & (F.col("qname") != F.col("rname")) & ((F.col("qlen") < F.col("rlen")) | ((F.col("qlen") == F.col("rlen")) & (F.col("qname") < F.col("rname"))))).select(F.col("qname").alias("name")).distinct()


def near_duplicates(alns: DataFrame, cutoff: float) -> DataFrame:
    """Names of contigs that map fully on one of smaller name and of nearly equal length; the larger name goes."""
    near = F.abs(F.col("qlen") - F.col("rlen")) <= (1 - cutoff) * F.least("qlen", "rlen")
    return alns.where(_fully(cutoff) & (F.col("qname") > F.col("rname")) & near).select(F.col("qname").alias("name")).distinct()


def perfectly_contained(alns: DataFrame, parity: bool = False) -> DataFrame:
    """Names of contigs that lie perfectly within another one. Of equal contigs the smaller name stays; with ``parity`` none does."""
    inside = C.is_perfectly_mapped(F.col("cigar"), F.col("qlen")) & (F.col("qname") != F.col("rname"))
    keep_one = F.lit(True) if parity else (F.col("qlen") < F.col("rlen")) | (F.col("qname") > F.col("rname"))
    return alns.where(inside & keep_one).select(F.col("qname").alias("name")).distinct()


def contained(alns: DataFrame, cutoff: float) -> DataFrame:
    """Names of contigs that map fully within a different one."""
    return alns.where(_fully(cutoff) & (F.col("qname") != F.col("rname"))).select(F.col("qname").alias("name")).distinct()


def without(contigs: DataFrame, name: str, names: DataFrame) -> DataFrame:
    """The contigs but for those named."""
    return contigs.join(names.select(F.col("name").alias(name)), name, "left_anti")
