"""Sequences as columns: complements, k-mers, gaps, flanks, splicing."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.records import ship

#: Bases and their complements.
BASES, COMPLEMENTS = "ACGT", "TGCA"


def reverse_complement(seq: Column, others: str = "keep") -> Column:
    """Reversed and complemented. ``others``: ``keep`` upper-cases bases and leaves other letters, ``n`` turns other letters to N,
    ``upper_n`` also upper-cases first but keeps N."""
    if others == "keep":
        return F.translate(F.reverse(seq), BASES + BASES.lower(), COMPLEMENTS * 2)
    upper = F.upper(seq) if others == "upper_n" else seq
    return F.translate(F.reverse(F.regexp_replace(upper, "[^ACGTacgt]", "N")), BASES + BASES.lower(), COMPLEMENTS * 2)


def kmers(seq: Column, k: int) -> Column:
    """All windows of k letters in order; an empty array for shorter sequences, null for null."""
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substring(seq, i, F.lit(k)))).when(seq.isNotNull(), F.array().cast("array<string>"))


def unrepeated(seq: Column, k: int) -> Column:
    """Whether no window of k letters stands twice in a sequence and its reverse complement, taken together; null for null."""
    ship()
    turned = str.maketrans(BASES + BASES.lower(), COMPLEMENTS * 2)

    @F.pandas_udf("boolean")
    def run(x: pd.Series) -> pd.Series:
        def one(s: str | None) -> bool | None:
            if s is None:
                return None
            n = max(len(s) - k + 1, 0)
            return len({t[i : i + k] for t in (s, s[::-1].translate(turned)) for i in range(n)}) == 2 * n

        return pd.Series([one(s) for s in x], dtype=object)

    return run(seq)


def pack_kmer(kmer: Column) -> Column:
    """Two bits a letter in one number, the first letter highest; letters other than A, C, G, T count as A. At most 31 letters."""
    digit = lambda c: F.instr(F.lit("ACGT"), c)
    letters = F.filter(F.split(F.upper(kmer), ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda acc, c: F.shiftleft(acc, 2) + F.greatest(digit(c) - 1, F.lit(0)))


def unpack_kmer(code: Column, k: int) -> Column:
    places = F.sequence(F.lit(k - 1), F.lit(0), F.lit(-1))
    return F.array_join(F.transform(places, lambda i: F.substring(F.lit("ACGT"), (F.expr("cast(0 as int)") + F.call_function("shiftright", code, (i * 2).cast("int")).bitwiseAND(3) + 1).cast("int"), F.lit(1))), "")


def roll_kmer(code: Column, base: Column, k: int) -> Column:
    """The packed k-mer one base further along."""
    return F.shiftleft(code, 2).bitwiseAND((1 << (2 * k)) - 1) + F.greatest(F.instr(F.lit("ACGT"), F.upper(base)) - 1, F.lit(0))


def neighbours(kmer: Column) -> Column:
    """The k-mers that differ in exactly one place."""
    places = F.sequence(F.lit(1), F.length(kmer))
    return F.flatten(F.transform(places, lambda i: F.transform(
        F.filter(F.array(*[F.lit(b) for b in BASES]), lambda b: b != F.substring(kmer, i, F.lit(1))),
        lambda b: F.concat(F.substring(kmer, F.lit(1), i - 1), b, F.substring(kmer, i + 1, F.length(kmer))),
    )))


def shifted(kmer: Column) -> Column:
    """The k-mers that follow by one base, and those that come one base before."""
    letters = F.array(*[F.lit(b) for b in BASES])
    tail, head = F.substring(kmer, F.lit(2), F.length(kmer)), F.substring(kmer, F.lit(1), F.length(kmer) - 1)
    return F.concat(F.transform(letters, lambda b: F.concat(tail, b)), F.transform(letters, lambda b: F.concat(b, head)))


def is_missing(base: Column) -> Column:
    return F.upper(base) == "N"


def is_gap(base: Column) -> Column:
    return base == "-"


def base_code(base: Column) -> Column:
    """A 0, T 1, C 2, G 3, -1 for others."""
    return F.instr(F.lit("ATCG"), F.upper(base)) - 1


def directional(seq: Column, start: Column, n: Column, forward: bool) -> Column:
    """``n`` bases from a 1-based place on, to the right or to the left, gap characters skipped."""
    if forward:
        return F.substring(F.replace(F.substring(seq, start, F.length(seq)), F.lit("-"), F.lit("")), F.lit(1), n)
    return F.substring(F.replace(F.reverse(F.substring(seq, F.lit(1), start)), F.lit("-"), F.lit("")), F.lit(1), n)


def gaps(seq: Column) -> Column:
    """array<struct<gap_start, gap_end>> of a sequence, 0-based, the end exclusive.

    A gap begins at an N and ends before the next upper-case A, C, G or T; small and ambiguous letters are inside. A trailing run
    without a base behind it is none, and the letter behind the closing base is passed over, as the reference rule does.
    """
    ship()
    return _gaps(seq)


#: A gap: from an N to before the next upper-case base, with the letter behind that base.
_GAP = re.compile(r"[^N]*(N[^ACGT]*)[ACGT].?", re.S)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("gap_start", T.IntegerType()), T.StructField("gap_end", T.IntegerType())])))
def _gaps(seq: pd.Series) -> pd.Series:
    """One walk along each sequence, however many gaps it has."""
    return seq.map(lambda s: None if s is None else [(m.start(1), m.end(1)) for m in _GAP.finditer(s)])


def flanks(seq: Column, start: Column, end: Column, length: int, inset: int = 5) -> Column:
    """struct<left, right>: the bases around a gap, ``inset`` bases away from it. A gap nearer to the start than ``inset`` has an empty left flank."""
    first = F.greatest(start - length, F.lit(0))
    left = F.substring(seq, first + 1, F.greatest(start - inset - first, F.lit(0)))
    return F.struct(left.alias("left"), F.substring(seq, end + inset + 1, F.lit(length - inset)).alias("right"))


def join_scaffolds(left: Column, right: Column, distance: Column) -> Column:
    """Two sequences with N between them for a distance, or overlapped by a negative one."""
    return F.when(distance >= 0, F.concat(left, F.repeat(F.lit("N"), distance), right)).otherwise(F.concat(left, F.substring(right, 1 - distance, F.length(right))))


def splice(seq: Column, fills: Column, parity: bool = False) -> Column:
    """A sequence with its gaps filled. ``fills``: array of struct<gap_start, gap_end, fill>, a null fill leaves the gap.

    Exact by default; ``parity`` drops the base behind every filled gap, as the reference's script does.
    """
    extra = 1 if parity else 0
    order = F.array_sort(F.filter(fills, lambda f: f["fill"].isNotNull()))
    done = F.aggregate(
        order,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, f: F.struct((f["gap_end"] + extra).cast("int").alias("at"), F.concat(acc["out"], F.substring(seq, acc["at"] + 1, F.greatest(f["gap_start"] - acc["at"], F.lit(0))), f["fill"]).alias("out")),
    )
    return F.concat(done["out"], F.substring(seq, done["at"] + 1, F.length(seq)))


def wrap(seq: Column, width: int = 60) -> Column:
    """Line ends after every ``width`` letters but not at the end."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def trim_true(seq: Column, least: int = 495, head: int = 389, tail: int = 105) -> Column:
    """The middle of a true gap sequence of at least ``least`` bases; null for shorter ones."""
    return F.when(F.length(seq) >= least, F.substring(seq, F.lit(head + 1), F.length(seq) - tail - head))


def bridge_fill(seq: Column, left: Column, left_len: Column, right: Column, right_len: Column, reverse: Column) -> Column:
    """The gap's sequence out of a contig that both flanks hit: [left + len - 1, right) forward, or the mirror image reversed."""
    ahead = F.substring(seq, left + left_len, F.greatest(right - (left + left_len - 1), F.lit(0)))
    back = F.substring(seq, right + right_len, F.greatest(left - (right + right_len - 1), F.lit(0)))
    return F.when(reverse, reverse_complement(back)).otherwise(ahead)


def extended_fill(left: Column, right: Column) -> Column:
    """What reaches into the gap from both sides, with NN between."""
    return F.concat(F.coalesce(left, F.lit("")), F.lit("NN"), F.coalesce(right, F.lit("")))


def contig_distance(insert: Column, left_len: Column, pos: Column, mate_pos: Column, read_length: int) -> Column:
    """Insert size less what both contigs hold of it."""
    return insert - (left_len - pos) - (mate_pos + read_length)


def uniform(seed: int, *by: Column) -> Column:
    """A pseudorandom double in [0, 1) for a seed and some columns: the same for the same values, wherever the row lies.

    53 bits of a 64-bit hash. A stream of numbers is that of a seed and a running number; it needs no state.
    """
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *by), 11).cast("double") * F.lit(2.0**-53)
