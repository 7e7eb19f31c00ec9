"""CIGAR strings as columns: parsing, lengths, clip codes, mapped predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The operations of the SAM format, and those that take up reference bases.
OPS = "MIDNSHP=X"
REFERENCE_OPS = "MDN=X"


def is_valid(cigar: Column) -> Column:
    """True where the cigar is one or more pairs of number and operation; false for anything else, null for null."""
    return cigar.rlike(f"^([0-9]+[{OPS}])+$")


def sum_of(cigar: Column, ops: str) -> Column:
    """Sum of the lengths of the operations in ``ops``; 0 if there are none, null if the cigar is null or a length passes 64 bits."""
    lengths = F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{ops}]"), F.lit(1))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda acc, x: acc + x.try_cast("long"))


def reference_span(cigar: Column) -> Column:
    """Reference bases an alignment takes up. The usual cigar of one M needs no list."""
    single = F.regexp_extract(cigar, "^([0-9]{1,9})[M=X]$", 1)
    return F.when(single != "", single.try_cast("long")).otherwise(sum_of(cigar, REFERENCE_OPS))


def parse(cigar: Column) -> Column:
    """array<struct<op: string, len: bigint>>; empty for ``*``, null for null."""
    pairs = F.regexp_extract_all(cigar, F.lit(f"([0-9]+[{OPS}])"), F.lit(1))
    return F.transform(pairs, lambda x: F.struct(F.substring(x, -1, 1).alias("op"), F.regexp_extract(x, "^[0-9]+", 0).try_cast("long").alias("len")))


def render(ops: Column) -> Column:
    """The inverse of :func:`parse`."""
    return F.array_join(F.transform(ops, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def clip_code(cigar: Column) -> Column:
    """0 not clipped, 1 at the left, 2 at the right, 3 at both; 0 for ``*``, null for null."""
    return F.when(cigar.rlike("^[0-9]+[SH]"), 1).otherwise(0) + F.when(cigar.rlike("[0-9]+[SH]$") & cigar.rlike("[0-9]+[A-Z=][0-9]+[SH]$"), 2).otherwise(0)


def clip_type(cigar: Column) -> Column:
    """UNCLIP, LEFT, RIGHT or BOTH; null for ``*`` and null."""
    code = clip_code(cigar)
    return F.when(cigar == "*", None).when(code == 3, "BOTH").when(code == 1, "LEFT").when(code == 2, "RIGHT").when(cigar.isNotNull(), "UNCLIP")


def clip_lengths(cigar: Column) -> Column:
    """struct<left, right>: clipped bases at either end, 0 where there is no clip."""
    left = F.regexp_extract(cigar, "^([0-9]+)[SH]", 1)
    right = F.regexp_extract(cigar, "[A-Z=]([0-9]+)[SH]$", 1)
    length = lambda c: F.when(c != "", c.try_cast("long")).otherwise(F.lit(0).cast("long"))
    return F.struct(length(left).alias("left"), length(right).alias("right"))


def is_qualified_clip(cigar: Column, least: int) -> Column:
    """Clipped by at least ``least`` bases at the first or the last operation."""
    c = clip_lengths(cigar)
    return (c["left"] >= least) | (c["right"] >= least)


def matched(cigar: Column) -> Column:
    """Sum of M."""
    return sum_of(cigar, "M")


def query_length(cigar: Column) -> Column:
    """Read length counted as M, S, H and I."""
    return sum_of(cigar, "MSHI")


def is_fully_mapped(cigar: Column, cutoff: float, length: Column | None = None) -> Column:
    """A single M of at most ``length``, else sum M / sum(M,S,H,I) > cutoff. Without ``length`` any single M counts."""
    single = F.regexp_extract(cigar, "^([0-9]+)M$", 1)
    alone = single != ""
    if length is not None:
        alone = alone & (single.try_cast("long") <= length)
    return alone | (matched(cigar) > F.lit(cutoff) * query_length(cigar))


def is_fully_mapped_fixed(cigar: Column, cutoff: float, read_length: int) -> Column:
    """A single M of exactly ``read_length``, else sum M / read_length > cutoff."""
    return (cigar == f"{read_length}M") | (matched(cigar) > cutoff * read_length)


def is_perfectly_mapped(cigar: Column, length: Column) -> Column:
    """The cigar is exactly ``{length}M``."""
    return cigar == F.concat(length.cast("string"), F.lit("M"))


def is_hard_clipped(cigar: Column) -> Column:
    return cigar.rlike("^[0-9]+H") | cigar.rlike("[A-Z=][0-9]+H$")


def is_clipped(cigar: Column) -> Column:
    """Soft or hard clipped at either end, with more than one operation."""
    return clip_code(cigar) > 0


def clip_positions(pos: Column, cigar: Column) -> Column:
    """struct<code, left_pos, right_pos>: which ends are clipped (L, R, B with S or H; N for none) and where, -1 for an end
    without clip. The left clip lies at ``pos``, the right one behind the last reference base."""
    first, last = F.regexp_extract(cigar, "^[0-9]+([SH])", 1), F.regexp_extract(cigar, "[A-Z=][0-9]+([SH])$", 1)
    code = F.when((first != "") & (last != ""), F.lit("B")).when(first != "", F.concat(F.lit("L"), first)).when(last != "", F.concat(F.lit("R"), last)).otherwise("N")
    return F.struct(code.alias("code"), F.when(first != "", pos.cast("long")).otherwise(-1).alias("left_pos"), F.when(last != "", pos.cast("long") + reference_span(cigar)).otherwise(-1).alias("right_pos"))
