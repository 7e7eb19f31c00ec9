"""Alignment flags and the predicates built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions import cigar as C

#: The flag bits of the SAM format.
PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x1, 0x4, 0x8, 0x10, 0x20, 0x40, 0x80, 0x100, 0x200, 0x400, 0x800


def has(flag: Column, bit: int) -> Column:
    """The bit is set; null for a null flag."""
    return flag.bitwiseAND(bit) != 0


def is_mapped(flag: Column) -> Column:
    return ~has(flag, UNMAPPED)


def is_mate_mapped(flag: Column) -> Column:
    return ~has(flag, MATE_UNMAPPED)


def is_primary(flag: Column) -> Column:
    return ~has(flag, SECONDARY)


def passes_qc(flag: Column) -> Column:
    return ~has(flag, QC_FAIL)


def mate_number(flag: Column) -> Column:
    """1 if the first-in-pair bit is set, else 2."""
    return F.when(has(flag, FIRST), 1).otherwise(2)


def mate_suffix(flag: Column) -> Column:
    """The suffix of unmapped pairs: 2 where the flag as a number passes 128, else 1 (a comparison, not a bit)."""
    return F.when(flag > SECOND, 2).otherwise(1)


def pair_class(flag: Column) -> Column:
    """11 both mapped, 10 mate unmapped, 01 read unmapped, 00 neither."""
    return F.concat(F.when(is_mapped(flag), "1").otherwise("0"), F.when(is_mate_mapped(flag), "1").otherwise("0"))


def read_class(flag: Column, cigar: Column, cutoff: float = 0.99) -> Column:
    """CLIP, FULLMAP, OTHER for mapped reads, UNMAP_MATE or UNMAP_BOTH for others. A supplementary read is CLIP if it is hard clipped."""
    mapped = F.when(has(flag, SUPPLEMENTARY), F.when(C.is_hard_clipped(cigar), "CLIP").otherwise("OTHER")).when(C.is_clipped(cigar), "CLIP").when(C.is_fully_mapped(cigar, cutoff), "FULLMAP").otherwise("OTHER")
    return F.when(is_mapped(flag), mapped).when(is_mate_mapped(flag), "UNMAP_MATE").otherwise("UNMAP_BOTH")


def is_discordant(rnext: Column, tlen: Column, insert_mean: Column, insert_sd: Column, short_below: int = 750) -> Column:
    """The mate lies on another reference, or |tlen| is at least mean + 3 sd, or, for libraries below ``short_below``, at most mean - 3 sd."""
    size = F.abs(tlen.cast("long"))
    far = size >= insert_mean + 3 * insert_sd
    near = (insert_mean < short_below) & (size <= insert_mean - 3 * insert_sd)
    return (rnext != "=") | far | near
