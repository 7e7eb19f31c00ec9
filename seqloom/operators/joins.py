"""Joins between reads, gaps and contigs: range, as-of, dispatch, rescue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import cigar as C
from seqloom.functions import flags as B
from seqloom.records import merge

#: Width of a bin of a range join, in bases.
BIN = 4096


def range_join(points: DataFrame, ranges: DataFrame, key: str, point: str, low: str, high: str, width: int = BIN) -> DataFrame:
    """Every point with every range of its key that holds it, both ends inclusive: inner, many to many.

    Ranges are written to the bins they touch and points to their own, so the join is an equi-join on (key, bin) with the range as
    a remaining condition. A key that holds a third of all points is spread over its bins, and no plan falls back to a product.
    Null keys, points or ends match nothing. The names of both sides must differ but for ``key``, which is kept once.
    """
    bins = ranges.where(F.col(key).isNotNull() & (F.col(low) <= F.col(high))).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("__bin", F.floor(F.col(point) / width)).join(bins, [key, "__bin"]).where(F.col(point).between(F.col(low), F.col(high))).drop("__bin")


def asof_largest(points: DataFrame, anchors: DataFrame, key: str, id: str, point: str, anchor: str, before: int, after: int, width: int = BIN) -> DataFrame:
    """For every point the largest anchor p of its key with p - before <= point <= p + after; points without one have no row.

    The range join with bins, then a maximum per point that is combined on the map side. Rows (id, key, point, anchor).
    """
    a = anchors.select(key, anchor).distinct().withColumns({"__low": F.col(anchor) - before, "__high": F.col(anchor) + after})
    hits = range_join(points.select(key, id, point), a, key, point, "__low", "__high", width)
    return hits.groupBy(id, key, point).agg(F.max(anchor).alias(anchor))


def gap_sides(gaps: DataFrame, reach: int) -> DataFrame:
    """The two focal regions of every gap: side 0 up to and with its start, side 1 from its end on, ``reach`` bases each."""
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("gap_start").alias("anchor"), F.greatest(F.col("gap_start") - (reach - 1), F.lit(0)).alias("low"), F.col("gap_start").alias("high")),
        F.struct(F.lit(1).alias("side"), F.col("gap_end").alias("anchor"), F.col("gap_end").alias("low"), (F.col("gap_end") + (reach - 1)).alias("high")),
    )
    return gaps.select("gap_id", F.col("scaffold").alias("rname"), "gap_len", F.inline(sides))


def select_reads(reads: DataFrame, gaps: DataFrame, libraries: DataFrame, reach: int, anchor_mapq: int = 30, clip_distance: int = 250) -> DataFrame:
    """Reads that belong to a gap: rows (aln_id, qname, gap_id, side, kind, mate, mapq, map_pos, mate_ref, mate_pos, gap_len).

    ``reads``: records with rname cleaned; ``reach``: at least the widest library's mean + 3 sd. A read matches a gap's side if
    it lies less than its own library's mean + 3 sd from it. Kind ``clip``: clipped towards the gap within ``clip_distance``, for
    this mate. Kind ``discordant``: both mates mapped, mapq at least ``anchor_mapq``, mate elsewhere; kind ``unmap``: read mapped,
    mate not; both for the other mate, and the first excludes the second. One match may give a clip row and one other.

    Null flag, position, mapq or tlen: the rules that ask for it don't hold. Equal gaps count once. ``libraries`` is a small
    dimension; Spark broadcasts it where its size allows.
    """
    lib = libraries.select("lib_id", "insert_mean", "insert_sd")
    r = reads.select("aln_id", "lib_id", "qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen").join(lib, "lib_id")
    hits = range_join(r, gap_sides(gaps, reach), "rname", "pos", "low", "high")
    hits = hits.withColumn("distance", F.abs(F.col("pos") - F.col("anchor"))).where(F.col("distance") < F.col("insert_mean") + 3 * F.col("insert_sd"))
    flag, code, mate = F.col("flag"), C.clip_code(F.col("cigar")), B.mate_number(F.col("flag"))
    clip = (F.col("distance") <= clip_distance) & (((F.col("side") == 0) & (code >= 2)) | ((F.col("side") == 1) & code.isin(1, 3)))
    discordant = B.is_mapped(flag) & B.is_mate_mapped(flag) & (F.col("mapq") >= anchor_mapq) & B.is_discordant(F.col("rnext"), F.col("tlen"), F.col("insert_mean"), F.col("insert_sd"))
    unmap = B.is_mapped(flag) & ~B.is_mate_mapped(flag)
    none = F.lit(None).cast("int")
    row = lambda kind, m, *tail: F.struct(F.lit(kind).alias("kind"), m.cast("int").alias("mate"), *[t.alias(n) for t, n in zip(tail, ["map_pos", "mate_ref", "mate_pos", "gap_len"], strict=True)])
    empty = (none, F.lit(None).cast("string"), none, none)
    rows = F.filter(F.array(
        F.when(clip, row("clip", mate, *empty)),
        F.when(discordant, row("discordant", 3 - mate, F.col("pos"), F.col("rnext"), F.col("pnext"), F.col("gap_len"))).when(unmap, row("unmap", 3 - mate, *empty)),
    ), lambda x: x.isNotNull())
    return hits.select("aln_id", "qname", "gap_id", "side", "mapq", F.inline(rows))


def low_mapq_reads(reads: DataFrame, positions: DataFrame, most_mapq: int = 0) -> DataFrame:
    """Reads of low mapq that lie at a discordant mate's place, with every gap of it: rows (aln_id, qname, gap_id, mapq).

    ``positions``: rows (rname, place, gap_id). A place covers 199 bases before and 299 behind it; of several the largest holds.
    """
    low = reads.where(F.col("mapq") <= most_mapq).select("aln_id", "rname", "pos")
    best = asof_largest(low, positions, "rname", "aln_id", "pos", "place", 199, 299)
    return best.join(positions.select("rname", "place", "gap_id"), ["rname", "place"]).join(reads.select("aln_id", "qname", "mapq"), "aln_id").select("aln_id", "qname", "gap_id", "mapq")


def dispatch(reads: DataFrame, selected: DataFrame) -> DataFrame:
    """Raw reads to every gap they were selected for: reads (qname, mate, seq, qual) with selected (qname, mate, gap_id).

    A pair (read, gap) that was selected for several reasons is one row.
    """
    return reads.join(selected.select("qname", "mate", "gap_id").distinct(), ["qname", "mate"])


def with_gaps(scaffolds: DataFrame, gaps: DataFrame) -> DataFrame:
    """The scaffolds that have a gap (left semi)."""
    return scaffolds.join(gaps.select(F.col("scaffold").alias("scf_name")), "scf_name", "left_semi")


def remaining(gaps: DataFrame, picked: DataFrame) -> DataFrame:
    """The gaps not yet picked: names of picked sequences begin with the gap's two numbers."""
    done = picked.select(F.array_join(F.slice(F.split("name", "_"), 1, 2), "_").alias("gap_id")).distinct()
    return gaps.join(done, "gap_id", "left_anti")


def rescue_mates(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """For reads aligned to a gap's contigs, the mates to take along: rows (qname, mate, gap_id).

    ``aligned``: (qname, mate, gap_id, flag, mate_gap); ``pairs``: (qname, mate) that exist. A mate is taken if it is unmapped or
    lies on another gap's contig; ``=`` for the mate's place is the same gap, which takes nothing.
    """
    elsewhere = F.col("mate_gap").isNotNull() & (F.col("mate_gap") != "=") & (F.col("mate_gap") != F.col("gap_id"))
    want = aligned.where(B.has(F.col("flag"), B.MATE_UNMAPPED) | elsewhere).select("qname", (3 - F.col("mate")).alias("mate"), "gap_id").distinct()
    return want.join(pairs.select("qname", "mate").distinct(), ["qname", "mate"], "left_semi")


def pair_up(reads: DataFrame) -> DataFrame:
    """Mates side by side: rows (qname, seq_1, seq_2) of the names that have both."""
    one, two = (reads.where(F.col("mate") == m).select("qname", F.col("seq").alias(f"seq_{m}")) for m in (1, 2))
    return one.join(two, "qname")


def symmetric_links(links: DataFrame, support: int) -> DataFrame:
    """Links (a, a_ori, b, b_ori, n) in both directions, the names on the reverse strand with _R, each once, supported often enough."""
    name = lambda c, o: F.when(F.col(o) == "-", F.concat(F.col(c), F.lit("_R"))).otherwise(F.col(c))
    x = links.where(F.col("n") >= support).select(name("a", "a_ori").alias("a"), name("b", "b_ori").alias("b"))
    return x.union(x.select("b", "a")).distinct()


def bridging_hits(hits: DataFrame) -> DataFrame:
    """Contigs that both flanks of a gap hit: the best pair of hits of every (gap, contig).

    ``hits``: rows (gap_id, contig, side, clip, pos, matched, flag), side left or right, clip UNCLIP, LEFT or RIGHT, one a
    (contig, side, clip). Both clipped at the same end is no bridge; both must lie on one strand; the largest sum of matched bases
    wins, of equal sums the pair first in the order UNCLIP, LEFT, RIGHT.
    """
    rank = lambda c: F.when(c == "UNCLIP", 0).when(c == "LEFT", 1).otherwise(2)
    side = lambda s, p: hits.where(F.col("side") == s).select("gap_id", "contig", *[F.col(c).alias(f"{p}_{c}") for c in ("clip", "pos", "matched", "flag")])
    both = side("left", "l").join(merge(side("right", "r")), ["gap_id", "contig"])
    both = both.where(((F.col("l_clip") != F.col("r_clip")) | (F.col("l_clip") == "UNCLIP")) & (F.col("l_flag").bitwiseAND(16) == F.col("r_flag").bitwiseAND(16)))
    order = F.struct((F.col("l_matched") + F.col("r_matched")).alias("sum"), (-(rank(F.col("l_clip")) * 3 + rank(F.col("r_clip")))).alias("first"), *[F.col(f"{p}_{c}") for p in "lr" for c in ("clip", "pos", "matched", "flag")])
    return both.groupBy("gap_id", "contig").agg(F.max(order).alias("m")).select("gap_id", "contig", "m.*").drop("first")


