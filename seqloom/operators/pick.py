"""Picking the sequence that fills a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions import cigar as C
from seqloom.functions import seq as S
from seqloom.operators.aggregates import best_hits
from seqloom.operators.joins import bridging_hits
from seqloom.records import merge


def flank_hits(alns: DataFrame) -> DataFrame:
    """Hits of flanks on contigs that count: mapped, not clipped at both ends, the longest per (gap, contig, side, clip), the first of equals.

    ``alns``: (gap_id, contig, side, flag, pos, cigar, ord).
    """
    x = alns.where(F.col("flag").bitwiseAND(4) == 0).withColumns({"clip": C.clip_type(F.col("cigar")), "matched": C.matched(F.col("cigar"))})
    return best_hits(x.where("clip <> 'BOTH'"), ["gap_id", "contig", "side", "clip"], "matched", "ord")


def pick_bridging(alns: DataFrame, contigs: DataFrame, least: int = -1) -> DataFrame:
    """Per gap the contig that both flanks hit with the largest span between them, and the fill cut out of it.

    ``contigs``: (gap_id, contig, seq). Rows (gap_id, contig, reverse, fill). Ties by contig name. Spans of -1 or less don't count.
    """
    b = bridging_hits(flank_hits(alns)).withColumn("reverse", F.col("l_flag").bitwiseAND(16) != 0)
    span = F.when(F.col("reverse"), F.col("l_pos") - (F.col("r_pos") + F.col("r_matched") - 1)).otherwise(F.col("r_pos") - (F.col("l_pos") + F.col("l_matched") - 1))
    b = b.withColumn("span", span).where(F.col("span") > least)
    w = Window.partitionBy("gap_id").orderBy(F.col("span").desc(), "contig")
    best = b.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    fill = S.bridge_fill(F.col("seq"), F.col("l_pos").cast("int"), F.col("l_matched").cast("int"), F.col("r_pos").cast("int"), F.col("r_matched").cast("int"), F.col("reverse"))
    return best.join(merge(contigs), ["gap_id", "contig"]).select("gap_id", "contig", "reverse", "span", fill.alias("fill"))


def pick_extended(alns: DataFrame, contigs: DataFrame, parity: bool = False, inset: int = 0) -> DataFrame:
    """For gaps without a bridge: what one contig adds to the left flank, NN, and what another adds to the right one.

    Only hits clipped at the end that faces the gap: the left flank's right end, the right flank's left end, mirrored on the
    reverse strand. The longest match wins, the first by name of equals. ``parity`` takes every non-zero flag for the reverse strand.
    ``inset``: bases between a flank and its gap, which are cut off here.
    """
    h = flank_hits(alns).withColumn("reverse", (F.col("flag") != 0) if parity else (F.col("flag").bitwiseAND(16) != 0))
    facing = F.when(F.col("side") == "left", F.when(F.col("reverse"), "LEFT").otherwise("RIGHT")).otherwise(F.when(F.col("reverse"), "RIGHT").otherwise("LEFT"))
    h = h.where((F.col("clip") == facing) | (F.col("clip") == "UNCLIP"))
    best = best_hits(h, ["gap_id", "side"], "matched", "contig").join(merge(contigs), ["gap_id", "contig"])
    end = F.col("pos") + F.col("matched") - 1
    behind = F.substring(F.col("seq"), (end + 1).cast("int"), F.length("seq"))
    before = F.substring(F.col("seq"), F.lit(1), (F.col("pos") - 1).cast("int"))
    ahead = F.col("reverse") == (F.col("side") == "right")
    piece = F.when(ahead, behind).otherwise(before)
    piece = F.when(F.col("reverse"), S.reverse_complement(piece)).otherwise(piece)
    if inset:
        piece = F.when(F.col("side") == "left", F.substring(piece, F.lit(inset + 1), F.length(piece))).otherwise(F.left(piece, F.greatest(F.length(piece) - inset, F.lit(0))))
    sides = best.select("gap_id", "side", piece.alias("piece")).groupBy("gap_id").agg(F.max(F.when(F.col("side") == "left", F.col("piece"))).alias("l"), F.max(F.when(F.col("side") == "right", F.col("piece"))).alias("r"))
    return sides.select("gap_id", S.extended_fill(F.col("l"), F.col("r")).alias("fill"))


def splice_gaps(scaffolds: DataFrame, gaps: DataFrame, fills: DataFrame, parity: bool = False) -> DataFrame:
    """Scaffolds (name, seq) with the picked fills (gap_id, fill) put in; a gap without a fill stays."""
    listed = gaps.join(merge(fills), "gap_id", "left").groupBy(F.col("scaffold").alias("name")).agg(F.collect_list(F.struct("gap_start", "gap_end", "fill")).alias("fills"))
    none = F.array().cast("array<struct<gap_start:int,gap_end:int,fill:string>>")
    return scaffolds.join(merge(listed), "name", "left").select("name", S.splice(F.col("seq"), F.coalesce("fills", none), parity).alias("seq"))
