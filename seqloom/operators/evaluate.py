"""How well gaps were filled: hits, closed gaps, picked sequences against true ones, stretches between flanks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import cigar as C
from seqloom.functions import seq as S
from seqloom.operators.align import local_column, spread
from seqloom.operators.ordered import scan


def hit_list(alns: DataFrame, target: str = "rname", least_clip: int = 20) -> DataFrame:
    """The different targets (id) that a sequence lies on without a clip of ``least_clip`` bases or more; alignments without a valid cigar don't count."""
    return alns.where(C.is_valid(F.col("cigar")) & ~C.is_qualified_clip(F.col("cigar"), least_clip)).select(F.col(target).alias("id")).where("id IS NOT NULL").distinct()


def closed_gaps(hits: DataFrame, gaps: DataFrame) -> DataFrame:
    """Rows (id, gap_id, gap_len) of hits whose id begins with a gap's id: scaffold and gap number, apart by a low line."""
    return hits.withColumn("gap_id", F.substring_index("id", "_", 2)).join(gaps.select("gap_id", "gap_len"), "gap_id").select("id", "gap_id", "gap_len")


def hits_and_sequences(alns: DataFrame, name: str = "qname", target: str = "rname", least_clip: int = 20) -> DataFrame:
    """One row (hits, sequences): different targets hit, different sequences that were aligned."""
    good = C.is_valid(F.col("cigar")) & ~C.is_qualified_clip(F.col("cigar"), least_clip)
    return alns.agg(F.count_distinct(F.when(good, F.col(target))).alias("hits"), F.count_distinct(name).alias("sequences"))


def against_truth(picked: DataFrame, truth: DataFrame) -> DataFrame:
    """Rows (gap_id, name, reverse, score, true_start, true_end, covered) of picked sequences (gap_id, name, seq) on the true ones (gap_id, seq).

    The better strand of a local alignment; ``covered`` is the aligned share of the true sequence. Sequences of gaps without a
    truth, and null ones, have no row.
    """
    both = picked.where("seq IS NOT NULL").select("gap_id", "name", "seq").join(truth.where("length(seq) > 0").select("gap_id", F.col("seq").alias("true_seq")), "gap_id")
    strands = both.select("gap_id", "name", "true_seq", F.inline(F.array(F.struct(F.lit(False).alias("reverse"), F.col("seq")), F.struct(F.lit(True).alias("reverse"), S.reverse_complement(F.col("seq")).alias("seq")))))
    x = spread(strands).withColumn("o", local_column(F.col("seq"), F.col("true_seq")))
    x = x.select("gap_id", "name", "reverse", F.col("o.score").alias("score"), F.col("o.second_start").alias("true_start"), F.col("o.second_end").alias("true_end"), ((F.col("o.second_end") - F.col("o.second_start") + 1) / F.length("true_seq")).alias("covered"))
    best = x.groupBy("gap_id", "name").agg(F.max_by(F.struct("reverse", "score", "true_start", "true_end", "covered"), F.struct(F.col("score"), (~F.col("reverse")).alias("forward"))).alias("b"))
    return best.select("gap_id", "name", "b.*")


def covering_queries(hits: DataFrame, lengths: DataFrame, cutoff: float) -> DataFrame:
    """The different queries (name) of a search that lie on another sequence with at least ``cutoff`` of their length.

    ``hits``: (query, subject, q_start, q_end); ``lengths``: (name, length). A hit of a sequence on itself doesn't count.
    """
    x = hits.where("query <> subject").join(lengths.select(F.col("name").alias("query"), "length"), "query")
    return x.where((F.col("q_end") - F.col("q_start")) / F.col("length") >= cutoff).select(F.col("query").alias("name")).distinct()


def filled_stretches(alns: DataFrame, order: str, gap: str, pos: str, on_own: str, inset: int = 295) -> DataFrame:
    """Rows (gap_id, first, last): the stretch between the two flanks of a gap, from alignments of flanks to filled scaffolds in file order.

    A row and the one before it make a stretch if they have one gap and the row lies on its own scaffold (column ``on_own``):
    from ``inset`` bases behind the one before to the row itself. Of several stretches of a gap the last holds; one that ends
    before it begins is left out. Rows without a gap or position are no flanks. Neighbours are found over ranges of rows.
    """
    x = alns.select(F.col(order).alias("o"), F.col(gap).alias("gap_id"), F.col(pos).alias("pos"), F.col(on_own).alias("own")).where("pos IS NOT NULL AND gap_id IS NOT NULL")
    x = scan(x, [], ["o"], lasts={"before": F.struct("gap_id", "pos")}, before=True)
    x = x.where((F.col("before.gap_id") == F.col("gap_id")) & F.col("own"))
    last = x.groupBy("gap_id").agg(F.max_by(F.struct((F.col("before.pos") + inset).alias("first"), F.col("pos").alias("last")), "o").alias("s"))
    return last.select("gap_id", "s.first", "s.last").where("first <= last")
