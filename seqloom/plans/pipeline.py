"""The gap-filling run as one chain of DataFrames: find gaps, collect reads, assemble, merge, pick, splice; no temporary files."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions import seq as S
from seqloom.operators import dedup, graph, joins, kmers, pick
from seqloom.operators.align import local_column, revcomp, spread
from seqloom.operators.ordered import scan
from seqloom.records import cut, merge


#: Bases between a flank and its gap.
INSET = 5

#: Bases of a gap's reads or contigs that a task holds at once; the k-mers of gaps that have more are rows.
AT_ONCE = 1 << 17


def find_gaps(scaffolds: DataFrame, least: int = 100) -> DataFrame:
    """Gaps of (ord, name, seq): rows (gap_id, scaffold, gap_start, gap_end, gap_len), ids of scaffold and gap ordinals.

    Scaffold ordinals count from 0 in the order of ``ord``, gaps from 1 along their scaffold. A null sequence has none.
    """
    ords = scan(scaffolds.select("ord", "name").distinct(), [], ["ord", "name"], {"scf_ord": F.lit(1)}, before=True).select("name", "scf_ord")
    g = scaffolds.select("name", F.inline(S.gaps(F.col("seq")))).withColumn("gap_len", F.col("gap_end") - F.col("gap_start")).where(F.col("gap_len") >= least)
    return scan(g, ["name"], ["gap_start"], {"gap_ord": F.lit(1)}).join(ords, "name").select(F.concat_ws("_", "scf_ord", "gap_ord").alias("gap_id"), F.col("name").alias("scaffold"), "gap_start", "gap_end", "gap_len")


def flank_pairs(scaffolds: DataFrame, gaps: DataFrame, length: int = 300) -> DataFrame:
    """(gap_id, left, right): the bases beside every gap."""
    return gaps.join(merge(scaffolds.select(F.col("name").alias("scaffold"), "seq")), "scaffold").select("gap_id", F.inline(F.array(S.flanks(F.col("seq"), F.col("gap_start"), F.col("gap_end"), length))))


def _by_size(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a sequence, dealt out by their gap: those of gaps of at most ``most`` bases, and of larger ones."""
    sized = spread(rows.where(F.length("seq") > 0), "gap_id").withColumn("bases", F.sum(F.length("seq")).over(Window.partitionBy("gap_id")))
    return sized.where(F.col("bases") <= most).drop("bases"), sized.where(F.col("bases") > most).drop("bases")


def assemble(reads: DataFrame, ks: list[int], least: int = 2, shortest: int = 40, at_once: int = AT_ONCE) -> DataFrame:
    """Contigs of every gap over several k: (gap_id, name, seq), names beginning with the k they come from.

    The k-mers of a gap whose reads have at most ``at_once`` bases are counted where it is assembled, those of others as rows.
    """
    small, large = _by_size(reads.select("gap_id", "seq"), at_once)

    def run(_: object, rows: list[tuple]) -> list[tuple[str, str]]:
        texts: Counter[str] = Counter()
        for (seq,), n in Counter(rows).items():
            for s in (seq, revcomp(seq)):
                texts[s.upper()] += n
        pieces = [(p, n) for s, n in texts.items() for p in re.findall("[ACGT]+", s)]
        out = []
        for k in ks:
            counts: dict[str, int] = {}
            for p, n in pieces:
                for i in range(len(p) - k + 1):
                    x = p[i : i + k]
                    counts[x] = counts.get(x, 0) + n
            found = sorted((s for s, _ in graph.unbranched({x: n for x, n in counts.items() if n >= least}) if len(s) >= shortest), key=lambda s: (-len(s), s))
            out += [(f"{k}_NODE_{i}", s) for i, s in enumerate(found, 1)]
        return out

    out = graph.of_groups(small, run, ["name", "seq"])
    both = large.union(large.select("gap_id", S.reverse_complement(F.col("seq")).alias("seq")))
    for k in ks:
        u = graph.unitigs(kmers.kmer_counts(both, ["gap_id"], "seq", k), "gap_id", "kmer", "n", least).where(F.length("seq") >= shortest)
        named = spread(u, "gap_id").withColumn("name", F.concat_ws("_", F.lit(k), F.lit("NODE"), F.row_number().over(Window.partitionBy("gap_id").orderBy(F.length("seq").desc(), "seq")).cast("string"))).select("gap_id", "name", "seq")
        out = out.unionByName(named)
    return out


def align_flanks(flanks: DataFrame, contigs: DataFrame, least: int = 30) -> DataFrame:
    """Local alignments of every gap's flanks to its own contigs, both strands: the input of :mod:`pick`."""
    # contigs are moved with both flanks, and only then stand beside each strand of each
    sides = spread(flanks.select("gap_id", "left", "right").join(merge(contigs.select("gap_id", "name", "seq")), "gap_id")).select("gap_id", "name", "seq", F.inline(F.array(F.struct(F.lit("left").alias("side"), F.col("left").alias("q")), F.struct(F.lit("right").alias("side"), F.col("right").alias("q")))))
    strands = sides.select("gap_id", "name", "seq", "side", F.inline(F.array(F.struct(F.lit(0).alias("flag"), F.col("q")), F.struct(F.lit(16).alias("flag"), S.reverse_complement(F.col("q")).alias("q")))))
    h = strands.withColumn("o", local_column(F.col("q"), F.col("seq")))
    # written, else they are aligned for each that asks for a part of them, and before they are dealt out
    h = cut(h.select("gap_id", "name", "side", "flag", "o", F.length("q").alias("bases"))).where(F.col("o.score") >= least)
    clip = lambda n: F.when(n > 3, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    m = F.col("o.first_end") - F.col("o.first_start") + 1
    cigar = F.concat(clip(F.col("o.first_start") - 1), m.cast("string"), F.lit("M"), clip(F.col("bases") - F.col("o.first_end")))
    return h.select("gap_id", F.col("name").alias("contig"), "side", "flag", F.col("o.second_start").alias("pos"), cigar.alias("cigar"), F.xxhash64("name", "side", "flag").alias("ord"))


def fill_round(flanks: DataFrame, reads: DataFrame, ks: list[int], least: int, least_score: int) -> DataFrame:
    """One round for some gaps: assemble, merge, align flanks, pick. Rows (gap_id, fill).

    Flanks lie ``INSET`` bases off the gap; those bases stand in the scaffold too, so they are cut off here for an exact splice.
    """
    contigs = cut(assemble(reads, ks, least))
    merged = graph.merge_contigs(contigs, "gap_id", "name", "seq").where("reason IS NULL").select("gap_id", "name", "seq")
    every = cut(contigs.unionByName(merged))
    picked = pick.pick_bridging(align_flanks(flanks, every, least_score), every.withColumnRenamed("name", "contig"), 2 * INSET)
    return picked.select("gap_id", _between(F.col("fill"), F.col("reverse")).alias("fill"))


def _between(fill: Column, reverse: Column) -> Column:
    """A picked fill without the bases between the flanks and the gap, and without the one of a flank that it holds: the first of the
    right one, or on a contig that lies the other way round the last of the left one."""
    return F.substring(fill, F.when(reverse, INSET + 2).otherwise(INSET + 1), F.length(fill) - (2 * INSET + 1))


def fill_gaps(scaffolds: DataFrame, gaps: DataFrame, reads: DataFrame, ks: tuple[int, ...] = (31,), flank: int = 300, rounds: tuple[tuple[int, int], ...] = ((2, 30), (1, 15))) -> DataFrame:
    """Fills of the gaps, round by round; each round works on the gaps that are still open (left anti). Rows (gap_id, fill, round).

    ``reads``: (gap_id, seq), dispatched. ``rounds``: least k-mer count and least alignment score of each.
    """
    pairs = flank_pairs(scaffolds, gaps, flank)
    done: DataFrame | None = None
    for i, (least, score) in enumerate(rounds, 1):
        open_pairs, open_reads = (pairs, reads) if done is None else (x.join(merge(done.select("gap_id")), "gap_id", "left_anti") for x in (pairs, reads))
        found = cut(fill_round(open_pairs, open_reads, list(ks), least, score).withColumn("round", F.lit(i)))
        done = found if done is None else done.unionByName(found)
    return done


def rescued_reads(unmapped: DataFrame, contigs: DataFrame, k: int = 31) -> DataFrame:
    """Reads (gap_id, seq) out of pairs that lie on no scaffold (qname, mate, seq): those that share k bases with a gap's contigs, and their mates.

    Either strand counts. The mate comes along if it lies on no contig, or on another gap's. Null sequences lie nowhere.
    """
    both = contigs.select("gap_id", "seq").union(contigs.select("gap_id", S.reverse_complement(F.col("seq")).alias("seq")))
    known = kmers.kmer_counts(both, ["gap_id"], "seq", k).select("gap_id", "kmer")
    ids = unmapped.where("seq IS NOT NULL").select("qname", "mate", F.explode(S.kmers(F.col("seq"), k)).alias("kmer")).distinct()
    hits = cut(ids.join(merge(known), "kmer").select("qname", "mate", "gap_id").distinct())
    mates = hits.select("qname", (3 - F.col("mate")).alias("mate"), F.col("gap_id").alias("mate_gap"))
    aligned = hits.join(merge(mates), ["qname", "mate"], "left").select("qname", "mate", "gap_id", F.when(F.col("mate_gap").isNull(), 8).otherwise(0).alias("flag"), "mate_gap")
    wanted = hits.unionByName(joins.rescue_mates(aligned, unmapped.select("qname", "mate")).select("qname", "mate", "gap_id")).distinct()
    return wanted.join(merge(unmapped), ["qname", "mate"]).select("gap_id", "seq")


def merged_ones(contigs: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """The merged sequences of every gap's contigs, those that lie within another left out before.

    Both is done at once for a gap whose contigs have at most ``at_once`` bases; for others the containments are joins.
    """
    small, large = _by_size(contigs.select("gap_id", "name", "seq"), at_once)

    def run(_: object, rows: list[tuple]) -> list[tuple[str, str]]:
        inside = dedup.within(rows)
        seqs: dict[str, str] = {}
        for n, s in sorted(rows):
            if n not in inside:
                seqs.setdefault(n, s.upper())
        return [(n, s) for n, _, s in graph.merged_paths(seqs, clip=50)]

    named = large.withColumn("name", F.concat_ws(":", "gap_id", "name"))
    inside = dedup.contained_or_smaller(dedup.exact_containments(named, "gap_id", "name", "seq"), 0.85)
    rest = graph.merge_contigs(dedup.without(named, "name", merge(inside)), "gap_id", "name", "seq").where("reason IS NULL").select("gap_id", "name", "seq")
    return graph.of_groups(small, run, ["name", "seq"]).unionByName(rest)


def fill_run(scaffolds: DataFrame, gaps: DataFrame, reads: DataFrame, unmapped: DataFrame, high_quality: DataFrame, ks: tuple[int, ...] = (31,), flank: int = 300, least: int = 2, scores: tuple[int, int] = (30, 15)) -> DataFrame:
    """The whole filling, in the order of the steps below, each for the gaps that are still open: rows (gap_id, fill, step).

    first: assemble, merge, pick. assembly: with the rescued reads of pairs that lie on no scaffold, assemble again, pick. merging: merge
    those contigs, pick. quality: merge them with the gap's high-quality reads, pick with the lower score. extended: what reaches
    into the gap from either side, apart by NN.

    ``reads``: (gap_id, seq), dispatched; ``unmapped``: (qname, mate, seq); ``high_quality``: (gap_id, name, seq), reads clipped on several
    contigs; both may be empty. ``least``: least count of a k-mer. A gap without any contig has no row.
    """
    pairs = cut(flank_pairs(scaffolds, gaps, flank))
    done: list[DataFrame] = []

    def still(df: DataFrame) -> DataFrame:
        return df.join(merge(reduce(DataFrame.unionByName, [x.select("gap_id") for x in done])), "gap_id", "left_anti") if done else df

    def picked(contigs: DataFrame, score: int, step: str) -> None:
        p = pick.pick_bridging(align_flanks(still(pairs), contigs, score), contigs.withColumnRenamed("name", "contig"), 2 * INSET)
        done.append(cut(p.select("gap_id", _between(F.col("fill"), F.col("reverse")).alias("fill"), F.lit(step).alias("step"))))

    first = cut(assemble(reads, list(ks), least))
    picked(cut(first.unionByName(merged_ones(first))), scores[0], "first")
    more = rescued_reads(unmapped, still(first), min(ks))
    second = cut(assemble(still(reads.select("gap_id", "seq").unionByName(more)), list(ks), least))
    picked(second, scores[0], "assembly")
    second = cut(still(second))
    picked(cut(merged_ones(second)), scores[0], "merging")
    third = cut(still(second).unionByName(still(high_quality.select("gap_id", "name", "seq"))))
    third = cut(third.unionByName(merged_ones(third)))
    picked(third, scores[1], "quality")
    open_ones = cut(still(third))
    ends = pick.pick_extended(align_flanks(still(pairs), open_ones, scores[1]), open_ones.withColumnRenamed("name", "contig"), inset=INSET)
    done.append(ends.where("fill <> 'NN'").select("gap_id", "fill", F.lit("extended").alias("step")))
    return reduce(DataFrame.unionByName, done)


def collect_reads(alignments: DataFrame, raw: DataFrame, gaps: DataFrame, libraries: DataFrame, reach: int) -> DataFrame:
    """Raw reads of every gap: (gap_id, qname, mate, seq, qual) of those selected by their alignments."""
    return joins.dispatch(raw, joins.select_reads(alignments, gaps, libraries, reach)).select("gap_id", "qname", "mate", "seq", "qual")
