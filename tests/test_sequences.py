"""Queries over sequences on small tables."""

import datetime
import random

from seqloom.queries import sequences as Q

T0 = datetime.datetime(2024, 1, 1)


def folder(spark, tmp_path, rows):
    """contig_alns of rows (rec_id, gap_id, rname, pos, mapq, seq)."""
    full = [(i, f"q{i}", g, 0, r, p, q, "*", s, T0) for i, g, r, p, q, s in rows]
    schema = "rec_id long, qname string, gap_id string, flag int, rname string, pos int, mapq int, cigar string, seq string, loaded_at timestamp_ntz"
    spark.createDataFrame(full, schema).write.parquet(str(tmp_path / "contig_alns.parquet"))
    return str(tmp_path)


def test_whole_kmers_are_changed_at_every_place(spark, tmp_path):
    """k-mers that are alike in their first letters stay apart."""
    kmers = ["ACGTACGTACGTACG", "ACGTACGTNCGTACT", "ACGTACGTNCGTACT", None]
    spark.createDataFrame([(k, 1, 0) for k in kmers], "kmer string, node_index long, pos int").write.parquet(str(tmp_path / "kmer_nodes.parquet"))
    changed = lambda k: {(k, k[:i] + b, k[:i] + b + k[i + 1 :]) for i in range(15) for b in "ACGT" if b != k[i]}
    got = [tuple(r) for r in Q.neighbour_kmers(spark, str(tmp_path)).collect()]
    assert len(got) == 91 and set(got) == changed(kmers[0]) | changed(kmers[1])
    got = sorted(tuple(r) for r in Q.shifted_kmers(spark, str(tmp_path)).collect())
    assert got == sorted((k, x) for k in kmers[:2] for b in "ACGT" for x in (k[1:] + b, b + k[:-1]))


def test_consensus_of_whole_contigs(spark, tmp_path):
    """Bases behind the 30th, and contigs under 30 bases, count."""
    d = folder(spark, tmp_path, [(1, "g", "s", 1, 60, "A" * 40 + "CCC"), (2, "g", "s", 1, 20, "C" * 45), (3, "h", "s", 1, 50, "CG"), (4, "h", "t", 1, 0, "acg"), (5, "h", "t", 1, 9, "*"), (6, "h", None, 1, 9, "TTT")])
    assert {r.rname: r.consensus for r in Q.consensus_of_contigs(spark, d).collect()} == {"s": "C" + "A" * 39 + "C" * 5, "t": "ACG"}


def test_scaffold_pairs_have_their_real_distances(spark, tmp_path):
    """A gap of over 500 bases keeps its length; an overlap of over 100 is checked, and stays if it is one."""
    rng = random.Random(4)
    x, far = ("".join(rng.choice("ACGT") for _ in range(n)) for n in (200, 40))
    y = x[50:] + far
    d = folder(spark, tmp_path, [(1, "g", "s", 1, 60, x), (2, "g", "s", 51, 60, y), (3, "g", "s", 2241, 60, far), (4, "g", "t", 1, 60, "A" * 200), (5, "g", "t", 51, 60, "C" * 200)])
    got = {(r.l_name, r.r_name): (r.distance, r.seq) for r in Q.scaffold_pairs(spark, d).collect()}
    assert got == {("c000000001", "c000000002"): (-150, x + far), ("c000000002", "c000000003"): (2000, y + "N" * 2000 + far)}


def test_contigs_of_any_length_are_compared(spark, tmp_path):
    """Contigs over 400 bases, and pairs that share a single 15-mer."""
    rng = random.Random(6)
    x, seed, before, behind = ("".join(rng.choice("ACGT") for _ in range(n)) for n in (500, 15, 40, 40))
    d = folder(spark, tmp_path, [(1, "g", "s", 1, 60, x), (2, "g", "s", 1, 60, x[:450]), (4, "h", "s", 1, 60, before + seed), (5, "h", "s", 1, 60, seed + behind)])
    got = {(r.a, r.b): r.first_score for r in Q.compared_contigs(spark, d).collect()}
    assert got["c000000001", "c000000002"] == 450 and got["c000000004", "c000000005"] == 15


def test_paths_of_gaps_are_walked_in_many_tasks(spark, tmp_path):
    """Candidate pairs are few bytes, but are neither broadcast nor walked in one task; k-mers are moved once."""
    d = folder(spark, tmp_path, [(3 * g + i, f"g{g}", "s", 1, 60, s) for g in range(20) for i, s in enumerate(["ACGTTGCAACGGATCCTAGA", "TGCAACGGATCCTAGATTTT", "TTGTTTTTTTTTTTTTTTTTTT"])])
    out = Q.simple_paths(spark, d)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString().split("FlatMapGroups")[1].split("Exchange")[1]
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = lambda i: f"c{i:09}"
    assert {(r.gap_id, r.root, *r.path) for r in out.collect()} == {(f"g{g}", name(3 * g + i), *p) for g in range(20) for i, p in ((0, (name(3 * g), name(3 * g + 1))), (1, (name(3 * g + 1),)))}
