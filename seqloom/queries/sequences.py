"""Queries over sequences: gaps, flanks, complements, k-mers, duplicates, overlaps, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import aggregates as A
from seqloom.operators import dedup as D
from seqloom.operators import graph as G
from seqloom.operators import kmers as K
from seqloom.operators.align import comparisons_column, local_column, spread, verify_pairs
from seqloom.plans import pipeline as P
from seqloom.queries.common import SQL_C, SQL_D, SQL_G, contigs, dna, gaps
from seqloom.records import cut, merge, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _letters(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).withColumn("name", F.concat(F.lit("d"), F.col("ord").cast("string")))


GAPS_SQL = f"""{SQL_D}, t AS (SELECT ord, seq, regexp_extract_all(seq, '([^N]*N[^ACGT]*[ACGT].?)', 1) AS toks FROM d),
u AS (SELECT ord, seq, unnest(range(0, len(toks))) AS i, unnest(toks) AS tok FROM t),
o AS (SELECT ord, i, tok, coalesce(sum(length(tok)) OVER (PARTITION BY ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM u),
f AS (SELECT ord, CAST(off + instr(tok, 'N') - 1 AS INTEGER) AS gap_start, CAST(off + length(regexp_extract(tok, '^([^N]*N[^ACGT]*)', 1)) AS INTEGER) AS gap_end FROM o)"""


@query(f"WITH {GAPS_SQL} SELECT ord, gap_start, gap_end FROM f")
def gaps_of_sequences(spark: SparkSession, d: str) -> DataFrame:
    """F1, W3"""
    return dna(spark, d).select("ord", F.inline(S.gaps(F.col("seq"))))


@query(f"""WITH {GAPS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY gap_start) AS gap_ord FROM f WHERE gap_end - gap_start >= 2), n AS (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS scf FROM d)
SELECT scf || '_' || gap_ord AS gap_id, 'd' || ord AS scaffold, gap_start, gap_end, gap_end - gap_start AS gap_len FROM r JOIN n USING (ord)""")
def gap_table(spark: SparkSession, d: str) -> DataFrame:
    """F1, W1, W2, P14, K4"""
    return P.find_gaps(_letters(spark, d), 2)


@query(f"""WITH {GAPS_SQL} SELECT ord, gap_start, CASE WHEN gap_start < 5 THEN '' ELSE substr(seq, greatest(gap_start - 30, 0) + 1, gap_start - 5 - greatest(gap_start - 30, 0)) END AS "left", substr(seq, gap_end + 6, 25) AS "right" FROM f JOIN d USING (ord) WHERE gap_end - gap_start >= 2""")
def gap_flanks(spark: SparkSession, d: str) -> DataFrame:
    """F2, K5"""
    x = dna(spark, d).select("ord", "seq", F.inline(S.gaps(F.col("seq")))).where("gap_end - gap_start >= 2")
    return x.select("ord", "gap_start", F.inline(F.array(S.flanks(F.col("seq"), F.col("gap_start"), F.col("gap_end"), 30))))


@query(f"""WITH {SQL_C} SELECT rec_id, translate(reverse(seq), 'ACGTacgt', 'TGCATGCA') AS rc_keep, translate(reverse(regexp_replace(seq, '[^ACGTacgt]', 'N', 'g')), 'ACGTacgt', 'TGCATGCA') AS rc_n, reverse(seq) AS reversed, substr(seq, 11, 20) AS part FROM c WHERE seq IS NOT NULL""")
def complements(spark: SparkSession, d: str) -> DataFrame:
    """F3, F4, F5, S2b, S4"""
    s = F.col("seq")
    return contigs(spark, d).where("seq IS NOT NULL").select("rec_id", S.reverse_complement(s).alias("rc_keep"), S.reverse_complement(s, "n").alias("rc_n"), F.reverse(s).alias("reversed"), F.substring(s, 11, 20).alias("part"))


@query(f"WITH {SQL_C}, w AS (SELECT substr(seq, i, 10) AS kmer FROM c, unnest(range(1, length(seq) - 8)) u(i)) SELECT kmer, count(*) AS n FROM w WHERE regexp_full_match(kmer, '[ACGT]{{10}}') GROUP BY kmer HAVING count(*) >= 2")
def kmers_of_contigs(spark: SparkSession, d: str) -> DataFrame:
    """F8, A11"""
    return K.kmer_counts(contigs(spark, d), [], "seq", 10, 2)


WINDOWS = "w AS (SELECT gap_id, substr(seq, i, 15) AS kmer FROM c, unnest(range(1, length(seq) - 13)) u(i) WHERE gap_id IS NOT NULL), n AS (SELECT gap_id, kmer, count(*) AS n FROM w WHERE regexp_full_match(kmer, '[ACGT]{15}') GROUP BY ALL)"


@query(f"WITH {SQL_C}, {WINDOWS} SELECT gap_id, kmer, n FROM n WHERE n >= 2")
def kmers_per_gap(spark: SparkSession, d: str) -> DataFrame:
    """A10"""
    return K.kmer_counts(contigs(spark, d).where("gap_id IS NOT NULL"), ["gap_id"], "seq", 15, 2)


@query(f"WITH {SQL_C}, {WINDOWS} SELECT gap_id, CAST(row_number() OVER (PARTITION BY gap_id ORDER BY kmer) - 1 AS VARCHAR) AS name, kmer AS seq, repeat('5', 15) AS qual FROM n WHERE n >= 2")
def kmers_as_reads(spark: SparkSession, d: str) -> DataFrame:
    """S19, K15"""
    return K.as_reads(K.kmer_counts(contigs(spark, d).where("gap_id IS NOT NULL"), ["gap_id"], "seq", 15, 2), "gap_id")


PACKED = " + ".join(f"greatest(instr('ACGT', substr(kmer, {i + 1}, 1)) - 1, 0) * {4 ** (14 - i)}" for i in range(15))


@query(f"SELECT DISTINCT kmer, CAST({PACKED} AS BIGINT) AS code, CAST((({PACKED}) * 4 + 2) % {4**15} AS BIGINT) AS rolled, kmer AS unpacked, CAST(instr('ATCG', upper(kmer[1])) - 1 AS INTEGER) AS first_code FROM kmer_nodes WHERE regexp_full_match(kmer, '[ACGT]{{15}}')")
def packed_kmers(spark: SparkSession, d: str) -> DataFrame:
    """F9, F10"""
    code = S.pack_kmer(F.col("kmer"))
    x = table(spark, d, "kmer_nodes").where(F.col("kmer").rlike("^[ACGT]{15}$")).select("kmer").distinct().withColumn("code", code)
    return x.select("kmer", "code", S.roll_kmer(F.col("code"), F.lit("G"), 15).alias("rolled"), S.unpack_kmer(F.col("code"), 15).alias("unpacked"), S.base_code(F.substring("kmer", 1, 1)).alias("first_code"))


NEAR = "k AS (SELECT DISTINCT kmer FROM kmer_nodes WHERE kmer IS NOT NULL)"


def _whole_kmers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kmer_nodes").where("kmer IS NOT NULL").select("kmer").distinct()


@query(f"WITH {NEAR}, b(b) AS (VALUES ('A'), ('C'), ('G'), ('T')) SELECT kmer, substr(kmer, 1, i - 1) || b AS changed_start, substr(kmer, 1, i - 1) || b || substr(kmer, i + 1) AS neighbour FROM k, unnest(range(1, length(kmer) + 1)) u(i), b WHERE b <> substr(kmer, i, 1)")
def neighbour_kmers(spark: SparkSession, d: str) -> DataFrame:
    """every place of the whole k-mer is changed"""
    x = _whole_kmers(spark, d).select("kmer", F.explode(S.neighbours(F.col("kmer"))).alias("neighbour"))
    # the changed place: a letter other than A, C, G and T has four neighbours, so it isn't told by the neighbour's number
    place = "filter(sequence(1, length(kmer)), i -> substring(kmer, i, 1) <> substring(neighbour, i, 1))[0]"
    return x.select("kmer", F.expr(f"left(neighbour, {place})").alias("changed_start"), "neighbour")


@query(f"WITH {NEAR}, b(b) AS (VALUES ('A'), ('C'), ('G'), ('T')) SELECT kmer, substr(kmer, 2) || b AS shifted FROM k, b UNION ALL SELECT kmer, b || substr(kmer, 1, length(kmer) - 1) FROM k, b")
def shifted_kmers(spark: SparkSession, d: str) -> DataFrame:
    """F12"""
    return _whole_kmers(spark, d).select("kmer", F.explode(S.shifted(F.col("kmer"))).alias("shifted"))


FREQUENT = "q AS (SELECT kmer, count(*) AS freq FROM kmer_nodes WHERE kmer IS NOT NULL GROUP BY kmer HAVING count(*) >= 2)"


@query(f"WITH {SQL_C}, {FREQUENT}, w AS (SELECT rec_id, substr(seq, i, 15) AS kmer FROM c, unnest(range(1, length(seq) - 13)) u(i)) SELECT rec_id, count(*) AS n FROM w WHERE kmer IN (SELECT kmer FROM q) GROUP BY rec_id HAVING count(*) >= 2")
def contigs_with_frequent_kmers(spark: SparkSession, d: str) -> DataFrame:
    """P18"""
    f = table(spark, d, "kmer_nodes").where("kmer IS NOT NULL").groupBy("kmer").agg(F.count(F.lit(1)).alias("freq")).where("freq >= 2")
    return K.reads_with_frequent(contigs(spark, d), "rec_id", "seq", f, 15, 2)


@query("WITH f AS (SELECT kmer, min_by(pos, node_index) AS freq FROM kmer_nodes WHERE kmer IS NOT NULL AND pos >= 0 AND node_index IS NOT NULL GROUP BY kmer), m AS (SELECT kmer, node_index, min(pos) AS pos FROM kmer_nodes WHERE kmer IS NOT NULL AND pos >= 0 AND node_index IS NOT NULL GROUP BY ALL) SELECT kmer, pos AS freq FROM m QUALIFY row_number() OVER (PARTITION BY kmer ORDER BY node_index) = 1")
def first_kmer_value(spark: SparkSession, d: str) -> DataFrame:
    """The entry of the smallest node holds"""
    k = table(spark, d, "kmer_nodes").where("kmer IS NOT NULL AND pos >= 0 AND node_index IS NOT NULL")
    return K.first_of_each(k.select("kmer", "node_index", F.col("pos").alias("freq")), "node_index")


@query("SELECT kmer, CAST(sum(pos) AS BIGINT) AS weight FROM kmer_nodes WHERE kmer IS NOT NULL AND pos >= 0 GROUP BY kmer")
def weighted_kmers(spark: SparkSession, d: str) -> DataFrame:
    """A11"""
    return K.weighted_map(table(spark, d, "kmer_nodes").where("kmer IS NOT NULL AND pos >= 0"), "pos")


TIPS = """e AS (SELECT DISTINCT gap_id, name, substr(seq, i, 10) AS kmer FROM c, unnest(range(1, length(seq) - 8)) u(i) WHERE gap_id IS NOT NULL),
t AS (SELECT DISTINCT gap_id, name, substr(x, i, 10) AS kmer FROM (SELECT gap_id, name, substr(seq, 1, 30) AS x FROM c WHERE gap_id IS NOT NULL UNION ALL SELECT gap_id, name, right(seq, 30) FROM c WHERE gap_id IS NOT NULL) z, unnest(range(1, length(x) - 8)) u(i))"""


@query(f"WITH {SQL_C}, {TIPS} SELECT DISTINCT e.gap_id, least(e.name, t.name) AS a, greatest(e.name, t.name) AS b FROM e JOIN t USING (gap_id, kmer)")
def overlap_candidates(spark: SparkSession, d: str) -> DataFrame:
    """J10"""
    return K.overlap_candidates(contigs(spark, d).where("gap_id IS NOT NULL"), "gap_id", "name", "seq")


@query(f"WITH {SQL_C}, w AS (SELECT DISTINCT gap_id, name, substr(seq, i, 15) AS kmer FROM c, unnest(range(1, length(seq) - 13)) u(i) WHERE gap_id IS NOT NULL) SELECT x.gap_id, x.name AS a, y.name AS b, count(*) AS n FROM w x JOIN w y ON x.gap_id = y.gap_id AND x.kmer = y.kmer AND x.name < y.name GROUP BY ALL")
def shared_kmer_counts(spark: SparkSession, d: str) -> DataFrame:
    """J12, F14"""
    return K.shared_counts(contigs(spark, d).where("gap_id IS NOT NULL"), "gap_id", "name", "seq")


#: Contigs with their first halves and some copies beside them, so that there is something to contain.
INSIDE = "k AS (SELECT gap_id, name, seq FROM c UNION ALL SELECT gap_id, name || 'h', left(seq, length(seq) // 2) FROM c UNION ALL SELECT gap_id, name || 'd', seq FROM c WHERE rec_id % 3 = 0), i AS (SELECT x.gap_id, x.name AS qname, y.name AS rname, length(x.seq) AS qlen, length(y.seq) AS rlen FROM k x JOIN k y ON x.gap_id = y.gap_id AND x.name <> y.name WHERE length(x.seq) >= 15 AND contains(y.seq, x.seq))"


def _with_parts(spark: SparkSession, d: str) -> DataFrame:
    c = contigs(spark, d).where("gap_id IS NOT NULL").select("rec_id", "gap_id", "name", "seq")
    halves = c.select("rec_id", "gap_id", F.concat("name", F.lit("h")).alias("name"), F.left("seq", F.floor(F.length("seq") / 2).cast("int")).alias("seq"))
    return c.unionByName(halves).unionByName(c.where("rec_id % 3 = 0").withColumn("name", F.concat("name", F.lit("d"))))


def _inside(spark: SparkSession, d: str) -> DataFrame:
    return D.exact_containments(_with_parts(spark, d), "gap_id", "name", "seq")


@query(f"WITH {SQL_C}, {INSIDE} SELECT gap_id, qname, rname, qlen, rlen FROM i")
def contained_contigs(spark: SparkSession, d: str) -> DataFrame:
    """J9, P6"""
    return _inside(spark, d).select("gap_id", "qname", "rname", "qlen", "rlen")


@query(f"WITH {SQL_C}, {INSIDE} SELECT name FROM k WHERE gap_id IS NOT NULL AND name NOT IN (SELECT qname FROM i WHERE qlen < rlen OR qname < rname)")
def without_contained_or_smaller(spark: SparkSession, d: str) -> DataFrame:
    """command O, U5, K2"""
    return D.without(_with_parts(spark, d).select("name"), "name", D.contained_or_smaller(_inside(spark, d), 0.85))


@query(f"WITH {SQL_C}, {INSIDE} SELECT DISTINCT qname AS name FROM i WHERE qname > rname AND rlen - qlen <= (1 - CAST(0.85 AS DOUBLE)) * qlen")
def near_duplicate_contigs(spark: SparkSession, d: str) -> DataFrame:
    """command P"""
    return D.near_duplicates(_inside(spark, d), 0.85)


@query(f"WITH {SQL_C}, {INSIDE} SELECT DISTINCT qname AS name FROM i WHERE qlen < rlen OR qname > rname")
def perfectly_contained_contigs(spark: SparkSession, d: str) -> DataFrame:
    """command P with g"""
    return D.perfectly_contained(_inside(spark, d))


@query(f"WITH {SQL_C}, {INSIDE} SELECT DISTINCT qname AS name FROM i")
def contained_names(spark: SparkSession, d: str) -> DataFrame:
    """command K, P21"""
    return D.contained(_inside(spark, d), 0.85)


@query(f"WITH {SQL_C}, {INSIDE} SELECT DISTINCT qname AS name FROM i WHERE right(qname, 1) = 'h' AND right(rname, 1) <> 'h'")
def mapped_on_other_set(spark: SparkSession, d: str) -> DataFrame:
    """command T: the halves are the second set"""
    i = _inside(spark, d)
    return D.mapped_on_other(i.where(F.endswith("qname", F.lit("h")) & ~F.endswith("rname", F.lit("h"))), 0.85)


@query(f"WITH {SQL_C} SELECT min(rec_id) AS rec_id, qname FROM c GROUP BY qname")
def unique_contigs(spark: SparkSession, d: str) -> DataFrame:
    """A16, O4, command U"""
    return A.unique_names(contigs(spark, d).select("rec_id", "qname"), "qname", "rec_id")


@query(f"WITH {SQL_C} SELECT gap_id, CAST(sum(length(seq)) AS BIGINT) AS bases, sum(length(seq)) <= 1000000 AS merge FROM c WHERE seq IS NOT NULL GROUP BY gap_id")
def contig_bases_per_gap(spark: SparkSession, d: str) -> DataFrame:
    """P19, A20"""
    return contigs(spark, d).where("seq IS NOT NULL").groupBy("gap_id").agg(F.sum(F.length("seq")).alias("bases")).withColumn("merge", F.col("bases") <= 1_000_000)


@query(f"WITH {SQL_C}, {SQL_G} SELECT gap_id, scaffold, gap_start, gap_end FROM g WHERE gap_id NOT IN (SELECT DISTINCT gap_id FROM c WHERE gap_id IS NOT NULL AND mapq >= 30)")
def remaining_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps with a well placed contig count as picked"""
    from seqloom.operators.joins import remaining

    picked = contigs(spark, d).where("gap_id IS NOT NULL AND mapq >= 30").select(F.concat_ws("_", "gap_id", "name").alias("name"))
    return remaining(gaps(spark, d).select("gap_id", "scaffold", "gap_start", "gap_end"), picked)


@query(f"WITH {SQL_C} SELECT gap_id, split_part(qname, '_', 1) || '_' || split_part(qname, '_', 2) || '_' || name AS contig FROM c WHERE gap_id IS NOT NULL UNION ALL SELECT gap_id, 'hq_' || name FROM c WHERE gap_id IS NOT NULL AND mapq = 60")
def united_contigs(spark: SparkSession, d: str) -> DataFrame:
    """U2, U3, U4, K14, P20"""
    c = contigs(spark, d).where("gap_id IS NOT NULL")
    p = F.split("qname", "_")
    one = c.select("gap_id", F.concat_ws("_", F.get(p, F.lit(0)), F.get(p, F.lit(1)), "name").alias("contig"))
    return one.unionByName(c.where("mapq = 60").select("gap_id", F.concat(F.lit("hq_"), "name").alias("contig")))


@query(f"""WITH {SQL_C}, v AS (SELECT rname, i, substr(seq, i, 1) AS base, sum(mapq) AS w FROM c, unnest(range(1, length(seq) + 1)) u(i) WHERE seq IS NOT NULL AND rname IS NOT NULL GROUP BY ALL),
b AS (SELECT rname, i, base FROM v QUALIFY row_number() OVER (PARTITION BY rname, i ORDER BY w DESC NULLS LAST, instr('ATCGN', base), base DESC) = 1) SELECT rname, string_agg(base, '' ORDER BY i) AS consensus FROM b GROUP BY rname""")
def consensus_of_contigs(spark: SparkSession, d: str) -> DataFrame:
    """A scaffold's contigs, weighted by mapq; a contig has no vote behind its end"""
    return A.consensus(contigs(spark, d).where("seq IS NOT NULL AND rname IS NOT NULL").select("rname", "seq", "mapq"), "rname", "seq", "mapq")


@query(f"""WITH {GAPS_SQL}, k AS (SELECT ord, gap_start, gap_end, row_number() OVER (PARTITION BY ord ORDER BY gap_start) AS n FROM f), e AS (SELECT *, coalesce(lag(gap_end) OVER (PARTITION BY ord ORDER BY n), 0) AS before FROM k WHERE n % 2 = 1),
p AS (SELECT ord, string_agg(substr(seq, before + 1, gap_start - before) || 'TTT', '' ORDER BY n) AS head, max(gap_end) AS tail FROM e JOIN d USING (ord) GROUP BY ord) SELECT d.ord, coalesce(head, '') || substr(seq, coalesce(tail, 0) + 1) AS seq FROM d LEFT JOIN p USING (ord)""")
def spliced_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Every other gap is filled"""
    fills = F.transform(S.gaps(F.col("seq")), lambda g, i: F.struct(g["gap_start"].alias("gap_start"), g["gap_end"].alias("gap_end"), F.when(i % 2 == 0, "TTT").alias("fill")))
    return dna(spark, d).select("ord", S.splice(F.col("seq"), fills).alias("seq"))


@query(f"""WITH {SQL_C} SELECT rec_id, rtrim(regexp_replace(seq, '(.{{60}})', '\\1\n', 'g'), chr(10)) AS wrapped, CASE WHEN length(seq) >= 495 THEN substr(seq, 390, length(seq) - 494) END AS trimmed, '>' || name AS header FROM c WHERE seq IS NOT NULL""")
def fasta_values(spark: SparkSession, d: str) -> DataFrame:
    """K1, K19, F19"""
    return contigs(spark, d).where("seq IS NOT NULL").select("rec_id", S.wrap(F.col("seq")).alias("wrapped"), S.trim_true(F.col("seq")).alias("trimmed"), F.concat(F.lit(">"), "name").alias("header"))


@query(f"""WITH {SQL_C}, o AS (SELECT gap_id, rec_id, seq, lead(seq) OVER (PARTITION BY gap_id ORDER BY rec_id) AS following FROM c WHERE gap_id IS NOT NULL AND seq IS NOT NULL)
SELECT rec_id, seq || repeat('N', 12) || following AS apart, seq || substr(following, 8) AS lapped, CASE WHEN 20 + 30 - 1 <= 50 THEN substr(seq, 20 + 30, 50 - (20 + 30 - 1)) END AS forward_fill, translate(reverse(substr(seq, 20 + 30, 90 - (20 + 30 - 1))), 'ACGTacgt', 'TGCATGCA') AS reverse_fill, left(seq, 10) || 'NN' || right(following, 10) AS extended FROM o WHERE following IS NOT NULL""")
def joined_contigs(spark: SparkSession, d: str) -> DataFrame:
    """F17, F18, F20"""
    from pyspark.sql.window import Window

    c = contigs(spark, d).where("gap_id IS NOT NULL AND seq IS NOT NULL").withColumn("following", F.lead("seq").over(Window.partitionBy("gap_id").orderBy("rec_id"))).where("following IS NOT NULL")
    s, n = F.col("seq"), F.col("following")
    return c.select("rec_id", S.join_scaffolds(s, n, F.lit(12)).alias("apart"), S.join_scaffolds(s, n, F.lit(-7)).alias("lapped"), S.bridge_fill(s, F.lit(20), F.lit(30), F.lit(50), F.lit(10), F.lit(False)).alias("forward_fill"), S.bridge_fill(s, F.lit(90), F.lit(10), F.lit(20), F.lit(30), F.lit(True)).alias("reverse_fill"), S.extended_fill(F.left(s, F.lit(10)), F.right(n, F.lit(10))).alias("extended"))


@query(f"WITH {SQL_C}, s AS (SELECT rname, string_agg(DISTINCT gap_id, ',' ORDER BY gap_id) AS gaps FROM c WHERE rname IS NOT NULL AND gap_id IS NOT NULL GROUP BY rname) SELECT * FROM s")
def gaps_of_scaffold(spark: SparkSession, d: str) -> DataFrame:
    """A19"""
    return contigs(spark, d).where("rname IS NOT NULL AND gap_id IS NOT NULL").groupBy("rname").agg(F.array_join(F.array_sort(F.collect_set("gap_id")), ",").alias("gaps"))


@query(f"""WITH {SQL_C}, l AS (SELECT rname AS root, name, CAST(length(seq) AS BIGINT) AS length FROM c WHERE seq IS NOT NULL AND rname IS NOT NULL) SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY root ORDER BY length DESC, name) <= 21""")
def longest_per_root(spark: SparkSession, d: str) -> DataFrame:
    """W7"""
    c = contigs(spark, d).where("seq IS NOT NULL AND rname IS NOT NULL").select(F.col("rname").alias("root"), "name", F.length("seq").cast("long").alias("length"))
    return A.longest_per_root(c, "root", "length", "name")


@query("WITH m AS (SELECT node_index AS line FROM kmer_nodes WHERE node_index IS NOT NULL) SELECT line FROM m WHERE line NOT IN (SELECT rec_id FROM contig_alns WHERE mapq >= 30 AND rec_id IS NOT NULL)")
def lines_not_in_other(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates stay"""
    k = table(spark, d, "kmer_nodes").where("node_index IS NOT NULL").select(F.col("node_index").alias("line"))
    return k.join(table(spark, d, "contig_alns").where("mapq >= 30").select(F.col("rec_id").alias("line")), "line", "left_anti")


@query(f"WITH {SQL_C}, r AS (SELECT DISTINCT node_index AS rec_id, pos FROM kmer_nodes WHERE pos >= 0) SELECT rec_id, r.pos AS pos, substr(seq, r.pos + 1, 15) AS part FROM c JOIN r USING (rec_id) WHERE seq IS NOT NULL")
def regions_of_contigs(spark: SparkSession, d: str) -> DataFrame:
    """J18, S13"""
    r = table(spark, d, "kmer_nodes").where("pos >= 0").select(F.col("node_index").alias("rec_id"), "pos").distinct()
    return contigs(spark, d).where("seq IS NOT NULL").select("rec_id", "seq").join(r, "rec_id").select("rec_id", "pos", F.expr("substring(seq, pos + 1, 15)").alias("part"))


@query(f"""WITH RECURSIVE {SQL_C}, {INSIDE}, e AS (SELECT qname AS x, rname AS y FROM i UNION SELECT rname, qname FROM i), t AS (SELECT x AS node, x AS c FROM e UNION SELECT e.y, t.c FROM t JOIN e ON e.x = t.node) SELECT node, min(c) AS component FROM t GROUP BY node""")
def contig_components(spark: SparkSession, d: str) -> DataFrame:
    """G11"""
    return G.weak_components(_inside(spark, d), "qname", "rname")


@query(f"""WITH RECURSIVE {SQL_C}, {INSIDE}, t AS (SELECT DISTINCT rname AS node, 0 AS depth FROM i WHERE rlen > 300 UNION SELECT i.qname, t.depth + 1 FROM t JOIN i ON i.rname = t.node WHERE i.qlen < i.rlen) SELECT node, min(depth) AS depth FROM t GROUP BY node""")
def reached_contigs(spark: SparkSession, d: str) -> DataFrame:
    """G8"""
    i = _inside(spark, d)
    return G.reach(i.where("qlen < rlen"), i.where("rlen > 300").select(F.col("rname").alias("node")), "rname", "qname")


PATHS = """e AS (SELECT DISTINCT rname AS s, qname AS t FROM i WHERE qlen < rlen), p AS (SELECT s AS root, [s] AS path FROM (SELECT DISTINCT s FROM e WHERE s NOT IN (SELECT t FROM e)) r
 UNION ALL SELECT root, list_append(path, t) FROM p JOIN e ON e.s = path[-1] WHERE NOT list_contains(path, t) AND len(path) < 4)"""


@query(f"WITH RECURSIVE {SQL_C}, {INSIDE}, {PATHS} SELECT root, array_to_string(path, ' ') AS path FROM p WHERE len(path) = 4 OR path[-1] NOT IN (SELECT s FROM e)")
def bounded_paths(spark: SparkSession, d: str) -> DataFrame:
    """Longest chains of contigs that lie in each other, of at most four"""
    i = _inside(spark, d).where("qlen < rlen")
    return G.maximal_paths(i, "rname", "qname", 4).select("root", F.array_join("path", " ").alias("path"))


GOOD = "regexp_full_match(cigar, '([0-9]+[MIDNSHP=X])+') AND greatest(coalesce(try_cast(nullif(regexp_extract(cigar, '^([0-9]+)[SH]', 1), '') AS BIGINT), 0), coalesce(try_cast(nullif(regexp_extract(cigar, '[A-Z=]([0-9]+)[SH]$', 1), '') AS BIGINT), 0)) < 20"


@query(f"WITH {SQL_C}, {SQL_G}, h AS (SELECT DISTINCT gap_id || '_' || qname AS id FROM c WHERE gap_id IS NOT NULL AND {GOOD}) SELECT id, g.gap_id, gap_len FROM h JOIN g ON g.gap_id = split_part(id, '_', 1) || '_' || split_part(id, '_', 2)")
def closed_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The contigs that lie on their scaffold unclipped, with the lengths of their gaps"""
    from seqloom.operators.evaluate import closed_gaps as f
    from seqloom.operators.evaluate import hit_list

    c = contigs(spark, d).where("gap_id IS NOT NULL").withColumn("id", F.concat_ws("_", "gap_id", "qname"))
    return f(hit_list(c, "id"), gaps(spark, d))


@query(f"WITH {SQL_C} SELECT count(DISTINCT gap_id) FILTER ({GOOD}) AS hits, count(DISTINCT qname) AS sequences FROM c")
def hits_and_sequences(spark: SparkSession, d: str) -> DataFrame:
    """A17, K16"""
    from seqloom.operators.evaluate import hits_and_sequences as f

    return f(contigs(spark, d), "qname", "gap_id")


@query(f"WITH {SQL_C}, {INSIDE} SELECT DISTINCT qname AS name FROM i WHERE (qlen - 1) / rlen >= 0.4")
def covering_contigs(spark: SparkSession, d: str) -> DataFrame:
    """The roles of the two are exchanged, so that a hit covers a part"""
    from seqloom.operators.evaluate import covering_queries

    i = _inside(spark, d).withColumns({"pair": F.concat_ws(" ", "qname", "rname")})
    hits = i.select(F.col("pair").alias("query"), F.col("rname").alias("subject"), F.lit(1).alias("q_start"), F.col("qlen").alias("q_end"))
    found = covering_queries(hits, i.select(F.col("pair").alias("name"), F.col("rlen").alias("length")), 0.4)
    return found.select(F.substring_index("name", " ", 1).alias("name")).distinct()


@query(f"""WITH {SQL_C}, o AS (SELECT rec_id, gap_id, pos, CAST(split_part(gap_id, '_', 1) AS INTEGER) = try_cast(substr(rname, 5) AS INTEGER) AS own FROM c WHERE pos IS NOT NULL AND gap_id IS NOT NULL),
l AS (SELECT *, lag(gap_id) OVER (PARTITION BY gap_id ORDER BY rec_id) AS bg, lag(pos) OVER (PARTITION BY gap_id ORDER BY rec_id) AS bp FROM o), s AS (SELECT gap_id, bp + 295 AS first, pos AS last FROM l WHERE bg = gap_id AND own QUALIFY row_number() OVER (PARTITION BY gap_id ORDER BY rec_id DESC) = 1) SELECT * FROM s WHERE first <= last""")
def filled_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Two contigs of a gap that follow each other stand for its flanks"""
    from seqloom.operators.evaluate import filled_stretches as f

    c = contigs(spark, d).where("gap_id IS NOT NULL")
    own = F.split("gap_id", "_")[0].try_cast("int") == F.substring("rname", 5, 20).try_cast("int")
    return f(c.withColumns({"own": own, "o": F.concat_ws("|", "gap_id", "name")}), "o", "gap_id", "pos", "own")


@query("SELECT CAST(row_number() OVER (ORDER BY scf_ord) - 1 AS BIGINT) AS id, scf_name AS name FROM scaffolds")
def reference_ids(spark: SparkSession, d: str) -> DataFrame:
    """S22, W2"""
    from seqloom.sources.text import ids_of

    return ids_of(table(spark, d, "scaffolds"), "scf_ord", "scf_name")


# ---- alignment and graph operators, tested against restatements and known answers instead of SQL


@query()
def verified_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """J11, D1, D2, D3"""
    c = contigs(spark, d).where("gap_id IS NOT NULL AND seq IS NOT NULL")
    pairs = K.overlap_candidates(c, "gap_id", "name", "seq").where("a < b").select("a", "b")
    return verify_pairs(pairs, c, "name", "seq")


@query()
def self_alignments(spark: SparkSession, d: str) -> DataFrame:
    """J9, D4"""
    return D.self_alignments(_with_parts(spark, d).where("seq IS NOT NULL"), "gap_id", "name", "seq")


@query()
def flank_alignments(spark: SparkSession, d: str) -> DataFrame:
    """D4 on the longest and each other contig of a gap"""
    from pyspark.sql.window import Window

    c = contigs(spark, d).where("gap_id IS NOT NULL AND seq IS NOT NULL").withColumn("top", F.first("seq").over(Window.partitionBy("gap_id").orderBy(F.length("seq").desc(), "name")))
    return c.select("gap_id", "name", local_column(F.col("seq"), F.col("top")).alias("o")).select("gap_id", "name", "o.*")


@query()
def merged_contigs(spark: SparkSession, d: str) -> DataFrame:
    """G1 to G5, G9, U6, W7, K8, D1 to D3"""
    return G.merge_contigs(contigs(spark, d).where("gap_id IS NOT NULL AND seq IS NOT NULL"), "gap_id", "name", "seq")


UNITIGS = """n AS (SELECT gap_id, substr(seq, i, 31) AS kmer, count(*) AS n FROM c, unnest(range(1, length(seq) - 29)) u(i) WHERE gap_id IS NOT NULL AND regexp_full_match(substr(seq, i, 31), '[ACGT]{31}') GROUP BY ALL),
e AS (SELECT x.gap_id, x.kmer AS a, y.kmer AS b FROM n x JOIN n y ON x.gap_id = y.gap_id AND substr(x.kmer, 2) = substr(y.kmer, 1, 30)),
l AS (SELECT * FROM e QUALIFY count(*) OVER (PARTITION BY gap_id, a) = 1 AND count(*) OVER (PARTITION BY gap_id, b) = 1),
t AS (SELECT gap_id, kmer AS cur, kmer AS seq, n AS total, 1 AS k FROM n WHERE (gap_id, kmer) NOT IN (SELECT (gap_id, b) FROM l)
 UNION ALL SELECT t.gap_id, l.b, t.seq || right(l.b, 1), t.total + n.n, k + 1 FROM t JOIN l ON l.gap_id = t.gap_id AND l.a = t.cur JOIN n ON n.gap_id = l.gap_id AND n.kmer = l.b)"""


@query(f"WITH RECURSIVE {SQL_C}, {UNITIGS} SELECT gap_id, seq, total / k AS mean_count FROM t WHERE (gap_id, cur) NOT IN (SELECT (gap_id, a) FROM l)")
def gap_unitigs(spark: SparkSession, d: str) -> DataFrame:
    """Section 2.15: our own assembler on the contigs' k-mers"""
    n = K.kmer_counts(contigs(spark, d).where("gap_id IS NOT NULL"), ["gap_id"], "seq", 31)
    return G.unitigs(n, "gap_id", "kmer", "n")


@query()
def scaffold_pairs(spark: SparkSession, d: str) -> DataFrame:
    """G10, command S: contigs that follow each other on their scaffold, at their distance there, whatever it is"""
    from seqloom.operators.scaffold import scaffold_pairs as f

    return f(*_neighbour_links(spark, d))


def _neighbour_links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Contigs and the links of those that follow each other on their scaffold."""
    from seqloom.operators.ordered import scan

    c = cut(contigs(spark, d).where("seq IS NOT NULL AND rname IS NOT NULL AND pos >= 1").select("rname", "pos", "name", "seq"))
    x = scan(c.select("rname", "pos", "name", F.length("seq").alias("bases")), ["rname"], ["pos", "name"], lasts={"l": F.struct("name", "pos", "bases")}, before=True).where("l IS NOT NULL")
    links = x.select(F.col("l.name").alias("l_name"), F.col("name").alias("r_name"), F.lit("+").alias("l_ori"), F.lit("+").alias("r_ori"), F.lit(2).cast("long").alias("pairs"), (F.col("pos") - F.col("l.pos") - F.col("l.bases")).cast("double").alias("mean_distance"))
    return links, c.select("name", "seq")


@query()
def compared_contigs(spark: SparkSession, d: str) -> DataFrame:
    """D5 to D9, commands A and M: contigs of a gap, of any length, that share at least one 15-mer, in part copies"""
    c = _with_parts(spark, d).where("seq IS NOT NULL")
    pairs = K.shared_counts(c, "gap_id", "name", "seq").select("a", "b")
    x, y = (c.select(F.col("name").alias(n), F.col("seq").alias(f"s_{n}")) for n in ("a", "b"))
    return spread(pairs.join(merge(x), "a").join(merge(y), "b")).select("a", "b", comparisons_column(F.col("s_a"), F.col("s_b")).alias("o")).select("a", "b", "o.*")


@query()
def simple_paths(spark: SparkSession, d: str) -> DataFrame:
    """Simple paths from every contig of a gap's candidate graph, of 50 contigs at most and 20 uses of a contig, as in the reference"""
    import pandas as pd

    edges = K.overlap_candidates(contigs(spark, d).where("gap_id IS NOT NULL"), "gap_id", "name", "seq").where("a < b")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        graph: G.Edges = {}
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            graph.setdefault(a, {})[b] = -1.0
        nodes = set(graph) | {b for after in graph.values() for b in after}
        rows = [(pdf["gap_id"].iloc[0], p[0], p) for p in G.simple_paths(sorted(nodes), graph)]
        return pd.DataFrame(rows, columns=["gap_id", "root", "path"])

    return spread(edges, "gap_id").groupBy("gap_id").applyInPandas(run, "gap_id string, root string, path array<string>")


@query()
def discarded_links(spark: SparkSession, d: str) -> DataFrame:
    """Links whose contigs don't overlap as they should"""
    from seqloom.operators.scaffold import discarded_links as f

    return f(*_neighbour_links(spark, d))


@query()
def picked_against_truth(spark: SparkSession, d: str) -> DataFrame:
    """A gap's well placed contigs against its longest one, which stands for the true sequence"""
    from seqloom.operators.evaluate import against_truth

    c = contigs(spark, d).where("gap_id IS NOT NULL AND seq IS NOT NULL")
    truth = c.groupBy("gap_id").agg(F.max_by("seq", F.struct(F.length("seq"), "name")).alias("seq"))
    return against_truth(c.where("mapq >= 30").select("gap_id", "name", "seq"), truth)


#: Contigs without repeated 31-mers, on either strand, as scaffolds with a gap of 40 bases in them; every third one's reads leave its middle open.
PLANTED = """o AS (SELECT rec_id, seq FROM c WHERE length(seq) BETWEEN 260 AND 500 AND regexp_full_match(seq, '[ACGT]+')),
w AS (SELECT rec_id, substr(seq, i, 31) AS k FROM o, unnest(range(1, length(seq) - 29)) u(i)), b AS (SELECT rec_id, k FROM w UNION ALL SELECT rec_id, translate(reverse(k), 'ACGT', 'TGCA') FROM w),
g AS (SELECT rec_id FROM b GROUP BY rec_id HAVING count(*) = count(DISTINCT k)), p AS (SELECT rec_id, seq FROM o JOIN g USING (rec_id))"""


@query(f"WITH {SQL_C}, {PLANTED} SELECT rec_id, CASE WHEN rec_id % 3 = 0 THEN 'extended' ELSE 'first' END AS step, CASE WHEN rec_id % 3 = 0 THEN substr(seq, 131, 15) || 'NN' || substr(seq, 156, 15) ELSE substr(seq, 131, 40) END AS fill, CASE WHEN rec_id % 3 = 0 THEN left(seq, 145) || 'NN' || substr(seq, 156) ELSE seq END AS filled FROM p")
def filled_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Sections 2.14b and 2.15, F16, K17: planted gaps, filled or extended and spliced"""
    from seqloom.operators.pick import splice_gaps

    s, end = F.col("seq"), F.length("seq")
    c = spread(contigs(spark, d).where("length(seq) BETWEEN 260 AND 500").where(s.rlike("^[ACGT]+$")).select("rec_id", F.col("rec_id").cast("string").alias("gap_id"), "seq"))
    c = cut(c.where(S.unrepeated(s, 31)))
    scaffolds = c.select(F.col("gap_id").alias("name"), F.concat(F.left(s, F.lit(130)), F.repeat(F.lit("N"), F.lit(40)), F.substring(s, F.lit(171), end)).alias("seq"))
    planted = c.select("gap_id", F.col("gap_id").alias("scaffold"), F.lit(130).alias("gap_start"), F.lit(170).alias("gap_end"))
    parts = F.when(F.col("rec_id") % 3 == 0, F.array(F.left(s, F.lit(145)), F.substring(s, F.lit(156), end))).otherwise(F.array(s))
    reads = c.select("gap_id", F.explode(F.concat(parts, parts)).alias("seq"))
    none = reads.where("false")
    fills = cut(P.fill_run(scaffolds, planted, reads, none.select(F.lit("").alias("qname"), F.lit(1).alias("mate"), "seq"), none.select("gap_id", F.lit("").alias("name"), "seq"), flank=100))
    whole = splice_gaps(scaffolds, planted, fills.select("gap_id", "fill")).withColumnRenamed("seq", "filled")
    return fills.join(merge(whole), fills["gap_id"] == whole["name"]).select(F.col("gap_id").cast("long").alias("rec_id"), "step", "fill", "filled")
