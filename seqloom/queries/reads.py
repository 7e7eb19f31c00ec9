"""Queries over alignments: predicates, selection of reads, coverage, linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions import cigar as C
from seqloom.functions import flags as B
from seqloom.operators import aggregates as A
from seqloom.operators import joins as J
from seqloom.operators.ordered import scan
from seqloom.queries.common import SQL_A, SQL_G, gaps, libraries, records, summed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


BITS = {"paired": 1, "unmapped": 4, "mate_unmapped": 8, "is_reverse": 16, "mate_reverse": 32, "is_first": 64, "is_second": 128, "is_secondary": 256, "qc_fail": 512, "is_duplicate": 1024}


@query(f"WITH {SQL_A} SELECT aln_id, " + ", ".join(f"(flag & {b}) <> 0 AS {n}" for n, b in BITS.items()) + " FROM a")
def flag_bits(spark: SparkSession, d: str) -> DataFrame:
    """P1"""
    return records(spark, d, "aln_id", "flag").select("aln_id", *[B.has(F.col("flag"), b).alias(n) for n, b in BITS.items()])


CLIPPED_SQL = "(regexp_matches(cigar, '^[0-9]+[SH]') OR regexp_matches(cigar, '[A-Z=][0-9]+[SH]$'))"
FULL_SQL = f"(regexp_full_match(cigar, '[0-9]+M') OR {summed('cigar', 'M')} > 0.99 * {summed('cigar', 'MSHI')})"
CLASS_SQL = f"""CASE WHEN (flag & 4) = 0 THEN CASE WHEN (flag & 2048) <> 0 THEN CASE WHEN regexp_matches(cigar, '^[0-9]+H') OR regexp_matches(cigar, '[A-Z=][0-9]+H$') THEN 'CLIP' ELSE 'OTHER' END
 WHEN {CLIPPED_SQL} THEN 'CLIP' WHEN {FULL_SQL} THEN 'FULLMAP' ELSE 'OTHER' END WHEN (flag & 8) = 0 THEN 'UNMAP_MATE' ELSE 'UNMAP_BOTH' END"""


@query(f"WITH {SQL_A} SELECT {CLASS_SQL} AS read_class, (CASE WHEN (flag & 4) = 0 THEN '1' ELSE '0' END) || (CASE WHEN (flag & 8) = 0 THEN '1' ELSE '0' END) AS pair_class, count(*) AS n FROM a GROUP BY ALL")
def read_classes(spark: SparkSession, d: str) -> DataFrame:
    """P2, P3"""
    return records(spark, d, "aln_id", "flag", "cigar").groupBy(B.read_class(F.col("flag"), F.col("cigar")).alias("read_class"), B.pair_class(F.col("flag")).alias("pair_class")).agg(F.count(F.lit(1)).alias("n"))


VALID = "regexp_full_match(cigar, '([0-9]+[MIDNSHP=X])+')"


@query(f"""WITH {SQL_A}, v AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(cigar, '^([0-9]+)[SH]', 1), '') AS BIGINT), 0) AS l, coalesce(try_cast(nullif(regexp_extract(cigar, '[A-Z=]([0-9]+)[SH]$', 1), '') AS BIGINT), 0) AS r,
 regexp_matches(cigar, '^[0-9]+[SH]') AS cl, regexp_matches(cigar, '[A-Z=][0-9]+[SH]$') AS cr FROM a WHERE {VALID})
SELECT aln_id, (CASE WHEN cl THEN 1 ELSE 0 END) + (CASE WHEN cr THEN 2 ELSE 0 END) AS clip_code, CASE WHEN cl AND cr THEN 'BOTH' WHEN cl THEN 'LEFT' WHEN cr THEN 'RIGHT' ELSE 'UNCLIP' END AS clip_type,
 l >= 10 OR r >= 10 AS qualified, {summed('cigar', 'M')} AS matched, {summed('cigar', 'MSHI')} AS query_length, {summed('cigar', 'MDN=X')} AS span,
 {FULL_SQL} AS fully, cigar = length(seq) || 'M' AS perfect, cigar = '101M' OR {summed('cigar', 'M')} > 0.85 * 101 AS fixed, array_to_string(list_transform(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), lambda x: CAST(x[:-2] AS BIGINT) || x[-1:]), '') AS rendered FROM v""")
def cigar_features(spark: SparkSession, d: str) -> DataFrame:
    """P4 to P11, F6, F7"""
    c = F.col("cigar")
    a = records(spark, d, "aln_id", "cigar", "seq", where=C.is_valid(c))
    return a.select("aln_id", C.clip_code(c).alias("clip_code"), C.clip_type(c).alias("clip_type"), C.is_qualified_clip(c, 10).alias("qualified"), C.matched(c).alias("matched"), C.query_length(c).alias("query_length"), C.reference_span(c).alias("span"), C.is_fully_mapped(c, 0.99).alias("fully"), C.is_perfectly_mapped(c, F.length("seq")).alias("perfect"), C.is_fully_mapped_fixed(c, 0.85, 101).alias("fixed"), C.render(C.parse(c)).alias("rendered"))


@query(f"""WITH {SQL_A}, v AS (SELECT *, regexp_extract(cigar, '^[0-9]+([SH])', 1) AS f, regexp_extract(cigar, '[A-Z=][0-9]+([SH])$', 1) AS l FROM a WHERE {VALID} AND pos >= 1)
SELECT aln_id, CASE WHEN f <> '' AND l <> '' THEN 'B' WHEN f <> '' THEN 'L' || f WHEN l <> '' THEN 'R' || l ELSE 'N' END AS code, CASE WHEN f <> '' THEN pos ELSE -1 END AS left_pos,
 CASE WHEN l <> '' THEN pos + {summed('cigar', 'MDN=X')} ELSE -1 END AS right_pos FROM v""")
def clip_places(spark: SparkSession, d: str) -> DataFrame:
    """P8"""
    a = records(spark, d, "aln_id", "cigar", "pos", where=C.is_valid(F.col("cigar")) & (F.col("pos") >= 1))
    return a.select("aln_id", C.clip_positions(F.col("pos"), F.col("cigar")).alias("p")).select("aln_id", "p.*")


@query(f"WITH {SQL_A} SELECT lib_id, count(*) FILTER (mapq >= 30) AS anchors, count(*) FILTER (mapq = 60) AS best, count(*) FILTER (mapq = 0) AS low, count(*) FILTER (mapq <> 255) AS known FROM a GROUP BY lib_id")
def mapq_classes(spark: SparkSession, d: str) -> DataFrame:
    """P12"""
    m = F.col("mapq")
    return records(spark, d, "aln_id", "lib_id", "mapq").groupBy("lib_id").agg(F.count_if(m >= 30).alias("anchors"), F.count_if(m == 60).alias("best"), F.count_if(m == 0).alias("low"), F.count_if(m != 255).alias("known"))


DISCORDANT = "(rnext <> '=' OR abs(CAST(tlen AS BIGINT)) >= insert_mean + 3 * insert_sd OR (insert_mean < 750 AND abs(CAST(tlen AS BIGINT)) <= insert_mean - 3 * insert_sd))"


@query(f"WITH {SQL_A} SELECT aln_id, {DISCORDANT} AS discordant FROM a JOIN libraries USING (lib_id) WHERE (flag & 12) = 0 AND mapq >= 30")
def discordant_reads(spark: SparkSession, d: str) -> DataFrame:
    """P13"""
    a = records(spark, d, "aln_id", "lib_id", "flag", "mapq", "rnext", "tlen", where=(F.col("flag").bitwiseAND(12) == 0) & (F.col("mapq") >= 30)).join(libraries(spark, d), "lib_id")
    return a.select("aln_id", B.is_discordant(F.col("rnext"), F.col("tlen"), F.col("insert_mean"), F.col("insert_sd")).alias("discordant"))


#: Widest mean + 3 sd of the libraries here; narrower ones are held to their own.
REACH = 465
SELECT_SQL = f"""
{SQL_A}, {SQL_G}, r AS (SELECT * FROM a JOIN libraries USING (lib_id)),
z AS (SELECT gap_id, scaffold, gap_len, 0 AS side, gap_start AS anchor FROM g UNION ALL SELECT gap_id, scaffold, gap_len, 1, gap_end FROM g),
h AS (SELECT r.*, gap_id, gap_len, side, abs(pos - anchor) AS dist, (CASE WHEN regexp_matches(cigar, '^[0-9]+[SH]') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(cigar, '[A-Z=][0-9]+[SH]$') THEN 2 ELSE 0 END) AS code,
 CASE WHEN (flag & 64) <> 0 THEN 1 ELSE 2 END AS m
 FROM r JOIN z ON r.rname = z.scaffold AND CASE WHEN side = 0 THEN pos <= anchor AND pos >= 0 ELSE pos >= anchor END AND abs(pos - anchor) < insert_mean + 3 * insert_sd),
s AS (
 SELECT aln_id, qname, gap_id, side, mapq, 'clip' AS kind, m AS mate, NULL AS map_pos, NULL AS mate_ref, NULL AS mate_pos, NULL AS gap_len FROM h WHERE cigar IS NOT NULL AND dist <= 250 AND ((side = 0 AND code >= 2) OR (side = 1 AND code IN (1, 3)))
 UNION ALL SELECT aln_id, qname, gap_id, side, mapq, 'discordant', 3 - m, pos, rnext, pnext, gap_len FROM h WHERE (flag & 12) = 0 AND mapq >= 30 AND {DISCORDANT}
 UNION ALL SELECT aln_id, qname, gap_id, side, mapq, 'unmap', 3 - m, NULL, NULL, NULL, NULL FROM h WHERE (flag & 4) = 0 AND (flag & 8) <> 0)"""


def selected(spark: SparkSession, d: str) -> DataFrame:
    cols = ["aln_id", "lib_id", "qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen"]
    return J.select_reads(records(spark, d, *cols), gaps(spark, d), libraries(spark, d), REACH)


@query(f"WITH {SELECT_SQL} SELECT * FROM s")
def select_reads(spark: SparkSession, d: str) -> DataFrame:
    """J1, K6"""
    return selected(spark, d)


PLACES = "l AS (SELECT DISTINCT mate_ref AS rname, mate_pos AS place, gap_id FROM s WHERE kind = 'discordant' AND mate_ref <> '=' AND mate_ref <> '*' AND mate_pos IS NOT NULL)"


def _places(s: DataFrame) -> DataFrame:
    return s.where("kind = 'discordant' AND mate_ref <> '=' AND mate_ref <> '*' AND mate_pos IS NOT NULL").select(F.col("mate_ref").alias("rname"), F.col("mate_pos").alias("place"), "gap_id").distinct()


@query(f"""WITH {SELECT_SQL}, {PLACES}, b AS (SELECT aln_id, max(place) AS place FROM a JOIN l ON a.rname = l.rname AND pos BETWEEN place - 199 AND place + 299 WHERE mapq <= 20 GROUP BY aln_id)
SELECT a.aln_id, a.qname, l.gap_id, a.mapq FROM b JOIN a USING (aln_id) JOIN l ON l.rname = a.rname AND l.place = b.place""")
def low_mapq_reads(spark: SparkSession, d: str) -> DataFrame:
    """J2, P12"""
    return J.low_mapq_reads(records(spark, d, "aln_id", "qname", "rname", "pos", "mapq"), _places(selected(spark, d)), 20)


@query(f"WITH {SQL_G} SELECT scf_ord, scf_name, seq_len FROM scaffolds WHERE scf_name IN (SELECT scaffold FROM g)")
def scaffolds_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """J3"""
    return J.with_gaps(spark.read.parquet(f"{d}/scaffolds.parquet").select("scf_ord", "scf_name", "seq_len"), gaps(spark, d))


SENT = "x AS (SELECT aln_id AS read, qname, CASE WHEN (flag & 64) <> 0 THEN 1 ELSE 2 END AS mate, length(seq) AS bases FROM a WHERE seq <> '*')"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, "aln_id", "qname", "flag", "seq").where("seq <> '*'").select(F.col("aln_id").alias("read"), "qname", B.mate_number(F.col("flag")).alias("mate"), F.length("seq").alias("bases"))


@query(f"WITH {SELECT_SQL}, {SENT} SELECT read, qname, mate, gap_id, bases FROM x JOIN (SELECT DISTINCT qname, mate, gap_id FROM s) USING (qname, mate)")
def dispatched_reads(spark: SparkSession, d: str) -> DataFrame:
    """J4, A9, U1"""
    return J.dispatch(_raw(spark, d), selected(spark, d)).select("read", "qname", "mate", "gap_id", "bases")


@query(f"WITH {SELECT_SQL}, {SENT} SELECT read, qname, mate, gap_id, bases FROM x JOIN (SELECT DISTINCT qname, mate, gap_id FROM s WHERE mapq = 60) USING (qname, mate)")
def high_quality_reads(spark: SparkSession, d: str) -> DataFrame:
    """J5, J6"""
    return J.dispatch(_raw(spark, d), selected(spark, d).where("mapq = 60")).select("read", "qname", "mate", "gap_id", "bases")


@query(f"WITH {SELECT_SQL}, w AS (SELECT qname, gap_id FROM s WHERE kind = 'discordant' UNION SELECT qname, gap_id FROM s) SELECT gap_id, count(*) AS reads FROM w GROUP BY gap_id")
def reads_per_gap(spark: SparkSession, d: str) -> DataFrame:
    """U1, A9"""
    s = selected(spark, d).select("kind", "qname", "gap_id")
    return s.where("kind = 'discordant'").select("qname", "gap_id").union(s.select("qname", "gap_id")).distinct().groupBy("gap_id").agg(F.count(F.lit(1)).alias("reads"))


@query(f"WITH {SELECT_SQL} SELECT DISTINCT qname, mate FROM s WHERE kind = 'discordant'")
def discordant_ids(spark: SparkSession, d: str) -> DataFrame:
    """A21"""
    return selected(spark, d).where("kind = 'discordant'").select("qname", "mate").distinct()


@query(f"WITH {SELECT_SQL}, {PLACES} SELECT rname, place, count(*) AS gaps, string_agg(gap_id, ',' ORDER BY gap_id) AS gap_ids FROM l GROUP BY ALL")
def places_to_gaps(spark: SparkSession, d: str) -> DataFrame:
    """A place's gaps are as many as gaps sent a mate there"""
    return _places(selected(spark, d)).groupBy("rname", "place").agg(F.count(F.lit(1)).alias("gaps"), F.array_join(F.array_sort(F.collect_list("gap_id")), ",").alias("gap_ids"))


@query(f"WITH {SQL_A}, {SQL_G}, n AS (SELECT gap_id, gap_start, gap_end, scf_ord, row_number() OVER (PARTITION BY scaffold ORDER BY gap_start, gap_end, gap_id) AS gap_ord FROM g JOIN scaffolds ON scf_name = scaffold) SELECT gap_id, scf_ord || '_' || gap_ord AS counted_id, gap_start, gap_end FROM n")
def gap_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """W1, W2, J7"""
    s = spark.read.parquet(f"{d}/scaffolds.parquet").select("scf_ord", F.col("scf_name").alias("scaffold"))
    n = F.row_number().over(Window.partitionBy("scaffold").orderBy("gap_start", "gap_end", "gap_id"))
    return gaps(spark, d).join(s, "scaffold").withColumn("gap_ord", n).select("gap_id", F.concat_ws("_", "scf_ord", "gap_ord").alias("counted_id"), "gap_start", "gap_end")


@query(f"WITH {SQL_G} SELECT gap_id, scaffold, gap_len FROM g WHERE gap_len >= 100")
def long_gaps(spark: SparkSession, d: str) -> DataFrame:
    """P14, S14, K4"""
    return gaps(spark, d).where("gap_len >= 100").select("gap_id", "scaffold", "gap_len")


@query(f"WITH {SQL_A} SELECT qname || '_' || (CASE WHEN flag > 128 THEN 2 ELSE 1 END) AS read_id, CASE WHEN flag > 128 THEN 2 ELSE 1 END AS mate, length(seq) AS bases FROM a WHERE (flag & 12) = 12")
def both_unmapped(spark: SparkSession, d: str) -> DataFrame:
    """S10, P20"""
    from seqloom.sources.text import both_unmapped as f

    return f(records(spark, d, "aln_id", "qname", "flag", "seq", "qual", where=F.col("flag").bitwiseAND(12) == 12)).select("read_id", "mate", F.length("seq").alias("bases"))


@query(f"WITH {SQL_A}, u AS (SELECT qname, CASE WHEN flag > 128 THEN 2 ELSE 1 END AS mate, seq FROM a WHERE (flag & 12) = 12) SELECT qname, x.seq AS seq_1, y.seq AS seq_2 FROM u x JOIN u y USING (qname) WHERE x.mate = 1 AND y.mate = 2")
def unmapped_pairs(spark: SparkSession, d: str) -> DataFrame:
    """J14"""
    a = records(spark, d, "aln_id", "qname", "flag", "seq", where=F.col("flag").bitwiseAND(12) == 12)
    return J.pair_up(a.select("qname", B.mate_suffix(F.col("flag")).alias("mate"), "seq"))


RESCUE = "y AS (SELECT DISTINCT x.qname, CASE WHEN (x.flag & 64) <> 0 THEN 1 ELSE 2 END AS mate, x.rname AS gap_id, x.flag, x.rnext AS mate_gap FROM a x WHERE (x.flag & 4) = 0 AND x.rname IS NOT NULL)"


@query(f"WITH {SQL_A}, {RESCUE}, p AS (SELECT DISTINCT qname, CASE WHEN (flag & 64) <> 0 THEN 1 ELSE 2 END AS mate FROM a) SELECT DISTINCT y.qname, 3 - y.mate AS mate, y.gap_id FROM y JOIN p ON p.qname = y.qname AND p.mate = 3 - y.mate WHERE (y.flag & 8) <> 0 OR (mate_gap IS NOT NULL AND mate_gap <> '=' AND mate_gap <> y.gap_id)")
def rescued_mates(spark: SparkSession, d: str) -> DataFrame:
    """A scaffold stands for a gap's contig"""
    a = records(spark, d, "aln_id", "qname", "flag", "rname", "rnext")
    mate = B.mate_number(F.col("flag"))
    aligned = a.where((F.col("flag").bitwiseAND(4) == 0) & F.col("rname").isNotNull()).select("qname", mate.alias("mate"), F.col("rname").alias("gap_id"), "flag", F.col("rnext").alias("mate_gap"))
    return J.rescue_mates(aligned, a.select("qname", mate.alias("mate")))


@query(f"""WITH {SQL_A}, k AS (SELECT rname, count(*) FILTER ({CLASS_SQL} = 'FULLMAP') AS "full", count(*) FILTER ({CLASS_SQL} = 'CLIP') AS clip FROM a WHERE rname IS NOT NULL GROUP BY rname)
SELECT rname, "full", clip, CASE WHEN "full" + clip > 0 THEN "full" / ("full" + clip) END AS ratio, coalesce("full" >= 0.85 * ("full" + clip), TRUE) AS keep FROM k""")
def clip_ratios(spark: SparkSession, d: str) -> DataFrame:
    """A1, command C"""
    r = A.clip_ratio(records(spark, d, "aln_id", "rname", "flag", "cigar").where("rname IS NOT NULL"), "rname", 0.85)
    return r


PAIRS = f"""e AS (SELECT rname AS l_name, rnext AS r_name, CASE WHEN (flag & 16) <> 0 THEN '-' ELSE '+' END AS l_ori, CASE WHEN (flag & 32) <> 0 THEN '-' ELSE '+' END AS r_ori, 300 - (seq_len - pos) - (pnext + 101) AS distance
 FROM a JOIN scaffolds ON scf_name = rname WHERE (flag & 64) <> 0 AND (flag & 12) = 0 AND rnext <> '=' AND rnext <> rname AND seq_len - pos <= 300 + 3 * 5000 - 101 AND pnext <= 300 + 3 * 5000 - 101)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    a = records(spark, d, "aln_id", "flag", "rname", "pos", "rnext", "pnext", where=(F.col("flag").bitwiseAND(76) == 64) & (F.col("rnext") != "="))
    return A.read_pairs_across(a, spark.read.parquet(f"{d}/scaffolds.parquet").select(F.col("scf_name").alias("name"), F.col("seq_len").alias("length")), 300, 5000, 101)


@query(f"WITH {SQL_A}, {PAIRS} SELECT * FROM e")
def linked_pairs(spark: SparkSession, d: str) -> DataFrame:
    """P15, F15"""
    return _pairs(spark, d).select("l_name", "r_name", "l_ori", "r_ori", "distance")


LINKS = "k AS (SELECT l_name, r_name, l_ori, r_ori, count(*) AS pairs, min(distance) AS min_distance, max(distance) AS max_distance, avg(distance) AS mean_distance FROM e GROUP BY ALL HAVING count(*) > 0)"


@query(f"WITH {SQL_A}, {PAIRS}, {LINKS} SELECT * FROM k")
def contig_links(spark: SparkSession, d: str) -> DataFrame:
    """A2, W8, O3, K13, command L"""
    return A.linkage(_pairs(spark, d), 0)


@query(f"WITH {SQL_A}, {PAIRS}, {LINKS} SELECT *, CAST(floor(avg(pairs) OVER (PARTITION BY l_name)) AS BIGINT) AS mean_pairs FROM k QUALIFY pairs >= mean_pairs")
def strong_links(spark: SparkSession, d: str) -> DataFrame:
    """A15"""
    return A.strong_links(A.linkage(_pairs(spark, d), 0))


@query(f"""WITH {SQL_A}, {PAIRS}, {LINKS}, t AS (SELECT CASE WHEN l_ori = '-' THEN l_name || '_R' ELSE l_name END AS a, CASE WHEN r_ori = '-' THEN r_name || '_R' ELSE r_name END AS b FROM k WHERE pairs >= 1)
SELECT a, b FROM t UNION SELECT b, a FROM t""")
def symmetric_links(spark: SparkSession, d: str) -> DataFrame:
    """J17"""
    k = A.linkage(_pairs(spark, d), 0)
    return J.symmetric_links(k.select(F.col("l_name").alias("a"), F.col("l_ori").alias("a_ori"), F.col("r_name").alias("b"), F.col("r_ori").alias("b_ori"), F.col("pairs").alias("n")), 1)


SPANS = f"i AS (SELECT rname, CAST(pos AS BIGINT) AS f, CAST(pos + {summed('cigar', 'MDN=X')} - 1 AS BIGINT) AS l, cigar FROM a WHERE rname IS NOT NULL AND pos >= 1 AND (flag & 1796) = 0 AND {VALID})"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    a = records(spark, d, "aln_id", "rname", "flag", "pos", "cigar", where=(F.col("pos") >= 1) & A.usable(F.col("flag")) & B.is_mapped(F.col("flag")) & C.is_valid(F.col("cigar"))).where("rname IS NOT NULL")
    return a.select("rname", F.col("pos").cast("long").alias("first"), (F.col("pos") + C.reference_span(F.col("cigar")) - 1).alias("last"), "cigar")


RUNS = """v AS (SELECT rname, x, sum(d) AS d FROM (SELECT rname, f AS x, 1 AS d FROM i WHERE f <= l UNION ALL SELECT rname, l + 1, -1 FROM i WHERE f <= l) GROUP BY ALL HAVING sum(d) <> 0),
w AS (SELECT rname, x AS first, CAST(sum(d) OVER (PARTITION BY rname ORDER BY x) AS BIGINT) AS depth, lead(x) OVER (PARTITION BY rname ORDER BY x) - 1 AS last FROM v)"""


@query(f"WITH {SQL_A}, {SPANS}, {RUNS} SELECT rname, first, last, depth FROM w WHERE depth > 0")
def depth_runs(spark: SparkSession, d: str) -> DataFrame:
    """A3, K11"""
    return A.depth_runs(_spans(spark, d), ["rname"])


COVER = "y AS (SELECT rname, CAST(sum(last - first + 1) AS BIGINT) AS covered, CAST(sum((last - first + 1) * depth) AS BIGINT) AS bases, max(depth) AS max_depth FROM w WHERE depth > 0 GROUP BY rname)"


@query(f"WITH {SQL_A}, {SPANS}, {RUNS}, {COVER} SELECT *, bases / covered AS mean_depth FROM y")
def scaffold_coverage(spark: SparkSession, d: str) -> DataFrame:
    """A3, A6, K10, command B"""
    return A.coverage(_spans(spark, d), ["rname"])


@query(f"WITH {SQL_A}, {SPANS}, {RUNS}, {COVER} SELECT CAST(sum(bases) AS BIGINT) AS total_bases, CAST(sum(covered) AS BIGINT) AS total_covered FROM y")
def total_bases(spark: SparkSession, d: str) -> DataFrame:
    """A5"""
    return A.coverage(_spans(spark, d), ["rname"]).agg(F.sum("bases").alias("total_bases"), F.sum("covered").alias("total_covered"))


@query(f"""WITH {SQL_A}, m AS (SELECT scf_name, seq_len, {summed('cigar', 'M')} AS m FROM a JOIN scaffolds ON scf_name = rname WHERE (flag & 1792) = 0)
SELECT scf_name, seq_len, CAST(coalesce(sum(m) FILTER (m >= 0.85 * 101), 0) AS BIGINT) AS matched, coalesce(sum(m) FILTER (m >= 0.85 * 101), 0) / seq_len AS coverage FROM m GROUP BY scf_name, seq_len""")
def cutoff_coverage(spark: SparkSession, d: str) -> DataFrame:
    """A4, command G"""
    a = records(spark, d, "aln_id", "rname", "flag", "cigar").join(spark.read.parquet(f"{d}/scaffolds.parquet").select(F.col("scf_name"), "seq_len").withColumn("rname", F.col("scf_name")), "rname")
    return A.cutoff_coverage(a, "scf_name", "seq_len", 101, 0.85)


@query(f"""WITH {SQL_A}, {PAIRS}, {LINKS}, {SPANS}, {RUNS}, {COVER}, q AS (SELECT k.*, x.bases / x.covered AS l_cov, z.bases / z.covered AS r_cov FROM k JOIN y x ON x.rname = l_name JOIN y z ON z.rname = r_name)
SELECT * FROM q WHERE greatest(l_cov, r_cov) > 0 AND greatest(l_cov, r_cov) - least(l_cov, r_cov) <= 0.5 * greatest(l_cov, r_cov)""")
def links_of_like_coverage(spark: SparkSession, d: str) -> DataFrame:
    """P16, J16"""
    from seqloom.operators.scaffold import similar_coverage

    cov = A.coverage(_spans(spark, d), ["rname"]).select(F.col("rname").alias("name"), F.col("mean_depth").alias("coverage"))
    return similar_coverage(A.linkage(_pairs(spark, d), 0), cov, 0.5)


@query(f"""WITH {SQL_A}, {SPANS}, {RUNS}, {COVER}, b AS (SELECT rname, max({summed('cigar', 'M')}) AS longest, sum({summed('cigar', 'M')}) AS mapped FROM i GROUP BY rname)
SELECT scf_name, seq_len, covered, longest, CAST(mapped AS BIGINT) AS mapped, bases / covered AS mean_depth FROM scaffolds JOIN y ON y.rname = scf_name JOIN b ON b.rname = scf_name WHERE longest >= 0.02 * seq_len""")
def benchmark_cover(spark: SparkSession, d: str) -> DataFrame:
    """A7, K12, command E"""
    s = _spans(spark, d)
    m = s.groupBy("rname").agg(F.max(C.matched(F.col("cigar"))).alias("longest"), F.sum(C.matched(F.col("cigar"))).alias("mapped"))
    sc = spark.read.parquet(f"{d}/scaffolds.parquet").select("scf_name", "seq_len", F.col("scf_name").alias("rname"))
    return sc.join(A.coverage(s, ["rname"]), "rname").join(m, "rname").where("longest >= 0.02 * seq_len").select("scf_name", "seq_len", "covered", "longest", "mapped", "mean_depth")


@query(f"""WITH RECURSIVE {SQL_A}, {SPANS}, n AS (SELECT rname, f, min(l) AS l FROM i WHERE f <= l GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY rname ORDER BY l, f) AS k FROM n),
t AS (SELECT rname, k, l AS e, CAST(l - f + 1 AS BIGINT) AS total FROM o WHERE k = 1 UNION ALL SELECT o.rname, o.k, CASE WHEN o.f >= e THEN o.l ELSE e END, CASE WHEN o.f >= e THEN total + o.l - o.f + 1 ELSE total END FROM t JOIN o ON o.rname = t.rname AND o.k = t.k + 1)
SELECT rname, max(total) AS total FROM t GROUP BY rname""")
def greedy_totals(spark: SparkSession, d: str) -> DataFrame:
    """A8, O5"""
    return A.greedy_total(_spans(spark, d).where("first <= last"), ["rname"])


@query(f"WITH {SELECT_SQL} SELECT qname, count(DISTINCT gap_id) AS gaps FROM s WHERE kind = 'clip' GROUP BY qname HAVING count(DISTINCT gap_id) >= 2")
def reads_clipped_at_several(spark: SparkSession, d: str) -> DataFrame:
    """A gap stands for a contig"""
    return selected(spark, d).where("kind = 'clip'").groupBy("qname").agg(F.count_distinct("gap_id").alias("gaps")).where("gaps >= 2")


@query(f"WITH {SQL_A} SELECT rname, count(DISTINCT qname) AS reads FROM a WHERE rname IS NOT NULL AND {VALID} AND greatest(coalesce(try_cast(nullif(regexp_extract(cigar, '^([0-9]+)[SH]', 1), '') AS BIGINT), 0), coalesce(try_cast(nullif(regexp_extract(cigar, '[A-Z=]([0-9]+)[SH]$', 1), '') AS BIGINT), 0)) < 20 GROUP BY rname")
def unclipped_hits(spark: SparkSession, d: str) -> DataFrame:
    """A17"""
    a = records(spark, d, "aln_id", "qname", "rname", "cigar", where=C.is_valid(F.col("cigar"))).where(F.col("rname").isNotNull() & ~C.is_qualified_clip(F.col("cigar"), 20))
    return a.groupBy("rname").agg(F.count_distinct("qname").alias("reads"))


@query(f"WITH {SQL_A} SELECT bam, count(*) AS records, count(*) FILTER ((flag & 4) = 0) AS aligned FROM a GROUP BY bam")
def aligned_counts(spark: SparkSession, d: str) -> DataFrame:
    """A18"""
    return records(spark, d, "aln_id", "bam", "flag").groupBy("bam").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("flag").bitwiseAND(4) == 0).alias("aligned"))


HITS = f"""h AS (SELECT gap_id, CAST(lib_id AS VARCHAR) AS contig, CASE WHEN pos <= gap_start THEN 'left' ELSE 'right' END AS side, flag, CAST(pos AS BIGINT) AS pos, {summed('cigar', 'M')} AS matched, aln_id,
 CASE WHEN regexp_matches(cigar, '^[0-9]+[SH]') THEN CASE WHEN regexp_matches(cigar, '[A-Z=][0-9]+[SH]$') THEN 'BOTH' ELSE 'LEFT' END WHEN regexp_matches(cigar, '[A-Z=][0-9]+[SH]$') THEN 'RIGHT' ELSE 'UNCLIP' END AS clip
 FROM a JOIN g ON rname = scaffold AND (pos BETWEEN gap_start - 250 AND gap_start OR pos BETWEEN gap_end AND gap_end + 250) WHERE {VALID} AND (flag & 4) = 0)"""


def hits_near_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Reads beside gaps as if they were flanks on contigs: the library stands for the contig."""
    a = records(spark, d, "aln_id", "lib_id", "flag", "rname", "pos", "cigar").where(C.is_valid(F.col("cigar")))
    h = J.range_join(a, J.gap_sides(gaps(spark, d), 251).withColumn("low", F.when(F.col("side") == 0, F.col("anchor") - 250).otherwise(F.col("low"))), "rname", "pos", "low", "high").join(gaps(spark, d).select("gap_id", "gap_start"), "gap_id")
    x = h.select("gap_id", F.col("lib_id").cast("string").alias("contig"), F.when(F.col("pos") <= F.col("gap_start"), "left").otherwise("right").alias("side"), "flag", F.col("pos").cast("long").alias("pos"), "cigar", F.col("aln_id").alias("ord"))
    return x.distinct()


BEST = "p AS (SELECT DISTINCT * FROM h WHERE clip <> 'BOTH'), q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY gap_id, contig, side, clip ORDER BY matched DESC, aln_id) = 1)"


@query(f"WITH {SQL_A}, {SQL_G}, {HITS}, {BEST} SELECT gap_id, contig, side, clip, flag, pos, matched FROM q")
def best_flank_hits(spark: SparkSession, d: str) -> DataFrame:
    """A13, O8"""
    from seqloom.operators.pick import flank_hits

    return flank_hits(hits_near_gaps(spark, d)).select("gap_id", "contig", "side", "clip", "flag", "pos", "matched")


BRIDGE = """j AS (SELECT x.gap_id, x.contig, x.clip AS l_clip, x.pos AS l_pos, x.matched AS l_matched, x.flag AS l_flag, y.clip AS r_clip, y.pos AS r_pos, y.matched AS r_matched, y.flag AS r_flag, x.matched + y.matched AS sum
 FROM q x JOIN q y ON x.gap_id = y.gap_id AND x.contig = y.contig AND x.side = 'left' AND y.side = 'right' WHERE (x.clip <> y.clip OR x.clip = 'UNCLIP') AND (x.flag & 16) = (y.flag & 16)),
b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY gap_id, contig ORDER BY sum DESC, CASE l_clip WHEN 'UNCLIP' THEN 0 WHEN 'LEFT' THEN 3 ELSE 6 END + CASE r_clip WHEN 'UNCLIP' THEN 0 WHEN 'LEFT' THEN 1 ELSE 2 END) = 1)"""


@query(f"WITH {SQL_A}, {SQL_G}, {HITS}, {BEST}, {BRIDGE} SELECT gap_id, contig, sum, l_clip, l_pos, l_matched, l_flag, r_clip, r_pos, r_matched, r_flag FROM b")
def bridging_hits(spark: SparkSession, d: str) -> DataFrame:
    """J15"""
    from seqloom.operators.pick import flank_hits

    return J.bridging_hits(flank_hits(hits_near_gaps(spark, d)))


@query(f"""WITH {SQL_A}, {SQL_G}, {HITS}, {BEST}, {BRIDGE}, s AS (SELECT gap_id, contig, (l_flag & 16) <> 0 AS reverse, CASE WHEN (l_flag & 16) <> 0 THEN l_pos - (r_pos + r_matched - 1) ELSE r_pos - (l_pos + l_matched - 1) END AS span FROM b)
SELECT * FROM s WHERE span > -1 QUALIFY row_number() OVER (PARTITION BY gap_id ORDER BY span DESC, contig) = 1""")
def best_bridges(spark: SparkSession, d: str) -> DataFrame:
    """W6"""
    from seqloom.operators.pick import pick_bridging

    h = hits_near_gaps(spark, d)
    none = h.select("gap_id", "contig").distinct().withColumn("seq", F.lit(""))
    return pick_bridging(h, none).select("gap_id", "contig", "reverse", "span")


@query(f"WITH {SQL_A}, o AS (SELECT aln_id, rname, pos, CASE WHEN (flag & 16) <> 0 THEN 'right' ELSE 'left' END AS side, lag(CASE WHEN (flag & 16) <> 0 THEN 'right' ELSE 'left' END) OVER w AS before_side, lag(pos) OVER w AS before_pos, lag(aln_id) OVER w AS before_aln_id FROM a WHERE rname IS NOT NULL AND pos >= 1 WINDOW w AS (PARTITION BY rname ORDER BY aln_id)) SELECT aln_id, rname, before_pos + 299 AS first, pos AS last FROM o WHERE before_side <> side AND before_aln_id = aln_id - 1")
def paired_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours in file order on one scaffold and opposite sides span a stretch"""
    a = records(spark, d, "aln_id", "rname", "pos", "flag", where="pos >= 1").where("rname IS NOT NULL").withColumn("side", F.when(B.has(F.col("flag"), 16), "right").otherwise("left"))
    x = A.consecutive_pairs(a.select("aln_id", "rname", "pos", "side"), "aln_id", ["rname"], "side")
    return x.select("aln_id", "rname", (F.col("before_pos") + 299).alias("first"), F.col("pos").alias("last"))


@query(f"WITH {SQL_A} SELECT rname, pos, qname, aln_id, row_number() OVER (PARTITION BY rname ORDER BY pos, qname, aln_id) AS place FROM a WHERE rname IS NOT NULL AND pos >= 1")
def by_coordinate(spark: SparkSession, d: str) -> DataFrame:
    """O2, O7"""
    a = records(spark, d, "aln_id", "rname", "pos", "qname", where="pos >= 1").where("rname IS NOT NULL")
    return scan(a, ["rname"], ["pos", "qname", "aln_id"], {"place": F.lit(1)}).select("rname", "pos", "qname", "aln_id", "place")


@query(f"WITH {SQL_A} SELECT DISTINCT rname AS name, coalesce(seq_len, 0) AS length FROM a LEFT JOIN scaffolds ON scf_name = rname WHERE rname IS NOT NULL")
def reference_lengths(spark: SparkSession, d: str) -> DataFrame:
    """A name without an index entry has length 0"""
    s = spark.read.parquet(f"{d}/scaffolds.parquet").select(F.col("scf_name").alias("name"), "seq_len")
    return records(spark, d, "aln_id", "rname").where("rname IS NOT NULL").select(F.col("rname").alias("name")).distinct().join(s, "name", "left").select("name", F.coalesce("seq_len", F.lit(0)).alias("length"))


@query(f"WITH {SQL_A} SELECT aln_id, rname, pos, qname FROM a WHERE rname = 'scf_00000003' AND pos BETWEEN 1000 AND 5000")
def region_scan(spark: SparkSession, d: str) -> DataFrame:
    """A region of a table; the filters reach the scan, before deliveries are told apart"""
    near = "rname LIKE 'scf_00000003%' AND pos BETWEEN 1000 AND 5000"
    return records(spark, d, "aln_id", "rname", "pos", "qname", where=near).where("rname = 'scf_00000003'").select("aln_id", "rname", "pos", "qname")
