"""Queries p1_ and p2_ and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import cigar as C
from seqloom.operators.intervals import coverage_periods
from seqloom.operators.skew import exact_mode, exact_quantiles
from seqloom.records import latest, reference_name, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered periods and gaps of every bam and rname.

    A record that is delivered again covers the same bases, so nothing has to be told apart. Records with a null flag aren't
    known to be aligned and are left out; a null bam is a bam of its own.
    """
    a = table(spark, sf_dir, "alignments").where((F.col("flag").bitwiseAND(4) == 0) & (F.col("pos") >= 1) & C.is_valid(F.col("cigar")))
    a = a.select("bam", reference_name(F.col("rname")).alias("rname"), F.col("pos").cast("long").alias("pos"), C.reference_span(F.col("cigar")).alias("span")).where("rname IS NOT NULL")
    return coverage_periods(a, ["bam", "rname"], F.col("pos"), F.col("pos") + F.col("span") - 1)


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rname and pos of every record that has both; all deliveries of a record have the same."""
    a = latest(table(spark, sf_dir, "alignments"), "aln_id", ["rname", "pos"], where="pos >= 1")
    return a.select(reference_name(F.col("rname")).alias("rname"), "pos").where("rname IS NOT NULL")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every rname the pos at which most of its records start."""
    return exact_mode(_starts(spark, sf_dir), ["rname"], "pos").select("rname", F.col("value").cast("int").alias("pos"))


def p2_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every rname the exact quartiles and 95th percentile of pos."""
    return exact_quantiles(_starts(spark, sf_dir), ["rname"], "pos", [0.25, 0.5, 0.75, 0.95]).select("rname", "q", F.col("value").cast("int").alias("pos"), "n")


RNAME = "CASE WHEN regexp_extract(rname, '^[^\\s]*') NOT IN ('', '*') THEN regexp_extract(rname, '^[^\\s]*') END"
#: One row per record, with the columns the queries use.
RECORDS = f"""a AS (SELECT * EXCLUDE (rname), {RNAME} AS rname FROM alignments QUALIFY row_number() OVER (PARTITION BY aln_id ORDER BY loaded_at DESC) = 1)"""

QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_quantiles": p2_quantiles}

SQL = {
    "p1_found": f"""
WITH {RECORDS},
iv AS (SELECT bam, rname, CAST(pos AS BIGINT) AS s, CAST(pos + list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: CAST(x AS BIGINT))) - 1 AS BIGINT) AS e
       FROM a WHERE (flag & 4) = 0 AND rname IS NOT NULL AND pos >= 1 AND regexp_full_match(cigar, '([0-9]+[MIDNSHP=X])+')),
m AS (SELECT *, max(e) OVER (PARTITION BY bam, rname ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM iv WHERE e >= s),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY bam, rname ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
p AS (SELECT bam, rname, k, min(s) AS s, max(e) AS e FROM g GROUP BY ALL),
q AS (SELECT *, lead(s) OVER (PARTITION BY bam, rname ORDER BY k) AS n FROM p)
SELECT bam, rname, 'period' AS kind, s AS first_base, e AS last_base FROM q
UNION ALL SELECT bam, rname, 'gap', e + 1, n - 1 FROM q WHERE n IS NOT NULL""",
    "p2_found": f"""
WITH {RECORDS}, c AS (SELECT rname, pos, count(*) AS n FROM a WHERE rname IS NOT NULL AND pos >= 1 GROUP BY ALL)
SELECT rname, pos FROM c QUALIFY row_number() OVER (PARTITION BY rname ORDER BY n DESC, pos) = 1""",
    "p2_quantiles": f"""
WITH {RECORDS}, o AS (SELECT rname, pos, row_number() OVER (PARTITION BY rname ORDER BY pos) AS r, count(*) OVER (PARTITION BY rname) AS n FROM a WHERE rname IS NOT NULL AND pos >= 1)
SELECT rname, q, pos, n FROM o, (VALUES (CAST(0.25 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.75 AS DOUBLE)), (CAST(0.95 AS DOUBLE))) v(q) WHERE r = greatest(1, CAST(ceil(q * n) AS BIGINT))""",
}
