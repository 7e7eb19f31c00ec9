"""Tables as the queries use them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.queries.problems import RECORDS
from seqloom.records import latest, reference_name, table

COLUMNS = ["aln_id", "bam", "lib_id", "qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]


def records(spark: SparkSession, d: str, *columns: str, where: Column | str | None = None) -> DataFrame:
    """One row per alignment record, rname cleaned. ``where`` is asked of the deliveries, which are equal but for their time."""
    a = latest(table(spark, d, "alignments"), "aln_id", list(columns or COLUMNS), where=where)
    return a.withColumn("rname", reference_name(F.col("rname"))) if "rname" in a.columns else a


def contigs(spark: SparkSession, d: str) -> DataFrame:
    """One row per contig record, its sequence in upper case, null for ``*``; the name is made unique by the record's id."""
    c = latest(table(spark, d, "contig_alns"), "rec_id", ["rec_id", "qname", "gap_id", "flag", "rname", "pos", "mapq", "cigar", "seq"])
    return c.withColumns({"seq": F.when(F.col("seq") != "*", F.upper("seq")), "name": F.concat(F.lit("c"), F.lpad(F.col("rec_id").cast("string"), 9, "0"))})


def gaps(spark: SparkSession, d: str) -> DataFrame:
    """The different gaps with a scaffold, their lengths set right."""
    return table(spark, d, "gap_positions").where("scaffold IS NOT NULL").select("gap_id", "scaffold", "gap_start", "gap_end").distinct().withColumn("gap_len", F.col("gap_end") - F.col("gap_start"))


def libraries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "libraries")


def dna(spark: SparkSession, d: str) -> DataFrame:
    """Documents read as bases: letters only, a to t mapped to A, C, G, T in turn and u to z to N, so that runs of N are gaps."""
    text = F.lower(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("ord"), F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTNNNNNN").alias("seq"))


SQL_A = RECORDS
SQL_C = "c AS (SELECT * EXCLUDE (seq), CASE WHEN seq <> '*' THEN upper(seq) END AS seq, 'c' || lpad(CAST(rec_id AS VARCHAR), 9, '0') AS name FROM contig_alns QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at DESC) = 1)"
SQL_G = "g AS (SELECT DISTINCT gap_id, scaffold, gap_start, gap_end, gap_end - gap_start AS gap_len FROM gap_positions WHERE scaffold IS NOT NULL)"
SQL_D = "d AS (SELECT doc_id AS ord, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTNNNNNN') AS seq FROM documents WHERE text IS NOT NULL)"


def summed(column: str, ops: str) -> str:
    """SQL for the sum of a cigar's lengths of some operations."""
    return f"CASE WHEN {column} IS NOT NULL THEN coalesce(list_sum(list_transform(regexp_extract_all({column}, '([0-9]+)[{ops}]', 1), lambda x: CAST(x AS BIGINT))), 0) END"
