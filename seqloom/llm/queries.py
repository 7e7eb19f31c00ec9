"""Queries p3_ to p8_ and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.mixing import mix, plan, report, source_of
from seqloom.llm.sketch import build_sketches, merge_sketches, query_sketches
from seqloom.llm.spans import shared_classes, shared_spans
from seqloom.llm.terms import term_frequency
from seqloom.llm.tokens import encode
from seqloom.llm.truncation import truncated
from seqloom.queries.problems import RECORDS
from seqloom.records import cut, latest, parallel, reference_name, table

# ---- p3: stretches shared between contigs


def _contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "contig_alns"), "rec_id", ["rec_id", "seq"]).where("seq <> '*'")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal runs of shared bases of every contig."""
    return shared_spans(_contigs(spark, sf_dir), "rec_id", "seq", 48).select("rec_id", F.col("pos").cast("int").alias("pos"), F.col("span_len").cast("int").alias("span_len"))


def p3_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every contig is shared elsewhere; 0 of 0 bases for a contig without a sequence."""
    whole = latest(table(spark, sf_dir, "contig_alns"), "rec_id", ["rec_id", "seq"]).select("rec_id", F.when(F.col("seq") != "*", F.length("seq")).otherwise(0).alias("bases"))
    spans = p3_found(spark, sf_dir).groupBy("rec_id").agg(F.sum("span_len").alias("shared"), F.count(F.lit(1)).alias("spans"))
    return whole.join(spans, "rec_id", "left").select("rec_id", F.col("bases").cast("long").alias("bases"), F.coalesce("shared", F.lit(0)).cast("long").alias("shared"), F.coalesce("spans", F.lit(0)).cast("long").alias("spans"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every contig that shares a verified stretch with another, and its number of links."""
    return shared_classes(_contigs(spark, sf_dir), "rec_id", "seq", 48)


# ---- p4: percentiles of tlen


def _tlen(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    a = latest(table(spark, sf_dir, "alignments"), "aln_id", ["flag", "rname", "tlen", *more])
    a = a.where((F.col("flag").bitwiseAND(4) == 0) & ~F.col("tlen").isin(0, 2147483647, -2147483648))
    return a.select(reference_name(F.col("rname")).alias("rname"), F.abs(F.col("tlen").cast("long")).alias("tlen"), *more).where("rname IS NOT NULL")


def p4_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rname the median and upper percentiles of the absolute tlen, with the bound of their rank error."""
    return query_sketches(build_sketches(_tlen(spark, sf_dir), ["rname"], "tlen"), ["rname"], [0.5, 0.9, 0.95, 0.99])


def p4_by_bam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for whole bam files: sketches of (bam, rname) merged into one per bam, then asked."""
    by_both = merge_sketches(build_sketches(_tlen(spark, sf_dir, "bam"), ["bam", "rname"], "tlen"), ["bam", "rname"])
    return query_sketches(by_both.drop("rname").withColumn("part", F.abs(F.xxhash64("values")) % 4096), ["bam"], [0.5, 0.9, 0.95, 0.99], parts=4096)


def _within(answers: DataFrame, data: DataFrame, key: str) -> DataFrame:
    """Whether the true rank of every answer lies within its rank error, counted over all values."""
    counts = data.groupBy(F.col(key).alias("__k"), F.col("tlen").alias("__v")).agg(F.count(F.lit(1)).alias("c"))
    x = answers.join(counts, F.col(key).eqNullSafe(F.col("__k"))).groupBy(key, "q", "value", "n", "rank_error")
    x = x.agg(F.coalesce(F.sum(F.when(F.col("__v") < F.col("value"), F.col("c"))), F.lit(0)).alias("below"), F.coalesce(F.sum(F.when(F.col("__v") <= F.col("value"), F.col("c"))), F.lit(0)).alias("upto"))
    rank, slack = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n"))), F.col("rank_error") * F.col("n")
    return x.select(key, "q", "n", ((F.col("below") + 1 - rank <= slack) & (rank - F.col("upto") <= slack) & (F.col("rank_error") < 0.01)).alias("within"))


def p4_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the percentiles of every rname keep their bound, which is under one percent."""
    return _within(p4_quantiles(spark, sf_dir), _tlen(spark, sf_dir), "rname")


def p4_bam_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for those of the bam files, whose sketches were merged twice."""
    return _within(p4_by_bam(spark, sf_dir), _tlen(spark, sf_dir, "bam"), "bam")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rnames of at least 40 records with a median of at least 400 or a 95th percentile of at least 1000."""
    q = query_sketches(build_sketches(_tlen(spark, sf_dir), ["rname"], "tlen"), ["rname"], [0.5, 0.95])
    pct = F.when((F.col("q") == 0.5) & (F.col("value") >= 400), 50).when((F.col("q") == 0.95) & (F.col("value") >= 1000), 95)
    return q.where("n >= 40").select("rname", pct.cast("int").alias("pct")).where("pct IS NOT NULL")


# ---- p5: frequency of every 10-letter term


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its occurrences, its records and its mark: rare, common or null."""
    a = latest(table(spark, sf_dir, "alignments"), "aln_id", ["seq"]).where("seq <> '*'")
    t = term_frequency(a, "seq", 10)
    mark = F.when(F.col("records") == 1, "rare").when(F.col("records") * 400 >= F.col("of_records"), "common")
    return t.select("kmer", "occurrences", "records", mark.alias("mark"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms in exactly one record and those in at least 1 in 400 records."""
    return p5_counts(spark, sf_dir).where("mark IS NOT NULL").select("kmer", "mark")


# ---- p6: token ids of every document


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k; an empty list for a null and an empty text."""
    return encode(parallel(table(spark, sf_dir, "documents").select("doc_id", "text")), "text", "byte_bpe_50k", keep=("doc_id",))


# ---- p7: sources mixed to target weights


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parallel(table(spark, sf_dir, "documents").select("doc_id", source_of(F.col("source")).alias("source"), "text"))
    return encode(docs.where("source IS NOT NULL"), "text", "byte_bpe_50k", keep=("doc_id", "source"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source what it has, what it should give, what the drawn mix takes of it and its actual share."""
    sizes = _tokens(spark, sf_dir).select("source", F.size("ids").cast("long").alias("tokens"))
    return report(spark, plan(sizes, table(spark, sf_dir, "mix_targets")))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus in blocks of token ids. Texts are encoded once, to a table in the shared folder."""
    return mix(cut(_tokens(spark, sf_dir)), table(spark, sf_dir, "mix_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources that cannot reach their share."""
    return p7_shares(spark, sf_dir).where("NOT reachable").select("source")


# ---- p8: texts that were cut off


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = parallel(table(spark, sf_dir, "documents").select("doc_id", source_of(F.col("source")).alias("source"), "text"))
    return truncated(d, "doc_id", "source", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose text was cut off."""
    return _cut(spark, sf_dir).where("is_cut").select(F.col("id").alias("doc_id"))


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source loses text: its documents with a text, those cut off, and their share."""
    c = _cut(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("is_cut").cast("long")).alias("cut"), F.sum((F.col("by") == "copy").cast("long")).alias("cut_by_copy"))
    return c.select("source", "texts", "cut", F.coalesce("cut_by_copy", F.lit(0)).alias("cut_by_copy"), (F.col("cut") / F.col("texts")).alias("share"))


QUERIES = {
    "p3_found": p3_found,
    "p3_shared": p3_shared,
    "p3_classes": p3_classes,
    "p4_found": p4_found,
    "p4_quantiles": p4_quantiles,
    "p4_by_bam": p4_by_bam,
    "p4_ranks": p4_ranks,
    "p4_bam_ranks": p4_bam_ranks,
    "p5_found": p5_found,
    "p5_counts": p5_counts,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_shares": p7_shares,
    "p7_mix": p7_mix,
    "p8_found": p8_found,
    "p8_sources": p8_sources,
}

_TERMS = f"""
WITH {RECORDS}, s AS (SELECT aln_id, upper(seq) AS seq FROM a WHERE seq <> '*'), n AS (SELECT count(*) AS n FROM s),
w AS (SELECT aln_id, substr(seq, i, 10) AS kmer FROM s, unnest(range(1, length(seq) - 8)) u(i)),
c AS (SELECT kmer, count(*) AS occurrences, count(DISTINCT aln_id) AS records FROM w WHERE regexp_full_match(kmer, '[ACGT]{{10}}') GROUP BY kmer),
m AS (SELECT c.*, CASE WHEN records = 1 THEN 'rare' WHEN records * 400 >= n THEN 'common' END AS mark FROM c, n)"""

#: Every percentile of every key, each within its bound.
_RANKS = f"""
WITH {RECORDS}, t AS (SELECT rname, bam FROM a WHERE (flag & 4) = 0 AND rname IS NOT NULL AND tlen NOT IN (0, 2147483647, -2147483648)), k AS (SELECT {{key}}, count(*) AS n FROM t GROUP BY {{key}})
SELECT {{key}}, q, n, TRUE AS "within" FROM k, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE)), (CAST(0.95 AS DOUBLE)), (CAST(0.99 AS DOUBLE))) v(q)"""

_SPANS = """
WITH r AS (SELECT rec_id, CASE WHEN seq <> '*' THEN upper(seq) END AS seq FROM contig_alns QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at DESC) = 1),
w AS (SELECT rec_id, i - 1 AS pos, substr(seq, i, 48) AS k FROM r, unnest(range(1, length(seq) - 46)) u(i)),
s AS (SELECT k FROM w WHERE regexp_full_match(k, '[ACGT]{48}') GROUP BY k HAVING count(DISTINCT rec_id) > 1),
h AS (SELECT DISTINCT rec_id, pos FROM w JOIN s USING (k)),
g AS (SELECT *, CASE WHEN pos > lag(pos) OVER (PARTITION BY rec_id ORDER BY pos) + 48 OR lag(pos) OVER (PARTITION BY rec_id ORDER BY pos) IS NULL THEN 1 ELSE 0 END AS fresh FROM h),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY rec_id ORDER BY pos) AS run FROM g),
f AS (SELECT rec_id, CAST(min(pos) AS INTEGER) AS pos, CAST(max(pos) + 48 - min(pos) AS INTEGER) AS span_len FROM i GROUP BY rec_id, run)"""

SQL = {
    "p3_found": _SPANS + " SELECT * FROM f",
    "p3_shared": _SPANS + """, t AS (SELECT rec_id, sum(span_len) AS shared, count(*) AS spans FROM f GROUP BY rec_id)
SELECT rec_id, coalesce(length(seq), 0) AS bases, CAST(coalesce(shared, 0) AS BIGINT) AS shared, coalesce(spans, 0) AS spans FROM r LEFT JOIN t USING (rec_id)""",
    "p4_found": f"""
WITH {RECORDS}, t AS (SELECT rname, abs(CAST(tlen AS BIGINT)) AS v FROM a WHERE (flag & 4) = 0 AND rname IS NOT NULL AND tlen NOT IN (0, 2147483647, -2147483648)),
q AS (SELECT rname, count(*) AS n, quantile_disc(v, 0.5) AS m, quantile_disc(v, 0.95) AS u FROM t GROUP BY rname HAVING count(*) >= 40)
SELECT rname, 50 AS pct FROM q WHERE m >= 400 UNION ALL SELECT rname, 95 FROM q WHERE u >= 1000""",
    "p4_ranks": _RANKS.format(key="rname"),
    "p4_bam_ranks": _RANKS.format(key="bam"),
    "p5_found": _TERMS + " SELECT kmer, mark FROM m WHERE mark IS NOT NULL",
    "p5_counts": _TERMS + " SELECT kmer, occurrences, records, mark FROM m",
}
