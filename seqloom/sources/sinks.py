"""Writers: text formats and tables partitioned by what they will be read by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.seq import wrap


def fasta_lines(seqs: DataFrame, name: str = "name", seq: str = "seq", width: int = 60) -> DataFrame:
    """One text value per sequence: header and wrapped letters."""
    return seqs.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), wrap(F.coalesce(F.col(seq), F.lit("")), width)).alias("value"))


def write_fasta(seqs: DataFrame, path: str, name: str = "name", seq: str = "seq", width: int = 60, mode: str = "overwrite") -> None:
    fasta_lines(seqs, name, seq, width).write.mode(mode).text(path)


def write_subset(seqs: DataFrame, drop: DataFrame, path: str, name: str = "name") -> None:
    """The sequences but for those named in ``drop``."""
    write_fasta(seqs.join(drop.select(F.col("name").alias(name)), name, "left_anti"), path, name)


def fastq_lines(reads: DataFrame, id: str = "read_id", seq: str = "seq", qual: str = "qual") -> DataFrame:
    quality = F.coalesce(F.when(F.col(qual) != "*", F.col(qual)), F.expr(f"repeat('5', length({seq}))"))
    return reads.select(*[c for c in reads.columns if c not in (id, seq, qual)], F.concat(F.lit("@"), F.col(id), F.lit("\n"), F.col(seq), F.lit("\n+\n"), quality).alias("value"))


def write_fastq_per_gap(reads: DataFrame, path: str, mode: str = "append") -> None:
    """A folder per gap; rows of a gap are brought together first, so each gap has few files."""
    fastq_lines(reads.select("gap_id", "read_id", "seq", "qual")).repartition("gap_id").write.mode(mode).partitionBy("gap_id").text(path)


def write_gaps(gaps: DataFrame, path: str) -> None:
    """The gap table as text: start, end, length, scaffold."""
    gaps.select(F.concat_ws(" ", "gap_start", "gap_end", "gap_len", "scaffold").alias("value")).write.mode("overwrite").text(path)


def write_flanks(flanks: DataFrame, path: str) -> None:
    """FASTA of both flanks, a folder per gap. ``flanks``: (gap_id, side, seq)."""
    named = flanks.select("gap_id", F.concat(F.lit(">"), "gap_id", F.lit("_"), "side", F.lit("\n"), "seq").alias("value"))
    named.repartition("gap_id").write.mode("overwrite").partitionBy("gap_id").text(path)


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """A Parquet table with a folder per value: cluster lists by (scaffold, mate), discordant places by mate's scaffold."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def provenance_lines(merged: DataFrame) -> DataFrame:
    """Merged contigs with the contigs they came from, names in order behind two blanks."""
    return merged.select(F.concat(F.col("name"), F.lit("  "), F.array_join("path", " ")).alias("value"))


def gml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A graph's nodes and edges as GML blocks. ``nodes``: (id, label); ``edges``: (source, target, weight) by id."""
    n = nodes.select(F.lit(0).alias("o"), F.concat(F.lit("node [ id "), F.col("id").cast("string"), F.lit(' label "'), F.col("label"), F.lit('" ]')).alias("value"))
    e = edges.select(F.lit(1).alias("o"), F.concat(F.lit("edge [ source "), F.col("source").cast("string"), F.lit(" target "), F.col("target").cast("string"), F.lit(" weight "), F.col("weight").cast("string"), F.lit(" ]")).alias("value"))
    return n.unionByName(e)


def link_lines(links: DataFrame) -> DataFrame:
    """A linkage table as tab-separated text in the columns' order."""
    return links.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in links.columns]).alias("value"))


def write_id_names(ids: DataFrame, path: str) -> None:
    """Numbers and names as text, for :func:`seqloom.sources.text.id_names`."""
    ids.select(F.concat_ws(" ", F.col("id").cast("string"), "name").alias("value")).write.mode("overwrite").text(path)
