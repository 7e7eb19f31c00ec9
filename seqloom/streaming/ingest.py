"""Alignments that keep arriving: the read selector on a stream of files, redeliveries dropped by id within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.joins import select_reads
from seqloom.records import reference_name


def selected_stream(spark: SparkSession, folder: str, schema, gaps: DataFrame, libraries: DataFrame, reach: int, late: str = "7 days") -> DataFrame:
    """A streaming DataFrame of selected reads: new files of ``folder`` joined to the static gaps.

    A record delivered again within ``late`` of event time counts once; state holds one id per record of that time.
    """
    s = spark.readStream.schema(schema).parquet(folder).withColumn("__at", F.col("loaded_at").cast("timestamp")).withWatermark("__at", late).dropDuplicatesWithinWatermark(["aln_id"])
    return select_reads(s.withColumn("rname", reference_name(F.col("rname"))), gaps, libraries, reach)
