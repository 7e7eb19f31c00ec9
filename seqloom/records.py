"""Tables and records: reading, and what counts as one record."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def ship(spark: SparkSession | None = None) -> None:
    """Makes this package known to the Python workers of the session, once; nothing to do where PYTHONPATH has it.

    Functions that run in workers refer to the package by name. Spark's file server hands out the archive, so executors need no
    shared file.
    """
    spark = spark or SparkSession.getActiveSession()
    package = os.path.dirname(os.path.abspath(__file__))
    home = os.path.dirname(package)
    sc = spark.sparkContext if spark else None
    if sc is None or getattr(sc, "_seqloom_shipped", False):
        return
    sc._seqloom_shipped = True
    if home in (os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="seqloom-"), "seqloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), home))
    sc.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, columns: Sequence[str], order: str = "loaded_at", where: Column | str | None = None) -> DataFrame:
    """One row per ``key``, the one with the greatest ``order``, with ``columns``.

    Records that are delivered again share their key. Deliveries with equal ``order`` are told apart by a hash of their
    columns, so the choice doesn't depend on how the rows are spread. A row without a key can't be another delivery of any
    record, so each such row is kept; an empty table gives an empty one. Only ``key``, ``order`` and ``columns`` are read.

    ``where`` is asked of every delivery before one is chosen, so it reaches the scan and fewer rows are moved. That is the same
    as asking it afterwards only where all deliveries of a record agree in what it asks for.
    """
    if where is not None:
        df = df.where(where)
    alone = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    keep = [c for c in dict.fromkeys(columns) if c not in (key, order)]
    w = Window.partitionBy("__key", "__alone").orderBy(F.col("__order").desc_nulls_last(), "__tie")
    # a fixed number of partitions: what follows is often much work on few bytes, which partitions merged by bytes wouldn't see
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        df.select(F.col(key).alias("__key"), alone.alias("__alone"), F.col(order).alias("__order"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(keep)])
        .withColumn("__tie", F.xxhash64(*[f"__c{i}" for i in range(len(keep))]) if keep else F.lit(0))
        .repartition(parts, "__key", "__alone")
        .withColumn("__n", F.row_number().over(w))
        .where("__n = 1")
        .select(*[F.col("__key").alias(key) if c == key else F.col("__order").alias(order) if c == order else F.col(f"__c{keep.index(c)}").alias(c) for c in dict.fromkeys(columns)])
    )


def reference_name(rname: Column) -> Column:
    """``rname`` up to its first white space; null for null, ``*`` and an empty name."""
    name = F.regexp_extract(rname, r"^(\S*)", 1)
    return F.when((name != "") & (name != "*"), name)


def parallel(scan: DataFrame) -> DataFrame:
    """A table as it is read, dealt out to all cores if its files make fewer partitions than there are cores.

    For work that costs far more than moving the rows. Tables of many files stay where they are, so large ones aren't shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the one the session was given. Only a local master, which has
    no other machine, gets a temporary one where none is set; on a cluster that is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    already = sc._jsc.sc().getCheckpointDir()
    if not already.isDefined():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="seqloom-"))
        already = sc._jsc.sc().getCheckpointDir()
    return already.get().rstrip("/")


#: Tables written by :func:`cut`: (session, path, weak reference to the relation that reads it).
_written: list[tuple[SparkSession, str, object]] = []


def _drop_unused(every: bool = False) -> None:
    """Removes the written tables that no plan reads any more; ``every``: all of them."""
    for entry in list(_written):
        spark, path, ref = entry
        try:
            if every or ref.get() is None:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
                _written.remove(entry)
        except Exception:  # the session is gone, and its folder is no concern of a later one
            _written.remove(entry)


atexit.register(_drop_unused, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read from there, so that what follows survives lost executors.

    The table is columnar, so later steps read only the columns they use. It is removed at a later call once no plan reads it, or at the end of the program.
    """
    spark = df.sparkSession
    ship(spark)
    _drop_unused()
    path = f"{shared_dir(spark)}/seqloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    relation = out._jdf.queryExecution().analyzed().relation()
    _written.append((spark, path, spark._jvm.java.lang.ref.WeakReference(relation)))
    return out


#: Rows that are broadcast at most.
FEW = 20_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df``, a written table, marked for broadcasting if it has at most ``most`` rows; else Spark joins it as it sees fit."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def merge(df: DataFrame) -> DataFrame:
    """``df`` marked for a join that sorts and merges, which is never sent whole to every executor by way of the driver.

    For tables whose rows were exploded: Spark takes their size from the file they come from, and so would broadcast many times its threshold.
    """
    return df.hint("merge")


def beside(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", by: str = "uid") -> DataFrame:
    """A join with ``right``, which has one row per key, where a key may hold a third of ``left``.

    ``right`` is a written table or a filter on one. It is broadcast if it is small; if it is of middling size, every row of it is
    repeated for up to 16 salts, to which ``left`` is dealt out by its column ``by``; a larger one is merged as it is, and partitions
    of hot keys are split by adaptive execution.
    """
    n = right.count()
    if n <= FEW:
        return left.join(F.broadcast(right), list(on), how)
    salts = min(16, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if n > 100 * FEW:
        return left.join(merge(right), list(on), how)
    salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(merge(salted), [*on, "__salt"], how).drop("__salt")


def empty_like(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
