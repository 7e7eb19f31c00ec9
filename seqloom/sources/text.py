"""Readers of the text formats of sequence work, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAM = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags string"
FAI = "name string, length bigint, offset bigint, line_bases int, line_width int"
LINKS = "l_id int, l_name string, l_len int, l_ori string, r_id int, r_name string, r_len int, r_ori string, pairs int, min_distance double, max_distance double, mean_distance double"
CHECKED_LINKS = LINKS + ", merged boolean, overlap int"
BLAST = "query string, subject string, identity double, length int, mismatches int, gap_opens int, q_start int, q_end int, s_start int, s_end int, evalue double, bit_score double"
GAPS = "gap_start int, gap_end int, gap_len int, scaffold string"


def fasta(spark: SparkSession, path: str, whole_header: bool = False, upper: bool = False) -> DataFrame:
    """Rows (ord, name, seq) of FASTA files, gzip included. ord grows in file order but isn't dense.

    The name ends at the first white space unless ``whole_header``. Blanks and line ends inside a sequence are dropped. A file that
    doesn't begin with a header, or a sequence with other characters than letters, ``-`` and ``*``, is an error.
    """
    raw = spark.read.text(path, lineSep="\n>").withColumn("ord", F.monotonically_increasing_id()).where("trim(value) <> ''")
    text = F.regexp_replace(F.col("value"), "^>", "")
    header = F.regexp_extract(text, r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.substring(text, F.length(header) + 1, F.length(text)), r"\s", "")
    x = raw.select("ord", F.when(F.lit(whole_header), F.rtrim(header)).otherwise(F.regexp_extract(header, r"^(\S*)", 1)).alias("name"), (F.upper(seq) if upper else seq).alias("seq"), (F.col("value").startswith(">")).alias("__first"))
    ok = x["seq"].rlike("^[A-Za-z*-]*$")
    return x.withColumn("seq", F.when(ok, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("not a sequence: "), F.col("name"))))).drop("__first")


def both_strands(seqs: DataFrame) -> DataFrame:
    """(name, seq) with the reverse complement of each beside it."""
    from seqloom.functions.seq import reverse_complement

    return seqs.withColumn("rc", reverse_complement(F.col("seq"), "n"))


def substring_of(seqs: DataFrame, name: str, pos: int, length: int = -1) -> DataFrame:
    """One stretch of a named sequence, from a 0-based place on; all of the rest for -1."""
    cut = F.substring("seq", pos + 1, length) if length >= 0 else F.expr(f"substring(seq, {pos + 1})")
    return seqs.where(F.col("name") == name).select("name", cut.alias("seq"))


def fai(spark: SparkSession, path: str) -> DataFrame:
    """Rows (ord, name, length, offset, line_bases, line_width) of a FASTA index, ord in file order."""
    return spark.read.csv(path, sep="\t", schema=FAI).select(F.monotonically_increasing_id().alias("ord"), "*")


def fai_of(seqs: DataFrame) -> DataFrame:
    """The index of sequences that are already a table: name and length."""
    return seqs.select("name", F.length("seq").cast("long").alias("length"))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """Rows (ord, read_id, seq, qual) of FASTQ files of four lines a read.

    Lines are numbered within their file, and every four are a record, so a quality line beginning with @ doesn't mislead. The id is
    the header's first word up to a slash, without the @.
    """
    raw = spark.read.text(path, wholetext=False).select(F.monotonically_increasing_id().alias("at"), F.col("value"), F.input_file_name().alias("file"))
    from pyspark.sql.window import Window

    # lines are numbered within their file; partitions of a file come in order, so the offsets of whole partitions are added
    part = F.shiftright("at", 33)
    sizes = raw.groupBy("file", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    firsts = raw.groupBy("file", part.alias("part")).agg(F.min("at").alias("first"))
    x = raw.withColumn("part", part).join(sizes.join(firsts, ["file", "part"]), ["file", "part"])
    line = F.col("at") - F.col("first") + F.col("base")
    g = x.withColumn("line", line).groupBy("file", F.floor(F.col("line") / 4).alias("record")).agg(*[F.max(F.when(F.col("line") % 4 == i, F.col("value"))).alias(c) for i, c in ((0, "header"), (1, "seq"), (3, "qual"))])
    return g.select(F.col("record").alias("ord"), F.regexp_extract("header", r"^@([^/\s]+)", 1).alias("read_id"), "seq", "qual")


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a SAM text file; header lines are left out, optional fields are kept in one column."""
    f = F.split("value", "\t", 12)
    x = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    cols = [c.split() for c in SAM.split(", ")]
    get = lambda i, kind: F.get(f, i) if kind == "string" else F.get(f, i).try_cast(kind)
    return x.select(*[get(i, kind).alias(n) for i, (n, kind) in enumerate(cols)])


def sam_references(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, length) of the header's reference lines."""
    x = spark.read.text(path).where(F.col("value").startswith("@SQ"))
    return x.select(F.regexp_extract("value", r"\tSN:([^\t]*)", 1).alias("name"), F.regexp_extract("value", r"\tLN:([0-9]+)", 1).try_cast("long").alias("length"))


def gap_and_contig(name: Column) -> Column:
    """struct<gap_id, contig> of a reference named ``{gap}-{contig}``."""
    parts = F.split(name, "-", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("gap_id"), F.get(parts, F.lit(1)).alias("contig"))


def both_unmapped(sams: DataFrame) -> DataFrame:
    """Reads unmapped with their mates, as (read_id, mate, seq, qual): ids end in _1 or _2."""
    from seqloom.functions.flags import mate_suffix

    x = sams.where(F.col("flag").bitwiseAND(12) == 12).withColumn("mate", mate_suffix(F.col("flag")))
    return x.select(F.concat_ws("_", "qname", F.col("mate").cast("string")).alias("read_id"), "mate", "seq", "qual")


def regions(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, first, last), 0-based and exclusive: one column is a whole sequence (nulls), two a single base, three a range."""
    f = F.split(F.trim("value"), r"\s+")
    n = F.size(f)
    a, b = F.get(f, F.lit(1)).try_cast("long"), F.get(f, F.lit(2)).try_cast("long")
    return spark.read.text(path).where("trim(value) <> ''").select(F.get(f, F.lit(0)).alias("name"), F.when(n == 2, a - 1).otherwise(a).alias("first"), F.when(n == 2, a).otherwise(b).alias("last"))


def gap_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows (gap_start, gap_end, gap_len, scaffold) of a white-space table."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(*[F.get(f, F.lit(i)).try_cast("int").alias(c) for i, c in enumerate(("gap_start", "gap_end", "gap_len"))], F.get(f, F.lit(3)).alias("scaffold"))


def links(spark: SparkSession, path: str, checked: bool = False) -> DataFrame:
    """A linkage table of 12 columns, or of 14 after the overlap check."""
    return spark.read.csv(path, sep="\t", schema=CHECKED_LINKS if checked else LINKS)


def blast(spark: SparkSession, path: str) -> DataFrame:
    """A tabular search result of 12 columns."""
    return spark.read.csv(path, sep="\t", schema=BLAST)


def kmer_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows (kmer, freq) of a k-mer dump; the first value of a repeated k-mer holds."""
    from seqloom.operators.kmers import first_of_each

    f = F.split(F.trim("value"), r"\s+")
    x = spark.read.text(path).where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("ord"), F.get(f, F.lit(0)).alias("kmer"), F.get(f, F.lit(1)).try_cast("double").alias("freq"))
    return first_of_each(x, "ord")


def gap_reads(spark: SparkSession, path: str) -> DataFrame:
    """Rows (qname, gap_ord, side, kind, map_pos, mate_ref, mate_pos, gap_len) of lists of reads that belong to gaps, one white-space line each.

    Lists of discordant reads have the first two columns only, and lists of clipped reads the first four; the rest is null there.
    Lines without two columns are left out.
    """
    f = F.split(F.trim("value"), r"\s+")
    get = lambda i, kind: F.get(f, F.lit(i)) if kind == "string" else F.get(f, F.lit(i)).try_cast(kind)
    names = (("qname", "string"), ("gap_ord", "int"), ("side", "string"), ("kind", "string"), ("map_pos", "int"), ("mate_ref", "string"), ("mate_pos", "int"), ("gap_len", "int"))
    return spark.read.text(path).where(F.size(f) >= 2).select(*[get(i, kind).alias(n) for i, (n, kind) in enumerate(names)])


def discordant_places(reads: DataFrame, scaffold: Column) -> DataFrame:
    """Rows (rname, place, gaps) of :func:`gap_reads`: where the mates of discordant reads lie, with the gaps that sent one there.

    ``scaffold``: that of the list; a mate on ``=`` lies there too.
    """
    x = reads.where("kind = 'discordant' AND mate_pos IS NOT NULL").select(F.when(F.col("mate_ref") == "=", scaffold).otherwise(F.col("mate_ref")).alias("rname"), F.col("mate_pos").alias("place"), F.concat_ws("_", scaffold, F.col("gap_ord").cast("string")).alias("gap"))
    return x.groupBy("rname", "place").agg(F.array_sort(F.collect_set("gap")).alias("gaps"))


def id_names(spark: SparkSession, path: str) -> DataFrame:
    """Rows (id, name) of a table of numbers and names."""
    f = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).where("trim(value) <> ''").select(F.get(f, F.lit(0)).try_cast("long").alias("id"), F.get(f, F.lit(1)).alias("name"))


def ids_of(index: DataFrame, order: str = "ord", name: str = "name") -> DataFrame:
    """Rows (id, name): the names of an index numbered from 0 in its order, by ranges of rows."""
    from seqloom.operators.ordered import scan

    return scan(index.select(F.col(order).alias("__o"), F.col(name).alias("name")), [], ["__o"], {"id": F.lit(1)}, before=True).select("id", "name")
