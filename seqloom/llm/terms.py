"""Frequency of every term: occurrences and records, by recursive radix partitioning and out-of-core aggregation with DuckDB."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.records import ship

#: Bits of a term's hash that choose its partition, at least; also the bits by which an oversized partition is split on disk.
RADIX_BITS = 8
#: Entries a map task holds before it combines them, and bases it encodes at a time.
HOLD, BASES = 1 << 22, 1 << 21
#: Entries of one partition that are aggregated at once; a larger one is split by its next bits on disk.
OVERSIZED = 1 << 22

#: The letters of a base's two bits.
LETTERS = "ACGT"

BLOCK = "radix int, terms binary, occurrences binary, records binary, held long, seen long"


def _codes() -> np.ndarray:
    code = np.full(256, 4, dtype=np.uint8)
    for i, letter in enumerate(LETTERS):
        code[ord(letter)] = code[ord(letter.lower())] = i
    return code


def windows(bases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows of ``k`` letters and whether each is made of A, C, G and T only; ``bases``: 0 to 3, 4 for others."""
    n = len(bases) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    power, width = (bases & 3).astype(np.uint64), 1
    out, done, bits = None, 0, k
    while bits:  # by the bits of k: a window of 10 is one of 2 and one of 8
        if bits & 1 and out is None:
            out, done = power, width
        elif bits & 1:
            m = len(bases) - done - width + 1
            out, done = (out[:m] << np.uint64(2 * width)) | power[done : done + m], done + width
        bits >>= 1
        if bits:
            power, width = (power[:-width] << np.uint64(2 * width)) | power[width:], 2 * width
    bad = np.concatenate([[0], np.cumsum(bases > 3)])
    return out[:n], (bad[k:] - bad[:-k])[:n] == 0


def multiplier(k: int) -> tuple[int, int]:
    """An odd number and its inverse modulo 4**k: terms times the one are their hashes, one to one."""
    m = (0x9E3779B97F4A7C15 & ((1 << (2 * k)) - 1)) | 1
    return m, pow(m, -1, 1 << (2 * k))


def _combine(h: np.ndarray, occ: np.ndarray, rec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h = h[order]
    edges = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, dtype=np.int64)
    return h[edges], np.add.reduceat(occ[order], edges) if len(h) else occ, np.add.reduceat(rec[order], edges) if len(h) else rec


def radix_bits(parts: int, k: int) -> int:
    """Bits of the radix for so many reduce tasks: four radix partitions a task or more, as far as a term has bits."""
    return min(2 * k, max(RADIX_BITS, (4 * parts - 1).bit_length()))


def term_blocks(df: DataFrame, sequence: str, k: int, bits: int = RADIX_BITS) -> DataFrame:
    """Partial counts of every window, combined in each map task and packed into one block per radix partition of ``bits`` bits."""
    if not 4 <= k <= 31:
        raise ValueError("k must be 4 to 31")
    ship(df.sparkSession)
    mult, mask, shift = np.uint64(multiplier(k)[0]), np.uint64((1 << (2 * k)) - 1), np.uint64(2 * k - bits)
    schema = pa.schema([("radix", pa.int32()), ("terms", pa.binary()), ("occurrences", pa.binary()), ("records", pa.binary()), ("held", pa.int64()), ("seen", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _codes()
        held: list[tuple] = []
        seen = 0

        def count(text: list[bytes]) -> None:
            """Occurrences and records of the windows of some records."""
            lengths = np.fromiter(map(len, text), dtype=np.int64, count=len(text)) + 1
            bases = code[np.frombuffer(b"|".join(text) + b"|", dtype=np.uint8)]
            codes, good = windows(bases, k)
            h = (codes[good] * mult) & mask
            rec = np.repeat(np.arange(len(text)), lengths)[: len(codes)][good]
            if 2 * k + 20 <= 64:
                both = np.sort((h << np.uint64(20)) | rec.astype(np.uint64))
                new_pair = np.r_[True, both[1:] != both[:-1]] if len(both) else np.zeros(0, dtype=bool)
                h = both >> np.uint64(20)
            else:
                order = np.lexsort((rec, h))
                h, rec = h[order], rec[order]
                new_pair = np.r_[True, (h[1:] != h[:-1]) | (rec[1:] != rec[:-1])] if len(h) else np.zeros(0, dtype=bool)
            if not len(h):
                return
            edges = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            held.append((h[edges], np.diff(np.r_[edges, len(h)]), np.add.reduceat(new_pair.astype(np.int64), edges)))

        def emit() -> Iterator[pa.RecordBatch]:
            h, occ, rec = held[0] if held else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
            cuts = np.searchsorted(h >> shift, np.arange((1 << bits) + 1, dtype=np.uint64))
            z = pa.Codec("zstd", 1)
            pack = lambda a: z.compress(np.ascontiguousarray(a).tobytes(), asbytes=True) if len(a) else b""
            rows = []
            for r in range(1 << bits):
                s = slice(cuts[r], cuts[r + 1])
                rows.append((r, pack(np.diff(h[s], prepend=np.uint64(0))), pack(occ[s]), pack(rec[s]), int(cuts[r + 1] - cuts[r]), seen))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        some = False
        for b in batches:
            column = b.column(0).cast(pa.binary())
            text: list[bytes] = []
            size = 0
            for x in column.to_pylist():
                text.append(x)
                size += len(x)
                if size >= BASES or len(text) >= 1 << 20:
                    count(text)
                    text, size = [], 0
            if text:
                count(text)
            seen += b.num_rows
            some = some or b.num_rows > 0
            if len(held) > 1 and sum(len(x[0]) for x in held) > HOLD:
                held = [_combine(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                if len(held[0][0]) > HOLD // 2:  # mostly different terms: combining no longer helps
                    yield from emit()
                    held, seen, some = [], 0, False
        if len(held) > 1:
            held = [_combine(*(np.concatenate(c) for c in zip(*held, strict=True)))]
        if some:
            yield from emit()

    return df.select(F.col(sequence).alias("__s")).mapInArrow(run, BLOCK)


def _aggregate(entries: pa.Table, folder: str) -> pa.Table:
    import duckdb

    db = duckdb.connect(config={"memory_limit": "400MB", "threads": 1, "temp_directory": folder})
    try:
        db.register("entries", entries)
        return db.sql("SELECT h, CAST(sum(o) AS BIGINT) AS o, CAST(sum(r) AS BIGINT) AS r FROM entries GROUP BY h").to_arrow_table()
    finally:
        db.close()


def _from_disk(files: list[str], bits: int, width: int, folder: str) -> Iterator[pa.Table]:
    """Aggregates the entries of some files; more than ``OVERSIZED`` are split by ``RADIX_BITS`` further bits first."""
    total = sum(pq.ParquetFile(f).metadata.num_rows for f in files)
    if total <= OVERSIZED or bits >= width:
        import duckdb

        db = duckdb.connect(config={"memory_limit": "400MB", "threads": 1, "temp_directory": folder})
        try:
            yield from (pa.Table.from_batches([b]) for b in db.sql("SELECT h, CAST(sum(o) AS BIGINT) AS o, CAST(sum(r) AS BIGINT) AS r FROM read_parquet(?) GROUP BY h", params=[files]).to_arrow_reader(1 << 18))
        finally:
            db.close()
        for f in files:
            os.unlink(f)
        return
    below = tempfile.mkdtemp(dir=folder)
    parts: dict[int, list[str]] = {}
    for f in files:
        for b in pq.ParquetFile(f).iter_batches(1 << 20):
            _spill(pa.Table.from_batches([b]), bits, width, below, parts)
        os.unlink(f)
    for p in sorted(parts):
        yield from _from_disk(parts[p], bits + RADIX_BITS, width, below)


def _spill(entries: pa.Table, bits: int, width: int, folder: str, parts: dict[int, list[str]]) -> None:
    h = entries.column("h").to_numpy()
    down = max(0, width - bits - RADIX_BITS)
    radix = (h >> np.uint64(down)) & np.uint64((1 << min(RADIX_BITS, width - bits)) - 1)
    order = np.argsort(radix, kind="stable")
    entries, radix = entries.take(pa.array(order)), radix[order]
    edges = np.flatnonzero(np.r_[True, radix[1:] != radix[:-1], True])
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        mine = parts.setdefault(int(radix[i]), [])
        mine.append(os.path.join(folder, f"{int(radix[i])}-{len(mine)}.parquet"))
        pq.write_table(entries.slice(i, j - i), mine[-1], compression="zstd")


def term_frequency(df: DataFrame, sequence: str, k: int = 10) -> DataFrame:
    """Rows (kmer, occurrences, records, of_records) of every window of ``k`` letters of ``sequence``.

    One row of ``df`` is a record. Windows are compared in upper case, and those with a letter other than A, C, G and T are no
    terms. ``records``: the records with the term; ``of_records``: all records of ``df`` with a sequence, which is the same on
    every row. A null sequence is no record; an empty one, or one shorter than k, is a record without terms. An empty table
    gives no rows. Other columns of ``df`` are not read.

    Map tasks combine their windows before anything is moved, so a term that a third of all records hold is one entry a task.
    Entries go to partitions by the top bits of a one-to-one hash, more bits for more reduce tasks; a task's partition is aggregated by DuckDB, and while it
    is larger than ``OVERSIZED`` entries it is split on disk by the next bits, so memory doesn't depend on the number of terms.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width, bits = 2 * k, radix_bits(parts, k)
    one_machine = df.sparkSession.sparkContext.master.startswith("local")
    inverse = np.uint64(multiplier(k)[1])
    mask = np.uint64((1 << width) - 1)
    schema = pa.schema([("kmer", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64()), ("of_records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = tempfile.mkdtemp(dir=os.environ.get("SPARK_LOCAL_DIRS", os.environ.get("LOCAL_DIRS", "")).split(",")[0] or (None if one_machine else os.getcwd()))  # scratch of one task, removed with it
        letters = np.frombuffer(LETTERS.encode(), dtype=np.uint8)
        z = pa.Codec("zstd")
        held: list[pa.Table] = []
        size, radix, total = 0, None, 0
        files: dict[int, list[str]] = {}

        def unpack(data: bytes, n: int, kind: type) -> np.ndarray:
            return np.frombuffer(z.decompress(data, decompressed_size=8 * n, asbytes=True), dtype=kind)

        def spill() -> None:
            nonlocal held, size
            _spill(pa.concat_tables(held), bits, width, folder, files)
            held, size = [], 0

        def result(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for b in t.to_batches(max_chunksize=1 << 16):
                c = (b.column(0).to_numpy() * inverse) & mask
                text = np.empty((len(c), k), dtype=np.uint8)
                for i in range(k):
                    text[:, i] = letters[((c >> np.uint64(2 * (k - 1 - i))) & np.uint64(3)).astype(np.int64)]
                words = pa.StringArray.from_buffers(len(c), pa.py_buffer(np.arange(0, k * (len(c) + 1), k, dtype=np.int32)), pa.py_buffer(text.tobytes()))
                yield pa.RecordBatch.from_arrays([words, b.column(1), b.column(2), pa.array(np.full(len(c), total), pa.int64())], schema=schema)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, files
            if files:
                if held:
                    spill()
                for p in sorted(files):
                    for t in _from_disk(files[p], bits + RADIX_BITS, width, folder):
                        yield from result(t)
            elif held:
                yield from result(_aggregate(pa.concat_tables(held), folder))
            held, size, files = [], 0, {}

        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["radix"] != radix:
                        yield from close()
                        radix, total = row["radix"], 0
                    total += row["seen"]
                    if n := row["held"]:
                        held.append(pa.table({"h": np.cumsum(unpack(row["terms"], n, np.uint64), dtype=np.uint64), "o": unpack(row["occurrences"], n, np.int64), "r": unpack(row["records"], n, np.int64)}))
                        size += n
                        if size > OVERSIZED:
                            spill()
            yield from close()
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    blocks = term_blocks(df.where(F.col(sequence).isNotNull()), sequence, k, bits)
    # hashes are spread evenly, so equal ranges of the radix are equal shares of the terms
    return blocks.repartitionById(parts, F.expr(f"cast(shiftright(radix * {parts}L, {bits}) AS int)")).sortWithinPartitions("radix").mapInArrow(run, "kmer string, occurrences long, records long, of_records long")
