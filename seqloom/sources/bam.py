"""BAM files as a Spark data source that splits them, and a writer of small ones."""

from __future__ import annotations

import glob
import gzip
import os
import struct
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Letters of the format's four-bit bases and its operations.
NIBBLES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
SCHEMA = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string"
#: Compressed bytes of a split, records of an Arrow batch, records that must follow each other where a split begins.
SPLIT, BATCH, SURE = 32 << 20, 8192, 4


class _Header:
    """A file's references, whether it is sorted by place, and where its records begin."""

    def __init__(self, path: str):
        with gzip.open(path, "rb") as f:
            if f.read(4) != b"BAM\1":
                raise ValueError(f"{path} is no BAM file")
            text = f.read(struct.unpack("<i", f.read(4))[0]).split(b"\0")[0].decode("utf-8", "replace")
            self.names, self.lengths = [], []
            for _ in range(struct.unpack("<i", f.read(4))[0]):
                self.names.append(f.read(struct.unpack("<i", f.read(4))[0])[:-1].decode())
                self.lengths.append(struct.unpack("<i", f.read(4))[0])
            self.begin = f.tell()
        self.is_sorted = any(line.startswith("@HD") and "SO:coordinate" in line.split("\t") for line in text.split("\n"))


def _is_block(head: bytes) -> int:
    """The size of the block that begins with these 18 bytes; 0 if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:16] != b"BC\2\0":
        return 0
    return struct.unpack_from("<H", head, 16)[0] + 1


def _next_block(f, at: int, size: int) -> int:
    """Where the first block at or behind ``at`` begins: its header must be followed by another block, or by the file's end."""
    while at < size:
        f.seek(at)
        data = f.read(1 << 17)
        i = data.find(b"\x1f\x8b\x08\x04")
        while i >= 0:
            f.seek(at + i)
            n = _is_block(f.read(18))
            if n:
                f.seek(at + i + n)
                if at + i + n == size or _is_block(f.read(18)):
                    return at + i
            i = data.find(b"\x1f\x8b\x08\x04", i + 1)
        at += max(1, len(data) - 3)
    return size


def _blocks(f, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the blocks from ``at`` on."""
    while at < size:
        f.seek(at)
        head = f.read(18)
        n = _is_block(head)
        if not n:
            raise ValueError(f"no block at {at}")
        yield at, zlib.decompress(head + f.read(n - 18), 31)
        at += n


def _plausible(data: bytes, at: int, h: _Header) -> int:
    """The place behind the record at ``at`` if there may be one, else 0. A record that the data cut short may be one if its fixed part is."""
    if at + 36 > len(data):
        return 0
    n, ref, pos, l_name, _, _, n_ops, _, l_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (-1 <= ref < len(h.names) and -1 <= mate < len(h.names) and pos >= -1 and mate_pos >= -1 and l_name >= 1 and l_seq >= 0):
        return 0
    if ref >= 0 and pos > h.lengths[ref] or n < 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq:
        return 0
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1:] != b"\0" or any(c < 33 or c > 126 for c in name[:-1])):
        return 0
    return at + 4 + n


def _first_record(data: bytes, h: _Header) -> int:
    """Where the first record begins in decompressed data that may begin within one: ``SURE`` records follow each other there, or all up to the end."""
    for at in range(len(data)):
        here, seen = at, 0
        while seen < SURE and here < len(data) and (there := _plausible(data, here, h)):
            here, seen = there, seen + 1
        if seen == SURE or seen and here >= len(data) - 36:
            return at
    return -1


def _raw(path: str, h: _Header, first: int, last: int) -> Iterator[bytes]:
    """The bodies of the records that begin in the blocks from byte ``first`` up to byte ``last`` of a file."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        start = _next_block(f, first, size) if first else 0
        data, skip, at = b"", h.begin if not first else None, 0
        mine = 0  # bytes of data that belong to this split's blocks
        for place, content in _blocks(f, start, size):
            inside = place < last
            if skip:  # the header
                skip, content = max(0, skip - len(content)), content[skip:]
            data = data[at:] + content
            mine = (len(data) if inside else mine - at)
            at = 0
            if skip is None:
                # a split begins within a record: enough data to be sure of where the next begins
                if inside and len(data) < 1 << 18 and place + 1 < size:
                    begin = -1 if len(data) < 1 << 17 else _first_record(data, h)
                else:
                    begin = _first_record(data, h)
                if begin < 0:
                    if inside:
                        continue
                    return
                at, skip = begin, 0
            while at + 4 <= len(data) and at < mine:
                n = struct.unpack_from("<i", data, at)[0]
                if at + 4 + n > len(data):
                    break
                yield data[at + 4 : at + 4 + n]
                at += 4 + n
            if not inside and at >= mine:
                return
        if skip is None and data and (begin := _first_record(data, h)) >= 0:  # a last split of few blocks
            at = begin
            while at + 4 <= len(data) and at < mine:
                n = struct.unpack_from("<i", data, at)[0]
                yield data[at + 4 : at + 4 + n]
                at += 4 + n


def _row(b: bytes, h: _Header) -> tuple:
    ref, pos, l_name, mapq, _, n_ops, flag, n, mate_ref, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", b)
    at = 32
    qname = b[at : at + l_name - 1].decode()
    at += l_name
    ops = struct.unpack_from(f"<{n_ops}I", b, at)
    at += 4 * n_ops
    packed = b[at : at + (n + 1) // 2]
    at += (n + 1) // 2
    seq = "".join(NIBBLES[x >> 4] + NIBBLES[x & 15] for x in packed)[:n] or "*"
    raw = b[at : at + n]
    qual = "*" if not n or raw[0] == 255 else "".join(chr(33 + q) for q in raw)
    mate = "*" if mate_ref < 0 else "=" if mate_ref == ref else h.names[mate_ref]
    return qname, flag, h.names[ref] if ref >= 0 else "*", pos + 1, mapq, "".join(f"{o >> 4}{OPS[o & 15]}" for o in ops) or "*", mate, mate_pos + 1, tlen, seq, qual


def records(path: str, name: str | None = None, first: int = 0, last: int = 1 << 62, low: int = 0, high: int = 1 << 31) -> Iterator[tuple]:
    """The records of one file, or of one split of it, streamed; positions are 1-based, those without a place 0. ``name``: only
    this reference; ``low``, ``high``: only positions between them."""
    h = _Header(path)
    want = None if name is None else h.names.index(name) if name in h.names else -1 if name == "*" else -2
    for b in _raw(path, h, first, last):
        ref, pos = struct.unpack_from("<ii", b)
        if want is not None and ref != want or not low <= pos + 1 <= high:
            if want is not None and want >= 0 and h.is_sorted and (ref > want or ref == want and pos + 1 > high):
                return
            continue
        yield _row(b, h)


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.files, self.split = sorted(glob.glob(path)) or [path], split
        self.names: set[str] = set()
        self.low, self.high = 0, 1 << 31

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("rname",):
                self.names.add(f.value)
            elif isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute == ("pos",):
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """The splits that may hold wanted records. In a file sorted by place the first record of every split tells; it is looked up
        in the split's first blocks, so no index file is needed."""
        if len(self.names) > 1:  # no record is on two references
            return [InputPartition(None)]
        out = []
        name = next(iter(self.names), None)
        for path in self.files:
            size = os.path.getsize(path)
            borders = [*range(0, max(size, 1), self.split), size]
            splits = list(zip(borders[:-1], borders[1:], strict=True))
            h = _Header(path)
            if name in h.names and h.is_sorted and len(splits) > 1:
                want, starts = h.names.index(name), []
                for a, b in splits:
                    one = next(_raw(path, h, a, b), None)
                    ref, pos = struct.unpack_from("<ii", one) if one else (None, None)
                    starts.append(None if one is None else (ref if ref >= 0 else len(h.names), pos + 1))
                kept = []
                for i, s in enumerate(starts):
                    following = next((x for x in starts[i + 1 :] if x is not None), None)
                    if s is not None and s <= (want, self.high) and (following is None or following >= (want, self.low)):
                        kept.append(splits[i])
                splits = kept
            out += [InputPartition((path, *s)) for s in splits]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        kinds = {"string": pa.string(), "int": pa.int32()}
        schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in SCHEMA.split(", "))])
        path, first, last = partition.value
        rows: list[tuple] = []
        for r in records(path, next(iter(self.names), None), first, last, self.low, self.high):
            rows.append(r)
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class BamSource(DataSource):
    """Format ``bam``: a task per split of a file, rows in Arrow batches. An equality on rname and bounds on pos are applied while
    reading, and choose the splits of files that are sorted by place. Option ``split``: compressed bytes of a split."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("split", SPLIT)))


def bam(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The records of BAM files; ``path`` may be a pattern, of a folder that all executors and the driver see."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("split", str(split)).load(path)


def references(path: str) -> list[tuple[str, int]]:
    """Names and lengths of a file's references."""
    with gzip.open(path, "rb") as f:
        f.read(4)
        f.read(struct.unpack("<i", f.read(4))[0])
        out = []
        for _ in range(struct.unpack("<i", f.read(4))[0]):
            name = f.read(struct.unpack("<i", f.read(4))[0])[:-1].decode()
            out.append((name, struct.unpack("<i", f.read(4))[0]))
        return out


def _block(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\6\0BC\2\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_bam(path: str, refs: list[tuple[str, int]], rows: list[tuple], is_sorted: bool = False) -> None:
    """A BAM file of rows in the schema's order, for exchange of small sets and tests."""
    import re

    ids = {n: i for i, (n, _) in enumerate(refs)}
    text = b"@HD\tVN:1.6\tSO:coordinate\n" if is_sorted else b""
    out = [b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))]
    for n, length in refs:
        out.append(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", length))
    for qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual in rows:
        ops = [int(n) << 4 | OPS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
        letters = "" if seq == "*" else seq
        codes = [NIBBLES.index(c) if c in NIBBLES else 15 for c in letters.upper()] + [0] * (len(letters) % 2)
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
        quals = bytes([255] * len(letters)) if qual == "*" else bytes(ord(c) - 33 for c in qual)
        ref = ids.get(rname, -1)
        mate = ref if rnext == "=" else ids.get(rnext, -1)
        body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(qname) + 1, mapq, 0, len(ops), flag, len(letters), mate, pnext - 1, tlen)
        body += qname.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + quals
        out.append(struct.pack("<i", len(body)) + body)
    data = b"".join(out)
    with open(path, "wb") as f:
        for i in range(0, len(data), 60_000):
            f.write(_block(data[i : i + 60_000]))
        f.write(_block(b""))
