"""Quantiles of very large columns with bounded rank error, from sketches that can be combined.

A sketch of a key is a set of sorted buffers. A full buffer has exactly ``k`` values that each stand for 2**level values; the
values that don't fill a buffer stay as they are, at weight 1. Two full buffers of one level collapse into one of the next: merged,
every second position kept, first the odd ones, then the even ones, by turns. A collapse of level l moves a rank by at most
2**l, so a key of n values has a rank error of at most n * log2(n / k) / (2 * k); the sum that really arose is carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.records import ship

#: Values of a buffer. 0.5 percent of rank error at 2**31 values a key.
K = 2048
#: Sketches merged by one task for a key in one round of the tree.
FAN_IN = 64
#: Rows a task holds while it builds sketches; more go into a further sketch.
CHUNK = 1 << 20


class Sketch:
    """Buffers of one key by level, the values below a buffer's size, and the rank error so far."""

    __slots__ = ("error", "full", "k", "n", "rest", "turn")

    def __init__(self, k: int):
        self.k, self.n, self.error = k, 0, 0
        self.full: dict[int, list[np.ndarray]] = {}
        self.rest: list[np.ndarray] = []
        self.turn: dict[int, int] = {}

    def add(self, values: np.ndarray) -> None:
        """Values of weight 1."""
        self.n += len(values)
        self.rest.append(values)
        if sum(map(len, self.rest)) >= self.k:
            flat = np.sort(np.concatenate(self.rest))
            # interleaved, not cut: every buffer then covers the whole range
            whole = len(flat) // self.k
            spread = flat[: whole * self.k].reshape(self.k, whole)
            for i in range(whole):
                self.put(0, np.ascontiguousarray(spread[:, i]))
            self.rest = [flat[whole * self.k :]]

    def put(self, level: int, values: np.ndarray) -> None:
        """A full, sorted buffer; collapses as long as its level has two."""
        while True:
            same = self.full.setdefault(level, [])
            same.append(values)
            if len(same) < 2:
                return
            both = np.concatenate(same)
            both.sort(kind="stable")
            turn = self.turn.get(level, 0)
            self.turn[level] = 1 - turn
            self.full[level] = []
            self.error += 1 << level
            values, level = both[turn::2], level + 1

    def rows(self) -> Iterator[tuple[int, np.ndarray]]:
        """(level, values); level -1 for the values of weight 1 that fill no buffer."""
        rest = [x for x in self.rest if len(x)]
        if rest:
            yield -1, np.sort(np.concatenate(rest))
        for level, buffers in self.full.items():
            for b in buffers:
                yield level, b

    def quantiles(self, probabilities: Sequence[float]) -> list[float]:
        values, weights = [], []
        for level, b in self.rows():
            values.append(b)
            weights.append(np.full(len(b), 1 << max(level, 0), dtype=np.int64))
        v, w = np.concatenate(values), np.concatenate(weights)
        order = np.argsort(v, kind="stable")
        v, upto = v[order], np.cumsum(w[order])
        at = np.searchsorted(upto, [max(1, math.ceil(q * self.n)) for q in probabilities])
        return v[np.minimum(at, len(v) - 1)].tolist()


def _schema(keys: list[str], df: DataFrame) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def _table(keys: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(len(keys) + 5)]
    arrays = [pa.array(list(c), type=t) for c, t in zip(cols[: len(keys)], types, strict=True)]
    arrays += [pa.array(cols[-5], pa.int32()), pa.array(cols[-4], pa.int32()), pa.array(cols[-3], pa.int64()), pa.array(cols[-2], pa.int64()), pa.array(cols[-1], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, names=[*keys, "part", "level", "n", "error", "values"])


def build_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = K) -> DataFrame:
    """Sketch rows (keys..., part, level, n, error, values) of an integer column, one sketch per key and task.

    No shuffle: each task turns up to ``CHUNK`` rows at a time into sketches, so its memory doesn't depend on the data. n and error
    stand on one row of a sketch and are 0 on its others, so sums over rows are right. Null values are left out, a null key is
    a key of its own, an empty table gives no rows. Rows of different tables, files or days can be united and merged.
    """
    keys = list(keys)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            types = [t.schema.field(i).type for i in range(len(keys))]
            frame = t.select(keys).to_pandas()
            codes = frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy() if keys else np.zeros(len(frame), dtype=np.int64)
            v = t.column("__v").to_numpy()
            order = np.lexsort((v, codes))
            codes, v = codes[order], v[order]
            edges = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True])
            firsts = [t.column(i).take(pa.array(order[edges[:-1]])).to_pylist() for i in range(len(keys))]
            out: list[tuple] = []
            for g in range(len(edges) - 1):
                s = Sketch(k)
                s.add(v[edges[g] : edges[g + 1]])
                key = tuple(c[g] for c in firsts)
                for i, (level, b) in enumerate(s.rows()):
                    out.append((*key, part, level, 0 if i else s.n, 0 if i else s.error, b))
                if len(out) >= 5000:
                    yield _table(keys, types, out)
                    out = []
            if out:
                yield _table(keys, types, out)

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= CHUNK:
                yield from emit()
                held, size = [], 0
        if size:
            yield from emit()

    data = df.select(*keys, F.col(value).cast("long").alias("__v")).where("__v IS NOT NULL")
    return data.mapInArrow(run, f"{_schema(keys, df) + ', ' if keys else ''}part int, level int, n long, error long, values array<long>")


def _fold(df: DataFrame, keys: list[str], bucket, k: int, probabilities: Sequence[float] | None) -> DataFrame:
    """One round of the tree: the sketch rows of a (key, bucket) to one sketch, or to its quantiles."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        s = Sketch(k)
        out: list[tuple] = []
        types: list[pa.DataType] = []

        def close() -> None:
            key, part = now[:-1], now[-1]
            if probabilities is not None:
                out.append((*key, part, 0, s.n, s.error, s.quantiles(probabilities)))
            else:
                for i, (level, b) in enumerate(s.rows()):
                    out.append((*key, part, level, 0 if i else s.n, 0 if i else s.error, b))

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(keys))]
            cols = [batch.column(i).to_pylist() for i in range(len(keys))]
            parts, levels, ns, errors = (batch.column(len(keys) + i).to_pylist() for i in range(4))
            lists = batch.column(len(keys) + 4)
            flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            for r in range(batch.num_rows):
                key = (*(c[r] for c in cols), parts[r])
                if key != now:
                    if now is not None:
                        close()
                    now, s = key, Sketch(k)
                values = flat[offsets[r] : offsets[r + 1]].copy()
                if levels[r] < 0:
                    s.n -= len(values)
                    s.add(values)
                else:
                    s.put(levels[r], values)
                s.n += ns[r]
                s.error += errors[r]
            if len(out) >= 5000:
                yield _table(keys, types, out)
                out.clear()
        if now is not None:
            close()
        if out:
            yield _table(keys, types, out)

    rows = df.withColumn("part", bucket.cast("int"))
    # the order in which sketches are merged rests on their content, not on when they arrive
    rows = rows.withColumns({"__part": F.col("part"), "__n": -F.col("n")}).repartition(*keys, "part").sortWithinPartitions(*keys, "part", "level", "values", "__n", "error").drop("__part", "__n")
    return rows.mapInArrow(run, f"{_schema(keys, df) + ', ' if keys else ''}part int, level int, n long, error long, values array<long>")


def _rounds(parts: int) -> int:
    return max(1, math.ceil(math.log(max(2, parts)) / math.log(FAN_IN)))


def merge_sketches(sketches: DataFrame, keys: Sequence[str], k: int = K, parts: int | None = None) -> DataFrame:
    """One sketch per key, in the same form, so results of files or days can be merged again and by fewer keys.

    A tree of rounds in which a task merges at most ``FAN_IN`` tasks' sketches of a key: a key that every task holds is merged by
    many tasks first, and a task never holds more than one sketch. ``parts``: how many tasks built the sketches at most.
    """
    parts = parts or int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(1, _rounds(parts)):
        sketches = _fold(sketches, list(keys), F.floor(F.col("part") / FAN_IN), k, None)
    return _fold(sketches, list(keys), F.lit(0), k, None)


def query_sketches(sketches: DataFrame, keys: Sequence[str], probabilities: Sequence[float], k: int = K, parts: int | None = None) -> DataFrame:
    """Quantiles of every key: rows (keys..., q, value, n, rank_error), rank_error as a share of n that no answer exceeds."""
    keys = list(keys)
    parts = parts or int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(1, _rounds(parts)):
        sketches = _fold(sketches, keys, F.floor(F.col("part") / FAN_IN), k, None)
    done = _fold(sketches, keys, F.lit(0), k, list(probabilities))
    pairs = F.arrays_zip(F.array(*[F.lit(float(q)) for q in probabilities]).alias("q"), F.col("values").alias("value"))
    return done.select(*keys, "n", (F.col("error") / F.col("n")).alias("rank_error"), F.inline(pairs).alias("q", "value")).select(*keys, "q", "value", "n", "rank_error")
