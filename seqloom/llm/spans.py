"""Long stretches of bases that appear letter for letter in more than one record.

Paragraph MinHash banding. A paragraph is a stretch of neighbouring windows of ``least`` bases that have one MinHash over their anchors
(shorter windows); so paragraphs are cut by content, and the next begins ``least`` - 1 bases before one ends. Equal windows
have equal MinHashes, so one band of one row has recall 1 here, and a bucket's paragraphs share an anchor. They are joined to
the bucket's representative, not to each other, aligned at the anchor and verified letter by letter. What that leaves open, in buckets of
three or more different paragraphs, is completed by comparing their windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.terms import _codes, windows
from seqloom.operators.graph import weak_components
from seqloom.operators.intervals import merged_runs
from seqloom.records import beside, cut, merge, ship

#: Bases of an anchor; windows of one paragraph at most (the bits of a mask).
ANCHOR, RUN = 20, 32
#: Bases handled at once by a task.
BASES = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64 bits (the finalizer of a well-known public hash)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _least_of(h: np.ndarray, w: int) -> np.ndarray:
    """The smallest of every ``w`` neighbours."""
    p, m = 1, h
    while 2 * p <= w:
        m = np.minimum(m[:-p], m[p:])
        p *= 2
    return np.minimum(m[: len(h) - w + 1], m[w - p : len(h) - p + 1])


def paragraphs(df: DataFrame, key: str, sequence: str, least: int) -> DataFrame:
    """Rows (rec, pos, h, n, anchor, again, bases, k1, k2): n neighbouring windows of ``least`` bases with one MinHash h, from ``pos`` on.

    ``bases``: their letters, two bits a base; ``anchor``: where in them the anchor of hash h stands first, ``again``: whether it
    stands there once more. k1, k2: 128 bits that stand for the letters.
    """
    width = 4 * ((least + RUN - 1 + 3) // 4)
    schema = pa.schema([("rec", pa.int64()), ("pos", pa.int32()), ("h", pa.int64()), ("n", pa.int32()), ("anchor", pa.int32()), ("again", pa.bool_()), ("bases", pa.binary()), ("k1", pa.int64()), ("k2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _codes()
        rng = np.random.Generator(np.random.PCG64(5))
        times = rng.integers(1, 1 << 63, (2, width // 4), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

        def apart(ids: list[int], text: list[bytes]) -> pa.RecordBatch | None:
            lengths = np.fromiter(map(len, text), dtype=np.int64, count=len(text)) + 1
            firsts = np.cumsum(lengths) - lengths
            bases = code[np.frombuffer(b"|".join(text) + b"|" + b"|" * width, dtype=np.uint8)]
            anchors, good = windows(bases, ANCHOR)
            h = np.where(good, _mix(anchors + np.uint64(1)), np.uint64(0xFFFFFFFFFFFFFFFF))
            low = _least_of(h, least - ANCHOR + 1)
            bad = np.concatenate([[0], np.cumsum(bases > 3)])
            valid = (bad[least:] - bad[:-least])[: len(low)] == 0
            fresh = valid & np.r_[True, ~valid[:-1] | (low[1:] != low[:-1])]
            # a run of one MinHash is cut after RUN windows, counted from its start
            at = np.arange(len(low))
            start = np.maximum.accumulate(np.where(fresh, at, 0))
            fresh |= valid & ((at - start) % RUN == 0)
            begin = np.flatnonzero(fresh)
            if not len(begin):
                return None
            stop = np.minimum(np.r_[begin[1:], len(low)], begin + RUN)
            inside = np.concatenate([[0], np.cumsum(valid)])
            n = inside[stop] - inside[begin]
            rec = np.searchsorted(firsts, begin, side="right") - 1
            near = np.arange(least + RUN - ANCHOR)
            is_anchor = np.r_[h, np.zeros(width, dtype=np.uint64)][begin[:, None] + near[None, :]] == low[begin][:, None]
            is_anchor &= near[None, :] < (n + least - ANCHOR)[:, None]
            cells = bases[begin[:, None] + np.arange(width)[None, :]]
            cells[np.arange(width)[None, :] >= (n + least - 1)[:, None]] = 0
            packed = np.ascontiguousarray((cells[:, 0::4] << 6) | (cells[:, 1::4] << 4) | (cells[:, 2::4] << 2) | cells[:, 3::4])
            size = width // 4
            blobs = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.arange(0, size * (len(begin) + 1), size, dtype=np.int32)), pa.py_buffer(packed.tobytes())])
            key = [_mix((_mix(packed.astype(np.uint64) + np.uint64(1 + i)) * times[i]).sum(axis=1, dtype=np.uint64) + n.astype(np.uint64)).view(np.int64) for i in range(2)]
            columns = [np.asarray(ids, dtype=np.int64)[rec], (begin - firsts[rec]).astype(np.int32), low[begin].view(np.int64), n.astype(np.int32), is_anchor.argmax(axis=1).astype(np.int32), is_anchor.sum(axis=1) > 1]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), blobs, *map(pa.array, key)], schema=schema)

        for b in batches:
            ids, text, size = [], [], 0
            for i, x in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                text.append(x)
                size += len(x)
                if size >= BASES:
                    if (out := apart(ids, text)) is not None:
                        yield out
                    ids, text, size = [], [], 0
            if ids and (out := apart(ids, text)) is not None:
                yield out

    data = df.select(F.col(key).cast("long").alias("__i"), F.col(sequence).alias("__s")).where("__i IS NOT NULL AND __s IS NOT NULL")
    return data.mapInArrow(run, "rec long, pos int, h long, n int, anchor int, again boolean, bases binary, k1 long, k2 long")


def _cells(column: pa.Array) -> np.ndarray:
    """Packed letters of a batch as numbers 0 to 3, a row each."""
    blobs = column.to_pylist()
    packed = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(len(blobs), -1)
    cells = np.empty((len(blobs), packed.shape[1] * 4), dtype=np.uint8)
    for j in range(4):
        cells[:, j::4] = (packed >> (6 - 2 * j)) & 3
    return cells


def _aligned(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs (k1, k2, n, anchor, bases and the same with r_) to (…, mask, r_mask): the windows of both that lie in their common stretch.

    The two are laid together at their anchors and compared letter by letter, to the left and to the right, up to the first difference.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 8192):
                b = whole.slice(i, 8192)
                col = dict(zip(whole.schema.names, b.columns, strict=True))
                x, y = _cells(col["bases"]), _cells(col["r_bases"])
                n, rn, a, ra = (col[c].to_numpy().astype(np.int64) for c in ("n", "r_n", "anchor", "r_anchor"))
                size, r_size = n + least - 1, rn + least - 1
                left, right = np.minimum(a, ra), np.minimum(size - a, r_size - ra)
                step = np.arange(max(x.shape[1], y.shape[1]))
                cut_at = lambda m, p: np.take_along_axis(m, np.clip(p, 0, m.shape[1] - 1), axis=1)
                same = cut_at(x, a[:, None] + step) == cut_at(y, ra[:, None] + step)
                r = np.where(step[None, :] < right[:, None], same, False)
                r = np.where(r.all(axis=1), len(step), r.argmin(axis=1))
                same = cut_at(x, a[:, None] - 1 - step) == cut_at(y, ra[:, None] - 1 - step)
                lt = np.where(step[None, :] < left[:, None], same, False)
                lt = np.where(lt.all(axis=1), len(step), lt.argmin(axis=1))
                shared = lt + r - least + 1  # windows in the common stretch
                of = lambda first, count: ((np.uint64(1) << np.clip(shared, 0, 63).astype(np.uint64)) - np.uint64(1)) << np.clip(first, 0, 63).astype(np.uint64) & ((np.uint64(1) << count.astype(np.uint64)) - np.uint64(1))
                mask, r_mask = of(a - lt, n), of(ra - lt, rn)
                ok = np.flatnonzero(shared > 0)
                take = pa.array(ok)
                yield pa.RecordBatch.from_arrays([*(col[c].take(take) for c in ("k1", "k2", "r_k1", "r_k2")), pa.array(mask[ok].view(np.int64)), pa.array(r_mask[ok].view(np.int64))], names=["k1", "k2", "r_k1", "r_k2", "mask", "r_mask"])

    return pairs.mapInArrow(run, "k1 long, k2 long, r_k1 long, r_k2 long, mask long, r_mask long")


def _windows(df: DataFrame, least: int) -> DataFrame:
    """Rows (k1, k2, n, bases, lo, hi) to one row (w, k1, k2, at, lo, hi) per window: w is its letters, two bits a base."""
    size = (least + 3) // 4
    schema = pa.schema([("w", pa.binary()), ("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                b = whole.slice(i, 4096)
                cells = _cells(b.column(3))
                n = b.column(2).to_numpy()
                row = np.repeat(np.arange(b.num_rows), n)
                at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                flat = np.concatenate([cells.ravel(), np.zeros(4 * size, dtype=np.uint8)])
                four = (flat[:-3] << 6) | (flat[1:-2] << 4) | (flat[2:-1] << 2) | flat[3:]
                packed = four[(row * cells.shape[1] + at)[:, None] + 4 * np.arange(size)[None, :]]
                if least % 4:
                    packed[:, -1] &= np.uint8(0xFF << (8 - 2 * (least % 4)) & 0xFF)
                w = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(np.arange(0, size * (len(row) + 1), size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(packed).tobytes())])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([w, b.column(0).take(take), b.column(1).take(take), pa.array(at.astype(np.int32)), b.column(4).take(take), b.column(5).take(take)], schema=schema)

    return df.select("k1", "k2", "n", "bases", "lo", "hi").mapInArrow(run, "w binary, k1 long, k2 long, at int, lo long, hi long")


ID = ["k1", "k2"]


def _buckets(df: DataFrame, key: str, sequence: str, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The paragraphs of live buckets, the different ones of them with their smallest and greatest record, and verified stretches of these and their representatives."""
    if least <= ANCHOR:
        raise ValueError(f"least must be more than {ANCHOR}")
    ship(df.sparkSession)
    whole = cut(paragraphs(df, key, sequence, least))
    # only buckets of several records have anything to share; from here on the others aren't read
    live = cut(whole.groupBy("h").agg(F.min("rec").alias("l"), F.max("rec").alias("u")).where("l <> u").select("h"))
    every = cut(beside(whole, live, ["h"], by="rec"))
    one = cut(every.groupBy(*ID).agg(F.first("h").alias("h"), F.first("n").alias("n"), F.first("anchor").alias("anchor"), F.first("again").alias("again"), F.first("bases").alias("bases"), F.min("rec").alias("lo"), F.max("rec").alias("hi"), F.count(F.lit(1)).alias("c")))
    # the commonest of a bucket stands for it
    top = one.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.max("again").alias("any_again"), F.max_by(F.struct(*[F.col(c).alias(f"r_{c}") for c in (*ID, "n", "anchor", "bases", "lo", "hi")]), F.struct("c", "n", *ID)).alias("r")).where("k > 1")
    top = cut(top.select("h", "k", "any_again", "r.*"))
    members = cut(beside(one, top, ["h"], by="k1"))
    both = members.where("NOT (k1 = r_k1 AND k2 = r_k2) AND (lo <> hi OR r_lo <> r_hi OR lo <> r_lo)")
    links = _aligned(both.select(*ID, "n", "anchor", "bases", "r_k1", "r_k2", "r_n", "r_anchor", "r_bases"), least)
    return every, members, cut(links)


def shared_spans(df: DataFrame, key: str, sequence: str, least: int = 48) -> DataFrame:
    """Rows (key, pos, span_len): the maximal runs of bases of a record that lie in stretches of at least ``least`` bases which
    appear in another record too, in the same direction. ``pos`` is 0-based. One row of ``df`` is a record, ``key`` an integer.

    Equal paragraphs are one row from the first aggregation on, with the smallest and the greatest record they come from, so a group of
    copies that holds a third of all rows costs as much as one of them. A paragraph of several records is shared as a whole;
    another shares what it has in common with the representative of its bucket. A bucket of two different paragraphs is done with that; only
    in others, windows that are still open are compared one by one, by smallest and greatest record. Pairs are never built.

    ``least`` is more than ``ANCHOR``. Bases are compared in upper case; stretches with other letters than A, C, G, T aren't looked
    at. Records without key or sequence are left out, and so have no rows, as have records without shared bases. A key that
    repeats is one record. An empty table gives no rows. Letters of paragraphs are told apart by 128 bits.
    """
    every, members, links = _buckets(df, key, sequence, least)
    return _spans(every, _masks(every, members, links, least), key, least)


def _full(n: str = "n"):
    return F.expr(f"shiftleft(1L, {n}) - 1")


def _verified(every: DataFrame, members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Masks (k1, k2, mask) by whole paragraphs, and by the common stretches with representatives."""
    whole = every.groupBy(*ID).agg(F.first("n").alias("n"), F.min("rec").alias("lo"), F.max("rec").alias("hi")).where("lo <> hi").select(*ID, _full().alias("mask"))
    parts = links.select(*ID, "mask").unionByName(links.select(F.col("r_k1").alias("k1"), F.col("r_k2").alias("k2"), F.col("r_mask").alias("mask")))
    return whole, parts.groupBy(*ID).agg(F.bit_or("mask").alias("mask"))


def _masks(every: DataFrame, members: DataFrame, links: DataFrame, least: int, complete: bool = True) -> DataFrame:
    """Which windows of the different paragraphs are shared: rows (k1, k2, mask)."""
    whole, parts = _verified(every, members, links)
    known = cut(whole.unionByName(parts).groupBy(*ID).agg(F.bit_or("mask").alias("mask")))
    if not complete:
        return known
    # open: windows of one record's paragraph, where a paragraph other than the representative, or another place of the anchor, may have them
    rest = members.where("k > 2 OR any_again").join(merge(known), ID, "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    rest = cut(rest.withColumn("open", F.col("mask") != _full()).select("h", *ID, "n", "bases", "lo", "hi", "open"))
    asked = rest.where("open").select("h").distinct()
    wins = cut(_windows(rest.join(merge(asked), "h", "left_semi"), least))
    shared = wins.groupBy("w").agg(F.min("lo").alias("l"), F.max("hi").alias("u")).where("l <> u").select("w")
    more = wins.where("lo = hi").join(merge(shared), "w", "left_semi").groupBy(*ID).agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))
    return cut(known.unionByName(more).groupBy(*ID).agg(F.bit_or("mask").alias("mask")))


def _spans(every: DataFrame, masks: DataFrame, key: str, least: int) -> DataFrame:
    """The runs of shared bases of every record, of its paragraphs' masks."""
    found = beside(every.select("rec", "pos", "n", *ID), masks, ID, by="rec")
    runs = found.withColumn("a", F.expr("filter(sequence(0, n - 1), i -> (shiftright(mask, i) & 1) = 1 AND (i = 0 OR (shiftright(mask, i - 1) & 1) = 0))"))
    runs = runs.withColumn("b", F.expr("filter(sequence(0, n - 1), i -> (shiftright(mask, i) & 1) = 1 AND (shiftright(mask, i + 1) & 1) = 0)"))
    runs = runs.select("rec", "pos", F.inline(F.arrays_zip("a", "b")))
    # a record's runs are bounded by its own length
    places = runs.groupBy("rec", (F.col("pos") + F.col("a")).alias("a")).agg(F.max(F.col("pos") + F.col("b") + (least - 1)).alias("b"))
    return merged_runs(places, ["rec"]).select(F.col("rec").alias(key), F.col("a").alias("pos"), (F.col("b") - F.col("a") + 1).alias("span_len"))


def verified_spans(df: DataFrame, key: str, sequence: str, least: int = 48) -> DataFrame:
    """The spans that banding and verification alone give, without the completion: for measuring its recall against :func:`shared_spans`."""
    every, members, links = _buckets(df, key, sequence, least)
    return _spans(every, _masks(every, members, links, least, complete=False), key, least)


def shared_classes(df: DataFrame, key: str, sequence: str, least: int = 48) -> DataFrame:
    """Rows (key, class, links): the components of records by shared stretches of at least ``least`` bases, and with how many other
    records each shares one. A class is named by its smallest record. Records that share nothing have no row.

    Exact, as :func:`shared_spans` is. Windows that the same paragraphs hold, and then those that the same records hold, are one set (told
    apart by 128 bits and the number of members), so a stretch that a third of all records hold is one set, and a record of one set has its
    other members as partners. Pairs are made only for records of several sets, whose partners have to be told apart.
    """
    every, members, links = _buckets(df, key, sequence, least)
    masks = _masks(every, members, links, least).where("mask <> 0")
    one = every.groupBy(*ID).agg(F.first("n").alias("n"), F.first("bases").alias("bases"))
    held = one.join(merge(masks), ID).select(*ID, "n", "bases", F.col("mask").alias("lo"), F.col("mask").alias("hi"))
    shared = _windows(held, least).where("(shiftright(lo, at) & 1) = 1").select("w", *ID).distinct()
    paragraph_sets = _sets(shared, "w", ID)
    records = beside(every.select("rec", *ID), cut(paragraph_sets), ID, by="rec").select("rec", "set").distinct()
    sets = cut(_sets(records, "set", ["rec"]))
    sizes = cut(sets.groupBy("set").agg(F.count(F.lit(1)).alias("members"), F.min("rec").alias("first")).where("members > 1"))
    mine = cut(beside(sets, sizes, ["set"], by="rec"))
    several = cut(mine.groupBy("rec").agg(F.count(F.lit(1)).alias("sets"), F.max("members").alias("members")))
    pairs = mine.join(merge(several.where("sets > 1").select("rec")), "rec", "left_semi").select("rec", "set")
    partners = pairs.join(merge(mine.select("set", F.col("rec").alias("other"))), "set").where("rec <> other").select("rec", "other").distinct()
    counts = several.where("sets = 1").select("rec", (F.col("members") - 1).alias("links")).unionByName(partners.groupBy("rec").agg(F.count(F.lit(1)).alias("links")))
    classes = weak_components(mine.select("rec", F.col("first").alias("other")), "rec", "other")
    return classes.select(F.col("node").alias("rec"), F.col("component").alias("class")).join(merge(counts), "rec").select(F.col("rec").alias(key), "class", "links")


def _sets(rows: DataFrame, of: str, by: list[str]) -> DataFrame:
    """Rows (of, by...), all different, to rows (set, by...): those of ``of`` that have the same members are one set."""
    marks = [F.xxhash64(F.lit(i), *by) for i in range(2)]
    named = rows.groupBy(of).agg(F.struct(*[F.bit_xor(m).alias(f"m{i}") for i, m in enumerate(marks)], F.count(F.lit(1)).alias("n")).alias("__set"))
    # one of a set's stands for it
    first = named.groupBy("__set").agg(F.min(of).alias(of))
    return rows.join(merge(first), of).select(F.col("__set").alias("set"), *by)
