"""Pairwise alignment of sequences: overlap, local, global. NumPy over whole rows, in Arrow batches."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.records import merge, ship

NONE = -(1 << 29)


def _bytes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("ascii", "replace"), dtype=np.uint8)


class Overlap(NamedTuple):
    """An overlap: its score, the cell where it ends, the bases left out behind it, whether it ends the first sequence, its start."""

    score: int
    row: int
    col: int
    clip: int
    ends_first: bool
    row_start: int
    col_start: int


def overlap(a: str, b: str, mismatch: int = -2, indel: int = -2, clip: int = 50) -> Overlap:
    """The best semi-global overlap of two sequences: both may begin freely, one of them must end, or come within ``clip`` bases of it.

    Match +1. Of equal scores the smaller clip, then the end of the first sequence, then the smaller other coordinate. The path
    prefers the diagonal, then up, then left. Empty sequences overlap by 0.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return Overlap(0, 0, 0, 0, True, 0, 0)
    x, y = _bytes(a), _bytes(b)
    if mismatch < 1 and indel < 0:
        # one that stands in the other letter for letter scores its length, which nothing else can and no other path does
        p, q = x.tobytes(), y.tobytes()
        if (at := q.find(p)) >= 0:
            return Overlap(n, n, at + n, 0, True, 0, at)
        if p.endswith(q):
            return Overlap(m, n, m, 0, True, n - m, 0)
        if (at := p.find(q)) >= 0:
            return Overlap(m, at + m, m, 0, False, at, 0)
    table = np.zeros((n + 1, m + 1), dtype=np.int32)
    fall = -indel * np.arange(m + 1, dtype=np.int32)
    against = {c: np.where(y == c, 1, mismatch).astype(np.int32) for c in set(x.tolist())}
    for i, c in enumerate(x.tolist(), 1):
        before, row = table[i - 1], table[i]
        np.add(before[:-1], against[c], out=row[1:])
        np.maximum(row[1:], before[1:] + indel, out=row[1:])
        row += fall
        np.maximum.accumulate(row, out=row)
        row -= fall
        row[0] = 0
    top = (NONE, 0, 0, 0, True)
    for c in range(min(clip, max(n, m) - 1) + 1):
        if c < n:
            j = int(table[n - c].argmax())
            if table[n - c, j] > top[0]:
                top = (int(table[n - c, j]), n - c, j, c, True)
        if c < m:
            i = int(table[:, m - c].argmax())
            if table[i, m - c] > top[0]:
                top = (int(table[i, m - c]), i, m - c, c, False)
    score, i, j, c, first = top
    end = (i, j)
    while i and j:
        if table[i, j] == table[i - 1, j - 1] + (1 if x[i - 1] == y[j - 1] else mismatch):
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + indel:
            i -= 1
        else:
            j -= 1
    return Overlap(score, *end, c, first, i, j)


def significance(o: Overlap, n: int, m: int, fraction: float = 0.005, loss: float = 0.4, least: int = 12, weak: int = 6, new_bases: int = 5) -> int | None:
    """2 for a good overlap, 1 for one that needs support, 0 for too short; None if it is refused.

    Refused: shorter than ``fraction`` of both sequences, fewer than ``new_bases`` that the other sequence adds, or a score below
    the overlap's length times (1 - loss).
    """
    size = min(n, m, o.col if o.ends_first else o.row)
    adds = (m - o.col) if o.ends_first else (n - o.row)
    if (size < fraction * n and size < fraction * m) or adds < new_bases or o.score < size * (1 - loss):
        return None
    return 0 if size < weak else 1 if size < least else 2


def merged(a: str, b: str, o: Overlap) -> str:
    """Both sequences as one: the one whose end overlaps, then what the other adds; the longer one if it contains the other."""
    if o.ends_first:
        return a[: o.row] + b[o.col :] if o.col_start == 0 or o.row_start > 0 else b
    return b[: o.col] + a[o.row :] if o.row_start == 0 or o.col_start > 0 else a


class Local(NamedTuple):
    """A local alignment: score and both stretches, 1-based and inclusive; zeros if nothing aligns."""

    score: int
    first_start: int
    first_end: int
    second_start: int
    second_end: int


def _local_end(x: np.ndarray, y: np.ndarray, match: int, mismatch: int, other: int, start: int, extend: int) -> tuple[int, int, int]:
    """Best score of a local alignment and where it ends, the earliest of equal ones."""
    m = len(y)
    h, f = np.zeros(m + 1, dtype=np.int32), np.full(m + 1, NONE, dtype=np.int32)
    fall = extend * np.arange(m + 1, dtype=np.int32)
    strange = ~np.isin(y, _bytes("ACGTacgt"))
    best = (0, 0, 0)
    for i, base in enumerate(x, 1):
        s = np.where(strange | (chr(base) not in "ACGTacgt"), other, np.where((y | 32) == (base | 32), match, mismatch)).astype(np.int32)
        f = np.maximum(h - start, f) - extend
        now = np.maximum(f, 0)
        now[1:] = np.maximum(now[1:], h[:-1] + s)
        now[0] = 0
        reach = np.maximum.accumulate(now + fall)
        now[1:] = np.maximum(now[1:], reach[:-1] - start - fall[1:])
        j = int(now.argmax())
        if now[j] > best[0]:
            best = (int(now[j]), i, j)
        h = now
    return best


def local(a: str, b: str, match: int = 1, mismatch: int = -3, other: int = -2, gap_open: int = 5, gap_extend: int = 2) -> Local:
    """The best local alignment with affine gaps: a gap of n costs open + n * extend. Letters other than A, C, G, T score ``other``.

    The start is found by aligning the reversed beginnings, so memory grows with one sequence, not with both.
    """
    if not a or not b:
        return Local(0, 0, 0, 0, 0)
    x, y = _bytes(a), _bytes(b)
    score, i, j = _local_end(x, y, match, mismatch, other, gap_open, gap_extend)
    if not score:
        return Local(0, 0, 0, 0, 0)
    _, di, dj = _local_end(x[:i][::-1], y[:j][::-1], match, mismatch, other, gap_open, gap_extend)
    return Local(score, i - di + 1, i, j - dj + 1, j)


#: Cells of a table's antidiagonal that are worked on at once by :func:`locals_of`.
CELLS = 1 << 15

#: A, C, G, T as 0 to 3 in either case, other letters as 4.
_CODES = np.full(256, 4, dtype=np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODES[[ord(_c), ord(_c.lower())]] = _i


def _local_ends(xs: list[np.ndarray], ys: list[np.ndarray], match: int, mismatch: int, other: int, start: int, extend: int) -> np.ndarray:
    """:func:`_local_end` of several pairs of coded sequences: columns score, i, j.

    An antidiagonal of all tables is one step. Its cells rest on the two before it only, and lie row by row, pair by pair in flat arrays.
    """
    count, n, m = len(xs), max(map(len, xs)), max(map(len, ys))
    # two letters differ by at least a unit, other letters by 8 of them, what is filled up by 32
    unit = 1 << max(match - mismatch, 1).bit_length()
    kind = np.int16 if max(128 * unit, (n + m + 2) * (max(match, mismatch, other) + 1) + start + extend) < 1 << 15 else np.int32
    x, y = np.full((n, count), 32 * unit, dtype=kind), np.full((m, count), 64 * unit, dtype=kind)
    for k, (a, b) in enumerate(zip(xs, ys, strict=True)):
        x[: len(a), k] = np.where(a == 4, 8 * unit, a.astype(kind) * unit)
        y[m - len(b) :, k] = np.where(b == 4, 16 * unit, b.astype(kind) * unit)[::-1]
        y[: m - len(b), k] = 64 * unit
    plain = mismatch < 0 and not any((a == 4).any() for a in [*xs, *ys])
    x, y = x.ravel(), y.ravel()
    size = (n + 1) * count
    h, h1, h2 = (np.zeros(size, dtype=kind) for _ in range(3))
    none = -(start + extend)
    e, f, f1 = (np.full(size, none, dtype=kind) for _ in range(3))
    s, q, best, at = np.empty(size, dtype=kind), np.empty(size, dtype=kind), np.zeros(size, dtype=kind), np.zeros(size, dtype=kind)
    for t in range(2, n + m + 1):
        low, high = max(1, t - m), min(n, t - 1)
        here, above = slice(low * count, (high + 1) * count), slice((low - 1) * count, high * count)
        d, hh, ff, ee = s[here], h[here], f[here], e[here]
        np.bitwise_xor(x[above], y[(m - t + low) * count : (m - t + high + 1) * count], out=d)
        if plain:
            np.minimum(d, match - mismatch, out=d)
            np.subtract(match, d, out=d)
        else:
            # behind an end nothing is gained
            d[:] = np.where(d == 0, match, np.where(d < 8 * unit, mismatch, np.where(d < 32 * unit, other, min(mismatch, other, -1))))
        np.add(h2[above], d, out=hh)
        np.add(h1[(low - 1) * count : (high + 1) * count], none, out=q[(low - 1) * count : (high + 1) * count])
        np.subtract(ee, extend, out=ee)
        np.maximum(ee, q[here], out=ee)
        np.subtract(f1[above], extend, out=ff)
        np.maximum(ff, q[above], out=ff)
        np.maximum(hh, ee, out=hh)
        np.maximum(hh, ff, out=hh)
        np.maximum(hh, 0, out=hh)
        better = np.flatnonzero(hh > best[here])
        if len(better):
            better += low * count
            best[better] = h[better]
            at[better] = t
        h, h1, h2 = h2, h, h1
        f, f1 = f1, f
    best, at, each = best.reshape(n + 1, count), at.reshape(n + 1, count), np.arange(count)
    i = best.argmax(axis=0)
    score = best[i, each].astype(np.int64)
    return np.stack([score, np.where(score > 0, i, 0), np.where(score > 0, at[i, each] - i, 0)], axis=1)


def _all_local_ends(pairs: list[tuple[np.ndarray, np.ndarray]], *options) -> list[list[int]]:
    """:func:`_local_ends` of any number of pairs, neither sequence empty, those of like lengths together."""
    out: list[list[int]] = [[]] * len(pairs)

    def place(k: int) -> tuple[int, int]:
        n, bucket = len(pairs[k][0]), len(pairs[k][1]) >> 5
        return bucket, n if bucket % 2 else -n

    order, i = sorted(range(len(pairs)), key=place), 0
    while i < len(order):
        j, n, m = i, 0, 0
        while j < len(order):
            n, m = max(n, len(pairs[order[j]][0])), max(m, len(pairs[order[j]][1]))
            if j > i and (j + 1 - i) * min(n, m) > CELLS:
                break
            j += 1
        some, i = order[i:j], j
        for k, end in zip(some, _local_ends([pairs[k][0] for k in some], [pairs[k][1] for k in some], *options).tolist(), strict=True):
            out[k] = end
    return out


def locals_of(pairs: list[tuple[str, str]], match: int = 1, mismatch: int = -3, other: int = -2, gap_open: int = 5, gap_extend: int = 2) -> list[Local]:
    """:func:`local` of every pair, the same results: pairs of like lengths are worked on together, so a step is one for many of them."""
    out = [Local(0, 0, 0, 0, 0)] * len(pairs)
    options = (match, mismatch, other, gap_open, gap_extend)
    known = [k for k, (a, b) in enumerate(pairs) if a and b]
    coded = [(_CODES[_bytes(pairs[k][0])], _CODES[_bytes(pairs[k][1])]) for k in known]
    if match > max(mismatch, other) and match > 0 and gap_open >= 0 and gap_extend > 0:
        # one that stands in the other base for base scores its length, which nothing else can: its first place is the earliest end
        whole = [y.tobytes().find(x.tobytes()) if x.max() < 4 else -1 for x, y in coded]
        for k, at, (x, _) in zip(known, whole, coded, strict=True):
            if at >= 0:
                out[k] = Local(len(x) * match, 1, len(x), at + 1, at + len(x))
        known, coded = [k for k, at in zip(known, whole, strict=True) if at < 0], [c for c, at in zip(coded, whole, strict=True) if at < 0]
    ends = _all_local_ends(coded, *options)
    hits = [k for k, end in enumerate(ends) if end[0]]
    back: dict[int, list[int]] = {}

    def turned(k: int, rows: int | None = None, cols: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        _, i, j = ends[k]
        return coded[k][0][:i][::-1][:rows], coded[k][1][:j][::-1][:cols]

    # an alignment of some rows has at most so many columns, as gaps cost: if one of the score lies in the first rows, so does the shortest
    if gap_extend > 0 and gap_open >= 0:
        rows = {k: 4 * ends[k][0] + 32 for k in hits}
        near = [turned(k, rows[k], rows[k] + rows[k] * max(match, mismatch, other) // gap_extend + 1) for k in hits]
        back = {k: end for k, end in zip(hits, _all_local_ends(near, *options), strict=True) if end[0] == ends[k][0]}
    rest = [k for k in hits if k not in back]
    back |= dict(zip(rest, _all_local_ends([turned(k) for k in rest], *options), strict=True))
    for k in hits:
        score, i, j = ends[k]
        out[known[k]] = Local(score, i - back[k][1] + 1, i, j - back[k][2] + 1, j)
    return out


def local_twice(a: str, b: str, rotate: bool = True) -> tuple[Local, Local]:
    """The best local alignment and the best of what it leaves of the second sequence: behind and before it joined (``rotate``), or
    the better of the two sides. The second one's places count within what was left."""
    first = local(a, b)
    if not first.score:
        return first, first
    before, behind = b[: first.second_start - 1], b[first.second_end :]
    if rotate:
        return first, local(a, behind + before)
    return first, max(local(a, before), local(a, behind), key=lambda x: x.score)


def global_cigar(a: str, b: str, match: int = 1, mismatch: int = -3, indel: int = -3, band: int = 50) -> tuple[int, str]:
    """Score and CIGAR (M, I, D) of the best global alignment within ``band`` of the diagonal, doubled until the path is free of its edge."""
    n, m = len(a), len(b)
    x, y = _bytes(a), _bytes(b)
    while True:
        width = max(band, abs(n - m) + 1)
        # only the band is held: cell (i, j) stands at (i, j - i + width)
        table = np.full((n + 1, 2 * width + 2), NONE, dtype=np.int32)
        table[0, width : width + min(width, m) + 1] = indel * np.arange(min(width, m) + 1)
        for i in range(1, n + 1):
            lo, hi = max(0, i - width), min(m, i + width)
            at, before = table[i, lo - i + width : hi - i + width + 1], table[i - 1]
            at[:] = before[lo - i + width + 1 : hi - i + width + 2] + indel
            k = max(lo, 1)
            diagonal = before[k - i + width : hi - i + width + 1] + np.where(y[k - 1 : hi] == x[i - 1], match, mismatch)
            at[k - lo :] = np.maximum(at[k - lo :], diagonal)
            fall = -indel * np.arange(len(at), dtype=np.int32)
            at[:] = np.maximum.accumulate(at + fall) - fall
        cell = lambda i, j: int(table[i, j - i + width]) if 0 <= j - i + width <= 2 * width else NONE
        i, j, ops, edge = n, m, [], False
        while i or j:
            edge = edge or abs(i - j) >= width
            if i and j and cell(i, j) == cell(i - 1, j - 1) + (match if x[i - 1] == y[j - 1] else mismatch):
                ops.append("M")
                i, j = i - 1, j - 1
            elif i and cell(i, j) == cell(i - 1, j) + indel:
                ops.append("I")
                i -= 1
            else:
                ops.append("D")
                j -= 1
        if not edge or width >= max(n, m):
            return cell(n, m), _runs(ops[::-1])
        band = 2 * width


def _runs(ops: list[str]) -> str:
    out, i = [], 0
    while i < len(ops):
        j = i
        while j < len(ops) and ops[j] == ops[i]:
            j += 1
        out.append(f"{j - i}{ops[i]}")
        i = j
    return "".join(out)


def smith_waterman(a: str, b: str, match: int = 2, mismatch: int = -1, indel: int = -1) -> tuple[int, int, int, str]:
    """Score, 0-based starts and CIGAR (M match, U mismatch, I, D) of the best local alignment with linear gaps."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0, 0, 0, ""
    x, y = _bytes(a), _bytes(b)
    table = np.zeros((n + 1, m + 1), dtype=np.int32)
    fall = -indel * np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        best = np.zeros(m + 1, dtype=np.int32)
        best[1:] = np.maximum(0, np.maximum(table[i - 1, :-1] + np.where(y == x[i - 1], match, mismatch), table[i - 1, 1:] + indel))
        table[i] = np.maximum.accumulate(best + fall) - fall
    i, j = (int(v) for v in np.unravel_index(int(table.argmax()), table.shape))
    score, ops = int(table[i, j]), []
    while table[i, j] > 0:
        if table[i, j] == table[i - 1, j - 1] + (match if x[i - 1] == y[j - 1] else mismatch):
            ops.append("M" if x[i - 1] == y[j - 1] else "U")
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + indel:
            ops.append("I")
            i -= 1
        else:
            ops.append("D")
            j -= 1
    return score, i, j, _runs(ops[::-1])


_COMPLEMENT = str.maketrans("ACGTacgt", "TGCATGCA")


def revcomp(s: str) -> str:
    return s[::-1].translate(_COMPLEMENT)


def repeat_cover(a: str, b: str) -> int:
    """Bases of ``b`` that two local alignments of ``a`` or of its reverse complement cover, whichever is more."""

    def covered(s: str) -> int:
        first, second = local_twice(s, b)
        return sum(x.second_end - x.second_start + 1 for x in (first, second) if x.score)

    return max(covered(a), covered(revcomp(a)))


def _twice_of(pairs: list[tuple[str, str]]) -> list[tuple[Local, Local, int]]:
    """Of every pair both alignments of :func:`local_twice`, and the score of the second one without ``rotate``."""
    first = locals_of(pairs)
    rests = [(a, b[: o.second_start - 1], b[o.second_end :]) if o.score else ("", "", "") for (a, b), o in zip(pairs, first, strict=True)]
    second = locals_of([(a, behind + before) for a, before, behind in rests])
    left, right = locals_of([(a, before) for a, before, _ in rests]), locals_of([(a, behind) for a, _, behind in rests])
    return [(o, s, max(x.score, y.score)) for o, s, x, y in zip(first, second, left, right, strict=True)]


def overlap_column(a: Column, b: Column, **options) -> Column:
    """struct<score, row, col, clip, ends_first, row_start, col_start, class, merged> of two sequence columns; null for a null one."""
    ship()

    @F.pandas_udf("score int, row int, col int, clip int, ends_first boolean, row_start int, col_start int, class int, merged string")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for s, t in zip(x, y, strict=True):
            if s is None or t is None:
                rows.append((None,) * 9)
                continue
            o = overlap(s, t, **options)
            c = significance(o, len(s), len(t))
            rows.append((*o, c, merged(s, t, o) if c else None))
        return pd.DataFrame(rows, columns=[*Overlap._fields, "class", "merged"]).astype({k: "Int32" for k in ("score", "row", "col", "clip", "row_start", "col_start", "class")})

    return run(a, b)


def local_column(a: Column, b: Column, **options) -> Column:
    """struct<score, first_start, first_end, second_start, second_end> of the best local alignment; null for a null sequence."""
    ship()

    @F.pandas_udf("score int, first_start int, first_end int, second_start int, second_end int")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        known = [s is not None and t is not None for s, t in zip(x, y, strict=True)]
        found = iter(locals_of([p for p, k in zip(zip(x, y, strict=True), known, strict=True) if k], **options))
        return pd.DataFrame([tuple(next(found)) if k else (None,) * 5 for k in known], columns=list(Local._fields)).astype("Int32")

    return run(a, b)


def comparisons_column(a: Column, b: Column) -> Column:
    """struct of what the other alignments say of two sequences: global and linear-gap scores with their CIGARs, the first and second
    local alignment (remainder rotated, or its better side), and the bases of ``b`` that ``a`` covers on either strand."""
    ship()

    @F.pandas_udf("global_score int, global_cigar string, sw_score int, sw_cigar string, first_score int, second_score int, side_score int, covered int")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        pairs = [(s, t) for s, t in zip(x, y, strict=True) if s is not None and t is not None]
        covered = lambda o: sum(z.second_end - z.second_start + 1 for z in o[:2] if z.score)
        plain, turned = _twice_of(pairs), _twice_of([(revcomp(s), t) for s, t in pairs])
        found = iter(zip(plain, turned, strict=True))
        for s, t in zip(x, y, strict=True):
            if s is None or t is None:
                rows.append((None,) * 8)
                continue
            g, w = global_cigar(s, t), smith_waterman(s, t)
            one, other = next(found)
            rows.append((*g, w[0], w[3], one[0].score, one[1].score, one[2], max(covered(one), covered(other))))
        names = ["global_score", "global_cigar", "sw_score", "sw_cigar", "first_score", "second_score", "side_score", "covered"]
        return pd.DataFrame(rows, columns=names).astype({n: "Int32" for n in names if "cigar" not in n})

    return run(a, b)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt out evenly, or by their keys ``by``: few bytes of pairs can be much work, which partitions sized by bytes don't see."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def verify_pairs(pairs: DataFrame, seqs: DataFrame, id: str, seq: str, **options) -> DataFrame:
    """Candidate pairs (a, b) with the alignment of their sequences: the join comes first, then the function, on candidates only."""
    left, right = (seqs.select(F.col(id).alias(n), F.col(seq).alias(f"__{n}")) for n in ("a", "b"))
    both = spread(pairs.join(merge(left), "a").join(merge(right), "b"))
    return both.withColumn("o", overlap_column(F.col("__a"), F.col("__b"), **options)).select("a", "b", "o.*")


class Extension(NamedTuple):
    """How far an alignment goes on from where both sequences begin: its score, and the bases of both that it takes in."""

    score: int
    first_end: int
    second_end: int


def extension(a: str, b: str, start: int = 0, mismatch: int = -2, indel: int = -2, band: int | None = None) -> Extension:
    """The best alignment that begins at the first bases of both, may end anywhere, and adds to a score of ``start``.

    Match +1. Of equal scores the one that takes in less of a, then less of b. ``band``: greatest difference of the places; only one
    row of that width is held, so memory doesn't grow with the product of the lengths. An empty sequence can't be extended.
    """
    n, m = len(a), len(b)
    band = max(n, m) if band is None else band
    x, y = _bytes(a), _bytes(b)
    width = min(m, band) + 1
    at = np.arange(m + 1)
    row = np.full(m + 1, NONE, dtype=np.int64)
    row[:width] = start + indel * np.arange(width)
    best = Extension(start, 0, 0)
    for i in range(1, n + 1):
        low, high = max(0, i - band), min(m, i + band)
        if low > high:
            break
        new = np.full(high - low + 1, NONE, dtype=np.int64)
        new = np.maximum(new, row[low : high + 1] + indel)
        j = np.arange(max(low, 1), high + 1)
        new[j - low] = np.maximum(new[j - low], row[j - 1] + np.where(y[j - 1] == x[i - 1], 1, mismatch))
        fall = -indel * np.arange(len(new))
        new = np.maximum.accumulate(new + fall) - fall
        row[low : high + 1] = new
        if low:
            row[low - 1] = NONE
        k = int(new.argmax())
        if new[k] > best.score:
            best = Extension(int(new[k]), i, int(at[low + k]))
    return best


def extension_column(a: Column, b: Column, band: int = 100) -> Column:
    """struct<score, first_end, second_end> of :func:`extension` in a band, null if either is null."""

    @F.pandas_udf("struct<score:int,first_end:int,second_end:int>")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if p is None or q is None else extension(p, q, band=band) for p, q in zip(x, y, strict=True)]
        return pd.DataFrame(rows, columns=["score", "first_end", "second_end"]).astype("Int32")

    ship()
    return run(a, b)
