"""Token ids of whole texts by a public byte-level BPE vocabulary.

Two tiers: a minimal perfect hash over the vocabulary resolves every pre-token that is a whole entry of it; the others are merged
from their bytes with a heap of candidate pairs over a linked list. Pre-tokens already seen by a task are remembered.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.records import ship

#: Where the public vocabulary files lie unless told otherwise.
FOLDER = "/opt/tokenizers"
#: Fixed value: the pre-token pattern of the byte-level vocabularies, with white space as Unicode defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pre-tokens a task remembers; when there are more it starts anew, which changes no id.
REMEMBER = 1 << 18
#: Characters of the texts in one batch of results.
CHARS = 1 << 22


def load_ranks(path: str) -> list[tuple[bytes, int]]:
    """(token, id) of a vocabulary file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]


class PerfectHash:
    """A minimal perfect hash of a fixed set of byte strings: every key has a slot of its own among len(keys).

    Hash and displace: keys are put into buckets by one hash; bucket by bucket, largest first, the first displacement is kept
    that sends all of its keys to free slots. A bucket of one key takes a slot that is left, noted as a negative displacement.
    """

    def __init__(self, items: list[tuple[bytes, int]]):
        import xxhash

        self._hash = xxhash.xxh3_128_intdigest
        self.n = n = max(1, len(items))
        self.buckets = max(1, n // 3)
        groups: dict[int, list[tuple[int, int, bytes, int]]] = {}
        for key, value in items:
            b, x, y = self._parts(key)
            groups.setdefault(b, []).append((x, y, key, value))
        self.shift = [0] * self.buckets
        self.slots: list[tuple[bytes, int] | None] = [None] * n
        free = iter(range(n))
        for b in sorted(groups, key=lambda g: -len(groups[g])):
            mine, d = groups[b], 0
            if len(mine) == 1:
                p = next(i for i in free if self.slots[i] is None)
                self.shift[b], self.slots[p] = -1 - p, mine[0][2:]
                continue
            while True:
                places = {self._slot(d, x, y) for x, y, _, _ in mine}
                if len(places) == len(mine) and all(self.slots[p] is None for p in places):
                    break
                d += 1
            self.shift[b] = d
            for x, y, key, value in mine:
                self.slots[self._slot(d, x, y)] = (key, value)

    def _parts(self, key: bytes) -> tuple[int, int, int]:
        h = self._hash(key)
        return (h & 0xFFFFFFFF) % self.buckets, (h >> 32) & 0xFFFFFFFF, (h >> 64) & 0xFFFFFFFF

    def _slot(self, d: int, x: int, y: int) -> int:
        return -1 - d if d < 0 else (x + d * y + d * d) % self.n

    def get(self, key: bytes) -> int | None:
        """The value of a key; None for any other byte string."""
        b, x, y = self._parts(key)
        item = self.slots[self._slot(self.shift[b], x, y)]
        return item[1] if item is not None and item[0] == key else None


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token that isn't in the vocabulary: the pair of lowest rank, the leftmost of equals, is merged until none is left.

    Pieces are a linked list over their first bytes; a heap holds the pairs that can be merged. Time grows as n log n, so a
    pre-token of a million letters is no special case.
    """
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


#: Fixed value: the characters Unicode calls white space.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def splitters():
    """The pre-token split, and a faster one for texts without the few characters on which it differs: (split, fast split, odd characters).

    The standard library knows letters only as word characters without digits. Where that isn't the same as the classes of the
    pattern is found by asking both about every character.
    """
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    odd = set(regex.findall(r"\p{L}", every)) ^ set(re.findall(r"[^\W\d_]", every))
    odd |= set(regex.findall(r"\p{N}", every)) ^ set(re.findall(r"\d", every))
    fast = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w{WHITE}]|_)+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
    return regex.compile(PATTERN).findall, re.compile(fast).findall, frozenset(odd)


class Encoder(dict):
    """Pre-token to ids, filled as pre-tokens come up."""

    def __init__(self, items: list[tuple[bytes, int]]):
        super().__init__()
        self.vocabulary = PerfectHash(items)
        self.ranks = dict(items)
        self.split, self.fast, self.odd = splitters()

    def __missing__(self, piece: str) -> tuple[int, ...]:
        word = piece.encode("utf-8", "replace")
        whole = self.vocabulary.get(word)
        ids = (whole,) if whole is not None else tuple(merge_bytes(word, self.ranks))
        if len(self) >= REMEMBER:
            self.clear()
        if len(word) <= 256:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null and an empty one."""
        if not text:
            return []
        split = self.fast if self.odd.isdisjoint(text) else self.split
        return list(chain.from_iterable(map(self.__getitem__, split(text))))


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str, items: list[tuple[bytes, int]]) -> Encoder:
    """One encoder per Python worker, as building its hash takes a moment."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(items)
    return _ENCODERS[name]


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = FOLDER):
    """The vocabulary as a broadcast value: under 1 MB, read on the driver, so executors need no file."""
    path = os.path.join(folder, f"{name}.tiktoken")
    with open(path, "rb") as f:
        return path, spark.sparkContext.broadcast(f.read())


def _items(data: bytes) -> list[tuple[bytes, int]]:
    return [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in data.splitlines() if line.strip())]


def encode(df: DataFrame, text: str, name: str = "byte_bpe_50k", folder: str = FOLDER, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (keep..., ids) for every row of ``df``: the ids of the whole text, without special tokens.

    An empty list for a null and for an empty text; strings that look like special tokens are ordinary text. No shuffle, one pass,
    one row out for each row in, repeated rows included. Columns of ``keep`` are passed on as they are.
    """
    ship(df.sparkSession)
    path, data = vocabulary(df.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _ENCODERS.get(path) or encoder(path, _items(data.value))
        for b in batches:
            texts = b.column(b.num_columns - 1)
            first, size = 0, 0
            ids: list[list[int]] = []
            for i in range(b.num_rows):
                t = texts[i].as_py()
                ids.append(e.encode(t))
                size += len(t or "")
                if size >= CHARS or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(first, i + 1 - first) for c in range(b.num_columns - 1)), pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "ids"])
                    first, size, ids = i + 1, 0, []

    kinds = dict(df.dtypes)
    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "ids array<int>"]))
