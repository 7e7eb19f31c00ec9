"""Texts that were cut off: near-copies that go on where a text ends, and closing words that don't close anything.

Two ways of knowing. Near-copies are found by MinHash banding over word shingles of nested beginnings, so that a copy that was cut in
its middle shares bands with the whole text; they are aligned at the end of the shorter one and verified by the exact share
of its shingles. Every text's closing words are also scored against the whole collection: how often the word that closes a line,
after the word before it and in that kind of line, ends a line, and how often it goes on.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.ordered import scan
from seqloom.records import beside, cut, few, merge, ship

#: Words of a shingle, and least share of a text's shingles that a near-copy holds.
SHINGLE, SIMILAR = 5, 0.8
#: Words before the last one by which two texts are aligned, as many of them as both have, and neighbouring places of which the one
#: with the smallest hash of its last ``SHINGLE`` words is taken.
BEFORE, PLACES = 8, 8
#: Bands and rows of the signature of a beginning: beginnings of similarity 0.8 share a band with probability 0.97, of 0.9 with 0.999.
BANDS, ROWS = 5, 3
#: Bucket members that are compared with a text at first, and how many times as many in every further round; rounds go on, for texts
#: that these don't show to be cut, until all members have been compared.
AT_FIRST, TIMES = 4, 8

#: A last word closes a line, or is whole, if at least this share of its known occurrences did, or were.
SHARE = 0.1
#: Occurrences from which a pair of words, or a word, is known; else the word, or its last character, is asked.
KNOWN = 3
#: A line's shape closes texts if it occurs so often, and in this share of its occurrences last, but for other such lines.
CLOSING, CLOSES = 5, 0.9
#: Lines of a kind must end with a line end if so many texts end with that kind, this share of them with a line end.
KIND, KIND_ENDS = 20, 0.8

#: Characters handled at once by a task; words it knows, and counted contexts it holds before it gives them out.
CHARS, WORDS, HOLD = 1 << 21, 1 << 21, 1 << 22

#: What ends a sentence, what may stand behind it, marks some tools put behind a cut, dots apart and entities cut short.
ENDS = ".?!。？！"
CLOSERS = "\"')]”’»)*_`"
MARKS = re.compile(r"\s*(\[(more|truncated|cut|continued|snip|\.\.\.|…)\]|\((more|truncated|continued)\)|<(snip|cut|truncated)>)\s*$")
PIECES = re.compile(r"(\s+(\.\.\.|…)|\s*&#?[a-z0-9]{0,7})$")
TAGS = re.compile(r"(\s*</?[a-z][^<>]{0,40}>)+\s*$")
ELLIPSIS = ("...", "…")

_BLANKS = re.compile(r"[^\S\n]{2,}|[^\S\n ]")
_INVISIBLE = re.compile("[​-‏⁠﻿­]")
_BROKEN = re.compile("[^\\S\n]*�[^\\S\n�]*(?=�*(\n|$))")
_DIGITS = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[acgtn]{15,}")
#: Where a sentence may end without a blank after it.
_WIDE = re.compile("(?<=[。！？])(?=[^\\s])|(?<=[.!?])(?=[぀-ヿ一-鿿])")
_LEAD = re.compile(r"([^\w\s]{1,3})( ?)")


def canonical(text: str) -> tuple[str, bool]:
    """A text without the differences that retelling makes (case, blanks, entities, wrapping tags), and whether its content ended with a line end."""
    t = html.unescape(html.unescape(text)) if "&" in text else text
    if "\r" in t:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
    if t.isascii():
        t = _BLANKS.sub(" ", t).lower()
    else:
        t = unicodedata.normalize("NFC", _BLANKS.sub(" ", _INVISIBLE.sub("", t))).casefold()
    last = t.rstrip()[-1:]
    if last == ">":
        t = TAGS.sub(lambda m: "\n" if m.group(0).startswith("\n") else "", t)
        last = t.rstrip()[-1:]
    if last and last in "])>" and (marked := MARKS.search(t)):
        t = t[: marked.start()]
    body = t.rstrip()
    ended = "\n" in t[len(body) :]
    bare = body.rstrip("�")  # a letter cut in its middle
    if bare.endswith('"') and bare[bare.rfind("\n") + 1 :].count('"') % 2:
        bare = bare[:-1]
    bare = bare.rstrip()
    if bare.endswith(ELLIPSIS) or "&" in bare[-9:]:
        bare = PIECES.sub("", bare).rstrip()
    return bare, ended


def shape(word: str) -> str:
    """Digits as 0, long runs of bases as one word."""
    return _DIGITS.sub("0", "Δ" if _LETTERS.fullmatch(word) else word)


def apart(body: str) -> str:
    """Sentences apart that follow each other without a blank, and no remains of broken letters at line ends."""
    if body.isascii():
        return body
    return _BROKEN.sub("", _WIDE.sub(" ", body))


def lead(word: str) -> tuple[str, bool]:
    """The punctuation a line's first word begins with, none for opening quotes and brackets, and whether it is all of the word."""
    m = _LEAD.match(word)
    mark = m.group(1) if m and m.group(1)[0] not in "¿¡\"'(«“‘" else ""
    return mark, mark == word


# ---- pass 1: canonical texts


def canonical_texts(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """Rows (id, source, same, body, ended): ``same`` is a 128-bit fingerprint of the canonical text and its line end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            same, bodies, ends = [], [], []
            for t in b.column(2).to_pylist():
                body, ended = canonical(t)
                same.append(xxhash.xxh3_128_digest(body.encode("utf-8", "replace") + (b"\n" if ended else b"")))
                bodies.append(body)
                ends.append(ended)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.binary()), pa.array(bodies, pa.string()), pa.array(ends, pa.bool_())], names=["id", "source", "same", "body", "ended"])

    data = df.select(F.col(key).cast("long").alias("id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")).where("text IS NOT NULL")
    return data.mapInArrow(run, "id long, source string, same binary, body string, ended boolean")


# ---- pass 2: one pass over the different texts, all of their words as numbers


class Words(dict):
    """Word to number, given out as words come up; beside it each word's hash, shape, and what it makes of a line it begins.

    Numbers 0 and 1 are no word and a line end, 2 stands for the beginning of a line.
    """

    def __init__(self) -> None:
        super().__init__({"": 0, "\n": 1})
        self.shapes: dict[str, int] = {"": 0, "\n": 1, "^": 2}
        self.kinds: dict[str, int] = {"": 0, "```": 1, "code": 2, "under>": 3, ">": 4}
        self.n = 3
        self._grow(1 << 12)
        self.shape[:3] = range(3)

    def _grow(self, size: int) -> None:
        old = getattr(self, "hash", np.zeros(0, dtype=np.uint64))
        more = lambda a, kind: np.concatenate([a, np.zeros(size - len(a), dtype=kind)])
        self.hash = more(old, np.uint64)
        self.shape, self.kind, self.kind_before = (more(getattr(self, n, np.zeros(0, dtype=np.int64)), np.int64) for n in ("shape", "kind", "kind_before"))

    def __missing__(self, word: str) -> int:
        import xxhash

        i = self.n
        if i == len(self.hash):
            self._grow(2 * i)
        self.n += 1
        self.hash[i] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        self.shape[i] = self.shapes.setdefault(shape(word), len(self.shapes))
        mark, whole = lead(word)
        mark = "```" if word.startswith("```") else mark
        # a mark that is a word of its own stands before a blank, if another word follows
        self.kind[i] = self.kinds.setdefault(mark, len(self.kinds))
        self.kind_before[i] = self.kinds.setdefault(mark + " ", len(self.kinds)) if whole and mark and mark != "```" else self.kind[i]
        self[word] = i
        return i


class Lines:
    """The words of some texts as arrays, and the lines they make."""

    def __init__(self, bodies: list[str], words: Words):
        tokens: list[str] = []
        sizes = []
        for body in bodies:
            t = apart(body).replace("\n", " \n ").split(" ")
            sizes.append(len(t))
            tokens += t
        ids = np.fromiter(map(words.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        doc = np.repeat(np.arange(len(bodies)), sizes)
        line = np.cumsum(ids == 1) + doc
        kept = ids > 1
        #: number, text and line of every word
        self.ids, self.doc, line = ids[kept], doc[kept], line[kept]
        n = len(self.ids)
        self.first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if n else np.zeros(0, dtype=np.int64)
        self.stop = np.r_[self.first[1:], n] if n else self.first
        #: of every line with content: its text, whether the line before has content too, its kind
        self.of = self.doc[self.first]
        m = len(self.first)
        begins = np.r_[True, self.of[1:] != self.of[:-1]] if m else np.zeros(0, dtype=bool)
        self.last = np.r_[begins[1:], True] if m else begins
        at = line[self.first]
        fresh = begins | (np.r_[2, np.diff(at)] > 1) if m else begins
        start = self.ids[self.first]
        single = self.stop - self.first == 1
        kind = np.where(single, words.kind[start], words.kind_before[start])
        fence = kind == 1
        opened = np.cumsum(fence)
        base = (opened - fence)[np.flatnonzero(begins)][np.cumsum(begins) - 1] if m else opened
        code = ~fence & ((opened - base) % 2 == 1)
        kind = np.where(code, 2, kind)
        #: texts that end in an open fence
        self.open = np.zeros(len(bodies), dtype=bool)
        self.open[self.of[self.last]] = ((opened - base) % 2 == 1)[self.last]
        # single words under a line that begins with >, down to a blank line
        could = single & (kind == 0) & ~fresh
        root = np.maximum.accumulate(np.where(could, 0, np.arange(m)))
        self.kind = np.where(could & (kind[root] == 4), 3, kind)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, of the words' hashes."""
    out = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
    for i in range(k if len(out) else 0):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return out


def _levels(most: int) -> list[int]:
    """Lengths of the nested beginnings, in words: 5, 10, 20 and so on."""
    out = [SHINGLE]
    while out[-1] * 2 <= most:
        out.append(out[-1] * 2)
    return out


def _signatures(h: np.ndarray, sizes: np.ndarray, times: np.ndarray, plus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of the nested beginnings of texts, and their number for each text: as many levels as fit before its last word.

    Levels share their minima: a level's is that of the level before and of the shingles between.
    """
    runs = _runs(h, SHINGLE)
    begin = np.cumsum(sizes) - sizes
    levels = _levels(int(sizes.max()) - 1 if len(sizes) else 0)
    fits = np.searchsorted(levels, sizes - 1, side="right")
    keys = np.zeros((int(fits.sum()), BANDS), dtype=np.uint64)
    # stretches of shingles that a level adds: from the level before - 4 to this one - 4
    text = np.repeat(np.arange(len(sizes)), fits)
    level = np.arange(len(text)) - np.repeat(np.cumsum(fits) - fits, fits)
    if not len(text):
        return keys, fits
    size = np.array(levels)[level]
    low = begin[text] + np.where(level > 0, size // 2 - SHINGLE + 1, 0)
    high = begin[text] + size - SHINGLE + 1
    # flat pairs of borders; what lies between two stretches is worked out and left out
    borders = np.stack([low, high], 1).ravel()
    padded = np.append(runs, np.uint64(0))
    for b in range(BANDS):
        key = np.full(len(text), b, dtype=np.uint64)
        for r in range(ROWS):
            i = b * ROWS + r
            least = np.minimum.reduceat(padded * times[i] + plus[i], borders)[::2]
            for step in range(1, len(levels)):
                now = np.flatnonzero(level == step)
                least[now] = np.minimum(least[now], least[now - 1])
            key = _mixed((key ^ least) * np.uint64(0xD6E8FEB86659FD93))
        keys[:, b] = _mixed(key + level.astype(np.uint64))
    return keys, fits


SURVEY = "tag string, uid long, kind string, prev string, word string, mid long, eol long, fin long, keys array<long>, lines array<long>, ended boolean, open boolean"
_FIELDS = [("tag", pa.string()), ("uid", pa.int64()), ("kind", pa.string()), ("prev", pa.string()), ("word", pa.string()), ("mid", pa.int64()), ("eol", pa.int64()), ("fin", pa.int64()), ("keys", pa.list_(pa.int64())), ("lines", pa.list_(pa.int64())), ("ended", pa.bool_()), ("open", pa.bool_())]


def _batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[name] if name in columns else pa.nulls(n, kind) for name, kind in _FIELDS], schema=pa.schema(_FIELDS))


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat.view(np.int64)))


def survey(texts: DataFrame) -> DataFrame:
    """All that is counted of the different texts, in one pass: rows of three tags.

    ``text``: a text's last line (kind, prev, word: its kind and the shapes of its last two words), the hashes of its lines' shapes from the
    last to the first, its band keys, whether it ended with a line end and in an open fence. ``word``: how often a word after
    another, in a kind of line, is followed by a word (mid), ends a line that is not the text's last (eol), or ends the text (fin).
    ``line``: how often (mid) the line shape of hash ``uid`` occurs. Counts are combined within a task as far as it can hold them.
    """
    rng = np.random.Generator(np.random.PCG64(11))
    times = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        shapes: list[tuple[np.ndarray, np.ndarray]] = []

        def combined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
            return keys[first], np.add.reduceat(counts, first) if len(first) else counts

        def given() -> Iterator[pa.RecordBatch]:
            if held:
                keys, counts = combined(held)
                where = keys >> np.uint64(2)
                first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(where) else np.zeros(0, dtype=np.int64)
                role = (keys & np.uint64(3)).astype(np.int64)
                each = [np.add.reduceat(np.where(role == r, counts, 0), first) if len(first) else counts for r in range(3)]
                where = where[first].astype(np.int64)
                kinds, names = pa.array(list(words.kinds), pa.string()), pa.array(list(words.shapes), pa.string())
                for i in range(0, len(where), 1 << 16):
                    w = where[i : i + (1 << 16)]
                    yield _batch(len(w), tag=pa.array(["word"] * len(w)), kind=kinds.take(pa.array(w >> 46)), prev=names.take(pa.array((w >> 23) & 0x7FFFFF)), word=names.take(pa.array(w & 0x7FFFFF)), **{n: pa.array(e[i : i + (1 << 16)]) for n, e in zip(("mid", "eol", "fin"), each, strict=True)})
            if shapes:
                keys, counts = combined(shapes)
                for i in range(0, len(keys), 1 << 16):
                    k = keys[i : i + (1 << 16)]
                    yield _batch(len(k), tag=pa.array(["line"] * len(k)), uid=pa.array(k.view(np.int64)), mid=pa.array(counts[i : i + (1 << 16)]))
            held.clear()
            shapes.clear()

        def some(uids: list[int], bodies: list[str], ended: list[bool]) -> pa.RecordBatch:
            x = Lines(bodies, words)
            sid = words.shape[x.ids]
            prev = np.r_[2, sid[:-1]] if len(sid) else sid
            prev[x.first] = 2
            role = np.zeros(len(sid), dtype=np.int64)
            role[x.stop - 1] = np.where(x.last, 2, 1)
            kind = np.repeat(x.kind, x.stop - x.first)
            # a text of more than 8 million different words, which alone fills the numbers, has the rest counted as no word
            fit = lambda a: np.where(a < 1 << 23, a, 0)
            keys = ((np.minimum(kind, 0xFFFF) << 48) | (fit(prev) << 25) | (fit(sid) << 2) | role).view(np.uint64)
            held.append(np.unique(keys, return_counts=True))
            # a line's hash: its words' hashes, each times a power that tells its place
            place = np.arange(len(sid)) - np.repeat(x.first, x.stop - x.first)
            power = np.cumprod(np.full(int(place.max(initial=0)) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
            named = hashes_of(sid)
            hashes = _mixed(np.add.reduceat(named * power[place], x.first)) if len(sid) else named
            shapes.append(np.unique(hashes, return_counts=True))
            lines = np.bincount(x.of, minlength=len(bodies))
            back = np.repeat(np.cumsum(lines), lines) - 1 - (np.arange(len(hashes)) - np.repeat(np.cumsum(lines) - lines, lines))
            sig, fits = _signatures(words.hash[x.ids], np.bincount(x.doc, minlength=len(bodies)), times, plus)
            end = np.flatnonzero(x.last)
            row = np.full(len(bodies), -1)
            row[x.of[end]] = end
            has = row >= 0
            at = np.r_[x.stop, 1][row] - 1
            kinds, names = pa.array(list(words.kinds), pa.string()), pa.array(list(words.shapes), pa.string())
            of = lambda a, v: a.take(pa.array(np.where(has, v, 0), mask=~has))
            return _batch(len(bodies), tag=pa.array(["text"] * len(bodies)), uid=pa.array(uids, pa.int64()), kind=of(kinds, np.r_[x.kind, 0][row]), prev=of(names, np.r_[prev, 0][at]), word=of(names, np.r_[sid, 0][at]), keys=_lists(sig.ravel(), fits * BANDS), lines=_lists(hashes[back], lines), ended=pa.array(ended, pa.bool_()), open=pa.array(x.open))

        known = np.zeros(0, dtype=np.uint64)

        def hashes_of(sid: np.ndarray) -> np.ndarray:
            """Hashes of shapes: those of the words where they are the same in both."""
            nonlocal known
            if len(known) < len(words.shapes):
                import xxhash

                new = list(words.shapes)[len(known) :]
                known = np.concatenate([known, np.fromiter((xxhash.xxh3_64_intdigest(s.encode("utf-8", "replace")) for s in new), dtype=np.uint64, count=len(new))])
            return known[sid]

        def full() -> Iterator[pa.RecordBatch]:
            nonlocal words, known
            for parts in (held, shapes):
                if len(parts) > 8:
                    parts[:] = [combined(parts)]
            if words.n > WORDS or len(words.kinds) > 1 << 14 or sum(len(k) for k, _ in held + shapes) > HOLD:
                yield from given()
                words, known = Words(), np.zeros(0, dtype=np.uint64)

        for b in batches:
            uids, bodies, ended, size = [], [], [], 0
            for u, body, e in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                uids.append(u)
                bodies.append(body)
                ended.append(e)
                size += len(body)
                if size >= CHARS:
                    yield some(uids, bodies, ended)
                    uids, bodies, ended, size = [], [], [], 0
                    yield from full()
            if uids:
                yield some(uids, bodies, ended)
                yield from full()
        yield from given()

    return texts.select("uid", "body", "ended").mapInArrow(run, SURVEY)


# ---- closing words


def closing_depths(found: DataFrame) -> DataFrame:
    """Rows (uid, depth): how many lines at the end of a text are closing lines (signatures and the like), for texts that have any.

    A line's shape closes texts if at least ``CLOSES`` of its occurrences, of ``CLOSING`` or more, are the last line of a text but for other
    closing lines. Found from the end: lines that are last, then those before them, as long as any text moves on.
    """
    shapes = cut(found.where("tag = 'line'").groupBy(F.col("uid").alias("hash")).agg(F.sum("mid").alias("n")).where(F.col("n") >= CLOSING))
    # texts wait at the first line from their end that isn't known to close; only shapes that may turn out to close are waited at
    step = lambda at: [F.col("uid"), F.col("lines"), at.alias("at"), F.get("lines", at).alias("hash")]
    fresh = cut(beside(found.where("tag = 'text' AND size(lines) > 0").select(*step(F.lit(0))), shapes, ["hash"]))
    active, tails, passed = fresh, None, []
    while True:
        more = fresh.groupBy("hash", "n").agg(F.count(F.lit(1)).alias("tail"))
        tails = cut(more if tails is None else tails.unionByName(more).groupBy("hash", "n").agg(F.sum("tail").alias("tail")))
        closing = tails.where(F.col("tail") >= CLOSES * F.col("n")).select("hash")
        moved = cut(beside(active, closing, ["hash"]).select(*step(F.col("at") + 1)))
        if moved.isEmpty():
            break
        passed.append(moved.select("uid", F.col("at").alias("depth")))
        fresh = cut(beside(moved, shapes, ["hash"]))
        active = cut(beside(active, closing, ["hash"], "left_anti").unionByName(fresh))
    if not passed:
        return found.where("false").select("uid", F.lit(0).alias("depth"))
    out = passed[0]
    for p in passed[1:]:
        out = out.unionByName(p)
    return out.groupBy("uid").agg(F.max("depth").alias("depth"))


def _tail(body: str, depth: int) -> str:
    """The last lines of a text that are looked at; all of it where what stands before them decides on their kind."""
    if "```" in body or ">" in body or "�" in body:
        return body
    return "\n".join([x for x in body.split("\n") if x.strip()][-depth - 1 :])


def _deeper(texts: DataFrame) -> DataFrame:
    """Rows (uid, i, kind, prev, word) of the lines 1 to depth from the end of texts (uid, body, depth)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            words = words if words.n < WORDS else Words()
            x = Lines([_tail(body, n) for body, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], words)
            end = np.zeros(b.num_rows, dtype=np.int64)
            end[x.of[x.last]] = np.flatnonzero(x.last)
            i = end[x.of] - np.arange(len(x.of))
            take = np.flatnonzero((i > 0) & (i <= b.column(2).to_numpy()[x.of]))
            at = x.stop[take] - 1
            shapes, kinds = pa.array(list(words.shapes), pa.string()), pa.array(list(words.kinds), pa.string())
            before = np.where(at > x.first[take], words.shape[x.ids[at - 1]], 2)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(x.of[take])), pa.array(i[take].astype(np.int32)), kinds.take(pa.array(x.kind[take])), shapes.take(pa.array(before)), shapes.take(pa.array(words.shape[x.ids[at]]))], names=["uid", "i", "kind", "prev", "word"])

    return texts.select("uid", "body", F.col("depth").cast("int")).mapInArrow(run, "uid long, i int, kind string, prev string, word string")


def _glyph(word: Column) -> Column:
    """The kind of a word's last character: a for letters, 0 for digits, else the character."""
    last = F.substring(word, -1, 1)
    return F.when(last.rlike(r"^\p{L}$"), "a").when(last == "0", "0").otherwise(last)


def _without_dots(word: Column) -> Column:
    n = F.length(word)
    return F.when(F.endswith(word, F.lit("...")) & (n > 3), F.left(word, n - 3)).when(F.endswith(word, F.lit("…")) & (n > 1), F.left(word, n - 1)).otherwise(word)


def context_scores(words: DataFrame, contexts: DataFrame) -> DataFrame:
    """Every context (cid, kind, prev, word, bare) with what ``words`` knows of it, 0 where it knows nothing.

    mid, eol, fin: of the word after the one before it; b_: of the word without dots; longer: occurrences of words that go on from
    it. w_: the same of the word alone; g_: of all words with such a last character. Facts and questions meet by a hash of what is
    asked; the beginnings of words are made only as long as those that are asked for, so no length is left out.
    """
    counts = ["mid", "eol", "fin"]
    key = lambda tag, *by: F.xxhash64(F.lit(tag), *by)
    kind, prev, word, bare = (F.col(c) for c in ("kind", "prev", "word", "bare"))
    single = cut(words.groupBy("kind", "word").agg(*[F.sum(c).alias(c) for c in counts]))
    fact = lambda k: [k.alias("key"), *counts]
    sizes = lambda *by: contexts.where("bare <> ''").groupBy(*by).agg(F.collect_set(F.length("bare")).alias("sizes"))
    pair_sizes, kind_sizes = sizes("kind", "prev"), few(cut(sizes("kind")))
    start = lambda x: x.withColumn("size", F.explode(F.filter("sizes", lambda s: s < F.length("word")))).withColumn("start", F.expr("left(word, size)")).withColumn("fin", F.col("mid") + F.col("eol") + F.col("fin")).withColumns({"mid": F.lit(0).cast("long"), "eol": F.lit(0).cast("long")})
    facts = (
        words.select(*fact(key("pair", kind, prev, word)))
        .unionByName(single.select(*fact(key("word", kind, word))))
        .unionByName(start(words.join(merge(pair_sizes), ["kind", "prev"])).select(*fact(key("pair begins", kind, prev, F.col("start")))))
        .unionByName(start(single.join(kind_sizes, "kind")).select(*fact(key("begins", kind, F.col("start")))))
        .groupBy("key").agg(*[F.sum(c).alias(c) for c in counts])
    )
    questions = F.array(key("pair", kind, prev, word), key("pair", kind, prev, bare), key("pair begins", kind, prev, bare), key("word", kind, word), key("word", kind, bare), key("begins", kind, bare))
    asked = contexts.select("cid", F.posexplode(questions).alias("q", "key"))
    of = lambda q, c, name: F.coalesce(F.max(F.when(F.col("q") == q, F.col(c))), F.lit(0)).alias(name)
    known = asked.join(merge(facts), "key").groupBy("cid").agg(*[of(0, c, c) for c in counts], of(1, "mid", "b_mid"), of(1, "eol", "b_eol"), of(2, "fin", "longer"), *[of(3, c, "w_" + c) for c in counts], of(4, "mid", "wb_mid"), of(4, "eol", "wb_eol"), of(5, "fin", "w_longer"))
    glyphs = few(cut(single.groupBy("kind", _glyph(F.col("word")).alias("glyph")).agg(*[F.sum(c).alias("g_" + c) for c in counts])))
    out = contexts.join(merge(known), "cid", "left").withColumn("glyph", _glyph(bare)).join(glyphs, ["kind", "glyph"], "left")
    return out.na.fill(0)


def _bad(last: bool) -> Column:
    """Whether a context's word doesn't close a line, the text's own occurrence left out; ``last``: that was the text's last line."""
    of = lambda c: F.col(c)
    less = lambda c, own: F.greatest(of(c) - own, F.lit(0))
    dotted = of("word") != of("bare")
    if_dotted = lambda x: F.when(dotted, x).otherwise(0)
    # occurrences of the last word as a whole word; one with dots also stands for the word without them
    fin, w_fin = less("fin", int(last)), less("w_fin", int(last))
    eol, w_eol = less("eol", int(not last)) + if_dotted(of("b_eol")), less("w_eol", int(not last)) + if_dotted(of("wb_eol"))
    mid, w_mid = of("mid") + if_dotted(of("b_mid")), of("w_mid") + if_dotted(of("wb_mid"))
    ended = F.rtrim(F.regexp_replace("word", f"[{re.escape(CLOSERS)}]+$", ""))
    sentence = ~dotted & F.substring(ended, -1, 1).isin(*ENDS) & (F.length(ended) > 0)
    # a word with dots behind it goes on from the word without them, but is no longer word by itself
    longer = of("longer") - if_dotted(of("mid") + of("eol") + of("fin"))
    w_longer = of("w_longer") - if_dotted(of("w_mid") + of("w_eol") + of("w_fin"))
    known, w_known = fin + eol + mid + longer, w_fin + w_eol + w_mid + w_longer
    whole = F.when(known >= KNOWN, longer <= known * (1 - SHARE)).when(w_known >= KNOWN, w_longer <= w_known * (1 - SHARE)).otherwise(True)
    g_end = of("g_fin") + of("g_eol")
    closes = F.when(known >= KNOWN, fin + eol >= known * SHARE).when(w_known >= KNOWN, w_fin + w_eol >= w_known * SHARE).otherwise(g_end >= (g_end + of("g_mid")) * SHARE)
    return F.when(sentence, ~whole).otherwise(~closes)


def cut_by_words(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Ids (uid) of the texts whose closing words show that they were cut: the last line, one of the closing lines before it or the first
    line before those doesn't close; or it lacks the line end that its kind has; or a fence is open."""
    ends = found.where("tag = 'text' AND word IS NOT NULL").select("uid", F.lit(0).alias("i"), "kind", "prev", "word")
    depths = cut(closing_depths(found))
    judged = cut(ends.unionByName(_deeper(texts.join(merge(depths), "uid").select("uid", "body", "depth"))))
    contexts = judged.groupBy("kind", "prev", "word").agg(F.count(F.lit(1)).alias("n")).drop("n").withColumn("bare", _without_dots(F.col("word")))
    contexts = cut(contexts.withColumn("cid", F.monotonically_increasing_id()))
    words = cut(found.where("tag = 'word'").groupBy("kind", "prev", "word").agg(*[F.sum(c).alias(c) for c in ("mid", "eol", "fin")]))
    scored = cut(context_scores(words, contexts).select("kind", "prev", "word", _bad(True).alias("bad_last"), _bad(False).alias("bad")).where("bad_last OR bad"))
    bad = beside(judged, scored, ["kind", "prev", "word"]).where(F.when(F.col("i") == 0, F.col("bad_last")).otherwise(F.col("bad"))).select("uid")
    last = found.where("tag = 'text' AND word IS NOT NULL").select("uid", "kind", "ended", "open")
    kinds = last.where("kind <> ''").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("ended").alias("e")).where((F.col("n") >= KIND) & (F.col("e") >= KIND_ENDS * F.col("n"))).select("kind")
    lacks = beside(last.where("NOT ended AND kind <> ''"), cut(kinds), ["kind"], "left_semi").select("uid")
    return bad.unionByName(lacks).unionByName(last.where("open").select("uid")).distinct()


# ---- near-copies


def _hashes(words: list[str], seen: dict[str, int]) -> np.ndarray:
    import xxhash

    if len(seen) > WORDS:
        seen.clear()
    for w in words:
        if w not in seen:
            seen[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
    return np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))


def _places(h: np.ndarray, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places in a text, in words from its start, with the hash of the ``SHINGLE`` words before each.

    Of every ``PLACES`` places that follow each other the one with the smallest hash, and of the first few as well, so that two texts with the
    same words around a place choose the same. ``last``: only the one before the text's last word.
    """
    r = _runs(h[:-1], SHINGLE)
    if not len(r):
        pick = np.zeros(0, dtype=np.int64)
    elif last:
        j = max(0, len(r) - PLACES)
        pick = np.array([j + int(r[j:].argmin())])
    else:
        first = r[:PLACES]
        pick = np.flatnonzero(np.r_[True, first[1:] < np.minimum.accumulate(first)[:-1]])
        if len(r) >= PLACES:
            pick = np.union1d(pick, np.arange(len(r) - PLACES + 1) + np.lib.stride_tricks.sliding_window_view(r, PLACES).argmin(axis=1))
    return pick + SHINGLE, r[pick]


def _strings(members: DataFrame) -> DataFrame:
    """Rows (k, s, uid, ask) of texts (uid, body, live): what follows a place, keyed by a band of the beginning and the words before the place.

    ``ask``: all that follows the place at a text's end, under the bands of its longest beginning; else the next words of
    any text, under each band at the places an alike text may end at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            out: list[tuple[np.ndarray, list[str], np.ndarray, bool]] = []
            held = 0
            for uid, body, live in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = body.split()
                h = _hashes(words, seen)
                at, key = _places(h)
                follow = [" ".join(words[e : e + PLACES + 1]) for e in at]
                for x in live:
                    band, size = np.uint64(x["key"] & 0xFFFFFFFFFFFFFFFF), SHINGLE << x["level"]
                    near = np.flatnonzero((at >= size * SIMILAR - PLACES) & (at <= 2 * size / SIMILAR))
                    out.append((_mixed(key[near] ^ band), [follow[i] for i in near], np.full(len(near), uid), False))
                    if x["ask"]:
                        e, k = _places(h, last=True)
                        out.append((_mixed(k ^ band), [" ".join(words[e[0] :])], np.full(1, uid), True))
                    held += len(near)
                if held > 1 << 16:
                    yield table(out)
                    out, held = [], 0
            if out:
                yield table(out)

    def table(out: list) -> pa.RecordBatch:
        k = np.concatenate([o[0] for o in out]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array([s for o in out for s in o[1]], pa.string()), pa.array(np.concatenate([o[2] for o in out]).astype(np.int64)), pa.array(np.concatenate([np.full(len(o[1]), o[3]) for o in out]), pa.bool_())], names=["k", "s", "uid", "ask"])

    return members.select("uid", "body", "live").mapInArrow(run, "k long, s string, uid long, ask boolean")


def goes_on(a: str, b: str) -> bool:
    """True if b, aligned to the end of a, goes on inside the word, sentence, line or block in which a ends."""
    wa = a.split()
    if len(wa) <= SHINGLE:
        return False
    before, last = wa[-BEFORE - 1 : -1], wa[-1]
    spans = [(m.start(), m.end()) for m in re.finditer(r"\S+", b)]
    wb = [b[i:j] for i, j in spans]
    # the words at the end of a may have been retold in part: the longest stretch of them that b has
    for k in range(len(before), SHINGLE - 1, -1):
        at = [j for j in range(len(wb) - k) if wb[j] == before[-k] and wb[j : j + k] == before[-k:] and wb[j + k].startswith(last)]
        if at:
            break
    else:
        return False
    e = min(at, key=lambda j: abs(j + k + 1 - len(wa))) + k
    if wb[e] != last:
        return True
    if e + 1 == len(wb):
        return False
    between = b[spans[e][1] : spans[e + 1][0]]
    if "\n" in between:
        # a line of a list, table or quotation goes on with another of its kind
        mark = lead(a[a.rfind("\n") + 1 :].lstrip())[0]
        return "\n\n" not in between and bool(mark) and lead(b[spans[e + 1][0] :])[0] == mark
    return last.rstrip(CLOSERS)[-1:] not in tuple(ENDS)


def holds(a: str, b: str, seen: dict[str, int]) -> bool:
    """True if at least ``SIMILAR`` of the different shingles of a, without its last word, are in b."""
    x = np.unique(_runs(_hashes(a.split()[:-1], seen), SHINGLE))
    y = np.unique(_runs(_hashes(b.split(), seen), SHINGLE))
    return len(x) > 0 and len(np.intersect1d(x, y, assume_unique=True)) >= SIMILAR * len(x)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Ids (uid) of the texts a of the pairs (a, b) in which b is a near-copy that goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            found = [uid for uid, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) if goes_on(a, b) and holds(a, b, seen)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["uid"])

    bodies = texts.select("uid", "body")
    both = pairs.join(merge(bodies.select(F.col("uid").alias("a"), F.col("body").alias("a_body"))), "a").join(merge(bodies.select(F.col("uid").alias("b"), F.col("body").alias("b_body"))), "b")
    return both.select("a", "a_body", "b_body").mapInArrow(run, "uid long").distinct()


def cut_by_copy(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Ids (uid) of the texts that a near-copy shows to be cut: one that holds ``SIMILAR`` of their shingles and goes on where they end.

    A text asks under the bands of its longest nested beginning (5, 10, 20 and so on words, before its last), every text answers under
    those of all of its own, so a text and its whole original share a bucket however much was cut off. Within a bucket they meet by
    the words before a place near the end, and by order: strings that begin as the text's end are a stretch of the sorted
    ones. So no pairs of a bucket are made but those that go on at that place. All of these are compared, those with equal strings
    too, as one may be a near-copy where another isn't: ``AT_FIRST`` of each at first, more and more of the rest for the texts these
    don't show to be cut.
    """
    rows = found.where("tag = 'text'").select("uid", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key"))
    rows = rows.select("uid", "key", F.floor(F.col("pos") / BANDS).cast("int").alias("level"), (F.col("pos") >= F.col("n") - BANDS).alias("ask"))
    live = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("ask").alias("asked")).where("n > 1 AND asked").select("key"))
    members = beside(rows, live, ["key"]).groupBy("uid").agg(F.collect_list(F.struct("key", "level", "ask")).alias("live"))
    strings = cut(_strings(texts.select("uid", "body").join(merge(members), "uid")))
    asking = cut(strings.where("ask").select("k", "s", "uid").distinct())
    ends = asking.select("k", "s").distinct()
    answers = strings.where("NOT ask").join(merge(ends.select("k").distinct()), "k", "left_semi").select("k", "s", F.col("uid").alias("b")).distinct()
    edge = lambda s, high: F.struct(s.alias("at"), F.lit(high).alias("high"))
    borders = ends.select("k", "s", F.inline(F.array(edge(F.col("s"), False), edge(F.concat("s", F.lit("\U0010ffff")), True))))
    line = answers.select("k", F.lit(None).cast("string").alias("s"), F.col("s").alias("at"), F.lit(False).alias("high"), F.lit(1).alias("w"), "b").unionByName(borders.withColumns({"w": F.lit(0), "b": F.lit(None).cast("long")}))
    # an answer comes before a border at the same string, so equal strings, which don't go on, lie outside
    ranked = cut(scan(line, ["k"], ["at", F.col("w").desc(), "high", "s", "b"], {"rank": F.col("w")}))
    stretch = ranked.where("w = 0").groupBy("k", "s").agg(F.max(F.when(~F.col("high"), F.col("rank"))).alias("low"), F.max(F.when(F.col("high"), F.col("rank"))).alias("up")).where("up > low")
    asked = cut(beside(asking, cut(stretch), ["k", "s"]))
    ranks = ranked.where("w = 1").select("k", "rank", "b")

    def compared(of: DataFrame, low: Column, up: Column) -> DataFrame:
        wanted = of.where(up > low).select(F.col("uid").alias("a"), "k", F.explode(F.sequence(low + 1, up)).alias("rank"))
        return _verified(wanted.join(merge(ranks), ["k", "rank"]).where("a <> b").select("a", "b").distinct(), texts)

    size, out = AT_FIRST, None
    while True:
        shown = cut(compared(asked, F.col("low"), F.least("up", F.col("low") + size)))
        out = shown if out is None else out.unionByName(shown)
        asked = asked.where(F.col("up") > F.col("low") + size)
        asked = cut(asked.join(merge(shown), "uid", "left_anti").withColumn("low", F.col("low") + size))
        if asked.isEmpty():
            return out
        size *= TIMES


def cut_copies(texts: DataFrame) -> DataFrame:
    """Ids (uid) of the different texts (uid, body) that a near-copy shows to be cut."""
    ship(texts.sparkSession)
    return cut_by_copy(cut(survey(texts.select("uid", "body", F.lit(False).alias("ended")))), texts)


def truncated(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """Rows (id, source, is_cut, by) for every row of ``df`` with a text: whether the text was cut off, and how that is known:
    ``copy`` (a near-copy goes on), ``words`` (its closing words don't close), null if it wasn't.

    Null texts have no row; empty and blank texts aren't cut. Texts that differ only in case, blanks, entities and wrapping tags
    are judged once, and each of their rows gets the verdict. Texts of fewer than six words have no shingle before their last
    word and are judged by their words alone. A null source is a source of its own. Repeated rows give repeated rows. An empty
    table gives none. Other columns are not read. The texts are written to the shared folder once, the different ones again.
    """
    ship(df.sparkSession)
    every = cut(canonical_texts(df, key, source, text))
    texts = cut(every.where("body <> ''").groupBy("same").agg(F.first("body").alias("body"), F.first("ended").alias("ended")).withColumn("uid", F.monotonically_increasing_id()))
    found = cut(survey(texts))
    by_words, by_copy = cut_by_words(found, texts), cut_by_copy(found, texts)
    known = by_words.select("uid", F.lit("words").alias("by")).unionByName(by_copy.select("uid", F.lit("copy").alias("by"))).groupBy("uid").agg(F.min("by").alias("by"))
    # `same` of a text told very often is a hot key: the verdicts, one row a cut text, are salted
    verdicts = cut(texts.select("uid", "same").join(merge(known), "uid").select("same", "by"))
    rows = every.select(F.col("id").alias("uid"), "source", "same")
    return beside(rows, verdicts, ["same"], "left").select(F.col("uid").alias("id"), "source", F.col("by").isNotNull().alias("is_cut"), "by")
