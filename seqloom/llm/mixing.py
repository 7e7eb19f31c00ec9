"""Mixing sources to target weights: blocks of tokens, multinomial draws per output shard, a random order without repeats per pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.llm.spans import _mix
from seqloom.operators.ordered import scan
from seqloom.records import ship

#: Tokens of a block, and blocks of an output shard.
BLOCK, SLOTS = 2048, 1024
#: Where the total is small, blocks shrink so that it is about so many of them, but not below so many tokens.
BLOCKS, LEAST_BLOCK = 20_000, 16
#: Rows of the table of targets; it is held on the driver, so a larger one is refused.
MOST_SOURCES = 10_000


def source_of(source: Column) -> Column:
    """A source in lower case without blanks around it; null for null and for blanks only."""
    s = F.regexp_replace(F.lower(source), r"(?U)^[\s​﻿]+|[\s​﻿]+$", "")
    return F.when(s != "", s)


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n - 1 chosen by ``key``, at ``index``: a Feistel network whose values of n or more go round again."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & low
        for r in range(4):
            seed = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 1) & 0xFFFFFFFFFFFFFFFF)
            left, right = right, left ^ (_mix(right ^ seed) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


class Plan:
    """What is drawn, known from the sources' totals alone: a bounded number of figures on the driver."""

    def __init__(self, sources: list[dict], total: int, block: int, slots: int, seed: int):
        self.sources, self.total, self.slots, self.seed = sources, total, slots, seed
        weights = np.array([max(0.0, s["weight"]) for s in sources])
        self.weights = weights if not weights.sum() or abs(weights.sum() - 1) < 1e-9 else weights / weights.sum()
        # a block small enough that each source's target is many of them, so that whole blocks come close to it
        self.block = int(min(block, max(LEAST_BLOCK, total // BLOCKS)))
        self.blocks = [-(-int(s["tokens"]) // self.block) for s in sources]
        most = np.array([int(s["max_repeats"]) * int(s["tokens"]) for s in sources], dtype=float)
        self.targets = self._targets(most)
        #: tokens that a source's slots must deliver, and slots for that: its blocks are full but for the last of a pass
        mean = np.array([int(s["tokens"]) / max(n, 1) for s, n in zip(sources, self.blocks, strict=True)])
        want = np.where(mean > 0, np.rint(self.targets / np.maximum(mean, 1e-9)), 0).astype(np.int64)
        self.quota = np.minimum(want, np.array([int(s["max_repeats"]) * n for s, n in zip(sources, self.blocks, strict=True)], dtype=np.int64)) if sources else want
        self.drawn = int(self.quota.sum())
        self.shards = -(-self.drawn // slots)

    def _targets(self, most: np.ndarray) -> np.ndarray:
        """Tokens of each source in the mix: its weight of the total; what sources can't give, having no passes left, is dealt out to
        the others by their weights, until the mix is as large as the total or no source has anything left."""
        out, full = np.zeros(len(most)), np.zeros(len(most), dtype=bool)
        left = float(self.total) if self.weights.sum() > 0 else 0.0
        while left > 0:
            share = np.where(full, 0.0, self.weights)
            if not share.sum():
                break
            want = share / share.sum() * left if full.any() else share * left
            over = ~full & (want >= most) & (share > 0)
            if not over.any():
                return out + want
            out[over] = most[over]
            left -= most[over].sum()
            full |= over
        return out

    def counts(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """A source's slots in a shard, and in all shards before it.

        A multinomial draw without replacement from the quotas, so that over all shards every source gets its own. It is drawn by halves:
        how many of a stretch of shards fall into its first half is drawn from the stretch's own slots, down to the shard. So a
        shard needs a logarithmic number of draws, and no other shard's result.
        """
        low, high, have, before = 0, self.shards, self.quota.copy(), np.zeros_like(self.quota)
        while high - low > 1:
            middle = (low + high) // 2
            first = self._first_half(have, min(middle * self.slots, self.drawn) - low * self.slots, np.random.Generator(np.random.Philox(key=self.seed, counter=[0, 2, low, high])))
            if shard < middle:
                have, high = first, middle
            else:
                have, before, low = have - first, before + first, middle
        return have, before

    @staticmethod
    def _first_half(have: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
        total = int(have.sum())
        if total < 10**9:
            return rng.multivariate_hypergeometric(have, size, method="marginals")
        # beyond what the generator takes, the limit of the same law, with the rest put on the sources with most room
        part = size / total
        out = np.clip(np.rint(have * part + rng.standard_normal(len(have)) * np.sqrt(have * part * (1 - part))), 0, have).astype(np.int64)
        for i in np.argsort(-have):
            out[i] += np.clip(size - out.sum(), -out[i], have[i] - out[i])
        return out

    def order(self, shard: int, counts: np.ndarray) -> np.ndarray:
        return np.random.Generator(np.random.Philox(key=self.seed, counter=[0, 0, 1, shard])).permutation(np.repeat(np.arange(len(counts)), counts))


def plan(documents: DataFrame, targets: DataFrame, block: int = BLOCK, slots: int = SLOTS, seed: int = 7) -> Plan:
    """``documents``: rows (source, tokens), any number a source; ``targets``: rows (source, weight, max_repeats).

    Totals are combined on the map side, so a source with a third of all rows is one row a task. Only the targets' sources come to
    the driver. Documents without a source count nowhere. A source that stands twice in the targets has the sum of its weights
    and the smaller cap; a null weight is 0, a null cap is 1; a target without documents has 0 tokens.
    """
    t = targets.groupBy(source_of(F.col("source")).alias("source")).agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")).where("source IS NOT NULL")
    sums = documents.where("source IS NOT NULL").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    sums = sums.join(t.withColumn("__in", F.lit(True)), "source", "full")
    # sources outside the targets are added up to one row
    sums = sums.groupBy(F.when(F.col("__in"), F.col("source")).alias("source")).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "documents")], F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    rows = [r.asDict() for r in sums.limit(MOST_SOURCES + 2).collect()]
    if len(rows) > MOST_SOURCES + 1:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    rows = sorted(rows, key=lambda r: r["source"] or "")
    return Plan([r for r in rows if r["source"] is not None], int(sum(r["tokens"] for r in rows)), block, slots, seed)


def draws(spark, p: Plan) -> DataFrame:
    """Rows (shard, slot, source, pass, block, tokens): which block fills each slot of the output.

    A shard's slots are a multinomial draw without replacement from what the plan gives each source. The i-th slot of a source
    over all shards is place i modulo its number of blocks in pass i div that number; every pass runs through all blocks in an
    order of its own. Every slot is filled. A shard works out its own draw and offsets, so nothing is moved.
    """
    ship(spark)
    schema = pa.schema([("shard", pa.int64()), ("slot", pa.int32()), ("source", pa.string()), ("pass", pa.int32()), ("block", pa.int64()), ("tokens", pa.int64())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([s["source"] for s in p.sources], dtype=object)
        totals, blocks = np.array([int(s["tokens"]) for s in p.sources], dtype=np.int64), np.array(p.blocks, dtype=np.int64)
        for b in batches:
            for shard in b.column(0).to_pylist():
                counts, before = p.counts(shard)
                who = p.order(shard, counts)
                nth = np.zeros(len(who), dtype=np.int64)
                for s in np.flatnonzero(counts):
                    nth[who == s] = before[s] + np.arange(counts[s])
                rounds = nth // np.maximum(blocks[who], 1)
                place = np.zeros(len(who), dtype=np.int64)
                for s, r in {(int(a), int(c)) for a, c in zip(who, rounds, strict=True)}:
                    mine = (who == s) & (rounds == r)
                    place[mine] = permute(nth[mine] % blocks[s], int(blocks[s]), (p.seed * 1_000_003 + s) * 1_000_003 + r)
                size = np.minimum(p.block, totals[who] - place * p.block)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), shard)), pa.array(np.arange(len(who), dtype=np.int32)), pa.array(names[who].tolist(), pa.string()), pa.array(rounds.astype(np.int32)), pa.array(place), pa.array(size)], schema=schema)

    shards = spark.range(p.shards).select(F.col("id").alias("shard"))
    return shards.mapInArrow(fill, "shard long, slot int, source string, pass int, block long, tokens long")


def report(spark, p: Plan) -> DataFrame:
    """Rows per target source: weight, tokens, target_tokens, planned_tokens, used_tokens, passes, share (of all tokens used), reached, reachable.

    ``planned_tokens``: the target, less what the source can't give, plus its part of what others can't give. All else is from the
    finished draw: the blocks that fill the slots, and how often each was used. ``reached``: the mix has what was planned, but for a
    percent or a block. ``reachable``: max_repeats times the source's tokens is at least its weight times the tokens of all
    documents with a source, so whatever is drawn, a source that isn't has all of its blocks in the mix max_repeats times and still
    less than its target: that the draw used it up is what the first condition asks, the exact amount follows.
    """
    known = spark.createDataFrame([(s["source"], float(s["weight"]), int(s["max_repeats"]), int(s["tokens"]), float(w) * p.total, float(t), int(n)) for s, n, w, t in zip(p.sources, p.blocks, p.weights, p.targets, strict=True)], "source string, weight double, max_repeats int, tokens long, target_tokens double, planned_tokens double, blocks long")
    used = draws(spark, p).groupBy("source").agg(F.sum("tokens").alias("used_tokens"), (F.max("pass") + 1).alias("passes"), F.count(F.lit(1)).alias("slots"))
    all_of = Window.partitionBy(F.lit(0))  # one row a target source
    out = known.join(used, "source", "left").na.fill({"used_tokens": 0, "passes": 0, "slots": 0})
    short = (F.col("slots") >= F.col("blocks") * F.col("max_repeats")) & (F.col("used_tokens") < F.col("target_tokens"))
    out = out.withColumns({"share": F.when(F.sum("used_tokens").over(all_of) > 0, F.col("used_tokens") / F.sum("used_tokens").over(all_of)).otherwise(0.0), "reached": F.abs(F.col("used_tokens") - F.col("planned_tokens")) <= F.greatest(F.lit(float(p.block)), F.col("planned_tokens") * 0.01), "reachable": ~short})
    return out.drop("blocks", "slots")


def pack(tokenized: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, source, ids) to blocks (source, block, ids) of ``block`` tokens; a source's last block may be shorter.

    A document's place in its source's stream is a running sum over ranges of documents, which are equally large however much a
    source holds. Long documents are cut at block borders and may fill many blocks. Documents without tokens or source add nothing.
    """
    docs = tokenized.where("source IS NOT NULL AND size(ids) > 0").select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n"))
    placed = scan(docs, ["source"], ["doc_id", F.xxhash64("ids")], {"first": F.col("n")}, before=True)
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("n") - 1) / block))))
    start = F.greatest(F.col("block") * block - F.col("first"), F.lit(0))
    stop = F.least((F.col("block") + 1) * block - F.col("first"), F.col("n"))
    pieces = pieces.select("source", "block", (F.col("first") + start).alias("at"), F.slice("ids", (start + 1).cast("int"), (stop - start).cast("int")).alias("part"))
    return pieces.groupBy("source", "block").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])).alias("ids"))


def mix(tokenized: DataFrame, targets: DataFrame, block: int = BLOCK, slots: int = SLOTS, seed: int = 7) -> DataFrame:
    """The mixed corpus: rows (shard, slot, source, pass, block, ids), joined from drawn slots and packed blocks by (source, block).

    ``tokenized``: rows (doc_id, source, ids). A block is drawn at most max_repeats times, so no join key is hot.
    """
    p = plan(tokenized.select("source", F.size("ids").cast("long").alias("tokens")), targets, block, slots, seed)
    return draws(tokenized.sparkSession, p).drop("tokens").join(pack(tokenized, p.block), ["source", "block"]).select("shard", "slot", "source", "pass", "block", "ids")
