"""Overlap graphs: components, paths, merging. A gap's graph is small and is worked on as one group; large graphs iterate."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.operators.align import Overlap, merged, overlap, revcomp, significance, spread
from seqloom.records import cut, merge, ship

Edges = dict[str, dict[str, float]]


def components(nodes: list[str], edges: Edges) -> list[list[str]]:
    """Strongly connected components, each before those it leads to; nodes and components in a defined order."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on: set[str] = set()
    stack: list[str] = []
    out: list[list[str]] = []
    for root in sorted(nodes):
        if root in index:
            continue
        work = [(root, iter(sorted(edges.get(root, ()))))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, following = work[-1]
            child = next(following, None)
            if child is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    group = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        group.append(x)
                        if x == node:
                            break
                    out.append(sorted(group))
            elif child not in index:
                index[child] = low[child] = len(index)
                stack.append(child)
                on.add(child)
                work.append((child, iter(sorted(edges.get(child, ())))))
            elif child in on:
                low[node] = min(low[node], index[child])
    return out[::-1]


def roots_and_ends(groups: list[list[str]], edges: Edges) -> tuple[list[str], list[str]]:
    """Nodes that no other component leads to, and those that lead to none; of a component that has only such nodes, its first and its last."""
    of = {n: i for i, g in enumerate(groups) for n in g}
    into = {t for s, ts in edges.items() for t in ts if of[s] != of[t]}
    out_of = {s for s, ts in edges.items() if any(of[s] != of[t] for t in ts)}
    roots, ends = [], []
    for g in groups:
        first, last = [n for n in g if n not in into], [n for n in g if n not in out_of]
        roots += first[:1] if len(first) == len(g) else first
        ends += last[-1:] if len(last) == len(g) else last
    return roots, ends


def shortest_paths(root: str, groups: list[list[str]], edges: Edges, ends: list[str]) -> list[tuple[float, list[str]]]:
    """One shortest path from a root to every end it reaches, over the components' order, edges back left out."""
    place = {n: i for i, n in enumerate(n for g in groups for n in g)}
    best: dict[str, tuple[float, str | None]] = {root: (0.0, None)}
    for n in sorted(place, key=place.get):
        if n not in best:
            continue
        for t in sorted(edges.get(n, ())):
            if place[t] > place[n] and (t not in best or best[n][0] + edges[n][t] < best[t][0]):
                best[t] = (best[n][0] + edges[n][t], n)
    paths = []
    for e in ends:
        if e in best:
            path, n = [], e
            while n is not None:
                path.append(n)
                n = best[n][1]
            paths.append((best[e][0], path[::-1]))
    return paths


def paths(nodes: list[str], edges: Edges, k: int = 20) -> list[tuple[float, list[str]]]:
    """From every root its k + 1 longest-overlap paths (smallest weights; the count is tested after it was raised)."""
    groups = components(nodes, edges)
    roots, ends = roots_and_ends(groups, edges)
    out = []
    for r in roots:
        out += sorted(shortest_paths(r, groups, edges, ends), key=lambda x: (x[0], x[1]))[: k + 1]
    return out


def simple_paths(root: str | list[str], edges: Edges, longest: int = 50, use: int = 20) -> list[list[str]]:
    """Paths without a repeated node from a root, or from several, each as far as it can be extended.

    The reference's two limits: a path has at most ``longest`` nodes, and a node that stands in more than ``use`` paths so far (the
    roots' own count) isn't stepped to again. Paths grow by a node a round, all together, in the order of their names.
    """
    level = [[r] for r in ([root] if isinstance(root, str) else sorted(root))]
    used = Counter(p[0] for p in level)
    out: list[list[str]] = []
    while level:
        longer = []
        for path in level:
            before = len(longer)
            if len(path) < longest:
                for t in sorted(edges.get(path[-1], ())):
                    if used[t] <= use and t not in path:
                        longer.append([*path, t])
                        used[t] += 1
            if len(longer) == before:
                out.append(path)
        level = longer
    return out


def flip(name: str) -> str:
    return name[:-2] if name.endswith("_R") else name + "_R"


def drop_mirrored(found: list[tuple[float, list[str]]]) -> list[tuple[float, list[str]]]:
    """Paths of which the mirror image (reversed, strands exchanged) came before are left out."""
    seen, out = set(), []
    for w, p in found:
        key = min(tuple(p), tuple(flip(n) for n in reversed(p)))
        if key not in seen:
            seen.add(key)
            out.append((w, p))
    return out


def drop_parts(found: list[tuple[float, list[str]]]) -> list[tuple[float, list[str]]]:
    """Paths that lie within a longer one are left out."""
    text = lambda p: "\0" + "\0".join(p) + "\0"
    whole = sorted({text(p) for _, p in found}, key=len, reverse=True)
    return [(w, p) for w, p in found if not any(len(x) > len(text(p)) and text(p) in x for x in whole)]


def overlap_graph(seqs: dict[str, str], seed: int = 10, end: int = 30, **options) -> tuple[list[str], Edges]:
    """Both strands of every sequence as nodes, an edge from i to j of weight -overlap where i's end overlaps j's beginning.

    Pairs are aligned only if they share a seed of ``seed`` letters with the first or last ``end`` bases of the other. What is
    contained in another makes no edge.
    """
    both = {n: s for name, seq in sorted(seqs.items()) for n, s in ((name, seq), (name + "_R", revcomp(seq)))}
    ends = {n: {p[i : i + seed] for p in (s[:end], s[-end:]) for i in range(len(p) - seed + 1)} for n, s in both.items()}
    # only seeds that ends have are asked for
    seeds: dict[str, set[str]] = {e: set() for some in ends.values() for e in some}
    for n, s in both.items():
        for e in seeds.keys() & {s[i : i + seed] for i in range(len(s) - seed + 1)}:
            seeds[e].add(n)
    edges: Edges = {}
    done: set[tuple[str, str]] = set()
    # contigs often come with their reverse complements, so the same two sequences meet under several names
    known: dict[tuple[str, str], Overlap] = {}
    for n in both:
        for other in sorted({o for e in ends[n] for o in seeds[e]}):
            pair = (min(n, other), max(n, other))
            if flip(n) == other or n == other or pair in done:
                continue
            done.add(pair)
            a, b = pair
            two = (both[a], both[b])
            o = known[two] if two in known else known.setdefault(two, overlap(*two, **options))
            if significance(o, len(both[a]), len(both[b])):
                # an overlap that takes up all of one sequence is a containment
                if o.ends_first and o.row_start > 0:
                    edges.setdefault(a, {})[b] = -float(o.score)
                elif not o.ends_first and o.col_start > 0:
                    edges.setdefault(b, {})[a] = -float(o.score)
    return sorted(both), edges


def merge_path(path: list[str], seqs: dict[str, str], **options) -> str:
    """The sequence of a path: one after the other merged by their overlap."""
    strand = lambda n: revcomp(seqs[n[:-2]]) if n.endswith("_R") else seqs[n]
    out = strand(path[0])
    for n in path[1:]:
        s = strand(n)
        out = merged(out, s, overlap(out, s, **options))
    return out


def merged_paths(seqs: dict[str, str], **options) -> list[tuple[str, list[str], str]]:
    """The merged sequences of the paths of sequences' overlap graph: (name, path, sequence)."""
    nodes, edges = overlap_graph(seqs, **options)
    used = sorted(set(edges) | {t for ts in edges.values() for t in ts})
    found = drop_parts(drop_mirrored([(w, p) for w, p in paths(used, edges) if len(p) > 1]))
    return [(f"merged_{i}", p, merge_path(p, seqs, **options)) for i, (_, p) in enumerate(found, 1)]


def of_groups(df: DataFrame, run: Callable[[object, list[tuple]], Iterable[tuple]], names: list[str]) -> DataFrame:
    """What ``run(group, rows)`` makes of every group of ``df``: rows (group, names...), all strings but the group, its first column.

    ``df`` is dealt out by its group. A batch holds many small groups, each of which would otherwise be a table of its own; a task
    holds one group and one batch. A null group is a group.
    """
    group, kind = df.dtypes[0]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out, kinds = None, [], [], None

        def written() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [group, *names])

        for part in parts:
            kinds = [part.schema.field(0).type, *[pa.string()] * len(names)]
            for row in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if rows and row[0] != key:
                    out += [(key, *r) for r in run(key, rows)]
                    rows = []
                    if len(out) >= 1000:
                        yield written()
                        out = []
                key = row[0]
                rows.append(row[1:])
        if rows:
            out += [(key, *r) for r in run(key, rows)]
        if out:
            yield written()

    ship(df.sparkSession)
    return df.sortWithinPartitions(group).mapInArrow(batches, ", ".join([f"`{group}` {kind}", *[f"{n} string" for n in names]]))


def merge_contigs(contigs: DataFrame, group: str, name: str, seq: str, most_bases: int = 1_000_000, clip: int = 50) -> DataFrame:
    """Per group the merged sequences of its overlap graph's paths: rows (group, name, path, seq, reason).

    A group whose sequences pass ``most_bases`` isn't merged, as the reference's guard has it, so a group that is worked on is
    bounded: each of its contigs comes out as it is, a path of itself, with the reason ``too many bases``; ``reason`` is null
    for merged sequences. Null and empty sequences are left out; a null group is a group.
    """
    ship(contigs.sparkSession)
    usable = contigs.where(F.length(seq) > 0).select(F.col(group).alias("g"), F.col(name).cast("string").alias("n"), F.col(seq).alias("s"))
    usable = spread(usable, "g").withColumn("bases", F.sum(F.length("s")).over(Window.partitionBy("g")))
    as_is = usable.where(F.col("bases") > most_bases).select(F.col("g").alias(group), F.col("n").alias("name"), F.array("n").alias("path"), F.col("s").alias("seq"), F.lit("too many bases").alias("reason"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf["g"].iloc[0]
        seqs = {}
        for n, s in sorted(zip(pdf["n"], pdf["s"], strict=True)):
            seqs.setdefault(n, s.upper())
        rows = [(g, *r) for r in merged_paths(seqs, clip=clip)]
        return pd.DataFrame(rows, columns=["g", "name", "path", "seq"])

    kind = dict(contigs.dtypes)[group]
    merged_ones = usable.where(F.col("bases") <= most_bases).drop("bases").groupBy("g").applyInPandas(run, f"g {kind}, name string, path array<string>, seq string").withColumnRenamed("g", group)
    return merged_ones.withColumn("reason", F.lit(None).cast("string")).unionByName(as_is)


def unbranched(have: dict[str, int]) -> list[tuple[str, float]]:
    """The unbranched paths of the de Bruijn graph of counted k-mers: (sequence, mean count)."""
    # the k-mer that begins, or ends, with the rest of one; empty where several do
    heads: dict[str, str] = {}
    tails: dict[str, str] = {}
    for x in have:
        p, q = x[:-1], x[1:]
        heads[p] = "" if p in heads else x
        tails[q] = "" if q in tails else x
    # from a k-mer to the only one behind it, of which it is the only one before
    after = {x: n for q, x in tails.items() if x and (n := heads.get(q))}
    inner = set(after.values())
    seen: set[str] = set()
    rows = []

    def walk(start: str) -> None:
        path, x = [start], start
        seen.add(start)
        while (x := after.get(x, "")) and x not in seen:
            path.append(x)
            seen.add(x)
        rows.append((path[0] + "".join([x[-1] for x in path[1:]]), float(sum([have[x] for x in path]) / len(path))))

    for x in sorted(have.keys() - inner):
        walk(x)
    if len(seen) < len(have):
        for x in sorted(have.keys() - seen):  # circles
            if x not in seen:
                walk(x)
    return rows


def unitigs(kmers: DataFrame, group: str, kmer: str, count: str, least: int = 1) -> DataFrame:
    """Per group the unbranched paths of its de Bruijn graph: rows (group, seq, mean_count). Our own assembler, a stand-in for external ones.

    k-mers counted fewer than ``least`` times are left out. A group is one gap's k-mers.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf["g"].iloc[0]
        rows = [(g, *r) for r in unbranched(dict(zip(pdf["k"], pdf["c"], strict=True)))]
        return pd.DataFrame(rows, columns=["g", "seq", "mean_count"])

    kind = dict(kmers.dtypes)[group]
    data = kmers.where(F.col(count) >= least).select(F.col(group).alias("g"), F.col(kmer).alias("k"), F.col(count).cast("long").alias("c"))
    return spread(data, "g").groupBy("g").applyInPandas(run, f"g {kind}, seq string, mean_count double").withColumnRenamed("g", group)


def weak_components(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Every node with the smallest node it is connected to, whatever the directions: rows (node, component).

    Labels are lowered by joins and a minimum combined on the map side; each round also jumps to the label's own label, so chains
    take few rounds. Rounds go on until no label changes. Every round is written to the shared folder.
    """
    both = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = cut(both.union(both.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(merge(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(merge(near), "node").select("node", F.least("label", "near").alias("new"), "label")
        jump = lower.alias("x").join(merge(labels.alias("y")), F.col("x.new") == F.col("y.node"), "left").select(F.col("x.node").alias("node"), F.least("x.new", F.coalesce("y.label", "x.new")).alias("new"), F.col("x.label").alias("old"))
        done = cut(jump)
        labels = done.select("node", F.col("new").alias("label"))
        if done.where("new <> old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))


def reach(edges: DataFrame, starts: DataFrame, source: str, target: str) -> DataFrame:
    """Breadth-first: rows (node, depth) of all nodes reached from ``starts`` (a column ``node``), each at its least depth, however far."""
    e = cut(edges.select(F.col(source).alias("s"), F.col(target).alias("node")).where("s IS NOT NULL AND node IS NOT NULL").distinct())
    seen = front = cut(starts.select("node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while not front.isEmpty():
        depth += 1
        front = cut(e.join(front.select(F.col("node").alias("s")), "s").select("node").distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        # written anew, so that a round's plan doesn't grow with the rounds before it
        seen = cut(seen.unionByName(front))
    return seen


def maximal_paths(edges: DataFrame, source: str, target: str, longest: int = 10) -> DataFrame:
    """Simple paths of at most ``longest`` nodes that can't be extended: rows (root, path), by expanding all paths a node a round.

    Roots are the nodes no edge leads to; a path ends where every edge leads back into it, or at ``longest`` nodes. Rounds are
    joins on the last node, so a large graph's paths are spread; their number is the feature's own. Repeated edges count
    once; edges with a null end lead nowhere. A graph that is all circles has no root and so no path; an empty one has none.
    """
    e = cut(edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s IS NOT NULL AND t IS NOT NULL AND s <> t").distinct())
    roots = e.select("s").distinct().join(e.select(F.col("t").alias("s")).distinct(), "s", "left_anti")
    level, done = cut(roots.select(F.col("s").alias("root"), F.array("s").alias("path"))), None
    for _ in range(longest - 1):
        longer = cut(level.join(e, F.element_at("path", -1) == F.col("s")).where(~F.array_contains("path", F.col("t"))).select("root", "path", F.concat("path", F.array("t")).alias("longer")))
        ended = level.join(longer.select("root", "path").distinct(), ["root", "path"], "left_anti")
        done = ended if done is None else done.unionByName(ended)
        level = longer.select("root", F.col("longer").alias("path"))
        if longer.isEmpty():
            return done
    return level if done is None else done.unionByName(level)
