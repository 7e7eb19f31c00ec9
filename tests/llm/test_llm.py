"""Operators of the llm subpackage against brute force, exact round trips and planted cases."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import mixing as M
from seqloom.llm import sketch as Q
from seqloom.llm import terms as T
from seqloom.llm import tokens as K
from seqloom.llm import truncation as C
from seqloom.llm.spans import shared_classes, shared_spans, verified_spans

# ---- spans


def brute_spans(seqs, least):
    where = defaultdict(set)
    for i, s in seqs.items():
        for p in range(len(s) - least + 1):
            if set(s[p : p + least]) <= set("ACGT"):
                where[s[p : p + least]].add(i)
    out = set()
    for i, s in seqs.items():
        bases = sorted({x for p in range(len(s) - least + 1) if len(where.get(s[p : p + least], ())) > 1 for x in range(p, p + least)})
        k = 0
        while k < len(bases):
            j = k
            while j + 1 < len(bases) and bases[j + 1] == bases[j] + 1:
                j += 1
            out.add((i, bases[k], bases[j] - bases[k] + 1))
            k = j + 1
    return out


@pytest.mark.parametrize("least", [21, 24, 48, 62, 90])
def test_spans(spark, least):
    rng = random.Random(least)
    base = "".join(rng.choice("ACGT") for _ in range(400))
    seqs = {}
    for i in range(40):
        a = rng.randint(0, 300)
        s = base[a : a + rng.randint(0, 120)] + "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 50)))
        s = list(s)
        for _ in range(rng.randint(0, 2)):
            if s:
                s[rng.randrange(len(s))] = rng.choice("ACGTN")
        seqs[i] = "".join(s)
    seqs |= {100: base, 101: base, 102: "A" * 200, 103: "A" * 150, 104: "", 105: "AC" * 100, 106: "CA" * 70, 107: "A" * least, 108: base[:200] * 2}
    rows = [(i, s.lower() if i % 3 else s, 1) for i, s in seqs.items()] + [(1, seqs[1], 2), (None, base, 1), (200, None, 1)]
    got = [tuple(r) for r in shared_spans(spark.createDataFrame(rows, "rec long, s string, pos int"), "rec", "s", least).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(seqs, least)


def test_spans_of_nothing(spark):
    assert shared_spans(spark.createDataFrame([], "rec long, s string"), "rec", "s").count() == 0
    with pytest.raises(ValueError, match="least"):
        shared_spans(spark.createDataFrame([], "rec long, s string"), "rec", "s", 20)


def test_recall_of_banding_and_classes(spark):
    """Families of variants of one sequence: most shared bases come from banding and verification, the rest from the completion."""
    rng = random.Random(9)
    seqs, family = {}, {}
    for f in range(30):
        base = "".join(rng.choice("ACGT") for _ in range(600))
        for v in range(rng.randint(1, 8)):
            s, a = list(base), rng.randint(0, 200)
            for _ in range(rng.randint(0, 4)):
                s[rng.randrange(600)] = rng.choice("ACGT")
            seqs[len(seqs)] = "".join(s)[a : a + rng.randint(200, 400)]
            family[len(seqs) - 1] = f
    df = spark.createDataFrame(list(seqs.items()), "rec long, s string")
    bases = lambda rows: {(r[0], x) for r in rows for x in range(r[1], r[1] + r[2])}
    exact, first = bases(brute_spans(seqs, 48)), bases(verified_spans(df, "rec", "s").collect())
    print("recall of banding", len(first) / len(exact))
    assert first <= exact and len(first) >= 0.9 * len(exact) and bases(shared_spans(df, "rec", "s").collect()) == exact
    classes = {r["rec"]: r for r in shared_classes(df, "rec", "s").collect()}
    assert set(classes) == {r for r, _ in first} and all(r["links"] >= 1 for r in classes.values())
    assert all(family[r["class"]] == family[rec] and r["class"] <= rec for rec, r in classes.items())


def brute_classes(seqs, least):
    """Record to (smallest record of its component, number of partners)."""
    where = defaultdict(set)
    for i, s in seqs.items():
        for p in range(len(s) - least + 1):
            where[s[p : p + least]].add(i)
    partners = defaultdict(set)
    for held in where.values():
        for i in held:
            partners[i] |= held - {i}
    out = {}
    for i in sorted(x for x, p in partners.items() if p):
        todo = [] if i in out else [i]
        while todo:
            if (x := todo.pop()) not in out:
                out[x] = (i, len(partners[x]))
                todo += partners[x]
    return out


def test_classes_have_all_links(spark):
    """Variants that share nothing with their bucket's representative, copies, a stretch of many records, a chain."""
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    seqs = {}
    for _ in range(12):
        base = letters(500)
        for _ in range(rng.randint(2, 8)):
            s, a = list(base), rng.randint(0, 250)
            for _ in range(rng.randint(0, 5)):
                s[rng.randrange(500)] = rng.choice("ACGT")
            seqs[len(seqs)] = "".join(s)[a : a + rng.randint(150, 250)]
    hot, copy, chain = letters(60), letters(120), letters(400)
    seqs |= {200 + i: letters(30) + hot + letters(20) for i in range(30)} | {300 + i: copy for i in range(5)} | {400 + i: chain[60 * i : 60 * i + 110] for i in range(5)}
    seqs |= {500: letters(100), 501: hot + copy[:50]}
    df = spark.createDataFrame(list(seqs.items()), "rec long, s string")
    assert {r["rec"]: (r["class"], r["links"]) for r in shared_classes(df, "rec", "s").collect()} == brute_classes(seqs, 48)


def test_a_stretch_that_a_third_of_all_records_hold(spark):
    rng = random.Random(4)
    hot = "".join(rng.choice("ACGT") for _ in range(60))
    seqs = {i: ("".join(rng.choice("ACGT") for _ in range(70)) + (hot if i % 3 == 0 else "") + "".join(rng.choice("ACGT") for _ in range(30))) for i in range(900)}
    got = {tuple(r) for r in shared_spans(spark.createDataFrame(list(seqs.items()), "rec long, s string"), "rec", "s").collect()}
    assert got == brute_spans(seqs, 48) and len(got) == 300


# ---- sketches


def rank_error(values, q, got):
    values = sorted(values)
    lo, hi = np.searchsorted(values, got, "left"), np.searchsorted(values, got, "right")
    want = max(1, math.ceil(q * len(values)))
    return max(0, lo + 1 - want, want - hi) / len(values)


@pytest.mark.parametrize("order", ["random", "rising", "falling", "ties"])
def test_sketch_error_is_within_its_bound(spark, order):
    n, k = 40_000, 128
    values = list(range(n))
    random.Random(1).shuffle(values)
    values = {"random": values, "rising": sorted(values), "falling": sorted(values, reverse=True), "ties": [v % 7 for v in values]}[order]
    rows = spark.createDataFrame([("hot", v) for v in values] + [("few", 5), ("few", None), (None, 9), (None, 8)], "g string, v long").repartition(16)
    got = Q.query_sketches(Q.build_sketches(rows, ["g"], "v", k), ["g"], [0.0, 0.5, 0.95, 1.0], k, parts=5000).collect()
    for r in got:
        if r.g == "hot":
            assert r.n == n and 0 < r.rank_error < 0.06 and rank_error(values, r.q, r.value) <= r.rank_error
    assert {(r.g, r.q, r.value, r.n) for r in got if r.g != "hot"} >= {("few", 0.5, 5, 1), (None, 0.5, 8, 2), (None, 1.0, 9, 2)}


def test_sketches_of_days_combine(spark):
    rows = [(f"d{i % 5}", "k", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "day string, g string, v long")
    days = None
    for d in range(5):
        s = Q.merge_sketches(Q.build_sketches(df.where(F.col("day") == f"d{d}"), ["day", "g"], "v", 64), ["day", "g"], 64)
        days = s if days is None else days.unionByName(s)
    r = Q.query_sketches(days.drop("day"), ["g"], [0.5], 64).first()
    assert r.n == 3000 and abs(r.value - 1500) <= 3000 * r.rank_error + 1
    assert Q.query_sketches(Q.build_sketches(df.limit(0), ["g"], "v"), ["g"], [0.5]).count() == 0


# ---- terms


def brute_terms(seqs, k):
    occ, rec = Counter(), Counter()
    for s in seqs:
        w = [s.upper()[i : i + k] for i in range(len(s) - k + 1)]
        w = [x for x in w if set(x) <= set("ACGT")]
        occ.update(w)
        rec.update(set(w))
    return {(t, occ[t], rec[t], len(seqs)) for t in occ}


@pytest.mark.parametrize("k", [4, 5, 10, 21, 22, 31])
def test_terms(spark, k):
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGTacgtN" if rng.random() < 0.3 else "ACGT") for _ in range(rng.choice([0, 3, k, 60, 200]))) for _ in range(150)]
    seqs += ["A" * 300] * 60 + seqs[:10]
    df = spark.createDataFrame([(s, 1) for s in seqs] + [(None, 1)], "s string, records int").repartition(5)
    assert {tuple(r) for r in T.term_frequency(df, "s", k).collect()} == brute_terms(seqs, k)


def test_terms_split_on_disk(spark, tmp_path, monkeypatch):
    """The recursion itself, with a small limit."""
    import pyarrow as pa

    monkeypatch.setattr(T, "OVERSIZED", 50)
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 12, 3000).astype(np.uint64) << np.uint64(8)
    t = pa.table({"h": h, "o": np.ones(3000, dtype=np.int64), "r": np.ones(3000, dtype=np.int64)})
    files = {}
    T._spill(t, 8, 20, str(tmp_path), files)
    got = Counter()
    for p in sorted(files):
        for part in T._from_disk(files[p], 16, 20, str(tmp_path)):
            for a, b in zip(part.column("h").to_pylist(), part.column("o").to_pylist(), strict=True):
                assert a not in got
                got[a] += b
    assert got == Counter(h.tolist())


def test_terms_of_nothing(spark):
    assert T.term_frequency(spark.createDataFrame([], "s string"), "s").count() == 0
    with pytest.raises(ValueError, match="k must"):
        T.term_frequency(spark.createDataFrame([], "s string"), "s", 32)


# ---- tokens


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids(spark, reference):
    rng = random.Random(2)
    pieces = ["a", "B", "é", "́", " ", "  ", "\n", "\r\n", "\t", "\x85", "\xa0", "\x1c", "​", "中文", "１２", "½", "'s", "'S", "!!", "<|endoftext|>", "🙏", "👩‍🔬", "3.14", "_", "\x00", "�", "tokenization", "ACGT" * 5]
    texts = ["", None, "   ", "x" * 3000, "ab" * 20_000, "Hello world's end."] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    texts += texts[:5]
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r.ids for r in K.encode(spark.createDataFrame(rows, "doc_id long, text string, ids int"), "text", keep=("doc_id",)).collect()}
    want = [x.ids for x in reference.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [got[i] for i in range(len(texts))] == want
    assert K.encode(spark.createDataFrame([], "doc_id long, text string"), "text", keep=("doc_id",)).count() == 0


def test_perfect_hash_is_minimal():
    items = [(f"k{i}".encode(), i) for i in range(5000)] + [(b"", 5000)]
    h = K.PerfectHash(items)
    assert all(s is not None for s in h.slots) and len(h.slots) == len(items)
    assert all(h.get(k) == v for k, v in items) and h.get(b"k5000") is None and h.get(b"x") is None


# ---- mixing


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_permutation(n):
    a, b = M.permute(np.arange(n), n, 1), M.permute(np.arange(n), n, 2)
    assert sorted(a) == list(range(n)) == sorted(b) and (n < 10 or list(a) != list(b))


def corpus(spark):
    rng = random.Random(3)
    rows = [(i, "big", list(range(rng.randint(0, 60)))) for i in range(300)] + [(1000 + i, "small", [7] * 10) for i in range(12)] + [(2000, "other", [1] * 500), (2001, None, [1] * 50), (2002, "big", None), (2003, "big", list(range(700)))]
    return spark.createDataFrame(rows, "doc_id long, source string, ids array<int>")


def test_mix(spark):
    docs = corpus(spark)
    targets = spark.createDataFrame([(" BIG ", 0.5, 2), ("small", 0.4, 3), ("none", 0.1, 5)], "source string, weight double, max_repeats int")
    p = M.plan(docs.select("source", F.size("ids").cast("long").alias("tokens")).where("tokens > 0"), targets, block=16, slots=32)
    rep = {r.source: r for r in M.report(spark, p).collect()}
    total = docs.where("source IS NOT NULL").agg(F.sum(F.greatest(F.size("ids"), F.lit(0)))).first()[0]
    assert p.total == total and set(rep) == {"big", "small", "none"}
    assert rep["big"].reachable and not rep["small"].reachable and not rep["none"].reachable
    assert rep["small"].used_tokens == 3 * 120 and rep["none"].used_tokens == 0 and rep["none"].passes == 0
    assert abs(sum(r.share for r in rep.values()) - 1) < 1e-9
    mixed = M.mix(docs.where("ids IS NOT NULL"), targets, block=16, slots=32).collect()
    assert len({(r.shard, r.slot) for r in mixed}) == len(mixed) == len({(r.source, r["pass"], r.block) for r in mixed})
    assert max(Counter((r.source, r.block) for r in mixed).values()) <= 3
    assert sum(len(r.ids) for r in mixed if r.source == "big") == rep["big"].used_tokens
    again = M.mix(docs.where("ids IS NOT NULL").repartition(7), targets, block=16, slots=32).collect()
    assert sorted(map(tuple, ((r.shard, r.slot, r.source, r.block, tuple(r.ids)) for r in mixed))) == sorted(map(tuple, ((r.shard, r.slot, r.source, r.block, tuple(r.ids)) for r in again)))


def test_shares_are_met(spark):
    """What sources without passes left can't give comes from the others: the mix is as large as the total, and each share is met."""
    rng = random.Random(8)
    sizes = {"a": 9000, "b": 4000, "c": 700, "d": 60, "e": 2500}
    docs = spark.createDataFrame([(k * 10_000 + i, s, [k] * 20) for k, (s, n) in enumerate(sizes.items()) for i in range(n // 10 + rng.randint(0, 3))], "doc_id long, source string, ids array<int>")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("d", 0.1, 2), ("e", 0.1, 9)], "source string, weight double, max_repeats int")
    p = M.plan(docs.select("source", F.size("ids").cast("long").alias("tokens")), targets, slots=64)
    rep = {r.source: r for r in M.report(spark, p).collect()}
    assert {s for s, r in rep.items() if not r.reachable} == {s for s, r in rep.items() if r.max_repeats * r.tokens < r.weight * p.total} == {"c", "d"}
    assert all(r.used_tokens == r.max_repeats * r.tokens for r in rep.values() if not r.reachable)
    assert abs(sum(r.used_tokens for r in rep.values()) - p.total) < 0.01 * p.total
    assert all(r.reached for r in rep.values() if r.reachable)
    got = M.draws(spark, p).collect()
    assert len(got) == p.drawn and Counter(r.source for r in got) == {s["source"]: int(q) for s, q in zip(p.sources, p.quota, strict=True) if q}
    spread = [Counter(r.source for r in got if r.shard == i)["a"] for i in range(p.shards - 1)]
    assert len(set(spread)) > 3


def test_a_draw_of_many_slots():
    have = np.array([3 * 10**10, 10**9, 5, 0])
    first = M.Plan._first_half(have, 10**10, np.random.default_rng(1))
    assert first.sum() == 10**10 and (first >= 0).all() and (first <= have).all() and abs(first[1] / 10**9 - 10 / 31) < 1e-3


def test_packing_loses_nothing(spark):
    docs = corpus(spark).where("ids IS NOT NULL")
    blocks = M.pack(docs, 16).collect()
    want, got = defaultdict(Counter), defaultdict(Counter)
    for r in docs.collect():
        want[r.source].update(r.ids)
    for r in blocks:
        got[r.source].update(r.ids)
    want.pop(None)
    assert got == want
    last = {s: max(r.block for r in blocks if r.source == s) for s in got}
    assert all(len(r.ids) == 16 for r in blocks if r.block < last[r.source])


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, ids array<int>")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeats int")
    assert M.mix(empty, targets).count() == 0
    p = M.plan(empty.select("source", F.size("ids").cast("long").alias("tokens")), targets)
    assert [(r.source, r.used_tokens, r.reachable) for r in M.report(spark, p).collect()] == [("a", 0, True)]
    assert M.mix(corpus(spark).where("ids IS NOT NULL"), targets.limit(0)).count() == 0


def test_sources(spark):
    rows = spark.createDataFrame([(" Wiki\t",), ("\xa0wiki",), (None,), ("  ",), ("",)], "s string").coalesce(1)
    assert [r.v for r in rows.select(M.source_of(F.col("s")).alias("v")).collect()] == ["wiki", "wiki", None, None, None]


# ---- truncation

PARTS = ["The left flank overlaps the gap at", "This run confirms scaffold", "The nightly batch rejects the reads clipped at", "Every pair links the anchor on", "The small contig masks a shared span of"]
TAILS = ["thanks in advance", "-- the desk", "(see NODE_7)", "exit status 0"]


def sentence(rng):
    return f"{rng.choice(PARTS)} {rng.randint(1, 9999)}{rng.choice([' bases', ' units in both orientations', ' rows'])}."


def text_of(rng):
    return "\n\n".join(" ".join(sentence(rng) for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(1, 4)))


def judged(spark, rows):
    df = spark.createDataFrame([(i, "s", t, 5) for i, t in rows], "id long, src string, text string, body int")
    return {r.id: (r.is_cut, r.by) for r in C.truncated(df, "id", "src", "text").collect()}


def test_cut_texts_are_found(spark):
    rng = random.Random(11)
    rows, cut = [], set()
    for i in range(900):
        t = text_of(rng)
        kind = i % 9
        if kind == 1:
            t += "\n\n" + rng.choice(TAILS)
        elif kind == 2:
            t += "\n\n- " + "\n- ".join(f"the gap at {rng.randint(1, 99)}" for _ in range(3)) + "\n"
        elif kind in (3, 4):
            words = t.split(" ")
            keep = rng.randint(len(words) // 2, len(words) - 2)
            t = " ".join(words[:keep])
            while t.rstrip()[-1] in ".":
                t = t.rstrip().rsplit(" ", 1)[0]
            if kind == 4:
                t += rng.choice(["...", " [more]", "\n\n-- the desk", "</p>", "\r\n", "�", '"'])
            cut.add(i)
        rows.append((i, t))
    rows += [(1000, None), (1001, ""), (1002, "  \n"), (1003, "```\ncode"), (1004, rows[0][1].upper())]
    got = judged(spark, rows)
    assert 1000 not in got and got[1001] == got[1002] == (False, None) and got[1003][0] and not got[1004][0]
    found = {i for i, (c, _) in got.items() if c and i < 900}
    assert len(found & cut) >= 0.98 * len(cut) and len(found - cut) <= 0.01 * 900


def test_a_near_copy_shows_the_cut(spark):
    """The last number was cut: only the other text knows."""
    rng = random.Random(5)
    rows = [(i, text_of(rng)) for i in range(60)]
    lines = "\n".join(f"- the gap at {n} on scaffold {n * 7}" for n in range(40, 90))
    whole = text_of(rng) + "\n\n" + lines + "\n"
    rows += [(100, whole), (101, whole[: whole.rindex("623") + 2] + "\n")]
    got = judged(spark, rows)
    assert got[101] == (True, "copy") and not got[100][0]


def test_goes_on():
    a = "one two three four five six seven eight nine ten"
    assert C.goes_on(a[:-1], a) and C.goes_on(a[:-4], a) and not C.goes_on(a, a)
    assert not C.goes_on(a[:-4], a[:-4] + "\n\nten") and not C.goes_on(a[:-4] + ".", a[:-4] + ". ten") and not C.goes_on("a b", a)


def test_hot_bucket_gives_few_pairs(spark, monkeypatch):
    """A third of all texts in one bucket: what is compared grows with the texts, not with their square."""
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(i, f"{base} x{i} y z") for i in range(300)] + [(400 + i, f"{base} x{i} y") for i in range(150)] + [(1000 + i, " ".join(f"u{i}_{j}" for j in range(50))) for i in range(600)]
    seen = []
    verified = C._verified
    monkeypatch.setattr(C, "_verified", lambda pairs, texts: (seen.append(pairs.count()), verified(pairs, texts))[1])
    assert sorted(r.uid for r in C.cut_copies(spark.createDataFrame(rows, "uid long, body string")).collect()) == list(range(400, 550))
    assert sum(seen) <= 450 * 2


def test_a_cut_copy_meets_its_own_original(spark):
    """The longest of the bucket is another variant; a copy cut inside its last word has as many words as its original; short texts."""
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(i, f"{base} x{i} y{i} z{i}") for i in range(40)] + [(50, f"{base} another one that is longer than they all are")]
    rows += [(60, f"{base} x7 y7"), (70, "to be cut inside a word one two three"), (71, "to be cut inside a word one two three four"), (80, "so so so so so so"), (81, "so so so so so so so so")]
    other = " ".join(f"u{i}" for i in range(100))
    rows += [(90, f"{other} ending"), (91, f"{other} end")]
    got = C.cut_copies(spark.createDataFrame(rows, "uid long, body string"))
    assert sorted(r.uid for r in got.collect()) == [60, 70, 80, 91]


def test_equal_strings_are_all_compared(spark):
    """What follows is the same in all of them, but only the last is a near-copy; the others differ in their middles."""
    head, middle, end = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("h", 40), ("m", 20), ("e", 14)))
    rows = [(i, f"{head} {' '.join(f'o{i}_{j}' for j in range(20))} {end} and so it goes on from here") for i in range(50)]
    rows += [(90, f"{head} {middle} {end} and so it goes on from here"), (91, f"{head} {middle} {end} an")]
    assert [r.uid for r in C.cut_copies(spark.createDataFrame(rows, "uid long, body string")).collect()] == [91]


def test_recall_of_cut_copies(spark):
    """Copies cut anywhere, some retold in every fortieth word: nearly all that brute force finds are found, and nothing else."""
    rng = random.Random(23)
    words = [f"{a}{b}" for a in ("gap", "read", "contig", "flank", "mate", "seed") for b in range(60)]
    wholes = [" ".join(rng.choice(words) for _ in range(rng.randint(12, 400))) for _ in range(150)]
    rows = [(i, w) for i, w in enumerate(wholes)]
    for i, w in enumerate(wholes):
        for j in range(3):
            t = w[: rng.randint(len(w) // 4, len(w) - 3)].rstrip()
            if j == 2:
                t = " ".join(x if rng.random() > 1 / 40 else x + "s" for x in t.split(" "))
            rows.append((1000 * (j + 1) + i, t))
    want = set()
    for uid, t in rows[150:]:
        if any(C.goes_on(t, b) and C.holds(t, b, {}) for b in (wholes[uid % 1000], *(x for u, x in rows[150:] if u != uid and u % 1000 == uid % 1000))):
            want.add(uid)
    got = {r.uid for r in C.cut_copies(spark.createDataFrame(rows, "uid long, body string")).collect()}
    print("recall", len(got & want) / len(want), "of", len(want))
    assert got <= want and len(got & want) >= 0.95 * len(want) and len(want) > 350


def test_nothing_is_too_long_or_too_deep(spark):
    """Words cut behind 60 letters, closing lines of 80 letters, six of them."""
    rng = random.Random(3)
    path = "/".join(["scaffold"] * 9)
    close = ["kind regards", "the desk of the assembly group " + "x" * 50, "room 5", "building 3", "campus north", "planet earth"]
    rows = [(i, text_of(rng) + "\n\n" + "\n".join(close)) for i in range(60)] + [(i, text_of(rng)) for i in range(60, 120)]
    rows += [(200 + i, f"{text_of(rng)}\n\nsee {path}/contigs.") for i in range(20)]
    rows += [(300, f"{text_of(rng)}\n\nThis run confirms\n" + "\n".join(close)), (301, f"{text_of(rng)}\n\nsee {path}/con")]
    got = judged(spark, rows)
    assert {i for i, (c, _) in got.items() if c} == {300, 301}


def test_truncation_of_nothing(spark):
    assert C.truncated(spark.createDataFrame([], "id long, src string, text string"), "id", "src", "text").count() == 0
