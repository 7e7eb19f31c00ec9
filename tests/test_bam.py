"""BAM files in splits of any size give every record once."""

import random

import pytest

from seqloom.sources.bam import _Reader, bam, records, write_bam


@pytest.fixture(scope="module")
def sample(tmp_path_factory):
    rng = random.Random(2)
    refs = [("chrA", 50_000), ("chrB", 40_000)]
    rows = []
    for i in range(9000):
        n = rng.randint(30, 120)
        rows.append((f"read{i}", rng.choice([0, 16, 99]), rng.choice(refs)[0], rng.randint(1, 39_000), rng.randint(0, 60), f"{n}M", "=", rng.randint(1, 39_000), rng.randint(-500, 500), "".join(rng.choice("ACGTN") for _ in range(n)), "".join(chr(rng.randint(35, 70)) for _ in range(n))))
    rows.sort(key=lambda r: (r[2], r[3]))
    path = str(tmp_path_factory.mktemp("bam") / "x.bam")
    write_bam(path, refs, rows, is_sorted=True)
    return path, rows


@pytest.mark.parametrize("split", [70_000, 123_457, 1 << 25])
def test_splits(spark, sample, split):
    path, rows = sample
    df = bam(spark, path, split)
    assert df.rdd.getNumPartitions() > (1 if split < 1 << 20 else 0)
    assert sorted(map(tuple, df.collect())) == sorted(rows) == sorted(records(path))


def test_regions(spark, sample):
    path, rows = sample
    df = bam(spark, path, 50_000)
    want = sorted(r for r in rows if r[2] == "chrB" and 1000 <= r[3] < 2000)
    assert sorted(map(tuple, df.where("rname = 'chrB' AND pos >= 1000 AND pos < 2000").collect())) == want and want
    assert df.where("rname = 'chrA' AND rname = 'chrB'").count() == 0 and df.where("rname = 'chrC'").count() == 0
    assert df.where("rname = 'chrA' AND pos = 5").count() == sum(r[2] == "chrA" and r[3] == 5 for r in rows)
    reader = _Reader(path, 50_000)
    reader.names, reader.low, reader.high = {"chrB"}, 1000, 1999
    assert 1 <= len(reader.partitions()) < len(_Reader(path, 50_000).partitions()) / 3
