"""k-mers joined with each other."""

import pytest

from seqloom.operators import kmers as K


@pytest.mark.parametrize("f", [K.overlap_candidates, K.shared_counts])
def test_kmers_are_not_broadcast(spark, tmp_path, f):
    """The table is small, its k-mers aren't."""
    spark.createDataFrame([("g", "x", "ACGTTGCAACGGATCCTAGA"), ("g", "y", "TGCAACGGATCCTAGATTTT"), ("h", "z", "TGCAACGGATCCTAGATTTT")], "gap string, name string, seq string").write.parquet(str(tmp_path / "c"))
    out = f(spark.read.parquet(str(tmp_path / "c")), "gap", "name", "seq")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.a, r.b) for r in out.where("a < b").collect()} == {("x", "y")}
