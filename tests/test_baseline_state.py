"""Baselines merged from loads against the exact ones over everything."""

import random

import pytest
from pyspark.sql import functions as F

from driftwatch.operators import baseline_state, profile


def test_loads_merge_to_the_whole(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "b", None]), int(rng.lognormvariate(6, 1))) for _ in range(20_000)] + [("hot", 777)] * 5000 + [("one", 5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, bytes long").withColumn("load", F.pmod(F.hash("bytes", "k"), F.lit(4)))
    path = str(tmp_path / "s")
    for tag in range(4):
        assert baseline_state.add_documents(path, df.where(F.col("load") == tag), "k", tag, F.col("bytes"))
    assert not baseline_state.add_documents(path, df, "k", 3, F.col("bytes"))
    got = {r["k"]: r for r in baseline_state.baseline_of_state(spark, path, "k").collect()}
    want = {r["k"]: r for r in profile.size_baseline(df.where("bytes IS NOT NULL"), "k", F.col("bytes"), full=True).collect()}
    assert set(got) == set(want) == {"hot", "b", None, "one"}
    for k, exact in want.items():
        for c in ("sample_count", "min_bytes", "max_bytes"):
            assert got[k][c] == exact[c]
        for c in ("mean_bytes", "stddev_bytes", "critical_threshold_bytes"):
            assert got[k][c] == (pytest.approx(exact[c], rel=1e-9) if exact[c] is not None else None)
        values = sorted(v for name, v in rows if name == k and v is not None)
        for name, p in baseline_state.QUANTILES.items():
            below = sum(v < got[k][name] for v in values) / len(values)
            upto = sum(v <= got[k][name] for v in values) / len(values)
            assert below - baseline_state.RANK_ERROR <= p <= upto + baseline_state.RANK_ERROR
