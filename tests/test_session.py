"""Size checks: what is broadcast, what is spread, what is left alone."""

import os
import subprocess
import sys

import pytest

from driftwatch import session


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bounded(spark):
    big = spark.range(1000)
    small = spark.range(10).withColumnRenamed("id", "k")
    joined = big.join(session.bounded(small, 10), big["id"] == small["k"], "left")
    assert "broadcast" in plan_of(joined)
    joined = big.join(session.bounded(small, 9), big["id"] == small["k"], "left")
    assert "strategy=broadcast" not in plan_of(joined)


def test_spread_small_only(spark, tmp_path, monkeypatch):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert "RepartitionByExpression" in plan_of(session.spread(df)) or "Repartition " in plan_of(session.spread(df))
    monkeypatch.setattr(session, "estimated_bytes", lambda _: 10**15)
    assert session.spread(df) is df


def test_workers_need_no_package(spark, tmp_path):
    """Python tasks run where the package is not on the path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from driftwatch.session import get_spark\n"
        "from driftwatch.plans.queries import QUERIES\n"
        "s = get_spark('w', '2', **{'spark.sql.shuffle.partitions': '2'})\n"
        "print('rows', QUERIES['rate_limit'](s, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 1000" in out.stdout, out.stderr[-2000:]


@pytest.mark.parametrize("key,want", [("a", ["a"]), (["a", "b"], ["a", "b"]), (("a",), ["a"])])
def test_keys(key, want):
    assert session.keys_of(key) == want
