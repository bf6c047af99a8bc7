"""Sequential rules against plain loops, with a hot key cut into many chunks."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwatch.operators import folds

START = datetime.datetime(2024, 1, 1)


def events(spark, seed, n=3000, span=90_000, keys=6, fail=0.5):
    """A third of all rows and more on one key; equal times occur."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(0, keys, n))
    at = rng.integers(0, span, n)
    failed = rng.random(n) < fail
    rows = [
        (f"k{k}", START + datetime.timedelta(seconds=int(t)), i, bool(f)) for i, (k, t, f) in enumerate(zip(key, at, failed))
    ]
    return rows, spark.createDataFrame(rows, "key string, ts timestamp, id bigint, failed boolean")


def per_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def loop_refire(rows, seconds):
    kept = set()
    for mine in per_key(rows).values():
        last = None
        for _, t, i, _ in mine:
            if last is None or (t - last).total_seconds() >= seconds:
                kept.add(i)
                last = t
    return kept


def loop_rate(rows, limit, seconds):
    admitted = set()
    for mine in per_key(rows).values():
        log = []
        for _, t, i, _ in mine:
            log = [x for x in log if (t - x).total_seconds() <= seconds]
            if len(log) < limit:
                log.append(t)
                admitted.add(i)
    return admitted


def loop_circuit(rows, failures, seconds):
    ran = set()
    for mine in per_key(rows).values():
        count, opened = 0, None
        for _, t, i, failed in mine:
            if count >= failures:
                if (t - opened).total_seconds() <= seconds:
                    continue
                count = 0
            ran.add(i)
            count = count + 1 if failed else 0
            if count >= failures:
                opened = t
    return ran


@pytest.mark.parametrize("seconds,chunks", [(60, 3), (600, 16), (20_000, 40)])
def test_refire(spark, seconds, chunks):
    rows, df = events(spark, 1)
    out = folds.fold_events(df, "key", "ts", "id", folds.refire_fold(seconds), "kept", chunks=chunks)
    got = {r["id"] for r in out.collect() if r["kept"]}
    assert got == loop_refire(rows, seconds)


@pytest.mark.parametrize("limit,seconds,chunks", [(3, 600, 16), (60, 3000, 16), (5, 40_000, 24)])
def test_rate_limit(spark, limit, seconds, chunks):
    rows, df = events(spark, 2)
    out = folds.fold_events(df, "key", "ts", "id", folds.rate_limit_fold(limit, seconds), "ok", chunks=chunks)
    assert {r["id"] for r in out.collect() if r["ok"]} == loop_rate(rows, limit, seconds)


@pytest.mark.parametrize("failures,seconds,chunks", [(3, 60, 16), (2, 5000, 24)])
def test_circuit(spark, failures, seconds, chunks):
    rows, df = events(spark, 3, fail=0.7)
    out = folds.fold_events(df, "key", "ts", "id", folds.circuit_fold(failures, seconds), "ran", "failed", chunks=chunks)
    assert {r["id"] for r in out.collect() if r["ran"]} == loop_circuit(rows, failures, seconds)


def test_hot_key_is_split(spark):
    """One key alone fills all chunks evenly."""
    rows, df = events(spark, 4, keys=1)
    out = folds.fold_events(df, "key", "ts", "id", folds.refire_fold(300), "kept", chunks=8)
    sizes = [r["n"] for r in out.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 0.3 * len(rows)
    assert {r["id"] for r in out.collect() if r["kept"]} == loop_refire(rows, 300)


def test_boundaries(spark):
    at = [0, 299, 300, 599, 600]
    rows = [("k", START + datetime.timedelta(seconds=s), i, False) for i, s in enumerate(at)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id bigint, failed boolean")
    checked = folds.throttle_checks(df, "key", "ts", "id").filter("checked = 1")
    assert sorted(r["id"] for r in checked.collect()) == [0, 2, 4]
    one = folds.rate_limit(df, "key", "ts", "id", 1, 300).filter("admitted = 1")
    assert sorted(r["id"] for r in one.collect()) == [0, 3]
