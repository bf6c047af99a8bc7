import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwatch.functions import vectors
from driftwatch.operators import anomaly, evaluate, velocity

T0 = datetime.datetime(2024, 1, 1)


def frame(spark, series: dict[str, list[list[np.ndarray]]]):
    """series: key -> hours -> vectors."""
    rows = []
    for key, hours in series.items():
        for h, vecs in enumerate(hours):
            rows += [(key, T0 + datetime.timedelta(hours=h, minutes=i % 60), [float(x) for x in v]) for i, v in enumerate(vecs)]
    return spark.createDataFrame(rows, "key string, ts timestamp, emb array<double>")


def expected(hours):
    """Velocity of one key in numpy."""
    cents = []
    for vecs in hours:
        c = np.mean(np.stack(vecs), axis=0)
        n = np.linalg.norm(c)
        cents.append(c / n if n > 1e-9 else c)
    d = [round(1 - max(-1.0, min(1.0, float(a @ b))), 6) for a, b in zip(cents, cents[1:])]
    cur, hist = d[-1], d[:-1]
    avg = np.mean(hist) if hist else cur
    std = np.std(hist) if len(hist) > 1 else 1e-7
    z = (cur - avg) / max(std, 1e-7)
    drift = sum(d[-6:])
    alert = drift > 0.8 and len(d[-6:]) >= 3
    status = "spike" if z > 3 else "cumulative_drift" if alert else "elevated" if z > 1.5 else "normal"
    return d, avg, z, drift, status


def run(spark, series, hours=400):
    df = frame(spark, series)
    as_of = F.lit(T0 + datetime.timedelta(hours=hours))
    return {r["key"]: r for r in velocity.semantic_velocity(df, "key", "ts", "emb", as_of, hours).collect()}


def scenarios():
    rng = np.random.default_rng(42)
    dim = 32
    base = rng.normal(size=dim)
    quiet = [base + rng.normal(size=dim) * 0.02 for _ in range(47)]
    out = {
        "gradual": [base + rng.normal(size=dim) * 0.005 for _ in range(48)],
        "sudden": quiet + [rng.normal(size=dim) * 10],
        "constant": [base] * 48,
        "oscillating": [rng.normal(size=dim) * 8 if i % 4 == 0 else base + rng.normal(size=dim) * 0.01 for i in range(48)],
        "slow": [base + rng.normal(size=dim) * (i / 60) * 0.6 for i in range(120)],
        "zero": [np.zeros(dim), base, base, np.zeros(dim)],
    }
    return {k: [[v] for v in s] for k, s in out.items()}


def test_scenarios(spark):
    series = scenarios()
    got = run(spark, series)
    for key, hours in series.items():
        d, avg, z, drift, status = expected(hours)
        row = got[key]
        assert row["hourly_distances"] == pytest.approx(d, abs=2e-6)
        assert row["baseline_distance"] == pytest.approx(avg, abs=2e-6)
        assert row["cumulative_drift"] == pytest.approx(drift, abs=1e-5)
        assert row["status"] == status, key
    assert got["sudden"]["status"] == "spike" and got["constant"]["status"] == "normal"
    assert got["oscillating"]["status"] == "cumulative_drift"
    spikes = anomaly.velocity_anomalies(
        velocity.semantic_velocity(frame(spark, series), "key", "ts", "emb", F.lit(T0 + datetime.timedelta(hours=400)), 400), "key", F.lit(T0)
    ).collect()
    assert [s["collection_name"] for s in spikes] == ["sudden"] and spikes[0]["severity"] == "CRITICAL"
    assert spikes[0]["description"].startswith("SEMANTIC SPIKE in 'sudden'")


def test_mean_per_hour_and_gaps(spark):
    rng = np.random.default_rng(1)
    hours = [[rng.normal(size=8) for _ in range(n)] for n in (8, 3, 0, 5, 1, 7)]
    row = run(spark, {"k": hours})["k"]
    d, *_ = expected([h for h in hours if h])
    assert row["hourly_distances"] == pytest.approx(d, abs=2e-6)


def test_insufficient(spark):
    got = run(spark, {"one_doc": [[np.ones(4)]], "one_hour": [[np.ones(4)] * 5]})
    assert {r["status"] for r in got.values()} == {"insufficient_data"}
    assert all(r["velocity_ratio"] == 1.0 and r["hourly_distances"] == [] for r in got.values())


def test_unequal_lengths_fail(spark):
    with pytest.raises(Exception):
        run(spark, {"k": [[np.ones(4), np.ones(5)], [np.ones(4)]]})


def test_lookback(spark):
    df = frame(spark, {"k": [[np.eye(6)[i]] for i in range(6)]})
    as_of = F.lit(T0 + datetime.timedelta(hours=5))
    row = velocity.semantic_velocity(df, "key", "ts", "emb", as_of, 2).first()
    assert len(row["hourly_distances"]) == 2


def test_backtest(spark):
    """Clean windows stay quiet, windows with a foreign last hour alarm."""
    rng = np.random.default_rng(42)
    clean, poison = rng.normal(size=16), rng.normal(size=16)
    rows = []
    for trial in range(40):
        bad = trial % 2 == 1
        for h in range(8):
            center = poison if bad and h == 7 else clean
            for _ in range(8):
                v = center + rng.normal(size=16) * 0.3
                rows.append(("k", trial, bad, T0 + datetime.timedelta(hours=h), [float(x) for x in v]))
    df = spark.createDataFrame(rows, "key string, trial int, bad boolean, ts timestamp, emb array<double>")
    r = velocity.backtest_velocity(df, "key", "trial", "bad", "ts", "emb", F.lit(T0 + datetime.timedelta(hours=8)), 8).first()
    assert r["tp"] == 20 and r["fn"] == 0 and r["fp"] <= 2


def test_cosine_variants(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0], [0.0, 0.0])], "a array<double>, b array<double>, o array<double>")
    r = df.select(
        vectors.cosine_distance(F.col("a"), F.col("b")), vectors.cosine_distance(F.col("a"), F.col("o")),
        vectors.unit_cosine_distance(F.col("a"), F.col("o")), vectors.cosine_distance(F.col("b"), F.col("b")),
    ).first()
    assert list(r) == [1.0, 0.0, 1.0, 0.0]


def test_peak(spark):
    values = [1.0, 1.1, 0.9, 5.0, 1.0, -0.2]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)] + [("flat", i, 2.0) for i in range(3)], "key string, i int, v double")
    got = {r["key"]: r for r in velocity.peak_zscore(df, "key", "i", "v").collect()}
    z = np.abs((np.array(values) - np.mean(values)) / np.std(values))
    assert got["k"]["peak_at"] == z.argmax() and got["k"]["peak_z"] == pytest.approx(z.max())
    assert got["flat"]["peak_z"] == 0.0


def test_evaluate_guards(spark):
    df = spark.createDataFrame([(False, False)] * 3, "t boolean, p boolean")
    r = evaluate.evaluate(df, F.col("t"), F.col("p")).first()
    assert (r["tn"], r["precision"], r["recall"], r["f1"], r["fpr"], r["fnr"]) == (3, 0.0, 0.0, 0.0, 0.0, 0.0)
