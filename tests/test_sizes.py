import datetime
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwatch.functions.sizes import document_bytes, index_digits
from driftwatch.operators import profile


def encoded(value) -> bytes:
    """The public document layout for the types used below."""
    if isinstance(value, dict):
        body = b""
        for k, v in value.items():
            if v is None:
                body += b"\x0a" + k.encode() + b"\x00"
            else:
                body += b"\x01" + k.encode() + b"\x00" + encoded(v)
        return struct.pack("<i", len(body) + 5) + body + b"\x00"
    if isinstance(value, (list, tuple)):
        return encoded({str(i): v for i, v in enumerate(value)})
    if isinstance(value, str):
        return struct.pack("<i", len(value.encode()) + 1) + value.encode() + b"\x00"
    if isinstance(value, bool):
        return b"\x01"
    if isinstance(value, bytes):
        return struct.pack("<i", len(value)) + b"\x00" + value
    if isinstance(value, int):
        return struct.pack("<q", value)
    if isinstance(value, float):
        return struct.pack("<d", value)
    if isinstance(value, datetime.datetime):
        return b"\x00" * 8
    raise TypeError(value)


def test_document_bytes(spark):
    schema = (
        "s string, n bigint, d double, b boolean, t timestamp, raw binary, tags array<string>, xs array<double>, "
        "o struct<name:string,inner:struct<k:bigint>>, os array<struct<name:string,q:bigint>>, m map<string,string>"
    )
    now = datetime.datetime(2024, 1, 1)
    docs = [
        {
            "s": "héllo", "n": 5, "d": 1.5, "b": True, "t": now, "raw": b"abc", "tags": ["a", None, "ççç"] * 7,
            "xs": [float(i) for i in range(1234)], "o": {"name": "x", "inner": {"k": 1}},
            "os": [{"name": "a", "q": 1}, {"name": "bb", "q": 2}], "m": {"a": "1", "bb": "22"},
        },
        {"s": "", "n": 0, "d": 0.0, "b": False, "t": now, "raw": b"", "tags": [], "xs": [], "o": {"name": "", "inner": {"k": 0}}, "os": [], "m": {}},
    ]
    df = spark.createDataFrame(docs, schema)
    got = [r[0] for r in df.select(document_bytes(df)).collect()]
    assert got == [len(encoded(d)) for d in docs]


def test_variant_bytes(spark):
    docs = [
        {}, {"a": None, "b": True, "s": "héllo", "x": 1.5, "e": {}, "l": []},
        {"n": {"m": {"k": ["a", {"z": "deep"}, [None, "q"]]}}, "tags": [str(i) for i in range(120)]},
    ]
    whole = {"small": 5, "big": 2**40}
    rows = [(i, json.dumps(d)) for i, d in enumerate([*docs, whole])] + [(9, None)]
    df = spark.createDataFrame(rows, "i int, j string").withColumn("doc", F.parse_json("j"))
    got = [r[0] for r in df.orderBy("i").select(document_bytes(df, doc="doc")).collect()]
    assert got == [len(encoded(d)) for d in docs] + [len(encoded(whole)) - 4, None]
    deep = 1
    for _ in range(40):
        deep = {"a": deep}
    d = spark.createDataFrame([(json.dumps(deep),)], "j string").withColumn("doc", F.parse_json("j"))
    assert d.select(document_bytes(d, doc="doc")).first()[0] == len(encoded(deep)) - 4


def test_missing_and_null(spark):
    df = spark.createDataFrame([("a", None)], "s string, n bigint")
    missing = df.select(document_bytes(df)).first()[0]
    null = df.select(document_bytes(df, null_as="null")).first()[0]
    assert missing == len(encoded({"s": "a"}))
    assert null == len(encoded({"s": "a", "n": None}))


def test_index_digits(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 9, 10, 11, 100, 101, 1234, 100001)], "n bigint")
    for n, got in df.select("n", index_digits(F.col("n"))).collect():
        assert got == sum(len(str(i)) for i in range(n))


@pytest.mark.parametrize("kind", ["small", "wide", "constant"])
def test_exact_percentiles(spark, kind):
    rng = np.random.default_rng(7)
    n = 4000
    values = {
        "small": rng.integers(0, 50, n),
        "wide": np.floor(np.exp(rng.normal(9, 3, n))).astype(int),
        "constant": np.full(n, 1_000_003),
    }[kind]
    keys = np.where(rng.random(n) < 0.7, "hot", "cold")
    df = spark.createDataFrame([(str(k), int(v)) for k, v in zip(keys, values)], "key string, v bigint")
    got = {r["key"]: r for r in profile.size_baseline(df, "key", F.col("v"), full=True).collect()}
    for key in set(keys):
        mine = values[keys == key].astype(float)
        row = got[str(key)]
        assert row["sample_count"] == len(mine)
        assert row["mean_bytes"] == pytest.approx(mine.mean(), rel=1e-12)
        assert row["stddev_bytes"] == pytest.approx(mine.std(ddof=1), rel=1e-9, abs=1e-9)
        for name, p in (("p50_bytes", 50), ("p95_bytes", 95), ("p99_bytes", 99)):
            assert row[name] == pytest.approx(np.percentile(mine, p), rel=1e-12)


def test_health_penalties(spark):
    rows = [("big", 100)] * 90 + [("big", 9_000_000)] * 10 + [("even", 1000)] * 50
    df = spark.createDataFrame(rows, "key string, v bigint")
    layout = spark.createDataFrame([("even", 2)], "key string, index_count int")
    got = {r["key"]: r for r in profile.health_card(df, "key", F.col("v"), layout).collect()}
    assert got["big"]["health_score"] == 10 - 3 - 2.5 - 2 - 1.5
    assert got["big"]["status"] == "CRITICAL" and len(got["big"]["issues"]) == 4
    assert got["even"]["health_score"] == 10.0 and got["even"]["status"] == "HEALTHY" and got["even"]["issues"] == []


def test_null_and_missing_types(spark):
    rows = [("a", '{"x": null}'), ("a", '{"x": 1}'), ("a", '{"x": "s", "y": [1]}'), ("a", '{"z": {"q": 1.5}}')]
    df = spark.createDataFrame(rows, "key string, j string").withColumn("doc", F.parse_json("j"))
    got = {r["field"]: r["types"] for r in profile.live_schema(df, "key", "doc").collect()}
    assert got == {"x": ["NoneType", "int", "str"], "y": ["list"], "z": ["dict"]}
    common = profile.live_schema(df, "key", "doc", min_share=0.5).collect()
    assert [r["field"] for r in common] == ["x"]
    report = profile.snapshot_report(profile.schema_snapshot(df, "key", "doc"), "key").first()["fields"]
    assert [(f["name"], f["count"]) for f in report] == [("x", 3), ("y", 1), ("z", 1)]
    assert report[0]["types"] == ["int", "null", "string"]
