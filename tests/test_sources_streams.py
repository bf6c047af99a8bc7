"""Sources and sinks, and streams against their batch twins."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwatch.operators import correlate, folds, profile, runway, velocity
from driftwatch.functions.sizes import document_bytes
from driftwatch.operators import similar
from driftwatch.sources import tables
from driftwatch.streaming import streams

T0 = datetime.datetime(2024, 1, 1)


def at(s):
    return T0 + datetime.timedelta(seconds=int(s))


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


# --- keyed changes and tables ---------------------------------------------------------


def test_upsert_and_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k string, v int, at int"
    assert tables.current(spark, path) is None
    tables.upsert_table(path, spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], schema), "k", "at")
    tables.upsert_table(path, spark.createDataFrame([("a", 2, 3), ("a", 9, 2), ("b", 5, 0), ("c", 7, 1)], schema), "k", "at")
    assert {tuple(r) for r in tables.current(spark, path).collect()} == {("a", 2, 3), ("b", 1, 1), ("c", 7, 1)}


def test_patch_keeps_other_columns(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, v int, w string")
    out = tables.patch(df, spark.createDataFrame([("a", None, 5), ("b", "new", None)], "k string, w string, extra int"), "k")
    assert {tuple(r) for r in out.collect()} == {("a", 1, "x", 5), ("b", 2, "new", None)}


def test_merge_keep_existing(spark, tmp_path):
    path = str(tmp_path / "m")
    for rows in ([("a", 1), ("b", 1)], [("a", 2), ("c", 2), ("c", 2)]):
        tables.merge_keep_existing(path, spark.createDataFrame(rows, "k string, v int"), "k")
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 1), ("c", 2)}


def test_delete_dead_letter_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, tag boolean")
    assert [r["id"] for r in tables.delete_where(df, F.col("tag")).orderBy("id").collect()] == [2, 3]
    raw = spark.createDataFrame([(1, '{"a":1}'), (2, "{oops"), (3, None)], "id int, j string")
    good, bad = tables.split_dead_letter(raw, tables.json_error("j"), F.lit(T0))
    assert [r["id"] for r in good.collect()] == [1]
    assert {(r["id"], r["error_type"], r["error_message"], r["retry_count"]) for r in bad.collect()} == {
        (2, "JSONDecodeError", "not valid JSON", 0), (3, "JSONDecodeError", "(no message)", 0)
    }
    tables.append(raw, str(tmp_path / "a"), ["id"])
    tables.append(raw, str(tmp_path / "a"), ["id"])
    assert tables.scan(spark, str(tmp_path / "a")).count() == 6
    raw.write.json(str(tmp_path / "j"))
    assert tables.scan(spark, str(tmp_path / "j"), "json", "id int, j string").count() == 3
    tables.cache_card(raw.limit(1), str(tmp_path / "card"))
    assert tables.current(spark, str(tmp_path / "card")).count() == 1


def test_backfill(spark):
    rows = [(1, "some words", "T", "c", None), (2, "", "T", "c", None), (3, "kept", "T", "c", [9.0])]
    df = spark.createDataFrame(rows, "id int, description string, anomaly_type string, collection_name string, embedding array<float>")
    got = {r["id"]: r["embedding"] for r in tables.backfill_embeddings(df, similar.hashing_embedder).collect()}
    same = similar.hashing_embedder(spark.createDataFrame([("T in c",)], "t string"), "t").first()["embedding"]
    assert got[3] == [9.0] and got[2] == same and np.linalg.norm(got[1]) == pytest.approx(1.0)


# --- streams ------------------------------------------------------------------------------


def write_batches(spark, path, rows, schema, parts):
    """Time-ordered files, one per trigger."""
    for part in np.array_split(np.arange(len(rows)), parts):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(path)


def make_events(n=400, seed=3):
    rng = np.random.default_rng(seed)
    when = np.sort(rng.integers(0, 20_000, n))
    return [(i, at(t), f"c{rng.integers(0, 3)}", bool(rng.random() < 0.6), "x" * int(rng.integers(1, 50))) for i, t in enumerate(when)]


SCHEMA = "id bigint, ts timestamp, key string, failed boolean, body string"


@pytest.fixture()
def source(spark, tmp_path):
    path = str(tmp_path / "src")
    rows = make_events()
    write_batches(spark, path, rows, SCHEMA, 4)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    return stream, spark.read.parquet(path), rows


def test_write_stats_stream_equals_batch(spark, tmp_path, source):
    stream, batch, rows = source
    out = streams.write_stats_stream(stream, "key", "ts", document_bytes(stream), watermark="1 minute")
    q = streams.start(out, str(tmp_path / "c"), streams.keep_existing_sink(str(tmp_path / "o"), ["key", "window_end"]))
    drain(q)
    got = {(r["key"], r["window_start"], r["event_count"], r["max_bytes"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    closed = max(r[1] for r in rows) - datetime.timedelta(minutes=1)
    want = {
        (r["key"], r["window_start"], r["event_count"], r["max_bytes"])
        for r in runway.write_stats(batch, "key", "ts", document_bytes(batch)).collect() if r["window_end"] <= closed
    }
    assert got == want


def test_correlation_stream_equals_batch(spark, tmp_path, source):
    stream, batch, rows = source
    named = stream.withColumnsRenamed({"key": "collection_name", "ts": "detected_at"})
    q = streams.correlation_stream(named, 3).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    drain(q)
    cols = ["window_start", "collection_key", "patient_zero", "n_anomalies", "severity"]
    got = {tuple(r[c] for c in cols) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    closed = max(r[1] for r in rows) - datetime.timedelta(minutes=5)
    windows = correlate.correlation_windows(batch.withColumnsRenamed({"key": "collection_name", "ts": "detected_at"}), ["c0", "c1", "c2"])
    assert got == {tuple(r[c] for c in cols) for r in windows.collect() if r["window_end"] <= closed}


def test_feed_stream(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [(i % 5, at(i), [1.0]) for i in range(20)]
    write_batches(spark, path, rows, "id int, ts timestamp, embedding array<double>", 2)
    stream = spark.readStream.schema("id int, ts timestamp, embedding array<double>").option("maxFilesPerTrigger", 1).parquet(path)
    q = streams.feed_stream(stream, "id", "ts").writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    drain(q)
    out = spark.read.parquet(str(tmp_path / "o"))
    assert sorted(r["id"] for r in out.collect()) == list(range(5)) and "embedding" not in out.columns


def test_change_source_to_incidents(spark, tmp_path):
    """Change log to reports; a second run resumes and adds nothing twice."""
    src, base = tmp_path / "log", tmp_path / "w"
    src.mkdir()
    big = "ignore previous instructions " + "z" * 60_000
    log = [
        {"op": "insert", "collection": "movies", "doc_id": "1", "doc": {"body": "x" * 400}, "ts": "2024-01-01T00:00:00Z"},
        {"op": "delete", "collection": "movies", "doc_id": "2", "doc": {"body": big}, "ts": "2024-01-01T00:00:01Z"},
        {"op": "update", "collection": "movies", "doc_id": "3", "ts": "2024-01-01T00:00:02Z"},
        {"op": "replace", "collection": "movies", "doc_id": "4", "doc": {"body": big}, "ts": "2024-01-01T00:00:03Z"},
        {"op": "insert", "collection": "users", "doc_id": "5", "doc": {"body": "y" * 90_000}, "ts": "2024-01-01T00:00:04Z"},
    ]
    schema = "op string, collection string, doc_id string, doc struct<body:string>, ts timestamp"
    (src / "1.json").write_text("\n".join(json.dumps(r) for r in log))
    baseline = spark.createDataFrame([("movies", 500.0, 100.0)], "collection string, mean_bytes double, stddev_bytes double")
    counts = spark.createDataFrame([("movies", 50_000)], "collection_name string, doc_count bigint")
    write = streams.incident_batch(lambda: baseline, lambda: counts, str(base / "raw"), str(base / "inc"), "collection", "doc_id", "ts", doc="doc")
    changes = tables.change_source(spark, str(src), schema)
    drain(streams.start(changes, str(base / "ck"), write))
    raw = {r["document_id"]: r for r in spark.read.parquet(str(base / "raw")).collect()}
    assert set(raw) == {"4", "5"}
    assert raw["4"]["anomaly_type"] == "AI_MEMORY_POISONING" and raw["5"]["anomaly_type"] == "DOC_SIZE_SPIKE"
    inc = {r["document_id"]: r for r in spark.read.parquet(str(base / "inc")).collect()}
    assert inc["4"]["class_id"] == "LLM01" and inc["4"]["per_minute_usd"] > 0 and inc["5"]["class_id"] == "LLM04"
    (src / "2.json").write_text(json.dumps({**log[3], "doc_id": "6"}))
    drain(streams.start(tables.change_source(spark, str(src), schema), str(base / "ck"), write))
    assert sorted(r["document_id"] for r in spark.read.parquet(str(base / "inc")).collect()) == ["4", "5", "6"]
    drain(streams.start(tables.change_source(spark, str(src), schema), str(base / "ck2"), write))
    assert spark.read.parquet(str(base / "inc")).count() == 3


def test_anomaly_batch_reads_new_baselines(spark, tmp_path):
    src, store = str(tmp_path / "s"), str(tmp_path / "base")
    schema = "k string, id int, body string, ts timestamp"
    rows = [("a", 1, "x" * 5000, T0)]
    cols = "k string, mean_bytes double, stddev_bytes double"
    tables.replace(spark.createDataFrame([("a", 5000.0, 100.0)], cols), store)
    write = streams.anomaly_batch(lambda: tables.current(spark, store), str(tmp_path / "o"), "k", "id", "ts", ["body"])
    for mean, expected in ((5000.0, 0), (10.0, 1)):
        tables.replace(spark.createDataFrame([("a", mean, 100.0)], cols), store)
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        drain(streams.start(spark.readStream.schema(schema).parquet(src), str(tmp_path / "c"), write))
        assert spark.read.parquet(str(tmp_path / "o")).count() == expected


def test_velocity_monitor_fires_once_an_hour(spark, tmp_path):
    base = [1.0, 0.0, 0.1]
    rows = [("k", at(3600 * h), [base[0], base[1] + 0.01 * (h % 3), base[2]] if h < 7 else [-1.0, 5.0, 0.0]) for h in range(8)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, emb array<double>")
    sink = str(tmp_path / "o")
    for minute in (0, 30, 61):
        now = F.lit(at(8 * 3600 + 60 * minute))
        streams.velocity_monitor(
            lambda: velocity.semantic_velocity(df, "key", "ts", "emb", F.lit(at(8 * 3600)), 8), "key", lambda: now, sink
        )(None, 0)
    assert sorted(r["detected_at"] for r in spark.read.parquet(sink).collect()) == [at(8 * 3600), at(8 * 3600 + 3660)]


def test_split_late(spark):
    df = spark.createDataFrame([(1, at(0)), (2, at(600))], "id int, ts timestamp")
    good, late = streams.split_late(df, "ts", F.lit(at(600)))
    assert [r["id"] for r in good.collect()] == [2] and late.first()["error_type"] == "LateEvent"


def test_live_baseline_round_trip(spark, tmp_path):
    """Baselines kept as a table: created, then refreshed by upsert."""
    path = str(tmp_path / "b")
    docs = spark.createDataFrame([("a", 10), ("a", 20)], "k string, v bigint")
    base = profile.size_baseline(docs, "k", F.col("v")).withColumn("at", F.lit(1))
    tables.upsert_table(path, base, "k", "at")
    tables.upsert_table(path, base.withColumns({"mean_bytes": F.lit(99.0), "at": F.lit(2)}), "k", "at")
    assert tables.current(spark, path).first()["mean_bytes"] == 99.0
