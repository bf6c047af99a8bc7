"""Routing to two sinks and sequential rules in event time: files out of order, late and bad rows, replays, restarts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from driftwatch.operators import folds
from driftwatch.sources import tables
from driftwatch.streaming import event_folds, routing, streams

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc).replace(tzinfo=None)
SCHEMA = "key string, ts timestamp, id int, failed boolean"


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def events(n=300, seed=4):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["b", None]
    # a long silence in the middle, in which every rule forgets
    return [(rng.choice(keys), at(rng.randint(0, 6000) + (50_000 if i % 2 else 0)), i, rng.random() < 0.5) for i in range(n)]


def feed(spark, base, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")


def route(spark, base, rows, watermark, error=None):
    streams.start(feed(spark, base, rows), f"{base}/routed", routing.route_batches(base, "ts", error, watermark)).awaitTermination()


@pytest.mark.parametrize(
    "fold", [folds.refire_fold(900), folds.rate_limit_fold(5, 1200), folds.circuit_fold(2, 600)], ids=["refire", "rate", "circuit"]
)
def test_stream_out_of_order_equals_batch(spark, tmp_path, fold):
    """Four shuffled files, the reader stopped and resumed after each: the same decisions as one batch."""
    base, rows = str(tmp_path), events()
    schema = spark.createDataFrame([], SCHEMA).schema
    for i in range(4):
        route(spark, base, rows[i::4], "20 hours")
        if i == 3:
            routing.close_stream(spark, base, schema, "ts", watermark="20 hours")
        df = routing.accepted_stream(spark, base, schema, "ts", "id", "20 hours")
        out = streams.fold_stream(df, "key", "ts", "id", fold, "ok", "failed")
        with event_folds.timer_state(spark):
            q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r["key"] or "", r["id"], r["ok"]) for r in spark.read.parquet(f"{base}/out").collect())
    batch = folds.fold_events(spark.createDataFrame(rows, SCHEMA), "key", "ts", "id", fold, "ok", "failed", chunks=3)
    assert got == sorted((r["key"] or "", r["id"], r["ok"]) for r in batch.collect())
    assert len(got) == len(rows)
    # all buffers are empty and all rules forgotten, but for a circuit that counts failures
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert left <= (12 if not hasattr(fold, "memory") else 6)


def test_rows_go_to_one_of_two_sinks(spark, tmp_path):
    base = str(tmp_path)
    bad = F.when(F.col("id") < 0, F.struct(F.lit("NegativeId").alias("error_type"), F.lit("").alias("error_message")))
    route(spark, base, [("a", at(1000), 1, False), ("a", None, 2, False), ("a", at(5), -3, False)], "1 minute", bad)
    route(spark, base, [("a", at(940), 4, False), ("a", at(941), 5, False), ("a", at(2000), 6, False), ("a", at(9), -7, False)], "1 minute", bad)
    # what an all-bad batch holds
    route(spark, base, [("a", at(1), 8, False)], "1 minute", bad)
    kept = spark.read.parquet(f"{base}/accepted")
    assert sorted(r["id"] for r in kept.collect()) == [1, 5, 6]
    dead = {r["id"]: (r["error_type"], r["error_message"]) for r in routing.dead_letters(spark, base).collect()}
    assert dead == {
        2: routing.NO_TIME, -3: ("NegativeId", "(no message)"), 4: routing.LATE, -7: ("NegativeId", "(no message)"), 8: routing.LATE,
    }
    book = routing.ledger(spark, base).orderBy("batch").collect()
    assert [(r["accepted"], r["dead"], r["newest"]) for r in book] == [(1, 2, at(1000)), (2, 2, at(2000)), (0, 1, at(2000))]


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    base = str(tmp_path)
    write = routing.route_batches(base, "ts", None, "1 minute")
    batch = spark.createDataFrame([("a", at(10), 1, False), ("a", None, 2, False)], SCHEMA)
    write(batch, 0)
    write(batch, 0)
    # stopped after the first sink: the second try completes the batch and keeps what is there
    tables.write_once(batch.where("id = 1"), f"{base}/accepted/batch=000000001")
    write(batch.withColumn("ts", F.lit(at(99))), 1)
    assert spark.read.parquet(f"{base}/accepted").count() == 2
    assert routing.dead_letters(spark, base).count() == 1
    assert routing.ledger(spark, base).count() == 2
    assert not [p for p in (tmp_path / "accepted").iterdir() if p.name.startswith("_")]


def test_close_stream_without_rows(spark, tmp_path):
    routing.close_stream(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema, "ts")
    assert not tables.table_exists(spark, f"{tmp_path}/accepted")


def test_cluster_events_and_refires_in_one_query(spark, tmp_path):
    base = str(tmp_path)
    rows = [(c, at(s), i, False) for i, (c, s) in enumerate([("a", 0), ("b", 30), ("a", 600), ("b", 610), ("c", 620), ("a", 9000), ("b", 9001)])]
    schema = spark.createDataFrame([], SCHEMA).schema
    route(spark, base, rows[::2], "1 hour")
    route(spark, base, rows[1::2], "3 hours")
    routing.close_stream(spark, base, schema, "ts", watermark="3 hours")
    named = routing.accepted_stream(spark, base, schema, "ts", "id", "3 hours").withColumnRenamed("key", "collection_name")
    with event_folds.timer_state(spark):
        q = streams.correlated_refires_stream(named, 3, "ts").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["collection_key"], r["window_end"]) for r in spark.read.parquet(f"{base}/out").collect())
    assert [k for k, _ in got] == ["a|b", "a|b", "a|b|c"]
    assert got[1][1] - got[0][1] >= datetime.timedelta(hours=1)


@pytest.mark.parametrize("name", ["stream_anomalies", "stream_changes"])
def test_streams_of_tables_in_folders(spark, tmp_path, name):
    """A table of several files in a folder gives the rows of the same table in one file."""
    from driftwatch.streaming import jobs

    for table in ("documents", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    got, wanted = (jobs.QUERIES[name](spark, folder).collect() for folder in (str(tmp_path), "/root/testdata/sf0.001"))
    assert got and sorted(map(str, got)) == sorted(map(str, wanted))


def test_streams_take_deliveries_of_many_files(spark, tmp_path, monkeypatch):
    """No step of a feed runs in one task: each delivery is several files and one batch, in whatever order ids have."""
    from driftwatch.streaming import jobs

    base = str(tmp_path)
    monkeypatch.setattr(jobs, "checkpoint_dir", lambda _: base)
    # ids run against time, and the span is months
    rows = [("hot" if i % 3 else None, at((3000 - i) * 3000), i, False) for i in range(3000)]
    events = spark.createDataFrame(rows, SCHEMA).repartition(4)
    keep = lambda df: streams.fold_stream(df, "key", "ts", "id", folds.rate_limit_fold(3, 20_000), "ok")
    out, _ = jobs.through_router(spark, events, keep, "ts", "id")
    got = sorted((r["key"] or "", r["id"], r["ok"]) for r in out.collect())
    batch = folds.fold_events(events, "key", "ts", "id", folds.rate_limit_fold(3, 20_000), "ok", chunks=3)
    assert got == sorted((r["key"] or "", r["id"], r["ok"]) for r in batch.collect())
    assert len(list(tmp_path.glob("streams/*/in/part-*"))) >= 2 * jobs.PARTS
