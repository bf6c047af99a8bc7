"""Streaming runs over the events table, as queries.

Each starts a stream on the table's files with ``availableNow``, waits for its
end, and returns what the sink holds. Sinks and checkpoints live under the
shared checkpoint folder of the session.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.functions.sizes import document_bytes
from driftwatch.operators import folds, profile
from driftwatch.plans.inputs import COLLECTION_OF_EVENT, MONITORED, SHARD_VECTOR_SPARK, as_of, vectors
from driftwatch.session import checkpoint_dir
from driftwatch.sources import tables
from driftwatch.streaming import routing, streams, velocity_state
from driftwatch.streaming.event_folds import timer_state


def _stream(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table as a stream, be it one file or a folder of files."""
    folder, _, name = path.rpartition("/")
    # the source takes a plain path for a folder; a pattern may name either
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{folder}/{{{name}}}")


def run(df: DataFrame, write=None, base: str | None = None) -> DataFrame:
    """Runs a stream to its end and reads the table it wrote; ``base`` holds the sink and the checkpoint of a stream that goes on."""
    spark = df.sparkSession
    base = base or f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    with timer_state(spark):
        if write is None:
            q = (
                df.writeStream.format("parquet").option("path", f"{base}/sink").option("checkpointLocation", f"{base}/log")
                .trigger(availableNow=True).start()
            )
        else:
            q = streams.start(df, f"{base}/log", write(f"{base}/sink"))
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/sink") if write is None else spark.read.parquet(f"{base}/sink")


# Every tenth event comes with one delivery too late.
PARTS = 6
PART_OF_ROW = "least(floor({share} * {parts}) + CASE WHEN {id} % 10 = 3 THEN 1 ELSE 0 END, {parts} - 1)"


def _parts(events: DataFrame, ts: str, row_id: str, watermark: str | None) -> tuple[Column, str]:
    """The number of the delivery an event comes with, and the delay that the events need.

    With a ``watermark`` the deliveries follow the ids. Without one they follow
    the time, and the delay is one delivery and a fifth, whatever the time span.
    """
    moment = F.unix_micros(F.col(ts).cast("timestamp"))
    rows, low, high = events.agg(F.count(F.lit(1)), F.min(moment), F.max(moment)).first()
    if watermark is not None:
        return F.expr(PART_OF_ROW.format(share=f"{row_id} / {max(rows, 1)}", parts=PARTS, id=row_id)), watermark
    span = (high - low if rows else 0) + 1
    share = f"(unix_micros(CAST({ts} AS TIMESTAMP)) - {low or 0}) / {span}"
    return F.expr(PART_OF_ROW.format(share=share, parts=PARTS, id=row_id)), f"{span * 6 // (PARTS * 5 * 1_000_000) + 1} seconds"


def through_router(
    spark: SparkSession, events: DataFrame, stream, ts: str, row_id: str, watermark: str | None = None, error=None, restart: bool = True
) -> tuple[DataFrame, str]:
    """Events in deliveries out of order, routed, read as a stream, stopped in between and resumed.

    ``stream`` turns the accepted stream into the result. The router takes one
    delivery, of as many files as its tasks write, and is started again from
    its checkpoint for the next; the reader is stopped after half of them.
    Returns the result and the router's folder.
    """
    base = f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    part, delay = _parts(events, ts, row_id, watermark)
    stops = {PARTS // 2 - 1, PARTS - 1} if restart else {PARTS - 1}
    out = None
    for i in range(PARTS):
        events.where(part == i).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        streams.start(source, f"{base}/routed", routing.route_batches(base, ts, error, delay)).awaitTermination()
        if i == PARTS - 1:
            routing.close_stream(spark, base, events.schema, ts, "1 hour", delay)
        if stream is not None and i in stops:
            out = run(stream(routing.accepted_stream(spark, base, events.schema, ts, row_id, delay)), base=f"{base}/out")
    return out, base


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def stream_write_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir)
    stats = lambda df: streams.write_stats_stream(df, "event_type", "ts", document_bytes(events), watermark=None)
    out, _ = through_router(spark, events, stats, "ts", "event_id")
    return out.select(
        "event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_count",
        F.round("mean_bytes", 6).alias("mean_bytes"), "max_bytes",
    )


def stream_refires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events out of order, in two runs of the stream: what the batch rule keeps."""
    keep = lambda df: streams.fold_stream(df, "event_type", "ts", "event_id", folds.refire_fold(), "kept")
    out, _ = through_router(spark, _table(spark, sf_dir), keep, "ts", "event_id")
    return out.filter("kept = 1").select("event_type", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = lambda df: streams.fold_stream(df, "event_type", "ts", "event_id", folds.refire_fold(1800), "checked")
    out, _ = through_router(spark, _table(spark, sf_dir), check, "ts", "event_id")
    return out.select("event_type", "event_id", "checked")


def stream_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir)
    ran = lambda df: streams.fold_stream(
        df.withColumn("failed", F.col("event_type").isin("error", "view", "click")), "user_id", "ts", "event_id", folds.circuit_fold(3, 86400), "ran", "failed"
    )
    out, _ = through_router(spark, events, ran, "ts", "event_id")
    return out.select("user_id", "event_id", "ran")


def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are late, have no time or are not JSON, by kind; all others are accepted."""
    events = _table(spark, sf_dir).withColumns(
        {
            "ts": F.expr("CASE WHEN event_id % 101 = 0 THEN NULL ELSE ts END"),
            "props": F.expr("CASE WHEN event_id % 103 = 0 THEN props || '}' ELSE props END"),
        }
    )
    _, base = through_router(spark, events, None, "ts", "event_id", "1 day", tables.json_error("props"), restart=False)
    return routing.dead_letters(spark, base).select("event_id", "error_type", "retry_count")


def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events that carry a document, from an append-only log."""
    log = _stream(spark, f"{sf_dir}/events.parquet").select(
        "event_id", F.expr("CASE event_type WHEN 'view' THEN 'delete' WHEN 'click' THEN 'replace' WHEN 'error' THEN 'update' ELSE 'insert' END").alias("op"),
        F.expr("CASE WHEN event_id % 10 = 0 THEN NULL ELSE props END").alias("doc"),
    )
    return run(tables.changes(log))


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    admit = lambda df: streams.fold_stream(df, "user_id", "ts", "event_id", folds.rate_limit_fold(3, 86400), "admitted")
    out, _ = through_router(spark, _table(spark, sf_dir), admit, "ts", "event_id")
    return out.select("user_id", "event_id", "admitted")


def _named_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir).select(F.expr(COLLECTION_OF_EVENT).alias("collection_name"), F.col("ts").alias("detected_at"), "event_id")


def stream_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lambda df: streams.correlation_stream(df, len(MONITORED), watermark=None).drop("closed_at")
    out, _ = through_router(spark, _named_anomalies(spark, sf_dir), found, "detected_at", "event_id")
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "collection_key", "patient_zero", "n_anomalies", "severity"
    )


def stream_correlated_refires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster events, at most one per collection set and hour, as one stream of two stateful steps."""
    once = lambda df: streams.correlated_refires_stream(df, len(MONITORED))
    out, _ = through_router(spark, _named_anomalies(spark, sf_dir), once, "detected_at", "event_id")
    return out.select("collection_key", F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def stream_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocity of shards from sums that each batch of a stream added up; no vector is read twice."""
    rows = vectors(spark, sf_dir, 12).select("vec_id", F.expr("vec_id % 37").alias("shard"), "ts", F.expr(SHARD_VECTOR_SPARK).alias("embedding"))
    _, base = through_router(spark, rows, None, "ts", "vec_id", "1 day", restart=False)
    accepted = routing.accepted_stream(spark, base, rows.schema, "ts", "vec_id", "1 day")
    state = f"{base}/velocity"
    streams.start(accepted, f"{base}/sums", velocity_state.velocity_state_batch(state, "shard", "ts", "embedding", 24)).awaitTermination()
    v = velocity_state.velocity_from_state(spark, state, "shard", F.lit("2024-01-01 23:59:59").cast("timestamp"), 24)
    return v.select(
        "shard", "centroid_distance", "baseline_distance", "velocity_ratio", "velocity_zscore", "cumulative_drift", "cumulative_alert", "status"
    )


def stream_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size anomalies of a document stream against a stored baseline."""
    path = f"{sf_dir}/documents.parquet"
    docs, stream = spark.read.parquet(path), _stream(spark, path)
    base = profile.size_baseline(docs, "lang")
    batch = lambda sink: streams.anomaly_batch(lambda: base, sink, "lang", "doc_id", "ts", docs.columns)
    out = run(stream.withColumn("ts", as_of()), batch)
    return out.select("collection_name", "document_id", "z_score", "severity")


QUERIES = {f.__name__: f for f in (
    stream_write_stats, stream_refires, stream_throttle, stream_circuit, stream_dead_letters, stream_changes, stream_rate_limit,
    stream_correlation, stream_correlated_refires, stream_velocity, stream_anomalies,
)}
