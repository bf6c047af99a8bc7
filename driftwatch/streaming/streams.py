"""Structured Streaming versions of the windowed and stateful operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftwatch.functions.sizes import document_bytes
from driftwatch.operators import anomaly, correlate, folds, incident, runway, threats
from driftwatch.session import bounded, materialize, null_safe_join
from driftwatch.sources import buckets, tables
from driftwatch.streaming.event_folds import fold_stream
from driftwatch.streaming.routing import WATERMARK


def write_stats_stream(
    df: DataFrame, key, ts: str, size: Column, width: str = "60 seconds", watermark: str | None = WATERMARK
) -> DataFrame:
    """Tumbling write statistics; append mode emits each window once. ``watermark`` is None if ``df`` has one."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark) if watermark else df
    return runway.write_stats(timed, key, ts, size, width)


def correlation_stream(df: DataFrame, n_monitored: int, ts: str = "detected_at", watermark: str | None = WATERMARK) -> DataFrame:
    """Cluster events of sliding five-minute windows, once a window closes.

    ``watermark`` is None if ``df`` has one already. ``closed_at`` is the event
    time of the result: the last moment of the window.
    """
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark) if watermark else df
    minutes = correlate.LOOKBACK_MINUTES
    grouped = timed.groupBy(F.window(ts, f"{minutes} minutes", "1 minute").alias("w")).agg(
        F.collect_set("collection_name").alias("names"),
        F.min(F.struct(F.col(ts).alias("_ts"), "collection_name")).alias("first"),
        F.count(F.lit(1)).alias("n_anomalies"),
    )
    return (
        correlate._event(grouped, n_monitored)
        .withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end"), "closed_at": F.window_time("w")})
        .drop("w")
    )


def correlated_refires_stream(df: DataFrame, n_monitored: int, ts: str = "detected_at", hours: int = correlate.REFIRE_HOURS) -> DataFrame:
    """Cluster events with re-fires suppressed: a window aggregation and a stateful rule in one query.

    ``df`` has a watermark on ``ts``. An event is kept if none of the same
    collections was kept in the hours before.
    """
    found = correlation_stream(df, n_monitored, ts, None).select("collection_key", "closed_at", "window_start")
    kept = fold_stream(found, "collection_key", "closed_at", "window_start", folds.refire_fold(hours * 3600), "kept")
    end = F.col("closed_at") + F.expr("INTERVAL 1 MICROSECOND")
    return kept.where("kept = 1").select("collection_key", end.alias("window_end"), "window_start")


def feed_stream(df: DataFrame, id_column: str, ts: str, watermark: str = WATERMARK) -> DataFrame:
    """Live feed: no embedding, each id once."""
    timed = df.drop("embedding").withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    return timed.dropDuplicatesWithinWatermark([id_column])


def split_late(df: DataFrame, ts: str, newest: Column, watermark: str = WATERMARK) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and rows later than the watermark for the dead letters."""
    late = F.when(
        F.col(ts) < newest - F.expr(f"INTERVAL {watermark}"),
        F.struct(F.lit("LateEvent").alias("error_type"), F.lit("event is older than the watermark").alias("error_message")),
    )
    return tables.split_dead_letter(df, late, newest)


# --- sinks ---------------------------------------------------------------------------


def start(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], interval: str | None = None) -> StreamingQuery:
    """Starts a query whose batches go to ``write``; a batch may repeat after
    a failure, so ``write`` must be safe to repeat."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def keep_existing_sink(path: str, key, within: str | None = None) -> Callable[[DataFrame, int], None]:
    """Batch writer that adds only keys the table does not have."""
    return lambda batch, _: tables.merge_keep_existing(path, batch, key, within)


def anomaly_batch(
    baselines: Callable[[], DataFrame], sink: str, key: str, doc_id: str, detected_at: str, size_columns: list[str] | None = None, doc: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """Batch writer of size anomalies; baselines are read anew per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        size = document_bytes(batch, size_columns, doc=doc)
        found = anomaly.size_anomalies(batch, baselines(), key, doc_id, F.col(detected_at), size)
        rows = found.withColumns({"processed": F.lit(False), "batch_id": F.lit(batch_id)})
        tables.merge_keep_existing(sink, rows, ["collection_name", "document_id", "detected_at"], "detected_at")

    return write


def enrich(
    anomalies: DataFrame, docs: DataFrame, doc_id: str, drift: DataFrame | None = None, velocity: DataFrame | None = None,
    runways: DataFrame | None = None, columns: list[str] | None = None, doc: str | None = None, key: str | None = None,
) -> DataFrame:
    """Adds threat, drift, velocity and runway signals to anomalies.

    Anomalies are found once and stored; only the documents they flag are
    scanned. ``drift``, ``velocity`` and
    ``runways`` are reports with one row per ``collection_name``. ``key`` names
    the collection of a document where ids repeat between collections.
    """
    anomalies = materialize(anomalies)
    on = ["document_id"] if key is None else ["collection_name", "document_id"]
    named = docs.withColumn("document_id", F.col(doc_id).cast("string"))
    if key is not None:
        named = named.withColumn("collection_name", F.col(key))
    flagged = null_safe_join(named, bounded(anomalies.select(*on).distinct()), on, "left_semi")
    found = threats.scan_threats(flagged, "document_id", columns or (None if doc else docs.columns), doc, keep=on[:-1])
    out = anomaly.escalate(anomalies, found)
    if drift is not None:
        out = null_safe_join(out, drift.select("collection_name", F.col("drift_detected").alias("schema_drift")), "collection_name", "left")
    if velocity is not None:
        side = velocity.select(
            "collection_name",
            F.col("centroid_distance").alias("semantic_velocity"),
            F.col("spike_detected").alias("semantic_spike"),
        )
        out = null_safe_join(out, side, "collection_name", "left")
    if runways is not None:
        side = runways.select("collection_name", F.struct("minutes_to_critical", "trend", "status").alias("runway"))
        out = null_safe_join(out, side, "collection_name", "left")
    return out


def incident_batch(
    baselines: Callable[[], DataFrame], counts: Callable[[], DataFrame], anomaly_sink: str, incident_sink: str, key: str,
    doc_id: str, detected_at: str, columns: list[str] | None = None, doc: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """Batch writer of the main path: detect, scan, escalate, report.

    Both sinks keep existing keys, so a repeated batch adds nothing twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        found = anomaly.size_anomalies(batch, baselines(), key, doc_id, F.col(detected_at), document_bytes(batch, columns, doc=doc))
        enriched = enrich(found, batch, doc_id, columns=columns, doc=doc, key=key).persist()
        tables.merge_keep_existing(anomaly_sink, enriched, ["collection_name", "document_id", "detected_at"], "detected_at")
        reports = incident.incident_reports(enriched, counts())
        tables.merge_keep_existing(incident_sink, reports, ["incident_id", "detected_at"], "detected_at")
        enriched.unpersist()
        batch.unpersist()

    return write


def throttled_checks(
    found: DataFrame, throttle: str, key: str = "collection_name", at: str = "detected_at", tie: str = "document_id",
    seconds: int = folds.THROTTLE_SECONDS,
) -> DataFrame:
    """Adds ``checked``: 1 for anomalies whose collection is checked, at most once in ``seconds``, 0 for the others.

    The last check of each collection is read from the table ``throttle``
    (:func:`remember_checks`) and stands first in its time order, so the rule
    goes on from batch to batch. ``found`` should be stored; it is read twice.
    """
    spark = found.sparkSession
    now = found.select(key, F.col(at).cast("timestamp").alias("_at"), F.col(tie).cast("string").alias("_tie"))
    before = buckets.read_table(spark, throttle)
    if before is not None:
        earlier = before.select(key, F.col("checked_at").alias("_at"), F.lit("").alias("_tie"))
        wanted = bounded(now.select(key).distinct())
        now = now.unionByName(null_safe_join(earlier, wanted, key, "left_semi"))
    decided = folds.fold_events(now, key, "_at", "_tie", folds.refire_fold(seconds), "checked")
    named = found.withColumns({"_at": F.col(at).cast("timestamp"), "_tie": F.col(tie).cast("string")})
    return null_safe_join(named, decided.where("_tie != ''"), [key, "_at", "_tie"], "left").drop("_at", "_tie")


def remember_checks(checked: DataFrame, throttle: str, key: str = "collection_name", at: str = "detected_at") -> None:
    """Stores the time of the newest check of each collection."""
    newest = checked.where("checked = 1").groupBy(key).agg(F.max(F.col(at).cast("timestamp")).alias("checked_at"))
    buckets.upsert_buckets(throttle, newest, key, "checked_at", 16)


def enriched_incident_batch(
    baselines: Callable[[], DataFrame], counts: Callable[[], DataFrame], reports: Callable[[DataFrame], dict[str, DataFrame]],
    throttle: str, anomaly_sink: str, incident_sink: str, key: str, doc_id: str, detected_at: str,
    columns: list[str] | None = None, doc: str | None = None, scanned: list[str] | None = None, seconds: int = folds.THROTTLE_SECONDS,
) -> Callable[[DataFrame, int], None]:
    """Batch writer of the whole main path: detect, scan, escalate, check, report.

    ``reports(collections)`` gives the reports ``drift``, ``velocity`` and
    ``runways`` (any of them) of a frame of collection names. They are asked
    for only where a check is due, and only anomalies that are checked carry
    their signals. Sizes are taken over ``columns``, threats looked for in
    ``scanned``. The sinks keep existing keys and the checks are remembered
    last, so a repeated batch stores nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        size = document_bytes(batch, columns, doc=doc)
        found = materialize(anomaly.size_anomalies(batch, baselines(), key, doc_id, F.col(detected_at), size))
        decided = materialize(throttled_checks(found, throttle, seconds=seconds))
        due = bounded(decided.where("checked = 1").select("collection_name").distinct())
        signals = {name: bounded(report) for name, report in reports(due).items()}
        enriched = enrich(decided, batch, doc_id, columns=scanned or columns, doc=doc, key=key, **signals)
        own = [c for c in ("schema_drift", "semantic_velocity", "semantic_spike", "runway") if c in enriched.columns]
        enriched = materialize(enriched.withColumns({c: F.when(F.col("checked") == 1, F.col(c)) for c in own}))
        tables.merge_keep_existing(anomaly_sink, enriched, ["collection_name", "document_id", "detected_at"], "detected_at")
        checked, unchecked = enriched.where("checked = 1"), enriched.where("checked = 0")
        made = incident.incident_reports(checked, counts(), drift=signals.get("drift")).unionByName(
            incident.incident_reports(unchecked, counts())
        )
        tables.merge_keep_existing(incident_sink, made, ["incident_id", "detected_at"], "detected_at")
        remember_checks(enriched, throttle)
        batch.unpersist()

    return write


def velocity_monitor(velocity: Callable[[], DataFrame], key: str, as_of: Callable[[], Column], sink: str) -> Callable[[DataFrame, int], None]:
    """Batch writer of a periodic check: spikes of the state table become
    anomaly rows, at most one per collection and hour."""

    def write(batch: DataFrame, batch_id: int) -> None:
        now = as_of()
        spikes = anomaly.velocity_anomalies(velocity(), key, now)
        spark = spikes.sparkSession
        if tables.table_exists(spark, sink):
            spikes = correlate.suppress_stored(spikes, spark.read.parquet(sink), "collection_name", "detected_at")
        tables.append(spikes, sink)

    return write
