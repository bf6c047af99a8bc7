"""Semantic velocity on mergeable state: each batch adds its sums, nothing is read again.

The state is a bucketed table of (key, hour, position): the sum of the vector
components and their count. A batch rewrites the buckets of its keys only and
leaves its number with them, so a repeated batch adds nothing. Hours that lie
further back than any report looks are dropped from buckets that are rewritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.operators import anomaly, correlate, velocity
from driftwatch.session import keys_of
from driftwatch.sources import buckets, tables


def velocity_state_batch(state: str, key, ts: str, emb: str, hours: int = 8, n_buckets: int = buckets.BUCKETS) -> Callable[[DataFrame, int], None]:
    """Batch writer that adds the vectors of a batch to the state.

    Of each bucket, hours more than ``hours`` + 1 before its newest one are dropped.
    """
    keys = keys_of(key)

    def write(batch: DataFrame, number: int) -> None:
        sums = velocity.partial_sums(batch, keys, ts, emb)

        def merge(rows: DataFrame, by: list[str]) -> DataFrame:
            added = rows.groupBy(*by, *keys, "hour", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
            newest = rows.groupBy(*by).agg(F.max("hour").alias("_newest"))
            kept = F.col("hour") >= F.col("_newest") - F.expr(f"INTERVAL {hours + 1} HOURS")
            return added.join(F.broadcast(newest), by).where(kept)  # one row a bucket

        buckets.merge_buckets(state, sums, keys, merge, number, n_buckets)

    return write


def velocity_from_state(spark: SparkSession, state: str, key, as_of: Column, hours: int = 8, closed: Column | None = None) -> DataFrame:
    """The velocity report of the hours of the state within ``hours`` before ``as_of``.

    With ``closed``, the watermark, only hours that ended before it count, so
    that a late row cannot change a report. Equals the batch report of the same
    rows where ``as_of`` less ``hours`` starts no hour in the middle.
    """
    keys = keys_of(key)
    rows = buckets.read_table(spark, state)
    start = as_of - F.expr(f"INTERVAL {hours} HOURS")
    rows = rows.where((F.col("hour") >= start) & (F.col("hour") <= as_of))
    if closed is not None:
        rows = rows.where(F.col("hour") + F.expr("INTERVAL 1 HOUR") <= closed)
    return velocity.velocity_report(velocity.centroid_distances(velocity.centroids_of_sums(rows, keys), keys), keys, hours)


def velocity_monitor_batch(
    state: str, sink: str, key: str, ts: str, emb: str, hours: int = 8, watermark: str = "5 minutes", n_buckets: int = buckets.BUCKETS
) -> Callable[[DataFrame, int], None]:
    """Batch writer of the periodic check: adds a batch to the state, then stores spikes of closed hours.

    The time of the check is the newest event less ``watermark``. A key is
    stored at most once an hour, and a repeated batch stores nothing twice.
    """
    add = velocity_state_batch(state, key, ts, emb, hours, n_buckets)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        add(batch, number)
        newest = buckets.read_table(spark, state).agg(F.max("hour")).first()[0]
        moment = batch.agg(F.max(F.col(ts).cast("timestamp"))).first()[0]
        if newest is None or moment is None:
            return
        now = F.lit(max(newest, moment)) - F.expr(f"INTERVAL {watermark}")
        last = F.date_trunc("hour", now) - F.expr("INTERVAL 1 MICROSECOND")
        spikes = anomaly.velocity_anomalies(velocity_from_state(spark, state, key, last, hours, now), key, F.date_trunc("hour", now))
        if tables.table_exists(spark, sink):
            spikes = correlate.suppress_stored(spikes, spark.read.parquet(sink), "collection_name", "detected_at")
        tables.merge_keep_existing(sink, spikes, ["collection_name", "detected_at"], "detected_at")

    return write
