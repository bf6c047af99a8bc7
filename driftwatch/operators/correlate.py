"""Anomalies that hit several collections within a few minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Look-back, fewest collections, confidence that makes an event
# critical, refire interval.
LOOKBACK_MINUTES = 5
MIN_COLLECTIONS = 2
CRITICAL_CONFIDENCE = 0.7
REFIRE_HOURS = 1


def collection_key(names: Column) -> Column:
    return F.array_join(F.array_sort(names), "|")


def _event(grouped: DataFrame, n_monitored: int) -> DataFrame:
    """Cluster columns from (names, first, n_anomalies)."""
    confidence = F.round(F.size("names") / F.lit(float(n_monitored)), 3)
    return (
        grouped.filter(F.size("names") >= MIN_COLLECTIONS)
        .withColumns(
            {
                "collection_key": collection_key(F.col("names")),
                "collections_affected": F.array_sort("names"),
                "patient_zero": F.col("first.collection_name"),
                "confidence": confidence,
            }
        )
        .withColumns(
            {
                "incident_type": F.lit("CLUSTER_WIDE_EVENT"),
                "severity": F.when(F.col("confidence") >= CRITICAL_CONFIDENCE, F.lit("CRITICAL")).otherwise(
                    F.lit("WARNING")
                ),
            }
        )
        .drop("names", "first")
    )


def correlated_events(
    anomalies: DataFrame, as_of: Column, monitored: list[str], ts: str = "detected_at", stored: DataFrame | None = None,
    minutes: int = LOOKBACK_MINUTES,
) -> DataFrame:
    """The cluster event of the look-back window before ``as_of``, if any.

    All anomalies of the window count, as one count and earliest time for each
    monitored collection. ``stored`` events of the same collection set within
    the last hour suppress it.
    """
    start = as_of - F.expr(f"INTERVAL {minutes} MINUTES")
    hit = (
        anomalies.filter((F.col(ts) >= start) & (F.col(ts) <= as_of) & F.col("collection_name").isin(monitored))
        .groupBy("collection_name")
        .agg(F.min(ts).alias("_ts"), F.count(F.lit(1)).alias("_n"))
    )
    grouped = hit.agg(
        F.collect_set("collection_name").alias("names"),
        F.min(F.struct("_ts", "collection_name")).alias("first"),
        F.sum("_n").alias("n_anomalies"),
    )
    found = _event(grouped, len(monitored)).withColumns({"window_start": start, "window_end": as_of, "created_at": as_of})
    return suppress_stored(found, stored) if stored is not None else found


def correlation_windows(
    anomalies: DataFrame, monitored: list[str], ts: str = "detected_at", minutes: int = LOOKBACK_MINUTES,
    slide_minutes: int = 1,
) -> DataFrame:
    """Cluster events of every sliding window over the whole history.

    Anomalies are first counted per (collection, slide step); only these counts
    are copied into the windows that cover them, so a burst of anomalies is
    one row per collection and step.
    """
    steps = minutes // slide_minutes
    width = slide_minutes * 60
    second = F.unix_seconds(F.col(ts).cast("timestamp"))
    per_step = (
        anomalies.filter(F.col("collection_name").isin(monitored))
        .select("collection_name", F.col(ts).cast("timestamp").alias("_ts"), (second - F.pmod(second, F.lit(width))).alias("step"))
        .groupBy("collection_name", "step")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_ts").alias("_ts"))
    )
    copies = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda j: F.col("step") - j * width))
    grouped = (
        per_step.withColumn("start", copies)
        .groupBy("start")
        .agg(
            F.collect_set("collection_name").alias("names"),
            F.min(F.struct("_ts", "collection_name")).alias("first"),
            F.sum("n").alias("n_anomalies"),
        )
    )
    end = F.timestamp_seconds(F.col("start") + minutes * 60)
    return (
        _event(grouped, len(monitored))
        .withColumns({"window_start": F.timestamp_seconds("start"), "window_end": end})
        .drop("start")
    )


def suppress_stored(
    candidates: DataFrame, stored: DataFrame, key: str = "collection_key", ts: str = "created_at", hours: int = REFIRE_HOURS
) -> DataFrame:
    """Drops candidates whose key was stored within the hours before them.

    Time is cut into spans of that length. Of the stored rows of a span only
    the first matters to candidates of the same span and only the last to those
    of the next, so a key meets its candidates with one row per span and a hot
    key costs no comparison of all with all.
    """
    width = hours * 3_600_000_000

    def micros(name: str) -> Column:
        return F.unix_micros(F.col(name).cast("timestamp"))

    span = F.floor(F.col("_t") / width)
    seen = stored.select(F.col(key).alias("_k"), micros(ts).alias("_t")).withColumn("_span", span)
    ends = seen.groupBy("_k", "_span").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    none = F.lit(None).cast("long")
    known = (
        ends.select("_k", "_span", "_first", none.alias("_before"))
        .unionByName(ends.select("_k", (F.col("_span") + 1).alias("_span"), none.alias("_first"), F.col("_last").alias("_before")))
        .groupBy("_k", "_span")
        .agg(F.max("_first").alias("_first"), F.max("_before").alias("_before"))
    )
    marked = candidates.withColumn("_t", micros(ts)).withColumn("_at", span)
    joined = marked.join(known, (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_span")), "left")
    recent = (F.col("_first") <= F.col("_t")) | (F.col("_before") >= F.col("_t") - width)
    return joined.filter(~F.coalesce(recent, F.lit(False))).select(*candidates.columns)
