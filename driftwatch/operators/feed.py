"""Feeds, lookups and status rows over the state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.session import null_safe_join

# Default size of each feed, and the largest size its readers publish.
FEED_LIMITS = {
    "anomalies": (50, 200),
    "incidents": (20, 100),
    "traces": (10, 50),
    "clusters": (10, 50),
    "tool_incidents": (10, 20),
    "tool_clusters": (5, 10),
    "tool_similar": (3, 5),
    "find": (10, 50),
}
FEED_KEEP, REPLAY = 100, 10
MAX_RETRIES = 3


def feed_size(feed: str, n: int | None = None, most: int | None = None) -> int:
    """``n`` or the feed's default; cut to ``most`` only where a maximum is asked for."""
    size = FEED_LIMITS[feed][0] if n is None else int(n)
    return size if most is None else min(size, most)


def newest(df: DataFrame, ts: str, tie: str, feed: str = "anomalies", n: int | None = None) -> DataFrame:
    """Newest rows of a feed, without embeddings; a distributed top-k."""
    return df.drop("embedding").orderBy(F.desc(ts), F.desc(tie)).limit(feed_size(feed, n))


def replay(df: DataFrame, ts: str, tie: str, n: int = REPLAY) -> DataFrame:
    """The newest ``n`` rows, oldest first."""
    return df.drop("embedding").orderBy(F.desc(ts), F.desc(tie)).limit(n).orderBy(F.asc(ts), F.asc(tie))


def find(
    df: DataFrame,
    predicate: Column | None = None,
    columns: list[str] | None = None,
    n: int | None = None,
    order: list[Column] | None = None,
) -> DataFrame:
    """Filtered, projected rows; 10 by default, the first by ``order`` if given (a distributed top-k)."""
    rows = df if predicate is None else df.filter(predicate)
    rows = rows if order is None else rows.orderBy(*order)
    rows = rows if columns is None else rows.select(*columns)
    return rows.limit(feed_size("find", n))


def has_field(column: Column) -> Column:
    return column.isNotNull()


def has_path(doc: str, path: str) -> Column:
    """The variant document has a value at the path; a null counts as one."""
    return F.try_variant_get(F.col(doc), path, "variant").isNotNull()


def not_equal(column: Column, value) -> Column:
    """Not equal, where a missing value also counts as not equal."""
    return ~column.eqNullSafe(F.lit(value))


def lookup(df: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows of the wanted ids."""
    return df.join(ids.select(id_column).distinct(), id_column, "left_semi")


def flagged_documents(anomalies: DataFrame, docs: DataFrame, doc_id: str, key: str | None = None) -> DataFrame:
    """Each anomaly with the document it names.

    ``key`` is the collection column of the documents; with it an anomaly
    meets only a document of its own collection, as ids may repeat between
    collections. Null collections and ids meet each other.
    """
    side = docs.withColumn("document_id", F.col(doc_id).cast("string"))
    if key is None:
        return null_safe_join(anomalies, side, "document_id")
    side = side.withColumn("collection_name", F.col(key).cast("string"))
    return null_safe_join(anomalies, side, ["collection_name", "document_id"])


def latest_per_key(df: DataFrame, key: list[str], ts: str, tie: str) -> DataFrame:
    """The newest row of each key, combined on the map side."""
    rest = [c for c in df.columns if c not in key]
    return (
        df.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_r"))
        .select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def dedup_feed(df: DataFrame, id_column: str, ts: str, n: int = FEED_KEEP) -> DataFrame:
    """One row per id, its newest, and the newest ``n`` of them."""
    rest = [c for c in df.columns if c != id_column]
    once = (
        df.groupBy(id_column)
        .agg(F.max_by(F.struct(*rest), F.struct(ts, F.xxhash64(*rest))).alias("_r"))
        .select(id_column, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )
    return once.orderBy(F.desc(ts), F.desc(id_column)).limit(n)


def velocity_cards(velocity: DataFrame) -> DataFrame:
    """Velocity rows worth showing, spikes first."""
    shown = F.col("status").isin("spike", "elevated") | (F.size("hourly_distances") > 1)
    place = F.when(F.col("status") == "spike", 0).when(F.col("status") == "elevated", 1).when(
        F.col("status") == "cumulative_drift", 2
    ).otherwise(3)
    return velocity.filter(shown).withColumn("place", place).orderBy("place")


def incident_list(incidents: DataFrame, n: int | None = None) -> DataFrame:
    """Newest incidents with their top remediation option."""
    return newest(incidents, "created_at", "incident_id", "tool_incidents", n).select(
        "incident_id", "collection_name", "anomaly_type", "severity", "z_score", "created_at", "summary",
        "per_minute_usd", "total_worst_case_usd", F.try_element_at("options", F.lit(1)).alias("top_remediation"),
    )


def cluster_list(clusters: DataFrame, n: int | None = None) -> DataFrame:
    """Newest cluster events."""
    return newest(clusters, "created_at", "collection_key", "tool_clusters", n)


def anomaly_check(velocity: DataFrame, key: str) -> DataFrame:
    """Short verdict per key from its velocity."""
    return velocity.select(
        F.col(key).alias("collection"),
        F.round("velocity_zscore", 2).alias("z_score"),
        F.round("centroid_distance", 4).alias("drift_distance"),
        F.round("baseline_distance", 4).alias("baseline"),
        "status",
        F.when(F.col("status") == "spike", F.lit("⚠ SPIKE: semantic contamination detected — incident pipeline triggered."))
        .otherwise(F.lit("✓ Normal: no semantic anomaly detected."))
        .alias("message"),
        F.coalesce("interpretation", F.lit("")).alias("interpretation"),
    )


def dead_letter_pending(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("retry_count") < MAX_RETRIES).alias("pending"))


def stream_health(progress: DataFrame, key: str, updated: str = "updated_at") -> DataFrame:
    """Last update per stream."""
    return progress.groupBy(key).agg(F.max(updated).alias("updated_at"))


def system_status(dead_letters: DataFrame, history: DataFrame, progress: DataFrame, key: str) -> DataFrame:
    """One row: streams seen, pending retries, embedded rows, overall verdict.

    Three one-row aggregates are stacked and folded into one, without a join.
    """
    zero = F.lit(None).cast("long")
    parts = (
        dead_letter_pending(dead_letters)
        .select(F.col("pending").alias("failed_events_pending"), zero.alias("history_rows"), zero.alias("embedded_rows"), zero.alias("streams"))
        .unionByName(
            history.agg(F.count(F.lit(1)).alias("history_rows"), F.count("embedding").alias("embedded_rows")).select(
                zero.alias("failed_events_pending"), "history_rows", "embedded_rows", zero.alias("streams")
            )
        )
        .unionByName(
            stream_health(progress, key)
            .agg(F.count(F.lit(1)).alias("streams"))
            .select(zero.alias("failed_events_pending"), zero.alias("history_rows"), zero.alias("embedded_rows"), "streams")
        )
    )
    names = ["failed_events_pending", "history_rows", "embedded_rows", "streams"]
    one = parts.agg(*[F.max(c).alias(c) for c in names])
    search_ok = (F.col("history_rows") == 0) | (F.col("embedded_rows") > 0)
    return one.withColumn("vector_search", F.when(search_ok, F.lit("ok")).otherwise(F.lit("error"))).withColumn(
        "status",
        F.when(search_ok & (F.col("failed_events_pending") == 0), F.lit("ok")).otherwise(F.lit("degraded")),
    )


def expected_seen(df: DataFrame, key: str, name: str, expected: list[str]) -> DataFrame:
    """Which of the expected names each key has, and whether all are there."""
    wanted = F.array(*[F.lit(x) for x in sorted(expected)])
    seen = df.groupBy(key).agg(F.collect_set(F.when(F.col(name).isin(expected), F.col(name))).alias("_s"))
    return seen.select(
        key,
        F.array_intersect(wanted, "_s").alias("seen"),
        F.array_except(wanted, "_s").alias("missing"),
        (F.size("_s") == len(expected)).alias("complete"),
    )
