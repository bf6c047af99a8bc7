"""Schema drift against a stored schema, and refresh of size baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.session import keys_of, null_safe_join

# Fixed value: a mean that moved by more than this percentage is refreshed.
STABLE_PERCENT = 5.0


def schema_changes(live: DataFrame, stored: DataFrame, key) -> DataFrame:
    """One row per field that was added, removed or changed its types.

    Both inputs have rows (key, field, types); a full outer join on
    (key, field) spreads even a single huge schema over all tasks.
    """
    keys = keys_of(key)
    now = live.select(*keys, "field", F.array_sort("types").alias("now"))
    was = stored.select(*keys, "field", F.array_sort("types").alias("was"))
    both = null_safe_join(now, was, [*keys, "field"], "full_outer")
    change = (
        F.when(F.col("was").isNull(), F.lit("added"))
        .when(F.col("now").isNull(), F.lit("removed"))
        .when(F.col("was") != F.col("now"), F.lit("changed"))
    )
    return both.withColumn("change", change)


def schema_drift(live: DataFrame, stored: DataFrame, key) -> DataFrame:
    """Drift report per key: added, removed, type changes, verdict.

    The lists hold field names, so their length is that of the schema.
    """
    keys = keys_of(key)
    changes = schema_changes(live, stored, keys)

    def fields(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("change") == kind, F.col("field"))))

    report = changes.groupBy(*keys).agg(
        fields("added").alias("added_fields"),
        fields("removed").alias("removed_fields"),
        F.array_sort(
            F.collect_list(F.when(F.col("change") == "changed", F.struct("field", "was", "now")))
        ).alias("type_changes"),
        F.count("now").cast("int").alias("live_field_count"),
    )
    first_added = F.try_element_at("added_fields", F.lit(1))
    first_changed = F.try_element_at("type_changes", F.lit(1))["field"]
    return report.select(
        *keys,
        ((F.size("added_fields") + F.size("removed_fields") + F.size("type_changes")) > 0).alias("drift_detected"),
        "added_fields",
        "removed_fields",
        "type_changes",
        "live_field_count",
        F.coalesce(first_added, first_changed).alias("most_suspicious_field"),
    )


def schema_after_drift(live: DataFrame, stored: DataFrame, key) -> DataFrame:
    """The stored schema after a check: drifting keys take the live schema.

    A key without live fields and without drift keeps what it had.
    """
    keys = keys_of(key)
    drifting = schema_changes(live, stored, keys).filter(F.col("change").isNotNull()).select(*keys).distinct()
    kept = null_safe_join(stored.select(*keys, "field", "types"), drifting, keys, "left_anti")
    taken = null_safe_join(live.select(*keys, "field", "types"), drifting, keys, "left_semi")
    return kept.unionByName(taken)


def refresh_baseline(fresh: DataFrame, stored: DataFrame, key) -> DataFrame:
    """Decision per key: created, refreshed or none, with the drift percent.

    ``fresh`` and ``stored`` hold (key, mean_bytes, stddev_bytes,
    sample_count); the chosen values come back with the decision.
    """
    keys = keys_of(key)
    new = fresh.select(
        *keys,
        F.col("mean_bytes").alias("fresh_mean"),
        F.col("stddev_bytes").alias("fresh_sd"),
        F.col("sample_count").alias("fresh_n"),
    )
    old = stored.select(
        *keys,
        F.col("mean_bytes").alias("old_mean"),
        F.col("stddev_bytes").alias("old_sd"),
        F.col("sample_count").alias("old_n"),
    )
    both = null_safe_join(new, old, keys, "full_outer")
    missing = F.coalesce(F.col("old_mean"), F.lit(0.0)) == 0
    empty = F.col("fresh_mean").isNull()
    percent = F.abs(F.col("fresh_mean") - F.col("old_mean")) / F.greatest("old_mean", F.lit(1.0)) * 100.0
    action = (
        F.when(missing, F.lit("created"))
        .when(empty, F.lit("none"))
        .when(percent > STABLE_PERCENT, F.lit("refreshed"))
        .otherwise(F.lit("none"))
    )
    renew = F.col("action") != "none"
    return (
        both.withColumn("action", action)
        .withColumn(
            "drift_pct",
            F.when(missing, F.lit(100.0)).when(empty, F.lit(0.0)).otherwise(F.round(percent, 2)),
        )
        .select(
            *keys,
            renew.alias("drifted"),
            "drift_pct",
            "action",
            (~renew).alias("stable"),
            F.when(~missing & empty, F.lit("no_documents")).alias("reason"),
            F.when(renew, F.col("fresh_mean")).otherwise(F.col("old_mean")).alias("mean_bytes"),
            F.when(renew, F.col("fresh_sd")).otherwise(F.col("old_sd")).alias("stddev_bytes"),
            F.when(renew, F.col("fresh_n")).otherwise(F.col("old_n")).alias("sample_count"),
        )
    )
