"""Size anomalies, velocity anomalies and the escalation of anomaly types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.scores import ANOMALY_Z, kilobytes, severity, z_confidence
from driftwatch.functions.sizes import document_bytes
from driftwatch.session import bounded, null_safe_join

# Baseline of a key that has none, and the smallest deviation.
DEFAULT_MEAN, DEFAULT_STDDEV, MIN_STDDEV = 1000.0, 500.0, 1.0


def with_z(
    docs: DataFrame, baseline: DataFrame, key: str, size: Column | None = None, mean: float = DEFAULT_MEAN,
    stddev: float = DEFAULT_STDDEV,
) -> DataFrame:
    """Adds ``bytes``, ``mean_bytes`` and ``z`` to every document."""
    size = document_bytes(docs) if size is None else size
    side = bounded(baseline.select(key, F.col("mean_bytes").alias("_mean"), F.col("stddev_bytes").alias("_sd")))
    joined = null_safe_join(docs.withColumn("bytes", size), side, key, "left")
    center = F.coalesce(F.col("_mean"), F.lit(mean))
    spread = F.greatest(F.coalesce(F.col("_sd"), F.lit(stddev)), F.lit(MIN_STDDEV))
    return joined.withColumns({"mean_bytes": center, "z": (F.col("bytes") - center) / spread}).drop("_mean", "_sd")


def size_anomalies(
    docs: DataFrame, baseline: DataFrame, key: str, doc_id: str, detected_at: Column, size: Column | None = None,
    threshold: float = ANOMALY_Z,
) -> DataFrame:
    """Documents whose size is at least ``threshold`` deviations off the mean.

    One pass over the documents: the size is a Column over lengths, the
    baseline side is broadcast when counted small, and only flagged rows leave.
    """
    flagged = with_z(docs, baseline, key, size).filter(F.abs("z") >= threshold)
    z, size_kb, mean_kb = F.col("z"), F.col("bytes") / 1024, F.col("mean_bytes") / 1024
    level = severity(z)
    return flagged.select(
        F.col(key).alias("collection_name"),
        F.lit("DOC_SIZE_SPIKE").alias("anomaly_type"),
        F.round(z, 3).alias("z_score"),
        F.col("bytes").alias("doc_size_bytes"),
        kilobytes(F.col("bytes")).alias("doc_size_kb"),
        kilobytes(F.col("mean_bytes")).alias("baseline_mean_kb"),
        level.alias("severity"),
        F.col(doc_id).cast("string").alias("document_id"),
        F.concat(
            level, F.lit(": Document in '"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("' is "), F.round(size_kb, 1).cast("string"),
            F.lit(" KB (Z="), F.round(z, 2).cast("string"), F.lit("). Baseline mean: "),
            F.round(mean_kb, 1).cast("string"), F.lit(" KB."),
        ).alias("description"),
        z_confidence(z).alias("confidence"),
        detected_at.alias("detected_at"),
    )


def velocity_anomalies(velocity: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Anomaly rows of the keys whose semantic velocity is a spike."""
    z = F.col("velocity_zscore")
    return velocity.filter(F.col("status") == "spike").select(
        F.col(key).cast("string").alias("collection_name"),
        F.lit("SEMANTIC_VELOCITY_SPIKE").alias("anomaly_type"),
        F.round(z, 3).alias("z_score"),
        severity(z).alias("severity"),
        F.lit("").alias("document_id"),
        F.col("interpretation").alias("description"),
        F.col("centroid_distance").alias("semantic_velocity"),
        F.lit(True).alias("semantic_spike"),
        z.alias("velocity_zscore"),
        "centroid_distance",
        "baseline_distance",
        z_confidence(z).alias("confidence"),
        as_of.alias("detected_at"),
    )


def escalate(anomalies: DataFrame, threats: DataFrame, doc_id: str = "document_id") -> DataFrame:
    """Marks anomalies whose document carries a threat.

    Only a size spike is re-typed; its severity becomes that of the threat.
    ``threats`` has one row per document, so the join stays one to one; ids are
    unique only within a collection, so a ``collection_name`` there must agree. It is
    not filtered by verdict here: that predicate would be pushed down to the
    documents and have every one of them scanned before any join.
    """
    on = [c for c in ("collection_name", doc_id) if c in threats.columns]
    side = threats.select(
        *on,
        F.col("severity").alias("_severity"),
        F.col("matches").alias("ai_threat_matches"),
        F.col("confidence").alias("ai_threat_confidence"),
        F.col("threat_detected").alias("_hit"),
    )
    joined = null_safe_join(anomalies, side, on, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    retyped = hit & (F.col("anomaly_type") == "DOC_SIZE_SPIKE")
    return joined.withColumns(
        {
            "ai_memory_poisoning": hit,
            "severity": F.when(retyped, F.coalesce("_severity", "severity", F.lit("WARNING"))).otherwise(
                F.col("severity")
            ),
            "anomaly_type": F.when(retyped, F.lit("AI_MEMORY_POISONING")).otherwise(F.col("anomaly_type")),
        }
    ).drop("_severity", "_hit")
