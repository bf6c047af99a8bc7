"""Incident reports: evidence confidence, dollar impact, class, templates.

All lookups are literal maps inside expressions, so a report is one projection
over the anomalies; only the optional signals of other operators are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.functions import scores
from driftwatch.functions import templates as T
from driftwatch.functions.text import title_case, usable_reply
from driftwatch.session import bounded, null_safe_join


def _lookup(table: dict, key: Column, default: Column) -> Column:
    pairs = [x for name, value in table.items() for x in (F.lit(name), F.lit(value))]
    return F.coalesce(F.create_map(*pairs)[key], default)


# --- classes and templates -----------------------------------------------------


def threat_class(kind: Column) -> Column:
    """Struct (id, name) of the anomaly type; unknown types have a class too."""
    ids = {k: v[0] for k, v in T.THREAT_CLASSES.items()}
    names = {k: v[1] for k, v in T.THREAT_CLASSES.items()}
    unknown = T.THREAT_CLASSES["UNKNOWN"]
    return F.struct(
        _lookup(ids, kind, F.lit(unknown[0])).alias("id"), _lookup(names, kind, F.lit(unknown[1])).alias("name")
    )


def root_cause(kind: Column, collection: Column) -> Column:
    other = F.concat(kind, F.lit(" detected on '"), collection, F.lit("'; manual review recommended."))
    return F.struct(
        _lookup(T.ROOT_CAUSE, kind, other).alias("root_cause_description"),
        F.when(kind.isin(list(T.ROOT_CAUSE)), F.lit(0.75)).otherwise(F.lit(0.5)).alias("confidence"),
        F.when(kind.isin(T.SECURITY_TYPES), F.lit("security_threat"))
        .when(kind.isin(T.PIPELINE_TYPES), F.lit("data_pipeline"))
        .otherwise(F.lit("infrastructure"))
        .alias("category"),
    )


def _options(rows) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(rank).alias("rank"),
                F.lit(title).alias("title"),
                F.lit(text).alias("description"),
                F.lit(minutes).alias("estimated_minutes"),
                F.lit(action).alias("mcp_action"),
                F.lit(approval).alias("requires_approval"),
            )
            for rank, (title, text, minutes, action, approval) in enumerate(rows, 1)
        ]
    )


def remediation_options(kind: Column) -> Column:
    """Ranked remediation options of the anomaly type."""
    chosen = None
    for name, rows in T.REMEDIATION.items():
        chosen = F.when(kind == name, _options(rows)) if chosen is None else chosen.when(kind == name, _options(rows))
    return chosen.otherwise(_options(T.DEFAULT_REMEDIATION))


def anomaly_summary(severity: Column, kind: Column, collection: Column, z: Column) -> Column:
    tail = (
        F.when(kind == "AI_MEMORY_POISONING", F.lit(" Document contains prompt-injection content."))
        .when(kind == "SEMANTIC_VELOCITY_SPIKE", F.lit(" Semantic meaning diverged from historical norm."))
        .otherwise(F.lit(""))
    )
    return F.concat(
        severity, F.lit(" "), title_case(kind), F.lit(" in '"), collection, F.lit("' (z="),
        F.format_string("%.1f", z), F.lit(")."), tail,
    )


def summary_text(severity: Column, kind: Column, collection: Column, z: Column, finding: Column, options: Column) -> Column:
    """Three sentences: what fired, what was found, what to do."""
    top = F.try_element_at(options, F.lit(1))
    advice = F.when(
        top.isNotNull(),
        F.concat(
            F.lit("Recommended: "), top["title"], F.lit(" (~"), top["estimated_minutes"].cast("string"), F.lit(" min).")
        ),
    ).otherwise(F.lit("No remediation options returned; manual triage required."))
    return F.concat(
        severity, F.lit(" "), kind, F.lit(" on '"), collection, F.lit("' (z="), F.format_string("%.1f", z), F.lit("). "),
        F.coalesce(finding, F.lit("Investigation complete; see context for details.")), F.lit(" "), advice,
    )


# --- evidence confidence -----------------------------------------------------------


def evidence_confidence(df: DataFrame, variant: str = "report") -> DataFrame:
    """Adds total confidence, its four parts and the two strongest sources.

    ``report`` reads n_indexes, n_schema, n_slow, vector_score,
    drift_detected, n_added, n_removed, z_score. ``ui`` reads
    advisor_confidence, vector_score, n_added, n_changed, z_score.
    """
    zero = F.lit(0)
    score = F.coalesce("vector_score", F.lit(0.0))
    z = F.coalesce("z_score", F.lit(0.0))
    w = T.WEIGHTS
    if variant == "ui":
        parts = [
            F.coalesce("advisor_confidence", F.lit(0.0)),
            score,
            F.least(F.lit(1.0), F.coalesce("n_added", zero) * 0.2 + F.coalesce("n_changed", zero) * 0.3),
            scores.normalize(z, 2.0, 10.0),
        ]
        total = sum((p * x for p, x in zip(parts, w)), F.lit(0.0))
        return df.withColumns(
            {
                "advisor_score": parts[0],
                "similar_score": parts[1],
                "schema_score": parts[2],
                "z_score_norm": parts[3],
                "total_confidence": total,
            }
        )
    advisor = F.least(
        F.lit(1.0),
        F.coalesce("n_indexes", zero) * 0.30
        + F.coalesce("n_schema", zero) * 0.15
        + F.least(F.coalesce("n_slow", zero), F.lit(5)) * 0.05,
    )
    drifted = F.coalesce("drift_detected", F.lit(False))
    moved = F.coalesce("n_added", zero) + F.coalesce("n_removed", zero)
    drift = (
        F.when(drifted & (moved > 2), F.least(F.lit(1.0), 0.9 + 0.05 * moved))
        .when(drifted, F.lit(0.9))
        .otherwise(F.lit(0.15))
    )
    strength = scores.z_confidence(z)
    # the first contribution enters the sum unrounded, the others rounded
    first = advisor * w[0]
    rest = [F.round(score * w[1], 3), F.round(drift * w[2], 3), F.round(strength * w[3], 3)]
    names = ["advisor", "vector_search", "schema_drift", "z_score"]
    confidences = [F.round(advisor, 3), F.round(score, 4), F.round(drift, 3), F.round(strength, 3)]
    contributions = [F.round(first, 3), *rest]
    evidence = F.array(
        *[
            F.struct(F.lit(n).alias("source"), c.alias("confidence"), F.lit(x).alias("weight"), k.alias("contribution"))
            for n, c, x, k in zip(names, confidences, w, contributions)
        ]
    )
    ranked = F.array_sort(
        F.transform(
            F.col("evidence"),
            lambda e, i: F.struct((-e["contribution"]).alias("neg"), i.alias("i"), e["source"].alias("source")),
        )
    )
    return df.withColumn("evidence", evidence).withColumns(
        {
            "total_confidence": F.round(first + rest[0] + rest[1] + rest[2], 3),
            "confidence_pct": F.round(F.round(first + rest[0] + rest[1] + rest[2], 3) * 100, 1),
            "top_sources": F.transform(F.slice(ranked, 1, 2), lambda e: e["source"]),
        }
    )


# --- dollar impact -------------------------------------------------------------------


def impact_columns(rows: Column, z: Column, kind: Column, collection: Column) -> dict[str, Column]:
    """Cost columns of one anomaly, to be applied in this order."""
    qps = F.greatest(F.greatest(F.coalesce(rows, F.lit(T.DEFAULT_ROWS)), F.lit(1)) / T.ROWS_PER_QPS, F.lit(T.MIN_QPS))
    degradation = 1.0 + F.least(F.abs(F.coalesce(z, F.lit(0.0))), F.lit(T.Z_CAP)) / T.Z_PER_DEGRADATION
    one = F.lit(1.0)
    factor = _lookup(T.TYPE_MULTIPLIER, F.coalesce(kind, F.lit("")), one)
    tier = _lookup(T.COLLECTION_TIER, F.lower(F.coalesce(collection, F.lit("unknown"))), one)
    triage = T.HOURLY_RATE * T.TRIAGE_HOURS
    minute = F.round(qps * degradation * factor * tier * T.COST_PER_QPS_MINUTE, 2)
    hour = F.round(minute * 60, 2)
    own = F.round(minute * T.TRIAGE_MINUTES, 2)
    return {
        "per_minute_usd": minute,
        "if_unresolved_1hr_usd": hour,
        "engineer_triage_usd": F.lit(round(triage, 2)),
        "total_worst_case_usd": F.round(hour + triage, 2),
        "saved_usd": F.greatest(F.round(F.lit(triage) - own + (hour - own), 2), F.lit(0.0)),
        "anomaly_mult": factor,
        "collection_tier": tier,
    }


def with_counts(anomalies: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``doc_count`` of the anomaly's collection."""
    side = bounded(counts.select("collection_name", "doc_count"))
    return null_safe_join(anomalies, side, "collection_name", "left")


def with_size_context(anomalies: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Adds the mean and largest size of the anomaly's collection."""
    side = bounded(stats.select(F.col(key).alias("collection_name"), "mean_kb", "max_kb"))
    return null_safe_join(anomalies, side, "collection_name", "left")


def dollar_impact(anomalies: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds the cost columns; collections without a count use 10 000 rows."""
    joined = with_counts(anomalies, counts)
    return joined.withColumns(
        impact_columns(F.col("doc_count"), F.col("z_score"), F.col("anomaly_type"), F.col("collection_name"))
    )


# --- merge and report --------------------------------------------------------------------


def merge_replies(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """Takes each reply (variant) if usable, else the computed value.

    ``fields`` pairs (reply column, computed column as variant); adds
    ``enriched``: at least one reply was used.
    """
    used = [usable_reply(F.col(reply)) for reply, _ in fields]
    merged = {own: F.when(good, F.col(reply)).otherwise(F.col(own)) for good, (reply, own) in zip(used, fields)}
    any_used = used[0]
    for good in used[1:]:
        any_used = any_used | good
    return df.withColumn("enriched", any_used).withColumns(merged)


def incident_reports(
    anomalies: DataFrame, counts: DataFrame, similar: DataFrame | None = None, drift: DataFrame | None = None,
) -> DataFrame:
    """One report per anomaly.

    ``similar`` (per document_id, and collection_name if it has one: top_match_score, estimated_resolution_minutes,
    pattern_identified) and ``drift`` (per collection_name, from the schema
    check) are optional signals.
    """
    base = with_counts(anomalies, counts)
    if similar is not None:
        signal = ["top_match_score", "estimated_resolution_minutes", "pattern_identified"]
        on = [c for c in ("collection_name", "document_id") if c in similar.columns]
        base = null_safe_join(base, similar.select(*on, *[F.col(c).alias(f"_{c}") for c in signal]), on, "left")
    else:
        base = base.withColumns(
            {
                "_top_match_score": F.lit(0.0),
                "_estimated_resolution_minutes": F.lit(30),
                "_pattern_identified": F.lit(None).cast("string"),
            }
        )
    if drift is not None:
        side = bounded(
            drift.select(
                "collection_name", "drift_detected",
                F.size("added_fields").alias("n_added"), F.size("removed_fields").alias("n_removed"),
            )
        )
        base = null_safe_join(base, side, "collection_name", "left")
    else:
        base = base.withColumns({"drift_detected": F.lit(False), "n_added": F.lit(0), "n_removed": F.lit(0)})
    kind = F.coalesce("anomaly_type", F.lit("UNKNOWN"))
    level = F.coalesce("severity", F.lit("WARNING"))
    collection, z = F.coalesce("collection_name", F.lit("")), F.coalesce("z_score", F.lit(0.0))
    staged = base.withColumns(
        {
            "incident_id": F.md5(
                F.concat_ws("|", collection, kind, F.coalesce("document_id", F.lit("")), F.col("detected_at").cast("string"))
            ),
            "_cause": root_cause(kind, collection),
            "options": remediation_options(kind),
            "_class": threat_class(kind),
            "_context": anomaly_summary(level, kind, collection, z),
            "vector_score": F.coalesce("_top_match_score", F.lit(0.0)),
            "n_indexes": F.lit(0),
            "n_schema": F.lit(0),
            "n_slow": F.lit(0),
        }
    )
    scored = evidence_confidence(staged).withColumns(impact_columns(F.col("doc_count"), z, kind, collection))
    flag = F.col("ai_memory_poisoning") if "ai_memory_poisoning" in anomalies.columns else F.lit(False)
    return scored.select(
        "incident_id",
        collection.alias("collection_name"),
        kind.alias("anomaly_type"),
        level.alias("severity"),
        z.alias("z_score"),
        F.coalesce("document_id", F.lit("")).alias("document_id"),
        "detected_at",
        F.col("_context").alias("anomaly_summary"),
        F.col("_cause.root_cause_description").alias("root_cause_description"),
        F.col("_cause.confidence").alias("root_cause_confidence"),
        F.col("_cause.category").alias("category"),
        "options",
        F.try_element_at("options", F.lit(1))["title"].alias("immediate_action"),
        (level == "CRITICAL").alias("escalate"),
        F.coalesce("_pattern_identified", kind).alias("pattern_identified"),
        scores.resolution_minutes(
            F.coalesce("_estimated_resolution_minutes", F.lit(30)),
            F.try_element_at("options", F.lit(1))["estimated_minutes"],
        ).alias("estimated_resolution_minutes"),
        summary_text(level, kind, collection, z, F.col("_context"), F.col("options")).alias("summary"),
        F.col("_class.id").alias("class_id"),
        F.col("_class.name").alias("class_name"),
        "drift_detected",
        "total_confidence",
        "top_sources",
        "per_minute_usd",
        "if_unresolved_1hr_usd",
        "engineer_triage_usd",
        "total_worst_case_usd",
        "saved_usd",
        F.coalesce(flag, F.lit(False)).alias("ai_memory_poisoning"),
        F.lit("deterministic").alias("pipeline_status"),
        F.lit("pending").alias("correlation_status"),
    )
