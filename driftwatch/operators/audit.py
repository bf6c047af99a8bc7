"""Approvals, tool-call audit, tamper seals, and trace spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.templates import DESTRUCTIVE_TOOLS
from driftwatch.functions.text import canonical_json, json_length, redact
from driftwatch.session import bounded, keys_of

# Columns that are no part of the sealed content.
UNSEALED = ["receipt", "receipt_verified", "receipt_pretty", "created_at", "_id"]


# --- approvals -----------------------------------------------------------------


def resolve_approvals(incidents: DataFrame, approvals: DataFrame) -> DataFrame:
    """Audit row per approval: the incident and the option it confirms.

    An unknown incident id falls back to the newest incident of the named
    collection, an unknown rank to the first option. Approvals that find no
    incident have status ``not_found``, those without options ``no_options``.
    """
    i = incidents.select(
        F.col("incident_id").alias("_by_id"), F.col("collection_name").alias("_coll"), F.col("options").alias("_opts")
    )
    newest = bounded(
        incidents.groupBy(F.col("collection_name").alias("_key")).agg(
            F.max_by(
                F.struct("incident_id", "collection_name", "options"), F.struct("created_at", "incident_id")
            ).alias("_latest")
        )
    )
    joined = approvals.join(i, approvals["incident_id"] == F.col("_by_id"), "left").join(
        newest, approvals["collection_name"] == F.col("_key"), "left"
    )
    hit = F.col("_by_id").isNotNull()
    options = F.when(hit, F.col("_opts")).otherwise(F.col("_latest.options"))
    ranked = F.filter("_options", lambda o: o["rank"] == F.col("option_rank"))
    chosen = F.coalesce(F.try_element_at(ranked, F.lit(1)), F.try_element_at("_options", F.lit(1)))
    return (
        joined.withColumn("_options", options)
        .withColumn("_found", F.when(hit, F.col("_by_id")).otherwise(F.col("_latest.incident_id")))
        .withColumn("_chosen", chosen)
        .select(
            approvals["incident_id"].alias("requested_id"),
            F.col("_found").alias("incident_id"),
            F.coalesce(F.when(hit, F.col("_coll")).otherwise(F.col("_latest.collection_name")), approvals["collection_name"]).alias(
                "collection"
            ),
            "option_rank",
            F.col("_chosen.title").alias("option_title"),
            F.col("_chosen.mcp_action").alias("mcp_action"),
            F.lit("operator").alias("approved_by"),
            "approved_at",
            F.lit("APPROVE").alias("action"),
            F.when(F.col("_found").isNull(), F.lit("not_found"))
            .when(F.col("_chosen").isNull(), F.lit("no_options"))
            .otherwise(F.lit("approved"))
            .alias("status"),
        )
    )


def apply_approvals(incidents: DataFrame, audit: DataFrame) -> DataFrame:
    """Incidents with approved, approved_option, approved_at; the last wins."""
    last = (
        audit.filter("status = 'approved'")
        .groupBy("incident_id")
        .agg(F.max_by(F.struct("option_rank", "approved_at"), F.struct("approved_at", "option_rank")).alias("a"))
    )
    return incidents.join(last, "incident_id", "left").select(
        *[F.col(c) for c in incidents.columns],
        F.col("a").isNotNull().alias("approved"),
        F.col("a.option_rank").alias("approved_option"),
        F.col("a.approved_at").alias("approved_at"),
    )


# --- tool calls --------------------------------------------------------------------


def audit_calls(calls: DataFrame, incidents: DataFrame) -> DataFrame:
    """Audit row per tool call: blocked if destructive and not approved.

    ``calls``: incident_id, tool_name, args map, response, started_at_ms,
    ended_at_ms, called_at. ``incidents``: incident_id, collection_name,
    approved.
    """
    side = incidents.select("incident_id", "collection_name", F.col("approved").alias("_approved"))
    joined = calls.join(side, "incident_id", "left")
    blocked = F.col("tool_name").isin(DESTRUCTIVE_TOOLS) & ~F.coalesce(F.col("_approved"), F.lit(False))
    return joined.select(
        "incident_id",
        "collection_name",
        "tool_name",
        redact(F.col("args")).alias("args"),
        F.coalesce(json_length(F.col("response")), F.lit(0)).alias("response_size_bytes"),
        F.when(blocked, F.lit(0).cast("long"))
        .otherwise((F.col("ended_at_ms") - F.col("started_at_ms")).cast("long"))
        .alias("latency_ms"),
        blocked.alias("was_blocked"),
        F.when(blocked, F.lit("AWAITING_APPROVAL")).otherwise(F.lit("OK")).alias("status"),
        F.col("called_at").alias("timestamp"),
    )


# --- seals ----------------------------------------------------------------------------


def _content_hash(df: DataFrame) -> Column:
    return F.sha2(canonical_json([c for c in df.columns if c not in UNSEALED]), 256)


def seal(df: DataFrame) -> DataFrame:
    """Adds ``receipt``: the hash of the canonical content of the row."""
    return df.withColumn("receipt", _content_hash(df))


def verify(df: DataFrame) -> DataFrame:
    """Adds has_receipt, verified, tampered and the reason."""
    has = F.col("receipt").isNotNull() & (F.col("receipt") != "")
    same = has & (F.col("receipt") == _content_hash(df))
    return df.withColumns(
        {
            "has_receipt": has,
            "verified": F.coalesce(same, F.lit(False)),
            "tampered": F.coalesce(has & ~same, F.lit(False)),
            "reason": F.when(~F.coalesce(has, F.lit(False)), F.lit("no receipt on document"))
            .when(same, F.lit("content unchanged"))
            .otherwise(F.lit("content was ALTERED after sealing")),
        }
    )


# --- trace spans ------------------------------------------------------------------------


def span_summary(events: DataFrame, key="incident_id", agent: str = "agent", at: str = "at_ms") -> DataFrame:
    """First and last event, duration, tool calls and texts per (key, agent)."""
    return (
        events.groupBy(*keys_of(key), agent)
        .agg(
            F.min(at).alias("start_ms"),
            F.max(at).alias("end_ms"),
            F.count("tool_name").alias("n_tool_calls"),
            F.count_if(F.col("has_text")).alias("text_chunks"),
        )
        .withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
    )


def span_tool_calls(events: DataFrame, key="incident_id", agent: str = "agent", at: str = "at_ms") -> DataFrame:
    """The tool calls of all spans as rows (key, agent, name, at)."""
    return events.filter(F.col("tool_name").isNotNull()).select(
        *keys_of(key), agent, F.col("tool_name").alias("name"), at
    )


def tool_counts(events: DataFrame, key="incident_id") -> DataFrame:
    """Calls per tool of each key."""
    return (
        events.filter(F.col("tool_name").isNotNull())
        .groupBy(*keys_of(key), F.col("tool_name").alias("name"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def span_overlap(spans: DataFrame, key="incident_id", agents: list[str] | None = None, agent: str = "agent") -> DataFrame:
    """Whether the spans of a key overlap, and the speedup that gave."""
    keys = keys_of(key)
    picked = spans if agents is None else spans.filter(F.col(agent).isin(agents))
    g = picked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.max("start_ms").alias("max_start"),
        F.min("end_ms").alias("min_end"),
        F.sum("duration_ms").alias("sequential_sum_ms"),
        (F.max("end_ms") - F.min("start_ms")).alias("wall"),
    )
    wall = F.when(F.col("n_spans") >= 2, F.col("wall")).otherwise(F.col("sequential_sum_ms"))
    return g.withColumn("parallel_wall_ms", wall).select(
        *keys,
        "n_spans",
        ((F.col("n_spans") >= 2) & (F.col("max_start") < F.col("min_end"))).alias("parallel_verified"),
        "sequential_sum_ms",
        "parallel_wall_ms",
        F.when(
            F.col("parallel_wall_ms") != 0,
            F.round(F.col("sequential_sum_ms") / F.greatest("parallel_wall_ms", F.lit(1).cast("long")), 2),
        )
        .otherwise(F.lit(1.0))
        .alias("speedup_factor"),
    )
