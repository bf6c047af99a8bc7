"""Everything known about an incident in one nested row: trace, overlap, tool counts, impact and evidence.

Spans and tool counts of an incident are few (agents and tools), so they are
arrays. The calls of a span have no bound: they are numbered into pages of
bounded size, of which the row carries the first of each span and their number;
the others are rows of :func:`tool_call_pages`. No page, and no span, is
gathered in one task beyond the calls of its time bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.operators import audit, incident
from driftwatch.session import null_safe_join

PAGE = 100
BUCKET_MS = 3_600_000
IMPACT = [
    "per_minute_usd", "if_unresolved_1hr_usd", "engineer_triage_usd", "total_worst_case_usd", "saved_usd", "anomaly_mult", "collection_tier",
]


def tool_call_pages(trace: DataFrame, page: int = PAGE, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(incident_id, agent, bucket, part, calls): the tool calls of each span, in order, at most ``page`` to a row.

    Pages follow each other by (bucket, part): a bucket is a stretch of time
    of ``bucket_ms``, so a busy span is numbered bucket by bucket in many tasks.
    """
    at = F.col("at_ms")
    calls = audit.span_tool_calls(trace).withColumn("bucket", F.floor(at / bucket_ms))
    order = Window.partitionBy("incident_id", "agent", "bucket").orderBy("at_ms", "name")
    part = F.floor((F.row_number().over(order) - 1) / page)
    return (
        calls.withColumn("part", part)
        .groupBy("incident_id", "agent", "bucket", "part")
        .agg(F.array_sort(F.collect_list(F.struct("at_ms", "name"))).alias("calls"))
    )


def incident_details(
    incidents: DataFrame, trace: DataFrame, counts: DataFrame, agents: list[str] | None = None, page: int = PAGE,
) -> DataFrame:
    """One row per incident with its trace, overlap, tool counts, impact and evidence.

    ``incidents``: incident_id, collection_name, anomaly_type, z_score, and
    the inputs of the evidence (n_indexes, n_schema, n_slow, vector_score,
    drift_detected, n_added, n_removed); a struct ``estimated_dollar_impact``
    is taken as the impact where it has a cost, which is computed else.
    ``trace`` has one row per step (incident_id, agent, at_ms, tool_name,
    has_text); ``counts`` the rows of each collection. ``agents`` names those
    whose overlap is judged. Incidents without a trace have null in its place.
    """
    pages = tool_call_pages(trace, page)
    first = pages.groupBy("incident_id", "agent").agg(
        F.min_by("calls", F.struct("bucket", "part")).alias("tool_calls"), F.count(F.lit(1)).alias("n_pages")
    )
    summary = audit.span_summary(trace)
    spans = null_safe_join(summary, first, ["incident_id", "agent"], "left")
    span = F.struct(
        "start_ms", "agent", "end_ms", "duration_ms", "text_chunks", "n_tool_calls",
        F.coalesce("n_pages", F.lit(0)).alias("n_pages"),
        F.coalesce("tool_calls", F.array().cast("array<struct<at_ms:bigint,name:string>>")).alias("tool_calls"),
    )
    steps = spans.groupBy("incident_id").agg(
        F.struct((F.max("end_ms") - F.min("start_ms")).alias("total_ms"), F.array_sort(F.collect_list(span)).alias("steps")).alias("trace")
    )
    overlap = audit.span_overlap(summary, agents=agents)
    overlap = overlap.select("incident_id", F.struct(*[c for c in overlap.columns if c != "incident_id"]).alias("overlap"))
    used = audit.tool_counts(trace).groupBy("incident_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("tool_counts")
    )
    scored = incident.evidence_confidence(incident.dollar_impact(incidents, counts))
    fresh = F.struct(*IMPACT)
    if "estimated_dollar_impact" in incidents.columns:
        cached = F.col("estimated_dollar_impact")
        kept = incidents.schema["estimated_dollar_impact"].dataType.fieldNames()
        both = F.struct(*[(cached[c].cast(scored.schema[c].dataType) if c in kept else F.lit(None).cast(scored.schema[c].dataType)).alias(c) for c in IMPACT])
        impact, from_cache = F.when(cached["per_minute_usd"].isNotNull(), both).otherwise(fresh), cached["per_minute_usd"].isNotNull()
    else:
        impact, from_cache = fresh, F.lit(False)
    out = scored.select(
        "incident_id", "collection_name", "anomaly_type", "z_score", impact.alias("impact"),
        F.coalesce(from_cache, F.lit(False)).alias("impact_stored"), "evidence", "total_confidence", "confidence_pct", "top_sources",
    )
    for side in (steps, overlap, used):
        out = null_safe_join(out, side, "incident_id", "left")
    return out
