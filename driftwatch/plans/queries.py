"""Registered queries: each runs one operator over whole shared tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwatch.functions import text as tx
from driftwatch.functions import vectors
from driftwatch.functions.sizes import document_bytes
from driftwatch.operators import (
    anomaly,
    audit,
    baseline_state,
    correlate,
    details,
    drift,
    embedding_store,
    evaluate,
    feed,
    folds,
    incident,
    profile,
    runway,
    similar,
    threats,
    vector_index,
    velocity,
)
from driftwatch.plans import inputs as I
from driftwatch.session import checkpoint_dir, spread
from driftwatch.sources import buckets, tables
from driftwatch.streaming import jobs, streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def folder(spark: SparkSession, name: str) -> str:
    """A new table folder in the shared folder of the session."""
    return f"{checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def r6(column: str) -> Column:
    return F.round(F.col(column), 6).alias(column)


def iso(column: str | Column, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name or column)


def joined(column: str | Column, name: str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.array_join(c, ",").alias(name)


# --- sizes, profiles, health ------------------------------------------------------


@query
def size_baseline(spark, sf):
    b = profile.size_baseline(I.table(spark, sf, "documents"), "lang")
    return b.select("lang", r6("mean_bytes"), r6("stddev_bytes"), "sample_count")


@query
def full_baseline(spark, sf):
    b = profile.size_baseline(I.table(spark, sf, "documents"), "source", full=True)
    doubles = [
        "mean_bytes", "stddev_bytes", "p50_bytes", "p95_bytes", "p99_bytes", "warning_threshold_bytes",
        "critical_threshold_bytes",
    ]
    return b.select("source", "sample_count", "min_bytes", "max_bytes", *[r6(c) for c in doubles])


@query
def null_key_baseline(spark, sf):
    """Documents of one language lose their key, which is then a key of its own."""
    docs = I.table(spark, sf, "documents").withColumn("bytes", document_bytes(I.table(spark, sf, "documents")))
    b = profile.size_baseline(docs.withColumn("lang", F.expr("nullif(lang, 'fr')")), "lang", F.col("bytes"), full=True)
    return b.select("lang", "sample_count", "min_bytes", "max_bytes", *[r6(c) for c in ("mean_bytes", "stddev_bytes", "p50_bytes", "p99_bytes")])


@query
def null_key_zscores(spark, sf):
    events = I.table(spark, sf, "events").select("event_id", F.expr("nullif(event_type, 'view')").alias("event_type"), "value")
    return velocity.series_zscores(events, "event_type", "value").select("event_id", r6("z"))


@query
def null_key_refresh(spark, sf):
    docs = I.table(spark, sf, "documents").withColumn("bytes", document_bytes(I.table(spark, sf, "documents")))
    docs = docs.withColumn("lang", F.expr("nullif(lang, 'fr')"))
    halves = [profile.size_baseline(docs.filter(f"doc_id % 2 = {k}"), "lang", F.col("bytes")) for k in (1, 0)]
    r = drift.refresh_baseline(*halves, "lang")
    return r.select("lang", "drifted", "drift_pct", "action", "stable", r6("mean_bytes"), "sample_count")


@query
def health_card(spark, sf):
    docs = I.table(spark, sf, "documents")
    layout = docs.groupBy("lang").agg(F.count_if(F.col("source") == "").cast("int").alias("index_count"))
    card = profile.health_card(docs, "lang", layout=layout)
    return card.withColumn("issues", F.array_join("issues", " | "))


@query
def avg_health(spark, sf):
    return profile.average_health(profile.health_card(I.table(spark, sf, "documents"), "lang")).select(r6("avg_health"))


@query
def size_stats(spark, sf):
    s = profile.size_stats(I.table(spark, sf, "documents"), "lang")
    return s.select("lang", "mean_kb", "max_kb", r6("field_count"))


def document_anomalies(spark, sf) -> DataFrame:
    docs = I.table(spark, sf, "documents")
    return anomaly.size_anomalies(docs, profile.size_baseline(docs, "lang"), "lang", "doc_id", I.as_of())


@query
def size_anomalies(spark, sf):
    a = document_anomalies(spark, sf)
    return a.drop("description").withColumns({"confidence": F.round("confidence", 6), "detected_at": F.date_format("detected_at", "yyyy-MM-dd HH:mm:ss")})


@query
def baseline_state_loads(spark, sf):
    """Three loads of documents merged into the state: exact moments, percentiles within the sketch's rank error."""
    docs = I.table(spark, sf, "documents")
    sized = docs.withColumn("bytes", document_bytes(docs))
    path = folder(spark, "baseline")
    for tag in (0, 1, 1, 2):
        baseline_state.add_documents(path, sized.filter(F.col("doc_id") % 3 == tag), "lang", tag, F.col("bytes"))
    b = baseline_state.baseline_of_state(spark, path, "lang")
    ranks = sized.select("lang", "bytes").join(F.broadcast(b), "lang").groupBy("lang").agg(
        *[F.avg((F.col("bytes") < F.col(c)).cast("double")).alias(f"{c}_below") for c in baseline_state.QUANTILES],
        *[F.avg((F.col("bytes") <= F.col(c)).cast("double")).alias(f"{c}_upto") for c in baseline_state.QUANTILES],
    )
    near = F.lit(True)
    for c, p in baseline_state.QUANTILES.items():
        near = near & (F.col(f"{c}_below") - baseline_state.RANK_ERROR <= p) & (F.col(f"{c}_upto") + baseline_state.RANK_ERROR >= p)
    return b.join(ranks, "lang").select(
        "lang", "sample_count", "min_bytes", "max_bytes", *[F.round(c, 4).alias(c) for c in ("mean_bytes", "stddev_bytes", "critical_threshold_bytes")], near.alias("percentiles_near")
    )


@query
def refresh_baseline(spark, sf):
    docs = I.table(spark, sf, "documents").withColumn("bytes", document_bytes(I.table(spark, sf, "documents")))
    stored = profile.size_baseline(docs.filter("doc_id % 2 = 0 AND lang != 'es'"), "lang", F.col("bytes"))
    fresh = profile.size_baseline(docs.filter("doc_id % 2 = 1 OR lang = 'es'").filter("lang != 'fr'"), "lang", F.col("bytes"))
    r = drift.refresh_baseline(fresh, stored, "lang")
    return r.select("lang", "drifted", "drift_pct", "action", "stable", "reason", r6("mean_bytes"), r6("stddev_bytes"), "sample_count")


@query
def field_profile(spark, sf):
    return profile.field_profile(I.event_docs(spark, sf), "event_type", "doc")


@query
def schema_snapshot(spark, sf):
    s = profile.schema_snapshot(I.event_docs(spark, sf), "event_type", "doc")
    return s.select("event_type", "field", joined("types", "types"), "count")


@query
def live_schema(spark, sf):
    s = profile.live_schema(I.event_docs(spark, sf), "event_type", "doc")
    return s.select("event_type", "field", joined("types", "types"))


@query
def dynamic_sizes(spark, sf):
    """Baseline of dynamic documents by their own size."""
    d = spread(I.event_docs(spark, sf))
    b = profile.size_baseline(d, "event_type", document_bytes(d, doc="doc"), full=True)
    return b.select("event_type", "sample_count", "min_bytes", "max_bytes", r6("mean_bytes"), r6("stddev_bytes"), r6("p95_bytes"))


@query
def typed_schema_snapshot(spark, sf):
    s = profile.schema_snapshot(I.table(spark, sf, "events"), "event_type")
    return s.select("event_type", "field", joined("types", "types"), "count")


@query
def schema_examples(spark, sf):
    s = profile.schema_examples(I.event_docs(spark, sf), "event_type", "event_id", "doc")
    return s.select("event_type", "field", joined("types", "types"), "example", "field_count")


@query
def first_types(spark, sf):
    return profile.first_types(I.event_docs(spark, sf), "event_type", "event_id", "doc")


def _schemas(spark, sf) -> tuple[DataFrame, DataFrame]:
    events = I.table(spark, sf, "events")
    split = "timestamp'2024-01-16 00:00:00'"
    live = events.filter(F.expr(f"ts >= {split}")).withColumn("doc", F.parse_json(F.expr(I.EVENT_DOC)))
    old = events.filter(F.expr(f"ts < {split}")).withColumn("doc", F.parse_json(F.expr(I.OLD_EVENT_DOC)))
    return profile.live_schema(live, "event_type", "doc"), profile.live_schema(old, "event_type", "doc")


@query
def schema_changes(spark, sf):
    live, stored = _schemas(spark, sf)
    c = drift.schema_changes(live, stored, "event_type")
    return c.select("event_type", "field", joined("now", "now"), joined("was", "was"), "change")


@query
def schema_drift(spark, sf):
    live, stored = _schemas(spark, sf)
    changed = F.transform("type_changes", lambda x: F.concat(x["field"], F.lit(":"), F.array_join(x["was"], "/"), F.lit(">"), F.array_join(x["now"], "/")))
    return drift.schema_drift(live, stored, "event_type").select(
        "event_type", "drift_detected", joined("added_fields", "added_fields"), joined("removed_fields", "removed_fields"),
        joined(changed, "type_changes"), "live_field_count", "most_suspicious_field",
    )


@query
def schema_after_drift(spark, sf):
    live, stored = _schemas(spark, sf)
    return drift.schema_after_drift(live, stored, "event_type").select("event_type", "field", joined("types", "types"))


@query
def top_groups(spark, sf):
    t = profile.top_groups(I.table(spark, sf, "documents"), "source")
    return t.select("source", "n", r6("avg_bytes"))


@query
def coverage(spark, sf):
    docs = I.table(spark, sf, "documents").join(I.table(spark, sf, "labels"), "doc_id", "left")
    return profile.coverage(docs, "toxic", F.col("lang") == "en")


@query
def sample_rows(spark, sf):
    return profile.sample_rows(I.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100)


# --- velocity -----------------------------------------------------------------------


@query
def hourly_centroids(spark, sf):
    c = velocity.hourly_centroids(I.vectors(spark, sf), "label", "ts", "embedding")
    return c.select("label", iso("hour"), "docs", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query
def centroid_distances(spark, sf):
    c = velocity.hourly_centroids(I.vectors(spark, sf), "label", "ts", "embedding")
    return velocity.centroid_distances(c, "label").select("label", iso("hour"), "docs", "distance")


def _day_end() -> Column:
    return F.lit("2024-01-01 23:59:59").cast("timestamp")


def _velocity(spark, sf) -> DataFrame:
    return velocity.semantic_velocity(I.vectors(spark, sf), "label", "ts", "embedding", _day_end(), hours=24)


VELOCITY_COLUMNS = [
    "centroid_distance", "baseline_distance", "velocity_ratio", "velocity_zscore", "cumulative_drift",
    "cumulative_alert", "status",
]


@query
def semantic_velocity(spark, sf):
    v = _velocity(spark, sf)
    return v.select("label", *VELOCITY_COLUMNS, F.size("hourly_distances").alias("n_distances"), "window_hours")


def _shard_velocity(spark, sf) -> DataFrame:
    """Many small groups with quiet, noisy, shifted and random last hours."""
    rows = I.vectors(spark, sf, 12).withColumn("shard", F.expr("vec_id % 37")).withColumn("embedding", F.expr(I.SHARD_VECTOR_SPARK))
    return velocity.semantic_velocity(rows, "shard", "ts", "embedding", _day_end(), hours=24)


@query
def shard_velocity(spark, sf):
    return _shard_velocity(spark, sf).select("shard", *VELOCITY_COLUMNS)


@query
def velocity_anomalies(spark, sf):
    a = anomaly.velocity_anomalies(_shard_velocity(spark, sf), "shard", _day_end())
    return a.select(
        "collection_name", "anomaly_type", "z_score", "severity", "centroid_distance", "baseline_distance",
        F.round("confidence", 6).alias("confidence"),
    )


@query
def velocity_fallback(spark, sf):
    """Live rows are sparse for some labels, history is old for others."""
    v = I.vectors(spark, sf)
    live = v.filter("label < 4 AND vec_id % 3 = 0 OR label >= 7 AND vec_id < 10")
    past = v.filter("NOT (label < 4 AND vec_id % 3 = 0 OR label >= 7 AND vec_id < 10)").withColumn(
        "ts", F.when(F.col("label") < 7, F.col("ts")).otherwise(F.col("ts") - F.expr("INTERVAL 40 DAYS") + F.make_dt_interval(secs=(F.col("vec_id") % 1000).cast("decimal(18,6)")))
    )
    r = velocity.semantic_velocity(live, "label", "ts", "embedding", _day_end(), 24, past, "recent")
    return r.select("label", *VELOCITY_COLUMNS)


@query
def velocity_cards(spark, sf):
    return feed.velocity_cards(_shard_velocity(spark, sf)).select("shard", "status", "place")


@query
def anomaly_check(spark, sf):
    return feed.anomaly_check(_shard_velocity(spark, sf), "shard").drop("interpretation", "message")


@query
def backtest_velocity(spark, sf):
    rows = I.vectors(spark, sf, 8).withColumns({"trial": F.expr("vec_id % 5"), "poisoned": F.expr("label % 2 = 1")})
    return velocity.backtest_velocity(rows, "label", "trial", "poisoned", "ts", "embedding", _day_end(), 24)


@query
def peak_zscore(spark, sf):
    c = velocity.centroid_distances(velocity.hourly_centroids(I.vectors(spark, sf), "label", "ts", "embedding"), "label")
    series = c.filter(F.col("distance").isNotNull()).withColumn("h", F.hour("hour"))
    return velocity.peak_zscore(series, "label", "h", "distance").select("label", r6("peak_z"), F.col("peak_at").cast("int").alias("peak_at"))


# --- write rates and runway -------------------------------------------------------------


def _event_size(spark, sf) -> tuple[DataFrame, Column]:
    events = I.table(spark, sf, "events")
    return events, document_bytes(events)


@query
def write_stats(spark, sf):
    events, size = _event_size(spark, sf)
    w = runway.write_stats(events, "event_type", "ts", size)
    return w.select(
        "event_type", iso("window_start"), iso("window_end"), "event_count", r6("mean_bytes"), "max_bytes",
        r6("avg_doc_size_kb"), r6("max_doc_size_kb"),
    )


@query
def recent_counts(spark, sf):
    events = I.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    c = runway.recent_counts(events, "user_id", "ts", I.as_of())
    return c.select("user_id", "event_count", "current_rate_per_min", iso("window_end"))


def _runway(spark, sf, width: str, metric: str = "rate") -> DataFrame:
    events, size = _event_size(spark, sf)
    base = profile.size_baseline(events, "event_type", size)
    stats = runway.write_stats(events, "event_type", "ts", size, width)
    return runway.runway(stats, base, "event_type", I.as_of(), metric=metric)


@query
def runway_rate(spark, sf):
    r = _runway(spark, sf, "6 hours")
    return r.withColumn("projected_critical_at", F.date_format("projected_critical_at", "yyyy-MM-dd HH:mm:ss"))


@query
def runway_size(spark, sf):
    return _runway(spark, sf, "1 hour", "size").drop("projected_critical_at")


@query
def runway_fallback(spark, sf):
    """Daily windows per user over the whole month; sparse users fall back."""
    events = I.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = events.withColumn("grp", F.expr("CASE WHEN user_id % 10 = 0 THEN 'sparse' || user_id ELSE 'u' || user_id END"))
    size = document_bytes(events)
    base = profile.size_baseline(rows, "grp", size)
    stats = runway.write_stats(rows, "grp", "ts", size, "1 day")
    few = stats.filter("grp NOT LIKE 'sparse%' OR window_end <= timestamp'2024-01-03'")
    counts = runway.recent_counts(rows, "grp", "ts", I.as_of())
    r = runway.runway(few, base, "grp", I.as_of(), fallback=counts)
    return r.drop("projected_critical_at")


@query
def runway_null_key(spark, sf):
    """One of the keys is null: its rows count like those of any other key, and once."""
    events, size = _event_size(spark, sf)
    rows = events.withColumns({"ts": F.col("ts").cast("timestamp"), "g": F.expr("nullif(event_type, 'view')"), "_size": size})
    base = profile.size_baseline(rows, "g", F.col("_size"))
    stats = runway.write_stats(rows, "g", "ts", F.col("_size"), "6 hours")
    r = runway.runway(stats, base, "g", I.as_of(), fallback=runway.recent_counts(rows, "g", "ts", I.as_of()))
    named = r.select(F.coalesce("g", F.lit("view")).alias("event_type"), *[c for c in r.columns if c != "g"])
    return named.withColumn("projected_critical_at", F.date_format("projected_critical_at", "yyyy-MM-dd HH:mm:ss"))


# --- threats ---------------------------------------------------------------------------------


def _document_threats(spark, sf) -> DataFrame:
    return threats.scan_threats(I.planted_documents(spark, sf), "doc_id", ["text", "source", "system_prompt"])


def _flat(threats_: DataFrame, doc_id: str) -> DataFrame:
    return threats_.select(
        doc_id, "threat_detected", "severity", F.size("matches").alias("n_matches"),
        joined(F.col("matches.pattern_label"), "labels"),
        F.array_join(F.col("matches.matched_text"), "|").alias("matched"),
        joined("suspicious_fields", "suspicious_fields"), "confidence",
    )


@query
def scan_threats(spark, sf):
    return _flat(_document_threats(spark, sf), "doc_id")


@query
def scan_threats_nested(spark, sf):
    """The same texts inside dynamic documents, four levels down and in a list."""
    docs = I.planted_documents(spark, sf)
    nested = F.struct(
        F.struct(F.struct(F.struct(F.col("text").alias("raw")).alias("content")).alias("source")).alias("metadata"),
        F.array("lang", "text").alias("tags"),
        F.col("system_prompt"),
    )
    return _flat(threats.scan_threats(docs.select("doc_id", F.parse_json(F.to_json(nested)).alias("doc")), "doc_id", doc="doc"), "doc_id")


@query
def scan_requests(spark, sf):
    turns = I.table(spark, sf, "conversations").withColumn("text", F.expr(I.PLANTED_TURN))
    return threats.scan_requests(turns, "text").select("conv_id", "turn", "blocked")


@query
def escalate(spark, sf):
    docs = I.planted_documents(spark, sf).drop("system_prompt")
    base = profile.size_baseline(docs, "lang")
    found = anomaly.size_anomalies(docs, base, "lang", "doc_id", I.as_of())
    hits = _document_threats(spark, sf).withColumn("document_id", F.col("doc_id").cast("string"))
    e = anomaly.escalate(found, hits)
    return e.select("document_id", "collection_name", "z_score", "anomaly_type", "severity", "ai_memory_poisoning")


@query
def evaluate_threats(spark, sf):
    hits = _document_threats(spark, sf)
    truth = F.expr(f"doc_id % 97 IN ({', '.join(str(k) for k in I.PAYLOADS)})")
    return evaluate.evaluate(hits, truth, F.col("threat_detected"))


@query
def evaluate_sizes(spark, sf):
    docs = I.table(spark, sf, "documents")
    scored = anomaly.with_z(docs, profile.size_baseline(docs, "lang"), "lang", document_bytes(docs))
    both = scored.join(I.table(spark, sf, "labels"), "doc_id")
    return evaluate.evaluate(both, F.col("toxic") == 1, F.abs("z") >= 2.0, "lang")


# --- similarity ------------------------------------------------------------------------------------


def _label_queries(spark, sf) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    v = I.table(spark, sf, "embeddings").withColumn("ts", I.as_of())
    c = velocity.hourly_centroids(v, "label", "ts", "embedding")
    return c.select(F.col("label").alias("query"), "label", F.col("centroid").alias("embedding"))


def _vector_history(spark, sf) -> DataFrame:
    return I.table(spark, sf, "embeddings").withColumns(
        {
            "anomaly_type": F.expr(I.VECTOR_TYPE),
            "description": F.expr(I.VECTOR_TEXT),
            "resolution_time_minutes": F.expr("CAST(vec_id % 50 AS INT)"),
        }
    )


@query
def nearest(spark, sf):
    n = similar.nearest(_label_queries(spark, sf), I.table(spark, sf, "embeddings"), "query", "vec_id", "embedding", 10)
    return n.select("query", "vec_id", "score", "rank")


@query
def nearest_filtered(spark, sf):
    n = similar.nearest(
        _label_queries(spark, sf), I.table(spark, sf, "embeddings"), "query", "vec_id", "embedding", 10, match_on="label"
    )
    return n.select("query", "vec_id", "score", "rank")


@query
def similar_incidents(spark, sf):
    s = similar.similar(_label_queries(spark, sf), _vector_history(spark, sf), "query", "vec_id", "embedding")
    return s.select("query", "vec_id", "score", "rank", "anomaly_type", "description")


@query
def similar_summary(spark, sf):
    s = similar.similar(
        _label_queries(spark, sf), _vector_history(spark, sf), "query", "vec_id", "embedding", keep=["resolution_time_minutes"]
    )
    return similar.similar_summary(s, "query")


@query
def recent_same_type(spark, sf):
    a = I.table(spark, sf, "customer").select("c_custkey", F.expr("CASE c_nationkey % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'view' WHEN 2 THEN 'click' WHEN 3 THEN 'signup' WHEN 4 THEN 'purchase' ELSE 'unheard' END").alias("event_type"))
    h = I.table(spark, sf, "events").select("event_type", "event_id", "ts")
    return similar.recent_same_type(a, h, "c_custkey", "event_type", "ts", "event_id").select("c_custkey", "event_id", "event_type", "rank")


@query
def nearest_indexed(spark, sf):
    """The stored index beside the exact search: enough recall, fewer cells than there are."""
    e = I.table(spark, sf, "embeddings")
    path = folder(spark, "vectors")
    probes = vector_index.build_index(e, path, "vec_id", "embedding", 10)
    asked = e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query")
    found = vector_index.search_index(spark, path, asked, "query", "vec_id", "embedding", 10)
    exact = similar.nearest(asked, e, "query", "vec_id", "embedding", 10)
    both = found.select("query", "vec_id", F.lit(1).alias("hit")).join(exact.select("query", "vec_id", F.lit(1).alias("true")), ["query", "vec_id"], "full_outer")
    cells = spark.read.parquet(f"{path}/centroids").count()
    counted = both.agg(F.count_distinct("query").alias("queries"), F.count("hit").alias("found"), (F.count_if(F.col("hit").isNotNull() & F.col("true").isNotNull()) / F.count("true")).alias("recall"))
    return counted.select("queries", "found", (F.col("recall") >= 0.95).alias("recall_reached"), F.lit(probes < cells).alias("fewer_cells"))


@query
def text_similar(spark, sf):
    """Benchmark items against documents, each distinct text embedded once."""
    return embedding_store.text_similar_stored(
        I.table(spark, sf, "benchmark"), I.table(spark, sf, "documents"), "item_id", "doc_id", "text", 3, folder(spark, "texts")
    )


@query
def embedded_once(spark, sf):
    """Two loads of overlapping texts: the store holds each distinct text once."""
    path = folder(spark, "texts")
    d, b = I.table(spark, sf, "documents"), I.table(spark, sf, "benchmark")
    embedding_store.embed_once(path, d.filter("doc_id % 3 != 0").select("text"), "text")
    again = embedding_store.embed_once(path, d.select("text").unionByName(b.select("text")), "text")
    return again.agg(F.count("embedding").alias("texts")).select(F.lit(embedding_store.stored_texts(spark, path)).alias("embedded"), "texts")


@query
def backfill_embeddings(spark, sf):
    e = I.table(spark, sf, "events").select(
        "event_id", F.expr("CASE WHEN event_id % 3 = 0 THEN 'value ' || props END").alias("description"),
        F.col("event_type").alias("anomaly_type"), F.expr(I.COLLECTION_OF_EVENT).alias("collection_name"),
        F.expr("CASE WHEN event_id % 2 = 0 THEN transform(sequence(1, 384), x -> CAST(x AS FLOAT)) END").alias("embedding"),
    )
    done = tables.backfill_embeddings(e, similar.hashing_embedder)
    return done.groupBy("collection_name").agg(
        F.count(F.lit(1)).alias("n"), F.count("embedding").alias("n_embedded"),
        F.count_if(F.element_at("embedding", 384) == 384.0).alias("n_kept"), F.min(F.size("embedding")).alias("width"),
    )


# --- incidents -----------------------------------------------------------------------------------------


def _evidence(spark, sf) -> DataFrame:
    return I.table(spark, sf, "events").select(
        "event_id",
        F.expr("CAST(user_id % 4 AS INT)").alias("n_indexes"),
        F.expr("CAST(event_id % 3 AS INT)").alias("n_schema"),
        F.expr("CAST(event_id % 8 AS INT)").alias("n_slow"),
        F.expr("(event_id % 101) / 101.0D").alias("vector_score"),
        F.expr("event_id % 2 = 0").alias("drift_detected"),
        F.expr("CAST(event_id % 5 AS INT)").alias("n_added"),
        F.expr("CAST(user_id % 3 AS INT)").alias("n_removed"),
        F.expr("CAST(user_id % 2 AS INT)").alias("n_changed"),
        F.expr("(user_id % 10) / 10.0D").alias("advisor_confidence"),
        F.expr("value / 4 - 5").alias("z_score"),
    )


@query
def evidence_confidence(spark, sf):
    e = incident.evidence_confidence(_evidence(spark, sf))
    return e.select("event_id", "total_confidence", joined("top_sources", "top_sources"))


@query
def evidence_confidence_ui(spark, sf):
    e = incident.evidence_confidence(_evidence(spark, sf), "ui")
    return e.select("event_id", r6("schema_score"), r6("z_score_norm"), r6("total_confidence"))


def _counts(anomalies: DataFrame) -> DataFrame:
    return anomalies.filter("collection_name != 'misc'").groupBy("collection_name").agg((F.count(F.lit(1)) * 977).alias("doc_count"))


@query
def dollar_impact(spark, sf):
    a = I.named_anomalies(spark, sf)
    d = incident.dollar_impact(a, _counts(a))
    return d.select(
        "event_id", "per_minute_usd", "if_unresolved_1hr_usd", "engineer_triage_usd", "total_worst_case_usd", "saved_usd",
        "anomaly_mult", "collection_tier",
    )


@query
def incident_reports(spark, sf):
    a = I.named_anomalies(spark, sf)
    r = incident.incident_reports(a, _counts(a))
    return r.select(
        "document_id", "collection_name", "anomaly_type", "severity", "anomaly_summary", "root_cause_description",
        "root_cause_confidence", "category", "immediate_action", "escalate", "estimated_resolution_minutes", "class_id",
        "class_name", "total_confidence", "per_minute_usd", "total_worst_case_usd", "summary",
    )


@query
def document_incidents(spark, sf):
    """The main path: sizes, threats of the flagged documents, escalation, report."""
    docs = I.planted_documents(spark, sf)
    own = [c for c in docs.columns if c != "system_prompt"]
    base = profile.size_baseline(docs, "lang", document_bytes(docs, own))
    found = anomaly.size_anomalies(docs, base, "lang", "doc_id", I.as_of(), document_bytes(docs, own))
    enriched = streams.enrich(found, docs, "doc_id", columns=["text", "source", "system_prompt"])
    counts = docs.groupBy(F.col("lang").alias("collection_name")).agg(F.count(F.lit(1)).alias("doc_count"))
    r = incident.incident_reports(enriched, counts)
    return r.select(
        "document_id", "collection_name", "anomaly_type", "severity", "immediate_action", "class_id",
        "estimated_resolution_minutes", "per_minute_usd", "ai_memory_poisoning",
    )


@query
def merge_replies(spark, sf):
    """Raw replies of mixed quality over computed values."""
    raw = F.expr(
        "CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '```json\\n' || props || '\\n```' "
        "WHEN 2 THEN 'Here it is: ' || props || ' done' WHEN 3 THEN 'no json here' ELSE NULL END"
    )
    rows = I.table(spark, sf, "events").select(
        "event_id", tx.lenient_json(raw).alias("reply"), F.parse_json(F.lit('{"k":-1}')).alias("computed")
    )
    m = incident.merge_replies(rows, [("reply", "computed")])
    return m.select("event_id", "enriched", F.variant_get("computed", "$.k", "int").alias("k"))


# --- correlation and sequential rules ------------------------------------------------------------------------


def _event_anomalies(spark, sf) -> DataFrame:
    return I.table(spark, sf, "events").select(
        F.expr(I.COLLECTION_OF_EVENT).alias("collection_name"), F.col("ts").cast("timestamp").alias("detected_at"), "event_id"
    )


@query
def correlation_windows(spark, sf):
    w = correlate.correlation_windows(_event_anomalies(spark, sf), I.MONITORED)
    return w.select(
        iso("window_start"), iso("window_end"), "collection_key", "patient_zero", "n_anomalies", "confidence", "severity"
    )


@query
def suppress_stored(spark, sf):
    w = correlate.correlation_windows(_event_anomalies(spark, sf), I.MONITORED).withColumn("created_at", F.col("window_end"))
    stored = w.filter("n_anomalies >= 3").select("collection_key", (F.col("created_at") - F.expr("INTERVAL 7 MINUTES")).alias("created_at"))
    s = correlate.suppress_stored(w, stored)
    return s.select(iso("window_start"), "collection_key")


@query
def suppress_refires(spark, sf):
    e = I.table(spark, sf, "events")
    return folds.suppress_refires(e, "event_type", "ts", "event_id").select("event_type", "event_id", iso("ts"))


@query
def correlated_refires(spark, sf):
    """Cluster events, at most one per collection set and hour."""
    w = correlate.correlation_windows(_event_anomalies(spark, sf), I.MONITORED)
    kept = folds.suppress_refires(w.withColumn("ts", F.col("window_end")), "collection_key", "ts", "window_start")
    return kept.select("collection_key", iso("ts"))


@query
def throttle_checks(spark, sf):
    e = I.table(spark, sf, "events")
    t = folds.throttle_checks(e, "event_type", "ts", "event_id", 1800)
    return t.select("event_type", "event_id", "checked")


@query
def rate_limit(spark, sf):
    e = I.table(spark, sf, "events")
    return folds.rate_limit(e, "user_id", "ts", "event_id", 3, 86400).select("user_id", "event_id", "admitted")


@query
def circuit_state(spark, sf):
    e = I.table(spark, sf, "events").withColumn("failed", F.expr("event_type IN ('error', 'view', 'click')"))
    return folds.circuit_state(e, "user_id", "ts", "event_id", "failed", 3, 86400).select("user_id", "event_id", "ran")


# --- audit -------------------------------------------------------------------------------------------------------


def _approvals(spark, sf) -> tuple[DataFrame, DataFrame]:
    incidents = I.table(spark, sf, "events").select(
        F.expr("'i' || event_id").alias("incident_id"),
        F.col("event_type").alias("collection_name"),
        incident.remediation_options(F.expr(I.ANOMALY_KIND)).alias("options"),
        F.col("ts").alias("created_at"),
    )
    approvals = I.table(spark, sf, "orders").select(
        F.expr("'i' || CAST(o_orderkey AS STRING)").alias("incident_id"),
        F.expr("CASE o_custkey % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'view' WHEN 2 THEN 'click' WHEN 3 THEN 'signup' WHEN 4 THEN 'purchase' ELSE 'unheard' END").alias("collection_name"),
        F.expr("CAST(o_orderkey % 4 + 1 AS INT)").alias("option_rank"),
        F.col("o_orderdate").alias("approved_at"),
    )
    return incidents, approvals


@query
def resolve_approvals(spark, sf):
    a = audit.resolve_approvals(*_approvals(spark, sf))
    return a.select("requested_id", "incident_id", "collection", "option_rank", "option_title", "status")


@query
def apply_approvals(spark, sf):
    incidents, approvals = _approvals(spark, sf)
    done = audit.apply_approvals(incidents, audit.resolve_approvals(incidents, approvals))
    return done.select("incident_id", "approved", "approved_option", iso("approved_at"))


@query
def audit_calls(spark, sf):
    events = I.table(spark, sf, "events")
    calls = events.select(
        F.expr("'i' || user_id").alias("incident_id"),
        F.expr(I.TOOL).alias("tool_name"),
        F.create_map(F.lit("Password"), F.col("event_type"), F.lit("query"), F.col("props")).alias("args"),
        F.struct(F.col("user_id"), F.col("event_type")).alias("response"),
        F.lit(0).cast("long").alias("started_at_ms"),
        F.expr("event_id % 50").alias("ended_at_ms"),
        F.col("ts").alias("called_at"),
        "event_id",
    ).filter("tool_name IS NOT NULL")
    incidents = events.select("user_id").distinct().select(
        F.expr("'i' || user_id").alias("incident_id"), F.expr("'c' || user_id % 6").alias("collection_name"),
        F.expr("user_id % 2 = 0").alias("approved"),
    )
    a = audit.audit_calls(calls, incidents)
    return a.select(
        "incident_id", "collection_name", "tool_name", F.col("args")["Password"].alias("password"), F.col("args")["query"].alias("query"),
        "response_size_bytes", "latency_ms", "was_blocked", "status", iso("timestamp"),
    )


@query
def seal_verify(spark, sf):
    sealed = audit.seal(I.table(spark, sf, "orders"))
    edited = sealed.withColumns(
        {
            "o_totalprice": F.expr("CASE WHEN o_orderkey % 1000 = 7 THEN o_totalprice + 0.01 ELSE o_totalprice END"),
            "receipt": F.expr("CASE WHEN o_orderkey % 1000 = 8 THEN NULL ELSE receipt END"),
        }
    )
    return audit.verify(edited).select("o_orderkey", "has_receipt", "verified", "tampered")


def _trace(spark, sf) -> DataFrame:
    return I.table(spark, sf, "events").select(
        F.expr("'i' || user_id").alias("incident_id"), F.col("event_type").alias("agent"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.expr(I.TOOL).alias("tool_name"), (F.col("value") > 20).alias("has_text"),
    )


@query
def span_summary(spark, sf):
    return audit.span_summary(_trace(spark, sf))


@query
def span_overlap(spark, sf):
    return audit.span_overlap(audit.span_summary(_trace(spark, sf)), agents=["error", "view", "click", "signup"])


def _traced_incidents(spark, sf) -> DataFrame:
    """The newest event of each user as the incident its trace belongs to; every third has a stored impact."""
    newest = I.table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    e = I.table(spark, sf, "events").select("event_id", "user_id")
    signals = newest.join(e, ["event_id", "user_id"]).select(
        "event_id",
        F.expr("'i' || user_id").alias("incident_id"),
        F.expr("user_id % 4").alias("n_indexes"), F.expr("event_id % 3").alias("n_schema"), F.expr("event_id % 8").alias("n_slow"),
        F.expr("(event_id % 101) / 101").alias("vector_score"), F.expr("event_id % 2 = 0").alias("drift_detected"),
        F.expr("event_id % 5").alias("n_added"), F.expr("user_id % 3").alias("n_removed"),
        F.expr("CASE WHEN user_id % 3 = 0 THEN named_struct('per_minute_usd', 1.5D, 'saved_usd', 2.0D) END").alias("estimated_dollar_impact"),
    )
    return signals.join(I.named_anomalies(spark, sf), "event_id")


@query
def incident_details(spark, sf):
    d = details.incident_details(_traced_incidents(spark, sf), _trace(spark, sf), _counts(I.named_anomalies(spark, sf)), ["error", "view", "click", "signup"], 2)
    step = lambda s: F.concat_ws(":", s["agent"], s["start_ms"].cast("string"), s["duration_ms"].cast("string"), s["n_tool_calls"].cast("string"))
    calls = F.flatten(F.transform("trace.steps", lambda s: F.transform(s["tool_calls"], lambda c: F.concat_ws(":", s["agent"], c["name"]))))
    return d.select(
        "incident_id", F.col("trace.total_ms").alias("total_ms"), joined(F.transform("trace.steps", step), "steps"),
        F.array_join(F.array_sort(calls), ",").alias("first_calls"),
        F.col("overlap.parallel_verified").alias("parallel_verified"), F.col("overlap.speedup_factor").alias("speedup_factor"),
        joined(F.transform(F.map_entries("tool_counts"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), "tools"),
        F.col("impact.per_minute_usd").alias("per_minute_usd"), F.col("impact.total_worst_case_usd").alias("total_worst_case_usd"), "impact_stored",
        "total_confidence", joined("top_sources", "top_sources"),
    )


@query
def tool_counts(spark, sf):
    return audit.tool_counts(_trace(spark, sf))


@query
def expected_agents(spark, sf):
    e = feed.expected_seen(_trace(spark, sf).filter("tool_name IS NOT NULL").withColumn("at", F.concat("agent", F.lit(":"), "tool_name")), "incident_id", "at", ["error:find", "view:find", "click:aggregate"])
    return e.select("incident_id", joined("seen", "seen"), joined("missing", "missing"), "complete")


# --- feeds, lookups, keyed writes ---------------------------------------------------------------------------------------


@query
def newest(spark, sf):
    return feed.newest(I.table(spark, sf, "events"), "ts", "event_id", "anomalies", 500).select("event_id", iso("ts"), "event_type")


@query
def replay(spark, sf):
    r = feed.replay(I.table(spark, sf, "events"), "ts", "event_id")
    return r.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ts", "event_id"))).select("place", "event_id", iso("ts"))


@query
def latest_per_key(spark, sf):
    return feed.latest_per_key(I.table(spark, sf, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", iso("ts"), "event_type", "value")


@query
def dedup_feed(spark, sf):
    e = I.table(spark, sf, "events").select(F.expr("'a' || event_id % 700").alias("id"), "ts", "event_type")
    return feed.dedup_feed(e, "id", "ts").select("id", iso("ts"), "event_type")


@query
def flagged_documents(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return feed.flagged_documents(document_anomalies(spark, sf), docs, "doc_id").select("document_id", "source", "n_chars", "z_score")


@query
def flagged_by_collection(spark, sf):
    """Document ids that repeat in other collections: an anomaly meets its own document only."""
    docs = I.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    more = docs.select("doc_id", F.concat("lang", F.lit("-old")).alias("lang"), (F.col("n_chars") + 1).alias("n_chars"))
    found = feed.flagged_documents(document_anomalies(spark, sf), docs.unionByName(more), "doc_id", "lang")
    return found.select("document_id", "collection_name", "n_chars", "z_score")


@query
def lookup(spark, sf):
    ids = I.table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    return feed.lookup(I.table(spark, sf, "documents"), ids, "doc_id").select("doc_id", "lang", "source")


@query
def filters(spark, sf):
    """Range, membership and null-aware inequality over a nested column."""
    e = I.table(spark, sf, "events").select(
        "event_id", F.struct(F.col("event_type"), F.expr("CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 2 = 0 END").alias("done")).alias("event"), "value"
    )
    kept = e.filter(
        feed.not_equal(F.col("event.done"), True) & F.col("event.event_type").isin("view", "click") & (F.col("value") >= 5) & (F.col("value") < 60)
    )
    return kept.select("event_id", F.col("event.event_type").alias("event_type"), "value")


@query
def system_status(spark, sf):
    e = I.table(spark, sf, "events")
    dead = e.select(F.expr("CAST(event_id % 5 AS INT)").alias("retry_count"))
    return feed.system_status(dead, I.table(spark, sf, "embeddings"), e.withColumn("updated_at", F.col("ts")), "event_type")


@query
def stream_health(spark, sf):
    e = I.table(spark, sf, "events").select(F.expr(I.COLLECTION_OF_EVENT).alias("stream"), F.col("ts").alias("updated_at"))
    return feed.stream_health(e, "stream").select("stream", iso("updated_at"))


@query
def result_summary(spark, sf):
    return evaluate.result_summary(I.table(spark, sf, "events"), "event_type", F.expr("user_id % 4 != 0"), F.col("value")).select(
        "event_type", "passed", "failed", F.round("total_ms", 4).alias("total_ms"), r6("mean_ms")
    )


@query
def slowest(spark, sf):
    return evaluate.slowest(I.table(spark, sf, "events"), "event_type", "value", "event_id", 5).select("event_type", "event_id", "value", "rank")


@query
def upsert_latest(spark, sf):
    o = I.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    keyed = o.withColumn("k", F.expr("o_orderkey % 4000"))
    old, new = keyed.filter("o_orderkey % 3 = 0"), keyed.filter("o_orderkey % 3 != 0")
    ordered = [d.withColumn("at", F.struct("o_orderdate", "o_orderkey")) for d in (old, new)]
    return tables.upsert(*ordered, "k", "at").select("k", "o_orderkey", "o_totalprice")


def _bucketed_orders(spark, sf) -> str:
    """Orders upserted in three steps, the last one for a single key."""
    o = I.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    keyed = o.withColumns({"k": F.expr("o_orderkey % 4000"), "at": F.struct("o_orderdate", "o_orderkey")})
    path = folder(spark, "orders")
    for part in ("o_orderkey % 3 = 0", "o_orderkey % 3 = 1", "o_orderkey % 3 = 2"):
        buckets.upsert_buckets(path, keyed.filter(part), "k", "at", 16)
    return path


@query
def upsert_buckets(spark, sf):
    path = _bucketed_orders(spark, sf)
    return buckets.read_table(spark, path).select("k", "o_orderkey", "o_totalprice")


@query
def delete_buckets(spark, sf):
    path = _bucketed_orders(spark, sf)
    buckets.delete_from_buckets(spark, path, F.col("k") == 17, "k")
    return buckets.read_table(spark, path).select("k", "o_orderkey", "o_totalprice")


@query
def patch(spark, sf):
    c = I.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    u = c.filter("c_custkey % 3 = 0").select(
        "c_custkey", F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'PATCHED' END").alias("c_mktsegment"), F.lit("x").alias("note")
    )
    return tables.patch(c, u, "c_custkey")


@query
def merge_keep_existing(spark, sf):
    e = I.table(spark, sf, "events")
    sink = e.filter("event_id % 4 = 0").select("user_id", F.expr("CAST(event_id % 30 AS INT)").alias("slot")).distinct()
    new = e.select("user_id", F.expr("CAST(event_id % 30 AS INT)").alias("slot"))
    return tables.keep_existing(sink, new, ["user_id", "slot"])


@query
def delete_where(spark, sf):
    e = I.table(spark, sf, "events").withColumn("tag", F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 2 = 0 END"))
    return tables.delete_where(e, F.col("tag")).select("event_id", "tag")


@query
def dead_letter(spark, sf):
    e = I.table(spark, sf, "events").withColumn("props", F.expr("CASE WHEN event_id % 50 = 0 THEN props || '}' WHEN event_id % 50 = 1 THEN NULL ELSE props END"))
    good, bad = tables.split_dead_letter(e.select("event_id", "props"), tables.json_error("props"), I.as_of())
    return good.select("event_id", "props", F.lit(None).cast("string").alias("error_type"), F.lit(None).cast("string").alias("error_message")).unionByName(
        bad.select("event_id", "props", "error_type", "error_message")
    )


@query
def shorten(spark, sf):
    """Long values of a map cut at 300 characters where the whole is too long."""
    d = I.table(spark, sf, "documents")
    m = tx.shorten_map(F.create_map(F.lit("text"), F.col("text")))
    return d.select("doc_id", F.length(m["text"]).alias("kept"), F.col("n_chars"))


@query
def duplicate_keys(spark, sf):
    h = _vector_history(spark, sf)
    return h.select("vec_id", tx.duplicate_key(F.col("anomaly_type"), F.col("description")).alias("dup_key"))


@query
def size_context(spark, sf):
    docs = I.table(spark, sf, "documents")
    c = incident.with_size_context(document_anomalies(spark, sf), profile.size_stats(docs, "lang"), "lang")
    return c.select("document_id", "collection_name", "mean_kb", "max_kb")


@query
def series_zscores(spark, sf):
    z = velocity.series_zscores(I.table(spark, sf, "events").select("event_id", "event_type", "value"), "event_type", "value")
    return z.select("event_id", r6("z"))


@query
def document_strings(spark, sf):
    w = threats.document_strings(I.event_docs(spark, sf), "event_id", "doc")
    return w.select("event_id", "field", "text")


@query
def fields_present(spark, sf):
    d = I.event_docs(spark, sf)
    return d.groupBy("event_type").agg(
        F.count_if(feed.has_path("doc", "$.note")).alias("with_note"), F.count_if(feed.has_path("doc", "$.geo.lat")).alias("with_lat"),
        F.count_if(~feed.has_path("doc", "$.tags[1]")).alias("without_tag"),
    )


@query
def cosine_distances(spark, sf):
    v = I.table(spark, sf, "embeddings")
    flipped = F.transform("embedding", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    none = F.transform("embedding", lambda x: x * 0)
    return v.select("vec_id", F.round(vectors.cosine_distance(F.col("embedding"), flipped), 6).alias("flipped"), vectors.cosine_distance(F.col("embedding"), none).alias("zero"))


@query
def correlated_events(spark, sf):
    """The look-back before ``as_of`` covers the whole table."""
    c = correlate.correlated_events(_event_anomalies(spark, sf), I.as_of(), I.MONITORED, minutes=60 * 24 * 60)
    return c.select("collection_key", "patient_zero", "n_anomalies", "confidence", "severity", iso("window_end"))


@query
def cluster_list(spark, sf):
    w = correlate.correlation_windows(_event_anomalies(spark, sf), I.MONITORED).withColumn("created_at", F.col("window_end"))
    return feed.cluster_list(w, 99).select("collection_key", iso("created_at"), "severity")


@query
def incident_list(spark, sf):
    a = I.named_anomalies(spark, sf)
    r = incident.incident_reports(a, _counts(a)).withColumns({"incident_id": F.col("document_id"), "created_at": F.col("detected_at")})
    return feed.incident_list(r).select("incident_id", "collection_name", F.col("top_remediation.title").alias("title"), "per_minute_usd")


@query
def span_tool_calls(spark, sf):
    return audit.span_tool_calls(_trace(spark, sf))


# --- streams run to the end of the table ---------------------------------------------------------------------------------------


LANG_OF_TYPE = "CASE event_type WHEN 'view' THEN 'en' WHEN 'click' THEN 'fr' WHEN 'purchase' THEN 'de' WHEN 'signup' THEN 'es' END"
LANG_OF_LABEL = "CASE label WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' WHEN 3 THEN 'es' END"
# Two documents a minute, so that checks of a language are often too soon.
DOC_TIME = "timestamp_seconds(1704067200 + doc_id * 30)"


@query
def stream_incidents(spark, sf):
    """The main path over documents in two deliveries: all signals, with checks throttled from batch to batch."""
    docs = I.planted_documents(spark, sf).withColumn("ts", F.expr(DOC_TIME))
    own = ["doc_id", "text", "lang", "source", "n_chars"]
    base = profile.size_baseline(docs, "lang", document_bytes(docs, own))
    counts = docs.groupBy(F.col("lang").alias("collection_name")).agg(F.count(F.lit(1)).alias("doc_count"))
    live, stored = _schemas(spark, sf)
    path = folder(spark, "incidents")
    tables.replace(base, f"{path}/base")
    tables.replace(counts, f"{path}/counts")

    def reports(due: DataFrame) -> dict[str, DataFrame]:
        def of(df: DataFrame, name: str) -> DataFrame:
            return df.withColumn("collection_name", F.expr(name)).join(due, "collection_name", "left_semi")

        return {
            "drift": of(drift.schema_drift(live, stored, "event_type"), LANG_OF_TYPE),
            "velocity": of(_velocity(spark, sf), LANG_OF_LABEL),
            "runways": of(_runway(spark, sf, "6 hours"), LANG_OF_TYPE),
        }

    write = streams.enriched_incident_batch(
        lambda: tables.current(spark, f"{path}/base"), lambda: tables.current(spark, f"{path}/counts"), reports,
        f"{path}/throttle", f"{path}/anomalies", f"{path}/reports", "lang", "doc_id", "ts", own, scanned=["text", "source", "system_prompt"],
    )
    n = docs.count()
    for i in range(2):
        # a delivery is written by all tasks and read as one batch
        docs.filter(F.least(F.floor(F.col("doc_id") * 2 / n), F.lit(1)) == i).write.mode("append").parquet(f"{path}/in")
        streams.start(spark.readStream.schema(docs.schema).parquet(f"{path}/in"), f"{path}/log", write).awaitTermination()
    found = spark.read.parquet(f"{path}/anomalies").select(
        "collection_name", "document_id", "checked", "schema_drift", "semantic_velocity", F.col("runway.status").alias("runway_status"),
    )
    made = spark.read.parquet(f"{path}/reports").select("document_id", "anomaly_type", "severity", "drift_detected", "per_minute_usd")
    return found.join(made, "document_id")


@query
def find_values(spark, sf):
    """The fifty highest values of events that have properties and are no views, scanned from the folder."""
    events = tables.scan(spark, f"{sf}/events.parquet")
    wanted = feed.has_field(F.col("props")) & feed.not_equal(F.col("event_type"), "view")
    order = [F.desc_nulls_last("value"), F.asc("event_id")]
    return feed.find(events, wanted, ["event_id", "event_type", "value"], 50, order)


@query
def cached_card(spark, sf):
    """The health card, cached under one name after an older one and read back."""
    path = folder(spark, "card")
    card = health_card(spark, sf)
    tables.cache_card(card.filter("health_score < 0"), path)
    tables.cache_card(card, path)
    return tables.current(spark, path)


@query
def plain_fields(spark, sf):
    """Ids and times of all events from their wrapped (``$oid``, ``$date``) and their plain texts."""
    number, text = F.format_string("%024d", "event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    wrapped = F.col("event_id") % 2 == 0
    raw = I.table(spark, sf, "events").select(
        F.when(wrapped, F.to_json(F.struct(number.alias("$oid")))).otherwise(number).alias("id"),
        F.when(wrapped, F.to_json(F.struct(text.alias("$date")))).otherwise(text).alias("at"),
    )
    return raw.select(tx.plain_id(F.col("id")).alias("id"), tx.iso_text(tx.plain_timestamp(F.col("at"))).alias("at"))


QUERIES.update(jobs.QUERIES)
