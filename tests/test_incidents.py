import datetime
import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftwatch.functions import scores, templates as T
from driftwatch.functions import text as tx
from driftwatch.operators import anomaly, audit, correlate, drift, feed, incident, profile, runway, similar

T0 = datetime.datetime(2024, 1, 1)


def minutes(n):
    return T0 + datetime.timedelta(minutes=n)


# --- cost and evidence ---------------------------------------------------------


def cost(rows, z, kind, collection):
    qps = max(max(rows if rows is not None else 10_000, 1) / 10_000, 0.1)
    deg = 1 + min(abs(z or 0), 300) / 50
    m = round(qps * deg * T.TYPE_MULTIPLIER.get(kind or "", 1.0) * T.COLLECTION_TIER.get((collection or "unknown").lower(), 1.0) * 0.15, 2)
    hour, own = round(m * 60, 2), round(m * 11, 2)
    return m, hour, round(hour + 510, 2), max(round(510 - own + hour - own, 2), 0)


IMPACT = [
    ("movies", 100.0, "DOC_SIZE_SPIKE"), ("movies", -5.0, "DOC_SIZE_SPIKE"), ("comments", 0.0, "SCHEMA_DRIFT"),
    ("nonexistent", 3.5, "AI_MEMORY_POISONING"), ("", 2.5, "SEMANTIC_VELOCITY_SPIKE"), ("movies", 3.0, "NEW_TYPE"),
    ("users", 0.001, "DOC_SIZE_SPIKE"), (None, 4.0, "SCHEMA_DRIFT"), ("ORDERS", 900.0, None), ("orders", None, "UNKNOWN"),
]


def test_dollar_impact(spark):
    a = spark.createDataFrame([(i, *c) for i, c in enumerate(IMPACT)], "i int, collection_name string, z_score double, anomaly_type string")
    counts = {"movies": 250_000, "orders": 40, "users": 12_345}
    n = spark.createDataFrame(list(counts.items()), "collection_name string, doc_count bigint")
    for r in incident.dollar_impact(a, n).collect():
        c, z, k = IMPACT[r["i"]]
        got = (r["per_minute_usd"], r["if_unresolved_1hr_usd"], r["total_worst_case_usd"], r["saved_usd"])
        assert got == pytest.approx(cost(counts.get(c), z, k, c), abs=0.011)
        assert r["engineer_triage_usd"] == 510.0


def test_evidence(spark):
    rows = [(2, 1, 9, 0.8, True, 2, 2, -7.5), (0, 0, 0, 0.0, False, 0, 0, 0.0), (9, 9, 9, 1.0, True, 5, 5, 50.0), (0, 0, 0, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "n_indexes int, n_schema int, n_slow int, vector_score double, drift_detected boolean, n_added int, n_removed int, z_score double")
    got = incident.evidence_confidence(df).collect()
    pa = min(1, 2 * 0.3 + 0.15 + 5 * 0.05)
    assert got[0]["total_confidence"] == round(pa * 0.35 + 0.24 + round(min(1, 0.9 + 0.2) * 0.2, 3) + round(0.75 * 0.15, 3), 3)
    assert got[0]["top_sources"] == ["advisor", "vector_search"]
    assert got[1]["total_confidence"] == 0.03
    assert got[2]["total_confidence"] == 1.0
    assert got[3]["total_confidence"] == 0.03 and got[3]["top_sources"] == ["schema_drift", "advisor"]


def test_report(spark):
    rows = [
        ("movies", "AI_MEMORY_POISONING", 4.25, "CRITICAL", "d1", T0, True),
        ("logs", "NEW_TYPE", 2.0, "WARNING", "d2", T0, False),
        (None, None, None, None, None, T0, None),
    ]
    a = spark.createDataFrame(rows, "collection_name string, anomaly_type string, z_score double, severity string, document_id string, detected_at timestamp, ai_memory_poisoning boolean")
    counts = spark.createDataFrame([("movies", 100)], "collection_name string, doc_count bigint")
    sim = spark.createDataFrame([("d1", 0.9, 17, "X")], "document_id string, top_match_score double, estimated_resolution_minutes int, pattern_identified string")
    dr = spark.createDataFrame([("movies", True, ["a", "b"], ["c"])], "collection_name string, drift_detected boolean, added_fields array<string>, removed_fields array<string>")
    got = {r["document_id"]: r for r in incident.incident_reports(a, counts, sim, dr).collect()}
    one = got["d1"]
    assert one["class_id"] == "LLM01" and one["category"] == "security_threat" and one["escalate"]
    assert one["estimated_resolution_minutes"] == 17 and one["pattern_identified"] == "X"
    assert one["total_confidence"] == round(0.27 + 0.2 + 0.064, 3)
    assert one["summary"].startswith("CRITICAL AI_MEMORY_POISONING on 'movies' (z=4.3). CRITICAL Ai Memory Poisoning in 'movies' (z=4.3). Document contains")
    assert one["summary"].endswith("Recommended: Quarantine the poisoned document (~5 min).")
    two = got["d2"]
    assert two["root_cause_description"] == "NEW_TYPE detected on 'logs'; manual review recommended." and two["root_cause_confidence"] == 0.5
    assert two["estimated_resolution_minutes"] == 30 and two["immediate_action"] == "Investigate the flagged document"
    assert got[""]["anomaly_type"] == "UNKNOWN" and got[""]["class_id"] == "LLM05"
    assert len({r["incident_id"] for r in got.values()}) == 3


# --- replies -----------------------------------------------------------------------


def test_lenient_json(spark):
    rows = [
        ('{"a": 1}', 1, True), ('```json\n{"a": 2}\n```', 2, True), ('```\n{"a": 3}', 3, True), ('Sure: {"a": 4} ok', 4, True),
        ("no json", None, False), (None, None, False), ("", None, False), ('{"a": 5}}', None, False), ('{"parse_error": true}', None, False),
        ('{"a": 6, "raw_response": "x"}', 6, False), ("[1]", None, False),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, raw string").withColumn("v", tx.lenient_json(F.col("raw")))
    out = df.select("i", F.try_variant_get("v", "$.a", "int").alias("a"), tx.usable_reply(F.col("v")).alias("ok")).orderBy("i").collect()
    assert [(r["a"], r["ok"]) for r in out] == [(a, ok) for _, a, ok in rows]


def test_text_functions(spark):
    df = spark.createDataFrame(
        [("SCHEMA_DRIFT", "  Drift at hour 1.04 ", {"Password": "x", "q": "y"}, '{"$oid": "abc"}', '{"$date": "2024-01-01T00:00:00Z"}', "a" * 5000)],
        "k string, d string, m map<string,string>, o string, t string, long string",
    )
    r = df.select(
        tx.duplicate_key(F.col("k"), F.col("d")).alias("key"), tx.title_case(F.col("k")).alias("title"), tx.redact(F.col("m")).alias("m"),
        tx.plain_id(F.col("o")).alias("o"), tx.plain_id(F.lit("plain")).alias("p"), tx.plain_timestamp(F.col("t")).alias("t"),
        tx.shorten_map(F.create_map(F.lit("a"), F.col("long"))).alias("cut"), tx.shorten_map(F.col("m")).alias("same"),
        F.size(tx.shorten_list(F.sequence(F.lit(1), F.lit(1000)))).alias("n"), tx.json_length(F.col("m")).alias("len"),
    ).first()
    assert r["key"] == "SCHEMA_DRIFT|drift at hour" and r["title"] == "Schema Drift"
    assert r["m"] == {"Password": "***REDACTED***", "q": "y"} and (r["o"], r["p"]) == ("abc", "plain")
    assert r["t"] == T0 and r["cut"]["a"] == "a" * 300 + "…[truncated]" and r["same"]["Password"] == "x"
    assert r["n"] == 10 and r["len"] == len('{"Password":"x","q":"y"}')


# --- similarity ----------------------------------------------------------------------


def test_nearest_brute_force(spark):
    rng = np.random.default_rng(5)
    h = rng.normal(size=(400, 12))
    h[10] = h[20] = h[30]  # ties
    h[40] = 0
    q = np.vstack([h[30], rng.normal(size=(29, 12))])
    hist = spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(h)], "hid int, emb array<double>, grp int")
    quer = spark.createDataFrame([(1000 + i, [float(x) for x in v], i % 3) for i, v in enumerate(q)], "qid int, emb array<double>, grp int")
    norm = np.linalg.norm(h, axis=1)
    cos = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ np.divide(h.T, norm, out=np.zeros_like(h.T), where=norm > 0), 6)
    for same, rows in itertools.product((False, True), (7, 10_000)):
        got = {}
        out = similar.nearest(quer, hist, "qid", "hid", "emb", 9, match_on=["grp"] if same else (), rows_per_block=rows)
        for r in out.orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append((r["hid"], r["score"]))
        for i in range(30):
            usable = [j for j in range(400) if not same or j % 3 == i % 3]
            want = sorted(usable, key=lambda j: (-cos[i, j], j))[:9]
            assert [x[0] for x in got[1000 + i]] == want
            assert [x[1] for x in got[1000 + i]] == pytest.approx([cos[i, j] for j in want], abs=1.1e-6)


def test_collapse_and_summary(spark):
    hist = spark.createDataFrame(
        [(1, [1.0, 0.0], "A", "Drift 1.03", 5), (2, [1.0, 0.01], "A", "drift 1.04", 6), (3, [1.0, 0.2], "B", "drift 1.04", 7), (4, [0.0, 1.0], "A", "other", 8)],
        "hid int, emb array<double>, anomaly_type string, description string, resolution_time_minutes int",
    )
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, emb array<double>")
    s = similar.similar(q, hist, "qid", "hid", "emb", keep=["resolution_time_minutes"])
    assert [r["hid"] for r in s.orderBy("rank").collect()] == [1, 3, 4]
    top = similar.similar_summary(s, "qid").first()
    assert (top["top_match_score"], top["pattern_identified"], top["estimated_resolution_minutes"]) == (1.0, "A", 5)


def test_similar_past_many_near_duplicates(spark):
    rows = [(i, [1.0, i / 1e4], "A", f"drift {i}", 5) for i in range(100)]
    rows += [(200, [1.0, 0.5], "B", "other", 6), (201, [1.0, 0.6], None, "none", 7), (202, [1.0, 0.7], "C", "last", 8), (203, [1.0, 0.65], None, "nil", 9)]
    hist = spark.createDataFrame(rows, "hid int, emb array<double>, anomaly_type string, description string, resolution_time_minutes int")
    q = spark.createDataFrame([(f"q{i}", [1.0, 0.0]) for i in range(3)], "qid string, emb array<double>")
    s = similar.similar(q, hist.repartition(5), "qid", "hid", "emb", keep=["resolution_time_minutes"])
    got = s.orderBy("qid", "rank").collect()
    assert [(r["qid"], r["hid"]) for r in got] == [(f"q{i}", h) for i in range(3) for h in (0, 200, 201)]
    assert {r["n_matches"] for r in similar.similar_summary(s, "qid").collect()} == {3}
    key = F.concat_ws("|", "anomaly_type")
    for rows_per_block in (2, 10_000):
        out = similar.nearest(q, hist, "qid", "hid", "emb", 3, rows_per_block=rows_per_block, distinct=key).orderBy("qid", "rank")
        assert [r["hid"] for r in out.collect()] == [0, 200, 201] * 3


def test_text_similar_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox jumps", "blue whale swims", "the red fox", "", None])], "doc int, text string")
    q = spark.createDataFrame([(0, "Red, fox!")], "q int, text string")
    out = similar.text_similar(q, docs, "q", "doc", "text", 2).orderBy("rank").collect()
    assert {r["doc"] for r in out} == {0, 2} and out[0]["score"] == pytest.approx(2 / np.sqrt(6), abs=1e-6)


def test_search_takes_few_rows_of_the_history_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1000, 12))
    history = pa.RecordBatch.from_pydict({"h": list(range(1000)), "hv": vectors.tolist(), "_c": [None] * 1000}, pa.schema([("h", pa.int64()), ("hv", pa.list_(pa.float64())), ("_c", pa.string())]))
    queries = pa.table({"q": ["x", "y"], "qv": vectors[:2].tolist()})
    search = similar.Search(queries, similar.Asked((), 3, False, False, 16))
    unit, held = similar.unit_rows, []
    monkeypatch.setattr(similar, "unit_rows", lambda v: held.append(len(v)) or unit(v))
    search.add(history)
    assert max(held) <= 16 and sum(held) == 1000
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cos = np.round(units[:2] @ units.T, 6)
    want = [(q, int(j)) for i, q in enumerate("xy") for j in np.argsort(-cos[i], kind="stable")[:3]]
    found = search.found(pa.int64()).to_pydict()
    assert list(zip(found["q"], found["h"])) == want


def test_model_embedder(spark):
    embed = similar.model_embedder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    df = embed(spark.createDataFrame([("abc",), (None,)], "t string"), "t")
    assert [list(r["embedding"]) for r in df.collect()] == [[3.0, 1.0], [0.0, 1.0]]


# --- runway -------------------------------------------------------------------------------


def test_runway(spark):
    def windows(key, counts, kb):
        return [(key, minutes(i - 20), c, kb) for i, c in enumerate(counts)]

    rows = windows("up", [1, 9, 9, 2, 4, 6, 8, 10, 12], 0.5) + windows("flat", [3] * 6, 0.5) + windows("down", [9, 7, 5, 3], 0.5) + windows("few", [1, 2], 0.5)
    stats = spark.createDataFrame(rows, "key string, window_end timestamp, event_count bigint, avg_doc_size_kb double")
    base = spark.createDataFrame([("up", 10240.0, 1024.0), ("flat", 1000.0, 0.0)], "key string, mean_bytes double, stddev_bytes double")
    got = {r["key"]: r for r in runway.runway(stats, base, "key", F.lit(T0)).collect()}
    up = got["up"]
    assert up["slope"] == 2.0 and up["trend"] == "increasing" and up["current_rate_per_min"] == 12.0
    assert up["minutes_to_critical"] == round((10240 + 3.5 * 1024) / 1024 / 2 - 0.25, 1) and up["status"] == "CRITICAL_IMMINENT"
    assert up["projected_critical_at"] == T0 + datetime.timedelta(minutes=up["minutes_to_critical"]) and up["confidence"] == 0.95
    assert got["flat"]["slope"] == 0.0 and got["flat"]["minutes_to_critical"] is None and got["flat"]["confidence"] == 0.9
    assert got["down"]["trend"] == "decreasing" and got["down"]["confidence"] == 0.95
    assert got["few"]["status"] == "insufficient_data" and got["few"]["confidence"] == 0.1
    events = spark.createDataFrame([("few", minutes(-m)) for m in (0, 1, 60, 61, 120, 359, 360, 361)], "key string, ts timestamp")
    counts = runway.recent_counts(events, "key", "ts", F.lit(T0))
    assert [r["event_count"] for r in counts.orderBy(F.desc("window_end")).collect()] == [2, 2, 0, 0, 0, 2]
    got = {r["key"]: r for r in runway.runway(stats, base, "key", F.lit(T0), fallback=counts).collect()}
    assert got["few"]["current_rate_per_min"] == 2.0 and len(got) == 4
    early = {r["key"]: r for r in runway.runway(stats, base, "key", F.lit(minutes(-17))).collect()}
    assert early["up"]["current_rate_per_min"] == 2.0 and early["flat"]["slope"] == 0.0  # later windows are cut


def test_scores(spark):
    df = spark.createDataFrame([(None,), (0.0,), (29.9,), (30.0,), (119.0,), (240.0,), (500.0,)], "m double")
    got = df.select(scores.runway_status(F.col("m")), scores.runway_fill(F.col("m"))).collect()
    assert [r[0] for r in got] == ["NORMAL", "NORMAL", "CRITICAL_IMMINENT", "WARNING", "WARNING", "NORMAL", "NORMAL"]
    assert [round(r[1], 2) for r in got] == [0.0, 100.0, 87.54, 87.5, 50.42, 0.0, 0.0]


# --- baselines, anomalies, correlation ---------------------------------------------------------


def test_size_anomaly_defaults(spark):
    docs = spark.createDataFrame([("a", 1, 3000), ("a", 2, 1100), ("b", 3, 11), ("b", 4, 10)], "c string, id int, n bigint")
    base = spark.createDataFrame([("b", 10.0, 0.2)], "c string, mean_bytes double, stddev_bytes double")
    got = {r["document_id"]: r for r in anomaly.size_anomalies(docs, base, "c", "id", F.lit(T0), F.col("n")).collect()}
    assert set(got) == {"1"}
    assert got["1"]["z_score"] == 4.0 and got["1"]["severity"] == "CRITICAL" and got["1"]["confidence"] == 0.4
    assert got["1"]["description"] == "CRITICAL: Document in 'a' is 2.9 KB (Z=4.0). Baseline mean: 1.0 KB."


def test_refresh(spark):
    old = spark.createDataFrame([("a", 100.0, 1.0, 5), ("b", 100.0, 1.0, 5), ("d", 100.0, 1.0, 5)], "k string, mean_bytes double, stddev_bytes double, sample_count bigint")
    new = spark.createDataFrame([("a", 105.0, 2.0, 9), ("b", 105.1, 2.0, 9), ("c", 7.0, 2.0, 9)], "k string, mean_bytes double, stddev_bytes double, sample_count bigint")
    got = {r["k"]: r for r in drift.refresh_baseline(new, old, "k").collect()}
    assert {k: (r["action"], r["drift_pct"], r["mean_bytes"]) for k, r in got.items()} == {
        "a": ("none", 5.0, 100.0), "b": ("refreshed", 5.1, 105.1), "c": ("created", 100.0, 7.0), "d": ("none", 0.0, 100.0)
    }
    assert got["d"]["reason"] == "no_documents"


def test_correlation(spark):
    rows = [("c1", minutes(0)), ("c2", minutes(3)), ("c9", minutes(3)), ("c1", minutes(4)), ("c3", minutes(30))]
    a = spark.createDataFrame(rows, "collection_name string, detected_at timestamp")
    monitored = ["c1", "c2", "c3"]
    r = correlate.correlated_events(a, F.lit(minutes(5)), monitored).first()
    assert r["collection_key"] == "c1|c2" and r["patient_zero"] == "c1" and r["n_anomalies"] == 3
    assert r["confidence"] == 0.667 and r["severity"] == "WARNING"
    assert correlate.correlated_events(a, F.lit(minutes(31)), monitored).count() == 0
    stored = spark.createDataFrame([("c1|c2", minutes(-54)), ("c1|c3", minutes(4))], "collection_key string, created_at timestamp")
    assert correlate.correlated_events(a, F.lit(minutes(5)), monitored, stored=stored).count() == 0
    old = spark.createDataFrame([("c1|c2", minutes(-56))], "collection_key string, created_at timestamp")
    assert correlate.correlated_events(a, F.lit(minutes(5)), monitored, stored=old).count() == 1
    w = {r["window_start"]: r for r in correlate.correlation_windows(a, monitored).collect()}
    for start, r in w.items():
        inside = [c for c, t in rows if start <= t < start + datetime.timedelta(minutes=5) and c in monitored]
        assert r["collections_affected"] == sorted(set(inside)) and r["n_anomalies"] == len(inside)
    assert set(w) == {minutes(m) for m in range(-1, 4)}


# --- audit ----------------------------------------------------------------------------------------


def test_seal(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 2.5)], "id int, t string, x double")
    sealed = audit.seal(df)
    assert audit.verify(sealed).filter("verified").count() == 2
    assert audit.verify(sealed.withColumn("created_at", F.lit("now"))).filter("verified").count() == 2
    edited = sealed.withColumn("x", F.when(F.col("id") == 1, F.lit(0.0)).otherwise(F.col("x")))
    assert [r["tampered"] for r in audit.verify(edited).orderBy("id").collect()] == [True, False]
    assert audit.seal(df.select("x", "t", "id")).select("receipt").orderBy("id").collect() == sealed.select("receipt").orderBy("id").collect()
    bare = audit.verify(df.withColumn("receipt", F.lit(None).cast("string"))).first()
    assert not bare["has_receipt"] and bare["reason"] == "no receipt on document"


def test_spans(spark):
    ev = [("i", "A", 0, "find", True), ("i", "A", 10, None, True), ("i", "B", 5, "find", False), ("i", "B", 25, "aggregate", None), ("j", "A", 3, None, None)]
    e = spark.createDataFrame(ev, "incident_id string, agent string, at_ms bigint, tool_name string, has_text boolean")
    spans = audit.span_summary(e)
    got = {(r["incident_id"], r["agent"]): (r["start_ms"], r["end_ms"], r["duration_ms"], r["n_tool_calls"], r["text_chunks"]) for r in spans.collect()}
    assert got == {("i", "A"): (0, 10, 10, 1, 2), ("i", "B"): (5, 25, 20, 2, 0), ("j", "A"): (3, 3, 0, 0, 0)}
    o = {r["incident_id"]: r for r in audit.span_overlap(spans).collect()}
    assert o["i"]["parallel_verified"] and o["i"]["speedup_factor"] == 1.2
    assert not o["j"]["parallel_verified"] and o["j"]["speedup_factor"] == 1.0
    assert audit.span_tool_calls(e).count() == 3


# --- feed ---------------------------------------------------------------------------------------------


def test_feed_sizes(spark):
    df = spark.range(300).withColumns({"ts": F.timestamp_seconds("id"), "embedding": F.array(F.lit(1.0))})
    assert feed.newest(df, "ts", "id").count() == 50 and feed.newest(df, "ts", "id", n=999).count() == 300
    assert "embedding" not in feed.newest(df, "ts", "id").columns
    assert [r["id"] for r in feed.replay(df, "ts", "id").collect()] == list(range(290, 300))
    assert feed.find(df, F.col("id") > 5, ["id"], 100).count() == 100
    assert feed.feed_size("find", 100, most=50) == 50 and feed.feed_size("find") == 10
    assert profile.sample_rows(df, "id", 7).collect() == profile.sample_rows(df.repartition(5), "id", 7).collect()


def test_expected_seen_keeps_keys_without_any(spark):
    df = spark.createDataFrame([("i1", "a"), ("i1", "b"), ("i2", "z")], "incident_id string, agent string")
    rows = {r["incident_id"]: r for r in feed.expected_seen(df, "incident_id", "agent", ["a", "b"]).collect()}
    assert rows["i1"]["complete"] and rows["i2"]["missing"] == ["a", "b"] and not rows["i2"]["complete"]


def test_burst_does_not_hide_a_cluster(spark):
    rows = [("c0", minutes(1))] * 3 + [("c1", minutes(2))] * 150
    a = spark.createDataFrame(rows, "collection_name string, detected_at timestamp")
    r = correlate.correlated_events(a, F.lit(minutes(5)), ["c0", "c1", "c2"]).first()
    assert r["collections_affected"] == ["c0", "c1"] and r["patient_zero"] == "c0" and r["n_anomalies"] == 153
