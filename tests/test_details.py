"""Incident details: nesting, pages of tool calls, stored impact, incidents without a trace."""

from pyspark.sql import functions as F

from driftwatch.operators import details, incident

TRACE = "incident_id string, agent string, at_ms long, tool_name string, has_text boolean"
INCIDENT = (
    "incident_id string, collection_name string, anomaly_type string, z_score double, n_indexes int, n_schema int, n_slow int, "
    "vector_score double, drift_detected boolean, n_added int, n_removed int, estimated_dollar_impact struct<per_minute_usd:double>"
)


def incidents(spark):
    rows = [
        ("i1", "orders", "SCHEMA_DRIFT", 4.0, 1, 1, 2, 0.8, True, 1, 2, None),
        ("i2", None, None, None, None, None, None, None, None, None, None, (7.25,)),
        (None, "users", "DOC_SIZE_SPIKE", -5.0, 0, 0, 0, 0.0, False, 0, 0, (None,)),
    ]
    return spark.createDataFrame(rows, INCIDENT)


def test_nested_assembly(spark):
    hour = details.BUCKET_MS
    steps = [("i1", "schema", t, "find" if t % 2 else None, True) for t in range(0, 14)]
    steps += [("i1", "schema", hour + 5, "aggregate", False), ("i1", "context", 3, None, True), ("i1", "context", 9, "find", None)]
    steps += [(None, "context", 1, "find", False)]
    counts = spark.createDataFrame([("orders", 50_000), (None, 20_000)], "collection_name string, doc_count bigint")
    got = {r["incident_id"]: r for r in details.incident_details(incidents(spark), spark.createDataFrame(steps, TRACE), counts, page=3).collect()}
    one = got["i1"]
    assert one["trace"]["total_ms"] == hour + 5
    assert [(s["agent"], s["start_ms"], s["n_tool_calls"], s["n_pages"]) for s in one["trace"]["steps"]] == [("schema", 0, 8, 4), ("context", 3, 1, 1)]
    assert [(c["at_ms"], c["name"]) for c in one["trace"]["steps"][0]["tool_calls"]] == [(1, "find"), (3, "find"), (5, "find")]
    assert one["tool_counts"] == {"find": 8, "aggregate": 1}
    assert one["overlap"]["parallel_verified"] and one["overlap"]["n_spans"] == 2
    # recomputed as the impact operator does
    alone = incident.dollar_impact(incidents(spark).where("incident_id = 'i1'"), counts).first()
    assert one["impact"]["per_minute_usd"] == alone["per_minute_usd"] and not one["impact_stored"]
    assert one["impact"]["total_worst_case_usd"] == alone["total_worst_case_usd"]
    assert [e["source"] for e in one["evidence"]] == ["advisor", "vector_search", "schema_drift", "z_score"]
    # a stored impact is taken as it is; no trace leaves null
    assert got["i2"]["impact"]["per_minute_usd"] == 7.25 and got["i2"]["impact_stored"] and got["i2"]["trace"] is None
    # null ids meet each other, an empty stored impact is computed
    assert got[None]["tool_counts"] == {"find": 1} and got[None]["impact"]["per_minute_usd"] > 0
    assert len(got) == 3


def test_pages_hold_every_call_in_order(spark):
    steps = [("i", "a", t, "find", False) for t in (5, 5, 7, 1, 2, details.BUCKET_MS)]
    pages = details.tool_call_pages(spark.createDataFrame(steps, TRACE), 2).orderBy("bucket", "part").collect()
    assert [[c["at_ms"] for c in p["calls"]] for p in pages] == [[1, 2], [5, 5], [7], [details.BUCKET_MS]]


def test_empty(spark):
    none = spark.createDataFrame([], TRACE)
    counts = spark.createDataFrame([], "collection_name string, doc_count bigint")
    assert details.incident_details(incidents(spark).limit(0), none, counts).count() == 0
    assert details.incident_details(incidents(spark).drop("estimated_dollar_impact"), none, counts).where(F.col("impact.saved_usd").isNull()).count() == 0
