"""Plain SQL with the same result as each registered query, over the same
tables. Queries without SQL here are checked by brute force in the tests."""

from __future__ import annotations

from driftwatch.functions import patterns as P
from driftwatch.functions import templates as T
from driftwatch.plans import inputs as I

ORACLES: dict[str, str] = {}

DOC_BYTES = "(73 + strlen(text) + strlen(lang) + strlen(source))"
EVENT_BYTES = "(96 + strlen(event_type) + strlen(props))"
STAMP = "'%Y-%m-%d %H:%M:%S'"
AS_OF = f"TIMESTAMP '{I.AS_OF}'"
DAY_END = "TIMESTAMP '2024-01-01 23:59:59'"


def half_up(x: str, places: int) -> str:
    """Rounding of the decimal form, halves away from zero."""
    return f"CAST(round(CAST(CAST({x} AS STRING) AS DECIMAL(38, 20)), {places}) AS DOUBLE)"


def one_decimal(x: str) -> str:
    """Text with one decimal that keeps the sign of a rounded zero."""
    return f"(CASE WHEN {x} < 0 AND {half_up(x, 1)} = 0 THEN '-0.0' ELSE printf('%.1f', {half_up(x, 1)}) END)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- sizes, profiles, health ---------------------------------------------------------

BASE = f"base AS (SELECT lang, avg({DOC_BYTES}) AS m, stddev_samp({DOC_BYTES}) AS sd, count(*) AS n FROM documents GROUP BY lang)"

ORACLES["size_baseline"] = f"WITH {BASE} SELECT lang, round(m, 6) AS mean_bytes, round(sd, 6) AS stddev_bytes, n AS sample_count FROM base"


def full(key: str) -> str:
    return f"""full_base AS (SELECT {key}, count(*) AS n, min(b) AS lo, max(b) AS hi, avg(b) AS m, stddev_samp(b) AS sd,
 quantile_cont(b, 0.5) AS p50, quantile_cont(b, 0.95) AS p95, quantile_cont(b, 0.99) AS p99
 FROM (SELECT {key}, CAST({DOC_BYTES} AS DOUBLE) AS b FROM documents) GROUP BY {key})"""


ORACLES["full_baseline"] = f"""WITH {full("source")} SELECT source, n AS sample_count, CAST(lo AS BIGINT) AS min_bytes,
 CAST(hi AS BIGINT) AS max_bytes, round(m, 6) AS mean_bytes, round(sd, 6) AS stddev_bytes, round(p50, 6) AS p50_bytes,
 round(p95, 6) AS p95_bytes, round(p99, 6) AS p99_bytes, round(m + 2.0e0 * sd, 6) AS warning_threshold_bytes,
 round(m + 3.5e0 * sd, 6) AS critical_threshold_bytes FROM full_base"""

NULL_KEY = f"(SELECT doc_id, nullif(lang, 'fr') AS lang, {DOC_BYTES} AS b FROM documents)"
ORACLES["baseline_state_loads"] = f"""WITH {BASE}, lo AS (SELECT lang, CAST(min({DOC_BYTES}) AS BIGINT) AS lo, CAST(max({DOC_BYTES}) AS BIGINT) AS hi FROM documents GROUP BY lang)
 SELECT lang, n AS sample_count, lo AS min_bytes, hi AS max_bytes, round(m, 4) AS mean_bytes, round(sd, 4) AS stddev_bytes, round(m + 3.5 * sd, 4) AS critical_threshold_bytes, true AS percentiles_near
 FROM base JOIN lo USING (lang)"""
ORACLES["null_key_baseline"] = f"""SELECT lang, count(*) AS sample_count, min(b) AS min_bytes, max(b) AS max_bytes,
 round(avg(b), 6) AS mean_bytes, round(stddev_samp(b), 6) AS stddev_bytes, round(quantile_cont(CAST(b AS DOUBLE), 0.5), 6) AS p50_bytes,
 round(quantile_cont(CAST(b AS DOUBLE), 0.99), 6) AS p99_bytes FROM {NULL_KEY} GROUP BY lang"""
ORACLES["null_key_zscores"] = """WITH e AS (SELECT event_id, nullif(event_type, 'view') AS event_type, value FROM events),
 s AS (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m, stddev_pop(value) OVER (PARTITION BY event_type) AS sd FROM e)
 SELECT event_id, round(CASE WHEN sd > 0 THEN (value - m) / sd ELSE 0 END, 6) AS z FROM s"""
ORACLES["null_key_refresh"] = f"""WITH g AS (SELECT lang, doc_id % 2 AS half, avg(b) AS m, count(*) AS n FROM {NULL_KEY} GROUP BY ALL),
 j AS (SELECT f.lang, o.m AS om, o.n AS onn, f.m AS fm, f.n AS fnn, abs(f.m - o.m) / greatest(o.m, 1) * 100 AS pct
  FROM g f JOIN g o ON f.lang IS NOT DISTINCT FROM o.lang WHERE f.half = 1 AND o.half = 0)
 SELECT lang, pct > 5 AS drifted, round(pct, 2) AS drift_pct, CASE WHEN pct > 5 THEN 'refreshed' ELSE 'none' END AS action, pct <= 5 AS stable,
 round(CASE WHEN pct > 5 THEN fm ELSE om END, 6) AS mean_bytes, CASE WHEN pct > 5 THEN fnn ELSE onn END AS sample_count FROM j"""

HEALTH = f"""{full("lang")}, card AS (SELECT *, p95 / greatest(p50, 1) AS skew FROM full_base),
 scored AS (SELECT *, round(greatest(0e0, 7.0e0 - CASE WHEN skew > 20 THEN 2.5e0 WHEN skew > 5 THEN 1.0e0 ELSE 0e0 END
 - CASE WHEN p99 > 1048576 THEN 2.0e0 ELSE 0e0 END - CASE WHEN hi > 8388608 THEN 1.5e0 ELSE 0e0 END), 1) AS health_score FROM card)"""
ORACLES["health_card"] = f"""WITH {HEALTH} SELECT lang, health_score, n AS doc_count, round(m / 1024, 2) AS mean_size_kb,
 round(p50 / 1024, 2) AS p50_size_kb, round(p95 / 1024, 2) AS p95_size_kb, round(p99 / 1024, 2) AS p99_size_kb,
 round(hi / 1024, 2) AS max_size_kb, 0 AS index_count,
 CASE WHEN health_score >= 8 THEN 'HEALTHY' WHEN health_score >= 5 THEN 'WARNING' ELSE 'CRITICAL' END AS status,
 concat_ws(' | ', 'No secondary indexes — all queries will collection-scan',
  CASE WHEN skew > 20 THEN printf('High size skew: P95/P50 = %.0f× — outlier documents detected', skew)
   WHEN skew > 5 THEN printf('Moderate size skew: P95/P50 = %.0f×', skew) END,
  CASE WHEN p99 > 1048576 THEN printf('P99 size %.1f KB — approaching 16 MB BSON limit risk', round(p99 / 1024, 0)) END,
  CASE WHEN hi > 8388608 THEN printf('Max document %.1f MB — over 50%% of BSON limit', round(hi / 1048576, 1)) END) AS issues FROM scored"""
ORACLES["avg_health"] = f"WITH {HEALTH} SELECT round(avg(health_score), 6) AS avg_health FROM scored"
ORACLES["size_stats"] = f"""SELECT lang, round(avg({DOC_BYTES} / 1024e0), 2) AS mean_kb, round(max({DOC_BYTES} / 1024e0), 2) AS max_kb,
 5.0e0 AS field_count FROM documents GROUP BY lang"""


def anomalies_of(docs: str) -> str:
    """Size anomalies with key lang over a documents relation."""
    return f"""db AS (SELECT *, {DOC_BYTES} AS bytes FROM {docs}),
 bl AS (SELECT lang, avg(bytes) AS m, stddev_samp(bytes) AS sd FROM db GROUP BY lang),
 zs AS (SELECT db.*, bl.m, (bytes - m) / greatest(sd, 1) AS z FROM db JOIN bl USING (lang)),
 found AS (SELECT *, CAST(doc_id AS STRING) AS document_id, CASE WHEN abs(z) >= 3.5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity
  FROM zs WHERE abs(z) >= 2.0)"""


ORACLES["size_anomalies"] = f"""WITH {anomalies_of("documents")} SELECT lang AS collection_name, 'DOC_SIZE_SPIKE' AS anomaly_type,
 round(z, 3) AS z_score, bytes AS doc_size_bytes, round(bytes / 1024e0, 2) AS doc_size_kb, round(m / 1024, 2) AS baseline_mean_kb,
 severity, document_id, round(least(1e0, abs(z) / 10), 6) AS confidence, '{I.AS_OF}' AS detected_at FROM found"""

ORACLES["refresh_baseline"] = f"""WITH d AS (SELECT doc_id, lang, {DOC_BYTES} AS b FROM documents),
 o AS (SELECT lang, avg(b) AS m, stddev_samp(b) AS sd, count(*) AS n FROM d WHERE doc_id % 2 = 0 AND lang != 'es' GROUP BY lang),
 f AS (SELECT lang, avg(b) AS m, stddev_samp(b) AS sd, count(*) AS n FROM d WHERE (doc_id % 2 = 1 OR lang = 'es') AND lang != 'fr' GROUP BY lang),
 j AS (SELECT coalesce(f.lang, o.lang) AS lang, o.m AS om, o.sd AS osd, o.n AS onn, f.m AS fm, f.sd AS fsd, f.n AS fnn,
  abs(f.m - o.m) / greatest(o.m, 1) * 100 AS pct FROM f FULL JOIN o ON f.lang = o.lang),
 a AS (SELECT *, CASE WHEN coalesce(om, 0) = 0 THEN 'created' WHEN fm IS NULL THEN 'none' WHEN pct > 5 THEN 'refreshed' ELSE 'none' END AS action FROM j)
 SELECT lang, action != 'none' AS drifted, CASE WHEN coalesce(om, 0) = 0 THEN 100e0 WHEN fm IS NULL THEN 0e0 ELSE round(pct, 2) END AS drift_pct,
 action, action = 'none' AS stable, CASE WHEN coalesce(om, 0) != 0 AND fm IS NULL THEN 'no_documents' END AS reason,
 round(CASE WHEN action != 'none' THEN fm ELSE om END, 6) AS mean_bytes, round(CASE WHEN action != 'none' THEN fsd ELSE osd END, 6) AS stddev_bytes,
 CASE WHEN action != 'none' THEN fnn ELSE onn END AS sample_count FROM a"""

CLIENT = "CASE t WHEN 'VARCHAR' THEN 'str' WHEN 'BIGINT' THEN 'int' WHEN 'UBIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'NoneType' WHEN 'ARRAY' THEN 'list' ELSE 'dict' END"
STORE = "CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'int' WHEN 'UBIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array' ELSE 'object' END"


def fields(doc: str, name: str = "fl", where: str = "true") -> str:
    return f"""{name}_d AS (SELECT event_type, event_id, CAST({doc} AS JSON) AS doc FROM events WHERE {where}),
 {name}_k AS (SELECT event_type, event_id, doc, unnest(json_keys(doc)) AS field FROM {name}_d),
 {name} AS (SELECT event_type, event_id, field, json_type(doc, '$.' || field) AS t, json_extract(doc, '$.' || field) AS v FROM {name}_k)"""


def types(client: str = CLIENT) -> str:
    return f"array_to_string(list_sort(list(DISTINCT {client})), ',')"


ORACLES["field_profile"] = f"""WITH {fields(I.EVENT_DOC)}, c AS (SELECT event_type, field, count(*) AS occurrence_count FROM fl GROUP BY 1, 2),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY occurrence_count DESC, field) AS INT) AS rank FROM c) SELECT * FROM r WHERE rank <= 30"""
ORACLES["schema_snapshot"] = f"WITH {fields(I.EVENT_DOC)} SELECT event_type, field, {types(STORE)} AS types, count(*) AS count FROM fl GROUP BY 1, 2"
ORACLES["live_schema"] = f"WITH {fields(I.EVENT_DOC)} SELECT event_type, field, {types()} AS types FROM fl GROUP BY 1, 2"
ORACLES["dynamic_sizes"] = """WITH b AS (SELECT event_type, 33 + CASE WHEN user_id % 7 = 0 THEN 5 + strlen('u' || user_id) ELSE 4 END + CASE WHEN event_id % 5 = 0 THEN 29 ELSE 0 END
  + CASE WHEN event_id % 11 = 0 THEN 6 ELSE 0 END + CASE WHEN event_type IN ('click', 'error') AND event_id % 3 = 0 THEN 23 ELSE 0 END + CASE WHEN event_id % 4 = 0 THEN 7 ELSE 0 END AS b FROM events)
 SELECT event_type, count(*) AS sample_count, min(b) AS min_bytes, max(b) AS max_bytes, round(avg(b), 6) AS mean_bytes, round(stddev_samp(b), 6) AS stddev_bytes,
 round(quantile_cont(CAST(b AS DOUBLE), 0.95), 6) AS p95_bytes FROM b GROUP BY 1"""
ORACLES["typed_schema_snapshot"] = """SELECT event_type, f.field, f.types, count(*) AS count FROM events,
 (VALUES ('event_id', 'long'), ('ts', 'date'), ('user_id', 'long'), ('value', 'double'), ('props', 'string')) f(field, types) GROUP BY 1, 2, 3"""
ORACLES["schema_examples"] = f"""WITH {fields(I.EVENT_DOC)}, e AS (SELECT event_type, field, {types()} AS types,
 arg_min(substring(CASE WHEN t = 'VARCHAR' THEN json_extract_string(v, '$') WHEN t = 'NULL' THEN NULL ELSE CAST(v AS STRING) END, 1, 100), event_id) AS ex,
 min(event_id) AS first_id FROM fl GROUP BY 1, 2),
 x AS (SELECT e.*, CASE WHEN fl.t = 'NULL' THEN NULL WHEN fl.t = 'VARCHAR' THEN json_extract_string(fl.v, '$') ELSE CAST(fl.v AS STRING) END AS example
  FROM e JOIN fl ON fl.event_type = e.event_type AND fl.field = e.field AND fl.event_id = e.first_id)
 SELECT event_type, field, types, example, count(*) OVER (PARTITION BY event_type) AS field_count FROM x"""
ORACLES["first_types"] = f"WITH {fields(I.EVENT_DOC)} SELECT event_type, field, arg_min({CLIENT}, event_id) AS type FROM fl GROUP BY 1, 2"

SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"
CHANGES = f"""{fields(I.EVENT_DOC, "nw", f"ts >= {SPLIT}")}, {fields(I.OLD_EVENT_DOC, "od", f"ts < {SPLIT}")},
 live AS (SELECT event_type, field, list_sort(list(DISTINCT {CLIENT})) AS types FROM nw GROUP BY 1, 2),
 stored AS (SELECT event_type, field, list_sort(list(DISTINCT {CLIENT})) AS types FROM od GROUP BY 1, 2),
 ch AS (SELECT coalesce(l.event_type, s.event_type) AS event_type, coalesce(l.field, s.field) AS field, l.types AS n, s.types AS w,
  CASE WHEN s.types IS NULL THEN 'added' WHEN l.types IS NULL THEN 'removed' WHEN l.types != s.types THEN 'changed' END AS change
  FROM live l FULL JOIN stored s ON l.event_type = s.event_type AND l.field = s.field)"""
ORACLES["schema_changes"] = f"WITH {CHANGES} SELECT event_type, field, array_to_string(n, ',') AS now, array_to_string(w, ',') AS was, change FROM ch"


def listed(kind: str, item: str = "field") -> str:
    return f"coalesce(array_to_string(list({item} ORDER BY field) FILTER (change = '{kind}'), ','), '')"


ORACLES["schema_drift"] = f"""WITH {CHANGES} SELECT event_type, count(change) > 0 AS drift_detected, {listed("added")} AS added_fields,
 {listed("removed")} AS removed_fields, {listed("changed", "field || ':' || array_to_string(w, '/') || '>' || array_to_string(n, '/')")} AS type_changes,
 CAST(count(n) AS INT) AS live_field_count,
 coalesce(min(field) FILTER (change = 'added'), min(field) FILTER (change = 'changed')) AS most_suspicious_field FROM ch GROUP BY event_type"""
ORACLES["schema_after_drift"] = f"""WITH {CHANGES}, dr AS (SELECT DISTINCT event_type FROM ch WHERE change IS NOT NULL)
 SELECT event_type, field, array_to_string(types, ',') AS types FROM stored WHERE event_type NOT IN (SELECT event_type FROM dr)
 UNION ALL SELECT event_type, field, array_to_string(types, ',') FROM live WHERE event_type IN (SELECT event_type FROM dr)"""
ORACLES["top_groups"] = f"SELECT source, count(*) AS n, round(avg({DOC_BYTES}), 6) AS avg_bytes FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10"
ORACLES["coverage"] = """SELECT count(*) AS total, count(toxic) AS with_value, count(*) - count(toxic) AS without_value,
 count(*) FILTER (lang = 'en') AS matching FROM documents LEFT JOIN labels USING (doc_id)"""
ORACLES["sample_rows"] = "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(CAST(o_orderkey AS STRING)), o_orderkey LIMIT 100"

# --- velocity -----------------------------------------------------------------------------


def vectors(hours: int = 24) -> str:
    return f"vec AS (SELECT *, TIMESTAMP '2024-01-01' + to_hours(CAST(vec_id % {hours} AS INT)) AS ts FROM embeddings)"


def centroids(key: str, source: str = "vec", name: str = "cent", emb: str = "embedding") -> str:
    return f"""{name}_x AS (SELECT {key}, ts, unnest({emb}) AS x, generate_subscripts({emb}, 1) AS pos FROM {source}),
 {name}_m AS (SELECT {key}, date_trunc('hour', ts) AS hour, pos, avg(CAST(x AS DOUBLE)) AS m, count(*) AS docs FROM {name}_x GROUP BY ALL),
 {name}_l AS (SELECT {key}, hour, max(docs) AS docs, list(m ORDER BY pos) AS c FROM {name}_m GROUP BY ALL),
 {name}_n AS (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS norm FROM {name}_l),
 {name} AS (SELECT {key}, hour, docs, CASE WHEN norm > 1e-9 THEN list_transform(c, lambda x: x / norm) ELSE c END AS u FROM {name}_n)"""


def distances(key: str, **k) -> str:
    return f"""{centroids(key, **k)}, lg AS (SELECT *, lag(u) OVER (PARTITION BY {key} ORDER BY hour) AS p FROM cent),
 dist AS (SELECT {key}, hour, docs, CASE WHEN p IS NOT NULL THEN round(1 - greatest(-1e0, least(1e0, list_inner_product(p, u))), 6) END AS distance FROM lg)"""


def velocity(key: str, **k) -> str:
    return f"""{distances(key, **k)},
 vg AS (SELECT {key}, sum(docs) AS n_docs, count(*) AS n_hours, list(distance ORDER BY hour) FILTER (distance IS NOT NULL) AS d FROM dist GROUP BY ALL),
 va AS (SELECT *, d[len(d)] AS cur, list_slice(d, 1, len(d) - 1) AS h, list_slice(d, greatest(len(d) - 5, 1), len(d)) AS r FROM vg),
 vb AS (SELECT *, CASE WHEN len(h) > 0 THEN list_avg(h) ELSE cur END AS av, CASE WHEN len(h) > 1 THEN list_aggregate(h, 'stddev_pop') ELSE 1e-7 END AS sd,
  list_sum(r) AS drift FROM va),
 vc AS (SELECT *, (cur - av) / greatest(sd, 1e-7) AS z, cur / greatest(av, 1e-7) AS ratio, drift > 0.8 AND len(r) >= 3 AS alert,
  n_docs >= 2 AND n_hours >= 2 AS known FROM vb),
 vel AS (SELECT {key}, CASE WHEN known THEN round(cur, 6) ELSE 0e0 END AS centroid_distance, CASE WHEN known THEN round(av, 6) ELSE 0e0 END AS baseline_distance,
  CASE WHEN known THEN round(ratio, 3) ELSE 1e0 END AS velocity_ratio, CASE WHEN known THEN round(z, 2) ELSE 0e0 END AS velocity_zscore,
  CASE WHEN known THEN round(drift, 6) ELSE 0e0 END AS cumulative_drift, CASE WHEN known THEN alert ELSE false END AS cumulative_alert,
  CASE WHEN NOT known THEN 'insufficient_data' WHEN z > 3 THEN 'spike' WHEN alert THEN 'cumulative_drift' WHEN z > 1.5 THEN 'elevated' ELSE 'normal' END AS status,
  CASE WHEN known THEN CAST(coalesce(len(d), 0) AS INT) ELSE 0 END AS n_distances FROM vc)"""


VCOLS = "centroid_distance, baseline_distance, velocity_ratio, velocity_zscore, cumulative_drift, cumulative_alert, status"
ORACLES["hourly_centroids"] = f"""WITH {vectors()}, {centroids("label")} SELECT label, strftime(hour, {STAMP}) AS hour, docs,
 CAST(generate_subscripts(u, 1) - 1 AS INT) AS pos, round(unnest(u), 6) AS x FROM cent"""
ORACLES["centroid_distances"] = f"WITH {vectors()}, {distances('label')} SELECT label, strftime(hour, {STAMP}) AS hour, docs, distance FROM dist"
ORACLES["semantic_velocity"] = f"WITH {vectors()}, {velocity('label')} SELECT label, {VCOLS}, n_distances, 24 AS window_hours FROM vel"
SHARDS = f"{vectors(12)}, sh AS (SELECT vec_id % 37 AS shard, ts, {I.SHARD_VECTOR_SQL} AS embedding FROM vec)"
ORACLES["shard_velocity"] = f"WITH {SHARDS}, {velocity('shard', source='sh')} SELECT shard, {VCOLS} FROM vel"
ORACLES["velocity_anomalies"] = f"""WITH {SHARDS}, {velocity('shard', source='sh')} SELECT CAST(shard AS STRING) AS collection_name,
 'SEMANTIC_VELOCITY_SPIKE' AS anomaly_type, velocity_zscore AS z_score, CASE WHEN abs(velocity_zscore) >= 3.5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
 centroid_distance, baseline_distance, round(least(1e0, abs(velocity_zscore) / 10), 6) AS confidence FROM vel WHERE status = 'spike'"""
PICK = "(label < 4 AND vec_id % 3 = 0 OR label >= 7 AND vec_id < 10)"
ORACLES["velocity_fallback"] = f"""WITH {vectors()}, lv AS (SELECT * FROM vec WHERE {PICK}),
 hs AS (SELECT vec_id, embedding, label, CASE WHEN label < 7 THEN ts ELSE ts - INTERVAL 40 DAYS + to_seconds(vec_id % 1000) END AS ts FROM vec WHERE NOT {PICK}),
 l2 AS (SELECT label, ts, embedding FROM lv WHERE ts >= {DAY_END} - INTERVAL 24 HOURS),
 ri AS (SELECT label FROM l2 GROUP BY label HAVING count(*) >= 2),
 rw AS (SELECT * FROM l2 UNION ALL SELECT label, ts, embedding FROM hs WHERE ts >= {DAY_END} - INTERVAL 24 HOURS AND label NOT IN (SELECT label FROM ri)),
 en AS (SELECT label FROM rw GROUP BY label HAVING count(*) >= 2),
 sy AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY ts DESC) AS rn FROM hs WHERE label NOT IN (SELECT label FROM en)),
 al AS (SELECT label, ts, embedding FROM rw WHERE label IN (SELECT label FROM en)
  UNION ALL SELECT label, {DAY_END} - to_hours(CAST(floor((rn - 1) / 8) AS INT)), embedding FROM sy WHERE rn <= 60),
 {velocity('label', source='al')} SELECT label, {VCOLS} FROM vel"""
ORACLES["velocity_cards"] = f"""WITH {SHARDS}, {velocity('shard', source='sh')} SELECT shard, status,
 CASE status WHEN 'spike' THEN 0 WHEN 'elevated' THEN 1 WHEN 'cumulative_drift' THEN 2 ELSE 3 END AS place FROM vel
 WHERE status IN ('spike', 'elevated') OR n_distances > 1"""
ORACLES["anomaly_check"] = f"""WITH {SHARDS}, {velocity('shard', source='sh')} SELECT shard AS collection, velocity_zscore AS z_score,
 {half_up('centroid_distance', 4)} AS drift_distance, {half_up('baseline_distance', 4)} AS baseline, status FROM vel"""


def rates(source: str, key: str = "") -> str:
    """Detector rates over a relation with boolean t and p."""
    by = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    return f"""ev AS (SELECT {by}count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) FILTER (NOT t AND p) AS fp,
  count(*) FILTER (t AND NOT p) AS fn FROM {source} {group}),
 ev2 AS (SELECT *, tp / greatest(tp + fp, 1) AS pr, tp / greatest(tp + fn, 1) AS rc FROM ev)
 SELECT {by}tp, tn, fp, fn, round(pr, 6) AS precision, round(rc, 6) AS recall, round(2 * pr * rc / greatest(pr + rc, 0.001e0), 6) AS f1,
  round(fp / greatest(fp + tn, 1), 6) AS fpr, round(fn / greatest(fn + tp, 1), 6) AS fnr FROM ev2"""


ORACLES["backtest_velocity"] = f"""WITH {vectors(8)}, tr AS (SELECT label, vec_id % 5 AS trial, label % 2 = 1 AS poisoned, ts, embedding FROM vec),
 {velocity('label, trial, poisoned', source='tr')}, tv AS (SELECT poisoned AS t, status = 'spike' AS p FROM vel), {rates('tv')}"""
ORACLES["peak_zscore"] = f"""WITH {vectors()}, {distances('label')}, s AS (SELECT label, CAST(date_part('hour', hour) AS INT) AS h, distance FROM dist WHERE distance IS NOT NULL),
 m AS (SELECT label, avg(distance) AS a, stddev_pop(distance) AS sd FROM s GROUP BY label),
 z AS (SELECT label, h, CASE WHEN sd > 0 THEN abs(distance - a) / sd ELSE 0 END AS z FROM s JOIN m USING (label)),
 k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(z, 9) DESC, h) AS rn FROM z) SELECT label, round(z, 6) AS peak_z, h AS peak_at FROM k WHERE rn = 1"""

# --- write rates and runway ------------------------------------------------------------------


def windows(width: str, key: str = "event_type", source: str = "events", name: str = "ws") -> str:
    return f"""{name} AS (SELECT {key}, time_bucket(INTERVAL '{width}', ts, TIMESTAMP '1970-01-01') AS window_start,
  time_bucket(INTERVAL '{width}', ts, TIMESTAMP '1970-01-01') + INTERVAL '{width}' AS window_end, count(*) AS event_count,
  avg({EVENT_BYTES}) AS mean_bytes, max({EVENT_BYTES}) AS max_bytes FROM {source} GROUP BY ALL)"""


ORACLES["write_stats"] = f"""WITH {windows('60 seconds')} SELECT event_type, strftime(window_start, {STAMP}) AS window_start, strftime(window_end, {STAMP}) AS window_end,
 event_count, round(mean_bytes, 6) AS mean_bytes, max_bytes, round(mean_bytes / 1024, 6) AS avg_doc_size_kb, round(max_bytes / 1024e0, 6) AS max_doc_size_kb FROM ws"""
ORACLES["recent_counts"] = f"""SELECT u.user_id, count(e.event_id) AS event_count, round(count(e.event_id) / 60e0, 4) AS current_rate_per_min,
 strftime({AS_OF} - to_hours(CAST(i AS INT)), {STAMP}) AS window_end
 FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN range(6) r(i)
 LEFT JOIN events e ON e.user_id = u.user_id AND e.ts >= {AS_OF} - to_hours(CAST(i + 1 AS INT)) AND e.ts < {AS_OF} - to_hours(CAST(i AS INT)) GROUP BY u.user_id, i"""


def slopes(key: str, source: str, rate: str, name: str) -> str:
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY window_end DESC) AS rn FROM {source}),
 {name} AS (SELECT {key}, count(*) AS nw, coalesce((count(*) * sum(-rn * CAST({rate} AS DOUBLE)) - sum(-rn) * sum(CAST({rate} AS DOUBLE))) / nullif(count(*) * sum(rn * rn) - sum(rn) * sum(rn), 0), 0) AS slope,
  CAST(max(event_count) FILTER (rn = 1) AS DOUBLE) AS cur, max(mean_bytes) FILTER (rn = 1) / 1024 AS size_kb FROM {name}_r WHERE rn <= 6 GROUP BY {key})"""


def runway(key: str, source: str, base: str, projected: bool) -> str:
    eta = (
        f"strftime({AS_OF} + to_microseconds(CAST(trunc(mins * 60000000) AS BIGINT)), {STAMP}) AS projected_critical_at," if projected else ""
    )
    return f"""rj AS (SELECT s.*, (coalesce(b.m, 1024) + 3.5e0 * greatest(coalesce(nullif(b.sd, 0), 512), 1)) / 1024 - coalesce(size_kb, 0) AS gap, nw >= 3 AS ok
  FROM {source} s LEFT JOIN {base} b USING ({key})),
 rm AS (SELECT *, CASE WHEN ok AND slope > 0 AND cur > 0 AND gap > 0 THEN round(gap / slope, 1) END AS mins FROM rj)
 SELECT {key}, CASE WHEN ok THEN round(cur, 2) ELSE 0e0 END AS current_rate_per_min, {eta} mins AS minutes_to_critical,
 CASE WHEN NOT ok THEN 'stable' WHEN slope > 0.5 THEN 'increasing' WHEN slope < -0.5 THEN 'decreasing' ELSE 'stable' END AS trend,
 CASE WHEN ok THEN round(least(0.95e0, 0.3e0 + nw * 0.1e0 + CASE WHEN slope != 0 THEN 0.3e0 ELSE 0e0 END), 2) ELSE 0.1e0 END AS confidence,
 CASE WHEN NOT ok THEN 'insufficient_data' WHEN mins != 0 AND mins < 30 THEN 'CRITICAL_IMMINENT' WHEN mins != 0 AND mins < 120 THEN 'WARNING' ELSE 'NORMAL' END AS status,
 round(CASE WHEN ok THEN slope END, 6) AS slope, round(greatest(0e0, least(100e0, (240e0 - coalesce(mins, 240e0)) / 240 * 100)), 6) AS fill_pct FROM rm"""


EBASE = f"eb AS (SELECT event_type, avg({EVENT_BYTES}) AS m, stddev_samp({EVENT_BYTES}) AS sd FROM events GROUP BY 1)"
ORACLES["runway_rate"] = f"WITH {windows('6 hours')}, {EBASE}, {slopes('event_type', 'ws', 'event_count', 'sl')}, {runway('event_type', 'sl', 'eb', True)}"
ORACLES["runway_size"] = f"WITH {windows('1 hour')}, {EBASE}, {slopes('event_type', 'ws', 'mean_bytes / 1024', 'sl')}, {runway('event_type', 'sl', 'eb', False)}"
ORACLES["runway_fallback"] = f"""WITH g AS (SELECT *, CASE WHEN user_id % 10 = 0 THEN 'sparse' || user_id ELSE 'u' || user_id END AS grp FROM events),
 eb AS (SELECT grp, avg({EVENT_BYTES}) AS m, stddev_samp({EVENT_BYTES}) AS sd FROM g GROUP BY 1), {windows('1 day', 'grp', 'g', 'w0')},
 ws AS (SELECT * FROM w0 WHERE grp NOT LIKE 'sparse%' OR window_end <= TIMESTAMP '2024-01-03'), {slopes('grp', 'ws', 'event_count', 's1')},
 good AS (SELECT * FROM s1 WHERE nw >= 3),
 rc AS (SELECT u.grp, count(e.event_id) AS event_count, 0e0 AS mean_bytes, {AS_OF} - to_hours(CAST(i AS INT)) AS window_end
  FROM (SELECT DISTINCT grp FROM g) u CROSS JOIN range(6) r(i) LEFT JOIN g e ON e.grp = u.grp AND e.ts >= {AS_OF} - to_hours(CAST(i + 1 AS INT))
  AND e.ts < {AS_OF} - to_hours(CAST(i AS INT)) WHERE u.grp NOT IN (SELECT grp FROM good) GROUP BY u.grp, i),
 {slopes('grp', 'rc', 'event_count', 's2')}, sl AS (SELECT * FROM good UNION ALL SELECT * FROM s2), {runway('grp', 'sl', 'eb', False)}"""

# --- threats ------------------------------------------------------------------------------------

LABELS = list(dict.fromkeys(label for label, _, _ in P.INJECTION_PATTERNS))


def first_match(text: str, label: str) -> str:
    arms = [
        f"nullif(regexp_extract({text}, {quoted('(?i)' + p)}, 0), '')" for name, p, _ in P.INJECTION_PATTERNS if name == label
    ]
    return f"CASE WHEN length({text}) >= 10 THEN substring(coalesce({', '.join(arms)}), 1, 120) END"


MATCH_COLUMNS = ", ".join(f"{first_match('text', label)} AS m{i}" for i, label in enumerate(LABELS))
HIT_LIST = "[" + ", ".join(f"CASE WHEN m{i} IS NOT NULL THEN {quoted(label)} END" for i, label in enumerate(LABELS)) + "]"
TEXT_LIST = "[" + ", ".join(f"m{i}" for i in range(len(LABELS))) + "]"


def threats_sql(copies: int = 1) -> str:
    """Threat verdicts of the planted documents; the text counts ``copies`` times."""
    again = " || ".join(["hl"] * copies)
    texts = " || ".join(["tl"] * copies)
    return f"""pd AS (SELECT doc_id, {I.PLANTED_DOC} AS text FROM documents), pm AS (SELECT doc_id, {MATCH_COLUMNS} FROM pd),
 pl AS (SELECT doc_id, list_filter({HIT_LIST}, lambda x: x IS NOT NULL) AS hl, list_filter({TEXT_LIST}, lambda x: x IS NOT NULL) AS tl,
  CASE WHEN doc_id % 89 = 0 THEN 1 ELSE 0 END AS s FROM pm),
 pc AS (SELECT doc_id, {again} AS labels, {texts} AS texts, s, least(1e0, len({again}) * 0.35e0 + s * 0.2e0) AS raw FROM pl),
 th AS (SELECT doc_id, len(labels) > 0 OR s > 0 AS threat_detected,
  CASE WHEN len(labels) >= 2 OR raw >= 0.7 THEN 'CRITICAL' WHEN len(labels) > 0 OR s > 0 THEN 'WARNING' END AS severity, CAST(len(labels) AS INT) AS n_matches,
  array_to_string(labels, ',') AS labels, array_to_string(texts, '|') AS matched, CASE WHEN s > 0 THEN 'system_prompt' ELSE '' END AS suspicious_fields,
  round(raw, 3) AS confidence FROM pc)"""


ORACLES["scan_threats"] = f"WITH {threats_sql()} SELECT * FROM th"
ORACLES["scan_threats_nested"] = f"WITH {threats_sql(2)} SELECT * FROM th"
ORACLES["scan_requests"] = f"SELECT conv_id, turn, regexp_matches({I.PLANTED_TURN}, {quoted('(?i)' + P.REQUEST_PATTERN)}) AS blocked FROM conversations"
PLANTED_ANOMALIES = f"pdocs AS (SELECT doc_id, {I.PLANTED_DOC} AS text, lang, source, n_chars FROM documents), {anomalies_of('pdocs')}"
ESCALATED = f"""{threats_sql()}, {PLANTED_ANOMALIES}, esc AS (SELECT f.document_id, f.lang AS collection_name, round(f.z, 3) AS z_score,
  CASE WHEN th.threat_detected THEN 'AI_MEMORY_POISONING' ELSE 'DOC_SIZE_SPIKE' END AS anomaly_type,
  CASE WHEN th.threat_detected THEN th.severity ELSE f.severity END AS severity, th.threat_detected AS ai_memory_poisoning
  FROM found f JOIN th ON th.doc_id = f.doc_id)"""
ORACLES["escalate"] = f"WITH {ESCALATED} SELECT * FROM esc"
ORACLES["runway_null_key"] = ORACLES["runway_rate"]
ORACLES["flagged_by_collection"] = f"WITH {anomalies_of('documents')} SELECT document_id, lang AS collection_name, n_chars, round(z, 3) AS z_score FROM found"
ORACLES["evaluate_threats"] = f"""WITH {threats_sql()}, tv AS (SELECT doc_id % 97 IN ({', '.join(str(k) for k in I.PAYLOADS)}) AS t, threat_detected AS p FROM th), {rates('tv')}"""
ORACLES["evaluate_sizes"] = f"""WITH {anomalies_of('documents')}, tv AS (SELECT lang, toxic = 1 AS t, abs(z) >= 2.0 AS p FROM zs JOIN labels USING (doc_id)), {rates('tv', 'lang')}"""

# --- similarity ---------------------------------------------------------------------------------------

QUERY_VECTORS = f"qv AS (SELECT *, TIMESTAMP '2024-01-01' AS ts FROM embeddings), {centroids('label', source='qv')}"
COSINE = "round(list_inner_product(q.u, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))) / sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6)"


def nearest(k: int, same: bool = False) -> str:
    on = "q.label = e.label" if same else "true"
    return f"""{QUERY_VECTORS}, sc AS (SELECT q.label AS query, e.vec_id, {COSINE} AS score FROM cent q JOIN embeddings e ON {on}),
 nr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INT) AS rank FROM sc QUALIFY rank <= {k})"""


ORACLES["nearest"] = f"WITH {nearest(10)} SELECT query, vec_id, score, rank FROM nr"
ORACLES["nearest_filtered"] = f"WITH {nearest(10, True)} SELECT query, vec_id, score, rank FROM nr"
DUP_KEY = f"{I.VECTOR_TYPE} || '|' || lower(trim(regexp_replace(substring({I.VECTOR_TEXT}, 1, 60), '[\\d.\\s]+$', '')))"
# near-duplicates collapse before the best three are taken, however many there are
SIMILAR = f"""{QUERY_VECTORS}, sc AS (SELECT q.label AS query, e.vec_id, {COSINE} AS score FROM cent q JOIN embeddings e ON true),
 hs AS (SELECT vec_id, {I.VECTOR_TYPE} AS anomaly_type, {I.VECTOR_TEXT} AS description, {DUP_KEY} AS dk, CAST(vec_id % 50 AS INT) AS mins FROM embeddings),
 cd AS (SELECT sc.query, sc.vec_id, sc.score, hs.anomaly_type, hs.description, hs.mins FROM sc JOIN hs USING (vec_id)
  QUALIFY row_number() OVER (PARTITION BY query, dk ORDER BY score DESC, vec_id) = 1),
 sm AS (SELECT query, vec_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INT) AS rank, anomaly_type, description, mins
  FROM cd QUALIFY rank <= 3)"""
ORACLES["similar_incidents"] = f"WITH {SIMILAR} SELECT query, vec_id, score, rank, anomaly_type, description FROM sm"
ORACLES["similar_summary"] = f"""WITH {SIMILAR} SELECT query, count(*) AS n_matches, max(score) FILTER (rank = 1) AS top_match_score,
 max(anomaly_type) FILTER (rank = 1) AS pattern_identified, max(mins) FILTER (rank = 1) AS estimated_resolution_minutes FROM sm GROUP BY query"""
SIX = "WHEN 0 THEN 'error' WHEN 1 THEN 'view' WHEN 2 THEN 'click' WHEN 3 THEN 'signup' WHEN 4 THEN 'purchase' ELSE 'unheard' END"
ORACLES["recent_same_type"] = f"""WITH a AS (SELECT c_custkey, CASE c_nationkey % 6 {SIX} AS et FROM customer),
 t AS (SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS INT) AS rank FROM events QUALIFY rank <= 3),
 g AS (SELECT event_type, event_id, CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS INT) AS rank FROM events QUALIFY rank <= 3)
 SELECT c_custkey, event_id, event_type, rank FROM a JOIN t ON t.event_type = a.et
 UNION ALL SELECT c_custkey, event_id, event_type, rank FROM a CROSS JOIN g WHERE et NOT IN (SELECT event_type FROM events)"""
ORACLES["text_similar"] = r"""WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\W+'), lambda w: w <> '') AS w FROM documents),
 asks AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\W+'), lambda w: w <> '') AS w FROM benchmark),
 dt AS (SELECT doc_id, p, count(*)::DOUBLE AS n FROM (SELECT doc_id, CAST('0x' || substr(md5(unnest(w)), 1, 7) AS BIGINT) % 384 AS p FROM docs) GROUP BY ALL),
 qt AS (SELECT item_id, p, count(*)::DOUBLE AS n FROM (SELECT item_id, CAST('0x' || substr(md5(unnest(w)), 1, 7) AS BIGINT) % 384 AS p FROM asks) GROUP BY ALL),
 dl AS (SELECT doc_id, sqrt(sum(n * n)) AS len FROM dt GROUP BY 1), ql AS (SELECT item_id, sqrt(sum(n * n)) AS len FROM qt GROUP BY 1),
 dot AS (SELECT item_id, doc_id, sum(qt.n * dt.n) AS x FROM qt JOIN dt USING (p) GROUP BY ALL),
 sc AS (SELECT a.item_id, d.doc_id, coalesce(round(x / (ql.len * dl.len), 6), 0e0) AS score FROM benchmark a CROSS JOIN documents d
  LEFT JOIN dot ON dot.item_id = a.item_id AND dot.doc_id = d.doc_id LEFT JOIN dl ON dl.doc_id = d.doc_id LEFT JOIN ql ON ql.item_id = a.item_id)
 SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM sc QUALIFY rank <= 3"""
ORACLES["embedded_once"] = """SELECT (SELECT count(*) FROM (SELECT text FROM documents UNION SELECT text FROM benchmark)) AS embedded, (SELECT count(*) FROM documents) + (SELECT count(*) FROM benchmark) AS texts"""
ORACLES["nearest_indexed"] = """SELECT count(*) AS queries, count(*) * 10 AS found, true AS recall_reached, (SELECT count(*) FROM embeddings) >= 400 AS fewer_cells
 FROM embeddings WHERE vec_id % 20 = 0"""
ORACLES["backfill_embeddings"] = f"""SELECT {I.COLLECTION_OF_EVENT} AS collection_name, count(*) AS n, count(*) AS n_embedded,
 count(*) FILTER (event_id % 2 = 0) AS n_kept, 384 AS width FROM events GROUP BY 1"""

# --- incidents -----------------------------------------------------------------------------------------------

EVIDENCE = f"""ei AS (SELECT event_id, least(1e0, (user_id % 4) * 0.30e0 + (event_id % 3) * 0.15e0 + least(event_id % 8, 5) * 0.05e0) * 0.35e0 AS c1,
  {half_up('(event_id % 101) / 101e0 * 0.30e0', 3)} AS c2,
  {half_up('CASE WHEN event_id % 2 = 0 AND event_id % 5 + user_id % 3 > 2 THEN least(1e0, 0.9e0 + 0.05e0 * (event_id % 5 + user_id % 3)) WHEN event_id % 2 = 0 THEN 0.9e0 ELSE 0.15e0 END * 0.20e0', 3)} AS c3,
  {half_up('least(1e0, abs(value / 4 - 5) / 10) * 0.15e0', 3)} AS c4 FROM events)"""
ORACLES["evidence_confidence"] = f"""WITH {EVIDENCE}, l AS (SELECT event_id, c1 + c2 + c3 + c4 AS total,
  list_sort([{{'n': -{half_up('c1', 3)}, 'i': 0, 's': 'advisor'}}, {{'n': -c2, 'i': 1, 's': 'vector_search'}}, {{'n': -c3, 'i': 2, 's': 'schema_drift'}}, {{'n': -c4, 'i': 3, 's': 'z_score'}}]) AS r FROM ei)
 SELECT event_id, {half_up('total', 3)} AS total_confidence, r[1].s || ',' || r[2].s AS top_sources FROM l"""
ORACLES["evidence_confidence_ui"] = f"""WITH u AS (SELECT event_id, (user_id % 10) / 10e0 AS a, (event_id % 101) / 101e0 AS v,
  least(1e0, (event_id % 5) * 0.2e0 + (user_id % 2) * 0.3e0) AS s, greatest(0e0, least(1e0, (value / 4 - 5 - 2) / 8)) AS z FROM events)
 SELECT event_id, {half_up('s', 6)} AS schema_score, {half_up('z', 6)} AS z_score_norm, {half_up('a * 0.35e0 + v * 0.30e0 + s * 0.20e0 + z * 0.15e0', 6)} AS total_confidence FROM u"""

FACTOR = I.case_of(T.TYPE_MULTIPLIER, "anomaly_type", "1.0e0", quote=False)
TIER = I.case_of(T.COLLECTION_TIER, "lower(collection_name)", "1.0e0", quote=False)


def cost(source: str) -> str:
    """Cost columns over a relation with anomaly columns and dc (row count)."""
    return f"""k1 AS (SELECT *, {FACTOR} AS anomaly_mult, {TIER} AS collection_tier, greatest(greatest(coalesce(dc, 10000), 1) / 10000e0, 0.1e0) AS qps,
  1 + least(abs(z_score), 300e0) / 50 AS deg FROM {source}),
 k2 AS (SELECT *, round(qps * deg * anomaly_mult * collection_tier * 0.15e0, 2) AS per_minute_usd FROM k1),
 k3 AS (SELECT *, round(per_minute_usd * 60, 2) AS if_unresolved_1hr_usd, round(per_minute_usd * 11, 2) AS own, 510e0 AS engineer_triage_usd FROM k2),
 ct AS (SELECT *, round(if_unresolved_1hr_usd + 510e0, 2) AS total_worst_case_usd, greatest(round(510e0 - own + (if_unresolved_1hr_usd - own), 2), 0e0) AS saved_usd FROM k3)"""


COUNTED = f"""{I.ANOMALIES_SQL}, cn AS (SELECT collection_name, count(*) * 977 AS dc FROM anomalies WHERE collection_name != 'misc' GROUP BY 1),
 ac AS (SELECT a.*, cn.dc FROM anomalies a LEFT JOIN cn USING (collection_name))"""
ORACLES["dollar_impact"] = f"""WITH {COUNTED}, {cost('ac')} SELECT event_id, per_minute_usd, if_unresolved_1hr_usd, engineer_triage_usd, total_worst_case_usd, saved_usd,
 anomaly_mult, collection_tier FROM ct"""
TITLE = I.case_of({k: r[0][0] for k, r in T.REMEDIATION.items()}, "anomaly_type", quoted(T.DEFAULT_REMEDIATION[0][0]))
MINUTES = I.case_of({k: r[0][2] for k, r in T.REMEDIATION.items()}, "anomaly_type", quoted(str(T.DEFAULT_REMEDIATION[0][2])))
CLASS_ID = I.case_of({k: v[0] for k, v in T.THREAT_CLASSES.items()}, "anomaly_type", "'LLM05'")
CLASS_NAME = I.case_of({k: v[1] for k, v in T.THREAT_CLASSES.items()}, "anomaly_type", "'Supply Chain Vulnerabilities'")
CAUSE = I.case_of(T.ROOT_CAUSE, "anomaly_type", "anomaly_type || ' detected on ''' || collection_name || '''; manual review recommended.'")
TITLED = "array_to_string(list_transform(string_split(anomaly_type, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
TAIL = """CASE anomaly_type WHEN 'AI_MEMORY_POISONING' THEN ' Document contains prompt-injection content.'
 WHEN 'SEMANTIC_VELOCITY_SPIKE' THEN ' Semantic meaning diverged from historical norm.' ELSE '' END"""
ORACLES["incident_reports"] = f"""WITH {COUNTED}, {cost('ac')}, rp AS (SELECT *, severity || ' ' || {TITLED} || ' in ''' || collection_name || ''' (z=' || {one_decimal('z_score')} || ').' || {TAIL} AS anomaly_summary,
  {TITLE} AS title, CASE WHEN anomaly_type IN ({', '.join(quoted(k) for k in T.ROOT_CAUSE)}) THEN 0.75e0 ELSE 0.5e0 END AS rc FROM ct)
 SELECT document_id, collection_name, anomaly_type, severity, anomaly_summary, {CAUSE} AS root_cause_description, rc AS root_cause_confidence,
 CASE WHEN anomaly_type IN ('AI_MEMORY_POISONING', 'SEMANTIC_VELOCITY_SPIKE') THEN 'security_threat' WHEN anomaly_type IN ('SCHEMA_DRIFT', 'ETL_MISCONFIGURATION') THEN 'data_pipeline' ELSE 'infrastructure' END AS category,
 title AS immediate_action, severity = 'CRITICAL' AS escalate, 30 AS estimated_resolution_minutes, {CLASS_ID} AS class_id, {CLASS_NAME} AS class_name,
 {half_up('0.03e0 + ' + half_up('least(1e0, abs(z_score) / 10) * 0.15e0', 3), 3)} AS total_confidence, per_minute_usd, total_worst_case_usd,
 severity || ' ' || anomaly_type || ' on ''' || collection_name || ''' (z=' || {one_decimal('z_score')} || '). ' || anomaly_summary || ' Recommended: ' || title || ' (~' || {MINUTES} || ' min).' AS summary FROM rp"""
ORACLES["document_incidents"] = f"""WITH {ESCALATED}, dcount AS (SELECT lang AS collection_name, count(*) AS dc FROM documents GROUP BY 1),
 ec AS (SELECT esc.*, dc FROM esc LEFT JOIN dcount USING (collection_name)), {cost('ec')}
 SELECT document_id, collection_name, anomaly_type, severity, {TITLE} AS immediate_action, {CLASS_ID} AS class_id, 30 AS estimated_resolution_minutes,
 per_minute_usd, ai_memory_poisoning FROM ct"""
ORACLES["merge_replies"] = """SELECT event_id, event_id % 5 < 3 AS enriched, CASE WHEN event_id % 5 < 3 THEN CAST(json_extract(props, '$.k') AS INT) ELSE -1 END AS k FROM events"""

# --- correlation and sequential rules ------------------------------------------------------------------------------

WINDOWS = f"""ea AS (SELECT {I.COLLECTION_OF_EVENT} AS c, ts, unnest(range(5)) AS j FROM events),
 sw AS (SELECT time_bucket(INTERVAL '1 minute', ts) - to_minutes(CAST(j AS INT)) AS s, list_sort(list(DISTINCT c)) AS cs, arg_min(c, {{'t': ts, 'c': c}}) AS pz, count(*) AS n FROM ea GROUP BY 1),
 cw AS (SELECT s, s + INTERVAL 5 MINUTES AS e, array_to_string(cs, '|') AS collection_key, pz AS patient_zero, n AS n_anomalies, round(len(cs) / 6e0, 3) AS confidence,
  CASE WHEN round(len(cs) / 6e0, 3) >= 0.7 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM sw WHERE len(cs) >= 2)"""
ORACLES["correlation_windows"] = f"""WITH {WINDOWS} SELECT strftime(s, {STAMP}) AS window_start, strftime(e, {STAMP}) AS window_end, collection_key, patient_zero,
 n_anomalies, confidence, severity FROM cw"""
ORACLES["suppress_stored"] = f"""WITH {WINDOWS}, st AS (SELECT collection_key, e - INTERVAL 7 MINUTES AS stored_at FROM cw WHERE n_anomalies >= 3)
 SELECT strftime(s, {STAMP}) AS window_start, collection_key FROM cw WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.collection_key = cw.collection_key AND st.stored_at >= cw.e - INTERVAL 1 HOUR AND st.stored_at <= cw.e)"""


def chain(source: str, key: str, ts: str, seconds: int) -> str:
    """Greedy re-fire rule as a recursive walk: one step per kept event."""
    return f"""RECURSIVE_CHAIN AS (SELECT {key}, min({ts}) AS t FROM {source} GROUP BY {key}
  UNION ALL SELECT c.{key}, min(e.{ts}) FROM RECURSIVE_CHAIN c JOIN {source} e ON e.{key} = c.{key} AND e.{ts} >= c.t + INTERVAL {seconds} SECONDS GROUP BY c.{key}, c.t)"""


ORACLES["suppress_refires"] = f"""WITH RECURSIVE {chain('events', 'event_type', 'ts', 3600)} SELECT e.event_type, e.event_id, strftime(e.ts, {STAMP}) AS ts
 FROM RECURSIVE_CHAIN c JOIN events e ON e.event_type = c.event_type AND e.ts = c.t"""
ORACLES["correlated_refires"] = f"""WITH RECURSIVE {WINDOWS}, {chain('cw', 'collection_key', 'e', 3600)} SELECT collection_key, strftime(t, {STAMP}) AS ts FROM RECURSIVE_CHAIN"""
ORACLES["throttle_checks"] = f"""WITH RECURSIVE {chain('events', 'event_type', 'ts', 1800)} SELECT e.event_type, e.event_id, CAST(c.t IS NOT NULL AS INT) AS checked
 FROM events e LEFT JOIN RECURSIVE_CHAIN c ON e.event_type = c.event_type AND e.ts = c.t"""
NUMBERED = "ne AS (SELECT user_id, event_id, ts, event_type IN ('error', 'view', 'click') AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"
ORACLES["rate_limit"] = f"""WITH RECURSIVE {NUMBERED}, st AS (SELECT user_id, event_id, rn, [ts] AS log, 1 AS admitted FROM ne WHERE rn = 1
 UNION ALL SELECT n.user_id, n.event_id, n.rn,
  CASE WHEN len(list_filter(s.log, lambda x: n.ts - x <= INTERVAL 86400 SECONDS)) < 3 THEN list_append(list_filter(s.log, lambda x: n.ts - x <= INTERVAL 86400 SECONDS), n.ts)
   ELSE list_filter(s.log, lambda x: n.ts - x <= INTERVAL 86400 SECONDS) END,
  CASE WHEN len(list_filter(s.log, lambda x: n.ts - x <= INTERVAL 86400 SECONDS)) < 3 THEN 1 ELSE 0 END
  FROM st s JOIN ne n ON n.user_id = s.user_id AND n.rn = s.rn + 1) SELECT user_id, event_id, admitted FROM st"""
ORACLES["circuit_state"] = f"""WITH RECURSIVE {NUMBERED}, st AS (SELECT user_id, event_id, rn, CASE WHEN failed THEN 1 ELSE 0 END AS f, CAST(NULL AS TIMESTAMP) AS opened, 1 AS ran FROM ne WHERE rn = 1
 UNION ALL SELECT user_id, event_id, rn, CASE WHEN ran = 0 THEN f WHEN NOT failed THEN 0 ELSE f0 + 1 END, CASE WHEN ran = 1 AND failed AND f0 + 1 >= 3 THEN ts ELSE opened END, ran FROM (
  SELECT n.user_id, n.event_id, n.rn, n.ts, n.failed, s.f, s.opened, CASE WHEN s.f >= 3 THEN 0 ELSE s.f END AS f0,
   CASE WHEN s.f >= 3 AND n.ts - s.opened <= INTERVAL 86400 SECONDS THEN 0 ELSE 1 END AS ran
  FROM st s JOIN ne n ON n.user_id = s.user_id AND n.rn = s.rn + 1)) SELECT user_id, event_id, ran FROM st"""

# --- audit --------------------------------------------------------------------------------------------------------------


def option_title(kind: str, rank: str) -> str:
    arms = []
    for name, rows in T.REMEDIATION.items():
        inner = " ".join(f"WHEN {i} THEN {quoted(r[0])}" for i, r in enumerate(rows, 1))
        arms.append(f"WHEN '{name}' THEN CASE {rank} {inner} ELSE {quoted(rows[0][0])} END")
    return f"(CASE {kind} {' '.join(arms)} ELSE {quoted(T.DEFAULT_REMEDIATION[0][0])} END)"


APPROVED = f"""ic AS (SELECT 'i' || event_id AS incident_id, event_type AS coll, {I.ANOMALY_KIND} AS kind, ts, event_id FROM events),
 lt AS (SELECT coll, arg_max({{'i': incident_id, 'k': kind}}, {{'t': ts, 'i': incident_id}}) AS l FROM ic GROUP BY coll),
 ap AS (SELECT 'i' || CAST(o_orderkey AS STRING) AS requested_id, CASE o_custkey % 6 {SIX} AS coll, CAST(o_orderkey % 4 + 1 AS INT) AS option_rank, o_orderdate AS done_at FROM orders),
 ar AS (SELECT ap.requested_id, coalesce(ic.incident_id, lt.l.i) AS incident_id, coalesce(ic.coll, ap.coll) AS collection, option_rank, coalesce(ic.kind, lt.l.k) AS kind, ap.done_at
  FROM ap LEFT JOIN ic ON ic.incident_id = ap.requested_id LEFT JOIN lt ON lt.coll = ap.coll)"""
ORACLES["resolve_approvals"] = f"""WITH {APPROVED} SELECT requested_id, incident_id, collection, option_rank,
 CASE WHEN incident_id IS NOT NULL THEN {option_title('kind', 'option_rank')} END AS option_title, CASE WHEN incident_id IS NULL THEN 'not_found' ELSE 'approved' END AS status FROM ar"""
ORACLES["apply_approvals"] = f"""WITH {APPROVED}, la AS (SELECT incident_id, arg_max({{'r': option_rank, 'a': done_at}}, {{'a': done_at, 'r': option_rank}}) AS x FROM ar WHERE incident_id IS NOT NULL GROUP BY 1)
 SELECT ic.incident_id, la.incident_id IS NOT NULL AS approved, x.r AS approved_option, strftime(x.a, {STAMP}) AS approved_at FROM ic LEFT JOIN la USING (incident_id)"""
ORACLES["audit_calls"] = f"""WITH c AS (SELECT *, {I.TOOL} AS tool_name FROM events), b AS (SELECT *, tool_name IN ('create_index', 'delete-many') AND user_id % 2 = 1 AS was_blocked FROM c WHERE tool_name IS NOT NULL)
 SELECT 'i' || user_id AS incident_id, 'c' || user_id % 6 AS collection_name, tool_name, '***REDACTED***' AS password, props AS query,
 CAST(length('{{"user_id":' || user_id || ',"event_type":"' || event_type || '"}}') AS INT) AS response_size_bytes, CASE WHEN was_blocked THEN 0 ELSE event_id % 50 END AS latency_ms,
 was_blocked, CASE WHEN was_blocked THEN 'AWAITING_APPROVAL' ELSE 'OK' END AS status, strftime(ts, {STAMP}) AS timestamp FROM b"""
ORACLES["seal_verify"] = """SELECT o_orderkey, o_orderkey % 1000 != 8 AS has_receipt, o_orderkey % 1000 NOT IN (7, 8) AS verified, o_orderkey % 1000 = 7 AS tampered FROM orders"""
TRACE = f"tr AS (SELECT 'i' || user_id AS incident_id, event_type AS agent, epoch_us(ts) // 1000 AS at_ms, {I.TOOL} AS tool_name, value > 20 AS has_text FROM events)"
SPANS = f"""{TRACE}, sp AS (SELECT incident_id, agent, min(at_ms) AS start_ms, max(at_ms) AS end_ms, count(tool_name) AS n_tool_calls, count(*) FILTER (has_text) AS text_chunks,
  max(at_ms) - min(at_ms) AS duration_ms FROM tr GROUP BY 1, 2)"""
ORACLES["span_summary"] = f"WITH {SPANS} SELECT * FROM sp"
ORACLES["span_overlap"] = f"""WITH {SPANS}, g AS (SELECT incident_id, count(*) AS n_spans, max(start_ms) AS ms, min(end_ms) AS me, CAST(sum(duration_ms) AS BIGINT) AS sequential_sum_ms, max(end_ms) - min(start_ms) AS w
  FROM sp WHERE agent IN ('error', 'view', 'click', 'signup') GROUP BY 1), h AS (SELECT *, CASE WHEN n_spans >= 2 THEN w ELSE sequential_sum_ms END AS parallel_wall_ms FROM g)
 SELECT incident_id, n_spans, n_spans >= 2 AND ms < me AS parallel_verified, sequential_sum_ms, parallel_wall_ms,
 CASE WHEN parallel_wall_ms != 0 THEN round(sequential_sum_ms / greatest(parallel_wall_ms, 1), 2) ELSE 1e0 END AS speedup_factor FROM h"""
ORACLES["tool_counts"] = f"WITH {TRACE} SELECT incident_id, tool_name AS name, count(*) AS n FROM tr WHERE tool_name IS NOT NULL GROUP BY 1, 2"
ORACLES["expected_agents"] = f"""WITH {TRACE}, s AS (SELECT incident_id, coalesce(list(DISTINCT agent || ':' || tool_name) FILTER (agent || ':' || tool_name IN ('error:find', 'view:find', 'click:aggregate')), []) AS l
  FROM tr WHERE tool_name IS NOT NULL GROUP BY 1), w AS (SELECT *, ['click:aggregate', 'error:find', 'view:find'] AS e FROM s)
 SELECT incident_id, array_to_string(list_filter(e, lambda x: list_contains(l, x)), ',') AS seen, array_to_string(list_filter(e, lambda x: NOT list_contains(l, x)), ',') AS missing, len(l) = 3 AS complete FROM w"""

# --- feeds, lookups, keyed writes ------------------------------------------------------------------------------------------

ORACLES["newest"] = f"SELECT event_id, strftime(ts, {STAMP}) AS ts, event_type FROM (SELECT * FROM events ORDER BY events.ts DESC, event_id DESC LIMIT 500) e"
ORACLES["replay"] = f"""SELECT CAST(row_number() OVER (ORDER BY e.ts, event_id) AS INT) AS place, event_id, strftime(e.ts, {STAMP}) AS ts
 FROM (SELECT * FROM events ORDER BY events.ts DESC, event_id DESC LIMIT 10) e"""
ORACLES["latest_per_key"] = f"""SELECT user_id, event_id, strftime(e.ts, {STAMP}) AS ts, event_type, value FROM events e
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY e.ts DESC, event_id DESC) = 1"""
ORACLES["dedup_feed"] = f"""WITH o AS (SELECT 'a' || event_id % 700 AS id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC) = 1),
 t AS (SELECT * FROM o ORDER BY ts DESC, id DESC LIMIT 100) SELECT id, strftime(t.ts, {STAMP}) AS ts, event_type FROM t"""
ORACLES["flagged_documents"] = f"WITH {anomalies_of('documents')} SELECT document_id, source, n_chars, round(z, 3) AS z_score FROM found"
ORACLES["lookup"] = "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"
ORACLES["filters"] = """SELECT event_id, event_type, value FROM events WHERE (CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 2 = 0 END) IS DISTINCT FROM true
 AND event_type IN ('view', 'click') AND value >= 5 AND value < 60"""
ORACLES["system_status"] = """SELECT (SELECT count(*) FROM events WHERE event_id % 5 < 3) AS failed_events_pending, (SELECT count(*) FROM embeddings) AS history_rows,
 (SELECT count(embedding) FROM embeddings) AS embedded_rows, (SELECT count(DISTINCT event_type) FROM events) AS streams, 'ok' AS vector_search, 'degraded' AS status"""
ORACLES["stream_health"] = f"SELECT {I.COLLECTION_OF_EVENT} AS stream, strftime(max(ts), {STAMP}) AS updated_at FROM events GROUP BY 1"
ORACLES["result_summary"] = """SELECT event_type, count(*) FILTER (user_id % 4 != 0) AS passed, count(*) FILTER (user_id % 4 = 0) AS failed, round(sum(value), 4) AS total_ms,
 round(avg(value), 6) AS mean_ms FROM events GROUP BY 1"""
ORACLES["slowest"] = """SELECT event_type, event_id, value, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INT) AS rank FROM events QUALIFY rank <= 5"""
ORACLES["upsert_latest"] = """SELECT o_orderkey % 4000 AS k, o_orderkey, o_totalprice FROM orders
 QUALIFY row_number() OVER (PARTITION BY o_orderkey % 4000 ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
ORACLES["upsert_buckets"] = ORACLES["upsert_latest"]
ORACLES["delete_buckets"] = """SELECT o_orderkey % 4000 AS k, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 4000 != 17
 QUALIFY row_number() OVER (PARTITION BY k ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
ORACLES["patch"] = """SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 'x' END AS note FROM customer"""
ORACLES["merge_keep_existing"] = """SELECT DISTINCT user_id, CAST(event_id % 30 AS INT) AS slot FROM events
 WHERE (user_id, event_id % 30) NOT IN (SELECT (user_id, event_id % 30) FROM events WHERE event_id % 4 = 0)"""
ORACLES["delete_where"] = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 2 = 0 END AS tag FROM events WHERE event_id % 3 = 0 OR event_id % 2 = 1"""
ORACLES["dead_letter"] = """SELECT event_id, CASE WHEN event_id % 50 = 0 THEN props || '}' WHEN event_id % 50 = 1 THEN NULL ELSE props END AS props,
 CASE WHEN event_id % 50 < 2 THEN 'JSONDecodeError' END AS error_type, CASE event_id % 50 WHEN 0 THEN 'not valid JSON' WHEN 1 THEN '(no message)' END AS error_message FROM events"""
ORACLES["shorten"] = """SELECT doc_id, CAST(CASE WHEN length(CAST(json_object('text', text) AS STRING)) > 2000 AND length(text) > 300 THEN 312 ELSE length(text) END AS INT) AS kept, n_chars FROM documents"""
ORACLES["duplicate_keys"] = f"SELECT vec_id, {DUP_KEY} AS dup_key FROM embeddings"

ORACLES["size_context"] = f"""WITH {anomalies_of("documents")}, st AS ({ORACLES["size_stats"]}) SELECT document_id, lang AS collection_name, mean_kb, max_kb FROM found JOIN st USING (lang)"""
ORACLES["series_zscores"] = """SELECT event_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z FROM events WINDOW w AS (PARTITION BY event_type)"""
ORACLES["document_strings"] = """SELECT event_id, 'user' AS field, 'u' || user_id AS text FROM events WHERE user_id % 7 = 0
 UNION ALL SELECT event_id, 'tags[0]', 'a' FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, 'tags[1]', 'b' FROM events WHERE event_id % 5 = 0"""
ORACLES["fields_present"] = """SELECT event_type, count(*) FILTER (event_id % 11 = 0) AS with_note, count(*) FILTER (event_type IN ('click', 'error') AND event_id % 3 = 0) AS with_lat,
 count(*) FILTER (event_id % 5 != 0) AS without_tag FROM events GROUP BY 1"""
ORACLES["cosine_distances"] = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a,
  list_transform(embedding, lambda x, i: CASE WHEN i % 2 = 1 THEN -CAST(x AS DOUBLE) ELSE CAST(x AS DOUBLE) END) AS b FROM embeddings)
 SELECT vec_id, round(1 - list_inner_product(a, b) / list_inner_product(a, a), 6) AS flipped, 0e0 AS zero FROM e"""
ORACLES["correlated_events"] = f"""WITH t AS (SELECT {I.COLLECTION_OF_EVENT} AS c, ts FROM events)
 SELECT array_to_string(list_sort(list(DISTINCT c)), '|') AS collection_key, arg_min(c, {{'t': ts, 'c': c}}) AS patient_zero, count(*) AS n_anomalies,
 round(count(DISTINCT c) / 6e0, 3) AS confidence, CASE WHEN count(DISTINCT c) / 6e0 >= 0.7 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, '{I.AS_OF}' AS window_end FROM t"""
ORACLES["cluster_list"] = f"""WITH {WINDOWS} SELECT collection_key, strftime(e, {STAMP}) AS created_at, severity FROM cw ORDER BY cw.e DESC, collection_key DESC LIMIT 99"""
ORACLES["incident_list"] = f"""WITH {COUNTED}, {cost('ac')} SELECT document_id AS incident_id, collection_name, {TITLE} AS title, per_minute_usd FROM ct ORDER BY detected_at DESC, document_id DESC LIMIT 10"""
# the first page of a span: its first two calls of the first hour with a call
ORACLES["incident_details"] = f"""WITH {SPANS}, {EVIDENCE.replace("value / 4 - 5", "value - 20")}, {COUNTED}, {cost('ac')},
 nw AS (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1),
 st AS (SELECT incident_id, max(end_ms) - min(start_ms) AS total_ms,
  array_to_string(list(agent || ':' || start_ms || ':' || duration_ms || ':' || n_tool_calls ORDER BY start_ms, agent), ',') AS steps FROM sp GROUP BY 1),
 fc AS (SELECT incident_id, agent, tool_name FROM tr WHERE tool_name IS NOT NULL
  QUALIFY dense_rank() OVER (PARTITION BY incident_id, agent ORDER BY at_ms // 3600000) = 1 AND row_number() OVER (PARTITION BY incident_id, agent, at_ms // 3600000 ORDER BY at_ms, tool_name) <= 2),
 fs AS (SELECT incident_id, array_to_string(list(agent || ':' || tool_name ORDER BY agent || ':' || tool_name), ',') AS first_calls FROM fc GROUP BY 1),
 tc AS ({ORACLES["tool_counts"]}), ts AS (SELECT incident_id, array_to_string(list(name || ':' || n ORDER BY name), ',') AS tools FROM tc GROUP BY 1),
 ov AS ({ORACLES["span_overlap"]}),
 ev AS (SELECT event_id, {half_up('c1 + c2 + c3 + c4', 3)} AS total_confidence,
  list_sort([{{'n': -{half_up('c1', 3)}, 'i': 0, 's': 'advisor'}}, {{'n': -c2, 'i': 1, 's': 'vector_search'}}, {{'n': -c3, 'i': 2, 's': 'schema_drift'}}, {{'n': -c4, 'i': 3, 's': 'z_score'}}]) AS r FROM ei)
 SELECT st.incident_id, st.total_ms, st.steps, coalesce(fs.first_calls, '') AS first_calls, ov.parallel_verified, ov.speedup_factor, ts.tools,
  CASE WHEN nw.user_id % 3 = 0 THEN 1.5e0 ELSE ct.per_minute_usd END AS per_minute_usd, CASE WHEN nw.user_id % 3 != 0 THEN ct.total_worst_case_usd END AS total_worst_case_usd,
  nw.user_id % 3 = 0 AS impact_stored, ev.total_confidence, ev.r[1].s || ',' || ev.r[2].s AS top_sources
 FROM nw JOIN ct USING (event_id) JOIN ev USING (event_id) JOIN st ON st.incident_id = 'i' || nw.user_id
 LEFT JOIN fs ON fs.incident_id = st.incident_id LEFT JOIN ts ON ts.incident_id = st.incident_id LEFT JOIN ov ON ov.incident_id = st.incident_id"""
ORACLES["span_tool_calls"] = f"WITH {TRACE} SELECT incident_id, agent, tool_name AS name, at_ms FROM tr WHERE tool_name IS NOT NULL"

# --- streams ---------------------------------------------------------------------------------------------------------------------

ORACLES["stream_write_stats"] = f"""WITH {windows('60 seconds')} SELECT event_type, strftime(window_start, {STAMP}) AS window_start, event_count, round(mean_bytes, 6) AS mean_bytes, max_bytes
 FROM ws"""
ORACLES["stream_refires"] = ORACLES["suppress_refires"]
ORACLES["stream_throttle"] = ORACLES["throttle_checks"]
ORACLES["stream_circuit"] = ORACLES["circuit_state"]
ORACLES["stream_dead_letters"] = """WITH d AS (SELECT event_id, CASE WHEN event_id % 101 != 0 THEN ts END AS ts, event_id % 103 = 0 AS bad,
  least(event_id * 6 // (SELECT count(*) FROM events) + CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END, 5) AS f FROM events),
 m AS (SELECT f, max(ts) FILTER (NOT bad) AS newest FROM d GROUP BY f),
 w AS (SELECT d.*, (SELECT max(newest) FROM m WHERE m.f < d.f) AS newest FROM d)
 SELECT event_id, CASE WHEN bad THEN 'JSONDecodeError' WHEN ts IS NULL THEN 'NullEventTime' ELSE 'LateEvent' END AS error_type, 0 AS retry_count
 FROM w WHERE bad OR ts IS NULL OR ts <= newest - INTERVAL 1 DAY"""
ORACLES["stream_changes"] = """SELECT event_id, CASE event_type WHEN 'click' THEN 'replace' WHEN 'error' THEN 'update' ELSE 'insert' END AS op, props AS doc
 FROM events WHERE event_type != 'view' AND event_id % 10 != 0"""
ORACLES["stream_rate_limit"] = ORACLES["rate_limit"]
ORACLES["stream_correlation"] = f"""WITH {WINDOWS} SELECT strftime(s, {STAMP}) AS window_start, collection_key, patient_zero, n_anomalies, severity
 FROM cw"""
ORACLES["stream_correlated_refires"] = ORACLES["correlated_refires"]
ORACLES["stream_velocity"] = ORACLES["shard_velocity"]
ORACLES["stream_anomalies"] = f"""WITH {anomalies_of("documents")} SELECT lang AS collection_name, document_id, round(z, 3) AS z_score, severity FROM found"""
ORACLES["stream_incidents"] = f"""WITH RECURSIVE {ESCALATED}, dcount AS (SELECT lang AS collection_name, count(*) AS dc FROM documents GROUP BY 1),
 ec AS (SELECT esc.*, dc, TIMESTAMP '2024-01-01' + to_seconds(CAST(document_id AS BIGINT) * 30) AS seen_at FROM esc LEFT JOIN dcount USING (collection_name)),
 {cost('ec')}, {chain('ec', 'collection_name', 'seen_at', 300)},
 ck AS (SELECT ec.document_id, c.t IS NOT NULL AS checked FROM ec LEFT JOIN RECURSIVE_CHAIN c ON c.collection_name = ec.collection_name AND c.t = ec.seen_at),
 sd AS ({ORACLES["schema_drift"]}), sv AS ({ORACLES["semantic_velocity"]}), rw AS ({ORACLES["runway_rate"]}),
 nm AS (SELECT * FROM (VALUES ('en', 'view', 0), ('fr', 'click', 1), ('de', 'purchase', 2), ('es', 'signup', 3)) AS x(lang, event_type, label))
 SELECT ct.collection_name, ct.document_id, CAST(ck.checked AS INT) AS checked, CASE WHEN ck.checked THEN sd.drift_detected END AS schema_drift,
  CASE WHEN ck.checked THEN sv.centroid_distance END AS semantic_velocity, CASE WHEN ck.checked THEN rw.status END AS runway_status,
  ct.anomaly_type, ct.severity, CASE WHEN ck.checked THEN sd.drift_detected ELSE false END AS drift_detected, ct.per_minute_usd
 FROM ct JOIN ck USING (document_id) JOIN nm ON nm.lang = ct.collection_name LEFT JOIN sd ON sd.event_type = nm.event_type
 LEFT JOIN sv ON sv.label = nm.label LEFT JOIN rw ON rw.event_type = nm.event_type"""
ORACLES["find_values"] = """SELECT event_id, event_type, value FROM events WHERE props IS NOT NULL AND event_type IS DISTINCT FROM 'view'
 ORDER BY events.value DESC NULLS LAST, event_id LIMIT 50"""
ORACLES["cached_card"] = ORACLES["health_card"]
ORACLES["plain_fields"] = """SELECT lpad(CAST(event_id AS VARCHAR), 24, '0') AS id, strftime(date_trunc('milliseconds', ts), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at
 FROM events"""
