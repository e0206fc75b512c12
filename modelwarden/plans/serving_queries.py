"""Endpoint metrics, canaries, traffic, health."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from modelwarden.operators import evaluation, gates, quality, serving
from modelwarden.plans.catalog import query
from modelwarden.plans.views import MODELS_SQL, REQUESTS_SQL, models, requests, table, with_ctes
from modelwarden.sources.stores import request_window

_METRICS_SQL = """
  count(*) AS request_count, count(*) FILTER (WHERE response_code LIKE '5%') AS error_count,
  round(CAST(count(*) FILTER (WHERE response_code LIKE '5%') AS DOUBLE) / greatest(count(*), 1), 9) AS error_rate,
  quantile_disc(latency_ms, 0.5) AS latency_p50_ms, quantile_disc(latency_ms, 0.95) AS latency_p95_ms,
  quantile_disc(latency_ms, 0.99) AS latency_p99_ms"""


def _rounded(df):
    return df.withColumn("error_rate", F.round("error_rate", 9))


@query("endpoint_metrics_daily", with_ctes(REQUESTS_SQL) + f"""
SELECT endpoint_id, date_trunc('day', ts) AS day, {_METRICS_SQL} FROM requests GROUP BY 1, 2""")
def endpoint_metrics_daily(spark, sf):
    r = requests(spark, sf).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return _rounded(serving.endpoint_metrics(r, ["endpoint_id", "day"]))


@query("endpoint_metrics_15m", with_ctes(REQUESTS_SQL) + f"""
SELECT endpoint_id, time_bucket(INTERVAL 15 MINUTES, ts) AS window_start, time_bucket(INTERVAL 15 MINUTES, ts) + INTERVAL 15 MINUTES AS window_end,
  {_METRICS_SQL} FROM requests GROUP BY 1, 2, 3""")
def endpoint_metrics_15m(spark, sf):
    return _rounded(serving.windowed_metrics(requests(spark, sf), ["endpoint_id"]))


@query("endpoint_metrics_sliding", with_ctes(REQUESTS_SQL, """
slid AS (SELECT r.*, time_bucket(INTERVAL 15 MINUTES, ts) - o.k * INTERVAL 15 MINUTES AS window_start
         FROM requests r CROSS JOIN (SELECT unnest(range(0, 4)) AS k) o)""") + f"""
SELECT endpoint_id, window_start, window_start + INTERVAL 1 HOUR AS window_end, {_METRICS_SQL} FROM slid GROUP BY 1, 2""")
def endpoint_metrics_sliding(spark, sf):
    return _rounded(serving.windowed_metrics(requests(spark, sf), ["endpoint_id"], "1 hour", "15 minutes"))


@query("user_sessions", """
WITH lagged AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
numbered AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 12 HOURS THEN 1 ELSE 0 END)
             OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM lagged)
SELECT user_id, CAST(s AS BIGINT) AS session_no, min(ts) AS session_start, max(ts) + INTERVAL 12 HOURS AS session_end, count(*) AS n_events
FROM numbered GROUP BY 1, 2""")
def user_sessions(spark, sf):
    return serving.sessions(table(spark, sf, "events"), ["user_id"], "ts", "event_id", 12 * 3600)


@query("trailing_window", with_ctes(REQUESTS_SQL) + f"""
SELECT endpoint_id, {_METRICS_SQL} FROM requests
WHERE endpoint_id = 'e1' AND ts >= (SELECT max(ts) FROM requests WHERE endpoint_id = 'e1') - INTERVAL 10080 MINUTES GROUP BY 1""")
def trailing_window(spark, sf):
    return _rounded(serving.endpoint_metrics(request_window(requests(spark, sf), "e1", 7 * 24 * 60), ["endpoint_id"]))


@query("class_distribution", with_ctes(REQUESTS_SQL, """
n AS (SELECT endpoint_id, predicted_class, count(*) AS n FROM requests GROUP BY 1, 2)""") + """
SELECT endpoint_id, string_agg(predicted_class || '=' || CAST(n AS VARCHAR), ',' ORDER BY predicted_class) AS predictions FROM n GROUP BY 1""")
def class_distribution(spark, sf):
    d = evaluation.class_distribution(requests(spark, sf), ["endpoint_id"])
    text = F.transform(F.map_entries("predictions"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return d.select("endpoint_id", F.array_join(text, ",").alias("predictions"))


_BY_VERSION_SQL = with_ctes(REQUESTS_SQL, f"""
m AS (SELECT endpoint_id, model_version, {_METRICS_SQL} FROM requests GROUP BY 1, 2)""")


def _by_version(spark, sf):
    return serving.endpoint_metrics(requests(spark, sf), ["endpoint_id", "model_version"])


@query("canary_gate", _BY_VERSION_SQL + """
SELECT endpoint_id, model_version, request_count, round(error_rate, 9) AS error_rate, latency_p99_ms,
  error_rate <= 0.2 AND latency_p99_ms <= 230 AS approved,
  CASE WHEN error_rate <= 0.2 AND latency_p99_ms <= 230 THEN 'model.deploy.promote' ELSE 'model.deploy.rollback' END AS action
FROM m""")
def canary_gate(spark, sf):
    out = gates.canary_gate(_by_version(spark, sf), max_error_rate=0.2, max_latency_p99_ms=230.0)
    return _rounded(out.select("endpoint_id", "model_version", "request_count", "error_rate", "latency_p99_ms", "approved", "action"))


@query("canary_vs_baseline", _BY_VERSION_SQL + """
SELECT b.endpoint_id, round(b.error_rate, 9) AS baseline_error_rate, round(c.error_rate, 9) AS canary_error_rate,
  c.error_rate <= 1.0 * b.error_rate AS within_baseline
FROM m b JOIN m c ON b.endpoint_id = c.endpoint_id AND b.model_version = 'v0' AND c.model_version = 'v1'""")
def canary_vs_baseline(spark, sf):
    out = gates.canary_vs_baseline(_by_version(spark, sf), "endpoint_id", "model_version", "v0", "v1", multiplier=1.0)
    return out.withColumn("baseline_error_rate", F.round("baseline_error_rate", 9)).withColumn(
        "canary_error_rate", F.round("canary_error_rate", 9))


@query("traffic_assignment", """
SELECT CASE WHEN event_id % 100 < 5 THEN 'canary' WHEN event_id % 100 < 30 THEN 'shadow' ELSE 'stable' END AS version,
  count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1""")
def traffic_assignment(spark, sf):
    e = table(spark, sf, "events")
    out = serving.assign_traffic(e, F.col("event_id") % 100, {"canary": 5, "shadow": 25, "stable": 70})
    return out.groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("canary_start_rows", with_ctes(MODELS_SQL) + """
SELECT model_name || '-canary' AS endpoint_name, model_name, version AS model_version, 'creating' AS status, 5 AS canary_traffic_pct FROM models""")
def canary_start_rows(spark, sf):
    return serving.canary_rows(models(spark, sf)).drop("traffic_split")


_STARTS_SQL = """
starts AS (SELECT model_name, version AS model_version, CASE WHEN hash3 = 0 THEN NULL ELSE model_name || '-canary' END AS endpoint_id,
  CASE WHEN hash3 = 1 THEN 'no capacity' END AS error FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY version) % 3 AS hash3 FROM models))"""


@query("canary_start", with_ctes(MODELS_SQL, _STARTS_SQL) + """
SELECT model_name, model_version, 'model.deploy.canary' AS action, error IS NULL AS approved, error IS NOT NULL AS escalate_to_human,
  CASE WHEN error IS NOT NULL THEN 'Canary deployment failed: ' || error END AS escalation_reason,
  CASE WHEN error IS NOT NULL THEN '{}' ELSE '{"canary_traffic_pct":5}' END AS metadata,
  CASE WHEN error IS NULL THEN coalesce(endpoint_id, '') || '|' || model_name || '|' || model_version END AS artifacts,
  'Deploying ' || model_name || '/' || model_version || ' as canary (5% traffic);' ||
  CASE WHEN error IS NOT NULL THEN 'Canary deployment failed: ' || error
       WHEN endpoint_id IS NOT NULL THEN 'Canary endpoint created: ' || endpoint_id || ' (status: creating)'
       ELSE 'No serving backend: nothing was deployed' END AS observations FROM starts""")
def canary_start(spark, sf):
    """Every third version of a model finds no backend, every third fails to deploy."""
    w = Window.partitionBy("model_name").orderBy("version")
    m = models(spark, sf).select("model_name", "version", (F.row_number().over(w) % 3).alias("k"))
    starts = m.select("model_name", F.col("version").alias("model_version"), F.lit("creating").alias("endpoint_status"),
                      F.when(F.col("k") != 0, F.concat("model_name", F.lit("-canary"))).alias("endpoint_id"),
                      F.when(F.col("k") == 1, "no capacity").alias("error"))
    out = gates.canary_start(starts)
    parts = [F.col("artifacts")[k] for k in ("endpoint_id", "model_name", "model_version")]
    return out.select(
        "model_name", "model_version", "action", "approved", "escalate_to_human", "escalation_reason", "metadata",
        F.when(F.size("artifacts") > 0, F.concat_ws("|", *parts)).alias("artifacts"), F.array_join("observations", ";").alias("observations"))


@query("rollback", """
SELECT 'ep-' || CAST(s_suppkey AS VARCHAR) AS endpoint_id, 'model.rollback' AS action, TRUE AS approved, 'ep-' || CAST(s_suppkey AS VARCHAR) AS artifact,
  'Rolling back endpoint: ep-' || CAST(s_suppkey AS VARCHAR) || CASE WHEN s_acctbal < 0 THEN ';Rollback failed: gone' WHEN s_nationkey % 2 = 0 THEN ';Canary endpoint removed' ELSE '' END AS observations
FROM supplier""")
def rollback(spark, sf):
    s = table(spark, sf, "supplier").select(
        F.concat(F.lit("ep-"), F.col("s_suppkey").cast("string")).alias("endpoint_id"),
        F.when(F.col("s_nationkey") % 2 == 0, True).alias("removed"), F.when(F.col("s_acctbal") < 0, "gone").alias("error"))
    return gates.rollback(s).select("endpoint_id", "action", "approved", F.col("artifacts")["endpoint_id"].alias("artifact"),
                                    F.array_join("observations", ";").alias("observations"))


@query("measured_over_payload", with_ctes(REQUESTS_SQL, f"""
m AS (SELECT endpoint_id, {_METRICS_SQL} FROM requests GROUP BY 1),
p AS (SELECT 'e' || CAST(s_nationkey AS VARCHAR) AS endpoint_id, nullif(avg(CAST(s_acctbal < 0 AS DOUBLE)), 0.0) AS error_rate, max(s_acctbal) AS latency_p99_ms FROM supplier GROUP BY 1)""") + """
SELECT p.endpoint_id, round(coalesce(m.error_rate, p.error_rate, 0), 9) AS error_rate, coalesce(m.latency_p99_ms, p.latency_p99_ms, 0) AS latency_p99_ms
FROM p LEFT JOIN m USING (endpoint_id)""")
def measured_over_payload(spark, sf):
    """Suppliers' nations give the payload; only some of these endpoints have measured requests."""
    payload = table(spark, sf, "supplier").groupBy(F.concat(F.lit("e"), F.col("s_nationkey").cast("string")).alias("endpoint_id")).agg(
        F.nullif(F.avg((F.col("s_acctbal") < 0).cast("double")), F.lit(0.0)).alias("error_rate"), F.max("s_acctbal").alias("latency_p99_ms"))
    measured = serving.endpoint_metrics(requests(spark, sf), ["endpoint_id"])
    return _rounded(serving.prefer_measured(payload, measured, "endpoint_id", ["error_rate", "latency_p99_ms"]))


BASE_END = "2024-01-08"
_HEALTH_SQL = with_ctes(REQUESTS_SQL, f"""
obs AS (SELECT *, ts < TIMESTAMP '{BASE_END}' AS is_base FROM requests),
edges AS (SELECT endpoint_id, unnest(quantile_disc(latency_ms, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS e FROM obs WHERE is_base GROUP BY 1),
vals AS (SELECT endpoint_id, latency_ms, count(*) FILTER (WHERE is_base) AS nb, count(*) FILTER (WHERE NOT is_base) AS nc FROM obs GROUP BY 1, 2),
binned AS (SELECT v.endpoint_id, v.latency_ms, any_value(v.nb) AS nb, any_value(v.nc) AS nc, count(e.e) FILTER (WHERE e.e < v.latency_ms) AS bin
           FROM vals v JOIN edges e USING (endpoint_id) GROUP BY 1, 2),
bins AS (SELECT endpoint_id, bin, sum(nb) AS nb, sum(nc) AS nc FROM binned GROUP BY 1, 2),
tot AS (SELECT endpoint_id, sum(nb) AS tb, sum(nc) AS tc FROM bins GROUP BY 1),
sh AS (SELECT endpoint_id, greatest(CAST(nc AS DOUBLE) / tc, 1e-6) AS a, greatest(CAST(nb AS DOUBLE) / tb, 1e-6) AS e FROM bins JOIN tot USING (endpoint_id)),
psi AS (SELECT endpoint_id, sum((a - e) * ln(a / e)) AS psi FROM sh GROUP BY 1),
live AS (SELECT endpoint_id, CAST(count(*) FILTER (WHERE response_code LIKE '5%') AS DOUBLE) / greatest(count(*), 1) AS error_rate,
           quantile_disc(latency_ms, 0.99) AS p99 FROM obs WHERE NOT is_base GROUP BY 1),
acc AS (SELECT endpoint_id, avg(CAST((latency_ms > 35) = (event_id % 3 > 0) AS DOUBLE)) FILTER (WHERE is_base) AS base,
          avg(CAST((latency_ms > 35) = (event_id % 3 > 0) AS DOUBLE)) FILTER (WHERE NOT is_base) AS cur FROM obs GROUP BY 1),
g AS (SELECT *, psi > 0.02 AS drift, base - cur > 0.05 OR error_rate > 0.2 AS degraded FROM psi JOIN live USING (endpoint_id) JOIN acc USING (endpoint_id))""")


def endpoint_health_rows(spark, sf):
    """Health of every endpoint: live metrics, drift of latency against the first week, accuracy by period."""
    r = requests(spark, sf).withColumn("is_base", F.col("ts") < F.lit(BASE_END).cast("timestamp_ntz"))
    obs = r.select("endpoint_id", F.lit("latency_ms").alias("feature"), F.col("latency_ms").alias("value"), "is_base")
    drift = quality.drift_maps(quality.drift_profile(obs, ["endpoint_id"]), ["endpoint_id"])
    live = serving.endpoint_metrics(r.where("NOT is_base"), ["endpoint_id"])
    scored = r.withColumn("label", F.col("event_id") % 3 > 0).withColumn("pred", F.col("latency_ms") > 35)
    acc = evaluation.accuracy_drop(scored, ["endpoint_id"], F.col("is_base")).drop("accuracy_drop")
    return live.join(drift, "endpoint_id", "left").join(acc, "endpoint_id", "left")


@query("endpoint_health", _HEALTH_SQL + """
SELECT endpoint_id, round(psi, 6) AS psi, round(error_rate, 9) AS error_rate, p99 AS latency_p99_ms, round(base - cur, 9) AS accuracy_drop,
  CASE WHEN degraded THEN 'critical' WHEN drift THEN 'warning' ELSE 'info' END AS severity, drift AND degraded AS needs_retrain,
  CASE WHEN drift OR degraded THEN 'drift.detect' ELSE 'metrics.collect' END AS action, NOT drift AND NOT degraded AS approved,
  false AS escalate_to_human
FROM g""")
def endpoint_health(spark, sf):
    gated = gates.health_gate(endpoint_health_rows(spark, sf), psi_threshold=0.02, error_rate_threshold=0.2)
    decided = gates.with_reasoning(gated, "monitoring").withColumn("escalate_to_human", F.lit(False)).withColumn(
        "escalation_reason", F.lit(None).cast("string"))
    out = gates.escalate(decided, {"monitoring": 0.8})
    return out.select(
        "endpoint_id", F.round(F.element_at("psi_scores", "latency_ms"), 6).alias("psi"),
        F.round("error_rate", 9).alias("error_rate"), "latency_p99_ms", F.round("accuracy_drop", 9).alias("accuracy_drop"),
        "severity", "needs_retrain", "action", "approved", "escalate_to_human")


@query("latency_drift_by_endpoint", _HEALTH_SQL + """
SELECT endpoint_id, 'latency_ms' AS feature, round(psi, 6) AS psi FROM psi""")
def latency_drift_by_endpoint(spark, sf):
    r = requests(spark, sf)
    obs = r.select("endpoint_id", F.lit("latency_ms").alias("feature"), F.col("latency_ms").alias("value"),
                   (F.col("ts") < F.lit(BASE_END).cast("timestamp_ntz")).alias("is_base"))
    return quality.drift_profile(obs, ["endpoint_id"]).select("endpoint_id", "feature", F.round("psi", 6).alias("psi"))
