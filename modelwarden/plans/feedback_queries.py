"""Feedback, retraining and data windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwarden.operators import feedback, gates
from modelwarden.plans.catalog import query
from modelwarden.plans.views import AGREEMENT_SQL, FEEDBACK_SQL, agreement_scores, corrections, flags, table, with_ctes

_SEGMENTS_SQL = """
seg AS (SELECT model_name, segment, count(*) AS n FROM corrections GROUP BY 1, 2),
tot AS (SELECT model_name, sum(n) AS t FROM seg GROUP BY 1),
pat AS (SELECT seg.*, CAST(n AS DOUBLE) / t AS pct FROM seg JOIN tot USING (model_name) WHERE n >= 5)"""


@query("error_segments", with_ctes(FEEDBACK_SQL, _SEGMENTS_SQL) + """
SELECT model_name, segment, n AS count, round(pct, 9) AS percentage FROM pat""")
def error_segments(spark, sf):
    out = feedback.error_patterns(corrections(spark, sf), ["model_name"])
    return out.withColumn("percentage", F.round("percentage", 9))


@query("top_error_patterns", with_ctes(FEEDBACK_SQL, _SEGMENTS_SQL, """
r AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY n DESC, segment) AS rn FROM pat)""") + """
SELECT model_name, count(*) AS n_patterns, string_agg(CASE WHEN rn <= 3 THEN segment END, ',' ORDER BY rn) AS top3 FROM r GROUP BY 1""")
def top_error_patterns(spark, sf):
    out = feedback.pattern_summary(feedback.error_patterns(corrections(spark, sf), ["model_name"]), ["model_name"])
    top = F.array_join(F.transform("top_patterns", lambda p: p["segment"]), ",")
    return out.select("model_name", F.col("pattern_count").alias("n_patterns"), top.alias("top3"))


@query("label_agreement", with_ctes(AGREEMENT_SQL) + """
SELECT model_name, round(avg(score), 9) AS avg_agreement, coalesce(avg(score) >= 0.7, true) AS agreement_ok FROM scores GROUP BY 1""")
def label_agreement(spark, sf):
    out = feedback.agreement(agreement_scores(spark, sf), ["model_name"])
    return out.withColumn("avg_agreement", F.round("avg_agreement", 9))


_TOTALS_SQL = """
fb AS (SELECT model_name, CAST(sum(c) AS BIGINT) AS corrections_count, CAST(sum(f) AS BIGINT) AS flags_count FROM
  (SELECT model_name, 1 AS c, 0 AS f FROM corrections UNION ALL SELECT model_name, 0, 1 FROM flags) GROUP BY 1)"""


@query("feedback_totals", with_ctes(FEEDBACK_SQL, _TOTALS_SQL) + """
SELECT model_name, corrections_count, flags_count, corrections_count + flags_count AS total_feedback,
  corrections_count + flags_count >= 250 AS enough_for_retrain FROM fb""")
def feedback_totals(spark, sf):
    return feedback.totals(corrections(spark, sf), flags(spark, sf), ["model_name"], 250)


@query("segment_errors", """
SELECT l_returnflag, p_brand AS segment, round(avg(CAST(l_discount > 0.08 AS DOUBLE)), 9) AS error_rate, count(*) AS count
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING avg(CAST(l_discount > 0.08 AS DOUBLE)) > 0.15""")
def segment_errors(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", (F.col("l_discount") > 0.08).alias("wrong"))
    p = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("segment"))
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    out = feedback.segment_errors(rows, ["l_returnflag"], "segment", "wrong", 0.15)
    return out.withColumn("error_rate", F.round("error_rate", 9))


def _feedback_subjects(spark, sf):
    nations = table(spark, sf, "customer").select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("model_name"),
        (F.col("c_acctbal") > 0).cast("double").alias("score"))
    agree = feedback.agreement(nations, ["model_name"]).select("model_name", "avg_agreement")
    return feedback.summary(corrections(spark, sf), flags(spark, sf), ["model_name"]).join(agree, "model_name", "left")


_GATE_SQL = with_ctes(FEEDBACK_SQL, _SEGMENTS_SQL, _TOTALS_SQL, """
ag AS (SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS model_name, avg(CAST(c_acctbal > 0 AS DOUBLE)) AS a FROM customer GROUP BY 1),
np AS (SELECT model_name, count(*) AS np FROM pat GROUP BY 1),
g AS (SELECT fb.*, corrections_count + flags_count AS total, a, coalesce(np, 0) AS np FROM fb LEFT JOIN ag USING (model_name) LEFT JOIN np USING (model_name))""")


@query("feedback_gate", _GATE_SQL + """
SELECT model_name, total AS total_feedback, round(a, 9) AS avg_agreement, a >= 0.9 AS agreement_ok, total >= 260 AS enough_for_retrain,
  a >= 0.9 AND total >= 260 AS approved, np AS n_patterns,
  'Feedback received: ' || CAST(corrections_count AS VARCHAR) || ' corrections, ' || CAST(flags_count AS VARCHAR) || ' flags' AS first_observation
FROM g""")
def feedback_gate(spark, sf):
    out = gates.feedback_gate(_feedback_subjects(spark, sf), 260, 0.9)
    return out.select(
        "model_name", "total_feedback", F.round("avg_agreement", 9).alias("avg_agreement"), "agreement_ok", "enough_for_retrain",
        "approved", F.coalesce("pattern_count", F.lit(0)).alias("n_patterns"),
        F.col("observations")[0].alias("first_observation"))


@query("feedback_observations", _GATE_SQL + """
, lines AS (SELECT model_name, string_agg('  Segment ' || chr(39) || segment || chr(39) || ': ' || CAST(n AS VARCHAR) || ' corrections (' || CAST(CAST(round_even(pct * 100, 0) AS BIGINT) AS VARCHAR) || '% of total)', '|' ORDER BY n DESC, segment) AS line
  FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY n DESC, segment) AS rn FROM pat) WHERE rn <= 3 GROUP BY 1)
SELECT model_name, concat_ws('|',
  'Feedback received: ' || CAST(corrections_count AS VARCHAR) || ' corrections, ' || CAST(flags_count AS VARCHAR) || ' flags',
  CASE WHEN a IS NULL THEN 'Label quality: no agreement scores provided (skipping check)'
    ELSE 'Label quality: avg agreement ' || CAST(CAST(round_even(a * 100, 0) AS BIGINT) AS VARCHAR) || '% (' || CASE WHEN a >= 0.9 THEN 'OK' ELSE 'LOW' END || ', threshold: 90%)' END,
  CASE WHEN corrections_count > 0 AND np > 0 THEN 'Error patterns: ' || CAST(np AS VARCHAR) || ' systematic failure segments|' || line
    WHEN corrections_count > 0 THEN 'Error patterns: no systematic failure segments detected' END,
  CASE WHEN total >= 260 THEN 'Sufficient feedback for retraining: ' || CAST(total AS VARCHAR) || ' samples (threshold: 260)'
    ELSE 'Insufficient feedback: ' || CAST(total AS VARCHAR) || ' samples (need 260)' END) AS observations
FROM g LEFT JOIN lines USING (model_name)""")
def feedback_observations(spark, sf):
    out = gates.feedback_gate(_feedback_subjects(spark, sf), 260, 0.9)
    return out.select("model_name", F.array_join("observations", "|").alias("observations"))


_RETRAIN_SQL = _GATE_SQL + """
, r AS (SELECT model_name, total, np, CAST(substr(model_name, 2) AS INTEGER) % 5 AS k FROM g),
s AS (SELECT model_name, np, k, CASE WHEN k = 4 THEN 0 ELSE total END AS fb, CASE WHEN k = 1 THEN 4 WHEN k = 2 THEN 1 ELSE 0 END AS drifted,
  CASE WHEN k IN (3, 4) THEN 0.0 ELSE 0.02 END AS drop, CASE WHEN k = 3 THEN 0 ELSE np END AS pats FROM r),
w AS (SELECT *, drifted >= 1 OR fb >= 260 OR drop > 0 OR pats > 0 AS go FROM s)"""


def _retrain_decisions(spark, sf):
    k = F.substr("model_name", F.lit(2)).cast("int") % 5
    subjects = feedback.summary(corrections(spark, sf), flags(spark, sf), ["model_name"])
    names = F.array(*[F.lit(f"f{i}") for i in range(4)])
    rows = subjects.select(
        "model_name", F.lit("monitor").alias("trigger_source"), F.lit(10).alias("total_features"),
        F.slice(names, F.lit(1), F.when(k == 1, 4).when(k == 2, 1).otherwise(0)).alias("drifted_features"),
        F.when(k == 4, F.lit(0)).otherwise(F.col("total_feedback")).alias("feedback_count"),
        F.when(k.isin(3, 4), 0.0).otherwise(0.02).alias("accuracy_drop"),
        F.when(k != 3, F.col("pattern_count")).alias("pattern_count"))
    return gates.retrain_gate(rows, min_feedback_samples=260)


@query("retrain_strategy", _RETRAIN_SQL + """
SELECT model_name, go AS approved,
  CASE WHEN NOT go THEN 'skip' WHEN drifted / 10.0 > 0.3 THEN 'full_retrain' WHEN fb > 0 THEN 'fine_tune' ELSE 'full_retrain' END AS strategy,
  CASE WHEN NOT go THEN 'none' WHEN drifted / 10.0 > 0.3 THEN 'all' WHEN fb > 0 THEN 'recent_30d_plus_feedback' ELSE 'recent_90d' END AS data_window,
  concat_ws('; ', CASE WHEN drifted > 0 THEN CAST(drifted AS VARCHAR) || ' features drifted' END, CASE WHEN fb >= 260 THEN CAST(fb AS VARCHAR) || ' feedback samples' END,
    CASE WHEN drop > 0 THEN 'accuracy dropped 0.0200' END, CASE WHEN pats > 0 THEN CAST(pats AS VARCHAR) || ' error patterns' END) AS reasons
FROM w""")
def retrain_strategy(spark, sf):
    out = _retrain_decisions(spark, sf)
    return out.select("model_name", "approved", "strategy", "data_window", F.array_join("retrain_reasons", "; ").alias("reasons"))


@query("retrain_observations", _RETRAIN_SQL + """
SELECT model_name, concat_ws('|', 'Retrain trigger: monitor for model ' || chr(39) || model_name || chr(39),
  CASE WHEN drifted > 0 THEN 'Drift: ' || CAST(drifted AS VARCHAR) || '/10 features drifted (' || CAST(drifted * 10 AS VARCHAR) || '%)' END,
  CASE WHEN fb > 0 THEN 'Feedback: ' || CAST(fb AS VARCHAR) || ' new labeled samples' END,
  CASE WHEN drop > 0 THEN 'Performance: accuracy dropped by 0.0200' END,
  CASE WHEN pats > 0 THEN 'Error patterns: ' || CAST(pats AS VARCHAR) || ' systematic failure patterns' END,
  CASE WHEN NOT go THEN 'Insufficient signal for retraining' END,
  CASE WHEN go AND drifted / 10.0 > 0.3 THEN 'Strategy: FULL RETRAIN (drift ratio ' || CAST(drifted * 10 AS VARCHAR) || '% > 30% threshold)'
    WHEN go AND fb > 0 THEN 'Strategy: FINE-TUNE on recent 30 days + ' || CAST(fb AS VARCHAR) || ' feedback samples'
    WHEN go THEN 'Strategy: FULL RETRAIN on recent 90 days' END) AS observations FROM w""")
def retrain_observations(spark, sf):
    return _retrain_decisions(spark, sf).select("model_name", F.array_join("observations", "|").alias("observations"))


@query("feedback_summary", with_ctes(FEEDBACK_SQL, _SEGMENTS_SQL, _TOTALS_SQL, """
r AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY n DESC, segment) AS rn FROM pat),
top AS (SELECT model_name, count(*) AS n_patterns, string_agg(segment || ':' || CAST(n AS VARCHAR) || ':' || CAST(CAST(round(pct * 1000000) AS BIGINT) AS VARCHAR), ','
        ORDER BY rn) FILTER (WHERE rn <= 3) AS top3 FROM r GROUP BY 1)""") + """
SELECT model_name, corrections_count, flags_count, corrections_count + flags_count >= 260 AS enough_for_retrain,
  coalesce(n_patterns, 0) AS n_patterns, coalesce(top3, '') AS top3 FROM fb LEFT JOIN top USING (model_name)""")
def feedback_summary(spark, sf):
    out = feedback.summary(corrections(spark, sf), flags(spark, sf), ["model_name"], 260)
    line = F.transform("top_patterns", lambda p: F.concat_ws(":", p["segment"], p["count"], F.round(p["percentage"] * 1000000).cast("bigint")))
    return out.select("model_name", "corrections_count", "flags_count", "enough_for_retrain", F.col("pattern_count").alias("n_patterns"),
                      F.array_join(line, ",").alias("top3"))


_WINDOW_SQL = """
w AS (SELECT o_custkey % 25 AS model, max(o_orderdate) AS newest FROM orders GROUP BY 1),
lab AS (SELECT *, CASE model % 4 WHEN 0 THEN 'all' WHEN 1 THEN 'recent_90d' WHEN 2 THEN 'recent_30d_plus_feedback' ELSE 'none' END AS data_window FROM w),
kept AS (SELECT o.*, lab.model, lab.data_window FROM orders o JOIN lab ON o.o_custkey % 25 = lab.model WHERE data_window = 'all'
  OR (data_window = 'recent_90d' AND o_orderdate >= newest - INTERVAL 90 DAYS) OR (data_window = 'recent_30d_plus_feedback' AND o_orderdate >= newest - INTERVAL 30 DAYS))"""


def _windowed(spark, sf):
    o = table(spark, sf, "orders").withColumn("model", F.col("o_custkey") % 25)
    labels = F.when(F.col("model") % 4 == 0, "all").when(F.col("model") % 4 == 1, "recent_90d").when(
        F.col("model") % 4 == 2, "recent_30d_plus_feedback").otherwise("none")
    windows = o.select("model").distinct().withColumn("data_window", labels)
    return o.join(windows, "model"), gates.select_window(o, windows, "model", "o_orderdate")


@query("training_window", with_ctes(_WINDOW_SQL) + """
SELECT model, data_window, count(*) AS num_rows, min(o_orderdate) AS first_day, round(sum(o_totalprice), 2) AS total FROM kept GROUP BY 1, 2""")
def training_window(spark, sf):
    _, kept = _windowed(spark, sf)
    return kept.groupBy("model", "data_window").agg(
        F.count(F.lit(1)).alias("num_rows"), F.min("o_orderdate").alias("first_day"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("training_rows", with_ctes(_WINDOW_SQL, """
fb AS (SELECT o_orderkey FROM orders JOIN lab ON o_custkey % 25 = lab.model WHERE o_orderstatus = 'P' AND data_window = 'recent_30d_plus_feedback'),
allr AS (SELECT o_orderkey, false AS from_feedback FROM kept WHERE o_orderkey NOT IN (SELECT o_orderkey FROM fb) UNION ALL SELECT o_orderkey, true FROM fb)""") + """
SELECT o_orderkey, from_feedback FROM allr""")
def training_rows(spark, sf):
    o, kept = _windowed(spark, sf)
    fb = o.where("o_orderstatus = 'P' AND data_window = 'recent_30d_plus_feedback'").select("o_orderkey", "o_totalprice")
    out = gates.training_rows(kept.select("o_orderkey", "o_totalprice"), fb, ["o_orderkey"])
    return out.select("o_orderkey", "from_feedback")
