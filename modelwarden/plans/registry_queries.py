"""Registry, experiment runs, model gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwarden.functions.maps import first_key, has_any_key
from modelwarden.operators import evaluation, gates, registry
from modelwarden.operators.ordered import latest_by
from modelwarden.plans.catalog import query
from modelwarden.plans.views import MODELS_SQL, PROMOTIONS_SQL, RUNS_SQL, models, promotions, runs, table, with_ctes
from modelwarden.session import work_dir
from modelwarden.sources import stores

_CHAMPION_SQL = """
champ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY (stage = 'production') DESC, version_n DESC) AS rn FROM models) WHERE rn = 1)"""


@query("champion", with_ctes(MODELS_SQL, _CHAMPION_SQL) + "SELECT model_name, version, stage, artifact_uri FROM champ")
def champion(spark, sf):
    return registry.champion(models(spark, sf)).select("model_name", "version", "stage", "artifact_uri")


@query("model_versions", """
WITH e AS (SELECT p_brand AS model_name, count(*) AS top FROM part WHERE p_size <= 20 GROUP BY 1),
n AS (SELECT p_brand AS model_name, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS rn FROM part WHERE p_size > 20)
SELECT n.model_name, p_partkey, CAST(coalesce(top, 0) + rn AS INTEGER) AS version_n, 'v' || CAST(coalesce(top, 0) + rn AS VARCHAR) AS version, 'none' AS stage
FROM n LEFT JOIN e USING (model_name)""")
def model_versions(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("model_name"), "p_partkey", "p_retailprice", "p_size")
    old = p.where("p_size <= 20").groupBy("model_name").agg(F.count(F.lit(1)).cast("int").alias("version_n"))
    new = p.where("p_size > 20").drop("p_size")
    return registry.assign_versions(new, old, ["p_retailprice", "p_partkey"]).drop("p_retailprice")


@query("promotion_history", with_ctes(PROMOTIONS_SQL, """
o AS (SELECT *, lead(ts) OVER (PARTITION BY model_name, version ORDER BY ts) AS own FROM promotions),
p AS (SELECT *, lead(ts) OVER (PARTITION BY model_name ORDER BY ts, version) AS oth FROM o WHERE stage = 'production')""") + """
SELECT model_name, version, ts AS valid_from, CASE WHEN own IS NULL THEN oth WHEN oth IS NULL THEN own ELSE least(own, oth) END AS valid_to,
  CASE WHEN own IS NULL AND oth IS NULL THEN 'production' ELSE 'archived' END AS stage_now FROM p""")
def promotion_history(spark, sf):
    return registry.promotion_periods(promotions(spark, sf))


_PERIODS_SQL = """
o AS (SELECT *, lead(ts) OVER (PARTITION BY model_name, version ORDER BY ts) AS own FROM promotions),
p AS (SELECT *, lead(ts) OVER (PARTITION BY model_name ORDER BY ts, version) AS oth FROM o WHERE stage = 'production'),
per AS (SELECT model_name, version, ts AS valid_from, CASE WHEN own IS NULL THEN oth WHEN oth IS NULL THEN own ELSE least(own, oth) END AS valid_to FROM p),
cand AS (SELECT 'm' || CAST(l_suppkey % 40 AS VARCHAR) AS model_name, l_shipdate + to_seconds(l_orderkey % 86400) AS evaluated_at,
           l_orderkey * 8 + l_linenumber AS row_id FROM lineitem)"""


def _candidates(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("m"), (F.col("l_suppkey") % 40).cast("string")).alias("model_name"),
        (F.col("l_shipdate") + F.make_dt_interval(secs=F.col("l_orderkey") % 86400)).alias("evaluated_at"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"))


@query("champion_asof", with_ctes(PROMOTIONS_SQL, _PERIODS_SQL) + """
SELECT c.model_name, c.evaluated_at, c.row_id, CASE WHEN per.valid_to IS NULL OR c.evaluated_at < per.valid_to THEN per.version END AS champion_version,
  CASE WHEN per.valid_to IS NULL OR c.evaluated_at < per.valid_to THEN per.valid_from END AS champion_since
FROM cand c ASOF LEFT JOIN per ON c.model_name = per.model_name AND c.evaluated_at >= per.valid_from""")
def champion_asof(spark, sf):
    return registry.champion_asof(_candidates(spark, sf), registry.promotion_periods(promotions(spark, sf)))


@query("registry_stages", with_ctes(PROMOTIONS_SQL, """
m AS (SELECT DISTINCT model_name, version FROM promotions),
l AS (SELECT model_name, version, arg_max(stage, ts) AS s FROM promotions GROUP BY 1, 2),
f AS (SELECT model_name, arg_max(version, (ts, version)) AS v FROM promotions WHERE stage = 'production' GROUP BY 1)""") + """
SELECT m.model_name, m.version, CASE WHEN l.s = 'production' AND m.version <> f.v THEN 'archived' ELSE l.s END AS stage
FROM m JOIN l USING (model_name, version) LEFT JOIN f USING (model_name)""")
def registry_stages(spark, sf):
    p = promotions(spark, sf)
    m = p.select("model_name", "version").distinct().withColumn("stage", F.lit("none"))
    return registry.apply_promotions(m, p)


@query("expired_versions", with_ctes(MODELS_SQL, """
r AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY version_n DESC) AS rn, created_at < TIMESTAMP '2024-07-01' - INTERVAL 90 DAYS AS old FROM models)""") + """
SELECT model_name, version, CASE WHEN old AND rn > 3 THEN 'age,count' WHEN old THEN 'age' ELSE 'count' END AS reason FROM r WHERE old OR rn > 3""")
def expired_versions(spark, sf):
    out = registry.expired_versions(models(spark, sf), F.lit("2024-07-01").cast("timestamp_ntz"))
    return out.select("model_name", "version", "reason")


@query("expired_dev_tables", with_ctes(MODELS_SQL) + """
SELECT artifact_uri FROM models WHERE created_at < TIMESTAMP '2024-07-01' - INTERVAL 30 DAYS""")
def expired_dev_tables(spark, sf):
    return registry.expired_tables(models(spark, sf), F.lit("2024-07-01").cast("timestamp_ntz")).select("artifact_uri")


@query("model_gate", with_ctes(MODELS_SQL, _CHAMPION_SQL, """
cand AS (SELECT CASE WHEN s_suppkey % 9 = 0 THEN 'new' || CAST(s_suppkey AS VARCHAR) ELSE 'Brand#' || CAST(s_suppkey % 25 + 1 AS VARCHAR) END AS model_name,
  s_suppkey, CASE WHEN s_suppkey % 18 = 0 THEN 0.0 ELSE 0.4 + CAST(s_suppkey % 32 AS DOUBLE) / 128 END AS f1,
  CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 16 AS DOUBLE) / 128 END AS fairness, CAST(s_suppkey % 40 AS DOUBLE) * 4 AS p99 FROM supplier),
j AS (SELECT cand.*, champ.version AS cv, champ.f1 AS cf FROM cand LEFT JOIN champ USING (model_name))""") + """
SELECT model_name, s_suppkey, cv AS champion_version, cv IS NULL AS is_first_model, round(CASE WHEN cv IS NULL THEN 0.0 ELSE f1 - cf END, 9) AS improvement,
  CASE WHEN cv IS NULL THEN f1 > 0 ELSE f1 - cf >= 0.005 AND (fairness IS NULL OR fairness <= 0.05) AND (p99 <= 100 OR p99 = 0) END AS approved,
  CASE WHEN cv IS NULL AND f1 > 0 THEN 'model.register' ELSE 'model.evaluate' END AS action FROM j""")
def model_gate(spark, sf):
    s = F.col("s_suppkey")
    name = F.when(s % 9 == 0, F.concat(F.lit("new"), s.cast("string"))).otherwise(
        F.concat(F.lit("Brand#"), (s % 25 + 1).cast("string")))
    base = F.create_map(F.lit("f1_score"), F.when(s % 18 == 0, 0.0).otherwise(0.4 + (s % 32) / 128),
                        F.lit("latency_p99_ms"), (s % 40) * F.lit(4.0))
    fair = F.when(s % 5 != 0, F.create_map(F.lit("demographic_parity_diff"), (s % 16) / 128)).otherwise(
        F.create_map().cast("map<string,double>"))
    cand = table(spark, sf, "supplier").select(name.alias("model_name"), "s_suppkey", F.map_concat(base, fair).alias("metrics"))
    out = gates.model_gate(cand, registry.champion(models(spark, sf)))
    return out.select("model_name", "s_suppkey", "champion_version", "is_first_model", F.round("improvement", 9).alias("improvement"),
                      "approved", "action")


def _requested(spark, sf):
    return runs(spark, sf).select(
        F.col("o_custkey").alias("comparison_id"), "run_id", F.col("o_orderkey").alias("pos"))


@query("best_run", with_ctes(RUNS_SQL, """
rk AS (SELECT metric, CASE metric WHEN 'f1' THEN 1 WHEN 'auc' THEN 4 WHEN 'accuracy' THEN 5 ELSE 99 END AS k FROM (SELECT DISTINCT metric FROM run_metrics)),
pm AS (SELECT o_custkey, arg_min(metric, (k, metric)) AS primary_metric FROM run_metrics JOIN rk USING (metric) GROUP BY 1),
v AS (SELECT r.o_custkey, r.run_id, r.o_orderkey, pm.primary_metric, coalesce(m.value, 0.0) AS value FROM runs r JOIN pm USING (o_custkey)
      LEFT JOIN run_metrics m ON m.run_id = r.run_id AND m.metric = pm.primary_metric)""") + """
SELECT o_custkey AS comparison_id, any_value(primary_metric) AS primary_metric, count(*) AS runs_compared, arg_max(run_id, (value, -o_orderkey)) AS best_run_id,
  round(max(value), 9) AS best_value FROM v GROUP BY 1""")
def best_run(spark, sf):
    out = evaluation.best_run(runs(spark, sf), _requested(spark, sf))
    return out.withColumn("best_value", F.round("best_value", 9))


@query("run_comparison", with_ctes(RUNS_SQL, """
k AS (SELECT DISTINCT o_custkey, metric FROM run_metrics)""") + """
SELECT r.o_custkey AS comparison_id, k.metric, r.run_id, round(coalesce(m.value, 0.0), 9) AS value
FROM runs r JOIN k USING (o_custkey) LEFT JOIN run_metrics m ON m.run_id = r.run_id AND m.metric = k.metric""")
def run_comparison(spark, sf):
    out = evaluation.comparison_long(runs(spark, sf), _requested(spark, sf))
    return out.withColumn("value", F.round("value", 9))


@query("compare_runs", with_ctes(RUNS_SQL) + """
SELECT metric, round(coalesce(max(CASE WHEN run_id = 'r000000000003' THEN value END), 0.0), 9) AS r000000000003,
  round(coalesce(max(CASE WHEN run_id = 'r000000000004' THEN value END), 0.0), 9) AS r000000000004,
  round(coalesce(max(CASE WHEN run_id = 'r000000000005' THEN value END), 0.0), 9) AS r000000000005
FROM run_metrics WHERE run_id IN ('r000000000003', 'r000000000004', 'r000000000005') GROUP BY 1""")
def compare_runs(spark, sf):
    ids = ["r000000000003", "r000000000004", "r000000000005"]
    out = evaluation.compare_runs(runs(spark, sf), ids)
    return out.select("metric", *[F.round(i, 9).alias(i) for i in ids])


@query("metric_keys", with_ctes(RUNS_SQL) + "SELECT DISTINCT metric FROM run_metrics")
def metric_keys(spark, sf):
    return evaluation.metric_keys(runs(spark, sf))


@query("list_runs", with_ctes(RUNS_SQL) + """
SELECT run_id, experiment_name, o_orderstatus AS status FROM runs WHERE experiment_name = '2-HIGH' ORDER BY run_id DESC LIMIT 20""")
def list_runs(spark, sf):
    return evaluation.list_runs(runs(spark, sf), "2-HIGH").select("run_id", "experiment_name", F.col("tags")["status"].alias("status"))


@query("find_run", with_ctes(RUNS_SQL) + """
SELECT run_id, experiment_name, CAST(o_custkey AS VARCHAR) AS cust FROM runs WHERE run_id = 'r000000000007'""")
def find_run(spark, sf):
    return stores.find_run(runs(spark, sf), "r000000000007").select("run_id", "experiment_name", F.col("params")["cust"].alias("cust"))


@query("run_store", with_ctes(RUNS_SQL) + """
SELECT run_id, CASE WHEN o_orderstatus = 'P' THEN 'default' ELSE experiment_name END AS experiment_name,
  CASE WHEN price * 1000000 > 200000 THEN 'again' ELSE 'first' END AS attempt FROM runs""")
def run_store(spark, sf):
    """Runs are logged twice for some ids; the store shows the newest row per id."""
    root = work_dir(spark, "runs")
    r = runs(spark, sf).withColumn("experiment_name", F.when(F.col("tags")["status"] == "P", "").otherwise(F.col("experiment_name")))
    r = r.join(table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000000).alias("price")), "o_orderkey")
    r = stores.named_runs(r).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    first = r.withColumn("tags", F.create_map(F.lit("attempt"), F.lit("first")))
    stores.append(first, root, "runs", F.to_timestamp(F.lit("2024-01-01")))
    again = r.where(F.col("price") * 1000000 > 200000).withColumn("tags", F.create_map(F.lit("attempt"), F.lit("again")))
    stores.append(again, root, "runs", F.to_timestamp(F.lit("2024-01-02")))
    return stores.current(spark, root, "runs").select("run_id", "experiment_name", F.col("tags")["attempt"].alias("attempt"))


@query("model_store", with_ctes(MODELS_SQL, _CHAMPION_SQL) + """
SELECT m.model_name, m.version_n, CASE WHEN c.version_n = m.version_n THEN 'production' ELSE 'none' END AS stage, round(m.f1, 9) AS f1
FROM models m JOIN champ c USING (model_name)""")
def model_store(spark, sf):
    """Models are registered, then champions are registered again as production; the store shows the newest."""
    root = work_dir(spark, "models")
    m = models(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp"))
    stores.append(m.withColumn("stage", F.lit("none")), root, "models", F.to_timestamp(F.lit("2024-03-01")))
    stores.append(registry.champion(m).withColumn("stage", F.lit("production")), root, "models", F.to_timestamp(F.lit("2024-03-02")))
    return stores.current(spark, root, "models").select("model_name", "version_n", "stage", F.round(F.col("metrics")["f1"], 9).alias("f1"))


@query("metric_lookup", with_ctes(RUNS_SQL) + """
SELECT run_id, round(CASE o_orderkey % 3 WHEN 0 THEN price ELSE 0.0 END, 9) AS f1, round(CASE o_orderkey % 3 WHEN 0 THEN 1 - price WHEN 1 THEN price ELSE 0.0 END, 9) AS auc,
  CASE WHEN o_orderkey % 3 = 1 THEN true ELSE false END AS has_accuracy FROM runs""")
def metric_lookup(spark, sf):
    m = F.col("metrics")
    return runs(spark, sf).select(
        "run_id", F.round(first_key(m, "f1", "f1_score", default=0.0), 9).alias("f1"),
        F.round(first_key(m, "auc_roc", "auc", default=0.0), 9).alias("auc"), has_any_key(m, "accuracy", "acc").alias("has_accuracy"))


@query("latest_by_key", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_by_key(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return latest_by(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")
