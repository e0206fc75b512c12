"""Dataset profiles, drift, data gates, model quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwarden.functions.numbers import clip
from modelwarden.operators import evaluation, gates, quality, training
from modelwarden.operators.ordered import top_per_key
from modelwarden.plans.catalog import query
from modelwarden.plans.views import PREDICTIONS_SQL, SPLIT_DATE, predictions, table, with_ctes
from modelwarden.session import work_dir
from modelwarden.sources import datasets

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# Columns made NULL for some values: the given tables have none.
_NULLED_SQL = """
nulled AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, nullif(o_orderpriority, '5-LOW') AS o_orderpriority,
             CASE WHEN o_custkey % 50 <> 0 THEN o_totalprice END AS o_totalprice, o_custkey % 4 AS feed FROM orders)"""


def _nulled(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority"),
        F.when(F.col("o_custkey") % 50 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        (F.col("o_custkey") % 4).alias("feed"))


_NULL_COLUMNS = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]


@query("null_rates", with_ctes(_NULLED_SQL) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", round(avg(CAST({c} IS NULL AS DOUBLE)), 9) AS null_rate FROM nulled" for c in _NULL_COLUMNS))
def null_rates(spark, sf):
    out = quality.null_rates(_nulled(spark, sf), _NULL_COLUMNS)
    return out.withColumn("null_rate", F.round("null_rate", 9))


@query("dataset_profile", """
SELECT 'orders' AS dataset_name, '2' AS dataset_version, count(*) AS num_rows, 6 AS num_columns,
  'o_custkey:bigint,o_orderdate:timestamp_ntz,o_orderkey:bigint,o_orderpriority:string,o_orderstatus:string,o_totalprice:double' AS schema
FROM orders WHERE o_orderstatus <> 'F'""")
def dataset_profile(spark, sf):
    """Two versions of a dataset are written; the newest is read back and profiled."""
    root = work_dir(spark, "datasets")
    orders = table(spark, sf, "orders")
    datasets.save_dataset(orders, root, "orders")
    n = datasets.save_dataset(orders.where("o_orderstatus <> 'F'"), root, "orders")
    p = datasets.profile(datasets.read_dataset(spark, root, "orders"), "orders", n)
    text = F.array_sort(F.transform(F.map_entries("schema"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])))
    return p.withColumn("schema", F.array_join(text, ","))


@query("dataset_catalog", """
SELECT DISTINCT regexp_replace(lower(replace(p_brand, '#', '_v')) , '_v[0-9]+$', '') || '_' || lower(p_type) AS name FROM part""")
def dataset_catalog(spark, sf):
    listing = table(spark, sf, "part").select(F.concat(
        F.lower(F.regexp_replace("p_brand", "#.*", "")), F.lit("_"), F.lower("p_type"), F.lit("_v"), F.col("p_size").cast("string")).alias("id"))
    return datasets.base_names(listing, "id")


_FIELDS_SQL = """
fields AS (SELECT user_id % 10 AS feed, event_type || '_' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS VARCHAR) AS field,
  CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'old' ELSE 'new' END AS period,
  CASE WHEN value > 200 THEN 'string' WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 = 2 THEN 'double' ELSE 'bigint' END AS type FROM events),
o AS (SELECT feed, field, string_agg(DISTINCT type, '|' ORDER BY type) AS t FROM fields WHERE period = 'old' AND field NOT LIKE 'view_1' GROUP BY 1, 2),
n AS (SELECT feed, field, string_agg(DISTINCT type, '|' ORDER BY type) AS t FROM fields WHERE period = 'new' AND field NOT LIKE 'click_3' GROUP BY 1, 2)"""


@query("schema_diff", with_ctes(_FIELDS_SQL) + """
SELECT coalesce(o.feed, n.feed) AS feed, coalesce(o.field, n.field) AS "column", o.t AS old_type, n.t AS new_type,
  CASE WHEN o.t IS NULL THEN 'added' WHEN n.t IS NULL THEN 'removed' ELSE 'type_changed' END AS change
FROM o FULL JOIN n ON o.feed = n.feed AND o.field = n.field WHERE o.t IS DISTINCT FROM n.t""")
def schema_diff(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int") % 5
    seen = table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("feed"), F.concat("event_type", F.lit("_"), k.cast("string")).alias("field"),
        (F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("old"),
        F.when(F.col("value") > 200, "string").when(k == 2, "double").otherwise("bigint").alias("type"))
    old = quality.observed_schema(seen.where("old AND field <> 'view_1'"), "field", "type", ["feed"])
    new = quality.observed_schema(seen.where("NOT old AND field <> 'click_3'"), "field", "type", ["feed"])
    return quality.schema_diff(old, new, ["feed"]).drop("description")


def _drift_sql(base: str, features: list[str]) -> str:
    union = "\nUNION ALL\n".join(
        f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS v, {base} AS is_base FROM lineitem" for f in features)
    return with_ctes(f"obs AS ({union})", """
edges AS (SELECT feature, unnest(quantile_disc(v, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS e FROM obs WHERE is_base GROUP BY 1),
vals AS (SELECT feature, v, count(*) FILTER (WHERE is_base) AS nb, count(*) FILTER (WHERE NOT is_base) AS nc FROM obs GROUP BY 1, 2),
binned AS (SELECT x.feature, x.v, any_value(nb) AS nb, any_value(nc) AS nc, count(e.e) FILTER (WHERE e.e < x.v) AS bin
           FROM vals x JOIN edges e USING (feature) GROUP BY 1, 2),
bins AS (SELECT feature, bin, sum(nb) AS nb, sum(nc) AS nc FROM binned GROUP BY 1, 2),
tot AS (SELECT feature, sum(nb) AS tb, sum(nc) AS tc FROM bins GROUP BY 1),
sh AS (SELECT feature, greatest(CAST(nc AS DOUBLE) / tc, 1e-6) AS a, greatest(CAST(nb AS DOUBLE) / tb, 1e-6) AS e FROM bins JOIN tot USING (feature)),
psi AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM sh GROUP BY 1),
cum AS (SELECT feature, v, sum(nb) OVER w AS cb, sum(nc) OVER w AS cc FROM vals WINDOW w AS (PARTITION BY feature ORDER BY v)),
ks AS (SELECT feature, max(abs(CAST(cb AS DOUBLE) / tb - CAST(cc AS DOUBLE) / tc)) AS ks_d, CAST(any_value(tb) AS BIGINT) AS n_base, CAST(any_value(tc) AS BIGINT) AS n_cur FROM cum JOIN tot USING (feature) GROUP BY 1),
lam AS (SELECT *, (sqrt(CAST(n_base AS DOUBLE) * n_cur / (n_base + n_cur)) + 0.12 + 0.11 / sqrt(CAST(n_base AS DOUBLE) * n_cur / (n_base + n_cur))) * ks_d AS l FROM ks),
pv AS (SELECT feature, CASE WHEN any_value(l) < 0.05 THEN 1.0 ELSE least(greatest(2 * sum(CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * j * j * l * l)), 0.0), 1.0) END AS ks_p
       FROM lam CROSS JOIN (SELECT unnest(range(1, 101)) AS j) GROUP BY 1)""")


_BASE = f"l_shipdate < TIMESTAMP '{SPLIT_DATE}'"


def _observations(spark, sf, cut=SPLIT_DATE):
    is_base = F.col("l_shipdate") < F.lit(cut).cast("timestamp_ntz")
    return quality.numeric_observations(table(spark, sf, "lineitem"), FEATURES, is_base)


@query("feature_drift", _drift_sql(_BASE, FEATURES) + """
SELECT feature, n_base, n_cur, round(psi, 6) AS psi, round(ks_d, 9) AS ks_d, round(ks_p, 6) AS ks_p
FROM ks JOIN psi USING (feature) JOIN pv USING (feature)""")
def feature_drift(spark, sf):
    p = quality.drift_profile(_observations(spark, sf))
    return p.select("feature", "n_base", "n_cur", F.round("psi", 6).alias("psi"), F.round("ks_d", 9).alias("ks_d"),
                    F.round("ks_p", 6).alias("ks_p"))


# A baseline of cheap items only, so that prices drift.
_SKEWED = "(l_extendedprice < 30000)"


@query("drift_summary", _drift_sql(_SKEWED, FEATURES) + """
SELECT 'lineitem' AS dataset_name, count(*) FILTER (WHERE psi > 0.2) AS drifted_count, count(*) AS total_features, round(max(psi), 6) AS max_psi,
  string_agg(CASE WHEN psi > 0.2 THEN feature END, ',' ORDER BY feature) AS drifted_features, count(*) FILTER (WHERE ks_p < 0.01) AS significant_features
FROM psi JOIN pv USING (feature)""")
def drift_summary(spark, sf):
    obs = quality.numeric_observations(table(spark, sf, "lineitem"), FEATURES, F.col("l_extendedprice") < 30000)
    named = obs.withColumn("dataset_name", F.lit("lineitem"))
    out = quality.drift_summary(quality.drift_profile(named, ["dataset_name"]), ["dataset_name"])
    return out.withColumn("max_psi", F.round("max_psi", 6)).withColumn("drifted_features", F.array_join("drifted_features", ","))


@query("psi_stored_edges", _drift_sql(_BASE, FEATURES) + "SELECT feature, round(psi, 6) AS psi, TRUE AS sketch_close FROM psi")
def psi_stored_edges(spark, sf):
    """The baseline's exact and sketched edges are taken once, saved as tables and reused.

    The index is that of the exact edges; `sketch_close`: that of the sketched ones is within 0.005 of the drift profile's.
    """
    base = table(spark, sf, "lineitem").where(F.col("l_shipdate") < F.lit(SPLIT_DATE).cast("timestamp_ntz"))
    path = work_dir(spark, "edges")
    quality.exact_edges(base, FEATURES).write.parquet(f"{path}/exact")
    quality.baseline_edges(base, FEATURES).write.parquet(f"{path}/sketched")
    obs = _observations(spark, sf)

    def index(kind):
        edges = spark.read.schema("feature string, edges array<double>").parquet(f"{path}/{kind}")
        return quality.psi_from_edges(obs, edges).select("feature", F.col("psi").alias(kind))

    profile = quality.drift_profile(obs).select("feature", "psi")
    close = F.abs(F.col("sketched") - F.col("psi")) <= 0.005
    return index("exact").join(index("sketched"), "feature").join(profile, "feature").select(
        "feature", F.round("exact", 6).alias("psi"), close.alias("sketch_close"))


_EDGES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


@query("baseline_edges", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, unnest(quantile_disc(CAST({f} AS DOUBLE), {_EDGES})) AS edge, generate_subscripts({_EDGES}, 1) AS place FROM lineitem" for f in FEATURES))
def baseline_edges(spark, sf):
    """The exact deciles of every feature."""
    exact = quality.exact_edges(table(spark, sf, "lineitem"), FEATURES)
    return exact.select("feature", F.posexplode("edges").alias("place", "edge")).select(
        "feature", "edge", (F.col("place") + 1).cast("bigint").alias("place"))


@query("psi_categorical", f"""
WITH obs AS (SELECT 'returnflag' AS feature, l_returnflag AS v, {_BASE} AS is_base FROM lineitem
             UNION ALL SELECT 'linestatus', l_linestatus, {_BASE} FROM lineitem
             UNION ALL SELECT 'supplier', CAST(l_suppkey AS VARCHAR), {_BASE} FROM lineitem),
c AS (SELECT feature, v, count(*) FILTER (WHERE is_base) AS nb, count(*) FILTER (WHERE NOT is_base) AS nc FROM obs GROUP BY 1, 2),
t AS (SELECT feature, sum(nb) AS tb, sum(nc) AS tc FROM c GROUP BY 1),
s AS (SELECT feature, greatest(CAST(nc AS DOUBLE) / tc, 1e-6) AS a, greatest(CAST(nb AS DOUBLE) / tb, 1e-6) AS e FROM c JOIN t USING (feature))
SELECT feature, round(sum((a - e) * ln(a / e)), 9) AS psi FROM s GROUP BY 1""")
def psi_categorical(spark, sf):
    li = table(spark, sf, "lineitem").select(
        (F.col("l_shipdate") < F.lit(SPLIT_DATE).cast("timestamp_ntz")).alias("is_base"), F.col("l_returnflag").alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"), F.col("l_suppkey").cast("string").alias("supplier"))
    obs = li.unpivot(["is_base"], ["returnflag", "linestatus", "supplier"], "feature", "value")
    return quality.psi_categorical(obs).select("feature", F.round("psi", 9).alias("psi"))


_CHECKS_SQL = """
checks AS (SELECT 's' || CAST(l_suppkey AS VARCHAR) AS dataset_name, 'part ' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS label, l_quantity < 48 AS ok FROM lineitem),
f AS (SELECT DISTINCT dataset_name, label FROM checks WHERE NOT ok),
ff AS (SELECT dataset_name, string_agg(label, ',' ORDER BY label) AS failed_checks
       FROM (SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY label) AS rn FROM f) WHERE rn <= 5 GROUP BY 1),
rep AS (SELECT dataset_name, count(*) AS total_checks, count(*) FILTER (WHERE ok) AS passed_checks FROM checks GROUP BY 1)"""


def _report(spark, sf):
    checks = table(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dataset_name"),
        F.concat(F.lit("part "), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("label"), "l_quantity")
    return quality.report_summary(checks, ["dataset_name"], F.col("l_quantity") < 48, "label")


@query("report_gate", with_ctes(_CHECKS_SQL) + """
SELECT dataset_name, total_checks, passed_checks, round(CAST(passed_checks AS DOUBLE) / greatest(total_checks, 1), 9) AS pass_rate,
  CAST(passed_checks AS DOUBLE) / greatest(total_checks, 1) >= 0.95 AS approved, coalesce(failed_checks, '') AS failed_checks
FROM rep LEFT JOIN ff USING (dataset_name)""")
def report_gate(spark, sf):
    out = gates.report_gate(_report(spark, sf))
    return out.select("dataset_name", "total_checks", "passed_checks", F.round("pass_rate", 9).alias("pass_rate"), "approved",
                      F.array_join("failed_checks", ",").alias("failed_checks"))


@query("data_gate", with_ctes(_NULLED_SQL, """
r AS (SELECT 'feed' || CAST(feed AS VARCHAR) AS dataset_name, count(*) AS num_rows, avg(CAST(o_orderstatus IS NULL AS DOUBLE)) AS a,
        avg(CAST(o_orderpriority IS NULL AS DOUBLE)) AS b, avg(CAST(o_totalprice IS NULL AS DOUBLE)) AS c FROM nulled GROUP BY 1)""") + """
SELECT dataset_name, num_rows, num_rows >= 100 AS rows_ok, NOT (a > 0.334 OR b > 0.334 OR c > 0.334) AS nulls_ok,
  num_rows >= 100 AND NOT (a > 0.334 OR b > 0.334 OR c > 0.334) AS approved,
  (CASE WHEN a > 0.334 THEN 1 ELSE 0 END + CASE WHEN b > 0.334 THEN 1 ELSE 0 END + CASE WHEN c > 0.334 THEN 1 ELSE 0 END) AS n_violations FROM r""")
def data_gate(spark, sf):
    cols = ["o_orderstatus", "o_orderpriority", "o_totalprice"]
    per = _nulled(spark, sf).groupBy(F.concat(F.lit("feed"), F.col("feed").cast("string")).alias("dataset_name")).agg(
        F.count(F.lit(1)).alias("num_rows"), *[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    rates = per.select("dataset_name", "num_rows", F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c))]).alias("null_rates"))
    out = gates.data_gate(rates, max_null_rate=0.334)
    return out.select("dataset_name", "num_rows", "rows_ok", "nulls_ok", "approved", F.size("null_violations").alias("n_violations"))


@query("data_gate_with_drift", _drift_sql(_SKEWED, FEATURES) + """
SELECT 'lineitem' AS dataset_name, any_value(n_base + n_cur) AS num_rows, count(*) FILTER (WHERE psi > 0.2) = 0 AS drift_ok,
  count(*) FILTER (WHERE psi > 0.2) = 0 AS approved,
  string_agg(CASE WHEN psi > 0.2 THEN feature || ': PSI=' || printf('%.3f', psi) END, ',' ORDER BY feature) AS psi_violations
FROM ks JOIN psi USING (feature)""")
def data_gate_with_drift(spark, sf):
    obs = quality.numeric_observations(table(spark, sf, "lineitem"), FEATURES, F.col("l_extendedprice") < 30000)
    prof = quality.drift_profile(obs.withColumn("dataset_name", F.lit("lineitem")), ["dataset_name"])
    subject = prof.groupBy("dataset_name").agg(
        F.max(F.col("n_base") + F.col("n_cur")).alias("num_rows"),
        F.map_from_entries(F.collect_list(F.struct("feature", "psi"))).alias("psi_scores"))
    out = gates.data_gate(subject)
    return out.select("dataset_name", "num_rows", "drift_ok", "approved", F.array_join("psi_violations", ",").alias("psi_violations"))


# --- model quality --------------------------------------------------------------------------------
@query("class_metrics", with_ctes(PREDICTIONS_SQL, """
c AS (SELECT model_name, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
        count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn FROM predictions GROUP BY 1)""") + """
SELECT model_name, tp, fp, fn, tn, round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 9) AS accuracy, round(CAST(tp AS DOUBLE) / (tp + fp), 9) AS precision,
  round(CAST(tp AS DOUBLE) / (tp + fn), 9) AS recall, round(CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn), 9) AS f1 FROM c""")
def class_metrics(spark, sf):
    out = evaluation.class_metrics(predictions(spark, sf), ["model_name"])
    return out.select("model_name", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("roc_auc", with_ctes(PREDICTIONS_SQL, """
r AS (SELECT model_name, label, rank() OVER w + (count(*) OVER (PARTITION BY model_name, score) - 1) / 2.0 AS rk FROM predictions WINDOW w AS (PARTITION BY model_name ORDER BY score)),
a AS (SELECT model_name, sum(CASE WHEN label = 1 THEN rk ELSE 0 END) AS s, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM r GROUP BY 1)""") + """
SELECT model_name, p AS positives, n AS negatives, round((s - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * n), 9) AS auc_roc FROM a""")
def roc_auc(spark, sf):
    out = evaluation.roc_auc(predictions(spark, sf), ["model_name"])
    return out.withColumn("auc_roc", F.round("auc_roc", 9))


@query("parity", with_ctes(PREDICTIONS_SQL, """
g AS (SELECT model_name, group_name, avg(CAST(pred AS DOUBLE)) AS r FROM predictions GROUP BY 1, 2)""") + """
SELECT model_name, count(*) AS groups, round(max(r) - min(r), 9) AS fairness_delta FROM g GROUP BY 1""")
def parity(spark, sf):
    out = evaluation.parity(predictions(spark, sf), ["model_name"], "group_name")
    return out.withColumn("fairness_delta", F.round("fairness_delta", 9))


@query("accuracy_drop", with_ctes(PREDICTIONS_SQL) + """
SELECT model_name, round(avg(CAST(label = pred AS DOUBLE)) FILTER (WHERE is_base), 9) AS baseline_accuracy,
  round(avg(CAST(label = pred AS DOUBLE)) FILTER (WHERE NOT is_base), 9) AS current_accuracy,
  round(avg(CAST(label = pred AS DOUBLE)) FILTER (WHERE is_base) - avg(CAST(label = pred AS DOUBLE)) FILTER (WHERE NOT is_base), 9) AS accuracy_drop
FROM predictions GROUP BY 1""")
def accuracy_drop(spark, sf):
    out = evaluation.accuracy_drop(predictions(spark, sf), ["model_name"], F.col("is_base"))
    return out.select("model_name", *[F.round(c, 9).alias(c) for c in ("baseline_accuracy", "current_accuracy", "accuracy_drop")])


@query("split_rates", with_ctes(PREDICTIONS_SQL) + """
SELECT CASE WHEN (l_orderkey * 7 + l_linenumber) % 100 < 80 THEN 'train' ELSE 'test' END AS split, count(*) AS num_rows,
  round(avg(CAST(label AS DOUBLE)), 9) AS positive_rate FROM predictions GROUP BY 1""")
def split_rates(spark, sf):
    slot = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 100
    out = evaluation.split_rates(training.hash_split(predictions(spark, sf), "l_orderkey", 80, slot), "split")
    return out.withColumn("positive_rate", F.round("positive_rate", 9))


@query("position_split", """
WITH n AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS c FROM orders)
SELECT CASE WHEN rn <= floor(c * 0.8) THEN 'train' ELSE 'test' END AS split, o_orderpriority, count(*) AS num_rows FROM n GROUP BY 1, 2""")
def position_split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    out = training.position_split(o, ["o_orderdate", "o_orderkey"])
    return out.groupBy("split", "o_orderpriority").agg(F.count(F.lit(1)).alias("num_rows"))


@query("stratified_split", """
WITH n AS (SELECT o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY (o_orderkey * 7919) % 10007, o_orderkey) AS rn,
  count(*) OVER (PARTITION BY o_orderstatus) AS c FROM orders)
SELECT o_orderstatus, CASE WHEN rn <= floor(c * 0.8) THEN 'train' ELSE 'test' END AS split, count(*) AS num_rows, round(sum(o_totalprice), 2) AS total FROM n GROUP BY 1, 2""")
def stratified_split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    out = training.stratified_split(o, "o_orderstatus", "o_orderkey", order=(F.col("o_orderkey") * 7919) % 10007)
    return out.groupBy("o_orderstatus", "split").agg(F.count(F.lit(1)).alias("num_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("class_weights", with_ctes(PREDICTIONS_SQL, "c AS (SELECT label, count(*) AS n FROM predictions GROUP BY 1)") + """
SELECT label, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * CAST(n AS DOUBLE)), 9) AS weight FROM c""")
def class_weights(spark, sf):
    out = training.balance_weights(predictions(spark, sf))
    return out.withColumn("weight", F.round("weight", 9))


@query("clipped_values", """
SELECT p_brand, sum(CAST(least(greatest(p_size - 5, 0), 23) AS BIGINT))::BIGINT AS clipped_sum FROM part GROUP BY 1""")
def clipped_values(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(
        F.sum(clip(F.col("p_size") - 5, 0, 23).cast("bigint")).alias("clipped_sum"))


@query("class_sample_union", """
WITH a AS (SELECT doc_id, quality, toxic FROM labels WHERE quality = 1), b AS (SELECT doc_id, quality, toxic FROM labels WHERE quality = 0)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def class_sample_union(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return lab.where("quality = 1").unionByName(lab.where("quality = 0"))


@query("class_sample", """
WITH h AS (SELECT doc_id, quality, toxic, md5('42:' || CAST(doc_id AS VARCHAR)) AS h FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM h)
SELECT doc_id, quality, toxic, row_number() OVER (ORDER BY h, doc_id) AS position FROM r
WHERE rn <= floor(n * CASE quality WHEN 1 THEN 0.5 ELSE 0.25 END)""")
def class_sample(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return training.class_sample(lab, "quality", "doc_id", {1: 0.5, 0: 0.25})


@query("worst_features", """
WITH r AS (SELECT p_type, p_brand, max(p_retailprice) AS v FROM part GROUP BY 1, 2)
SELECT p_type, arg_max(p_brand, (v, p_brand)) AS worst, max(v) AS max_value FROM r GROUP BY 1""")
def worst_features(spark, sf):
    r = table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.max("p_retailprice").alias("v"))
    return r.groupBy("p_type").agg(F.max_by("p_brand", F.struct("v", "p_brand")).alias("worst"), F.max("v").alias("max_value"))


FOREST_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("forest_train_score", """
WITH li AS (SELECT l_extendedprice > 1200 * l_quantity AS y, (l_orderkey * 7 + l_linenumber) % 100 < 80 AS train FROM lineitem)
SELECT 'v1' AS model_version, count(*) FILTER (WHERE NOT train) AS tested, count(*) FILTER (WHERE NOT train AND y) AS positives,
  100 AS trees, count(*) FILTER (WHERE NOT train) > 0 AS learned FROM li""")
def forest_train_score(spark, sf):
    """Train the full forest on 80 % of the line items and score the others; `learned`: accuracy, F1 and AUC above stated bounds."""
    li = table(spark, sf, "lineitem").withColumn("label", (F.col("l_extendedprice") > 1200 * F.col("l_quantity")).cast("int"))
    rows = training.hash_split(li, "l_orderkey", 80, (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 100)
    rows = rows.select("split", "label", *FOREST_FEATURES)
    model = training.train_forest(rows.where("split = 'train'"), FOREST_FEATURES)
    m = training.holdout_metrics(training.score(model, training.deal(rows.where("split = 'test'")), "v1"))
    return m.select("model_version", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("tested"),
                    (F.col("tp") + F.col("fn")).alias("positives"), F.lit(model.stages[-1].getNumTrees).alias("trees"),
                    ((F.col("accuracy") > 0.8) & (F.col("f1") > 0.8) & (F.col("auc_roc") > 0.85)).alias("learned"))


_WEIGHTS = (0.02, -0.00001, 3.0)


@query("pandas_scoring", """
SELECT l_returnflag, 'lin-1' AS model_version, count(*) AS n, round(avg(0.02 * l_quantity - 0.00001 * l_extendedprice + 3.0 * l_discount), 6) AS mean_score,
  count(*) FILTER (WHERE 0.02 * l_quantity - 0.00001 * l_extendedprice + 3.0 * l_discount > 0.450034567) AS positives FROM lineitem GROUP BY 1""")
def pandas_scoring(spark, sf):
    """Scores from a Python model in Arrow batches: a linear model here."""
    weights = _WEIGHTS

    def load_model():
        import numpy as np

        w = np.array(weights)
        return lambda x: x @ w

    li = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_discount")
    scored = training.score_batches(li, ["l_quantity", "l_extendedprice", "l_discount"], load_model, "lin-1")
    return scored.groupBy("l_returnflag", "model_version").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.count_if(F.col("score") > 0.450034567).alias("positives"))


@query("top_failures", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem WHERE l_quantity >= 48)
WHERE rn <= 5""")
def top_failures(spark, sf):
    li = table(spark, sf, "lineitem").where("l_quantity >= 48").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    out = top_per_key(li, ["l_suppkey"], [F.desc("l_quantity"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], 5)
    return out.drop("l_partkey")
