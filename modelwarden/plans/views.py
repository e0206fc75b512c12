"""Domain tables (requests, decisions, predictions, models, runs, notebooks ...) over the given tables.

Each view is a projection, or an aggregate where it says so. The `*_SQL` texts define the same views
for the check SQL, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


# --- requests -------------------------------------------------------------------------------------
def requests(spark: SparkSession, sf: str) -> DataFrame:
    return request_columns(table(spark, sf, "events"))


def request_columns(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "ts",
        F.concat(F.lit("e"), (F.col("user_id") % 5).cast("string")).alias("endpoint_id"),
        F.concat(F.lit("v"), (F.col("event_id") % 2).cast("string")).alias("model_version"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("response_code"),
        F.col("value").alias("latency_ms"),
        F.col("event_type").alias("predicted_class"),
    )


REQUESTS_SQL = """
requests AS (
  SELECT event_id, ts, 'e' || CAST(user_id % 5 AS VARCHAR) AS endpoint_id, 'v' || CAST(event_id % 2 AS VARCHAR) AS model_version,
         CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS response_code, value AS latency_ms,
         event_type AS predicted_class
  FROM events)"""

# --- decisions ------------------------------------------------------------------------------------
AGENTS = {"click": "evaluation", "view": "monitoring", "purchase": "deployment", "signup": "feedback", "error": "cicd"}
ACTIONS = {"click": "model.evaluate", "view": "drift.detect", "purchase": "model.deploy.promote",
           "signup": "feedback.analyze", "error": "data.validate"}
THRESHOLDS = {"deployment": 0.9, "evaluation": 0.8}


def _lookup(column: str, pairs: dict[str, str]):
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), F.col(column))


def _case(column: str, pairs: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def decision_columns(events: DataFrame, *extra: str) -> DataFrame:
    """Events as decision rows, with further columns of theirs; big values turn a promotion into a rollback action."""
    action = F.when((F.col("event_type") == "purchase") & (F.col("value") > 60), "model.deploy.rollback").otherwise(
        _lookup("event_type", ACTIONS))
    reasoning = F.struct(
        F.array(F.concat(F.lit("props "), F.col("props")), F.concat(F.lit("user "), F.col("user_id").cast("string")))
        .alias("observations"),
        F.concat(F.lit("event "), "event_type").alias("analysis"),
        F.concat(F.lit("Conclusion on event "), F.col("event_id").cast("string")).alias("conclusion"),
        ((F.col("event_id") % 100) / 100).alias("confidence"),
        F.array().cast("array<string>").alias("alternatives_considered"),
        F.lit("static-reasoner").alias("model_used"),
    )
    return events.select(
        F.concat(F.lit("d"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("id"),
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("trace_id"),
        _lookup("event_type", AGENTS).alias("agent_name"),
        action.alias("action"),
        (F.col("value") > 10).alias("approved"),
        reasoning.alias("reasoning"),
        F.create_map(F.lit("event_type"), F.col("event_type")).alias("artifacts"),
        F.col("props").alias("metadata"),
        F.col("ts").alias("timestamp"),
        F.lit(False).alias("escalate_to_human"),
        F.lit(None).cast("string").alias("escalation_reason"),
        *extra,
    )


def decisions(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    return decision_columns(table(spark, sf, "events"), *extra)


def escalated_decisions(spark: SparkSession, sf: str, default: float = 0.1) -> DataFrame:
    """Decisions after escalation with a low default, so that most traces hold both outcomes."""
    from modelwarden.operators.gates import escalate

    return escalate(decisions(spark, sf), {"deployment": 0.2}, default)


DECISIONS_SQL = f"""
decisions AS (
  SELECT 'd' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, 't' || CAST(user_id AS VARCHAR) AS trace_id,
         {_case('event_type', AGENTS)} AS agent_name,
         CASE WHEN event_type = 'purchase' AND value > 60 THEN 'model.deploy.rollback' ELSE {_case('event_type', ACTIONS)} END AS action,
         value > 10 AS approved, CAST((event_id % 100) AS DOUBLE) / 100 AS confidence,
         'Conclusion on event ' || CAST(event_id AS VARCHAR) AS conclusion, 'props ' || props AS obs1,
         'user ' || CAST(user_id AS VARCHAR) AS obs2, event_type, ts AS "timestamp", event_id, user_id, props, value
  FROM events)"""
ESCALATED_SQL = DECISIONS_SQL + """,
esc AS (
  SELECT *, confidence < CASE agent_name WHEN 'deployment' THEN 0.2 ELSE 0.1 END AS escalate_to_human FROM decisions)"""
PCT_SQL = "CAST(CAST(round_even(confidence * 100, 0) AS BIGINT) AS VARCHAR) || '%'"

# --- predictions ----------------------------------------------------------------------------------
SPLIT_DATE = "1998-06-01"


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_discount").alias("score"),
        (F.col("l_discount") >= 0.05).cast("int").alias("pred"),
        F.col("l_linestatus").alias("group_name"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string")).alias("model_name"),
        (F.col("l_shipdate") < F.lit(SPLIT_DATE).cast("timestamp_ntz")).alias("is_base"),
        "l_orderkey", "l_linenumber",
    )


PREDICTIONS_SQL = f"""
predictions AS (
  SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, l_discount AS score, CAST(l_discount >= 0.05 AS INTEGER) AS pred,
         l_linestatus AS group_name, 's' || CAST(l_suppkey % 10 AS VARCHAR) AS model_name,
         l_shipdate < TIMESTAMP '{SPLIT_DATE}' AS is_base, l_orderkey, l_linenumber
  FROM lineitem)"""

# --- models, promotions, candidates, runs ---------------------------------------------------------
EPOCH = "2024-01-01"


def models(spark: SparkSession, sf: str) -> DataFrame:
    """Registry: a brand is a model, its parts in key order are the versions (numbered by a sliced scan)."""
    from modelwarden.operators.ordered import scan

    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice", "p_type")
    numbered = scan(p, ["p_brand"], ["p_partkey"], position="version_n")
    return numbered.select(
        F.col("p_brand").alias("model_name"), F.concat(F.lit("v"), F.col("version_n").cast("string")).alias("version"),
        F.col("version_n").cast("int").alias("version_n"),
        F.concat(F.lit("s3://models/"), F.col("p_partkey").cast("string"), F.lit(".pkl")).alias("artifact_uri"),
        F.create_map(F.lit("f1"), F.col("p_retailprice") / 2000, F.lit("latency_p99_ms"), F.col("p_size") * 3.0,
                     F.lit("fairness_delta"), (F.col("p_partkey") % 16) / 160).alias("metrics"),
        F.when(F.col("p_size") == 1, "production").otherwise("none").alias("stage"),
        (F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval((F.col("p_partkey") % 200).cast("int"))).alias("created_at"),
        "p_partkey",
    )


MODELS_SQL = f"""
models AS (
  SELECT p_brand AS model_name, 'v' || CAST(version_n AS VARCHAR) AS version, version_n, p_partkey,
         's3://models/' || CAST(p_partkey AS VARCHAR) || '.pkl' AS artifact_uri, p_retailprice / 2000 AS f1, p_size * 3.0 AS p99,
         CAST(p_partkey % 16 AS DOUBLE) / 160 AS fairness, CASE WHEN p_size = 1 THEN 'production' ELSE 'none' END AS stage,
         TIMESTAMP '{EPOCH}' + to_days(CAST(p_partkey % 200 AS INTEGER)) AS created_at
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS version_n FROM part))"""


def promotions(spark: SparkSession, sf: str) -> DataFrame:
    """Promotion log from orders: customer group -> model, order -> version and time."""
    return table(spark, sf, "orders").select(
        F.concat(F.lit("m"), (F.col("o_custkey") % 40).cast("string")).alias("model_name"),
        F.concat(F.lit("v"), (F.col("o_custkey") % 7).cast("string")).alias("version"),
        F.when(F.col("o_orderstatus") == "F", "production").when(F.col("o_orderstatus") == "O", "staging")
        .otherwise("archived").alias("stage"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey"))).alias("ts"),
    )


PROMOTIONS_SQL = """
promotions AS (
  SELECT 'm' || CAST(o_custkey % 40 AS VARCHAR) AS model_name, 'v' || CAST(o_custkey % 7 AS VARCHAR) AS version,
         CASE o_orderstatus WHEN 'F' THEN 'production' WHEN 'O' THEN 'staging' ELSE 'archived' END AS stage,
         o_orderdate + to_seconds(o_orderkey) AS ts
  FROM orders)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Experiment runs from orders; metric sets differ between runs."""
    price = F.col("o_totalprice") / 1000000
    return table(spark, sf, "orders").select(
        F.concat(F.lit("r"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("run_id"),
        F.col("o_orderpriority").alias("experiment_name"),
        F.create_map(F.lit("cust"), F.col("o_custkey").cast("string")).alias("params"),
        F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("f1"), price, F.lit("auc"), 1 - price))
        .when(F.col("o_orderkey") % 3 == 1, F.create_map(F.lit("auc"), price, F.lit("accuracy"), price / 2))
        .otherwise(F.create_map(F.lit("loss"), price)).alias("metrics"),
        F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("tags"),
        F.col("o_orderdate").alias("timestamp"),
        "o_orderkey", "o_custkey",
    )


RUNS_SQL = """
runs AS (
  SELECT 'r' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS run_id, o_orderpriority AS experiment_name, o_orderkey, o_custkey,
         o_totalprice / 1000000 AS price, o_orderstatus, o_orderdate AS "timestamp"
  FROM orders),
run_metrics AS (
  SELECT run_id, o_custkey, o_orderkey, 'f1' AS metric, price AS value FROM runs WHERE o_orderkey % 3 = 0
  UNION ALL SELECT run_id, o_custkey, o_orderkey, 'auc', 1 - price FROM runs WHERE o_orderkey % 3 = 0
  UNION ALL SELECT run_id, o_custkey, o_orderkey, 'auc', price FROM runs WHERE o_orderkey % 3 = 1
  UNION ALL SELECT run_id, o_custkey, o_orderkey, 'accuracy', price / 2 FROM runs WHERE o_orderkey % 3 = 1
  UNION ALL SELECT run_id, o_custkey, o_orderkey, 'loss', price FROM runs WHERE o_orderkey % 3 = 2)"""


# --- feedback -------------------------------------------------------------------------------------
def corrections(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("model_name"),
        F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE")).alias("segment"), "o_orderkey", "o_totalprice",
    )


def flags(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderstatus = 'O' AND o_orderpriority LIKE '1%'")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("model_name"), F.lit("late").alias("reason"))


FEEDBACK_SQL = """
corrections AS (
  SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS model_name, coalesce(nullif(c_mktsegment, 'FURNITURE'), 'unknown') AS segment, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'),
flags AS (
  SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS model_name
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1%')"""


def agreement_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of the two labels of a document, by language."""
    lab = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return lab.join(docs, "doc_id").select(
        F.col("lang").alias("model_name"), "source",
        (F.col("quality") == 1 - F.col("toxic")).cast("double").alias("score"))


AGREEMENT_SQL = """
scores AS (
  SELECT lang AS model_name, source, CAST(quality = 1 - toxic AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id))"""

# --- notebooks ------------------------------------------------------------------------------------
SNIPPETS = [
    "import pandas as pd\nfrom sklearn.ensemble import RandomForestClassifier\nimport yaml\nimport os",
    "# mlops: data-loading\ndf = pd.read_csv('data.csv')",
    "# mlops: training\nmodel = RandomForestClassifier()\nmodel.fit(X_train, y_train)",
    "# mlops: metrics\nmetrics = {'f1': f1_score(y, p), 'auc': roc_auc_score(y, p)}",
    "model.fit(X, y)",
    "y_pred = model.predict(X_test)",
    "X = StandardScaler().transform(X)",
    "LEARNING_RATE = 0.1",
    "clf = xgb.XGBClassifier()",
    "from IPython.display import display\nimport cv2\nimport torch.nn as nn",
    "# mlops: nonsense\nprint(1)",
]
MANIFEST = "# mlops: manifest\n# cell 0-2: training\n# cell 1: metrics\n# cell 3 - 900: config\n# cell 5: bogus"


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Notebook cells: conversations are notebooks, turns are cells; code by position, text as a comment."""
    c = table(spark, sf, "conversations")
    pick = F.pmod(F.col("conv_id") * 3 + F.col("turn") * 2, F.lit(len(SNIPPETS))).cast("int")
    snippet = F.when((F.col("conv_id") % 4 == 0) & (F.col("turn") == 1), F.lit(MANIFEST)).otherwise(
        F.element_at(F.array(*[F.lit(s) for s in SNIPPETS]), pick + 1))
    return c.select(
        F.concat(F.lit("nb"), F.col("conv_id").cast("string")).alias("notebook"),
        F.col("turn").cast("bigint").alias("index"),
        F.when(F.col("role") == "system", "markdown").otherwise("code").alias("cell_type"),
        F.concat(snippet, F.lit("\n# "), F.regexp_replace("text", r"\s+", " ")).alias("source"),
    )


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CELLS_SQL = f"""
cells AS (
  SELECT 'nb' || CAST(conv_id AS VARCHAR) AS notebook, turn AS index, CASE WHEN role = 'system' THEN 'markdown' ELSE 'code' END AS cell_type,
         CASE WHEN conv_id % 4 = 0 AND turn = 1 THEN {_q(MANIFEST)}
              ELSE list_extract([{', '.join(_q(s) for s in SNIPPETS)}], CAST((conv_id * 3 + turn * 2) % {len(SNIPPETS)} AS INTEGER) + 1)
         END || chr(10) || '# ' || regexp_replace(text, '\\s+', ' ', 'g') AS source
  FROM conversations)"""
