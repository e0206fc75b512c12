"""Event routing, authority, stage graphs, delegations, job states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from modelwarden.operators import audit, gates, routing
from modelwarden.plans.catalog import query
from modelwarden.plans.views import DECISIONS_SQL, ESCALATED_SQL, decisions, escalated_decisions, table, with_ctes

# Subscription log: every customer may subscribe to a pattern, some unsubscribe later.
PATTERNS = ["model.*", "model.deploy.*", "*.failed", "feedback.analyze", "data.valid?te", "[dm]*", "model.deploy.r[!a]llback", "human.*"]
_CUST_CASE = "list_extract([" + ", ".join(f"'{p}'" for p in PATTERNS) + f"], CAST(c_custkey % {len(PATTERNS)} AS INTEGER) + 1)"
_SUBS_SQL = f"""
log AS (SELECT {_CUST_CASE} AS pattern, 'h' || CAST(c_nationkey % 5 AS VARCHAR) AS handler, CASE WHEN c_acctbal < 0 THEN 'unsubscribe' ELSE 'subscribe' END AS op, c_custkey AS seq FROM customer),
subs AS (SELECT pattern, handler, seq FROM log s WHERE op = 'subscribe' AND NOT EXISTS (
  SELECT 1 FROM log u WHERE u.op = 'unsubscribe' AND u.pattern = s.pattern AND u.handler = s.handler AND u.seq > s.seq))"""


def _subscription_log(spark, sf):
    c = table(spark, sf, "customer")
    pattern = F.element_at(F.array(*[F.lit(p) for p in PATTERNS]), (F.col("c_custkey") % len(PATTERNS)).cast("int") + 1)
    return c.select(
        pattern.alias("pattern"), F.concat(F.lit("h"), (F.col("c_nationkey") % 5).cast("string")).alias("handler"),
        F.when(F.col("c_acctbal") < 0, "unsubscribe").otherwise("subscribe").alias("op"), F.col("c_custkey").alias("seq"))


@query("active_subscriptions", with_ctes(_SUBS_SQL) + "SELECT pattern, handler, seq FROM subs")
def active_subscriptions(spark, sf):
    return routing.active_subscriptions(_subscription_log(spark, sf))


@query("event_routing", with_ctes(DECISIONS_SQL, _SUBS_SQL, """
p AS (SELECT pattern, handler, count(*) AS n FROM subs GROUP BY 1, 2),
t AS (SELECT action AS type, count(*) AS c FROM decisions GROUP BY 1)""") + """
SELECT t.type, p.pattern, p.handler, n * c AS deliveries FROM t JOIN p ON (p.pattern = 'model.*' AND t.type LIKE 'model.%')
  OR (p.pattern = 'model.deploy.*' AND t.type LIKE 'model.deploy.%') OR (p.pattern = '*.failed' AND t.type LIKE '%.failed') OR p.pattern = t.type
  OR (p.pattern = 'data.valid?te' AND t.type LIKE 'data.valid_te') OR (p.pattern = '[dm]*' AND left(t.type, 1) IN ('d', 'm'))
  OR (p.pattern = 'model.deploy.r[!a]llback' AND regexp_full_match(t.type, 'model\\.deploy\\.r[^a]llback')) OR (p.pattern = 'human.*' AND t.type LIKE 'human.%')""")
def event_routing(spark, sf):
    ev = decisions(spark, sf).select("id", F.col("action").alias("type"))
    return routing.delivery_counts(ev, routing.active_subscriptions(_subscription_log(spark, sf)))


@query("event_routing_rows", with_ctes(ESCALATED_SQL, """
e AS (SELECT id, CASE WHEN escalate_to_human THEN 'human.escalation' WHEN approved THEN action || '.approved' ELSE action || '.rejected' END AS type FROM esc)""") + """
SELECT id, type, '*.rejected' AS pattern, 'alert' AS handler FROM e WHERE type LIKE '%.rejected'
UNION ALL SELECT id, type, 'human.*', 'pager' FROM e WHERE type LIKE 'human.%'
UNION ALL SELECT id, type, 'model.deploy.*', 'deployer' FROM e WHERE type LIKE 'model.deploy.%'""")
def event_routing_rows(spark, sf):
    subs = [("*.rejected", "alert"), ("human.*", "pager"), ("model.deploy.*", "deployer")]
    ev = gates.result_events(escalated_decisions(spark, sf).withColumn("artifacts", F.create_map(F.lit("id"), F.col("id"))))
    out = routing.route_static(ev.withColumn("id", F.get_json_object("payload", "$.decision_id")).select("id", "type"), subs)
    return out


def _scopes(spark, sf):
    """Scope table by agent; monitoring is given only metrics, feedback none at all (not restricted)."""
    rows = [(a, s) for a, ss in gates.SCOPES.items() if a not in ("feedback", "monitoring") for s in ss]
    rows += [("monitoring", "metrics.*"), ("deployment", "model.deploy.promote")]
    return spark.createDataFrame([r for r in rows if r != ("deployment", "model.deploy.**")], "agent_name string, scope string")


_OK = """(agent_name = 'evaluation' AND action IN ('model.evaluate', 'model.compare', 'model.register')) OR (agent_name = 'cicd' AND action IN ('data.validate', 'pipeline.trigger', 'test.run', 'artifact.version'))
  OR (agent_name = 'deployment' AND action IN ('model.deploy.promote', 'model.rollback')) OR (agent_name = 'monitoring' AND action LIKE 'metrics.%') OR agent_name = 'feedback'"""


@query("scope_authorised", with_ctes(DECISIONS_SQL) + f"SELECT id, agent_name, action FROM decisions WHERE {_OK}")
def scope_authorised(spark, sf):
    return routing.authorised(decisions(spark, sf), _scopes(spark, sf)).select("id", "agent_name", "action")


@query("scope_violations", with_ctes(DECISIONS_SQL) + f"SELECT id, agent_name, action FROM decisions WHERE NOT ({_OK})")
def scope_violations(spark, sf):
    return routing.violations(decisions(spark, sf), _scopes(spark, sf)).select("id", "agent_name", "action")


# The agents' own scopes, one of which goes deep (prefix.**), and the same actions one level further down for a third of the decisions.
_SCOPE_VALUES = ", ".join(f"('{a}', '{s}')" for a, ss in gates.SCOPES.items() for s in ss)


@query("scope_deep", with_ctes(DECISIONS_SQL, f"""
sc(agent_name, scope) AS (VALUES {_SCOPE_VALUES}),
d AS (SELECT decisions.id, agent_name, CASE WHEN c % 3 = 0 THEN action || '.x' || CAST(c AS VARCHAR) WHEN c % 7 = 0 THEN 'model.deploy'
        WHEN c % 7 = 1 THEN 'model.deployed' ELSE action END AS action
      FROM decisions JOIN (SELECT id, CAST(substr(trace_id, 2) AS BIGINT) AS c FROM decisions) AS k ON k.id = decisions.id)""") + """
SELECT id, agent_name, action FROM d WHERE EXISTS (SELECT 1 FROM sc WHERE sc.agent_name = d.agent_name
    AND (sc.scope = d.action OR (sc.scope LIKE '%.**' AND (d.action = replace(sc.scope, '.**', '') OR starts_with(d.action, replace(sc.scope, '**', ''))))))
  OR d.agent_name NOT IN (SELECT agent_name FROM sc)""")
def scope_deep(spark, sf):
    own = spark.createDataFrame([(a, s) for a, ss in gates.SCOPES.items() for s in ss], "agent_name string, scope string")
    c = F.substr("trace_id", F.lit(2)).cast("bigint")
    action = (F.when(c % 3 == 0, F.concat("action", F.lit(".x"), c.cast("string"))).when(c % 7 == 0, "model.deploy")
              .when(c % 7 == 1, "model.deployed").otherwise(F.col("action")))
    return routing.authorised(decisions(spark, sf).withColumn("action", action), own).select("id", "agent_name", "action")


# Stage tables: every customer is a stage; success leads to twice its number, failure to number + 7.
_STAGES_SQL = """
stages AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS stage, 'c' || CAST(c_custkey * 2 AS VARCHAR) AS ok, 'c' || CAST(c_custkey + 7 AS VARCHAR) AS bad, c_custkey % 5 = 0 AS terminal FROM customer),
edges AS (SELECT stage, 'on_success' AS outcome, 0 AS pos, ok AS target FROM stages WHERE NOT terminal UNION ALL SELECT stage, 'on_failure', 0, bad FROM stages
          UNION ALL SELECT stage, 'on_failure', 1, 'alert_human' FROM stages WHERE terminal)"""


def _stages(spark, sf):
    k = F.col("c_custkey")

    def name(c):
        return F.concat(F.lit("c"), c.cast("string"))

    empty = F.array().cast("array<string>")
    return table(spark, sf, "customer").select(
        name(k).alias("stage"), F.when(k % 5 == 0, empty).otherwise(F.array(name(k * 2))).alias("on_success"),
        F.when(k % 5 == 0, F.array(name(k + 7), F.lit("alert_human"))).otherwise(F.array(name(k + 7))).alias("on_failure"))


@query("stage_edges", with_ctes(_STAGES_SQL) + "SELECT stage, outcome, pos, target FROM edges")
def stage_edges(spark, sf):
    return routing.stage_edges(_stages(spark, sf))


@query("dangling_stages", with_ctes(_STAGES_SQL) + "SELECT stage, outcome, pos, target FROM edges WHERE target NOT IN (SELECT stage FROM stages)")
def dangling_stages(spark, sf):
    s = _stages(spark, sf)
    return routing.dangling(routing.stage_edges(s), s).select("stage", "outcome", "pos", "target")


@query("next_stage", with_ctes(ESCALATED_SQL, _STAGES_SQL) + """
SELECT id, stage, CASE WHEN escalate_to_human THEN NULL WHEN approved THEN CASE WHEN terminal THEN NULL ELSE ok END ELSE bad END AS next_stage
FROM esc JOIN stages ON stage = 'c' || CAST(user_id AS VARCHAR)""")
def next_stage(spark, sf):
    d = escalated_decisions(spark, sf).withColumn("stage", F.concat(F.lit("c"), F.substr("trace_id", F.lit(2))))
    return routing.next_stage(d, _stages(spark, sf)).select("id", "stage", "next_stage")


@query("stage_reachability", """
WITH RECURSIVE """ + _STAGES_SQL.strip() + """,
r AS (SELECT 'c1' AS target, 0 AS depth UNION SELECT e.target, r.depth + 1 FROM r JOIN edges e ON e.stage = r.target WHERE r.depth <= (SELECT count(*) FROM stages))
SELECT 'c1' AS root, target, min(depth) AS depth FROM r GROUP BY 2""")
def stage_reachability(spark, sf):
    s = _stages(spark, sf)
    return routing.reachable(routing.stage_edges(s), s.where("stage = 'c1'").select("stage"))


@query("stage_cycles", with_ctes(DECISIONS_SQL, """
t AS (SELECT agent_name AS target, lag(agent_name) OVER (PARTITION BY trace_id ORDER BY "timestamp", id) AS stage FROM decisions)""") + """
SELECT DISTINCT stage FROM t WHERE stage IS NOT NULL""")
def stage_cycles(spark, sf):
    pos = audit.positions(decisions(spark, sf).select("trace_id", "timestamp", "id", "agent_name"))
    return routing.on_cycle(routing.observed_transitions(pos).select("stage", "target"))


# Suppliers in rings of up to 33 (the next number in the same block of 33, the last one back to the first), blocks apart;
# the even blocks lack the way back. The deepest chain has 32 steps.
_RINGS_SQL = """
n AS (SELECT s_suppkey AS k, (s_suppkey - 1) // 33 AS b FROM supplier),
edges AS (SELECT k AS stage, coalesce(lead(k) OVER (PARTITION BY b ORDER BY k), CASE WHEN b % 2 = 1 THEN min(k) OVER (PARTITION BY b) END) AS target, b FROM n
          UNION ALL SELECT min(k), max(k) + 1, b FROM n GROUP BY b)"""


def _ring_edges(spark, sf):
    k, size = F.col("s_suppkey"), 33
    block = F.expr("CAST((s_suppkey - 1) DIV 33 AS BIGINT)")
    n = table(spark, sf, "supplier").select(k.cast("bigint").alias("k"), block.alias("b"))
    w = Window.partitionBy("b")
    back = F.when(F.col("b") % 2 == 1, F.min("k").over(w))
    ring = n.select(F.col("k").alias("stage"), F.coalesce(F.lead("k").over(w.orderBy("k")), back).alias("target"))
    on = n.groupBy("b").agg(F.min("k").alias("stage"), (F.max("k") + 1).alias("target")).select("stage", "target")
    return ring.where("target IS NOT NULL").union(on).select(F.col("stage").cast("string"), F.col("target").cast("string"))


@query("stage_rings", f"WITH {_RINGS_SQL.strip()} SELECT CAST(k AS VARCHAR) AS stage FROM n WHERE b % 2 = 1")
def stage_rings(spark, sf):
    return routing.on_cycle(_ring_edges(spark, sf))


@query("stage_chain", f"""WITH RECURSIVE {_RINGS_SQL.strip()},
r AS (SELECT 1::BIGINT AS target, 0 AS depth UNION SELECT e.target, r.depth + 1 FROM r JOIN edges e ON e.stage = r.target WHERE e.target IS NOT NULL AND r.depth <= (SELECT count(*) FROM n))
SELECT '1' AS root, CAST(target AS VARCHAR) AS target, min(depth) AS depth FROM r GROUP BY 2""")
def stage_chain(spark, sf):
    return routing.reachable(_ring_edges(spark, sf), spark.createDataFrame([("1",)], "stage string"))


@query("stage_reach_counts", f"""WITH RECURSIVE {_RINGS_SQL.strip()},
e AS (SELECT stage, target FROM edges WHERE target IS NOT NULL),
v AS (SELECT stage FROM e UNION SELECT target FROM e),
r AS (SELECT stage, stage AS target FROM v UNION SELECT r.stage, e.target FROM r JOIN e ON e.stage = r.target),
p AS (SELECT a.stage, min(CAST(a.target AS VARCHAR)) AS part FROM r a JOIN r b ON a.stage = b.target AND a.target = b.stage GROUP BY 1)
SELECT CAST(stage AS VARCHAR) AS stage, part, count(*) AS n_reachable FROM r JOIN p USING (stage) GROUP BY stage, part""")
def stage_reach_counts(spark, sf):
    return routing.reach_counts(_ring_edges(spark, sf))


@query("observed_transitions", with_ctes(DECISIONS_SQL, """
t AS (SELECT agent_name AS target, lag(agent_name) OVER (PARTITION BY trace_id ORDER BY "timestamp", id) AS stage FROM decisions)""") + """
SELECT stage, target, count(*) AS n FROM t WHERE stage IS NOT NULL GROUP BY 1, 2""")
def observed_transitions(spark, sf):
    pos = audit.positions(decisions(spark, sf).select("trace_id", "timestamp", "id", "agent_name"))
    return routing.observed_transitions(pos)


_DELEGATIONS_SQL = with_ctes(DECISIONS_SQL, f"""
sc(agent_name, scope) AS (VALUES {_SCOPE_VALUES}),
g AS (SELECT DISTINCT agent_name, date_trunc('hour', "timestamp") AS granted_at FROM decisions)""")


def _grants(spark, sf):
    return decisions(spark, sf).select("agent_name", F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("granted_at")).distinct()


@query("delegations", _DELEGATIONS_SQL + """
SELECT 'orchestrator' AS grantor_name, agent_name, granted_at, scope, granted_at + INTERVAL 24 HOURS AS expires_at FROM g JOIN sc USING (agent_name)""")
def delegations(spark, sf):
    return routing.delegations(_grants(spark, sf), gates.SCOPES, "orchestrator")


@query("active_delegations", _DELEGATIONS_SQL + """
SELECT agent_name, scope, max(granted_at) AS granted_at FROM g JOIN sc USING (agent_name)
WHERE granted_at <= TIMESTAMP '2024-01-20 12:00:00' AND granted_at + INTERVAL 24 HOURS > TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1, 2""")
def active_delegations(spark, sf):
    rows = routing.delegations(_grants(spark, sf), gates.SCOPES, "orchestrator")
    at = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    return routing.active_delegations(rows, at).select("agent_name", "scope", "granted_at")


@query("job_states", """
WITH j AS (SELECT list_extract(['JOB_STATE_QUEUED', 'JOB_STATE_RUNNING', 'JOB_STATE_SUCCEEDED', 'JOB_STATE_FAILED', 'JOB_STATE_CANCELLED', 'JOB_STATE_PAUSED', 'JOB_STATE_EXPIRED', 'OTHER'],
  CAST(o_orderkey % 8 AS INTEGER) + 1) AS state FROM orders)
SELECT state, CASE state WHEN 'JOB_STATE_QUEUED' THEN 'pending' WHEN 'JOB_STATE_RUNNING' THEN 'running' WHEN 'JOB_STATE_SUCCEEDED' THEN 'succeeded' WHEN 'JOB_STATE_FAILED' THEN 'failed'
  WHEN 'JOB_STATE_CANCELLED' THEN 'cancelled' WHEN 'JOB_STATE_PAUSED' THEN 'running' WHEN 'JOB_STATE_EXPIRED' THEN 'failed' ELSE 'running' END AS status, count(*) AS n FROM j GROUP BY 1""")
def job_states(spark, sf):
    names = ["JOB_STATE_QUEUED", "JOB_STATE_RUNNING", "JOB_STATE_SUCCEEDED", "JOB_STATE_FAILED", "JOB_STATE_CANCELLED",
             "JOB_STATE_PAUSED", "JOB_STATE_EXPIRED", "OTHER"]
    o = table(spark, sf, "orders").select(
        F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("o_orderkey") % 8).cast("int") + 1).alias("state"))
    return o.withColumn("status", routing.job_status(F.col("state"))).groupBy("state", "status").agg(F.count(F.lit(1)).alias("n"))
