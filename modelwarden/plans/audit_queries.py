"""Audit trail, traces, escalation, rewards, lineage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from modelwarden.functions import maps, text
from modelwarden.functions.numbers import fixed, pct
from modelwarden.operators import audit, gates
from modelwarden.plans.catalog import query
from modelwarden.plans.views import (
    DECISIONS_SQL, ESCALATED_SQL, PCT_SQL, THRESHOLDS, decisions, escalated_decisions, table, with_ctes,
)
from modelwarden.session import work_dir
from modelwarden.sources import stores

_CONF = "reasoning.confidence"


@query("audit_trace", with_ctes(DECISIONS_SQL) + """
SELECT id, agent_name, action, approved, confidence, "timestamp" FROM decisions WHERE trace_id = 't7'""")
def audit_trace(spark, sf):
    return audit.by_trace(decisions(spark, sf), "t7").select("id", "agent_name", "action", "approved", _CONF, "timestamp")


@query("audit_agent", with_ctes(DECISIONS_SQL) + """
SELECT id, trace_id, action, approved, "timestamp" FROM decisions WHERE agent_name = 'deployment' ORDER BY "timestamp" DESC, id DESC LIMIT 50""")
def audit_agent(spark, sf):
    return audit.by_agent(decisions(spark, sf), "deployment").select("id", "trace_id", "action", "approved", "timestamp")


@query("audit_recent", with_ctes(DECISIONS_SQL) + """
SELECT id, trace_id, agent_name, action, "timestamp" FROM decisions ORDER BY "timestamp" DESC, id DESC LIMIT 20""")
def audit_recent(spark, sf):
    return audit.recent(decisions(spark, sf)).select("id", "trace_id", "agent_name", "action", "timestamp")


@query("audit_display", with_ctes(ESCALATED_SQL) + f"""
SELECT strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS time, agent_name, action,
  CASE WHEN escalate_to_human THEN 'ESCALATED' WHEN approved THEN 'GO' ELSE 'NO-GO' END AS decision, {PCT_SQL} AS confidence,
  conclusion, obs1 || '|' || obs2 AS observations,
  CASE WHEN escalate_to_human THEN 'Confidence ' || {PCT_SQL} || ' below threshold ' || CASE agent_name WHEN 'deployment' THEN '20%' ELSE '10%' END || ' for stage ''' || agent_name || '''' END AS escalation_reason
FROM esc""")
def audit_display(spark, sf):
    out = audit.display(escalated_decisions(spark, sf))
    return out.withColumn("observations", F.array_join("observations", "|"))


_ROLLUP_SQL = """
SELECT trace_id, count(*) AS stages, count(*) FILTER (WHERE approved AND NOT escalate_to_human) AS approved, count(*) FILTER (WHERE NOT approved) AS rejected,
  count(*) FILTER (WHERE escalate_to_human) AS escalated, arg_max(agent_name || '/' || action, ("timestamp", id)) AS last_action, max("timestamp") AS last_ts"""


@query("trace_rollup", with_ctes(ESCALATED_SQL) + _ROLLUP_SQL + " FROM esc GROUP BY 1")
def trace_rollup(spark, sf):
    return audit.trace_rollup(escalated_decisions(spark, sf))


@query("recent_status", with_ctes(ESCALATED_SQL, """
last50 AS (SELECT * FROM esc ORDER BY "timestamp" DESC, id DESC LIMIT 50)""") + _ROLLUP_SQL + """
FROM last50 GROUP BY 1 ORDER BY last_ts DESC, trace_id DESC LIMIT 10""")
def recent_status(spark, sf):
    return audit.recent_status(escalated_decisions(spark, sf))


# Only the first 20 stages count, and none after the first escalation.
_OUTCOME_SQL = """
runs AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY "timestamp", id) AS r FROM {src}),
ends AS (SELECT trace_id, min(r) FILTER (WHERE escalate_to_human AND r <= 20) AS e, least(count(*), 20) AS m, bool_and(approved) FILTER (WHERE r <= 20) AS ok FROM runs GROUP BY 1),
out AS (SELECT trace_id, coalesce(e, m) AS n, CASE WHEN e IS NOT NULL THEN 'escalated' WHEN m >= 20 OR NOT ok THEN 'failed' ELSE 'completed' END AS status FROM ends)"""
# Short runs: one trace per user, event type and day, so that all outcomes occur.
_SHORT_SQL = """
short AS (SELECT * REPLACE (trace_id || '-' || event_type || '-' || strftime("timestamp", '%Y%m%d') AS trace_id) FROM esc)"""


def _short(spark, sf):
    d = escalated_decisions(spark, sf)
    return d.withColumn("trace_id", F.concat_ws("-", "trace_id", F.col("artifacts")["event_type"], F.date_format("timestamp", "yyyyMMdd")))


@query("trace_outcome", with_ctes(ESCALATED_SQL, _SHORT_SQL, _OUTCOME_SQL.format(src="short")) + """
SELECT trace_id, n AS stages_executed, n AS decisions, status FROM out""")
def trace_outcome(spark, sf):
    return audit.trace_outcome(_short(spark, sf))


@query("completion_events", with_ctes(ESCALATED_SQL, _SHORT_SQL, _OUTCOME_SQL.format(src="short")) + """
SELECT CASE WHEN status = 'completed' THEN 'pipeline.completed' ELSE 'pipeline.failed' END AS type, 'orchestrator' AS source, trace_id,
  '{"status":"' || status || '","stages_executed":' || CAST(n AS VARCHAR) || ',"decisions":' || CAST(n AS VARCHAR) || '}' AS payload FROM out WHERE status <> 'escalated'""")
def completion_events(spark, sf):
    return audit.completion_events(audit.trace_outcome(_short(spark, sf)))


@query("start_events", with_ctes(DECISIONS_SQL) + """
SELECT 'pipeline.started' AS type, 'orchestrator' AS source, trace_id, '{"pipeline":"nightly","entry_stage":"' || arg_min(agent_name, ("timestamp", id)) || '"}' AS payload
FROM decisions GROUP BY trace_id""")
def start_events(spark, sf):
    first = decisions(spark, sf).groupBy("trace_id").agg(F.min_by("agent_name", F.struct("timestamp", "id")).alias("entry_stage"))
    return audit.start_events(first, "nightly")


_POSITIONS_SQL = """
pos AS (SELECT *, row_number() OVER w AS position, lag(agent_name) OVER w AS previous_stage, lag(id) OVER w AS previous_decision_id
        FROM esc WINDOW w AS (PARTITION BY trace_id ORDER BY "timestamp", id))"""


@query("trace_positions", with_ctes(ESCALATED_SQL, _POSITIONS_SQL) + """
SELECT id, trace_id, agent_name, position, previous_stage, previous_decision_id FROM pos""")
def trace_positions(spark, sf):
    return audit.positions(escalated_decisions(spark, sf)).select(
        "id", "trace_id", "agent_name", "position", "previous_stage", "previous_decision_id")


@query("stage_cap", with_ctes(ESCALATED_SQL, _POSITIONS_SQL) + """
SELECT id, trace_id, CAST(position AS INTEGER) AS stage_no FROM pos WHERE position <= 20""")
def stage_cap(spark, sf):
    return audit.capped(escalated_decisions(spark, sf)).select("id", "trace_id", "stage_no")


@query("trace_nested", with_ctes(ESCALATED_SQL, _POSITIONS_SQL) + """
SELECT trace_id, (position - 1) // 25 AS page, string_agg(id || ':' || action, ',' ORDER BY position) AS decisions, count(*) AS n FROM pos GROUP BY 1, 2""")
def trace_nested(spark, sf):
    out = audit.nested(escalated_decisions(spark, sf).select("trace_id", "timestamp", "id", "action"), page_rows=25)
    line = F.transform("decisions", lambda d: F.concat(d["id"], F.lit(":"), d["action"]))
    return out.select("trace_id", "page", F.array_join(line, ",").alias("decisions"), F.size("decisions").cast("bigint").alias("n"))


@query("pipeline_traces", with_ctes(ESCALATED_SQL, _POSITIONS_SQL, """
nest AS (SELECT trace_id, count(*) AS n, string_agg(id, ',' ORDER BY position) AS ids FROM pos GROUP BY 1),
head AS (SELECT 't' || CAST(c_custkey AS VARCHAR) AS trace_id, c_name AS pipeline_name, 'completed' AS status FROM customer WHERE c_mktsegment <> 'MACHINERY')""") + """
SELECT coalesce(head.trace_id, nest.trace_id) AS trace_id, coalesce(pipeline_name, '') AS pipeline_name, coalesce(status, 'running') AS status,
  coalesce(n, 0) AS n_decisions, coalesce(ids, '') AS ids FROM head FULL JOIN nest ON head.trace_id = nest.trace_id""")
def pipeline_traces(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment <> 'MACHINERY'")
    none = F.lit(None).cast("timestamp_ntz")
    heads = c.select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("trace_id"), F.col("c_name").alias("pipeline_name"),
                     none.alias("started_at"), none.alias("completed_at"), F.lit("completed").alias("status"))
    d = escalated_decisions(spark, sf).select("trace_id", "timestamp", "id")
    out = audit.pipeline_traces(heads, d, page_rows=100_000)
    return out.select("trace_id", "pipeline_name", "status", F.size("decisions").cast("bigint").alias("n_decisions"),
                      F.array_join(F.transform("decisions", lambda d: d["id"]), ",").alias("ids"))


@query("pipeline_trace_pages", with_ctes(ESCALATED_SQL, _POSITIONS_SQL, """
nest AS (SELECT trace_id, (position - 1) // 10 AS page, count(*) AS n, string_agg(id, ',' ORDER BY position) AS ids FROM pos GROUP BY 1, 2),
head AS (SELECT 't' || CAST(c_custkey AS VARCHAR) AS trace_id, c_name AS pipeline_name FROM customer WHERE c_mktsegment <> 'MACHINERY')""") + """
SELECT coalesce(head.trace_id, nest.trace_id) AS trace_id, coalesce(page, 0) AS page, coalesce(pipeline_name, '') AS pipeline_name,
  coalesce(n, 0) AS n_decisions, coalesce(ids, '') AS ids FROM head FULL JOIN nest ON head.trace_id = nest.trace_id""")
def pipeline_trace_pages(spark, sf):
    """Traces of more than ten decisions are several rows, each with the header."""
    none = F.lit(None).cast("timestamp_ntz")
    heads = table(spark, sf, "customer").where("c_mktsegment <> 'MACHINERY'").select(
        F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("trace_id"), F.col("c_name").alias("pipeline_name"),
        none.alias("started_at"), none.alias("completed_at"), F.lit("completed").alias("status"))
    out = audit.pipeline_traces(heads, escalated_decisions(spark, sf).select("trace_id", "timestamp", "id"), page_rows=10)
    return out.select("trace_id", "page", "pipeline_name", F.size("decisions").cast("bigint").alias("n_decisions"),
                      F.array_join(F.transform("decisions", lambda d: d["id"]), ",").alias("ids"))


@query("trace_text", with_ctes(ESCALATED_SQL, _POSITIONS_SQL, _OUTCOME_SQL.format(src="esc"), f"""
lines AS (SELECT trace_id, position, (position - 1) // 30 AS page, '  [' || agent_name || '] ' || action || ' -> ' || CASE WHEN approved THEN 'GO' ELSE 'NO-GO' END
  || ' (confidence: ' || {PCT_SQL} || ')' || CASE WHEN escalate_to_human THEN ' [ESCALATED]' ELSE '' END AS line FROM pos)""") + """
SELECT trace_id, page, 'Trace: ' || trace_id || ' (' || any_value(status) || ')' || chr(10) || string_agg(line, chr(10) ORDER BY position) AS summary
FROM lines JOIN out USING (trace_id) GROUP BY 1, 2""")
def trace_text(spark, sf):
    d = escalated_decisions(spark, sf)
    return audit.trace_text(d, audit.trace_outcome(d), page_rows=30)


@query("bounded_history", with_ctes(DECISIONS_SQL) + """
SELECT id, "timestamp" FROM decisions ORDER BY "timestamp" DESC, id DESC LIMIT 1000""")
def bounded_history(spark, sf):
    return audit.bounded_history(decisions(spark, sf)).select("id", "timestamp")


@query("decision_store", with_ctes(DECISIONS_SQL) + """
SELECT id, trace_id, agent_name, CASE WHEN action = 'data.validate' THEN NOT approved ELSE approved END AS approved, confidence, obs1 AS first_observation FROM decisions""")
def decision_store(spark, sf):
    """Every decision is logged, some are logged again with a changed outcome; the store shows the newest."""
    root = work_dir(spark, "audit")
    d = decisions(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    stores.append(d, root, "decisions", F.to_timestamp(F.lit("2024-03-01")))
    again = d.where("action = 'data.validate'").withColumn("approved", ~F.col("approved"))
    stores.append(again, root, "decisions", F.to_timestamp(F.lit("2024-03-02")))
    return stores.current(spark, root, "decisions").select(
        "id", "trace_id", "agent_name", "approved", _CONF, F.col("reasoning.observations")[0].alias("first_observation"))


@query("escalation", with_ctes(DECISIONS_SQL, f"""
t AS (SELECT *, CASE agent_name {' '.join(f"WHEN '{a}' THEN {v}" for a, v in THRESHOLDS.items())} ELSE 0.7 END AS thr FROM decisions)""") + f"""
SELECT id, confidence < thr AS escalate_to_human, CASE WHEN confidence < thr THEN 'Confidence ' || {PCT_SQL} || ' below threshold ' ||
  CAST(CAST(round_even(thr * 100, 0) AS BIGINT) AS VARCHAR) || '% for stage ''' || agent_name || '''' END AS escalation_reason FROM t""")
def escalation(spark, sf):
    thresholds = spark.createDataFrame(list(THRESHOLDS.items()), "agent_name string, confidence_threshold double")
    return gates.escalate(decisions(spark, sf), thresholds).select("id", "escalate_to_human", "escalation_reason")


@query("result_events", with_ctes(ESCALATED_SQL) + """
SELECT CASE WHEN escalate_to_human THEN 'human.escalation' WHEN approved THEN action || '.approved' ELSE action || '.rejected' END AS type,
  agent_name AS source, trace_id, substr(sha256('event|' || id), 1, 12) AS id, "timestamp",
  id AS decision_id, action, approved, confidence, conclusion, escalate_to_human AS escalated FROM esc""")
def result_events(spark, sf):
    out = gates.result_events(escalated_decisions(spark, sf))
    held = F.from_json("payload", "decision_id string, action string, approved boolean, confidence double, conclusion string, escalated boolean")
    return out.withColumn("p", held).select("type", "source", "trace_id", "id", "timestamp", "p.*")


@query("trace_store", with_ctes(ESCALATED_SQL, _OUTCOME_SQL.format(src="esc")) + """
SELECT trace_id, 'audit' AS pipeline_name, status FROM out""")
def trace_store(spark, sf):
    """Headers are saved as running when a trace starts and again with its outcome; the newest counts."""
    root = work_dir(spark, "traces")
    d = escalated_decisions(spark, sf)
    spans = d.groupBy("trace_id").agg(F.min("timestamp").cast("timestamp").alias("started_at"), F.max("timestamp").cast("timestamp").alias("ended"))
    begun = spans.select("trace_id", F.lit("audit").alias("pipeline_name"), "started_at", F.lit(None).cast("timestamp").alias("completed_at"),
                         F.lit("running").alias("status"))
    stores.append(begun, root, "traces", F.to_timestamp(F.lit("2024-03-01")))
    done = spans.join(audit.trace_outcome(d), "trace_id").select(
        "trace_id", F.lit("audit").alias("pipeline_name"), "started_at", F.col("ended").alias("completed_at"), "status")
    stores.append(done, root, "traces", F.to_timestamp(F.lit("2024-03-02")))
    return stores.current(spark, root, "traces").select("trace_id", "pipeline_name", "status")


@query("custom_gate", """
SELECT s_suppkey, CASE WHEN s_acctbal < 0 OR s_nationkey = 3 THEN false ELSE s_acctbal > 5000 END AS approved,
  CASE WHEN s_acctbal < 0 THEN 'Unhandled error in credit: missing input' WHEN s_nationkey = 3 THEN 'Unhandled error in credit: lacks authority for credit.delete'
    WHEN 0.5 + (s_suppkey % 8) / 16.0 < 0.7 THEN 'Confidence ' || CAST(CAST(round_even((0.5 + (s_suppkey % 8) / 16.0) * 100, 0) AS BIGINT) AS VARCHAR) || '% below threshold 70% for stage ' || chr(39) || 'credit' || chr(39) END AS escalation_reason
FROM supplier""")
def custom_gate(spark, sf):
    """A user's own gate and reasoner: authority check, error rows, escalation and packing come with it."""
    def credit(df):
        return (
            df.withColumn("action", F.when(F.col("s_nationkey") == 3, "credit.delete").otherwise("credit.check"))
            .withColumn("approved", F.col("balance") > 5000)
            .withColumn("observations", F.array(F.concat(F.lit("balance "), F.col("balance").cast("string")))))

    def reasoner(observations, agent, action):
        r = text.static_reasoning(observations, agent, action)
        return r.withField("confidence", 0.5 + (F.col("s_suppkey") % 8) / 16)

    s = table(spark, sf, "supplier").withColumn("balance", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")))
    out = gates.decide(
        s, credit, "credit", trace_id=F.lit("t"), timestamp=F.lit("2024-01-01").cast("timestamp"), id_parts=[F.col("s_suppkey")],
        scopes=["credit.check"], required=["balance"], metadata=["s_suppkey"], reasoner=reasoner)
    return out.select(F.get_json_object("metadata", "$.s_suppkey").cast("bigint").alias("s_suppkey"), "approved", "escalation_reason")


@query("payload_merge", with_ctes(DECISIONS_SQL) + """
SELECT id, 'action=' || CASE WHEN approved THEN 'final' ELSE action END || ';event_type=' || event_type || ';previous=' || trace_id AS payload FROM decisions""")
def payload_merge(spark, sf):
    """Payload, then artifacts, then metadata: on equal names the later value wins."""
    d = decisions(spark, sf)
    first = F.create_map(F.lit("action"), F.col("action"), F.lit("event_type"), F.lit("unset"))
    last = F.when(F.col("approved"), F.create_map(F.lit("action"), F.lit("final"), F.lit("previous"), F.col("trace_id"))).otherwise(
        F.create_map(F.lit("previous"), F.col("trace_id")))
    merged = maps.merge_later_wins(first, F.col("artifacts"), last)
    kv = F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return d.select("id", F.array_join(kv, ";").alias("payload"))


@query("event_store", with_ctes(ESCALATED_SQL) + """
SELECT CASE WHEN escalate_to_human THEN 'human.escalation' WHEN approved THEN action || '.approved' ELSE action || '.rejected' END AS type, count(*) AS n FROM esc GROUP BY 1""")
def event_store(spark, sf):
    root = work_dir(spark, "events")
    ev = gates.result_events(escalated_decisions(spark, sf)).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    stores.append(ev, root, "events_log")
    return stores.current(spark, root, "events_log").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("error_rows", with_ctes(DECISIONS_SQL) + """
SELECT id, CASE WHEN value < 5 THEN false ELSE approved END AS approved, CASE WHEN value < 5 THEN 0.0 ELSE confidence END AS confidence, value < 5 AS escalate_to_human,
  CASE WHEN value < 5 THEN 'Unhandled error in cicd: missing input of user ' || CAST(user_id AS VARCHAR) END AS escalation_reason FROM decisions""")
def error_rows(spark, sf):
    joined = decisions(spark, sf, "value").withColumn("missing", F.col("value") < 5)
    msg = F.concat(F.lit("missing input of "), F.col("reasoning.observations")[1])
    return gates.error_decisions(joined, F.col("missing"), msg, "cicd").select(
        "id", "approved", _CONF, "escalate_to_human", "escalation_reason")


@query("valid_decisions", with_ctes(DECISIONS_SQL) + """
SELECT id, confidence * 1.25 AS confidence FROM decisions WHERE confidence * 1.25 BETWEEN 0 AND 1 AND value > 3""")
def valid_decisions(spark, sf):
    d = decisions(spark, sf, "value")
    shifted = d.withColumn("reasoning", F.col("reasoning").withField("confidence", F.col("reasoning.confidence") * 1.25))
    blank = shifted.withColumn("action", F.when(F.col("value") > 3, F.col("action")))
    good, _ = gates.split_valid(blank)
    return good.select("id", _CONF)


@query("rejected_decisions", with_ctes(DECISIONS_SQL) + """
SELECT id FROM decisions WHERE NOT (confidence * 1.25 BETWEEN 0 AND 1)""")
def rejected_decisions(spark, sf):
    d = decisions(spark, sf)
    shifted = d.withColumn("reasoning", F.col("reasoning").withField("confidence", F.col("reasoning.confidence") * 1.25))
    return gates.split_valid(shifted)[1].select("id")


_REWARD = "CASE WHEN approved THEN confidence ELSE confidence * 0.5 END"


@query("reward_signals", with_ctes(DECISIONS_SQL) + f"""
SELECT agent_name, count(*) AS decisions, count(*) FILTER (WHERE approved) AS successes, round(avg({_REWARD}), 9) AS mean_reward FROM decisions GROUP BY 1""")
def reward_signals(spark, sf):
    out = audit.reward_signals(decisions(spark, sf))
    return out.withColumn("mean_reward", F.round("mean_reward", 9))


@query("reward_trend", with_ctes(DECISIONS_SQL, f"""
d AS (SELECT agent_name, CAST("timestamp" AS DATE) AS day, sum({_REWARD}) AS s, count(*) AS n FROM decisions GROUP BY 1, 2)""") + """
SELECT agent_name, day, n AS decisions,
  round(sum(s) OVER (PARTITION BY agent_name ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) / sum(n) OVER (PARTITION BY agent_name ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 9) AS reward_7d,
  round(sum(s) OVER (PARTITION BY agent_name ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) / sum(n) OVER (PARTITION BY agent_name ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW), 9) AS reward_30d
FROM d""")
def reward_trend(spark, sf):
    out = audit.reward_trend(decisions(spark, sf))
    return out.withColumn("reward_7d", F.round("reward_7d", 9)).withColumn("reward_30d", F.round("reward_30d", 9))


@query("provenance_rows", with_ctes(ESCALATED_SQL) + """
SELECT agent_name, action, trace_id, id AS decision_id, approved, confidence, conclusion, escalate_to_human AS escalated, "timestamp" FROM esc""")
def provenance_rows(spark, sf):
    out = gates.provenance_rows(escalated_decisions(spark, sf))
    held = F.from_json("metadata", "trace_id string, decision_id string, approved boolean, confidence double, conclusion string, escalated boolean")
    return out.select("agent_name", "action", held.alias("m"), "timestamp").select("agent_name", "action", "m.*", "timestamp")


@query("feedback_signal_rows", with_ctes(DECISIONS_SQL) + f"""
SELECT agent_name, action, CASE WHEN approved THEN 'success' ELSE 'blocked' END AS result, round({_REWARD}, 9) AS reward_signal, conclusion AS content, "timestamp" FROM decisions""")
def feedback_signal_rows(spark, sf):
    return gates.feedback_rows(decisions(spark, sf)).withColumn("reward_signal", F.round("reward_signal", 9))


@query("memory_rows", with_ctes(DECISIONS_SQL) + f"""
SELECT agent_name, action || ': ' || CASE WHEN approved THEN 'GO' ELSE 'NO-GO' END || ' (' || {PCT_SQL} || ')' AS title, conclusion AS content, 'decision' AS entry_type, "timestamp" FROM decisions""")
def memory_rows(spark, sf):
    return gates.memory_rows(decisions(spark, sf)).drop("metadata")


def _payload_columns(spark, sf):
    d = decisions(spark, sf, "value").withColumn("event_type", F.col("artifacts")["event_type"])
    return d.select(
        "trace_id", "timestamp", "id",
        F.when(F.col("event_type") == "click", F.col("value")).alias("f1"),
        F.when(F.col("event_type") == "error", F.col("id")).alias("failed_id"),
        F.when(F.col("value") > 100, F.col("event_type")).alias("large"))


@query("payload_carry_forward", with_ctes(DECISIONS_SQL) + """
SELECT id, trace_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS payload_f1,
  last_value(CASE WHEN event_type = 'error' THEN id END IGNORE NULLS) OVER w AS payload_failed_id,
  last_value(CASE WHEN value > 100 THEN event_type END IGNORE NULLS) OVER w AS payload_large
FROM decisions WINDOW w AS (PARTITION BY trace_id ORDER BY "timestamp", id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def payload_carry_forward(spark, sf):
    out = audit.carry_forward(_payload_columns(spark, sf), ["f1", "failed_id", "large"])
    return out.select("id", "trace_id", "payload_f1", "payload_failed_id", "payload_large")


_PAYLOAD_SQL = """
kv AS (SELECT trace_id, "timestamp", id, agent_name AS k, action || '/' || id AS v FROM decisions
       UNION ALL SELECT trace_id, "timestamp", id, 'previous_stage', agent_name FROM decisions)"""


def _payloads(spark, sf):
    return decisions(spark, sf).select("trace_id", "timestamp", "id", F.create_map(
        F.col("agent_name"), F.concat("action", F.lit("/"), "id"), F.lit("previous_stage"), F.col("agent_name")).alias("payload"))


def _entries_text(payload: str):
    return F.array_join(F.array_sort(F.transform(F.map_entries(payload), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


@query("running_payload", with_ctes(DECISIONS_SQL, _PAYLOAD_SQL, """
upto AS (SELECT d.id, kv.k, arg_max(kv.v, (kv."timestamp", kv.id)) AS v FROM decisions d
         JOIN kv ON kv.trace_id = d.trace_id AND (kv."timestamp", kv.id) <= (d."timestamp", d.id) GROUP BY 1, 2)""") + """
SELECT id, string_agg(k || '=' || v, ';' ORDER BY k) AS payload FROM upto GROUP BY 1""")
def running_payload(spark, sf):
    """What each decision finds in the payload: all that its run has written until then."""
    return audit.running_payload(_payloads(spark, sf)).select("id", _entries_text("carried").alias("payload"))


@query("final_payload", with_ctes(DECISIONS_SQL, _PAYLOAD_SQL, """
n AS (SELECT trace_id, k, arg_max(v, ("timestamp", id)) AS v FROM kv GROUP BY 1, 2)""") + """
SELECT trace_id, string_agg(k || '=' || v, ';' ORDER BY k) AS payload FROM n GROUP BY 1""")
def final_payload(spark, sf):
    return audit.final_payload(_payloads(spark, sf)).select("trace_id", _entries_text("payload").alias("payload"))


@query("lineage_pairs", with_ctes(ESCALATED_SQL, _POSITIONS_SQL) + """
SELECT c.id, c.previous_decision_id, p.agent_name AS previous_agent, p.approved AS previous_approved FROM pos c JOIN esc p ON c.previous_decision_id = p.id""")
def lineage_pairs(spark, sf):
    pos = audit.positions(escalated_decisions(spark, sf).select("trace_id", "timestamp", "id", "agent_name", "approved"))
    return audit.lineage_pairs(pos).select("id", "previous_decision_id", "previous_agent", "previous_approved")


@query("lineage_roots", with_ctes(ESCALATED_SQL, _POSITIONS_SQL) + """
SELECT id, first_value(id) OVER (PARTITION BY trace_id ORDER BY position) AS root, position - 1 AS depth, FALSE AS cyclic FROM pos""")
def lineage_roots(spark, sf):
    pos = audit.positions(escalated_decisions(spark, sf).select("trace_id", "timestamp", "id", "agent_name"))
    return audit.lineage_roots(pos.select("id", F.col("previous_decision_id").alias("parent")))


# Orders follow the order of the next smaller number in their block of 16; the first of every fourth block follows the last.
@query("lineage_with_cycles", """
WITH o AS (SELECT o_orderkey AS id, o_orderkey // 16 AS b FROM orders),
l AS (SELECT *, min(id) OVER (PARTITION BY b) AS first, row_number() OVER (PARTITION BY b ORDER BY id) - 1 AS depth FROM o)
SELECT id, CASE WHEN b % 4 <> 0 THEN first END AS root, CASE WHEN b % 4 <> 0 THEN depth END AS depth, b % 4 = 0 AS cyclic FROM l""")
def lineage_with_cycles(spark, sf):
    block = F.expr("CAST(o_orderkey DIV 16 AS BIGINT)")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("bigint").alias("id"), block.alias("b"))
    w = Window.partitionBy("b")
    last = F.when(F.col("b") % 4 == 0, F.max("id").over(w))
    return audit.lineage_roots(o.select("id", F.coalesce(F.lag("id").over(w.orderBy("id")), last).alias("parent")))


@query("reasoning_prompts", with_ctes(DECISIONS_SQL) + """
SELECT id, 'Agent: ' || agent_name || chr(10) || 'Action: ' || action || chr(10) || chr(10) || 'Observations:' || chr(10) || '- ' || obs1 || chr(10) || '- ' || obs2 || chr(10) || chr(10)
  || 'Context:' || chr(10) || '{"trace_id":"' || trace_id || '","approved":' || CASE WHEN approved THEN 'true' ELSE 'false' END || '}' || chr(10) || chr(10)
  || 'Analyze these observations and produce your reasoning.' AS prompt FROM decisions""")
def reasoning_prompts(spark, sf):
    ctx = F.to_json(F.struct("trace_id", "approved"))
    return decisions(spark, sf).select("id", text.reasoning_prompt(
        F.col("reasoning.observations"), ctx, F.col("agent_name"), F.col("action")).alias("prompt"))


@query("static_reasoning", with_ctes(DECISIONS_SQL) + """
SELECT id, 'Static analysis for ' || agent_name || '/' || action || ': all observations within bounds.' AS analysis, 'Proceed with ' || action || '.' AS conclusion,
  CAST(0.9 AS DOUBLE) AS confidence, 'static-reasoner' AS model_used FROM decisions""")
def static_reasoning(spark, sf):
    d = decisions(spark, sf)
    r = text.static_reasoning(F.col("reasoning.observations"), F.col("agent_name"), F.col("action"))
    return d.select("id", r.alias("r")).select("id", "r.analysis", "r.conclusion", "r.confidence", "r.model_used")


_RESPONSES_SQL = """
resp AS (SELECT doc_id, CASE doc_id % 6
    WHEN 0 THEN '{"confidence": 0.' || CAST(doc_id % 90 + 10 AS VARCHAR) || ', "analysis": "doc ' || CAST(doc_id AS VARCHAR) || '", "observations": ["' || lang || '", "' || source || '"]}'
    WHEN 1 THEN '```json' || chr(10) || '{"confidence": 0.5, "conclusion": "' || source || '"}' || chr(10) || '```'
    WHEN 2 THEN text WHEN 3 THEN '{"analysis": "no confidence"}' WHEN 4 THEN '  {"confidence": "0.25"}' ELSE '[1, 2]' END AS t, text FROM documents)"""


@query("response_parse", with_ctes(_RESPONSES_SQL) + """
SELECT doc_id, CASE WHEN doc_id % 6 IN (2, 5) THEN 0.0 WHEN doc_id % 6 = 0 THEN CAST('0.' || CAST(doc_id % 90 + 10 AS VARCHAR) AS DOUBLE) WHEN doc_id % 6 = 4 THEN 0.25 ELSE 0.5 END AS confidence,
  CASE doc_id % 6 WHEN 0 THEN 'doc ' || CAST(doc_id AS VARCHAR) WHEN 2 THEN left(text, 500) WHEN 3 THEN 'no confidence' WHEN 5 THEN '[1, 2]' ELSE '' END AS analysis,
  CASE WHEN doc_id % 6 IN (2, 5) THEN 'Parse error - manual review required' WHEN doc_id % 6 = 1 THEN json_extract_string(split_part(t, chr(10), 2), '$.conclusion') ELSE '' END AS conclusion,
  CASE WHEN doc_id % 6 = 0 THEN json_extract_string(t, '$.observations[0]') || '|' || json_extract_string(t, '$.observations[1]') WHEN doc_id % 6 IN (2, 5) THEN 'Failed to parse LLM response' ELSE '' END AS observations
FROM resp""")
def response_parse(spark, sf):
    d = table(spark, sf, "documents")
    k, i = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit('{"confidence": 0.'), (F.col("doc_id") % 90 + 10).cast("string"), F.lit(', "analysis": "doc '), i,
                                F.lit('", "observations": ["'), "lang", F.lit('", "'), "source", F.lit('"]}')))
        .when(k == 1, F.concat(F.lit('```json\n{"confidence": 0.5, "conclusion": "'), "source", F.lit('"}\n```')))
        .when(k == 2, F.col("text")).when(k == 3, F.lit('{"analysis": "no confidence"}'))
        .when(k == 4, F.lit('  {"confidence": "0.25"}')).otherwise(F.lit("[1, 2]")))
    r = d.select("doc_id", text.parse_response(raw, F.lit("m")).alias("r"))
    return r.select("doc_id", "r.confidence", "r.analysis", "r.conclusion", F.array_join("r.observations", "|").alias("observations"))


@query("formatted_numbers", with_ctes(DECISIONS_SQL) + f"""
SELECT id, {PCT_SQL} AS whole, printf('%.4f', confidence) AS four, strftime("timestamp", '%H:%M:%S') AS clock FROM decisions""")
def formatted_numbers(spark, sf):
    c = F.col("reasoning.confidence")
    return decisions(spark, sf).select("id", pct(c).alias("whole"), fixed(c, 4).alias("four"), F.date_format("timestamp", "HH:mm:ss").alias("clock"))


@query("ids_and_names", """
SELECT o_orderkey, 'pipe-' || substr(sha256(CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus), 1, 8) AS trace_id, left(lower(replace('Svc_' || o_orderpriority, '_', '-')), 40) AS service,
  CASE o_orderstatus WHEN 'F' THEN 900 WHEN 'O' THEN 3600 ELSE 45 END::BIGINT AS seconds, CAST(CASE o_orderstatus WHEN 'F' THEN 0.05 WHEN 'O' THEN 0.125 END AS DOUBLE) AS share FROM orders""")
def ids_and_names(spark, sf):
    o = table(spark, sf, "orders")
    s = F.col("o_orderstatus")
    return o.select(
        "o_orderkey", text.short_id(F.col("o_orderkey"), s, length=8, prefix="pipe-").alias("trace_id"),
        text.service_name(F.concat(F.lit("Svc_"), "o_orderpriority")).alias("service"),
        text.duration_seconds(F.when(s == "F", "15m").when(s == "O", "1h").otherwise("45s")).alias("seconds"),
        text.percent_fraction(F.when(s == "F", "5%").when(s == "O", "12.5%").otherwise("none")).alias("share"))


