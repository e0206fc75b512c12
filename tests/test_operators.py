"""Operators on small literal cases."""

import datetime as dt
import fnmatch
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from modelwarden.operators import audit, evaluation, feedback, joins, quality, registry, routing, serving, training


def ts(day, hour=0, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


# --- quality --------------------------------------------------------------------------------------
def _obs(spark, base, cur):
    rows = [("f", float(v), True) for v in base] + [("f", float(v), False) for v in cur]
    return spark.createDataFrame(rows, "feature string, value double, is_base boolean")


@pytest.mark.parametrize("slice_rows", [7, 10**6])
def test_drift_profile_by_hand(spark, slice_rows):
    base, cur = list(range(100)), [v + 40 for v in range(100)]
    r = quality.drift_profile(_obs(spark, base, cur), slice_rows=slice_rows).first()
    edges = [9, 19, 29, 39, 49, 59, 69, 79, 89]

    def share(xs, b):
        n = sum(1 for x in xs if sum(e < x for e in edges) == b)
        return max(n / len(xs), 1e-6)

    psi = sum((share(cur, b) - share(base, b)) * math.log(share(cur, b) / share(base, b)) for b in range(10))
    assert r.psi == pytest.approx(psi, rel=1e-9)
    assert r.ks_d == pytest.approx(0.4)
    ne = 50.0
    lam = (math.sqrt(ne) + 0.12 + 0.11 / math.sqrt(ne)) * 0.4
    p = 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * lam * lam) for j in range(1, 101))
    assert r.ks_p == pytest.approx(p, abs=1e-12)
    same = quality.drift_profile(_obs(spark, base, base), slice_rows=slice_rows).first()
    assert (same.psi, same.ks_d, same.ks_p) == (0.0, 0.0, 1.0)


def test_drift_without_current_rows(spark):
    r = quality.drift_profile(_obs(spark, [1, 2, 3], [])).first()
    assert (r.psi, r.ks_p, r.n_base, r.n_cur) == (None, None, 3, 0)


def test_psi_edges_and_categories(spark):
    wide = spark.range(1000).select((F.col("id") * 1.0).alias("a"))
    edges = quality.baseline_edges(wide, ["a"], k=2000).first().edges
    assert edges == [99.0, 199.0, 299.0, 399.0, 499.0, 599.0, 699.0, 799.0, 899.0]
    cat = spark.createDataFrame([("f", "x", True)] * 3 + [("f", "y", True)] + [("f", "x", False), ("f", "y", False)],
                                "feature string, value string, is_base boolean")
    want = (0.5 - 0.75) * math.log(0.5 / 0.75) + (0.5 - 0.25) * math.log(0.5 / 0.25)
    assert quality.psi_categorical(cat).first().psi == pytest.approx(want)


def test_null_rates_and_schema(spark, rows):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None), (4, "y")], "a int, b string")
    assert rows(quality.null_rates(df)) == [("a", 0.25), ("b", 0.5)]
    m = quality.null_rate_map(df).first()
    assert (m.num_rows, m.null_rates) == (4, {"a": 0.25, "b": 0.5})
    new = spark.createDataFrame([(1, 2.0)], "a bigint, c double")
    diff = quality.schema_diff(quality.schema_rows(df), quality.schema_rows(new))
    assert rows(diff, "column", "change") == [("a", "type_changed"), ("b", "removed"), ("c", "added")]
    assert "changed type of a: int -> bigint" in {r.description for r in diff.collect()}


# --- evaluation -----------------------------------------------------------------------------------
def test_metrics(spark):
    df = spark.createDataFrame([("m", 1, 1, 0.9), ("m", 1, 0, 0.4), ("m", 0, 1, 0.4), ("m", 0, 0, 0.1), ("z", 0, 0, 0.5)],
                               "model string, label int, pred int, score double")
    r = {x.model: x for x in evaluation.class_metrics(df, ["model"]).collect()}
    assert (r["m"].accuracy, r["m"].precision, r["m"].recall, r["m"].f1) == (0.5, 0.5, 0.5, 0.5)
    assert (r["z"].precision, r["z"].f1) == (0.0, 0.0)
    for slice_rows in (2, 10**6):
        auc = {x.model: x.auc_roc for x in evaluation.roc_auc(df, ["model"], slice_rows=slice_rows).collect()}
        assert auc == {"m": 0.875, "z": None}
    assert evaluation.roc_auc(df.where("model = 'm'"), []).first().auc_roc == 0.875


def test_auc_brute_force_on_hot_model(spark):
    df = spark.range(400).select(F.lit("m").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("int").alias("label"),
                                 (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(90)) / 90).alias("score"))
    data = df.collect()
    pos, neg = [r.score for r in data if r.label], [r.score for r in data if not r.label]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluation.roc_auc(df, ["k"], slice_rows=6).first().auc_roc == pytest.approx(want, rel=1e-12)


def _runs(spark, data):
    return spark.createDataFrame(data, "run_id string, experiment_name string, metrics map<string,double>")


def test_runs(spark, rows):
    runs = _runs(spark, [("r1", "e", {"f1": 0.8, "z": 1.0}), ("r2", "e", {"f1": 0.85}), ("r3", "e", {"acc": 0.1}), ("r4", "e", {})])
    m = {r.metric: r for r in evaluation.compare_runs(runs, ["r1", "r2", "zz"]).collect()}
    assert (m["f1"].r2, m["z"].r2, list(m)) == (0.85, 0.0, ["f1", "z"])
    req = spark.createDataFrame([("a", "r1", 0), ("a", "r2", 1), ("b", "r2", 0), ("b", "missing", 1), ("c", "r4", 0), ("c", "r1", 1),
                                 ("d", "r3", 0)], "comparison_id string, run_id string, pos int")
    assert rows(evaluation.best_run(runs, req), "comparison_id", "best_run_id", "primary_metric") == [
        ("a", "r2", "f1"), ("b", "r2", "f1"), ("d", "r3", "acc")]
    tie = _runs(spark, [("x", "e", {"auc": 0.5}), ("y", "e", {"auc": 0.5})])
    asked = spark.createDataFrame([("t", "y", 0), ("t", "x", 1)], "comparison_id string, run_id string, pos int")
    assert evaluation.best_run(tie, asked).first().best_run_id == "y"
    five = _runs(spark, [(f"r{i}", "e", {}) for i in range(5)])
    assert [r.run_id for r in evaluation.list_runs(five, "e", 3).collect()] == ["r4", "r3", "r2"]
    assert evaluation.list_runs(five, "none").count() == 0


# --- registry -------------------------------------------------------------------------------------
MODELS = "model_name string, version string, version_n int, stage string"


def test_champion(spark, rows):
    df = spark.createDataFrame([("a", "v1", 1, "none"), ("a", "v2", 2, "none"), ("b", "v1", 1, "none"), ("b", "v2", 2, "production"),
                                ("b", "v3", 3, "none"), ("c", "v9", 9, "none"), ("c", "v10", 10, "archived")], MODELS)
    assert rows(registry.champion(df), "model_name", "version") == [("a", "v2"), ("b", "v2"), ("c", "v10")]


def test_promotions(spark, rows):
    p = spark.createDataFrame([("a", "v1", "production", ts(1)), ("a", "v2", "production", ts(3)), ("a", "v2", "archived", ts(5)),
                               ("a", "v1", "staging", ts(6))], "model_name string, version string, stage string, ts timestamp")
    assert rows(registry.promotion_periods(p), "version", "valid_from", "valid_to", "stage_now") == [
        ("v1", ts(1), ts(3), "archived"), ("v2", ts(3), ts(5), "archived")]
    m = spark.createDataFrame([("a", "v1", 1, "none"), ("a", "v2", 2, "none"), ("a", "v3", 3, "none")], MODELS)
    assert rows(registry.apply_promotions(m, p), "version", "stage") == [("v1", "staging"), ("v2", "archived"), ("v3", "none")]
    cand = spark.createDataFrame([("a", ts(1), 1), ("a", ts(2), 2), ("a", ts(4), 3), ("a", ts(9), 4)],
                                 "model_name string, evaluated_at timestamp, row_id long")
    got = registry.champion_asof(cand, registry.promotion_periods(p), slice_rows=2)
    assert rows(got, "row_id", "champion_version") == [(1, "v1"), (2, "v1"), (3, "v2"), (4, None)]


def test_versions_and_retention(spark, rows):
    old = spark.createDataFrame([("a", "v1", 1, "none"), ("a", "v10", 10, "none")], MODELS)
    new = spark.createDataFrame([("a", ts(2)), ("a", ts(1)), ("b", ts(1))], "model_name string, created_at timestamp")
    assert rows(registry.assign_versions(new, old, ["created_at"]), "model_name", "created_at", "version", "stage") == [
        ("a", ts(1), "v11", "none"), ("a", ts(2), "v12", "none"), ("b", ts(1), "v1", "none")]
    df = spark.createDataFrame([("a", f"v{i}", i, ts(i)) for i in range(1, 6)] + [("b", "v1", 1, dt.datetime(2023, 1, 1))],
                               "model_name string, version string, version_n int, created_at timestamp")
    got = registry.expired_versions(df, F.lit(ts(10)))
    assert rows(got, "model_name", "version", "reason") == [("a", "v1", "count"), ("a", "v2", "count"), ("b", "v1", "age")]


# --- serving --------------------------------------------------------------------------------------
def test_endpoint_metrics(spark):
    df = spark.createDataFrame([("e", "200", float(i)) for i in range(1, 100)] + [("e", "503", 100.0), ("e", None, None)],
                               "endpoint_id string, response_code string, latency_ms double")
    for slice_rows in (9, 10**6):
        r = serving.endpoint_metrics(df, ["endpoint_id"], slice_rows=slice_rows).first()
        assert (r.request_count, r.error_count) == (101, 1)
        assert (r.latency_p50_ms, r.latency_p95_ms, r.latency_p99_ms) == (50.0, 95.0, 99.0)
        assert r.error_rate == pytest.approx(1 / 101)


def test_sessions_on_hot_key(spark, rows):
    df = spark.range(300).select(F.lit("u").alias("u"), "id", F.timestamp_seconds(F.col("id") * 10 + F.floor(F.col("id") / 50) * 100).alias("t"))
    for slice_rows in (11, 10**6):
        got = serving.sessions(df, ["u"], "t", "id", 60, slice_rows).collect()
        assert sorted(r.n_events for r in got) == [50] * 6


def test_traffic_and_canary(spark, rows):
    out = serving.assign_traffic(spark.range(100), F.col("id"), {"canary": 5, "stable": 95})
    assert rows(out.groupBy("version").count()) == [("canary", 5), ("stable", 95)]
    with pytest.raises(ValueError):
        serving.assign_traffic(spark.range(1), F.col("id"), {"a": 5})
    r = serving.canary_rows(spark.createDataFrame([("m", "v3")], "model_name string, version string")).first()
    assert (r.endpoint_name, r.canary_traffic_pct, r.traffic_split) == ("m-canary", 5, {"v3": 5})


# --- feedback -------------------------------------------------------------------------------------
def test_feedback(spark, rows):
    c = spark.createDataFrame([("m", s) for s, n in (("a", 15), ("b", 3), (None, 40)) for _ in range(n)], "model_name string, segment string")
    f = spark.createDataFrame([("m",)] * 2, "model_name string")
    pats = feedback.error_patterns(c, ["model_name"])
    assert rows(pats, "segment", "count") == [("a", 15), ("unknown", 40)]
    assert sum(r.percentage for r in pats.collect()) == pytest.approx(55 / 58)
    top = feedback.pattern_summary(pats, ["model_name"], 1).first()
    assert (top.pattern_count, [p.segment for p in top.top_patterns]) == (2, ["unknown"])
    t = feedback.totals(c, f, ["model_name"]).first()
    assert (t.corrections_count, t.flags_count, t.total_feedback, t.enough_for_retrain) == (58, 2, 60, True)
    few = c.where("segment = 'b'")
    assert feedback.error_patterns(few, ["model_name"]).count() == 0


# --- audit ----------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def trail(spark):
    data = [("t1", 1, "eval", True, 0.9, False), ("t1", 2, "deploy", False, 0.8, False), ("t2", 1, "eval", True, 0.4, True),
            ("t3", 5, "eval", True, 0.95, False)]
    df = spark.createDataFrame(data, "trace_id string, d int, agent_name string, approved boolean, c double, escalate_to_human boolean")
    reasoning = F.struct(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")).alias("observations"), F.lit("x" * 80).alias("conclusion"),
                         F.col("c").alias("confidence"))
    return df.select(
        F.concat("trace_id", F.lit("-"), F.col("d").cast("string")).alias("id"), "trace_id", "agent_name", F.lit("act").alias("action"),
        "approved", reasoning.alias("reasoning"), F.make_timestamp(F.lit(2024), F.lit(1), F.col("d"), F.lit(0), F.lit(0), F.lit(0)).alias("timestamp"),
        "escalate_to_human", F.lit(None).cast("string").alias("escalation_reason"))


def test_audit(trail, spark, rows):
    assert [r.id for r in audit.recent(trail, 2).collect()] == ["t3-5", "t1-2"]
    assert [r.id for r in audit.by_agent(trail, "eval", 2).collect()] == ["t3-5", "t2-1"]
    assert [r.id for r in audit.by_trace(trail, "t1").collect()] == ["t1-1", "t1-2"]
    shown = audit.display(audit.by_trace(trail, "t2")).first()
    assert (shown.decision, shown.confidence, len(shown.conclusion), shown.observations) == ("ESCALATED", "40%", 60, ["a", "b", "c"])
    assert rows(audit.trace_rollup(trail), "trace_id", "stages", "approved", "rejected", "escalated", "last_action") == [
        ("t1", 2, 1, 1, 0, "deploy/act"), ("t2", 1, 0, 0, 1, "eval/act"), ("t3", 1, 1, 0, 0, "eval/act")]
    assert [r.trace_id for r in audit.recent_status(trail, 50, 2).collect()] == ["t3", "t1"]
    outcome = audit.trace_outcome(trail)
    assert rows(outcome, "trace_id", "status") == [("t1", "failed"), ("t2", "escalated"), ("t3", "completed")]
    assert rows(audit.trace_outcome(trail, 1), "trace_id", "status")[2] == ("t3", "failed")
    assert rows(audit.completion_events(outcome), "type") == [("pipeline.completed",), ("pipeline.failed",)]
    assert audit.capped(trail, 1).count() == 3
    text = {r.trace_id: r.summary for r in audit.trace_text(trail, outcome).collect()}
    assert text["t1"] == ("Trace: t1 (failed)\n  [eval] act -> GO (confidence: 90%)\n  [deploy] act -> NO-GO (confidence: 80%)")


def test_pipeline_traces(trail, spark):
    head = spark.createDataFrame([("t1", "p", "failed"), ("t9", "q", "running")], "trace_id string, pipeline_name string, status string")
    head = head.withColumn("started_at", F.lit(ts(1))).withColumn("completed_at", F.lit(None).cast("timestamp"))
    for page_rows in (1, 100):
        got = audit.pipeline_traces(head, trail.select("trace_id", "timestamp", "id"), page_rows).collect()
        assert sum(len(r.decisions) for r in got) == 4
        by = {}
        for r in sorted(got, key=lambda r: r.page):
            by.setdefault(r.trace_id, (r.pipeline_name, r.status, []))[2].extend(d.id for d in r.decisions)
        assert by == {"t1": ("p", "failed", ["t1-1", "t1-2"]), "t9": ("q", "running", []), "t2": ("", "running", ["t2-1"]),
                      "t3": ("", "running", ["t3-5"])}


def test_lineage(spark, rows):
    links = spark.createDataFrame([(f"d{i}", f"d{i - 1}" if i else None) for i in range(9)] + [("x", "gone"), ("c1", "c2"), ("c2", "c1"), ("in", "c1")],
                                  "id string, parent string")
    got = {r.id: (r.root, r.depth, r.cyclic) for r in audit.lineage_roots(links).collect()}
    cyclic = {i: (None, None, True) for i in ("c1", "c2", "in")}
    assert got == {f"d{i}": ("d0", i, False) for i in range(9)} | {"x": ("x", 0, False)} | cyclic


def test_lineage_on_cycles_ends_with_the_chains(spark, monkeypatch):
    written = []
    plain = audit.materialise
    monkeypatch.setattr(audit, "materialise", lambda df, purpose, *more: written.append(purpose) or plain(df, purpose, *more))
    links = [(i, i ^ 1) for i in range(2000)] + [(5000, None)] + [(i, i - 1) for i in range(5001, 5006)]
    got = {r.id: (r.root, r.depth, r.cyclic) for r in audit.lineage_roots(spark.createDataFrame(links, "id int, parent int")).collect()}
    assert got == {i: (None, None, True) for i in range(2000)} | {5000 + i: (5000, i, False) for i in range(6)}
    assert len(written) <= 6  # not as many as the number of rows has bits


def test_payload(trail, spark, rows):
    entries = trail.select("trace_id", "timestamp", "id", F.create_map(F.lit("who"), F.col("agent_name"), F.col("agent_name"), F.col("id")).alias("payload"))
    got = {r.trace_id: r.payload for r in audit.final_payload(entries).collect()}
    assert got["t1"] == {"who": "deploy", "eval": "t1-1", "deploy": "t1-2"}
    kept = trail.withColumn("m", F.when(F.col("agent_name") == "eval", F.col("id")))
    assert rows(audit.carry_forward(kept, ["m"]), "id", "payload_m")[1] == ("t1-2", "t1-1")


# --- routing --------------------------------------------------------------------------------------
def test_routing(spark, rows):
    ev = spark.createDataFrame([(1, "model.trained"), (2, "model.deploy.canary"), (3, "data.validated"), (4, "pipeline.failed")], "id int, type string")
    log = spark.createDataFrame([("model.*", "a", "subscribe", 1), ("model.deploy.*", "a", "subscribe", 2), ("*.failed", "b", "subscribe", 3),
                                 ("data.*", "c", "subscribe", 4), ("data.*", "c", "unsubscribe", 5), ("data.*", "d", "subscribe", 6)],
                                "pattern string, handler string, op string, seq int")
    subs = routing.active_subscriptions(log)
    want = [(1, "model.*", "a"), (2, "model.*", "a"), (2, "model.deploy.*", "a"), (3, "data.*", "d"), (4, "*.failed", "b")]
    assert rows(routing.route_events(ev, subs), "id", "pattern", "handler") == want
    static = routing.route_static(ev, [(r.pattern, r.handler) for r in subs.collect()])
    assert rows(static, "id", "pattern", "handler") == want


def test_scopes(spark, rows):
    d = spark.createDataFrame([(1, "deployment", "model.deploy.canary"), (2, "deployment", "data.validate"), (3, "free", "any.thing")],
                              "id int, agent_name string, action string")
    sc = spark.createDataFrame([("deployment", "model.deploy.**"), ("deployment", "model.rollback")], "agent_name string, scope string")
    assert rows(routing.authorised(d, sc), "id") == [(1,), (3,)]
    assert rows(routing.violations(d, sc), "id") == [(2,)]


def test_stages(spark, rows):
    st = spark.createDataFrame([("validate", ["train"], ["alert_human"]), ("train", ["evaluate"], []), ("evaluate", [], ["train"])],
                               "stage string, on_success array<string>, on_failure array<string>")
    edges = routing.stage_edges(st)
    assert edges.count() == 4
    assert rows(routing.dangling(edges, st), "stage", "target") == [("validate", "alert_human")]
    d = spark.createDataFrame([(1, "validate", True, False), (2, "validate", False, False), (3, "train", False, False), (4, "train", True, True)],
                              "id int, stage string, approved boolean, escalate_to_human boolean")
    assert rows(routing.next_stage(d, st), "id", "next_stage") == [(1, "train"), (2, "alert_human"), (3, None), (4, None)]
    reach = routing.reachable(edges, st.where("stage = 'validate'"))
    assert rows(reach, "target", "depth") == [("alert_human", 1), ("evaluate", 2), ("train", 1), ("validate", 0)]
    assert rows(routing.on_cycle(edges), "stage") == [("evaluate",), ("train",)]
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (6, 7), (8, 1), (9, 9), (9, 10), (2, 11), (11, 2)]
    graph = spark.createDataFrame(pairs, "stage int, target int")
    assert rows(routing.on_cycle(graph), "stage") == [(i,) for i in (1, 11, 2, 3, 5, 6, 9)]
    assert routing.on_cycle(graph.where("stage > 9")).count() == 0


def test_rings_in_a_row_take_few_rounds(spark, rows, monkeypatch):
    written = []
    plain = routing.materialise
    monkeypatch.setattr(routing, "materialise", lambda df, purpose, *more: written.append(purpose) or plain(df, purpose, *more))
    pairs = [p for i in range(0, 40, 2) for p in ((i, i + 1), (i + 1, i), (i, i + 2))]  # 20 rings, then a stage off all cycles
    got = rows(routing.cycle_parts(spark.createDataFrame(pairs, "stage int, target int")), "stage", "part")
    assert sorted(got) == [(i, i - i % 2) for i in range(40)]
    assert len(written) < 60  # one ring a round took well over a hundred


def test_reach_counts_match_plain_search(spark):
    rng = random.Random(3)
    graphs = [[(1, 1)], [(i, i + 1) for i in range(12)] + [(12, 9)], [(0, k) for k in range(1, 30)] + [(k, 99) for k in range(1, 30)]]
    graphs += [[(rng.randrange(n), rng.randrange(n)) for _ in range(m)] for n, m in ((40, 45), (60, 70), (30, 90))]
    pairs = [(1000 * g + a, 1000 * g + b) for g, edges in enumerate(graphs) for a, b in edges]
    after, want = {}, {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())
    for root in after:
        seen, todo = {root}, [root]
        while todo:
            for b in after[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        want[root] = seen
    got = {r.stage: (r.part, r.n_reachable) for r in routing.reach_counts(spark.createDataFrame(pairs + [(5, None), (None, 5)], "stage int, target int")).collect()}
    assert got == {a: (min(b for b in seen if a in want[b]), len(seen)) for a, seen in want.items()}
    assert routing.reach_counts(spark.createDataFrame([], "stage int, target int")).count() == 0


def test_delegations(spark, rows):
    a = spark.createDataFrame([("cicd", ts(1)), ("nobody", ts(1))], "agent_name string, granted_at timestamp")
    rows_ = routing.delegations(a, {"cicd": ["x", "y"]}, "orch")
    assert rows(rows_, "agent_name", "scope", "expires_at") == [("cicd", "x", ts(2)), ("cicd", "y", ts(2))]
    assert routing.active_delegations(rows_, F.lit(ts(1, 23))).count() == 2
    assert routing.active_delegations(rows_, F.lit(ts(2))).count() == 0


# --- joins and training ---------------------------------------------------------------------------
def test_range_join(spark, rows):
    p = spark.range(40).select(F.lit("k").alias("k"), "id")
    r = spark.createDataFrame([("k", 3, 3), ("k", 8, 17), ("k", 30, 99), ("k", 5, 4), ("j", 0, 99)], "k string, lo int, hi int")
    got = rows(joins.range_join(p, r, ["k"], F.col("id"), F.col("lo"), F.col("hi"), 5), "id", "lo")
    assert got == sorted([(i, lo) for lo, hi in ((3, 3), (8, 17), (30, 99)) for i in range(40) if lo <= i <= hi], key=repr)


def test_training(spark):
    df = spark.range(400).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"),
                                 ((F.col("id") % 10 == 0).cast("int") * 5 + F.pmod(F.xxhash64("id"), F.lit(3))).cast("double").alias("x"))
    w = {r.label: r.weight for r in training.balance_weights(df).collect()}
    assert w == {0: pytest.approx(400 / (2 * 360)), 1: pytest.approx(5.0)}
    split = training.stratified_split(df, "label", "id", slice_rows=25)
    assert {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()} == {
        (0, "train"): 288, (0, "test"): 72, (1, "train"): 32, (1, "test"): 8}
    assert training.position_split(df, ["id"]).where("split = 'train'").agg(F.max("id")).first()[0] == 319
    model = training.train_forest(split.where("split = 'train'"), ["x"], trees=3, depth=3)
    scored = training.score(model, split.where("split = 'test'"), "v1")
    m = training.holdout_metrics(scored).first()
    assert (m.f1, m.auc_roc, m.model_version) == (1.0, 1.0, "v1")


def test_forest_rows_are_dealt_to_all_cores(spark, monkeypatch):
    """Rows of one row group are one partition, which every pass over the trees' levels would read in one task."""
    monkeypatch.setattr(training.Pipeline, "fit", lambda self, rows: rows)
    one = spark.range(6000).coalesce(1).select((F.col("id") % 3 == 0).cast("int").alias("label"), F.col("id").cast("double").alias("x"))
    given = training.train_forest(one, ["x"])
    sizes = [r["count"] for r in given.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 1.1 * min(sizes)
    assert given.agg(F.sum("x"), F.count("weight")).first()[:] == (sum(range(6000)), 6000)


def test_class_sample_takes_shares_in_one_order(spark):
    df = spark.range(400).select("id", (F.col("id") % 4).cast("int").alias("label"))
    whole = training.class_sample(df, "label", "id", {0: 0.5, 1: 0.25, 9: 1.0})
    sliced = training.class_sample(df, "label", "id", {0: 0.5, 1: 0.25, 9: 1.0}, slice_rows=9)
    got = sorted((r.position, r.id, r.label) for r in whole.collect())
    assert got == sorted((r.position, r.id, r.label) for r in sliced.collect())
    assert [p for p, _, _ in got] == list(range(1, 76)) and [x for _, x, _ in got] != sorted(x for _, x, _ in got)
    assert (sum(c == 0 for *_, c in got), sum(c == 1 for *_, c in got)) == (50, 25)


def test_matching_equals_plain_match(spark):
    """10,000 patterns and 10,000 names against the plain match of every pair, on patterns of all shapes."""
    rng = random.Random(7)
    parts = ["model", "data", "deploy", "drift", "valid", "feed", "x1", "q", "[a]", "ok!"]

    def name():
        return ".".join(rng.choice(parts) + rng.choice(["", "", str(rng.randrange(400))]) for _ in range(rng.randint(1, 4)))

    def pattern():
        text, kind = name(), rng.randrange(10)
        if kind < 3:
            return text
        if kind < 8:
            chars = list(text)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(chars))
                chars[i : i + rng.randint(1, 4)] = rng.choice([["*"], ["?"], ["[dmq]"], ["[!x]"], ["[0-9]"]])
            return "".join(chars)
        return rng.choice(["*", "?*", "????", "[dm]*", "[!dm]*", "*.*", "*1*", "[", "[]x]*", "*[0-4]", ""]) + rng.choice(["", "", "*"])

    names, globs = sorted({name() for _ in range(14_000)})[:10_000] + [""], sorted({pattern() for _ in range(16_000)})[:10_000]
    assert len(names) > 9_000 and len(globs) > 8_000
    n = spark.createDataFrame([(x,) for x in names], "type string")
    found = routing.matching(n, spark.createDataFrame([(x,) for x in globs], "pattern string"))
    shape = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in shape and "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.pattern: r.n for r in found.groupBy("pattern").agg(F.count_distinct("type").alias("n")).collect()}
    assert found.count() == sum(got.values())
    want = {}
    for p in globs:
        rule = re.compile(fnmatch.translate(p))
        hits = sum(1 for x in names if rule.match(x))
        if hits:
            want[p] = hits
    assert got == want


@pytest.mark.parametrize("cells", [2, 512])
def test_exact_edges_of_any_spread(spark, cells):
    """Deciles by rank: ties, wide spread, both signs, nulls, one value, no value."""
    rng = random.Random(5)
    n = 4001
    cols = {
        "ties": [float(rng.randrange(4)) for _ in range(n)], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-200, 200) for _ in range(n)],
        "nulls": [rng.gauss(0, 1) if rng.random() < 0.1 else None for _ in range(n)], "one": [7.25] * n, "none": [None] * n,
        "huge": [rng.choice([-1.7e308, 1.7e308, 0.0, 5e-324]) for _ in range(n)]}
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols))
    got = {r.feature: r.edges for r in quality.exact_edges(df, list(cols), cells=cells).collect()}
    want = {}
    for c, values in cols.items():
        known = sorted(v for v in values if v is not None)
        if known:
            want[c] = [known[max(-(-i * len(known) // 10), 1) - 1] for i in range(1, 10)]
    assert got == want
