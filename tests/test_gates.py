"""Gates around their thresholds, with equality and missing inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from modelwarden.operators import gates

QUALITY = ("dataset_name string, num_rows bigint, null_rates map<string,double>, schema_changes array<string>, "
           "psi_scores map<string,double>")


def test_data_gate(spark):
    df = spark.createDataFrame([
        ("ok", 5000, {"a": 0.01, "b": 0.03}, [], {"a": 0.05}),
        ("few", 50, None, None, None),
        ("nulls", 5000, {"email": 0.25, "phone": 0.02}, None, None),
        ("schema", 5000, None, ["column added"], None),
        ("drift", 5000, None, None, {"amount": 0.35}),
        ("nothing", None, None, None, None),
        ("edge", 100, {"a": 0.125}, [], {"a": 0.25}),
    ], QUALITY)
    out = {r.dataset_name: r for r in gates.data_gate(df, max_null_rate=0.125, max_psi=0.25).collect()}
    assert {k: r.approved for k, r in out.items()} == {
        "ok": True, "few": False, "nulls": False, "schema": False, "drift": False, "nothing": True, "edge": True}
    assert not out["few"].rows_ok and not out["drift"].drift_ok
    assert out["nulls"].null_violations == ["email: 25.0%"]
    assert out["drift"].psi_violations == ["amount: PSI=0.350"]
    assert out["few"].observations[1] == "Row count: 50 (BELOW minimum 100)"
    assert out["nothing"].observations == [
        "Dataset: nothing (0 rows)", "Row count: unknown (no row count provided)", "Schema: no changes detected",
        "Distribution drift: no PSI scores provided (skipping)"]


def test_report_takes_precedence(spark):
    df = spark.createDataFrame([
        ("a", 5, 47, 46, ["x"]), ("b", 5000, 20, 15, ["c1", "c2", "c3", "c4", "c5", "c6"]), ("c", 5000, None, None, None),
        ("d", 5000, 0, 0, []),
    ], "dataset_name string, num_rows bigint, total_checks int, passed_checks int, failed_checks array<string>")
    out = {r.dataset_name: r for r in gates.data_gate(df).collect()}
    assert {k: r.approved for k, r in out.items()} == {"a": True, "b": False, "c": True, "d": False}
    assert out["a"].observations == ["Validation report: 46/47 checks passed (98%)", "  Failed: x"]
    assert len(out["b"].observations) == 6


def _models(spark, data):
    return spark.createDataFrame(data, "model_name string, metrics map<string,double>")


def test_model_gate(spark):
    cand = _models(spark, [
        ("first", {"f1": 0.834}), ("zero", {"f1": 0.0}), ("up", {"f1": 0.834}), ("down", {"f1": 0.834}),
        ("small", {"f1_score": 0.834}), ("unfair", {"f1": 0.85, "fairness_delta": 0.08}), ("fair", {"f1": 0.85}),
        ("slow", {"f1": 0.85, "latency_p99_ms": 150.0}), ("exact", {"f1": 0.75, "demographic_parity_diff": -0.05}),
    ])
    champ = spark.createDataFrame([
        ("up", "v1", {"f1": 0.821}), ("down", "v1", {"f1": 0.85}), ("small", "v1", {"f1": 0.832}),
        ("unfair", "v2", {"f1": 0.8}), ("fair", "v2", {"f1": 0.8}), ("slow", "v2", {"f1": 0.8}), ("exact", "v9", {"f1": 0.5}),
    ], "model_name string, version string, metrics map<string,double>")
    out = {r.model_name: r for r in gates.model_gate(cand, champ, min_improvement=0.005).collect()}
    assert {k: r.approved for k, r in out.items()} == {
        "first": True, "zero": False, "up": True, "down": False, "small": False, "unfair": False, "fair": True,
        "slow": False, "exact": True}
    assert out["first"].action == "model.register" and out["zero"].action == "model.evaluate"
    assert abs(out["up"].improvement - 0.013) < 1e-9
    assert out["up"].observations == [
        "Current champion: up/v1 (F1: 0.8210)",
        "Candidate metrics - F1: 0.8340, Precision: 0.0000, Recall: 0.0000, AUC: 0.0000",
        "F1 delta: +0.0130 (+1.6%) vs champion", "Fairness: no fairness metrics provided (skipping check)"]
    exact = gates.model_gate(cand.where("model_name = 'exact'"), champ, min_improvement=0.25).first()
    assert exact.approved


def test_canary(spark):
    df = spark.createDataFrame([("a", 0.01, 15.0, 9), ("b", 0.15, 15.0, 9), ("c", 0.01, 500.0, 9), ("d", None, None, None),
                                ("e", 0.05, 200.0, 1)],
                               "endpoint_id string, error_rate double, latency_p99_ms double, request_count bigint")
    out = {r.endpoint_id: r for r in gates.canary_gate(df).collect()}
    assert {k: r.action.split(".")[-1] for k, r in out.items()} == {
        "a": "promote", "b": "rollback", "c": "rollback", "d": "rollback", "e": "promote"}
    assert "no data" in out["d"].observations[1]
    assert out["a"].observations[2:] == ["Error rate: 1.00% (max: 5.00%)", "Latency p99: 15.0ms (max: 200.0ms)"]


def test_canary_vs_baseline(spark, rows):
    df = spark.createDataFrame([("e", "b", 0.01), ("e", "c", 0.03), ("f", "b", 0.01), ("f", "c", 0.04), ("g", "c", 0.0)],
                               "endpoint_id string, version string, error_rate double")
    got = gates.canary_vs_baseline(df, "endpoint_id", "version", "b", "c")
    assert rows(got, "endpoint_id", "within_baseline") == [("e", True), ("f", False), ("g", False)]


def test_health(spark):
    df = spark.createDataFrame([
        ("ok", {"a": 0.08}, {"a": 0.5}, 0.95, 0.94, None), ("drift", {"amount": 0.35, "b": 0.1}, {"b": 0.001}, None, None, None),
        ("acc", None, None, 0.95, 0.88, None), ("err", None, None, None, None, 0.15),
        ("both", {"amount": 0.35}, None, 0.95, 0.88, 0.0), ("mild", {"amount": 0.35}, None, 0.95, 0.94, 0.0),
        ("edge", {"a": 0.2}, None, 0.75, 0.5, 0.1), ("gone", None, None, 0.9, None, None),
    ], "endpoint_id string, psi_scores map<string,double>, ks_p_values map<string,double>, baseline_accuracy double, "
       "current_accuracy double, error_rate double")
    out = {r.endpoint_id: r for r in gates.health_gate(df, accuracy_drop_threshold=0.05).collect()}
    assert {k: (r.severity, r.needs_retrain, r.approved) for k, r in out.items()} == {
        "ok": ("info", False, True), "drift": ("warning", False, False), "acc": ("critical", False, False),
        "err": ("critical", False, False), "both": ("critical", True, False), "mild": ("warning", False, False),
        "edge": ("critical", False, False), "gone": ("info", False, True)}
    assert out["drift"].drifted_features == ["amount"] and out["drift"].significant_drifts == ["b"]
    assert out["drift"].observations == [
        "Feature drift: 1/2 features drifted (max PSI: 0.350, threshold: 0.2)", "  Drifted: amount (PSI=0.350)",
        "KS test: 1/1 features statistically significant (p < 0.01)"]
    assert out["gone"].accuracy_drop is None
    assert gates.health_gate(df.where("endpoint_id = 'edge'"), accuracy_drop_threshold=0.25).first().approved


@pytest.fixture(scope="module")
def retrain_out(spark):
    df = spark.createDataFrame([
        ("few", "drift", ["a", "b"], 10, 0, 0.0, None), ("fb", "feedback", None, None, 100, None, None),
        ("skip", "feedback", None, None, 10, None, None), ("much", "drift", list("abcd"), 10, 0, None, None),
        ("tune", "drift", ["a"], 10, 75, None, None), ("plain", "drift", ["a"], 10, None, None, None),
        ("manual", None, None, None, None, None, None), ("edge", "drift", list("abc"), 10, 0, None, None),
        ("seg", "x", None, None, None, 0.02, [("s", 9, 0.5)]),
    ], "model_name string, trigger_source string, drifted_features array<string>, total_features int, feedback_count bigint, "
       "accuracy_drop double, error_patterns array<struct<segment:string,count:bigint,percentage:double>>")
    return {r.model_name: r for r in gates.retrain_gate(df).collect()}


def test_retrain(retrain_out):
    got = {k: (r.strategy, r.data_window) for k, r in retrain_out.items()}
    assert got == {
        "few": ("full_retrain", "recent_90d"), "fb": ("fine_tune", "recent_30d_plus_feedback"), "skip": ("skip", "none"),
        "much": ("full_retrain", "all"), "tune": ("fine_tune", "recent_30d_plus_feedback"),
        "plain": ("full_retrain", "recent_90d"), "manual": ("full_retrain", "recent_90d"),
        "edge": ("full_retrain", "recent_90d"), "seg": ("full_retrain", "recent_90d")}
    assert retrain_out["seg"].retrain_reasons == ["accuracy dropped 0.0200", "1 error patterns"]
    assert retrain_out["manual"].retrain_reasons == ["manual trigger"]
    assert not retrain_out["skip"].approved


def test_feedback_gate(spark):
    df = spark.createDataFrame([
        ("a", 60, 0, None, [("s1", 40, 0.67), ("s2", 20, 0.33)]), ("b", 20, 0, None, []), ("c", 30, 25, None, None),
        ("good", 60, 0, 0.8625, []), ("bad", 60, 0, 0.525, []),
    ], "model_name string, corrections_count bigint, flags_count bigint, avg_agreement double, "
       "error_patterns array<struct<segment:string,count:bigint,percentage:double>>")
    out = {r.model_name: r for r in gates.feedback_gate(df).collect()}
    assert {k: r.approved for k, r in out.items()} == {"a": True, "b": False, "c": True, "good": True, "bad": False}
    assert out["c"].total_feedback == 55
    assert out["a"].observations == [
        "Feedback received: 60 corrections, 0 flags", "Label quality: no agreement scores provided (skipping check)",
        "Error patterns: 2 systematic failure segments", "  Segment 's1': 40 corrections (67% of total)",
        "  Segment 's2': 20 corrections (33% of total)", "Sufficient feedback for retraining: 60 samples (threshold: 50)"]


def _decisions(spark, confidences):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(confidences)], "n int, c double")
    gated = gates.with_reasoning(
        df.withColumn("action", F.lit("model.evaluate")).withColumn("approved", F.lit(True))
        .withColumn("observations", F.array(F.lit("o"))), "evaluation")
    gated = gated.withColumn("reasoning", F.col("reasoning").withField("confidence", F.col("c")))
    return gates.as_decisions(gated, F.lit("t1"), F.lit(dt.datetime(2024, 1, 1)), [F.col("n")], {"model": F.lit("m")}, ["c"])


def test_escalation(spark):
    ds = _decisions(spark, [0.45, 0.7, 0.9])
    out = gates.escalate(ds, default=0.7).orderBy("reasoning.confidence").collect()
    assert [r.escalate_to_human for r in out] == [True, False, False]
    assert out[0].escalation_reason == "Confidence 45% below threshold 70% for stage 'evaluation'"
    assert gates.escalate(ds, {"evaluation": 0.95}, 0.5).where("escalate_to_human").count() == 3
    table = spark.createDataFrame([("evaluation", 0.8)], "agent_name string, confidence_threshold double")
    assert gates.escalate(ds, table).where("escalate_to_human").count() == 2
    twice = gates.escalate(gates.escalate(ds, default=0.5), default=0.99)
    assert "50%" in twice.where("reasoning.confidence = 0.45").first().escalation_reason


def test_events_and_rows(spark):
    ds = gates.escalate(_decisions(spark, [0.45, 0.9]))
    assert sorted(r.type for r in gates.result_events(ds).collect()) == ["human.escalation", "model.evaluate.approved"]
    assert sorted(r.reward_signal for r in gates.feedback_rows(ds.withColumn("approved", F.lit(False))).collect()) == [0.225, 0.45]
    assert gates.memory_rows(ds).where("title = 'model.evaluate: GO (90%)'").count() == 1
    assert gates.provenance_rows(ds).count() == 2


def test_error_rows_and_validity(spark):
    ds = _decisions(spark, [0.8, None, 1.5])
    good, bad = gates.split_valid(ds)
    assert (good.count(), bad.count()) == (1, 2)
    err = gates.error_decisions(ds, F.col("reasoning.confidence").isNull(), F.lit("boom"), "evaluation")
    row = err.where("escalate_to_human").collect()
    assert len(row) == 1 and row[0].reasoning.confidence == 0.0 and not row[0].approved
    assert row[0].escalation_reason == "Unhandled error in evaluation: boom"


def test_data_window(spark, rows):
    days = spark.sql("SELECT 'm' AS k, timestamp'2024-06-30' - make_interval(0,0,0,n) AS ts, n FROM (SELECT explode(array(0, 29, 30, 31, 90, 91)) AS n)")
    for label, want in {"all": 6, "recent_90d": 5, "recent_30d_plus_feedback": 3, "none": 0}.items():
        w = spark.createDataFrame([("m", label)], "k string, data_window string")
        assert gates.select_window(days, w, "k", "ts").count() == want
    a = spark.createDataFrame([(1, 0), (2, 0)], "id int, label int")
    b = spark.createDataFrame([(2, 1), (3, 1)], "id int, label int")
    assert rows(gates.training_rows(a, b, ["id"])) == [(1, 0, False), (2, 1, True), (3, 1, True)]
