"""Decision gates: one output row per subject with action, approved and ordered observations.

Each gate adds columns to its input, so a gate costs no shuffle. Missing inputs are NULL and pass,
unless a gate says otherwise. Map inputs hold one entry per feature or field of the subject.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwarden.functions.maps import first_key, has_any_key, keys_above, keys_below, map_size, max_value
from modelwarden.functions.numbers import fixed, pct, relative_improvement, safe_ratio, signed
from modelwarden.functions.patterns import scope_allows
from modelwarden.functions.text import (
    compact, escalation_reason, memory_title, result_event_type, short_id, static_reasoning,
)

# Names that other stages and stored rows refer to.
SCOPES = {
    "cicd": ["data.validate", "pipeline.trigger", "test.run", "artifact.version"],
    "evaluation": ["model.evaluate", "model.compare", "model.register"],
    "deployment": ["model.deploy.**", "model.rollback"],
    "monitoring": ["metrics.collect", "drift.detect", "alert.send"],
    "retraining": ["model.retrain", "data.select", "experiment.configure"],
    "feedback": ["feedback.collect", "feedback.analyze", "label.validate"],
}
DEFAULT_CONFIDENCE = 0.7


def _opt(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _ok(flag: Column, bad: str) -> Column:
    return F.when(flag, F.lit("OK")).otherwise(F.lit(bad))


def _n(c: Column) -> Column:
    return c.cast("string")


def _arr(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _listed(names: Column, values: Column, digits: int, prefix: str = "", percent: bool = False) -> Column:
    def show(k):
        v = F.element_at(values, k)
        return F.concat(k, F.lit(": " + prefix), pct(v, digits) if percent else fixed(v, digits))

    return F.transform(names, show)


def data_gate(df: DataFrame, min_rows: int = 100, max_null_rate: float = 0.1, max_psi: float = 0.2) -> DataFrame:
    """Row count, null rates, schema changes and drift all within limits.

    Columns: dataset_name, and optionally dataset_version, num_rows, null_rates, schema_changes,
    psi_scores. Where a validation report is present (total_checks not NULL) `report_gate` decides.
    """
    rows = _opt(df, "num_rows", "bigint")
    nulls = _opt(df, "null_rates", "map<string,double>")
    psi = _opt(df, "psi_scores", "map<string,double>")
    schema = _arr(_opt(df, "schema_changes", "array<string>"))
    unknown = F.coalesce(rows <= 0, F.lit(True))
    bad_nulls, bad_psi = keys_above(nulls, max_null_rate), keys_above(psi, max_psi)
    rows_ok = unknown | (rows >= min_rows)
    nulls_ok, schema_ok, drift_ok = F.size(bad_nulls) == 0, F.size(schema) == 0, F.size(bad_psi) == 0
    out = (
        df.withColumn("null_violations", _listed(bad_nulls, nulls, 1, percent=True))
        .withColumn("psi_violations", _listed(bad_psi, psi, 3, "PSI="))
        .withColumn("rows_ok", rows_ok).withColumn("nulls_ok", nulls_ok)
        .withColumn("schema_ok", schema_ok).withColumn("drift_ok", drift_ok)
    )
    n_nulls, n_psi = map_size(nulls), map_size(psi)
    name = F.coalesce(F.nullif(F.col("dataset_name"), F.lit("")), F.lit("unknown"))
    messages = compact(
        F.concat(F.lit("Dataset: "), name, F.lit(" ("), _n(F.coalesce(rows, F.lit(0))), F.lit(" rows)")),
        F.when(unknown, F.lit("Row count: unknown (no row count provided)")).otherwise(
            F.concat(F.lit("Row count: "), _n(rows), F.lit(" ("), _ok(rows_ok, f"BELOW minimum {min_rows}"), F.lit(")"))),
        F.when(n_nulls > 0, F.concat(
            F.lit("Null rates: max "), pct(max_value(nulls), 1), F.lit(" across "), _n(n_nulls), F.lit(" fields ("),
            F.when(nulls_ok, F.lit("OK")).otherwise(F.concat(_n(F.size(bad_nulls)), F.lit(" violations"))), F.lit(")"))),
        F.when(~nulls_ok, F.concat(F.lit("Null violations: "), F.array_join("null_violations", ", "))),
        F.when(schema_ok, F.lit("Schema: no changes detected")).otherwise(
            F.concat(F.lit("Schema changes detected: "), F.array_join(schema, ", "))),
        F.when(n_psi > 0, F.concat(
            F.lit("Distribution drift: max PSI "), fixed(max_value(psi), 3), F.lit(" across "), _n(n_psi),
            F.lit(" fields ("), F.when(drift_ok, F.lit("OK")).otherwise(
                F.concat(_n(F.size(bad_psi)), F.lit(" drifted fields"))), F.lit(")"))
        ).otherwise(F.lit("Distribution drift: no PSI scores provided (skipping)")),
    )
    out = (
        out.withColumn("action", F.lit("data.validate"))
        .withColumn("approved", rows_ok & nulls_ok & schema_ok & drift_ok)
        .withColumn("observations", messages)
    )
    return _report_override(out) if "total_checks" in df.columns else out


def _report_parts(df: DataFrame, min_pass_rate: float):
    failed = _arr(_opt(df, "failed_checks", "array<string>"))
    rate = safe_ratio(F.col("passed_checks"), F.col("total_checks"))
    first = F.transform(F.slice(failed, 1, 5), lambda c: F.concat(F.lit("  Failed: "), c))
    head = F.concat(F.lit("Validation report: "), _n(F.col("passed_checks")), F.lit("/"), _n(F.col("total_checks")),
                    F.lit(" checks passed ("), pct(rate), F.lit(")"))
    return rate, rate >= min_pass_rate, F.concat(F.array(head), first)


def report_gate(df: DataFrame, min_pass_rate: float = 0.95) -> DataFrame:
    """Pass rate of a validation report; a report without checks has rate 0 and is rejected."""
    rate, approved, messages = _report_parts(df, min_pass_rate)
    return (
        df.withColumn("pass_rate", rate).withColumn("action", F.lit("data.validate"))
        .withColumn("approved", approved).withColumn("observations", messages)
    )


def _report_override(df: DataFrame, min_pass_rate: float = 0.95) -> DataFrame:
    rate, approved, messages = _report_parts(df, min_pass_rate)
    given = F.col("total_checks").isNotNull()
    return (
        df.withColumn("pass_rate", F.when(given, rate))
        .withColumn("approved", F.when(given, approved).otherwise(F.col("approved")))
        .withColumn("observations", F.when(given, messages).otherwise(F.col("observations")))
    )


def model_gate(
    candidates: DataFrame, champions: DataFrame, min_improvement: float = 0.005, max_fairness_delta: float = 0.05,
    max_latency_p99_ms: float = 100.0,
) -> DataFrame:
    """Candidate (model_name, metrics, ...) against the champion of its model (model_name, version, metrics).

    A first model needs F1 above 0 only. Otherwise: F1 gain, fairness gap and p99 latency within
    limits; an absent fairness or latency value passes.
    """
    ch = champions.select(
        "model_name", F.col("version").alias("champion_version"), F.col("metrics").alias("champion_metrics")
    )
    df = candidates.join(ch, "model_name", "left")
    m, cm = F.col("metrics"), F.col("champion_metrics")
    f1 = first_key(m, "f1", "f1_score", default=0.0)
    champ = first_key(cm, "f1", "f1_score", default=0.0)
    auc = first_key(m, "auc_roc", "auc", default=0.0)
    fair = first_key(m, "fairness_delta", "demographic_parity_diff", default=0.0)
    p99 = first_key(m, "latency_p99_ms", default=0.0)
    first = F.col("champion_version").isNull()
    gain = f1 - champ
    has_fair = F.coalesce(has_any_key(m, "fairness_delta", "demographic_parity_diff"), F.lit(False))
    fair_ok = ~has_fair | (F.abs(fair) <= max_fairness_delta)
    latency_ok = (p99 <= max_latency_p99_ms) | (p99 == 0)
    approved = F.when(first, f1 > 0).otherwise((gain >= min_improvement) & fair_ok & latency_ok)
    messages = compact(
        F.when(first, F.lit("No existing champion - this is the first model version")).otherwise(
            F.concat(F.lit("Current champion: "), "model_name", F.lit("/"), "champion_version", F.lit(" (F1: "),
                     fixed(champ, 4), F.lit(")"))),
        F.concat(F.lit("Candidate metrics - F1: "), fixed(f1, 4),
                 F.lit(", Precision: "), fixed(first_key(m, "precision", default=0.0), 4),
                 F.lit(", Recall: "), fixed(first_key(m, "recall", default=0.0), 4), F.lit(", AUC: "), fixed(auc, 4)),
        F.when(first, F.lit("First model - no champion comparison needed")).otherwise(
            F.concat(F.lit("F1 delta: "), signed(gain, 4), F.lit(" ("), signed(relative_improvement(f1, champ), 1),
                     F.lit("%) vs champion"))),
        F.when(has_fair, F.concat(F.lit("Fairness: demographic parity delta "), fixed(fair, 3), F.lit(" ("),
                                  _ok(fair_ok, "VIOLATION"), F.lit(f", threshold: {max_fairness_delta})")))
        .otherwise(F.lit("Fairness: no fairness metrics provided (skipping check)")),
        F.when(p99 > 0, F.concat(F.lit("Latency p99: "), fixed(p99, 1), F.lit("ms ("), _ok(latency_ok, "VIOLATION"),
                                 F.lit(f", SLA: {max_latency_p99_ms}ms)"))),
    )
    return (
        df.withColumn("is_first_model", first)
        .withColumn("improvement", F.when(first, F.lit(0.0)).otherwise(gain))
        .withColumn("fairness_ok", fair_ok).withColumn("latency_ok", latency_ok)
        .withColumn("action", F.when(first & (f1 > 0), "model.register").otherwise("model.evaluate"))
        .withColumn("approved", approved).withColumn("observations", messages)
    )


def canary_start(df: DataFrame, traffic_pct: int = 5) -> DataFrame:
    """Decision to start a canary: approved unless the deployment failed, which goes to a human.

    Columns: model_name, model_version, endpoint_id (empty if nothing served it), endpoint_status, error (null if none).
    """
    failed, served = F.col("error").isNotNull(), F.coalesce("endpoint_id", F.lit("")) != ""
    result = (
        F.when(failed, F.concat(F.lit("Canary deployment failed: "), "error"))
        .when(served, F.concat(F.lit("Canary endpoint created: "), "endpoint_id", F.lit(" (status: "), "endpoint_status", F.lit(")")))
        .otherwise("No serving backend: nothing was deployed"))
    head = F.concat(F.lit("Deploying "), "model_name", F.lit("/"), "model_version", F.lit(f" as canary ({traffic_pct}% traffic)"))
    return df.withColumns({
        "action": F.lit("model.deploy.canary"), "approved": ~failed, "observations": F.array(head, result),
        "artifacts": F.when(failed, F.create_map().cast("map<string,string>")).otherwise(F.create_map(
            F.lit("endpoint_id"), F.coalesce("endpoint_id", F.lit("")), F.lit("model_name"), F.col("model_name"),
            F.lit("model_version"), F.col("model_version"))),
        "metadata": F.when(failed, F.lit("{}")).otherwise(F.lit(f'{{"canary_traffic_pct":{traffic_pct}}}')),
        "escalate_to_human": failed,
        "escalation_reason": F.when(failed, F.concat(F.lit("Canary deployment failed: "), "error")),
    })


def rollback(df: DataFrame) -> DataFrame:
    """Decision to roll back an endpoint, approved whether or not its removal went well.

    Columns: endpoint_id, removed (boolean, null if nothing served it), error.
    """
    head = F.concat(F.lit("Rolling back endpoint: "), "endpoint_id")
    result = (F.when(F.col("error").isNotNull(), F.concat(F.lit("Rollback failed: "), "error"))
              .when(F.col("removed"), F.lit("Canary endpoint removed")))
    return df.withColumns({
        "action": F.lit("model.rollback"), "approved": F.lit(True), "observations": F.array_compact(F.array(head, result)),
        "artifacts": F.create_map(F.lit("endpoint_id"), F.col("endpoint_id")),
    })


def canary_gate(df: DataFrame, max_error_rate: float = 0.05, max_latency_p99_ms: float = 200.0) -> DataFrame:
    """Promote when error rate and p99 are within limits, else roll back. Missing metrics are not approved."""
    err, p99 = F.col("error_rate"), F.col("latency_p99_ms")
    known = err.isNotNull() & p99.isNotNull()
    err_ok = F.coalesce(err <= max_error_rate, F.lit(False))
    lat_ok = F.coalesce(p99 <= max_latency_p99_ms, F.lit(False))
    approved = err_ok & lat_ok
    messages = compact(
        F.concat(F.lit("Checking canary metrics for endpoint: "), F.col("endpoint_id").cast("string")),
        F.when(~known, F.lit("Could not fetch canary metrics: no data")),
        F.when(known, F.concat(F.lit("Requests: "), _n(F.coalesce(_opt(df, "request_count", "bigint"), F.lit(0))))),
        F.when(known, F.concat(F.lit("Error rate: "), pct(err, 2), F.lit(f" (max: {max_error_rate:.2%})"))),
        F.when(known, F.concat(F.lit("Latency p99: "), fixed(p99, 1), F.lit(f"ms (max: {max_latency_p99_ms}ms)"))),
    )
    return (
        df.withColumn("error_ok", err_ok).withColumn("latency_ok", lat_ok)
        .withColumn("action", F.when(approved, "model.deploy.promote").otherwise("model.deploy.rollback"))
        .withColumn("approved", approved).withColumn("observations", messages)
    )


def canary_vs_baseline(
    metrics: DataFrame, key: str, version: str, baseline: str, canary: str, multiplier: float = 3.0
) -> DataFrame:
    """Canary error rate at most `multiplier` times the baseline's, per endpoint.

    One aggregation pivots the two versions; the metrics are not joined with themselves.
    """
    def side(v, c):
        return F.max(F.when(F.col(version) == v, F.col(c)))

    out = metrics.groupBy(key).agg(
        side(baseline, "error_rate").alias("baseline_error_rate"), side(canary, "error_rate").alias("canary_error_rate"),
    )
    ok = F.coalesce(F.col("canary_error_rate") <= F.lit(multiplier) * F.col("baseline_error_rate"), F.lit(False))
    return out.withColumn("within_baseline", ok)


def health_gate(
    df: DataFrame, psi_threshold: float = 0.2, ks_p_value_threshold: float = 0.01,
    accuracy_drop_threshold: float = 0.05, error_rate_threshold: float = 0.1,
) -> DataFrame:
    """Drift and degradation of an endpoint: severity, retrain need, healthy or not.

    KS results are reported and do not change the decision. accuracy_drop is NULL unless both
    accuracies are known.
    """
    psi = _opt(df, "psi_scores", "map<string,double>")
    ks = _opt(df, "ks_p_values", "map<string,double>")
    base, cur = _opt(df, "baseline_accuracy", "double"), _opt(df, "current_accuracy", "double")
    err, p99 = _opt(df, "error_rate", "double"), _opt(df, "latency_p99_ms", "double")
    drifted, significant = keys_above(psi, psi_threshold), keys_below(ks, ks_p_value_threshold)
    drop = F.when((base > 0) & (cur > 0), base - cur)
    acc_ok = F.coalesce(drop <= accuracy_drop_threshold, F.lit(True))
    err_ok = F.coalesce(err <= error_rate_threshold, F.lit(True))
    drift, degraded = F.size(drifted) > 0, ~acc_ok | ~err_ok
    n_psi, n_ks = map_size(psi), map_size(ks)
    head = compact(
        F.when(err.isNotNull() & p99.isNotNull(), F.concat(
            F.lit("Endpoint "), F.col("endpoint_id").cast("string"), F.lit(": error_rate="), pct(err, 2),
            F.lit(", p99="), fixed(p99, 1), F.lit("ms"))),
        F.when(n_psi > 0, F.concat(
            F.lit("Feature drift: "), _n(F.size(drifted)), F.lit("/"), _n(n_psi), F.lit(" features drifted (max PSI: "),
            fixed(max_value(psi), 3), F.lit(f", threshold: {psi_threshold})")))
        .otherwise(F.lit("Feature drift: no PSI scores provided")),
    )
    each = F.transform(drifted, lambda f: F.concat(
        F.lit("  Drifted: "), f, F.lit(" (PSI="), fixed(F.element_at(psi, f), 3), F.lit(")")))
    tail = compact(
        F.when(n_ks > 0, F.concat(
            F.lit("KS test: "), _n(F.size(significant)), F.lit("/"), _n(n_ks),
            F.lit(f" features statistically significant (p < {ks_p_value_threshold})"))),
        F.when(drop.isNotNull(), F.concat(
            F.lit("Accuracy: "), fixed(cur, 4), F.lit(" (baseline: "), fixed(base, 4), F.lit(", drop: "),
            signed(drop, 4), F.lit(", "), _ok(acc_ok, "DEGRADED"), F.lit(")"))),
        F.when(err > 0, F.concat(
            F.lit("Error rate: "), pct(err, 2), F.lit(" ("), _ok(err_ok, "HIGH"),
            F.lit(f", threshold: {error_rate_threshold:.2%})"))),
    )
    return (
        df.withColumn("drifted_features", drifted).withColumn("significant_drifts", significant)
        .withColumn("accuracy_drop", drop)
        .withColumn("severity", F.when(degraded, "critical").when(drift, "warning").otherwise("info"))
        .withColumn("needs_retrain", drift & degraded)
        .withColumn("action", F.when(drift | degraded, "drift.detect").otherwise("metrics.collect"))
        .withColumn("approved", ~drift & ~degraded)
        .withColumn("observations", F.concat(head, each, tail))
    )


def retrain_gate(
    df: DataFrame, min_feedback_samples: int = 50, min_drifted_features: int = 1, full_retrain_drift_ratio: float = 0.3
) -> DataFrame:
    """Whether to retrain, why, and with which strategy and data window.

    A missing trigger source counts as manual, and a manual trigger always retrains. Error patterns come
    as `pattern_count`, or as an `error_patterns` array.
    """
    source = F.coalesce(_opt(df, "trigger_source", "string"), F.lit("manual"))
    drifted = _arr(_opt(df, "drifted_features", "array<string>"))
    total = F.coalesce(_opt(df, "total_features", "int"), F.lit(0))
    fb = F.coalesce(_opt(df, "feedback_count", "bigint"), F.lit(0))
    drop = F.coalesce(_opt(df, "accuracy_drop", "double"), F.lit(0.0))
    n_patterns, _ = _patterns(df)
    n = F.size(drifted)
    reasons = compact(
        F.when((n > 0) & (n >= min_drifted_features), F.concat(_n(n), F.lit(" features drifted"))),
        F.when((fb > 0) & (fb >= min_feedback_samples), F.concat(_n(fb), F.lit(" feedback samples"))),
        F.when(drop > 0, F.concat(F.lit("accuracy dropped "), fixed(drop, 4))),
        F.when(n_patterns > 0, F.concat(_n(n_patterns), F.lit(" error patterns"))),
        F.when(source == "manual", F.lit("manual trigger")),
    )
    go = F.size(reasons) > 0
    ratio = F.when(total > 0, safe_ratio(n, total)).otherwise(F.lit(0.0))
    strategy = (
        F.when(~go, "skip").when(ratio > full_retrain_drift_ratio, "full_retrain").when(fb > 0, "fine_tune")
        .otherwise("full_retrain")
    )
    window = (
        F.when(~go, "none").when(ratio > full_retrain_drift_ratio, "all").when(fb > 0, "recent_30d_plus_feedback")
        .otherwise("recent_90d")
    )
    messages = compact(
        F.concat(F.lit("Retrain trigger: "), source, F.lit(" for model '"), F.coalesce("model_name", F.lit("")), F.lit("'")),
        F.when(n > 0, F.concat(F.lit("Drift: "), _n(n), F.lit("/"), _n(total), F.lit(" features drifted ("),
                               pct(safe_ratio(n, total)), F.lit(")"))),
        F.when(fb > 0, F.concat(F.lit("Feedback: "), _n(fb), F.lit(" new labeled samples"))),
        F.when(drop > 0, F.concat(F.lit("Performance: accuracy dropped by "), fixed(drop, 4))),
        F.when(n_patterns > 0, F.concat(F.lit("Error patterns: "), _n(n_patterns), F.lit(" systematic failure patterns"))),
        F.when(~go, F.lit("Insufficient signal for retraining")),
        F.when(window == "all", F.concat(F.lit("Strategy: FULL RETRAIN (drift ratio "), pct(ratio),
                                         F.lit(f" > {full_retrain_drift_ratio:.0%} threshold)")))
        .when(strategy == "fine_tune", F.concat(F.lit("Strategy: FINE-TUNE on recent 30 days + "), _n(fb),
                                                F.lit(" feedback samples")))
        .when(go, F.lit("Strategy: FULL RETRAIN on recent 90 days")),
    )
    return (
        df.withColumn("retrain_reasons", reasons).withColumn("strategy", strategy).withColumn("data_window", window)
        .withColumn("action", F.lit("model.retrain")).withColumn("approved", go).withColumn("observations", messages)
    )


def _patterns(df: DataFrame) -> tuple[Column, Column | None]:
    """(number of error patterns, array that starts with the most frequent ones)."""
    if "pattern_count" in df.columns:
        return F.coalesce("pattern_count", F.lit(0)), F.col("top_patterns") if "top_patterns" in df.columns else None
    if "error_patterns" in df.columns:
        found = F.col("error_patterns")
        return F.when(found.isNull(), F.lit(0)).otherwise(F.size(found)), found
    return F.lit(0), None


def feedback_gate(df: DataFrame, min_samples: int = 50, min_agreement: float = 0.7) -> DataFrame:
    """Enough feedback and good label agreement; an absent agreement passes.

    Columns: corrections_count, flags_count, avg_agreement, and pattern_count with top_patterns (or an
    error_patterns array), all from the feedback operators.
    """
    c = F.coalesce(_opt(df, "corrections_count", "bigint"), F.lit(0))
    f = F.coalesce(_opt(df, "flags_count", "bigint"), F.lit(0))
    agree = _opt(df, "avg_agreement", "double")
    ok = F.coalesce(agree >= min_agreement, F.lit(True))
    total = c + f
    enough = total >= min_samples
    head = compact(
        F.concat(F.lit("Feedback received: "), _n(c), F.lit(" corrections, "), _n(f), F.lit(" flags")),
        F.when(agree.isNull(), F.lit("Label quality: no agreement scores provided (skipping check)")).otherwise(
            F.concat(F.lit("Label quality: avg agreement "), pct(agree), F.lit(" ("), _ok(ok, "LOW"),
                     F.lit(f", threshold: {min_agreement:.0%})"))),
    )
    middle = F.array().cast("array<string>")
    n, pats = _patterns(df)
    if pats is not None:
        found = F.array(F.concat(F.lit("Error patterns: "), _n(n), F.lit(" systematic failure segments")))
        lines = F.transform(F.slice(pats, 1, 3), lambda p: F.concat(
            F.lit("  Segment '"), p["segment"], F.lit("': "), _n(p["count"]), F.lit(" corrections ("),
            pct(p["percentage"]), F.lit(" of total)")))
        none = F.array(F.lit("Error patterns: no systematic failure segments detected"))
        middle = F.when(c == 0, middle).when(n > 0, F.concat(found, lines)).otherwise(none)
    tail = F.when(enough, F.concat(F.lit("Sufficient feedback for retraining: "), _n(total),
                                   F.lit(f" samples (threshold: {min_samples})"))).otherwise(
        F.concat(F.lit("Insufficient feedback: "), _n(total), F.lit(f" samples (need {min_samples})")))
    return (
        df.withColumn("total_feedback", total).withColumn("agreement_ok", ok).withColumn("enough_for_retrain", enough)
        .withColumn("action", F.lit("feedback.analyze")).withColumn("approved", enough & ok)
        .withColumn("observations", F.concat(head, middle, F.array(tail)))
    )


def window_start(label: Column, newest: Column) -> Column:
    """Start of a data window label; NULL for `all` (no limit). `none` has no rows at all."""
    return F.when(label == "recent_90d", newest - F.expr("INTERVAL 90 DAYS")).when(
        label == "recent_30d_plus_feedback", newest - F.expr("INTERVAL 30 DAYS"))


def select_window(rows: DataFrame, windows: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows inside each subject's data window (key, data_window), counted back from its newest row."""
    newest = rows.groupBy(key).agg(F.max(ts).alias("_newest"))
    limits = windows.select(key, "data_window").join(newest, key).withColumn(
        "_from", window_start(F.col("data_window"), F.col("_newest"))).where("data_window <> 'none'")
    kept = rows.join(limits.select(key, "data_window", "_from"), key)
    return kept.where(F.col("_from").isNull() | (F.col(ts) >= F.col("_from"))).drop("_from")


def training_rows(recent: DataFrame, feedback: DataFrame, keys: list[str]) -> DataFrame:
    """Recent rows together with feedback rows; a feedback row replaces a recent row with the same key."""
    from modelwarden.operators.ordered import latest_by

    both = recent.withColumn("_fb", F.lit(0)).unionByName(feedback.withColumn("_fb", F.lit(1)), allowMissingColumns=True)
    return latest_by(both, keys, ["_fb"]).withColumn("from_feedback", F.col("_fb") == 1).drop("_fb")


Reasoner = Callable[[Column, Column, Column], Column]


def with_reasoning(
    df: DataFrame, agent: str, proceed: bool = True, confidence: float = 0.9, reasoner: Reasoner | None = None
) -> DataFrame:
    """Adds agent_name and reasoning. Default: fixed dry-run reasoning.

    reasoner: (observations, agent, action) -> reasoning struct; a column function, or a pandas UDF
    that calls a model in Arrow batches.
    """
    if reasoner is None:
        def reasoner(observations, name, action):
            return static_reasoning(observations, name, action, proceed, confidence)

    made = reasoner(F.col("observations"), F.lit(agent), F.col("action"))
    return df.withColumn("agent_name", F.lit(agent)).withColumn("reasoning", made)


def decide(
    subjects: DataFrame, gate: Callable[[DataFrame], DataFrame], agent: str, *, trace_id: Column, timestamp: Column,
    id_parts: list[Column], scopes: list[str] | None = None, required: list[str] | None = None,
    artifacts: dict[str, Column] | None = None, metadata: list[str] | None = None, reasoner: Reasoner | None = None,
    thresholds: dict[str, float] | DataFrame | None = None, default: float = DEFAULT_CONFIDENCE,
) -> DataFrame:
    """Run any gate over its subjects and return finished decision rows.

    gate: a function that adds action, approved and observations. Subjects with a NULL in `required`, an
    action outside `scopes`, or a NULL outcome become error decisions; then low confidence escalates.
    """
    gated = with_reasoning(gate(subjects), agent, reasoner=reasoner)
    missing = F.lit(False)
    for c in required or []:
        missing = missing | F.col(c).isNull()
    outside = ~scope_allows(F.col("action"), scopes or [])
    problem = (
        F.when(missing, F.lit("missing input")).when(F.col("approved").isNull(), F.lit("no outcome"))
        .when(outside, F.concat(F.lit("lacks authority for "), "action"))
    )
    rows = as_decisions(gated.withColumn("_problem", problem), trace_id, timestamp, id_parts, artifacts, metadata, ["_problem"])
    failed = F.col("_problem").isNotNull() | F.col("reasoning.confidence").isNull()
    rows = error_decisions(rows, failed, F.coalesce("_problem", F.lit("unreadable reasoning")), agent).drop("_problem")
    return escalate(rows, thresholds, default)


def as_decisions(
    df: DataFrame, trace_id: Column, timestamp: Column, id_parts: list[Column], artifacts: dict[str, Column] | None = None,
    metadata: list[str] | None = None, extra: list[str] | None = None,
) -> DataFrame:
    """Gate output with reasoning to rows of the decision table."""
    pairs = [x for k, v in (artifacts or {}).items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))]
    return df.select(
        short_id(*id_parts).alias("id"),
        trace_id.alias("trace_id"),
        "agent_name", "action", "approved", "reasoning",
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("artifacts"),
        (F.to_json(F.struct(*metadata)) if metadata else F.lit("{}")).alias("metadata"),
        timestamp.alias("timestamp"),
        F.lit(False).alias("escalate_to_human"),
        F.lit(None).cast("string").alias("escalation_reason"),
        *(extra or []),
    )


def escalate(decisions: DataFrame, thresholds: dict[str, float] | DataFrame | None = None,
             default: float = DEFAULT_CONFIDENCE, confidence: Column | None = None) -> DataFrame:
    """Escalate decisions whose confidence is below their agent's threshold; earlier escalations stay.

    Thresholds are a plan-time dict, or a table (agent_name, confidence_threshold) joined on the agent.
    """
    conf = confidence if confidence is not None else F.col("reasoning.confidence")
    df = decisions
    if isinstance(thresholds, DataFrame):
        df = df.join(thresholds.select("agent_name", "confidence_threshold"), "agent_name", "left")
        limit = F.coalesce("confidence_threshold", F.lit(default))
    else:
        limit = F.lit(default)
        for agent, t in (thresholds or {}).items():
            limit = F.when(F.col("agent_name") == agent, F.lit(float(t))).otherwise(limit)
    low = (conf < limit) & ~F.col("escalate_to_human")
    out = df.withColumn(
        "escalation_reason",
        F.when(low, escalation_reason(conf, limit, F.col("agent_name"))).otherwise(F.col("escalation_reason")),
    ).withColumn("escalate_to_human", low | F.col("escalate_to_human"))
    return out.select(*decisions.columns)


def error_decisions(df: DataFrame, is_error: Column, message: Column, agent: str) -> DataFrame:
    """Turn failed rows of a decision frame into blocked, escalated decisions with confidence 0."""
    bad = F.coalesce(is_error, F.lit(True))
    reasoning = F.struct(
        F.array(F.concat(F.lit("Agent error: "), message)).alias("observations"),
        F.lit("Agent encountered an unhandled error during decision-making.").alias("analysis"),
        F.concat(F.lit("Blocking due to error: "), message).alias("conclusion"),
        F.lit(0.0).alias("confidence"),
        F.array().cast("array<string>").alias("alternatives_considered"),
        F.lit("error-handler").alias("model_used"),
    )
    changed = {
        "reasoning": F.when(bad, reasoning).otherwise(F.col("reasoning")),
        "approved": F.when(bad, F.lit(False)).otherwise(F.col("approved")),
        "escalation_reason": F.when(
            bad, F.concat(F.lit(f"Unhandled error in {agent}: "), message)).otherwise(F.col("escalation_reason")),
        "escalate_to_human": bad | F.col("escalate_to_human"),
    }
    return df.withColumns(changed)


def split_valid(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): confidence within [0, 1] and the required fields present."""
    ok = F.col("reasoning.confidence").between(0, 1)
    for c in ("id", "trace_id", "agent_name", "action", "approved", "timestamp"):
        ok = ok & F.col(c).isNotNull()
    ok = F.coalesce(ok, F.lit(False))
    return decisions.where(ok), decisions.where(~ok)


def result_events(decisions: DataFrame) -> DataFrame:
    """One result event per decision, in the event table's columns."""
    payload = F.to_json(F.struct(
        F.col("id").alias("decision_id"), "action", "approved", F.col("reasoning.confidence").alias("confidence"),
        F.col("reasoning.conclusion").alias("conclusion"), "artifacts", F.col("escalate_to_human").alias("escalated"),
    ))
    return decisions.select(
        short_id(F.lit("event"), F.col("id")).alias("id"),
        result_event_type(F.col("action"), F.col("approved"), F.col("escalate_to_human")).alias("type"),
        F.col("agent_name").alias("source"), payload.alias("payload"), "trace_id", "timestamp",
    )


def reward(approved: Column, confidence: Column) -> Column:
    return F.when(approved, confidence).otherwise(confidence * 0.5)


def provenance_rows(decisions: DataFrame) -> DataFrame:
    meta = F.to_json(F.struct(
        "trace_id", F.col("id").alias("decision_id"), "approved", "reasoning.confidence", "reasoning.conclusion",
        F.col("escalate_to_human").alias("escalated"), "artifacts"))
    return decisions.select("agent_name", "action", meta.alias("metadata"), "timestamp")


def feedback_rows(decisions: DataFrame) -> DataFrame:
    return decisions.select(
        "agent_name", "action", F.when(F.col("approved"), "success").otherwise("blocked").alias("result"),
        reward(F.col("approved"), F.col("reasoning.confidence")).alias("reward_signal"),
        F.col("reasoning.conclusion").alias("content"), "timestamp",
    )


def memory_rows(decisions: DataFrame) -> DataFrame:
    title = memory_title(F.col("action"), F.col("approved"), F.col("reasoning.confidence"))
    return decisions.select(
        "agent_name", title.alias("title"), F.col("reasoning.conclusion").alias("content"),
        F.lit("decision").alias("entry_type"),
        F.to_json(F.struct("trace_id", "reasoning.observations")).alias("metadata"), "timestamp",
    )
