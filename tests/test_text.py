import pytest
from pyspark.sql import functions as F

from modelwarden.functions import maps, numbers, patterns, text
from modelwarden.operators.routing import job_status


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(col.alias("x")).first().x


@pytest.mark.parametrize("value,digits,want", [(0.925, 0, "92%"), (0.935, 0, "94%"), (0.45, 0, "45%"), (0.0125, 2, "1.25%"), (0.333, 1, "33.3%")])
def test_percent_ties_to_even(spark, value, digits, want):
    assert one(spark, numbers.pct(F.lit(value), digits)) == want


def test_numbers(spark):
    assert one(spark, numbers.signed(F.lit(0.013), 4)) == "+0.0130"
    assert one(spark, numbers.safe_ratio(F.lit(3), F.lit(0))) == 3.0
    assert abs(one(spark, numbers.relative_improvement(F.lit(0.5), F.lit(0.0))) - 50000) < 1e-6
    assert one(spark, numbers.clip(F.lit(30), 0, 23)) == 23


@pytest.mark.parametrize("name,pattern,want", [
    ("model.trained", "model.*", True), ("model.deploy.canary", "model.*", True), ("data.validated", "model.*", False),
    ("pipeline.failed", "*.failed", True), ("a.b", "a?b", True), ("ab", "a?b", False), ("v1", "v[0-9]", True),
    ("vx", "v[!0-9]", True), ("v1", "v[!0-9]", False), ("modelXtrained", "model.trained", False), ("a[b", "a[b", True),
    ("a*c", "a[*]c", True), ("abc", "a[*]c", False), ("a\nb", "a*b", True),
])
def test_glob(spark, name, pattern, want):
    assert one(spark, patterns.glob_match(F.lit(name), pattern)) is want
    assert one(spark, patterns.glob_match(F.col("n"), F.col("p")), n=name, p=pattern) is want


@pytest.mark.parametrize("action,want", [
    ("model.deploy", True), ("model.deploy.canary.blue", True), ("model.deployed", False), ("model.rollback", True),
    ("model.evaluate", False)])
def test_scopes(spark, action, want):
    assert one(spark, patterns.scope_allows(F.lit(action), ["model.deploy.**", "model.rollback"])) is want
    assert one(spark, patterns.scope_allows(F.lit(action), []))


@pytest.mark.parametrize("raw,want", [
    ('{"confidence": 0.92, "analysis": "a", "observations": ["o1"]}', (0.92, "a", ["o1"])),
    ('```json\n{"confidence": 0.8, "analysis": "b"}\n```', (0.8, "b", [])),
    ("no json here", (0.0, "no json here", ["Failed to parse LLM response"])),
    ('{"analysis": "c"}', (0.5, "c", [])),
    ('{"confidence": "0.85"}', (0.85, "", [])),
    ("[1]", (0.0, "[1]", ["Failed to parse LLM response"])),
])
def test_parse_response(spark, raw, want):
    r = one(spark, text.parse_response(F.col("t"), F.lit("m")), t=raw)
    assert (r.confidence, r.analysis, r.observations) == want and r.model_used == "m"


def test_lines(spark):
    line = text.decision_line(F.lit("evaluation"), F.lit("model.evaluate"), F.lit(False), F.lit(0.925), F.lit(True))
    assert one(spark, line) == "[evaluation] model.evaluate -> NO-GO (confidence: 92%) [ESCALATED]"
    prompt = text.reasoning_prompt(F.array(F.lit("a"), F.lit("b")), F.lit("{}"), F.lit("x"), F.lit("y"))
    assert one(spark, prompt) == (
        "Agent: x\nAction: y\n\nObservations:\n- a\n- b\n\nContext:\n{}\n\nAnalyze these observations and produce your reasoning.")


def test_names(spark):
    assert one(spark, text.service_name(F.lit("My_Model" + "x" * 50))) == "my-model" + "x" * 32
    assert one(spark, text.stem(F.lit("a/b.c/data.v1.csv"))) == "data.v1"
    assert one(spark, text.suffix(F.lit("a/model.pkl"))) == ".pkl"
    assert one(spark, text.uri_bucket(F.lit("gs://b/k/x"))) == "b" and one(spark, text.uri_key(F.lit("gs://b/k/x"))) == "k/x"
    assert one(spark, text.duration_seconds(F.lit("15m"))) == 900 and one(spark, text.duration_seconds(F.lit("1h"))) == 3600
    assert one(spark, text.duration_seconds(F.lit("soon"))) is None
    assert one(spark, text.percent_fraction(F.lit("5%"))) == 0.05
    assert len(one(spark, text.short_id(F.lit("k"), length=8, prefix="pipe-"))) == 13
    assert one(spark, job_status(F.lit("JOB_STATE_PAUSED"))) == "running" and one(spark, job_status(F.lit("?"), "failed")) == "failed"


def test_maps(spark):
    m = F.create_map(F.lit("auc"), F.lit(0.9), F.lit("f1_score"), F.lit(0.8))
    assert one(spark, maps.first_key(m, "f1", "f1_score", default=0.0)) == 0.8
    assert one(spark, maps.first_key(m, "x", default=0.0)) == 0.0
    later = F.create_map(F.lit("auc"), F.lit(0.1))
    assert one(spark, maps.merge_later_wins(m, later)) == {"auc": 0.1, "f1_score": 0.8}
    assert one(spark, maps.keys_above(m, 0.8)) == ["auc"]
