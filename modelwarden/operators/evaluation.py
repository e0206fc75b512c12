"""Model quality from prediction rows, and comparisons of experiment runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwarden.operators.ordered import SLICE_ROWS, scan

# Metric that decides between runs, in order of preference.
PRIMARY_METRICS = ["f1", "f1_score", "auc_roc", "auc", "accuracy"]


def class_metrics(predictions: DataFrame, keys: Sequence[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 per key; an undefined ratio is 0."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    counts = predictions.groupBy(*keys).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
    )

    def ratio(x, n):
        return F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        counts.withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
    )


def roc_auc(
    predictions: DataFrame, keys: Sequence[str], label: str = "label", score: str = "score", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """ROC AUC by rank sums over per-score counts (ties count half); NULL when a class is missing."""
    keys = list(keys)
    y = F.col(label) == 1
    counts = predictions.groupBy(*keys, score).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    by = keys or ["_all"]
    counts = counts if keys else counts.withColumn("_all", F.lit(0))
    cum = scan(counts, by, [score], sums={"cneg": "neg"}, slice_rows=slice_rows)
    wins = F.col("pos") * (F.col("cneg") - F.col("neg") + F.col("neg") / 2)
    out = cum.groupBy(*by).agg(
        F.sum(wins).alias("_u"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")
    )
    auc = F.try_divide(F.col("_u"), F.col("positives").cast("double") * F.col("negatives"))
    return out.select(*keys, "positives", "negatives", auc.alias("auc_roc"))


def parity(predictions: DataFrame, keys: Sequence[str], group: str, pred: str = "pred") -> DataFrame:
    """Demographic parity difference: widest gap in positive-prediction rate between groups."""
    rates = predictions.groupBy(*keys, group).agg(F.avg((F.col(pred) == 1).cast("double")).alias("rate"))
    return rates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("groups"), (F.max("rate") - F.min("rate")).alias("fairness_delta")
    )


def split_rates(rows: DataFrame, split: str, label: str = "label") -> DataFrame:
    """Row count and positive rate per split."""
    return rows.groupBy(split).agg(
        F.count(F.lit(1)).alias("num_rows"), F.avg((F.col(label) == 1).cast("double")).alias("positive_rate")
    )


def class_distribution(predictions: DataFrame, keys: Sequence[str], predicted: str = "predicted_class") -> DataFrame:
    """Map predicted class -> count per key, from counts (not rows) per class."""
    counts = predictions.groupBy(*keys, predicted).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(predicted, "n")))).alias("predictions")
    )


def accuracy_drop(predictions: DataFrame, keys: Sequence[str], is_base: Column, label="label", pred="pred") -> DataFrame:
    """Baseline and current accuracy and their difference per key."""
    hit = (F.col(label) == F.col(pred)).cast("double")
    return predictions.groupBy(*keys).agg(
        F.avg(F.when(is_base, hit)).alias("baseline_accuracy"), F.avg(F.when(~is_base, hit)).alias("current_accuracy")
    ).withColumn("accuracy_drop", F.col("baseline_accuracy") - F.col("current_accuracy"))


def run_metrics_long(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", F.explode("metrics").alias("metric", "value"))


def metric_keys(runs: DataFrame) -> DataFrame:
    """Metric names that occur in any run, sorted."""
    return runs.select(F.explode(F.map_keys("metrics")).alias("metric")).distinct().orderBy("metric")


def compare_runs(runs: DataFrame, run_ids: list[str]) -> DataFrame:
    """Metric x run matrix of the requested runs; missing ids are skipped, a missing metric is 0.0."""
    chosen = runs.where(F.col("run_id").isin(run_ids))
    matrix = run_metrics_long(chosen).groupBy("metric").pivot("run_id", run_ids).agg(F.first("value"))
    return matrix.fillna(0.0).orderBy("metric")


def comparison_long(runs: DataFrame, requested: DataFrame) -> DataFrame:
    """Long form of the matrix for any number of comparisons: requested is (comparison_id, run_id, pos).

    One row per (comparison, metric, run), absent metrics as 0.0.
    """
    picked = requested.join(runs.select("run_id", "metrics"), "run_id")
    names = picked.select("comparison_id", F.explode(F.map_keys("metrics")).alias("metric")).distinct()
    return picked.join(names, "comparison_id").select(
        "comparison_id", "metric", "run_id",
        F.coalesce(F.try_element_at("metrics", "metric"), F.lit(0.0)).alias("value"),
    )


def best_run(runs: DataFrame, requested: DataFrame) -> DataFrame:
    """Best run per comparison by its primary metric.

    Primary metric: the first of PRIMARY_METRICS that any run has, else the smallest name. A run
    without it counts as 0; ties go to the run requested first; no best if the first run has no metrics.
    """
    picked = requested.join(runs.select("run_id", "metrics"), "run_id")
    rank = F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(m) for m in PRIMARY_METRICS]), F.col("m")), F.lit(0)), F.lit(99)
    )
    primary = (
        picked.select("comparison_id", F.explode(F.map_keys("metrics")).alias("m"))
        .groupBy("comparison_id").agg(F.min_by("m", F.struct(rank, F.col("m"))).alias("primary_metric"))
    )
    value = F.coalesce(F.try_element_at("metrics", "primary_metric"), F.lit(0.0))
    return (
        picked.join(primary, "comparison_id").groupBy("comparison_id")
        .agg(
            F.first("primary_metric").alias("primary_metric"),
            F.max_by(F.struct("run_id", value.alias("v")), F.struct(value, -F.col("pos"))).alias("_b"),
            F.min_by(F.size("metrics"), F.col("pos")).alias("_first"),
            F.count(F.lit(1)).alias("runs_compared"),
        )
        .where("_first > 0")
        .select("comparison_id", "primary_metric", "runs_compared", F.col("_b.run_id").alias("best_run_id"),
                F.col("_b.v").alias("best_value"))
    )


def list_runs(runs: DataFrame, experiment: str, limit: int = 20) -> DataFrame:
    """Runs of one experiment, run id descending."""
    return runs.where(F.col("experiment_name") == experiment).orderBy(F.desc("run_id")).limit(limit)
