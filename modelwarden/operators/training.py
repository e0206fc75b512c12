"""Training and batch scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwarden.operators.evaluation import class_metrics, roc_auc
from modelwarden.operators.forest import CellForest, class_probabilities
from modelwarden.session import materialise

#: Tasks per core of a training pass: enough to even out slower ones, few enough as each sums a table of all nodes.
TASKS_A_CORE = 3


def balance_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Class weights n / (classes * n_class) per label value."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    total = rows.agg(F.count(F.lit(1)) / F.count_distinct(label)).scalar()
    return counts.select(label, (total / F.col("_nc")).alias("weight"))


def hash_split(rows: DataFrame, key: str, train_percent: int = 80, slot: Column | None = None) -> DataFrame:
    """Adds `split` (train / test) from a hash of the key, the same in every run."""
    s = slot if slot is not None else F.pmod(F.xxhash64(key), F.lit(100))
    return rows.withColumn("split", F.when(s < train_percent, "train").otherwise("test"))


def position_split(rows: DataFrame, order: Sequence[str], train_share: float = 0.8) -> DataFrame:
    """First share of the rows in the given order is train, the rest test.

    Rows are dealt by range of the order and written with their range's number; a row's position is the number of rows in
    earlier ranges (one count per range) plus its place in its own range, so no task sees all rows.
    """
    order = list(order)
    ranged = materialise(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = sorted(ranged.groupBy("_range").agg(F.count(F.lit(1))).collect())  # a row per shuffle partition
    before, total = [], 0
    for number, n in counts:
        before.append((number, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "_range int, _before bigint")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    split = F.when(F.col("_before") + place <= int(total * train_share + 1e-9), "train").otherwise("test")
    return ranged.join(F.broadcast(offsets), "_range").withColumn("split", split).select(*rows.columns, "split")


def stratified_split(rows: DataFrame, label: str, key: str, train_share: float = 0.8, order: Column | None = None, **kwargs) -> DataFrame:
    """The same share of each label goes to train, chosen by hash order of the key."""
    from modelwarden.operators.ordered import scan

    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    hashed = rows.withColumn("_h", order if order is not None else F.xxhash64(key))
    numbered = scan(hashed, [label], ["_h", key], position="_pos", **kwargs).drop("_h")
    return numbered.join(sizes, label).withColumn(
        "split", F.when(F.col("_pos") <= F.floor(F.col("_n") * train_share), "train").otherwise("test")
    ).drop("_pos", "_n")


def class_sample(rows: DataFrame, label: str, key: str, shares: dict[object, float], seed: int = 42, **kwargs) -> DataFrame:
    """A share of the rows of every class named in `shares`, all together in one seeded order, with their `position` in it.

    The order is that of a hash of seed and key, so a sample can be repeated; classes are numbered slice by slice, and so is the
    whole, hence no task sees a class or the sample as one. Other classes are left out.
    """
    from modelwarden.operators.ordered import scan

    wanted = F.coalesce(*(F.when(F.col(label) == v, F.lit(float(s))) for v, s in shares.items()), F.lit(None))
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    hashed = rows.withColumns({"_share": wanted, "_drawn": drawn}).where("_share IS NOT NULL")
    sizes = hashed.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    numbered = scan(hashed, [label], ["_drawn", key], position="_place", **kwargs).join(F.broadcast(sizes), label)  # a row per share
    chosen = numbered.where(F.col("_place") <= F.floor(F.col("_n") * F.col("_share"))).withColumn("_all", F.lit(0))
    return scan(chosen, ["_all"], ["_drawn", key], position="position", **kwargs).select(*rows.columns, "position")


def deal(rows: DataFrame) -> DataFrame:
    """The same rows in partitions of equal size, some for every core: a file gives one a row group, however many rows it has."""
    return rows.repartition(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism)


def train_forest(
    rows: DataFrame, features: Sequence[str], label: str = "label", trees: int = 100, depth: int = 10,
    min_instances: int = 5, seed: int = 42,
) -> PipelineModel:
    """Random forest with balanced class weights.

    Spark limits rows per child node where the usual setting limits rows per split node; `min_instances`
    is the nearest control. Every level of the trees is a pass over the rows, so they are dealt evenly first.
    """
    weights = balance_weights(rows, label)  # one row per class
    weighted = deal(rows.select(label, *features)).join(F.broadcast(weights), label)
    forest = CellForest(features, label, "weight", trees, depth, min_instances, seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), forest]).fit(weighted)


def score(model: PipelineModel, rows: DataFrame, version: str) -> DataFrame:
    """Adds pred, class probabilities, positive-class score and the model version. Batch or streaming."""
    if (votes := class_probabilities(model, rows)) is not None:
        out = rows.withColumn("probabilities", votes)
        best = F.array_position("probabilities", F.array_max("probabilities")) - 1
        return out.withColumns({"pred": best.cast("int"), "score": F.col("probabilities")[1], "model_version": F.lit(version)})
    out = model.transform(rows).withColumn("probabilities", vector_to_array("probability"))
    return (
        out.withColumn("pred", F.col("prediction").cast("int")).withColumn("score", F.col("probabilities")[1])
        .withColumn("model_version", F.lit(version)).drop("features", "rawPrediction", "probability", "prediction")
    )


def score_batches(
    rows: DataFrame, features: Sequence[str], load_model: Callable[[], Callable], version: str, output: str = "score"
) -> DataFrame:
    """Score with any Python model: `load_model()` runs once per task and returns a function from a 2-D
    float array to one score per row. Rows travel in Arrow batches; nothing is shuffled."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = load_model()
        for columns in batches:
            yield pd.Series(model(np.column_stack([c.to_numpy(dtype=float) for c in columns])))

    return rows.withColumn(output, run(*features)).withColumn("model_version", F.lit(version))


def holdout_metrics(scored: DataFrame, keys: Sequence[str] = ("model_version",)) -> DataFrame:
    """Accuracy, precision, recall, F1 and AUC per model version from scored test rows, which are scored once."""
    scored = materialise(scored.select(*keys, "label", "pred", "score"), "scored")
    return class_metrics(scored, keys).join(roc_auc(scored, keys), list(keys))


