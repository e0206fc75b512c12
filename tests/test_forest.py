"""The forest grown from cells: against brute force, against Spark's own, and whatever the partitions are."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from modelwarden.operators import forest, training


def noisy(spark, n, copies=1):
    """Two features of 20 and of many values; the label follows them but for a tenth of the rows."""
    u = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(10_000)) / 10_000
    one = spark.range(n).select("id", F.floor(u(1) * 20).cast("double").alias("few"), u(2).alias("many"), u(3).alias("noise"))
    y = (F.when(F.col("noise") < 0.1, F.col("noise") < 0.05).otherwise(F.col("few") / 20 + F.col("many") > 1.2)).cast("int")
    return one.withColumn("label", y).crossJoin(spark.range(copies).select(F.col("id").alias("copy"))).drop("noise")


def test_passes_read_cells_not_rows(spark, monkeypatch):
    """Rows alike in all bins are one cell, so fifty copies of the rows cost the passes nothing more; none is left out."""
    given = []
    grow = forest.grow
    monkeypatch.setattr(forest, "grow", lambda blocks, *rest: given.append(blocks.collect()) or grow(blocks, *rest))
    sizes = {}
    for copies in (1, 50):
        model = training.train_forest(noisy(spark, 2000, copies), ["few", "many"], trees=2, depth=2)
        rows = given.pop()
        counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows])
        sizes[copies] = len(counts)
        assert counts.sum() == 2000 * copies
        assert isinstance(model.stages[-1], RandomForestClassificationModel) and model.stages[-1].getNumTrees == 2
    assert max(sizes.values()) <= 20 * 32 * 2


def test_as_good_as_sparks_forest(spark):
    """Held-out quality next to that of Spark's forest with the same settings, and tests on rows as they come."""
    split = training.hash_split(noisy(spark, 20_000), "id")
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    ours = training.train_forest(train, ["few", "many"], trees=20, depth=6)
    weighted = train.join(F.broadcast(training.balance_weights(train)), "label")
    assemble = VectorAssembler(inputCols=["few", "many"], outputCol="features")
    spark_s = RandomForestClassifier(weightCol="weight", numTrees=20, maxDepth=6, minInstancesPerNode=5, seed=42).fit(assemble.transform(weighted))
    both = [training.holdout_metrics(training.score(m, rows, "v")).first() for m, rows in ((ours, test), (spark_s, assemble.transform(test)))]
    for name in ("accuracy", "f1", "auc_roc"):
        assert both[0][name] == pytest.approx(both[1][name], abs=0.01)


def test_same_forest_whatever_the_partitions(spark):
    rows = noisy(spark, 3000).select("label", "few", (F.floor(F.col("many") * 30) / 30).alias("many"))  # thresholds at quantiles are near ones
    texts = {training.train_forest(rows.repartition(n), ["few", "many"], trees=3, depth=4).stages[-1].toDebugString.partition("\n")[2]
             for n in (1, 7)}
    assert len(texts) == 1


def grown(rows, inputs, block, **settings):
    """Nodes, cuts and cells of a forest grown step by step."""
    names = [f"x{i}" for i in range(len(inputs))]
    rows = rows.select(F.col("label").cast("double"), *(F.col(c).cast("double").alias(n) for c, n in zip(inputs, names)))
    cuts = forest.cut_points(rows, names, 32)
    blocks, n = forest.cell_blocks(rows, cuts, block)
    weights = settings.pop("weights")
    return forest.grow(blocks, n, cuts, np.array(weights), **settings), cuts, blocks.collect()


def test_splits_are_the_best_of_the_sample(spark):
    """Every node's rows, and the gain of its split, against the tree's own sample held as one array."""
    weights = np.array([0.7, 1.9])
    for block in (1 << 20, 300):  # a block, and several whose sums are added
        trees, cuts, blocks = grown(noisy(spark, 4000), ["few", "many"], block, weights=weights, trees=2, depth=5, min_instances=5, seed=42)
        assert (len(blocks) > 1) == (block == 300)
        cells = [forest.Cells(r.asDict(), 2, 2, 32) for r in blocks]
        bins = np.concatenate([np.frombuffer(r["bins"], np.uint8).reshape(2, -1) for r in blocks], axis=1)
        labels = np.concatenate([c.labels for c in cells])
        for t, tree in enumerate(trees):
            bag = np.concatenate([c.bag(t, 42) for c in cells])
            inside = {0: np.ones(len(bag), bool)}
            for i in range(len(tree["feature"])):
                by_class = np.bincount(labels[inside[i]], bag[inside[i]], 2)
                assert by_class.tolist() == tree["rows"][i].tolist()
                if tree["feature"][i] < 0:
                    continue
                gains = {}
                for f in (0, 1):
                    for c in range(len(cuts[f])):
                        left = np.bincount(labels[inside[i] & (bins[f] <= c)], bag[inside[i] & (bins[f] <= c)], 2)
                        if min(left.sum(), (by_class - left).sum()) >= 5:
                            parts = [left * weights, (by_class - left) * weights]
                            whole = by_class * weights
                            gains[f, c] = forest.gini(whole) - sum(p.sum() * forest.gini(p) for p in parts) / whole.sum()
                assert tree["gain"][i] == pytest.approx(max(gains.values())) == gains[tree["feature"][i], tree["cut"][i]]
                left = bins[tree["feature"][i]] <= tree["cut"][i]
                inside[tree["left"][i]], inside[tree["left"][i] + 1] = inside[i] & left, inside[i] & ~left


def test_draws_follow_the_poisson_distribution():
    """From tables for runs of equal counts, and one by one for the others."""
    n = 20_000
    counts = np.concatenate([np.full(n, 1), np.full(n, 40), np.arange(100, 2100)])
    cells = forest.Cells({"block": 0, "size": len(counts), "bins": bytes(len(counts)), "labels": bytes(len(counts)),
                          "counts": counts.tobytes()}, 1, 2, 2)
    assert len(cells.runs) == 2 and len(cells.rest) == 2000
    draws = np.stack([cells.bag(t, 7) for t in range(20)])
    for mean, got in ((1, draws[:, :n]), (40, draws[:, n : 2 * n])):
        assert got.mean() == pytest.approx(mean, rel=0.01) and got.var() == pytest.approx(mean, rel=0.02)
    assert (draws[:, :n] == 0).mean() == pytest.approx(np.exp(-1), rel=0.01)
    assert ((draws[:, 2 * n :] - counts[2 * n :]) ** 2 / counts[2 * n :]).mean() == pytest.approx(1, rel=0.05)
    assert (draws[0] != draws[1]).any() and (cells.bag(3, 7) == draws[3]).all()


def test_thresholds(spark):
    """Few values are parted halfway, many at quantiles of all rows; rows that no forest can take are refused."""
    rows = spark.range(100_000).select(F.lit(0.0).alias("label"), (F.col("id") % 3).cast("double").alias("x0"),
                                       F.col("id").cast("double").alias("x1"), F.lit(1.0).alias("x2"))
    three, many, one = forest.cut_points(rows, ["x0", "x1", "x2"], 32)
    assert three.tolist() == [0.5, 1.5] and one.tolist() == []
    assert len(many) == 31 and np.abs(many - np.arange(1, 32) * 3125).max() <= 100
    for bad in (F.lit(None).cast("double"), F.lit(float("nan"))):
        with pytest.raises(ValueError, match="feature"):
            forest.cut_points(rows.withColumn("x1", F.when(F.col("x1") > 5, F.col("x1")).otherwise(bad)), ["x0", "x1"], 32)
    with pytest.raises(ValueError, match="labels"):
        forest.cut_points(rows.withColumn("label", F.lit(0.5)), ["x0"], 32)


def test_scores_are_those_of_the_model(spark):
    """Batches through tree after tree give what transform() gives for each row, for batches and for other models alike."""
    rows = noisy(spark, 5000)
    model = training.train_forest(rows, ["few", "many"], trees=7, depth=6)
    assert forest.class_probabilities(model, rows) is not None and forest.class_probabilities(model.stages[-1], rows) is None
    ours = training.score(model, rows, "v")
    plain = model.transform(rows).select("id", F.col("prediction").cast("int").alias("p"), F.col("probability").alias("q"))
    assert ours.columns == [*rows.columns, "probabilities", "pred", "score", "model_version"]
    for r in ours.join(plain, "id").collect():
        assert r.pred == r.p and r.probabilities == pytest.approx(r.q.toArray().tolist(), abs=1e-12) and r.score == r.probabilities[1]
    with pytest.raises(Exception, match="null or NaN in many"):
        training.score(model, rows.withColumn("many", F.when(F.col("id") != 7, F.col("many"))), "v").select("score").collect()
