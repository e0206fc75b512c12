"""Random forests grown from counts of binned rows."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.util import DefaultParamsWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from modelwarden.session import materialise, release, work_dir

#: Cells of a block, which one task holds in memory, and of a slice of it, which the CPU's cache holds.
BLOCK = 1 << 20
SLICE = 1 << 16
#: Quantiles are right within this share of the rows; a bin has about a 32nd.
ACCURACY = 2000
#: Cells of equal count from which on a table of their draws is worth making.
RUN = 8192
#: Spark's own limit on classes that no metadata states.
CLASSES = 100
#: Tasks per core of a pass over the cells.
TASKS_A_CORE = 3

# Tasks get this module's code with their functions, wherever their Python looks for modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class CellForest(Estimator):
    """Spark's random forest, grown from cells instead of rows; the fitted model is Spark's.

    A forest sees a feature through its bins only: between the values where there are few, else at quantiles, here of all rows.
    Rows alike in all bins and label are one cell with a count. How often a tree's bootstrap sample takes a cell is drawn from
    the Poisson distribution of that count, as the sum of draws for its rows would be. So there are never more cells than rows,
    nor more than the bins allow, and each level of all trees is one pass over them. Weights must be those of classes.
    Feature subsets (square root, per node), gini, least rows per child and leaves follow Spark's classifier.
    """

    def __init__(self, inputs: Sequence[str], label: str, weight: str, trees: int, depth: int, min_instances: int, seed: int,
                 bins: int = 32, block: int = BLOCK):
        super().__init__()
        self.inputs, self.label, self.weight, self.trees, self.depth = list(inputs), label, weight, trees, depth
        self.min_instances, self.seed, self.bins, self.block = min_instances, seed, bins, block

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        spark = dataset.sparkSession
        names = [f"x{i}" for i in range(len(self.inputs))]
        rows = dataset.select(F.col(self.label).cast("double").alias("label"), F.col(self.weight).cast("double").alias("weight"),
                              *(F.col(c).cast("double").alias(n) for c, n in zip(self.inputs, names)))
        rows = materialise(rows, "forest-rows")
        cuts = cut_points(rows, names, self.bins)
        weights = class_weights(rows)
        blocks, n_blocks = cell_blocks(rows, cuts, self.block)
        release(spark, rows)
        grown = grow(blocks, n_blocks, cuts, weights, self.trees, self.depth, self.min_instances, self.seed)
        release(spark, blocks)
        forest = RandomForestClassifier(
            featuresCol="features", labelCol=self.label, weightCol=self.weight, numTrees=self.trees, maxDepth=self.depth,
            maxBins=self.bins, minInstancesPerNode=self.min_instances, seed=self.seed)
        return as_model(spark, forest, grown, cuts, weights)


def cut_points(rows: DataFrame, names: list[str], bins: int) -> list[np.ndarray]:
    """Ascending thresholds per feature, `bins` - 1 at most; a value goes to the bin of as many thresholds as are below it.

    Raises where a feature is null or NaN, or a label is no class number.
    """
    y = F.col("label")
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y.isNull() | F.isnan(y) | (y < 0) | (y != F.floor(y)) | (y >= CLASSES)).alias("bad_labels"),
        *(F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"bad_{c}") for c in names),
        *(F.approx_count_distinct(c).alias(c) for c in names)).first()
    if not found["n"]:
        raise ValueError("no rows to train on")
    if found["bad_labels"]:
        raise ValueError(f"{found['bad_labels']} labels are not whole numbers from 0 to {CLASSES - 1}")
    if bad := [c for c in names if found[f"bad_{c}"]]:
        raise ValueError("null or NaN in feature " + ", ".join(c[1:] for c in bad))
    few = [c for c in names if found[c] <= 2 * bins]  # a bounded set each
    many = [c for c in names if found[c] >= bins / 2]
    read = rows.agg(*(F.collect_set(c).alias(f"set_{c}") for c in few),
                    *(F.percentile_approx(c, shares, ACCURACY).alias(f"at_{c}") for c in many)).first().asDict()
    cuts = []
    for c in names:
        values = np.unique(np.array(read.get(f"set_{c}", []), float))
        if 0 < len(values) <= bins or c not in many:
            middle = values[:-1] / 2 + values[1:] / 2
            found_cuts = np.where((values[:-1] <= middle) & (middle < values[1:]), middle, values[:-1])
        else:
            found_cuts = np.unique(np.array(read[f"at_{c}"], float))
        cuts.append(found_cuts[found_cuts < np.finfo(float).max])  # above the last number nothing is parted
    return cuts


def class_weights(rows: DataFrame) -> np.ndarray:
    """The weight of each class, 0 where a class has no rows. A row per class is collected."""
    found = rows.groupBy("label").agg(F.min("weight").alias("low"), F.max("weight").alias("high"),
                                      F.count_if(F.col("weight").isNull() | (F.col("weight") < 0)).alias("bad")).collect()
    if any(r["bad"] or r["low"] != r["high"] for r in found):
        raise ValueError("every class needs one weight, which is not negative")
    weights = np.zeros(max(2, 1 + int(max(r["label"] for r in found))))
    for r in found:
        weights[int(r["label"])] = r["low"]
    return weights


def cell_blocks(rows: DataFrame, cuts: list[np.ndarray], block: int) -> tuple[DataFrame, int]:
    """(block, size, bins, labels, counts), and how many blocks: the cells by hash, in one order whatever the partitions are."""
    bits = max(len(c) for c in cuts).bit_length() or 1
    kind = np.min_scalar_type(max(len(c) for c in cuts))
    a_word = 62 // bits
    words = [range(i, min(i + a_word, len(cuts))) for i in range(0, len(cuts), a_word)]
    keys = [f"k{i}" for i in range(len(words))]

    def pack(cells: pa.Table) -> pa.Table:
        col = {c: cells.column(c).to_numpy() for c in ("label", "n", *keys)}
        order = np.lexsort([*(col[k] for k in keys), col["label"], col["n"]])  # by count first
        bins = np.zeros((len(cuts), len(order)), kind)
        for key, word in zip(keys, words):
            for at, i in enumerate(reversed(word)):
                bins[i] = (col[key][order] >> (at * bits)) & ((1 << bits) - 1)
        return pa.table({
            "block": pa.array([cells.column("block")[0].as_py()], pa.int32()), "size": pa.array([len(order)], pa.int32()),
            "bins": pa.array([bins.tobytes()], pa.binary()), "labels": pa.array([col["label"][order].astype(np.uint8).tobytes()], pa.binary()),
            "counts": pa.array([col["n"][order].astype(np.int64).tobytes()], pa.binary())})

    parted = [i for i, c in enumerate(cuts) if len(c)]
    binned = rows
    if parted:  # Spark's buckets have their lower edge, bins their upper one
        edges = [[-np.inf, *np.nextafter(cuts[i], np.inf).tolist(), np.inf] for i in parted]
        names = {"inputCols": [f"x{i}" for i in parted], "outputCols": [f"b{i}" for i in parted]}
        binned = Bucketizer(splitsArray=edges, **names).transform(rows)
    for key, word in zip(keys, words):
        packed = F.lit(0).cast("bigint")
        for i in word:
            packed = F.shiftleft(packed, bits) + (F.col(f"b{i}").cast("bigint") if i in parted else F.lit(0))
        binned = binned.withColumn(key, packed)
    cells = binned.groupBy(F.col("label").cast("int").alias("label"), *keys).agg(F.count(F.lit(1)).alias("n"))
    cells = materialise(cells, "forest-cells")
    n = -(-cells.count() // block)
    dealt = cells.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))
    blocks = materialise(dealt.groupBy("block").applyInArrow(pack, "block int, size int, bins binary, labels binary, counts binary"),
                         "forest-blocks")
    release(rows.sparkSession, cells)
    return blocks, n


def poisson_table(mean: int) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative probabilities, and the draw for each 65,536th of the unit interval, -1 where it holds several."""
    k = np.arange(int(mean + 12 * mean**0.5 + 30))
    below = np.cumsum(np.exp(k * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])))
    edges = np.arange(65537) / 65536
    low, high = np.searchsorted(below, edges[:-1], side="right"), np.searchsorted(below, edges[1:], side="left")
    return below, np.where(low == high, low, -1).astype(np.int32)


class Cells:
    """One block: how often a tree takes each cell, and its sums by open node, feature, bin and class."""

    def __init__(self, row: dict, n_features: int, n_classes: int, width: int):
        self.block, self.size, self.n_classes, self.width = row["block"], row["size"], n_classes, width
        bins = np.frombuffer(row["bins"], np.min_scalar_type(width - 1)).reshape(n_features, self.size)
        self.labels = np.frombuffer(row["labels"], np.uint8).astype(np.intp)
        self.counts = np.frombuffer(row["counts"], np.int64)
        self.slices = [(lo, min(lo + SLICE, self.size), np.ascontiguousarray(bins[:, lo : lo + SLICE]).ravel())
                       for lo in range(0, self.size, SLICE)]
        starts = np.flatnonzero(np.diff(self.counts, prepend=-1))
        ends = np.append(starts[1:], self.size)
        self.runs = [(a, b, *poisson_table(int(self.counts[a]))) for a, b in zip(starts.tolist(), ends.tolist()) if b - a >= RUN]
        rest = np.ones(self.size, bool)
        for a, b, *_ in self.runs:
            rest[a:b] = False
        self.rest = np.flatnonzero(rest)

    def bag(self, tree: int, seed: int) -> np.ndarray:
        """A draw for every cell from the Poisson distribution of its count, the same at each level."""
        rng = np.random.Generator(np.random.SFC64(np.random.SeedSequence([seed & (2**64 - 1), tree, self.block])))
        out = np.empty(self.size, np.int64)
        for a, b, below, table in self.runs:
            at = rng.integers(0, 65536, b - a, dtype=np.uint16)
            drawn = table.take(at)
            open_ = np.flatnonzero(drawn < 0)
            drawn[open_] = np.searchsorted(below, (at[open_] + rng.random(len(open_))) / 65536, side="right")
            out[a:b] = drawn
        out[self.rest] = rng.poisson(self.counts[self.rest])
        return out

    def tally(self, tree: dict, level: int, bag: np.ndarray) -> np.ndarray:
        """Rows of the sample by open node, place in its feature subset, bin and class."""
        n_open, n_subset = tree["subset"].shape
        a_node = self.width * self.n_classes
        sums = np.zeros((n_subset, n_open * a_node))
        for lo, hi, bins in self.slices:
            every = np.arange(hi - lo)
            node = np.zeros(hi - lo, np.intp)
            for _ in range(level):
                at = tree["feature"].take(node)
                at *= hi - lo
                at += every
                right = bins.take(at) > tree["cut"].take(node)
                node = tree["left"].take(node)
                node += right
            slot = tree["slot"].take(node)
            live = np.flatnonzero((slot >= 0) & (bag[lo:hi] > 0))
            slot, taken = slot[live], bag[lo:hi][live].astype(float)
            base = slot * a_node
            base += self.labels[lo:hi][live]
            for j in range(n_subset):
                at = tree["subset"][:, j].take(slot)
                at *= hi - lo
                at += live
                at = bins.take(at).astype(np.intp)
                at *= self.n_classes
                at += base
                sums[j] += np.bincount(at, taken, n_open * a_node)
        return sums.reshape(n_subset, n_open, self.width, self.n_classes).swapaxes(0, 1)


def gini(sums: np.ndarray) -> np.ndarray:
    total = sums.sum(-1, keepdims=True)
    return np.where(total[..., 0] > 0, 1 - (np.divide(sums, total, out=np.zeros_like(sums), where=total > 0) ** 2).sum(-1), 0.0)


def best_splits(sums: np.ndarray, subset: np.ndarray, n_cuts: np.ndarray, weights: np.ndarray, min_instances: int) -> dict:
    """Per open node its rows by class, and of its best split the feature (-1: none), threshold, gain and rows by class to the left."""
    below = sums.cumsum(2)
    total, left = below[:, :1, -1:], below[:, :, :-1]
    right = total - left
    lw, rw = left * weights, right * weights
    whole = (total * weights).sum(-1)
    gain = gini(total * weights) - (lw.sum(-1) * gini(lw) + rw.sum(-1) * gini(rw)) / np.where(whole > 0, whole, 1)
    allowed = (left.sum(-1) >= min_instances) & (right.sum(-1) >= min_instances)
    allowed &= np.arange(left.shape[2]) < n_cuts[subset][:, :, None]
    gain = np.where(allowed, gain, -np.inf).reshape(len(sums), -1)
    node, top = np.arange(len(sums)), gain.argmax(1)
    j, cut = np.divmod(top, left.shape[2])
    gain = gain[node, top]
    return {"feature": np.where(gain > 0, subset[node, j], -1), "cut": cut, "gain": gain, "total": total[:, 0, 0], "left": left[node, j, cut]}


def grow(blocks: DataFrame, n_blocks: int, cuts: list[np.ndarray], weights: np.ndarray, trees: int, depth: int,
         min_instances: int, seed: int) -> list[dict]:
    """Nodes of every tree: feature (-1 in a leaf), cut, left child (the right one follows it), gain, and rows by class.

    Every level is one pass over the blocks, and tasks for some trees each where there are fewer blocks than cores. What comes to
    the driver is a split per open node.
    """
    n_features, n_classes, width = len(cuts), len(weights), 1 + max(1, *map(len, cuts))
    n_subset = n_features if trees == 1 else int(np.ceil(n_features**0.5))
    n_cuts = np.array([len(c) for c in cuts])
    tasks = TASKS_A_CORE * blocks.sparkSession.sparkContext.defaultParallelism
    groups = max(1, min(trees, -(-tasks // n_blocks)))
    work = blocks.withColumn("trees", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartitionById(
        n_blocks * groups, F.col("block") * groups + F.col("trees"))
    grown = [{"feature": np.array([-1]), "cut": np.array([0]), "left": np.array([0]), "gain": np.array([-1.0]),
              "rows": np.zeros((1, n_classes), np.int64), "open": np.array([0])} for _ in range(trees)]

    def splits(level: int) -> list:
        state = {t: searched(g, n_features, n_subset, [seed & (2**64 - 1), t, level]) for t, g in enumerate(grown) if len(g["open"])}
        shared = blocks.sparkSession.sparkContext.broadcast(state)

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    cells = Cells(row, n_features, n_classes, width)
                    for t in range(row["trees"], trees, groups):
                        if t not in shared.value:
                            continue
                        sums = cells.tally(shared.value[t], level, cells.bag(t, seed))
                        kind = np.min_scalar_type(int(sums.max(initial=0)))
                        yield pa.record_batch({"tree": pa.array([t], pa.int32()), "kind": pa.array([kind.str]),
                                               "sums": pa.array([sums.astype(kind).tobytes()], pa.binary())})

        def best(parts: pa.Table) -> pa.Table:
            t = parts.column("tree")[0].as_py()
            subset = shared.value[t]["subset"]
            sums = np.zeros((*subset.shape, width, n_classes), np.int64)
            for kind, part in zip(parts.column("kind"), parts.column("sums")):
                sums += np.frombuffer(part.as_buffer(), np.dtype(kind.as_py())).reshape(sums.shape).astype(np.int64)
            found = best_splits(sums, subset, n_cuts, weights, min_instances)
            flat = {k: pa.array([found[k].astype(float if k == "gain" else np.int64).tobytes()], pa.binary()) for k in FOUND}
            return pa.table({"tree": pa.array([t], pa.int32()), **flat})

        tallied = work.mapInArrow(tally, "tree int, kind string, sums binary")
        out = tallied.groupBy("tree").applyInArrow(best, "tree int, " + ", ".join(f"{k} binary" for k in FOUND)).collect()
        shared.destroy()
        return out

    # A tree without a level still needs the rows of its root.
    for level in range(max(depth, 1)):
        for row in splits(level) if any(len(g["open"]) for g in grown) else []:
            found = {k: np.frombuffer(row[k], float if k == "gain" else np.int64) for k in FOUND}
            split(grown[row["tree"]], found, n_classes, level, depth)
    return grown


FOUND = ("feature", "cut", "gain", "total", "left")


def searched(tree: dict, n_features: int, n_subset: int, seed: list[int]) -> dict:
    """A tree as tasks search it: leaves lead to themselves, open nodes have a slot and a random subset of features."""
    leaf = tree["feature"] < 0
    slot = np.full(len(leaf), -1)
    slot[tree["open"]] = np.arange(len(tree["open"]))
    rng = np.random.Generator(np.random.SFC64(np.random.SeedSequence(seed)))
    order = rng.permuted(np.tile(np.arange(n_features), (len(tree["open"]), 1)), axis=1)
    return {"feature": np.where(leaf, 0, tree["feature"]), "cut": np.where(leaf, np.iinfo(np.int32).max, tree["cut"]),
            "left": np.where(leaf, np.arange(len(leaf)), tree["left"]), "slot": slot, "subset": np.sort(order[:, :n_subset], axis=1)}


def split(tree: dict, found: dict, n_classes: int, level: int, depth: int) -> None:
    """Give the open nodes of a tree the splits found; children are open unless pure or at the last level."""
    total, left = found["total"].reshape(-1, n_classes), found["left"].reshape(-1, n_classes)
    if level == 0:
        tree["rows"][0] = total[0]
    has = (found["feature"] >= 0) & (level < depth)
    at, n = tree["open"][has], len(tree["feature"])
    children = np.stack([left[has], (total - left)[has]], axis=1).reshape(-1, n_classes)
    tree["feature"][at], tree["cut"][at], tree["gain"][at] = found["feature"][has], found["cut"][has], found["gain"][has]
    tree["left"][at] = n + 2 * np.arange(len(at))
    more = {"feature": np.full(len(children), -1), "cut": np.zeros(len(children), int), "left": np.zeros(len(children), int),
            "gain": np.full(len(children), -1.0), "rows": children}
    for k, v in more.items():
        tree[k] = np.concatenate([tree[k], v])
    mixed = (children > 0).sum(axis=1) > 1
    tree["open"] = n + np.flatnonzero(mixed) if level + 1 < depth else np.array([], int)


def as_model(spark: SparkSession, forest: RandomForestClassifier, grown: list[dict], cuts: list[np.ndarray], weights: np.ndarray) -> RandomForestClassificationModel:
    """The trees as Spark's model, by way of the files in which Spark keeps one."""
    path = work_dir(spark, "forest")
    shape = {"numFeatures": len(cuts), "numClasses": len(weights)}
    about = json.loads(DefaultParamsWriter._get_metadata_to_save(forest, spark, {**shape, "numTrees": len(grown)}))
    package = "org.apache.spark.ml.classification."
    about["class"] = package + "RandomForestClassificationModel"
    of_forests = {"numTrees", "featureSubsetStrategy", "subsamplingRate", "bootstrap"}
    one = {k: v for k, v in about.items() if k != "numTrees"} | {"class": package + "DecisionTreeClassificationModel"}
    for k in ("paramMap", "defaultParamMap"):
        one[k] = {p: v for p, v in about[k].items() if p not in of_forests}
    tables = []
    for t, tree in enumerate(grown):
        sums = tree["rows"] * weights
        leaf, n = tree["feature"] < 0, len(tree["feature"])
        value = [0.0 if f < 0 else cuts[f][c] for f, c in zip(tree["feature"], tree["cut"])]
        places = np.concatenate([[0], np.cumsum(~leaf)]).astype(np.int32)
        ints = lambda x: pa.array(np.asarray(x, np.int32))
        sides = pa.StructArray.from_arrays(
            [ints(tree["feature"]), pa.ListArray.from_arrays(pa.array(places), pa.array(np.array(value)[~leaf])), ints(np.full(n, -1))],
            ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
        nodes = pa.StructArray.from_arrays(
            [ints(np.arange(n)), pa.array(sums.argmax(axis=1).astype(float)), pa.array(gini(sums)),
             pa.ListArray.from_arrays(ints(np.arange(n + 1) * len(weights)), pa.array(sums.ravel())), pa.array(tree["rows"].sum(axis=1)),
             pa.array(np.where(leaf, -1.0, tree["gain"])), ints(np.where(leaf, -1, tree["left"])),
             ints(np.where(leaf, -1, tree["left"] + 1)), sides],
            ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
        tables.append(pa.table({"treeID": ints(np.full(n, t)), "nodeData": nodes}))
    spark.createDataFrame(pa.concat_tables(tables)).write.parquet(f"{path}/data")
    each = [(t, json.dumps(one | {"uid": f"dtc_{about['uid'][-12:]}_{t}"}), 1.0) for t in range(len(grown))]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return RandomForestClassificationModel.load(path)


def class_probabilities(model: PipelineModel, rows: DataFrame) -> Column | None:
    """The array of class probabilities of a forest on plain columns, as its transform() gives; None for any other model.

    A batch of rows goes through one tree after the other, so the tree at hand stays in the CPU's cache.
    """
    stages = getattr(model, "stages", [])
    if [type(s) for s in stages] != [VectorAssembler, RandomForestClassificationModel]:
        return None
    assembler, forest = stages
    inputs = assembler.getInputCols()
    plain = all(c in rows.columns and isinstance(rows.schema[c].dataType, NumericType) for c in inputs)
    if not plain or assembler.getHandleInvalid() != "error" or forest.isSet("thresholds") or (trees := tree_arrays(forest)) is None:
        return None
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    n_classes = forest.numClasses

    @F.arrow_udf("array<double>")
    def vote(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)  # one column comes as it is
            if bad := [c for c, x in zip(inputs, columns) if x.null_count or np.isnan(x.to_numpy()).any()]:
                raise ValueError("null or NaN in " + ", ".join(bad))
            n = len(columns[0])
            values, every = np.concatenate([x.to_numpy() for x in columns]), np.arange(n)
            votes = np.zeros((n_classes, n))
            for tree in shared.value:
                node = np.zeros(n, np.intp)
                for _ in range(tree["depth"]):
                    at = tree["feature"].take(node)
                    at *= n
                    at += every
                    right = values.take(at) > tree["threshold"].take(node)
                    node *= 2
                    node += right
                    node = tree["children"].take(node)
                for c in range(n_classes):
                    votes[c] += tree["shares"][c].take(node)
            votes /= np.maximum(votes.sum(axis=0), np.finfo(float).tiny)
            yield pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n_classes), pa.array(votes.T.ravel()))

    return vote(*(F.col(c).cast("double") for c in inputs))


def tree_arrays(forest: RandomForestClassificationModel) -> list[dict] | None:
    """Every tree's nodes as arrays, from the files in which Spark keeps a forest; None if it splits by category."""
    spark = SparkSession.active()
    path = work_dir(spark, "forest")
    forest.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.impurityStats",
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), "nodeData.split.numCategories").toArrow()
    col = {c: nodes.column(c).to_numpy() for c in ("treeID", "id", "leftChild", "rightChild", "featureIndex", "threshold", "numCategories")}
    if (col["numCategories"] >= 0).any():
        return None
    stats = np.array(nodes.column("impurityStats").combine_chunks().flatten()).reshape(len(nodes), -1)
    shares = stats / np.maximum(stats.sum(axis=1, keepdims=True), np.finfo(float).tiny)
    trees = []
    for t in range(forest.getNumTrees):
        own = np.flatnonzero(col["treeID"] == t)
        own = own[np.argsort(col["id"][own])]
        leaf, ids = col["featureIndex"][own] < 0, np.arange(len(own))
        children = np.stack([np.where(leaf, ids, col["leftChild"][own]), np.where(leaf, ids, col["rightChild"][own])], axis=1)
        depth, front = 0, ids[:1]
        while not leaf[front].all():
            depth, front = depth + 1, np.unique(children[front[~leaf[front]]])
        trees.append({"feature": np.where(leaf, 0, col["featureIndex"][own]).astype(np.intp), "depth": depth,
                      "threshold": np.where(leaf, np.inf, col["threshold"][own]), "children": children.ravel().astype(np.intp),
                      "shares": np.ascontiguousarray(shares[own].T)})
    return trees
