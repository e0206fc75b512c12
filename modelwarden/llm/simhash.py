"""SimHash near-duplicates, linked through vantage-point trees over Hamming distance.

Every text becomes a 64-bit fingerprint of its word shingles. A vantage-point tree, built from a bounded sample of the
distinct fingerprints, deals all distinct fingerprints to leaves: at a node with vantage v and radius r a fingerprint goes
left if d(f, v) <= r and right otherwise, and one with r < d(f, v) <= r + max_bits also visits the left side, since by the
triangle bound only such a one can be within max_bits of something there. So every pair in reach meets in a leaf, where it
is compared exactly. A node is split only where the sample says that this saves comparisons. A leaf larger than BLOCK is
cut into blocks, and pairs of blocks are compared in tasks of their own, so a large group never lies in one task. A task
gives back a spanning forest of the links it found, never all pairs; connected components join the forests.

With `min_similarity` fingerprints count each distinct shingle of a text once, as similarity is one of sets. The links
are between texts, and hold where fingerprints are within max_bits (SHORT_BITS more for texts of under SHORT shingles) and
the similarity of the sets of shingles is min_similarity or more. Sizes that rule it out part the texts into rings first. Such
links need a wide max_bits, where the triangle bound cannot save comparisons: then only rings and blocks part the work.
One-permutation sketches of 512 bins (standard error 0.03 at most) pick candidates with a margin of five errors; texts joined
by candidates are a group, and inside the groups the sets themselves are compared, in blocks again where a group is large.

Defined results: null, empty and blank texts have no words and fingerprint zero, and link like any others; texts with
fewer words than a shingle are one shingle; equal texts always share a component; repeated rows are returned each; an
empty table gives an empty result; very long texts are read whole; columns not asked for are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwarden.llm.components import components
from modelwarden.session import materialise, release

SEED = 42
#: Distinct fingerprints that the tree is built from, at most.
SAMPLE = 20_000
#: Fingerprints that one side of a comparison holds at most.
BLOCK = 16_384
#: Few shingles make the majority unsteady: sets of 4 and 5 that share 4 differ in 12 +- 3 bits, those of 500 in 9.6 +- 2.9.
SHORT, SHORT_BITS = 8, 4
BINS = 512
#: How far below the wanted similarity a sketch may be, and how many bins may disagree by chance besides (few shingles).
MARGIN, SLACK = 0.14, 4
#: Shingles that one side of a comparison of sets holds, about; texts up to which a group is not cut into blocks.
SET_BLOCK, GROUP = 1 << 20, 1024
#: Bits of the table that says which rows may be wanted, in words of 64: it bounds what is broadcast.
MARKS = 1 << 24


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of `words` words, repeats included, A-Z in lower case."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    last = max(1, len(tokens) - words + 1)
    return np.array([digest(b" ".join(tokens[i : i + words]), SEED) for i in range(last)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if it is set in over half of the hashes."""
    count = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[start : start + (1 << 16)]).astype("<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<u8")[0])


def sketch(hashes: np.ndarray) -> tuple[int, bytes]:
    """Number of distinct shingles, and by bin of the hash's top bits: whether it is used, and one bit of its least hash."""
    distinct = np.unique(hashes)  # sorted, so the first of a bin is its least
    bins, first = np.unique(distinct >> np.uint64(55), return_index=True)
    used, bit = np.zeros(BINS, np.uint8), np.zeros(BINS, np.uint8)
    used[bins.astype(np.int64)] = 1
    mixed = distinct[first] * np.uint64(0x9E3779B97F4A7C15)
    bit[bins.astype(np.int64)] = (mixed >> np.uint64(63)).astype(np.uint8)
    return len(distinct), np.packbits(used).tobytes() + np.packbits(bit).tobytes()


def fingerprint(docs: DataFrame, keep: list[str], shingle: int, sketched: bool = False) -> DataFrame:
    """The columns `keep` with fp (64 bits as long) and, if sketched, text_key, size and sketch."""
    kept = docs.select(*keep).schema
    more = ", text_key bigint, size int, sketch binary" if sketched else ""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", fp bigint" + more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys, sizes, marks = [], [], [], []
            for value in batch.column("_shingled_text"):
                text = value.as_py()
                hashes = shingle_hashes(text, shingle)
                # Links between texts go by sets of shingles, so there a word repeated often must not outvote the others.
                fps.append(majority(np.unique(hashes) if sketched else hashes))
                if sketched:
                    keys.append(xxhash.xxh64_intdigest(b" ".join((text or b"").lower().split())))
                    n, mark = sketch(hashes)
                    sizes.append(n)
                    marks.append(mark)
            out = [batch.column(i) for i in range(len(kept))] + [pa.array(np.array(fps, np.uint64).view(np.int64))]
            if sketched:
                out += [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()),
                        pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=schema_names)

    schema_names = [*kept.names, "fp", *(["text_key", "size", "sketch"] if sketched else [])]
    return docs.select(*keep, F.col("text").cast("binary").alias("_shingled_text")).mapInArrow(run, schema)


def leaf_size(total: int) -> float:
    """Fingerprints that a leaf should hold. It grows slowly with all, as every level of the tree makes more visitors."""
    return 400 * max(1, total) ** 0.25


def build_tree(sample: np.ndarray, total: int, max_bits: int) -> list[tuple]:
    """Nodes (vantage, radius, left, right), or (leaf number,), of a tree for `total` fingerprints."""
    rng = np.random.default_rng(SEED)
    scale = total / max(1, len(sample))
    nodes: list[tuple] = []
    leaves = 0

    def grow(points: np.ndarray) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append(())
        best = None
        if len(points) * scale > leaf_size(total) and len(points) >= 16:
            for vantage in rng.choice(points, 8):
                by = np.bincount(np.bitwise_count(points ^ vantage), minlength=65 + max_bits)
                inside = by.cumsum()
                for radius in range(64):
                    left, right = inside[radius + max_bits], len(points) - inside[radius]
                    cost = left * left + right * right
                    if inside[radius] and right and (best is None or cost < best[0]):
                        best = (int(cost), vantage, radius)
        if best is None or best[0] > 0.9 * len(points) ** 2:
            nodes[at] = (leaves,)
            leaves += 1
            return at
        _, vantage, radius = best
        far = np.bitwise_count(points ^ vantage)
        nodes[at] = (vantage, radius, grow(points[far <= radius + max_bits]), grow(points[far > radius]))
        return at

    grow(sample)
    return nodes


def deal(points: np.ndarray, nodes: list[tuple], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of a point, leaf) for every leaf that a point belongs to or visits."""
    index, leaf = [], []
    stack = [(0, np.arange(len(points)))]
    while stack:
        at, own = stack.pop()
        node = nodes[at]
        if len(node) == 1:
            index.append(own)
            leaf.append(np.full(len(own), node[0], np.int64))
        elif len(own):
            far = np.bitwise_count(points[own] ^ node[0])
            stack += [(node[2], own[far <= node[1] + max_bits]), (node[3], own[far > node[1]])]
    return np.concatenate(index), np.concatenate(leaf)


def bins_matched(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins used in either set, and those matched less those that match by chance, from rows of sketches as 64-bit words:
    first which bins are used, then the bits."""
    half = a.shape[1] // 2
    either = np.bitwise_count(a[:, :half] | b[:, :half]).sum(axis=1, dtype=np.int64)
    both = a[:, :half] & b[:, :half]
    agree = np.bitwise_count(both & ~(a[:, half:] ^ b[:, half:])).sum(axis=1, dtype=np.int64)
    return either, 2 * agree - np.bitwise_count(both).sum(axis=1, dtype=np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sets from rows of sketches."""
    either, matched = bins_matched(a, b)
    return np.where(either == 0, 1.0, matched / np.maximum(either, 1))


def candidates(i: np.ndarray, j: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, min_similarity: float) -> np.ndarray:
    """Which of the pairs can have the similarity, by sizes and sketches."""
    least, most = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    out = least >= min_similarity * most - 1e-9
    fit = np.flatnonzero(out)
    for k in range(0, len(fit), 65536):
        some = fit[k : k + 65536]
        either, matched = bins_matched(sketches[i[some]], sketches[j[some]])
        # Sets of under 5 shingles are similar by 0.8 only if equal, and equal sets match in all bins.
        out[some] = matched >= (min_similarity - MARGIN) * either - SLACK * (most[some] * (1 - min_similarity) >= 1 - 1e-9)
    return out


def forest(fps: np.ndarray, first: np.ndarray, second: np.ndarray, max_bits: int, sizes: np.ndarray | None = None,
           sketches: np.ndarray | None = None, min_similarity: float = 0.0) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the links (of candidates, if sketched) between the points `first` and `second`."""
    label = np.arange(len(fps))
    tree = []
    step = max(1, (1 << 21) // max(1, len(second)))
    for start in range(0, len(first), step):
        rows = first[start : start + step]
        reach = max_bits if sizes is None else (max_bits + SHORT_BITS * (sizes[rows] < SHORT))[:, None]
        i, j = np.nonzero(np.bitwise_count(fps[rows][:, None] ^ fps[second][None, :]) <= reach)
        i, j = rows[i], second[j]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        if sketches is not None:
            ok = candidates(i, j, sizes, sketches, min_similarity)
            i, j = i[ok], j[ok]
        if not len(i):
            continue
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while x in parent:
                if parent[x] in parent:
                    parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        _, once = np.unique(label[i] * len(fps) + label[j], return_index=True)
        for x, y, p, q in zip(label[i[once]].tolist(), label[j[once]].tolist(), i[once].tolist(), j[once].tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                tree.append((p, q))
        moved = np.arange(len(fps))
        for x in parent:
            moved[x] = root(x)
        label = moved[label]
    return tree


def set_forest(fps: np.ndarray, first: np.ndarray, second: np.ndarray, max_bits: int, sizes: np.ndarray, sketches: np.ndarray,
               sets: list[np.ndarray], min_similarity: float) -> list[tuple[int, int]]:
    """Like `forest`, of the pairs whose sets of shingles have the similarity."""
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(x) for x in sets])
    own = [ids[e - len(x) : e] for x, e in zip(sets, ends)]
    label, held, tree = np.arange(len(fps)), np.zeros(len(known), bool), []
    for x in first.tolist():
        others = second[label[second] != label[x]]
        others = others[np.bitwise_count(fps[others] ^ fps[x]) <= max_bits + SHORT_BITS * (sizes[x] < SHORT)]
        others = others[candidates(np.full(len(others), x), others, sizes, sketches, min_similarity)]
        if not len(others):
            continue
        held[own[x]] = True
        shared = np.array([np.count_nonzero(held[own[y]]) for y in others.tolist()])
        held[own[x]] = False
        others = others[shared >= min_similarity * (sizes[x] + sizes[others] - shared) - 1e-9]
        joined, once = np.unique(label[others], return_index=True)
        tree += [(x, y) for y in others[once].tolist()]
        label[np.isin(label, joined)] = label[x]
    return tree


def marked(rows: DataFrame, own: list[str], wanted: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose columns `own` may equal `key` of some row of `wanted`: all that do, few others while MARKS is ample.

    So a join with `wanted` shuffles little of `rows`, however many are wanted. A null equals a null.
    """
    def at(names: list[str]) -> Column:
        return F.pmod(F.xxhash64(*names), F.lit(MARKS))

    bit = F.expr("shiftleft(1L, cast(_at % 64 as int))")
    words = wanted.select(at(key).alias("_at")).groupBy(F.expr("_at div 64").alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    placed = rows.withColumn("_at", at(own)).withColumn("_word", F.expr("_at div 64"))
    return placed.join(F.broadcast(words), "_word").where(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def set_links(docs: DataFrame, points: DataFrame, grouped: DataFrame, shingle: int, max_bits: int,
              min_similarity: float) -> DataFrame:
    """Edges (a, b) that connect all texts of a group (node, root) whose sets of shingles have the similarity.

    points has node, fp, size, sketch, and row: the doc_id and hash of one row of `docs` that holds the text.
    """
    members = materialise(points.join(grouped, "node"), "members")
    chosen = members.select(F.col("row.doc_id").alias("_row_id"), F.col("row._set_hash").alias("_row_hash"), "node")
    texts = docs.select("doc_id", "_set_hash", F.col("text").cast("binary").alias("_shingled_text"))
    texts = marked(texts, ["doc_id", "_set_hash"], chosen, ["_row_id", "_row_hash"])
    texts = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("_row_id")) & (F.col("_set_hash") == F.col("_row_hash")))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column("node").to_pylist(), batch.column("_shingled_text")):
                found = np.unique(shingle_hashes(text.as_py(), shingle)).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([found], pa.binary())], names=["node", "shingles"])

    sets = texts.select("node", "_shingled_text").mapInArrow(shingles, "node bigint, shingles binary")
    sets = materialise(sets.dropDuplicates(["node"]), "sets")  # of repeated rows each gave one
    # Blocks by texts, so that a large group is many tasks but no set is copied often, and by shingles.
    by_texts = F.greatest(F.least(F.ceil(F.count("*") / F.lit(GROUP)), F.lit(16)), F.ceil(F.count("*") / F.lit(BLOCK)))
    sizes = members.groupBy("root").agg(F.greatest(by_texts, F.ceil(F.sum("size") / F.lit(SET_BLOCK))).alias("k"))
    large = materialise(sizes.where("k > 1"), "large")  # at most one group in GROUP texts or SET_BLOCK shingles
    n, held = members.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bundles = 1 + max(n // 4096, held // SET_BLOCK)
    bundle = F.when(F.col("k").isNull(), F.pmod(F.xxhash64("root"), F.lit(bundles))).otherwise(F.col("root"))
    k = F.coalesce("k", F.lit(1))
    tasks = (members.select("node", "root", "fp", "size", "sketch").join(sets, "node").join(F.broadcast(large), "root", "left")
             .withColumns({"bundle": bundle, "whole": F.col("k").isNull(), "own": F.pmod(F.xxhash64("node"), k)})
             .withColumn("other", F.explode(F.sequence(F.lit(0), k - 1)))
             .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("k", "other"))

    def compare(t: pa.Table) -> pa.Table:
        node, root, own = (t.column(c).to_numpy() for c in ("node", "root", "own"))
        fps, size = t.column("fp").to_numpy().view(np.uint64), t.column("size").to_numpy()
        words = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(fps), -1)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("shingles")]
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        order = np.argsort(root, kind="stable")
        a, b = [], []
        for at in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
            first, second = np.flatnonzero(own[at] == i), np.flatnonzero(own[at] == j)
            for x, y in set_forest(fps[at], first, second, max_bits, size[at], words[at], [sets[p] for p in at], min_similarity):
                a.append(node[at[x]])
                b.append(node[at[y]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    edges = materialise(tasks.groupBy("whole", "bundle", "i", "j").applyInArrow(compare, "a bigint, b bigint"), "set-links")
    release(docs.sparkSession, members, sets, large)
    return edges


def links(points: DataFrame, max_bits: int, min_similarity: float | None = None, leaf_sample: int = SAMPLE,
          block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect all linked points; columns node and fp. With min_similarity they connect all candidates, and
    points has size and sketch too."""
    total = points.count()
    rank = F.xxhash64("fp", F.lit(7))
    sample = points.select("fp").orderBy(rank, "fp").limit(leaf_sample).toArrow().column("fp").to_numpy().view(np.uint64)
    sketched = min_similarity is not None
    reach = max_bits + SHORT_BITS * sketched
    nodes = build_tree(sample, total, reach)
    step = math.log(1 / min_similarity) if sketched else 1.0
    extra = ["size", "sketch"] if sketched else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, leaf = deal(batch.column("fp").to_numpy().view(np.uint64), nodes, reach)
            ring = np.zeros(len(index), np.int64)
            if sketched:  # texts of one ring, and of the next, can be similar enough
                ring = np.floor(np.log(np.maximum(batch.column("size").to_numpy()[index], 1)) / step + 1e-9).astype(np.int64)
                index, leaf = np.tile(index, 2), np.tile(leaf, 2)
                ring = np.concatenate([ring, ring + 1])
            taken = batch.take(pa.array(index))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaf), pa.array(ring)],
                                             names=[*taken.schema.names, "leaf", "ring"])

    fields = "node bigint, fp bigint" + (", size int, sketch binary" if sketched else "")
    placed = materialise(points.select("node", "fp", *extra).mapInArrow(place, fields + ", leaf bigint, ring bigint"),
                         "leaves")
    # One row per leaf and ring: leaves are bounded by the sample, rings by the logarithm of the longest text.
    sizes = placed.groupBy("leaf", "ring").agg(F.ceil(F.count("*") / F.lit(block)).alias("k"))
    own = F.pmod(F.xxhash64("node"), F.col("k"))
    tasks = (placed.join(F.broadcast(sizes), ["leaf", "ring"]).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
             .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")))

    def compare(t: pa.Table) -> pa.Table:
        fps = t.column("fp").to_numpy().view(np.uint64)
        node, own = t.column("node").to_numpy(), t.column("own").to_numpy()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        first, second = np.flatnonzero(own == i), np.flatnonzero(own == j)
        more = {}
        if sketched:
            words = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(fps), -1)
            more = {"sizes": t.column("size").to_numpy(), "sketches": words, "min_similarity": min_similarity}
        found = np.array(forest(fps, first, second, max_bits, **more), np.int64).reshape(-1, 2)
        return pa.table({"a": node[found[:, 0]], "b": node[found[:, 1]]})

    found = tasks.groupBy("leaf", "ring", "i", "j").applyInArrow(compare, "a bigint, b bigint")
    if sketched:  # the dealt sketches are large
        found = materialise(found, "candidates")
        release(points.sparkSession, placed)
    return found


def near_duplicates(docs: DataFrame, keep: list[str], shingle: int = 3, max_bits: int = 3,
                    min_similarity: float | None = None, block: int = BLOCK) -> DataFrame:
    """`keep` (which holds doc_id) with fingerprint (16 hex digits), component_id and root.

    component_id is the smallest doc_id reachable over links, root a number that only the rows of one component share.
    """
    sketched = min_similarity is not None
    if sketched:
        docs = docs.withColumn("_set_hash", F.xxhash64("text"))
    rows = materialise(fingerprint(docs, [*keep, *["_set_hash"] * sketched], shingle, sketched), "fingerprints")
    node = "text_key" if sketched else "fp"
    facts = [F.min("doc_id").alias("least_id")]
    if sketched:
        facts += [F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("sketch").alias("sketch"),
                  F.min(F.struct("doc_id", "_set_hash")).alias("row")]
    points = materialise(rows.groupBy(F.col(node).alias("node")).agg(*facts), "points")
    if not sketched:
        points = points.withColumn("fp", F.col("node"))
    rooted = components(links(points, max_bits, min_similarity, block=block))
    if sketched:
        rooted = components(set_links(docs, points, rooted, shingle, max_bits, min_similarity))
    named = points.select("node", "least_id").join(rooted, "node", "left")
    named = materialise(named.select("node", "least_id", F.coalesce("root", "node").alias("root")), "roots")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = materialise(named.join(least, "root").select(F.col("node").alias(node), "component_id", "root"), "named")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return rows.join(named, node).select(*keep, hexed, "component_id", "root")


def keep_one(docs: DataFrame, shingle: int = 5, max_bits: int = 22, min_similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the row with the smallest doc_id stays."""
    text_hash = F.xxhash64("text").alias("text_hash")
    rows = near_duplicates(docs.select("doc_id", "text", text_hash), ["doc_id", "text_hash"], shingle, max_bits, min_similarity)
    first = materialise(rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("at")).select("at"), "first")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.struct("doc_id", text_hash).alias("own"))
    # The join and the window go by one column (where a null id equals a null), so the texts are shuffled once.
    chosen = whole.join(first, F.col("own") == F.col("at"))
    once = Window.partitionBy("at").orderBy("at")  # of repeated rows too only one stays
    return chosen.withColumn("copy", F.row_number().over(once)).where("copy = 1").select("row.*")
