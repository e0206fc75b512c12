"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows are written once with their partition and position. From the partitions' row counts alone a matrix is drawn that says
how many rows each partition sends to each shard: row by row from a multivariate hypergeometric distribution, so that it is
distributed as under a uniform permutation of all rows, and every shard gets exactly its size. Each partition then permutes
its own rows and cuts them by its line of the matrix; rows are exchanged; and in each shard rows are permuted again
by a keyed one-to-one mixing of (partition, position), in blocks, so that no task ever holds a shard.

The matrix has as many lines as the input has partitions and as many columns as shards: it does not grow with the rows
of a partition. All draws depend on the seed and on what was written, so a repeated task repeats them.

Defined results: shards are at most one row apart, the first ones being larger; fewer rows than shards leave shards empty;
an empty table gives an empty result; equal rows are separate rows; columns named `shard` or `slot` are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelwarden.llm.common import free_names
from modelwarden.session import materialise

#: Rows, and bytes of text, that one task permutes at a time in the second permutation, about.
BLOCK_ROWS, BLOCK_BYTES = 1 << 16, 64 << 20
#: Working columns, under other names where the table has these.
WORKING = ["_deal_part", "_deal_position", "_deal_block", "_deal_key", "_deal_offset"]


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart, larger ones first."""
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def communication_matrix(parts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """How many rows each part sends to each shard; line sums are `parts`, column sums `sizes`."""
    # The newer generator refuses populations of 10^9 and more.
    rng = np.random.default_rng(seed) if sum(sizes) < 10**9 else np.random.RandomState(seed)
    left = list(sizes)
    out = np.zeros((len(parts), len(sizes)), np.int64)
    for i, rows in enumerate(parts):
        for k, size in enumerate(left):
            others = sum(left[k + 1 :])
            out[i, k] = rng.hypergeometric(size, others, rows) if rows and size and others else min(rows, size)
            rows -= int(out[i, k])
        left = [size - int(n) for size, n in zip(left, out[i])]
    return out


def mix(values: np.ndarray, seed: int) -> np.ndarray:
    """A keyed one-to-one map of 64-bit values whose results look random."""
    x = values.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shuffle_to_shards(df: DataFrame, shards: int, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows of `df` with shard (0 to shards-1) and slot (gapless from 0 in each shard), uniformly shuffled."""
    columns = [c for c in df.columns if c not in ("shard", "slot")]
    part_name, position_name, block_name, mixed_name, offset_name = free_names(WORKING, columns)
    place = F.monotonically_increasing_id()
    numbered = materialise(df.select(*columns, F.shiftright(place, 33).cast("int").alias(part_name),
                                     place.bitwiseAND(F.lit((1 << 33) - 1)).alias(position_name)), "dealt", "zstd")
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)).cast("bigint") for f in numbered.schema
             if f.dataType.simpleString() in ("string", "binary")]
    found = numbered.groupBy(part_name).agg(F.count("*").alias("n"), F.sum(sum(texts, F.lit(0))).alias("bytes")).collect()  # one per partition
    counts = {r[part_name]: r["n"] for r in found}
    parts = sorted(counts)
    total = sum(counts.values())
    matrix = communication_matrix([counts[p] for p in parts], shard_sizes(total, shards), seed)
    lines = {p: np.cumsum(matrix[i]) for i, p in enumerate(parts)}
    bits = max(0, math.ceil(math.log2(max(1, total / shards / block_rows, sum(r["bytes"] for r in found) / shards / BLOCK_BYTES))))
    shared = df.sparkSession.sparkContext.broadcast(lines)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, order = None, np.zeros(0, np.int64)
        for batch in batches:
            part, position = batch.column(part_name).to_numpy(), batch.column(position_name).to_numpy()
            shard = np.zeros(len(part), np.int32)
            for p in np.unique(part):
                if p != last:
                    line = shared.value[int(p)]
                    order = np.random.default_rng([seed, int(p)]).permutation(int(line[-1]))
                    last = p
                own = part == p
                shard[own] = np.searchsorted(line, order[position[own]], side="right")
            key = mix((part.astype(np.uint64) << np.uint64(33)) | position.astype(np.uint64), seed)
            block = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(block), pa.array(key.view(np.int64))],
                                             names=[*batch.schema.names, "shard", block_name, mixed_name])

    def deal(rows: DataFrame) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(cut, f"{fields}, shard int, {block_name} bigint, {mixed_name} bigint")

    dealt = deal(numbered)
    ahead = Window.partitionBy("shard").orderBy(block_name).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (deal(numbered.select(part_name, position_name)).groupBy("shard", block_name).agg(F.count("*").alias("n"))  # a row per BLOCK_ROWS rows or so
               .select("shard", block_name, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(offset_name)))
    within = F.row_number().over(Window.partitionBy("shard", block_name).orderBy(mixed_name)) - 1
    return (dealt.join(offsets, ["shard", block_name])
            .select(*columns, "shard", (F.col(offset_name) + within).cast("bigint").alias("slot")))
