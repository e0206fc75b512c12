"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str | Column, folds: int) -> Column:
    """crc32 of the column as text, modulo `folds`; a null counts as empty text."""
    col = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def free_names(names: list[str], taken: list[str]) -> list[str]:
    """The names, with underscores in front of those that are taken (names differ by more than case)."""
    used = {c.lower() for c in taken}
    return [next(x for x in ("_" * k + n for k in range(len(used) + 1)) if x.lower() not in used) for n in names]


def chunks(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes add up to `limit` at most, or of one row that is larger."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def byte_sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each value of a string or binary column; a null has none."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def over_texts(docs: DataFrame, keep: list[str], outputs: StructType, compute: Callable[[list[bytes | None]], list[pa.Array]],
               limit: int = 4 << 20) -> DataFrame:
    """The columns `keep` of every row, with `outputs` that `compute` finds from the UTF-8 texts of some rows.

    Rows come in chunks of about `limit` bytes of text, or one longer text. A kept column of an output's name gives way to it.
    """
    kept = [c for c in keep if c not in outputs.names]
    row = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)))
    rows = docs.select(row.alias("row"), F.col("text").cast("binary").alias("text"))
    schema = StructType([rows.schema["row"], *outputs.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in chunks(byte_sizes(texts), limit):
                found = compute(texts.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *found], names=schema.names)

    done = rows.mapInArrow(run, schema)
    return done.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)), *outputs.names)
