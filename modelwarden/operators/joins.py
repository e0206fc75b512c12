"""Range joins without a nested loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_join(
    points: DataFrame, ranges: DataFrame, keys: Sequence[str], point: Column, low: Column, high: Column, width: float,
) -> DataFrame:
    """Points with the ranges that hold them (low <= point <= high), equal on `keys`.

    Ranges are laid on buckets of `width`; the join is on (keys, bucket), so a hot key is spread over
    its buckets. Choose a width near the usual range length: a range is copied once per bucket it meets.
    """
    p = points.withColumn("_point", point.cast("double")).withColumn("_bucket", F.floor(F.col("_point") / width))
    r = ranges.withColumn("_low", low.cast("double")).withColumn("_high", high.cast("double")).where("_low <= _high")
    r = r.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor(F.col("_high") / width))))
    joined = p.join(r, [*keys, "_bucket"]).where(F.col("_point").between(F.col("_low"), F.col("_high")))
    return joined.drop("_bucket", "_point", "_low", "_high")
