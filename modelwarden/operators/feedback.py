"""Human feedback: corrections, flags, annotator agreement and segment errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelwarden.operators.ordered import top_per_key


def segment_counts(corrections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Corrections per segment (`unknown` if absent) with the share of all corrections of the key."""
    keys = list(keys)
    named = corrections.withColumn("segment", F.coalesce("segment", F.lit("unknown")))
    counts = named.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy(*keys).agg(F.sum("count").alias("_total"))
    return counts.join(totals, keys).withColumn("percentage", F.col("count") / F.col("_total")).drop("_total")


def error_patterns(corrections: DataFrame, keys: Sequence[str], min_count: int = 5) -> DataFrame:
    """Segments with at least min_count corrections; the share is of all corrections."""
    return segment_counts(corrections, keys).where(F.col("count") >= min_count)


def pattern_arrays(patterns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Patterns per key as an array, most frequent first, for keys with few segments. `pattern_summary`
    keeps no array of unlimited length."""
    entry = F.struct((-F.col("count")).alias("_o"), "segment", "count", "percentage")
    ordered = F.array_sort(F.collect_list(entry))
    return patterns.groupBy(*keys).agg(
        F.transform(ordered, lambda e: F.struct(
            e["segment"].alias("segment"), e["count"].alias("count"), e["percentage"].alias("percentage")
        )).alias("error_patterns")
    )


def pattern_summary(patterns: DataFrame, keys: Sequence[str], show: int = 3) -> DataFrame:
    """What the gates need: the number of patterns per key and the `show` most frequent ones."""
    keys = list(keys)
    counts = patterns.groupBy(*keys).agg(F.count(F.lit(1)).alias("pattern_count"))
    top = top_per_key(patterns, keys, [F.desc("count"), F.asc("segment")], show)
    return counts.join(pattern_arrays(top, keys).withColumnRenamed("error_patterns", "top_patterns"), keys)


def agreement(scores: DataFrame, keys: Sequence[str], min_rate: float = 0.7) -> DataFrame:
    mean = F.avg("score")
    return scores.groupBy(*keys).agg(
        mean.alias("avg_agreement"), F.coalesce(mean >= min_rate, F.lit(True)).alias("agreement_ok")
    )


def totals(corrections: DataFrame, flags: DataFrame, keys: Sequence[str], min_samples: int = 50) -> DataFrame:
    """Corrections, flags and their sum per key, and whether they are enough."""
    both = corrections.select(*keys, F.lit(1).alias("c"), F.lit(0).alias("f")).unionByName(
        flags.select(*keys, F.lit(0).alias("c"), F.lit(1).alias("f"))
    )
    out = both.groupBy(*keys).agg(F.sum("c").alias("corrections_count"), F.sum("f").alias("flags_count"))
    return out.withColumn("total_feedback", F.col("corrections_count") + F.col("flags_count")).withColumn(
        "enough_for_retrain", F.col("total_feedback") >= min_samples
    )


def summary(corrections: DataFrame, flags: DataFrame, keys: Sequence[str], min_samples: int = 50, min_count: int = 5,
            show: int = 3) -> DataFrame:
    """`totals` and `pattern_summary` in one pass: both sides are counted by segment once, and all else follows from counts.

    pattern_count is 0 and top_patterns empty where no segment has min_count corrections. What a task sorts for a key is a row
    per segment.
    """
    keys = list(keys)
    both = corrections.select(*keys, F.coalesce("segment", F.lit("unknown")).alias("segment"), F.lit(1).alias("c"), F.lit(0).alias("f"))
    both = both.unionByName(flags.select(*keys, F.lit(None).cast("string").alias("segment"), F.lit(0).alias("c"), F.lit(1).alias("f")))
    counts = both.groupBy(*keys, "segment").agg(F.sum("c").alias("count"), F.sum("f").alias("flags"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), F.asc_nulls_last("segment")))
    found = F.col("count") >= min_count
    shown = F.when(found & (F.col("_place") <= show), F.struct("_place", "segment", "count"))
    out = counts.withColumn("_place", place).groupBy(*keys).agg(
        F.sum("count").alias("corrections_count"), F.sum("flags").alias("flags_count"),
        F.count_if(found & F.col("segment").isNotNull()).alias("pattern_count"), F.array_sort(F.collect_list(shown)).alias("_shown"))
    top = F.transform("_shown", lambda e: F.struct(
        e["segment"].alias("segment"), e["count"].alias("count"), (e["count"] / F.col("corrections_count")).alias("percentage")))
    total = F.col("corrections_count") + F.col("flags_count")
    return out.withColumn("top_patterns", top).drop("_shown").withColumn("total_feedback", total).withColumn(
        "enough_for_retrain", total >= min_samples)


def segment_errors(rows: DataFrame, keys: Sequence[str], segment: str, is_error: str, above: float = 0.1) -> DataFrame:
    """Error rate and sample count per segment, above the limit only."""
    return (
        rows.groupBy(*keys, segment)
        .agg(F.avg(F.col(is_error).cast("double")).alias("error_rate"), F.count(F.lit(1)).alias("count"))
        .where(F.col("error_rate") > above)
    )
