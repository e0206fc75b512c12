"""Endpoint metrics from request rows, traffic splits and canary rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwarden.functions.numbers import safe_ratio
from modelwarden.operators.ordered import SLICE_ROWS, exact_percentiles, scan

PERCENTILES = {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95, "latency_p99_ms": 0.99}
ACCURACY = 10_000
#: Size of a pane's sketch: ranks are within 0.1 % of the requests.
SKETCH_K = 8192


def server_error(code: Column) -> Column:
    """Response codes that start with 5; a missing code counts as 200."""
    return F.startswith(F.coalesce(code.cast("string"), F.lit("200")), F.lit("5"))


def _sketched(requests: DataFrame, by: Sequence[str | Column], code: str, latency: str) -> DataFrame:
    """Counts, and percentiles from bounded sketches that combine map-side: within 1/ACCURACY of the rank."""
    agg = requests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("request_count"), F.count_if(server_error(F.col(code))).alias("error_count"),
        F.percentile_approx(latency, list(PERCENTILES.values()), ACCURACY).alias("_p"))
    out = agg.withColumn("error_rate", safe_ratio(F.col("error_count"), F.col("request_count")))
    return out.withColumns({f"approx_{name}": F.col("_p")[i] for i, name in enumerate(PERCENTILES)}).drop("_p")


def endpoint_metrics(
    requests: DataFrame, keys: Sequence[str], code: str = "response_code", latency: str = "latency_ms",
    exact: bool = True, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Request and error counts, error rate and latency percentiles per key.

    exact: requests are counted per latency value and the counts cumulated, which shuffles one row per distinct
    value. Otherwise the percentiles are called approx_* and come from sketches.
    """
    keys = list(keys)
    if not exact:
        return _sketched(requests, keys, code, latency)
    counts = requests.groupBy(*keys, latency).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(server_error(F.col(code))).alias("_e"))
    also = {"request_count": "_n", "error_count": "_e"}
    out = exact_percentiles(counts, keys, latency, "_n", PERCENTILES, also, slice_rows)
    return out.withColumn("error_rate", safe_ratio(F.col("error_count"), F.col("request_count")))


def pane_width(width: str, slide: str) -> str:
    """The longest time that divides both, so that every window is a whole number of panes."""
    micros = math.gcd(*(int(pd.Timedelta(t) / pd.Timedelta(microseconds=1)) for t in (width, slide)))
    return f"{micros} microseconds"


def windowed_metrics(
    requests: DataFrame, keys: Sequence[str], width: str = "15 minutes", slide: str | None = None, ts: str = "ts",
) -> DataFrame:
    """Tumbling or sliding endpoint metrics with flat window_start / window_end.

    A batch gets exact percentiles. Sliding windows are made of panes: requests are counted once per pane and latency value,
    and only these counts go to every window of their pane. A stream, whose state must stay bounded, gets sketches named
    approx_*, for tumbling windows; sliding ones are `pane_sketches` merged by `merge_panes`.
    """
    keys, bounds = list(keys), [F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end")]
    if requests.isStreaming:
        if slide:
            raise ValueError("keep pane_sketches of a stream, and merge_panes of what is kept")
        out = _sketched(requests, [F.window(ts, width).alias("w"), *keys], "response_code", "latency_ms")
        return out.select(*keys, *bounds, *[c for c in out.columns if c not in ("w", *keys)])
    pane = F.window(ts, pane_width(width, slide) if slide else width).alias("w")
    counts = requests.select(pane, *keys, "response_code", "latency_ms").groupBy("w", *keys, "latency_ms").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(server_error(F.col("response_code"))).alias("_e"))
    if slide:
        counts = counts.select(*keys, "latency_ms", "_n", "_e", F.window("w.start", width, slide).alias("w")).groupBy(
            "w", *keys, "latency_ms").agg(F.sum("_n").alias("_n"), F.sum("_e").alias("_e"))
    also = {"request_count": "_n", "error_count": "_e"}
    flat = counts.select(*keys, *bounds, "latency_ms", "_n", "_e")
    out = exact_percentiles(flat, [*keys, "window_start", "window_end"], "latency_ms", "_n", PERCENTILES, also)
    return out.withColumn("error_rate", safe_ratio(F.col("error_count"), F.col("request_count")))


def pane_sketches(requests: DataFrame, keys: Sequence[str], width: str, slide: str, ts: str = "ts") -> DataFrame:
    """Per key and pane: counts and a mergeable latency sketch. Every request is in one pane, whatever the windows."""
    agg = requests.groupBy(F.window(ts, pane_width(width, slide)).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("request_count"), F.count_if(server_error(F.col("response_code"))).alias("error_count"),
        F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), F.lit(SKETCH_K)).alias("sketch"))
    return agg.select(*keys, F.col("w.start").alias("pane_start"), "request_count", "error_count", "sketch")


def merge_panes(panes: DataFrame, keys: Sequence[str], width: str, slide: str) -> DataFrame:
    """Sliding windows with approx_* percentiles from the panes that they cover."""
    w = F.window("pane_start", width, slide).alias("w")
    merged = panes.select(w, *keys, "request_count", "error_count", "sketch").groupBy("w", *keys).agg(
        F.sum("request_count").alias("request_count"), F.sum("error_count").alias("error_count"),
        F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"))
    known = F.kll_sketch_get_n_double("sketch") > 0
    return merged.select(
        *keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "request_count", "error_count",
        safe_ratio(F.col("error_count"), F.col("request_count")).alias("error_rate"),
        *[F.when(known, F.kll_sketch_get_quantile_double("sketch", F.lit(p))).alias(f"approx_{name}") for name, p in PERCENTILES.items()])


def sessions(
    rows: DataFrame, keys: Sequence[str], ts: str, row_id: str, gap_seconds: int, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Sessions per key: a new one starts when the gap since the previous row reaches gap_seconds.

    Built from sliced scans, so one busy key does not land in one task.
    """
    keys = list(keys)
    base = rows.select(*keys, ts, row_id)
    lagged = scan(base, keys, [ts, row_id], prev={"_prev": ts}, slice_rows=slice_rows)
    quiet = F.col(ts) >= F.col("_prev") + F.expr(f"INTERVAL {int(gap_seconds)} SECONDS")
    flagged = lagged.withColumn("_new", F.when(F.col("_prev").isNull() | quiet, 1).otherwise(0)).drop("_prev")
    numbered = scan(flagged, keys, [ts, row_id], sums={"session_no": "_new"}, slice_rows=slice_rows)
    return numbered.groupBy(*keys, "session_no").agg(
        F.min(ts).alias("session_start"),
        (F.max(ts) + F.expr(f"INTERVAL {int(gap_seconds)} SECONDS")).alias("session_end"),
        F.count(F.lit(1)).alias("n_events"),
    )


def assign_traffic(rows: DataFrame, slot: Column, split: Mapping[str, int], output: str = "version") -> DataFrame:
    """Assign each row to a version by cumulative percent ranges; `slot` is an integer 0..99."""
    upper, ranges = 0, []
    for version, percent in split.items():
        upper += percent
        ranges.append((version, upper))
    if upper != 100:
        raise ValueError("split percentages must sum to 100")
    chosen = F.lit(ranges[-1][0])
    for version, limit in reversed(ranges[:-1]):
        chosen = F.when(slot < limit, F.lit(version)).otherwise(chosen)
    return rows.withColumn(output, chosen)


def key_slot(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(100))


def canary_rows(models: DataFrame, traffic_pct: int = 5) -> DataFrame:
    """Endpoint rows that start a canary: endpoint `<model>-canary` with its traffic share."""
    return models.select(
        F.concat("model_name", F.lit("-canary")).alias("endpoint_name"),
        "model_name",
        F.col("version").alias("model_version"),
        F.lit("creating").alias("status"),
        F.lit(traffic_pct).alias("canary_traffic_pct"),
        F.create_map(F.col("version"), F.lit(traffic_pct)).alias("traffic_split"),
    )


def prefer_measured(payload: DataFrame, measured: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Measured endpoint values replace payload values where they exist; otherwise payload, otherwise 0."""
    m = measured.select(key, *[F.col(c).alias(f"_m_{c}") for c in columns])
    joined = payload.join(m, key, "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(f"_m_{c}", c, F.lit(0.0))).drop(f"_m_{c}")
    return joined
