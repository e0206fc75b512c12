"""Append-only tables for decisions, traces, events, runs, models and promotions.

Parquet has no upsert. Every write appends, with a write time; readers take the newest row per key
(`latest_by`). Tables are partitioned by month so that reads with `since` prune; rows are rebalanced by
month before a write, which keeps files few and splits a month that is too large for one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwarden.functions.text import REASONING_TYPE, short_id
from modelwarden.operators.ordered import latest_by

SCHEMAS = {
    "decisions": (
        f"id string, trace_id string, agent_name string, action string, approved boolean, reasoning {REASONING_TYPE}, "
        "artifacts map<string,string>, metadata string, timestamp timestamp, escalate_to_human boolean, "
        "escalation_reason string"
    ),
    "traces": "trace_id string, pipeline_name string, started_at timestamp, completed_at timestamp, status string",
    "events_log": "id string, type string, source string, payload string, trace_id string, timestamp timestamp",
    "runs": (
        "run_id string, experiment_name string, params map<string,string>, metrics map<string,double>, "
        "tags map<string,string>, timestamp timestamp"
    ),
    "models": (
        "model_name string, version string, version_n int, artifact_uri string, metrics map<string,double>, "
        "stage string, created_at timestamp"
    ),
    "promotions": "model_name string, version string, stage string, ts timestamp",
}
KEYS = {"decisions": ["id"], "traces": ["trace_id"], "runs": ["run_id"], "models": ["model_name", "version_n"]}
TIMES = {"decisions": "timestamp", "traces": "started_at", "events_log": "timestamp", "runs": "timestamp",
         "models": "created_at", "promotions": "ts"}


def append(df: DataFrame, root: str, table: str, written_at: Column | None = None, sequence: Column | None = None) -> None:
    """Append rows. Versions of one key are ordered by write time, then by `write_seq`: `sequence`, or the row's own time.

    Both depend on the row only, so a repeated task writes the same order. Rows of one key in one write that have the same
    time need a sequence.
    """
    own = F.unix_micros(F.col(TIMES[table]).cast("timestamp"))
    columns = [f.strip().split(" ")[0] for f in _top_level(SCHEMAS[table])]
    (
        df.select(*columns)
        .withColumn("write_ts", written_at if written_at is not None else F.current_timestamp())
        .withColumn("write_seq", (own if sequence is None else sequence).cast("bigint"))
        .withColumn("month", F.date_format(TIMES[table], "yyyy-MM"))
        .hint("rebalance", F.col("month"))
        .write.mode("append").partitionBy("month").parquet(f"{root}/{table}")
    )


def _top_level(ddl: str) -> list[str]:
    out, depth, current = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(current)
            current = ""
        else:
            current += ch
    return [*out, current]


def history(spark: SparkSession, root: str, table: str, since: str | None = None) -> DataFrame:
    """Every row written. `since` (yyyy-MM) reads only the partitions from that month on."""
    schema = f"{SCHEMAS[table]}, write_ts timestamp, write_seq bigint, month string"
    rows = spark.read.schema(schema).parquet(f"{root}/{table}")
    return rows if since is None else rows.where(F.col("month") >= since)


def current(spark: SparkSession, root: str, table: str, since: str | None = None) -> DataFrame:
    """The newest row per key (event and promotion tables: every row), of those only the ones from month `since` on.

    The newest version of a key may lie in an earlier month than an older one, so keyed tables are read whole.
    """
    if table not in KEYS:
        return history(spark, root, table, since).drop("write_ts", "write_seq", "month")
    rows = latest_by(history(spark, root, table), KEYS[table], ["write_ts", "write_seq"])
    return (rows if since is None else rows.where(F.col("month") >= since)).drop("write_ts", "write_seq", "month")


def named_runs(runs: DataFrame) -> DataFrame:
    """Runs with the default experiment name and a stable id where none was given."""
    given = F.nullif(F.col("run_id"), F.lit(""))
    made = short_id(F.col("experiment_name"), F.col("timestamp"), F.to_json("metrics"), F.to_json("params"))
    return runs.withColumn("run_id", F.coalesce(given, made)).withColumn(
        "experiment_name", F.coalesce(F.nullif(F.col("experiment_name"), F.lit("")), F.lit("default"))
    )


class RunNotFound(ValueError):
    pass


def find_run(runs: DataFrame, run_id: str) -> DataFrame:
    """The run with this id in any experiment; an error if there is none."""
    hit = runs.where(F.col("run_id") == run_id)
    if hit.isEmpty():
        raise RunNotFound(f"Run not found: {run_id}")
    return hit


def compact(spark: SparkSession, root: str, table: str, target: str) -> None:
    """Rewrite the newest rows to a new path; readers switch paths, nothing is replaced in place."""
    rows = history(spark, root, table)
    if table in KEYS:
        rows = latest_by(rows, KEYS[table], ["write_ts", "write_seq"])
    rows.hint("rebalance", F.col("month")).write.mode("errorifexists").partitionBy("month").parquet(f"{target}/{table}")


def request_window(requests: DataFrame, endpoint: str, minutes: int, now: Column | None = None) -> DataFrame:
    """Requests of one endpoint in the trailing window. Without `now` the newest request is the end."""
    mine = requests.where(F.col("endpoint_id") == endpoint)
    if now is None:
        newest = mine.agg(F.max("ts")).scalar()
        return mine.where(F.col("ts") >= newest - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    return mine.where((F.col("ts") >= now - F.expr(f"INTERVAL {int(minutes)} MINUTES")) & (F.col("ts") <= now))
