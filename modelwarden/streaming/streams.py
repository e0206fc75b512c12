"""Structured Streaming forms: windows, sessions, routing, de-duplication, continuous gates, file feeds.

Aggregates run in update mode into `batch_sink`, which writes one folder per micro-batch; a replayed
batch overwrites its own folder. `latest_result` then gives the newest row per key. Event time must be
TIMESTAMP (`event_time` casts).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from modelwarden.operators import gates, serving
from modelwarden.operators.ordered import latest_by
from modelwarden.operators.routing import route_static

Sink = Callable[[DataFrame, int], None]
#: What a query of this module needs to find in the session when it starts: state on disk, sessions merged before the shuffle.
START_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}
#: Rows keep their microseconds as JSON text.
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def read_files(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, max_files: int | None = None) -> DataFrame:
    """Streaming file source with a fixed schema (taken from the files now present if not given)."""
    schema = schema if schema is not None else spark.read.format(fmt).load(path).schema
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def event_time(stream: DataFrame, ts: str, delay: str | None = "1 hour") -> DataFrame:
    out = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, delay) if delay else out


def batch_folder(folder: str, batch_id: int) -> str:
    return f"{folder}/batch={batch_id}"


def batch_sink(folder: str) -> Sink:
    """Write each micro-batch to its own folder; writing a batch again replaces it."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(batch_folder(folder, batch_id))

    return write


@contextmanager
def settings(spark: SparkSession, wanted: Mapping[str, str]) -> Iterator[None]:
    """Session settings for the time in which a query starts, as it keeps those that it finds then."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available(stream: DataFrame, sink: Sink, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available, then stop. For a service use a processing-time trigger instead."""
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    with settings(stream.sparkSession, START_SETTINGS):
        started = q.trigger(availableNow=True).start()
    started.awaitTermination()
    return started


def results(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Rows written by `batch_sink`, with their batch number."""
    numbered = StructType([*schema.fields, StructField("batch", LongType())])
    return spark.read.schema(numbered).parquet(folder)


def latest_result(spark: SparkSession, folder: str, schema, keys: Sequence[str]) -> DataFrame:
    return latest_by(results(spark, folder, schema), keys, ["batch"]).drop("batch")


# --- windows --------------------------------------------------------------------------------------
def endpoint_windows(requests: DataFrame, keys: Sequence[str], width: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    return serving.windowed_metrics(event_time(requests, "ts", delay), keys, width)


def endpoint_panes(requests: DataFrame, keys: Sequence[str], width: str, slide: str, delay: str = "1 hour") -> DataFrame:
    """Panes of sliding windows: the state holds one sketch per key and pane, and a request updates one of them."""
    return serving.pane_sketches(event_time(requests, "ts", delay), keys, width, slide)


def sliding_windows(spark: SparkSession, folder: str, panes: StructType, keys: Sequence[str], width: str, slide: str) -> DataFrame:
    """Sliding windows from the newest version of the panes in a folder of `batch_sink`."""
    return serving.merge_panes(latest_result(spark, folder, panes, [*keys, "pane_start"]), keys, width, slide)


def session_counts(events: DataFrame, keys: Sequence[str], gap: str, delay: str = "1 hour") -> DataFrame:
    """Sessions per key. Only closed sessions are emitted (append mode).

    Rows of a session are merged inside each task before the shuffle (START_SETTINGS), so a busy key sends sessions.
    """
    out = event_time(events, "ts", delay).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n_events"))
    return out.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def continuous_health(requests: DataFrame, keys: Sequence[str], width: str = "15 minutes", **limits) -> DataFrame:
    """Health gate on every endpoint window: a streaming aggregate followed by stateless columns."""
    windows = endpoint_windows(requests, keys, width)
    named = windows.withColumnsRenamed({c: c.removeprefix("approx_") for c in windows.columns})
    return gates.health_gate(named, **limits)


def continuous_feedback(feedback: DataFrame, keys: Sequence[str], interval: str = "1 hour", delay: str = "1 hour", **limits) -> DataFrame:
    """Feedback per interval with the sufficiency rule. Columns: keys, ts, kind (correction / flag)."""
    w = F.window("ts", interval)
    agg = event_time(feedback, "ts", delay).groupBy(w.alias("w"), *keys).agg(
        F.count_if(F.col("kind") == "correction").alias("corrections_count"),
        F.count_if(F.col("kind") == "flag").alias("flags_count"))
    flat = agg.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "corrections_count", "flags_count")
    return gates.feedback_gate(flat, **limits)


class RunOutcome(StatefulProcessor):
    """State of one run: its first decisions in time order as a list, and the time of its newest one."""

    def __init__(self, max_stages: int, expire_ms: int):
        self.max_stages, self.expire_ms = max_stages, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getListState("first", "at bigint, id string, escalated boolean, action string")
        self.newest = handle.getValueState("newest", "at bigint")

    def handleInputRows(self, key, rows, timerValues):
        kept = [tuple(r) for r in self.first.get()]
        newest = self.newest.get()[0] if self.newest.exists() else 0
        for batch in rows:
            new = zip(batch["at"].tolist(), batch["id"], batch["escalated"].astype(bool).tolist(), batch["action"])
            kept = sorted([*kept, *new])[: self.max_stages]
            newest = max(newest, int(batch["at"].max()))
        self.first.put(kept)
        self.newest.update((newest,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(newest // 1000, timerValues.getCurrentWatermarkInMs()) + self.expire_ms)
        stop = next((i for i, row in enumerate(kept) if row[2]), None)
        stages = len(kept) if stop is None else stop + 1
        status = "escalated" if stop is not None else "failed" if stages >= self.max_stages else "running"
        yield pd.DataFrame({"trace_id": [key[0]], "stages": [stages], "status": [status], "last_action": [kept[stages - 1][3]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.first.clear()
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def running_outcomes(decisions: DataFrame, max_stages: int = 20, delay: str = "1 day", expire_hours: int = 24 * 7) -> DataFrame:
    """Run state per trace while its decisions arrive: stages so far, status, last action.

    A run ends at its first escalation or at the stage limit, in time order, whatever order decisions arrive in. The state
    of a trace is its first `max_stages` decisions, however many come; a timer drops it `expire_hours` after the newest one.
    """
    rows = event_time(decisions, "timestamp", delay).select(
        "trace_id", "timestamp", F.unix_micros("timestamp").alias("at"), F.col("id").cast("string").alias("id"),
        F.col("escalate_to_human").alias("escalated"), F.concat("agent_name", F.lit("/"), "action").alias("action"))
    return rows.groupBy("trace_id").transformWithStateInPandas(
        RunOutcome(max_stages, expire_hours * 3_600_000), "trace_id string, stages bigint, status string, last_action string",
        "Update", "EventTime")


class NewestRows(StatefulProcessor):
    """State of one group of a feed: its newest n rows. Gives the rows of a batch that are among them."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "at bigint, id string, row string")

    def handleInputRows(self, key, rows, timerValues):
        before = [tuple(r) for r in self.kept.get()]
        kept = before
        for batch in rows:
            kept = sorted([*kept, *zip(batch["at"].tolist(), batch["id"], batch["row"])], reverse=True)[: self.n]
        self.kept.put(kept)
        added = Counter(kept) - Counter(before)
        if added:
            yield pd.DataFrame(list(added.elements()), columns=["at", "id", "row"])

    def close(self) -> None:
        pass


def newest_rows(stream: DataFrame, n: int = 1000, salts: int = 64, ts: str = "timestamp", key: str = "id") -> DataFrame:
    """The rows of each batch that can be among the newest n of all so far, for `history_sink`.

    The feed is dealt to `salts` groups by its key, each with its newest n rows as state: what a batch hands on is at most
    n rows a group, and less and less as the history fills.
    """
    row = F.to_json(F.struct(*stream.columns), JSON_TIMES).alias("row")
    packed = stream.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(key).cast("string").alias("id"), row,
                           F.pmod(F.xxhash64(key), F.lit(salts)).alias("salt"))
    out = packed.groupBy("salt").transformWithStateInPandas(NewestRows(n), "at bigint, id string, row string", "Append", "None")
    return out.select(F.from_json("row", stream.schema, JSON_TIMES).alias("r")).select("r.*")


def first_copies(stream: DataFrame, key: str) -> DataFrame:
    """One row per key of every Arrow batch of a task: a key that comes again and again sends few rows on."""

    at = stream.columns.index(key)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = pc.dictionary_encode(batch.column(at), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            yield batch.take(pa.array(np.sort(np.unique(codes, return_index=True)[1])))

    return stream.mapInArrow(pick, stream.schema)


def unique_decisions(decisions: DataFrame, delay: str = "1 hour", key: str = "id", ts: str = "timestamp") -> DataFrame:
    """Drop repeats of an id that arrive within the watermark delay of each other.

    Copies are first combined inside each task, so an id that comes without end sends few rows. The state holds the ids of the
    delay; a batch reads its own rows and looks its own ids up, however much has been logged.
    """
    rows = first_copies(decisions.withColumn(ts, F.col(ts).cast("timestamp")), key)
    return event_time(rows, ts, delay).dropDuplicatesWithinWatermark([key])


# --- sinks ----------------------------------------------------------------------------------------
def routed_sink(subscriptions: list[tuple[str, str]], handlers: Mapping[str, Sink], dead_letters: str) -> Sink:
    """Deliver each event to every matching handler. A failing handler does not stop the others:
    its events go to the dead-letter folder with the error text."""

    def write(df: DataFrame, batch_id: int) -> None:
        routed = route_static(df, subscriptions).persist()
        failed = []
        for name in sorted({h for _, h in subscriptions}):
            mine = routed.where(F.col("handler") == name)
            try:
                handlers[name](mine, batch_id)
            except Exception as e:  # a handler is user code
                failed.append(mine.withColumn("error", F.lit(f"{type(e).__name__}: {e}")))
        path = batch_folder(dead_letters, batch_id)
        letters = routed.where(F.lit(False)).withColumn("error", F.lit(""))
        for f in failed:
            letters = letters.unionByName(f)
        letters.write.mode("overwrite").parquet(path)
        routed.unpersist()

    return write


def save_watermarks(query: StreamingQuery, folder: str) -> None:
    """The watermark that the engine used in every batch of a query's run, from its progress: (batch, watermark).

    Progress goes back spark.sql.streaming.numRecentProgressUpdates batches; a service saves from time to time, and rows
    saved twice are equal.
    """
    spark = SparkSession.active()
    used = {p["batchId"]: p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in p["eventTime"]}
    rows = spark.createDataFrame(sorted(used.items()), "batch bigint, watermark string")
    rows.withColumn("watermark", F.col("watermark").cast("timestamp")).coalesce(1).write.mode("overwrite").parquet(
        f"{folder}/run={query.runId}")


def split_late(spark: SparkSession, folder: str, schema, watermarks: str, ts: str, lag: int = 0) -> DataFrame:
    """Rows of a `batch_sink` folder with `late`: at or before the watermark that the engine had for their batch.

    Operators with state drop rows by the watermark of the batch before, which is the same once the engine has had an empty
    batch between; lag=1 gives what they drop while every batch has data.
    """
    used = spark.read.schema("batch bigint, watermark timestamp").parquet(watermarks).distinct()
    used = used.withColumn("batch", F.col("batch") + lag)
    rows = results(spark, folder, schema).join(used, "batch", "left")
    return rows.withColumn("late", F.coalesce(F.col(ts) <= F.col("watermark"), F.lit(False))).drop("batch", "watermark")


def history_sink(folder: str, schema, n: int = 1000) -> Sink:
    """Bounded history: the newest n events after each batch, in a new folder per batch."""

    def write(df: DataFrame, batch_id: int) -> None:
        rows = df
        if batch_id > 0:
            rows = rows.unionByName(df.sparkSession.read.schema(schema).parquet(batch_folder(folder, batch_id - 1)))
        rows.orderBy(F.desc("timestamp"), F.desc("id")).limit(n).write.mode("overwrite").parquet(batch_folder(folder, batch_id))

    return write


def new_file_gate(files: DataFrame, columns: Sequence[str], name: Column | None = None, **limits) -> DataFrame:
    """Gate rows for the files of one batch: profile per file in one aggregation, then the data gate."""
    per = files.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("num_rows"), *[F.avg(F.col(c).isNull().cast("double")).alias(f"_{c}") for c in columns])
    rates = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"_{c}"))])
    subject = per.select("file_path", (name if name is not None else F.col("file_path")).alias("dataset_name"), "num_rows",
                         rates.alias("null_rates"))
    return gates.data_gate(subject, **limits)


def arrivals_sink(folder: str, columns: Sequence[str], dataset: Column) -> Sink:
    """Keep the rows of a feed as they arrive, with partial counts per dataset, so a dataset may span batches."""

    def write(df: DataFrame, batch_id: int) -> None:
        rows = df.withColumn("dataset_name", dataset)
        rows.write.mode("overwrite").parquet(batch_folder(f"{folder}/rows", batch_id))
        counts = rows.groupBy("dataset_name").agg(
            F.count(F.lit(1)).alias("num_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        counts.write.mode("overwrite").parquet(batch_folder(f"{folder}/counts", batch_id))

    return write


def feed_sink(folder: str, columns: Sequence[str], dataset: Column) -> Sink:
    """`arrivals_sink` for a feed of several formats (`sources.files.feed`): counts rows and broken records, and keeps both apart.

    Files without a row count as a dataset of 0 rows. Broken records go to `broken`, and their share is the null rate of `parsed`.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        rows = df.withColumn("dataset_name", dataset).persist()
        good = F.col("is_row") & F.col("unparsed").isNull()
        rows.where(good).drop("is_row", "unparsed").write.mode("overwrite").parquet(batch_folder(f"{folder}/rows", batch_id))
        rows.where("unparsed is not null").select("dataset_name", "file_path", "unparsed").write.mode("overwrite").parquet(
            batch_folder(f"{folder}/broken", batch_id))
        counts = rows.groupBy("dataset_name").agg(
            F.count_if("is_row").alias("num_rows"), *[F.count_if(good & F.col(c).isNull()).alias(c) for c in columns],
            F.count_if(F.col("is_row") & F.col("unparsed").isNotNull()).alias("parsed"))
        counts.write.mode("overwrite").parquet(batch_folder(f"{folder}/counts", batch_id))
        rows.unpersist()

    return write


def gate_arrivals(spark: SparkSession, folder: str, columns: Sequence[str], **limits) -> DataFrame:
    """One gate row per dataset over all that has arrived of it, in however many files and batches."""
    counts = spark.read.parquet(f"{folder}/counts").groupBy("dataset_name").agg(
        *[F.sum(c).alias(c) for c in ("num_rows", *columns)])
    # a dataset without rows has no rates
    rates = F.create_map(*[x for c in columns for x in (F.lit(c), F.try_divide(F.col(c), F.col("num_rows")))])
    return gates.data_gate(counts.select("dataset_name", "num_rows", rates.alias("null_rates")), **limits)


def accepted_arrivals(spark: SparkSession, folder: str, decided: DataFrame) -> DataFrame:
    """The rows of the datasets that the gate approved."""
    rows = spark.read.parquet(f"{folder}/rows").drop("batch")
    return rows.join(decided.where("approved").select("dataset_name"), "dataset_name", "left_semi")


def new_file_sink(folder: str, columns: Sequence[str], **limits) -> Sink:
    def write(df: DataFrame, batch_id: int) -> None:
        new_file_gate(df, columns, **limits).write.mode("overwrite").parquet(batch_folder(folder, batch_id))

    return write
