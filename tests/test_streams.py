"""Streams over files that arrive one per micro-batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from modelwarden.operators import serving
from modelwarden.streaming import streams

SCHEMA = "id string, k string, ts timestamp, code string, ms double"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


@pytest.fixture
def feed(spark, tmp_path):
    """Two files, read one per batch, in this order; the second holds a late row."""
    first = [("a", "x", at(1), "200", 10.0), ("b", "x", at(14), "500", 20.0), ("c", "y", at(200), "200", 30.0)]
    second = [("b", "x", at(14), "500", 20.0), ("d", "y", at(210), "200", 5.0), ("e", "x", at(2), "200", 7.0)]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p{i}")
    return streams.read_files(spark, f"{tmp_path}/in/*", schema=SCHEMA, max_files=1), spark.createDataFrame(first + second, SCHEMA)


def renamed(df):
    return df.select(F.col("k").alias("endpoint_id"), "ts", F.col("code").alias("response_code"), F.col("ms").alias("latency_ms"))


def test_windows_equal_batch(spark, feed, tmp_path, rows):
    stream, batch = feed
    w = streams.endpoint_windows(renamed(stream), ["endpoint_id"], delay="2 days")
    streams.run_available(w, streams.batch_sink(f"{tmp_path}/out"), f"{tmp_path}/ck", "update")
    got = streams.latest_result(spark, f"{tmp_path}/out", w.schema, ["endpoint_id", "window_start", "window_end"])
    exact = serving.windowed_metrics(renamed(batch), ["endpoint_id"])  # windows of few rows, where sketches are exact too
    assert rows(got.select(*w.columns)) == rows(exact.select(*[c.removeprefix("approx_") for c in w.columns]))


def test_sliding_windows_equal_batch(spark, feed, tmp_path, rows):
    """Windows merged from panes, where sketches of few rows are exact; a request is in one pane only."""
    stream, batch = feed
    panes = streams.endpoint_panes(renamed(stream), ["endpoint_id"], "60 minutes", "20 minutes", delay="2 days")
    streams.run_available(panes, streams.batch_sink(f"{tmp_path}/out"), f"{tmp_path}/ck", "update")
    w = streams.sliding_windows(spark, f"{tmp_path}/out", panes.schema, ["endpoint_id"], "60 minutes", "20 minutes")
    exact = serving.windowed_metrics(renamed(batch), ["endpoint_id"], "60 minutes", "20 minutes")
    assert rows(w) == rows(exact.select(*[c.removeprefix("approx_") for c in w.columns]))
    plain = serving.windowed_metrics(renamed(batch).where("endpoint_id = 'x'"), ["endpoint_id"], "50 minutes", "20 minutes")
    assert sorted((r.window_start, r.request_count) for r in plain.collect()) == sorted(
        (r.w.start, r.n) for r in batch.where("k = 'x'").groupBy(F.window("ts", "50 minutes", "20 minutes").alias("w")).agg(
            F.count("*").alias("n")).collect())


def test_sliding_plan_copies_counts_only(feed):
    """Below the copies that go to every window there is an aggregate, not the requests."""
    _, batch = feed
    w = serving.windowed_metrics(renamed(batch), ["endpoint_id"], "60 minutes", "20 minutes")
    lines = w._jdf.queryExecution().optimizedPlan().toString().splitlines()
    copies = [i for i, line in enumerate(lines) if "Expand" in line]
    assert len(copies) == 1 and any("Aggregate" in line for line in lines[copies[0] + 1 :])


def test_unique(spark, feed, tmp_path):
    stream, _ = feed
    u = streams.unique_decisions(stream, "2 days", "id", "ts")
    streams.run_available(u, streams.batch_sink(f"{tmp_path}/out"), f"{tmp_path}/ck")
    assert sorted(r.id for r in streams.results(spark, f"{tmp_path}/out", u.schema).collect()) == ["a", "b", "c", "d", "e"]


@pytest.mark.parametrize("runs", [1, 2])
def test_late_rows_are_those_the_engine_drops(spark, feed, tmp_path, runs):
    """The split by the saved watermarks, against the rows that an aggregate on the same feed drops.

    In one run every batch has data, so state lags a batch; between two runs the aggregate has had an empty batch.
    """
    dropped = 0
    for i in range(2):
        rows = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in/p{i}")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/again/p{i}")
        if i or runs == 2:
            timed = streams.event_time(streams.read_files(spark, f"{tmp_path}/again/*", schema=SCHEMA, max_files=1), "ts", "1 hour")
            run = streams.run_available(timed, streams.batch_sink(f"{tmp_path}/all"), f"{tmp_path}/ck")
            streams.save_watermarks(run, f"{tmp_path}/marks")
            counted = timed.groupBy(F.window("ts", "1 second"), "id").count()
            run = streams.run_available(counted, streams.batch_sink(f"{tmp_path}/n"), f"{tmp_path}/ck2", "update")
            dropped += sum(o["numRowsDroppedByWatermark"] for p in run.recentProgress for o in p["stateOperators"])
    late = streams.split_late(spark, f"{tmp_path}/all", timed.schema, f"{tmp_path}/marks", "ts", lag=2 - runs)
    assert sorted(r.id for r in late.where("late").collect()) == ["b", "e"][: 2 * (runs - 1)]
    assert late.count() == 6 and dropped == late.where("late").count()
    now = streams.split_late(spark, f"{tmp_path}/all", timed.schema, f"{tmp_path}/marks", "ts")
    assert sorted(r.id for r in now.where("late").collect()) == ["b", "e"]


def test_unique_over_runs_reads_new_rows_only(spark, tmp_path):
    """Four runs on one checkpoint: ids known from earlier runs are left out, and no batch reads more than its own rows."""
    for i in range(4):
        rows = [(f"{k}", "x", at(i), "200", 1.0) for k in range(10 * i, 10 * i + 20) for _ in range(3)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        u = streams.unique_decisions(streams.read_files(spark, f"{tmp_path}/in", schema=SCHEMA), "2 days", "id", "ts")
        run = streams.run_available(u, streams.batch_sink(f"{tmp_path}/out"), f"{tmp_path}/ck")
        assert sum(p["numInputRows"] for p in run.recentProgress) == 60
    got = [r.id for r in streams.results(spark, f"{tmp_path}/out", u.schema).collect()]
    assert len(got) == 50 and len(set(got)) == 50


def test_copies_are_combined_before_the_shuffle(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(1000)] + [(None, 1), (None, 2), ("a", 3)], "id string, n int").coalesce(1)
    assert sorted(str(r.id) for r in streams.first_copies(rows, "id").collect()) == ["None", "a", "hot"]


def test_history_from_state_over_a_restart(spark, tmp_path):
    """The newest three of four runs on one checkpoint; a run hands on only rows that can be among them."""
    handed = 0
    for i, minutes in enumerate(([5, 9, 1], [2, 3, 4, 0], [8, 9, 7], [6])):
        rows = [(f"r{i}{m}", "x", at(m), "200", 1.0) for m in minutes]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        d = streams.read_files(spark, f"{tmp_path}/in", schema=SCHEMA).select("id", F.col("ts").alias("timestamp"))
        sink, seen = streams.history_sink(f"{tmp_path}/h", d.schema, 3), []
        streams.run_available(streams.newest_rows(d, 3, salts=1), lambda df, b: (seen.append((b, df.count())), sink(df, b)), f"{tmp_path}/ck")
        handed += sum(n for _, n in seen)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/h/batch={seen[-1][0]}").collect()) == ["r09", "r28", "r29"]
    assert handed == 3 + 1 + 2 + 0


def test_outcomes_over_a_restart(spark, tmp_path, rows):
    """A run's decisions come in two runs on one checkpoint, out of order; the state carries over."""
    for part in ([("a", 3, False), ("b", 5, True)], [("c", 1, False), ("d", 9, False)]):
        new = [("t", at(m), i, "ag", i, e) for i, m, e in part]
        schema = "trace_id string, timestamp timestamp, id string, agent_name string, action string, escalate_to_human boolean"
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        o = streams.running_outcomes(streams.read_files(spark, f"{tmp_path}/in", schema=schema))
        streams.run_available(o, streams.batch_sink(f"{tmp_path}/o"), f"{tmp_path}/ck", "update")
    got = streams.latest_result(spark, f"{tmp_path}/o", o.schema, ["trace_id"])
    assert rows(got, "trace_id", "stages", "status", "last_action") == [("t", 3, "escalated", "ag/b")]


def test_failing_handler(spark, feed, tmp_path):
    stream, _ = feed

    def broken(df, batch_id):
        raise ValueError("no disk")

    ev = stream.select("id", F.concat(F.lit("model."), "k").alias("type"))
    sink = streams.routed_sink([("model.*", "good"), ("*.x", "bad")], {"good": streams.batch_sink(f"{tmp_path}/good"), "bad": broken}, f"{tmp_path}/dead")
    streams.run_available(ev, sink, f"{tmp_path}/ck")
    assert spark.read.parquet(f"{tmp_path}/good").count() == 6
    dead = spark.read.parquet(f"{tmp_path}/dead").collect()
    assert len(dead) == 4 and {r.error for r in dead} == {"ValueError: no disk"}


def test_new_files(spark, feed, tmp_path):
    stream, _ = feed
    files = stream.withColumn("file_path", F.col("_metadata.file_path")).withColumn("code", F.nullif(F.col("code"), F.lit("500")))
    streams.run_available(files, streams.new_file_sink(f"{tmp_path}/g", ["code", "ms"], min_rows=2, max_null_rate=0.4), f"{tmp_path}/ck")
    got = spark.read.parquet(f"{tmp_path}/g").collect()
    assert [r.num_rows for r in got] == [3, 3] and all(r.approved for r in got)


def test_outcomes_and_feedback(spark, feed, tmp_path, rows):
    stream, _ = feed
    d = stream.select(F.col("k").alias("trace_id"), F.col("ts").alias("timestamp"), "id", F.lit("ag").alias("agent_name"), F.col("id").alias("action"),
                      (F.col("id") == "d").alias("escalate_to_human"))
    o = streams.running_outcomes(d, 4)
    streams.run_available(o, streams.batch_sink(f"{tmp_path}/o"), f"{tmp_path}/ck", "update")
    got = streams.latest_result(spark, f"{tmp_path}/o", o.schema, ["trace_id"])
    assert rows(got, "trace_id", "stages", "status", "last_action") == [("x", 4, "failed", "ag/b"), ("y", 2, "escalated", "ag/d")]
    kind = F.when(F.col("code") == "500", "flag").otherwise("correction")
    fb = streams.continuous_feedback(stream.select(F.col("k").alias("model_name"), "ts", kind.alias("kind")), ["model_name"], "1 day", "2 days", min_samples=4)
    streams.run_available(fb, streams.batch_sink(f"{tmp_path}/f"), f"{tmp_path}/ck2", "update")
    got = streams.latest_result(spark, f"{tmp_path}/f", fb.schema, ["model_name"])
    assert rows(got, "model_name", "total_feedback", "approved") == [("x", 4, True), ("y", 2, False)]


def test_feed_of_four_formats(spark, tmp_path, rows):
    from pyspark.sql.types import StructType

    from modelwarden.sources import files

    src = tmp_path / "in"
    (src / "deep").mkdir(parents=True)
    schema = StructType.fromDDL("id bigint, x double")
    (src / "a.csv").write_text("id,x\n1,0.5\nbad,2.5\n2,\n")
    (src / "b.jsonl").write_text('{"id": 3, "x": 1.5}\n{"id": \n')
    (src / "deep" / "c.json").write_text('[{"id": 4, "x": 2.5},\n {"id": 5}]')
    (src / "d.json").write_text("[]")
    (src / "e.csv").write_text("id,x\n")
    (src / "notes.txt").write_text("1,2\n")
    spark.createDataFrame([(6, 3.5)], schema).coalesce(1).write.parquet(str(src / "p"))
    out = str(tmp_path / "out")
    name = F.regexp_extract("file_path", r"([a-z]+)\.[a-z]+$", 1)
    name = F.when(F.endswith("file_path", F.lit(".parquet")), "p").otherwise(name)
    streams.run_available(files.feed(spark, str(src), schema, max_files=1), streams.feed_sink(out, ["x"], name), str(tmp_path / "cp"))
    got = rows(streams.gate_arrivals(spark, out, ["x", "parsed"], min_rows=1, max_null_rate=0.4), "dataset_name", "num_rows", "approved")
    assert got == [("a", 3, True), ("b", 2, False), ("c", 2, False), ("d", 0, True), ("e", 0, True), ("p", 1, True)]
    assert rows(spark.read.parquet(f"{out}/rows"), "id", "x") == [(1, 0.5), (2, None), (3, 1.5), (4, 2.5), (5, None), (6, 3.5)]
    assert rows(spark.read.parquet(f"{out}/broken"), "dataset_name", "unparsed") == [("a", "bad,2.5"), ("b", '{"id": ')]


def test_feed_of_many_small_files_takes_few_batches(spark, tmp_path):
    from pyspark.sql.types import StructType

    from modelwarden.sources import files

    src = tmp_path / "in"
    src.mkdir()
    for i in range(40):
        (src / f"{i}.jsonl").write_text(f'{{"id": {i}}}\n')
    schema, out = StructType.fromDDL("id bigint"), str(tmp_path / "out")
    sink = streams.feed_sink(out, ["id"], F.lit("all"))
    q = streams.run_available(files.feed(spark, str(src), schema, max_bytes=1 << 20), sink, str(tmp_path / "cp"))
    assert sum(p["numInputRows"] > 0 for p in q.recentProgress) == 1  # five with eight files a batch
    assert spark.read.parquet(f"{out}/rows").agg(F.sum("id")).first()[0] == sum(range(40))
