"""Streaming queries run to the end of the available input, so that they compare with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwarden.operators import gates
from modelwarden.operators.serving import PERCENTILES
from modelwarden.plans.catalog import query
from modelwarden.plans.views import DECISIONS_SQL, ESCALATED_SQL, REQUESTS_SQL, decision_columns, request_columns, table, with_ctes
from modelwarden.session import work_dir
from modelwarden.sources import files
from modelwarden.streaming import streams


def _events(spark, sf):
    # a glob, since the streaming source takes a pattern or a folder and the table may be a single file
    return streams.read_files(spark, f"{sf}/{{events}}.parquet", schema=table(spark, sf, "events").schema)


def _run(spark, frame, keys, mode="update"):
    folder = work_dir(spark, "stream")
    streams.run_available(frame, streams.batch_sink(f"{folder}/out"), f"{folder}/checkpoint", mode)
    schema = frame.schema
    if keys is None:
        return streams.results(spark, f"{folder}/out", schema).drop("batch")
    return streams.latest_result(spark, f"{folder}/out", schema, keys)


def _plain(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


#: Share of a window's rows by which the rank of an approximate percentile may be off.
RANK_TOLERANCE = 0.001
_COUNTS_SQL = """
  count(*) AS request_count, count(*) FILTER (WHERE response_code LIKE '5%') AS error_count,
  round(CAST(count(*) FILTER (WHERE response_code LIKE '5%') AS DOUBLE) / greatest(count(*), 1), 9) AS error_rate,
  CAST(count(latency_ms) AS BIGINT) AS ranked, TRUE AS ranks_ok"""


def _ranked(spark, sf, out, width, slide=None):
    """The stream's windows with whether each percentile's rank among the window's rows is within the tolerance."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = request_columns(table(spark, sf, "events")).select("endpoint_id", w.start.alias("window_start"), "latency_ms")
    rows = _plain(rows, "window_start")
    out = _plain(out, "window_start", "window_end")
    keys = ["endpoint_id", "window_start", "window_end", "request_count", "error_count", "error_rate"]
    names = {f"approx_{k}": p for k, p in PERCENTILES.items()}
    ranks = out.join(rows, ["endpoint_id", "window_start"]).groupBy(*keys).agg(
        F.count("latency_ms").alias("ranked"), *[F.count_if(F.col("latency_ms") < F.col(c)).alias(f"lt_{c}") for c in names],
        *[F.count_if(F.col("latency_ms") <= F.col(c)).alias(f"le_{c}") for c in names])
    n = F.col("ranked")
    fits = [(F.col(f"lt_{c}") < p * n + RANK_TOLERANCE * n + 1) & (F.col(f"le_{c}") > p * n - RANK_TOLERANCE * n - 1) for c, p in names.items()]
    return ranks.select(*keys, "ranked", (fits[0] & fits[1] & fits[2]).alias("ranks_ok")).withColumn("error_rate", F.round("error_rate", 9))


@query("stream_tumbling", with_ctes(REQUESTS_SQL) + f"""
SELECT endpoint_id, time_bucket(INTERVAL 6 HOURS, ts) AS window_start, time_bucket(INTERVAL 6 HOURS, ts) + INTERVAL 6 HOURS AS window_end, {_COUNTS_SQL} FROM requests GROUP BY 1, 2, 3""")
def stream_tumbling(spark, sf):
    w = streams.endpoint_windows(request_columns(_events(spark, sf)), ["endpoint_id"], "6 hours")
    return _ranked(spark, sf, _run(spark, w, ["endpoint_id", "window_start", "window_end"]), "6 hours")


@query("stream_sliding", with_ctes(REQUESTS_SQL, """
slid AS (SELECT r.*, time_bucket(INTERVAL 6 HOURS, ts) - o.k * INTERVAL 6 HOURS AS window_start FROM requests r CROSS JOIN (SELECT unnest(range(0, 4)) AS k) o)""") + f"""
SELECT endpoint_id, window_start, window_start + INTERVAL 24 HOURS AS window_end, {_COUNTS_SQL} FROM slid GROUP BY 1, 2""")
def stream_sliding(spark, sf):
    """The stream keeps panes of 6 hours; windows are merged from them."""
    keys, width, slide = ["endpoint_id"], "24 hours", "6 hours"
    panes = streams.endpoint_panes(request_columns(_events(spark, sf)), keys, width, slide)
    folder = work_dir(spark, "panes")
    streams.run_available(panes, streams.batch_sink(f"{folder}/out"), f"{folder}/checkpoint", "update")
    return _ranked(spark, sf, streams.sliding_windows(spark, f"{folder}/out", panes.schema, keys, width, slide), width, slide)


@query("stream_sessions", """
WITH lagged AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
numbered AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 12 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM lagged),
done AS (SELECT user_id, s, min(ts) AS session_start, max(ts) + INTERVAL 12 HOURS AS session_end, count(*) AS n_events FROM numbered GROUP BY 1, 2)
SELECT user_id, session_start, session_end, n_events FROM done WHERE session_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark, sf):
    """Closed sessions: append mode emits those that the watermark has passed."""
    s = streams.session_counts(_events(spark, sf).select("user_id", "ts"), ["user_id"], "12 hours")
    return _plain(_run(spark, s, None, "append"), "session_start", "session_end")


@query("stream_health", with_ctes(REQUESTS_SQL, """
w AS (SELECT endpoint_id, time_bucket(INTERVAL 24 HOURS, ts) AS window_start, CAST(count(*) FILTER (WHERE response_code LIKE '5%') AS DOUBLE) / greatest(count(*), 1) AS e FROM requests GROUP BY 1, 2)""") + """
SELECT endpoint_id, window_start, round(e, 9) AS error_rate, CASE WHEN e > 0.2 THEN 'critical' ELSE 'info' END AS severity, e <= 0.2 AS approved FROM w""")
def stream_health(spark, sf):
    h = streams.continuous_health(request_columns(_events(spark, sf)), ["endpoint_id"], "24 hours", error_rate_threshold=0.2)
    h = h.select("endpoint_id", "window_start", "error_rate", "severity", "approved")
    out = _run(spark, h, ["endpoint_id", "window_start"])
    return _plain(out, "window_start").withColumn("error_rate", F.round("error_rate", 9))


@query("stream_feedback", """
SELECT 'm' || CAST(user_id % 3 AS VARCHAR) AS model_name, time_bucket(INTERVAL 24 HOURS, ts) AS window_start, count(*) FILTER (WHERE event_type = 'signup') AS corrections_count,
  count(*) FILTER (WHERE event_type = 'click') AS flags_count, count(*) >= 45 AS approved FROM events WHERE event_type IN ('signup', 'click') GROUP BY 1, 2""")
def stream_feedback(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "correction").when(F.col("event_type") == "click", "flag")
    fb = _events(spark, sf).select(F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model_name"), "ts", kind.alias("kind"))
    g = streams.continuous_feedback(fb.where("kind IS NOT NULL"), ["model_name"], "24 hours", min_samples=45)
    g = g.select("model_name", "window_start", "corrections_count", "flags_count", "approved")
    return _plain(_run(spark, g, ["model_name", "window_start"]), "window_start")


@query("stream_outcomes", with_ctes(ESCALATED_SQL, """
runs AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY "timestamp", id) AS r FROM esc),
ends AS (SELECT trace_id, min(r) FILTER (WHERE escalate_to_human AND r <= 20) AS e, least(count(*), 20) AS m FROM runs GROUP BY 1)""") + """
SELECT trace_id, coalesce(e, m) AS stages, CASE WHEN e IS NOT NULL THEN 'escalated' WHEN m >= 20 THEN 'failed' ELSE 'running' END AS status,
  agent_name || '/' || action AS last_action FROM ends JOIN runs USING (trace_id) WHERE r = coalesce(e, m)""")
def stream_outcomes(spark, sf):
    d = gates.escalate(decision_columns(_events(spark, sf)), {"deployment": 0.2}, 0.1)
    return _run(spark, streams.running_outcomes(d), ["trace_id"])


@query("stream_unique", with_ctes(DECISIONS_SQL) + """
SELECT id, trace_id, action FROM decisions""")
def stream_unique(spark, sf):
    """Every event arrives twice, the second time in a later run; each decision is logged once, known from the state."""
    folder = work_dir(spark, "unique")
    twice = table(spark, sf, "events").withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2))))
    d = None
    for _ in range(2):
        twice.write.mode("append").parquet(f"{folder}/in")
        src = streams.read_files(spark, f"{folder}/in")
        d = streams.unique_decisions(decision_columns(src).select("id", "trace_id", "action", "timestamp"), "60 days")
        streams.run_available(d, streams.batch_sink(f"{folder}/out"), f"{folder}/checkpoint")
    return streams.results(spark, f"{folder}/out", d.schema).select("id", "trace_id", "action")


@query("stream_unique_watermark", with_ctes(DECISIONS_SQL) + """
SELECT id, trace_id, action FROM decisions""")
def stream_unique_watermark(spark, sf):
    twice = _events(spark, sf).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2))))
    d = streams.unique_decisions(decision_columns(twice)).select("id", "trace_id", "action")
    return _run(spark, d, None, "append")


_ROUTES = [("model.*", "registry"), ("model.deploy.*", "deployer"), ("*.analyze", "broken")]


@query("stream_routing", with_ctes(DECISIONS_SQL) + """
SELECT 'registry' AS handler, id, action AS type FROM decisions WHERE action LIKE 'model.%'
UNION ALL SELECT 'deployer', id, action FROM decisions WHERE action LIKE 'model.deploy.%'
UNION ALL SELECT 'dead', id, action FROM decisions WHERE action LIKE '%.analyze'""")
def stream_routing(spark, sf):
    """Two handlers write their events, a third one always fails and its events become dead letters."""
    folder = work_dir(spark, "routing")

    def broken(df, batch_id):
        raise RuntimeError("handler is down")

    handlers = {h: streams.batch_sink(f"{folder}/{h}") for h in ("registry", "deployer")} | {"broken": broken}
    ev = decision_columns(_events(spark, sf)).select("id", F.col("action").alias("type"))
    streams.run_available(ev, streams.routed_sink(_ROUTES, handlers, f"{folder}/dead"), f"{folder}/checkpoint")
    out = None
    for h in ("registry", "deployer", "dead"):
        part = streams.results(spark, f"{folder}/{h}", ev.schema).select(F.lit(h).alias("handler"), "id", "type")
        out = part if out is None else out.unionByName(part)
    return out


@query("stream_history", with_ctes(DECISIONS_SQL) + """
SELECT id, trace_id FROM decisions ORDER BY "timestamp" DESC, id DESC LIMIT 100""")
def stream_history(spark, sf):
    """The newest 100 decisions, kept over micro-batches of a few files each."""
    folder = work_dir(spark, "history")
    days = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    days.hint("rebalance", "day").write.partitionBy("day").parquet(f"{folder}/in")
    d = decision_columns(streams.read_files(spark, f"{folder}/in", max_files=10)).select("id", "trace_id", "timestamp")
    schema = d.schema
    q = streams.run_available(streams.newest_rows(d, 100), streams.history_sink(f"{folder}/out", schema, 100), f"{folder}/checkpoint")
    last = max(p["batchId"] for p in q.recentProgress if p["numInputRows"] > 0)
    return spark.read.schema(schema).parquet(streams.batch_folder(f"{folder}/out", last)).select("id", "trace_id")


@query("stream_new_files", """
SELECT 'feed' || CAST(o_custkey % 4 AS VARCHAR) AS dataset_name, count(*) AS num_rows, count(*) >= 3700 AS rows_ok,
  avg(CAST(o_orderstatus = 'P' AS DOUBLE)) <= 0.34 AS nulls_ok, count(*) >= 3700 AND avg(CAST(o_orderstatus = 'P' AS DOUBLE)) <= 0.34 AS approved,
  CASE WHEN count(*) >= 3700 AND avg(CAST(o_orderstatus = 'P' AS DOUBLE)) <= 0.34 THEN count(*) ELSE 0 END AS appended FROM orders GROUP BY 1""")
def stream_new_files(spark, sf):
    """Feeds arrive in a file per order month over many batches; each feed is gated once, and appended if accepted."""
    folder = work_dir(spark, "arrivals")
    columns = ["o_orderstatus", "o_orderpriority"]
    o = table(spark, sf, "orders").withColumn("o_orderstatus", F.nullif(F.col("o_orderstatus"), F.lit("P"))).withColumns({
        "feed": F.concat(F.lit("feed"), (F.col("o_custkey") % 4).cast("string")), "year": F.year("o_orderdate")})
    o.hint("rebalance", "feed", "year").write.partitionBy("feed", "year").parquet(f"{folder}/in")
    src = streams.read_files(spark, f"{folder}/in", schema=spark.read.parquet(f"{folder}/in").schema, max_files=8)
    streams.run_available(src, streams.arrivals_sink(f"{folder}/feed", columns, F.col("feed")), f"{folder}/checkpoint")
    decided = streams.gate_arrivals(spark, f"{folder}/feed", columns, min_rows=3700, max_null_rate=0.34)
    streams.accepted_arrivals(spark, f"{folder}/feed", decided).write.mode("append").parquet(f"{folder}/accepted")
    kept = spark.read.schema("dataset_name string").parquet(f"{folder}/accepted").groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n"))
    return decided.join(kept, "dataset_name", "left").select(
        "dataset_name", "num_rows", "rows_ok", "nulls_ok", "approved", F.coalesce("n", F.lit(0)).alias("appended"))


def _text_files(spark, lines, folder, suffix, rows_per_file=0):
    """Lines as text files of another suffix."""
    lines.hint("rebalance").write.option("maxRecordsPerFile", rows_per_file).text(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for i, status in enumerate(fs.globStatus(path(f"{folder}/part-*"))):
        fs.rename(status.getPath(), path(f"{folder}/{i}.{suffix}"))


_FORMATS = ["csv", "jsonl", "json", "parquet"]


@query("stream_feed_formats", """
WITH o AS (SELECT ['csv', 'jsonl', 'json', 'parquet'][CAST(o_custkey % 4 AS INTEGER) + 1] AS f, o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS s FROM orders),
c AS (SELECT f, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys, CAST(sum(s) AS BIGINT) AS known, CASE WHEN f IN ('csv', 'jsonl') THEN 1 ELSE 0 END AS broken FROM o GROUP BY 1)
SELECT f AS dataset_name, n + broken AS num_rows, CAST(broken AS BIGINT) AS broken, broken = 0 AS approved, CASE WHEN broken = 0 THEN keys END AS accepted_keys, CASE WHEN broken = 0 THEN known END AS accepted_known FROM c
UNION ALL SELECT 'empty', 0, 0, true, NULL, NULL""")
def stream_feed_formats(spark, sf):
    """Orders arrive as csv, jsonl, json and Parquet files, with a broken record in two of them and a csv file without rows.

    Any broken record fails its dataset; the file without rows gets a gate row of its own.
    """
    folder = work_dir(spark, "formats")
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"),
        F.col("o_totalprice").cast("double").alias("o_totalprice"), (F.col("o_custkey") % 4).alias("f"))
    part = {f: o.where(F.col("f") == i).drop("f") for i, f in enumerate(_FORMATS)}
    row = F.struct("o_orderkey", "o_orderstatus", "o_totalprice")
    part["csv"].write.csv(f"{folder}/in/csv", header=True)
    part["parquet"].write.parquet(f"{folder}/in/parquet")
    arrays = part["json"].groupBy(F.floor(F.col("o_orderkey") / 64000)).agg(F.to_json(F.collect_list(row)).alias("value"))
    _text_files(spark, arrays.select("value"), f"{folder}/in/json", "json", 1)
    _text_files(spark, part["jsonl"].select(F.to_json(row).alias("value")), f"{folder}/in/jsonl", "jsonl")
    _text_files(spark, spark.sql("SELECT 'o_orderkey,o_orderstatus,o_totalprice\nx,O,1.0' AS value"), f"{folder}/in/late", "csv")
    _text_files(spark, spark.sql("SELECT '{broken' AS value"), f"{folder}/in/later", "jsonl")
    _text_files(spark, spark.sql("SELECT 'o_orderkey,o_orderstatus,o_totalprice' AS value"), f"{folder}/in/empty", "csv")
    src = files.feed(spark, f"{folder}/in", part["csv"].schema, max_bytes=32 << 20)
    name = F.when(F.contains("file_path", F.lit("/empty/")), "empty").otherwise(F.regexp_extract("file_path", r"([a-z]+)$", 1))
    streams.run_available(src, streams.feed_sink(f"{folder}/feed", ["o_orderkey"], name), f"{folder}/checkpoint")
    decided = streams.gate_arrivals(spark, f"{folder}/feed", ["o_orderkey", "parsed"], min_rows=1, max_null_rate=0.0)
    broken = spark.read.parquet(f"{folder}/feed/broken").groupBy("dataset_name").agg(F.count(F.lit(1)).alias("broken"))
    kept = streams.accepted_arrivals(spark, f"{folder}/feed", decided).groupBy("dataset_name").agg(
        F.sum("o_orderkey").alias("accepted_keys"), F.count("o_orderstatus").alias("accepted_known"))
    return decided.join(broken, "dataset_name", "left").join(kept, "dataset_name", "left").select(
        "dataset_name", "num_rows", F.coalesce("broken", F.lit(0)).alias("broken"), "approved", "accepted_keys", "accepted_known")


@query("stream_late_rows", """
WITH m AS (SELECT max(ts) - INTERVAL 5 DAYS AS m FROM events WHERE event_id % 2 = 0)
SELECT event_id, event_id % 2 = 1 AND ts <= m AS late FROM events, m""")
def stream_late_rows(spark, sf):
    """Even events arrive first, then odd ones, of which those behind the engine's watermark of five days are late."""
    folder = work_dir(spark, "late")
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    for odd in (0, 1):
        e.where(F.col("event_id") % 2 == odd).write.mode("append").parquet(f"{folder}/in")
        src = streams.event_time(streams.read_files(spark, f"{folder}/in"), "ts", "5 days")
        run = streams.run_available(src, streams.batch_sink(f"{folder}/out"), f"{folder}/checkpoint")
        streams.save_watermarks(run, f"{folder}/watermarks")
    return streams.split_late(spark, f"{folder}/out", e.schema, f"{folder}/watermarks", "ts").select("event_id", "late")
