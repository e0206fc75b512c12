import base64
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from modelwarden.sources import datasets, files, stores


def test_dataset_versions(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1.0, 0), (2.0, 1)], "amount double, is_fraud int")
    assert [datasets.save_dataset(df, root, "tx") for _ in range(11)] == list(range(1, 12))
    datasets.save_dataset(df.limit(1), root, "tx")
    assert datasets.read_dataset(spark, root, "tx").count() == 1
    assert datasets.read_dataset(spark, root, "tx", "v10").count() == 2
    with pytest.raises(datasets.DatasetNotFound):
        datasets.read_dataset(spark, root, "tx", "v99")
    with pytest.raises(datasets.DatasetNotFound):
        datasets.read_dataset(spark, root, "none")
    datasets.save_dataset(df, root, "users_v3")
    assert datasets.list_datasets(spark, root) == ["tx", "users"]
    p = datasets.profile(df, "tx", 1).first()
    assert (p.num_rows, p.num_columns, p.schema) == (2, 2, {"amount": "double", "is_fraud": "int"})


def test_query_binds_parameters(spark, tmp_path):
    df = spark.createDataFrame([(1, True), (2, False)], "a int, b boolean")
    datasets.save_dataset(df, str(tmp_path), "flags_table")
    datasets.register_datasets(spark, str(tmp_path))
    out = datasets.query(spark, "SELECT a FROM flags_table WHERE b = @want AND a < @most", {"want": True, "most": 9})
    assert [r.a for r in out.collect()] == [1]


def test_arrivals(spark, rows):
    up = spark.createDataFrame(
        [("b", "in/x.v2.csv", "text/csv", 5), ("b", "notes.txt", None, 1), ("b", "y.jsonl", None, None)],
        "bucket string, name string, contentType string, size bigint",
    )
    assert rows(files.arrivals(up)) == [
        ("x.v2", "gs://b/in/x.v2.csv", "text/csv", 5, "gcs_upload"),
        ("y", "gs://b/y.jsonl", "", 0, "gcs_upload"),
    ]


def test_artifacts_and_metrics(spark, tmp_path, rows):
    for name, text in {"m/a.pkl": "x", "m/b.h5": "xy", "m/metrics.json": '{"f1": 0.8, "n": 3}', "run.log": "l"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    out = files.artifacts(files.listing(spark, str(tmp_path)), f"file:{tmp_path}")
    assert rows(out, "key", "artifact_type", "size_bytes") == [
        ("m/a.pkl", "model", 1), ("m/b.h5", "model", 2), ("m/metrics.json", "metrics", 19), ("run.log", "logs", 1)]
    assert files.metric_files(spark, str(tmp_path)).first().metrics == {"f1": 0.8, "n": 3.0}


def test_messages(spark):
    body = base64.b64encode(json.dumps({"dataset_name": "tx", "size_bytes": 7}).encode()).decode()
    r = files.decode_messages(spark.createDataFrame([("m1", body)], "id string, data string")).first()
    assert (r.id, r.dataset_name, r.size_bytes, r.trigger) == ("m1", "tx", 7, None)


def test_notebook_cells(spark, tmp_path, rows):
    nb = {"cells": [{"cell_type": "code", "source": ["a\n", "b"], "metadata": {"tags": ["t"]}},
                    {"cell_type": "markdown", "source": "text"}, {"source": []}]}
    (tmp_path / "n.ipynb").write_text(json.dumps(nb, indent=1))
    got = rows(files.notebook_cells(files.notebooks(spark, str(tmp_path))), "index", "cell_type", "source", "tags")
    assert got == [(0, "code", "a\nb", ["t"]), (1, "markdown", "text", []), (2, "code", "", [])]


def test_store_upsert_view(spark, tmp_path, rows):
    root = str(tmp_path)
    first = spark.createDataFrame([("t1", "p", "running"), ("t2", "p", "running")], "trace_id string, pipeline_name string, status string")
    full = first.withColumn("started_at", F.lit("2024-01-01").cast("timestamp")).withColumn("completed_at", F.lit(None).cast("timestamp"))
    stores.append(full, root, "traces")
    stores.append(full.where("trace_id = 't1'").withColumn("status", F.lit("failed")), root, "traces")
    assert rows(stores.current(spark, root, "traces"), "trace_id", "status") == [("t1", "failed"), ("t2", "running")]
    assert stores.history(spark, root, "traces").count() == 3
    stores.compact(spark, root, "traces", root + "/next")
    assert rows(stores.current(spark, root + "/next", "traces"), "trace_id", "status") == [("t1", "failed"), ("t2", "running")]


def test_newest_version_in_an_earlier_month(spark, tmp_path, rows):
    """A key whose newest version lies in an earlier month is not current from a later month on; a sequence orders one write."""
    root, columns = str(tmp_path), "trace_id string, pipeline_name string, status string, started_at timestamp, completed_at timestamp"
    first = [("t1", "p", "running", dt.datetime(2024, 5, 1), None), ("t2", "p", "running", dt.datetime(2024, 5, 2), None)]
    stores.append(spark.createDataFrame(first, columns), root, "traces", F.to_timestamp(F.lit("2024-06-01")))
    again = [("t1", "p", s, dt.datetime(2024, 3, 1), None) for s in ("b", "c", "a")]
    stores.append(spark.createDataFrame(again, columns), root, "traces", F.to_timestamp(F.lit("2024-06-02")), F.ascii("status"))
    assert rows(stores.current(spark, root, "traces"), "trace_id", "status") == [("t1", "c"), ("t2", "running")]
    assert rows(stores.current(spark, root, "traces", "2024-05"), "trace_id", "status") == [("t2", "running")]


def test_runs(spark):
    runs = spark.createDataFrame(
        [("", "", {"f1": 0.5}, {}, {}), ("r2", "exp", {"f1": 0.6}, {}, {})],
        "run_id string, experiment_name string, metrics map<string,double>, params map<string,string>, tags map<string,string>",
    ).withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    named = stores.named_runs(runs)
    a = named.where("experiment_name = 'default'").first()
    assert len(a.run_id) == 12
    assert stores.find_run(named, a.run_id).count() == 1
    with pytest.raises(stores.RunNotFound):
        stores.find_run(named, "zzz")


def test_request_window(spark, rows):
    df = spark.createDataFrame([("e", "2024-01-01 00:00:00", 1), ("e", "2024-01-01 00:10:00", 2), ("x", "2024-01-01 09:00:00", 3)],
                               "endpoint_id string, t string, n int").withColumn("ts", F.to_timestamp("t"))
    assert rows(stores.request_window(df, "e", 5), "n") == [(2,)]
    assert rows(stores.request_window(df, "e", 15, F.to_timestamp(F.lit("2024-01-01 00:12:00"))), "n") == [(1,), (2,)]
