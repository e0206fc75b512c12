"""File feeds, artifact listings, messages, notebooks and metric files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from modelwarden.functions.text import basename, stem, suffix

# Suffixes that decide what a file is.
DATA_SUFFIXES = ["csv", "parquet", "json", "jsonl"]
MODEL_SUFFIXES = [".pkl", ".joblib", ".pt", ".onnx", ".h5"]
METRIC_SUFFIX = ".json"

NOTEBOOK_SCHEMA = (
    "cells array<struct<cell_type:string,source:variant,metadata:struct<tags:array<string>>>>"
)
MESSAGE_SCHEMA = (
    "dataset_name string, dataset_uri string, content_type string, size_bytes bigint, trigger string"
)


def is_data_file(path: Column) -> Column:
    return F.regexp_like(path, F.lit(r"\.(" + "|".join(DATA_SUFFIXES) + r")\z"))


def arrivals(uploads: DataFrame, scheme: str = "gs", trigger: str = "gcs_upload") -> DataFrame:
    """Upload notices (bucket, name, contentType, size) to pipeline payload rows; other files are dropped."""
    return uploads.where(is_data_file(F.col("name"))).select(
        stem(F.col("name")).alias("dataset_name"),
        F.concat(F.lit(f"{scheme}://"), F.col("bucket"), F.lit("/"), F.col("name")).alias("dataset_uri"),
        F.coalesce("contentType", F.lit("")).alias("content_type"),
        F.coalesce(F.col("size").cast("bigint"), F.lit(0)).alias("size_bytes"),
        F.lit(trigger).alias("trigger"),
    )


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below a folder with size and time. The content column is not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        .load(path).select("path", F.col("length").alias("size_bytes"), "modificationTime")
    )


def feed(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """One stream over the csv, json, jsonl and Parquet files below a folder, with `file_path`, `unparsed` and `is_row`.

    A record that does not parse keeps its text in `unparsed` and has null columns; csv files have a header line, a json file is
    one object or an array. Besides its rows every file gives one row with is_row = false, so that a file without rows (a header, `[]`) is seen. Spark skips
    files of zero bytes in all sources; those show in the upload notices (`arrivals`) by their size.
    `max_files` or `max_bytes` is the limit of a batch for each format. By bytes, many small files take no more batches than a
    few large ones with the same rows.
    """
    broken = StructType([*schema.fields, StructField("unparsed", StringType())])
    place = F.col("_metadata.file_path").alias("file_path")
    names = [F.col(f"`{f.name}`") for f in schema.fields]

    def read(fmt: str, suffix: str, fields: StructType, **options) -> DataFrame:
        reader = spark.readStream.format(fmt).schema(fields).options(
            recursiveFileLookup=True, pathGlobFilter=f"*.{suffix}", **options)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        if max_bytes:
            reader = reader.option("maxBytesPerTrigger", max_bytes)
        return reader.load(path)

    loose = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unparsed"}
    parts = [
        read("csv", "csv", broken, header=True, **loose), read("json", "jsonl", broken, **loose),
        read("json", "json", broken, multiLine=True, **loose),
        read("parquet", "parquet", schema).withColumn("unparsed", F.lit(None).cast("string")),
    ]
    out = None
    for part in parts:
        rows = part.select(*names, "unparsed", place, F.lit(True).alias("is_row"))
        out = rows if out is None else out.unionByName(rows)
    binary = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()),
                         StructField("length", LongType()), StructField("content", BinaryType())])
    files = read("binaryFile", "{" + ",".join(DATA_SUFFIXES) + "}", binary)  # only the path is read
    marks = files.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields],
                         F.lit(None).cast("string").alias("unparsed"), place, F.lit(False).alias("is_row"))
    return out.unionByName(marks)


def artifact_type(path: Column) -> Column:
    s = suffix(path)
    return F.when(s.isin(*MODEL_SUFFIXES), "model").when(s == METRIC_SUFFIX, "metrics").otherwise("logs")


def artifacts(files: DataFrame, prefix: str = "") -> DataFrame:
    """Artifact rows of a listing: name, path, key relative to the prefix, type and size."""
    return files.select(
        basename(F.col("path")).alias("name"),
        "path",
        F.when(F.startswith("path", F.lit(prefix)), F.ltrim(F.substr("path", F.lit(len(prefix) + 1)), F.lit("/")))
        .otherwise(F.col("path")).alias("key"),
        artifact_type(F.col("path")).alias("artifact_type"),
        F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
    )


def decode_messages(messages: DataFrame, data: str = "data", schema: str = MESSAGE_SCHEMA) -> DataFrame:
    """Base64 message bodies to columns; works on batch and streaming frames."""
    body = F.from_json(F.unbase64(data).cast("string"), schema)
    return messages.withColumn("_m", body).select(*[c for c in messages.columns if c != data], "_m.*")


def notebooks(spark: SparkSession, path: str, glob: str = "*.ipynb") -> DataFrame:
    """Notebook files as (path, content)."""
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        .text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


def notebook_cells(docs: DataFrame) -> DataFrame:
    """One row per cell in order. A source given as a list of lines is joined; plain text is kept."""
    parsed = docs.select("path", F.from_json("content", NOTEBOOK_SCHEMA).alias("_n"))
    cells = parsed.select("path", F.posexplode("_n.cells").alias("index", "_c"))
    source = F.col("_c.source")
    text = F.coalesce(
        F.array_join(F.try_variant_get(source, "$", "array<string>"), ""), F.try_variant_get(source, "$", "string"),
        F.lit(""),
    )
    return cells.select(
        F.col("path").alias("notebook"),
        "index",
        F.coalesce("_c.cell_type", F.lit("code")).alias("cell_type"),
        text.alias("source"),
        F.coalesce("_c.metadata.tags", F.array().cast("array<string>")).alias("tags"),
    )


def metric_files(spark: SparkSession, path: str, glob: str = "metrics*.json") -> DataFrame:
    """One JSON object of metric -> value per file, as (path, metrics map)."""
    text = notebooks(spark, path, glob)
    return text.select("path", F.from_json("content", "map<string,double>").alias("metrics"))
