"""Versioned datasets: folders `root/name/v=N` of Parquet, and SQL over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class DatasetNotFound(ValueError):
    pass


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folder names matching a path pattern: metadata only, one entry per dataset version."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [s.getPath().toString() for s in (found or []) if s.isDirectory()]


def _version(folder: str) -> int | None:
    tail = folder.rstrip("/").rsplit("/v=", 1)
    return int(tail[1]) if len(tail) == 2 and tail[1].isdigit() else None


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """Version numbers in numeric order, so that 10 comes after 9."""
    return sorted(v for v in map(_version, _folders(spark, f"{root}/{name}/v=*")) if v is not None)


def read_dataset(spark: SparkSession, root: str, name: str, version: int | str = "latest") -> DataFrame:
    known = versions(spark, root, name)
    if version == "latest":
        if not known:
            raise DatasetNotFound(f"Dataset not found: {name}")
        n = known[-1]
    else:
        n = int(str(version).lstrip("v"))
        if n not in known:
            raise DatasetNotFound(f"Dataset version not found: {name}/{version}")
    return spark.read.parquet(f"{root}/{name}/v={n}")


def save_dataset(df: DataFrame, root: str, name: str) -> int:
    """Write the next version (highest + 1) and return its number; no version is overwritten."""
    n = max(versions(df.sparkSession, root, name), default=0) + 1
    df.write.mode("errorifexists").parquet(f"{root}/{name}/v={n}")
    return n


def list_datasets(spark: SparkSession, root: str) -> list[str]:
    """Distinct dataset names, sorted; a trailing `_v<digits>` in a name is dropped."""
    import re

    names = (f.rstrip("/").rsplit("/", 2)[1] for f in _folders(spark, f"{root}/*/v=*"))
    return sorted({re.sub(r"_v\d+$", "", n) for n in names})


def base_names(df: DataFrame, column: str) -> DataFrame:
    """Catalog from a listing table: distinct base names in order."""
    return df.select(F.regexp_replace(column, r"_v\d+$", "").alias("name")).distinct().orderBy("name")


def profile(df: DataFrame, name: str, version: int | str = "latest") -> DataFrame:
    """One row: dataset name, version, row and column counts, schema map."""
    schema = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    return df.agg(F.count(F.lit(1)).alias("num_rows")).select(
        F.lit(name).alias("dataset_name"),
        F.lit(str(version)).alias("dataset_version"),
        "num_rows",
        F.lit(len(df.columns)).alias("num_columns"),
        schema.alias("schema"),
    )


def query(spark: SparkSession, sql: str, params: dict | None = None, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """SQL with `:name` (or `@name`) parameters over the given tables; the result stays lazy."""
    for table, df in (tables or {}).items():
        df.createOrReplaceTempView(table)
    for p in sorted(params or {}, key=len, reverse=True):
        sql = sql.replace(f"@{p}", f":{p}")
    return spark.sql(sql, args=params or {})


def register_datasets(spark: SparkSession, root: str) -> None:
    """Make the newest version of every saved dataset visible to SQL."""
    for name in {f.rstrip("/").rsplit("/", 2)[1] for f in _folders(spark, f"{root}/*/v=*")}:
        read_dataset(spark, root, name).createOrReplaceTempView(name)


