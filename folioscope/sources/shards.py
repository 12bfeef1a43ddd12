"""Shards of NDJSON with completion markers, and table files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.schema import PAPER


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().toString() for x in fs.listStatus(path)] if fs.exists(path) else []


def complete(spark: SparkSession, folder: str, channels: list[str] | None = None, suffix: str = ".ndjson", marker: str = ".done") -> list[str]:
    """Shard files in a folder that have their marker; a channel is the name up to the first dot or underscore and year."""
    names = set(_files(spark, folder))
    found = sorted(n for n in names if n.endswith(suffix) and (n + marker in names or n[: -len(suffix)] + marker in names))
    return [n for n in found if channels is None or channel_of(n) in channels]


def channel_of(path: str) -> str:
    return re.sub(r"[_.-]?\d{4}$", "", path.rsplit("/", 1)[-1].split(".")[0])


def read_shards(spark: SparkSession, folder: str, channels: list[str] | None = None) -> DataFrame:
    """Records of complete shards, with `channel`. Blank lines are skipped, the schema is fixed; no shard gives an empty table."""
    paths = complete(spark, folder, channels)
    if not paths:
        return spark.createDataFrame([], PAPER).withColumn("channel", F.lit(None).cast("string"))
    name = F.regexp_extract(F.input_file_name(), "([^/]+)$", 1)
    return spark.read.schema(PAPER).json(paths).withColumn("channel", F.regexp_replace(F.substring_index(name, ".", 1), "[_.-]?\\d{4}$", ""))


def channel_counts(shards: DataFrame) -> DataFrame:
    return shards.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


def write_shards(records: DataFrame, folder: str, by: tuple[str, ...] = ("channel", "year")) -> None:
    """One folder of NDJSON for each channel and year; _SUCCESS marks the whole. Only the partitions written are replaced."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(folder)


def mark_complete(spark: SparkSession, shard: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(shard + ".done")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True).close()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, CSV with a header, or NDJSON, by the path's ending; Parquet without one."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if path.endswith((".ndjson", ".jsonl", ".json")):
        return spark.read.json(path)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as CSV with a header; nested columns as JSON."""
    nested = {f.name: F.to_json(f.name) for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    df.withColumns(nested).write.mode("overwrite").option("header", True).csv(path) if nested else df.write.mode("overwrite").option("header", True).csv(path)


def save_tables(tables: dict[str, DataFrame], database: str | None = None) -> None:
    for name, frame in tables.items():
        frame.write.mode("overwrite").saveAsTable(f"{database}.{name}" if database else name)


def write_jdbc(tables: dict[str, DataFrame], url: str, properties: dict[str, str] | None = None, batch: int = 5_000) -> None:
    """Appends the tables in order, `batch` rows at a time."""
    for name, frame in tables.items():
        nested = {f.name: F.to_json(f.name) for f in frame.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
        out = frame.withColumns(nested) if nested else frame
        out.write.mode("append").option("batchsize", batch).jdbc(url, name, properties=properties or {})


def write_report(df: DataFrame, path: str) -> None:
    """A report of a few rows as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)
