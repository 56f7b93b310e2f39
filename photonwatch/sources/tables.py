"""Scans: named tables, telemetry history, source selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY_COLUMNS = ["Node", "DateTime", "qkdKeyRate"]  # fixed values: what a history file must hold
SOURCES = ("database", "csv", "snmp")


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def database_table(
    spark: SparkSession, url: str, table: str, partition_column: str, lower: str, upper: str, partitions: int, **options: str
) -> DataFrame:
    """Table of a live database, read in parallel ranges of ``partition_column``."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn=partition_column,
            lowerBound=lower,
            upperBound=upper,
            numPartitions=str(partitions),
            **options,
        )
        .load()
    )


def csv_history(spark: SparkSession, path: str) -> DataFrame:
    """Key-rate history from CSV with a header; other columns are kept as text.

    The header row is read for the column names; types are given, not inferred.
    """
    names = spark.read.option("header", True).csv(path).columns
    missing = [c for c in HISTORY_COLUMNS if c not in names]
    if missing:
        raise ValueError(f"history lacks columns: {', '.join(missing)}")
    types = {"DateTime": "timestamp_ntz", "qkdKeyRate": "double"}
    schema = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in names)
    return spark.read.schema(schema).option("header", True).csv(path)


def history(spark: SparkSession, source: str, database: DataFrame | None = None, csv_path: str | None = None) -> DataFrame:
    """History from the chosen source; ``snmp`` reads the database."""
    if source == "csv":
        if csv_path is None:
            raise ValueError("source csv needs csv_path")
        return csv_history(spark, csv_path)
    if source in ("database", "snmp"):
        if database is None:
            raise ValueError(f"source {source} needs a database frame")
        return database
    raise ValueError(f"unknown data source: {source}; choose one of {', '.join(SOURCES)}")


def merged_history(parts: list[DataFrame]) -> DataFrame:
    """Histories of different sources, columns matched by name, ordered by node and time."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.orderBy("Node", "DateTime")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: name, text, content hash."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.decode("content", F.lit("UTF-8")).alias("text"),
        F.md5("content").alias("content_hash"),
    )
