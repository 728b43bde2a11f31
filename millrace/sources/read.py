"""Tables, JSON lines, request logs and archives of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.urls import glob_pattern
from millrace.operators.steps import select_path
from millrace.sources.archive import REQUEST, SPLIT, RequestArchive



def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def records(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None) -> DataFrame:
    """Files of records by ``kind`` (parquet, json, csv, orc, text; else by the path's ending).

    Give JSON and CSV a ``schema``: without one Spark reads the files twice.
    """
    kind = kind or next((k for k in ("parquet", "json", "csv", "orc") if path.rstrip("/").endswith("." + k)), "parquet")
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        reader = reader.option("header", "true").option("escape", '"').option("multiLine", "true")
    return reader.format(kind).load(path)


def requests(spark: SparkSession, path: str) -> DataFrame:
    """A request log in JSON lines."""
    return spark.read.schema(REQUEST).json(path)


def archive(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Requests in archives, JSON lines or HAR, with their ``file`` and ``offset``, in ranges of ``split`` bytes.

    ``path`` is a file or folder in a store that pyarrow opens, shared by all executors. Conditions on url, method, status
    and offset are tested while reading: the session's setting for that is switched on, unless it is set.
    """
    setting = "spark.sql.python.filterPushdown.enabled"
    if spark.conf.get(setting, "false") != "true":
        spark.conf.set(setting, "true")
    spark.dataSource.register(RequestArchive)
    return spark.read.format(RequestArchive.name()).option("split", split).load(path)


def matching(log: DataFrame, glob: str) -> DataFrame:
    """The requests whose address a glob matches anywhere."""
    return log.where(F.col("url").rlike(glob_pattern(glob)))


def first_response(log: DataFrame, part: str, order: str, path: str | None = None, schema: str | None = None) -> DataFrame:
    """The earliest request whose address contains ``part``: its response, as ``response`` text, or the value at ``path``; the whole where that is null."""
    one = log.where(F.col("url").contains(part)).orderBy(order).limit(1)
    if schema is None:
        whole = F.col("response_body")
        return one.select((F.coalesce(F.get_json_object(whole, "$." + path), whole) if path else whole).alias("response"))
    read = one.select(F.from_json("response_body", schema).alias("r")).select("r.*")
    return select_path(read, path) if path else read


def parsed(log: DataFrame, schema: str, condition: Column | None = None) -> DataFrame:
    """The captured responses as columns ``url`` and those of ``schema``; bodies that aren't such JSON give nulls."""
    rows = log if condition is None else log.where(condition)
    return rows.select("url", F.from_json("response_body", schema).alias("r")).select("url", "r.*")
