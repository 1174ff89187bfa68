"""File sources and sinks with asserted schemas: CSV (plain or gzip), Parquet, JSON, and content hashes."""

from __future__ import annotations

import hashlib
import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SchemaError(ValueError):
    pass


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_many(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    out = spark.read.parquet(*paths)
    return out.select(*columns) if columns else out


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_registry(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A registry whose ``key`` must be there and unique in every row."""
    out = read_csv(spark, path, schema)
    n = out.agg(F.count("*").alias("rows"), F.count(key).alias("keys"), F.countDistinct(key).alias("distinct")).first()
    if not n.rows == n["keys"] == n["distinct"]:
        raise SchemaError(f"{key} is missing or repeated: {n.rows} rows, {n['keys']} keys, {n['distinct']} distinct")
    return out


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def content_hashes(spark: SparkSession, glob: str) -> DataFrame:
    """SHA-256 of the bytes of each file."""
    return spark.read.format("binaryFile").load(glob).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for summaries of a bounded size."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_by(df: DataFrame, path: str, *keys: str) -> None:
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def span_metadata(df: DataFrame, date: str = "date") -> dict[str, object]:
    r = df.agg(F.min(date).alias("first"), F.max(date).alias("last"), F.count("*").alias("rows")).first()
    return {"first": str(r["first"]), "last": str(r["last"]), "rows": r["rows"]}


def write_metadata(df: DataFrame, path: str, date: str = "date", **more: object) -> None:
    """``span_metadata`` and what else is given, as one JSON file on the driver."""
    import json

    with open(path, "w") as f:
        json.dump(span_metadata(df, date) | more, f, indent=2, sort_keys=True)


def log_to(path: str) -> logging.Logger:
    """A log that is appended to a file."""
    log = logging.getLogger(f"hindcast.{path}")
    if not log.handlers:
        handler = logging.FileHandler(path, mode="a")
        handler.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
    return log


def read_panel_csv(spark: SparkSession, path: str, columns: list[str], state: list[str] = ()) -> DataFrame:
    """A panel of ``date`` and doubles from a CSV file, plain or gzip, by position; ``valid_state`` tells whether all of ``state`` are there and finite."""
    from pyspark.sql import Window

    from hindcast.functions.scores import finite

    p = require(read_csv(spark, path, "date date, " + ", ".join(f"`{c}` double" for c in columns)), ["date", *state])
    ok = F.lit(True)
    for c in state:
        ok = ok & finite(f"`{c}`")
    by = Window.partitionBy("series").orderBy("date")
    p = p.withColumn("series", F.lit("all")).withColumn("pos", (F.row_number().over(by) - 1).cast("long"))
    return p.withColumn("valid_state", ok)


def stored(spark: SparkSession, name: str, version: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that is computed once for a version of its inputs and read from the shared folder after that.

    Without ``spark.checkpoint.dir``, or a version, nothing is kept.  A table that is not whole has no ``_SUCCESS`` and is built anew.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base or not version:
        return build()
    path = f"{base.rstrip('/')}/hindcast-store/{name}-{hashlib.sha256(version.encode()).hexdigest()[:16]}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
