"""Checks of results and inputs, each a row: what was looked at, whether it holds, and how many rows don't."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(bad: DataFrame, name: str) -> DataFrame:
    return bad.agg(F.count("*").alias("bad")).select(F.lit(name).alias("check"), (F.col("bad") == 0).alias("holds"), "bad")


def holds(df: DataFrame, name: str, what: Column | str) -> DataFrame:
    """Rows for which ``what`` is false or unknown."""
    what = F.expr(what) if isinstance(what, str) else what
    return _row(df.where(~F.coalesce(what, F.lit(False))), name)


def unique(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Keys that are there more than once."""
    return _row(df.groupBy(*keys).count().where("count > 1"), name)


def same_members(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Rows of one that the other lacks, either way."""
    return _row(a.distinct().exceptAll(b.distinct()).unionByName(b.distinct().exceptAll(a.distinct())), name)


def has_columns(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    return df.sparkSession.createDataFrame([(name, not missing, len(missing))], "check string, holds boolean, bad long")


def group_counts(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Groups with another number of rows than the largest has."""
    n = df.groupBy(*keys).count()
    most = n.agg(F.max("count").alias("most"))
    return _row(n.join(F.broadcast(most)).where("count <> most"), name)


def isolated(found: DataFrame, name: str, radius: int) -> DataFrame:
    """Queries with a neighbour later than ``radius + 1`` days before them."""
    return _row(found.where(F.exists("neighbours", lambda s: s > F.col("t") - radius - 1)), name)


def among(found: DataFrame, candidates: DataFrame, name: str) -> DataFrame:
    """Neighbours that are no candidates, ``series`` and ``pos``."""
    each = found.select("series", F.explode("neighbours").alias("pos"))
    return _row(each.join(candidates.select("series", "pos"), ["series", "pos"], "left_anti"), name)


def manifest(hashes: DataFrame, expected: DataFrame, name: str) -> DataFrame:
    """Files of ``expected`` (``file``, ``sha256``) whose bytes are others or that are not there."""
    have = hashes.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("sha256").alias("have"))
    return _row(expected.join(have, "file", "left").where(~F.col("sha256").eqNullSafe(F.col("have"))), name)


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
