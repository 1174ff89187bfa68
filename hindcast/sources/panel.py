"""Panels: aligned series with a position, returns, losses and the loss of the next day.

Every window is partitioned by ``series``, so many series spread over a cluster; one series is a few
thousand rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.config import SPLITS, STATE, WEIGHTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def version(df: DataFrame) -> str:
    """Tells one state of the input files of ``df`` from another: their paths, sizes and times."""
    spark = df.sparkSession
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for f in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    return "\n".join(out)


def aligned(base: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """``other`` on the calendar of ``base``, gaps filled with the last value before."""
    by = Window.partitionBy("series").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = base.join(other, ["series", "date"], "left")
    return out.withColumns({c: F.last(c, ignorenulls=True).over(by) for c in columns})


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two daily price series from sales and orders, their simple returns and the weighted one, and the day's position."""
    a = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("px_a"))
    b = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("px_b"), F.count("*").cast("double").alias("n_orders"))
    one = lambda d: d.withColumn("series", F.lit("all"))
    px = aligned(one(a), one(b), ["px_b", "n_orders"]).where("px_b is not null")
    by = Window.partitionBy("series").orderBy("date")
    change = lambda c: F.col(c) / F.lag(c).over(by) - 1
    px = px.withColumn("pos", (F.row_number().over(by) - 1).cast("long")).withColumns({"ret_a": change("px_a"), "ret_b": change("px_b")})
    px = px.withColumn("ret", F.lit(WEIGHTS[0]) * F.col("ret_a") + F.lit(WEIGHTS[1]) * F.col("ret_b"))
    return px.withColumn("loss", -F.col("ret")).withColumn("next_loss", -F.lead("ret").over(by))


def hourly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events an hour: how many of each type, and their mean value."""
    e = table(spark, sf_dir, "events")
    kinds = ["click", "view", "purchase", "signup", "error"]
    return e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(
        F.count("*").alias("n"), F.countDistinct("event_type").alias("n_types"), *(F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds), F.avg("value").alias("mean_value")
    )


def state_panel(panel: DataFrame) -> DataFrame:
    """Adds realised volatility, 20-day compound return, order level, its 5-day change and the price ratio."""
    by = Window.partitionBy("series").orderBy("pos")
    last = by.rowsBetween(-19, 0)
    whole = F.count("ret").over(last) == 20
    grow = F.aggregate(F.collect_list(F.col("px_a") / F.col("px_a_before")).over(last), F.lit(1.0), lambda a, x: a * x) - 1
    out = panel.withColumn("px_a_before", F.lag("px_a").over(by))
    return out.withColumns({
        "rv20": F.when(whole, F.stddev_pop("ret").over(last) * F.sqrt(F.lit(252.0))), "ret20": F.when(whole, grow), "level": F.col("n_orders"),
        "delta5": F.col("n_orders") - F.lag("n_orders", 5).over(by), "ratio": F.col("px_a") / F.col("px_b"),
    }).drop("px_a_before")


def expanding_zscores(panel: DataFrame, columns: tuple[str, ...] = STATE, least: int = 60) -> DataFrame:
    """Adds ``z_`` columns: each value by the mean and deviation of those before it, ``least`` at least."""
    before = Window.partitionBy("series").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    z = lambda c: F.when(F.count(c).over(before) >= least, (F.col(c) - F.avg(c).over(before)) / F.nullif(F.stddev_pop(c).over(before), F.lit(0.0)))
    return panel.withColumns({f"z_{c}": z(c) for c in columns})


def split(date: F.Column | str = "date") -> F.Column:
    d = F.col(date) if isinstance(date, str) else date
    return F.when(d >= F.lit(SPLITS.test).cast("date"), "test").when(d >= F.lit(SPLITS.validation).cast("date"), "validation").otherwise("warmup")
