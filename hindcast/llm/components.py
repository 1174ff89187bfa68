"""Connected components of a graph held in DataFrames: least labels spread over links, then jump along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm import blocks as B


def components(edges: DataFrame, shared: B.Shared, name: str = "labels") -> DataFrame:
    """``node`` and ``label``, the least node of its component, for each node of the links ``a``, ``b`` (longs).

    Each round's labels are written, so lineage stays short and a lost executor costs one round at most.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = shared.write(both, f"{name}-links", few=True)
    labels = both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("node"), "label")
    labels = shared.write(labels, f"{name}-0", few=True)
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("to"))
        # many nodes share a label: it is looked up once for each of the tasks they are dealt over
        spread = spread.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(B.SALTS)))
        jump = spread.select("to", "salt").distinct().join(labels.select(F.col("node").alias("to"), F.col("label").alias("far")), "to")
        moved = spread.join(jump, ["to", "salt"], "left").select("node", F.least("to", F.coalesce("far", "to")).alias("label"), (F.least("to", F.coalesce("far", "to")) != F.col("label")).alias("moved"))
        moved = shared.write(moved, f"{name}-{step}", few=True)
        again = not moved.where("moved").isEmpty()
        shared.drop(f"{name}-{step - 1}")
        labels = moved.select("node", "label")
        if not again:
            return labels
