"""Groups of rows that links hold together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for every node of a link the least node that links reach from it. Links with a null end are none.

    Each round hangs the larger and then the smaller neighbours of a node on its least one, as grouped minima and joins, so a
    hub is aggregated before it is shuffled. Rounds grow with the logarithm of the nodes and are written to the shared folder.
    """
    edges = materialise(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNull() | F.col(b).isNull()).toDF("u", "v", "open")
                        .where("NOT open AND u <> v").select("u", "v").distinct())
    mark = None
    while True:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(lowest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialise(down.where("u <> v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = state
