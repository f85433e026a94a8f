"""Connected components over an edge table, by alternating large-star and small-star rounds.

Every round is aggregations and equi-joins whose hot sides Spark can split (Kiveris et al., 2014).
Nothing is gathered on the driver but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import driver_gives_back, materialise


def _state(edges: DataFrame) -> tuple[int, str]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], str(row[1])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v: long); root is the smallest node reachable.

    Loops and repeated edges do no harm. An empty edge table gives an empty result.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialise(e, "cc")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large.unionByName(low.filter("_u > m").select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct(), "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
        small = large.join(low, F.col("u") == F.col("_u")).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(low.select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct(), "cc")
        new = _state(e)
        driver_gives_back(edges.sparkSession)
        if new == state:
            break
        state = new
    # Stars now: every node points at its root.
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
