"""Transitive closures of edge tables and containment in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closure(edges: DataFrame, reflexive: bool = False, rounds: int = 30) -> DataFrame:
    """(src, dst) of all paths, by doubling: a round joins the paths so far with themselves.

    Cycles end when a round adds nothing. Self-pairs are kept only if reflexive. Each round is a
    written table, so the plan does not grow; rounds bounds path lengths to 2 ** rounds.
    """
    from pairloom.sources.scratch import written

    paths = written(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "closure")
    size = paths.count()
    for _ in range(rounds):
        more = paths.select("src", F.col("dst").alias("mid")).join(paths.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        paths = written(paths.unionByName(more).distinct(), "closure")
        now = paths.count()
        if now == size:
            break
        size = now
    out = paths.filter("src <> dst")
    if reflexive:
        nodes = edges.select(F.col("src").alias("n")).unionByName(edges.select(F.col("dst").alias("n"))).filter("n is not null").distinct()
        out = out.unionByName(nodes.select(F.col("n").alias("src"), F.col("n").alias("dst")))
    return out


def containment(pairs: DataFrame, paths: DataFrame, countries: DataFrame) -> DataFrame:
    """pairs (x, y) with level: equal, country or local where one contains the other, else null."""
    up = paths.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.lit(True).alias("_up"))
    down = paths.select(F.col("dst").alias("x"), F.col("src").alias("y"), F.lit(True).alias("_down"))
    c = countries.select(F.col("id").alias("_c"), F.lit(True).alias("_country"))
    out = pairs.join(up, ["x", "y"], "left").join(down, ["x", "y"], "left")
    holder: Column = F.when(F.col("_up"), F.col("y")).when(F.col("_down"), F.col("x"))
    out = out.withColumn("_h", holder).join(c, F.col("_h") == F.col("_c"), "left")
    level = F.when(F.col("x") == F.col("y"), "equal").when(F.col("_h").isNull(), F.lit(None)).when(F.col("_country"), "country").otherwise("local")
    return out.select("x", "y", level.alias("level"))


def cross_references(statements: Column, other: Column, dedicated: list[str]) -> Column:
    """The properties by which an item's statements (property to values) name the other item, but for dedicated ones."""
    naming = F.map_filter(statements, lambda p, vs: ~p.isin(*dedicated) & F.exists(vs, lambda v: (v["type"] == "item") & (v["value"] == other)))
    return F.array_sort(F.map_keys(naming))


def linked(items: DataFrame) -> DataFrame:
    """(id): every item that a statement of items names, once."""
    values = items.select(F.explode(F.map_values("statements")).alias("vs")).select(F.explode("vs").alias("v"))
    return values.filter("v.type = 'item'").select(F.col("v.value").alias("id")).distinct()
