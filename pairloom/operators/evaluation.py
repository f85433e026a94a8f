"""Judging a classifier on labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision, recall, f1; 0 where a denominator is."""
    c = rows.agg(
        F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"),
    )
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return c.select(
        "tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def gate(baseline: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, change) of two runs' (key, correct): regressed, fixed, added, removed or same."""
    b, c = baseline.select(key, F.col("correct").alias("_b")), current.select(key, F.col("correct").alias("_c"))
    change = (
        F.when(F.col("_b").isNull(), "added").when(F.col("_c").isNull(), "removed")
        .when(F.col("_b") & ~F.col("_c"), "regressed").when(~F.col("_b") & F.col("_c"), "fixed").otherwise("same")
    )
    return b.join(c, key, "full_outer").select(key, change.alias("change"))


def escalation(rows: DataFrame, rules: dict[str, Column], cheap_right: Column, dear_right: Column, cheap: float, dear: float) -> DataFrame:
    """For each rule that says when to ask the dear model: how often, how many are right, the mean cost. All rules in one pass."""
    stacked = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(c, F.lit(False)).alias("up")) for k, c in rules.items()])).alias("r"), cheap_right.alias("c"), dear_right.alias("d"))
    return stacked.groupBy("r.rule").agg(
        F.count_if(F.col("r.up")).alias("escalated"),
        F.count_if(F.when(F.col("r.up"), F.col("d")).otherwise(F.col("c"))).alias("right"),
        F.count(F.lit(1)).alias("n"),
    ).select("rule", "escalated", "right", ratio(F.col("escalated"), F.col("n")).alias("share"), (F.lit(cheap) + ratio(F.col("escalated"), F.col("n")) * dear).alias("mean_cost"))


def bands(rows: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """(band, n) by the highest edge that value reaches."""
    band = F.lit(None).cast("string")
    for low in edges:
        band = F.when(value >= low, F.lit(f"{low:g}")).otherwise(band)
    return rows.select(band.alias("band")).filter("band is not null").groupBy("band").agg(F.count(F.lit(1)).alias("n"))
