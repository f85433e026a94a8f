"""Choosing what a two-stage classifier reviews, within a budget, and acting on its answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ATTEMPTS = 3
BATCH_REQUESTS = 5000


def first_picks(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Open candidates without a review, or whose review failed with attempts left; once for each unordered pair, lowest confidence first."""
    low, high = F.least("merged_from", "merged_into"), F.greatest("merged_from", "merged_into")
    c = candidates.filter(F.col("status") == "open").withColumn("low", low).withColumn("high", high)
    r = reviews.select("low", "high", F.col("outcome"), F.col("attempts"))
    again = F.col("outcome").isNull() | ((F.col("outcome") == "failed") & (F.col("attempts") < MAX_ATTEMPTS))
    once = Window.partitionBy("low", "high").orderBy("confidence", "merged_from")
    c = c.join(r, ["low", "high"], "left").filter(again).withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    return c.select("low", "high", "confidence")


def needs_confirmation(verdict: Column, probability: Column) -> Column:
    trusted = ((verdict == "same") & (probability >= 0.7)) | ((verdict == "different") & (probability < 0.1))
    return ~trusted


def affordable(picks: DataFrame, order: list[Column], cost: str, budget: float, most: int) -> DataFrame:
    """The picks in order until the budget or the number is used up, with their batch.

    The running sum is over picks of one run, which most bounds beforehand.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    first = picks.orderBy(*order).limit(most)
    out = first.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).withColumn("spent", F.sum(cost).over(w))
    return out.filter(F.col("spent") <= budget).withColumn("batch", F.floor((F.col("n") - 1) / BATCH_REQUESTS))


def expected_cost(done: DataFrame, by: str, cost: str, fallback: float, least: int = 200, margin: float = 1.5) -> DataFrame:
    """(by, expected): the mean cost where least samples are known, else fallback, times margin."""
    out = done.groupBy(by).agg(F.count(cost).alias("n"), F.avg(cost).alias("mean"))
    return out.select(by, "n", (F.when(F.col("n") >= least, F.col("mean")).otherwise(F.lit(fallback)) * margin).alias("expected"))


def parse_answer(c: Column) -> Column:
    """(verdict, probability, rationale) of a JSON answer; null unless it has exactly that form. The probability is clamped."""
    got = F.from_json(c, "verdict string, probability double, rationale string")
    fine = got["verdict"].isin("same", "different", "unsure") & got["probability"].isNotNull() & got["rationale"].isNotNull()
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), got["probability"]))
    return F.when(fine, F.struct(got["verdict"].alias("verdict"), clamped.alias("probability"), got["rationale"].alias("rationale")))


def hides(verdict: Column, probability: Column, status: Column) -> Column:
    """Whether a confirmation hides a candidate that is still open."""
    return (verdict == "different") & (probability < 0.1) & (status == "open")


def failure(submitted: Column, age_minutes: Column, batch_found: Column, results_kept: Column, has_result: Column) -> Column:
    return (
        F.when(~submitted & (age_minutes > 60), "never submitted").when(~submitted, "pending").when(~batch_found, "batch not found")
        .when(~results_kept, "results gone").when(~has_result, "no result").otherwise("ok")
    )


def sample_bands(rows: DataFrame, value: Column, edges: list[float], n: int, key: str) -> DataFrame:
    """n rows of each band of value, by hash of the key, so that reruns agree."""
    band = F.lit(None).cast("string")
    for low in edges:
        band = F.when(value >= low, F.lit(f"{low:g}")).otherwise(band)
    w = Window.partitionBy("band").orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    return rows.withColumn("band", band).filter("band is not null").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def confirm_picks(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """(low, high, probability) of open candidates whose first pass says different without being trusted, lowest probability first.

    reviews is (low, high, stage, outcome, verdict, probability); a pair that has been confirmed is not picked again.
    """
    first = reviews.filter("stage = 'first' and outcome = 'done' and verdict = 'different'").filter(needs_confirmation(F.col("verdict"), F.col("probability")))
    sure = reviews.filter("stage = 'confirm' and outcome = 'done'").select("low", "high")
    open_ = candidates.filter("status = 'open'").select(F.least("merged_from", "merged_into").alias("low"), F.greatest("merged_from", "merged_into").alias("high")).distinct()
    out = first.join(sure, ["low", "high"], "left_anti").join(open_, ["low", "high"], "left_semi")
    return out.select("low", "high", "probability").orderBy("probability", "low", "high")


def month_spend(done: DataFrame, pending: DataFrame, expected: DataFrame, by: str, cost: str, done_at: str, start: Column) -> DataFrame:
    """(by, spent): what was completed since start, and what pending requests are expected to cost; expected is (by, expected)."""
    spent = done.filter(F.col(done_at) >= start).groupBy(by).agg(F.sum(cost).alias("_done"))
    waiting = pending.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).join(expected.select(by, "expected"), by)
    both = spent.join(waiting, by, "full_outer")
    return both.select(by, (F.coalesce("_done", F.lit(0.0)) + F.coalesce(F.col("_n") * F.col("expected"), F.lit(0.0))).alias("spent"))


def oldest(requests: DataFrame, batch: str, created_at: str) -> DataFrame:
    return requests.groupBy(batch).agg(F.min(created_at).alias("oldest"))


def outcome_counts(reviews: DataFrame, stage: str, outcome: str, outcomes: list[str]) -> DataFrame:
    """A row for each stage, a column for each outcome."""
    return reviews.groupBy(stage).agg(*[F.count_if(F.col(outcome) == o).alias(o) for o in outcomes])
