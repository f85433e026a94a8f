"""An ordered fold of weights and caps over a pair's signals.

The order of the steps is part of their meaning: a cap lowers the score as it stands, and later
steps may still move it. The fold is one expression, so a pair is scored in a single projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.functions.temporal import modest_gap_penalty
from pairloom.operators.blocking import pairs


@dataclass(frozen=True)
class Step:
    """kind is weight, cap or ceiling; amount may be a number or a column, and when a condition."""

    kind: str
    reason: str
    amount: float | Column
    when: Column

    def value(self) -> Column:
        return self.amount if isinstance(self.amount, Column) else F.lit(float(self.amount))


def fold(df: DataFrame, steps: list[Step], trace: bool = False) -> DataFrame:
    """df with confidence, in [0, 1], and reasons; caps come first in reasons, the last one foremost.

    With trace, also the score after each step. Each partial score is a column of its own, so the
    expression grows with the number of steps, not with its square.
    """
    out = df.withColumn("_s0", F.lit(0.0))
    for n, s in enumerate(steps):
        was = F.col(f"_s{n}")
        value = F.when(F.coalesce(s.when, F.lit(False)), s.value())
        # Each partial score is named once; least() passes over the null of a step that does not apply.
        out = out.withColumn(f"_s{n + 1}", was + F.coalesce(value, F.lit(0.0)) if s.kind == "weight" else F.least(was, value))
    last = F.col(f"_s{len(steps)}")

    def told(kind: tuple[str, ...]) -> Column:
        which = []
        for n, s in enumerate(steps):
            if s.kind in kind:
                hit = F.coalesce(s.when, F.lit(False))
                if s.kind == "ceiling":  # told only if it bit
                    hit &= F.col(f"_s{n + 1}") < F.col(f"_s{n}")
                which.append(F.when(hit, F.lit(s.reason)))
        return F.array_compact(F.array(*which)) if which else F.array().cast("array<string>")

    reasons = F.concat(F.reverse(told(("cap", "ceiling"))), told(("weight",)))
    out = out.withColumn("reasons", F.concat_ws("; ", reasons)).withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), last)), 9))
    if trace:
        out = out.withColumn("trace", F.array(*[F.round(f"_s{n + 1}", 6) for n in range(len(steps))]))
    return out.drop(*[f"_s{n}" for n in range(len(steps) + 1)])


def part_pairs(part: DataFrame) -> DataFrame:
    """Pairs of parts that share name key and type, beside each other."""
    rows = part.withColumn("key", text.blocking_key(F.col("p_name")))
    found = pairs(rows, ["key", "p_type"], "p_partkey")
    cols = ["p_norm", "p_brand", "p_size", "p_retailprice"]
    named = part.withColumn("p_norm", text.normalize(F.col("p_name")))  # once for each part, not for each pair
    a, b = (named.select(F.col("p_partkey").alias(s), *[F.col(c).alias(f"{s}_{c[2:]}") for c in cols]) for s in "ab")
    return found.join(a, "a").join(b, "b")


def part_signals(pairs_: DataFrame) -> DataFrame:
    """Each signal as a column, so that the rules share what it costs."""
    return pairs_.withColumns(
        {
            "same_brand": F.col("a_brand") == F.col("b_brand"),
            "alike": text.similarity(F.col("a_norm"), F.col("b_norm")),
            "gap": F.abs(F.col("a_size") - F.col("b_size")),
            "price_gap": F.abs(F.col("a_retailprice") - F.col("b_retailprice")),
        }
    )


def part_steps() -> list[Step]:
    """The rules over the signals of part_signals()."""
    brand, alike, gap, price = map(F.col, ("same_brand", "alike", "gap", "price_gap"))
    return [
        Step("weight", "shared brand", 0.6, brand),
        Step("weight", "same type", 0.1, F.lit(True)),
        Step("weight", "same name", 0.35, alike >= 0.995),
        Step("weight", "similar name", 0.2, (alike >= 0.75) & (alike < 0.995)),
        Step("weight", "different name", -0.35, alike < 0.75),
        Step("weight", "sizes far apart", -0.3, (gap >= 10) & brand),
        Step("cap", "sizes far apart, no shared brand", 0.1, (gap >= 10) & ~brand),
        Step("weight", "sizes differ", -modest_gap_penalty(gap), (gap >= 2) & (gap < 10)),
        Step("weight", "prices differ", -0.2, price > 200),
        Step("ceiling", "held below by few signals", F.when(brand & (gap == 0), 0.93).when(brand, 0.85).otherwise(0.72), F.lit(True)),
    ]


def score_parts(part: DataFrame, trace: bool = False) -> DataFrame:
    """Scored pairs of parts, the younger (higher id) as merged_from."""
    out = fold(part_signals(part_pairs(part)), part_steps(), trace)
    cols = ["confidence", "reasons", *(["trace"] if trace else [])]
    return out.select(F.greatest("a", "b").alias("merged_from"), F.least("a", "b").alias("merged_into"), *cols)
