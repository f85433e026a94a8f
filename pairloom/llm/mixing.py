"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Every document is due an expected number of copies: what its source's target asks for, times a
preference of its length band. Whole copies are certain. The remaining fraction is an inclusion
probability, and documents are ranked within their source by random odds over inclusion odds
(Rosen's Pareto order sampling); the sample of fixed size, counted in words, is the front of that
order. The cut is found with two histograms of the rank key and an exact order of the few rows in
one cell, so that no task ever sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.common import WORD, checked_broadcast, materialise, table

#: No document is repeated more often, and no target exceeds so many times its source.
MAX_COPIES = 3
#: Length bands: words below which a document counts as a fragment or as short, and the preference of each.
BANDS = ((8, 1.0), (32, 2.0))
FULL_BAND = 4.0
#: Source weights, repeated along the sources in code point order.
SOURCE_WEIGHTS = (1, 2, 3)
_CELLS = 1024


def size_of(text: str = "text") -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def preference(size: Column) -> Column:
    out = F.lit(FULL_BAND)
    for below, value in reversed(BANDS):
        out = F.when(size < below, F.lit(value)).otherwise(out)
    return out


def draw(seed: str, doc_id: str = "doc_id", text: str = "text") -> Column:
    """A uniform number in (0, 1) that depends on the seed, id and text alone, so reruns agree."""
    named = F.concat(
        F.lit(seed + "|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit(""))
    )
    return (F.conv(F.substring(F.md5(named.cast("binary")), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))


def _level(df: DataFrame, by: list[str], ratio: str, name: str, cap: str, weight: str, total: str, out: str) -> DataFrame:
    """The water level at which sum(least(cap, level * weight)) is total, per group of by.

    In ascending order of cap / weight, the level that would hold if all before were full is right
    for the first row that it does not fill, and is lower for the later ones: so it is a maximum.
    """
    before = Window.partitionBy(*by).orderBy(ratio, name)
    past = F.coalesce(F.sum(cap).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum(weight).over(before.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("_try", (F.col(total) - past) / F.nullif(left, F.lit(0.0)))
    fits = F.when(F.col("_try") <= F.col(ratio), F.col("_try"))
    return df.withColumn(out, F.max(fits).over(Window.partitionBy(*by))).drop("_try")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) of a table with source and size.

    Sources in code point order, null last, take the weights in turn and share all words; a target
    stops at max_copies times its source, and the excess goes to the others by weight. The windows
    here run over one row for each source.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("_n", F.row_number().over(order))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_n") - 1) % len(weights) + 1).cast("int"))
    per = (
        per.withColumn("_one", F.lit(0))
        .withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size").cast("double") * float(max_copies))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(Window.partitionBy("_one")).cast("double"))
    )
    per = _level(per, ["_one"], "_ratio", "_n", "_cap", "_weight", "_total", "_lvl")
    return per.select("source", "source_size", F.least("_cap", F.col("_lvl") * F.col("_weight")).alias("target"))


def copies_due(sizes: DataFrame, targets: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, pref, due, rest, ...): expected copies of a document by source and preference.

    due is proportional to the preference up to max_copies, such that the expected words are the
    target; rest is the words that the certain copies leave to be sampled.
    """
    by = sizes.groupBy("source", "pref").agg(F.sum("size").alias("_words"))
    by = by.join(targets, by["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    by = (
        by.withColumn("_cap", F.col("_words").cast("double") * float(max_copies))
        .withColumn("_mass", F.col("_words").cast("double") * F.col("pref"))
        .withColumn("_ratio", F.lit(float(max_copies)) / F.col("pref"))
    )
    by = _level(by, ["source"], "_ratio", "pref", "_cap", "_mass", "target", "_lvl")
    due = F.least(F.lit(float(max_copies)), F.coalesce(F.col("_lvl"), F.lit(0.0)) * F.col("pref"))
    by = by.withColumn("due", due)
    certain = F.sum(F.floor("due").cast("double") * F.col("_words").cast("double")).over(Window.partitionBy("source"))
    return by.withColumn("rest", F.col("target") - certain).select("source", "pref", "due", "rest", "source_size", "target")


def _ranked(rows: DataFrame, due: DataFrame) -> DataFrame:
    """rows with base (certain copies) and key in [0, 1], by which Pareto order sampling ranks; key is null where nothing is left to chance."""
    due = due.withColumnsRenamed({"source": "_source", "pref": "_pref"})
    out = rows.join(due, rows["source"].eqNullSafe(due["_source"]) & (rows["pref"] == due["_pref"])).drop("_source", "_pref")
    share = F.col("due") - F.floor("due")
    odds = (F.col("u") / (F.lit(1.0) - F.col("u"))) / (share / (F.lit(1.0) - share))
    key = F.when(share > 0, odds / (F.lit(1.0) + odds))
    return out.withColumn("base", F.floor("due").cast("long")).withColumn("key", key)


def _cut(ranked: DataFrame) -> DataFrame:
    """(source, cut, cut_id): documents up to that key and id, in this order, are in the sample.

    The front of the order is the longest whose words do not exceed rest, and one more if that
    comes closer. Two histograms narrow the cut to one cell of about a millionth of the source.
    """
    rows = ranked.filter(F.col("key").isNotNull()).select("source", "doc_id", "size", "rest", "key")
    rows = rows.withColumn("_past", F.lit(0).cast("long"))
    for fine in (_CELLS, _CELLS * _CELLS):
        rows = rows.withColumn("_cell", F.floor(F.col("key") * float(fine)))
        cells = rows.groupBy("source", "_cell", "rest", "_past").agg(F.sum("size").alias("_words"))
        upto = Window.partitionBy("source").orderBy("_cell")
        cells = cells.withColumn("_sum", F.col("_past") + F.sum("_words").over(upto))
        # The first cell that passes rest holds the cut; if none does, the last one.
        cells = cells.withColumn("_over", F.col("_sum").cast("double") > F.col("rest"))
        last = Window.partitionBy("source")
        hit = F.coalesce(F.min(F.when(F.col("_over"), F.col("_cell"))).over(last), F.max("_cell").over(last))
        cells = cells.withColumn("_hit", hit).filter("_cell = _hit").select(
            F.col("source").alias("_s"), F.col("_cell").alias("_c"), (F.col("_sum") - F.col("_words")).alias("_new")
        )
        cells = checked_broadcast(materialise(cells, "mix-cells"))
        rows = rows.join(cells, rows["source"].eqNullSafe(cells["_s"]) & (rows["_cell"] == cells["_c"]))
        rows = rows.withColumn("_past", F.col("_new")).drop("_s", "_c", "_new")
    # Rows equal in key and id are repeated rows: they are taken or left together.
    ties = rows.groupBy("source", "key", "doc_id", "rest", "_past").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first())
    ties = ties.withColumn("_sum", F.col("_past") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    over = F.col("_sum").cast("double") - F.col("rest")
    under = F.col("rest") - (F.col("_sum") - F.col("size")).cast("double")
    ties = ties.withColumn("_in", (over <= 0) | (over < under))
    # Everything before the cell is in; the cut is the last one that is in, or else the cell's start.
    first = F.min(F.struct("key", F.coalesce("doc_id", F.lit(-(2**63))).alias("id")))
    return ties.groupBy("source").agg(
        F.max(F.when(F.col("_in"), F.struct("key", F.coalesce("doc_id", F.lit(-(2**63))).alias("id")))).alias("_at"), first.alias("_first")
    ).select(
        "source",
        F.coalesce("_at.key", "_first.key").alias("cut"),
        F.when(F.col("_at").isNotNull(), F.col("_at.id")).alias("cut_id"),
    )


def plan_mix(docs: DataFrame, seed: str = "mix-1", max_copies: int = MAX_COPIES) -> tuple[DataFrame, DataFrame]:
    """(light, plan): a written table of doc_id, source, size, pref, u; and per source and preference what to take."""
    size = size_of()
    light = docs.select("doc_id", "source", size.alias("size"), preference(size).alias("pref"), draw(seed).alias("u"))
    light = materialise(light, "mix-sizes")
    targets = source_targets(light, max_copies=max_copies)
    due = checked_broadcast(materialise(copies_due(light, targets, max_copies), "mix-due"))
    cut = _cut(_ranked(light, due)).withColumnRenamed("source", "_src")
    plan = due.join(cut, due["source"].eqNullSafe(cut["_src"]), "left").drop("_src")
    return light, checked_broadcast(materialise(plan, "mix-plan"))


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (source, doc_id, pref, u, ...) with copies, the number of times the mix takes each."""
    ranked = _ranked(rows, plan)
    at = F.coalesce("doc_id", F.lit(-(2**63)))
    within = (F.col("key") < F.col("cut")) | ((F.col("key") == F.col("cut")) & (at <= F.col("cut_id")))
    return ranked.withColumn("copies", F.col("base") + F.when(F.coalesce(within, F.lit(False)), 1).otherwise(0))


def mix_sources(docs: DataFrame, seed: str = "mix-1", max_copies: int = MAX_COPIES) -> DataFrame:
    """docs with each document as often as the mix takes it, and no other column.

    Null source is a source of its own. Null or wordless texts have size 0 and cost nothing;
    they follow the same draw. Rows equal in id and text share one draw. An empty table gives an
    empty mix. Extra columns pass through, whatever their names.
    """
    names = docs.columns
    _, plan = plan_mix(docs, seed, max_copies)
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    size = size_of()
    rows = docs.select("doc_id", "source", preference(size).alias("pref"), draw(seed).alias("u"), row.alias("_row"))
    rows = with_copies(rows, plan).filter("copies > 0")
    return rows.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: size, its source's size and target, and the words that the mix takes."""
    light, plan = plan_mix(table(spark, sf_dir, "documents"))
    return with_copies(light, plan).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


#: The same by exact ordered sums.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 12))::BIGINT::DOUBLE + 0.5)
      / 281474976710656.0::DOUBLE AS u
  FROM documents),
p AS (SELECT *, CASE WHEN size < 8 THEN 1.0::DOUBLE WHEN size < 32 THEN 2.0::DOUBLE ELSE 4.0::DOUBLE END AS pref FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM p GROUP BY source),
s1 AS (SELECT *, ((n - 1) % 3 + 1)::DOUBLE AS w, source_size::DOUBLE * 3.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
s2 AS (SELECT *, cap / w AS ratio FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY ratio, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t FROM s2),
s4 AS (SELECT *, max(CASE WHEN t <= ratio THEN t END) OVER () AS lvl FROM s3),
tg AS (SELECT source, source_size, least(cap, lvl * w) AS target FROM s4),
b AS (SELECT source, pref, sum(size)::BIGINT AS words FROM p GROUP BY source, pref),
b1 AS (SELECT b.*, tg.source_size, tg.target, words::DOUBLE * 3.0::DOUBLE AS cap, words::DOUBLE * pref AS mass, 3.0::DOUBLE / pref AS ratio
  FROM b JOIN tg ON b.source IS NOT DISTINCT FROM tg.source),
b2 AS (SELECT *, (target - coalesce(sum(cap) OVER (PARTITION BY source ORDER BY ratio, pref ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(mass) OVER (PARTITION BY source ORDER BY ratio, pref ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS t FROM b1),
b3 AS (SELECT *, max(CASE WHEN t <= ratio THEN t END) OVER (PARTITION BY source) AS lvl FROM b2),
b4 AS (SELECT *, least(3.0::DOUBLE, coalesce(lvl, 0) * pref) AS due FROM b3),
b5 AS (SELECT *, target - sum(floor(due) * words::DOUBLE) OVER (PARTITION BY source) AS rest FROM b4),
r AS (SELECT p.doc_id, p.source, p.size, p.u, b5.source_size, b5.target, b5.due, b5.rest, floor(b5.due) AS base, b5.due - floor(b5.due) AS share
  FROM p JOIN b5 ON p.source IS NOT DISTINCT FROM b5.source AND p.pref = b5.pref),
k AS (SELECT *, CASE WHEN share > 0 THEN (u / (1.0 - u)) / (share / (1.0 - share)) END AS odds FROM r),
k1 AS (SELECT *, odds / (1.0 + odds) AS key FROM k),
c AS (SELECT *, sum(CASE WHEN key IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY key NULLS LAST, doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k1),
f AS (SELECT *, (base + CASE WHEN key IS NOT NULL AND (upto <= rest OR upto - rest < rest - (upto - size)) THEN 1 ELSE 0 END)::BIGINT AS copies FROM c)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM f
"""
