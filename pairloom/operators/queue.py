"""The review queue: filters, pages, neighbours and the leaderboard."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.sources.scratch import written


def list_rows(
    rows: DataFrame,
    *,
    sort: str,
    id_: str,
    status: tuple[str, str] | None = None,
    floor: tuple[str, float] | None = None,
    search: tuple[list[str], str] | None = None,
    types: tuple[list[str], list[str]] | None = None,
    mine: tuple[str, str | None] | None = None,
    page: int = 1,
    size: int = 25,
) -> tuple[DataFrame, DataFrame]:
    """(page, all matching rows), highest sort first, then highest id.

    A floor that is not finite is ignored; a viewer who is not known sees nothing of mine; a search
    is for a literal part in any case, cut to 250 characters; up to 50 types match in any column.
    """
    cond: list[Column] = []
    if status:
        cond.append(F.col(status[0]) == status[1])
    if floor and math.isfinite(floor[1]):
        cond.append(F.col(floor[0]) >= floor[1])
    if search and search[1].strip():
        q = F.lower(F.lit(search[1].strip()[:250]))
        cond.append(reduce(lambda x, y: x | y, [F.contains(F.lower(F.col(c)), q) for c in search[0]]))
    if types and types[1]:
        cond.append(reduce(lambda x, y: x | y, [F.col(c).isin(*types[1][:50]) for c in types[0]]))
    if mine:
        cond.append(F.col(mine[0]) == mine[1] if mine[1] is not None else F.lit(False))
    hits = rows.filter(reduce(lambda x, y: x & y, cond, F.lit(True)))
    page, size = min(max(page, 1), 1000), min(max(size, 1), 100)
    return hits.orderBy(F.col(sort).desc(), F.col(id_).desc()).offset((page - 1) * size).limit(size), hits


def keyset_page(rows: DataFrame, key: str, after: int, n: int) -> DataFrame:
    return rows.filter(F.col(key) > after).orderBy(key).limit(n)


def readable(langs: list[str], label_langs: Column, clash_langs: Column) -> Column:
    """Rows of which any label and every clash is in one of langs; unknown (null) passes."""
    mine = F.array(*map(F.lit, langs))
    return (label_langs.isNull() | F.arrays_overlap(label_langs, mine)) & (clash_langs.isNull() | (F.size(F.array_except(clash_langs, mine)) == 0))


def neighbours(rows: DataFrame, by: list[str], sort: str, id_: str) -> DataFrame:
    """rows with the ids before and after in (sort descending, id descending) among those equal in by, nulls being equal.

    The order is dealt in ranges, which are written, so that no group meets in one task; of each
    range the first and last row are held against the ranges beside it.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*(F.col(c).asc_nulls_first() for c in by), F.col(sort).desc_nulls_last(), F.col(id_).desc_nulls_last()]
    dealt = written(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    within = Window.partitionBy("_part").orderBy(*order)
    me = F.struct(F.struct(*by).alias("by"), F.col(id_).alias("id"))
    placed = dealt.withColumns({"_before": F.lag(me).over(within), "_after": F.lead(me).over(within), "_me": me})
    ends = placed.filter("_before is null or _after is null").groupBy(F.col("_part").alias("_p")).agg(
        F.first(F.when(F.col("_before").isNull(), F.col("_me")), True).alias("first"), F.first(F.when(F.col("_after").isNull(), F.col("_me")), True).alias("last")
    )
    ranges = Window.partitionBy(F.lit(0)).orderBy("_p")  # a row for each range
    ends = ends.select("_p", F.lag("last").over(ranges).alias("_end"), F.lead("first").over(ranges).alias("_begin"))
    out = placed.join(F.broadcast(ends), F.col("_part") == F.col("_p"))

    def there(x: Column) -> Column:
        return F.when(x["by"].eqNullSafe(F.struct(*by)), x["id"])

    found = {"prev_id": there(F.coalesce("_before", "_end")), "next_id": there(F.coalesce("_after", "_begin"))}
    return out.withColumns(found).drop("_part", "_p", "_before", "_after", "_me", "_end", "_begin")


def neighbours_of(rows: DataFrame, by: str, sort: str, id_: str, of: int) -> DataFrame:
    """The same for one id by two filtered top-1 lookups, which need no order of all rows."""
    me = rows.filter(F.col(id_) == of).select(F.col(by).alias("_by"), F.col(sort).alias("_sort"))
    peers = rows.join(F.broadcast(me.limit(1)), F.col(by) == F.col("_by"))
    later = (F.col(sort) < F.col("_sort")) | ((F.col(sort) == F.col("_sort")) & (F.col(id_) < of))
    place = F.struct(sort, id_)
    # The next one is the greatest below, the one before the least above.
    return peers.agg(
        F.min(F.when(~later & (F.col(id_) != of), place)).getField(id_).alias("prev_id"), F.max(F.when(later, place)).getField(id_).alias("next_id")
    )


def leaderboard(merges: DataFrame, verdicts: DataFrame, top: int = 100) -> DataFrame:
    """(user, merges, verdicts, total) of two sources of counts, highest total, then merges, then name."""
    m = merges.select("user", F.col("n").alias("merges"), F.lit(0).cast("long").alias("verdicts"))
    v = verdicts.select("user", F.lit(0).cast("long").alias("merges"), F.col("n").alias("verdicts"))
    out = m.unionByName(v).groupBy("user").agg(F.sum("merges").alias("merges"), F.sum("verdicts").alias("verdicts"))
    out = out.withColumn("total", F.col("merges") + F.col("verdicts"))
    return out.orderBy(F.col("total").desc(), F.col("merges").desc(), "user").limit(top)


def page_bounds(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(page, upper): every size-th key in order.

    The order is dealt in ranges: each row's number is its place in its range and the count of the
    ranges before, so no task orders all rows.
    """
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = written(rows.select(key).repartitionByRange(int(n), key).withColumn("_part", F.spark_partition_id()), "dealt")
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    counts = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    numbered = dealt.withColumn("_rank", rank).join(F.broadcast(counts), F.col("_part") == F.col("_p")).withColumn("_row", F.col("_before") + F.col("_rank"))
    return numbered.filter(F.col("_row") % size == 0).select((F.col("_row") / size).cast("long").alias("page"), F.col(key).alias("upper"))


def without_blockers(rows: DataFrame, blocker: str, wanted: bool) -> DataFrame:
    return rows.filter(~F.col(blocker)) if wanted else rows


def by_creator(rows: DataFrame, sides: list[str], creations: DataFrame, user: str) -> DataFrame:
    """rows of which an item on either side was created by user; creations is (id, user_name)."""
    own = creations.filter(F.col("user_name") == user).select(F.col("id").alias("_own")).distinct()
    out = rows
    for n, side in enumerate(sides):
        out = out.join(own.select(F.col("_own").alias(f"_own{n}")), F.col(side) == F.col(f"_own{n}"), "left")
    hit = reduce(lambda x, y: x | y, [F.col(f"_own{n}").isNotNull() for n in range(len(sides))])
    return out.filter(hit).select(*rows.columns)


def fresh(rows: DataFrame, checked_at: str, as_of: Column, days: int) -> DataFrame:
    """rows checked within days of as_of; those never checked are not fresh."""
    return rows.filter(F.col(checked_at) >= as_of - F.make_dt_interval(F.lit(days)))


def among(rows: DataFrame, wanted: DataFrame, cols: list[str]) -> DataFrame:
    """rows whose values of cols are a row of wanted."""
    return rows.join(wanted.select(*cols).distinct(), cols, "left_semi")


def identifiers_only(rows: DataFrame, properties: DataFrame, property_: str = "property") -> DataFrame:
    """rows of properties whose datatype is ExternalId; all of them while no property is known."""
    if not properties.limit(1).count():
        return rows
    known = properties.filter("datatype = 'ExternalId'").select(F.col("pid").alias("_pid"))
    return rows.join(known, F.col(property_) == F.col("_pid"), "left_semi")


def inapplicable(satisfied: Column) -> Column:
    """Whether every one of the constraints is known to be unsatisfied; null, not known, lets pass, and so does none."""
    return (F.size(satisfied) > 0) & F.forall(satisfied, lambda s: ~F.coalesce(s, F.lit(True)))


def totals(board: DataFrame, cols: list[str]) -> DataFrame:
    """Sums over all rows, 0 for none."""
    return board.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols])


def progress(segments: DataFrame) -> DataFrame:
    """(done, failed, matched) of segments (done_at, failed, matched)."""
    return segments.agg(
        F.count("done_at").alias("done"), F.coalesce(F.sum(F.col("failed").cast("int")), F.lit(0)).alias("failed"), F.coalesce(F.sum("matched"), F.lit(0)).alias("matched")
    )


def latest(rows: DataFrame, by: str, id_: str, cols: list[str]) -> DataFrame:
    """cols of the row with the highest id of each by."""
    return rows.groupBy(by).agg(F.max_by(F.struct(*cols), F.col(id_)).alias("_row")).select(by, *[F.col(f"_row.{c}") for c in cols])


def by_strength(reasons: Column, strengths: Column) -> Column:
    """reasons, strongest first, those of one strength in their order."""
    placed = F.transform(F.arrays_zip(reasons.alias("r"), strengths.alias("s")), lambda x, i: F.struct((-x["s"]).alias("s"), i.alias("i"), x["r"].alias("r")))
    return F.transform(F.array_sort(placed), lambda x: x["r"])


def display_order(rows: DataFrame, demoted: str, tier: str, pid: str) -> DataFrame:
    """rows in the order of a list of fields: demoted ones last, then by tier, then by the number of the property."""
    return rows.orderBy(F.col(demoted), F.col(tier), F.regexp_extract(pid, r"(\d+)", 1).try_cast("long").asc_nulls_first(), F.col(pid))


def summary(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """candidates with the labels of both items, and their type if they share it; items is (id, label, type)."""
    a, b = (items.select(F.col("id").alias(f"_{s}"), F.col("label").alias(f"{s}_label"), F.col("type").alias(f"_{s}_type")) for s in ("from", "into"))
    out = candidates.join(a, F.col("merged_from") == F.col("_from"), "left").join(b, F.col("merged_into") == F.col("_into"), "left")
    return out.withColumn("shared_type", F.when(F.col("_from_type") == F.col("_into_type"), F.col("_from_type"))).drop("_from", "_into", "_from_type", "_into_type")


def redirect_overlay(clashes: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, redirects) of clashing (id, wiki, title): where a page is known to redirect, by wiki; a null target is not known.

    pages is (wiki, title, is_redirect, target).
    """
    hit = clashes.join(pages.filter("is_redirect").select("wiki", "title", "target"), ["wiki", "title"])
    return hit.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("wiki", "target")))).alias("redirects"))
