"""Comparing values, sets of values and whole records field by field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions import text

RANK = ("distinct", "similar", "identical")


def compare_strings(a: Column, b: Column, similar: float = 0.75) -> Column:
    """Rank 0 to 2 of two strings."""
    alike = text.similarity_at_least(text.normalize(a), text.normalize(b), similar) >= similar
    return F.when(a == b, 2).when(alike, 1).otherwise(0)


def compare_exact(a: Column, b: Column) -> Column:
    return F.when(a == b, 2).otherwise(0)


def status(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RANK)), rank + 1)


def best_against(values: Column, others: Column, compare) -> Column:
    """For each value, its best rank against the others."""
    return F.transform(values, lambda v: F.coalesce(F.array_max(F.transform(others, lambda o: compare(v, o))), F.lit(0)))


def compare_sets(a: Column, b: Column, compare=compare_strings) -> Column:
    """identical if every value of both sides is, distinct if all are, else similar; one-sided if a side is empty."""
    ranks = F.concat(best_against(a, b, compare), best_against(b, a, compare))
    none = F.size(ranks) == 0
    return (
        F.when(none | F.forall(ranks, lambda r: r == 2), "identical")
        .when((F.size(a) == 0) | (F.size(b) == 0), "one-sided")
        .when(F.forall(ranks, lambda r: r == 0), "distinct")
        .otherwise("similar")
    )


def compare_rows(a: Column, b: Column) -> Column:
    """An array of (field, status) over the sorted union of the keys of two maps of strings."""
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))

    def row(k: Column) -> Column:
        x, y = F.try_element_at(a, k), F.try_element_at(b, k)
        s = F.when(x.isNull() | y.isNull(), "one-sided").otherwise(status(compare_strings(x, y)))
        return F.struct(k.alias("field"), s.alias("status"))

    return F.transform(keys, row)


#: Properties whose values are phone numbers, and the one whose items are never alike by name. Fixed values.
PHONES, NOT_BY_NAME = ("P1329", "P2900"), "P21"


def value_status(a: Column, b: Column, pid: Column | None = None, level: Column | None = None, labels: tuple[Column, Column] | None = None) -> Column:
    """Status of two tagged values as snak_value() gives them; the first rule that holds decides.

    pid is the property, level whether one item contains the other (country, local or null), labels
    the names of two items.
    """
    from pairloom.functions import geo, temporal

    pid = F.lit(None).cast("string") if pid is None else pid
    level = F.lit(None).cast("string") if level is None else level
    x, y = labels or (F.lit(None).cast("string"),) * 2
    named_alike = (F.coalesce(pid, F.lit("")) != NOT_BY_NAME) & (text.similarity(text.normalize(x), text.normalize(y)) >= 0.6)
    away = geo.distance(a["latitude"], a["longitude"], b["latitude"], b["longitude"], F.coalesce(geo.radius(a["globe"]), F.lit(geo.RADIUS["earth"])))
    pa, pb = F.coalesce(a["time_precision"], F.lit(9)), F.coalesce(b["time_precision"], F.lit(9))
    coarse = temporal.compare_coarse(temporal.part(a["value"], 1), pa, temporal.part(b["value"], 1), pb)
    return (
        F.when(a["type"] != b["type"], "distinct")
        .when(a["type"] == "somevalue", "distinct")
        .when(a["type"] == "novalue", "identical")
        .when((a["type"] == "quantity") & ~a["unit"].eqNullSafe(b["unit"]), "distinct")
        .when((a["type"] == "coordinate") & ~a["globe"].eqNullSafe(b["globe"]), "distinct")
        .when((a["type"] == "time") & ((pa < 9) | (pb < 9)), coarse)
        .when(a["value"] == b["value"], "identical")
        .when(a["type"] == "item", F.when(level.isNotNull() | F.coalesce(named_alike, F.lit(False)), "similar").otherwise("distinct"))
        .when(a["type"] == "time", F.regexp_replace(temporal.compare_calendar(a["value"], b["value"]), ":.*", ""))
        .when(a["type"].isin("quantity", "external-id", "musical-notation"), "distinct")
        .when(a["type"] == "coordinate", F.when(away <= 250, "similar").otherwise("distinct"))
        .when(a["type"] == "url", text.compare_urls(a["value"], b["value"]))
        .when(pid.isin(*PHONES), F.when(text.same_phone(a["value"], b["value"]), "identical").otherwise("distinct"))
        .otherwise(status(compare_strings(a["value"], b["value"])))
    )


def compare_places(a: Column, b: Column, compare) -> Column:
    """Status of two arrays where compare gives (rank, broad): a value's best is a similar one that is not broad before a broad one.

    distinct if there are values that are not only broadly alike and all of them are distinct.
    """
    def best(values: Column, others: Column) -> Column:
        return F.transform(values, lambda v: F.array_max(F.transform(others, lambda o: compare(v, o)["rank"] * 2 - compare(v, o)["broad"].cast("int"))))

    # 4 identical, 2 similar, 1 similar but broad, 0 distinct
    each = F.concat(best(a, b), best(b, a))
    narrow = F.filter(each, lambda r: r != 1)
    return (
        F.when(F.forall(each, lambda r: r == 4), "identical")
        .when((F.size(a) == 0) | (F.size(b) == 0), "one-sided")
        .when((F.size(narrow) > 0) & F.forall(narrow, lambda r: r == 0), "distinct")
        .otherwise("similar")
    )
