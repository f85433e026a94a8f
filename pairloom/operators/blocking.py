"""Candidate pairs from shared keys, without ever comparing everything with everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members up to which a group is expanded into pairs; larger ones are audited instead.
MAX_GROUP = 100


def groups(rows: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """(keys, n) of groups of several distinct ids; rows with a null key are in none."""
    kept = rows.dropna(subset=keys)
    return kept.groupBy(*keys).agg(F.countDistinct(id_).alias("n")).filter("n > 1")


def shared_keys(rows: DataFrame, keys: list[str], id_: str) -> DataFrame:
    return groups(rows, keys, id_).select(*keys, "n")


def members(rows: DataFrame, keys: list[str], id_: str, most: int = MAX_GROUP) -> DataFrame:
    """(keys, ids, n): the ids of groups of 2 to most, ascending. Only bounded groups are collected."""
    small = groups(rows, keys, id_).filter(F.col("n") <= most).select(*keys, "n")
    kept = rows.select(*keys, id_).distinct().join(small, keys)
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list(id_)).alias("ids"), F.first("n").alias("n"))


def oversized(rows: DataFrame, keys: list[str], id_: str, most: int = MAX_GROUP) -> DataFrame:
    return groups(rows, keys, id_).filter(F.col("n") > most)


def pairs(rows: DataFrame, keys: list[str], id_: str, most: int = MAX_GROUP) -> DataFrame:
    """(a, b) with a < b that share all keys in a group of up to most.

    The cap comes before the expansion, so a popular key costs one count. A capped group expands
    inside its row, without a self-join.
    """
    m = members(rows, keys, id_, most)
    a = F.posexplode("ids").alias("i", "a")
    first = m.select("ids", a)
    return first.select("a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("b"))


def union_pairs(*several: DataFrame) -> DataFrame:
    """Each pair once, whichever strategies found it."""
    out = several[0]
    for s in several[1:]:
        out = out.unionByName(s)
    return out.distinct()


def incremental_keys(rows: DataFrame, keys: list[str], id_: str, after: int) -> DataFrame:
    """Keys that a row above the watermark shares with any other id."""
    new = rows.filter(F.col(id_) > after).select(*keys, F.col(id_).alias("_new"))
    old = rows.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(id_).alias("_old"))
    cond = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_new") != F.col("_old")]
    return new.join(old, cond, "left_semi").select(*keys).distinct()


def with_block_size(pair: DataFrame, rows: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """pair with block_size, the size of the block that both are in; null if they are in different ones."""
    sized = rows.select(F.col(id_), *keys).join(groups(rows, keys, id_), keys, "left")
    x = sized.select(F.col(id_).alias("a"), *[F.col(k).alias(f"a_{k}") for k in keys], F.col("n").alias("block_size"))
    y = sized.select(F.col(id_).alias("b"), *[F.col(k).alias(f"b_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"a_{k}") == F.col(f"b_{k}")
    return pair.join(x, "a").join(y, "b").select("a", "b", F.when(same, F.col("block_size")).alias("block_size"))
