"""Bringing a mirror up to date: change detection, set differences, guarded pruning, staggered refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(cols: list[str]) -> Column:
    """SHA-1 of the columns' texts in order of name; null differs from an empty text."""
    return F.sha1(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in sorted(cols)]))


def detect_changes(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, change): added, changed, removed or same, by the hash of cols."""
    o, n = old.select(key, content_hash(cols).alias("_o")), new.select(key, content_hash(cols).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") == F.col("_n"), "same").otherwise("changed")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def row_diff(old: DataFrame, new: DataFrame, cols: list[str]) -> DataFrame:
    """(cols, op): delete for rows only in old, insert for rows only in new."""
    gone = old.select(*cols).join(new.select(*cols), cols, "left_anti").withColumn("op", F.lit("delete"))
    come = new.select(*cols).join(old.select(*cols), cols, "left_anti").withColumn("op", F.lit("insert"))
    return gone.unionByName(come)


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and the rows of new whose key it lacks, one for each key."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def prune_missing(mirror: DataFrame, seen: DataFrame, key: str, most: float = 0.2) -> DataFrame:
    """mirror without the keys that were not seen; raises if that is more than the share most."""
    kept = mirror.join(seen.select(key).distinct(), key, "left_semi")
    before, after = mirror.count(), kept.count()
    if before - after > most * before:
        raise ValueError(f"refusing to delete {before - after} of {before} rows")
    return kept


def due_for_refresh(rows: DataFrame, key: str, checked_at: str, as_of: Column, least_days: int = 6, spread: int = 28) -> DataFrame:
    """Rows not checked for least_days and a number of days that depends on the key, so that refreshes spread out."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 4), 16, 10).cast("int") % spread
    return rows.withColumn("limit_days", least_days + bucket).filter(F.datediff(as_of, F.col(checked_at)) > F.col("limit_days"))


def replace_closure(closure: DataFrame, looked_up: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """closure with the rows of every looked-up key replaced by what was found; other keys stay."""
    return closure.join(looked_up.select(key).distinct(), key, "left_anti").unionByName(found)
