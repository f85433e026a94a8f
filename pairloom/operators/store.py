"""The candidate store as versioned snapshots: each change is a join that yields the next snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses whose rows a rescore must not touch. Fixed values.
PROTECTED = ("merging", "dismissed", "merged", "auto_dismissed")
FLOOR = 0.4
#: Seconds after which a claim lapses.
CLAIM_SECONDS = 600
KEY = ("merged_from", "merged_into")


def is_protected(status: Column) -> Column:
    return F.coalesce(status.isin(*PROTECTED), F.lit(False))


def upsert(old: DataFrame, new: DataFrame, guarded: tuple[str, ...] = ("confidence", "reasons"), always: tuple[str, ...] = ()) -> DataFrame:
    """old with new's rows: guarded columns stay where the status is protected, always ones are refreshed, status is kept.

    Rows only in new come in as open; rows only in old stay as they are.
    """
    o = old.select(*KEY, F.col("status"), *[F.col(c).alias(f"_o_{c}") for c in (*guarded, *always)], F.lit(True).alias("_old"))
    n = new.select(*KEY, *[F.col(c).alias(f"_n_{c}") for c in (*guarded, *always)], F.lit(True).alias("_new"))
    both = o.join(n, list(KEY), "full_outer")
    keep_old = F.col("_new").isNull() | is_protected(F.col("status"))
    cols = [F.when(keep_old, F.col(f"_o_{c}")).otherwise(F.col(f"_n_{c}")).alias(c) for c in guarded]
    cols += [F.when(F.col("_new").isNull(), F.col(f"_o_{c}")).otherwise(F.col(f"_n_{c}")).alias(c) for c in always]
    return both.select(*KEY, *cols, F.coalesce("status", F.lit("open")).alias("status"))


def drop_stale(store: DataFrame, scored: DataFrame, floor: float = FLOOR) -> DataFrame:
    """store without the unprotected rows that were scored below floor just now."""
    low = scored.filter(F.col("confidence") < floor).select(*KEY)
    return store.filter(is_protected(F.col("status"))).unionByName(store.filter(~is_protected(F.col("status"))).join(low, list(KEY), "left_anti"))


def orphans(store: DataFrame, pairs: DataFrame) -> DataFrame:
    """Unprotected rows that blocking no longer finds."""
    found = pairs.select(F.greatest("a", "b").alias("merged_from"), F.least("a", "b").alias("merged_into"))
    return store.filter(~is_protected(F.col("status"))).join(found, list(KEY), "left_anti")


@dataclass(frozen=True)
class Valve:
    """Deletions are refused if they exceed both a count and a share."""

    count: int
    share: float

    def open(self, hit: int, of: int) -> bool:
        return not (hit > self.count and hit > self.share * of)


def prune_orphans(store: DataFrame, pairs: DataFrame, valve: Valve = Valve(100, 0.5), force: bool = False) -> DataFrame:
    """store without its orphans, or unchanged if the valve refuses or blocking found nothing at all.

    The valve compares two counts, which are all that reaches the driver.
    """
    if not pairs.limit(1).count():
        return store
    lost = orphans(store, pairs)
    open_ = store.filter(F.col("status") == "open").count()
    if not force and not valve.open(lost.count(), open_):
        return store
    return store.join(lost.select(*KEY), list(KEY), "left_anti")


def null_safe_changes(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, new values) of rows in which any column differs, null being equal to null."""
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in cols])
    same = F.lit(True)
    for c in cols:
        same &= F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return new.select(key, *cols).join(o, key).filter(~same).select(key, *cols)


def settle(candidates: DataFrame, fates: DataFrame, valve: Valve = Valve(50, 0.01)) -> DataFrame:
    """candidates with what happened to their items elsewhere.

    fates is (id, redirect, deleted). In order of precedence: one redirects to the other, merged;
    any redirect, merged elsewhere; any deletion, dismissed, unless too many were deleted at once.
    """
    f, t = (fates.select(F.col("id").alias(f"_{s}"), F.col("redirect").alias(f"{s}_redirect"), F.col("deleted").alias(f"{s}_deleted")) for s in "ft")
    both = candidates.join(f, F.col("merged_from") == F.col("_f"), "left").join(t, F.col("merged_into") == F.col("_t"), "left")
    gone = F.coalesce("f_deleted", F.lit(False)) | F.coalesce("t_deleted", F.lit(False))
    open_ = F.col("status") == "open"
    row = both.agg(F.count_if(open_ & gone), F.count_if(open_)).first()
    trusted = valve.open(row[0], row[1])
    partner = (F.col("f_redirect") == F.col("merged_into")) | (F.col("t_redirect") == F.col("merged_from"))
    new = (
        F.when(~open_, F.col("status"))
        .when(F.coalesce(partner, F.lit(False)), "merged")
        .when(F.col("f_redirect").isNotNull() | F.col("t_redirect").isNotNull(), "merged elsewhere")
        .when(gone & F.lit(trusted), "dismissed")
        .otherwise(F.col("status"))
    )
    return both.select(*KEY, new.alias("status"))


def next_status(status: Column, action: Column, age_seconds: Column) -> Column:
    """The status after an action: claim, release, merge, dismiss, reopen. A claim lapses; what is not allowed changes nothing."""
    lapsed = (status == "merging") & (age_seconds > CLAIM_SECONDS)
    return (
        F.when((action == "claim") & ((status == "open") | lapsed), "merging")
        .when((action == "release") & (status == "merging"), "open")
        .when((action == "merge") & (status == "merging") & ~lapsed, "merged")
        .when((action == "dismiss") & ((status == "open") | lapsed), "dismissed")
        .when((action == "reopen") & status.isin("dismissed", "auto_dismissed"), "open")
        .otherwise(status)
    )


def after_merge(store: DataFrame, merged: DataFrame) -> DataFrame:
    """store after pairs (merged_from, merged_into) were merged: they are merged, other open pairs of a vanished item are dismissed."""
    done = merged.select(*KEY, F.lit(True).alias("_done"))
    gone = merged.select(F.col("merged_from").alias("_gone")).distinct()
    x = store.join(done, list(KEY), "left")
    x = x.join(gone.withColumnRenamed("_gone", "_g1"), F.col("merged_from") == F.col("_g1"), "left")
    x = x.join(gone.withColumnRenamed("_gone", "_g2"), F.col("merged_into") == F.col("_g2"), "left")
    touched = F.col("_g1").isNotNull() | F.col("_g2").isNotNull()
    new = F.when(F.col("_done"), "merged").when(touched & (F.col("status") == "open"), "dismissed").otherwise(F.col("status"))
    return x.withColumn("status", new).drop("_done", "_g1", "_g2")
