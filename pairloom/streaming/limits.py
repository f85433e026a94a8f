"""Keyed state over events: sliding-window limits and re-delivery."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def hits_in_window(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """events with the hits of their key in the seconds up to them, themselves included."""
    w = Window.partitionBy(key).orderBy(_micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("hits", F.count(F.lit(1)).over(w))


def rate_limit(events: DataFrame, key: str, ts: str, id_: str, most: int, seconds: int) -> DataFrame:
    """(id, key, allowed): at most so many allowed hits of a key in any window; refused hits are not counted.

    Whether a hit counts depends on the ones before, so a key's events are read in order, a batch
    at a time; only the hits inside the window are held.
    """
    rows = events.select(F.col(id_).alias("id"), F.col(key).cast("string").alias("k"), _micros(ts).alias("us"))
    rows = rows.repartition("k").sortWithinPartitions("k", "us", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, deque()
        for b in batches:
            out = []
            for k, us in zip(b["k"], b["us"], strict=True):
                if k != now:
                    now, held = k, deque()
                while held and held[0] <= us - seconds * 1_000_000:
                    held.popleft()
                out.append(len(held) < most)
                if out[-1]:
                    held.append(us)
            yield b[["id", "k"]].assign(allowed=out)

    return rows.mapInPandas(run, "id long, k string, allowed boolean")


def first_delivery(stream: DataFrame, id_: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Each id once, of a stream that may deliver it again within the delay."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_])


def windowed_counts(stream: DataFrame, ts: str, by: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n"))
