"""Distances on globes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radii in metres. Fixed values.
RADIUS = {"earth": 6371000.0, "moon": 1737400.0, "mars": 3389500.0}


def radius(globe: Column) -> Column:
    """Metres; null for a globe that is not known."""
    return reduce(lambda out, kv: out.when(globe == kv[0], kv[1]), list(RADIUS.items())[1:], F.when(globe == "earth", RADIUS["earth"]))


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, r: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * r * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def nearest(a: Column, b: Column) -> Column:
    """The least distance over two arrays of (lat, lon, globe); null if no two are on one known globe."""
    def one(p: Column, q: Column) -> Column:
        return F.when(p["globe"] == q["globe"], distance(p["lat"], p["lon"], q["lat"], q["lon"], radius(p["globe"])))
    return F.array_min(F.flatten(F.transform(a, lambda p: F.transform(b, lambda q: one(p, q)))))


def coordinate_text(lat: Column, lon: Column, globe: Column) -> Column:
    """lat,lon and the globe, which is left out for the Earth; null without a latitude or longitude."""
    other = F.when(F.coalesce(globe, F.lit("earth")) != "earth", globe)
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat_ws(",", lat.cast("string"), lon.cast("string"), other))


def known_precision(precision: Column) -> Column:
    return F.when(precision > 0, precision)
