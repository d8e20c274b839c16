"""Scalar functions of the ranker: geography, opening hours, and the nine signals, each between 0 and 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# The weights of the signals, and those that tuning chose.
WEIGHTS = {"semantic": 0.30, "attributes": 0.25, "category": 0.20, "distance": 0.10, "rating": 0.10, "popularity": 0.05, "open_now": 0.10, "review": 0.10, "price": 0.20}
TUNED = {"semantic": 0.40, "attributes": 0.05, "category": 0.05, "distance": 0.30, "rating": 0.05, "popularity": 0.20, "open_now": 0.05, "review": 0.05, "price": 0.20}
#: The clock of evaluations, in minutes of the day.
NOW = 14 * 60


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def minutes(hhmm: Column) -> Column:
    """Of the day; null for what is no time."""
    part = lambda i: F.get(F.split(hhmm, ":"), F.lit(i)).try_cast("int")
    return part(0) * 60 + part(1)


def times(hours: Column) -> Column:
    """Hours read once: struct(always, start, end), minutes of the day; all null for hours that can't be read."""
    fits = hours.rlike("^\\d{1,2}:\\d{2}-\\d{1,2}:\\d{2}$")
    start, end = (F.when(fits, minutes(F.get(F.split(hours, "-"), F.lit(i)))) for i in (0, 1))
    return F.struct(F.when(F.trim(hours) == "24/7", F.lit(True)).alias("always"), start.alias("start"), end.alias("end"))


def open_at(times: Column, at: Column) -> Column:
    """null for hours that can't be read; both bounds are open; hours may go past midnight."""
    start, end = times["start"], times["end"]
    inside = F.when(end < start, (at >= start) | (at <= end)).otherwise(at.between(start, end))
    return F.when(times["always"], F.lit(True)).when(start.isNotNull(), inside)


def is_open(hours: Column, at: Column) -> Column:
    return open_at(times(hours), at)


def attributes(required: Column, soft: Column, own: Column) -> Column:
    """All three are arrays of folded names."""
    n = lambda a: F.size(F.array_distinct(a))
    total = n(required) + 0.5 * n(soft)
    return F.when(total > 0, (F.size(F.array_intersect(required, own)) + 0.5 * F.size(F.array_intersect(soft, own))) / total).otherwise(0.5)


def category(wanted: Column, own: Column) -> Column:
    return F.when(wanted.isNull(), 0.5).otherwise((wanted == own).cast("double"))


def distance(km: Column) -> Column:
    """km is null without an anchor."""
    return F.when(km.isNull(), 0.5).otherwise(clamp(F.pow(F.lit(2.718281828), -km / 3.0)))


def rating(own: Column, reviews: Column, mean: Column) -> Column:
    bayes = (own * reviews + mean * 30.0) / (reviews + 30.0)
    return clamp((bayes - 3.5) / 1.5)


def popularity(own: Column) -> Column:
    return clamp(own / 100.0)


def open_now(hours: Column, at: Column) -> Column:
    return open_score(times(hours), at)


def open_score(times: Column, at: Column) -> Column:
    return F.when(open_at(times, at), 1.0).when(~open_at(times, at), 0.3).otherwise(0.5)


def review(query: Column, own: Column) -> Column:
    """Arrays of distinct words."""
    return F.when((F.size(query) == 0) | (F.size(own) == 0), 0.5).otherwise(F.size(F.array_intersect(query, own)) / F.size(query))


def price(direction: Column, level: Column) -> Column:
    up = (level - 1) / 3.0
    return F.when(direction.isNull() | level.isNull(), 0.5).when(direction == "cheap", 1.0 - up).otherwise(up)


def total(signals: dict[str, Column], weights: dict[str, float], anchored: Column) -> Column:
    """The weighted mean; distance has no weight without an anchor."""
    w = {k: F.when(anchored, F.lit(float(weights[k]))).otherwise(0.0) if k == "distance" else F.lit(float(weights[k])) for k in WEIGHTS}
    top, bottom = sum((w[k] * signals[k] for k in WEIGHTS), F.lit(0.0)), sum(w.values(), F.lit(0.0))
    return top / F.when(bottom == 0, 1.0).otherwise(bottom)
