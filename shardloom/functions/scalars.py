"""Scalar expressions that queries and pipelines share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_instant(n: Column) -> Column:
    """An epoch number in ns, us, ms or s, told by its size, as an instant floored to seconds."""
    return F.timestamp_seconds(epoch_seconds(n))


def epoch_seconds(n: Column) -> Column:
    """An epoch number in ns, us, ms or s, told by its size, in whole seconds."""
    unit = F.when(n > 10**18, F.lit(10**9)).when(n > 10**15, F.lit(10**6)).when(n > 10**12, F.lit(10**3)).otherwise(F.lit(1))
    return F.call_function("div", n - F.pmod(n, unit), unit)


def percent_change(now: Column, then: Column) -> Column:
    """Change in percent; NULL from nothing or from NULL."""
    return F.when(then != 0, (now - then) / then * 100)


def fixed_point(raw: Column, precision: Column | int) -> Column:
    """A fixed-point integer with the given number of decimals."""
    return raw / F.pow(F.lit(10.0), precision if isinstance(precision, Column) else F.lit(precision))


def tag(tags: Column, name: str) -> Column:
    """The first value of a tag, its name in any case of letters; tags is an array of (k, v)."""
    return F.get(F.filter(tags, lambda t: F.lower(t["k"]) == name.lower()), 0)["v"]


def last_price(close: Column, price: Column) -> Column:
    return F.coalesce(close, price)


def normal_topic(topic: Column) -> Column:
    """A topic without outer blanks, lower-cased; topics are otherwise exact."""
    return F.lower(F.trim(topic))
