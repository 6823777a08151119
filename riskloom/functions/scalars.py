"""Column functions. Every one is a native expression; none needs Python workers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import constants as C


def number(col: Column) -> Column:
    """Lenient number parse: text that is no number, NaN and infinities become null.

    The cast alone would take Java's type suffixes, such as ``12d``.
    """
    plain = col.cast("string").rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$")
    return F.when(plain, finite(col.try_cast("double")))


def finite(col: Column) -> Column:
    # NaN is greater than every number in Spark, so one comparison rules out all three.
    return F.when(F.abs(col) < F.lit(float("inf")), col)


def event_time(col: Column, fmt: str = C.LOG_TIME_FORMAT) -> Column:
    """Lenient timestamp parse; a malformed text becomes null."""
    return F.try_to_timestamp(col, F.lit(fmt))


def occurrences(col: Column, text: str) -> Column:
    """How often ``text`` occurs in a column, by length, which is cheaper than a pattern."""
    return ((F.length(col) - F.length(F.replace(col, F.lit(text), F.lit("")))) / len(text)).cast("int")


def list_items(col: Column) -> Column:
    """Items in a ``;`` list; the empty text holds none."""
    return F.when(F.length(col) > 0, occurrences(col, ";") + 1).otherwise(0)


def internal_items(col: Column, domain: str, anchored: bool = False) -> Column:
    """Addresses of ``domain`` in a ``;`` list, never more than the list holds.

    By default the domain may occur anywhere in an address; ``anchored`` asks for
    addresses that end in it. Case does not matter.
    """
    if anchored:
        pattern = "(?i)@" + re.escape(domain) + r"(?=\s*(;|$))"
        hits = F.regexp_count(col, F.lit(pattern))
    else:
        hits = occurrences(F.lower(col), "@" + domain.lower())
    return F.coalesce(F.least(hits, list_items(col)), F.lit(0))


def after_hours(ts: Column, start: int = C.WORKDAY_START_HOUR, end: int = C.WORKDAY_END_HOUR) -> Column:
    hour = F.hour(ts)
    return F.coalesce((hour < start) | (hour >= end), F.lit(False)).cast("int")


def weekend(ts: Column) -> Column:
    return F.coalesce(F.weekday(ts) >= 5, F.lit(False)).cast("int")


def scaled_feature(name: str) -> Column:
    """A model feature: finite values only, ``log1p`` on the skewed columns."""
    col = F.col(name).cast("double")
    if name in C.LOG_SCALED:
        return F.when((col > -1.0) & (col < F.lit(float("inf"))), F.log1p(col))
    return finite(col)


def quota(n: Column, budget: Column) -> Column:
    """Review slots for ``n`` rows, at least one; the budget counts as a double."""
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(n * budget.cast("double")))


def ratio(num: Column, den: Column) -> Column:
    """A quotient that is null when the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine_distance(inner: Column, norm_a: Column, norm_b: Column) -> Column:
    """One minus the cosine; null where either norm is zero."""
    return F.lit(1.0) - F.try_divide(inner, norm_a * norm_b)


def hashed_index(n: Column, *parts: Column) -> Column:
    """A reproducible draw from ``0 .. n-1`` out of the md5 of the joined parts."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % n
