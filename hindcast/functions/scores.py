"""Column functions: standardised windows, quantiles and tail means of arrays, and forecast scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    return _c(x).isNotNull() & ~F.isnan(_c(x)) & (F.abs(_c(x)) < float("inf"))


def array_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` reads it for each element of an array."""
    return F.transform(F.array(value), use)[0]


def standardised(a: Column, tiny: float = 1e-8) -> Column:
    """An array less its mean, by its population deviation where that is more than ``tiny``."""

    def scale(m: Column) -> Column:
        s = F.sqrt(array_mean(F.transform(a, lambda x: (x - m) * (x - m))))
        return bound(F.when(s > tiny, s).otherwise(1.0), lambda d: F.transform(a, lambda x: (x - m) / d))

    return bound(array_mean(a), scale)


def _between(s: Column, p: float) -> Column:
    h = (F.size(s) - 1) * F.lit(p)
    low, high = F.floor(h).cast("int"), F.ceil(h).cast("int")
    at = lambda i: F.element_at(s, i + 1)
    return F.when(F.size(s) > 0, at(low) + (h - low) * (at(high) - at(low)))


def array_quantile(a: Column, p: float) -> Column:
    """Linear between the order statistics of an array's finite values; null where there are none."""
    return bound(F.array_sort(F.filter(a, finite)), lambda s: _between(s, p))


def tail_mean(a: Column, p: float) -> Column:
    """Mean of the finite values at or above the quantile."""
    kept = lambda s: bound(_between(s, p), lambda q: bound(F.filter(s, lambda x: x >= q), lambda k: F.when(F.size(k) > 0, array_mean(k))))
    return bound(F.array_sort(F.filter(a, finite)), kept)


def pinball(y: Column | str, q: Column | str, level: float = 0.99) -> Column:
    y, q = _c(y), _c(q)
    return F.when(y >= q, level * (y - q)).otherwise((1 - level) * (q - y))


def fz0(y: Column | str, q: Column | str, e: Column | str, level: float = 0.975) -> Column:
    """Joint score of a quantile and a tail mean; null where one isn't finite or the tail mean isn't positive."""
    y, q, e = _c(y), _c(q), _c(e)
    tail = F.when(y > q, (y - q) / ((1 - level) * e)).otherwise(0.0)
    return F.when(finite(y) & finite(q) & finite(e) & (e > 0), tail + q / e + F.log(e) - 1)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)).cast("double"), F.lit(0.0))


def joined(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ";")


def split_ints(s: Column) -> Column:
    return F.when(s == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(s, ";"), lambda x: x.cast("bigint")))
