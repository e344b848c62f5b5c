"""Statistics as Column builders: null instead of errors or NaN wherever a value is undefined."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def over(x: Column, w: WindowSpec | None) -> Column:
    return x if w is None else x.over(w)


def safe_corr(x: Column, y: Column, w: WindowSpec | None = None, least: int = 2) -> Column:
    """Pearson correlation over rows with both values; null for fewer than ``least`` rows or a constant side."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    n = over(F.count(F.when(x.isNotNull() & y.isNotNull(), 1)), w)
    varies = (over(F.min(a), w) != over(F.max(a), w)) & (over(F.min(b), w) != over(F.max(b), w))
    return F.when((n >= least) & varies, F.try_divide(over(F.covar_pop(a, b), w), over(F.stddev_pop(a), w) * over(F.stddev_pop(b), w)))


def sample_skew(x: Column, w: WindowSpec | None = None) -> Column:
    """Bias-corrected skewness; 0 for constants, null below three values."""
    n = over(F.count(x), w).cast("double")
    constant = over(F.min(x), w) == over(F.max(x), w)
    return F.when(n >= 3, F.when(constant, 0.0).otherwise(over(F.skewness(x), w) * F.sqrt(n * (n - 1)) / (n - 2)))


def sample_kurt(x: Column, w: WindowSpec | None = None, constant_value: float = -3.0) -> Column:
    """Bias-corrected excess kurtosis; ``constant_value`` for constants, null below four values."""
    n = over(F.count(x), w).cast("double")
    constant = over(F.min(x), w) == over(F.max(x), w)
    return F.when(n >= 4, F.when(constant, constant_value).otherwise(((n + 1) * over(F.kurtosis(x), w) + 6) * (n - 1) / ((n - 2) * (n - 3))))


def rank_and_ties(x: Column, *by: str | Column) -> tuple[Column, Column]:
    """Average-tie rank of ``x`` (1 is the smallest) among the rows of its group, all of which have a value, and how many others equal it. Both come from one order."""
    ties = F.count("*").over(W.partitionBy(*by, x)) - 1
    return F.rank().over(W.partitionBy(*by).orderBy(x)) + ties / 2, ties


def average_rank(x: Column, *by: str, among: Column | None = None) -> Column:
    """Average-tie rank of ``x`` (1 is the smallest) in its group, among rows with a value and, if given, ``among``."""
    in_it = x.isNotNull() if among is None else x.isNotNull() & F.coalesce(among, F.lit(False))
    return F.when(in_it, rank_and_ties(x, *by, in_it)[0])


def percent_rank(x: Column, *by: str, among: Column | None = None) -> Column:
    in_it = x.isNotNull() if among is None else x.isNotNull() & F.coalesce(among, F.lit(False))
    return average_rank(x, *by, among=among) / F.count("*").over(W.partitionBy(*by, in_it))


def benjamini_hochberg(p: Column, name: Column, *by: str) -> Column:
    """q-values: the least of p * m / rank over this and all larger p, at most 1."""
    order = W.partitionBy(*by).orderBy(p, name)
    m = F.count("*").over(W.partitionBy(*by))
    return F.least(F.lit(1.0), p * m / F.row_number().over(order))


def session_minutes(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)
