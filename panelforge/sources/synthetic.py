"""A made-up panel of any size for tests and demonstrations."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def normal(*key: Column) -> Column:
    """A standard normal number that depends on ``key`` alone, so partitions don't matter."""
    share = lambda salt: (F.pmod(F.xxhash64(F.lit(salt), *key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(share(1))) * F.cos(2 * math.pi * share(2))


def synthetic_panel(spark: SparkSession, sessions: int = 100, securities: int = 40, index: str | None = "399001", gap: tuple[int, int, int] | None = (30, 3, 4), start: str = "2020-01-02", seed: int = 42) -> DataFrame:
    """(timestamp, security, returns, amount) on business days from ``start``: normal returns of 1.2 % a day and lognormal amounts.

    ``index`` adds one more security of that name; ``gap`` (first session, sessions, number of the security) leaves returns null there.
    """
    first = datetime.date.fromisoformat(start)
    first += datetime.timedelta(max(0, 7 - first.weekday()) if first.weekday() > 4 else 0)  # business days begin on a Monday at the latest
    n = securities + (index is not None)
    cells = spark.range(sessions * n).select(F.floor(F.col("id") / n).cast("int").alias("_k"), (F.col("id") % n + 1).cast("int").alias("_s"))
    day = F.date_add(F.lit(first), (F.col("_k") + 2 * F.floor((F.col("_k") + first.weekday()) / 5)).cast("int"))
    name = F.when(F.col("_s") > securities, F.lit(index)).otherwise(F.lpad(F.col("_s").cast("string"), 6, "0"))
    key = (F.lit(seed), F.col("_k"), F.col("_s"))
    returns = 0.012 * normal(F.lit("returns"), *key)
    if gap:
        at, length, number = gap
        returns = F.when(~((F.col("_s") == number) & F.col("_k").between(at, at + length - 1)), returns)
    return cells.select(day.alias("timestamp"), name.alias("security"), returns.alias("returns"), F.exp(14 + 0.4 * normal(F.lit("amount"), *key)).alias("amount"))
