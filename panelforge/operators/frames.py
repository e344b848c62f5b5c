"""Putting panels together: batches, common and united columns, masks of another frequency, narrower domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def assemble(batches: list[DataFrame], keys: list[str]) -> DataFrame:
    """All batches of one schema as one table; a key that occurs twice is an error when rows are read. Batches of other columns or types are refused at once."""
    first = batches[0]
    for b in batches[1:]:
        if b.dtypes != first.dtypes:
            raise ValueError(f"batch_schema_mismatch:{b.dtypes}:{first.dtypes}")
    rows = reduce(DataFrame.unionAll, batches).withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
    shown = F.concat_ws(",", *(F.col(k).cast("string") for k in keys))
    unique = F.when(F.col("_n") == 1, F.col(keys[0])).otherwise(F.raise_error(F.concat(F.lit("duplicate_key:"), shown)))
    return rows.withColumn(keys[0], unique).drop("_n")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys with several rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def common_cells(times: DataFrame, panels: list[DataFrame], time: str = "timestamp", security: str = "security") -> DataFrame:
    """Every (time, security) of ``times`` and the securities that are in all panels. A time that a panel lacks is an error when rows are read."""
    names = reduce(lambda a, b: a.join(b.select(security).distinct(), security, "left_semi"), panels[1:], panels[0].select(security).distinct())
    asked = times.select(time).distinct()
    for k, panel in enumerate(panels):
        have = panel.select(time).distinct().withColumn("_in", F.lit(True))
        missing = F.raise_error(F.concat(F.lit(f"missing_timestamp:{k}:"), F.col(time).cast("string")))
        asked = asked.join(have, time, "left").withColumn(time, F.when(F.col("_in"), F.col(time)).otherwise(missing)).drop("_in")
    return asked.crossJoin(names)  # the grid asked for


def united(panels: dict[str, DataFrame], time: str = "timestamp", security: str = "security") -> DataFrame:
    """(time, security, <name>...): one value column for each panel, over every cell that any of them has."""
    frames = [df.select(time, security, F.col("value").alias(name)) for name, df in panels.items()]
    return reduce(lambda a, b: a.join(b, [time, security], "full"), frames)


def spread_daily(bars: DataFrame, mask: DataFrame, flag: str, time: str = "timestamp", security: str = "security", day: str = "day") -> DataFrame:
    """A daily boolean on intraday rows by their date; a day without an entry is false."""
    daily = mask.select(F.col(day).cast("date").alias("_day"), security, flag)
    return bars.withColumn("_day", F.to_date(time)).join(daily, ["_day", security], "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop("_day")


def narrow(df: DataFrame, universe: str, domain: Column) -> DataFrame:
    """``universe`` cut to ``domain`` (null: false), which may not reach beyond it: a cell outside is an error when rows are read."""
    inside, wanted = F.coalesce(F.col(universe), F.lit(False)), F.coalesce(domain, F.lit(False))
    return df.withColumn(universe, F.when(wanted & ~inside, F.raise_error(F.lit("domain_outside_universe")).cast("boolean")).otherwise(wanted))


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of two tables of the same columns with ``side``: ``both``, ``left`` or ``right``; nulls equal each other. Intersection, difference and union in one shuffle of rows that each task has already made distinct."""
    every = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(2)))
    seen = every.groupBy(*left.columns).agg(F.bit_or("_side").alias("_sides"))
    return seen.select(*left.columns, F.when(F.col("_sides") == 3, "both").when(F.col("_sides") == 1, "left").otherwise("right").alias("side"))
