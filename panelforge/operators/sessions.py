"""Steps over a portfolio's sessions, each spread over its securities, for runs that are too large for one group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.sources.panels import AXIS_ROWS
from panelforge.sources.shared import saved, shared_path

#: A portfolio of at most this many cells (sessions times securities) runs as one group; it holds some six dense tables of doubles, 100 MB here.
GROUP_CELLS = 2_000_000


def number(c: str) -> Column:
    """The column as a double, with null for NaN, as the dense tables of a group see it."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def largest_grid(df: DataFrame, group: str, time: str, security: str) -> int:
    """Sessions times securities of the group that has most of them; 0 for an empty table."""
    sessions = df.select(group, time).distinct().groupBy(group).agg(F.count("*").alias("_t"))
    names = df.select(group, security).distinct().groupBy(group).agg(F.count("*").alias("_s"))
    return sessions.join(names, group).agg(F.max(F.col("_t") * F.col("_s"))).first()[0] or 0


def in_sessions(df: DataFrame, group: str, time: str, security: str, values: list[str], start: dict[str, Column], step: Callable[[DataFrame, Callable[[DataFrame], DataFrame], int, str], DataFrame]) -> list[str]:
    """Folders of what ``step`` wrote for the first, second, ... session of all groups.

    ``step`` gets the state (one row for each group and security; at first the columns of ``start``) joined with the session's rows (``time`` is null where
    there is none), ``hint`` for tables of one row a group, the session's number and the folder for its output; it returns the next state, written. Groups whose sessions are over drop out.
    The driver walks the calendar, which is short; a session's rows are split over tasks by security. A cell that occurs twice is an error.
    """
    spark, keys = df.sparkSession, [group, security]
    axis = df.select(group, time).distinct().withColumn("_k", F.row_number().over(W.partitionBy(group).orderBy(time)))
    axis = saved(axis)
    shown = F.concat_ws(",", *(F.col(k).cast("string") for k in (group, time, security)))
    once = F.when(F.count("*") == 1, F.first(group)).otherwise(F.raise_error(F.concat(F.lit("duplicate_key:"), F.first(shown))))
    rows = df.groupBy(group, time, security).agg(*(F.first(number(v)).alias(v) for v in values), once.alias("_once")).where(F.col("_once").isNotNull()).drop("_once").join(axis, [group, time])
    path = shared_path(spark)
    rows.repartitionByRange("_k", security).write.partitionBy("_k").parquet(path)
    rows = spark.read.parquet(path)
    last = axis.agg(F.max("_k")).first()[0] or 0
    few = axis.where("_k = 1").count() <= AXIS_ROWS
    hint = F.broadcast if few else (lambda sums: sums)
    state, out = saved(df.select(*keys).distinct().select(*keys, *(c.alias(n) for n, c in start.items()))), []
    for k in range(1, last + 1):
        out.append(shared_path(spark))
        session = rows.where(F.col("_k") == k).drop("_k").hint("merge")  # small in its file: else it would go to the driver and out to all, in each session
        state = step(state.join(session, keys, "left"), hint, k, out[-1])
    return out
