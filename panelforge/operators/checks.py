"""Checks of incoming data: schema, order, calendar and session, availability, coverage, embargo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.stats import session_minutes


def schema_issues(df: DataFrame, fields: dict[str, tuple[str, bool]]) -> DataFrame:
    """(code, field, n): fields (name: type, nullable) that are missing, of another type, or not nullable with n nulls; one pass over the data."""
    types, spark = dict(df.dtypes), df.sparkSession
    fixed = [("missing_schema_field", name, 0) for name in fields if name not in types]
    fixed += [("field_dtype_mismatch", name, 0) for name, (kind, _) in fields.items() if types.get(name, kind) != kind]
    filled = [name for name, (_, nullable) in fields.items() if not nullable and name in types]
    out = spark.createDataFrame(fixed, "code string, field string, n long")
    if not filled:
        return out
    nulls = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in filled)).unpivot([], filled, "field", "n").where("n > 0")
    return out.unionByName(nulls.select(F.lit("nonnullable_field_has_missing").alias("code"), "field", "n"))


def out_of_order(df: DataFrame, by: list[str], sequence: str, key: str) -> DataFrame:
    """Rows whose ``key`` is before that of the row before them in ``sequence``, within each group ``by``. A table has no order of its own, so a column has to tell it."""
    return df.withColumn("_last", F.lag(key).over(W.partitionBy(*by).orderBy(sequence))).where(F.col(key) < F.col("_last")).drop("_last")


def outside_calendar(df: DataFrame, calendar: DataFrame, sessions: list[tuple[int, int]], time: str = "ts", day: str = "day") -> DataFrame:
    """Rows on a date that ``calendar`` lacks or at a minute of no session (both ends included); a missing time is outside."""
    minute: Column = F.lit(False)
    for low, high in sessions:
        minute = minute | session_minutes(F.col(time)).between(low, high)
    open_ = calendar.select(F.col(day).cast("date").alias("_day")).distinct().withColumn("_open", F.lit(True))
    marked = df.withColumn("_day", F.to_date(time)).join(open_, "_day", "left")
    return marked.where(~F.coalesce(F.col("_open") & minute, F.lit(False))).drop("_day", "_open")


def seen_too_early(df: DataFrame, used: Column, available: Column) -> DataFrame:
    """Rows used before they were available; a missing stamp counts as not available."""
    return df.where(~F.coalesce(available <= used, F.lit(False)))


def coverage(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """(kind, key): what is expected and missing, and what is given and unknown; no rows where both sets are equal."""
    want, have = expected.select(key).distinct(), given.select(key).distinct()
    missing = want.join(have, key, "left_anti").select(F.lit("missing").alias("kind"), key)
    return missing.unionByName(have.join(want, key, "left_anti").select(F.lit("unknown").alias("kind"), key))


def embargo(folds: DataFrame, calendar: DataFrame, sessions: int, time: str = "timestamp") -> DataFrame:
    """``folds`` (train_end, validation_start, ...) with ``gap``, the calendar's sessions between both, and ``ok``; a bound outside the calendar has neither gap nor leave.

    The calendar is one axis of sessions, far smaller than any panel, so one task numbers it.
    """
    axis = calendar.select(F.col(time).alias("_at")).distinct().withColumn("_k", F.row_number().over(W.orderBy("_at")))
    ends, starts = axis.toDF("train_end", "_a"), axis.toDF("validation_start", "_b")
    out = folds.join(ends, "train_end", "left").join(starts, "validation_start", "left").withColumn("gap", F.col("_b") - F.col("_a") - 1)
    return out.withColumn("ok", F.coalesce(F.col("gap") >= sessions, F.lit(False))).drop("_a", "_b")
