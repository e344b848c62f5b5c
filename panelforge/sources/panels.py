"""Panels over the driver's tables, in long form with a dense grid of sessions and securities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.stats import finite
from panelforge.sources.shared import saved


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Sessions are far fewer than cells; the axis is broadcast behind this check, else Spark chooses.
AXIS_ROWS = 100_000


def densify(cells: DataFrame, time: str = "timestamp", security: str = "security") -> DataFrame:
    """Every session for every security, with nulls where there is no cell. The session axis repeats for each security, which is the panel's size by definition. ``cells`` are written first, as both axes and the grid read them."""
    cells = saved(cells)
    times, names = cells.select(time).distinct(), cells.select(security).distinct()
    axis = times.agg(F.sort_array(F.collect_set(time)).alias("_axis")) if times.count() <= AXIS_ROWS else None
    grid = names.join(F.broadcast(axis)).select(security, F.explode("_axis").alias(time)) if axis is not None else names.join(times)
    return grid.join(cells, [time, security], "left")


def supplier_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(timestamp, security, close, amount, volume, returns): supplier-months of lineitem on a dense grid."""
    items = table(spark, sf_dir, "lineitem")
    cells = items.groupBy(F.trunc("l_shipdate", "MM").alias("timestamp"), F.col("l_suppkey").alias("security")).agg(
        F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("close"), F.sum("l_extendedprice").alias("amount"), F.sum("l_quantity").alias("volume")
    )
    by = W.partitionBy("security").orderBy("timestamp")
    return densify(cells).withColumn("returns", finite(F.try_divide(F.col("close"), F.lag("close").over(by)) - 1))


#: The same panel for DuckDB, to be followed by a query over ``g``.
PANEL_SQL = """
WITH cells AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, l_suppkey AS security, sum(l_extendedprice) / sum(l_quantity) AS close,
    sum(l_extendedprice) AS amount, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2),
grid AS (SELECT ts, security FROM (SELECT DISTINCT ts FROM cells) CROSS JOIN (SELECT DISTINCT security FROM cells)),
g0 AS (SELECT ts, security, close, amount, volume FROM grid LEFT JOIN cells USING (ts, security)),
g AS (SELECT *, close / lag(close) OVER (PARTITION BY security ORDER BY ts) - 1 AS returns FROM g0)
"""
