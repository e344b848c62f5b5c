"""Steps after a formula: visibility, clipping, standardising, neutralising, smoothing, daily aggregation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from panelforge.functions import stats
from panelforge.sources.panels import AXIS_ROWS
from panelforge.sources.shared import saved

#: Fixed local-time windows, in minutes of the day, both ends included.
CLOCK = {"full_day": (570, 900), "open30": (570, 600), "midday30": (660, 690), "postlunch30": (780, 810), "close30": (870, 900), "close60": (840, 900)}


def available(effective: Column, known: Column, at: Column) -> Column:
    """A cell can be seen when it took effect and was known by then; missing stamps can't."""
    return F.coalesce((effective <= at) & (known <= at), F.lit(False))


def winsorize(df: DataFrame, col: str, lower: float, upper: float, time: str = "timestamp") -> DataFrame:
    """Clip to a date's interpolated quantiles."""
    w = W.partitionBy(time)
    lo, hi = F.percentile(col, F.lit(lower)).over(w), F.percentile(col, F.lit(upper)).over(w)
    return df.withColumn(col, F.when(F.col(col).isNotNull(), F.least(F.greatest(F.col(col), lo), hi)))


def zscore(df: DataFrame, col: str, time: str = "timestamp") -> DataFrame:
    w = W.partitionBy(time)
    varies = F.min(col).over(w) != F.max(col).over(w)
    return df.withColumn(col, F.when(varies, F.try_divide(F.col(col) - F.avg(col).over(w), F.stddev_pop(col).over(w))))


def neutralize(df: DataFrame, col: str, exposure: str, time: str = "timestamp") -> DataFrame:
    """Residual of ``col`` on one exposure and an intercept, by date; null where fewer than three rows have both."""
    w = W.partitionBy(time)
    both = F.col(col).isNotNull() & F.col(exposure).isNotNull()
    y, x = F.when(both, F.col(col)), F.when(both, F.col(exposure))
    slope = F.when(F.min(x).over(w) != F.max(x).over(w), F.try_divide(F.covar_pop(x, y).over(w), F.var_pop(x).over(w)))
    rest = y - F.avg(y).over(w) - F.coalesce(slope, F.lit(0.0)) * (x - F.avg(x).over(w))
    return df.withColumn(col, F.when(F.count(F.when(both, 1)).over(w) > 2, rest))


def residual(df: DataFrame, col: str, exposures: list[str], ridge: float, least: int, time: str = "timestamp") -> DataFrame:
    """What a least-squares fit on the exposures and an intercept leaves of ``col`` by date, over the rows where all are finite; null on dates with fewer than ``least`` of them.

    Covariances of each date merge over tasks; a date's small system is solved by a pseudo-inverse (the ridge spares the intercept). Gives ``df`` with ``_rest``: the
    dates' coefficients are broadcast behind a count and applied as a dot product.
    """
    every = [col, *exposures]
    whole = reduce(lambda a, b: a & b, [stats.finite(F.col(c).cast("double")).isNotNull() for c in every])
    x = {c: F.when(whole, F.col(c).cast("double")) for c in every}
    cov = [F.covar_pop(x[a], x[b]) for a in exposures for b in every]
    sums = df.groupBy(time).agg(F.count(F.when(whole, 1)).alias("_n"), F.array(*(F.avg(x[c]) for c in every)).alias("_mean"), F.array(*cov).alias("_cov")).where(F.col("_n") >= least)
    k = len(exposures)

    @F.pandas_udf("array<double>")
    def solve(n: pd.Series, cov: pd.Series) -> pd.Series:
        out = []
        for rows, flat in zip(n, cov, strict=True):
            c = rows * np.asarray(flat, float).reshape(k, k + 1)
            a = c[:, 1:] + ridge * np.eye(k)
            scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
            out.append(np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-10, hermitian=True) @ (c[:, 0] / scale) / scale)
        return pd.Series(out)

    fits = saved(sums.select(F.col(time).alias("_date"), "_mean", solve("_n", "_cov").alias("_fit")))
    fits = F.broadcast(fits) if fits.count() <= AXIS_ROWS else fits
    rest = F.col(col) - F.col("_mean")[0] - sum((F.col("_fit")[i] * (F.col(c) - F.col("_mean")[i + 1]) for i, c in enumerate(exposures)), F.lit(0.0))
    return df.join(fits, F.col(time) == F.col("_date"), "left").withColumn("_rest", F.when(whole, stats.finite(rest))).drop("_date", "_mean", "_fit")


def neutralize_many(df: DataFrame, col: str, exposures: list[str], ridge: float = 0.0, time: str = "timestamp") -> DataFrame:
    """Residuals on several exposures by date; null where a value isn't finite or fewer than two more rows than exposures are whole."""
    return residual(df, col, exposures, ridge, len(exposures) + 2, time).withColumn(col, F.col("_rest")).drop("_rest")


def ewm(df: DataFrame, col: str, span: int, time: str = "timestamp", security: str = "security") -> DataFrame:
    """Exponential mean with weight 2 / (span + 1); gaps decay the old weight; null before ``span`` values. Nulls and NaN are gaps.

    Rows are sorted in ranges of security and time, so that a long security is spread over tasks. A chunk of one security's rows is first taken by itself, with what it would
    keep of an earlier mean; then the chunks' ends, a row for each, are folded in order, and each row adds what it keeps of the mean before its chunk.
    """
    alpha = 2.0 / (span + 1)
    kept = [F.col(c) for c in df.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            names, x = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(float)
            cuts = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.empty(0, int)
            made = []
            for s, e in zip(cuts, np.append(cuts[1:], len(names)), strict=True):
                part, number = x[s:e], number + 1
                at = np.flatnonzero(~np.isnan(part))
                old = (1 - alpha) ** np.diff(at)
                decay = np.full(e - s, np.nan)
                decay[at] = np.cumprod(np.append(np.ones(min(1, len(at))), old / (old + alpha)))
                place = np.arange(1, e - s + 1)
                made.append((np.full(e - s, number), place, pd.Series(part).ewm(alpha=alpha, adjust=False).mean().to_numpy(), pd.Series(decay).ffill().to_numpy(), np.cumsum(~np.isnan(part))))
            if made:
                columns = [pa.array(np.concatenate(c), from_pandas=True) for c in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "_chunk", "_place", "_fresh", "_decay", "_seen"])

    schema = StructType([*df.schema.fields, StructField("_name", LongType()), StructField("_x", DoubleType()), StructField("_chunk", LongType()), StructField("_place", LongType()), StructField("_fresh", DoubleType()), StructField("_decay", DoubleType()), StructField("_seen", LongType())])
    # a hash tells neighbours apart within a batch, as rows come in order of the security itself
    ranged = df.select(*kept, F.xxhash64(security).alias("_name"), F.col(col).cast("double").alias("_x")).repartitionByRange(F.col(security), F.col(time)).sortWithinPartitions(security, time)
    rows = saved(ranged.mapInArrow(run, schema))
    value = F.when(F.col("_x").isNotNull() & ~F.isnan("_x"), F.col("_place"))
    ends = rows.groupBy("_chunk").agg(
        F.first(security).alias("_security"), F.min(time).alias("_from"), F.max("_place").alias("n"), F.min(value).alias("first"), F.max(value).alias("last"), F.max("_seen").alias("seen"),
        F.min_by("_x", value).alias("x"), F.max_by("_fresh", "_place").alias("fresh"), F.max_by("_decay", "_place").alias("decay"),
    )
    before = W.partitionBy("_security").orderBy("_from", "_chunk").rowsBetween(W.unboundedPreceding, -1)
    start = F.struct(F.lit(None).cast("double").alias("m"), F.lit(0).cast("long").alias("gap"), F.lit(0).cast("long").alias("seen"))

    def met(m: Column, gap: Column, first: Column, x: Column) -> Column:
        """The mean at a chunk's first value, after ``gap`` rows without one."""
        old = F.pow(F.lit(1 - alpha), (gap + first).cast("double"))
        return F.when(m.isNull(), x).otherwise((old * m + alpha * x) / (old + alpha))

    def fold(state: Column, c: Column) -> Column:
        end = c["fresh"] + c["decay"] * (met(state["m"], state["gap"], c["first"], c["x"]) - c["x"])
        none = c["first"].isNull()
        return F.struct(F.when(none, state["m"]).otherwise(end).alias("m"), F.when(none, state["gap"] + c["n"]).otherwise(c["n"] - c["last"]).alias("gap"), (state["seen"] + c["seen"]).alias("seen"))

    listed = F.collect_list(F.struct("n", "first", "last", "seen", "x", "fresh", "decay")).over(before)
    carried = saved(ends.withColumn("_c", F.aggregate(listed, start, fold)).select("_chunk", met(F.col("_c.m"), F.col("_c.gap"), F.col("first"), F.col("x")).alias("_met"), F.col("x").alias("_first_x"), F.col("_c.m").alias("_m"), F.col("_c.seen").alias("_before")))
    carried = F.broadcast(carried) if carried.count() <= AXIS_ROWS else carried
    mean = F.when(F.col("_seen") > 0, F.col("_fresh") + F.col("_decay") * (F.col("_met") - F.col("_first_x"))).otherwise(F.col("_m"))
    return rows.join(carried, "_chunk").select(*df.columns, F.when(F.col("_before") + F.col("_seen") >= span, stats.finite(mean)).alias("ewm"))


def daily(df: DataFrame, col: str, window: str, reducer: str, time: str = "timestamp", security: str = "security") -> DataFrame:
    """One value a day and security over a clock window; the stamp is the last one of that day's window, whichever security has it."""
    lo, hi = CLOCK[window]
    rows = df.where(stats.session_minutes(F.col(time)).between(lo, hi)).withColumn("_day", F.to_date(time))
    x = F.col(col)
    made = {"last": F.max_by(x, F.col(time)), "mean": F.avg(x), "sum": F.sum(x), "std": F.stddev_pop(x), "skew": stats.sample_skew(x), "kurt": stats.sample_kurt(x, constant_value=0.0)}[reducer]
    stamps = rows.groupBy("_day").agg(F.max(time).alias(time))
    return rows.groupBy("_day", security).agg(made.alias(col)).join(F.broadcast(stamps), "_day").drop("_day")
