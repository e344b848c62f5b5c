"""Per-date and summary evaluation of a signal against labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from panelforge.functions import stats
from panelforge.operators.postprocess import residual


def bucket(x: Column, n_buckets: int, valid: Column, time: str = "timestamp", security: str = "security") -> Column:
    """Formal bucket: ties go by security."""
    w = W.partitionBy(time, valid)
    rank, n = F.row_number().over(w.orderBy(x, security)), F.count("*").over(w)
    return F.when(valid, F.least(F.greatest(F.ceil(rank / n * n_buckets), F.lit(1)), F.lit(n_buckets)).cast("int"))


def per_date(df: DataFrame, signal: str, label: str, least: int = 2, time: str = "timestamp") -> DataFrame:
    """(timestamp, n, coverage, ic, rank_ic, dispersion, tie_rate): ranks are taken anew on rows with both values."""
    valid = F.col(signal).isNotNull() & F.col(label).isNotNull()
    rows = df.select(time, signal, label, valid.alias("_ok"))
    (rs, ties), (rl, _) = (stats.rank_and_ties(F.col(c), time, "_ok") for c in (signal, label))  # one shuffle, and one order for each value
    ranked = rows.select("*", F.when(F.col("_ok"), rs).alias("_rs"), F.when(F.col("_ok"), ties).alias("_ties"), F.when(F.col("_ok"), rl).alias("_rl"))
    s, y = F.when(F.col("_ok"), F.col(signal)), F.when(F.col("_ok"), F.col(label))
    n = F.count(F.when(F.col("_ok"), 1))
    return ranked.groupBy(time).agg(
        n.alias("n"), F.try_divide(n.cast("double"), F.count(signal)).alias("coverage"), stats.safe_corr(s, y, least=least).alias("ic"), stats.safe_corr(F.col("_rs"), F.col("_rl"), least=least).alias("rank_ic"),
        F.stddev_pop(s).alias("dispersion"), F.try_divide(F.sum("_ties").cast("double"), n * (n - 1)).alias("tie_rate"),
    )


def bucket_returns(df: DataFrame, signal: str, label: str, n_buckets: int, time: str = "timestamp") -> DataFrame:
    valid = F.col(signal).isNotNull() & F.col(label).isNotNull()
    rows = df.withColumn("bucket", bucket(F.col(signal), n_buckets, valid)).where("bucket is not null")
    return rows.groupBy(time, "bucket").agg(F.avg(label).alias("mean_label"), F.count("*").alias("n"))


def summary(dates: DataFrame) -> DataFrame:
    """(metric, value): mean, deviation, ratio and positive share of rank ICs, mean coverage."""
    r = F.col("rank_ic")
    row = dates.agg(F.avg(r).alias("mean_rank_ic"), F.stddev_samp(r).alias("std_rank_ic"), F.try_divide(F.avg(r), F.stddev_samp(r)).alias("rank_ic_ir"), F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))).alias("positive_ratio"), F.avg("coverage").alias("mean_coverage"), F.count(r).cast("double").alias("sample_count"))
    return row.unpivot([], row.columns, "metric", "value")


def rank_turnover(df: DataFrame, signal: str, time: str = "timestamp", security: str = "security") -> DataFrame:
    """(timestamp, turnover): mean absolute change of percent ranks over securities ranked on this and the date before."""
    by = W.partitionBy(security).orderBy(time)
    ranked = df.select(time, security, stats.percent_rank(F.col(signal), time).alias("_r")).withColumn("_d", F.abs(F.col("_r") - F.lag("_r").over(by)))
    return ranked.groupBy(time).agg(F.when(F.count("_d") >= 2, F.avg("_d")).alias("turnover"))


def pair_correlations(df: DataFrame, factors: list[str], time: str = "timestamp") -> DataFrame:
    """(timestamp, left, right, corr) of every pair of the given factor columns, in one pass over their common rows."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    made = df.groupBy(time).agg(*(stats.safe_corr(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs))
    long = made.unpivot([time], [f"{a}|{b}" for a, b in pairs], "pair", "corr")
    return long.select(time, F.substring_index("pair", "|", 1).alias("left"), F.substring_index("pair", "|", -1).alias("right"), "corr")


def pair_diagnostics(df: DataFrame, factors: list[str], domains: list[str] | None = None, least: int = 2, time: str = "timestamp") -> DataFrame:
    """(timestamp, left, right, common_domain, common, coverage, pearson, spearman) of every pair of factor columns.

    ``domains``: a boolean column for each factor (null counts as false; without them all rows are inside). A pair's figures are over its common rows: inside both domains, both values finite; ranks are taken among them.
    Correlations are null for fewer than ``least`` rows or a constant side. A date's cross-section is one group, whose counts and Pearson sums are a few matrix products for all pairs, and each factor is sorted once.
    """
    names = [f"_x{k}" for k in range(len(factors))]
    flags = [f"_d{k}" for k in range(len(factors))]
    inside = [F.coalesce(F.col(c), F.lit(False)) for c in domains] if domains else [F.lit(True)] * len(factors)
    rows = df.select(F.col(time), *(F.col(c).cast("double").alias(n) for c, n in zip(factors, names, strict=True)), *(c.alias(n) for c, n in zip(inside, flags, strict=True)))
    schema = StructType([df.schema[time], *(StructField(n, StringType()) for n in ("left", "right")), *(StructField(n, LongType()) for n in ("common_domain", "common")), *(StructField(n, DoubleType()) for n in ("coverage", "pearson", "spearman"))])

    def run(group: pa.Table) -> pa.Table:
        x = np.column_stack([group.column(n).to_numpy().astype(float) for n in names])
        domain = np.column_stack([group.column(n).to_numpy().astype(bool) for n in flags])
        held = domain & np.isfinite(x)
        left, right = np.triu_indices(len(names), 1)
        both, counts = (m.T.astype(float) @ m for m in (domain, held))
        n = counts[left, right]
        enough = n >= least
        x = np.where(held, x, 0.0)
        size = np.maximum(np.abs(x).max(axis=0), 1e-300)
        x = x / size
        x = np.where(held, x - x.sum(axis=0) / np.maximum(held.sum(axis=0), 1), 0.0)
        products, sums, squares = x.T @ x, x.T @ held, (x * x).T @ held
        with np.errstate(divide="ignore", invalid="ignore"):
            cov = products[left, right] - sums[left, right] * sums[right, left] / n
            spread = [squares[a, b] - sums[a, b] ** 2 / n for a, b in ((left, right), (right, left))]
            pearson = np.where(enough & (spread[0] > 1e-14 * n) & (spread[1] > 1e-14 * n), cov / np.sqrt(spread[0] * spread[1]), np.nan)
        ranks = [_Ranks(x[:, k], held[:, k]) for k in range(len(names))]
        spearman = np.array([_corr(ranks[a].among(held[:, b]), ranks[b].among(held[:, a])) if ok else np.nan for a, b, ok in zip(left, right, enough, strict=True)])
        domains_n = both[left, right]
        columns = [pa.array([factors[k] for k in side]) for side in (left, right)] + [pa.array(v.astype(np.int64)) for v in (domains_n, n)]
        columns += [pa.array(v, from_pandas=True) for v in (np.divide(n, domains_n, out=np.full(len(n), np.nan), where=domains_n > 0), pearson, spearman)]
        return pa.Table.from_arrays([group.column(time).take(pa.array(np.zeros(len(left), np.int64))), *columns], [time, *schema.names[1:]])

    return rows.groupBy(time).applyInArrow(run, schema)


class _Ranks:
    """A factor's values in order, from which ranks with ties among any of its rows follow by running counts."""

    def __init__(self, x: np.ndarray, held: np.ndarray):
        rows = np.flatnonzero(held)
        self.rows = rows[np.argsort(x[rows], kind="stable")]
        values = x[self.rows]
        self.first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
        self.size, self.total = np.diff(np.append(self.first, len(values))), len(x)

    def among(self, other: np.ndarray) -> np.ndarray:
        """Average-tie ranks of the rows that ``other`` holds too, in the rows' own order."""
        shared = other[self.rows]
        if not shared.any():
            return np.empty(0)
        n = np.add.reduceat(shared.astype(np.int64), self.first)
        rank = np.full(self.total, np.nan)
        rank[self.rows[shared]] = np.repeat(np.cumsum(n) - n + (n + 1) / 2, self.size)[shared]
        return rank[~np.isnan(rank)]


def _corr(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    scale = np.sqrt((a @ a) * (b @ b))
    return float(a @ b / scale) if scale > 0 else np.nan


def with_quantiles(dates: DataFrame, buckets: DataFrame, n_buckets: int = 5, time: str = "timestamp") -> DataFrame:
    """``per_date`` rows with each descriptive bucket's mean label (q1, q2, ...) and ``spread``, the last less the first; null where a bucket is empty."""
    means = buckets.groupBy(time).agg(*(F.max(F.when(F.col("bucket") == k, F.col("mean_label"))).alias(f"q{k}") for k in range(1, n_buckets + 1)))
    return dates.join(means, time, "left").withColumn("spread", F.col(f"q{n_buckets}") - F.col("q1"))


def ic_decay(df: DataFrame, signal: str, labels: list[str], least: int = 2, time: str = "timestamp") -> DataFrame:
    """(horizon, rank_ic, n_dates): mean rank IC of the signal against each label column, all horizons in one pass."""
    long = df.select(time, signal, *labels).unpivot([time, signal], labels, "horizon", "_y").where(F.col(signal).isNotNull() & F.col("_y").isNotNull())
    ranked = long.select("horizon", time, stats.rank_and_ties(F.col(signal), time, "horizon")[0].alias("_a"), stats.rank_and_ties(F.col("_y"), time, "horizon")[0].alias("_b"))
    dates = ranked.groupBy("horizon", time).agg(stats.safe_corr(F.col("_a"), F.col("_b"), least=least).alias("_ic"))
    return dates.groupBy("horizon").agg(F.avg("_ic").alias("rank_ic"), F.count("_ic").alias("n_dates"))


def incremental_ic(df: DataFrame, signal: str, references: list[str], label: str, least: int = 2, time: str = "timestamp") -> DataFrame:
    """(timestamp, n, rank_ic): rank correlation with the label of what a least-squares fit on the references leaves of the signal.

    Over rows with every value; dates with fewer than ``least`` or references + 2 rows, or with nothing left (less than 1e-10 of the signal's size), have none.
    """
    rows = df.select(time, signal, *references, label).dropna()
    left = residual(rows, signal, references, 0.0, max(least, len(references) + 2), time).where(F.col("_rest").isNotNull())
    ranked = left.select(time, signal, "_rest", stats.rank_and_ties(F.col("_rest"), time)[0].alias("_a"), stats.rank_and_ties(F.col(label), time)[0].alias("_b"))
    some = F.stddev_pop("_rest") > 1e-10 * F.greatest(F.lit(1.0), F.max(F.abs(signal)))
    out = ranked.groupBy(time).agg(F.count("*").alias("n"), stats.safe_corr(F.col("_a"), F.col("_b")).alias("rank_ic"), some.alias("_some"))
    return out.where(F.col("_some") & F.col("rank_ic").isNotNull()).drop("_some")


def descriptive_buckets(df: DataFrame, signal: str, label: str, n_buckets: int = 5, least: int = 2, time: str = "timestamp") -> DataFrame:
    """(timestamp, bucket, mean_label, n) by average ranks, so that equal values share a bucket and a bucket may be empty; dates with fewer than ``least`` rows or one value have none."""
    rows = df.where(F.col(signal).isNotNull() & F.col(label).isNotNull()).select(time, signal, label)
    w = W.partitionBy(time)
    rows = rows.withColumn("_r", stats.rank_and_ties(F.col(signal), time)[0]).withColumn("_n", F.count("*").over(w)).withColumn("_varies", F.min(signal).over(w) != F.max(signal).over(w))
    place = F.least(F.greatest(F.ceil(F.col("_r") * n_buckets / F.col("_n")), F.lit(1)), F.lit(n_buckets)).cast("int")
    return rows.where((F.col("_n") >= least) & F.col("_varies")).groupBy(time, place.alias("bucket")).agg(F.avg(label).alias("mean_label"), F.count("*").alias("n"))


def rank_autocorrelation(df: DataFrame, signal: str, time: str = "timestamp", security: str = "security") -> DataFrame:
    """(timestamp, n, autocorrelation): rank correlation with the date before, ranked anew over the securities with both values; fewer than two have none. Needs a dense grid."""
    pairs = df.select(time, security, F.col(signal).alias("_x"), F.lag(signal).over(W.partitionBy(security).orderBy(time)).alias("_y")).where("_x is not null and _y is not null")
    ranked = pairs.select(time, stats.rank_and_ties(F.col("_x"), time)[0].alias("_a"), stats.rank_and_ties(F.col("_y"), time)[0].alias("_b"))
    return ranked.groupBy(time).agg(F.count("*").alias("n"), stats.safe_corr(F.col("_a"), F.col("_b")).alias("autocorrelation"))


def reference_correlations(df: DataFrame, signal: str, references: list[str], time: str = "timestamp") -> DataFrame:
    """(reference, correlation, n_dates): mean over dates of the rank correlation with each reference, ranked over the rows with both; all references in one pass."""
    long = df.select(time, signal, *references).unpivot([time, signal], references, "reference", "_y").where(F.col(signal).isNotNull() & F.col("_y").isNotNull())
    ranked = long.select("reference", time, stats.rank_and_ties(F.col(signal), "reference", time)[0].alias("_a"), stats.rank_and_ties(F.col("_y"), "reference", time)[0].alias("_b"))
    dates = ranked.groupBy("reference", time).agg(stats.safe_corr(F.col("_a"), F.col("_b")).alias("_c"))
    return dates.groupBy("reference").agg(F.avg("_c").alias("correlation"), F.count("_c").alias("n_dates"))


#: Units of the summary's metrics.
UNITS = {"mean_rank_ic": "correlation", "std_rank_ic": "correlation", "rank_ic_ir": "ratio", "positive_ratio": "share", "mean_coverage": "share"}


def metric_metadata(summary: DataFrame, least: int) -> DataFrame:
    """(metric, value, unit, sample_count, status) of a ``summary``: ``ok``, ``insufficient_samples`` below ``least`` dates, or ``undefined`` without a value."""
    n = summary.where("metric = 'sample_count'").select(F.col("value").cast("long").alias("sample_count"))
    unit = F.coalesce(*(F.when(F.col("metric") == m, u) for m, u in UNITS.items()))
    rows = summary.where("metric != 'sample_count'").crossJoin(n)  # one row
    status = F.when(F.col("sample_count") < least, "insufficient_samples").when(F.col("value").isNull(), "undefined").otherwise("ok")
    return rows.select("metric", "value", unit.alias("unit"), "sample_count", status.alias("status"))
