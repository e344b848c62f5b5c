"""Forward labels and purged walk-forward splits on a dense grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _by() -> WindowSpec:
    return W.partitionBy("security").orderBy("timestamp")


def return_label(price: Column, lag: int, horizon: int, tradable: Column | None = None) -> Column:
    """P[exit] / P[entry] - 1 with entry ``lag`` sessions after the signal and exit ``horizon`` later; null unless both prices are positive and both ends tradable."""
    entry, leave = F.lead(price, lag).over(_by()), F.lead(price, lag + horizon).over(_by())
    ok = (entry > 0) & (leave > 0)
    if tradable is not None:
        ok &= F.coalesce(F.lead(tradable, lag).over(_by()) & F.lead(tradable, lag + horizon).over(_by()), F.lit(False))
    return F.when(ok, leave / entry - 1)


def direction(label: Column, threshold: float = 0.0) -> Column:
    return F.when(label.isNotNull(), (label > threshold).cast("double"))


def future_volatility(log_return: str, horizon: int, annual: float | None = None) -> Column:
    """Population deviation of the log returns of the next ``horizon`` sessions, all of them present."""
    ahead = _by().rowsBetween(2, horizon + 1)
    made = F.when(F.count(log_return).over(ahead) == horizon, F.stddev_pop(log_return).over(ahead))
    return made * F.sqrt(F.lit(annual)) if annual else made


def compounded(returns: str, horizon: int) -> Column:
    """Product of 1 + r over the next ``horizon`` sessions, minus one; a missing return makes it null."""
    ahead = _by().rowsBetween(1, horizon)
    return F.when(F.count(returns).over(ahead) == horizon, F.product(1 + F.col(returns)).over(ahead) - 1)


def walk_forward(windows: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold_id, signal, role): ``train`` rows whose label window ends inside the training span and doesn't overlap validation labels, ``purged`` ones that
    do, ``validation`` rows contained in their span, ``excluded`` ones that aren't. ``folds`` is a handful of rows.
    """
    both = windows.join(F.broadcast(folds), F.col("signal").between(F.col("train_start"), F.col("validation_end")))
    in_train = F.col("signal").between(F.col("train_start"), F.col("train_end"))
    in_val = F.col("signal").between(F.col("validation_start"), F.col("validation_end"))
    contained = F.col("label_end") <= F.col("validation_end")
    role = F.when(in_train & (F.col("label_end") > F.col("train_end")), "purged").when(in_train, "train").when(in_val & contained, "validation").when(in_val, "excluded")
    return both.select("fold_id", "signal", role.alias("role")).where("role is not null")


def execution_windows(signals: DataFrame, calendar: DataFrame, delay: int = 1) -> DataFrame:
    """(signal, entry, next_signal, exit, complete): each signal's holding interval, from ``delay`` sessions after it to ``delay`` after the next.

    The last signal has none. Bounds outside the calendar are null, with ``complete`` false. Both tables are session axes, far smaller than any panel.
    """
    axis = calendar.select(F.col("timestamp").alias("_at")).distinct().withColumn("_to", F.lead("_at", delay).over(W.orderBy("_at")))
    named = signals.select(F.col("timestamp").alias("signal")).distinct().withColumn("next_signal", F.lead("signal").over(W.orderBy("signal"))).where("next_signal is not null")
    entry, leave = axis.toDF("signal", "entry"), axis.toDF("next_signal", "exit")
    out = named.join(entry, "signal", "left").join(leave, "next_signal", "left")
    return out.select("signal", "entry", "next_signal", "exit", F.coalesce(F.col("entry") < F.col("exit"), F.lit(False)).alias("complete"))


#: What makes an execution-aware return invalid.
INVALID = tuple(f"{end}_{what}" for what in ("open_invalid", "adjustment_invalid", "amount_invalid", "suspended") for end in ("entry", "exit"))


def execution_returns(windows: DataFrame, panel: DataFrame) -> DataFrame:
    """(signal, security, value, valid, and the flags of ``INVALID``): adjusted open-to-open returns of each holding interval, for every security of the panel.

    ``windows``: (signal, entry, exit), a session axis. ``panel``: (timestamp, security, open, adjustment, amount, suspended). Prices, adjustments and amounts at both
    ends must be finite and positive, and no end suspended; a missing row fails all but the suspension. A return that isn't finite is invalid too.
    """
    names = panel.select("security").distinct()
    cells = names.crossJoin(windows.select("signal", "entry", "exit"))  # the grid asked for
    good = lambda c: F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")), F.lit(False))
    for end in ("entry", "exit"):
        side = panel.select(F.col("timestamp").alias(end), "security", *(F.col(c).alias(f"{end}_{c}") for c in ("open", "adjustment", "amount")), F.coalesce("suspended", F.lit(False)).alias(f"{end}_suspended"))
        cells = cells.join(side, [end, "security"], "left")
        cells = cells.withColumns({f"{end}_{c}_invalid": ~good(f"{end}_{c}") for c in ("open", "adjustment", "amount")} | {f"{end}_suspended": F.coalesce(f"{end}_suspended", F.lit(False))})
    value = F.try_divide(F.col("exit_open") * F.col("exit_adjustment"), F.col("entry_open") * F.col("entry_adjustment")) - 1
    broken = F.greatest(*(F.col(c).cast("int") for c in INVALID)) == 1
    cells = cells.withColumn("value", F.when(~broken & (F.abs(value) < float("inf")), value)).withColumn("nonfinite_return", ~broken & F.col("value").isNull())
    changed = ~F.col("entry_adjustment_invalid") & ~F.col("exit_adjustment_invalid") & (F.col("entry_adjustment") != F.col("exit_adjustment"))
    return cells.select("signal", "security", "value", F.col("value").isNotNull().alias("valid"), *INVALID, F.coalesce(changed, F.lit(False)).alias("adjustment_changed"), "nonfinite_return")


def label_diagnostics(returns: DataFrame, universe: DataFrame) -> DataFrame:
    """(signal, scope, valid, invalid, and a count for each flag) over the securities of ``universe`` (signal, security) on each signal date."""
    rows = returns.join(universe.select("signal", "security").distinct(), ["signal", "security"], "left_semi")
    flags = [*INVALID, "adjustment_changed", "nonfinite_return"]
    return rows.groupBy("signal").agg(F.count("*").alias("scope"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), *(F.count_if(c).alias(c) for c in flags))


def windows_between(windows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Windows whose whole interval from entry to exit lies between ``start`` and ``end``."""
    return windows.where((F.col("entry") >= start) & (F.col("exit") <= end))
