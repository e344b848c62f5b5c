"""Checks and records around candidates: price envelopes, suspension markers, drawdown runs, ledgers, campaign tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed words of suspension markers.
SUSPENDED = ("1", "S", "SUSPENDED", "SUSPEND", "停牌", "TRUE")
TRADED = ("0", "N", "NORMAL", "FALSE")


def suspended(marker: Column) -> Column:
    """A marker as a boolean; an unknown word is an error, a missing one is null."""
    word = F.upper(F.trim(marker))
    return F.when(word.isin(*SUSPENDED), True).when(word.isin(*TRADED), False).when(word.isNotNull(), F.raise_error(F.concat(F.lit("unknown suspension marker: "), word)).cast("boolean"))


def envelope_breaks(bars: DataFrame) -> DataFrame:
    """Bars whose high or low doesn't enclose the other prices."""
    return bars.where((F.col("high") < F.greatest("low", "open", "close")) | (F.col("low") > F.least("open", "close")))


def steps_over(df: DataFrame, col: str, most: float, time: str = "timestamp", security: str = "security") -> DataFrame:
    """Rows whose value is more than ``most`` times, or less than a ``most``-th of, the one before."""
    before = F.lag(col).over(W.partitionBy(security).orderBy(time))
    return df.withColumn("_before", before).where((F.col("_before") > 0) & (F.col(col) > 0) & (F.greatest(F.col(col) / F.col("_before"), F.col("_before") / F.col(col)) > most)).drop("_before")


def as_of_with_fallback(targets: DataFrame, mask: DataFrame, allowed: DataFrame, flag: str = "eligible", time: str = "timestamp", security: str = "security") -> DataFrame:
    """Adds the latest mask at or before each date and, before the mask's first date, whether the security is among ``allowed``.

    The first mask date is one row. A security outside ``allowed`` is never eligible.
    """
    from panelforge.operators.market import as_of_join

    known = as_of_join(targets, mask.select(security, F.col(time).alias("_since"), flag), [security], time, "_since", flag)
    first = mask.agg(F.min(time).alias("_first"))
    names = allowed.select(security).distinct().withColumn("_allowed", F.lit(True))
    out = known.join(F.broadcast(first)).join(names, security, "left").withColumn("_allowed", F.coalesce("_allowed", F.lit(False)))
    now = F.when(F.col("_first").isNull() | (F.col(time) < F.col("_first")), F.col("_allowed")).otherwise(F.coalesce(flag, F.lit(False)) & F.col("_allowed"))
    return out.withColumn(flag, now).drop("_first", "_allowed")


def longest_drawdown(df: DataFrame, value: str, by: str, time: str = "timestamp") -> DataFrame:
    """(by, sessions): the longest run of sessions below the running peak."""
    w = W.partitionBy(by).orderBy(time)
    marked = df.withColumn("_under", F.col(value) < F.max(value).over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = marked.withColumn("_run", F.sum((~F.col("_under")).cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    lengths = runs.groupBy(by, "_run").agg(F.sum(F.col("_under").cast("long")).alias("_n"))
    return lengths.groupBy(by).agg(F.coalesce(F.max("_n"), F.lit(0)).alias("sessions"))


def broken_chain(ledger: DataFrame, stream: str, seq: str, hash_col: str, previous: str) -> DataFrame:
    """Entries of a hash-chained ledger whose ``previous`` isn't the hash of the entry before (null for the first)."""
    before = F.lag(hash_col).over(W.partitionBy(stream).orderBy(seq))
    return ledger.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col(previous))).drop("_before")


def dangling(bindings: DataFrame, components: DataFrame, role: str) -> DataFrame:
    """Bindings whose role resolves to no component."""
    return bindings.join(components.select(role).distinct(), role, "left_anti")


def campaign_tests(attempts: DataFrame, family: str, candidate: str) -> DataFrame:
    """(family, candidate, attempt, p, q): each candidate's authoritative attempt (the last by number, then id), with failed or missing tests at p = 1, corrected within the family."""
    from panelforge.operators.selection import benjamini_hochberg

    last = attempts.groupBy(family, candidate).agg(F.max_by(F.struct("attempt", "p"), F.struct("attempt", "attempt_id")).alias("a"))
    rows = last.select(family, candidate, F.col("a.attempt").alias("attempt"), F.coalesce("a.p", F.lit(1.0)).alias("p"))
    return benjamini_hochberg(rows, "p", candidate, family)


def stalled(rounds: DataFrame, value: str, patience: int, least_gain: float = 0.0, campaign: str = "campaign", at: str = "round") -> DataFrame:
    """Adds ``stop``: no strict improvement over the best before by more than ``least_gain`` in the last ``patience`` rounds."""
    w = W.partitionBy(campaign).orderBy(at)
    best = F.max(value).over(w.rowsBetween(W.unboundedPreceding, -1))
    better = rounds.withColumn("_best", best).withColumn("_better", F.coalesce(F.col(value) > F.col("_best") + least_gain, F.lit(True)))
    recent = F.max("_better").over(w.rowsBetween(-(patience - 1), 0))
    return better.withColumn("stop", ~recent & (F.row_number().over(w) >= patience)).drop("_best", "_better")


def bad_transitions(events: DataFrame, allowed: list[tuple[str, str]], key: str, seq: str, state: str) -> DataFrame:
    """Events that follow the one before by a transition that isn't allowed."""
    spark = events.sparkSession
    table = F.broadcast(spark.createDataFrame(allowed, f"_from string, {state} string"))
    return events.withColumn("_from", F.lag(state).over(W.partitionBy(key).orderBy(seq))).where("_from is not null").join(table, ["_from", state], "left_anti").drop("_from")
