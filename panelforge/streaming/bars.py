"""Daily bars and revisions of an event stream, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, keys: list[str], known: str = "known_at", late: str = "2 days") -> DataFrame:
    """The first row of each key within the watermark; later revisions are dropped."""
    return stream.withWatermark(known, late).dropDuplicatesWithinWatermark(keys)


def _number(df: DataFrame, c: str) -> Column:
    """The column as a number that keeps its order, for times."""
    kind = df.schema[c].dataType.typeName()
    return F.unix_date(c) if kind == "date" else F.unix_micros(F.col(c).cast("timestamp")) if kind.startswith("timestamp") else F.col(c)


def revisions(stream: DataFrame, keys: list[str], policy: str, effective: str = "effective_at", known: str = "known_at", tie: str | None = None, late: str = "30 days") -> DataFrame:
    """The row that stands for each key and effective time, sent again whenever a revision takes its place (update mode): the first that was known (``first_seen``) or the last (``as_of``), of equal ones that with the smallest ``tie``.

    The state is one row for each key and effective time, whatever the number and order of its revisions. It is kept, and late rows are taken, until the effective time is ``late`` behind the newest one. Within that, the
    last row sent for each key is that of the batch ``resolve_revisions``. A null ``known`` is the earliest; a null ``effective`` is never sent.
    """
    if policy not in ("first_seen", "as_of"):
        raise ValueError(f"unknown policy {policy}")
    at = _number(stream, known)
    first = [at.isNotNull(), at] if policy == "first_seen" else [at.isNull(), -at]
    others = [c for c in stream.columns if c not in (*keys, effective)]
    order = F.struct(*(c.alias(f"o{k}") for k, c in enumerate([*first, *([F.col(tie)] if tie else [])])))
    rows = stream.withWatermark(effective, late).where(F.col(effective).isNotNull()).groupBy(*keys, effective)
    return rows.agg(F.min_by(F.struct(*others), order).alias("_row")).select(*keys, effective, "_row.*").select(*stream.columns)


def daily_bars(stream: DataFrame, price: str, by: str, time: str = "ts", tie: str = "event_id", late: str = "1 day") -> DataFrame:
    """Open, high, low, close, sum and count of each day and security, updated while the watermark permits."""
    order = F.struct(F.col(time), F.col(tie))
    rows = stream.withWatermark(time, late).groupBy(F.window(time, "1 day"), F.col(by))
    bars = rows.agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(price).alias("volume"), F.count("*").alias("n"))
    return bars.select(F.to_date("window.start").alias("day"), by, "open", "high", "low", "close", "volume", "n")
