"""Which cells of a joined panel count as identity, signal, suspension and execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def feature_returns(df: DataFrame, returns: str, identity: Column, marker: Column, amount: str, fill: float = 0.0) -> DataFrame:
    """Adds feature_return, observed, suspension_filled, unexplained and conflict.

    ``fill`` stands in only where a security has a suspension marker, no return and no positive amount; a marker with trading is a conflict.
    """
    i, m, traded = _true(identity), _true(marker), _true(F.col(amount) > 0)
    seen = F.col(returns).isNotNull()
    filled = i & m & ~seen & ~traded
    return df.withColumns({
        "feature_return": F.when(filled, F.lit(fill)).when(i, F.col(returns)), "observed": i & seen, "suspension_filled": filled,
        "unexplained": i & ~seen & ~filled, "conflict": i & m & (seen | traded),
    })


def security_contract(df: DataFrame, identity: Column, source: Column, marker: Column, returns: str, close: str, amount: str, price_limit: Column | None = None) -> DataFrame:
    """Adds signal (identity and source) and execution (also a return, a close and a positive amount, no marker and, if given, free of the price limit)."""
    signal = _true(identity) & _true(source)
    can = F.col(returns).isNotNull() & F.col(close).isNotNull() & _true(F.col(amount) > 0) & ~_true(marker)
    return df.withColumns({"signal": signal, "execution": signal & can & (_true(price_limit) if price_limit is not None else F.lit(True))})


def research_identity(panels: list[DataFrame], listed: DataFrame, security: str = "security", time: str = "timestamp") -> DataFrame:
    """(timestamp, security) of the first panel for six-digit ids that are in every panel, from their ``list_date`` on."""
    out = panels[0].select(time, security).distinct()
    for panel in panels[1:]:
        out = out.join(panel.select(security).distinct(), security, "left_semi")
    dates = listed.groupBy(security).agg(F.min("list_date").alias("_from"))
    return out.where(F.col(security).cast("string").rlike("^[0-9]{6}$")).join(dates, security).where(F.col(time) >= F.col("_from")).select(time, security)


def contract_audit(df: DataFrame, flags: list[str], time: str = "timestamp", security: str = "security") -> DataFrame:
    """One row of counts of a joined panel: rows, dates, securities, and for each flag its cells and its dates; nulls count as false."""
    counts = [F.count("*").alias("cells"), F.countDistinct(time).alias("dates"), F.countDistinct(security).alias("securities")]
    for c in flags:
        counts += [F.count_if(_true(F.col(c))).alias(f"{c}_cells"), F.countDistinct(F.when(_true(F.col(c)), F.col(time))).alias(f"{c}_dates")]
    return df.agg(*counts)
