"""Overlaps of two tables of intervals, both of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.sources.shared import saved


def _placed(df: DataFrame, start: str, stop: str, side: str) -> DataFrame:
    """Rows with their ends as ``_a`` and ``_b``, and the level whose bins, powers of two wide, are just as long as they are: they touch two of them at most."""
    ends = df.withColumns({f"_{side}a": F.col(start).cast("long"), f"_{side}b": F.col(stop).cast("long")}).where(F.col(f"_{side}a") <= F.col(f"_{side}b"))
    # the level is found by comparing whole numbers, as logarithms of long intervals round
    length = F.col(f"_{side}b") - F.col(f"_{side}a")
    return saved(ends.withColumn(f"_{side}level", F.length(F.bin(length)) - F.when(length == 0, 1).otherwise(0)))


def _binned(df: DataFrame, side: str, levels: list[int]) -> DataFrame:
    """Each row in its bins of its own level and of the other side's higher ones."""
    own = F.col(f"_{side}level")
    every = F.array_distinct(F.concat(F.array(own), F.filter(F.lit(levels).cast("array<int>"), lambda v: v > own)))

    def at(level: Column, end: str) -> Column:
        return F.call_function("shiftright", F.col(f"_{side}{end}"), level)

    leveled = df.withColumn("_level", F.explode(every))
    bins = F.sequence(at(F.col("_level"), "a"), at(F.col("_level"), "b"))
    return leveled.withColumn(f"_{side}first", at(F.col("_level"), "a")).withColumn("_bin", F.explode(bins))


def overlaps(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], on: list[str] | None = None) -> DataFrame:
    """Pairs of rows, equal in the columns ``on``, whose spans (both ends included; whole numbers, or what casts to them: dates as ``unix_date``, timestamps as seconds) share a point.

    Two intervals meet once, at the level of the longer one, in the last bin that both begin in or before; so the join is on equal levels and bins, and the longest intervals don't repeat in many small
    bins. Rows with a null end, or whose end is before their start, overlap nothing. Columns of both sides are kept, those of ``on`` once; other names must differ.
    """
    on = on or []
    a, b = _placed(left, *left_span, "l"), _placed(right, *right_span, "r")
    levels = [[r[0] for r in side.select(f"_{s}level").distinct().collect()] for side, s in ((a, "l"), (b, "r"))]  # at most 64 numbers
    met = _binned(a, "l", levels[1]).join(_binned(b, "r", levels[0]), [*on, "_level", "_bin"])
    own = F.greatest("_llevel", "_rlevel") == F.col("_level")
    once = F.greatest("_lfirst", "_rfirst") == F.col("_bin")
    kept = [*left.columns, *(c for c in right.columns if c not in on)]
    return met.where(own & once & (F.col("_la") <= F.col("_rb")) & (F.col("_ra") <= F.col("_lb"))).select(*kept)
