"""Points that no other point dominates, without comparing all pairs.

Objectives are oriented so that more is better. In falling order of their sum a point can only be dominated by an earlier one. Each task
first keeps its own frontier; what is left is sorted in ranges and packed in blocks, and a block meets only those earlier blocks whose upper corner
reaches its lower one. What a point dominates is also dominated by any point above it, so everything else is compared with the frontier alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.sources.shared import saved

#: Points of a block.
BLOCK = 4096
#: Comparisons that are held at once.
CELLS = 1 << 22
#: Vectors that may be broadcast.
BROADCAST_ROWS = 500_000


def oriented(maximise: list[str], minimise: list[str]) -> list[Column]:
    """The objectives as doubles v0, v1, ..., those to minimise negated."""
    every = [F.col(c).cast("double") for c in maximise] + [-F.col(c).cast("double") for c in minimise]
    return [c.alias(f"v{k}") for k, c in enumerate(every)]


def beaten(x: np.ndarray, by: np.ndarray, epsilon: float, strict: bool) -> np.ndarray:
    """Which rows of ``x`` some row of ``by`` is no worse than by more than ``epsilon`` in every column and, if ``strict``, better by more in one."""
    out = np.zeros(len(x), bool)
    step = max(1, CELLS // max(1, len(x)))
    for at in range(0, len(by), step):
        left = np.flatnonzero(~out)
        if not len(left):
            break
        part = by[at : at + step]
        holds = np.ones((len(left), len(part)), bool)
        better = np.zeros_like(holds) if strict else holds
        for k in range(x.shape[1]):
            gain = part[:, k] - x[left, k][:, None]
            holds &= gain >= -epsilon
            if strict:
                better |= gain > epsilon
        out[left] = (holds & better).any(axis=1)
    return out


def in_order(x: np.ndarray) -> np.ndarray:
    """Rows by falling sum, then falling values, so that a row is only dominated by earlier ones, also where sums round to the same."""
    return x[np.lexsort((*(-x.T[::-1]), -x.sum(axis=1)))]


def own_frontier(x: np.ndarray) -> np.ndarray:
    """The rows of ``x`` that no other dominates."""
    x, kept = in_order(x), x[:0]
    for at in range(0, len(x), 512):
        part = x[at : at + 512]
        part = part[~beaten(part, kept, 0.0, True)]
        kept = np.concatenate((kept, part[~beaten(part, part, 0.0, True)]))
    return kept


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy() for c in batch.columns]) if batch.num_rows else np.empty((0, batch.num_columns))


def _blocks(points: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(block, at, vector columns) of distinct ``points`` in falling order, and (number, block, low, high, rows) of each block; both written."""
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    order = [F.desc("_sum"), *(F.desc(c) for c in names)]
    ranged = points.withColumn("_sum", total).repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    rows = saved(ranged.select(*names, F.floor(place / BLOCK).alias("block"), (place % BLOCK).cast("int").alias("at")))
    ends = [F.array(*(f(c) for c in names)).alias(alias) for f, alias in ((F.min, "low"), (F.max, "high"))]
    packed = F.sort_array(F.collect_list(F.struct("at", F.array(*names).alias("v")))).alias("rows")
    blocks = rows.groupBy("block").agg(*ends, packed).select("block", "low", "high", F.transform("rows", lambda r: r["v"]).alias("rows"))
    # one row a block, so a window over all of them is small
    return rows, saved(blocks.withColumn("number", F.row_number().over(W.orderBy("block")) - 1))


def _beaten_rows(x: DataFrame, by: DataFrame, width: int, epsilon: float, strict: bool, earlier: bool) -> DataFrame:
    """(block, at) of rows of blocks ``x`` that rows of blocks ``by`` beat; ``earlier``: both are the same blocks, and only earlier ones can."""
    n = by.count()
    last = F.col("number") if earlier else F.lit(n - 1)
    corners = x.select(F.col("block").alias("x_block"), F.col("low").alias("x_low"), F.explode(F.sequence(F.lit(0), last)).alias("number")) if n else x.select(F.col("block").alias("x_block"), F.col("low").alias("x_low"), "number").limit(0)
    reach = F.forall(F.arrays_zip("high", "x_low"), lambda p: p["high"] - p["x_low"] >= -epsilon)
    pairs = corners.join(by.select("number", "high"), "number").where(reach).select("x_block", "number")
    met = pairs.join(by.select("number", F.col("rows").alias("by_rows")), "number").join(x.select(F.col("block").alias("x_block"), F.col("rows").alias("x_rows")), "x_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                both = [batch.column(c)[k].values.flatten().to_numpy().reshape(-1, width) for c in (1, 2)]
                at = np.flatnonzero(beaten(*both, epsilon, strict))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(at), pa.int64()), pa.array(at.astype(np.int32))], ["block", "at"])

    return met.select("x_block", "x_rows", "by_rows").mapInArrow(run, "block long, at int").distinct()


def pareto(points: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The distinct ``points`` (double columns ``names``, no nulls) that no other dominates: as rows with their block and place, and as blocks; both written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty((0, len(names)))
        for batch in batches:
            kept = own_frontier(np.concatenate((kept, _matrix(batch))))
        yield pa.RecordBatch.from_arrays([pa.array(kept[:, k]) for k in range(len(names))], names)

    schema = ", ".join(f"{c} double" for c in names)
    rows, blocks = _blocks(points.select(*names).distinct().mapInArrow(run, schema), names)
    lost = _beaten_rows(blocks, blocks, len(names), 0.0, True, True)
    return _blocks(rows.join(lost, ["block", "at"], "left_anti").select(*names), names)


def _usable(names: list[str]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).isNotNull() & ~F.isnan(c)
    return out


def unbeaten(df: DataFrame, by: DataFrame, maximise: list[str], minimise: list[str], epsilon: float, strict: bool) -> DataFrame:
    """Rows of ``df`` that no row of ``by`` beats (see ``beaten``). Rows with a null or NaN objective beat nothing and stay; equal rows stay or go together."""
    vector = oriented(maximise, minimise)
    names = [f"v{k}" for k in range(len(vector))]
    usable = _usable(names)
    frontier, by_blocks = pareto(by.select(*vector).where(usable), names)
    if strict and not epsilon and by is df:
        good = frontier.select(*names)
    else:
        rows, blocks = _blocks(df.select(*vector).where(usable).distinct(), names)
        good = saved(rows.join(_beaten_rows(blocks, by_blocks, len(names), epsilon, strict, False), ["block", "at"], "left_anti").select(*names))
    good = F.broadcast(good) if good.count() <= BROADCAST_ROWS else good
    clash = {c: f"_{c}_of_objective" for c in names}
    placed = df.select("*", *(c.alias(clash[n]) for c, n in zip(vector, names, strict=True)))
    found = placed.where(_usable(list(clash.values()))).join(good.withColumnsRenamed(clash), list(clash.values()), "left_semi").select(*df.columns)
    return found.unionByName(placed.where(~_usable(list(clash.values()))).select(*df.columns))
