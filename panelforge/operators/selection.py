"""Tests of many candidates and their selection."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions import stats
from panelforge.operators import skyline
from panelforge.sources.shared import saved

#: Sums (series times trials) or starts that a bootstrap holds at once (so few that they stay in a core's cache), and values or counts.
BATCH_CELLS = 510 * 1008
COUNT_CELLS = 1 << 22
#: Trials of a row, and series of a task.
TRIALS = 1 << 21
TASK_SERIES = 4096
#: Trials for which a series keeps its order of the common starts, as a power of two.
ORDER_BITS = 16
#: Rows of a range of p-values.
RANGE_ROWS = 250_000
#: A counter's step and the factors that scramble it.
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def benjamini_hochberg(df: DataFrame, p: str, name: str, *by: str) -> DataFrame:
    """Adds q: null p-values count as 1. A family is one table of candidates. The least of all larger p is a running minimum from the largest p down: a frame that reaches to the end is added up anew for each row, in quadratic time.

    Beyond ``4 * RANGE_ROWS`` rows a family isn't one group: rows are dealt out by ranges of families and p, and ranks and minima go on from the range before by a row for each range and family.
    """
    rows = saved(df.withColumn("_p", F.coalesce(F.col(p), F.lit(1.0))))
    n = rows.count()
    if n <= 4 * RANGE_ROWS:
        tail = W.partitionBy(*by).orderBy(F.desc("_p"), F.desc(name)).rowsBetween(W.unboundedPreceding, 0)
        return rows.withColumn("_raw", stats.benjamini_hochberg(F.col("_p"), F.col(name), *by)).withColumn("q", F.min("_raw").over(tail)).drop("_p", "_raw")
    # written, as another run might cut the ranges elsewhere
    dealt = saved(rows.repartitionByRange(-(-n // RANGE_ROWS), *by, "_p", name).withColumn("_range", F.spark_partition_id()))

    def with_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
        other = ranges.select(*(F.col(c).alias(f"_of_{c}") for c in (*by, "_range")), *(c for c in ranges.columns if c not in (*by, "_range")))
        same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*by, "_range")))
        return rows.join(other, same).drop(*(f"_of_{c}" for c in (*by, "_range")))

    family, group = W.partitionBy(*by), W.partitionBy(*by, "_range")
    before = family.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    places = sizes.select(*by, "_range", F.sum("_n").over(family).alias("_m"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.row_number().over(group.orderBy("_p", name))
    raw = with_ranges(dealt, places).withColumn("_raw", F.least(F.lit(1.0), F.col("_p") * F.col("_m") / rank))
    falling = group.orderBy(F.desc("_p"), F.desc(name)).rowsBetween(W.unboundedPreceding, 0)
    ranked = saved(raw.withColumn("_low", F.min("_raw").over(falling)).drop("_m", "_before", "_p"))
    above = family.orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    lows = ranked.groupBy(*by, "_range").agg(F.min("_raw").alias("_least")).select(*by, "_range", F.min("_least").over(above).alias("_above"))
    return with_ranges(ranked, lows).withColumn("q", F.least("_low", "_above")).drop("_range", "_raw", "_low", "_above")


def newey_west(df: DataFrame, value: str, series: str, time: str, lags: int) -> DataFrame:
    """(series, n, mean, lrv, z) of each series: long-run variance with Bartlett weights; z is null when it isn't positive."""
    w = W.partitionBy(series).orderBy(time)
    rows = df.where(F.col(value).isNotNull()).withColumn("_x", F.col(value) - F.avg(value).over(W.partitionBy(series)))
    for k in range(lags + 1):
        rows = rows.withColumn(f"_g{k}", F.col("_x") * (F.lag("_x", k).over(w) if k else F.col("_x")))
    n = F.count("*")
    gamma = [F.coalesce(F.sum(f"_g{k}"), F.lit(0.0)) / n for k in range(lags + 1)]
    lrv = reduce(lambda a, b: a + b, [gamma[0], *(2 * (1 - k / (lags + 1)) * gamma[k] for k in range(1, lags + 1))])
    out = rows.groupBy(series).agg(n.alias("n"), F.avg(value).alias("mean"), lrv.alias("lrv"))
    return out.withColumn("z", F.when(F.col("lrv") > 1e-18, F.col("mean") / F.sqrt(F.col("lrv") / F.col("n"))))


def upper_p(z: Column) -> Column:
    """One-sided p-value of a normal score (null: 1)."""

    @F.pandas_udf("double")
    def tail(s: pd.Series) -> pd.Series:
        x = s.to_numpy(float, na_value=np.nan) / math.sqrt(2)
        return pd.Series(np.where(np.isnan(x), 1.0, 0.5 * _erfc(np.nan_to_num(x))))

    return tail(z)


def _erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of an array, to about 1e-15: a series for small arguments, a continued fraction for large ones."""
    a = np.abs(x)
    small = np.minimum(a, 2.5)
    term = total = small.copy()
    for n in range(1, 60):
        term = -term * small * small / n
        total = total + term / (2 * n + 1)
    large = np.maximum(a, 2.5)
    rest = large.copy()
    for n in range(80, 0, -1):
        rest = large + (n / 2) / rest
    tail = np.where(a <= 2.5, 1 - 2 / math.sqrt(math.pi) * total, np.exp(-large * large) / (math.sqrt(math.pi) * rest))
    return np.where(x >= 0, tail, 2 - tail)


def family_significance(family: DataFrame, values: DataFrame, least: int, lags: int, candidate: str = "candidate", value: str = "value", time: str = "timestamp") -> DataFrame:
    """(candidate, status, n, mean, z, p, q) for the whole declared ``family`` (candidate, sign): values are taken in the declared direction, and candidates that
    are missing, have fewer than ``least`` values or no positive variance count with p = 1. Values of candidates outside the family are an error when rows are read.
    """
    known = values.join(family.select(candidate, F.col("sign").alias("_sign")), candidate, "left")
    sign = F.coalesce(F.col("_sign"), F.raise_error(F.concat(F.lit("outside_family:"), F.col(candidate).cast("string"))).cast("int"))
    tested = newey_west(known.select(candidate, time, (F.col(value) * sign).alias("_v")), "_v", candidate, time, lags)
    out = family.select(candidate).join(tested, candidate, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("n") == 0, "missing").when(F.col("n") < least, "insufficient_observations").when(F.col("z").isNull(), "degenerate").otherwise("tested")
    out = out.withColumn("status", status).withColumn("z", F.when(F.col("status") == "tested", F.col("z"))).withColumn("p", upper_p(F.col("z")))
    return benjamini_hochberg(out, "p", candidate).select(candidate, "status", "n", "mean", "z", "p", "q")


def _scrambled(counter: np.ndarray) -> np.ndarray:
    x = (counter ^ (counter >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def _common_starts(stream: int, trials: np.ndarray, blocks: int, n: int) -> np.ndarray:
    """Starts below ``n`` by trial and block, each from its own counter in the stream."""
    starts, width = np.empty((len(trials), blocks), np.int64), max(1, BATCH_CELLS // blocks)
    for at in range(0, len(trials), width):
        counter = (trials[at : at + width, None] * np.uint64(blocks) + np.arange(blocks, dtype=np.uint64) + np.uint64(1)) * STEP
        starts[at : at + width] = (_scrambled(counter + np.uint64(stream)) >> np.uint64(11)).astype(float) * 2.0**-53 * n
    return starts


def _orders(keys: np.ndarray, epoch: int, n: int) -> np.ndarray:
    """Each key's own order of the ``n`` starts for the trials of an epoch, every order being as likely."""
    counter = (np.arange(n, dtype=np.uint64) + np.uint64(epoch * n + 1)) * STEP
    return np.argsort(_scrambled(counter + keys[:, None]), axis=1)


def _starts(key: int, trials: np.ndarray, blocks: int, n: int) -> np.ndarray:
    stream, own = divmod(key, 1 << 64)
    starts, epochs = _common_starts(stream, trials, blocks, n), trials >> np.uint64(ORDER_BITS)
    for epoch in np.unique(epochs):
        starts[epochs == epoch] = _orders(np.array([own], np.uint64), int(epoch), n)[0][starts[epochs == epoch]]
    return starts


def draw_starts(key: int, first: int, trials: int, blocks: int, n: int) -> np.ndarray:
    """Starts below ``n`` of the blocks of trials ``first`` on, each by its trial and block alone, so that any range of trials can be drawn anywhere.

    The key's upper part names a stream of starts that a family has in common; its lower part is a series' own and puts the ``n`` starts in an order of its own, a new one for every 2^16 trials.
    So a series' starts are even and independent from trial to trial, and a family's trials are drawn once: what series have in common is only which of a trial's blocks are the same one.
    """
    return _starts(key, np.arange(first, first + trials, dtype=np.uint64), blocks, n)


def stream_key(seed: int, name: object) -> int:
    """The key of a series' stream: the seed's 64 bits, then the series' own."""
    parts = (hashlib.sha256(text.encode()).digest()[:8] for text in (f"{seed}", f"{seed}:{name}"))
    return int.from_bytes(b"".join(parts), "big")


def bootstrap_hits(x: np.ndarray, block: int, key: int, first: int, trials: int) -> int:
    """``family_hits`` of one series."""
    return int(family_hits(x[None, :], block, [key], first, trials)[0])


def family_hits(x: np.ndarray, block: int, keys: list[int], first: int, trials: int) -> np.ndarray:
    """In how many of the trials the mean of the drawn blocks of a row of ``x`` less its mean reaches that mean. The starts are those of ``draw_starts`` with the row's key; the keys are of one seed.

    A block's sum is a difference of two running sums. How often each start occurs in a trial is counted once for all rows, and a product of these counts with the rows' block sums, each in its row's
    order, adds up all trials of all rows. It is taken in single precision: what its rounding could decide is added up anew in double precision. Trials go by their last, shorter block, whose sum
    lowers the bound that the others have to reach.
    """
    n, mean = x.shape[1], x.mean(axis=1)
    full, rest = divmod(n, block)
    blocks, place = full + (rest > 0), np.arange(n)
    sums = np.zeros((len(x), n + block + 1))
    np.cumsum((x - mean[:, None])[:, np.arange(n + block) % n], axis=1, out=sums[:, 1:])
    whole, part = sums[:, place + block] - sums[:, place], sums[:, place + rest] - sums[:, place]
    hits = np.zeros(len(x), np.int64)
    flat = ~(whole.any(axis=1) | part.any(axis=1))  # all sums are 0
    hits[flat] = np.where(mean[flat] <= 0, trials, 0)
    live = np.flatnonzero(~flat)
    if not len(live):
        return hits
    mean, whole, part = mean[live], whole[live], part[live]
    stream, own = keys[0] >> 64, np.array([keys[k] % (1 << 64) for k in live], np.uint64)
    few = n > 64 * max(full, 1)  # counts would be nearly all zeros
    held = max(1, BATCH_CELLS // (blocks * len(live)) if few else COUNT_CELLS // blocks)
    found = np.zeros(len(live), np.int64)
    at, end = first, first + trials
    while at < end:
        epoch = at >> ORDER_BITS
        orders, stop = _orders(own, epoch, n), min(end, (epoch + 1) << ORDER_BITS)
        wholes, parts = np.take_along_axis(whole, orders, 1), np.take_along_axis(part, orders, 1)
        for begin in range(at, stop, held):
            starts = _common_starts(stream, np.arange(begin, min(begin + held, stop), dtype=np.uint64), blocks, n)
            if few:
                found += _exact_hits(wholes, parts, mean, starts, full, *np.divmod(np.arange(len(live) * len(starts)), len(starts)))
            else:
                found += _counted_hits(wholes, parts, mean, starts, full)
        at = stop
    hits[live] = found
    return hits


def _counted_hits(wholes: np.ndarray, parts: np.ndarray, mean: np.ndarray, starts: np.ndarray, full: int) -> np.ndarray:
    """Hits by row of trials of one epoch: sums less their bounds from the counts' product, and those near 0 left to ``_exact_hits``. Hits of 255 trials at a time are added up as bytes, eight rows in a word."""
    size, n = wholes.shape
    padded = -(-size // 8) * 8
    width = min(padded, 1008)  # not a power of two, whose rows would meet in a core's cache
    height = max(1, min(BATCH_CELLS // width, COUNT_CELLS // n))
    scale = np.abs(wholes).max(axis=1, keepdims=True)
    scale[~(scale > 0)] = 1.0
    reach = full + 2  # no sum gets there, nor need a bound lie beyond
    margin = (full + 4) * (full + reach) * 2.0**-24  # a term is rounded as a factor, as a product and at most ``full`` times as it is added
    factors, bounds = np.zeros((padded, n + min(n, height)), np.float32), np.full((padded, n), -reach, np.float32)
    factors[:size, :n] = wholes / scale
    bounds[:size] = -np.clip(((mean * n)[:, None] - parts) / scale, -reach, reach)
    last = starts[:, full] if starts.shape[1] > full else np.zeros(len(starts), np.int64)
    by_last = np.argsort(last, kind="stable")  # so that few bounds are factors at once
    starts, last = starts[by_last], last[by_last]
    found, open_ = np.zeros(padded, np.int64), []
    total, flags = np.empty(height * width, np.float32), np.empty((2, height * width), bool)
    for at in range(0, len(starts), height):
        of = last[at : at + height]
        new = np.append(True, of[1:] != of[:-1])
        drawn, k = np.column_stack((starts[at : at + height, :full], n - 1 + np.cumsum(new))), n + np.count_nonzero(new)
        factors[:, n:k] = bounds[:, of[new]]
        cells = np.arange(len(drawn))[:, None] * k + drawn
        counts = np.bincount(cells.ravel(), minlength=len(drawn) * k).reshape(-1, k).astype(np.float32)
        for row in range(0, padded, width):
            rows = slice(row, min(row + width, padded))
            shape = (len(drawn), rows.stop - row)
            sums, sure, maybe = (a[: shape[0] * shape[1]].reshape(shape) for a in (total, *flags))
            np.matmul(counts, factors[rows, :k].T, out=sums)
            np.greater_equal(sums, margin, out=sure)
            np.greater_equal(sums, -margin, out=maybe)
            words = sure.view(np.uint64)
            for a in range(0, len(words), 255):
                found[rows] += words[a : a + 255].sum(axis=0).view(np.uint8)
            differ = np.flatnonzero(words != maybe.view(np.uint64))
            if len(differ):
                trial, own = np.divmod((differ[:, None] * 8 + np.arange(8)).ravel(), shape[1])
                undecided = sure[trial, own] != maybe[trial, own]
                open_.append((own[undecided] + row, trial[undecided] + at))
        if open_ and (len(open_) >= 64 or at + height >= len(starts)):
            found[:size] += _exact_hits(wholes, parts, mean, starts, full, *map(np.concatenate, zip(*open_, strict=True)))
            open_ = []
    return found[:size]


def _exact_hits(wholes: np.ndarray, parts: np.ndarray, mean: np.ndarray, starts: np.ndarray, full: int, rows: np.ndarray, trials: np.ndarray) -> np.ndarray:
    """Hits by row among the pairs of a row and a trial, added up in double precision."""
    n, found = wholes.shape[1], np.zeros(len(wholes), np.int64)
    width = max(1, BATCH_CELLS // starts.shape[1])
    for at in range(0, len(rows), width):
        k, drawn = rows[at : at + width], starts[trials[at : at + width]]
        total = wholes[k[:, None], drawn[:, :full]].sum(axis=1)
        if drawn.shape[1] > full:
            total += parts[k, drawn[:, full]]
        found += np.bincount(k[total / n >= mean[k]], minlength=len(found))
    return found


def block_bootstrap(df: DataFrame, value: str, series: str, time: str, block: int, trials: int | None, seed: int) -> DataFrame:
    """(series, p): circular block bootstrap of the mean under no effect. A series' trials are drawn by number with its own key (``draw_starts``), so how they are dealt out doesn't matter.

    A family needs max(2000, 20 for each series) trials, for the least p to survive the correction over all series: fewer are refused, None takes that number.
    Null values are left out; a series of fewer than two has p = 1. Ranges of trials are rows of their own, and only their hits are merged. A task has series of few lengths, as those of one length share their draws.
    """
    held = F.transform(F.sort_array(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("x"))))), lambda r: r["x"])
    rows = saved(df.groupBy(series).agg(held.alias("_x")))
    count = rows.count()
    least = max(2000, 20 * count)
    if trials is None:
        trials = least
    if trials < least:
        raise ValueError(f"block bootstrap of this family needs {least} trials, not {trials}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, values, alike = batch.column(0).to_pylist(), batch.column(2), {}
            hits = np.zeros(len(names), np.int64)
            for k, (first, n) in enumerate(zip(batch.column(1).to_pylist(), values.value_lengths().to_pylist(), strict=True)):
                alike.setdefault((first, n), []).append(k)
            for (first, n), places in alike.items():
                size = max(1, COUNT_CELLS // n)
                for own in (places[at : at + size] for at in range(0, len(places), size)):
                    x = np.stack([values[k].values.to_numpy() for k in own])
                    hits[own] = family_hits(x, block, [stream_key(seed, names[k]) for k in own], first, min(TRIALS, trials - first))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.int64())], [series, "_hits"])

    kind = df.schema[series].dataType.simpleString()
    parts = -(-count // TASK_SERIES) * -(-trials // TRIALS) or 1
    ranges = rows.where(F.size("_x") > 1).select(series, F.explode(F.sequence(F.lit(0), F.lit(trials - 1), F.lit(TRIALS))).alias("_first"), "_x").repartitionByRange(parts, "_first", F.size("_x"), series)
    counted = ranges.mapInArrow(run, f"{series} {kind}, _hits long").groupBy(series).agg(((1 + F.sum("_hits")) / F.lit(trials + 1)).alias("p"))
    return counted.unionByName(rows.where(F.size("_x") < 2).select(series, F.lit(1.0).alias("p")))


def frontier(df: DataFrame, name: str, maximise: list[str], minimise: list[str], epsilon: float = 0.0) -> DataFrame:
    """Candidates that no other one dominates: no worse within ``epsilon`` in every objective, better by more in one. ``name`` identifies a candidate; equal candidates don't dominate each other, and one with a null or NaN objective neither dominates nor is dominated."""
    return skyline.unbeaten(df, df, maximise, minimise, epsilon, True)


def failed_gates(tests: dict[str, Column]) -> Column:
    """Codes of the tests that don't hold (a null test doesn't)."""
    codes = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in tests.items()]
    return F.filter(F.array(*codes), lambda c: c.isNotNull())
