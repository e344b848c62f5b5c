"""Point-in-time market data: visibility, revisions, as-of joins, bars, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.sources.shared import saved


def visible_as_of(df: DataFrame, as_of: Column, effective: str = "effective_at", known: str = "known_at") -> DataFrame:
    return df.where((F.col(effective) <= as_of) & (F.col(known) <= as_of))


def resolve_revisions(df: DataFrame, keys: list[str], policy: str, effective: str = "effective_at", known: str = "known_at", tie: str | None = None) -> DataFrame:
    """One row for each key and effective time: the first that was known (``first_seen``) or the last (``as_of``)."""
    order = F.asc(known) if policy == "first_seen" else F.desc(known)
    w = W.partitionBy(*keys, effective).orderBy(order, *([F.asc(tie)] if tie else []))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def as_of_join(left: DataFrame, right: DataFrame, on: list[str], at: str, since: str, value: str) -> DataFrame:
    """Latest ``value`` of ``right`` at or before ``at``: both sides in one order per key, the last known value carried forward. One shuffle, no range join."""
    a = left.select(*on, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(*on, F.col(since).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = W.partitionBy(*on).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    joined = a.unionByName(b).withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return joined.select("_row.*", value)


def state_at(events: DataFrame, dates: DataFrame, key: str, date: str = "date") -> DataFrame:
    """Status of each instrument on each date: the latest event by (effective, known) among those in effect and known; none, no row.

    An event counts from the later of its two times. Events and asked dates (a grid, which the result is a part of) are put in one order for each key
    and the latest event is carried along: one shuffle, no range join.
    """
    kind = dates.schema[date].dataType
    axis = dates.agg(F.array_distinct(F.collect_list(date)).alias("_axis"))  # one row of sessions
    grid = events.select(key).distinct().join(F.broadcast(axis)).select(key, F.explode("_axis").alias("_t"), F.lit(1).alias("_asked"))
    event = F.struct("effective_at", "known_at", "status")
    seen = events.where("effective_at is not null and known_at is not null").select(key, F.greatest("effective_at", "known_at").cast(kind).alias("_t"), F.lit(0).alias("_asked"), event.alias("_event"))
    last = F.max("_event").over(W.partitionBy(key).orderBy("_t", "_asked").rowsBetween(W.unboundedPreceding, 0))
    rows = seen.unionByName(grid, allowMissingColumns=True).withColumn("_event", last)
    return rows.where("_asked = 1 and _event is not null").select(key, F.col("_t").alias(date), F.col("_event.status").alias("status"))


def daily_bars(df: DataFrame, price: str, volume: str, by: str, time: str = "ts", tie: str = "event_id") -> DataFrame:
    order = F.struct(F.col(time), F.col(tie))
    return df.groupBy(F.to_date(time).alias("day"), F.col(by)).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        F.sum(volume).alias("volume"), F.avg(price).alias("mean"), F.count("*").alias("n"),
    )


def quality_report(df: DataFrame, keys: list[str], field: str, low: float, high: float, error_missing: float = 0.25, warn_missing: float = 0.05, applicable: str | None = None) -> DataFrame:
    """(code, severity, field, n): issues of one numeric field in a single aggregation; an error quarantines the table.

    ``applicable``: a boolean column (null: false) of the rows in which the field means something; missing shares, infinities and bounds are theirs alone.
    """
    applies = F.coalesce(F.col(applicable), F.lit(False)) if applicable else F.lit(True)
    x = F.when(applies, F.col(field).cast("double"))
    infinite = F.abs(x) == float("inf")
    absent = applies & (x.isNull() | F.isnan(x))
    groups = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(applies).alias("_applies"), F.sum(absent.cast("long")).alias("_absent"), F.sum(F.coalesce(infinite, F.lit(False)).cast("long")).alias("_inf"), F.sum((x < low).cast("long")).alias("_low"), F.sum(((x > high) & ~infinite & ~F.isnan(x)).cast("long")).alias("_high"))
    total = groups.agg(F.coalesce(F.sum("_applies"), F.lit(0)).alias("rows"), F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("dup"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c[1:]) for c in ("_absent", "_inf", "_low", "_high")))
    ratio = F.coalesce(F.try_divide("absent", "rows"), F.lit(0.0))
    issue = lambda code, severity, n, when: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(field).alias("field"), n.alias("n")))
    issues = [
        issue("duplicate_timestamp_security", "error", F.col("dup"), F.col("dup") > 0),
        issue("excessive_missing_values", "error", F.col("absent"), ratio > error_missing),
        issue("missing_values", "warning", F.col("absent"), (ratio > warn_missing) & (ratio <= error_missing)),
        issue("infinite_numeric_value", "error", F.col("inf"), F.col("inf") > 0),
        issue("value_below_minimum", "error", F.col("low"), F.col("low") > 0),
        issue("value_above_maximum", "error", F.col("high"), F.col("high") > 0),
    ]
    return total.select(F.inline(F.filter(F.array(*issues), lambda i: i.isNotNull())))


def mask_lookup(grid: DataFrame, mask: DataFrame, on: list[str], flag: str) -> DataFrame:
    """Exact-date lookup of a boolean; what is missing is false."""
    return grid.join(mask.select(*on, flag), on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def ancestors(edges: DataFrame, child: str = "child", parent: str = "parent", of: DataFrame | None = None) -> DataFrame:
    """(node, ancestor) of the nodes in ``of`` (its first column; None: all) in a lineage graph of any depth. Paths that meet again, and cycles, are one row each.

    A round climbs one edge from the pairs that the last round found, and keeps what no earlier round has, so only new pairs are joined, and only from the nodes that are asked for.
    """
    links = edges.select(F.col(child).alias("_c"), F.col(parent).alias("_p")).where("_c is not null and _p is not null").distinct()
    links = saved(links)
    first = links if of is None else links.join(of.select(F.col(of.columns[0]).alias("_c")).distinct(), "_c", "left_semi")
    fresh = saved(first.select(F.col("_c").alias("node"), F.col("_p").alias("ancestor")))
    known = fresh
    while fresh.limit(1).count():
        up = fresh.join(links, F.col("ancestor") == F.col("_c")).select("node", F.col("_p").alias("ancestor")).distinct()
        fresh = saved(up.join(known, ["node", "ancestor"], "left_anti"))
        known = known.unionByName(fresh)
    return known


def closing_edges(edges: DataFrame, new: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """``new`` edges with ``closes``: whether each by itself would close a cycle in the graph of ``edges``, as its child is its parent or above it. Only what is above the new parents is visited; an edge with a null end closes none."""
    above = ancestors(edges, child, parent, of=new.where(F.col(parent).isNotNull()).select(parent)).select(F.col("node").alias(parent), F.col("ancestor").alias(child), F.lit(True).alias("_met"))
    met = F.coalesce("_met", F.col(child) == F.col(parent), F.lit(False))
    return new.join(above, [child, parent], "left").select(*new.columns, met.alias("closes"))


def lineage_depth(nodes: DataFrame, edges: DataFrame, key: str = "node", child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, depth, status): 0 for nodes without a parent, else 1 more than the deepest parent. ``missing_parent``: a parent is unknown or has no depth; ``cycle``: what never gets one.

    A round passes on only the nodes that the last one settled: their children count arrived parents, and are settled once all have arrived. What lies below a missing parent spreads in the same way.
    """
    known = saved(nodes.select(F.col(key).alias("node")).distinct())
    links = saved(edges.select(F.col(child).alias("node"), F.col(parent).alias("_p")))
    needed = saved(links.groupBy("node").agg(F.count("*").alias("_n")).join(known, "node", "left_semi"))
    fresh = saved(known.join(needed, "node", "left_anti").select("node", F.lit(0).alias("depth")))
    depth, arrived = fresh, None
    while fresh.limit(1).count():
        came = saved(links.join(fresh.withColumnRenamed("node", "_p"), "_p").groupBy("node").agg(F.count("*").alias("_n"), F.max("depth").alias("_top")))
        arrived = came if arrived is None else arrived.unionByName(came)
        touched = arrived.join(came.select("node"), "node", "left_semi").groupBy("node").agg(F.sum("_n").alias("_n"), (F.max("_top") + 1).alias("depth"))
        fresh = saved(touched.join(needed, ["node", "_n"]).select("node", "depth"))
        depth = depth.unionByName(fresh)
    lost = saved(links.join(known, F.col("_p") == known["node"], "left_anti").select("node").distinct())
    fresh = lost
    while fresh.limit(1).count():
        fresh = saved(links.join(fresh.withColumnRenamed("node", "_p"), "_p", "left_semi").select("node").distinct().join(lost, "node", "left_anti"))
        lost = lost.unionByName(fresh)
    status = F.when(F.col("depth").isNotNull(), "ok").when(F.col("_lost"), "missing_parent").otherwise("cycle")
    return known.join(depth, "node", "left").join(lost.withColumn("_lost", F.lit(True)), "node", "left").select("node", "depth", status.alias("status"))
