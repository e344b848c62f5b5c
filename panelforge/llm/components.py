"""Distributed connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import join_one, written


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component) for every id of an edge; ``component`` is the smallest id that can be reached.

    Each round hooks every node to its smallest neighbour, follows those pointers to their
    end by doubling, and contracts the edges to the remaining roots. At least the nodes that
    aren't local minima go in a round, so rounds grow with the logarithm of a component's size.
    A hub costs no more than its edges: minima are pre-aggregated before the shuffle,
    joins bring one row for each node, and a hub's edges aren't dealt to one task. Loops, repeated edges and null ends are ignored;
    no edges give no rows. Each round is a written table, so lost executors cost no lineage.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    live = written(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "edges")
    hops = []
    while live.count():
        ends = live.select(F.col("a").alias("u"), F.col("b").alias("v")).union(live.select("b", "a"))
        parent = written(ends.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")), "parents")
        moved = True
        while moved:
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            up2 = parent.select(F.col("u").alias("pp"), F.col("p").alias("p3"))
            jumped = join_one(join_one(parent, up, "p"), up2, "pp").select("u", F.col("p3").alias("p"), (F.col("p3") != F.col("p")).alias("moved"))
            jumped = written(jumped, "parents")
            moved = bool(jumped.where("moved").limit(1).count())
            parent = jumped.select("u", "p")
        hops.append(parent)
        pa = parent.select(F.col("u").alias("a"), F.col("p").alias("ra"))
        pb = parent.select(F.col("u").alias("b"), F.col("p").alias("rb"))
        joined = join_one(join_one(live, pa, "a"), pb, "b")
        live = written(joined.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a < b").distinct(), "edges")
    if not hops:
        return live.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = hops[0].select(F.col("u").alias("id"), F.col("p").alias("component"))
    for hop in hops[1:]:
        step = hop.select(F.col("u").alias("component"), F.col("p").alias("_next"))
        out = join_one(out, step, "component", left=True).select("id", F.coalesce("_next", "component").alias("component"))
    return out
