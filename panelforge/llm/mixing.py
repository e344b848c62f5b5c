"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

Leaves are (domain, language, source) groups. A token budget flows down the tree by weights.
A leaf can give at most its tokens times ``max_epochs``; what a node can't fill is offered to its
siblings first, in proportion to their budgets, and only what the siblings can't take goes to the
parent's siblings. A leaf's tokens are a prefix of its seeded epochs: each epoch orders the
leaf's documents by a hash of seed, epoch and id, whole epochs are taken as they are, and the
last one up to the budget.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_broadcast, written

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class MixSpec:
    """``share``: target tokens as a share of the available ones. ``power``: weight of a node is its tokens to this power among its siblings."""

    share: float = 1.0
    power: float = 0.5
    max_epochs: int = 4
    seed: int = 42


def domain_of(source: Column) -> Column:
    """Sources that end in a number are grouped to five domains by it (its last digit tells it modulo 5); others by their name's first letter."""
    digit = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9])$", 1)
    return F.when(digit != "", F.concat(F.lit("d"), digit.cast("int") % 5)).otherwise(F.substring(F.coalesce(source, F.lit("")), 1, 1))


def n_tokens(text: Column) -> Column:
    """Pieces between single spaces and line ends; 0 for null and empty texts."""
    bare = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return F.when(F.length(text) > 0, F.length(text) - F.length(bare) + 1).otherwise(F.lit(0)).cast("long")


def leaves(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, domain, lang, source, tokens) of each document, and the columns ``keep``."""
    source, lang = F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.col("lang").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of(source).alias("domain"), lang.alias("lang"), source.alias("source"), n_tokens(F.col("text").cast("string")).alias("tokens"), *keep)


def _fill(nodes: DataFrame, parent: list[str], spec: MixSpec) -> DataFrame:
    """Split each parent's ``budget`` among its children by ``weight``, none over its ``cap``; what is cut off goes to siblings with room.

    Children fill up in the order of cap / weight, so one pass finds those that are full: with all
    before a child full, the child is full too if the rest gives it its cap. The others share what is left by weight.
    """
    key = LEVELS[len(parent)]
    every = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    ahead = every.orderBy("ratio", key).rowsBetween(W.unboundedPreceding, -1)
    out = nodes.withColumn("ratio", F.col("cap") / F.col("weight"))
    out = out.withColumn("cap_before", F.coalesce(F.sum("cap").over(ahead), F.lit(0))).withColumn("room", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0)))
    out = out.withColumn("full", F.col("cap_before") + F.col("ratio") * F.col("room") <= F.col("budget"))
    used, open_weight = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every), F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).over(every)
    return out.withColumn("given", F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("budget") - used) * F.col("weight") / open_weight))


def budgets(stats: DataFrame, spec: MixSpec) -> DataFrame:
    """(domain, lang, source, tokens, budget): ``stats`` has a row for each leaf (bounded by the tree, not by the documents)."""
    cap = F.col("tokens") * spec.max_epochs
    total = stats.agg((F.sum("tokens") * F.lit(spec.share)).alias("budget"))
    level = total
    for depth in range(1, len(LEVELS) + 1):
        keys, parent = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        nodes = stats.groupBy(*keys).agg(F.sum("tokens").alias("tokens")).withColumn("cap", cap).withColumn("weight", F.pow(F.col("tokens").cast("double"), F.lit(spec.power)))
        above = level.select(*parent, "budget")
        nodes = nodes.join(above, parent) if parent else nodes.crossJoin(above)  # ``above`` is one row at the root
        level = _fill(nodes, parent, spec).select(*keys, "tokens", F.col("given").alias("budget"))
    return level.select(*LEVELS, "tokens", F.floor(F.col("budget") + 0.5).cast("long").alias("budget"))


def mix(docs: DataFrame, spec: MixSpec = MixSpec(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, tokens), and the columns ``keep`` of ``docs``: one row for each time a document is taken.

    The document that reaches its leaf's budget is taken whole and ends the prefix. Null languages and sources are a leaf of
    their own (empty names); documents without tokens, and empty tables, give nothing. Repeated rows count as often as they stand.
    Order within an epoch: md5 of "seed:epoch:doc_id", then id, then ``keep``. The budget's end is found by sums over 256 ranges of that hash, then over
    256 parts of the range it falls in, and only the rows of that part are put in order, so a leaf with a third of all rows isn't one task's work.
    """
    rows = written(leaves(docs, keep).where("tokens > 0"), "leaf-rows")
    stats = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = written(budgets(written(stats, "leaves"), spec).where("budget > 0").select(*LEVELS, "budget", F.col("tokens").alias("leaf_tokens")).coalesce(1), "budgets")
    epochs = F.sequence(F.lit(0), F.floor((F.col("budget") - 1) / F.col("leaf_tokens")).cast("int"))
    taken = rows.join(bounded_broadcast(plan), list(LEVELS)).select("*", F.explode(epochs).alias("epoch"))
    left = F.col("budget") - F.col("epoch") * F.col("leaf_tokens")
    order = F.md5(F.concat_ws(":", F.lit(spec.seed), "epoch", "doc_id").cast("binary"))
    out = ["doc_id", *LEVELS, "epoch", "tokens", *keep]
    full = taken.where(left >= F.col("leaf_tokens")).select(*out)
    cut = taken.where(left < F.col("leaf_tokens")).select(*out, left.alias("left"), order.alias("h"))
    before, inside = _edge(cut, 1)
    edge = written(inside, "edges")
    within, last = _edge(edge, 3)
    ahead = W.partitionBy(*LEVELS).orderBy("h", "doc_id", *keep).rowsBetween(W.unboundedPreceding, -1)
    some = last.withColumn("ahead", F.coalesce(F.sum("tokens").over(ahead), F.lit(0))).where("ahead < left")
    return full.unionByName(before.select(*out)).unionByName(within.select(*out)).unionByName(some.select(*out))


def _edge(rows: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``left`` tokens to go in their leaf, cut by the two digits of ``h`` from ``at`` on: those of the ranges that are taken whole, and
    those of the range in which ``left`` is reached, with what is left there."""
    part = rows.withColumn("part", F.substring("h", at, 2))
    sums = part.groupBy(*LEVELS, "left", "part").agg(F.sum("tokens").alias("n"))
    before = F.sum("n").over(W.partitionBy(*LEVELS).orderBy("part")) - F.col("n")
    ends = sums.withColumn("before", before).where((F.col("before") < F.col("left")) & (F.col("before") + F.col("n") >= F.col("left")))
    ends = written(ends.select(*LEVELS, F.col("part").alias("end"), (F.col("left") - F.col("before")).alias("rest")).coalesce(1), "range-ends")
    met = part.join(bounded_broadcast(ends), list(LEVELS))
    return met.where("part < end"), met.where("part = end").drop("left", "part", "end").withColumnRenamed("rest", "left")
