"""A factor from its declaration: formula, daily aggregation, preprocessing, direction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.stats import finite
from panelforge.operators import postprocess
from panelforge.plans import dsl
from panelforge.plans.compile import compile_formulas


@dataclass(frozen=True)
class FactorSpec:
    """``steps``: any of ("winsorize", low, high), ("zscore",), ("neutralize", exposure), ("ewm", span), in the order in which they are applied. ``fields``: exactly the
    columns that the formula and the exposures read. ``daily``: (clock window, reducer). ``direction``: 1 or -1, applied when the factor is evaluated."""

    formula: str
    fields: frozenset[str]
    steps: tuple[tuple, ...] = ()
    daily: tuple[str, str] | None = None
    direction: int = 1


def check(spec: FactorSpec) -> None:
    exposures = {s[1] for s in spec.steps if s[0] == "neutralize"}
    if exposures and spec.daily:
        raise ValueError("neutralize_after_aggregation")
    if spec.direction not in (1, -1):
        raise ValueError("direction_not_signed")
    if why := dsl.reasons_against(spec.formula, set(spec.fields)):
        raise ValueError(";".join(why))
    for name in spec.fields - exposures:
        if not dsl.reasons_against(spec.formula, set(spec.fields) - {name}):
            raise ValueError(f"required_fields_differ:{name}")


def run(spec: FactorSpec, view: DataFrame, mask: str | None = None) -> DataFrame:
    """(timestamp, security, factor): the formula, then daily aggregation, then the declared steps; after each, cells outside ``mask`` and values that aren't finite are null."""
    check(spec)
    exposures = [s[1] for s in spec.steps if s[0] == "neutralize"]
    inside = F.coalesce(F.col(mask), F.lit(False)) if mask else F.lit(True)
    made = compile_formulas(view, {"factor": spec.formula}, set(spec.fields))
    cut = lambda df: df.withColumn("factor", F.when(inside, finite(F.col("factor").cast("double"))))
    out = cut(made.select("timestamp", "security", "factor", *dict.fromkeys([*exposures, *([mask] if mask else [])])))
    if spec.daily:
        out, inside = postprocess.daily(out.where(inside), "factor", *spec.daily), F.lit(True)
    for name, *args in spec.steps:
        if name == "ewm":
            out = cut(postprocess.ewm(out, "factor", *args).withColumn("factor", F.col("ewm")).drop("ewm"))
        else:
            out = cut({"winsorize": postprocess.winsorize, "zscore": postprocess.zscore, "neutralize": postprocess.neutralize}[name](out, "factor", *args))
    return out.select("timestamp", "security", "factor")


def directed(df: DataFrame, spec: FactorSpec, col: str = "factor") -> DataFrame:
    return df.withColumn(col, F.col(col) * spec.direction)
