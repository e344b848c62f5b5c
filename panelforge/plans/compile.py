"""From formulas to one staged DataFrame plan.

Every rolling or cross-sectional node becomes a column of its own, named by its canonical form, so equal nodes of one or many
formulas are computed once and guards never repeat their child. Nodes of one depth and one partitioning are
added together, so Spark computes them in a shared sort and shuffle.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions import stats
from panelforge.plans import dsl

TIME, SECURITY = "timestamp", "security"


class Compiler:
    """``hist`` masks fields and IfElse, ``xs`` masks CsRank on both sides; both are names of boolean columns or None."""

    def __init__(self, view: DataFrame, hist: str | None = None, xs: str | None = None):
        self.df, self.hist, self.xs = view, hist, xs
        self.stage: dict[str, str] = {}

    def _masked(self, x: Column, mask: str | None) -> Column:
        return x if mask is None else F.when(F.col(mask), x)

    def _column(self, key: str, make) -> str:
        if key not in self.stage:
            made = make()  # adds the columns below first
            name = f"_n{len(self.stage)}"
            self.df = self.df.withColumn(name, made)
            self.stage[key] = name
        return self.stage[key]

    def value(self, node: ast.expr) -> Column:
        """The node as a Column over the current plan, booleans as they are."""
        if isinstance(node, ast.Constant):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            return self._masked(F.col(node.id).cast("double"), self.hist)
        name = node.func.id  # type: ignore[attr-defined]
        args = node.args  # type: ignore[attr-defined]
        if name.startswith("Ts"):
            return F.col(self._column(dsl.canonical(node), lambda: self._rolling(name, args)))
        if name == "CsRank":
            child = F.col(self._held(args[0]))
            return F.col(self._column(dsl.canonical(node), lambda: stats.percent_rank(child, TIME, among=None if self.xs is None else F.col(self.xs))))
        x = [self.number(a) for a in args] if name not in ("IfElse",) else [self.value(args[0]), self.number(args[1]), self.number(args[2])]
        match name:
            case "Add":
                return x[0] + x[1]
            case "Sub":
                return x[0] - x[1]
            case "Mul":
                return x[0] * x[1]
            case "Div":
                return x[0] / F.when(F.abs(x[1]) > 1e-12, x[1])
            case "Neg":
                return -x[0]
            case "Greater":
                return F.coalesce(x[0] > x[1], F.lit(False))
            case "Less":
                return F.coalesce(x[0] < x[1], F.lit(False))
            case "IfElse":
                return self._masked(F.when(x[0].cast("boolean"), x[1]).otherwise(x[2]), self.hist)
        raise dsl.FormulaError([f"operator_not_registered:{name}"])

    def number(self, node: ast.expr) -> Column:
        return self.value(node).cast("double")

    def _held(self, node: ast.expr) -> str:
        return self._column("=" + dsl.canonical(node), lambda made=self.number(node): made)

    def _rolling(self, name: str, args: list[ast.expr]) -> Column:
        by = W.partitionBy(SECURITY).orderBy(TIME)
        last = args[dsl.OPERATORS.get(name, dsl.EXTENSIONS.get(name, (0, 1)))[1] or 1]
        n = int(last.value)  # type: ignore[attr-defined]
        x = F.col(self._held(args[0]))
        w = by.rowsBetween(-(n - 1), 0)
        full = F.count(x).over(w) == n
        match name:
            case "TsMean":
                return F.when(full, F.avg(x).over(w))
            case "TsStd":
                return F.when(full, F.stddev_samp(x).over(w)) if n > 1 else F.lit(None).cast("double")
            case "TsDelta":
                return x - F.lag(x, n).over(by)
            case "TsDelay":
                return F.lag(x, n).over(by)
            case "TsRank":
                seen = F.collect_list(x).over(w)
                below, same = F.size(F.filter(seen, lambda v: v < x)), F.size(F.filter(seen, lambda v: v == x))
                return F.when(full, (below + (same + 1) / 2) / n)
            case "TsCorr":
                y = F.col(self._held(args[1]))
                both = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).over(w) == n
                return F.when(both, stats.safe_corr(x, y, w))
            case "TsAutoCorr":
                lagged = F.col(self._column(f"lag{int(args[2].value)}(" + dsl.canonical(args[0]) + ")", lambda: F.lag(x, int(args[2].value)).over(by)))  # type: ignore[attr-defined]
                both = F.count(F.when(x.isNotNull() & lagged.isNotNull(), 1)).over(w) == n
                return F.when(both, stats.safe_corr(x, lagged, w))
            case "TsSkew":
                return F.when(full, stats.sample_skew(x, w))
            case "TsKurt":
                return F.when(full, stats.sample_kurt(x, w))
        raise dsl.FormulaError([f"operator_not_registered:{name}"])


def compile_formulas(view: DataFrame, formulas: dict[str, str], fields: set[str], hist: str | None = None, xs: str | None = None, budget: dsl.Budget = dsl.Budget(), extended: bool = False) -> DataFrame:
    """``view`` (a dense grid of timestamp and security) with a double column for each formula; equal parts of formulas are shared."""
    c = Compiler(view, hist, xs)
    for name, text in formulas.items():
        node = dsl.parse(text, fields, budget, extended)
        made = c.number(node)
        c.df = c.df.withColumn(name, c._masked(made, xs))
    return c.df.select(*view.columns, *formulas)
