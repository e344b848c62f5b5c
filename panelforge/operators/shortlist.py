"""From reviews and a frontier to the candidates that go on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import skyline


def panel(proposed: DataFrame, critic: DataFrame, risk: DataFrame, arbiter: DataFrame, n: int, name: str = "candidate_id") -> DataFrame:
    """(candidate, priority): the first ``n`` candidates approved, allowed and selected, by falling priority and id. A risk block can't be overruled."""
    passed = proposed.join(critic.where("decision = 'approve'").select(name), name, "left_semi").join(risk.where("decision = 'allow'").select(name), name, "left_semi")
    chosen = arbiter.where("decision = 'select'").select(name, F.coalesce("priority", F.lit(0)).alias("priority"))
    return passed.select(name).join(chosen, name).orderBy(F.desc("priority"), name).limit(n)


def progressed(new: DataFrame, old: DataFrame, name: str, maximise: list[str], minimise: list[str], epsilon: float = 0.0) -> DataFrame:
    """Members of ``new`` that no member of ``old`` is (by ``name``), equals or dominates within ``epsilon``. A member with a null or NaN objective equals and dominates none."""
    fresh = new.join(old.select(F.col(name).alias("_old_name")), F.col(name) == F.col("_old_name"), "left_anti")
    return skyline.unbeaten(fresh, old, maximise, minimise, epsilon, False)


def diverse(frontier: DataFrame, correlations: DataFrame, campaign: str, name: str, maximise: list[str], minimise: list[str], capacity: int, limit: float) -> DataFrame:
    """(campaign, candidate, place, reason): objectives take turns to pick their best remaining candidate, ties by id.

    It joins the list unless its absolute correlation (``left``, ``right``, ``corr``) with a member is over the limit or isn't known. Those out have no place. A
    campaign's frontier is one group; campaigns run in parallel.
    """
    objectives = [(c, False) for c in maximise] + [(c, True) for c in minimise]

    def run(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        known = {frozenset((a, b)): abs(v) for a, b, v in zip(pairs["left"], pairs["right"], pairs["corr"]) if pd.notna(v)}
        queues = [iter(rows.sort_values([c, name], ascending=[up, True])[name]) for c, up in objectives]
        left, chosen, out = set(rows[name]), [], []
        while left and len(chosen) < capacity:
            for queue in queues:
                pick = next((x for x in queue if x in left), None)
                if pick is None or len(chosen) == capacity:
                    continue
                left.remove(pick)
                found = [known.get(frozenset((pick, c))) for c in chosen]
                bad = next((v for v in found if v is None or v > limit), 0.0)  # the first member it clashes with
                reason = "correlation_missing" if bad is None else "correlation" if bad else "selected"
                if reason == "selected":
                    chosen.append(pick)
                out.append((pick, len(chosen) if reason == "selected" else None, reason))
        out += [(x, None, "capacity") for x in sorted(left)]
        made = pd.DataFrame(out, columns=[name, "place", "reason"]).astype({"place": "Int32"})
        return made.assign(**{campaign: rows[campaign].iloc[0] if len(rows) else None})[[campaign, name, "place", "reason"]]

    kinds = {f.name: f.dataType.simpleString() for f in frontier.schema}
    schema = f"{campaign} {kinds[campaign]}, {name} {kinds[name]}, place int, reason string"
    return frontier.groupBy(campaign).cogroup(correlations.groupBy(campaign)).applyInPandas(run, schema)
