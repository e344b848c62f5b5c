"""What becomes of candidates: lifecycle, registration, coarse feedback, resolved roles, and the clean universe that they are tested in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.sources.shared import saved

#: Fixed lifecycle of a factor: each state and those that may follow it.
LIFECYCLE = {"registered": ("validated", "rejected", "deprecated"), "validated": ("deprecated",), "rejected": ("deprecated",), "deprecated": ()}

#: Fixed names of failures, by the reason that is told.
RESEARCH_FAILURES = {
    "weak_signal": ("raw_full_ic_below_minimum", "neutral_full_ic_below_minimum", "neutral_primary_test_bh_q_above_maximum"),
    "sign_instability": (
        "raw_2020_ic_not_positive", "raw_2021_ic_not_positive", "neutral_2020_ic_not_positive", "neutral_2021_ic_not_positive", "too_few_positive_neutral_half_years",
        "worst_neutral_half_year_below_minimum", "raw_positive_week_ratio_below_minimum", "neutral_positive_week_ratio_below_minimum",
    ),
    "excess_turnover": ("turnover_above_maximum", "one_way_weekly_turnover_above_maximum", "excess_turnover"),
    "cost_failure": ("net_20bp_spread_below_minimum", "net_cost_spread_below_minimum", "cost_failure"),
    "coverage_failure": ("coverage_below_minimum", "neutral_coverage_below_minimum", "coverage_failure"),
    "non_monotonic": ("non_monotonic", "quantile_monotonicity_below_minimum"),
    "redundant_signal": ("redundant_signal", "signal_correlation_above_maximum", "family_quota_exceeded"),
}
EXPRESSION_FAILURES = ("invalid_expression", "dsl_validation_failed", "unsupported_operator", "future_field_detected")
REPAIRABLE = ("excess_turnover", "cost_failure", "coverage_failure", "non_monotonic")


def lifecycle(events: DataFrame, allowed: dict[str, tuple[str, ...]] = LIFECYCLE, first: str = "registered", key: str = "factor", seq: str = "seq", state: str = "state") -> DataFrame:
    """(key, seq, state, accepted): where each history stands when events that may not follow the accepted one before are refused.

    A history starts at its first event in state ``first``; keys without one are left out. As ``allowed`` has no cycles, each round
    of one aggregation by key accepts one event more, and there are fewer rounds than states, however long histories are.
    """
    now = events.where(F.col(state) == first).groupBy(key).agg(F.min(seq).alias("_at"), F.lit(first).alias("_state"), F.lit(1).alias("accepted"))
    may = lambda was, then: reduce(lambda a, b: a | b, [(was == s) & then.isin(*to) for s, to in allowed.items() if to])
    for _ in range(len(allowed) - 1):
        now = saved(now)
        later = events.select(key, F.col(seq).alias("_seq"), F.col(state).alias("_then")).join(now, key).where((F.col("_seq") > F.col("_at")) & may(F.col("_state"), F.col("_then")))
        step = later.groupBy(key).agg(F.min("_seq").alias("_next"), F.min_by("_then", "_seq").alias("_to"))
        moved = F.col("_next").isNotNull()
        now = now.join(step, key, "left").select(key, F.coalesce("_next", "_at").alias("_at"), F.coalesce("_to", "_state").alias("_state"), (F.col("accepted") + moved.cast("int")).alias("accepted"))
    return now.select(key, F.col("_at").alias(seq), F.col("_state").alias(state), "accepted")


def registrable(definitions: DataFrame, key: str, version: str, body: str, seq: str) -> DataFrame:
    """Adds ``status``: a registry only grows, so of equal bodies, and of equal (key, version), the first by ``seq`` is ``registered``; the others are
    ``duplicate_definition`` or ``duplicate_version``."""
    seen = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(seq)) > 1
    marked = definitions.withColumn("_body", F.sha2(F.col(body).cast("string"), 256)).withColumn("_again", seen("_body")).withColumn("_taken", seen(key, version))
    return marked.withColumn("status", F.when(F.col("_again"), "duplicate_definition").when(F.col("_taken"), "duplicate_version").otherwise("registered")).drop("_body", "_again", "_taken")


def feedback(decisions: DataFrame, technical: str = "technical_pass", technical_failures: str = "technical_failures", research: str = "research_pass", research_failures: str = "research_failures") -> DataFrame:
    """Adds ``reasons`` and ``disposition``: names of failed gates become a closed list of coarse reasons in a fixed order, so nothing else about a test is told.

    A null list holds no failures, and a null pass is a failure.
    """
    of = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    names = lambda xs: F.array(*map(F.lit, xs))
    passed, good, why, broken = F.coalesce(F.col(technical), F.lit(False)), F.coalesce(F.col(research), F.lit(False)), of(research_failures), of(technical_failures)
    failed = ~passed
    weighed = passed & ~good
    known = names([x for xs in RESEARCH_FAILURES.values() for x in xs])
    hit: dict[str, Column] = {reason: F.arrays_overlap(why, names(xs)) for reason, xs in RESEARCH_FAILURES.items()}
    told = [
        ("local_gate_pass", passed & good),
        ("weak_signal", weighed & (hit["weak_signal"] | (F.size(F.array_except(why, known)) > 0) | (F.size(why) == 0))),
        ("sign_instability", weighed & hit["sign_instability"]),
        ("regime_instability", weighed & hit["sign_instability"]),
        *((reason, weighed & hit[reason]) for reason in ("excess_turnover", "cost_failure", "coverage_failure", "non_monotonic", "redundant_signal")),
        ("invalid_expression", failed & F.arrays_overlap(broken, names(EXPRESSION_FAILURES))),
        ("data_contract_failure", failed & ((F.size(F.array_except(broken, names(EXPRESSION_FAILURES))) > 0) | (F.size(broken) == 0))),
    ]
    reasons = F.filter(F.array(*(F.when(F.coalesce(when, F.lit(False)), F.lit(reason)) for reason, when in told)), lambda r: r.isNotNull())
    has = lambda r: F.array_contains("reasons", r)
    fate = F.when(failed, "technical_reject").when(good, "promote").when(has("redundant_signal"), "diversify")
    fate = fate.when(F.arrays_overlap("reasons", names(REPAIRABLE)) & ~has("sign_instability"), "repair").otherwise("retire")
    return decisions.withColumn("reasons", reasons).withColumn("disposition", fate)


def resolve_roles(bindings: DataFrame, components: DataFrame, owner: str, role: str, component: str) -> DataFrame:
    """Each binding (owner, role, component) with its component's columns. A component that isn't known, and a role that an owner binds twice, are errors when rows are read."""
    times = F.count("*").over(W.partitionBy(owner, role))
    what = F.concat_ws(":", F.col(owner).cast("string"), F.col(role).cast("string"))
    joined = bindings.withColumn("_times", times).join(components.withColumn("_known", F.lit(True)), component, "left")
    sound = F.when(F.col("_times") > 1, F.raise_error(F.concat(F.lit("role_bound_twice:"), what))).when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown_component:"), what)))
    return joined.withColumn(role, F.coalesce(sound.cast("string"), F.col(role).cast("string"))).drop("_times", "_known")


def aligned_mask(targets: DataFrame, mask: DataFrame, flag: str, time: str = "timestamp", security: str = "security") -> DataFrame:
    """Adds ``flag`` as of each target's time: the row of the mask's last date at or before it. What that date doesn't list, and what lies before the first date, is false.

    Dates are looked up on the session axis, which is far smaller than the panel; cells are joined by equality.
    """
    days = targets.select(F.col(time).alias("_t"), F.lit(None).cast(mask.schema[time].dataType).alias("_since")).distinct()
    axis = days.unionByName(mask.select(F.col(time).alias("_t"), F.col(time).alias("_since")).distinct())
    past = axis.withColumn("_since", F.max("_since").over(W.orderBy("_t").rangeBetween(W.unboundedPreceding, 0))).select(F.col("_t").alias(time), "_since").distinct()
    cells = mask.groupBy(F.col(time).alias("_since"), security).agg(F.max(F.coalesce(flag, F.lit(False))).alias(flag))
    return targets.drop(flag).join(past, time, "left").join(cells, ["_since", security], "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop("_since")


def clean_universe(targets: DataFrame, master: DataFrame, fast: DataFrame, time: str = "timestamp", security: str = "security", flag: str = "eligible") -> DataFrame:
    """Targets (distinct cells) with ``eligible``: in both masks as of their time. Each mask is (time, security, flag)."""
    one = aligned_mask(targets.withColumnRenamed(flag, "_old") if flag in targets.columns else targets, master, flag, time, security).withColumnRenamed(flag, "_master")
    both = aligned_mask(one, fast, flag, time, security)
    return both.withColumn(flag, F.col(flag) & F.col("_master")).drop("_master", "_old")


def universe_audit(universe: DataFrame, master: DataFrame, fast: DataFrame, time: str = "timestamp", security: str = "security", flag: str = "eligible", index_prefix: str = "399") -> DataFrame:
    """One row of counts of a ``clean_universe``: its axes and cells, both masks' axes, how many securities each lists, and which are never eligible."""
    ever = universe.groupBy(security).agg(F.max(flag).alias("_ever"), F.count("*").alias("_n"), F.count_if(flag).alias("_ok"))
    listed = lambda df, name: df.select(security).distinct().withColumn(name, F.lit(True))
    marked = ever.join(listed(master, "_m"), security, "left").join(listed(fast, "_f"), security, "left")
    index = F.col(security).cast("string").startswith(index_prefix)
    cells = marked.agg(
        F.count("*").alias("securities"), F.count("_m").alias("in_master"), F.count("_f").alias("in_fast"), F.count_if(F.col("_m") & F.col("_f")).alias("in_both"),
        F.count_if("_ever").alias("ever_eligible"), F.count_if(~F.col("_ever")).alias("excluded"), F.count_if(~F.col("_ever") & index).alias("excluded_index"),
        F.coalesce(F.sum("_ok"), F.lit(0)).alias("eligible_cells"), F.coalesce(F.sum("_n"), F.lit(0)).alias("cells"),
    )
    axes = [df.agg(F.countDistinct(time).alias(f"{name}_dates"), F.countDistinct(security).alias(f"{name}_securities"), F.min(time).alias(f"_{name}_first")) for df, name in ((master, "master"), (fast, "fast"))]
    first = reduce(DataFrame.crossJoin, axes)  # one row each
    days = universe.select(time).distinct().crossJoin(F.broadcast(first.select("_master_first", "_fast_first")))
    before = days.agg(F.count("*").alias("dates"), *(F.count_if(F.col(time) < F.col(f"_{n}_first")).alias(f"dates_before_{n}") for n in ("master", "fast")))
    return cells.crossJoin(before).crossJoin(first.drop("_master_first", "_fast_first")).withColumn("unmapped", F.col("securities") - F.col("in_both"))
