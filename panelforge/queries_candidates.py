"""Registered queries of candidates' lifecycle, feedback and roles, of the clean universe, and of the made-up panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import candidates
from panelforge.queries import QUERIES, query
from panelforge.sources.panels import PANEL_SQL, supplier_month, table

#: Users' events as histories of factors.
STATE_SQL = "SELECT user_id AS factor, event_id AS seq, CASE event_type WHEN 'signup' THEN 'registered' WHEN 'purchase' THEN 'validated' WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'deprecated' ELSE 'unknown' END AS state FROM events"


@query(
    "k12_lifecycle",
    f"""WITH e AS ({STATE_SQL}), a AS (SELECT factor, min(seq) AS seq FROM e WHERE state = 'registered' GROUP BY 1),
    b AS (SELECT a.factor, min_by(e.state, e.seq) AS state, min(e.seq) AS seq FROM a JOIN e ON e.factor = a.factor AND e.seq > a.seq AND e.state IN ('validated', 'rejected', 'deprecated') GROUP BY 1),
    c AS (SELECT b.factor, min(e.seq) AS seq FROM b JOIN e ON e.factor = b.factor AND e.seq > b.seq AND e.state = 'deprecated' WHERE b.state != 'deprecated' GROUP BY 1)
    SELECT a.factor, coalesce(c.seq, b.seq, a.seq) AS seq, CASE WHEN c.seq IS NOT NULL THEN 'deprecated' ELSE coalesce(b.state, 'registered') END AS state, 1 + (b.seq IS NOT NULL)::INT + (c.seq IS NOT NULL)::INT AS accepted
    FROM a LEFT JOIN b ON b.factor = a.factor LEFT JOIN c ON c.factor = a.factor""",
)
def _lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    state = F.expr("CASE event_type WHEN 'signup' THEN 'registered' WHEN 'purchase' THEN 'validated' WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'deprecated' ELSE 'unknown' END")
    return candidates.lifecycle(table(spark, sf, "events").select(F.col("user_id").alias("factor"), F.col("event_id").alias("seq"), state.alias("state")))


@query(
    "k12_registrable",
    """WITH m AS (SELECT event_id, row_number() OVER (PARTITION BY props, event_type ORDER BY event_id) > 1 AS again, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS taken FROM events)
    SELECT event_id, CASE WHEN again THEN 'duplicate_definition' WHEN taken THEN 'duplicate_version' ELSE 'registered' END AS status FROM m""",
)
def _registrable(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("body", F.concat_ws("|", "event_type", "props"))
    return candidates.registrable(e, "user_id", "event_type", "body", "event_id").select("event_id", "status")


#: Which failures an order's decision carries, by the remainders of its key.
FAILURES = ("raw_full_ic_below_minimum", "raw_2020_ic_not_positive", "excess_turnover", "cost_failure", "coverage_below_minimum", "non_monotonic", "family_quota_exceeded", "something_new")
_LISTED = ", ".join(f"'{x}'" for x in FAILURES)


@query(
    "k9_feedback",
    f"""WITH d AS (SELECT o_orderkey, o_orderstatus != 'P' AS tech, o_totalprice > 250000 AS good, CASE WHEN o_orderkey % 4 = 0 THEN [] WHEN o_orderkey % 4 = 1 THEN ['invalid_expression'] WHEN o_orderkey % 4 = 2 THEN ['late_data'] ELSE ['future_field_detected', 'late_data'] END AS broken,
        CASE WHEN o_orderkey % 7 = 0 THEN [] ELSE [([{_LISTED}])[1 + o_orderkey % 8], ([{_LISTED}])[1 + o_custkey % 8]] END AS why FROM orders),
    h AS (SELECT *, NOT tech AS failed, tech AND NOT good AS weighed FROM d),
    r AS (SELECT *, list_filter([
        CASE WHEN tech AND good THEN 'local_gate_pass' END,
        CASE WHEN weighed AND (list_contains(why, 'raw_full_ic_below_minimum') OR list_contains(why, 'something_new') OR len(why) = 0) THEN 'weak_signal' END,
        CASE WHEN weighed AND list_contains(why, 'raw_2020_ic_not_positive') THEN 'sign_instability' END, CASE WHEN weighed AND list_contains(why, 'raw_2020_ic_not_positive') THEN 'regime_instability' END,
        CASE WHEN weighed AND list_contains(why, 'excess_turnover') THEN 'excess_turnover' END, CASE WHEN weighed AND list_contains(why, 'cost_failure') THEN 'cost_failure' END,
        CASE WHEN weighed AND list_contains(why, 'coverage_below_minimum') THEN 'coverage_failure' END, CASE WHEN weighed AND list_contains(why, 'non_monotonic') THEN 'non_monotonic' END,
        CASE WHEN weighed AND list_contains(why, 'family_quota_exceeded') THEN 'redundant_signal' END,
        CASE WHEN failed AND o_orderkey % 4 IN (1, 3) THEN 'invalid_expression' END, CASE WHEN failed AND o_orderkey % 4 != 1 THEN 'data_contract_failure' END], lambda x: x IS NOT NULL) AS reasons FROM h)
    SELECT o_orderkey, array_to_string(reasons, ',') AS reasons, CASE WHEN failed THEN 'technical_reject' WHEN good THEN 'promote' WHEN list_contains(reasons, 'redundant_signal') THEN 'diversify'
        WHEN list_has_any(reasons, ['excess_turnover', 'cost_failure', 'coverage_failure', 'non_monotonic']) AND NOT list_contains(reasons, 'sign_instability') THEN 'repair' ELSE 'retire' END AS disposition FROM r""",
)
def _feedback(spark: SparkSession, sf: str) -> DataFrame:
    broken = F.expr("CASE o_orderkey % 4 WHEN 0 THEN cast(array() as array<string>) WHEN 1 THEN array('invalid_expression') WHEN 2 THEN array('late_data') ELSE array('future_field_detected', 'late_data') END")
    why = F.expr(f"CASE WHEN o_orderkey % 7 = 0 THEN cast(array() as array<string>) ELSE array(element_at(array({_LISTED}), cast(1 + o_orderkey % 8 as int)), element_at(array({_LISTED}), cast(1 + o_custkey % 8 as int))) END")
    d = table(spark, sf, "orders").select("o_orderkey", F.expr("o_orderstatus != 'P'").alias("technical_pass"), broken.alias("technical_failures"), F.expr("o_totalprice > 250000").alias("research_pass"), why.alias("research_failures"))
    return candidates.feedback(d).select("o_orderkey", F.concat_ws(",", "reasons").alias("reasons"), "disposition")


@query("e15_roles", "SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS role, l_suppkey, s_name FROM (SELECT l_orderkey, l_linenumber, any_value(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1) JOIN supplier ON s_suppkey = l_suppkey")
def _roles(spark: SparkSession, sf: str) -> DataFrame:
    """Each line of an order is a role that one supplier fills; lines that the table lists twice are left to the error."""
    once = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("role")).agg(F.first("l_suppkey").alias("l_suppkey"), F.count("*").alias("n")).where("n = 1").drop("n")
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return candidates.resolve_roles(once, names, "l_orderkey", "role", "l_suppkey").select("l_orderkey", "role", "l_suppkey", "s_name")


def _universe(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells of the panel, a quarterly list of large suppliers and one of risen ones every second month from 1993 on."""
    panel = supplier_month(spark, sf)
    master = panel.where("month(timestamp) % 3 = 1 and volume is not null and security % 5 != 0").select("timestamp", "security", (F.col("volume") > 60).alias("eligible"))
    fast = panel.where("month(timestamp) % 2 = 0 and year(timestamp) >= 1993 and returns is not null").select("timestamp", "security", (F.col("returns") > -0.05).alias("eligible"))
    return panel.select("timestamp", "security"), master, fast


UNIVERSE_SQL = f"""{PANEL_SQL}, m AS (SELECT ts, security, volume > 60 AS ok FROM g WHERE month(ts) % 3 = 1 AND volume IS NOT NULL AND security % 5 != 0), f AS (SELECT ts, security, returns > -0.05 AS ok FROM g WHERE month(ts) % 2 = 0 AND year(ts) >= 1993 AND returns IS NOT NULL),
    t AS (SELECT ts, (SELECT max(m.ts) FROM m WHERE m.ts <= x.ts) AS mt, (SELECT max(f.ts) FROM f WHERE f.ts <= x.ts) AS ft FROM (SELECT DISTINCT ts FROM g) x),
    u AS (SELECT g.ts, g.security, coalesce(m.ok, false) AND coalesce(f.ok, false) AS eligible FROM g JOIN t ON t.ts = g.ts LEFT JOIN m ON m.ts = t.mt AND m.security = g.security LEFT JOIN f ON f.ts = t.ft AND f.security = g.security)"""


@query("i13_universe", f"{UNIVERSE_SQL} SELECT * FROM u")
def _clean(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.clean_universe(*_universe(spark, sf)).select(F.col("timestamp").cast("date").alias("ts"), "security", "eligible")


@query(
    "i13_audit",
    f"""{UNIVERSE_SQL}, s AS (SELECT security, bool_or(eligible) AS ever, security IN (SELECT security FROM m) AS im, security IN (SELECT security FROM f) AS if_ FROM u GROUP BY 1)
    SELECT (SELECT count(*) FROM s) AS securities, (SELECT count_if(im) FROM s) AS in_master, (SELECT count_if(if_) FROM s) AS in_fast, (SELECT count_if(im AND if_) FROM s) AS in_both, (SELECT count_if(NOT (im AND if_)) FROM s) AS unmapped,
    (SELECT count_if(ever) FROM s) AS ever_eligible, (SELECT count_if(NOT ever) FROM s) AS excluded, (SELECT count_if(NOT ever AND starts_with(security::VARCHAR, '399')) FROM s) AS excluded_index, (SELECT count_if(eligible) FROM u) AS eligible_cells, (SELECT count(*) FROM u) AS cells,
    (SELECT count(*) FROM t) AS dates, (SELECT count_if(mt IS NULL) FROM t) AS dates_before_master, (SELECT count_if(ft IS NULL) FROM t) AS dates_before_fast,
    (SELECT count(DISTINCT ts) FROM m) AS master_dates, (SELECT count(DISTINCT security) FROM m) AS master_securities, (SELECT count(DISTINCT ts) FROM f) AS fast_dates, (SELECT count(DISTINCT security) FROM f) AS fast_securities""",
)
def _universe_audit(spark: SparkSession, sf: str) -> DataFrame:
    targets, master, fast = _universe(spark, sf)
    return candidates.universe_audit(candidates.clean_universe(targets, master, fast), master, fast)
