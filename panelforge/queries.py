"""Registered queries of the factor engine and their DuckDB equivalents.

Panels come from the driver's tables (see ``sources.panels``). Values are rounded so that both engines' sums agree.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions import stats
from panelforge.operators import constraints, contract, evaluate, frames, intervals, labels, market, portfolio, postprocess, records, robustness, selection, shortlist
from panelforge.plans.compile import compile_formulas
from panelforge.sources.panels import PANEL_SQL, supplier_month, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FIELDS = {"returns", "close", "amount", "volume"}
W_TS, W_CS = "(PARTITION BY security ORDER BY ts)", "(PARTITION BY ts)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def shown(df: DataFrame, *values: str, digits: int = 8) -> DataFrame:
    return df.select(F.col("timestamp").cast("date").alias("ts"), "security", *(F.round(F.col(v).cast("double"), digits).alias(v) for v in values))


def frame(n: int) -> str:
    return f"(PARTITION BY security ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(x: str, n: int, expr: str) -> str:
    return f"CASE WHEN count({x}) OVER {frame(n)} = {n} THEN {expr} END"


def pct_rank_sql(x: str, source: str) -> str:
    """A percent rank with average ties over non-null values, as a query over ``source`` (ts, security, x)."""
    return f"SELECT ts, security, CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY ts, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY ts, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY ts) END AS v FROM {source}"


def formula(name: str, text: str, sql: str, ready: bool = False) -> None:
    """A query that evaluates one formula on the supplier-month panel; ``sql`` is an expression over g, or with ``ready`` a query for (ts, security, v)."""
    rows = sql if ready else f"SELECT ts, security, {sql} AS v FROM g"
    query(name, f"{PANEL_SQL} SELECT ts, security, round(CAST(v AS DOUBLE), 8) AS value FROM ({rows})")(lambda spark, sf: shown(compile_formulas(supplier_month(spark, sf), {"value": text}, FIELDS), "value"))


formula("a1_add", "Add(returns, Mul(returns, 2))", "returns + returns * 2")
formula("a2_sub", "Sub(returns, 0.5)", "returns - 0.5")
formula("a3_mul", "Mul(returns, returns)", "returns * returns")
formula("a4_div", "Div(amount, volume)", "amount / CASE WHEN abs(volume) > 1e-12 THEN volume END")
formula("a5_neg", "Neg(returns)", "-returns")
formula("a6_greater", "Greater(returns, 0)", "CASE WHEN coalesce(returns > 0, false) THEN 1 ELSE 0 END")
formula("a7_less", "Less(returns, 0)", "CASE WHEN coalesce(returns < 0, false) THEN 1 ELSE 0 END")
formula("a8_ifelse", "IfElse(Less(returns, 0), Mul(returns, returns), 0)", "CASE WHEN returns < 0 THEN returns * returns ELSE 0 END")
formula("a10_tsmean", "TsMean(returns, 3)", full("returns", 3, f"avg(returns) OVER {frame(3)}"))
formula("a11_tsstd", "TsStd(returns, 6)", full("returns", 6, f"stddev_samp(returns) OVER {frame(6)}"))
formula("a12_tsdelta", "TsDelta(close, 2)", f"close - lag(close, 2) OVER {W_TS}")
formula(
    "a13_tsrank", "TsRank(returns, 5)",
    "SELECT ts, security, CASE WHEN len(a) = 5 THEN (len(list_filter(a, lambda v: v < returns)) + (len(list_filter(a, lambda v: v = returns)) + 1) / 2.0) / 5 END AS v "
    f"FROM (SELECT ts, security, returns, list(returns) FILTER (returns IS NOT NULL) OVER {frame(5)} AS a FROM g)", ready=True,
)
formula(
    "a14_tscorr", "TsCorr(returns, volume, 6)",
    f"SELECT ts, security, CASE WHEN count(x) OVER {frame(6)} = 6 THEN covar_pop(x, y) OVER {frame(6)} / nullif(stddev_pop(x) OVER {frame(6)} * stddev_pop(y) OVER {frame(6)}, 0) END AS v "
    "FROM (SELECT ts, security, CASE WHEN volume IS NOT NULL THEN returns END AS x, CASE WHEN returns IS NOT NULL THEN volume END AS y FROM g)", ready=True,
)
formula("a15_tsskew", "TsSkew(returns, 8)", full("returns", 8, f"skewness(returns) OVER {frame(8)}"))
formula("a16_tskurt", "TsKurt(returns, 8)", full("returns", 8, f"kurtosis(returns) OVER {frame(8)}"))
formula("a17_csrank", "CsRank(returns)", pct_rank_sql("returns", "g"), ready=True)
formula("dsl_flagship", "CsRank(TsMean(returns, 3))", pct_rank_sql("m", f"(SELECT ts, security, {full('returns', 3, f'avg(returns) OVER {frame(3)}')} AS m FROM g)"), ready=True)


@query("a_extensions", f"{PANEL_SQL} SELECT ts, security, round(lag(returns, 2) OVER {W_TS}, 8) AS delay FROM g")
def _extensions(spark: SparkSession, sf: str) -> DataFrame:
    return shown(compile_formulas(supplier_month(spark, sf), {"delay": "TsDelay(returns, 2)"}, FIELDS, extended=True), "delay")


@query(
    "a22_batch",
    f"""{PANEL_SQL}, m AS (SELECT ts, security, {full("returns", 3, f"avg(returns) OVER {frame(3)}")} AS m3, {full("returns", 6, f"stddev_samp(returns) OVER {frame(6)}")} AS s6 FROM g)
    SELECT ts, security, round(m3, 8) AS mean3, round(m3 / CASE WHEN abs(s6) > 1e-12 THEN s6 END, 8) AS ratio, round(-m3, 8) AS reversed FROM m""",
)
def _batch(spark: SparkSession, sf: str) -> DataFrame:
    """Three formulas in one plan; their common parts are computed once."""
    texts = {"mean3": "TsMean(returns, 3)", "ratio": "Div(TsMean(returns, 3), TsStd(returns, 6))", "reversed": "Neg(TsMean(returns, 3))"}
    return shown(compile_formulas(supplier_month(spark, sf), texts, FIELDS), *texts)


@query(
    "a23_masks",
    f"""{PANEL_SQL}, f AS (SELECT g.*, s_acctbal >= 0 AS xs, volume IS NOT NULL AS hist FROM g JOIN supplier ON security = s_suppkey),
    h AS (SELECT ts, security, xs, CASE WHEN hist THEN CASE WHEN returns < 0 THEN returns * returns ELSE 0 END END AS x FROM f)
    SELECT ts, security, round(CASE WHEN xs AND x IS NOT NULL THEN (rank() OVER (PARTITION BY ts, xs AND x IS NOT NULL ORDER BY x) + (count(*) OVER (PARTITION BY ts, xs AND x IS NOT NULL, x) - 1) / 2.0)
        / count(*) OVER (PARTITION BY ts, xs AND x IS NOT NULL) END, 8) AS value FROM h""",
)
def _masks(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("security"), (F.col("s_acctbal") >= 0).alias("xs"))
    view = supplier_month(spark, sf).join(suppliers, "security").withColumn("hist", F.col("volume").isNotNull())
    return shown(compile_formulas(view, {"value": "CsRank(IfElse(Less(returns, 0), Mul(returns, returns), 0))"}, FIELDS, hist="hist", xs="xs"), "value")


# --- factor post-processing


@query("b1_visibility", "SELECT event_id, coalesce(ts + to_hours(CAST(json_extract_string(props, '$.k') AS INTEGER)) <= TIMESTAMP '2024-01-15 00:00:00', false) AS visible FROM events")
def _visible(spark: SparkSession, sf: str) -> DataFrame:
    return known_events(spark, sf).select("event_id", postprocess.available(F.col("effective_at"), F.col("known_at"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("visible"))


def known_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the time they became known: some hours (``k``) after they happened."""
    e = table(spark, sf, "events")
    return e.withColumn("effective_at", F.col("ts")).withColumn("known_at", F.expr("ts + make_dt_interval(0, cast(get_json_object(props, '$.k') as int), 0, 0)"))


KNOWN_SQL = "SELECT *, ts AS effective_at, ts + to_hours(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS known_at FROM events"


@query("b4_winsorize", f"{PANEL_SQL}, q AS (SELECT ts, quantile_cont(returns, 0.05) AS lo, quantile_cont(returns, 0.95) AS hi FROM g GROUP BY ts) SELECT ts, security, round(CASE WHEN returns IS NOT NULL THEN least(greatest(returns, lo), hi) END, 8) AS returns FROM g JOIN q USING (ts)")
def _winsor(spark: SparkSession, sf: str) -> DataFrame:
    return shown(postprocess.winsorize(supplier_month(spark, sf), "returns", 0.05, 0.95), "returns")


@query("b5_zscore", f"{PANEL_SQL} SELECT ts, security, round((returns - avg(returns) OVER {W_CS}) / nullif(stddev_pop(returns) OVER {W_CS}, 0), 8) AS returns FROM g")
def _zscore(spark: SparkSession, sf: str) -> DataFrame:
    return shown(postprocess.zscore(supplier_month(spark, sf), "returns"), "returns")


@query(
    "b6_neutralize",
    f"""{PANEL_SQL}, p AS (SELECT ts, security, CASE WHEN volume IS NOT NULL THEN returns END AS y, CASE WHEN returns IS NOT NULL THEN volume END AS x FROM g),
    s AS (SELECT ts, avg(y) AS my, avg(x) AS mx, count(y) AS n, covar_pop(x, y) / nullif(var_pop(x), 0) AS b FROM p GROUP BY ts)
    SELECT ts, security, round(CASE WHEN n > 2 THEN y - my - coalesce(b, 0) * (x - mx) END, 8) AS returns FROM p JOIN s USING (ts)""",
)
def _neutral(spark: SparkSession, sf: str) -> DataFrame:
    return shown(postprocess.neutralize(supplier_month(spark, sf), "returns", "volume"), "returns")


@query(
    "b6_neutralize_many",
    f"""{PANEL_SQL}, v AS (SELECT *, coalesce(isfinite(returns) AND isfinite(volume) AND isfinite(close), false) AS ok FROM g),
    s AS (SELECT ts, avg(returns) AS my, avg(volume) AS m1, avg(close) AS m2, count(*) * var_pop(volume) + 0.1 AS a, count(*) * var_pop(close) + 0.1 AS d, count(*) * covar_pop(volume, close) AS b,
        count(*) * covar_pop(returns, volume) AS p, count(*) * covar_pop(returns, close) AS q FROM v WHERE ok GROUP BY ts HAVING count(*) >= 4)
    SELECT ts, security, round(CASE WHEN ok THEN returns - my - ((d * p - b * q) * (volume - m1) + (a * q - b * p) * (close - m2)) / (a * d - b * b) END, 8) AS returns FROM v LEFT JOIN s USING (ts)""",
)
def _neutral_many(spark: SparkSession, sf: str) -> DataFrame:
    return shown(postprocess.neutralize_many(supplier_month(spark, sf), "returns", ["volume", "close"], ridge=0.1), "returns")


@query(
    "b7_daily",
    """WITH d AS (SELECT user_id AS security, ts, value, CAST(ts AS DATE) AS day FROM events WHERE hour(ts) * 60 + minute(ts) BETWEEN 840 AND 900),
    last AS (SELECT day, max(ts) AS timestamp FROM d GROUP BY day)
    SELECT timestamp, security, round(avg(value), 8) AS value FROM d JOIN last USING (day) GROUP BY timestamp, security""",
)
def _daily(spark: SparkSession, sf: str) -> DataFrame:
    ticks = table(spark, sf, "events").select(F.col("ts").alias("timestamp"), F.col("user_id").alias("security"), "value")
    return postprocess.daily(ticks, "value", "close60", "mean").select("timestamp", "security", F.round("value", 8).alias("value"))


CLOCK_SQL = "SELECT user_id AS security, ts, value, CAST(ts AS DATE) AS day FROM events WHERE hour(ts) * 60 + minute(ts) BETWEEN {} AND {}"


@query(
    "b8_windows",
    " UNION ALL ".join(
        f"(WITH d AS ({CLOCK_SQL.format(*bounds)}), last AS (SELECT day, max(ts) AS timestamp FROM d GROUP BY day) SELECT '{name}' AS clock, timestamp, security, round(sum(value), 6) AS value FROM d JOIN last USING (day) GROUP BY timestamp, security)"
        for name, bounds in postprocess.CLOCK.items()
    ),
)
def _clocks(spark: SparkSession, sf: str) -> DataFrame:
    ticks = table(spark, sf, "events").select(F.col("ts").alias("timestamp"), F.col("user_id").alias("security"), "value")
    made = [postprocess.daily(ticks, "value", name, "sum").select(F.lit(name).alias("clock"), "timestamp", "security", F.round("value", 6).alias("value")) for name in postprocess.CLOCK]
    return reduce(DataFrame.unionByName, made)


@query(
    "b9_reducers",
    f"""WITH d AS ({CLOCK_SQL.format(*postprocess.CLOCK["full_day"])}), last AS (SELECT day, max(ts) AS timestamp FROM d GROUP BY day)
    SELECT timestamp, security, round(max_by(value, ts), 6) AS last, round(avg(value), 6) AS mean, round(sum(value), 6) AS sum, round(stddev_pop(value), 6) AS std,
        round(CASE WHEN count(*) >= 3 THEN CASE WHEN min(value) = max(value) THEN 0 ELSE skewness(value) END END, 6) AS skew, round(CASE WHEN count(*) >= 4 THEN CASE WHEN min(value) = max(value) THEN 0 ELSE kurtosis(value) END END, 6) AS kurt
    FROM d JOIN last USING (day) GROUP BY timestamp, security""",
)
def _reducers(spark: SparkSession, sf: str) -> DataFrame:
    ticks = table(spark, sf, "events").select(F.col("ts").alias("timestamp"), F.col("user_id").alias("security"), "value")
    made = [postprocess.daily(ticks, "value", "full_day", name).select("timestamp", "security", F.round("value", 6).alias(name)) for name in ("last", "mean", "sum", "std", "skew", "kurt")]
    return reduce(lambda a, b: a.join(b, ["timestamp", "security"]), made)


@query(
    "b10_ewm",
    f"""{PANEL_SQL}, n AS (SELECT *, row_number() OVER {W_TS} AS k FROM g), r AS (
    WITH RECURSIVE e AS (SELECT security, k, ts, returns AS m, 1.0::DOUBLE AS o, (returns IS NOT NULL)::INT AS c FROM n WHERE k = 1
        UNION ALL SELECT n.security, n.k, n.ts, CASE WHEN n.returns IS NULL THEN m WHEN m IS NULL THEN n.returns ELSE (o * 0.6 * m + 0.4 * n.returns) / (o * 0.6 + 0.4) END,
            CASE WHEN n.returns IS NULL THEN CASE WHEN m IS NULL THEN 1.0 ELSE o * 0.6 END ELSE 1.0 END, c + (n.returns IS NOT NULL)::INT FROM e JOIN n ON n.security = e.security AND n.k = e.k + 1) SELECT * FROM e)
    SELECT ts, security, round(CASE WHEN c >= 4 THEN m END, 8) AS ewm FROM r""",
)
def _ewm(spark: SparkSession, sf: str) -> DataFrame:
    return shown(postprocess.ewm(supplier_month(spark, sf), "returns", 4), "ewm")


# --- sources, point in time, quality


@query("c4_as_of", f"SELECT event_id, user_id FROM ({KNOWN_SQL}) WHERE effective_at <= TIMESTAMP '2024-01-20' AND known_at <= TIMESTAMP '2024-01-20'")
def _as_of(spark: SparkSession, sf: str) -> DataFrame:
    return market.visible_as_of(known_events(spark, sf), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("event_id", "user_id")


def _revisions(policy: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = known_events(spark, sf).withColumn("effective_at", F.date_trunc("day", "ts"))
        return market.resolve_revisions(rows, ["user_id"], policy, tie="event_id").select("user_id", F.col("effective_at").cast("date").alias("day"), "event_id")

    return run


for _policy, _order in (("first_seen", "known_at"), ("as_of", "known_at DESC")):
    query(f"c5_{_policy}", f"SELECT user_id, CAST(ts AS DATE) AS day, event_id FROM ({KNOWN_SQL}) QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY {_order}, event_id) = 1")(_revisions(_policy))


@query(
    "d1_quality",
    f"""{PANEL_SQL}, t AS (SELECT count(*) AS n, count(*) - count(returns) AS absent, count(*) FILTER (returns < -0.5) AS low, count(*) FILTER (returns > 0.5) AS high FROM g)
    SELECT * FROM (SELECT 'missing_values' AS code, 'warning' AS severity, 'returns' AS field, absent AS n FROM t WHERE absent / n > 0.01 AND absent / n <= 0.25
    UNION ALL SELECT 'value_below_minimum', 'error', 'returns', low FROM t WHERE low > 0 UNION ALL SELECT 'value_above_maximum', 'error', 'returns', high FROM t WHERE high > 0)""",
)
def _quality(spark: SparkSession, sf: str) -> DataFrame:
    return market.quality_report(supplier_month(spark, sf), ["timestamp", "security"], "returns", -0.5, 0.5, warn_missing=0.01)


@query(
    "d1d_applicable",
    f"""{PANEL_SQL}, t AS (SELECT count(*) AS n, count(*) - count(returns) AS absent, count(*) FILTER (returns < -0.4) AS low, count(*) FILTER (returns > 0.4) AS high FROM g WHERE volume > 20)
    SELECT * FROM (SELECT 'missing_values' AS code, 'warning' AS severity, 'returns' AS field, absent AS n FROM t WHERE absent / n > 0.001 AND absent / n <= 0.25 UNION ALL SELECT 'excessive_missing_values', 'error', 'returns', absent FROM t WHERE absent / n > 0.25
    UNION ALL SELECT 'value_below_minimum', 'error', 'returns', low FROM t WHERE low > 0 UNION ALL SELECT 'value_above_maximum', 'error', 'returns', high FROM t WHERE high > 0)""",
)
def _applicable(spark: SparkSession, sf: str) -> DataFrame:
    df = supplier_month(spark, sf).withColumn("traded", F.col("volume") > 20)
    return market.quality_report(df, ["timestamp", "security"], "returns", -0.4, 0.4, warn_missing=0.001, applicable="traded")


@query("d4_session", "SELECT event_id FROM events WHERE hour(ts) * 60 + minute(ts) BETWEEN 570 AND 690 OR hour(ts) * 60 + minute(ts) BETWEEN 780 AND 900")
def _session(spark: SparkSession, sf: str) -> DataFrame:
    minute = stats.session_minutes(F.col("ts"))
    return table(spark, sf, "events").where(minute.between(570, 690) | minute.between(780, 900)).select("event_id")


# --- joins


@query(
    "e3_mask_lookup",
    f"{PANEL_SQL}, m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS ts, o_custkey AS security, true AS busy FROM orders) SELECT ts, security, coalesce(busy, false) AS busy FROM g LEFT JOIN m USING (ts, security)",
)
def _mask(spark: SparkSession, sf: str) -> DataFrame:
    busy = table(spark, sf, "orders").select(F.trunc("o_orderdate", "MM").alias("timestamp"), F.col("o_custkey").alias("security"), F.lit(True).alias("busy")).distinct()
    return market.mask_lookup(supplier_month(spark, sf), busy, ["timestamp", "security"], "busy").select(F.col("timestamp").cast("date").alias("ts"), "security", "busy")


@query(
    "e4_as_of_join",
    "WITH b AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') SELECT a.event_id, b.value FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts",
)
def _asof(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return market.as_of_join(clicks, bought, ["user_id"], "ts", "ts", "value").select("event_id", "value")


@query(
    "e7_state",
    f"""WITH d AS (SELECT CAST(unnest(range(DATE '2024-01-05', DATE '2024-02-01', INTERVAL 5 DAY)) AS TIMESTAMP) AS date), k AS (SELECT *, CASE WHEN event_type = 'error' THEN 'INACTIVE' ELSE 'ACTIVE' END AS status FROM ({KNOWN_SQL}))
    SELECT user_id, CAST(date AS DATE) AS date, max_by(status, (effective_at, known_at, status)) AS status FROM k JOIN d ON effective_at <= date AND known_at <= date GROUP BY 1, 2""",
)
def _state(spark: SparkSession, sf: str) -> DataFrame:
    events = known_events(spark, sf).withColumn("status", F.when(F.col("event_type") == "error", "INACTIVE").otherwise("ACTIVE"))
    dates = spark.sql("SELECT explode(transform(sequence(date'2024-01-05', date'2024-01-31', interval 5 days), d -> cast(d as timestamp_ntz))) AS date")
    return market.state_at(events, dates, "user_id").select("user_id", F.col("date").cast("date").alias("date"), "status")


@query(
    "e14_ancestors",
    """WITH RECURSIVE edges AS (SELECT CAST(p_partkey AS BIGINT) AS child, CAST(floor(p_partkey / 3) AS BIGINT) AS parent FROM part WHERE p_partkey >= 3),
    up AS (SELECT child AS node, parent AS ancestor FROM edges UNION SELECT up.node, e.parent FROM up JOIN edges e ON e.child = up.ancestor) SELECT node, ancestor FROM up""",
)
def _lineage(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "part").where("p_partkey >= 3").select(F.col("p_partkey").cast("long").alias("child"), F.floor(F.col("p_partkey") / 3).cast("long").alias("parent"))
    return market.ancestors(edges)


@query(
    "k13_cycle_check",
    """WITH RECURSIVE edges AS (SELECT CAST(p_partkey AS BIGINT) AS child, CAST(floor(p_partkey / 3) AS BIGINT) AS parent FROM part WHERE p_partkey >= 3),
    up AS (SELECT child AS node, parent AS ancestor FROM edges UNION SELECT up.node, e.parent FROM up JOIN edges e ON e.child = up.ancestor),
    new AS (SELECT CAST(floor(p_partkey / 9) AS BIGINT) + p_partkey % 2 AS child, p_partkey AS parent FROM part WHERE p_partkey % 7 = 0)
    SELECT child, parent, child = parent OR node IS NOT NULL AS closes FROM new LEFT JOIN up ON node = parent AND ancestor = child""",
)
def _cycles(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey").cast("long")
    part = table(spark, sf, "part")
    edges = part.where("p_partkey >= 3").select(p.alias("child"), F.floor(p / 3).alias("parent"))
    return market.closing_edges(edges, part.where("p_partkey % 7 = 0").select((F.floor(p / 9) + p % 2).alias("child"), p.alias("parent")))


@query(
    "e8_overlaps",
    """WITH s AS (SELECT l_suppkey AS security, l_returnflag AS flag, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS a, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS b FROM lineitem)
    SELECT l.security, l.a // 30 AS part, count(*) AS n, CAST(sum(least(l.b, r.b) - greatest(l.a, r.a)) AS BIGINT) AS days FROM s l JOIN s r ON l.security = r.security AND l.a <= r.b AND r.a <= l.b WHERE l.flag = 'N' AND r.flag = 'R' GROUP BY 1, 2""",
)
def _overlaps(spark: SparkSession, sf: str) -> DataFrame:
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("long")
    items = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("security"), "l_returnflag", day.alias("a"), (day + F.col("l_quantity").cast("long")).alias("b"))
    kept, returned = (items.where(F.col("l_returnflag") == flag).drop("l_returnflag") for flag in "NR")
    met = intervals.overlaps(kept, returned.toDF("security", "c", "d"), ("a", "b"), ("c", "d"), ["security"])
    shared = F.least("b", "d") - F.greatest("a", "c")
    return met.groupBy("security", F.floor(F.col("a") / 30).alias("part")).agg(F.count("*").alias("n"), F.sum(shared).alias("days"))


@query(
    "l_compared",
    """WITH a AS (SELECT DISTINCT l_suppkey AS security, year(l_shipdate) AS y FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_suppkey AS security, year(l_shipdate) AS y FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 45)
    SELECT *, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'left' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def _compared(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem")
    kept = [items.where(test).select(F.col("l_suppkey").alias("security"), F.year("l_shipdate").cast("long").alias("y")) for test in ("l_returnflag = 'R'", "l_returnflag = 'N' AND l_quantity > 45")]
    return frames.compared(*kept)


@query("e17_active", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _active(spark: SparkSession, sf: str) -> DataFrame:
    revoked = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(revoked, "o_orderkey", "left_anti")


# --- aggregations


@query(
    "f1_bars",
    "SELECT CAST(ts AS DATE) AS day, user_id, min_by(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, max_by(value, (ts, event_id)) AS close, round(sum(value), 6) AS volume, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1, 2",
)
def _bars(spark: SparkSession, sf: str) -> DataFrame:
    b = market.daily_bars(table(spark, sf, "events"), "value", "value", "user_id")
    return b.withColumn("volume", F.round("volume", 6)).withColumn("mean", F.round("mean", 6))


LABELED_SQL = f"{PANEL_SQL}, l AS (SELECT ts, security, returns AS s, CASE WHEN lead(close, 1) OVER {W_TS} > 0 AND lead(close, 2) OVER {W_TS} > 0 THEN lead(close, 2) OVER {W_TS} / lead(close, 1) OVER {W_TS} - 1 END AS y FROM g)"
RANKED_SQL = f"""{LABELED_SQL}, v AS (SELECT *, s IS NOT NULL AND y IS NOT NULL AS ok FROM l),
    k AS (SELECT *, rank() OVER (PARTITION BY ts, ok ORDER BY s) + (count(*) OVER (PARTITION BY ts, ok, s) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY ts, ok ORDER BY y) + (count(*) OVER (PARTITION BY ts, ok, y) - 1) / 2.0 AS ry FROM v)"""
PER_DATE_SQL = f"""{RANKED_SQL}, d AS (SELECT ts, count(*) FILTER (ok) AS n, count(*) FILTER (ok) / nullif(count(s), 0) AS coverage, covar_pop(s, y) FILTER (ok) / nullif(stddev_pop(s) FILTER (ok) * stddev_pop(y) FILTER (ok), 0) AS ic,
    covar_pop(rs, ry) FILTER (ok) / nullif(stddev_pop(rs) FILTER (ok) * stddev_pop(ry) FILTER (ok), 0) AS rank_ic, stddev_pop(s) FILTER (ok) AS dispersion FROM k GROUP BY ts)"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return supplier_month(spark, sf).select("timestamp", "security", "returns", labels.return_label(F.col("close"), 1, 1).alias("label"))


@query("f2_per_date", f"{PER_DATE_SQL} SELECT ts, n, round(coverage, 8) AS coverage, round(ic, 8) AS ic, round(rank_ic, 8) AS rank_ic, round(dispersion, 8) AS dispersion FROM d")
def _per_date(spark: SparkSession, sf: str) -> DataFrame:
    d = evaluate.per_date(labelled(spark, sf), "returns", "label")
    return d.select(F.col("timestamp").cast("date").alias("ts"), "n", *(F.round(c, 8).alias(c) for c in ("coverage", "ic", "rank_ic", "dispersion")))


@query("f14_tie_rate", f"{RANKED_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY ts, ok, s) AS same FROM v) SELECT ts, round(CAST(sum(same - 1) FILTER (ok) AS DOUBLE) / nullif(count(*) FILTER (ok) * (count(*) FILTER (ok) - 1), 0), 8) AS tie_rate FROM c GROUP BY ts")
def _ties(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.per_date(labelled(spark, sf), "returns", "label").select(F.col("timestamp").cast("date").alias("ts"), F.round("tie_rate", 8).alias("tie_rate"))


@query(
    "f4_buckets",
    f"{LABELED_SQL}, b AS (SELECT ts, y, least(greatest(ceil(row_number() OVER (PARTITION BY ts ORDER BY s, security) / count(*) OVER (PARTITION BY ts) * 5), 1), 5)::INT AS bucket FROM l WHERE s IS NOT NULL AND y IS NOT NULL) SELECT ts, bucket, round(avg(y), 8) AS mean_label, count(*) AS n FROM b GROUP BY 1, 2",
)
def _buckets(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.bucket_returns(labelled(spark, sf), "returns", "label", 5).select(F.col("timestamp").cast("date").alias("ts"), "bucket", F.round("mean_label", 8).alias("mean_label"), "n")


@query(
    "f6_summary",
    f"""{PER_DATE_SQL}, a AS (SELECT avg(rank_ic) AS mean_rank_ic, stddev_samp(rank_ic) AS std_rank_ic, avg(rank_ic) / stddev_samp(rank_ic) AS rank_ic_ir, avg((rank_ic > 0)::INT) AS positive_ratio, avg(coverage) AS mean_coverage, count(rank_ic)::DOUBLE AS sample_count FROM d)
    SELECT metric, round(value, 7) AS value FROM (UNPIVOT a ON COLUMNS(*) INTO NAME metric VALUE value)""",
)
def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.summary(evaluate.per_date(labelled(spark, sf), "returns", "label")).select("metric", F.round("value", 7).alias("value"))


@query(
    "f7_turnover",
    f"{PANEL_SQL}, p AS ({pct_rank_sql('returns', 'g')}), q AS (SELECT ts, abs(v - lag(v) OVER {W_TS}) AS d FROM p) SELECT ts, round(CASE WHEN count(d) >= 2 THEN avg(d) END, 8) AS turnover FROM q GROUP BY ts",
)
def _turnover(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.rank_turnover(supplier_month(spark, sf), "returns").select(F.col("timestamp").cast("date").alias("ts"), F.round("turnover", 8).alias("turnover"))


def _pair_sql(a: str, b: str) -> str:
    return f"SELECT ts, '{a}' AS \"left\", '{b}' AS \"right\", round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 7) AS corr FROM (SELECT ts, CASE WHEN {b} IS NOT NULL THEN {a} END AS x, CASE WHEN {a} IS NOT NULL THEN {b} END AS y FROM g) GROUP BY ts"


@query("f13_pairs", f"{PANEL_SQL} {_pair_sql('returns', 'volume')} UNION ALL {_pair_sql('returns', 'close')} UNION ALL {_pair_sql('volume', 'close')}")
def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    made = evaluate.pair_correlations(supplier_month(spark, sf), ["returns", "volume", "close"])
    return made.select(F.col("timestamp").cast("date").alias("ts"), "left", "right", F.round("corr", 7).alias("corr"))


@query("f29_histogram", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _histogram(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("f30_next_attempt", "SELECT l_orderkey, coalesce(max(l_linenumber), 0) + 1 AS next FROM lineitem GROUP BY 1")
def _next(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.coalesce(F.max("l_linenumber"), F.lit(0)) + 1).alias("next"))


@query("f31_latest", "SELECT o_custkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1")
def _latest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))


# --- labels and splits


@query("i1_return_label", f"{LABELED_SQL} SELECT ts, security, round(y, 8) AS label FROM l")
def _label(spark: SparkSession, sf: str) -> DataFrame:
    return shown(labelled(spark, sf), "label")


@query("i2_excess", f"{LABELED_SQL} SELECT ts, security, round(y - avg(y) OVER {W_CS}, 8) AS excess FROM l")
def _excess(spark: SparkSession, sf: str) -> DataFrame:
    return shown(labelled(spark, sf).withColumn("excess", F.col("label") - F.avg("label").over(W.partitionBy("timestamp"))), "excess")


@query("i3_direction", f"{LABELED_SQL} SELECT ts, security, CASE WHEN y IS NOT NULL THEN (y > 0)::INT::DOUBLE END AS direction FROM l")
def _direction(spark: SparkSession, sf: str) -> DataFrame:
    return shown(labelled(spark, sf).withColumn("direction", labels.direction(F.col("label"))), "direction")


AHEAD = "(PARTITION BY security ORDER BY ts ROWS BETWEEN {} FOLLOWING AND {} FOLLOWING)"


@query("i4_future_volatility", f"{PANEL_SQL}, r AS (SELECT ts, security, ln(1 + returns) AS x FROM g) SELECT ts, security, round(CASE WHEN count(x) OVER {AHEAD.format(2, 4)} = 3 THEN stddev_pop(x) OVER {AHEAD.format(2, 4)} END, 8) AS vol FROM r")
def _future_vol(spark: SparkSession, sf: str) -> DataFrame:
    rows = supplier_month(spark, sf).withColumn("x", F.log(1 + F.col("returns")))
    return shown(rows.withColumn("vol", labels.future_volatility("x", 3)), "vol")


@query("f16_compounded", f"{PANEL_SQL} SELECT ts, security, round(CASE WHEN count(returns) OVER {AHEAD.format(1, 3)} = 3 THEN product(1 + returns) OVER {AHEAD.format(1, 3)} - 1 END, 8) AS compounded FROM g")
def _compound(spark: SparkSession, sf: str) -> DataFrame:
    return shown(supplier_month(spark, sf).withColumn("compounded", labels.compounded("returns", 3)), "compounded")


@query(
    "i8_walk_forward",
    """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS signal FROM lineitem), w AS (SELECT signal, lead(signal, 2) OVER (ORDER BY signal) AS label_end FROM m),
    f(fold_id, a, b, c, d) AS (VALUES (1, DATE '1995-01-01', DATE '1997-12-01', DATE '1998-02-01', DATE '1998-12-01'), (2, DATE '1995-01-01', DATE '1998-12-01', DATE '1999-02-01', DATE '1999-12-01'))
    SELECT * FROM (SELECT fold_id, signal, CASE WHEN signal BETWEEN a AND b AND label_end > b THEN 'purged' WHEN signal BETWEEN a AND b THEN 'train' WHEN signal BETWEEN c AND d AND label_end <= d THEN 'validation' WHEN signal BETWEEN c AND d THEN 'excluded' END AS role FROM w JOIN f ON signal BETWEEN a AND d) WHERE role IS NOT NULL""",
)
def _split(spark: SparkSession, sf: str) -> DataFrame:
    months = table(spark, sf, "lineitem").select(F.trunc("l_shipdate", "MM").alias("signal")).distinct()
    windows = months.withColumn("label_end", F.lead("signal", 2).over(W.orderBy("signal")))  # one row for each session
    folds = spark.sql("SELECT * FROM VALUES (1, date'1995-01-01', date'1997-12-01', date'1998-02-01', date'1998-12-01'), (2, date'1995-01-01', date'1998-12-01', date'1999-02-01', date'1999-12-01') AS t(fold_id, train_start, train_end, validation_start, validation_end)")
    return labels.walk_forward(windows, folds)


# --- portfolios and costs


@query(
    "h1_top_quantile",
    f"{PANEL_SQL}, r AS (SELECT ts, security, row_number() OVER (PARTITION BY ts ORDER BY returns, security) AS rn, count(*) OVER (PARTITION BY ts) AS n FROM g WHERE returns IS NOT NULL), k AS (SELECT *, greatest(1, floor(n * 0.2)) AS k FROM r) SELECT ts, security, round(CASE WHEN rn > n - k THEN 0.5 / k WHEN rn <= k THEN -0.5 / k ELSE 0 END, 8) AS weight FROM k",
)
def _top(spark: SparkSession, sf: str) -> DataFrame:
    return shown(portfolio.top_quantile(supplier_month(spark, sf), "returns", 0.2), "weight")


RANK_WEIGHT_SQL = f"""{PANEL_SQL}, r AS (SELECT ts, security, row_number() OVER (PARTITION BY ts ORDER BY returns, security) / count(*) OVER (PARTITION BY ts) - 0.5 AS c FROM g WHERE returns IS NOT NULL),
    wts AS (SELECT ts, security, CASE WHEN c > 0 THEN c / nullif(sum(greatest(c, 0)) OVER (PARTITION BY ts), 0) / 2 WHEN c < 0 THEN c / nullif(sum(greatest(-c, 0)) OVER (PARTITION BY ts), 0) / 2 ELSE 0 END AS weight FROM r)"""


@query("h2_rank_weights", f"{RANK_WEIGHT_SQL} SELECT ts, security, round(weight, 8) AS weight FROM wts")
def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return shown(portfolio.rank_weights(supplier_month(spark, sf), "returns"), "weight")


@query(
    "h3_capped",
    f"""{PANEL_SQL}, p AS (SELECT ts, security, returns AS x, unnest([0, 1]) AS stop FROM g WHERE returns IS NOT NULL), e AS (SELECT *, x - stop * 0.25 AS t FROM p),
    s AS (SELECT *, sum(1 - 2 * stop) OVER w AS n, sum((1 - 2 * stop) * x + 0.25 * stop) OVER w AS s FROM e WINDOW w AS (PARTITION BY ts ORDER BY t DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    a AS (SELECT ts, arg_min(CASE WHEN n > 0 THEN (s - 1) / n ELSE t END, t) AS shift FROM s WHERE s - n * t <= 1 GROUP BY ts)
    SELECT ts, security, round(least(greatest(x - shift, 0), 0.25), 8) AS weight FROM p JOIN a USING (ts) WHERE stop = 0""",
)
def _capped(spark: SparkSession, sf: str) -> DataFrame:
    return shown(portfolio.capped_simplex(supplier_month(spark, sf).where("returns is not null"), "returns", cap=0.25), "weight")


@query("h7_diagnostics", f"{RANK_WEIGHT_SQL}, t AS (SELECT *, abs(weight - coalesce(lag(weight) OVER {W_TS}, 0)) AS d FROM wts) SELECT ts, round(sum(d) / 2, 8) AS turnover, round(sum(abs(weight)), 8) AS gross, round(sum(weight), 8) + 0.0 AS net FROM t GROUP BY ts")
def _diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    made = portfolio.one_way_turnover(portfolio.rank_weights(supplier_month(spark, sf), "returns"))
    return made.select(F.col("timestamp").cast("date").alias("ts"), F.round("turnover", 8).alias("turnover"), F.round("gross", 8).alias("gross"), (F.round("net", 8) + 0.0).alias("net"))


@query(
    "j4_costs",
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_extendedprice = 0 THEN 0 ELSE greatest(l_extendedprice * 3.0 / 10000, 5.0) + l_extendedprice * 3.0 / 10000 + CASE WHEN l_returnflag = 'R' THEN l_extendedprice * 10.0 / 10000 ELSE 0 END
    + 0.1 * pow(l_quantity / 100, 0.5) * l_discount * l_extendedprice END, 6) AS cost FROM lineitem""",
)
def _costs(spark: SparkSession, sf: str) -> DataFrame:
    cost = portfolio.trade_cost(F.col("l_extendedprice"), F.col("l_returnflag") == "R", F.col("l_quantity") / 100, F.col("l_discount"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(cost, 6).alias("cost"))


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    panel = supplier_month(spark, sf)
    weights = portfolio.top_quantile(panel, "returns", 0.2)
    rows = panel.join(weights, ["timestamp", "security"], "left").select(F.explode(F.expr("array(1L, 2L)")).alias("portfolio_id"), "timestamp", "security", "weight", "close", "amount")
    side = F.when(F.col("portfolio_id") == 2, -1.0).otherwise(1.0)
    return rows.select("portfolio_id", "timestamp", "security", (F.coalesce("weight", F.lit(0.0)) * side).alias("weight"), F.col("close").alias("price"), "amount")


def _navs(spark: SparkSession, sf: str) -> DataFrame:
    return portfolio.backtest(_targets(spark, sf))


QUERIES["j1_backtest"] = _navs
QUERIES["f19_performance"] = lambda spark, sf: portfolio.performance(_navs(spark, sf))


# --- multiple testing and selection


def _supplier_series(spark: SparkSession, sf: str) -> DataFrame:
    return selection.newey_west(supplier_month(spark, sf), "returns", "security", "timestamp", 3)


HAC_SQL = f"""{PANEL_SQL}, x AS (SELECT ts, security, returns - avg(returns) OVER (PARTITION BY security) AS x, returns FROM g WHERE returns IS NOT NULL),
    y AS (SELECT *, x * x AS g0, x * lag(x, 1) OVER {W_TS} AS g1, x * lag(x, 2) OVER {W_TS} AS g2, x * lag(x, 3) OVER {W_TS} AS g3 FROM x),
    s AS (SELECT security, count(*) AS n, avg(returns) AS mean, (sum(g0) + 1.5 * coalesce(sum(g1), 0) + coalesce(sum(g2), 0) + 0.5 * coalesce(sum(g3), 0)) / count(*) AS lrv FROM y GROUP BY security)"""


@query("f24_newey_west", f"{HAC_SQL} SELECT security, n, round(mean, 8) AS mean, round(lrv, 8) AS lrv, round(CASE WHEN lrv > 1e-18 THEN mean / sqrt(lrv / n) END, 6) AS z FROM s")
def _hac(spark: SparkSession, sf: str) -> DataFrame:
    return _supplier_series(spark, sf).select("security", "n", F.round("mean", 8).alias("mean"), F.round("lrv", 8).alias("lrv"), F.round("z", 6).alias("z"))


QUERIES["f24_p_values"] = lambda spark, sf: _supplier_series(spark, sf).withColumn("p", selection.upper_p(F.col("z")))
QUERIES["f25_bootstrap"] = lambda spark, sf: selection.block_bootstrap(supplier_month(spark, sf), "returns", "security", "timestamp", 5, None, 42)


@query(
    "k1_benjamini_hochberg",
    "WITH p AS (SELECT p_partkey AS name, p_brand AS family, (p_retailprice - floor(p_retailprice)) AS p FROM part), r AS (SELECT *, least(1.0, p * count(*) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family ORDER BY p, name)) AS raw FROM p) SELECT name, family, round(min(raw) OVER (PARTITION BY family ORDER BY p, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 8) AS q FROM r",
)
def _bh(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("family"), (F.col("p_retailprice") - F.floor("p_retailprice")).alias("p"))
    return selection.benjamini_hochberg(p, "p", "name", "family").select("name", "family", F.round("q", 8).alias("q"))


@query(
    "k4_frontier",
    "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_suppkey != a.s_suppkey AND b.s_acctbal - a.s_acctbal >= 0 AND a.s_nationkey - b.s_nationkey >= 0 AND (b.s_acctbal - a.s_acctbal > 0 OR a.s_nationkey - b.s_nationkey > 0))",
)
def _frontier(spark: SparkSession, sf: str) -> DataFrame:
    return selection.frontier(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_suppkey", ["s_acctbal"], ["s_nationkey"])


@query("k8_gates", "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT o_totalprice < 200000 THEN 'too_large' END, CASE WHEN NOT o_orderstatus = 'F' THEN 'not_final' END], lambda x: x IS NOT NULL), ',') AS codes FROM orders")
def _gates(spark: SparkSession, sf: str) -> DataFrame:
    codes: Column = selection.failed_gates({"too_large": F.col("o_totalprice") < 200000, "not_final": F.col("o_orderstatus") == "F"})
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(codes, ",").alias("codes"))


@query("l_top_k", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def _top_k(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20)


@query("m_scalars", "SELECT s_suppkey, upper(trim(s_name)) AS name, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, round(sqrt(abs(s_acctbal)), 8) AS root FROM supplier")
def _scalars(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", F.upper(F.trim("s_name")).alias("name"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), F.round(F.sqrt(F.abs("s_acctbal")), 8).alias("root"))


# --- records and checks


@query("d1f_envelope", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * 2000 < greatest(l_quantity * 100, l_extendedprice, l_extendedprice * (1 - l_discount)) OR l_quantity * 100 > least(l_extendedprice, l_extendedprice * (1 - l_discount))")
def _envelope(spark: SparkSession, sf: str) -> DataFrame:
    q, x = F.col("l_quantity"), F.col("l_extendedprice")
    bars = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (q * 2000).alias("high"), (q * 100).alias("low"), x.alias("open"), (x * (1 - F.col("l_discount"))).alias("close"))
    return records.envelope_breaks(bars).select("l_orderkey", "l_linenumber")


@query("d1g_steps", f"{PANEL_SQL}, b AS (SELECT ts, security, close, lag(close) OVER {W_TS} AS p FROM g) SELECT ts, security, round(close, 8) AS close FROM b WHERE p > 0 AND close > 0 AND greatest(close / p, p / close) > 1.5")
def _steps(spark: SparkSession, sf: str) -> DataFrame:
    return shown(records.steps_over(supplier_month(spark, sf), "close", 1.5), "close")


@query(
    "e5_as_of_fallback",
    f"""{PANEL_SQL}, m AS (SELECT ts AS since, security, volume > 100 AS eligible FROM g0 WHERE volume IS NOT NULL AND ts >= DATE '1997-01-01'), a AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
    SELECT g.ts, g.security, CASE WHEN g.ts < (SELECT min(since) FROM m) THEN s_suppkey IS NOT NULL ELSE coalesce(m.eligible, false) AND s_suppkey IS NOT NULL END AS eligible
    FROM g ASOF LEFT JOIN m ON g.security = m.security AND g.ts >= m.since LEFT JOIN a ON g.security = s_suppkey""",
)
def _fallback(spark: SparkSession, sf: str) -> DataFrame:
    g = supplier_month(spark, sf).select("timestamp", "security", "volume")
    mask = g.where("volume is not null and timestamp >= date'1997-01-01'").select("timestamp", "security", (F.col("volume") > 100).alias("eligible"))
    allowed = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("security"))
    made = records.as_of_with_fallback(g.select("timestamp", "security"), mask, allowed)
    return made.select(F.col("timestamp").cast("date").alias("ts"), "security", "eligible")


@query("e16_dangling", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _dangling(spark: SparkSession, sf: str) -> DataFrame:
    return records.dangling(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(
    "f20_drawdown",
    f"""{PANEL_SQL}, u AS (SELECT security, ts, close < max(close) OVER {W_TS} AS under FROM g WHERE close IS NOT NULL), r AS (SELECT *, sum((NOT under)::INT) OVER {W_TS} AS run FROM u),
    n AS (SELECT security, run, sum(under::INT) AS n FROM r GROUP BY 1, 2) SELECT security, max(n)::BIGINT AS sessions FROM n GROUP BY 1""",
)
def _drawdown(spark: SparkSession, sf: str) -> DataFrame:
    return records.longest_drawdown(supplier_month(spark, sf).where("close is not null").select("timestamp", "security", "close"), "close", "security")


@query("i14_markers", "SELECT s_suppkey, s_nationkey % 2 = 0 AS suspended FROM supplier")
def _markers(spark: SparkSession, sf: str) -> DataFrame:
    words = F.element_at(F.array(F.lit(" suspended "), F.lit("n"), F.lit("停牌"), F.lit("false")), F.col("s_nationkey") % 4 + 1)
    return table(spark, sf, "supplier").select("s_suppkey", records.suspended(words).alias("suspended"))


@query(
    "k3_campaign",
    """WITH a AS (SELECT l_suppkey % 5 AS family, l_partkey AS candidate, l_linenumber AS attempt, l_orderkey AS attempt_id, CASE WHEN l_returnflag != 'R' THEN l_discount + l_quantity / 1000 END AS p FROM lineitem),
    l AS (SELECT family, candidate, arg_max(attempt, (attempt, attempt_id)) AS attempt, coalesce(arg_max({'p': p}, (attempt, attempt_id)).p, 1.0) AS p FROM a GROUP BY 1, 2),
    r AS (SELECT *, least(1.0, p * count(*) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family ORDER BY p, candidate)) AS raw FROM l)
    SELECT family, candidate, attempt, round(p, 8) AS p, round(min(raw) OVER (PARTITION BY family ORDER BY p, candidate ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 8) AS q FROM r""",
)
def _campaign(spark: SparkSession, sf: str) -> DataFrame:
    p = F.when(F.col("l_returnflag") != "R", F.col("l_discount") + F.col("l_quantity") / 1000)
    attempts = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 5).alias("family"), F.col("l_partkey").alias("candidate"), F.col("l_linenumber").alias("attempt"), F.col("l_orderkey").alias("attempt_id"), p.alias("p"))
    return records.campaign_tests(attempts, "family", "candidate").select("family", "candidate", "attempt", F.round("p", 8).alias("p"), F.round("q", 8).alias("q"))


@query(
    "k7_patience",
    """WITH b AS (SELECT o_custkey AS campaign, o_orderkey AS round, o_totalprice AS v, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
    SELECT campaign, round, NOT bool_or(coalesce(v > best, true)) OVER (PARTITION BY campaign ORDER BY round ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AND k >= 3 AS stop FROM b""",
)
def _patience(spark: SparkSession, sf: str) -> DataFrame:
    rounds = table(spark, sf, "orders").select(F.col("o_custkey").alias("campaign"), F.col("o_orderkey").alias("round"), "o_totalprice")
    return records.stalled(rounds, "o_totalprice", 3).select("campaign", "round", "stop")


@query(
    "k14_transitions",
    "WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders) SELECT o_custkey, o_orderkey, o_orderstatus FROM s WHERE prev IS NOT NULL AND NOT (prev, o_orderstatus) IN (('O', 'F'), ('O', 'P'), ('P', 'F'))",
)
def _transitions(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return records.bad_transitions(events, [("O", "F"), ("O", "P"), ("P", "F")], "o_custkey", "o_orderkey", "o_orderstatus").select("o_custkey", "o_orderkey", "o_orderstatus")


@query(
    "k15_ledger",
    "WITH h AS (SELECT user_id, event_id, event_type AS hash, CASE WHEN event_id % 10 = 3 THEN 'click' ELSE lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) END AS previous, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS due FROM events) SELECT user_id, event_id FROM h WHERE previous IS DISTINCT FROM due",
)
def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("hash"), F.when(F.col("event_id") % 10 == 3, "click").otherwise(before).alias("previous"))
    return records.broken_chain(rows, "user_id", "event_id", "hash", "previous").select("user_id", "event_id")


# --- incremental value, limits, robustness, contracts and shortlists

PAIRED = {"returns": "true", "volume": "security % 7 != 0", "close": "security % 5 != 1", "amount": "volume > 40"}


@query(
    "f13_diagnostics",
    f"""{PANEL_SQL}, l AS ({" UNION ALL ".join(f"SELECT ts, security, '{c}' AS f, {k} AS i, {c}::DOUBLE AS v, coalesce({d}, false) AS d FROM g" for k, (c, d) in enumerate(PAIRED.items()))}),
    j AS (SELECT a.ts, a.f AS "left", b.f AS "right", a.d AND b.d AS dom, coalesce(a.d AND b.d AND isfinite(a.v) AND isfinite(b.v), false) AS ok, a.v AS x, b.v AS y FROM l a JOIN l b USING (ts, security) WHERE a.i < b.i),
    r AS (SELECT *, CASE WHEN ok THEN x END AS p, CASE WHEN ok THEN y END AS q, CASE WHEN ok THEN rank() OVER (PARTITION BY ts, "left", "right", ok ORDER BY x) + (count(*) OVER (PARTITION BY ts, "left", "right", ok, x) - 1) / 2.0 END AS a,
        CASE WHEN ok THEN rank() OVER (PARTITION BY ts, "left", "right", ok ORDER BY y) + (count(*) OVER (PARTITION BY ts, "left", "right", ok, y) - 1) / 2.0 END AS b FROM j),
    s AS (SELECT ts, "left", "right", count(*) FILTER (dom) AS common_domain, count(*) FILTER (ok) AS common, CASE WHEN count(*) FILTER (ok) >= 3 AND min(p) < max(p) AND min(q) < max(q) THEN corr(p, q) END AS pearson,
        CASE WHEN count(*) FILTER (ok) >= 3 AND min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END AS spearman FROM r GROUP BY ALL)
    SELECT ts, "left", "right", common_domain, common, round(common / nullif(common_domain, 0), 8) AS coverage, round(pearson, 7) AS pearson, round(spearman, 8) AS spearman FROM s""",
)
def _pair_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    df = supplier_month(spark, sf).withColumns({f"in_{c}": F.expr(d) for c, d in PAIRED.items()})
    made = evaluate.pair_diagnostics(df, list(PAIRED), [f"in_{c}" for c in PAIRED], least=3)
    return made.select(F.col("timestamp").cast("date").alias("ts"), "left", "right", "common_domain", "common", F.round("coverage", 8).alias("coverage"), F.round("pearson", 7).alias("pearson"), F.round("spearman", 8).alias("spearman"))


@query(
    "f12_quantiles",
    f"""{RANKED_SQL}, v5 AS (SELECT ts, s, y, rank() OVER (PARTITION BY ts ORDER BY s) + (count(*) OVER (PARTITION BY ts, s) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY ts) AS n, min(s) OVER (PARTITION BY ts) < max(s) OVER (PARTITION BY ts) AS varies FROM v WHERE ok),
    b AS (SELECT ts, least(greatest(ceil(r * 5 / n), 1), 5) AS bucket, avg(y) AS m FROM v5 WHERE n >= 5 AND varies GROUP BY 1, 2),
    q AS (SELECT ts, {", ".join(f"max(m) FILTER (bucket = {k}) AS q{k}" for k in range(1, 6))} FROM b GROUP BY 1), d AS (SELECT ts, count(*) FILTER (ok) AS n FROM v GROUP BY 1)
    SELECT ts, n, {", ".join(f"round(q{k}, 8) AS q{k}" for k in range(1, 6))}, round(q5 - q1, 8) AS spread FROM d LEFT JOIN q USING (ts)""",
)
def _quantiles(spark: SparkSession, sf: str) -> DataFrame:
    df = labelled(spark, sf)
    made = evaluate.with_quantiles(evaluate.per_date(df, "returns", "label"), evaluate.descriptive_buckets(df, "returns", "label", 5, least=5))
    return made.select(F.col("timestamp").cast("date").alias("ts"), "n", *(F.round(c, 8).alias(c) for c in ("q1", "q2", "q3", "q4", "q5", "spread")))


NEXT_SQL = f"{PANEL_SQL}, z AS (SELECT ts, security, returns AS s, amount AS x, " + ", ".join(f"CASE WHEN lead(close, 1) OVER {W_TS} > 0 AND lead(close, {1 + h}) OVER {W_TS} > 0 THEN lead(close, {1 + h}) OVER {W_TS} / lead(close, 1) OVER {W_TS} - 1 END AS y{h}" for h in (1, 2, 3)) + " FROM g)"
SAFE_IC = "CASE WHEN count(*) >= {} AND min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END"


def _with_labels(spark: SparkSession, sf: str) -> DataFrame:
    return supplier_month(spark, sf).withColumns({f"y{h}": labels.return_label(F.col("close"), 1, h) for h in (1, 2, 3)})


@query(
    "f9_incremental_ic",
    f"""{NEXT_SQL}, v AS (SELECT * FROM z WHERE s IS NOT NULL AND x IS NOT NULL AND y1 IS NOT NULL), f AS (SELECT ts, regr_slope(s, x) AS k, regr_intercept(s, x) AS c FROM v GROUP BY ts HAVING count(*) >= 5),
    r AS (SELECT ts, y1, s - k * x - c AS e FROM v JOIN f USING (ts)),
    q AS (SELECT ts, rank() OVER (PARTITION BY ts ORDER BY e) + (count(*) OVER (PARTITION BY ts, e) - 1) / 2.0 AS a, rank() OVER (PARTITION BY ts ORDER BY y1) + (count(*) OVER (PARTITION BY ts, y1) - 1) / 2.0 AS b FROM r)
    SELECT ts, count(*) AS n, round({SAFE_IC.format(5)}, 8) AS rank_ic FROM q GROUP BY ts""",
)
def _incremental(spark: SparkSession, sf: str) -> DataFrame:
    made = evaluate.incremental_ic(_with_labels(spark, sf), "returns", ["amount"], "y1", least=5)
    return made.select(F.col("timestamp").cast("date").alias("ts"), "n", F.round("rank_ic", 8).alias("rank_ic"))


@query(
    "f10_ic_decay",
    f"""{NEXT_SQL}, l AS (UNPIVOT (SELECT ts, s, y1, y2, y3 FROM z WHERE s IS NOT NULL) ON y1, y2, y3 INTO NAME horizon VALUE y),
    q AS (SELECT horizon, ts, rank() OVER (PARTITION BY horizon, ts ORDER BY s) + (count(*) OVER (PARTITION BY horizon, ts, s) - 1) / 2.0 AS a, rank() OVER (PARTITION BY horizon, ts ORDER BY y) + (count(*) OVER (PARTITION BY horizon, ts, y) - 1) / 2.0 AS b FROM l),
    d AS (SELECT horizon, ts, {SAFE_IC.format(3)} AS ic FROM q GROUP BY 1, 2) SELECT horizon, round(avg(ic), 8) AS rank_ic, count(ic) AS n_dates FROM d GROUP BY horizon""",
)
def _decay(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.ic_decay(_with_labels(spark, sf), "returns", ["y1", "y2", "y3"], least=3).select("horizon", F.round("rank_ic", 8).alias("rank_ic"), "n_dates")


QUERIES["f27_permutation"] = lambda spark, sf: robustness.permutation_test(_with_labels(spark, sf), "returns", "y1", trials=200, seed=42)


def _fills(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem")
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return items.select((F.col("l_suppkey") % 3).alias("portfolio_id"), F.col("l_partkey").alias("security"), F.trunc("l_shipdate", "MM").alias("timestamp"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fill_id"), signed.alias("shares"))


FILLS_SQL = """WITH f AS (SELECT l_suppkey % 3 AS portfolio_id, l_partkey AS security, date_trunc('month', l_shipdate) AS ts, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS q FROM lineitem),
k AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS k, count(*) OVER () - 1 AS last FROM (SELECT DISTINCT ts FROM f)),
h AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY portfolio_id, security ORDER BY k, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM f JOIN k USING (ts)),
c AS (SELECT *, CASE WHEN sign(q) * sign(held) < 0 THEN least(abs(q), abs(held)) ELSE 0 END AS closed FROM h)"""


@query("f21_holding", f"{FILLS_SQL} SELECT portfolio_id, round(sum(closed * k - (abs(q) - closed) * k + (abs(q) - 2 * closed) * last) / sum(abs(q) - closed), 8) AS sessions FROM c GROUP BY 1")
def _holding(spark: SparkSession, sf: str) -> DataFrame:
    fills = _fills(spark, sf)
    return robustness.holding_sessions(fills, fills.select("timestamp")).select("portfolio_id", F.round("sessions", 8).alias("sessions"))


# the SQL numbers every single share
@query(
    "f21_lots",
    f"""{FILLS_SQL}, t AS (SELECT *, abs(q) - closed AS opened, sum(closed) OVER w AS c, sum(abs(q) - closed) OVER w AS o FROM c WINDOW w AS (PARTITION BY portfolio_id, security ORDER BY k, id ROWS UNBOUNDED PRECEDING)),
    a AS (SELECT portfolio_id, security, k AS opened, unnest(range((o - opened)::BIGINT, o::BIGINT)) AS i FROM t WHERE opened > 0),
    b AS (SELECT portfolio_id, security, k AS closed, unnest(range((c - closed)::BIGINT, c::BIGINT)) AS i FROM t WHERE closed > 0)
    SELECT portfolio_id, security, opened, closed, count(*)::DOUBLE AS shares FROM a LEFT JOIN b USING (portfolio_id, security, i) GROUP BY ALL""",
)
def _lots(spark: SparkSession, sf: str) -> DataFrame:
    fills = _fills(spark, sf)
    return robustness.matched_lots(fills, fills.select("timestamp"))


@query("f22_fill_ratio", "SELECT l_suppkey % 3 AS portfolio_id, round(sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_quantity END) / nullif(sum(l_quantity), 0), 8) AS fill_ratio FROM lineitem GROUP BY 1")
def _fill_ratio(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity").cast("double")
    orders = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 3).alias("portfolio_id"), q.alias("requested"), F.when(F.col("l_returnflag") != "N", q).alias("filled"))
    return robustness.fill_ratio(orders).select("portfolio_id", F.round("fill_ratio", 8).alias("fill_ratio"))


@query(
    "f23_marginal",
    f"""{PANEL_SQL}, m AS (SELECT security, returns, avg(returns) OVER (PARTITION BY ts) AS base FROM g), v AS (SELECT * FROM m WHERE returns IS NOT NULL AND base IS NOT NULL)
    SELECT security, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN regr_slope(returns, base) END, 6) AS beta, round(CASE WHEN count(*) >= 3 THEN regr_intercept(returns, base) * 252 END, 6) AS residual_annual,
    round(CASE WHEN count(*) >= 3 THEN corr(returns, base) END, 6) AS corr FROM v GROUP BY security""",
)
def _marginal(spark: SparkSession, sf: str) -> DataFrame:
    rows = supplier_month(spark, sf).withColumn("base", F.avg("returns").over(W.partitionBy("timestamp")))
    made = robustness.marginal_contribution(rows, "base", "returns", "security")
    return made.select("security", "n", *(F.round(c, 6).alias(c) for c in ("beta", "residual_annual", "corr")))


@query(
    "f23_admission",
    f"""{PANEL_SQL}, m AS (SELECT ts, security, returns AS y, avg(returns) OVER (PARTITION BY ts) AS x FROM g), v AS (SELECT * FROM m WHERE y IS NOT NULL AND x IS NOT NULL),
    w AS (SELECT *, exp(gx - greatest(max(gx) OVER u, 0)) - 1 AS fx, exp(gy - greatest(max(gy) OVER u, 0)) - 1 AS fy FROM (SELECT *, CASE WHEN min(x) OVER u > -1 THEN sum(CASE WHEN x > -1 THEN ln(1 + x) END) OVER u END AS gx,
        CASE WHEN min(y) OVER u > -1 THEN sum(CASE WHEN y > -1 THEN ln(1 + y) END) OVER u END AS gy FROM v WINDOW u AS (PARTITION BY security ORDER BY ts ROWS UNBOUNDED PRECEDING)) WINDOW u AS (PARTITION BY security ORDER BY ts ROWS UNBOUNDED PRECEDING)),
    a AS (SELECT security, (avg(y) - avg(x)) * 252 AS return_delta, CASE WHEN min(y) < max(y) AND min(x) < max(x) THEN (avg(y) / stddev_samp(y) - avg(x) / stddev_samp(x)) * sqrt(252) END AS ratio_delta,
        CASE WHEN count(fx) = count(*) AND count(fy) = count(*) THEN min(fy) - min(fx) END AS drawdown_delta, CASE WHEN count(*) >= 3 THEN regr_intercept(y, x) * 252 END AS residual FROM w GROUP BY security)
    SELECT security, round(return_delta, 6) AS return_delta, round(ratio_delta, 6) AS ratio_delta, round(drawdown_delta, 6) AS drawdown_delta, coalesce(residual > 1 AND ratio_delta > -1, false) AS admitted FROM a""",
)
def _admission(spark: SparkSession, sf: str) -> DataFrame:
    rows = supplier_month(spark, sf).withColumn("base", F.avg("returns").over(W.partitionBy("timestamp")))
    made = robustness.marginal_admission(rows, "base", "returns", "security", least_residual=1.0, least_ratio=-1.0)
    return made.select("security", *(F.round(c, 6).alias(c) for c in ("return_delta", "ratio_delta", "drawdown_delta")), "admitted")


def _exposed(spark: SparkSession, sf: str) -> DataFrame:
    weights = portfolio.rank_weights(supplier_month(spark, sf), "returns")
    return weights.withColumn("size", (F.col("security") % 7 - 3).cast("double"))


QUERIES["h4_risk_projection"] = lambda spark, sf: shown(constraints.risk_projection(_exposed(spark, sf), "weight", {"size": 0.05}, cap=0.5), "weight")


def _ramped(spark: SparkSession, sf: str) -> DataFrame:
    return constraints.turnover_ramp(_exposed(spark, sf).select(F.lit(1).alias("portfolio_id"), "timestamp", "security", "weight"), most=0.2)


QUERIES["h5_turnover_ramp"] = lambda spark, sf: shown(_ramped(spark, sf), "weight")


@query(
    "h6_conditions",
    f"""{RANK_WEIGHT_SQL}, d AS (SELECT *, abs(weight - coalesce(lag(weight) OVER {W_TS}, 0)) AS d FROM wts), s AS (SELECT ts, sum(d) / 2 AS t, max(abs(weight)) AS c FROM d GROUP BY ts)
    SELECT ts, 'turnover' AS code FROM s WHERE t > 0.6 + 1e-7 UNION ALL SELECT ts, 'weight' FROM s WHERE c > 0.1 + 1e-7""",
)
def _conditions(spark: SparkSession, sf: str) -> DataFrame:
    made = constraints.broken_conditions(portfolio.rank_weights(supplier_month(spark, sf), "returns"), gross=1.0, net=0.0, cap=0.1, turnover=0.6)
    return made.select(F.col("timestamp").cast("date").alias("ts"), "code")


@query(
    "i5_windows",
    """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS ts FROM lineitem), a AS (SELECT ts, lead(ts) OVER (ORDER BY ts) AS nxt FROM m), s AS (SELECT ts, lead(ts) OVER (ORDER BY ts) AS next_signal FROM m WHERE month(ts) % 3 = 1)
    SELECT s.ts AS signal, a.nxt AS entry, next_signal, b.nxt AS exit, coalesce(a.nxt < b.nxt, false) AS complete FROM s LEFT JOIN a ON a.ts = s.ts LEFT JOIN a b ON b.ts = next_signal WHERE next_signal IS NOT NULL""",
)
def _windows(spark: SparkSession, sf: str) -> DataFrame:
    months = table(spark, sf, "lineitem").select(F.trunc("l_shipdate", "MM").alias("timestamp")).distinct()
    return labels.execution_windows(months.where(F.month("timestamp") % 3 == 1), months)


@query(
    "i10_feature_returns",
    f"""{PANEL_SQL}, c AS (SELECT *, security % 7 != 0 AS i, security % 2 = 0 AS m, coalesce(amount > 0, false) AS t FROM g)
    SELECT ts, security, round(CASE WHEN i AND m AND returns IS NULL AND NOT t THEN 0 WHEN i THEN returns END, 8) AS value, i AND returns IS NOT NULL AS observed, i AND m AND returns IS NULL AND NOT t AS suspension_filled,
    i AND returns IS NULL AND NOT (m AND NOT t) AS unexplained, i AND m AND (returns IS NOT NULL OR t) AS conflict FROM c""",
)
def _feature_returns(spark: SparkSession, sf: str) -> DataFrame:
    made = contract.feature_returns(supplier_month(spark, sf), "returns", F.col("security") % 7 != 0, F.col("security") % 2 == 0, "amount")
    return made.select(F.col("timestamp").cast("date").alias("ts"), "security", F.round("feature_return", 8).alias("value"), "observed", "suspension_filled", "unexplained", "conflict")


@query("i11_contract", f"{PANEL_SQL} SELECT ts, security, security % 7 != 0 AND security % 3 != 0 AS signal, coalesce(security % 7 != 0 AND security % 3 != 0 AND returns IS NOT NULL AND close IS NOT NULL AND amount > 0 AND security % 5 != 0, false) AS execution FROM g")
def _contract(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("security")
    made = contract.security_contract(supplier_month(spark, sf), s % 7 != 0, s % 3 != 0, s % 5 == 0, "returns", "close", "amount")
    return made.select(F.col("timestamp").cast("date").alias("ts"), "security", "signal", "execution")


@query(
    "i12_identity",
    """WITH e AS (SELECT DISTINCT CAST(ts AS DATE) AS d, lpad(CAST(user_id AS VARCHAR), 6, '0') AS id FROM events), l AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS id FROM orders),
    f AS (SELECT id, min(d) + 2 AS d0 FROM e GROUP BY id) SELECT e.d AS day, e.id FROM e JOIN f USING (id) WHERE e.d >= d0 AND e.id IN (SELECT id FROM l)""",
)
def _identity(spark: SparkSession, sf: str) -> DataFrame:
    code = lambda c: F.lpad(F.col(c).cast("string"), 6, "0").alias("security")
    seen = table(spark, sf, "events").select(F.col("ts").cast("date").alias("timestamp"), code("user_id"))
    listed = seen.groupBy("security").agg(F.date_add(F.min("timestamp"), 2).alias("list_date"))
    return contract.research_identity([seen, table(spark, sf, "orders").select(code("o_custkey"))], listed).select(F.col("timestamp").alias("day"), F.col("security").alias("id"))


QUERIES["j6_scenarios"] = lambda spark, sf: robustness.capital_and_delay(_targets(spark, sf), 1e6, [1e5, 1e8], [1, 3])
QUERIES["j7_regimes"] = lambda spark, sf: robustness.regime_slices(_navs(spark, sf), spark.sql("SELECT * FROM VALUES ('early', date'1992-01-01', date'1994-12-01'), ('late', date'1995-01-01', date'2000-12-01'), ('none', date'1900-01-01', date'1900-02-01') AS t(regime, start, stop)"))


@query(
    "k5_progress",
    "WITH o AS (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) SELECT s_suppkey FROM supplier a WHERE s_suppkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM o WHERE o.s_suppkey = a.s_suppkey OR (o.s_acctbal >= a.s_acctbal AND o.s_nationkey <= a.s_nationkey))",
)
def _progress(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return shortlist.progressed(s.where("s_suppkey % 3 = 0"), s.where("s_suppkey % 2 = 0"), "s_suppkey", ["s_acctbal"], ["s_nationkey"]).select("s_suppkey")


@query("k10_panel", "SELECT p_partkey AS candidate_id, p_size AS priority FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 5 != 0 AND p_partkey % 3 != 0 ORDER BY p_size DESC, p_partkey LIMIT 10")
def _panel_of_reviews(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("candidate_id"), F.col("p_size").alias("priority"))
    says = lambda test, yes: part.withColumn("decision", F.when(test, yes).otherwise("no"))
    k = F.col("candidate_id")
    return shortlist.panel(part.select("candidate_id"), says(k % 2 == 0, "approve"), says(k % 5 != 0, "allow"), says(k % 3 != 0, "select"), 10)


from panelforge import queries_candidates, queries_data  # noqa: E402, F401  (they register their queries here)
