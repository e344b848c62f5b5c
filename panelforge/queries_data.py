"""Registered queries of data checks, assembly, declared factors, execution labels, diagnostics, families and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import checks, contract, evaluate, factor, frames, labels, market, selection
from panelforge.queries import KNOWN_SQL, LABELED_SQL, PER_DATE_SQL, QUERIES, W_TS, frame, full, known_events, labelled, query, shown
from panelforge.sources.panels import PANEL_SQL, supplier_month, table

# --- checks

DECLARED = {"event_id": ("bigint", False), "ts": ("timestamp_ntz", False), "value": ("double", False), "props": ("bigint", True), "venue": ("string", True)}


@query(
    "d2_schema",
    """SELECT 'missing_schema_field' AS code, 'venue' AS field, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'field_dtype_mismatch', 'props', 0
    UNION ALL SELECT 'nonnullable_field_has_missing', field, n FROM (SELECT 'event_id' AS field, count(*) FILTER (event_id IS NULL) AS n FROM events UNION ALL SELECT 'ts', count(*) FILTER (ts IS NULL) FROM events
        UNION ALL SELECT 'value', count(*) FILTER (x IS NULL) FROM (SELECT CASE WHEN event_type != 'error' THEN value END AS x FROM events)) WHERE n > 0""",
)
def _schema(spark: SparkSession, sf: str) -> DataFrame:
    """Errors carry no value here, so that a field that must be filled has gaps."""
    return checks.schema_issues(table(spark, sf, "events").withColumn("value", F.expr("CASE WHEN event_type != 'error' THEN value END")), DECLARED)


@query("d1b_order", "SELECT event_id FROM (SELECT event_id, value < lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS late FROM events) WHERE late")
def _order(spark: SparkSession, sf: str) -> DataFrame:
    return checks.out_of_order(table(spark, sf, "events"), ["user_id"], "event_id", "value").select("event_id")


SESSIONS = [(570, 690), (780, 900)]


@query("d1c_session", "SELECT event_id FROM events WHERE NOT coalesce(isodow(ts) < 6 AND (hour(ts) * 60 + minute(ts) BETWEEN 570 AND 690 OR hour(ts) * 60 + minute(ts) BETWEEN 780 AND 900), false)")
def _outside(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    days = e.select(F.to_date("ts").alias("day")).distinct().where(~F.dayofweek("day").isin(1, 7))
    return checks.outside_calendar(e, days, SESSIONS).select("event_id")


@query("d3_future", f"SELECT event_id FROM ({KNOWN_SQL}) WHERE NOT coalesce(known_at <= effective_at + INTERVAL 12 HOUR, false)")
def _future(spark: SparkSession, sf: str) -> DataFrame:
    return checks.seen_too_early(known_events(spark, sf), F.expr("effective_at + INTERVAL 12 HOURS"), F.col("known_at")).select("event_id")


@query(
    "e12_coverage",
    "SELECT 'missing' AS kind, c_custkey FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'unknown', o_custkey FROM (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL EXCEPT SELECT c_custkey FROM customer)",
)
def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    return checks.coverage(table(spark, sf, "customer"), table(spark, sf, "orders").where("o_custkey is not null").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(
    "i9_embargo",
    f"""{PANEL_SQL}, c AS (SELECT ts, row_number() OVER (ORDER BY ts) AS k FROM (SELECT DISTINCT ts FROM g)), f AS (SELECT ts AS train_end, lead(ts, CAST(1 + month(ts) % 4 AS INTEGER)) OVER (ORDER BY ts) AS validation_start FROM c)
    SELECT train_end, validation_start, b.k - a.k - 1 AS gap, coalesce(b.k - a.k - 1 >= 2, false) AS ok FROM f LEFT JOIN c a ON a.ts = train_end LEFT JOIN c b ON b.ts = validation_start""",
)
def _embargo(spark: SparkSession, sf: str) -> DataFrame:
    days = supplier_month(spark, sf).select("timestamp").distinct()
    by = F.expr("array_sort(collect_list(timestamp))")
    axis = days.agg(by.alias("a")).select(F.posexplode("a").alias("k", "train_end"), "a")  # an axis of sessions
    folds = axis.select("train_end", F.expr("try_element_at(a, k + 2 + month(train_end) % 4)").alias("validation_start"))
    return checks.embargo(folds, days, 2).select(F.col("train_end").cast("date").alias("train_end"), F.col("validation_start").cast("date").alias("validation_start"), F.col("gap").cast("long").alias("gap"), "ok")


# --- assembly


@query("c1_assemble", "SELECT o_orderkey, o_totalprice FROM orders")
def _assemble(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return frames.assemble([o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")], ["o_orderkey"])


@query("c1_duplicates", "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return frames.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_suppkey"])


CELL_SQL = "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, l_suppkey AS security, sum(l_quantity) AS value FROM lineitem WHERE l_returnflag = '{}' GROUP BY 1, 2"


def _cells(spark: SparkSession, sf: str, flag: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").where(F.col("l_returnflag") == flag)
    return rows.groupBy(F.trunc("l_shipdate", "MM").alias("timestamp"), F.col("l_suppkey").alias("security")).agg(F.sum("l_quantity").alias("value"))


@query("e6_union", f"SELECT ts, security, a.value AS returned, b.value AS kept FROM ({CELL_SQL.format('R')}) a FULL JOIN ({CELL_SQL.format('N')}) b USING (ts, security)")
def _union(spark: SparkSession, sf: str) -> DataFrame:
    return frames.united({"returned": _cells(spark, sf, "R"), "kept": _cells(spark, sf, "N")}).select(F.col("timestamp").cast("date").alias("ts"), "security", "returned", "kept")


@query(
    "e2_common",
    f"""WITH a AS ({CELL_SQL.format("R")}), b AS ({CELL_SQL.format("A")}), t AS (SELECT ts FROM (SELECT DISTINCT ts FROM a) JOIN (SELECT DISTINCT ts FROM b) USING (ts) WHERE month(ts) <= 3)
    SELECT ts, security FROM t CROSS JOIN (SELECT security FROM a INTERSECT SELECT security FROM b)""",
)
def _common(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _cells(spark, sf, "R"), _cells(spark, sf, "A")
    times = a.select("timestamp").intersect(b.select("timestamp")).where(F.month("timestamp") <= 3)
    return frames.common_cells(times, [a, b]).select(F.col("timestamp").cast("date").alias("ts"), "security")


@query(
    "b2_daily_mask",
    "WITH m AS (SELECT CAST(ts AS DATE) AS day, user_id, bool_or(event_type = 'purchase') AS bought FROM events WHERE event_type != 'error' GROUP BY 1, 2) SELECT event_id, coalesce(bought, false) AS bought FROM events e LEFT JOIN m ON CAST(e.ts AS DATE) = m.day AND e.user_id = m.user_id",
)
def _daily_mask(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    mask = e.where("event_type != 'error'").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("bought"))
    return frames.spread_daily(e, mask, "bought", "ts", "user_id").select("event_id", "bought")


@query("b3_domain", f"{PANEL_SQL} SELECT ts, security, coalesce(volume > 100, false) AS universe FROM g")
def _domain(spark: SparkSession, sf: str) -> DataFrame:
    view = supplier_month(spark, sf).withColumn("universe", F.col("volume") > 50)
    return frames.narrow(view, "universe", F.col("volume") > 100).select(F.col("timestamp").cast("date").alias("ts"), "security", "universe")


# --- declared factors

SPEC = factor.FactorSpec("TsMean(returns, 3)", frozenset({"returns", "volume"}), (("winsorize", 0.05, 0.95), ("zscore",), ("neutralize", "volume")), direction=-1)


@query(
    "b12_factor",
    f"""{PANEL_SQL}, f0 AS (SELECT ts, security, volume, coalesce(s_acctbal >= 0, false) AS inside, {full("returns", 3, f"avg(returns) OVER {frame(3)}")} AS x FROM g LEFT JOIN supplier ON security = s_suppkey),
    f1 AS (SELECT ts, security, volume, inside, CASE WHEN inside THEN x END AS x FROM f0),
    f2 AS (SELECT ts, security, volume, inside, CASE WHEN inside AND x IS NOT NULL THEN least(greatest(x, quantile_cont(x, 0.05) OVER (PARTITION BY ts)), quantile_cont(x, 0.95) OVER (PARTITION BY ts)) END AS x FROM f1),
    f3 AS (SELECT ts, security, inside, CASE WHEN min(x) OVER (PARTITION BY ts) != max(x) OVER (PARTITION BY ts) THEN (x - avg(x) OVER (PARTITION BY ts)) / stddev_pop(x) OVER (PARTITION BY ts) END AS y, volume FROM f2),
    f4 AS (SELECT ts, security, y IS NOT NULL AND volume IS NOT NULL AS both_, y, volume FROM f3),
    f5 AS (SELECT ts, security, both_, CASE WHEN both_ THEN y END AS y, CASE WHEN both_ THEN volume END AS v FROM f4),
    f6 AS (SELECT ts, security, y - avg(y) OVER w - coalesce(CASE WHEN min(v) OVER w != max(v) OVER w THEN covar_pop(v, y) OVER w / nullif(var_pop(v) OVER w, 0) END, 0) * (v - avg(v) OVER w) AS r, count(*) FILTER (both_) OVER w AS n FROM f5 WINDOW w AS (PARTITION BY ts))
    SELECT ts, security, round(-CASE WHEN n > 2 THEN r END, 6) AS factor FROM f6""",
)
def _factor(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("security"), (F.col("s_acctbal") >= 0).alias("inside"))
    view = supplier_month(spark, sf).join(suppliers, "security", "left")
    return shown(factor.directed(factor.run(SPEC, view, "inside"), SPEC), "factor", digits=6)


# --- execution labels


def _priced(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier-months as a market: adjustments that change by quarter, and months that are suspended."""
    p = supplier_month(spark, sf)
    return p.select("timestamp", "security", F.col("close").alias("open"), (1 + F.quarter("timestamp") / 10).alias("adjustment"), "amount", ((F.col("security") + F.month("timestamp")) % 7 == 0).alias("suspended"))


WINDOWS_SQL = f"""{PANEL_SQL}, c AS (SELECT ts, lead(ts, 1) OVER (ORDER BY ts) AS nxt FROM (SELECT DISTINCT ts FROM g)),
    n AS (SELECT ts AS signal, lead(ts) OVER (ORDER BY ts) AS next_signal FROM c WHERE month(ts) % 3 = 0), w AS (SELECT signal, a.nxt AS entry, b.nxt AS exit FROM n JOIN c a ON a.ts = signal JOIN c b ON b.ts = next_signal)"""
EXECUTION_SQL = f"""{WINDOWS_SQL}, p AS (SELECT ts, security, close, 1 + quarter(ts) / 10 AS adj, amount, (security + month(ts)) % 7 = 0 AS sus FROM g), s AS (SELECT DISTINCT security FROM g),
    x AS (SELECT signal, s.security, a.close AS c1, b.close AS c2, a.adj AS j1, b.adj AS j2, NOT coalesce(a.close > 0, false) AS entry_open_invalid, NOT coalesce(b.close > 0, false) AS exit_open_invalid, NOT coalesce(a.adj > 0, false) AS entry_adjustment_invalid,
        NOT coalesce(b.adj > 0, false) AS exit_adjustment_invalid, NOT coalesce(a.amount > 0, false) AS entry_amount_invalid, NOT coalesce(b.amount > 0, false) AS exit_amount_invalid, coalesce(a.sus, false) AS entry_suspended, coalesce(b.sus, false) AS exit_suspended
        FROM w CROSS JOIN s LEFT JOIN p a ON a.ts = entry AND a.security = s.security LEFT JOIN p b ON b.ts = exit AND b.security = s.security),
    y AS (SELECT *, CASE WHEN NOT (entry_open_invalid OR exit_open_invalid OR entry_adjustment_invalid OR exit_adjustment_invalid OR entry_amount_invalid OR exit_amount_invalid OR entry_suspended OR exit_suspended) THEN c2 * j2 / (c1 * j1) - 1 END AS value FROM x)"""


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    days = supplier_month(spark, sf).select("timestamp").distinct()
    return labels.execution_windows(days.where(F.month("timestamp") % 3 == 0), days).select("signal", "entry", "exit")


@query("i6_execution", f"{EXECUTION_SQL} SELECT signal, security, round(value, 8) AS value, value IS NOT NULL AS valid, entry_open_invalid, exit_open_invalid, entry_suspended, exit_suspended FROM y")
def _execution(spark: SparkSession, sf: str) -> DataFrame:
    out = labels.execution_returns(_windows(spark, sf), _priced(spark, sf))
    return out.select(F.col("signal").cast("date").alias("signal"), "security", F.round("value", 8).alias("value"), "valid", "entry_open_invalid", "exit_open_invalid", "entry_suspended", "exit_suspended")


@query(
    "f17_diagnostics",
    f"""{EXECUTION_SQL} SELECT signal, count(*) AS scope, count(value) AS valid, count(*) - count(value) AS invalid, count_if(entry_open_invalid) AS entry_open_invalid, count_if(exit_amount_invalid) AS exit_amount_invalid,
    count_if(entry_suspended) AS entry_suspended, count_if(NOT entry_adjustment_invalid AND NOT exit_adjustment_invalid AND j1 != j2) AS adjustment_changed FROM y JOIN supplier ON security = s_suppkey WHERE s_acctbal >= 0 GROUP BY 1""",
)
def _diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    windows = _windows(spark, sf)
    universe = table(spark, sf, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("security")).crossJoin(windows.select("signal"))
    out = labels.label_diagnostics(labels.execution_returns(windows, _priced(spark, sf)), universe)
    return out.select(F.col("signal").cast("date").alias("signal"), "scope", "valid", "invalid", "entry_open_invalid", "exit_amount_invalid", "entry_suspended", "adjustment_changed")


@query("i7_between", f"{WINDOWS_SQL} SELECT signal, entry, exit FROM w WHERE entry >= DATE '1994-01-01' AND exit <= DATE '1996-12-31'")
def _between(spark: SparkSession, sf: str) -> DataFrame:
    out = labels.windows_between(_windows(spark, sf), F.lit("1994-01-01").cast("date"), F.lit("1996-12-31").cast("date"))
    return out.select(*(F.col(c).cast("date").alias(c) for c in out.columns))


# --- diagnostics


@query(
    "f5_descriptive",
    f"""{LABELED_SQL}, v AS (SELECT *, (rank() OVER (PARTITION BY ts ORDER BY s) + (count(*) OVER (PARTITION BY ts, s) - 1) / 2.0) AS r, count(*) OVER (PARTITION BY ts) AS n, min(s) OVER (PARTITION BY ts) AS lo, max(s) OVER (PARTITION BY ts) AS hi FROM l WHERE s IS NOT NULL AND y IS NOT NULL)
    SELECT ts, CAST(least(greatest(ceil(r * 5 / n), 1), 5) AS INTEGER) AS bucket, round(avg(y), 8) AS mean_label, count(*) AS n FROM v WHERE n >= 5 AND lo != hi GROUP BY 1, 2""",
)
def _descriptive(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.descriptive_buckets(labelled(spark, sf), "returns", "label", 5, 5)
    return out.select(F.col("timestamp").cast("date").alias("ts"), "bucket", F.round("mean_label", 8).alias("mean_label"), "n")


def rank_corr_sql(source: str, by: str, a: str = "a", b: str = "b") -> str:
    """Correlation of average ranks over the rows of ``source`` (``by``, a, b)."""
    rank = lambda x: f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"
    return f"SELECT {by}, count(*) AS n, round(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 8) AS c FROM (SELECT {by}, {rank(a)} AS ra, {rank(b)} AS rb FROM ({source})) GROUP BY {by}"


@query("f7_autocorrelation", f"{PANEL_SQL} SELECT ts, n, c AS autocorrelation FROM ({rank_corr_sql(f'SELECT * FROM (SELECT ts, returns AS a, lag(returns) OVER {W_TS} AS b FROM g) WHERE a IS NOT NULL AND b IS NOT NULL', 'ts')})")
def _autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.rank_autocorrelation(supplier_month(spark, sf), "returns")
    return out.select(F.col("timestamp").cast("date").alias("ts"), "n", F.round("autocorrelation", 8).alias("autocorrelation"))


@query(
    "f8_references",
    " UNION ALL ".join(f"SELECT '{c}' AS reference, round(avg(c), 8) AS correlation, count(c) AS n_dates FROM ({PANEL_SQL} {rank_corr_sql(f'SELECT ts, returns AS a, {c} AS b FROM g WHERE returns IS NOT NULL AND {c} IS NOT NULL', 'ts')})" for c in ("amount", "volume")),
)
def _references(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.reference_correlations(supplier_month(spark, sf), "returns", ["amount", "volume"]).withColumn("correlation", F.round("correlation", 8))


@query(
    "f11_metadata",
    f"""{PER_DATE_SQL}, s AS (SELECT avg(rank_ic) AS mean_rank_ic, stddev_samp(rank_ic) AS std_rank_ic, avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) AS rank_ic_ir, avg(CASE WHEN rank_ic > 0 THEN 1.0 WHEN rank_ic IS NOT NULL THEN 0.0 END) AS positive_ratio,
    avg(coverage) AS mean_coverage, count(rank_ic) AS n FROM d), u AS (SELECT * FROM (SELECT n, unnest(['mean_rank_ic', 'std_rank_ic', 'rank_ic_ir', 'positive_ratio', 'mean_coverage']) AS metric, unnest(['correlation', 'correlation', 'ratio', 'share', 'share']) AS unit,
    unnest([mean_rank_ic, std_rank_ic, rank_ic_ir, positive_ratio, mean_coverage]) AS value FROM s))
    SELECT metric, round(value, 6) AS value, unit, n AS sample_count, CASE WHEN n < 20 THEN 'insufficient_samples' WHEN value IS NULL THEN 'undefined' ELSE 'ok' END AS status FROM u""",
)
def _metadata(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.metric_metadata(evaluate.summary(evaluate.per_date(labelled(spark, sf), "returns", "label")), 20).withColumn("value", F.round("value", 6))


@query(
    "f18_audit",
    f"{PANEL_SQL} SELECT count(*) AS cells, count(DISTINCT ts) AS dates, count(DISTINCT security) AS securities, count_if(volume > 100) AS large_cells, count(DISTINCT CASE WHEN volume > 100 THEN ts END) AS large_dates, count_if(returns < 0) AS down_cells, count(DISTINCT CASE WHEN returns < 0 THEN ts END) AS down_dates FROM g",
)
def _audit(spark: SparkSession, sf: str) -> DataFrame:
    return contract.contract_audit(supplier_month(spark, sf).withColumn("large", F.col("volume") > 100).withColumn("down", F.col("returns") < 0), ["large", "down"])


@query("f28_usage", "SELECT user_id, count(*) AS calls, count_if(event_type = 'error') AS failed, round(sum(value), 6) AS units, round(count_if(event_type = 'error') / count(*), 8) AS failure_rate FROM events GROUP BY 1")
def _usage(spark: SparkSession, sf: str) -> DataFrame:
    failed = F.count_if(F.col("event_type") == "error")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("calls"), failed.alias("failed"), F.round(F.sum("value"), 6).alias("units"), F.round(failed / F.count("*"), 8).alias("failure_rate"))


# --- families and lineage


def _family(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as candidates in declared directions, some without any value."""
    family = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("candidate"), F.when(F.col("s_acctbal") < 0, -1).otherwise(1).alias("sign"))
    values = supplier_month(spark, sf).where("returns is not null and security % 9 != 0").select(F.col("security").alias("candidate"), "timestamp", F.col("returns").alias("value"))
    return selection.family_significance(family, values, 24, 3)


@query(
    "k2_family",
    f"""{PANEL_SQL}, n AS (SELECT security, count(returns) AS n, avg(returns) AS m FROM g WHERE security % 9 != 0 GROUP BY 1)
    SELECT s_suppkey AS candidate, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n < 24 THEN 'insufficient_observations' ELSE 'tested' END AS status, round(CASE WHEN s_acctbal < 0 THEN -m ELSE m END, 8) AS mean FROM supplier LEFT JOIN n ON security = s_suppkey""",
)
def _k2(spark: SparkSession, sf: str) -> DataFrame:
    return _family(spark, sf).select("candidate", "n", "status", F.round("mean", 8).alias("mean"))


QUERIES["k2_p_values"] = lambda spark, sf: _family(spark, sf).select("candidate", "p", "q")


@query(
    "k11_depth",
    """WITH RECURSIVE e AS (SELECT p_partkey AS child, CAST(floor(p_partkey / 3) AS BIGINT) AS parent FROM part WHERE p_partkey >= 3 UNION ALL SELECT p_partkey, CAST(floor(p_partkey / 2) AS BIGINT) FROM part WHERE p_partkey >= 3 AND p_partkey % 2 = 0),
    d AS (SELECT p_partkey AS node, 0 AS depth FROM part WHERE p_partkey < 3 UNION SELECT e.child, d.depth + 1 FROM d JOIN e ON e.parent = d.node) SELECT node, max(depth) AS depth, 'ok' AS status FROM d GROUP BY 1""",
)
def _depth(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("child"))
    edges = part.where("child >= 3").withColumn("parent", F.floor(F.col("child") / 3)).union(part.where("child >= 3 and child % 2 = 0").withColumn("parent", F.floor(F.col("child") / 2)))
    return market.lineage_depth(part.select(F.col("child").alias("node")), edges)
