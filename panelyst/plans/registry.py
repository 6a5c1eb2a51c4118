"""Queries of the panel engine over the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W

from .. import sources as S
from ..operators import backtest as B, features as X, folds as P, learning as L, relational as J, seasonal as Y
from ..panel import Panel
from . import pipelines as PL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Results are compared after rounding to 6 places; this keeps short decimals off the ties, which engines round apart.
OFF_TIES = 1.7e-8
#: The events as a panel: users are instruments.
EV = Panel("ts", "user_id", ("event_id",))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with a second series ``y`` and one with gaps ``xn``."""
    return table(spark, d, "events").select(
        "event_id", "user_id", "ts", "event_type", F.col("value").alias("x"), (((F.col("event_id") * 7919) % 101).cast("double") / 10).alias("y"),
        F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("xn"), F.to_date("ts").alias("d"),
    )


E_SQL = """e AS (SELECT event_id, user_id, ts, event_type, value AS x, CAST((event_id * 7919) % 101 AS DOUBLE) / 10 AS y,
  CASE WHEN event_id % 5 <> 0 THEN value END AS xn, CAST(ts AS DATE) AS d,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"""
OW = "PARTITION BY user_id ORDER BY ts, event_id"


def last(n: int) -> str:
    return f"OVER ({OW} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


SOFAR = f"OVER ({OW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def weighted(name: str, h: float, expr: str, src: str = "e") -> str:
    """CTE of the weighted moments m1..m4 of an expression, and r1..r4 of the recursion begun at the first value."""
    k = repr(0.5 ** (1 / h))
    m = ", ".join(f"sum(pow(b.v, {i}) * pow({k}, a.c - b.c)) / sum(pow({k}, a.c - b.c)) AS m{i}" for i in (1, 2, 3, 4))
    r = ", ".join(f"CASE WHEN c = 1 THEN pow(f, {i}) ELSE m{i} * (1 - pow({k}, c)) + pow({k}, c) * pow(f, {i}) END AS r{i}" for i in (1, 2, 3, 4))
    return f"""{name}_s AS (SELECT event_id, user_id, rn, v, count(v) OVER (PARTITION BY user_id ORDER BY rn) AS c,
  first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM (SELECT event_id, user_id, rn, {expr} AS v FROM {src})),
{name}_m AS (SELECT a.event_id, a.c, a.f, {m} FROM {name}_s a JOIN {name}_s b ON a.user_id = b.user_id AND b.rn <= a.rn WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY a.event_id, a.c, a.f),
{name} AS (SELECT event_id, {r}, m1, m2, m3, m4 FROM {name}_m)"""


def series(name: str, build: Callable[[DataFrame], DataFrame], outs: dict[str, tuple[str, str]], ctes: list[str] = (), joins: str = "") -> None:
    """A query over the events: result column -> (column of the operator, SQL), rounded to 6 places."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = build(events(spark, d))
        return out.select("event_id", *[F.round(F.col(f"`{c}`").cast("double") + OFF_TIES, 6).alias(o) for o, (c, _) in outs.items()])

    QUERIES[name] = run
    cols = ", ".join(f"ROUND(CAST({sql} AS DOUBLE) + {OFF_TIES}, 6) AS {o}" for o, (_, sql) in outs.items())
    ORACLES[name] = f"WITH {', '.join([E_SQL, *ctes])} SELECT e.event_id, {cols} FROM e {joins}"


def gd(n: str, d: str, default: float = 0.0) -> str:
    return f"(CASE WHEN abs({d}) <= 1e-8 THEN (CASE WHEN ({n}) IS NOT NULL THEN {default} END) ELSE ({n}) / ({d}) END)"


def cl(x: str, b: float = 3.0) -> str:
    return f"(CASE WHEN ({x}) < -{b} THEN -{b} WHEN ({x}) > {b} THEN {b} ELSE ({x}) END)"


K5, K20 = weighted("k5", 5, "x"), weighted("k20", 20, "x")
J5, J520 = "LEFT JOIN k5 USING (event_id)", "LEFT JOIN k5 USING (event_id) LEFT JOIN k20 USING (event_id)"
SD5 = "sqrt(greatest(k5.m2 - k5.m1 * k5.m1, 0))"
KEEP5 = 0.5 ** (1 / 5)
TV5 = gd(f"k5.m1 * {((1 + KEEP5) / (1 - KEEP5)) ** 0.5!r}", SD5)

# --- scalar ------------------------------------------------------------------
series("scalar_divide", lambda e: X.divide(e, ["x"], ["y"]), {"v": ("xdivy", gd("x", "y"))})
series("scalar_divide_less_one", lambda e: X.divide_less_one(e, ["x"], ["y"]), {"v": ("xdivm1y", gd("x", "y", 1.0) + " - 1")})
series("scalar_log1", lambda e: X.log1(e, ["x"]), {"v": ("x_log1", "ln(1 + x)")})
series("scalar_abs", lambda e: X.absolute(e.withColumn("z", F.col("y") - 5), ["z"]), {"v": ("z_abs", "abs(y - 5)")})
series("scalar_zero_to_null", lambda e: X.zero_to_null(e, ["y"]), {"v": ("y_0tonan", "nullif(y, 0)")})
series("scalar_to_double", lambda e: X.to_double(e.withColumn("i", F.col("event_id").cast("int")), ["i"]), {"v": ("i", "event_id")})
series("scalar_clip", lambda e: X.clipped(e, ["xn"], 20.0, 60.0), {"v": ("xn_clip", "CASE WHEN xn < 20 THEN 20 WHEN xn > 60 THEN 60 ELSE xn END")})
series("scalar_average_fill0", lambda e: X.average_fill0(e, ["xn", "y"], "a"), {"v": ("a", "(coalesce(xn, 0) + coalesce(y, 0)) / 2")})
series("scalar_rename", lambda e: X.to_feature(X.to_signal(e, ["x"]), ["y"]), {"sig": ("sig_x", "x"), "sigf": ("sigf_y", "y")})
series("scalar_calendar", lambda e: X.calendar_parts(e, "ts"), {"dow": ("sigf_dayofweek", "(isodow(ts) - 1)"), "tod": ("sigf_timeofday", "(epoch_us(ts) % 86400000000) / 86400000000.0 * 2")})
series("scalar_sign_log", lambda e: e.withColumn("s", F.signum(F.col("y") - 5) * F.ln(1 + F.abs(F.col("y") - 5))), {"v": ("s", "sign(y - 5) * ln(1 + abs(y - 5))")})

# --- exponentially weighted --------------------------------------------------
series("ewm", lambda e: X.ewm(e, ["xn"], [5], EV), {"v": ("xn_ewm5", "kn.m1")}, [weighted("kn", 5, "xn")], "LEFT JOIN kn USING (event_id)")
series("ewm_detrend", lambda e: X.detrend_ewm(e, ["x"], [5], EV), {"v": ("x_detrend_ewm5", "x - k5.m1")}, [K5], J5)
series("ewm_detrend_ratio", lambda e: X.detrend_ratio_ewm(e, ["x"], [5], EV), {"v": ("x_detrendratio_ewm5", gd("x", "k5.m1", 1.0) + " - 1")}, [K5], J5)
series("ewm_macd", lambda e: X.macd(e, ["x"], [(5, 20)], EV), {"v": ("x_macd5x20", "k5.m1 - k20.m1")}, [K5, K20], J520)
series("ewm_macd_ratio", lambda e: X.macd_ratio(e, ["x"], [(5, 20)], EV), {"v": ("x_macdr5x20", gd("k5.m1", "k20.m1", 1.0) + " - 1")}, [K5, K20], J520)
_MACD = [K5, K20, "mc AS (SELECT event_id, user_id, rn, k5.m1 - k20.m1 AS mv FROM e JOIN k5 USING (event_id) JOIN k20 USING (event_id))"]
series("ewm_macd_signal", lambda e: X.macd_signal(e, ["x"], [(5, 20, 9)], EV), {"v": ("x_macd5x20x9", "mc.mv - k9.m1")}, [*_MACD, weighted("k9", 9, "mv", "mc")], "JOIN mc USING (event_id) JOIN k9 USING (event_id)")
series("ewm_std", lambda e: X.ewm_std(e, ["x"], [5], EV), {"v": ("x_ewmstd5", f"CASE WHEN e.rn = 1 THEN 0 ELSE {SD5} END")}, [K5], J5)
series("ewm_skew", lambda e: X.ewm_skew(e, ["x"], [5], EV), {"v": ("x_ewmskew5", "CASE WHEN k5.r2 - k5.r1 * k5.r1 > 1e-9 THEN (k5.r3 - 3 * k5.r2 * k5.r1 + 2 * pow(k5.r1, 3)) / pow(k5.r2 - k5.r1 * k5.r1, 1.5) ELSE 0 END")}, [K5], J5)
series("ewm_kurt", lambda e: X.ewm_kurt(e, ["x"], [5], EV), {"v": ("x_ewmkurt5", "CASE WHEN k5.r2 - k5.r1 * k5.r1 > 1e-14 THEN (k5.r4 - 4 * k5.r3 * k5.r1 + 6 * k5.r2 * k5.r1 * k5.r1 - 3 * pow(k5.r1, 4)) / pow(k5.r2 - k5.r1 * k5.r1, 2) - 3 ELSE 0 END")}, [K5], J5)
series("ewm_scaling", lambda e: X.scale_ewm(e, ["x"], [5], EV), {"v": ("x_scaled_ewmstd5", f"CASE WHEN e.rn = 1 THEN 0 ELSE {cl(gd('x', SD5))} END")}, [K5], J5)
series("ewm_t_value", lambda e: X.ewm_scaled(e, ["x"], [5], EV), {"v": ("x_ewmscaled5", f"CASE WHEN e.rn = 1 THEN 0 ELSE {cl(TV5)} END")}, [K5], J5)
_SH = weighted("k5", 5, gd("(x - 50)", "abs(y)"))
series("ewm_sharpe", lambda e: X.sharpe_ewm(e.withColumn("g", F.col("x") - 50), {"y": "g"}, [5], EV), {"v": ("y_ewmsharpe5", f"CASE WHEN e.rn = 1 THEN 0 ELSE {cl(TV5)} END")}, [_SH], J5)

# --- rolling -----------------------------------------------------------------
series("rolling_sma", lambda e: X.sma(e, ["xn"], [7], EV), {"v": ("xn_sma7", f"avg(xn) {last(7)}")})
series("rolling_max_min", lambda e: X.rolling_min(X.rolling_max(e, ["x"], [7], EV), ["x"], [7], EV), {"hi": ("x_max7", f"max(x) {last(7)}"), "lo": ("x_min7", f"min(x) {last(7)}")})
series("rolling_lag", lambda e: X.lag(e, ["x"], [0, 3], EV), {"v0": ("x_lag0", "x"), "v3": ("x_lag3", f"lag(x, 3) OVER ({OW})")})
series("rolling_lag_forward", lambda e: X.lag_forward(e, ["x"], [-2], EV), {"v": ("forward_x_lag-2", f"lead(x, 2) OVER ({OW})")})
series("rolling_stochastic", lambda e: X.stochastic(e, ["x"], [7], EV), {"v": ("x_sto7", gd(f"(x - min(x) {last(7)})", f"(max(x) {last(7)} - min(x) {last(7)})"))})
series("rolling_rank", lambda e: X.rolling_rank(e, ["x"], [7], EV), {"v": ("x_rank7", f"(len(list_filter(list(x) {last(7)}, lambda q: q < x)) - 3.5) / 7")})
_C = lambda a: f"sum({a}) {last(10)}"
_VX, _VY = (f"(10 * {_C(f'{v}*{v}')} - {_C(v)} * {_C(v)})" for v in "xy")
series("rolling_corr", lambda e: X.corr(e, [("x", "y")], [10], EV), {"v": ("xxy_corr10", f"CASE WHEN {_VX} > 1e-9 AND {_VY} > 1e-9 THEN (10 * {_C('x*y')} - {_C('x')} * {_C('y')}) / sqrt({_VX} * {_VY}) END")})
_VAR, _COV = f"({_C('x*x')} - {_C('x')} * {_C('x')} / count(*) {last(10)})", f"({_C('x*y')} - {_C('x')} * {_C('y')} / count(*) {last(10)})"
_BETA = f"({_COV} / ({_VAR} + 2.0))"
_ALPHA = f"({_C('y')} / count(*) {last(10)} - {_BETA} * {_C('x')} / count(*) {last(10)})"
series("rolling_ridge", lambda e: X.ridge(e, [("x", "y")], [10], [2.0], EV), {"alpha": ("xxy_reg10x2.0_alpha", _ALPHA), "beta": ("xxy_reg10x2.0_beta", _BETA), "resid": ("xxy_reg10x2.0_resid", f"y - {_ALPHA} - {_BETA} * x")})
series("rolling_theta", lambda e: X.theta(e, ["x"], [10], [0.5], EV), {"v": ("x_theta10x0.5", f"CASE WHEN e.rn = 1 THEN x ELSE 0.5 * x + 0.5 * (avg(x) {last(10)} + coalesce(regr_slope(x, rn) {last(10)}, 0) * (rn - avg(rn) {last(10)})) END")})

# --- expanding ---------------------------------------------------------------
series("expanding_cumsum", lambda e: X.cumsum(e, ["xn"], EV), {"v": ("xn_cumsum", f"coalesce(sum(xn) {SOFAR}, 0)")})
series("expanding_count", lambda e: X.count_so_far(e, EV), {"v": ("cnt_exists", "rn")})
series("expanding_diff", lambda e: X.diff(e, ["x"], [1], EV), {"v": ("x_diff1", f"coalesce(x - lag(x) OVER ({OW}), 0)")})
series("expanding_ffill", lambda e: X.ffill(e, ["xn"], EV), {"v": ("xn_ffill", f"last_value(xn IGNORE NULLS) {SOFAR}")})
series("expanding_max_min_mean", lambda e: X.expanding(e, ["x"], EV), {"hi": ("x_expmax", f"max(x) {SOFAR}"), "lo": ("x_expmin", f"min(x) {SOFAR}"), "mean": ("x_expmean", f"avg(x) {SOFAR}")})
series("expanding_quantile", lambda e: X.quantile_by_key(e, ["x"], [0.9], EV), {"v": ("x_qtl0.90", f"quantile_cont(x, 0.9) {SOFAR}")})
_DD = f"dd AS (SELECT event_id, rn, user_id, sum(x - 50) {SOFAR} AS cum, avg(abs(y)) {SOFAR} AS size FROM e), d2 AS (SELECT event_id, 100 * {gd('(max(cum) OVER (PARTITION BY user_id ORDER BY rn) - cum)', 'size')} AS v FROM dd)"
series("expanding_drawdown", lambda e: X.drawdown(e.withColumn("g", F.col("x") - 50), {"y": "g"}, EV), {"v": ("y_ddpct", "d2.v")}, [_DD], "JOIN d2 USING (event_id)")
_NO = "n AS (SELECT event_id, x, row_number() OVER (ORDER BY ts, event_id) AS no FROM e)"
_MR = "mr AS (SELECT a.event_id, a.no, sum((b.x < a.x)::INT) AS l, sum((b.x = a.x)::INT) AS q FROM n a JOIN n b ON b.no BETWEEN a.no - 49 AND a.no GROUP BY 1, 2)"
series("stream_moving_rank", lambda e: X.moving_rank(e, ["x"], 50, EV), {"v": ("x_appops50", "CASE WHEN no >= 50 THEN 2 * (l + (q + 1) / 2.0 - 1) / 49 - 1 END")}, [_NO, _MR], "JOIN mr USING (event_id)")
def so_far(name: str, expr: str, shares: list[float], period: int, src: str = "e") -> str:
    """CTE with, per emission b, the quantiles q0.. of the first b * period rows of the stream; and ``{name}_n``, each row's emission."""
    qs = ", ".join(f"quantile_cont(v, {q!r}) AS q{i}" for i, q in enumerate(shares))
    return f"""{name}_n AS (SELECT event_id, {expr} AS v, row_number() OVER (ORDER BY ts, event_id) - 1 AS no, row_number() OVER (ORDER BY ts, event_id) // {period} AS b FROM {src}),
 {name} AS (SELECT o.b, {qs} FROM (SELECT DISTINCT b FROM {name}_n WHERE b > 0) o JOIN {name}_n r ON r.no < o.b * {period} GROUP BY o.b)"""


_QG, _JQ = so_far("g", "x", [0.05, 0.95], 250), "JOIN g_n USING (event_id) LEFT JOIN g USING (b)"
series("stream_quantile", lambda e: X.quantile_global(e, ["x"], [0.05, 0.95], EV, 250), {"q5": ("x_qtl0.05", "g.q0"), "q95": ("x_qtl0.95", "g.q1")}, [_QG], _JQ)
series("stream_winsorize", lambda e: X.winsorize_global(e, ["x"], 0.05, 0.95, EV, 250), {"v": ("x_clipqtl", "CASE WHEN x < g.q0 THEN g.q0 WHEN x > g.q1 THEN g.q1 ELSE x END")}, [_QG], _JQ)
_BQ = so_far("bq", "x", [(i + 1) / 9 for i in range(8)], 250)
_BJ = "CASE WHEN bq.q0 IS NOT NULL AND fw IS NOT NULL THEN " + " + ".join(f"(x >= bq.q{i})::INT" for i in range(7)) + " END"
_BR = f"""fw AS (SELECT event_id, lead(y) OVER ({OW}) AS fw FROM e), bj AS (SELECT e.event_id, bq_n.no, fw.fw, {_BJ} AS j FROM e JOIN bq_n USING (event_id) LEFT JOIN bq USING (b) JOIN fw USING (event_id)),
 bs AS (SELECT event_id, fw, {", ".join(f"sum(fw) FILTER (j = {j}) OVER w AS s{j}, sum(fw * fw) FILTER (j = {j}) OVER w AS t{j}, count(*) FILTER (j = {j}) OVER w AS c{j}" for j in (0, 3, 7))} FROM bj WINDOW w AS (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
series(
    "bucket_response",
    lambda e: X.bucket_response(X.lag_forward(e, ["y"], [-1], EV).withColumnRenamed("forward_y_lag-1", "fw"), "x", "fw", 8, EV, 250, 300).select("*", *[F.col(f"x_fw_bucketxy_{k}")[j].alias(f"{k}{j}") for k in ("mean", "std") for j in (0, 3, 7)]),
    {f"{k}{j}": (f"{k}{j}", f"CASE WHEN bs.fw IS NOT NULL AND c{j} > 0 THEN {sql.format(j=j)} END") for k, sql in (("mean", "s{j} / c{j}"), ("std", "(t{j} / c{j} - (s{j} / c{j}) * (s{j} / c{j})) / sqrt(c{j})")) for j in (0, 3, 7)},
    [_BQ, _BR], "JOIN bs USING (event_id)",
)

# --- cross-section (a day is one time) ---------------------------------------
CS = Panel("d", "user_id", ("event_id",))
_AT = "OVER (PARTITION BY d, event_type)"
_M = f"(sum(x * y) {_AT} / sum(y) {_AT})"
_N = f"count(*) {_AT}"
series("cs_demean", lambda e: X.cs_demean(e, ["x"], CS, ["event_type"], "y"), {"m": ("x_csmean", f"CASE WHEN sum(y) {_AT} > 0 THEN {_M} ELSE 0 END"), "v": ("x_csdemean", f"x - CASE WHEN sum(y) {_AT} > 0 THEN {_M} ELSE 0 END")})
_SD = f"(CASE WHEN sum(y) {_AT} > 0 AND {_N} >= 2 THEN sqrt(greatest((sum(x * x * y) {_AT} / sum(y) {_AT} - {_M} * {_M}) * {_N} / ({_N} - 1), 0)) ELSE 0 END)"
series("cs_scaling", lambda e: X.cs_scaling(e, ["x"], CS, ["event_type"], "y"), {"v": ("x_csscaling", cl(gd("x", _SD)))})
_Z = f"z AS (SELECT event_id, d, x - avg(x) OVER (PARTITION BY d) AS c FROM e), z2 AS (SELECT event_id, {cl(gd('c', '(sqrt(greatest(avg(c * c) OVER (PARTITION BY d) - pow(avg(c) OVER (PARTITION BY d), 2), 0) * count(*) OVER (PARTITION BY d) / (count(*) OVER (PARTITION BY d) - 1)))'))} AS v FROM z)"
series("cs_zscore", lambda e: X.cs_zscore(e, ["x"], CS), {"v": ("x_cszscore", "z2.v")}, [_Z], "JOIN z2 USING (event_id)")
_RK = "(row_number() OVER (PARTITION BY d ORDER BY x, user_id, event_id) - 1)"
_ND = "count(*) OVER (PARTITION BY d)"
series("cs_rank", lambda e: X.cs_rank(e, ["x"], CS), {"v": ("x_csrank", f"CASE WHEN {_ND} <= 1 THEN 0 ELSE ({_RK} - ({_ND} - 1) / 2.0) / ({_ND} - 1) * 2 END")})
series("cs_rank_up", lambda e: X.cs_rank(e, ["x"], CS, kind="up"), {"v": ("x_csrank", _RK)})
series("cs_rank_down", lambda e: X.cs_rank(e, ["x"], CS, kind="down"), {"v": ("x_csrank", f"CASE WHEN {_ND} <= 1 THEN 0 ELSE {_ND} - {_RK} END")})


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def r6(*cols: str):
    return [F.round(F.col(c).cast("double") + OFF_TIES, 6).alias(c) for c in cols]


def s6(**cols: str) -> str:
    return ", ".join(f"ROUND(CAST({x} AS DOUBLE) + {OFF_TIES}, 6) AS {c}" for c, x in cols.items())


# --- aggregation, joins, reshaping -------------------------------------------
@query("group_last", f"WITH {E_SQL} SELECT d, user_id, {s6(x='arg_max(x, (ts, event_id))')} FROM e GROUP BY 1, 2")
def group_last(spark, d):
    return J.group_last(events(spark, d), ["x"], Panel("d", "user_id", ("ts", "event_id"))).select("d", "user_id", *r6("x"))


@query("group_sum_mean", f"WITH {E_SQL} SELECT d, event_type, {s6(x='sum(x)', m='avg(x)')} FROM e GROUP BY 1, 2")
def group_sum_mean(spark, d):
    e = events(spark, d)
    total, mean = J.group_sum(e, ["x"], ["event_type"], CS), J.group_sum(e.withColumnRenamed("x", "m"), ["m"], ["event_type"], CS, True)
    return total.join(mean, ["d", "event_type"]).select("d", "event_type", *r6("x", "m"))


@query("time_bars", f"WITH {E_SQL}, b AS (SELECT user_id, time_bucket(INTERVAL '1 day', ts) AS date, {s6(open='arg_min(x, (ts, event_id))', high='max(x)', low='min(x)', close='arg_max(x, (ts, event_id))')}, count(*) AS cnt FROM e GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date) - 1 AS id FROM b")
def time_bars(spark, d):
    bars = J.time_bars(events(spark, d), "x", "1 day", EV)
    return bars.select("user_id", F.col("date").cast("timestamp_ntz").alias("date"), *r6("open", "high", "low", "close"), F.col("cnt").cast("long"), F.col("id").cast("long"))


@query("merge_asof", "SELECT l.event_id, r.value AS value_masof, r.event_id AS right_id_masof FROM (SELECT * FROM events WHERE event_type <> 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.ts >= r.ts")
def merge_asof(spark, d):
    ev = table(spark, d, "events")
    right = ev.where("event_type = 'purchase'").select("user_id", "ts", "value", F.col("event_id").alias("right_id"))
    left = ev.where("event_type <> 'purchase'").select("user_id", "ts", "event_id")
    return J.merge_asof(left, right, Panel("ts", "user_id"), ["value", "right_id"]).select("event_id", "value_masof", "right_id_masof")


@query("merge_asof_forward", "SELECT l.event_id, r.value AS value_masof FROM (SELECT * FROM events WHERE event_type <> 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.ts <= r.ts")
def merge_asof_forward(spark, d):
    ev = table(spark, d, "events")
    right = ev.where("event_type = 'purchase'").select("user_id", "ts", "value")
    return J.merge_asof(ev.where("event_type <> 'purchase'").select("user_id", "ts", "event_id"), right, Panel("ts", "user_id"), ["value"], forward=True).select("event_id", "value_masof")


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("pivot", f"WITH {E_SQL} SELECT d, " + ", ".join(f"arg_max(x, (ts, event_id)) FILTER (event_type = '{t}') AS {t}" for t in TYPES) + " FROM e GROUP BY d")
def pivot(spark, d):
    return J.pivot(events(spark, d), "x", TYPES, Panel("d", "event_type", ("ts", "event_id")))


@query("unpivot", f"WITH {E_SQL}, p AS (SELECT d, " + ", ".join(f"arg_max(x, (ts, event_id)) FILTER (event_type = '{t}') AS {t}" for t in TYPES) + " FROM e GROUP BY d) " + " UNION ALL ".join(f"SELECT d, '{t}' AS event_type, {t} AS serie FROM p" for t in TYPES))
def unpivot(spark, d):
    p = Panel("d", "event_type", ("ts", "event_id"))
    return J.unpivot(J.pivot(events(spark, d), "x", TYPES, p), TYPES, p)


TY = Panel("d", "event_type", ("ts", "event_id"))
_G = f"""{E_SQL}, o AS (SELECT d, event_type, arg_max(x, (ts, event_id)) AS v FROM e GROUP BY 1, 2),
 t AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS n FROM (SELECT DISTINCT d FROM e)), f AS (SELECT d AS dtsi, n FROM t WHERE n >= 9 AND (n - 9) % 5 = 0),
 s AS (SELECT f.dtsi, o.d, o.event_type AS c, o.v FROM f JOIN t ON t.n BETWEEN f.n - 9 AND f.n JOIN o ON o.d = t.d),
 a1 AS (SELECT dtsi, c, sum(v) AS s, sum(v * v) AS q FROM s GROUP BY 1, 2),
 pc AS (SELECT a.dtsi, a.c AS dscode1, b.c AS dscode2, sum(a.v * b.v) AS p FROM s a JOIN s b ON a.dtsi = b.dtsi AND a.d = b.d AND a.c < b.c GROUP BY 1, 2, 3),
 pd AS (SELECT pc.dtsi, dscode1, dscode2, (10 * p - x.s * y.s) / sqrt((10 * x.q - x.s * x.s) * (10 * y.q - y.s * y.s)) AS dist FROM pc JOIN a1 x ON x.dtsi = pc.dtsi AND x.c = dscode1 JOIN a1 y ON y.dtsi = pc.dtsi AND y.c = dscode2)"""


@query("pair_correlation", f"WITH {_G} SELECT dtsi, dscode1, dscode2, {s6(dist='dist')} FROM pd")
def pair_correlation(spark, d):
    return J.pair_correlation(events(spark, d), "x", 10, 5, TY).select("dtsi", "dscode1", "dscode2", *r6("dist"))


@query("pick_pairs")
def pick_pairs(spark, d):
    return J.pick_pairs(J.pair_correlation(events(spark, d), "x", 10, 5, TY), 1).select("dtsi", "dscode1", "dscode2", *r6("dist"))


_CHOSEN = "ch AS (SELECT dtsi, dscode1, dscode2 FROM pd WHERE dist > 0), ep AS (SELECT t.d, max(ch.dtsi) AS ep FROM t JOIN ch ON ch.dtsi <= t.d GROUP BY 1), px AS (SELECT ep.d, dscode1, dscode2, x.v AS serie1, y.v AS serie2 FROM ep JOIN ch ON ch.dtsi = ep.ep LEFT JOIN o x ON x.d = ep.d AND x.event_type = dscode1 LEFT JOIN o y ON y.d = ep.d AND y.event_type = dscode2)"


def _exploded(spark, d):
    e = events(spark, d)
    return J.explode_pairs(e, J.pair_correlation(e, "x", 10, 5, TY).where("dist > 0"), "x", TY)


@query("explode_pairs", f"WITH {_G}, {_CHOSEN} SELECT * FROM px")
def explode_pairs(spark, d):
    return _exploded(spark, d)


@query("collapse_pairs", f"WITH {_G}, {_CHOSEN}, lg AS (SELECT d, dscode1 AS c, serie1 - serie2 AS v FROM px UNION ALL SELECT d, dscode2, serie2 - serie1 FROM px) SELECT d, c AS event_type, {s6(gap='avg(v)')} FROM lg GROUP BY 1, 2")
def collapse_pairs(spark, d):
    gap = _exploded(spark, d).withColumn("gap", F.col("serie1") - F.col("serie2"))
    return J.collapse_pairs(gap, "gap", TY).select("d", "event_type", *r6("gap"))


@query("rollup_cube", "SELECT l_returnflag, l_linestatus, ROUND(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rollup_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.count(F.lit(1)).alias("n"))


@query("top_k", f"WITH {E_SQL} SELECT d, event_id, x FROM e QUALIFY row_number() OVER (PARTITION BY d ORDER BY x DESC, event_id) <= 3")
def top_k(spark, d):
    w = W.partitionBy("d").orderBy(F.desc("x"), "event_id")
    return events(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 3").select("d", "event_id", "x")


@query("set_union_distinct", "SELECT user_id, event_type FROM events WHERE value > 50 UNION SELECT user_id, event_type FROM events WHERE value < 20")
def set_union_distinct(spark, d):
    ev = table(spark, d, "events")
    return ev.where("value > 50").select("user_id", "event_type").unionByName(ev.where("value < 20").select("user_id", "event_type")).distinct()


# --- sources -----------------------------------------------------------------
@query("scan_range", "SELECT event_id, user_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND user_id IN (1, 2, 3, 5, 8, 13) AND NOT regexp_matches(CAST(user_id AS VARCHAR), '^1.$')")
def scan_range(spark, d):
    return S.scan(table(spark, d, "events"), "ts", "user_id", ["event_id", "user_id", "ts", "value"], "2024-01-05", "2024-01-12", [1, 2, 3, 5, 8, 13], "^1.$")


@query("scan_existing", "SELECT user_id, CAST(ts AS DATE) AS dt, count(*) AS n FROM events GROUP BY 1, 2")
def scan_existing(spark, d):
    return S.existing_rows(table(spark, d, "events"), "user_id", "ts")


@query("scan_universe_size", "SELECT CAST(ts AS DATE) AS dt, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def scan_universe_size(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("dt")).agg(F.countDistinct("user_id").alias("n"))


@query("dense_codes", "SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS dscode FROM events")
def dense_codes(spark, d):
    return S.codes(table(spark, d, "events"), "event_type").select("event_id", "dscode")


_BASES = ["FDUSD", "BUSD", "USDT", "USDC", "TUSD", "USD", "BNB", "ETH", "BTC", "BIDR", "PAX", "BRL", "EUR", "RUB", "TRY", "AUD", "GBP", "XRP", "NGN", "TRX", "X", "_PERP"]
_MARKS = ["", "UP", "DOWN", "BULL", "BEAR"]
_SYM = "o_orderstatus || CAST(o_custkey AS VARCHAR) || [" + ", ".join(f"'{m}'" for m in _MARKS) + "][o_custkey % 5 + 1] || [" + ", ".join(f"'{b}'" for b in _BASES) + "][o_orderkey % 22 + 1]"
_BASE = "CASE " + " ".join(f"WHEN ends_with(s, '{b}') THEN '{b}'" for b in _BASES[:20]) + " END"
_ADJ = "CASE " + " ".join(f"WHEN ends_with(s, '{m}' || base) THEN '{m}'" for m in _MARKS[1:]) + " WHEN base IS NOT NULL THEN '' END"
_SID = "CASE WHEN base IS NULL THEN NULL WHEN isupdown <> '' THEN 12 " + " ".join(f"WHEN base = '{b}' THEN {i}" for i, b in enumerate(["USDT", "BTC", "ETH", "BUSD", "BNB", "USDC", "TUSD", "FDUSD", "USD"], 1)) + " ELSE 10 END"


@query("split_symbol", f"WITH s AS (SELECT o_orderkey, {_SYM} AS s FROM orders), b AS (SELECT *, {_BASE} AS base FROM s), m AS (SELECT *, {_ADJ} AS isupdown FROM b) SELECT o_orderkey, s AS sym, base, replace(s, isupdown || base, '') AS ticker, isupdown, {_SID} AS orderid FROM m")
def split_symbol(spark, d):
    pick = lambda items, i: F.element_at(F.array(*map(F.lit, items)), (i + 1).cast("int"))
    o = table(spark, d, "orders").select("o_orderkey", F.concat("o_orderstatus", F.col("o_custkey").cast("string"), pick(_MARKS, F.col("o_custkey") % 5), pick(_BASES, F.col("o_orderkey") % 22)).alias("sym"))
    base, ticker, mark, sort_id = S.split_symbol(F.col("sym"))
    return o.select("o_orderkey", "sym", base.alias("base"), ticker.alias("ticker"), mark.alias("isupdown"), sort_id.alias("orderid"))


_FOLDER = "['data/spot/monthly/klines/', 'data/futures/um/monthly/klines/', 'data/futures/cm/monthly/klines/']"


@query("universe", f"""WITH p AS (SELECT DISTINCT {_FOLDER}[o_custkey % 3 + 1] || {_SYM} || CASE WHEN o_orderkey % 4 = 0 THEN '_250328' ELSE '' END || '/' AS "Prefix" FROM orders),
 k AS (SELECT "Prefix", CASE WHEN "Prefix" LIKE 'data/spot%' THEN 'spot' WHEN "Prefix" LIKE '%/um/%' THEN 'future_um' ELSE 'future_cm' END AS kind, regexp_extract("Prefix", 'klines/(.*)/', 1) AS sym_original FROM p),
 s AS (SELECT *, regexp_replace(sym_original, '_250328$', '') AS s FROM k), b AS (SELECT *, {_BASE} AS base FROM s), m AS (SELECT *, {_ADJ} AS isupdown FROM b)
 SELECT "Prefix", kind, sym_original, s AS sym, base, replace(s, isupdown || base, '') AS ticker, isupdown, coalesce({_SID}, 100) AS orderid FROM m""")
def universe(spark, d):
    pick = lambda items, i: F.element_at(F.array(*map(F.lit, items)), (i + 1).cast("int"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    sym = F.concat("o_orderstatus", c.cast("string"), pick(_MARKS, c % 5), pick(_BASES, o % 22), F.when(o % 4 == 0, "_250328").otherwise(""))
    return S.universe(table(spark, d, "orders").select(F.concat(pick(list(S.KINDS.values()), c % 3), sym, F.lit("/")).alias("Prefix")).distinct())


@query("should_query", """WITH l AS (SELECT user_id AS token, ts AS query_date, value > 30 AS success FROM events), k AS (SELECT token, min(query_date) FILTER (success) AS f, max(query_date) FILTER (success) AS t FROM l GROUP BY 1),
 r AS (SELECT token, (SELECT max(query_date) FROM l WHERE l.token = k.token AND query_date < f) AS a, (SELECT min(query_date) FROM l WHERE l.token = k.token AND query_date > t) AS b FROM k)
 SELECT e.user_id AS token, e.ts AS query_date FROM events e LEFT JOIN r ON r.token = e.user_id WHERE NOT coalesce(e.ts < r.a, false) AND NOT coalesce(e.ts > r.b, false)""")
def should_query(spark, d):
    return S.should_query(failing_range(spark, d), table(spark, d, "events").select(F.col("user_id").alias("token"), F.col("ts").alias("query_date")))


@query("names", "SELECT o_orderkey, sha256(o_orderpriority) AS hash, translate(o_orderpriority || ' (a/b:c,d)', ' /:(),', '______') AS file FROM orders")
def names(spark, d):
    text = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", S.name_hash(text).alias("hash"), S.file_name(F.concat(text, F.lit(" (a/b:c,d)"))).alias("file"))


@query("shards", "SELECT o_orderkey, CAST(floor((CAST(o_orderdate AS DATE) - DATE '1970-01-01') / 10.0) AS INT) AS shard FROM orders")
def shards(spark, d):
    return S.shards(table(spark, d, "orders"), "o_orderdate", 10).select("o_orderkey", "shard")


@query("failing_range", "WITH l AS (SELECT user_id AS token, ts AS query_date, value > 30 AS success FROM events), k AS (SELECT token, min(query_date) FILTER (success) AS first_ok, max(query_date) FILTER (success) AS last_ok FROM l GROUP BY 1) SELECT k.token, first_ok, last_ok, max(query_date) FILTER (query_date < first_ok AND NOT success) AS fails_until, min(query_date) FILTER (query_date > last_ok AND NOT success) AS fails_from FROM k LEFT JOIN l ON l.token = k.token GROUP BY 1, 2, 3")
def failing_range(spark, d):
    return S.failing_range(table(spark, d, "events").select(F.col("user_id").alias("token"), F.col("ts").alias("query_date"), (F.col("value") > 30).alias("success")))


# --- folds -------------------------------------------------------------------
@query("cusum", f"WITH RECURSIVE {E_SQL}, f AS (SELECT event_id, user_id, rn, CASE WHEN greatest(0, 0 + y - 5 - 0.5) > 5 THEN 0 ELSE greatest(0, 0 + y - 5 - 0.5) END AS s FROM e WHERE rn = 1 UNION ALL SELECT e.event_id, e.user_id, e.rn, CASE WHEN greatest(0, f.s + e.y - 5 - 0.5) > 5 THEN 0 ELSE greatest(0, f.s + e.y - 5 - 0.5) END FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1) SELECT event_id, {s6(v='s')} FROM f")
def cusum(spark, d):
    return P.cusum(events(spark, d), "y", 5.0, p=EV).withColumnRenamed("y_cusum", "v").select("event_id", *r6("v"))


@query("holt_winters")
def holt_winters(spark, d):
    return P.holt_winters(events(spark, d), "x", [(5, 20, 30, 7), (10, 0, 30, 7)], EV).select("event_id", *r6("x_5x20x30x7_1", "x_10x0x30x7_1"))


@query("ata")
def ata(spark, d):
    return P.ata(events(spark, d), "x", 2, 1, 1, EV).select("event_id", *r6("x_ata2x1"))


@query("point_figure")
def point_figure(spark, d):
    names = [f"x_pfp5.0x3_{s}" for s in ("px", "dir", "el", "perf", "perf2", "dur")]
    out = P.point_figure(events(spark, d), "x", 5.0, 3, EV)
    out = out.select("event_id", *[F.col(f"`{n}`").alias(n.rsplit("_", 1)[1]) for n in names])
    return out.select("event_id", "px", "dir", "el", *r6("perf"), "perf2", "dur")


@query("holt_level")
def holt_level(spark, d):
    return P.holt_level(events(spark, d), "x", 0.3, 0.1, EV).select("event_id", F.col("`x_holt0.3x0.1`").alias("v")).select("event_id", *r6("v"))


@query("svd_residual")
def svd_residual(spark, d):
    return P.svd_residual(events(spark, d), "x", 10, 5, 2, CS).select("d", "user_id", *r6("x_svdres", "x_svd1", "x_svd2"))


# --- outliers and seasons ----------------------------------------------------
@query("hampel", f"WITH {E_SQL}, a AS (SELECT event_id, x, list(x) OVER ({OW} ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS l FROM e), m AS (SELECT *, CASE WHEN len(l) = 10 THEN list_aggregate(l, 'median') END AS med FROM a), k AS (SELECT *, CASE WHEN med IS NOT NULL THEN list_aggregate(list_transform(l, lambda q: abs(q - med)), 'median') END AS mad FROM m) SELECT event_id, {s6(med='med', mad='mad')}, CASE WHEN abs(x - med) > 2 * 1.4826 * mad THEN 1 ELSE 0 END AS hit FROM k")
def hampel(spark, d):
    out = Y.hampel(events(spark, d), ["x"], 10, 2.0, EV)
    return out.select("event_id", F.col("x_med").alias("med"), F.col("x_mad").alias("mad"), F.col("x_out").alias("hit")).select("event_id", *r6("med", "mad"), "hit")


@query("hampel_report")
def hampel_report(spark, d):
    return Y.hampel_report(events(spark, d), ["x"], 10, 3.0, 20, EV)


OR = Panel("o_orderdate", "o_custkey", ("o_orderkey",))
_YO = "WITH l AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice AS x FROM orders), r AS (SELECT o_custkey, o_orderdate + INTERVAL 364 DAY AS t, arg_max(o_totalprice, o_orderkey) AS y FROM orders GROUP BY 1, 2)"


@query("yoy", f"{_YO} SELECT l.o_orderkey, {s6(x_lag1y='r.y', x_yoy_pct='CASE WHEN x + y <> 0 THEN greatest(-0.5, least(0.5, 2 * (x - y) / (x + y))) END')} FROM l ASOF LEFT JOIN r ON l.o_custkey = r.o_custkey AND l.o_orderdate >= r.t")
def yoy(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("x"))
    return Y.yoy(o, "x", "ratio", OR).select("o_orderkey", *r6("x_lag1y", "x_yoy_pct"))


@query("yoy_holiday")
def yoy_holiday(spark, d):
    o = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("k")).agg(F.sum("o_totalprice").alias("x"))
    return Y.yoy_holiday(o, "x", Y.event_links(Y.event_calendar(spark, 1994, 2002)), Panel("date", "k")).select("date", "k", *r6("x_lag1y", "x_yoy"))


@query("event_calendar")
def event_calendar(spark, d):
    return Y.event_calendar(spark, 2010, 2025)


@query("event_distances")
def event_distances(spark, d):
    return Y.event_distances(spark, Y.event_calendar(spark, 2023, 2026), "2024-01-01", "2025-01-01")


# --- backtest ----------------------------------------------------------------
def _signals(spark, d):
    e = events(spark, d)
    e = X.lag_forward(e.withColumn("dx", F.col("x") - 50), ["dx"], [-1], EV)
    return e.withColumns({"sig_a": (F.col("y") - 5) / 5, "sig_b": -(F.col("x") - 50) / 25})


_SG = f"{E_SQL}, g AS (SELECT event_id, user_id, ts, rn, d, lead(x - 50) OVER ({OW}) AS fw, (y - 5) / 5 AS a, -(x - 50) / 25 AS b FROM e), lo AS (SELECT 'sig_a' AS signal, event_id, user_id, rn, d, fw, a AS s FROM g UNION ALL SELECT 'sig_b', event_id, user_id, rn, d, fw, b FROM g), tr AS (SELECT *, abs(s - lag(s) OVER (PARTITION BY signal, user_id ORDER BY rn)) AS t FROM lo), dy AS (SELECT signal, d AS date, coalesce(sum(s * fw), 0) AS gross, coalesce(sum(t), 0) AS traded, sum(abs(s)) AS gmv FROM tr GROUP BY 1, 2)"


@query("backtest_daily", f"WITH {_SG} SELECT signal, date, {s6(gross='gross', traded='traded', gmv='gmv', net='gross - traded * 2 / 1e4')} FROM dy")
def backtest_daily(spark, d):
    return B.daily_pnl(_signals(spark, d), ["sig_a", "sig_b"], "forward_dx_lag-1", EV, fee_bps=2.0).select("signal", "date", *r6("gross", "traded", "gmv", "net"))


@query("backtest_stats", f"""WITH {_SG}, c AS (SELECT *, sum(gross) OVER (PARTITION BY signal ORDER BY date) AS cum, date - lag(date) OVER (PARTITION BY signal ORDER BY date) AS gap FROM dy), q AS (SELECT *, max(cum) OVER (PARTITION BY signal ORDER BY date) - cum AS dd FROM c)
SELECT signal, count(*) AS n, {s6(sr='sqrt(365 / median(gap)) * avg(gross) / (stddev_samp(gross) + 1e-6)', ann_pnl='avg(gross) * 365 / median(gap) / 1e3', mdd='100 * max(dd) / avg(gmv)', rpt='1e4 * sum(gross) / sum(traded)', rog='1e2 * sum(gross) / avg(gmv)')} FROM q GROUP BY signal""")
def backtest_stats(spark, d):
    days = B.daily_pnl(_signals(spark, d), ["sig_a", "sig_b"], "forward_dx_lag-1", EV, fee_bps=2.0)
    return B.daily_stats(days).select("signal", "n", *r6("sr", "ann_pnl", "mdd", "rpt", "rog"))


_DS = f"{_SG}, cu AS (SELECT *, sum(gross) OVER (PARTITION BY signal ORDER BY date) AS cum FROM dy), dq AS (SELECT *, max(cum) OVER (PARTITION BY signal ORDER BY date) - cum AS dd FROM cu)"


@query("backtest_drawdown", f"WITH {_DS} SELECT signal, date, {s6(cum='cum', dd='dd')} FROM dq")
def backtest_drawdown(spark, d):
    days = B.daily_pnl(_signals(spark, d), ["sig_a", "sig_b"], "forward_dx_lag-1", EV)
    return B.drawdown_series(days).select("signal", "date", *r6("cum", "dd"))


@query("backtest_ratios", f"WITH {_DS} SELECT signal, {s6(ann_sr='sqrt(252) * avg(gross) / stddev_samp(gross)', ret_dd='sum(gross) / max(dd)')} FROM dq GROUP BY signal")
def backtest_ratios(spark, d):
    days = B.daily_pnl(_signals(spark, d), ["sig_a", "sig_b"], "forward_dx_lag-1", EV)
    return B.return_ratios(days).select("signal", *r6("ann_sr", "ret_dd"))


@query("backtest_capped", f"WITH {E_SQL} SELECT event_id, {s6(v='greatest(-0.1 * abs(y), least(0.1 * abs(y), x - 50))')} FROM e")
def backtest_capped(spark, d):
    return events(spark, d).select("event_id", B.capped(F.col("x") - 50, F.col("y"), 0.1).alias("v")).select("event_id", *r6("v"))


@query("date_parts", "SELECT o_orderkey, isodow(o_orderdate) - 1 AS weekday, month(o_orderdate) AS month, day(o_orderdate) AS day, week(o_orderdate) AS week FROM orders")
def date_parts(spark, d):
    return X.date_parts(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").select("o_orderkey", "weekday", "month", "day", "week")


@query("silhouettes")
def silhouettes(spark, d):
    from pyspark.ml.functions import array_to_vector

    vectors = table(spark, d, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return spark.createDataFrame(L.silhouettes(vectors, range(2, 5)), "k int, silhouette double")


@query("backtest_impact", f"WITH {E_SQL} SELECT event_id, {s6(v='0.15 * y + 0.125 * x * sqrt(greatest(0, least(1, CASE WHEN x = 0 THEN 0 ELSE y / x END)))')} FROM e")
def backtest_impact(spark, d):
    return events(spark, d).select("event_id", B.impact_bps(F.col("y"), F.col("x"), F.col("y"), F.col("x")).alias("v")).select("event_id", *r6("v"))


_KB_RULES = {"sharpe": 1.0, "drawdown": 400.0, "per_trade": 100.0, "holding": 50.0, "least": 5}


def _selectable(spark, d):
    """One row per user and day: a signal that leads the coming change, and one that does not."""
    e = J.group_last(events(spark, d), ["x", "y"], Panel("d", "user_id", ("ts", "event_id")))
    p = Panel("d", "user_id")
    e = X.diff(e, ["x"], [1], p)
    return e.select("d", "user_id", F.col("x_diff1").alias("ret"), (F.col("y") + 1).alias("wgt"), (50 - F.col("x")).alias("sigf_a"), (F.col("y") - 5).alias("sigf_b"))


def _kb_sql(name: str, tail: str) -> str:
    k = repr(0.5 ** (1 / 5))
    mean = lambda c: f"sum(b.{c} * pow({k}, a.cnt - b.cnt)) / sum(pow({k}, a.cnt - b.cnt))"
    return f"""WITH {E_SQL}, o AS (SELECT d, user_id, arg_max(x, (ts, event_id)) AS x, arg_max(y, (ts, event_id)) AS y FROM e GROUP BY 1, 2),
 f AS (SELECT d, user_id, coalesce(x - lag(x) OVER w, 0) AS ret, y + 1 AS wgt, 50 - x AS sigf_a, y - 5 AS sigf_b FROM o WINDOW w AS (PARTITION BY user_id ORDER BY d)),
 lo AS (SELECT 'sigf_a' AS signal, d, user_id, ret, wgt, sigf_a AS v FROM f UNION ALL SELECT 'sigf_b', d, user_id, ret, wgt, sigf_b FROM f),
 po AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY signal, user_id ORDER BY d), 0) * wgt AS s FROM lo),
 tr AS (SELECT *, abs(s - lag(s) OVER (PARTITION BY signal, user_id ORDER BY d)) AS t FROM po),
 dt AS (SELECT signal, d, sum(abs(s)) AS gross, sum(s * ret) AS pnl, coalesce(sum(t), 0) AS trd, row_number() OVER (PARTITION BY signal ORDER BY d) AS cnt FROM tr GROUP BY 1, 2),
 dc AS (SELECT *, sum(pnl) OVER (PARTITION BY signal ORDER BY d) AS cum, pnl * pnl AS pnl2 FROM dt),
 mm AS (SELECT a.signal, a.d, a.cnt, a.cum, {mean("gross")} AS mg, {mean("pnl")} AS mp, {mean("trd")} AS mt, {mean("pnl2")} AS mp2 FROM dc a JOIN dc b ON a.signal = b.signal AND b.cnt <= a.cnt GROUP BY 1, 2, 3, 4),
 ms AS (SELECT *, max(cum) OVER w AS top, min(cum) OVER w AS low, CASE WHEN cnt = 1 THEN 0 ELSE sqrt(greatest(mp2 - mp * mp, 0)) END AS sd FROM mm WINDOW w AS (PARTITION BY signal ORDER BY d)),
 sc AS (SELECT signal, d, cnt, sqrt(365) * {gd("mp", "sd")} AS sr, 1e4 * {gd("mp", "mt")} AS rpt, {gd("mg", "mt")} AS hold, 100 * {gd("(top - cum)", "mg")} AS dd, 100 * {gd("(cum - low)", "mg")} AS ddn FROM ms),
 {name} AS (SELECT *, CASE WHEN hold < 50 AND cnt > 5 AND sr > 1 AND dd < 400 AND rpt > 100 THEN 1 WHEN hold < 50 AND cnt > 5 AND sr < -1 AND ddn < 400 AND rpt < -100 THEN -1 ELSE 0 END AS sel FROM sc) {tail}"""


@query("signal_scores", _kb_sql("k", f"SELECT signal, d, {s6(sr='sr', rpt='rpt', hold='hold', dd='dd', ddn='ddn')}, sel FROM k"))
def signal_scores(spark, d):
    out = B.signal_scores(_selectable(spark, d), ["sigf_a", "sigf_b"], "ret", 5, Panel("d", "user_id"), "wgt", _KB_RULES)
    return out.select("signal", "d", *r6("sr", "rpt", "hold", "dd", "ddn"), "sel")


@query("select_best", _kb_sql("k", f"""SELECT f.d, f.user_id, {s6(sig_kbest="CASE WHEN abs(a.sel) + abs(b.sel) > 0 THEN (a.sel * sigf_a + b.sel * sigf_b) / (abs(a.sel) + abs(b.sel)) ELSE 0 END")} FROM f JOIN k a ON a.signal = 'sigf_a' AND a.d = f.d JOIN k b ON b.signal = 'sigf_b' AND b.d = f.d"""))
def select_best(spark, d):
    return B.select_best(_selectable(spark, d), ["sigf_a", "sigf_b"], "ret", 5, Panel("d", "user_id"), "wgt", _KB_RULES).select("d", "user_id", *r6("sig_kbest"))


@query("selection_stats", _kb_sql("k", f"SELECT signal, {s6(abs_sel='avg(abs(sel))', sel='avg(sel)', sr='avg(sr)', hold='avg(hold)')}, row_number() OVER (ORDER BY abs(avg(sel)) DESC, signal) AS rank FROM k GROUP BY signal"))
def selection_stats(spark, d):
    out = B.selection_stats(B.signal_scores(_selectable(spark, d), ["sigf_a", "sigf_b"], "ret", 5, Panel("d", "user_id"), "wgt", _KB_RULES))
    return out.select("signal", *r6("abs_sel", "sel", "sr", "hold"), F.col("rank").cast("long").alias("rank"))


# --- learning ----------------------------------------------------------------
@query("time_splits")
def time_splits(spark, d):
    parts = L.time_splits(events(spark, d), Panel("d", "user_id"), 10, 5, 1, 7)
    return spark.createDataFrame([tuple(float(v) for v in s.values()) for s in parts] or [(0.0,) * 4], "train_start double, train_end double, test_start double, test_end double")


@query("walk_forward")
def walk_forward(spark, d):
    from pyspark.ml.regression import LinearRegression

    e = _signals(spark, d)
    p = Panel("d", "user_id")
    out = L.walk_forward(e.withColumnRenamed("forward_dx_lag-1", "fw"), ["sig_a", "sig_b"], "fw", lambda: LinearRegression(regParam=0.1), L.time_splits(e, p, 10, 5, 1, 7), p)
    return out.select("event_id", *r6("model_fw"))


@query("local_models")
def local_models(spark, d):
    e = _signals(spark, d).withColumnRenamed("forward_dx_lag-1", "fw").withColumn("train", F.col("d") < F.lit("2024-01-20").cast("date"))
    return L.local_models(e, "event_type", ["sig_a", "sig_b"], "fw", "train", L.LeastSquares).select("event_id", *r6("local_fw"))


@query("cluster_codes")
def cluster_codes(spark, d):
    p = Panel("ts", "user_id")
    e = events(spark, d)
    parts = L.time_splits(e.select(F.to_date("ts").alias("ts"), "user_id"), p, 10, 7, 1, 10)
    return L.cluster_codes(e, "x", parts, 4, p)


@query("forecast_error", f"WITH {E_SQL}, k AS (SELECT event_id, event_type, x, lag(x) OVER ({OW}) AS p FROM e) SELECT event_type, {s6(mae='avg(abs(x - p))')} FROM k GROUP BY 1")
def forecast_error(spark, d):
    return L.mean_absolute_error(X.lag(events(spark, d), ["x"], [1], EV), "x", "x_lag1", ["event_type"]).select("event_type", *r6("mae"))


# --- strategy pipelines ------------------------------------------------------
BARS = Panel("d", "event_type", ())


def bars(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars per event type: five instruments."""
    e = events(spark, d)
    order = F.struct("ts", "event_id")
    return e.groupBy("d", "event_type").agg(F.max_by("x", order).alias("close"), F.sum("y").alias("volume"), F.sum("x").alias("taker"), F.sum(F.col("x") + F.col("y")).alias("total"))


def bar_query(name: str, build: Callable[[DataFrame], DataFrame], outs: dict[str, str]) -> None:
    QUERIES[name] = lambda spark, d: build(bars(spark, d)).select("d", "event_type", *[F.round(F.col(f"`{c}`").cast("double") + OFF_TIES, 6).alias(o) for o, c in outs.items()])


def _prepared(b: DataFrame) -> DataFrame:
    return PL.remove_market(_in_universe(b), "tret", BARS, period=20)


def _in_universe(b: DataFrame) -> DataFrame:
    return PL.define_universe(PL.prepare(b, BARS, 5, period=20), BARS, 3, 5)


bar_query("pipeline_prepare", lambda b: PL.prepare(b, BARS, 5, 20, 20), {"tret": "tret", "clip": "tret_clipqtl", "wgt": "wgt", "sigf_wgt": "sigf_wgt", "age": "ipocnt"})
bar_query("pipeline_universe", _in_universe, {"univ": "univ", "wgt": "wgt"})
bar_query("pipeline_remove_market", _prepared, {"v": "tret_xmkt"})
bar_query("pipeline_forward", lambda b: PL.forward_returns(_in_universe(b), "tret", BARS, [3], period=20), {"f1": "forward_fh1", "f3": "forward_fh3", "c1": "forward_fh1_clip", "c3": "forward_fh3_clip"})
bar_query("pipeline_mean_reversion", lambda b: PL.mean_reversion(b, "close", BARS, [3, 8]), {"v": "sigf_close_mual"})
bar_query("pipeline_momentum", lambda b: PL.momentum(b, "close", BARS, 3, 8, 5, 20), {"macd": "sigf_close_macd3x8_appops20", "sig": "sigf_close_macd3x8x5_appops20", "skew": "sigf_close_ewmskew8_appops20", "kurt": "sigf_close_ewmkurt8_appops20"})
bar_query("pipeline_volatility", lambda b: PL.volatility(b, "close", BARS, 3, 8, 20), {"v": "sigf_close_volratio3x8_appops20"})
bar_query("pipeline_gaps", lambda b: PL.gaps(b, "close", BARS, 5, 1, 0.5, 4), {"gap": "close_gap5", "smooth": "close_gap5_ewm4"})
bar_query("pipeline_taker_share", lambda b: PL.taker_share(b, "taker", "total", BARS, 3, 8, 20), {"v": "takerpct", "rank": "sigf_takerpct_ewm3_appops20"})
bar_query("pipeline_turnover", lambda b: PL.turnover_excess(b.withColumn("turnover", F.col("close") * F.col("volume")), BARS, 3, 8), {"v": "sigf_turnexc_macd3x8"})
bar_query("pipeline_turnover_ratio", lambda b: PL.turnover_ratio(b.withColumn("turnover", F.col("close") * F.col("volume")), BARS, 3, 8, 20), {"v": "sigf_turnover_macdr3x8_appops20"})
bar_query("pipeline_point_figure", lambda b: PL.point_figure(_prepared(b), "tret", BARS, 0.5, 2, 4), {"dir": "pfp_dir", "dur": "pfp_dur", "turns": "pfp_dir_chg_ewm4"})
bar_query("pipeline_pnl", lambda b: PL.pnl_features(_prepared(b).withColumn("sig", F.signum("tret_xmkt")), "sig", "tret_xmkt", BARS, 5, 20), {"sharpe": "sigf_sig_ewmsharpe5_appops20", "dd": "sigf_sig_ddpct_appops20"})
bar_query("pipeline_pairs", lambda b: PL.pairs(b, "close", BARS, 10, 5, 1), {"v": "close_pairs"})
bar_query("pipeline_forecast", lambda b: PL.naive_forecast(b, "close", BARS, 3, 5), {"pred": "pred"})


bar_query("pipeline_svd_return", lambda b: PL.svd_return(_prepared(b), "tret_xmkt", BARS, 10, 5, 2), {"v": "sret_svd", "d0": "sigf_d_0"})
bar_query("pipeline_cluster_return", lambda b: PL.cluster_return(_prepared(b), "tret_xmkt", BARS, L.time_splits(b, BARS, 10, 7, 1, 10), 2, period=20), {"v": "sret_kmeans", "cat": "kmeans_cat"})


def research_query(kind: str) -> None:
    def run(spark, d):
        out = PL.research_stats(bars(spark, d), BARS, 3, kind=kind, period=20, rules=_KB_RULES, splits={"lookback": 15, "every": 5, "least": 10})
        return out.select("signal", "n", *r6("sr", "ann_pnl", "mdd", "rpt", "rog"))

    QUERIES["pipeline_research" if kind == "none" else f"pipeline_research_{kind}"] = run


for _kind in PL.KINDS:
    research_query(_kind)

OD = Panel("date", "k")


def daily_sales(spark, d):
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("k")).agg(F.sum("o_totalprice").alias("x"))


_DSQL = "ds AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS k, sum(o_totalprice) AS x FROM orders GROUP BY 1, 2)"


@query("forecast_lagged", f"WITH {_DSQL} SELECT l.date, l.k, {s6(pred='r.x')} FROM ds l ASOF LEFT JOIN (SELECT date + 364 AS t, k, x FROM ds) r ON l.k = r.k AND l.date >= r.t")
def forecast_lagged(spark, d):
    return PL.lagged_forecast(daily_sales(spark, d), "x", OD).select("date", "k", *r6("pred"))


_FS = weighted("kf", 10, "lg", "lgs")


@query("forecast_seasonal", f"""WITH {_DSQL}, nb AS (SELECT *, row_number() OVER (ORDER BY date, k) AS event_id, k AS user_id, row_number() OVER (PARTITION BY k ORDER BY date) AS rn FROM ds WHERE date < DATE '1997-06-01'),
 lgs AS (SELECT *, lag(ln(1 + x)) OVER (PARTITION BY k ORDER BY date) AS lg FROM nb), {_FS}, off AS (SELECT date, k, ln(1 + x) - kf.m1 AS v, kf.m1 AS m FROM lgs LEFT JOIN kf USING (event_id))
 SELECT l.date, l.k, {s6(pred='CASE WHEN r.v IS NOT NULL THEN exp(greatest(-0.5, least(0.5, r.v)) + l.m) / 1e3 END')} FROM off l ASOF LEFT JOIN (SELECT date + 364 AS t, k, v FROM off) r ON l.k = r.k AND l.date >= r.t""")
def forecast_seasonal(spark, d):
    out = PL.seasonal_forecast(daily_sales(spark, d).where("date < date'1997-06-01'"), "x", OD)
    return out.withColumn("pred", (F.col("pred") + 1) / 1e3).select("date", "k", *r6("pred"))


@query("forecast_holidays")
def forecast_holidays(spark, d):
    return PL.seasonal_forecast(daily_sales(spark, d), "x", OD, links=Y.event_links(Y.event_calendar(spark, 1994, 2002))).select("date", "k", *r6("pred"))


BAR_SQL = f"""{E_SQL}, bb AS (SELECT d, event_type, arg_max(x, (ts, event_id)) AS close, sum(y) AS volume, sum(x) AS taker, sum(x + y) AS total FROM e GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (ORDER BY d, event_type) AS event_id, event_type AS user_id, row_number() OVER (PARTITION BY event_type ORDER BY d) AS rn FROM bb)"""
_BW = "OVER (PARTITION BY event_type ORDER BY d)"


def ranked(name: str, src: str, col: str, window: int) -> str:
    """CTE of the average rank among the last rows of the whole stream of bars, scaled to -1..1; missing values do not count."""
    return f"""{name} AS (SELECT a.event_id, CASE WHEN count(w.{col}) = {window} AND a.{col} IS NOT NULL THEN 2 * (sum((w.{col} < a.{col})::INT) + (sum((w.{col} = a.{col})::INT) + 1) / 2.0 - 1) / {window - 1} - 1 END AS r
  FROM {src} a JOIN {src} w ON w.event_id BETWEEN a.event_id - {window - 1} AND a.event_id GROUP BY a.event_id, a.{col})"""


ORACLES["pipeline_forecast"] = f"WITH {BAR_SQL}, lg AS (SELECT *, lag(close, 3) {_BW} AS lc FROM b), {weighted('kf', 5, 'lc', 'lg')} SELECT d, event_type, {s6(pred='kf.m1')} FROM lg LEFT JOIN kf USING (event_id)"
ORACLES["pipeline_gaps"] = f"""WITH {BAR_SQL}, g AS (SELECT *, max(close) OVER (PARTITION BY event_type ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mx, min(close) OVER (PARTITION BY event_type ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mn FROM b),
g2 AS (SELECT *, lag(mx) {_BW} AS lx, lag(mn) {_BW} AS ln FROM g), {weighted('k4', 4, 'close', 'b')},
g3 AS (SELECT g2.*, CASE WHEN close > lx + 0.5 * sqrt(greatest(k4.m2 - k4.m1 * k4.m1, 0)) THEN 1.0 WHEN close < ln - 0.5 * sqrt(greatest(k4.m2 - k4.m1 * k4.m1, 0)) THEN -1.0 ELSE 0.0 END AS gap FROM g2 JOIN k4 USING (event_id)),
{weighted('kg', 4, 'gap', 'g3')} SELECT d, event_type, {s6(gap='gap', smooth='kg.m1')} FROM g3 JOIN kg USING (event_id)"""
ORACLES["pipeline_turnover"] = f"""WITH {BAR_SQL}, t AS (SELECT *, close * volume AS tv FROM b), t2 AS (SELECT *, coalesce(ln(1 + tv) - lag(ln(1 + tv)) {_BW}, 0) AS df FROM t), t3 AS (SELECT *, df - avg(df) OVER (PARTITION BY d) AS dm FROM t2), t4 AS (SELECT *, sum(dm) {_BW} AS cs FROM t3),
{weighted('a3', 3, 'cs', 't4')}, {weighted('a8', 8, 'cs', 't4')} SELECT d, event_type, {s6(v='a3.m1 - a8.m1')} FROM t4 JOIN a3 USING (event_id) JOIN a8 USING (event_id)"""
ORACLES["pipeline_turnover_ratio"] = f"""WITH {BAR_SQL}, t4 AS (SELECT *, close * volume AS tv FROM b), {weighted('b3', 3, 'tv', 't4')}, {weighted('b8', 8, 'tv', 't4')}, m AS (SELECT event_id, {gd('b3.m1', 'b8.m1', 1.0)} - 1 AS v FROM b3 JOIN b8 USING (event_id)), {ranked('rk', 'm', 'v', 20)}
SELECT d, event_type, {s6(v='rk.r')} FROM b JOIN rk USING (event_id)"""
ORACLES["pipeline_taker_share"] = f"""WITH {BAR_SQL}, t AS (SELECT *, {gd('taker', 'total', 0.5)} - 0.5 AS tp FROM b), {weighted('k3', 3, 'tp', 't')}, m AS (SELECT event_id, k3.m1 AS v FROM k3), {ranked('rk', 'm', 'v', 20)}
SELECT d, event_type, {s6(v='tp', rank='rk.r')} FROM t JOIN rk USING (event_id)"""
ORACLES["pipeline_volatility"] = f"""WITH {BAR_SQL}, {weighted('k3', 3, 'close', 'b')}, {weighted('k8', 8, 'close', 'b')}, sd AS (SELECT event_id, CASE WHEN rn = 1 THEN 0 ELSE sqrt(greatest(k3.m2 - k3.m1 * k3.m1, 0)) END AS s3, CASE WHEN rn = 1 THEN 0 ELSE sqrt(greatest(k8.m2 - k8.m1 * k8.m1, 0)) END AS s8 FROM b JOIN k3 USING (event_id) JOIN k8 USING (event_id)),
m AS (SELECT event_id, {gd('s3', 's8', 1.0)} - 1 AS v FROM sd), {ranked('rk', 'm', 'v', 20)} SELECT d, event_type, {s6(v='rk.r')} FROM b JOIN rk USING (event_id)"""

ORACLES["ata"] = f"""WITH RECURSIVE {E_SQL}, f AS (SELECT event_id, user_id, rn, x AS s, CAST(0 AS DOUBLE) AS b FROM e WHERE rn = 1
UNION ALL SELECT event_id, user_id, rn, n AS s, (n - s) / rn + (1 - 1.0 / rn) * b FROM (SELECT e.event_id, e.user_id, e.rn, f.s, f.b, least(1.0, 2.0 / e.rn) * e.x + (1 - least(1.0, 2.0 / e.rn)) * (f.s + f.b) AS n FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
SELECT event_id, {s6(x_ata2x1='s + b')} FROM f"""
ORACLES["point_figure"] = f"""WITH RECURSIVE {E_SQL}, q AS (SELECT event_id, user_id, rn, epoch_us(ts) AS t, floor(x / 5.0) AS px FROM e),
f AS (SELECT event_id, user_id, rn, t, px, CAST(1 AS DOUBLE) AS dir, px AS el, px AS lo, px AS hi, t AS since FROM q WHERE rn = 1
UNION ALL SELECT event_id, user_id, rn, t, px, CASE WHEN turn THEN -dir ELSE dir END, CASE WHEN turn THEN px ELSE el END, CASE WHEN turn THEN px ELSE lo2 END, CASE WHEN turn THEN px ELSE hi2 END, CASE WHEN turn THEN t ELSE since END
  FROM (SELECT *, CASE WHEN dir > 0 THEN px <= hi2 - 3 ELSE px >= lo2 + 3 END AS turn FROM (SELECT q.event_id, q.user_id, q.rn, q.t, q.px, f.dir, f.el, f.since, CASE WHEN f.dir < 0 THEN least(f.lo, q.px) ELSE f.lo END AS lo2, CASE WHEN f.dir > 0 THEN greatest(f.hi, q.px) ELSE f.hi END AS hi2 FROM f JOIN q ON q.user_id = f.user_id AND q.rn = f.rn + 1)))
SELECT event_id, px * 5 AS px, dir, el * 5 AS el, {s6(perf="CASE WHEN el <> 0 THEN px / el - 1 ELSE 0 END")}, px - el AS perf2, CAST(t - since AS DOUBLE) AS dur FROM f"""

_HW = []
for _a, _b, _g in ((5, 20, 30), (10, 0, 30)):
    _LEVEL, _TREND, _SEASON = (0.0 if h == 0 else 1 - 0.5 ** (1 / h) for h in (_a, _b, _g))
    _HW.append(f"""f{_a} AS (SELECT event_id, user_id, rn, x AS l, CAST(0 AS DOUBLE) AS b, list_transform(range(7), lambda i: CAST(1 AS DOUBLE)) AS s, x AS v FROM q WHERE rn = 1
 UNION ALL SELECT event_id, user_id, rn, l2, b2, list_transform(range(7), lambda i: CASE WHEN i = slot THEN s2 ELSE s[i + 1] END), (l2 + b2) * s2 FROM
 (SELECT *, greatest(0.05, least(20, {_SEASON!r} * x / l2 + (1 - {_SEASON!r}) * s[slot + 1])) AS s2 FROM (SELECT *, {_TREND!r} * (l2 - l) + (1 - {_TREND!r}) * b AS b2 FROM
 (SELECT q.event_id, q.user_id, q.rn, q.x, q.slot, f.l, f.b, f.s, {_LEVEL!r} * q.x / f.s[q.slot + 1] + (1 - {_LEVEL!r}) * (f.l + f.b) AS l2 FROM f{_a} f JOIN q ON q.user_id = f.user_id AND q.rn = f.rn + 1))))""")
ORACLES["holt_winters"] = f"""WITH RECURSIVE {E_SQL}, q AS (SELECT *, (epoch_us(ts) // 86400000000) % 7 AS slot FROM e), {", ".join(_HW)}
SELECT f5.event_id, {s6(x_5x20x30x7_1="f5.v", x_10x0x30x7_1="f10.v")} FROM f5 JOIN f10 USING (event_id)"""
ORACLES["holt_level"] = f"""WITH RECURSIVE {E_SQL}, f AS (SELECT event_id, user_id, rn, x AS s, CAST(0 AS DOUBLE) AS b FROM e WHERE rn = 1
UNION ALL SELECT event_id, user_id, rn, n, 0.1 * (n - s) + 0.9 * b FROM (SELECT e.event_id, e.user_id, e.rn, f.s, f.b, 0.3 * e.x + 0.7 * (f.s + f.b) AS n FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
SELECT event_id, {s6(v="s + b")} FROM f"""

def prepared(smooth: float, near: float) -> str:
    """CTEs up to p3: the prepared bars with the half-life of their turnover, and the one that ranks it (uw)."""
    return f"""{BAR_SQL}, p0 AS (SELECT *, d AS ts, close * volume AS tv, coalesce(close - lag(close) {_BW}, 0) AS df FROM b), p1 AS (SELECT *, {gd('df', 'close')} AS tret FROM p0),
{weighted('kt', smooth, 'tv', 'p1')}, {weighted('ku', near, 'tv', 'p1')}, p2 AS (SELECT p1.*, kt.m1 AS tw, ku.m1 AS uw FROM p1 JOIN kt USING (event_id) JOIN ku USING (event_id)), {so_far('g', 'tret', [0.05, 0.95], 20, 'p2')}, {so_far('h', 'tw', [0.8], 20, 'p2')},
p3 AS (SELECT p2.*, h.q0 AS top, coalesce(CASE WHEN tw < h.q0 THEN tw ELSE h.q0 END, 0) AS wgt, CASE WHEN tret < g.q0 THEN g.q0 WHEN tret > g.q1 THEN g.q1 ELSE tret END AS clip
  FROM p2 JOIN g_n USING (event_id) LEFT JOIN g ON g.b = g_n.b LEFT JOIN h ON h.b = g_n.b)"""


ORACLES["pipeline_prepare"] = f"WITH {prepared(5, 5)} SELECT d, event_type, {s6(tret='tret', clip='clip', wgt='wgt', sigf_wgt='CASE WHEN top <> 0 THEN wgt / top END', age='least(rn, 20) / 20.0')} FROM p3"


def universe(smooth: float, near: float) -> str:
    return f"""{prepared(smooth, near)}, p4 AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY uw, event_type) - 1 AS r0, count(*) OVER (PARTITION BY d) AS nd FROM p3),
p5 AS (SELECT * EXCLUDE (wgt), (CASE WHEN nd <= 1 THEN 0 ELSE nd - r0 END <= 3)::INT AS univ, wgt * (CASE WHEN nd <= 1 THEN 0 ELSE nd - r0 END <= 3)::INT AS wgt FROM p4)"""


_UNIV = universe(5, 5)
ORACLES["pipeline_universe"] = f"WITH {_UNIV} SELECT d, event_type, {s6(univ='univ', wgt='wgt')} FROM p5"
ORACLES["pipeline_remove_market"] = f"""WITH {_UNIV}, p6 AS (SELECT *, tret - CASE WHEN sum(wgt) OVER (PARTITION BY d) > 0 THEN sum(wgt * tret) OVER (PARTITION BY d) / sum(wgt) OVER (PARTITION BY d) ELSE 0 END AS raw FROM p5), {so_far('x', 'raw', [0.02, 0.98], 20, 'p6')}
SELECT d, event_type, {s6(v='CASE WHEN wgt = 0 THEN 0 ELSE univ * CASE WHEN raw < x.q0 THEN x.q0 WHEN raw > x.q1 THEN x.q1 ELSE raw END END')} FROM p6 JOIN x_n USING (event_id) LEFT JOIN x ON x.b = x_n.b"""


def less_market(x: str) -> str:
    """A value less its weighted mean at the time, in and weighted by the universe."""
    total = f"sum(CASE WHEN {x} IS NOT NULL THEN wgt END) OVER (PARTITION BY d)"
    return f"({x} - CASE WHEN {total} > 0 THEN sum(wgt * {x}) OVER (PARTITION BY d) / {total} ELSE 0 END)"


def held(x: str, q: str) -> str:
    return f"CASE WHEN {x} < {q}.q0 THEN {q}.q0 WHEN {x} > {q}.q1 THEN {q}.q1 ELSE {x} END"


def reversion(name: str, src: str, col: str, halves: list[int]) -> str:
    """CTE of minus the mean over half-lives of the smoothed value over its deviation, scaled at each time."""
    ks = [f"{name}_k{h}" for h in halves]
    sd = " + ".join(f"CASE WHEN s.rn = 1 THEN 0 ELSE sqrt(greatest({k}.m2 - {k}.m1 * {k}.m1, 0)) END" for k in ks)
    zs = ", ".join(f"{cl(gd(f'{k} * sqrt({h}.0)', 'sd'))} AS z{h}" for k, h in zip(ks, halves))
    var = lambda z: f"(sum({z} * {z}) OVER w / count({z}) OVER w - pow(sum({z}) OVER w / count({z}) OVER w, 2)) * count({z}) OVER w / (count({z}) OVER w - 1)"
    devs = ", ".join(f"CASE WHEN count(z{h}) OVER w >= 2 THEN sqrt(greatest({var(f'z{h}')}, 0)) ELSE 0 END AS d{h}" for h in halves)
    mean = " + ".join(f"coalesce({cl(gd(f'z{h}', f'd{h}'))}, 0)" for h in halves)
    return f"""{", ".join(weighted(k, h, col, src) for k, h in zip(ks, halves))},
 {name}_s AS (SELECT s.event_id, s.d, {", ".join(f"{k}.m1 AS {k}" for k in ks)}, ({sd}) / {len(halves)} AS sd FROM {src} s {" ".join(f"JOIN {k} USING (event_id)" for k in ks)}),
 {name}_z AS (SELECT event_id, d, {zs} FROM {name}_s), {name}_d AS (SELECT *, {devs} FROM {name}_z WINDOW w AS (PARTITION BY d)),
 {name} AS (SELECT event_id, -{cl(f"({mean}) / {len(halves)}")} AS v FROM {name}_d)"""


ORACLES["pipeline_mean_reversion"] = f"WITH {BAR_SQL}, {reversion('mr', 'b', 'close', [3, 8])} SELECT d, event_type, {s6(v='mr.v')} FROM b JOIN mr USING (event_id)"

_AHEAD = f"""f0 AS (SELECT *, avg(tret) OVER (PARTITION BY event_type ORDER BY d ROWS 2 PRECEDING) AS sm FROM p5), f1 AS (SELECT *, lead(tret) {_BW} AS a1, lead(sm, 3) {_BW} AS a3 FROM f0),
 f2 AS (SELECT *, CASE WHEN wgt = 0 THEN 0 ELSE univ * {less_market('a1')} END AS fh1, CASE WHEN wgt = 0 THEN 0 ELSE univ * {less_market('a3')} END AS fh3 FROM f1)"""
ORACLES["pipeline_forward"] = f"""WITH {_UNIV}, {_AHEAD}, {so_far('x', 'fh1', [0.03, 0.97], 20, 'f2')}, {so_far('y', 'fh3', [0.03, 0.97], 20, 'f2')}
SELECT d, event_type, {s6(f1='fh1', f3='fh3', c1=held('fh1', 'x'), c3=held('fh3', 'y'))} FROM f2 JOIN x_n USING (event_id) LEFT JOIN x ON x.b = x_n.b LEFT JOIN y ON y.b = x_n.b"""

ORACLES["pipeline_research"] = f"""WITH {universe(43_200, 60)}, p6 AS (SELECT *, {less_market('tret')} AS raw FROM p5), {so_far('x', 'raw', [0.02, 0.98], 20, 'p6')},
 p7 AS (SELECT p6.*, CASE WHEN wgt = 0 THEN 0 ELSE univ * {held('raw', 'x')} END AS xm FROM p6 JOIN x_n USING (event_id) LEFT JOIN x ON x.b = x_n.b), {reversion('mr', 'p7', 'xm', [5, 10])}, {_AHEAD},
 po AS (SELECT f2.event_type, f2.d AS date, f2.fh1, coalesce(mr.v * f2.univ, 0) * coalesce(f2.wgt, 1) AS s FROM f2 JOIN mr USING (event_id)), tr AS (SELECT *, abs(s - lag(s) OVER (PARTITION BY event_type ORDER BY date)) AS t FROM po),
 dy AS (SELECT date, coalesce(sum(s * fh1), 0) AS gross, coalesce(sum(t), 0) AS traded, sum(abs(s)) AS gmv FROM tr GROUP BY 1),
 c AS (SELECT *, sum(gross) OVER (ORDER BY date) AS cum, date - lag(date) OVER (ORDER BY date) AS gap FROM dy), q AS (SELECT *, max(cum) OVER (ORDER BY date) - cum AS dd FROM c)
SELECT 'sig_none' AS signal, count(*) AS n, {s6(sr='sqrt(365 / median(gap)) * avg(gross) / (stddev_samp(gross) + 1e-6)', ann_pnl='avg(gross) * 365 / median(gap) / 1e3', mdd='100 * ' + gd('max(dd)', 'avg(gmv)'), rpt='1e4 * ' + gd('sum(gross)', 'sum(traded)'), rog='1e2 * ' + gd('sum(gross)', 'avg(gmv)'))} FROM q HAVING count(*) >= 10"""

ORACLES["pipeline_point_figure"] = f"""WITH RECURSIVE {_UNIV}, lp AS (SELECT event_id, event_type, d, rn, CASE WHEN 1 + tret > 0 THEN ln(1 + tret) END AS lg FROM p5),
 q AS (SELECT event_id, event_type, d, rn, epoch_us(d) AS t, floor((1 + coalesce(sum(lg) OVER (PARTITION BY event_type ORDER BY d ROWS UNBOUNDED PRECEDING), 0)) / 0.5) AS box FROM lp),
 f AS (SELECT event_id, event_type, d, rn, t, CAST(1 AS DOUBLE) AS dir, box AS ext, t AS since FROM q WHERE rn = 1
 UNION ALL SELECT event_id, event_type, d, rn, t, CASE WHEN turn THEN -dir ELSE dir END, CASE WHEN turn THEN box ELSE ext2 END, CASE WHEN turn THEN t ELSE since END FROM (SELECT *, dir * (ext2 - box) >= 2 AS turn FROM
 (SELECT q.*, f.dir, f.since, CASE WHEN f.dir > 0 THEN greatest(f.ext, q.box) ELSE least(f.ext, q.box) END AS ext2 FROM f JOIN q ON q.event_type = f.event_type AND q.rn = f.rn + 1))),
 pg AS (SELECT *, event_type AS user_id, coalesce(sign(abs(dir - lag(dir) {_BW})), 0) AS chg FROM f), {weighted('kc', 4, 'chg', 'pg')}
SELECT d, event_type, {s6(dir='dir', dur='t - since', turns='kc.m1')} FROM pg JOIN kc USING (event_id)"""


def picked(order: str) -> str:
    """CTEs of the pairs that a greedy pass in this order takes, each code once a time."""
    return f"""rk AS (SELECT dtsi, dscode1, dscode2, dist, row_number() OVER (PARTITION BY dtsi ORDER BY {order}, dscode1, dscode2) AS i FROM pd),
 gr AS (SELECT DISTINCT dtsi, '' AS dscode1, '' AS dscode2, CAST(0 AS DOUBLE) AS dist, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, FALSE AS kept FROM rk
 UNION ALL SELECT dtsi, dscode1, dscode2, dist, i, CASE WHEN free THEN list_concat(used, [dscode1, dscode2]) ELSE used END, free FROM
 (SELECT rk.*, gr.used, NOT list_contains(gr.used, rk.dscode1) AND NOT list_contains(gr.used, rk.dscode2) AS free FROM gr JOIN rk ON rk.dtsi = gr.dtsi AND rk.i = gr.i + 1))"""


ORACLES["pick_pairs"] = f"WITH RECURSIVE {_G}, {picked('dist')} SELECT dtsi, dscode1, dscode2, {s6(dist='dist')} FROM gr WHERE kept"
ORACLES["pipeline_pairs"] = f"""WITH RECURSIVE {_G}, {picked('1 - coalesce(dist, 0)')}, {_CHOSEN.replace('FROM pd WHERE dist > 0', 'FROM gr WHERE kept')},
 lg AS (SELECT d, dscode1 AS c, coalesce(serie1, 0) - coalesce(serie2, 0) AS v FROM px UNION ALL SELECT d, dscode2, coalesce(serie2, 0) - coalesce(serie1, 0) FROM px), cp AS (SELECT d, c AS event_type, avg(v) AS v FROM lg GROUP BY 1, 2)
SELECT o.d, o.event_type, {s6(v='coalesce(cp.v, 0)')} FROM o LEFT JOIN cp USING (d, event_type)"""
ORACLES["time_splits"] = f"""WITH {E_SQL}, s AS (SELECT epoch_us(d) AS t FROM (SELECT DISTINCT d FROM e)), g AS (SELECT min(t) AS lo, max(t) AS hi, median(step) AS u FROM (SELECT t, t - lag(t) OVER (ORDER BY t) AS step FROM s)),
 n AS (SELECT lo, hi, u, lo + (7 + 5 * unnest(range(0, CAST((hi - lo) / (5 * u) AS BIGINT) + 1))) * u AS stop FROM g), p AS (SELECT CAST(greatest(lo, stop - 10 * u) AS DOUBLE) AS train_start, CAST(stop AS DOUBLE) AS train_end, CAST(stop + u AS DOUBLE) AS test_start, CAST(least(hi, stop + 6 * u) AS DOUBLE) AS test_end FROM n WHERE stop + u < hi)
SELECT * FROM p UNION ALL SELECT 0, 0, 0, 0 WHERE NOT EXISTS (FROM p)"""
