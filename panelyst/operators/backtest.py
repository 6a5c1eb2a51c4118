"""Gain and cost of signals, their statistics and signal selection."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from ..functions import ewm as E
from ..panel import Panel, number, ratio

PANEL = Panel()


def impact_bps(spread_bps: Column, sigma_bps: Column, traded: Column, turnover: Column) -> Column:
    """Square-root impact in basis points: fixed shares of the spread and of the volatility."""
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio(traded, turnover)))
    return 0.15 * spread_bps + 0.125 * sigma_bps * F.sqrt(part)


def long_signals(df: DataFrame, signals: list[str], keep: list[str]) -> DataFrame:
    """One row per observation and signal, so that all signals go through one plan."""
    return df.unpivot(keep, [F.col(s) for s in signals], "signal", "pos")


def daily_pnl(df: DataFrame, signals: list[str], forward: str, p: Panel = PANEL, wgt: str | None = None, fee_bps: float = 0.0, by_day: bool = True) -> DataFrame:
    """Per signal and day: gross gain, traded and held value, fee and net gain.

    A position is signal times weight, missing ones 0 (a missing weight 1); an
    instrument's first trade does not count.
    """
    rows = long_signals(df, signals, [p.ts, p.key, *p.tie, forward, *([wgt] if wgt else [])])
    pos = F.coalesce(number("pos"), F.lit(0.0)) * (F.coalesce(number(wgt), F.lit(1.0)) if wgt else F.lit(1.0))
    rows = rows.withColumn("_s", pos)
    w = W.partitionBy("signal", p.key).orderBy(p.ts, *p.tie)
    rows = rows.withColumn("_t", F.abs(F.col("_s") - F.lag("_s").over(w)))
    when = F.to_date(p.ts) if by_day else F.col(p.ts)
    days = rows.groupBy("signal", when.alias("date")).agg(
        F.coalesce(F.sum(F.col("_s") * number(forward)), F.lit(0.0)).alias("gross"), F.coalesce(F.sum("_t"), F.lit(0.0)).alias("traded"), F.sum(F.abs("_s")).alias("gmv")
    )
    return days.withColumn("fee", F.col("traded") * fee_bps / 1e4).withColumn("net", F.col("gross") - F.col("fee"))


def daily_stats(days: DataFrame, pnl: str = "gross", least: int = 10, days_per_year: float = 365.0) -> DataFrame:
    """Per signal: sharpe ratio, yearly gain in thousands, drawdown, gain per trade and per value; from ``least`` days on."""
    w = W.partitionBy("signal").orderBy("date")
    summed = days.withColumns({"_cum": F.sum(pnl).over(w), "_gap": F.datediff("date", F.lag("date").over(w))})
    deep = summed.withColumn("_dd", F.max("_cum").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("_cum"))
    agg = deep.groupBy("signal").agg(
        F.count("date").alias("n"), F.avg(pnl).alias("m"), F.stddev_samp(pnl).alias("s"), F.sum(pnl).alias("total"), F.sum("traded").alias("traded"), F.avg("gmv").alias("gmv"), F.max("_dd").alias("dd"),
        (days_per_year / F.percentile("_gap", 0.5)).alias("f"),
    )
    return agg.where(F.col("n") >= least).select(
        "signal", "n", (F.sqrt("f") * F.col("m") / (F.col("s") + 1e-6)).alias("sr"), (F.col("m") * F.col("f") / 1e3).alias("ann_pnl"),
        (100 * ratio(F.col("dd"), F.col("gmv"))).alias("mdd"), (1e4 * ratio(F.col("total"), F.col("traded"))).alias("rpt"), (1e2 * ratio(F.col("total"), F.col("gmv"))).alias("rog"),
    )


def drawdown_series(days: DataFrame, pnl: str = "gross") -> DataFrame:
    """Per signal and day: summed gain and how far it is below its height."""
    w = W.partitionBy("signal").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return days.withColumn("cum", F.sum(pnl).over(w)).withColumn("dd", F.max("cum").over(w) - F.col("cum"))


def return_ratios(days: DataFrame, pnl: str = "gross", per_year: float = 252.0) -> DataFrame:
    """Per signal: yearly sharpe ratio with the sample deviation, and summed gain over the deepest drawdown."""
    agg = drawdown_series(days, pnl).groupBy("signal").agg(F.avg(pnl).alias("m"), F.stddev_samp(pnl).alias("s"), F.sum(pnl).alias("t"), F.max("dd").alias("dd"))
    return agg.select("signal", (per_year**0.5 * ratio(F.col("m"), F.col("s"))).alias("ann_sr"), ratio(F.col("t"), F.col("dd")).alias("ret_dd"))


def capped(position: Column, turnover: Column, share: float) -> Column:
    """A position held within a share of the turnover."""
    most = share * F.abs(turnover)
    return F.greatest(-most, F.least(most, position))


#: Bounds of the selection rules: sharpe ratio, drawdown and gain per trade in percent and basis points, holding time in rows, least number of times.
RULES = {"sharpe": 3.0, "drawdown": 5.0, "per_trade": 2.0, "holding": 7200.0, "least": 100}


def signal_scores(df: DataFrame, signals: list[str], ret: str, halflife: float, p: Panel = PANEL, wgt: str = "wgt", rules: dict = {}) -> DataFrame:
    """Per signal and time: what it gained so far, by weighted means over times, and the choice (``sel``: 1, -1 or 0) that the rules make.

    A position is the signal of an instrument's row before, times the weight,
    missing signals being 0; so the choice at a time uses what is known then.
    An instrument's first trade does not count. Drawdowns are below the height
    (``dd``) and above the depth (``ddn``, for a signal to be turned around) of the
    summed gain, in percent of the mean gross value; ``rpt`` is the gain per
    trade in basis points, ``hold`` gross over traded value.
    """
    rules = RULES | rules
    rows = long_signals(df, signals, [p.ts, p.key, *p.tie, ret, wgt])
    w = W.partitionBy("signal", p.key).orderBy(p.ts, *p.tie)
    rows = rows.withColumn("_s", F.coalesce(F.lag(number("pos")).over(w), F.lit(0.0)) * number(wgt))
    rows = rows.withColumn("_t", F.abs(F.col("_s") - F.lag("_s").over(w)))
    times = rows.groupBy("signal", p.ts).agg(F.sum(F.abs("_s")).alias("_gross"), F.sum(F.col("_s") * number(ret)).alias("_pnl"), F.coalesce(F.sum("_t"), F.lit(0.0)).alias("_trd"))
    q = Panel(p.ts, "signal")
    mean = {k: E.ewm(F.col(f"_{k}"), halflife, q) for k in ("gross", "pnl", "trd")}
    micros = F.unix_micros(F.col(p.ts).cast("timestamp")) if dict(df.dtypes)[p.ts] not in ("bigint", "int") else F.col(p.ts)
    new = {"cnt": F.row_number().over(q.rows()), "_cum": F.sum("_pnl").over(q.so_far()), "_gap": micros - F.lag(micros).over(q.rows()), "_std": E.ewm_std(F.col("_pnl"), halflife, q)}
    scored = times.withColumns(new | {f"_{k}_ewm": v for k, v in mean.items()})
    scored = scored.withColumns({"_top": F.max("_cum").over(q.so_far()), "_low": F.min("_cum").over(q.so_far()), "_unit": F.percentile("_gap", 0.5).over(W.partitionBy("signal"))})
    scale = F.sqrt(86_400e6 * 365 / F.col("_unit"))
    out = scored.select(
        "signal", p.ts, "cnt", (scale * ratio(F.col("_pnl_ewm"), F.col("_std"))).alias("sr"), F.coalesce(1e4 * ratio(F.col("_pnl_ewm"), F.col("_trd_ewm")), F.lit(0.0)).alias("rpt"),
        F.coalesce(ratio(F.col("_gross_ewm"), F.col("_trd_ewm")), F.lit(0.0)).alias("hold"), (100 * ratio(F.col("_top") - F.col("_cum"), F.col("_gross_ewm"))).alias("dd"),
        (100 * ratio(F.col("_cum") - F.col("_low"), F.col("_gross_ewm"))).alias("ddn"),
    )
    both = (F.col("hold") < rules["holding"]) & (F.col("cnt") > rules["least"])
    long = both & (F.col("sr") > rules["sharpe"]) & (F.col("dd") < rules["drawdown"]) & (F.col("rpt") > rules["per_trade"])
    short = both & (F.col("sr") < -rules["sharpe"]) & (F.col("ddn") < rules["drawdown"]) & (F.col("rpt") < -rules["per_trade"])
    return out.withColumn("sel", F.when(long, 1).when(short, -1).otherwise(0))


def select_best(df: DataFrame, signals: list[str], ret: str, halflife: float, p: Panel = PANEL, wgt: str = "wgt", rules: dict = {}) -> DataFrame:
    """Add ``sig_kbest``: the mean of the signals that the rules choose at each time, turned around where they say so; 0 without any."""
    scores = signal_scores(df, signals, ret, halflife, p, wgt, rules)
    wide = scores.groupBy(p.ts).pivot("signal", signals).agg(F.max("sel"))
    picks = [f"_pick{i}" for i in range(len(signals))]
    out = df.join(wide.select(p.ts, *[F.col(f"`{s}`").alias(k) for s, k in zip(signals, picks)]), p.ts, "left")
    total = sum((F.coalesce(number(s), F.lit(0.0)) * F.col(k) for s, k in zip(signals, picks)), F.lit(0.0))
    used = sum((F.abs(F.col(k)) for k in picks), F.lit(0))
    return out.withColumn("sig_kbest", F.when(used > 0, total / used).otherwise(0.0)).drop(*picks)


def selection_stats(scores: DataFrame) -> DataFrame:
    """Per signal, the means of choices and scores; the most chosen come first in ``rank``."""
    means = scores.groupBy("signal").agg(F.avg(F.abs("sel")).alias("abs_sel"), *[F.avg(c).alias(c) for c in ("sel", "sr", "rpt", "dd", "ddn", "hold")])
    return means.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.abs("sel")), "signal")))  # one row a signal
