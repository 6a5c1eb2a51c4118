"""Strategy pipelines: composite features over a panel of bars.

Each takes and returns a panel; operators over an instrument's rows come first,
then those over the rows of one time, so that each pipeline changes the
partitioning as seldom as its definition allows.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..functions import ewm as E
from ..operators import backtest as B, features as X, folds as P, learning as L, relational as J, seasonal as Y
from ..panel import Panel, clip, number, ratio


def prepare(bars: DataFrame, p: Panel, halflife: float = 43_200, oldest: int = 28_800, period: int = X.PERIOD) -> DataFrame:
    """``turnover``, age ``ipocnt`` (1 from the oldest on), calendar features, return ``tret`` (over the current close), its winsorised form, ``wgt`` and ``sigf_wgt``.

    The weight is the smoothed turnover, at most its 0.8 quantile so far; 0 before there is one.
    """
    out = bars.withColumn("turnover", number("close") * number("volume"))
    out = X.calendar_parts(X.count_so_far(out, p), p.ts).withColumn("ipocnt", F.least(F.col("cnt_exists"), F.lit(oldest)) / oldest).drop("cnt_exists")
    out = X.ewm(X.diff(out, ["close"], [1], p), ["turnover"], [halflife], p)
    out = out.withColumn("tret", ratio(number("close_diff1"), number("close")))
    out = X.winsorize_global(out, ["tret"], 0.05, 0.95, p, period)
    turn = f"turnover_ewm{halflife}"
    out = X.quantile_global(out, [turn], [0.8], p, period)
    top = F.col(f"`{turn}_qtl0.80`")
    out = out.withColumn("wgt", F.coalesce(F.when(F.col(turn) < top, F.col(turn)).otherwise(top), F.lit(0.0)))
    return out.withColumn("sigf_wgt", F.when(top != 0, F.col("wgt") / top)).drop(f"{turn}_qtl0.80")


def define_universe(df: DataFrame, p: Panel, count: int, halflife: float = 60) -> DataFrame:
    """``univ``: the instruments of greatest smoothed turnover at each time; ``wgt`` is 0 elsewhere."""
    out = X.cs_rank(X.ewm(df, ["turnover"], [halflife], p), [f"turnover_ewm{halflife}"], p, kind="down")
    rank = F.col(f"turnover_ewm{halflife}_csrank")
    out = out.withColumn("univ", (rank <= count).cast("int")).drop(f"turnover_ewm{halflife}_csrank")
    return out.withColumn("wgt", number("wgt") * F.col("univ")) if "wgt" in df.columns else out


def remove_market(df: DataFrame, col: str, p: Panel, out: str | None = None, winsor: float | None = 0.02, period: int = X.PERIOD) -> DataFrame:
    """``{col}_xmkt``: weighted demeaned at each time, 0 outside the universe and without weight.

    With ``winsor`` the demeaned values are held within these quantiles of the stream so far.
    """
    name = out or f"{col}_xmkt"
    done = X.cs_demean(df, [col], p, wgt="wgt").withColumnRenamed(f"{col}_csdemean", "_raw").drop(f"{col}_csmean")
    if winsor is not None:
        done = X.winsorize_global(done, ["_raw"], winsor, 1 - winsor, p, period).drop("_raw", "_raw_qtllow", "_raw_qtlhigh").withColumnRenamed("_raw_clipqtl", "_raw")
    inside = F.col("_raw") * F.col("univ") if "univ" in df.columns else F.col("_raw")
    return done.withColumn(name, F.when(number("wgt") == 0, F.lit(0.0)).otherwise(inside)).drop("_raw")


def forward_returns(df: DataFrame, col: str, p: Panel, windows: list[int], market: bool = True, period: int = X.PERIOD) -> DataFrame:
    """``{col}_xmkt``, ``forward_fh1`` and ``forward_fh{w}``: coming returns, averaged over w rows, less the market; and ``_clip`` of each.

    The clipped forms are held within the 0.03 and 0.97 quantiles of the stream so far.
    """
    out = remove_market(df, col, p, period=period)
    for w in (1, *windows):
        base = col if w == 1 else f"{col}_sma{w}"
        out = out if w == 1 else X.sma(out, [col], [w], p)
        ahead, name = f"forward_{base}_lag-{w}", f"forward_fh{w}"
        out = X.lag_forward(out, [base], [-w], p)
        out = remove_market(out, ahead, p, name, None) if market else out.withColumn(name, F.col(f"`{ahead}`"))
        out = X.winsorize_global(out.drop(ahead, *([base] if w > 1 else [])), [name], 0.03, 0.97, p, period)
        out = out.drop(f"{name}_qtllow", f"{name}_qtlhigh").withColumnRenamed(f"{name}_clipqtl", f"{name}_clip")
    return out


def mean_reversion(df: DataFrame, col: str, p: Panel, halflives: list[float], bound: float = 3.0) -> DataFrame:
    """``sigf_{col}_mual``: minus the mean over horizons of the scaled smoothed return."""
    names = [f"_z{h}" for h in halflives]
    average = sum((E.ewm_std(number(col), h, p) for h in halflives), F.lit(0.0)) / len(halflives)
    out = df.withColumn("_sd", average)
    out = out.withColumns({n: clip(ratio(E.ewm(number(col), h, p) * h**0.5, F.col("_sd")), -bound, bound) for n, h in zip(names, halflives)})
    out = X.average_fill0(X.cs_scaling(out, names, p), [f"{n}_csscaling" for n in names], "_m")
    return out.withColumn(f"sigf_{col}_mual", -clip(F.col("_m"), -bound, bound)).drop("_m", "_sd", *names, *[f"{n}_csscaling" for n in names])


def ranked(df: DataFrame, cols: list[str], window: int, p: Panel) -> DataFrame:
    """The columns' ranks in the stream as features, ``sigf_{col}_appops{window}``."""
    return X.to_feature(X.moving_rank(df, cols, window, p), [f"{c}_appops{window}" for c in cols])


def momentum(df: DataFrame, col: str, p: Panel, fast: float, slow: float, signal: float, window: int) -> DataFrame:
    """Ranked macd, macd against its mean, t-value, skew and kurtosis."""
    out = X.macd_signal(X.macd(df, [col], [(fast, slow)], p), [col], [(fast, slow, signal)], p)
    out = X.ewm_kurt(X.ewm_skew(X.ewm_scaled(out, [col], [slow], p), [col], [slow], p), [col], [slow], p)
    made = [c for c in out.columns if c not in df.columns]
    return ranked(out, made, window, p)


def volatility(df: DataFrame, col: str, p: Panel, fast: float, slow: float, window: int) -> DataFrame:
    out = X.ewm_std(df, [col], [fast, slow], p)
    name = f"{col}_volratio{fast}x{slow}"
    out = out.withColumn(name, ratio(F.col(f"{col}_ewmstd{fast}"), F.col(f"{col}_ewmstd{slow}"), 1.0) - 1)
    return ranked(out, [name], window, p)


def gaps(df: DataFrame, col: str, p: Panel, window: int, lag: int, threshold: float, halflife: float) -> DataFrame:
    """Break-outs above the lagged highest or below the lagged lowest value by some deviations, smoothed."""
    out = X.ewm_std(X.rolling_min(X.rolling_max(df, [col], [window], p), [col], [window], p), [col], [halflife], p)
    out = X.lag(out, [f"{col}_max{window}", f"{col}_min{window}"], [lag], p)
    room = threshold * lag**0.5 * F.col(f"{col}_ewmstd{halflife}")
    event = F.when(number(col) > F.col(f"{col}_max{window}_lag{lag}") + room, 1.0).when(number(col) < F.col(f"{col}_min{window}_lag{lag}") - room, -1.0).otherwise(0.0)
    out = X.ewm(out.withColumn(f"{col}_gap{window}", event), [f"{col}_gap{window}"], [halflife], p)
    return out.drop(*[c for c in out.columns if c not in df.columns and "_gap" not in c])


def taker_share(df: DataFrame, taker: str, total: str, p: Panel, fast: float, slow: float, window: int) -> DataFrame:
    """Share of buyers less a half: smoothed, macd, t-value, ranked."""
    out = df.withColumn("takerpct", ratio(number(taker), number(total), 0.5) - 0.5)
    out = X.ewm_scaled(X.macd(X.ewm(out, ["takerpct"], [fast], p), ["takerpct"], [(fast, slow)], p), ["takerpct"], [slow], p)
    return ranked(out, [f"takerpct_ewm{fast}", f"takerpct_macd{fast}x{slow}", f"takerpct_ewmscaled{slow}"], window, p)


def turnover_ratio(df: DataFrame, p: Panel, fast: float, slow: float, window: int) -> DataFrame:
    """The ranked macd ratio of turnover."""
    return ranked(X.macd_ratio(df, ["turnover"], [(fast, slow)], p), [f"turnover_macdr{fast}x{slow}"], window, p)


def turnover_excess(df: DataFrame, p: Panel, fast: float, slow: float) -> DataFrame:
    """macd of the summed, demeaned change of log turnover, as a feature."""
    out = X.diff(X.log1(df, ["turnover"]), ["turnover_log1"], [1], p)
    out = X.cs_demean(out, ["turnover_log1_diff1"], p)
    out = X.macd(X.cumsum(out, ["turnover_log1_diff1_csdemean"], p).withColumnRenamed("turnover_log1_diff1_csdemean_cumsum", "turnexc"), ["turnexc"], [(fast, slow)], p)
    out = out.drop("turnover_log1", "turnover_log1_diff1", "turnover_log1_diff1_csmean", "turnover_log1_diff1_csdemean")
    return X.to_feature(out, [f"turnexc_macd{fast}x{slow}"])


def point_figure(df: DataFrame, col: str, p: Panel, tick: float, reverse: int, halflife: float) -> DataFrame:
    """Point-and-figure of one plus the summed log return, with its turns smoothed."""
    out = X.cumsum(X.log1(df, [col]), [f"{col}_log1"], p).withColumn("_px", 1 + F.col(f"{col}_log1_cumsum"))
    out = P.point_figure(out.drop(f"{col}_log1", f"{col}_log1_cumsum"), "_px", tick, reverse, p)
    stem = f"_px_pfp{tick}x{reverse}"
    out = out.withColumnsRenamed({c: c.replace(stem, "pfp") for c in out.columns if c.startswith(stem)}).drop("_px")
    out = X.diff(out, ["pfp_dir"], [1], p).withColumn("pfp_dir_chg", F.signum(F.abs("pfp_dir_diff1"))).drop("pfp_dir_diff1")
    return X.ewm(out, ["pfp_dir_chg"], [halflife], p)


def pnl_features(df: DataFrame, signal: str, ret: str, p: Panel, halflife: float, window: int) -> DataFrame:
    """How well a signal did so far: t-value of its gain and drawdown, ranked."""
    out = X.lag(df, [signal], [1], p).withColumn("_pnl", F.coalesce(F.col(f"{signal}_lag1"), F.lit(0.0)) * number(ret))
    out = X.drawdown(X.sharpe_ewm(out, {signal: "_pnl"}, [halflife], p), {signal: "_pnl"}, p)
    return ranked(out.drop("_pnl", f"{signal}_lag1"), [f"{signal}_ewmsharpe{halflife}", f"{signal}_ddpct"], window, p)


def pairs(df: DataFrame, col: str, p: Panel, lookback: int, every: int, k: int) -> DataFrame:
    """Spread of the chosen pairs, back on their instruments as ``{col}_pairs``."""
    chosen = J.pick_pairs(J.pair_correlation(df, col, lookback, every, p).withColumn("dist", 1 - F.coalesce("dist", F.lit(0.0))), k)
    spread = J.explode_pairs(df, chosen, col, p).withColumn(f"{col}_pairs", F.coalesce(number("serie1"), F.lit(0.0)) - F.coalesce(number("serie2"), F.lit(0.0)))
    return df.join(J.collapse_pairs(spread, f"{col}_pairs", p), [p.ts, p.key], "left").fillna(0.0, [f"{col}_pairs"])


def cluster_return(df: DataFrame, col: str, p: Panel, parts: list[dict], k: int, out: str = "sret_kmeans", winsor: float = 0.01, period: int = X.PERIOD) -> DataFrame:
    """``sret_kmeans``: the return less its weighted mean in the cluster that holds at each time, winsorised; ``kmeans_cat`` is -1 before the first."""
    found = L.cluster_codes(df, col, parts, k, p)
    kind, since = dict(df.dtypes)[p.ts], F.col("valid_from").cast("long")
    since = since if kind in ("bigint", "int") else F.timestamp_micros(since)
    right = found.select(p.key, since.cast(kind).alias(p.ts), "kmeans_cat")
    done = J.merge_asof(df, right, Panel(p.ts, p.key), ["kmeans_cat"]).withColumnRenamed("kmeans_cat_masof", "kmeans_cat").fillna(-1, ["kmeans_cat"])
    done = X.cs_demean(done, [col], p, ["kmeans_cat"], "wgt").withColumnRenamed(f"{col}_csdemean", out).drop(f"{col}_csmean")
    done = X.winsorize_global(done, [out], winsor, 1 - winsor, p, period)
    return done.drop(out, f"{out}_qtllow", f"{out}_qtlhigh").withColumnRenamed(f"{out}_clipqtl", out)


def svd_return(df: DataFrame, col: str, p: Panel, lookback: int, every: int, parts: int, out: str = "sret_svd") -> DataFrame:
    """``sret_svd``: the return less its leading components, as of each time; their singular values as ``sigf_d_0``..."""
    found = P.svd_residual(df, col, lookback, every, parts, p)
    values = [f"{col}_svd{i + 1}" for i in range(parts)]
    done = J.merge_asof(df, found.select(p.ts, p.key, f"{col}_svdres"), Panel(p.ts, p.key), [f"{col}_svdres"]).withColumnRenamed(f"{col}_svdres_masof", out)
    per_time = found.groupBy(p.ts).agg(*[F.max(v).alias(v) for v in values])
    done = done.join(per_time, p.ts, "left")
    return done.withColumnsRenamed({v: f"sigf_d_{i}" for i, v in enumerate(values)})


def naive_forecast(df: DataFrame, col: str, p: Panel, lag: int, halflife: float) -> DataFrame:
    """Weighted mean of the values known ``lag`` rows before."""
    out = X.ewm(X.lag(df, [col], [lag], p), [f"{col}_lag{lag}"], [halflife], p)
    return out.withColumnRenamed(f"{col}_lag{lag}_ewm{halflife}", "pred").drop(f"{col}_lag{lag}")


def lagged_forecast(df: DataFrame, col: str, p: Panel) -> DataFrame:
    """The value of 52 weeks before."""
    return Y.yoy(df, col, "lag", p).withColumnRenamed(f"{col}_lag1y", "pred")


def seasonal_forecast(df: DataFrame, col: str, p: Panel, lag: int = 1, halflife: float = 10, bound: float = 0.5, links: DataFrame | None = None) -> DataFrame:
    """The weighted mean of the log values known ``lag`` rows before, plus how far the value of 52 weeks before was off its own mean, within the bound.

    ``links`` are dates to look at instead of 52 weeks before, such as last year's holiday.
    """
    out = df.withColumn("_log", F.ln(1 + number(col)))
    out = X.ewm(X.lag(out, ["_log"], [lag], p), [f"_log_lag{lag}"], [halflife], p).withColumnRenamed(f"_log_lag{lag}_ewm{halflife}", "_mean")
    out = out.withColumn("_off", F.col("_log") - F.col("_mean"))
    out = Y.yoy(out, "_off", "lag", p) if links is None else Y.yoy_holiday(out, "_off", links, p)
    return out.withColumn("pred", F.exp(clip(F.col("_off_lag1y"), -bound, bound) + F.col("_mean")) - 1).select(*df.columns, "pred")


KINDS = ("none", "best", "model", "trees")


def research(bars: DataFrame, p: Panel, count: int, kind: str = "none", period: int = X.PERIOD, rules: dict = {}, splits: dict = {}) -> DataFrame:
    """Bars to signals: universe, market-free returns, mean reversion and volatility features, and ``sig_{kind}`` made of them.

    ``none`` takes the mean-reversion feature as it is, ``best`` selects among the
    features by what they gained so far, ``model`` and ``trees`` learn the coming
    return walk-forward with a linear model or boosted trees.
    """
    out = define_universe(prepare(bars, p, period=period), p, count)
    out = forward_returns(out, "tret", p, [3], period=period)
    out = mean_reversion(out, "tret_xmkt", p, [5, 10])
    feats = ["sigf_tret_xmkt_mual", "sigf_wgt"]
    if kind == "none":
        out = out.withColumn("sig_none", F.col(feats[0]) * F.col("univ"))
    elif kind == "best":
        out = B.select_best(out, feats, "tret", 20, p, "wgt", rules).withColumnRenamed("sig_kbest", "sig_best")
    elif kind in KINDS:
        from pyspark.ml.regression import GBTRegressor, LinearRegression

        make = (lambda: LinearRegression(regParam=0.1)) if kind == "model" else (lambda: GBTRegressor(maxIter=10, maxDepth=3, seed=42))
        parts = L.time_splits(out, p, **({"lookback": 20, "every": 10, "gap": 1, "least": 10} | splits))
        out = L.walk_forward(out, feats, "forward_fh1", make, parts, p, "model").withColumnRenamed("model_forward_fh1", f"sig_{kind}")
    else:
        raise ValueError(f"unknown kind {kind!r}; there are {KINDS}")
    return out


def research_stats(bars: DataFrame, p: Panel, count: int, **parameters) -> DataFrame:
    """The back-tested statistics of a research flow's signal."""
    out = research(bars, p, count, **parameters)
    signal = next(c for c in out.columns if c.startswith("sig_"))
    return B.daily_stats(B.daily_pnl(out, [signal], "forward_fh1", p, "wgt"))
