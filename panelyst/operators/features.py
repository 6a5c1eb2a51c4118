"""Feature operators: each adds named columns to a panel and returns it.

All columns that an operator adds go into one projection, so that everything
over the same window of an instrument shares one exchange and one sort.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import Window as W

from ..functions import cross, ewm as E, rolling as R
from ..panel import Panel, clip, number, ratio, settled

PANEL = Panel()
Names = list[str]


# --- scalar ------------------------------------------------------------------


def divide(df: DataFrame, tops: Names, bottoms: Names) -> DataFrame:
    return df.withColumns({f"{n}div{d}": ratio(number(n), number(d)) for n in tops for d in bottoms})


def divide_less_one(df: DataFrame, tops: Names, bottoms: Names) -> DataFrame:
    return df.withColumns({f"{n}divm1{d}": ratio(number(n), number(d), 1.0) - 1 for n in tops for d in bottoms})


def log1(df: DataFrame, cols: Names) -> DataFrame:
    return df.withColumns({f"{c}_log1": F.ln(1 + number(c)) for c in cols})


def absolute(df: DataFrame, cols: Names) -> DataFrame:
    return df.withColumns({f"{c}_abs": F.abs(number(c)) for c in cols})


def zero_to_null(df: DataFrame, cols: Names) -> DataFrame:
    return df.withColumns({f"{c}_0tonan": F.nullif(number(c), F.lit(0.0)) for c in cols})


def to_double(df: DataFrame, cols: Names) -> DataFrame:
    return df.withColumns({c: number(c) for c in cols})


def clipped(df: DataFrame, cols: Names, low: float | None = None, high: float | None = None) -> DataFrame:
    return df.withColumns({f"{c}_clip": clip(number(c), low, high) for c in cols})


def average_fill0(df: DataFrame, cols: Names, name: str) -> DataFrame:
    """Mean over the columns, nulls as zeros."""
    total = sum((F.coalesce(number(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    return df.withColumn(name, total / len(cols))


def to_signal(df: DataFrame, cols: Names) -> DataFrame:
    return df.withColumnsRenamed({c: f"sig_{c}" for c in cols})


def to_feature(df: DataFrame, cols: Names) -> DataFrame:
    return df.withColumnsRenamed({c: f"sigf_{c}" for c in cols})


def add_prefix(df: DataFrame, cols: Names, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in cols})


def only_signals(df: DataFrame, p: Panel = PANEL) -> DataFrame:
    """Keys, signals and features; the rest is never read."""
    return df.select(*[c for c in df.columns if c in (p.ts, p.key) or c.startswith(("sig_", "sigf_"))])


def calendar_parts(df: DataFrame, ts: str) -> DataFrame:
    """Weekday (Monday 0) and time of day from 0 to 2, of a timestamp column."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumns({"sigf_dayofweek": F.weekday(ts).cast("double"), "sigf_timeofday": F.pmod(micros, F.lit(86_400_000_000)) / 86_400_000_000 * 2})


def date_parts(df: DataFrame, date: str) -> DataFrame:
    """Weekday (Monday 0), month, day and ISO week, for seasonal models."""
    return df.withColumns({"weekday": F.weekday(date), "month": F.month(date), "day": F.dayofmonth(date), "week": F.weekofyear(date)})


def in_universe(df: DataFrame) -> DataFrame:
    return df.where(F.col("univ") > 0)


def between_dates(df: DataFrame, ts: str, first: str, last: str) -> DataFrame:
    """Inclusive dates as a range of times, so that the condition reaches the scan."""
    return df.where((F.col(ts) >= F.lit(first).cast("timestamp_ntz")) & (F.col(ts) < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz")))


# --- exponentially weighted --------------------------------------------------


def ewm(df: DataFrame, cols: Names, halflives: list[float], p: Panel = PANEL) -> DataFrame:
    return df.withColumns({f"{c}_ewm{h}": E.ewm(number(c), h, p) for c in cols for h in halflives})


def detrend_ewm(df: DataFrame, cols: Names, halflives: list[float], p: Panel = PANEL) -> DataFrame:
    return df.withColumns({f"{c}_detrend_ewm{h}": number(c) - E.ewm(number(c), h, p) for c in cols for h in halflives})


def detrend_ratio_ewm(df: DataFrame, cols: Names, halflives: list[float], p: Panel = PANEL) -> DataFrame:
    return df.withColumns({f"{c}_detrendratio_ewm{h}": ratio(number(c), E.ewm(number(c), h, p), 1.0) - 1 for c in cols for h in halflives})


def _fast_slow(fast: float, slow: float) -> None:
    if fast >= slow:
        raise ValueError(f"fast half-life {fast} is not below the slow one {slow}")


def macd(df: DataFrame, cols: Names, pairs: list[tuple[float, float]], p: Panel = PANEL) -> DataFrame:
    for fast, slow in pairs:
        _fast_slow(fast, slow)
    return df.withColumns({f"{c}_macd{f}x{s}": E.ewm(number(c), f, p) - E.ewm(number(c), s, p) for c in cols for f, s in pairs})


def macd_ratio(df: DataFrame, cols: Names, pairs: list[tuple[float, float]], p: Panel = PANEL) -> DataFrame:
    for fast, slow in pairs:
        _fast_slow(fast, slow)
    return df.withColumns({f"{c}_macdr{f}x{s}": ratio(E.ewm(number(c), f, p), E.ewm(number(c), s, p), 1.0) - 1 for c in cols for f, s in pairs})


def macd_signal(df: DataFrame, cols: Names, triples: list[tuple[float, float, float]], p: Panel = PANEL, compat: bool = False) -> DataFrame:
    """macd less its own weighted mean over ``signal`` rows; over the slow half-life with ``compat``."""
    base = macd(df, cols, [t[:2] for t in triples], p)
    out = base.withColumns({f"{c}_macd{f}x{s}x{g}": F.col(f"{c}_macd{f}x{s}") - E.ewm(F.col(f"{c}_macd{f}x{s}"), s if compat else g, p) for c in cols for f, s, g in triples})
    return out.drop(*[f"{c}_macd{f}x{s}" for c in cols for f, s, _ in triples if f"{c}_macd{f}x{s}" not in df.columns])


def ewm_std(df: DataFrame, cols: Names, halflives: list[float], p: Panel = PANEL) -> DataFrame:
    return df.withColumns({f"{c}_ewmstd{h}": E.ewm_std(number(c), h, p) for c in cols for h in halflives})


def ewm_skew(df: DataFrame, cols: Names, halflives: list[float], p: Panel = PANEL) -> DataFrame:
    return E.moments(df, {f"{c}_ewmskew{h}": (number(c), h) for c in cols for h in halflives}, E.skew, 3, p)


def ewm_kurt(df: DataFrame, cols: Names, halflives: list[float], p: Panel = PANEL) -> DataFrame:
    return E.moments(df, {f"{c}_ewmkurt{h}": (number(c), h) for c in cols for h in halflives}, E.kurt, 4, p)


def scale_ewm(df: DataFrame, cols: Names, halflives: list[float], p: Panel = PANEL, bound: float = 3.0) -> DataFrame:
    return df.withColumns({f"{c}_scaled_ewmstd{h}": clip(ratio(number(c), E.ewm_std(number(c), h, p)), -bound, bound) for c in cols for h in halflives})


def _t_value(x, h: float, p: Panel):
    keep = 0.5 ** (1 / h)
    return ratio(E.ewm(x, h, p) * ((1 + keep) / (1 - keep)) ** 0.5, E.ewm_std(x, h, p))


def ewm_scaled(df: DataFrame, cols: Names, halflives: list[float], p: Panel = PANEL, bound: float = 3.0) -> DataFrame:
    """The weighted mean in units of its standard error, for independent values, within the bound."""
    return df.withColumns({f"{c}_ewmscaled{h}": clip(_t_value(number(c), h, p), -bound, bound) for c in cols for h in halflives})


def sharpe_ewm(df: DataFrame, pnl_of: dict[str, str], halflives: list[float], p: Panel = PANEL, bound: float = 3.0) -> DataFrame:
    """The same for the gain per unit of signal; ``pnl_of`` names each signal's gain column."""
    return df.withColumns({f"{s}_ewmsharpe{h}": clip(_t_value(ratio(number(g), F.abs(number(s))), h, p), -bound, bound) for s, g in pnl_of.items() for h in halflives})


# --- rolling -----------------------------------------------------------------


def sma(df: DataFrame, cols: Names, windows: list[int], p: Panel = PANEL) -> DataFrame:
    return df.withColumns({f"{c}_sma{n}": R.mean(number(c), n, p) for c in cols for n in windows})


def rolling_max(df: DataFrame, cols: Names, windows: list[int], p: Panel = PANEL) -> DataFrame:
    return df.withColumns({f"{c}_max{n}": R.highest(number(c), n, p) for c in cols for n in windows})


def rolling_min(df: DataFrame, cols: Names, windows: list[int], p: Panel = PANEL) -> DataFrame:
    return df.withColumns({f"{c}_min{n}": R.lowest(number(c), n, p) for c in cols for n in windows})


def lag(df: DataFrame, cols: Names, windows: list[int], p: Panel = PANEL) -> DataFrame:
    return df.withColumns({f"{c}_lag{n}": R.lag(number(c), n, p) for c in cols for n in windows})


def lag_forward(df: DataFrame, cols: Names, steps: list[int], p: Panel = PANEL) -> DataFrame:
    """Looks ahead: the value ``-step`` rows later."""
    return df.withColumns({f"forward_{c}_lag{n}": R.lead(number(c), -n, p) for c in cols for n in steps})


def stochastic(df: DataFrame, cols: Names, windows: list[int], p: Panel = PANEL) -> DataFrame:
    return df.withColumns({f"{c}_sto{n}": R.stochastic(number(c), n, p) for c in cols for n in windows})


def rolling_rank(df: DataFrame, cols: Names, windows: list[int], p: Panel = PANEL) -> DataFrame:
    return df.withColumns({f"{c}_rank{n}": R.rank(number(c), n, p) for c in cols for n in windows})


def corr(df: DataFrame, pairs: list[tuple[str, str]], windows: list[int], p: Panel = PANEL) -> DataFrame:
    return df.withColumns({f"{a}x{b}_corr{n}": R.corr(number(a), number(b), n, p) for a, b in pairs for n in windows})


def ridge(df: DataFrame, pairs: list[tuple[str, str]], windows: list[int], penalties: list[float], p: Panel = PANEL) -> DataFrame:
    new = {}
    for a, b in pairs:
        for n in windows:
            for lam in penalties:
                new |= dict(zip((f"{a}x{b}_reg{n}x{lam}_{s}" for s in ("alpha", "beta", "resid")), R.ridge(number(a), number(b), n, lam, p)))
    return df.withColumns(new)


def theta(df: DataFrame, cols: Names, windows: list[int], weights: list[float], p: Panel = PANEL) -> DataFrame:
    numbered = df.withColumn("_row", F.row_number().over(p.rows()))
    return numbered.withColumns({f"{c}_theta{n}x{w}": R.theta(number(c), F.col("_row"), n, w, p) for c in cols for n in windows for w in weights}).drop("_row")


# --- expanding ---------------------------------------------------------------


def cumsum(df: DataFrame, cols: Names, p: Panel = PANEL) -> DataFrame:
    return df.withColumns({f"{c}_cumsum": F.coalesce(F.sum(number(c)).over(p.so_far()), F.lit(0.0)) for c in cols})


def count_so_far(df: DataFrame, p: Panel = PANEL) -> DataFrame:
    return df.withColumn("cnt_exists", F.row_number().over(p.rows()).cast("long"))


def diff(df: DataFrame, cols: Names, windows: list[int] = [1], p: Panel = PANEL) -> DataFrame:
    """Change against ``n`` rows before, 0 where there is none."""
    return df.withColumns({f"{c}_diff{n}": F.coalesce(number(c) - R.lag(number(c), n, p), F.lit(0.0)) for c in cols for n in windows})


def ffill(df: DataFrame, cols: Names, p: Panel = PANEL) -> DataFrame:
    return df.withColumns({f"{c}_ffill": F.last(number(c), ignorenulls=True).over(p.so_far()) for c in cols})


def expanding(df: DataFrame, cols: Names, p: Panel = PANEL, what: tuple[str, ...] = ("max", "min", "mean")) -> DataFrame:
    how = {"max": F.max, "min": F.min, "mean": F.avg}
    return df.withColumns({f"{c}_exp{k}": how[k](number(c)).over(p.so_far()) for c in cols for k in what})


def quantile_by_key(df: DataFrame, cols: Names, shares: list[float], p: Panel = PANEL) -> DataFrame:
    """Exact quantiles of an instrument's rows so far."""
    return df.withColumns({f"{c}_qtl{q:.2f}": F.percentile(number(c), q).over(p.so_far()) for c in cols for q in shares})


def drawdown(df: DataFrame, pnl_of: dict[str, str], p: Panel = PANEL) -> DataFrame:
    """How far the summed gain is below its height so far, in percent of the mean signal size."""
    summed = df.withColumns({f"_cum_{s}": F.sum(number(g)).over(p.so_far()) for s, g in pnl_of.items()})
    new = {f"{s}_ddpct": 100 * ratio(F.max(f"_cum_{s}").over(p.so_far()) - F.col(f"_cum_{s}"), F.avg(F.abs(number(s))).over(p.so_far())) for s in pnl_of}
    return summed.withColumns(new).drop(*[f"_cum_{s}" for s in pnl_of])


# --- cross-section -----------------------------------------------------------


def _weight(wgt: str | None):
    return F.lit(1.0) if wgt is None else F.coalesce(number(wgt), F.lit(0.0))


def cs_demean(df: DataFrame, cols: Names, p: Panel = PANEL, by: Names = [], wgt: str | None = None) -> DataFrame:
    means = {c: cross.mean(number(c), _weight(wgt), p.at(*by)) for c in cols}
    return df.withColumns({f"{c}_csmean": m for c, m in means.items()} | {f"{c}_csdemean": number(c) - m for c, m in means.items()})


def cs_scaling(df: DataFrame, cols: Names, p: Panel = PANEL, by: Names = [], wgt: str | None = None, bound: float = 3.0) -> DataFrame:
    return df.withColumns({f"{c}_csscaling": clip(cross.scaled(number(c), _weight(wgt), p.at(*by)), -bound, bound) for c in cols})


def cs_zscore(df: DataFrame, cols: Names, p: Panel = PANEL, by: Names = [], wgt: str | None = None, bound: float = 3.0) -> DataFrame:
    """Demeaned, divided by the deviation of the demeaned, within the bound: one exchange, two windows."""
    centred = df.withColumns({f"_c_{c}": number(c) - cross.mean(number(c), _weight(wgt), p.at(*by)) for c in cols})
    new = {f"{c}_cszscore": clip(cross.scaled(F.col(f"_c_{c}"), _weight(wgt), p.at(*by)), -bound, bound) for c in cols}
    return centred.withColumns(new).drop(*[f"_c_{c}" for c in cols])


def cs_rank(df: DataFrame, cols: Names, p: Panel = PANEL, by: Names = [], wgt: str | None = None, kind: str = "scaled") -> DataFrame:
    """Rank of value times weight: ``scaled`` to -1..1, ``up`` from 0, or ``down`` to 1; ties by key and tie columns."""
    how = {"scaled": cross.rank, "up": cross.rank_up, "down": cross.rank_down}[kind]
    return df.withColumns({f"{c}_csrank": how(number(c) * _weight(wgt), p.at(*by), p.key, *p.tie) for c in cols})


# --- over the whole stream, without regard to the instrument -----------------


def stream_numbers(df: DataFrame, p: Panel, name: str = "_no") -> DataFrame:
    """Number all rows in time order without gathering them: days are counted, and their offsets joined back."""
    day = F.to_date(p.ts)
    sizes = df.groupBy(day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(F.col("_day").alias("_of"), (F.sum("_n").over(W.orderBy("_day")) - F.col("_n")).alias("_before"))  # one row a day
    dated = df.withColumn("_day", day).join(offsets, F.col("_day").eqNullSafe(F.col("_of"))).drop("_of")
    return dated.withColumn(name, F.col("_before") + F.row_number().over(W.partitionBy("_day").orderBy(p.ts, *p.tie, p.key)) - 1).drop("_day", "_before")


def moving_rank(df: DataFrame, cols: Names, window: int, p: Panel = PANEL) -> DataFrame:
    """Average rank among the last ``window`` rows of the whole stream, scaled to -1..1; null until they are there.

    Blocks of the stream are handled apart; each also gets the rows before it
    that its windows reach back to.
    """
    block = max(4 * window, 4096)
    numbered = stream_numbers(df, p)
    own = numbered.withColumn("_b", F.floor(F.col("_no") / block)).withColumn("_own", F.lit(True))
    reach = own.where(F.pmod("_no", F.lit(block)) >= block - window + 1).withColumns({"_b": F.col("_b") + 1, "_own": F.lit(False)})
    w = W.partitionBy("_b").orderBy("_no").rowsBetween(1 - window, 0)
    seen = own.unionByName(reach).withColumns({f"_l_{c}": F.collect_list(number(c)).over(w) for c in cols})

    def scaled(c: str):
        x, values = number(c), F.col(f"_l_{c}")
        less, same = F.size(F.filter(values, lambda v: v < x)), F.size(F.filter(values, lambda v: v == x))
        return F.when((F.size(values) == window) & x.isNotNull(), 2 * (less + (same + 1) / 2 - 1) / (window - 1) - 1)

    return seen.where("_own").withColumns({f"{c}_appops{window}": scaled(c) for c in cols}).drop("_no", "_b", "_own", *[f"_l_{c}" for c in cols])


#: Rows of the stream after which quantiles are taken anew: five days of minutes.
PERIOD = 7200
#: Ranges of values that the exact quantiles are worked out in.
BINS = 1000


def emitted(df: DataFrame, p: Panel, period: int) -> DataFrame:
    """Number the rows of the stream (``_no``, from 0) and the emission that holds at each (``_b``): that after its first ``_b * period`` rows."""
    return stream_numbers(df, p).withColumn("_b", F.floor((F.col("_no") + 1) / period).cast("long"))


def _ranges(numbered: DataFrame, cols: Names, bins: int) -> dict[str, list[float]]:
    """Edges that cut each column into ranges of about as many rows; they only deal out the work."""
    shares = [i / bins for i in range(1, bins)]
    found = numbered.agg(*[F.percentile_approx(number(c), shares, 10 * bins).alias(f"_e{i}") for i, c in enumerate(cols)]).first()
    return {c: [-float("inf"), *sorted({e for e in found[i] or [] if e not in (-float("inf"), float("inf"))}), float("inf")] for i, c in enumerate(cols)}


def _picked(key: tuple, members: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """Of one range: the value of each wanted rank among the values that came before an emission."""
    members, out = members.sort_values("_x"), np.full(len(wanted), np.nan)
    x, since, n = (members[c].to_numpy() for c in ("_x", "_k", "_n"))
    for b, at in wanted.reset_index(drop=True).groupby("_b").groups.items():
        out[at] = x[np.searchsorted(np.cumsum(np.where(since <= b, n, 0)), wanted["_r"].to_numpy()[at], side="right")]
    return wanted.assign(_v=out * wanted["_w"])[["_b", "_q", "_v"]]


def expanding_quantiles(numbered: DataFrame, col: str, shares: list[float], period: int, edges: list[float]) -> DataFrame:
    """``_b`` and ``_q0``.. : exact quantiles, between two values by proportion, of the first ``_b * period`` rows of the stream.

    Counts by emission and range of values say in which range a quantile lies
    and which rank it has there; then each range is handled apart, its equal
    values of one period as one row. No row later than an emission has a part in it.
    """
    from pyspark.ml.feature import Bucketizer

    x = numbered.select((F.floor(F.col("_no") / period) + 1).cast("long").alias("_k"), number(col).alias("_x")).where("_x is not null")
    placed = Bucketizer(splits=edges, inputCol="_x", outputCol="_bin").transform(x)
    members = placed.groupBy("_bin", "_k", "_x").agg(F.count(F.lit(1)).alias("_n"))
    emissions = numbered.select("_b").where("_b > 0").distinct()
    counts = members.groupBy("_bin", "_k").agg(F.sum("_n").alias("_n"))
    grid = emissions.crossJoin(counts.select("_bin").distinct())  # emissions are a period apart, ranges a fixed number
    upto = W.partitionBy("_bin").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    each = grid.join(counts.withColumnRenamed("_k", "_b"), ["_b", "_bin"], "left").withColumn("_n", F.sum(F.coalesce("_n", F.lit(0))).over(upto))
    by = W.partitionBy("_b")
    each = each.withColumns({"_all": F.sum("_n").over(by), "_before": F.sum("_n").over(by.orderBy("_bin")) - F.col("_n")}).where("_n > 0")
    ranks = []
    for i, q in enumerate(shares):
        at = F.lit(float(q)) * (F.col("_all") - 1)
        low = F.floor(at + 1e-12)
        rest = F.greatest(at - low, F.lit(0.0))
        ranks += [F.struct(F.lit(i).alias("_q"), low.cast("long").alias("_r"), (1 - rest).alias("_w")), F.struct(F.lit(i).alias("_q"), F.least(low + 1, F.col("_all") - 1).cast("long").alias("_r"), rest.alias("_w"))]
    wanted = each.withColumn("_s", F.explode(F.array(*ranks))).select("_bin", "_b", "_before", "_n", "_s.*").where("_w > 0 and _r >= _before and _r < _before + _n")
    wanted = wanted.select(F.col("_bin").alias("_in"), "_b", "_q", (F.col("_r") - F.col("_before")).alias("_r"), "_w")
    found = wanted.groupBy("_in").cogroup(members.groupBy("_bin")).applyInPandas(lambda key, w, m: _picked(key, m, w), "_b long, _q int, _v double")
    return found.groupBy("_b").agg(*[F.sum(F.when(F.col("_q") == i, F.col("_v"))).alias(f"_q{i}") for i in range(len(shares))])


def quantile_global(df: DataFrame, cols: Names, shares: list[float], p: Panel = PANEL, period: int = PERIOD, bins: int = BINS) -> DataFrame:
    """Quantiles of the stream so far, over all instruments, taken anew after each ``period`` rows; null before the first time."""
    numbered = settled(emitted(df, p, period))
    edges = _ranges(numbered, cols, bins)
    out = numbered
    for c in cols:
        found = expanding_quantiles(numbered, c, shares, period, edges[c])
        out = out.join(found.select(F.col("_b").alias("_at"), *[F.col(f"_q{i}").alias(f"{c}_qtl{q:.2f}") for i, q in enumerate(shares)]), F.col("_b") == F.col("_at"), "left").drop("_at")
    return out.drop("_no", "_b")


def winsorize_global(df: DataFrame, cols: Names, low: float, high: float, p: Panel = PANEL, period: int = PERIOD) -> DataFrame:
    """Values held within the quantiles of the stream so far; unchanged where there are none yet."""
    out = quantile_global(df, cols, [low, high], p, period)
    for c in cols:
        a, b, x = F.col(f"`{c}_qtl{low:.2f}`"), F.col(f"`{c}_qtl{high:.2f}`"), number(c)
        out = out.withColumns({f"{c}_qtllow": a, f"{c}_qtlhigh": b, f"{c}_clipqtl": F.when(x < a, a).when(x > b, b).otherwise(x)})
        out = out.drop(*{f"{c}_qtl{low:.2f}", f"{c}_qtl{high:.2f}"})
    return out


def bucket_response(df: DataFrame, x: str, y: str, buckets: int = 8, p: Panel = PANEL, period: int = PERIOD, block: int = 1 << 16) -> DataFrame:
    """Running mean of y per bucket of x, and its variance over the root of the count, as arrays ``{x}_{y}_bucketxy_mean`` and ``_std``.

    The buckets lie between the quantiles i / (buckets + 1) of x so far; the last
    one is open. A row counts from itself on, in the bucket of that time. Rows
    without x, y or quantiles give null arrays where they don't count, and buckets
    without rows null items. Running sums go by blocks of the stream; a block
    starts from the totals of those before it.
    """
    shares = [(i + 1) / (buckets + 1) for i in range(buckets)]
    numbered = settled(emitted(df, p, period))
    found = expanding_quantiles(numbered, x, shares, period, _ranges(numbered, [x], BINS)[x])
    out = numbered.join(found.withColumnRenamed("_b", "_at"), F.col("_b") == F.col("_at"), "left").drop("_at", "_b")
    a, b = number(x), number(y)
    counts = a.isNotNull() & b.isNotNull() & F.col("_q0").isNotNull()
    place = sum(((a >= F.col(f"_q{i}")).cast("int") for i in range(buckets - 1)), F.lit(0))
    out = out.withColumns({"_j": F.when(counts, place), "_y": b, "_blk": F.floor(F.col("_no") / block)}).drop(*[f"_q{i}" for i in range(buckets)])
    parts = {f"_{k}{j}": F.when(F.col("_j") == j, v) for j in range(buckets) for k, v in (("c", F.lit(1.0)), ("s", F.col("_y")), ("t", F.col("_y") * F.col("_y")))}
    totals = out.groupBy("_blk").agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(k) for k, v in parts.items()])
    before = W.orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)  # one row a block
    start = totals.select(F.col("_blk").alias("_of"), *[F.coalesce(F.sum(k).over(before), F.lit(0.0)).alias(f"{k}_0") for k in parts])
    inside = W.partitionBy("_blk").orderBy("_no").rowsBetween(W.unboundedPreceding, 0)
    run = out.join(start, F.col("_blk") == F.col("_of")).withColumns({k: F.col(f"{k}_0") + F.coalesce(F.sum(v).over(inside), F.lit(0.0)) for k, v in parts.items()})
    n, s, t = (lambda j, k=k: F.col(f"_{k}{j}") for k in "cst")
    mean = F.array(*[F.when(n(j) > 0, s(j) / n(j)) for j in range(buckets)])
    spread = F.array(*[F.when(n(j) > 0, (t(j) / n(j) - (s(j) / n(j)) * (s(j) / n(j))) / F.sqrt(n(j))) for j in range(buckets)])
    shown = a.isNotNull() & b.isNotNull()
    return run.withColumns({f"{x}_{y}_bucketxy_mean": F.when(shown, mean), f"{x}_{y}_bucketxy_std": F.when(shown, spread)}).select(*df.columns, f"{x}_{y}_bucketxy_mean", f"{x}_{y}_bucketxy_std")
