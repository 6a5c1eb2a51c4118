"""Recurrences that depend on their own past non-linearly: one ordered pass per instrument.

An instrument's rows are one group; instruments run in parallel. Rows may come
in any order, each fold sorts its own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from ..panel import Panel, decay, number

PANEL = Panel()


def _fold(df: DataFrame, p: Panel, names: list[str], one) -> DataFrame:
    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in names]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([p.ts, *p.tie], kind="stable")
        return pdf.assign(**dict(zip(names, one(pdf))))

    return df.groupBy(p.key).applyInPandas(run, schema)


def _values(pdf: pd.DataFrame, col: str) -> np.ndarray:
    return pdf[col].to_numpy(float, na_value=np.nan)


def _times(pdf: pd.DataFrame, p: Panel) -> np.ndarray:
    """Times as whole numbers: microseconds of timestamps and dates."""
    t = pdf[p.ts]
    return t.to_numpy(np.int64) if t.dtype.kind in "iu" else t.to_numpy("datetime64[us]").astype(np.int64)


def cusum(df: DataFrame, col: str, target: float, slack: float = 0.5, bound: float = 5.0, p: Panel = PANEL) -> DataFrame:
    """Upper cumulative sum that restarts, giving 0, when it passes the bound; ``_alarm`` is 1 there."""

    def one(pdf):
        s, out, alarm = 0.0, [], []
        for x in _values(pdf, col):
            if math.isnan(x):
                out.append(None)
                alarm.append(0.0)
                continue
            s = max(0.0, s + x - target - slack)
            alarm.append(float(s > bound))
            s = 0.0 if s > bound else s
            out.append(s)
        return out, alarm

    return _fold(df, p, [f"{col}_cusum", f"{col}_cusum_alarm"], one)


def holt_winters(df: DataFrame, col: str, grid: list[tuple[float, float, float, int]], p: Panel = PANEL, unit: float = 86_400e6, seasonal: bool = True) -> DataFrame:
    """Level, trend and multiplicative season per grid point of half-lives (level, trend, season) and season length.

    The season slot is the time in units, modulo the length. The forecast is
    (level + trend) * season; missing rows give null and change nothing.
    """
    names = [f"{col}_{a}x{b}x{g}x{m}_{int(seasonal)}" for a, b, g, m in grid]

    def one(pdf):
        slots, values, results = _times(pdf, p) // int(unit), _values(pdf, col), []
        for a, b, g, m in grid:
            a, b, g = decay(a), decay(b), decay(g)
            level = trend = None
            season, out = {}, []
            for slot, x in zip(slots % m, values):
                if math.isnan(x):
                    out.append(None)
                    continue
                s = season.get(slot, 1.0) if seasonal else 1.0
                if level is None:  # the recursion begins at the first value
                    level, trend = x, 0.0
                new = a * x / s + (1 - a) * (level + trend)
                trend = b * (new - level) + (1 - b) * trend
                level = new
                if seasonal:
                    season[slot] = min(20.0, max(0.05, g * x / level + (1 - g) * s)) if level else s
                out.append((level + trend) * (season[slot] if seasonal else 1.0))
            results.append(out)
        return results

    return _fold(df, p, names, one)


def ata(df: DataFrame, col: str, level: int = 1, trend: int = 1, ahead: int = 1, p: Panel = PANEL) -> DataFrame:
    """Smoothing whose weights fall with the row number: level/t and trend/t; gives level + ahead * trend."""

    def one(pdf):
        s = b = last = None
        t, out = 0, []
        for x in _values(pdf, col):
            if math.isnan(x):
                out.append(None)
                continue
            t += 1
            a = min(1.0, level / t)
            if s is None:
                s, b = x, 0.0
            else:
                new = a * x + (1 - a) * (s + b)
                c = min(1.0, trend / t)
                b = (x - last) if t <= trend else c * (new - s) + (1 - c) * b
                s = new
            last = x
            out.append(s + ahead * b)
        return [out]

    return _fold(df, p, [f"{col}_ata{level}x{trend}"], one)


def holt_level(df: DataFrame, col: str, level: float, trend: float, p: Panel = PANEL) -> DataFrame:
    """Level plus trend, both smoothed with the given factors (0 to 1); missing rows give null and change nothing."""

    def one(pdf):
        s = b = None
        out = []
        for x in _values(pdf, col):
            if math.isnan(x):
                out.append(None)
                continue
            before, s = s, x if s is None else level * x + (1 - level) * (s + b)
            b = 0.0 if before is None else trend * (s - before) + (1 - trend) * b
            out.append(s + b)
        return [out]

    return _fold(df, p, [f"{col}_holt{level}x{trend}"], one)


def point_figure(df: DataFrame, col: str, tick: float, reverse: int, p: Panel = PANEL) -> DataFrame:
    """Point-and-figure: prices in whole boxes of ``tick``; the direction turns when the price retraces ``reverse`` boxes.

    ``_px`` and ``_el`` are the price and the price at the last turn (at first,
    the first one), both rounded down to a box; ``_dir`` is 1 or -1, ``_perf`` the
    relative change since the turn (0 from a price of 0) and ``_perf2`` the
    change in boxes. ``_dur`` is the time since the turn: in microseconds for
    timestamps and dates, else in the unit of the time column. Missing prices
    give nulls and change nothing.
    """
    stem = f"{col}_pfp{tick}x{reverse}"

    def one(pdf):
        rows, way, extreme, entry, since = [], 1.0, None, None, 0
        for t, x in zip(_times(pdf, p), _values(pdf, col)):
            if math.isnan(x):
                rows.append((None,) * 6)
                continue
            box = float(x // tick)
            if entry is None:
                extreme, entry, since = box, box, t
            extreme = max(extreme, box) if way > 0 else min(extreme, box)
            if way * (extreme - box) >= reverse:
                way, extreme, entry, since = -way, box, box, t
            rows.append((box * tick, way, entry * tick, box / entry - 1 if entry else 0.0, box - entry, float(t - since)))
        return [list(c) for c in zip(*rows)]

    return _fold(df, p, [f"{stem}_{s}" for s in ("px", "dir", "el", "perf", "perf2", "dur")], one)


def svd_residual(df: DataFrame, col: str, lookback: int, every: int, parts: int, p: Panel = PANEL) -> DataFrame:
    """What is left of each newest value after the leading components of the matrix of times and instruments.

    At each ``every``-th time the components are fitted on the ``lookback``
    times up to it and used until the next fit. Fit epochs run in parallel; an
    epoch's block of times is one group. Missing values are zeros; ``_svd1``.. are
    the epoch's singular values.
    """
    from pyspark.sql import Window as W

    times = df.select(p.ts).distinct().withColumn("_n", F.row_number().over(W.orderBy(p.ts)) - 1)  # one row a time
    x = df.groupBy(p.ts, p.key).agg((F.max_by(number(col), F.struct(*p.tie)) if p.tie else F.max(number(col))).alias("_x")).join(times, p.ts)
    # epoch e is fitted on times up to e*every+lookback-1 and serves the times from there on
    first = F.greatest(F.floor((F.col("_n") - lookback + 1) / every), F.lit(0))
    last = F.floor(F.col("_n") / every)
    blocks = x.withColumn("_e", F.explode(F.sequence(first, last)))
    names = [f"_svd{i + 1}" for i in range(parts)]
    schema = StructType([df.schema[p.ts], df.schema[p.key], StructField(f"{col}_svdres", DoubleType()), *[StructField(f"{col}{n}", DoubleType()) for n in names]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = int(pdf["_e"].iat[0])
        fit = e * every + lookback - 1
        m = pdf.pivot_table(index="_n", columns=p.key, values="_x", aggfunc="last", dropna=False)
        past = m.reindex(range(e * every, fit + 1)).fillna(0.0).to_numpy()
        _, d, v = np.linalg.svd(past, full_matrices=False)
        v = v[:parts]
        serve = pdf[(pdf["_n"] >= fit) & (pdf["_n"] < fit + every)]
        values = m.reindex(serve["_n"].unique()).fillna(0.0)
        rest = values - values.to_numpy() @ v.T @ v
        out = serve[[p.ts, p.key]].copy()
        out[f"{col}_svdres"] = [rest.at[n, k] for n, k in zip(serve["_n"], serve[p.key])]
        for i, n in enumerate(names):
            out[f"{col}{n}"] = float(d[i]) if i < len(d) else 0.0
        return out

    return blocks.groupBy("_e").applyInPandas(run, schema)
