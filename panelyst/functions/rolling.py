"""Columns over the last n rows of an instrument."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

from ..panel import Panel, ratio


def mean(x: Column, n: int, p: Panel) -> Column:
    return F.avg(x).over(p.last(n))


def highest(x: Column, n: int, p: Panel) -> Column:
    return F.max(x).over(p.last(n))


def lowest(x: Column, n: int, p: Panel) -> Column:
    return F.min(x).over(p.last(n))


def lag(x: Column, n: int, p: Panel) -> Column:
    return x if n == 0 else F.lag(x, n).over(p.rows())


def lead(x: Column, n: int, p: Panel) -> Column:
    return F.lead(x, n).over(p.rows())


def stochastic(x: Column, n: int, p: Panel) -> Column:
    low = lowest(x, n, p)
    return ratio(x - low, highest(x, n, p) - low)


def rank(x: Column, n: int, p: Panel) -> Column:
    """Share of the window below the newest value, from -1/2 on; rows before the first count as missing."""
    below = F.size(F.filter(F.collect_list(x).over(p.last(n)), lambda v: v < x))
    return F.when(x.isNotNull(), (below - n / 2) / n)


def corr(x: Column, y: Column, n: int, p: Panel) -> Column:
    """Correlation over n rows, of which those before the first and the missing ones are zeros."""
    x, y, w = F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0)), p.last(n)
    sx, sy, sxx, syy, sxy = (F.sum(c).over(w) for c in (x, y, x * x, y * y, x * y))
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 1e-9) & (vy > 1e-9), (n * sxy - sx * sy) / F.sqrt(vx * vy))


def ridge(x: Column, y: Column, n: int, penalty: float, p: Panel) -> tuple[Column, Column, Column]:
    """Intercept, slope and newest residual of y on x, the slope shrunk by the penalty."""
    both, w = x.isNotNull() & y.isNotNull(), p.last(n)
    a, b = F.when(both, x), F.when(both, y)
    k, sx, sy = F.count(a).over(w), F.sum(a).over(w), F.sum(b).over(w)
    cov, var = F.sum(a * b).over(w) - sx * sy / k, F.sum(a * a).over(w) - sx * sx / k
    beta = F.when(var + penalty > 1e-12, cov / (var + penalty)).otherwise(0.0)
    alpha = sy / k - beta * sx / k
    return alpha, beta, y - alpha - beta * x


def theta(x: Column, t: Column, n: int, weight: float, p: Panel) -> Column:
    """weight * x + (1 - weight) * the window's linear trend at its newest row; ``t`` numbers an instrument's rows."""
    w, t = p.last(n), F.when(x.isNotNull(), t.cast("double"))
    k, st, sx = F.count(x).over(w), F.sum(t).over(w), F.sum(x).over(w)
    var = F.sum(t * t).over(w) - st * st / k
    slope = F.when(var > 1e-12, (F.sum(t * x).over(w) - st * sx / k) / var).otherwise(0.0)
    return weight * x + (1 - weight) * (sx / k + slope * (t - st / k))
