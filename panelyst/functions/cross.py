"""Columns over the rows of one time, optionally within a group and weighted."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column
from pyspark.sql.window import WindowSpec

from ..panel import ratio


def mean(x: Column, w: Column, at: WindowSpec) -> Column:
    """Weighted mean; 0 where the weights sum to nothing."""
    total = F.sum(F.when(x.isNotNull(), w)).over(at)
    return F.when(total > 0, F.sum(x * w).over(at) / total).otherwise(0.0)


def std(x: Column, w: Column, at: WindowSpec, least: int = 2) -> Column:
    """Weighted deviation with the sample correction by the number of rows; 0 below ``least`` rows."""
    n, total = F.count(x).over(at), F.sum(F.when(x.isNotNull(), w)).over(at)
    m = F.sum(x * w).over(at) / total
    v = (F.sum(x * x * w).over(at) / total - m * m) * n / (n - 1)
    return F.when((total > 0) & (n >= max(2, least)), F.sqrt(F.greatest(v, F.lit(0.0)))).otherwise(0.0)


def scaled(x: Column, w: Column, at: WindowSpec) -> Column:
    return ratio(x, std(x, w, at))


def place(x: Column, at: WindowSpec, *tie: str) -> tuple[Column, Column]:
    """Number of rows at this time, and the row's place from 0 in ascending order."""
    return F.count(F.lit(1)).over(at), F.row_number().over(at.orderBy(x.asc_nulls_last(), *tie)) - 1


def rank(x: Column, at: WindowSpec, *tie: str) -> Column:
    """Place scaled to -1..1; 0 alone."""
    n, r = place(x, at, *tie)
    return F.when(n <= 1, 0.0).otherwise((r - (n - 1) / 2) / (n - 1) * 2)


def rank_up(x: Column, at: WindowSpec, *tie: str) -> Column:
    return place(x, at, *tie)[1].cast("double")


def rank_down(x: Column, at: WindowSpec, *tie: str) -> Column:
    """n for the least to 1 for the greatest; 0 alone."""
    n, r = place(x, at, *tie)
    return F.when(n <= 1, 0.0).otherwise((n - r).cast("double"))
