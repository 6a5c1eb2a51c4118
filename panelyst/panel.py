"""The panel: which columns hold time, instrument and tie order, and the windows over them.

A panel is a flat table with one row per observation of one instrument. Rows of
an instrument are ordered by time and then by the tie columns; nothing depends
on the physical order of the rows. Missing numbers are null; NaN is turned into
null where a column enters an operator.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

#: A denominator this near to zero counts as zero.
ZERO = 1e-8


@dataclass(frozen=True)
class Panel:
    ts: str = "dtsi"
    key: str = "dscode"
    tie: tuple[str, ...] = ()

    def rows(self) -> WindowSpec:
        """An instrument's rows in order, without a frame."""
        return W.partitionBy(self.key).orderBy(self.ts, *self.tie)

    def so_far(self) -> WindowSpec:
        return self.rows().rowsBetween(W.unboundedPreceding, 0)

    def last(self, n: int) -> WindowSpec:
        return self.rows().rowsBetween(1 - n, 0)

    def at(self, *by: str) -> WindowSpec:
        """All rows of one time (and group)."""
        return W.partitionBy(self.ts, *by)

    def check(self, df: DataFrame, *columns: str) -> None:
        """Raise early, with all missing names."""
        if missing := [c for c in (self.ts, self.key, *self.tie, *columns) if c not in df.columns]:
            raise ValueError(f"columns missing: {missing}; there are {df.columns}")


def number(c: str | Column) -> Column:
    """The column as double, NaN as null."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.nanvl(c, F.lit(None).cast("double"))


def ratio(n: Column, d: Column, default: float = 0.0) -> Column:
    """n / d, and the default where d is zero within ZERO; null where either is null."""
    return F.when(F.abs(d) <= ZERO, F.when(n.isNotNull(), F.lit(default))).otherwise(n / d)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds that are None do not bound; null stays null."""
    if low is not None:
        c = F.when(c < low, F.lit(float(low))).otherwise(c)
    if high is not None:
        c = F.when(c > high, F.lit(float(high))).otherwise(c)
    return c


def settled(df: DataFrame) -> DataFrame:
    """The frame, worked out once for the several branches that read it.

    It goes to the session's checkpoint folder where there is one; else Spark
    keeps it in memory and on disk, to be worked out again where a part is lost.
    """
    if df.sparkSession.sparkContext.getCheckpointDir():
        return df.checkpoint(eager=False)
    return df.persist()


def decay(halflife: float) -> float:
    """Smoothing factor of a half-life in rows; a half-life of 0 means none."""
    return 0.0 if halflife == 0 else 1 - 0.5 ** (1 / halflife)
