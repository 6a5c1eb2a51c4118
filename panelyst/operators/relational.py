"""Joins, reshaping, aggregation and pairs on panels."""

from __future__ import annotations

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import Window as W

from ..panel import Panel, number

PANEL = Panel()


def merge_asof(left: DataFrame, right: DataFrame, p: Panel, feats: list[str] | None = None, forward: bool = False) -> DataFrame:
    """Each left row with the right row of its key that is latest at or before it, as ``{c}_masof``.

    Both sides go through one exchange and one sort: right rows stand before
    left rows of the same time, and the last right row is carried along. A
    matched null stays null. ``forward`` looks for the next row instead. Right
    rows of one time are taken in the order of the tie columns.
    """
    feats = feats or [c for c in right.columns if c not in (p.ts, p.key, *p.tie)]
    tie = [c for c in p.tie if c in right.columns]
    values = F.struct(*[F.col(c) for c in feats])
    kind = values_type(right, feats)
    a = left.select(p.key, p.ts, F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"), F.lit(None).cast(kind).alias("_right"), *[F.lit(None).cast(dict(right.dtypes)[c]).alias(f"_t_{c}") for c in tie])
    b = right.select(p.key, p.ts, F.lit(0).alias("_side"), F.lit(None).cast(left.schema.simpleString()).alias("_row"), values.alias("_right"), *[F.col(c).alias(f"_t_{c}") for c in tie])
    ts = F.col(p.ts).desc() if forward else F.col(p.ts).asc()
    w = W.partitionBy(p.key).orderBy(ts, "_side", *[f"_t_{c}" for c in tie]).rowsBetween(W.unboundedPreceding, 0)
    met = a.unionByName(b).withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    return met.select("_row.*", *[F.col("_right")[c].alias(f"{c}_masof") for c in feats])


def values_type(df: DataFrame, cols: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "struct<" + ",".join(f"`{c}`:{kinds[c]}" for c in cols) + ">"


def group_last(df: DataFrame, cols: list[str], p: Panel = PANEL) -> DataFrame:
    """Last row of each time and instrument by the tie columns."""
    order = F.struct(*p.tie)
    return df.groupBy(p.ts, p.key).agg(*[F.max_by(c, order).alias(c) for c in cols])


def group_sum(df: DataFrame, cols: list[str], by: list[str], p: Panel = PANEL, mean: bool = False) -> DataFrame:
    return df.groupBy(p.ts, *by).agg(*[(F.avg if mean else F.sum)(number(c)).alias(c) for c in cols])


def time_bars(df: DataFrame, col: str, period: str, p: Panel = PANEL, keep_last: int | None = None) -> DataFrame:
    """Open, high, low, close and count per instrument and period; ``id`` numbers an instrument's bars."""
    order = F.struct(p.ts, *p.tie)
    bars = df.groupBy(p.key, F.window(p.ts, period).alias("_w")).agg(
        F.min_by(col, order).alias("open"), F.max(col).alias("high"), F.min(col).alias("low"), F.max_by(col, order).alias("close"), F.count(col).alias("cnt")
    )
    w = W.partitionBy(p.key).orderBy("date")
    bars = bars.select(F.col("_w.start").alias("date"), p.key, "open", "high", "low", "close", "cnt").withColumn("id", F.row_number().over(w) - 1)
    if keep_last is not None:
        bars = bars.withColumn("_r", F.row_number().over(W.partitionBy(p.key).orderBy(F.desc("date")))).where(F.col("_r") <= keep_last).drop("_r")
    return bars


def pivot(df: DataFrame, col: str, keys: list, p: Panel = PANEL) -> DataFrame:
    """One column per key; of several rows of a time and key the last by the tie columns counts."""
    return df.groupBy(p.ts).pivot(p.key, keys).agg(F.max_by(col, F.struct(*p.tie)) if p.tie else F.max(col))


def unpivot(df: DataFrame, keys: list[str], p: Panel = PANEL, value: str = "serie") -> DataFrame:
    """One row per time and key column, missing ones included."""
    return df.unpivot([p.ts], keys, p.key, value)


# --- pairs of instruments ----------------------------------------------------


def pair_correlation(df: DataFrame, col: str, lookback: int, every: int, p: Panel = PANEL, cluster: str | None = None) -> DataFrame:
    """Correlation of each two instruments (of one cluster) over ``lookback`` times, at each ``every``-th time.

    Missing observations count as zeros, which adds nothing to the sums of
    products; so only pairs seen together are multiplied out, and the sums of
    single instruments are joined to them.
    """
    times = df.select(p.ts).distinct().withColumn("_n", F.row_number().over(W.orderBy(p.ts)) - 1)  # one row a time
    fits = times.where((F.col("_n") >= lookback - 1) & ((F.col("_n") - lookback + 1) % every == 0)).select(F.col("_n").alias("_fit"), F.col(p.ts).alias("_at"))
    by = [cluster] if cluster else []
    x = df.groupBy(p.ts, p.key, *by).agg(F.last(number(col)).alias("_x") if not p.tie else F.max_by(number(col), F.struct(*p.tie)).alias("_x")).join(times, p.ts)
    first = F.greatest(F.ceil((F.col("_n") - lookback + 1) / every), F.lit(0))
    last = F.floor(F.col("_n") / every)
    spread = x.where("_x is not null").withColumn("_k", F.explode(F.sequence(first, last))).withColumn("_fit", F.col("_k") * every + lookback - 1).join(fits, "_fit")
    spread = spread.select("_at", p.ts, F.col(p.key).alias("_c"), "_x", *by)
    one = spread.groupBy("_at", "_c", *by).agg(F.sum("_x").alias("_s"), F.sum(F.col("_x") * F.col("_x")).alias("_q"))
    a, b = spread.alias("a"), spread.alias("b")
    same = (F.col("a._at") == F.col("b._at")) & (F.col(f"a.{p.ts}") == F.col(f"b.{p.ts}")) & (F.col("a._c") < F.col("b._c"))
    for c in by:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    both = a.join(b, same).groupBy(F.col("a._at").alias("_at"), F.col("a._c").alias("dscode1"), F.col("b._c").alias("dscode2")).agg(F.sum(F.col("a._x") * F.col("b._x")).alias("_p"))
    left = one.select("_at", F.col("_c").alias("dscode1"), F.col("_s").alias("_s1"), F.col("_q").alias("_q1"))
    right = one.select("_at", F.col("_c").alias("dscode2"), F.col("_s").alias("_s2"), F.col("_q").alias("_q2"))
    n = F.lit(float(lookback))
    square = (n * F.col("_q1") - F.col("_s1") * F.col("_s1")) * (n * F.col("_q2") - F.col("_s2") * F.col("_s2"))
    dist = F.when(square > 0, (n * F.col("_p") - F.col("_s1") * F.col("_s2")) / F.sqrt(square))
    return both.join(left, ["_at", "dscode1"]).join(right, ["_at", "dscode2"]).select(F.col("_at").alias("dtsi"), "dscode1", "dscode2", dist.alias("dist"))


def pick_pairs(df: DataFrame, k: int, by: str = "dtsi") -> DataFrame:
    """Pairs by ascending distance, each code in at most ``k``; per time, one greedy pass.

    Ties go by the codes. Pairs of a code with itself are left out and codes are
    put in order. A time's pairs are one group.
    """

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        used, keep = {}, []
        for i, a, b in pdf.sort_values(["dist", "dscode1", "dscode2"])[["dscode1", "dscode2"]].itertuples():
            if used.get(a, 0) < k and used.get(b, 0) < k:
                used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
                keep.append(i)
        return pdf.loc[keep]

    ordered = df.where("dscode1 <> dscode2").select(by, F.least("dscode1", "dscode2").alias("dscode1"), F.greatest("dscode1", "dscode2").alias("dscode2"), "dist")
    return ordered.groupBy(by).applyInPandas(greedy, ordered.schema)


def explode_pairs(df: DataFrame, chosen: DataFrame, col: str, p: Panel = PANEL) -> DataFrame:
    """At each time, both values of every pair of the latest selection at or before it; null where one is missing."""
    times = df.select(p.ts).distinct().withColumn("_one", F.lit(0))
    epochs = chosen.select(F.col("dtsi").alias(p.ts)).distinct().withColumns({"_one": F.lit(0), "_epoch": F.col(p.ts)})
    at = merge_asof(times, epochs, Panel(p.ts, "_one"), ["_epoch"]).where("_epoch_masof is not null")
    pairs = at.join(chosen.select(F.col("dtsi").alias("_epoch_masof"), "dscode1", "dscode2"), "_epoch_masof").select(p.ts, "dscode1", "dscode2")
    order = F.struct(*p.tie) if p.tie else F.lit(1)
    values = df.groupBy(p.ts, p.key).agg(F.max_by(number(col), order).alias("_v"))
    for i in ("1", "2"):
        pairs = pairs.join(values.select(p.ts, F.col(p.key).alias(f"dscode{i}"), F.col("_v").alias(f"serie{i}")), [p.ts, f"dscode{i}"], "left")
    return pairs.select(p.ts, "dscode1", "dscode2", "serie1", "serie2")


def collapse_pairs(pairs: DataFrame, col: str, p: Panel = PANEL) -> DataFrame:
    """Pair values back on their codes: plus on the first, minus on the second, mean over a code's pairs."""
    legs = F.explode(F.array(F.struct(F.col("dscode1").alias("c"), number(col).alias("v")), F.struct(F.col("dscode2").alias("c"), (-number(col)).alias("v"))))
    return pairs.select(p.ts, legs.alias("_l")).groupBy(p.ts, F.col("_l.c").alias(p.key)).agg(F.avg("_l.v").alias(col))
