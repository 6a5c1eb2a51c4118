"""Panels as streams: bars, exponential means and as-of joins with state and watermarks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.relational import merge_asof
from ..panel import Panel, decay


def time_bars(stream: DataFrame, col: str, period: str, delay: str, p: Panel) -> DataFrame:
    """Bars per instrument and period, emitted once when the watermark has passed their end; later rows are dropped."""
    timed = stream.withColumn(p.ts, F.col(p.ts).cast("timestamp")).withWatermark(p.ts, delay)
    order = F.struct(p.ts, *p.tie)
    bars = timed.groupBy(p.key, F.window(p.ts, period).alias("_w")).agg(
        F.min_by(col, order).alias("open"), F.max(col).alias("high"), F.min(col).alias("low"), F.max_by(col, order).alias("close"), F.count(col).alias("cnt")
    )
    return bars.select(F.col("_w.start").alias("date"), p.key, "open", "high", "low", "close", "cnt")


def ewm(stream: DataFrame, col: str, halflife: float, p: Panel, on_late: str = "error") -> DataFrame:
    """Exponential mean with its sums kept per instrument from batch to batch.

    A row older than the instrument's last one raises, or is left out with
    ``on_late="drop"``. Rows of one batch may come in any order.
    """
    keep = 1 - decay(halflife)
    ties = list(p.tie)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields) + f", `{col}_ewm{halflife}` double"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, w, seen = state.get if state.exists else (0.0, 0.0, None)
        pdf = pd.concat(list(batches)).sort_values([p.ts, *ties], kind="stable")
        at = pdf[p.ts].to_numpy("datetime64[us]").astype("int64") if pdf[p.ts].dtype.kind == "M" else pdf[p.ts].to_numpy("int64")
        if seen is not None and len(at) and at[0] < seen:
            if on_late == "error":
                raise ValueError(f"row at {at[0]} after {seen} for {key}")
            pdf, at = pdf[at >= seen], at[at >= seen]
        means = []
        for x in pdf[col]:
            if pd.isna(x):
                means.append(None)
                continue
            s, w = s * keep + x, w * keep + 1
            means.append(s / w)
        if len(at):
            state.update((s, w, int(at[-1])))
        yield pdf.assign(**{f"{col}_ewm{halflife}": means})

    return stream.groupBy(p.key).applyInPandasWithState(step, out, "s double, w double, seen long", "append", GroupStateTimeout.NoTimeout)


def asof_sink(right: Callable[[], DataFrame], feats: list[str], p: Panel, path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch joined as of a table that is read anew, written once per batch number."""

    def write(batch: DataFrame, number: int) -> None:
        merge_asof(batch, right(), p, feats).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
