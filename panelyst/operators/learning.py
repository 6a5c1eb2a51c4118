"""Walk-forward splits and models, models per group, and clustering."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, StructField, StructType

from ..panel import Panel, number

PANEL = Panel()


def splits(first, last, unit, lookback: int, every: int, gap: int = 1, least: int | None = None) -> list[dict]:
    """Train and test ranges: the train end moves by ``every`` units, tests follow after ``gap`` units."""
    least, out = lookback if least is None else least, []
    end = first + least * unit
    while end + gap * unit < last:
        start = max(first, end - lookback * unit)
        test = end + gap * unit
        out.append({"train_start": start, "train_end": end, "test_start": test, "test_end": min(last, end + (gap + every) * unit)})
        end = end + every * unit
    return out


def time_splits(df: DataFrame, p: Panel, lookback: int, every: int, gap: int = 1, least: int | None = None) -> list[dict]:
    """Splits over the panel's times; the unit is the median step between different times."""
    times = df.select(p.ts).distinct()
    micros = F.unix_micros(F.col(p.ts).cast("timestamp")) if "timestamp" in dict(df.dtypes)[p.ts] or dict(df.dtypes)[p.ts] == "date" else F.col(p.ts)
    steps = times.select(micros.alias("t")).withColumn("d", F.col("t") - F.lag("t").over(W.orderBy("t")))  # one row a time
    lo, hi, unit = steps.agg(F.min("t"), F.max("t"), F.percentile("d", 0.5)).first()
    return splits(lo, hi, unit, lookback, every, gap, least) if unit else []


def calendar_splits(days: list[dt.date], every: int = 250, least: int = 400, most: int = 600, gap: int = 1) -> list[dict]:
    """Splits over a list of days: train ends move by ``every`` days, a train range has ``most`` days at most.

    Tests begin ``gap`` days of the list after the train end; the last test
    reaches 50 business days beyond the list, for days yet to come. Up to
    ``least`` days give one split at seven tenths of the list.
    """
    days = sorted(set(days))
    n = len(days)
    if n <= least:
        cut = int(n * 0.7)
        return [{"train_start": days[0], "train_end": days[cut], "test_start": days[cut + 1], "test_end": days[-1]}] if cut + 1 < n else []
    out, end = [], least
    while end + gap < n:
        last = end + every >= n
        stop = pd.Timestamp(days[-1]) + pd.offsets.BDay(50) if last else days[end + every + gap - 1]
        out.append({"train_start": days[max(0, end - most)], "train_end": days[end], "test_start": days[end + gap], "test_end": stop.date() if last else stop})
        end += every
    return out


def _range(df: DataFrame, p: Panel, a, b, closed: bool) -> DataFrame:
    kind = dict(df.dtypes)[p.ts]
    t = F.unix_micros(F.col(p.ts).cast("timestamp")) if kind.startswith("timestamp") or kind == "date" else F.col(p.ts)
    return df.where((t >= a) & ((t <= b) if closed else (t < b)))


def walk_forward(df: DataFrame, feats: list[str], target: str, estimator: Callable, parts: list[dict], p: Panel = PANEL, name: str = "model") -> DataFrame:
    """Fit an estimator per split on its train range and predict its test range; rows in no test range are not returned."""
    from pyspark.ml.feature import VectorAssembler

    ready = df.withColumns({f: F.coalesce(number(f), F.lit(0.0)) for f in feats} | {"label": number(target)})
    ready = VectorAssembler(inputCols=feats, outputCol="features").transform(ready)
    out = None
    for s in parts:
        train = _range(ready, p, s["train_start"], s["train_end"], True).where("label is not null")
        test = _range(ready, p, s["test_start"], s["test_end"], s is parts[-1])
        if train.isEmpty():
            continue
        done = estimator().fit(train).transform(test).select(*df.columns, F.col("prediction").alias(f"{name}_{target}"))
        out = done if out is None else out.unionByName(done)
    if out is None:
        return df.limit(0).withColumn(f"{name}_{target}", F.lit(None).cast("double"))
    return out


def local_models(df: DataFrame, by: str, feats: list[str], target: str, is_train: str, model: Callable) -> DataFrame:
    """One model per group: fitted on the group's rows with ``is_train``, predicting all of them as ``local_{target}``."""
    schema = StructType([*df.schema.fields, StructField(f"local_{target}", DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        train = pdf[pdf[is_train] & pdf[target].notna()]
        if train.empty:
            return pdf.assign(**{f"local_{target}": None})
        m = model()
        m.fit(train[feats].fillna(0.0).to_numpy(float), train[target].to_numpy(float))
        return pdf.assign(**{f"local_{target}": m.predict(pdf[feats].fillna(0.0).to_numpy(float))})

    return df.groupBy(by).applyInPandas(run, schema)


class LeastSquares:
    """Ridge regression with an intercept, for local models."""

    def __init__(self, penalty: float = 1e-6):
        self.penalty = penalty

    def fit(self, x, y):
        import numpy as np

        a = np.column_stack([x, np.ones(len(x))])
        self.w = np.linalg.solve(a.T @ a + self.penalty * np.eye(a.shape[1]), a.T @ y)

    def predict(self, x):
        import numpy as np

        return np.column_stack([x, np.ones(len(x))]) @ self.w


def cluster_codes(df: DataFrame, col: str, parts: list[dict], k: int, p: Panel = PANEL, seed: int = 42) -> DataFrame:
    """Per split, k-means over instruments by their vectors of values in the train range; ``kmeans_cat`` holds from the test start."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    out = None
    for s in parts:
        train = _range(df, p, s["train_start"], s["train_end"], True)
        days = [r[0] for r in train.select(F.to_date(p.ts).alias("d")).distinct().orderBy("d").collect()]  # the dates of one train range
        by = train.groupBy(p.key, F.to_date(p.ts).alias("d")).agg(F.avg(number(col)).alias("x")).groupBy(p.key).agg(F.map_from_entries(F.collect_list(F.struct("d", "x"))).alias("m"))
        vectors = by.select(p.key, array_to_vector(F.array(*[F.coalesce(F.col("m")[F.lit(d)], F.lit(0.0)) for d in days])).alias("features"))
        fitted = KMeans(k=k, seed=seed).fit(vectors).transform(vectors)
        part = fitted.select(F.lit(s["test_start"]).alias("valid_from"), p.key, F.col("prediction").alias("kmeans_cat"))
        out = part if out is None else out.unionByName(part)
    return out


def silhouettes(vectors: DataFrame, counts: range = range(2, 11), seed: int = 42) -> list[tuple[int, float]]:
    """Mean silhouette of k-means for each number of clusters, over a frame with ``features``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    judge = ClusteringEvaluator(featuresCol="features")
    return [(k, judge.evaluate(KMeans(k=k, seed=seed).fit(vectors).transform(vectors))) for k in counts]


def mean_absolute_error(df: DataFrame, actual: str, predicted: str, by: list[str] = []) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.abs(number(actual) - number(predicted))).alias("mae"))
