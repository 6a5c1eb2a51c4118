"""Exponentially weighted columns. Half-lives are in rows; null rows give null and leave the state alone."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.internal import InternalFunction

from ..panel import Panel, decay


def ewm(x: Column, halflife: float, p: Panel) -> Column:
    """Weighted mean of the rows so far, weights falling by half each ``halflife`` rows."""
    mean = InternalFunction.ewm(x, decay(halflife), True).over(p.rows())
    return F.when(x.isNotNull(), mean)


def ewm_std(x: Column, halflife: float, p: Panel) -> Column:
    m = ewm(x, halflife, p)
    return F.sqrt(F.greatest(ewm(x * x, halflife, p) - m * m, F.lit(0.0)))


def power(x: np.ndarray, n: float) -> np.ndarray:
    """The C library's pow, which SQL engines call too. Those of numpy and of the JVM round some values otherwise."""
    try:
        return np.fromiter(map(math.pow, x.tolist(), repeat(float(n))), float, len(x))
    except OverflowError:
        return np.power(x, float(n))


#: Rows that are added one by one; what lies before them is added as the one sum that it is already.
REACH = 128


class Recursion:
    """The recursions r = (1-a) r + a x**i, begun at the first value, for i from 1 to n.

    Values come in batches in the order of rows, instrument after instrument,
    with their number (from 1) in it. The weighted mean differs from the recursion
    only by the weight of the beginning, which has a closed form. Moments of nearly
    equal values cancel down to the last bit; so powers and sums are rounded as in
    SQL, where a row's sum begins with its own term and goes back in time.
    """

    def __init__(self, halflife: float, n: int):
        self.keep, self.first = 1 - decay(halflife), np.zeros(1)
        self.weights = [math.pow(self.keep, j) for j in range(REACH + 1)]
        self.powers = self.sums = np.empty((n + 1, 0))

    def __call__(self, x: np.ndarray, number: np.ndarray) -> list[np.ndarray]:
        powers = np.concatenate([self.powers, [power(x, i) for i in range(len(self.powers))]], axis=1)
        sums = np.concatenate([self.sums, np.zeros((len(powers), len(x)))], axis=1)
        held = self.powers.shape[1]
        at = live = np.arange(len(x)) + held
        for j, w in enumerate(self.weights[:REACH]):
            live = live[number[live - held] > j]
            sums[:, live] += powers[:, live - j] * w
        block = (number - 1) // REACH
        for b in np.unique(block[block > 0]):
            sums[:, at[block == b]] += sums[:, at[block == b] - REACH] * self.weights[REACH]
        self.powers, self.sums = powers[:, -REACH:], sums[:, -REACH:]
        begun = number == 1
        firsts = np.concatenate([self.first, x[begun]])
        first, self.first = firsts[np.cumsum(begun)], firsts[-1:]
        left = np.fromiter((math.pow(self.keep, c) for c in number.tolist()), float, len(x))
        begin = [power(first, i) for i in range(1, len(powers))]
        return [np.where(begun, f, s / sums[0, at] * (1 - left) + left * f) for f, s in zip(begin, sums[1:, at])]


def skew(r1: np.ndarray, r2: np.ndarray, r3: np.ndarray) -> np.ndarray:
    v = r2 - r1 * r1
    some = v > 1e-9
    return np.where(some, (r3 - 3 * r2 * r1 + 2 * power(r1, 3)) / power(np.where(some, v, 1.0), 1.5), np.where(np.isnan(v), v, 0.0))


def kurt(r1: np.ndarray, r2: np.ndarray, r3: np.ndarray, r4: np.ndarray) -> np.ndarray:
    v = r2 - r1 * r1
    some = v > 1e-14
    return np.where(some, (r4 - 4 * r3 * r1 + 6 * r2 * r1 * r1 - 3 * power(r1, 4)) / power(np.where(some, v, 1.0), 2) - 3, np.where(np.isnan(v), v, 0.0))


def moments(df: DataFrame, made: dict[str, tuple[Column, float]], shape: Callable[..., np.ndarray], n: int, p: Panel) -> DataFrame:
    """Columns (value, half-life) of a shape of the first n recursive moments: one ordered pass, an instrument after another.

    Only the last REACH rows are held, so instruments may be of any length.
    """
    xs, ns = [f"_x{i}" for i in range(len(made))], [f"_n{i}" for i in range(len(made))]
    placed = df.withColumns({x: value for x, (value, _) in zip(xs, made.values())}).repartition(p.key).sortWithinPartitions(p.key, p.ts, *p.tie)
    placed = placed.withColumns({c: F.count(x).over(p.so_far()) for x, c in zip(xs, ns)})
    halflives = [h for _, h in made.values()]

    def run(batches):
        folds = [Recursion(h, n) for h in halflives]
        for batch in batches:
            for x, c, fold in zip(xs, ns, folds):
                here = batch.column(x).is_valid().to_numpy(zero_copy_only=False)
                out = np.zeros(len(here))
                with np.errstate(all="ignore"):
                    out[here] = shape(*fold(batch.column(x).to_numpy(zero_copy_only=False)[here], batch.column(c).to_numpy()[here]))
                batch = batch.set_column(batch.schema.get_field_index(x), x, pa.array(out, mask=~here))
            yield batch

    found = placed.mapInArrow(run, placed.schema)
    return found.withColumns({name: F.col(x) for name, x in zip(made, xs)}).drop(*xs, *ns)
