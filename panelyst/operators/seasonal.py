"""Outliers, year-over-year features and the holiday calendar."""

from __future__ import annotations

import datetime as dt

import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import Window as W

from ..panel import Panel, clip, number
from .relational import merge_asof

PANEL = Panel()
#: Turns a median absolute deviation into a standard deviation, for normal values.
MAD = 1.4826


def median(a):
    """Median of an ascending array of doubles."""
    n = F.size(a)
    return (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2


def hampel(df: DataFrame, cols: list[str], window: int, sigmas: float = 3.0, p: Panel = PANEL) -> DataFrame:
    """Per column ``_med``, ``_mad``, ``_thr``, ``_out`` (0/1) and ``_filtered``; null medians where the centred window is not full."""
    half = window // 2
    frame = p.rows().rowsBetween(-half, window - half - 1)
    out = df.withColumns({f"_a_{c}": F.array_sort(F.collect_list(number(c)).over(frame)) for c in cols})
    out = out.withColumns({f"{c}_med": F.when(F.size(f"_a_{c}") == window, median(F.col(f"_a_{c}"))) for c in cols})
    for c in cols:
        med = F.col(f"{c}_med")
        out = out.withColumn(f"_d_{c}", F.array_sort(F.transform(f"_a_{c}", _distance(med))))
        out = out.withColumn(f"{c}_mad", F.when(med.isNotNull(), median(F.col(f"_d_{c}"))))
        thr = sigmas * MAD * F.col(f"{c}_mad")
        hit = F.coalesce(F.abs(number(c) - med) > thr, F.lit(False))
        out = out.withColumns({f"{c}_thr": thr, f"{c}_out": hit.cast("int"), f"{c}_filtered": F.when(hit, med).otherwise(number(c))}).drop(f"_a_{c}", f"_d_{c}")
    return out


def _distance(med):
    return lambda v: F.abs(v - med)


def autocorr(df: DataFrame, cols: list[str], p: Panel = PANEL) -> DataFrame:
    """Per instrument, lag-1 correlation of the average ranks of the forward-filled series; 1 where it does not vary."""
    filled = df.withColumns({f"_f_{c}": F.last(number(c), ignorenulls=True).over(p.so_far()) for c in cols})
    ranked = filled.withColumns({f"_r_{c}": F.rank().over(W.partitionBy(p.key).orderBy(f"_f_{c}")) + (F.count(F.lit(1)).over(W.partitionBy(p.key, f"_f_{c}")) - 1) / 2 for c in cols})
    lagged = ranked.withColumns({f"_l_{c}": F.lag(f"_r_{c}").over(p.rows()) for c in cols})
    return lagged.groupBy(p.key).agg(*[F.when(F.coalesce(F.stddev_pop(f"_r_{c}"), F.lit(0.0)) == 0, 1.0).otherwise(F.corr(f"_r_{c}", f"_l_{c}")).alias(f"{c}_autocorr") for c in cols])


def hampel_report(df: DataFrame, cols: list[str], window: int = 100, sigmas: float = 3.0, least: int = 100, p: Panel = PANEL) -> DataFrame:
    """Outlier counts per instrument and column, with the reason where a series is not fit for the test."""
    signed = df.withColumns({f"_s_{c}": F.signum(number(c)) * F.ln(1 + F.abs(number(c))) for c in cols})
    auto = autocorr(signed, [f"_s_{c}" for c in cols], p)
    stats = df.groupBy(p.key).agg(*[x for c in cols for x in (F.count(number(c)).alias(f"_n_{c}"), F.sum((number(c) == 0).cast("long")).alias(f"_z_{c}"), F.countDistinct(number(c)).alias(f"_u_{c}"))])
    counts = hampel(df, cols, window, sigmas, p).groupBy(p.key).agg(*[F.sum(f"{c}_out").alias(f"_o_{c}") for c in cols])
    wide = stats.join(auto, p.key).join(counts, p.key)
    parts = []
    for c in cols:
        n, z, u, a = (F.col(f"_n_{c}"), F.col(f"_z_{c}"), F.col(f"_u_{c}"), F.col(f"_s_{c}_autocorr"))
        msg = F.when(n <= least, "too few").when(z > 0.9 * n, "zeros").when((u <= 10) | (u < 0.02 * n), "few values").when(F.abs(a) < 0.7, "no persistence").otherwise("tested")
        parts.append(F.struct(F.lit(c).alias("col"), msg.alias("msg"), F.when(msg == "tested", F.col(f"_o_{c}")).otherwise(0).cast("long").alias("nb_out")))
    return wide.select(p.key, F.explode(F.array(*parts)).alias("_x")).select(p.key, "_x.*")


def yoy(df: DataFrame, col: str, how: str = "diff", p: Panel = PANEL) -> DataFrame:
    """Against the last value at or before 52 weeks earlier: ``lag``, ``diff`` (within ±0.5) or ``ratio`` 2(x-l)/(x+l)."""
    past = df.select(p.key, (F.col(p.ts) + F.expr("interval 364 days")).alias(p.ts), number(col).alias(f"{col}_lag1y"), *p.tie)
    out = merge_asof(df, past, p, [f"{col}_lag1y"]).withColumnRenamed(f"{col}_lag1y_masof", f"{col}_lag1y")
    x, y = number(col), F.col(f"{col}_lag1y")
    if how == "diff":
        return out.withColumn(f"{col}_yoy", clip(x - y, -0.5, 0.5))
    if how == "ratio":
        return out.withColumn(f"{col}_yoy_pct", clip(F.when(x + y != 0, 2 * (x - y) / (x + y)), -0.5, 0.5))
    if how == "lag":
        return out
    raise ValueError(f"unknown kind {how!r}")


def yoy_holiday(df: DataFrame, col: str, links: DataFrame, p: Panel = PANEL) -> DataFrame:
    """Difference to the value at the linked date of the year before (``date``, ``date_p1y``), else 364 days earlier.

    Of several links of a date the earliest counts. The join is left to the
    planner, which broadcasts the links if they are as few as a calendar's.
    """
    anchors = df.join(links.groupBy(F.col("date").alias(p.ts)).agg(F.min("date_p1y").alias("date_p1y")), p.ts, "left")
    anchors = anchors.withColumn("_a", F.coalesce("date_p1y", F.date_sub(p.ts, 364)).cast(dict(df.dtypes)[p.ts])).withColumnsRenamed({p.ts: "_now", "_a": p.ts})
    past = df.select(p.key, p.ts, number(col).alias("_past"), *p.tie)
    met = merge_asof(anchors, past, p, ["_past"]).drop(p.ts, "date_p1y").withColumnRenamed("_now", p.ts)
    return met.withColumnRenamed("_past_masof", f"{col}_lag1y").withColumn(f"{col}_yoy", number(col) - F.col(f"{col}_lag1y"))


# --- calendar ----------------------------------------------------------------


def easter(year: int) -> dt.date:
    """Gregorian Easter Sunday (the anonymous computus)."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    l = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * l) // 451
    return dt.date(year, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1)


def nth_weekday(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th such weekday (Monday 0) of a month; the last for n = -1."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    end = (dt.date(year, month, 28) + dt.timedelta(4)).replace(day=1) - dt.timedelta(1)
    return end - dt.timedelta((end.weekday() - weekday) % 7)


def superbowl(year: int) -> dt.date:
    return nth_weekday(year, 2, 6, 1 if year <= 2021 else 2)


def eid_alfitr(year: int) -> dt.date:
    """The first 1 Shawwal of a Gregorian year, by the arithmetic Islamic calendar (leap years 2, 5, 7, 10, 13, 16, 18, 21, 24, 26, 29 of 30)."""
    h = int((year - 622) * 33 / 32) - 1
    while True:
        days = 29 * 9 + 5 + (h - 1) * 354 + (3 + 11 * h) // 30  # nine months of 30 and 29 days in turn, then the first day of the tenth
        day = dt.date(622, 7, 19) + dt.timedelta(days)
        if day.year >= year:
            return day
        h += 1


#: Holiday, its date by year, importance; in the order in which they come before others of the same date.
HOLIDAYS = (
    ("NewYear", lambda y: dt.date(y, 1, 1), "High"),
    ("Christmas", lambda y: dt.date(y, 12, 25), "High"),
    ("LaborDay", lambda y: nth_weekday(y, 9, 0, 1), "Mid"),
    ("JuneTeenth", lambda y: dt.date(y, 6, 19), "Mid"),
    ("Easter", easter, "High"),
    ("Thanksgiving", lambda y: nth_weekday(y, 11, 3, -1), "High"),
    ("MotherDay", lambda y: nth_weekday(y, 5, 6, 2), "Mid"),
    ("MemorialDay", lambda y: nth_weekday(y, 5, 0, -1), "Mid"),
    ("EidAlfitr", eid_alfitr, "Mid"),
    ("Halloween", lambda y: dt.date(y, 10, 31), "Mid"),
    ("ValentinesDay", lambda y: dt.date(y, 2, 14), "Mid"),
    ("SuperBowl", superbowl, "Mid"),
    ("StPatricksDay", lambda y: dt.date(y, 3, 17), "Mid"),
    ("CincoDeMayo", lambda y: dt.date(y, 5, 5), "Mid"),
)
#: Holidays with days around them, and the first and last of these days.
AROUND, OFFSETS = ("Christmas", "Easter", "Thanksgiving"), range(-10, 10)


def event_calendar(spark, first_year: int, last_year: int) -> DataFrame:
    """``date``, ``evtname`` and ``evtimp`` of the holidays of both years and those between, and of the days around three of them.

    One event a date: a holiday comes before a day around one, then the order of the list holds.
    """
    rows: dict[dt.date, tuple] = {}
    for year in range(first_year, last_year + 1):
        for name, day, importance in HOLIDAYS:
            rows.setdefault(day(year), (day(year), name, importance))
    dates = {name: day for name, day, _ in HOLIDAYS}
    for year in range(first_year, last_year + 1):
        for k in OFFSETS:
            for name in AROUND:
                at = dates[name](year) + dt.timedelta(k)
                rows.setdefault(at, (at, f"{name}+{k}", "Mid"))
    return spark.createDataFrame(sorted(rows.values()), "date date, evtname string, evtimp string")


def event_links(calendar: DataFrame) -> DataFrame:
    """Each event (date) with the same event of the year before (date_p1y), and the reverse.

    The reverse of a link, named with ``-R``, is at 52 weeks before the earlier
    date and points to 52 weeks after the later one. Links of the same two dates are one.
    """
    year = F.year("date")
    now, before = calendar.select("date", "evtname", year.alias("y")), calendar.select(F.col("date").alias("date_p1y"), "evtname", (year + 1).alias("y"))
    linked = now.join(before, ["evtname", "y"]).select("date", "date_p1y", "evtname")
    reverse = linked.select(F.date_sub("date_p1y", 364).alias("date"), F.date_add("date", 364).alias("date_p1y"), F.concat("evtname", F.lit("-R")).alias("evtname"))
    both = linked.withColumn("k", F.lit(0)).unionByName(reverse.withColumn("k", F.lit(1)))
    return both.groupBy("date", "date_p1y").agg(F.min(F.struct("k", "evtname"))["evtname"].alias("evtname"))


def event_distances(spark, calendar: DataFrame, first: str, last: str, bound: int = 60) -> DataFrame:
    """Per day and kind (all, High, Mid): days since the last and to the next event (0 or negative), within the bound, and the events' names.

    Null where there is no such event in the calendar.
    """
    spine = spark.sql(f"select explode(sequence(date'{first}', date'{last}')) as date")
    for kind in ("all", "High", "Mid"):
        days = calendar.where(F.lit(kind == "all") | (F.col("evtimp") == kind)).select("date", F.lit(0).alias("_k"), F.col("date").alias("_e"), F.col("evtname").alias("_n"))
        for name, short, forward in (("since_last", "prev", False), ("to_next", "next", True)):
            spine = merge_asof(spine.withColumn("_k", F.lit(0)), days, Panel("date", "_k"), ["_e", "_n"], forward)
            gap = F.datediff("date", "_e_masof")
            held = F.when(gap.isNotNull(), F.least(F.lit(bound), F.greatest(F.lit(-bound), gap)))
            spine = spine.withColumns({f"dist_{name}_{kind}": held, f"evt_{kind}_{short}": F.col("_n_masof")}).drop("_e_masof", "_n_masof", "_k")
    return spine
