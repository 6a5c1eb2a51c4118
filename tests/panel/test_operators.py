"""Small fixed cases: golden values, ties, missing values, order of the input."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import pytest

from panelyst import sources as S
from panelyst.operators import backtest as B, features as X, folds as P, learning as L, relational as J, seasonal as Y
from panelyst.panel import Panel

TIED = Panel(tie=("seq",))
P12 = list(zip(range(12), [1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11], [1, 2] + [1] * 9 + [2], [3.0, 100.0, 5.0, 9.0, 12.0, 5.0, 7.0, 8.0, 13.0, 15.0, 20.0, 110.0], [3.0, 100.0, 5.0, 9.0, 12.0, 5.0, 7.0, 8.0, -13.0, -15.0, -20.0, -110.0]))


@pytest.fixture()
def p12(spark):
    return spark.createDataFrame(P12, "seq long, dtsi long, dscode long, a double, b double")


def column(df, name):
    return [r[0] for r in df.orderBy("seq").select(f"`{name}`").collect()]


def test_zero_padded_correlation(p12):
    got = column(X.corr(p12, [("a", "b")], [10], TIED), "axb_corr10")
    assert got == pytest.approx([1, 1, 1, 1, 1, 1, 1, 1, 0.01705065, -0.41257552, -0.74521172, -0.09560928], abs=1e-6)


def test_ridge_of_equal_series(p12):
    assert column(X.ridge(p12, [("a", "b")], [10], [0.0], TIED), "axb_reg10x0.0_beta")[3] == pytest.approx(1.0)


def test_ffill_cumsum_clip(spark):
    df = spark.createDataFrame([(0, 1, 1, 10.0), (1, 1, 1, float("nan")), (2, 2, 2, 20.0), (3, 3, 1, 15.0), (4, 4, 2, None), (5, 5, 3, -30.0)], "seq long, dtsi long, dscode long, x double")
    assert column(X.ffill(df, ["x"], TIED), "x_ffill") == [10, 10, 20, 15, 20, -30]
    assert column(X.cumsum(df, ["x"], TIED), "x_cumsum") == [10, 10, 20, 25, 20, -30]
    assert column(X.clipped(df, ["x"], high=12.0), "x_clip") == [10, None, 12, 12, None, -30]


def test_rank_of_one_time(spark):
    df = spark.createDataFrame([(i, 1, i, v) for i, v in enumerate([10.0, 20.0, 15.0, 30.0, 25.0])], "seq long, dtsi long, dscode long, x double")
    assert column(X.cs_rank(df, ["x"], TIED), "x_csrank") == [-1, 0, -0.5, 1, 0.5]
    assert column(X.cs_rank(df, ["x"], TIED, kind="down"), "x_csrank") == [5, 3, 4, 1, 2]


def test_ewm_against_pandas_and_order_of_rows(spark):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame({"seq": range(1000), "dtsi": np.sort(rng.integers(0, 300, 1000)), "dscode": rng.integers(0, 10, 1000), "x": rng.normal(size=1000)})
    pdf.loc[::7, "x"] = np.nan
    want = pdf.groupby("dscode")["x"].transform(lambda s: s.ewm(halflife=5, ignore_na=True).mean()).where(pdf["x"].notna())
    for df in (pdf, pdf.sample(frac=1, random_state=1)):
        got = pd.Series(column(X.ewm(spark.createDataFrame(df), ["x"], [5], TIED), "x_ewm5"), dtype=float)
        assert np.allclose(got, want, equal_nan=True)


def test_asof_by_key_with_null_value_and_ties(spark):
    left = spark.createDataFrame([(1, 1), (3, 2), (5, 1), (7, 2), (9, 1)], "dtsi long, dscode long")
    right = spark.createDataFrame([(2, 1, 1.0), (4, 2, 2.0), (6, 1, 3.0), (9, 1, None)], "dtsi long, dscode long, v double")
    got = {r.dtsi: r.v_masof for r in J.merge_asof(left, right, Panel(), ["v"]).collect()}
    assert got == {1: None, 3: None, 5: 1.0, 7: 2.0, 9: None}


def test_time_bars(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(base + dt.timedelta(seconds=s), 1, float(10 + i), i) for i, s in enumerate([0, 30, 60, 90, 120, 130, 140, 150, 210])], "dtsi timestamp, dscode long, x double, seq long")
    got = J.time_bars(df, "x", "1 minute", TIED).orderBy("date").collect()
    assert [r.open for r in got] == [10, 12, 14, 18] and [r.high for r in got] == [11, 13, 17, 18] and [r.close for r in got] == [11, 13, 17, 18] and sum(r.cnt for r in got) == 9


def test_pick_pairs(spark):
    pairs = [(1, 2, 0.1), (1, 3, 0.2), (1, 4, 0.3), (2, 3, 0.4), (2, 4, 0.5), (3, 4, 0.6), (4, 5, 0.7), (5, 6, 0.8)]
    df = spark.createDataFrame([(0, *p) for p in pairs], "dtsi long, dscode1 long, dscode2 long, dist double")
    got = {(r.dscode1, r.dscode2) for r in J.pick_pairs(df, 2).collect()}
    assert len(got) == 5 and {(1, 2), (4, 5)} <= got


def test_point_figure(p12):
    """Boxes 1 50 2 4 6 2 3 4 6 7 10 55: instrument 1 turns down at 5 (to box 2) and up at 8 (to box 6)."""
    out = P.point_figure(p12, "a", 2.0, 3, TIED)
    get = lambda name: column(out, f"a_pfp2.0x3_{name}")
    assert get("dir") == [1, 1, 1, 1, 1, -1, -1, -1, 1, 1, 1, 1]
    assert get("px") == [2, 100, 4, 8, 12, 4, 6, 8, 12, 14, 20, 110]
    assert get("el") == [2, 100, 2, 2, 2, 4, 4, 4, 12, 12, 12, 100]
    assert get("perf") == pytest.approx([0, 0, 1, 3, 5, 0, 0.5, 1, 0, 1 / 6, 4 / 6, 0.1])
    assert get("perf2") == [0, 0, 1, 3, 5, 0, 1, 2, 0, 1, 4, 5]
    assert get("dur") == [0, 0, 1, 2, 3, 0, 1, 2, 0, 1, 2, 9]


def test_point_figure_of_missing_and_zero_prices(spark):
    df = spark.createDataFrame([(i, i, 1, v) for i, v in enumerate([0.0, None, 4.0, 0.0])], "seq long, dtsi long, dscode long, x double")
    out = P.point_figure(df, "x", 1.0, 3, TIED)
    assert column(out, "x_pfp1.0x3_perf") == [0, None, 0, 0] and column(out, "x_pfp1.0x3_dir") == [1, None, 1, -1]


def test_cusum_restarts_and_skips_missing(spark):
    df = spark.createDataFrame([(i, i, 1, v) for i, v in enumerate([3.0, None, 3.0, 3.0, 0.0])], "seq long, dtsi long, dscode long, x double")
    out = P.cusum(df, "x", 0.0, 0.5, 5.0, TIED)
    assert column(out, "x_cusum") == [2.5, None, 5.0, 0.0, 0.0] and column(out, "x_cusum_alarm") == [0, 0, 0, 1, 0]


def test_moving_rank_crosses_blocks(spark):
    n = 9000
    x = np.random.default_rng(3).permutation(n).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"dtsi": pd.to_datetime("2024-01-01") + pd.to_timedelta(np.arange(n), "min"), "dscode": np.arange(n) % 7, "x": x, "seq": np.arange(n)}))
    got = np.array(column(X.moving_rank(df, ["x"], 20, TIED), "x_appops20"), float)
    want = np.full(n, np.nan)
    for i in range(19, n):
        want[i] = 2 * (x[i - 19 : i + 1] < x[i]).sum() / 19 - 1
    assert np.allclose(got, want, equal_nan=True)


def test_svd_of_a_low_rank_panel(spark):
    rng = np.random.default_rng(5)
    m = np.outer(rng.normal(size=40), rng.normal(size=6))
    df = spark.createDataFrame([(t, c, float(m[t, c])) for t in range(40) for c in range(6)], "dtsi long, dscode long, x double")
    out = P.svd_residual(df, "x", 10, 5, 1).collect()
    assert len(out) == 31 * 6 and max(abs(r.x_svdres) for r in out) < 1e-8


def test_hampel_finds_one_jump(spark):
    x = np.cumsum(np.random.default_rng(0).integers(-2, 3, 60)).astype(float)
    x[30] += 1000
    df = spark.createDataFrame([(i, i, 1, float(v)) for i, v in enumerate(x)], "seq long, dtsi long, dscode long, x double")
    out = Y.hampel(df, ["x"], 10, 6.0, TIED)
    assert [i for i, hit in enumerate(column(out, "x_out")) if hit] == [30]


def test_calendar(spark):
    assert Y.easter(2024) == dt.date(2024, 3, 31) and Y.easter(2025) == dt.date(2025, 4, 20)
    assert Y.eid_alfitr(2024) == dt.date(2024, 4, 10) and Y.eid_alfitr(2000) == dt.date(2000, 1, 8)
    rows = {r.date: (r.evtname, r.evtimp) for r in Y.event_calendar(spark, 2010, 2025).collect()}
    on = lambda name: {d.isoformat() for d, v in rows.items() if v[0] == name}
    assert {"2019-02-03", "2020-02-02", "2021-02-07", "2022-02-13", "2023-02-12", "2024-02-11", "2025-02-09"} <= on("SuperBowl")
    assert {"2021-04-04", "2022-04-17", "2023-04-09", "2024-03-31", "2025-04-20"} <= on("Easter")
    assert {"2021-11-25", "2023-11-30", "2024-11-28", "2025-11-27"} <= on("Thanksgiving")
    assert rows[dt.date(2024, 6, 19)] == ("JuneTeenth", "Mid") and rows[dt.date(2024, 3, 17)] == ("StPatricksDay", "Mid") and rows[dt.date(2023, 5, 5)] == ("CincoDeMayo", "Mid")
    assert rows[dt.date(2024, 12, 15)] == ("Christmas+-10", "Mid") and rows[dt.date(2024, 4, 9)] == ("Easter+9", "Mid") and dt.date(2025, 1, 4) not in rows
    assert {v[1] for v in rows.values()} == {"High", "Mid"} and len(on("EidAlfitr")) >= 10


def test_event_distances(spark):
    days = {r.date: r for r in Y.event_distances(spark, Y.event_calendar(spark, 2024, 2025), "2024-01-01", "2025-01-01").collect()}
    assert len(days) == 367
    assert days[dt.date(2024, 4, 6)].dist_since_last_High == 6 and days[dt.date(2024, 3, 25)].dist_to_next_High == -6
    assert days[dt.date(2024, 3, 31)].dist_to_next_all == 0 and days[dt.date(2024, 3, 31)].evt_all_next == "Easter"
    assert days[dt.date(2024, 8, 1)].dist_since_last_High == 60 and days[dt.date(2024, 1, 1)].dist_since_last_Mid is None
    assert days[dt.date(2024, 4, 2)].evt_Mid_prev == "Easter+2"


def test_links_and_their_reverse(spark):
    links = {(r.date, r.date_p1y): r.evtname for r in Y.event_links(Y.event_calendar(spark, 2023, 2026)).collect()}
    assert links[dt.date(2025, 4, 20), dt.date(2024, 3, 31)] == "Easter"
    assert links[dt.date(2023, 4, 2), dt.date(2026, 4, 19)] == "Easter-R"  # 52 weeks before the earlier date, 52 weeks after the later


def test_yoy_with_moved_easter(spark):
    rows = [(dt.date(2024, 3, 31), "A", 100.0), (dt.date(2024, 4, 21), "A", 110.0), (dt.date(2025, 4, 20), "A", 90.0)]
    df = spark.createDataFrame(rows, "date date, k string, x double")
    out = {r.date: r.x_yoy for r in Y.yoy_holiday(df, "x", Y.event_links(Y.event_calendar(spark, 2023, 2026)), Panel("date", "k")).collect()}
    assert out[dt.date(2025, 4, 20)] == -10


def walk(spark, x, codes=3):
    n = len(x)
    return spark.createDataFrame(pd.DataFrame({"dtsi": pd.to_datetime("2024-01-01") + pd.to_timedelta(np.arange(n), "h"), "dscode": np.arange(n) % codes, "x": x, "seq": np.arange(n)}))


@pytest.mark.parametrize("outlier", [None, 1e12])
def test_quantiles_of_the_stream_so_far(spark, outlier):
    """Exact, and nothing of a later row has a part in it: the outlier stands near the end."""
    x = np.random.default_rng(4).lognormal(sigma=2, size=900).round(2)
    x[::11] = 5.0
    x[5] = np.nan
    if outlier:
        x[880] = outlier
    out = X.quantile_global(walk(spark, x), ["x"], [0.05, 0.95], TIED, 100, 50)
    low, high = column(out, "x_qtl0.05"), column(out, "x_qtl0.95")
    for i in range(len(x)):
        b = (i + 1) // 100
        want = np.nanquantile(x[: 100 * b], [0.05, 0.95]) if b else (None, None)
        assert (low[i], high[i]) == (None, None) if not b else np.allclose((low[i], high[i]), want)


def test_buckets_so_far(spark):
    rng = np.random.default_rng(8)
    x, period = rng.normal(size=400), 50
    df = walk(spark, x).withColumn("y", F.when(F.col("seq") % 7 != 0, F.col("x") * 2 + 1))
    out = X.bucket_response(df, "x", "y", 4, TIED, period, 64).orderBy("seq").collect()
    sums = [[] for _ in range(4)]
    for i, r in enumerate(out):
        if i % 7 == 0:
            assert r.x_y_bucketxy_mean is None
            continue
        b = (i + 1) // period
        if b:
            edges = np.quantile(x[: b * period], [0.2, 0.4, 0.6])
            sums[int((x[i] >= edges).sum())].append(2 * x[i] + 1)
        for j in range(4):
            assert (r.x_y_bucketxy_mean[j] is None) == (not sums[j])
            if sums[j]:
                assert r.x_y_bucketxy_mean[j] == pytest.approx(np.mean(sums[j])) and r.x_y_bucketxy_std[j] == pytest.approx(np.var(sums[j]) / len(sums[j]) ** 0.5, abs=1e-9)


def test_holt_winters_follows_a_season(spark):
    """What is left over is the noise, after the first fifth."""
    rng, n = np.random.default_rng(42), 1000
    t, noise = np.arange(n), rng.normal(scale=2.0, size=n)
    df = walk(spark, 100 + 5 * np.cos(2 * np.pi * t / 10) + 0.1 * t + noise, 1).withColumn("dtsi", F.col("dtsi").cast("date") + F.col("seq").cast("int") - F.floor(F.col("seq") / 24).cast("int"))
    got = np.array(column(P.holt_winters(df, "x", [(100, 100, 20, 10)], TIED), "x_100x100x20x10_1"))
    x = np.array(column(df, "x"))
    assert np.corrcoef((x - got)[200:], noise[200:])[0, 1] > 0.6


def test_splits_move_forward():
    parts = L.splits(0, 29, 1, 10, 3, 1, 5)
    assert all(s["train_start"] <= s["train_end"] < s["test_start"] <= s["test_end"] for s in parts)
    assert [s["train_end"] for s in parts] == sorted({s["train_end"] for s in parts})


def test_calendar_splits():
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(40)]
    parts = L.calendar_splits(days, 10, 15, 20, 1)
    assert [(s["train_end"] - days[0]).days for s in parts] == [15, 25, 35] and [(s["train_start"] - days[0]).days for s in parts] == [0, 5, 15]
    assert [(s["test_start"] - days[0]).days for s in parts] == [16, 26, 36] and parts[0]["test_end"] == days[25] and parts[-1]["test_end"] == dt.date(2024, 4, 19)
    assert L.calendar_splits(days[:10], 10, 15) == [{"train_start": days[0], "train_end": days[7], "test_start": days[8], "test_end": days[9]}] and L.calendar_splits([]) == []


def test_selection_turns_a_signal_around(spark):
    rng, rows, before = np.random.default_rng(1), [], {}
    for t in range(600):
        for c in range(4):
            ret = before.get(c, 0.0) * (1 if t <= 300 else -1) + 0.1 * rng.normal()  # the signal of the row before
            before[c] = rng.normal()
            rows.append((dt.datetime(2024, 1, 1) + dt.timedelta(days=t), c, before[c], ret, 1.0))
    df = spark.createDataFrame(rows, "dtsi timestamp, dscode long, sigf_1 double, sret double, wgt double")
    out = B.select_best(df, ["sigf_1"], "sret", 10, rules={"drawdown": 1e9}).toPandas().sort_values(["dtsi", "dscode"])
    sign = np.sign(out["sig_kbest"] * out["sigf_1"]).to_numpy().reshape(600, 4)
    assert (sign[:100] == 0).all() and (sign[150:300] == 1).all() and (sign[500:] == -1).all()
    strict = B.select_best(df, ["sigf_1"], "sret", 10, rules={"holding": 0.0})
    assert strict.where("sig_kbest <> 0").count() == 0


def test_ingest_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0), ("B", dt.date(2024, 1, 2), 2.0)], "dscode string, dt date, x double")
    path = str(tmp_path / "t")
    for _ in range(2):
        assert S.ingest(df, path, ["dscode", "dt"], "dt").count() == 2


def test_exchange_csv_and_symbols(spark, tmp_path):
    (tmp_path / "k.csv").write_text("1704067200000,1,2,0.5,1.5,10,1704067259999,15,3,5,7,0\n")
    r = S.exchange_csv(spark, str(tmp_path / "k.csv"), "klines", header=False).first()
    assert r.close == 1.5 and r.open_time == dt.datetime(2024, 1, 1)
    parts = S.split_symbol(F.col("s"))
    got = spark.createDataFrame([("BTCUSDT",), ("BTCUPUSDT",), ("ETHBTC",), ("1000CATFDUSD",), ("XRPUSD",), ("ADABEARBUSD",), ("FOO",)], "s string").select(*parts).collect()
    assert [tuple(r) for r in got] == [("USDT", "BTC", "", 1), ("USDT", "BTC", "UP", 12), ("BTC", "ETH", "", 2), ("FDUSD", "1000CAT", "", 8), ("USD", "XRP", "", 9), ("BUSD", "ADA", "BEAR", 12), (None, None, None, None)]


def test_universe_listing(spark, tmp_path):
    names = ["data/spot/monthly/klines/1000CATBNB/", "data/futures/um/monthly/klines/XRPUSDT_250328/", "data/futures/cm/monthly/klines/BTCUSD_PERP/"]
    (tmp_path / "l.xml").write_text("<ListBucketResult>" + "".join(f"<CommonPrefixes><Prefix>{n}</Prefix></CommonPrefixes>" for n in names) + "</ListBucketResult>")
    rows = {r.kind: r for r in S.universe_xml(spark, str(tmp_path / "l.xml")).collect()}
    assert (rows["spot"].base, rows["spot"].ticker, rows["spot"].orderid) == ("BNB", "1000CAT", 5)
    assert (rows["future_um"].sym, rows["future_um"].base, rows["future_um"].sym_original) == ("XRPUSDT", "USDT", "XRPUSDT_250328")
    assert (rows["future_cm"].sym, rows["future_cm"].base, rows["future_cm"].orderid) == ("BTCUSD_PERP", None, 100)


def test_assets_shards_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"assetCode": "A", "assetName": "Aa", "createTime": 0, "tags": ["x", "y"]}]')
    assert S.assets_json(spark, str(tmp_path / "a.json")).first().tags == "x,y"
    df = spark.createDataFrame([(dt.date(1970, 1, 1) + dt.timedelta(i), float(i), float(-i), 1.0) for i in range(30)], "d date, sigf_a double, forward_fh1 double, forward_fh2 double")
    S.shards(df, "d", 10).write.partitionBy("shard").parquet(str(tmp_path / "s"))
    got = S.read_shards(spark, str(tmp_path / "s"), 1, 2, "forward_fh1")
    assert got.count() == 10 and "forward_fh2" not in got.columns and "forward_fh1" in got.columns
    for _ in range(2):
        S.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 30


def test_missing_columns_are_named():
    class Frame:
        columns = ["dtsi"]

    with pytest.raises(ValueError, match="dscode"):
        Panel().check(Frame())


def test_empty_panel(spark, p12):
    none = p12.limit(0)
    for out in (X.ewm(none, ["a"], [5], TIED), X.cs_zscore(none, ["a"], TIED), P.cusum(none, "a", 0.0, p=TIED), X.moving_rank(none.withColumn("dtsi", F.timestamp_micros("dtsi")), ["a"], 5, TIED)):
        assert out.count() == 0
    assert math.isnan(float("nan"))


def test_moments_of_long_instruments_go_on_over_batches(spark):
    rng = np.random.default_rng(5)
    seen = [(i, i, int(rng.integers(3)) if i % 7 else None, None if i % 11 == 0 else float(rng.normal(50, 9))) for i in range(1500)]
    df = spark.createDataFrame(seen, "seq long, dtsi long, dscode long, x double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out = X.ewm_kurt(X.ewm_skew(df, ["x"], [5, 300], TIED), ["x"], [5, 0], TIED)
        assert out.columns == ["seq", "dtsi", "dscode", "x", "x_ewmskew5", "x_ewmskew300", "x_ewmkurt5", "x_ewmkurt0"]
        found = {r["seq"]: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(found) == len(seen)
    for h, name, n in ((5, "x_ewmskew5", 3), (300, "x_ewmskew300", 3), (5, "x_ewmkurt5", 4), (0, "x_ewmkurt0", 4)):
        a, state = (1 - 0.5 ** (1 / h) if h else 0.0), {}
        for seq, _, key, x in seen:
            if x is None:
                assert found[seq][name] is None
                continue
            r = state[key] = [(1 - a) * m + a * x**i if key in state else x**i for i, m in enumerate(state.get(key, [0] * n), 1)]
            v = r[1] - r[0] ** 2
            if n == 3:
                want = (r[2] - 3 * r[1] * r[0] + 2 * r[0] ** 3) / v**1.5 if v > 1e-6 else 0.0
            else:
                want = (r[3] - 4 * r[2] * r[0] + 6 * r[1] * r[0] ** 2 - 3 * r[0] ** 4) / v**2 - 3 if v > 1e-6 else 0.0
            assert v < 1 or found[seq][name] == pytest.approx(want, abs=1e-5)
