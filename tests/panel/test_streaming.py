"""Streams against the same rows as one batch."""

import pyspark.sql.functions as F

from panelyst import streaming as ST
from panelyst.operators import features as X, relational as J
from panelyst.panel import Panel

DATA = "/root/testdata/sf0.001"
EV = Panel("ts", "user_id", ("event_id",))


def feed(spark, tmp_path, parts=3):
    """Events in time order, as files that a stream takes one at a time."""
    ev = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    bounds = [r[0] for r in ev.selectExpr(f"explode(percentile(unix_micros(ts), array({', '.join(str(i / parts) for i in range(1, parts))})))").collect()]
    for i in range(parts):
        cond = F.lit(True)
        micros = F.unix_micros("ts")
        cond = cond & (micros >= bounds[i - 1]) if i else cond
        cond = cond & (micros < bounds[i]) if i < parts - 1 else cond
        ev.where(cond).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return ev, spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(stream, tmp_path, mode, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_ewm_goes_on_over_batches(spark, tmp_path):
    ev, stream = feed(spark, tmp_path)
    got = run(ST.ewm(stream, "value", 5, EV), tmp_path, "append", "ewm_stream")
    want = X.ewm(ev, ["value"], [5], EV)
    diff = got.select("event_id", F.col("value_ewm5").alias("a")).join(want.select("event_id", F.col("value_ewm5").alias("b")), "event_id")
    assert diff.count() == ev.count() and diff.where(F.abs(F.col("a") - F.col("b")) > 1e-9).count() == 0


def test_closed_bars_are_those_of_the_batch(spark, tmp_path):
    ev, stream = feed(spark, tmp_path)
    got = {(r.date, r.user_id): tuple(r)[2:] for r in run(ST.time_bars(stream, "value", "1 day", "1 hour", EV), tmp_path, "append", "bar_stream").collect()}
    want = {(r.date, r.user_id): (r.open, r.high, r.low, r.close, r.cnt) for r in J.time_bars(ev, "value", "1 day", EV).collect()}
    assert len(got) > 0.9 * len(want) and all(want[k] == v for k, v in got.items())


def test_asof_per_batch(spark, tmp_path):
    ev, stream = feed(spark, tmp_path)
    right = spark.read.parquet(f"{DATA}/events.parquet").where("event_type = 'purchase'").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))
    sink = ST.asof_sink(lambda: right, ["price"], Panel("ts", "user_id"), str(tmp_path / "out"))
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("event_id", "price_masof")
    want = J.merge_asof(ev, right, Panel("ts", "user_id"), ["price"]).select("event_id", "price_masof")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()
