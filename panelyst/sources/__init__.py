"""Sources and sinks: declared schemas, pruned scans, idempotent ingestion."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W

#: Column lists of the exchange files.
SCHEMAS = {
    "klines": "open_time long, open double, high double, low double, close double, volume double, close_time long, quote_volume double, count int, taker_buy_volume double, taker_buy_quote_volume double, ignore int",
    "trades": "id long, price double, qty double, quote_qty double, time long, is_buyer_maker boolean",
    "aggTrades": "agg_trade_id long, price double, quantity double, first_trade_id long, last_trade_id long, transact_time long, is_buyer_maker boolean",
    "bookTicker": "update_id long, best_bid_price double, best_bid_qty double, best_ask_price double, best_ask_qty double, transaction_time long, event_time long",
    "bookDepth": "timestamp timestamp, percentage double, depth double, notional double",
}
_MILLIS = {"open_time", "close_time", "time", "transact_time", "transaction_time", "event_time"}


def exchange_csv(spark: SparkSession, path: str, kind: str, header: bool = True) -> DataFrame:
    """Files of one kind with their declared schema; milliseconds become timestamps."""
    df = spark.read.csv(path, schema=SCHEMAS[kind], header=header)
    return df.withColumns({c: F.timestamp_millis(c) for c in df.columns if c in _MILLIS})


def ingest(new: DataFrame, path: str, keys: list[str], partition: str) -> DataFrame:
    """Append the rows whose keys the table at ``path`` lacks, partitioned; running it again adds nothing."""
    spark = new.sparkSession
    try:
        known = spark.read.parquet(path).select(*keys).distinct()
        new = new.join(known, keys, "left_anti")
    except Exception as e:  # only a missing table is an empty one
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").partitionBy(partition).parquet(path)
    return spark.read.parquet(path)


def existing_rows(table: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows per instrument and day, what an ingestion checks for."""
    return table.groupBy(key, F.to_date(ts).alias("dt")).agg(F.count(ts).alias("n"))


def scan(table: DataFrame, ts: str, key: str, columns: list[str], start: str, end: str, keys: list[str] | None = None, without: str | None = None) -> DataFrame:
    """Columns of [start, end); the range is on the time itself, so that it reaches the files' statistics."""
    kind = dict(table.dtypes)[ts]
    out = table.where((F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) < F.lit(end).cast(kind)))
    if keys is not None:
        out = out.where(F.col(key).isin(keys))
    if without is not None:
        out = out.where(~F.col(key).cast("string").rlike(without))
    return out.select(*columns)


def codes(df: DataFrame, name: str, out: str = "dscode") -> DataFrame:
    """Dense numbers from 0 in sort order of the names; the names are a dimension table."""
    names = df.select(name).distinct().withColumn(out, (F.row_number().over(W.orderBy(name)) - 1).cast("long"))
    return df.join(names, name)


#: Quote currencies in the order in which they are tried, marks of leveraged tokens, and sort ids.
QUOTES = ("FDUSD", "BUSD", "USDT", "USDC", "TUSD", "USD", "BNB", "ETH", "BTC", "BIDR", "PAX", "BRL", "EUR", "RUB", "TRY", "AUD", "GBP", "XRP", "NGN", "TRX")
LEVERAGED = ("UP", "DOWN", "BULL", "BEAR")
SORT_IDS = {"USDT": 1, "BTC": 2, "ETH": 3, "BUSD": 4, "BNB": 5, "USDC": 6, "TUSD": 7, "FDUSD": 8, "USD": 9}
OTHER_ID, LEVERAGED_ID = 10, 12


def split_symbol(symbol: Column) -> tuple[Column, Column, Column, Column]:
    """The quote currency, the ticker, the mark of a leveraged token (else empty) and the sort id of a symbol.

    The first quote currency that ends the symbol counts, with a mark before it
    if there is one. The ticker is the symbol without mark and quote, wherever
    they stand in it. All four are null for a symbol of no known quote.
    """
    quote, mark = F.lit(None).cast("string"), F.lit(None).cast("string")
    for q in reversed(QUOTES):
        marked = F.lit("")
        for m in reversed(LEVERAGED):
            marked = F.when(symbol.endswith(m + q), F.lit(m)).otherwise(marked)
        quote, mark = F.when(symbol.endswith(q), F.lit(q)).otherwise(quote), F.when(symbol.endswith(q), marked).otherwise(mark)
    sort_id = F.lit(OTHER_ID)
    for q, i in SORT_IDS.items():
        sort_id = F.when(quote == q, F.lit(i)).otherwise(sort_id)
    sort_id = F.when(quote.isNotNull(), F.when(mark != "", F.lit(LEVERAGED_ID)).otherwise(sort_id))
    return quote, F.replace(symbol, F.concat(mark, quote), F.lit("")), mark, sort_id


#: The folder of each kind in the listings.
KINDS = {"spot": "data/spot/monthly/klines/", "future_um": "data/futures/um/monthly/klines/", "future_cm": "data/futures/cm/monthly/klines/"}
#: Sort id of symbols that have no known quote.
UNKNOWN_ID = 100


def universe(listing: DataFrame) -> DataFrame:
    """Listed folders (``Prefix``) as instruments: kind, symbol without the marks of perpetual and dated contracts, its parts and sort id."""
    name, kind = F.regexp_replace("Prefix", "/$", ""), F.lit(None).cast("string")
    for k, folder in KINDS.items():
        kind = F.when(F.col("Prefix").startswith(folder), F.lit(k)).otherwise(kind)
        name = F.replace(name, F.lit(folder), F.lit(""))
    out = listing.select("Prefix", kind.alias("kind"), name.alias("sym_original"))
    dated = F.regexp_extract("sym_original", r"^(.*)_\d{6}", 1)
    out = out.withColumn("sym", F.when(F.col("sym_original").rlike(r"_\d{6}"), dated).otherwise(F.col("sym_original")))
    base, ticker, mark, sort_id = split_symbol(F.col("sym"))
    return out.select("*", base.alias("base"), ticker.alias("ticker"), mark.alias("isupdown"), F.coalesce(sort_id, F.lit(UNKNOWN_ID)).alias("orderid"))


def universe_xml(spark: SparkSession, path: str, row_tag: str = "CommonPrefixes") -> DataFrame:
    """Instruments of listing files."""
    return universe(spark.read.format("xml").option("rowTag", row_tag).schema("Prefix string").load(path))


def assets_json(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.json(path, multiLine=True, schema="assetCode string, assetName string, createTime long, tags array<string>")
    return df.select("assetCode", "assetName", F.timestamp_millis("createTime").alias("created"), F.array_join("tags", ",").alias("tags"))


def failing_range(log: DataFrame) -> DataFrame:
    """Per token of a query log: first and last success, and the nearest failures around them."""
    ok = log.groupBy("token").agg(F.min(F.when(F.col("success"), F.col("query_date"))).alias("first_ok"), F.max(F.when(F.col("success"), F.col("query_date"))).alias("last_ok"))
    bad = log.where(~F.col("success")).join(ok, "token")
    around = bad.groupBy("token").agg(F.max(F.when(F.col("query_date") < F.col("first_ok"), F.col("query_date"))).alias("fails_until"), F.min(F.when(F.col("query_date") > F.col("last_ok"), F.col("query_date"))).alias("fails_from"))
    return ok.join(around, "token", "left")


def write_columns(df: DataFrame, path: str, keys: list[str], prefixes: tuple[str, ...]) -> None:
    """Keys and the columns of the naming convention, as parquet."""
    df.select(*keys, *[c for c in df.columns if c.startswith(prefixes) and c not in keys]).write.mode("overwrite").parquet(path)


def should_query(ranges: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (token, query_date) that are not known to fail: not before the last failure ahead of the successes, nor after the first one behind them."""
    out = wanted.join(ranges.select("token", "fails_until", "fails_from"), "token", "left")
    known = F.coalesce(F.col("query_date") < F.col("fails_until"), F.lit(False)) | F.coalesce(F.col("query_date") > F.col("fails_from"), F.lit(False))
    return out.where(~known).select(*wanted.columns)


def write_csv(df: DataFrame, path: str) -> None:
    """As CSV files with a header; an earlier result is replaced, so that a repeated run leaves one."""
    df.write.mode("overwrite").option("header", True).csv(path)


def name_hash(text: Column) -> Column:
    """SHA-256 of a text in lowercase hex, to name models by what they were made from."""
    return F.sha2(text.cast("string"), 256)


#: Characters of a name that file names don't take, and what stands for each.
_UNSAFE, _SAFE = " /:(),", "______"


def file_name(text: Column) -> Column:
    """A name as a file name."""
    return F.translate(text, _UNSAFE, _SAFE)


def shards(df: DataFrame, ts: str, days: int) -> DataFrame:
    """Add ``shard``, the number of the block of days, to partition training data by."""
    return df.withColumn("shard", F.floor(F.datediff(ts, F.lit("1970-01-01").cast("date")) / days).cast("int"))


def read_shards(spark: SparkSession, path: str, first: int, last: int, target: str) -> DataFrame:
    """Shards of [first, last) by partition pruning; looking-ahead columns but the target are left out."""
    df = spark.read.parquet(path).where((F.col("shard") >= first) & (F.col("shard") < last))
    return df.select(*[c for c in df.columns if c == target or not c.startswith("forward_")])
