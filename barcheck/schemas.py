"""Relations of the library, as Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T

DAILY_BARS = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])

MINUTE_BARS = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])

PROVIDER_BARS = T.StructType([
    T.StructField("v", T.DoubleType()),
    T.StructField("vw", T.DoubleType()),
    T.StructField("o", T.DoubleType()),
    T.StructField("c", T.DoubleType()),
    T.StructField("h", T.DoubleType()),
    T.StructField("l", T.DoubleType()),
    T.StructField("t", T.LongType()),
    T.StructField("n", T.IntegerType()),
    T.StructField("ticker", T.StringType()),
])

SPLITS = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("execution_date", T.DateType()),
    T.StructField("split_from", T.DoubleType()),
    T.StructField("split_to", T.DoubleType()),
])

PROVENANCE = T.StructType([
    T.StructField("provider", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("tickers", T.ArrayType(T.StringType())),
    T.StructField("retrieved_at_utc", T.StringType()),
    T.StructField("splits", T.ArrayType(T.StructType([
        T.StructField("ticker", T.StringType()),
        T.StructField("execution_date", T.StringType()),
        T.StructField("split_from", T.DoubleType()),
        T.StructField("split_to", T.DoubleType()),
        T.StructField("adjustment_type", T.StringType()),
    ]))),
])

SECURITY_MASTER = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("list_date", T.DateType()),
    T.StructField("delist_date", T.DateType()),
    T.StructField("delist_return", T.DoubleType()),
])

NEWS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("published_utc", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("publisher_name", T.StringType()),
    T.StructField("tickers", T.StringType()),
])

FILINGS = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("period_end", T.DateType()),
    T.StructField("available_ts", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
])

GAP = T.StructType([
    T.StructField("dataset_id", T.StringType()),
    T.StructField("check", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("start", T.StringType()),
    T.StructField("end", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("resolution", T.StringType()),
    T.StructField("excluded_from", T.ArrayType(T.StringType())),
    T.StructField("gap_id", T.StringType()),
])

FINDING = T.StructType([
    T.StructField("check", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("n", T.LongType()),
])

EVENTS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("ts_text", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("prev_hash", T.StringType()),
    T.StructField("hash", T.StringType()),
])

PANEL = T.StructType([
    T.StructField("t", T.IntegerType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
    T.StructField("spread_bps", T.DoubleType()),
    T.StructField("alive", T.BooleanType()),
    T.StructField("excluded", T.BooleanType()),
])
