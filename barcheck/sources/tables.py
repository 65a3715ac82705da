"""Adapters from the star-schema tables to the relations of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.shape import dense_index
from ..session import cut_lineage


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _price() -> Column:
    return F.col("l_extendedprice") / F.col("l_quantity")


def line_prices(spark: SparkSession, folder: str, flat_step: float | None = None) -> DataFrame:
    """One trade-like row per line item: ticker (brand), date, price, size and a full-row order key.

    ``flat_step`` coarsens prices so that unchanged bars occur (used by the staleness checks).
    """
    li = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"
    )
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    price = _price() if flat_step is None else F.floor(_price() / F.lit(flat_step)).cast("double")
    rank = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.join(part, "l_partkey").select(
        F.col("p_brand").alias("ticker"),
        F.to_date("l_shipdate").alias("date"),
        price.alias("price"),
        F.col("l_quantity").alias("size"),
        rank.alias("ord"),
    )


def daily_bars(spark: SparkSession, folder: str, flat_step: float | None = None) -> DataFrame:
    """Daily bars; open and close are the first and last price in full-row order. One hash aggregation, no window."""
    x = line_prices(spark, folder, flat_step)
    return x.groupBy("ticker", "date").agg(
        F.min_by("price", "ord").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "ord").alias("close"),
        F.sum("size").alias("volume"),
    )


def staged_daily_bars(spark: SparkSession, folder: str, flat_step: float | None = None) -> DataFrame:
    """Daily bars as the table they are in practice: built from the lines once, however many checks read them."""
    return cut_lineage(daily_bars(spark, folder, flat_step))


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Events as trades: ticker = event type, price = value, size 1, instants in UTC."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "event_id"
    )


def minute_bars(spark: SparkSession, folder: str) -> DataFrame:
    x = ticks(spark, folder).withColumn("minute", F.date_trunc("minute", "ts")).withColumn("ord", F.struct("ts", "event_id"))
    return x.groupBy("ticker", "minute").agg(
        F.min_by("price", "ord").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "ord").alias("close"),
        F.count("*").cast("double").alias("volume"),
    ).withColumnRenamed("minute", "ts")


def raw_minutes(spark: SparkSession, folder: str) -> DataFrame:
    """Un-aggregated events placed on whole minutes (every 13th keeps its seconds): duplicates and misalignment occur."""
    minute = F.date_trunc("minute", "ts")
    return ticks(spark, folder).select(
        "ticker",
        F.when(F.col("event_id") % 13 == 0, F.date_trunc("second", "ts")).otherwise(minute).alias("ts"),
        F.col("price").alias("open"),
        F.col("price").alias("high"),
        F.col("price").alias("low"),
        F.col("price").alias("close"),
        F.lit(1.0).alias("volume"),
    )


def news(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as articles; the event with the same id gives the publication instant."""
    d = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    e = table(spark, folder, "events").select(
        F.col("event_id").alias("doc_id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("iso")
    )
    stamp = (
        F.when(F.col("doc_id") % 17 == 0, F.lit(None).cast("string"))
        .when(F.col("doc_id") % 29 == 0, F.lit("garbage"))
        .when(F.col("doc_id") % 11 == 0, F.col("iso"))
        .otherwise(F.concat(F.col("iso"), F.lit("Z")))
    )
    return d.join(e, "doc_id").select(
        F.concat(F.lit("a"), (F.col("doc_id") - F.when(F.col("doc_id") % 23 == 1, F.lit(1)).otherwise(F.lit(0))).cast("string")).alias("id"),
        stamp.alias("published_utc"),
        F.col("text").alias("title"),
        F.col("source").alias("publisher_name"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("[]")).otherwise(F.concat(F.lit('["'), F.upper("lang"), F.lit('"]'))).alias("tickers"),
    )


def security_master(spark: SparkSession, folder: str) -> DataFrame:
    """First and last shipment of each brand, moved so that every listing defect occurs somewhere."""
    x = line_prices(spark, folder).groupBy("ticker").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    k = F.regexp_extract("ticker", r"(\d+)", 1).cast("int") % 5
    return x.select(
        "ticker",
        F.when(k == 0, F.date_sub("lo", 40)).when(k == 1, F.date_add("lo", 10)).when(k == 2, F.date_sub("lo", 12)).otherwise(F.col("lo")).alias("list_date"),
        F.when(k == 2, F.date_add("hi", 30)).when(k == 3, F.date_sub("hi", 20)).when(k == 4, F.col("hi")).alias("delist_date"),
        F.when(k == 4, F.lit(-0.3)).cast("double").alias("delist_return"),
    )


def splits(spark: SparkSession, folder: str) -> DataFrame:
    """One split per brand and year at its first bar, plus one long after the data ends for every fifth brand."""
    x = line_prices(spark, folder).groupBy("ticker", F.year("date").alias("y")).agg(F.min("date").alias("execution_date"))
    k = F.regexp_extract("ticker", r"(\d+)", 1).cast("int")
    return x.select(
        "ticker",
        F.when((k % 5 == 0) & (F.col("y") % 2 == 0), F.add_months("execution_date", 240)).otherwise(F.col("execution_date")).alias("execution_date"),
        F.lit(1.0).alias("split_from"),
        (2 + F.col("y") % 3).cast("double").alias("split_to"),
    )


def filings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("ticker"),
        F.col("o_orderpriority").alias("field"),
        F.col("o_orderdate").cast("timestamp").alias("available_ts"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderkey").alias("filing_id"),
    )


def variant_returns(spark: SparkSession, folder: str) -> DataFrame:
    """Dense returns (strategy_id, t, r): one variant per order priority and status, one bar per order date.

    r is the summed deviation of order totals from their mean, in cents over 1e10: integers until the last division, so
    both engines give the same doubles. No orders means an empty sum, which is exactly 0.
    """
    o = table(spark, folder, "orders").select(
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("strategy_id"),
        F.to_date("o_orderdate").alias("date"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )
    mean = o.agg(F.expr("sum(cents) div count(*)").alias("m"))
    per = o.groupBy("strategy_id", "date").agg(F.sum("cents").alias("s"), F.count("*").alias("k"))
    idx = dense_index(o, "date", "pos", F.trunc("date", "month"))
    long = per.join(idx, "date").select("strategy_id", "pos", ((F.col("s") - F.col("k") * mean.scalar()) / F.lit(1e10)).alias("v"))
    last = idx.agg(F.max("pos")).scalar()
    grid = per.select("strategy_id").distinct().select("strategy_id", F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    full = grid.join(long, ["strategy_id", "pos"], "left")
    return full.select("strategy_id", F.col("pos").alias("t"), F.coalesce("v", F.lit(0.0)).alias("r"))


def market_returns(variants: DataFrame) -> DataFrame:
    """Benchmark (t, b): the mean of all variants on the bar."""
    return variants.groupBy("t").agg((F.sum(F.round(F.col("r") * F.lit(1e10)).cast("long")) / F.lit(1.5e11)).alias("b"))


def experiment_events(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as experiment-log events; each date with a key divisible by 97 also marks its customer's data as seen."""
    o = table(spark, folder, "orders")
    kind = (
        F.when(F.col("o_orderkey") % 97 == 0, F.lit("CONTAMINATION"))
        .when(F.col("o_orderkey") % 5 == 0, F.lit("PREREG"))
        .when(F.col("o_orderkey") % 53 == 1, F.lit("FINAL_TEST"))
        .when(F.col("o_orderkey") % 211 == 2, F.lit("UNLISTED_KIND"))
        .otherwise(F.lit("EXPERIMENT"))
    )
    cust = F.col("o_custkey").cast("string")
    payload = F.concat(
        F.lit('{"dataset_id":"d'), (F.col("o_custkey") % 20).cast("string"),
        F.lit('","dataset_ids":["d'), (F.col("o_custkey") % 20).cast("string"),
        F.lit('","d'), (F.col("o_orderkey") % 7).cast("string"),
        F.lit('"],"family":"'), F.col("o_orderpriority"),
        F.lit('","hyp_id":"h'), cust,
        F.lit('","params":{"status":"'), F.col("o_orderstatus"),
        F.lit('"},"version":'), (F.col("o_orderkey") % 3).cast("string"), F.lit("}"),
    )
    return o.select(
        F.col("o_orderkey").alias("seq"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("ts_text"),
        kind.alias("kind"),
        payload.alias("payload"),
        F.concat(F.lit("h"), cust).alias("chain"),
    )


def signal_times(spark: SparkSession, folder: str) -> DataFrame:
    """Life-cycle instants of signals derived from events; every 19th signal precedes its publication."""
    e = table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    sec = F.unix_seconds(F.date_trunc("second", "ts"))
    at = F.timestamp_seconds
    return e.select(
        "event_id",
        F.col("event_type").alias("ticker"),
        at(sec).alias("event_ts"),
        at(sec + F.col("user_id") % 50).alias("publication_ts"),
        at(sec + 60 - F.when(F.col("event_id") % 31 == 0, F.lit(40)).otherwise(F.lit(0))).alias("system_receipt_ts"),
        at(sec + F.when(F.col("event_id") % 19 == 0, F.lit(0)).otherwise(F.lit(90))).alias("signal_ts"),
    )
