"""Provider files: CSV bars, JSON provenance and the JSONL event log; parquet sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import EXCHANGE_TZ
from ..operators.eventlog import read_jsonl, to_jsonl
from ..schemas import PROVENANCE, PROVIDER_BARS

# --- fixed values: provider column names
RENAMED = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}


def read_csv_bars(spark: SparkSession, path: str) -> DataFrame:
    """Provider CSV to daily bars; the session is the New York date of the epoch milliseconds."""
    raw = spark.read.schema(PROVIDER_BARS).option("header", True).option("mode", "FAILFAST").csv(path)
    return shape_provider_bars(raw)


def shape_provider_bars(raw: DataFrame) -> DataFrame:
    date = F.to_date(F.from_utc_timestamp(F.timestamp_millis("t"), EXCHANGE_TZ))
    return raw.withColumn("date", date).withColumnsRenamed(RENAMED).select("ticker", "date", "open", "high", "low", "close", "volume")


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROVENANCE).option("multiLine", True).json(path)


def provenance_splits(provenance: DataFrame) -> DataFrame:
    s = provenance.select(F.explode("splits").alias("s")).select("s.*")
    return s.select("ticker", F.to_date("execution_date").alias("execution_date"), "split_from", "split_to", "adjustment_type")


def write_ledger(gaps: DataFrame, path: str) -> None:
    """Ledger rows appended as parquet, partitioned by check."""
    gaps.write.mode("append").partitionBy("check").parquet(path)


def write_bars(daily: DataFrame, path: str) -> None:
    """Daily bars partitioned by year, so date filters prune whole folders."""
    daily.withColumn("year", F.year("date")).write.mode("overwrite").partitionBy("year").parquet(path)


def write_event_lines(events: DataFrame, path: str) -> None:
    to_jsonl(events).write.mode("append").text(path)


__all__ = ["read_csv_bars", "read_jsonl", "read_provenance", "provenance_splits", "shape_provider_bars", "write_bars", "write_event_lines", "write_ledger"]
