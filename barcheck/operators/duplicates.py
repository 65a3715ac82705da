"""Duplicate and staleness checks on rows and daily bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..constants import MATERIAL, MINOR
from ..functions.quantiles import median_at_least
from ..functions.shape import previous_row, running_sum
from .gaps import as_gaps


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with the row count and whether their values conflict.

    Conflicts come from min, max and count, which combine map-side: a hot key costs one row per task. NULL counts as a
    value; rows with a NULL in the key are duplicates but never conflicts.
    """
    vals = [c for c in df.columns if c not in key]
    aggs = [F.count("*").alias("k")]
    for i, c in enumerate(vals):
        aggs += [F.min(c).alias(f"_lo{i}"), F.max(c).alias(f"_hi{i}"), F.count(c).alias(f"_n{i}")]
    g = df.groupBy(*key).agg(*aggs).where("k > 1")
    conflict = F.lit(False)
    for i in range(len(vals)):
        mixed = (F.col(f"_n{i}") > 0) & (F.col(f"_n{i}") < F.col("k"))
        conflict = conflict | mixed | F.coalesce(F.col(f"_lo{i}") != F.col(f"_hi{i}"), F.lit(False))
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    return g.select(*key, "k", (conflict & whole).alias("conflict"))


def check_duplicates(df: DataFrame, key: Sequence[str], dataset_id: str, label: str = "rows") -> DataFrame:
    x = duplicate_keys(df, key).agg(F.sum("k").alias("n"), F.count_if("conflict").alias("conflicts")).where("n > 0")
    bad = F.col("conflicts") > 0
    kind = F.when(bad, F.lit("CONFLICTING_DUPLICATES")).otherwise(F.lit("EXACT_DUPLICATES"))
    sev = F.when(bad, F.lit(MATERIAL)).otherwise(F.lit(MINOR))
    detail = F.format_string(f"%d {label} repeat the key {', '.join(key)}; %d keys disagree", "n", "conflicts")
    return as_gaps(x, dataset_id, "duplicates", kind, sev, detail, n=F.col("n"))


def flat_runs(daily: DataFrame) -> DataFrame:
    """Longest run of unchanged flat bars per ticker. Identical bars are collapsed with their count first."""
    cols = ["date", "open", "high", "low", "close"]
    d = daily.groupBy("ticker", *cols).agg(F.count("*").alias("k"))
    d = previous_row(d, ["ticker"], cols, ["close"], F.trunc("date", "year"))
    flat = F.coalesce((F.col("open") == F.col("close")) & (F.col("high") == F.col("low")), F.lit(False))
    f1 = F.coalesce(F.col("prev_close") == F.col("close"), F.lit(False)) & flat
    d = d.withColumn("f1", f1).withColumn("add", F.when(F.col("f1"), F.col("k")).when(flat, F.col("k") - 1).otherwise(0))
    d = running_sum(d, ["ticker"], cols, F.when(F.col("f1"), 0).otherwise(1), "g", F.trunc("date", "year"))
    return d.groupBy("ticker", "g").agg(F.sum("add").alias("run")).groupBy("ticker").agg(F.max("run").alias("run"))


def liquid_tickers(daily: DataFrame, floor: float) -> DataFrame:
    """(ticker, zeros) of tickers with a median volume of at least ``floor``; no list of volumes is kept for a ticker."""
    x = daily.groupBy("ticker").agg(median_at_least("volume", floor).alias("liquid"), F.count_if(F.col("volume") <= 0).alias("zeros"))
    return x.where("liquid").drop("liquid")


def check_stale_daily(daily: DataFrame, dataset_id: str, liquid_min_volume: float = 100_000, run_len: int = 3) -> DataFrame:
    liquid = liquid_tickers(daily, liquid_min_volume)
    runs = flat_runs(daily).where(F.col("run") >= run_len).join(liquid.select("ticker"), "ticker", "left_semi").withColumn("n", F.col("run") + 1)
    stale = as_gaps(runs, dataset_id, "stale", "STALE_DAILY_PRICES", MATERIAL,
                    F.format_string("%s: %d flat daily bars with the same price in a row", F.col("ticker"), F.col("n")), F.col("ticker"), n=F.col("n"))
    zero = as_gaps(liquid.where("zeros > 0"), dataset_id, "stale", "ZERO_VOLUME_BARS", MINOR,
                   F.format_string("%s: %d bars without volume", F.col("ticker"), F.col("zeros")), F.col("ticker"), n=F.col("zeros"))
    return stale.unionByName(zero)
