"""Minute-bar checks. Session, grid position and regular hours are expressions of the timestamp: no calendar join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..constants import AMBIGUOUS, MATERIAL, MINOR
from . import calendar as cal
from .gaps import as_gaps, iso_utc, union_all

PRICES = ("open", "high", "low", "close", "volume")
KEY = ("ticker", "session")
MINUTE = 60_000_000  # microseconds


class MinuteBars:
    """Relations shared by the minute checks of one dataset.

    Bars are reduced to one row per timestamp and then one per minute before any window, so a (ticker, session) window
    sees at most 390 rows however many duplicates the feed carries.
    """

    def __init__(self, bars: DataFrame, dataset_id: str, liquid_min_session_volume: float = 200_000, max_gap_minutes: int = 5):
        self.dataset_id, self.floor, self.max_gap = dataset_id, liquid_min_session_volume, max_gap_minutes
        kind = bars.schema["ts"].dataType
        self.naive = isinstance(kind, T.TimestampNTZType)
        ts = F.timestamp_millis(F.col("ts").cast("long")) if isinstance(kind, (T.LongType, T.IntegerType, T.DoubleType)) else F.col("ts").cast("timestamp")
        b = bars.withColumn("ts", ts).withColumn("session", cal.exchange_date(F.col("ts")))
        self.bars = b.join(cal.session_table(bars.sparkSession), "session", "left")
        self.tagged = self.bars.where(F.col("len").isNotNull()).withColumn("us", F.unix_micros("ts") - F.col("open_us"))
        self.per_ts = self.tagged.groupBy(*KEY, "open_us", "len", "ts", "us").agg(
            F.count("*").alias("k"), *[f(c).alias(f"{c}_{nm}") for c in PRICES for nm, f in (("lo", F.min), ("hi", F.max))],
            F.sum("volume").alias("vol"),
        )
        regular = (F.col("us") >= 0) & (F.col("us") < F.col("len") * F.lit(MINUTE).cast("long"))
        self.regular = regular
        # one row per minute; minute -1 stands for the session itself so that empty sessions stay visible
        spot = F.when(regular, F.floor(F.col("us") / F.lit(MINUTE).cast("long"))).otherwise(F.lit(-1)).cast("int")
        self.per_minute = self.per_ts.withColumn("m", spot).groupBy(*KEY, "open_us", "len", "m").agg(
            F.count("*").alias("stamps"),
            F.sum("k").alias("rows"),
            F.sum("vol").alias("vol"),
            F.min("ts").alias("t0"),
            F.max("ts").alias("t1"),
            F.bool_or(F.col("us") % F.lit(MINUTE).cast("long") == 0).alias("on_grid"),
        )
        self.per_session = self.per_minute.groupBy(*KEY, "open_us", "len").agg(
            F.coalesce(F.sum(F.when(F.col("m") >= 0, F.col("vol"))), F.lit(0.0)).alias("vol"),
            F.sum(F.when(F.col("m") >= 0, F.col("stamps")).otherwise(0)).alias("observed"),
            F.sum(F.when(F.col("m") >= 0, F.col("rows")).otherwise(0)).alias("regular_rows"),
            F.sum(F.when(F.col("m") < 0, F.col("rows")).otherwise(0)).alias("extended_rows"),
            F.count_if((F.col("m") >= 0) & F.col("on_grid")).alias("hits"),
        ).withColumn("liquid", F.col("vol") >= self.floor)

    def timestamp_defects(self) -> DataFrame:
        off = F.unix_micros("ts") % F.lit(MINUTE).cast("long") != 0
        c = self.bars.agg(F.count("*").alias("n"), F.count_if(off).alias("off"))
        mis = as_gaps(c.where("off > 0"), self.dataset_id, "minute_bars", "TIMESTAMP_MISALIGNED", MATERIAL,
                      F.format_string("%d bars are off the minute", "off"), n=F.col("off"))
        if not self.naive:
            return mis
        return mis.unionByName(as_gaps(c, self.dataset_id, "minute_bars", "NAIVE_TIMESTAMPS", MATERIAL, "timestamps have no time zone", n=F.col("n")))

    def closed_days(self) -> DataFrame:
        d = F.col("session")
        x = self.bars.where(F.col("len").isNull()).groupBy("session").agg(F.count("*").alias("n"))
        return as_gaps(x, self.dataset_id, "minute_bars", "DATA_ON_NON_TRADING_DAY", MATERIAL, "bars on a closed day", start=d, end=d, n=F.col("n"))

    def duplicates(self) -> DataFrame:
        differ = F.lit(False)
        for c in PRICES:
            differ = differ | F.coalesce(F.col(f"{c}_lo") != F.col(f"{c}_hi"), F.lit(False))
        x = self.per_ts.where("k > 1").groupBy(*KEY).agg(F.sum("k").alias("n"), F.bool_or(differ).alias("conflict"))
        kind = F.when(F.col("conflict"), F.lit("CONFLICTING_DUPLICATE_BARS")).otherwise(F.lit("EXACT_DUPLICATE_BARS"))
        sev = F.when(F.col("conflict"), F.lit(MATERIAL)).otherwise(F.lit(MINOR))
        d = F.col("session")
        detail = F.format_string("%s: %d bars share a timestamp", F.col("ticker"), F.col("n"))
        return as_gaps(x, self.dataset_id, "duplicates", kind, sev, detail, F.col("ticker"), d, d, F.col("n"))

    def missing_minutes(self) -> DataFrame:
        """(ticker, session, liquid, a, z, n): missing runs as grid positions, from the step between bars on the grid."""
        grid = self.per_minute.where("m >= 0 AND on_grid").select(*KEY, "m")
        start = self.per_session.select(*KEY, F.lit(-1).alias("m"))
        steps = grid.unionByName(start).withColumn("nxt", F.lead("m").over(Window.partitionBy(*KEY).orderBy("m")))
        x = steps.join(self.per_session.select(*KEY, "open_us", "len", "liquid"), list(KEY))
        x = x.withColumn("nxt", F.coalesce("nxt", "len")).where("nxt - m > 1")
        return x.select(*KEY, "open_us", "liquid", (F.col("m") + 1).alias("a"), (F.col("nxt") - 1).alias("z"), (F.col("nxt") - F.col("m") - 1).alias("n"))

    def minute_gaps(self) -> DataFrame:
        x = self.missing_minutes().where("NOT liquid OR n >= 3")
        at = lambda c: F.timestamp_micros(F.col("open_us") + F.col(c).cast("long") * MINUTE)
        a, z = at("a"), at("z")
        kind = F.when(F.col("liquid"), F.lit("MISSING_MINUTES_LIQUID")).otherwise(F.lit("NO_TRADE_OR_MISSING_MINUTES"))
        sev = F.when(F.col("liquid"), F.lit(MATERIAL)).otherwise(F.lit(AMBIGUOUS))
        detail = F.format_string("%s: %d regular minutes in a row are missing", F.col("ticker"), F.col("n"))
        return as_gaps(x, self.dataset_id, "minute_bars", kind, sev, detail, F.col("ticker"), iso_utc(a), iso_utc(z), F.col("n"))

    def scattered_minutes(self) -> DataFrame:
        x = self.per_session.withColumn("n", F.col("len") - F.col("hits")).where("liquid AND n >= 3")
        d = F.col("session")
        detail = F.format_string("%s: %d minutes are missing in all", F.col("ticker"), F.col("n"))
        return as_gaps(x, self.dataset_id, "minute_bars", "SCATTERED_MISSING_MINUTES_LIQUID", MINOR, detail, F.col("ticker"), d, d, F.col("n"))

    def timestamp_jumps(self) -> DataFrame:
        """More than the allowed minutes between consecutive distinct regular timestamps, in time order."""
        w = Window.partitionBy(*KEY).orderBy("m")
        x = self.per_minute.where("m >= 0").withColumn("nxt", F.lead("t0").over(w))
        x = x.withColumn("us", F.unix_micros("nxt") - F.unix_micros("t1")).where(F.col("us") > F.lit(self.max_gap).cast("long") * MINUTE)
        x = x.join(self.per_session.select(*KEY, "liquid"), list(KEY)).withColumn("n", F.floor(F.col("us") / F.lit(MINUTE).cast("long")))
        sev = F.when(F.col("liquid"), F.lit(MATERIAL)).otherwise(F.lit(AMBIGUOUS))
        detail = F.format_string("%s: %d minutes between consecutive bars", F.col("ticker"), F.col("n"))
        return as_gaps(x, self.dataset_id, "timestamp_gaps", "INTRASESSION_TIMESTAMP_GAP", sev, detail, F.col("ticker"),
                       iso_utc(F.col("t1")), iso_utc(F.col("nxt")), F.col("n"))

    def stale_runs(self, min_run: int = 10) -> DataFrame:
        """Longest run of flat bars with volume per liquid session. Identical bars are counted before the window."""
        same = self.tagged.where(self.regular).groupBy(*KEY, "ts", *PRICES).agg(F.count("*").alias("k"))
        w = Window.partitionBy(*KEY).orderBy("ts", *PRICES)
        flat = F.coalesce((F.col("high") == F.col("low")) & (F.col("volume") > 0), F.lit(False))
        f1 = F.coalesce(F.lag("close").over(w) == F.col("close"), F.lit(False)) & flat
        x = same.withColumn("f1", f1).withColumn("add", F.when(F.col("f1"), F.col("k")).when(flat, F.col("k") - 1).otherwise(0))
        x = x.withColumn("g", F.sum(F.when(F.col("f1"), 0).otherwise(1)).over(w))
        runs = x.groupBy(*KEY, "g").agg(F.sum("add").alias("run")).groupBy(*KEY).agg(F.max("run").alias("n"))
        ok = self.per_session.where("liquid AND regular_rows >= 10").select(*KEY)
        runs = runs.where(F.col("n") >= min_run).join(ok, list(KEY), "left_semi")
        d = F.col("session")
        detail = F.format_string("%s: %d flat bars with volume in a row", F.col("ticker"), F.col("n"))
        return as_gaps(runs, self.dataset_id, "stale", "STALE_MINUTE_PRICES", MATERIAL, detail, F.col("ticker"), d, d, F.col("n"))

    def gaps(self) -> DataFrame:
        return union_all([
            self.timestamp_defects(), self.closed_days(), self.duplicates(), self.minute_gaps(),
            self.scattered_minutes(), self.timestamp_jumps(), self.stale_runs(),
        ])

    def statistics(self) -> DataFrame:
        miss = F.col("len") - F.col("hits")
        s = self.per_session.agg(
            F.count("*").alias("sessions"),
            F.sum("len").cast("long").alias("regular_expected"),
            F.sum("observed").alias("regular_observed"),
            F.sum(F.when(F.col("liquid"), miss).otherwise(0)).cast("long").alias("missing_regular_liquid"),
            F.sum(F.when(F.col("liquid"), 0).otherwise(miss)).cast("long").alias("missing_regular_ambiguous"),
            F.sum("extended_rows").alias("extended_hours_bars"),
        )
        one = F.lit(1).alias("_one")
        return self.bars.agg(F.count("*").alias("n_bars")).select("*", one).join(s.select("*", one), "_one").drop("_one")
