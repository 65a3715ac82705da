"""Daily-session checks.

Missing sessions are found from the steps between observed sessions, never from a ticker x session grid: the work
grows with the bars that exist and the runs that are missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..constants import AMBIGUOUS, MATERIAL, MINOR
from ..functions.quantiles import median_at_least
from . import calendar as cal
from .gaps import as_gaps, union_all

CHECK = "sessions"


class DailySessions:
    """Relations shared by the session checks of one daily-bar dataset."""

    def __init__(self, daily: DataFrame, dataset_id: str, liquid_min_volume: float = 100_000, partial_frac: float = 0.5):
        self.daily, self.dataset_id = daily, dataset_id
        self.liquid_min_volume, self.partial_frac = liquid_min_volume, partial_frac
        self.seen = daily.groupBy("ticker", "date").agg(F.count("*").alias("bars"))
        self.per_date = cal.with_kind(self.seen.groupBy("date").agg(F.count("*").alias("tickers"), F.sum("bars").alias("bars")))
        self.range = self.per_date.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
        self.days = cal.days_between(self.range)
        self.sessions = cal.sessions(self.days)

    # ------------------------------------------------------------ market-wide
    def marketwide_missing(self) -> DataFrame:
        gone = self.sessions.join(self.per_date, "date", "left_anti")
        # both windows run on calendar rows only
        runs = gone.withColumn("g", F.col("pos") - F.row_number().over(Window.orderBy("pos"))).groupBy("g").agg(
            F.min("date").alias("a"), F.max("date").alias("b"), F.count("*").alias("n")
        )
        detail = F.format_string("expected sessions %s to %s have no bar of any ticker", F.col("a").cast("string"), F.col("b").cast("string"))
        return as_gaps(runs, self.dataset_id, CHECK, "MISSING_SESSION_MARKETWIDE", MATERIAL, detail, start=F.col("a"), end=F.col("b"), n=F.col("n"))

    def non_trading_days(self) -> DataFrame:
        off = self.per_date.where(f"NOT {cal.SESSION} AND kind <> 'UNKNOWN'")
        detail = F.format_string("%d bars on a closed day (%s): calendar or provider is wrong", "bars", "kind")
        d = F.col("date")
        return as_gaps(off, self.dataset_id, CHECK, "DATA_ON_NON_TRADING_DAY", MATERIAL, detail, start=d, end=d)

    def unknown_days(self) -> DataFrame:
        """Days with bars outside the years the calendar is verified for: nothing can be said about them."""
        x = self.per_date.where("kind = 'UNKNOWN'")
        d = F.col("date")
        return as_gaps(x, self.dataset_id, CHECK, "CALENDAR_UNKNOWN", MATERIAL, F.format_string("%d bars outside the verified calendar", "bars"), start=d, end=d)

    def partial_sessions(self) -> DataFrame:
        cov = self.per_date.where(cal.SESSION)
        med = cov.agg(F.median("tickers")).scalar()
        low = cov.withColumn("med", med).where(F.col("tickers") < F.lit(self.partial_frac) * F.col("med"))
        detail = F.format_string("%d tickers against a median of %d", F.col("tickers"), F.col("med").cast("int"))
        d = F.col("date")
        return as_gaps(low, self.dataset_id, CHECK, "PARTIAL_SESSION", MATERIAL, detail, start=d, end=d)

    # ------------------------------------------------------------ listing window
    def _span(self) -> DataFrame:
        return self.seen.groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"))

    def listing_gaps(self, master: DataFrame) -> DataFrame:
        """Head, tail, before-listing and after-delisting gaps. Sessions in a date span are the difference of two running
        counts looked up by day, so no range join is needed."""
        if "delist_date" not in master.columns:
            master = master.withColumn("delist_date", F.lit(None).cast("date"))
        if "list_date" not in master.columns:
            master = master.withColumn("list_date", F.lit(None).cast("date"))
        past_end = self.range.select(F.col("lo"), F.date_add("hi", 1).alias("hi"))
        day = cal.classify_days(cal.days_between(past_end))
        inside = F.when(F.expr(cal.SESSION), 1).otherwise(0)
        # calendar rows only
        before = day.select("date", (F.sum(inside).over(Window.orderBy("date")) - inside).alias("k"))
        lo = self.range.select("lo").scalar()
        hi = self.range.select(F.date_add("hi", 1)).scalar()

        def clamp(c):
            return F.greatest(F.least(c, F.col("_hi")), F.col("_lo"))

        x = self._span().join(master.select("ticker", "list_date", "delist_date"), "ticker").withColumn("_lo", lo).withColumn("_hi", hi)
        x = x.select(
            "ticker", "first", "last", "list_date", "delist_date",
            clamp(F.col("list_date")).alias("d1"),
            F.col("first").alias("d2"),
            F.date_add("last", 1).alias("d3"),
            clamp(F.date_add("delist_date", 1)).alias("d4"),
        )
        for i in (1, 2, 3, 4):
            x = x.join(before.select(F.col("date").alias(f"d{i}"), F.col("k").alias(f"k{i}")), f"d{i}", "left")
        head = F.when(F.col("list_date") < F.col("first"), F.col("k2") - F.col("k1")).otherwise(0)
        tail = F.when(F.col("delist_date") > F.col("last"), F.col("k4") - F.col("k3")).otherwise(0)

        def row(when, kind, severity, a, b, n, text):
            return F.when(when, F.struct(
                F.lit(kind).alias("kind"), severity.alias("severity"), F.col(a).cast("string").alias("a"),
                F.col(b).cast("string").alias("b"), n.cast("long").alias("n"), F.lit(text).alias("text")))

        material, one = F.lit(MATERIAL), F.lit(1)
        rows = F.array(
            row(head > 5, "MISSING_HEAD", F.when(head > 20, material).otherwise(F.lit(MINOR)), "list_date", "first", head,
                "the first bar comes many sessions after the listing"),
            row(F.col("list_date") > F.col("first"), "BARS_BEFORE_LISTING", material, "first", "list_date", one,
                "bars precede the listing"),
            row(tail > 5, "MISSING_TAIL", material, "last", "delist_date", tail, "the last bar comes many sessions before the delisting"),
            row(F.col("last") > F.date_add("delist_date", 3), "BARS_AFTER_DELISTING", material, "delist_date", "last", one,
                "bars continue after the delisting"),
        )
        g = x.select("ticker", F.explode(F.array_compact(rows)).alias("g")).select("ticker", "g.*")
        detail = F.concat_ws(" ", F.concat("ticker", F.lit(":")), F.col("text"), F.concat(F.lit("("), "a", F.lit(" / "), "b", F.lit(")")))
        return as_gaps(g, self.dataset_id, CHECK, F.col("kind"), F.col("severity"), detail, F.col("ticker"), F.col("a"), F.col("b"), F.col("n"))

    # ------------------------------------------------------------ per ticker
    def _open_sessions(self) -> DataFrame:
        """Sessions on which anybody traded: position, index among themselves, and segment between outages (calendar rows)."""
        s = self.sessions.join(self.per_date.select("date"), "date", "left_semi")
        s = s.withColumn("i", F.row_number().over(Window.orderBy("pos")) - 1)
        return s.withColumn("seg", F.dense_rank().over(Window.orderBy(F.col("pos") - F.col("i"))))

    def missing_runs(self) -> DataFrame:
        """(ticker, a, b, n): runs of expected sessions without a bar between a ticker's first and last bar.

        A market-wide outage is no ticker's gap, but it splits a run.
        """
        s = self._open_sessions()
        # calendar rows: open sessions before each day; a bar on a closed day lies between two of them
        day = self.days.join(s.select("date", F.lit(1).alias("is_open")), "date", "left")
        day = day.select("date", F.coalesce("is_open", F.lit(0)).alias("is_open"))
        day = day.withColumn("k", F.sum("is_open").over(Window.orderBy("date")) - F.col("is_open"))
        # closed days count only as a ticker's first or last bar: inside its span they must not cut a run in two
        own = Window.partitionBy("ticker")
        mine = self.seen.select("ticker", "date").join(day, "date")
        mine = mine.withColumn("d0", F.min("date").over(own)).withColumn("d1", F.max("date").over(own))
        step = mine.where("is_open = 1 OR date = d0 OR date = d1").select("ticker", (F.col("k") + F.col("is_open")).alias("lo"), F.lead("k").over(Window.partitionBy("ticker").orderBy("date")).alias("nxt"))
        hole = step.where("nxt > lo").select("ticker", "lo", (F.col("nxt") - 1).alias("hi"))
        at = s.select("i", "seg")
        hole = hole.join(at.toDF("lo", "s0"), "lo").join(at.toDF("hi", "s1"), "hi")
        hole = hole.select("ticker", "lo", "hi", F.explode(F.sequence("s0", "s1")).alias("seg"))
        ends = s.groupBy("seg").agg(F.min("i").alias("i0"), F.max("i").alias("i1"))
        cut = hole.join(ends, "seg").select("ticker", F.greatest("lo", "i0").alias("a"), F.least("hi", "i1").alias("b"))
        name = s.select("i", "date")
        return (
            cut.withColumn("n", F.col("b") - F.col("a") + 1)
            .join(name.toDF("a", "a_date"), "a")
            .join(name.toDF("b", "b_date"), "b")
            .select("ticker", F.col("a_date").alias("a"), F.col("b_date").alias("b"), F.col("n").cast("long"))
        )

    def liquidity(self) -> DataFrame:
        return self.daily.groupBy("ticker").agg(median_at_least("volume", self.liquid_min_volume).alias("liquid"))

    def ticker_gaps(self) -> DataFrame:
        x = self.missing_runs().join(self.liquidity(), "ticker")
        kind = F.when(F.col("liquid"), F.lit("MISSING_SESSION_LIQUID")).otherwise(F.lit("NO_TRADE_OR_MISSING"))
        sev = F.when(F.col("liquid"), F.lit(MATERIAL)).otherwise(F.lit(AMBIGUOUS))
        why = F.when(F.col("liquid"), F.lit("a liquid name always trades")).otherwise(F.lit("no trade and lost bar look the same"))
        detail = F.format_string("%s: %d sessions in a row without a bar (%s)", F.col("ticker"), F.col("n"), why)
        return as_gaps(x, self.dataset_id, CHECK, kind, sev, detail, F.col("ticker"), F.col("a"), F.col("b"), F.col("n"))

    # ------------------------------------------------------------ all, statistics
    def gaps(self, master: DataFrame | None = None) -> DataFrame:
        parts = [self.marketwide_missing(), self.non_trading_days(), self.unknown_days(), self.partial_sessions(), self.ticker_gaps()]
        if master is not None:
            parts.append(self.listing_gaps(master))
        return union_all(parts)

    def statistics(self) -> DataFrame:
        """One row: range, session and day-kind counts, missing ticker-sessions by class."""
        k = cal.classify_days(self.days).agg(
            F.min("date").alias("range_start"),
            F.max("date").alias("range_end"),
            F.count_if(F.col("kind").isin("TRADING", "EARLY_CLOSE")).alias("expected_sessions"),
            F.count_if(F.col("kind") == "EARLY_CLOSE").alias("early_closes"),
            F.count_if(F.col("kind") == "WEEKEND").alias("weekend_days"),
            F.count_if(F.col("kind") == "HOLIDAY").alias("weekday_holidays"),
        )
        m = self.missing_runs().join(self.liquidity(), "ticker").agg(
            F.coalesce(F.sum(F.when(F.col("liquid"), F.col("n"))), F.lit(0)).alias("missing_ticker_sessions_liquid"),
            F.coalesce(F.sum(F.when(~F.col("liquid"), F.col("n"))), F.lit(0)).alias("missing_ticker_sessions_ambiguous"),
        )
        one = F.lit(1).alias("_one")
        o = self.per_date.agg(F.count("*").alias("observed_sessions"))
        return k.select("*", one).join(o.select("*", one), "_one").join(m.select("*", one), "_one").drop("_one")
