"""Trading calendar of the New York exchange.

The rules and the unscheduled closures give the special days of 1985-2100 (about 1,300 dates, a fixed size); days outside
are UNKNOWN, never guessed. They enter a plan as one small relation that
Spark broadcasts by its own size check; a day's kind is then a lookup, and no rule is evaluated per bar.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..constants import ADHOC_CLOSURES, ADHOC_EARLY_CLOSES, EXCHANGE_TZ, MARKETS

MON, TUE, WED, THU, FRI = range(5)
FIRST_DAY, LAST_DAY = date(1985, 1, 1), date(2100, 12, 31)


class UnknownMarket(ValueError):
    """A market without a registered calendar."""


def calendar_code(market: str) -> str:
    if market not in MARKETS:
        raise UnknownMarket(f"no trading calendar is registered for market {market!r}")
    return MARKETS[market]


def _easter(year: int) -> date:
    """Gregorian Easter Sunday (anonymous algorithm)."""
    golden, century, rest = year % 19, year // 100, year % 100
    epact = (19 * golden + century - century // 4 - (century - (century + 8) // 25 + 1) // 3 + 15) % 30
    weekday = (32 + 2 * (century % 4) + 2 * (rest // 4) - epact - rest % 4) % 7
    shift = (golden + 11 * epact + 22 * weekday) // 451
    code = epact + weekday - 7 * shift + 114
    return date(year, code // 31, code % 31 + 1)


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th given weekday of a month; n = -1 is the last."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)
    return last - timedelta(days=(last.weekday() - weekday) % 7)


def _observed(d: date) -> date:
    """Saturday is kept on Friday, Sunday on Monday."""
    return d + timedelta(days={5: -1, 6: 1}.get(d.weekday(), 0))


def holidays(year: int) -> Iterator[date]:
    """Closed weekdays of a year (rules in force since 1971)."""
    new_year = date(year, 1, 1)
    if new_year.weekday() != 5:  # a Saturday is not made up for
        yield _observed(new_year)
    if year >= 1998:
        yield _nth(year, 1, MON, 3)
    yield _nth(year, 2, MON, 3)
    yield _easter(year) - timedelta(days=2)
    yield _nth(year, 5, MON, -1)
    if year >= 2022:
        yield _observed(date(year, 6, 19))
    yield _observed(date(year, 7, 4))
    yield _nth(year, 9, MON, 1)
    yield _nth(year, 11, THU, 4)
    yield _observed(date(year, 12, 25))


def early_closes(year: int) -> Iterator[date]:
    """Sessions that end at 13:00 local time (rules in force since 1993)."""
    if year >= 1993:
        yield _nth(year, 11, THU, 4) + timedelta(days=1)
        if date(year, 12, 24).weekday() <= THU:
            yield date(year, 12, 24)
    third = date(year, 7, 3).weekday()
    if (year >= 1995 and third in (MON, TUE, THU)) or (year >= 2013 and third == WED):
        yield date(year, 7, 3)
    if 1996 <= year <= 2012 and third == WED:
        yield date(year, 7, 5)


@lru_cache(maxsize=1)
def _special_days() -> str:
    years = range(FIRST_DAY.year, LAST_DAY.year + 1)
    shut = {d for y in years for d in holidays(y)} | {date.fromisoformat(x) for x in ADHOC_CLOSURES}
    early = {d for y in years for d in early_closes(y)} | {date.fromisoformat(x) for x in ADHOC_EARLY_CLOSES}
    shut = {d for d in shut if d.weekday() < 5}
    early = {d for d in early if d.weekday() < 5} - shut
    return ",".join(sorted([f"H{d}" for d in shut] + [f"E{d}" for d in early]))


def special_days(spark: SparkSession) -> DataFrame:
    """(date, special): H closed, E early close."""
    x = spark.range(1).select(F.explode(F.split(F.lit(_special_days()), ",")).alias("s"))
    return x.select(F.to_date(F.substring("s", 2, 10)).alias("date"), F.substring("s", 1, 1).alias("special"))


def with_kind(df: DataFrame, col: str = "date") -> DataFrame:
    """Adds ``kind``: TRADING, EARLY_CLOSE, WEEKEND, HOLIDAY, or UNKNOWN for a weekday outside the verified years."""
    x = df.join(special_days(df.sparkSession).withColumnRenamed("date", col), col, "left")
    kind = (
        F.when(F.weekday(col) >= 5, F.lit("WEEKEND"))
        .when(F.col("special") == "H", F.lit("HOLIDAY"))
        .when(F.col("special") == "E", F.lit("EARLY_CLOSE"))
        .when(~F.col(col).between(F.lit(FIRST_DAY), F.lit(LAST_DAY)), F.lit("UNKNOWN"))
        .otherwise(F.lit("TRADING"))
    )
    return x.withColumn("kind", kind).drop("special")


SESSION = "kind IN ('TRADING', 'EARLY_CLOSE')"


def at_exchange(d: Column, minutes: Column) -> Column:
    """UTC instant of a wall-clock minute of an exchange date; daylight saving follows from the zone."""
    wall = F.timestamp_seconds(F.unix_date(d).cast("long") * 86400 + minutes * 60)
    return F.to_utc_timestamp(wall, EXCHANGE_TZ)


def session_open(d: Column) -> Column:
    return at_exchange(d, F.lit(9 * 60 + 30))


def exchange_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, EXCHANGE_TZ))


# ------------------------------------------------------------------ relations


def days_between(bounds: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """One row per calendar day of a one-row relation (lo, hi)."""
    return bounds.where(F.col(lo).isNotNull()).select(F.explode(F.sequence(lo, hi, F.expr("interval 1 day"))).alias("date"))


def data_range(df: DataFrame, col: str = "date") -> DataFrame:
    return df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))


def classify_days(days: DataFrame) -> DataFrame:
    return with_kind(days.select("date"))


def sessions(days: DataFrame) -> DataFrame:
    """Expected sessions with their 0-based position.

    The window is un-partitioned on purpose: it runs on calendar days (about 250 rows a year), never on data.
    """
    s = with_kind(days.select("date")).where(SESSION)
    return s.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("pos"))


def session_table(spark: SparkSession) -> DataFrame:
    """All sessions of 1985-2100 with their window: a dimension of fixed size (29k rows) that Spark broadcasts by its
    own size check. Looking a bar's session up here is cheaper than evaluating the rules on every bar."""
    days = spark.range((LAST_DAY - FIRST_DAY).days + 1).select(F.date_add(F.lit(FIRST_DAY), F.col("id").cast("int")).alias("date"))
    w = session_windows(days)
    return w.select(F.col("date").alias("session"), F.unix_micros("open_utc").alias("open_us"), F.col("minutes").alias("len"))


def session_windows(days: DataFrame) -> DataFrame:
    x = with_kind(days.select("date")).where(SESSION)
    x = x.withColumn("minutes", F.when(F.col("kind") == "EARLY_CLOSE", F.lit(210)).otherwise(F.lit(390)))
    close = at_exchange(F.col("date"), F.lit(9 * 60 + 30) + F.col("minutes"))
    return x.select("date", session_open(F.col("date")).alias("open_utc"), close.alias("close_utc"), "minutes")


def minute_grid(days: DataFrame) -> DataFrame:
    """Expected regular-session minutes (bounded by 390 per session)."""
    return session_windows(days).select(
        "date",
        F.explode(F.sequence("open_utc", F.expr("close_utc - interval 1 minute"), F.expr("interval 1 minute"))).alias("minute"),
    )


def require_registered(markets: DataFrame, col: str = "market") -> DataFrame:
    """Markets of a relation that have no registered calendar."""
    known = F.array(*[F.lit(m) for m in MARKETS])
    return markets.where(~F.coalesce(F.array_contains(known, F.col(col)), F.lit(False)))


def weekend_bars(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Bars whose exchange-local day is a Saturday or Sunday, as a finding row when there are any."""
    hit = F.weekday(F.from_utc_timestamp(ts, EXCHANGE_TZ)) >= 5
    return df.agg(F.count_if(hit).alias("n")).where("n > 0").select(
        F.lit("weekend_bars").alias("check"), F.lit("WARN").alias("severity"),
        F.format_string("%d bars fall on exchange-local weekends", "n").alias("detail"), "n",
    )
