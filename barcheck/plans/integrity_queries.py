"""Integrity queries over the driver tables, each with its verification SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import calendar as cal
from ..operators.corporate import CorporateActions
from ..operators.duplicates import check_duplicates, check_stale_daily, duplicate_keys
from ..operators.minutes import MinuteBars
from ..operators.news import News
from ..operators.sessions import DailySessions
from ..sources import tables as src
from . import sqltext as q

DS = "bars"
LIQUID_DAILY = 30.0  # volumes of the tables are tens of units, not millions
LIQUID_MINUTES = 20.0
RETRIEVED = "2024-01-25T00:00:00Z"
FLAT_STEP = 20000.0

SHOW = ("kind", "severity", "ticker", "start", "end", "n", "gap_id")


def _show(gaps: DataFrame) -> DataFrame:
    return gaps.select(*SHOW)


def _gap_sql(ds, check, kind, sev, body, ticker="NULL", start="NULL", end="NULL", n="1"):
    return (
        f"SELECT {kind} AS kind, {sev} AS severity, ({ticker})::VARCHAR AS ticker, ({start})::VARCHAR AS start, ({end})::VARCHAR AS \"end\","
        f" ({n})::BIGINT AS n, {q.gap_id_sql(ds, check, kind, ticker, start, end)} AS gap_id FROM {body}"
    )


def _sessions(spark: SparkSession, folder: str) -> DailySessions:
    return DailySessions(src.staged_daily_bars(spark, folder), DS, LIQUID_DAILY)


def _with_outage(spark: SparkSession, folder: str) -> DailySessions:
    """The bars without those of 9 to 16 March of any year, as a feed that was down would leave them."""
    lost = (F.month("date") == 3) & F.dayofmonth("date").between(9, 16)
    return DailySessions(src.staged_daily_bars(spark, folder).where(~lost), DS, LIQUID_DAILY)


def _minutes(spark: SparkSession, folder: str) -> MinuteBars:
    return MinuteBars(src.raw_minutes(spark, folder), "minutes", LIQUID_MINUTES)


def _news(spark: SparkSession, folder: str) -> News:
    return News(src.news(spark, folder), "news", RETRIEVED)


def _corporate(spark: SparkSession, folder: str) -> CorporateActions:
    return CorporateActions(src.staged_daily_bars(spark, folder), src.splits(spark, folder), DS)


# ------------------------------------------------------------------ calendar and bars


def bars_daily(spark, folder):
    return src.daily_bars(spark, folder).select("ticker", F.col("date").cast("string").alias("date"), "open", "high", "low", "close", "volume")


def bars_minute(spark, folder):
    m = src.minute_bars(spark, folder)
    return m.select("ticker", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "open", "high", "low", "close", "volume")


def calendar_days(spark, folder):
    """Day kinds over the range of the bars, with the bars each kind of day carries."""
    s = _sessions(spark, folder)
    k = cal.classify_days(s.days).join(s.per_date.drop("kind"), "date", "left")
    return k.select(F.col("date").cast("string").alias("date"), "kind", F.coalesce("bars", F.lit(0)).alias("bars"))


def session_windows(spark, folder):
    """Session windows in UTC for the days the events cover, with the events inside each window."""
    ev = src.ticks(spark, folder).withColumn("date", cal.exchange_date(F.col("ts")))
    d = F.col("date")
    us = F.unix_micros("ts") - F.col("open_us")
    known = ev.join(cal.session_table(spark).withColumnRenamed("session", "date"), "date")
    inside = known.where((us >= 0) & (us < F.col("len").cast("long") * 60_000_000))
    hits = inside.groupBy("date").agg(F.count("*").alias("events"))
    w = cal.session_windows(cal.days_between(cal.data_range(ev))).join(hits, "date", "left")
    fmt = "yyyy-MM-dd HH:mm:ss"
    return w.select(
        d.cast("string").alias("date"), F.date_format("open_utc", fmt).alias("open_utc"), F.date_format("close_utc", fmt).alias("close_utc"),
        F.col("minutes").cast("long").alias("minutes"), F.coalesce("events", F.lit(0)).alias("events"),
    )


def minute_grid(spark, folder):
    """Expected minutes of every session the events cover, with the trades of each minute."""
    ev = src.ticks(spark, folder)
    got = ev.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("events"))
    g = cal.minute_grid(cal.days_between(cal.data_range(ev.withColumn("date", cal.exchange_date(F.col("ts"))))))
    return g.join(got, "minute", "left").select(
        F.date_format("minute", "yyyy-MM-dd HH:mm:ss").alias("minute"), F.coalesce("events", F.lit(0)).alias("events")
    )


def weekend_bars(spark, folder):
    return cal.weekend_bars(src.ticks(spark, folder)).select("check", "severity", "n")


def unregistered_markets(spark, folder):
    """Market names of the orders' regions that no calendar covers, with their orders."""
    c = src.table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    n = src.table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    r = src.table(spark, folder, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    o = src.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    market = F.when(F.col("r_name") == "AMERICA", F.lit("US_EQUITY")).otherwise(F.concat("r_name", F.lit("_EQUITY")))
    m = o.join(c, "c_custkey").join(n, "c_nationkey").join(r, "n_regionkey").groupBy(market.alias("market")).agg(F.sum("k").alias("orders"))
    return cal.require_registered(m)


BARS = q.bars_cte()
DAYS = q.days_cte("bars")
FMT = "'%Y-%m-%d %H:%M:%S'"
EV_DAYS = (
    f"ev AS (SELECT ts, {q.ny_date('ts')} AS date FROM events)", q.days_cte("ev"),
    f"win AS (SELECT date, {q.open_sql('date')} AS o, CASE WHEN {q.early_sql('date')} THEN 210 ELSE 390 END AS m FROM days WHERE {q.session_sql('date')})",
)

OUTAGE = (q.bars_cte(name="all_bars"), "bars AS (SELECT * FROM all_bars WHERE NOT (month(date) = 3 AND day(date) BETWEEN 9 AND 16))", DAYS, q.SESS)
MARKETWIDE = (
    "r AS (SELECT min(date) AS a, max(date) AS b, count(*) AS n FROM (SELECT date, pos - row_number() OVER (ORDER BY pos) AS g FROM sess WHERE date NOT IN (SELECT date FROM bars)) GROUP BY g)"
)

CALENDAR = {
    "bars_daily": (bars_daily, q.with_ctes(BARS) + "SELECT ticker, date::VARCHAR AS date, open, high, low, close, volume FROM bars"),
    "bars_minute": (bars_minute, q.with_ctes(q.MINUTES) + f"SELECT ticker, strftime(ts, {FMT}) AS ts, open, high, low, close, volume FROM minutes"),
    "calendar_days": (
        calendar_days,
        q.with_ctes(BARS, DAYS)
        + f"SELECT d.date::VARCHAR AS date, {q.kind_sql('d.date')} AS kind, coalesce(k, 0) AS bars FROM days d LEFT JOIN"
        " (SELECT date, count(*) AS k FROM bars GROUP BY date) b ON d.date = b.date",
    ),
    "session_windows": (
        session_windows,
        q.with_ctes(*EV_DAYS)
        + f"SELECT win.date::VARCHAR AS date, strftime(o, {FMT}) AS open_utc, strftime(o + to_minutes(m), {FMT}) AS close_utc, m::BIGINT AS minutes,"
        " (SELECT count(*) FROM events WHERE ts >= o AND ts < o + to_minutes(m)) AS events FROM win",
    ),
    "minute_grid": (
        minute_grid,
        q.with_ctes(*EV_DAYS)
        + f", g AS (SELECT o + to_minutes(i) AS minute FROM win, LATERAL (SELECT unnest(range(m)) AS i)), e AS (SELECT date_trunc('minute', ts) AS minute,"
        f" count(*) AS k FROM events GROUP BY 1) SELECT strftime(g.minute, {FMT}) AS minute, coalesce(k, 0) AS events FROM g LEFT JOIN e ON g.minute = e.minute",
    ),
    "weekend_bars": (
        weekend_bars,
        f"SELECT 'weekend_bars' AS \"check\", 'WARN' AS severity, count(*) AS n FROM events WHERE isodow({q.ny_date('ts')}) >= 6 HAVING count(*) > 0",
    ),
    "unregistered_markets": (
        unregistered_markets,
        "SELECT r_name || '_EQUITY' AS market, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
        " JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AMERICA' GROUP BY 1",
    ),
}


# ------------------------------------------------------------------ daily sessions

RUN_BASE = (
    BARS, DAYS, q.SESS,
    "open_sess AS (SELECT * FROM sess WHERE date IN (SELECT date FROM bars))",
    "span AS (SELECT ticker, min(date) AS f, max(date) AS l, median(volume) >= 30 AS liquid FROM bars GROUP BY ticker)",
    "miss AS (SELECT span.ticker, liquid, s.date, s.pos FROM span JOIN open_sess s ON s.date BETWEEN f AND l"
    " WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.ticker = span.ticker AND b.date = s.date))",
    "runs AS (SELECT ticker, liquid, min(date) AS a, max(date) AS b, count(*) AS n FROM (SELECT *, pos - row_number() OVER"
    " (PARTITION BY ticker ORDER BY pos) AS g FROM miss) GROUP BY ticker, liquid, g)",
)
LIQ_KIND = "CASE WHEN liquid THEN 'MISSING_SESSION_LIQUID' ELSE 'NO_TRADE_OR_MISSING' END"
LIQ_SEV = "CASE WHEN liquid THEN 'MATERIAL' ELSE 'AMBIGUOUS' END"
LISTING = (
    "span AS (SELECT ticker, min(date) AS f, max(date) AS l FROM bars GROUP BY ticker)",
    "x AS (SELECT m.*, f, l, (SELECT count(*) FROM sess WHERE date >= list_date AND date < f) AS head,"
    " (SELECT count(*) FROM sess WHERE date > l AND date <= delist_date) AS tail FROM master m JOIN span USING (ticker))",
)

SESSIONS = {
    "gap_marketwide": (
        lambda s, f: _show(_sessions(s, f).marketwide_missing()),
        q.with_ctes(BARS, DAYS, q.SESS)
        + ", r AS (SELECT min(date) AS a, max(date) AS b, count(*) AS n FROM (SELECT date, pos - row_number() OVER (ORDER BY pos) AS g FROM sess"
        " WHERE date NOT IN (SELECT date FROM bars)) GROUP BY g) "
        + _gap_sql(DS, "'sessions'", "'MISSING_SESSION_MARKETWIDE'", "'MATERIAL'", "r", start="a", end="b", n="n"),
    ),
    "gap_marketwide_outage": (
        lambda s, f: _show(_with_outage(s, f).marketwide_missing()),
        q.with_ctes(*OUTAGE, MARKETWIDE) + _gap_sql(DS, "'sessions'", "'MISSING_SESSION_MARKETWIDE'", "'MATERIAL'", "r", start="a", end="b", n="n"),
    ),
    "gap_nontrading": (
        lambda s, f: _show(_sessions(s, f).non_trading_days()),
        q.with_ctes(BARS) + _gap_sql(DS, "'sessions'", "'DATA_ON_NON_TRADING_DAY'", "'MATERIAL'",
                                     f"(SELECT DISTINCT date FROM bars WHERE NOT {q.session_sql('date')})", start="date", end="date"),
    ),
    "gap_partial": (
        lambda s, f: _show(_sessions(s, f).partial_sessions()),
        q.with_ctes(BARS, f"cov AS (SELECT date, count(DISTINCT ticker) AS k FROM bars WHERE {q.session_sql('date')} GROUP BY date)")
        + _gap_sql(DS, "'sessions'", "'PARTIAL_SESSION'", "'MATERIAL'", "(SELECT date FROM cov WHERE k < 0.5 * (SELECT median(k) FROM cov))",
                   start="date", end="date"),
    ),
    "gap_listing": (
        lambda s, f: _show(_sessions(s, f).listing_gaps(src.security_master(s, f))),
        q.with_ctes(BARS, DAYS, q.SESS, q.MASTER, *LISTING)
        + _gap_sql(DS, "'sessions'", "'MISSING_HEAD'", "CASE WHEN head > 20 THEN 'MATERIAL' ELSE 'MINOR' END", "x WHERE head > 5", "ticker", "list_date", "f", "head")
        + " UNION ALL " + _gap_sql(DS, "'sessions'", "'BARS_BEFORE_LISTING'", "'MATERIAL'", "x WHERE list_date > f", "ticker", "f", "list_date")
        + " UNION ALL " + _gap_sql(DS, "'sessions'", "'MISSING_TAIL'", "'MATERIAL'", "x WHERE tail > 5", "ticker", "l", "delist_date", "tail")
        + " UNION ALL " + _gap_sql(DS, "'sessions'", "'BARS_AFTER_DELISTING'", "'MATERIAL'", "x WHERE l > delist_date + 3", "ticker", "delist_date", "l"),
    ),
    "gap_ticker_runs": (
        lambda s, f: _show(_sessions(s, f).ticker_gaps()),
        q.with_ctes(*RUN_BASE) + _gap_sql(DS, "'sessions'", LIQ_KIND, LIQ_SEV, "runs", "ticker", "a", "b", "n"),
    ),
    "session_statistics": (
        lambda s, f: _sessions(s, f).statistics().withColumns({c: F.col(c).cast("string") for c in ("range_start", "range_end")}),
        q.with_ctes(*RUN_BASE, f"k AS (SELECT date, {q.kind_sql('date')} AS kind FROM days)")
        + "SELECT min(date)::VARCHAR AS range_start, max(date)::VARCHAR AS range_end, count(*) FILTER (kind IN ('TRADING', 'EARLY_CLOSE')) AS expected_sessions,"
        " count(*) FILTER (kind = 'EARLY_CLOSE') AS early_closes, count(*) FILTER (kind = 'WEEKEND') AS weekend_days, count(*) FILTER (kind = 'HOLIDAY')"
        " AS weekday_holidays, (SELECT count(DISTINCT date) FROM bars) AS observed_sessions,"
        " (SELECT coalesce(sum(n), 0)::BIGINT FROM runs WHERE liquid) AS missing_ticker_sessions_liquid,"
        " (SELECT coalesce(sum(n), 0)::BIGINT FROM runs WHERE NOT liquid) AS missing_ticker_sessions_ambiguous FROM k",
    ),
}

# ------------------------------------------------------------------ minute bars

MIN_BASE = (
    q.RAW_MINUTES,
    f"mb AS (SELECT *, {q.ny_date('ts')} AS session FROM minutes)",
    f"mt AS (SELECT mb.*, {q.open_sql('session')} AS o, CASE WHEN {q.early_sql('session')} THEN 210 ELSE 390 END AS len FROM mb WHERE {q.session_sql('session')})",
    "reg AS (SELECT * FROM mt WHERE ts >= o AND ts < o + to_minutes(len))",
    "ps AS (SELECT s.ticker, s.session, s.o, s.len, coalesce(v, 0) AS vol, coalesce(v, 0) >= 20 AS liquid, coalesce(rows, 0) AS rows FROM"
    " (SELECT DISTINCT ticker, session, o, len FROM mt) s LEFT JOIN (SELECT ticker, session, sum(volume) AS v, count(*) AS rows FROM reg GROUP BY 1, 2) r"
    " ON r.ticker = s.ticker AND r.session = s.session)",
    "mg AS (SELECT ps.*, i, o + to_minutes(i) AS m FROM ps, LATERAL (SELECT unnest(range(len)) AS i))",
    "mm AS (SELECT mg.* FROM mg WHERE NOT EXISTS (SELECT 1 FROM reg WHERE reg.ticker = mg.ticker AND reg.session = mg.session AND reg.ts = mg.m))",
    "mr AS (SELECT ticker, session, liquid, min(m) AS a, max(m) AS z, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY ticker, session"
    " ORDER BY i) AS g FROM mm) GROUP BY ticker, session, liquid, g)",
)
ISO = "'%Y-%m-%dT%H:%M:%S+00:00'"
M_KIND = "CASE WHEN liquid THEN 'MISSING_MINUTES_LIQUID' ELSE 'NO_TRADE_OR_MISSING_MINUTES' END"

MINUTES = {
    "gap_minute_timestamps": (
        lambda s, f: _show(_minutes(s, f).timestamp_defects()),
        q.with_ctes(q.RAW_MINUTES, "c AS (SELECT count(*) AS n FROM minutes WHERE ts <> date_trunc('minute', ts))")
        + _gap_sql("minutes", "'minute_bars'", "'TIMESTAMP_MISALIGNED'", "'MATERIAL'", "c WHERE n > 0", n="n"),
    ),
    "gap_minute_naive": (
        lambda s, f: _show(MinuteBars(src.raw_minutes(s, f).withColumn("ts", F.col("ts").cast("timestamp_ntz")), "minutes", LIQUID_MINUTES).timestamp_defects()),
        q.with_ctes(q.RAW_MINUTES, "c AS (SELECT count(*) FILTER (ts <> date_trunc('minute', ts)) AS off, count(*) AS n FROM minutes)")
        + _gap_sql("minutes", "'minute_bars'", "'TIMESTAMP_MISALIGNED'", "'MATERIAL'", "c WHERE off > 0", n="off")
        + " UNION ALL " + _gap_sql("minutes", "'minute_bars'", "'NAIVE_TIMESTAMPS'", "'MATERIAL'", "c", n="n"),
    ),
    "gap_minute_closed": (
        lambda s, f: _show(_minutes(s, f).closed_days()),
        q.with_ctes(*MIN_BASE[:2], f"c AS (SELECT session, count(*) AS n FROM mb WHERE NOT {q.session_sql('session')} GROUP BY session)")
        + _gap_sql("minutes", "'minute_bars'", "'DATA_ON_NON_TRADING_DAY'", "'MATERIAL'", "c", start="session", end="session", n="n"),
    ),
    "gap_minute_dups": (
        lambda s, f: _show(_minutes(s, f).duplicates()),
        q.with_ctes(*MIN_BASE[:3], "d AS (SELECT ticker, session, ts, count(*) AS k, count(DISTINCT open) > 1 OR count(DISTINCT close) > 1 OR count(DISTINCT high) > 1"
                    " OR count(DISTINCT low) > 1 OR count(DISTINCT volume) > 1 AS c FROM mt GROUP BY 1, 2, 3 HAVING count(*) > 1)",
                    "e AS (SELECT ticker, session, sum(k) AS n, bool_or(c) AS c FROM d GROUP BY 1, 2)")
        + _gap_sql("minutes", "'duplicates'", "CASE WHEN c THEN 'CONFLICTING_DUPLICATE_BARS' ELSE 'EXACT_DUPLICATE_BARS' END",
                   "CASE WHEN c THEN 'MATERIAL' ELSE 'MINOR' END", "e", "ticker", "session", "session", "n"),
    ),
    "gap_minutes": (
        lambda s, f: _show(_minutes(s, f).minute_gaps()),
        q.with_ctes(*MIN_BASE)
        + _gap_sql("minutes", "'minute_bars'", M_KIND, LIQ_SEV, "mr WHERE NOT liquid OR n >= 3", "ticker", f"strftime(a, {ISO})", f"strftime(z, {ISO})", "n"),
    ),
    "gap_minutes_scattered": (
        lambda s, f: _show(_minutes(s, f).scattered_minutes()),
        q.with_ctes(*MIN_BASE, "c AS (SELECT ticker, session, count(*) AS n FROM mm WHERE liquid GROUP BY 1, 2 HAVING count(*) >= 3)")
        + _gap_sql("minutes", "'minute_bars'", "'SCATTERED_MISSING_MINUTES_LIQUID'", "'MINOR'", "c", "ticker", "session", "session", "n"),
    ),
    "gap_minute_jumps": (
        lambda s, f: _show(_minutes(s, f).timestamp_jumps()),
        q.with_ctes(*MIN_BASE, "d AS (SELECT ticker, session, ts, lead(ts) OVER (PARTITION BY ticker, session ORDER BY ts) AS nx FROM (SELECT DISTINCT ticker, session, ts FROM reg))",
                    "e AS (SELECT d.*, liquid, epoch_us(nx) - epoch_us(d.ts) AS us FROM d JOIN ps ON ps.ticker = d.ticker AND ps.session = d.session)")
        + _gap_sql("minutes", "'timestamp_gaps'", "'INTRASESSION_TIMESTAMP_GAP'", LIQ_SEV, "e WHERE us > 300000000", "ticker", f"strftime(ts, {ISO})",
                   f"strftime(nx, {ISO})", "us // 60000000"),
    ),
    "gap_minute_stale": (
        lambda s, f: _show(_minutes_flat(s, f).stale_runs(2)),
        q.with_ctes(q.RAW_MINUTES.replace("value AS", "floor(value / 40) AS"), *MIN_BASE[1:5],
                    "d AS (SELECT *, row_number() OVER w AS i, coalesce(close = lag(close) OVER w, false) AND high = low AND volume > 0 AS same FROM reg"
                    " WINDOW w AS (PARTITION BY ticker, session ORDER BY ts, open, high, low, close, volume))",
                    "e AS (SELECT ticker, session, i - row_number() OVER (PARTITION BY ticker, session ORDER BY i) AS g FROM d WHERE same)",
                    "r AS (SELECT ticker, session, max(n) AS n FROM (SELECT ticker, session, g, count(*) AS n FROM e GROUP BY 1, 2, 3) GROUP BY 1, 2)",
                    "ok AS (SELECT r.* FROM r JOIN ps ON ps.ticker = r.ticker AND ps.session = r.session WHERE liquid AND rows >= 10 AND n >= 2)")
        + _gap_sql("minutes", "'stale'", "'STALE_MINUTE_PRICES'", "'MATERIAL'", "ok", "ticker", "session", "session", "n"),
    ),
    "minute_statistics": (
        lambda s, f: _minutes(s, f).statistics(),
        q.with_ctes(*MIN_BASE)
        + "SELECT (SELECT count(*) FROM mb) AS n_bars, count(*) AS sessions, sum(len)::BIGINT AS regular_expected,"
        " (SELECT count(*) FROM (SELECT DISTINCT ticker, session, ts FROM reg)) AS regular_observed,"
        " (SELECT count(*) FROM mm WHERE liquid) AS missing_regular_liquid, (SELECT count(*) FROM mm WHERE NOT liquid) AS missing_regular_ambiguous,"
        " (SELECT count(*) FROM mt) - (SELECT count(*) FROM reg) AS extended_hours_bars FROM ps",
    ),
}


def _minutes_flat(spark, folder):
    m = src.raw_minutes(spark, folder)
    coarse = {c: F.floor(F.col(c) / 40).cast("double") for c in ("open", "high", "low", "close")}
    return MinuteBars(m.withColumns(coarse), "minutes", LIQUID_MINUTES)


# ------------------------------------------------------------------ duplicates and staleness

LI = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def _lines(spark, folder):
    return src.table(spark, folder, "lineitem").select(*LI)


DUP_SQL = (
    "d AS (SELECT l_orderkey, l_linenumber, count(*) AS k, count(DISTINCT l_partkey) > 1 OR count(DISTINCT l_suppkey) > 1 OR count(DISTINCT l_quantity) > 1"
    " OR count(DISTINCT l_extendedprice) > 1 AS conflict FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)"
)
FLAT = (
    q.bars_cte(FLAT_STEP),
    "liq AS (SELECT ticker, count(*) FILTER (volume <= 0) AS zeros FROM bars GROUP BY ticker HAVING median(volume) >= 30)",
    "d AS (SELECT ticker, date, row_number() OVER w AS i, coalesce(close = lag(close) OVER w, false) AND open = close AND high = low AS same FROM bars"
    " WINDOW w AS (PARTITION BY ticker ORDER BY date))",
    "e AS (SELECT ticker, i - row_number() OVER (PARTITION BY ticker ORDER BY i) AS g FROM d WHERE same)",
    "r AS (SELECT ticker, max(n) + 1 AS n FROM (SELECT ticker, g, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1 HAVING max(n) >= 3)",
)

DUPLICATES = {
    "dup_keys": (
        lambda s, f: duplicate_keys(_lines(s, f), ["l_orderkey", "l_linenumber"]),
        q.with_ctes(DUP_SQL) + "SELECT l_orderkey, l_linenumber, k, conflict FROM d",
    ),
    "dups": (
        lambda s, f: _show(check_duplicates(_lines(s, f), ["l_orderkey", "l_linenumber"], "lines")),
        q.with_ctes(DUP_SQL, "e AS (SELECT sum(k) AS n, bool_or(conflict) AS c FROM d)")
        + _gap_sql("lines", "'duplicates'", "CASE WHEN c THEN 'CONFLICTING_DUPLICATES' ELSE 'EXACT_DUPLICATES' END", "CASE WHEN c THEN 'MATERIAL' ELSE 'MINOR' END",
                   "e WHERE n > 0", n="n"),
    ),
    "stale_daily": (
        lambda s, f: _show(check_stale_daily(src.staged_daily_bars(s, f, FLAT_STEP), DS, 10.0)),
        q.with_ctes(*FLAT).replace("median(volume) >= 30", "median(volume) >= 10")
        + _gap_sql(DS, "'stale'", "'STALE_DAILY_PRICES'", "'MATERIAL'", "r WHERE ticker IN (SELECT ticker FROM liq)", "ticker", n="n")
        + " UNION ALL " + _gap_sql(DS, "'stale'", "'ZERO_VOLUME_BARS'", "'MINOR'", "liq WHERE zeros > 0", "ticker", n="zeros"),
    ),
    "zero_volume": (
        lambda s, f: _show(check_stale_daily(_thin(s, f), DS, 10.0).where("kind = 'ZERO_VOLUME_BARS'")),
        q.with_ctes(BARS, "z AS (SELECT ticker, count(*) FILTER (volume - 10 <= 0) AS zeros FROM bars GROUP BY ticker HAVING median(volume - 10) >= 10)")
        + _gap_sql(DS, "'stale'", "'ZERO_VOLUME_BARS'", "'MINOR'", "z WHERE zeros > 0", "ticker", n="zeros"),
    ),
}


def _thin(spark, folder):
    return src.staged_daily_bars(spark, folder).withColumn("volume", F.col("volume") - 10)


# ------------------------------------------------------------------ news

NEWS_PROFILE = (
    q.NEWS,
    f"p AS (SELECT count(*) AS n, count(ts) AS usable, count(*) FILTER (st IN ('null', 'bad')) AS bad, count(*) FILTER (st = 'nozone') AS nozone,"
    f" count(*) FILTER (ts > TIMESTAMP '2024-01-25') AS fut, count(*) FILTER (ts = date_trunc('day', ts)) AS mid, count(*) FILTER (second(ts) = 0) AS sec0,"
    f" count(*) FILTER (minute(ts) IN (0, 15, 30, 45)) AS qh, count(*) FILTER (tickers = '[]') AS untagged, count(DISTINCT publisher_name) AS pubs FROM news)",
)
N_CHECK = "'news_timestamps'"
NORM = "trim(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'))"
SYND = f"sy AS (SELECT {NORM} AS headline, count(DISTINCT publisher_name) AS publishers FROM news WHERE ts IS NOT NULL AND length({NORM}) > 15 GROUP BY 1 HAVING count(DISTINCT publisher_name) > 1)"
COVER = (
    q.NEWS,
    f"ok AS (SELECT ts, ts::DATE AS date, {q.ny_date('ts')} AS nyd FROM news WHERE ts <= TIMESTAMP '2024-01-25')",
    q.days_cte("ok"),
    f"cs AS (SELECT days.date, count(nyd) AS k FROM days LEFT JOIN ok ON nyd = days.date WHERE {q.session_sql('days.date')} GROUP BY days.date)",
)

#: One day of New York without articles.
DEAD = ("2024-01-02 05:00:00", "2024-01-03 05:00:00")
DEAD_COVER = (COVER[0], COVER[1][:-1] + f" AND NOT (ts >= TIMESTAMP '{DEAD[0]}' AND ts < TIMESTAMP '{DEAD[1]}'))", *COVER[2:])


def _with_dead_day(spark: SparkSession, folder: str) -> News:
    """The news without the articles of DEAD, as a feed that was down would leave them."""
    at = F.translate(F.substring("published_utc", 1, 19), "T", " ")
    lost = F.coalesce((at >= DEAD[0]) & (at < DEAD[1]), F.lit(False))
    return News(src.news(spark, folder).where(~lost), "news", RETRIEVED)


NEWS = {
    "news_quality": (
        lambda s, f: _show(_news(s, f).timestamp_gaps()),
        q.with_ctes(*NEWS_PROFILE) + " UNION ALL ".join([
            _gap_sql("news", N_CHECK, "'MISSING_OR_UNPARSEABLE_TIMESTAMP'", "'MATERIAL'", "p WHERE bad > 0", n="bad"),
            _gap_sql("news", N_CHECK, "'TIMEZONE_MISSING'", "'MATERIAL'", "p WHERE nozone > 0", n="nozone"),
            _gap_sql("news", N_CHECK, "'PUBLISHED_AFTER_RETRIEVAL'", "'MATERIAL'", "p WHERE fut > 0", n="fut"),
            _gap_sql("news", N_CHECK, "'DATE_ONLY_TIMESTAMPS'", "'MATERIAL'", "p WHERE mid > 0.02 * n", n="mid"),
            _gap_sql("news", N_CHECK, "'MINUTE_RESOLUTION_ONLY'", "'MINOR'", "p WHERE sec0 > 0.9 * usable"),
            _gap_sql("news", N_CHECK, "'NO_TICKER_MAPPING'", "'MINOR'", "p WHERE untagged > 0", n="untagged"),
            _gap_sql("news", N_CHECK, "'NO_VENDOR_RECEIPT_TS'", "'MATERIAL'", "p"),
            _gap_sql("news", N_CHECK, "'NO_SYSTEM_RECEIPT_TS'", "'MATERIAL'", "p"),
        ]),
    ),
    "news_date_only": (
        lambda s, f: _show(_coarse_news(s, f, "day").timestamp_gaps().where("kind IN ('DATE_ONLY_TIMESTAMPS', 'IMPLAUSIBLE_EARLY_TIMESTAMP', 'MINUTE_RESOLUTION_ONLY')")),
        "WITH p AS (SELECT count(*) AS n FROM documents JOIN events ON doc_id = event_id) "
        + _gap_sql("news", N_CHECK, "'DATE_ONLY_TIMESTAMPS'", "'MATERIAL'", "p", n="n")
        + " UNION ALL " + _gap_sql("news", N_CHECK, "'IMPLAUSIBLE_EARLY_TIMESTAMP'", "'MATERIAL'", "p", n="n")
        + " UNION ALL " + _gap_sql("news", N_CHECK, "'MINUTE_RESOLUTION_ONLY'", "'MINOR'", "p"),
    ),
    "news_duplicates": (
        lambda s, f: _show(_news(s, f).duplicates()),
        q.with_ctes(q.NEWS, "d AS (SELECT id, count(*) AS k, count(DISTINCT title) > 1 OR count(DISTINCT published_utc) > 1 OR (count(published_utc) BETWEEN 1 AND count(*) - 1)"
                    " AS c FROM news GROUP BY id HAVING count(*) > 1)", "e AS (SELECT sum(k) AS n, bool_or(c) AS c FROM d)")
        + _gap_sql("news", "'duplicates'", "CASE WHEN c THEN 'CONFLICTING_DUPLICATES' ELSE 'EXACT_DUPLICATES' END", "CASE WHEN c THEN 'MATERIAL' ELSE 'MINOR' END",
                   "e WHERE n > 0", n="n"),
    ),
    "news_syndicated_titles": (
        lambda s, f: _news(s, f).syndicated_titles(),
        q.with_ctes(q.NEWS, SYND) + "SELECT headline, publishers FROM sy",
    ),
    "news_syndication": (
        lambda s, f: _show(_news(s, f).syndication()),
        q.with_ctes(q.NEWS, SYND, "c AS (SELECT count(*) AS n FROM sy)")
        + _gap_sql("news", "'news_independence'", "'SYNDICATED_ARTICLES'", "'MINOR'", "c WHERE n > 0", n="n"),
    ),
    "news_coverage": (
        lambda s, f: _show(_news(s, f).coverage_gaps()),
        q.with_ctes(*COVER) + _gap_sql("news", "'news_coverage'", "'NEWS_COVERAGE_GAP'", "'MATERIAL'",
                                       "cs WHERE (SELECT median(k) FROM cs) >= 5 AND k < 0.1 * (SELECT median(k) FROM cs)", start="date", end="date"),
    ),
    "news_coverage_dead_day": (
        lambda s, f: _show(_with_dead_day(s, f).coverage_gaps()),
        q.with_ctes(*DEAD_COVER) + _gap_sql("news", "'news_coverage'", "'NEWS_COVERAGE_GAP'", "'MATERIAL'",
                                            "cs WHERE (SELECT median(k) FROM cs) >= 5 AND k < 0.1 * (SELECT median(k) FROM cs)", start="date", end="date"),
    ),
    "news_per_session": (
        lambda s, f: _news(s, f).per_session().withColumn("date", F.col("date").cast("string")),
        q.with_ctes(*COVER) + "SELECT date::VARCHAR AS date, k FROM cs",
    ),
    "news_statistics": (
        lambda s, f: _round(_news(s, f).statistics(), "midnight_utc_fraction", "zero_seconds_fraction", "quarter_hour_fraction"),
        q.with_ctes(*NEWS_PROFILE, SYND, *[c for c in COVER if c not in NEWS_PROFILE])
        + "SELECT n AS n_articles, round(mid / usable, 6) AS midnight_utc_fraction, round(sec0 / usable, 6) AS zero_seconds_fraction,"
        " round(qh / usable, 6) AS quarter_hour_fraction, pubs AS distinct_publishers, (SELECT median(k) FROM cs) AS median_articles_per_session,"
        " (SELECT count(*) FROM sy) AS syndicated_titles FROM p",
    ),
}


def _coarse_news(spark, folder, unit):
    """Articles moved 40 years back and cut to whole days."""
    e = src.table(spark, folder, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"))
    n = src.table(spark, folder, "documents").select("doc_id", "text", "source").join(e, "doc_id")
    old = F.date_format(F.date_trunc(unit, F.add_months("ts", -480)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return News(n.select(F.col("doc_id").cast("string").alias("id"), old.alias("published_utc"), F.col("text").alias("title"),
                         F.col("source").alias("publisher_name")), "news", RETRIEVED)


def _round(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ------------------------------------------------------------------ corporate actions

MOVES = (
    BARS, q.SPLITS,
    "mv AS (SELECT ticker, date, open / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) AS r FROM bars)",
    "st AS (SELECT s.ticker, s.execution_date, split_from, split_to, count(mv.date) AS bars, coalesce(bool_or(abs(r * split_to / split_from - 1) < 0.12), false) AS hit,"
    " min(r) AS r_min, max(r) AS r_max FROM splits s LEFT JOIN mv ON mv.ticker = s.ticker AND mv.date BETWEEN execution_date - 4 AND execution_date + 4 GROUP BY 1, 2, 3, 4)",
    "bg AS (SELECT ticker, date, EXISTS (SELECT 1 FROM (SELECT unnest([2, 3, 4, 5, 6, 8, 10, 15, 20, 25, 50, 100])::DOUBLE AS k) WHERE abs(r - 1 / k) / (1 / k) < 0.12 OR"
    " abs(r - k) / k < 0.12) AS lk FROM mv WHERE (r < 0.65 OR r > 1.7) AND NOT EXISTS (SELECT 1 FROM splits s WHERE s.ticker = mv.ticker AND mv.date"
    " BETWEEN execution_date - 4 AND execution_date + 4))",
)
S_KIND = "CASE WHEN bars = 0 THEN 'SPLIT_NO_PRICE_DATA' ELSE 'SPLIT_WITHOUT_DISCONTINUITY' END"

CORPORATE = {
    "split_status": (
        lambda s, f: _round(_corporate(s, f).split_status().drop("copies").withColumn("execution_date", F.col("execution_date").cast("string")), "r_min", "r_max"),
        q.with_ctes(*MOVES) + "SELECT ticker, execution_date::VARCHAR AS execution_date, split_from, split_to, bars, hit, round(r_min, 6) AS r_min, round(r_max, 6) AS r_max FROM st",
    ),
    "split_gaps": (
        lambda s, f: _show(_corporate(s, f).split_gaps()),
        q.with_ctes(*MOVES) + _gap_sql(DS, "'corporate_actions'", S_KIND, "'MATERIAL'", "st WHERE NOT hit", "ticker", "execution_date", "execution_date"),
    ),
    "unrecorded_jumps": (
        lambda s, f: _show(_corporate(s, f).move_gaps()),
        q.with_ctes(*MOVES) + _gap_sql(DS, "'corporate_actions'", "CASE WHEN lk THEN 'UNRECORDED_SPLIT_LIKE_DISCONTINUITY' ELSE 'LARGE_UNEXPLAINED_GAP' END",
                                       "CASE WHEN lk THEN 'MATERIAL' ELSE 'MINOR' END", "bg", "ticker", "date", "date"),
    ),
    "delisting_unknown": (
        lambda s, f: _show(_corporate(s, f).delisting_gaps(src.security_master(s, f))),
        q.with_ctes(BARS, q.MASTER) + _gap_sql(DS, "'corporate_actions'", "'DELISTING_RETURN_UNKNOWN'", "'MATERIAL'",
                                               "master WHERE delist_date IS NOT NULL AND delist_return IS NULL", "ticker", "delist_date", "delist_date"),
    ),
    "action_statistics": (
        lambda s, f: _corporate(s, f).statistics(src.table(s, f, "supplier")),
        q.with_ctes(*MOVES) + "SELECT count(*) AS recorded_splits, count(*) FILTER (hit) AS splits_confirmed_in_prices, count(*) FILTER (NOT hit AND bars > 0)"
        " AS splits_without_discontinuity, (SELECT count(*) FROM bg) AS unrecorded_discontinuities, (SELECT count(*) FROM supplier) AS recorded_dividends FROM st",
    ),
}

QUERIES = {**CALENDAR, **SESSIONS, **MINUTES, **DUPLICATES, **NEWS, **CORPORATE}
