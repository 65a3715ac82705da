"""Ledger, audit, panel and experiment-log queries with their verification SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import EVENT_KINDS, GENESIS_PREV, REQUIRED_CHECKS
from ..operators import audits, eventlog, ledger, panel as pan
from ..operators.corporate import CorporateActions
from ..operators.duplicates import check_duplicates
from ..operators.gaps import union_all
from ..session import cut_lineage
from ..sources import tables as src
from . import integrity_queries as iq, sqltext as q
from .integrity_run import IntegrityRun

# ------------------------------------------------------------------ ledger


def _gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps of the daily bars, every one of them written twice so that the merge has work to do."""
    s = iq._sessions(spark, folder)
    c = CorporateActions(s.daily, src.splits(spark, folder), iq.DS)
    parts = [s.non_trading_days(), s.partial_sessions(), s.listing_gaps(src.security_master(spark, folder)), c.split_gaps(),
             c.delisting_gaps(src.security_master(spark, folder)), check_duplicates(iq._lines(spark, folder), ["l_orderkey", "l_linenumber"], "lines")]
    return union_all(parts).withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")


def _ledger(spark, folder):
    return cut_lineage(ledger.merge(_gaps(spark, folder)))


def _transitions(led: DataFrame) -> DataFrame:
    """Two events per gap: a first RESOLVED, then by id resolved again, excluded from one or two experiments, or none."""
    k = F.conv(F.substring("gap_id", 1, 6), 16, 10).cast("long") % 4
    first = F.struct(F.lit(1).cast("long").alias("seq"), F.lit("RESOLVED").alias("status"), F.lit("seen").alias("resolution"),
                     F.array().cast("array<string>").alias("excluded_from"))
    second = F.struct(
        F.lit(2).cast("long").alias("seq"),
        F.when(k == 0, F.lit("RESOLVED")).otherwise(F.lit("EXCLUDED")).alias("status"),
        F.lit("decided").alias("resolution"),
        F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("exp1"))).otherwise(F.array(F.lit("exp1"), F.lit("exp2"))).alias("excluded_from"),
    )
    moved = led.where(k < 3)
    return moved.select("gap_id", F.explode(F.array(first, second)).alias("e")).select("gap_id", "e.*")


def _decided(spark, folder):
    led = _ledger(spark, folder)
    return ledger.apply_transitions(led, _transitions(led))


def _requirements(spark: SparkSession) -> DataFrame:
    rows = [("exp1", ["US_EQUITY"], ["daily_bars", "news"]), ("exp2", ["US_EQUITY", "JP_EQUITY"], ["daily_bars", "quotes"]), ("exp3", ["US_EQUITY"], ["daily_bars"])]
    return spark.createDataFrame(rows, "experiment string, markets array<string>, needs array<string>")


def _coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars are complete when lines exist; news is complete when every document has an instant (it has not)."""
    li = src.table(spark, folder, "lineitem").agg(F.lit("daily_bars").alias("need"), (F.count("*") > 0).alias("complete"), F.lit(None).cast("string").alias("note"))
    nw = src.news(spark, folder).agg(F.lit("news").alias("need"), (F.count("published_utc") == F.count("*")).alias("complete"), F.lit("undated articles").alias("note"))
    return li.unionByName(nw)


RUN_CHECKS = ("calendar", "sessions", "duplicates", "stale", "corporate_actions", "news_timestamps", "timestamp_gaps")


def _reasons(spark, folder):
    done = spark.createDataFrame([(c,) for c in RUN_CHECKS], "check string")
    return ledger.gate_reasons(_requirements(spark), _coverage(spark, folder), done, _decided(spark, folder))


def _part(check: str, name: str, where: str = "") -> str:
    return f"SELECT '{check}' AS \"check\", * FROM ({iq.QUERIES[name][1]}) {where}"


LED = "led AS (" + " UNION ALL ".join([
    _part("sessions", "gap_nontrading"), _part("sessions", "gap_partial"), _part("sessions", "gap_listing"),
    _part("corporate_actions", "split_gaps"), _part("corporate_actions", "delisting_unknown"), _part("duplicates", "dups"),
]) + ")"
DEC = (
    "dec AS (SELECT *, CASE WHEN k = 3 THEN 'OPEN' WHEN k = 0 THEN 'RESOLVED' ELSE 'EXCLUDED' END AS status, CASE k WHEN 1 THEN ['exp1'] WHEN 2 THEN"
    " ['exp1', 'exp2'] ELSE [] END AS ex FROM (SELECT *, ('0x' || substr(gap_id, 1, 6))::BIGINT % 4 AS k FROM led))"
)
EXPS = "exps AS (SELECT unnest(['exp1', 'exp2', 'exp3']) AS experiment)"
OPEN_FOR = "severity = 'MATERIAL' AND status <> 'RESOLVED' AND NOT (status = 'EXCLUDED' AND list_contains(ex, {e}))"
REASONS = (
    "reasons AS (SELECT 'exp2' AS experiment, 'UNREGISTERED_MARKET' AS reason, 'JP_EQUITY' AS subject"
    " UNION ALL SELECT 'exp1', 'COVERAGE_INCOMPLETE', 'news: undated articles' FROM (SELECT count(*) AS c FROM documents JOIN events ON doc_id = event_id WHERE doc_id % 17 = 0) WHERE c > 0"
    " UNION ALL SELECT 'exp2', 'DATASET_NOT_INGESTED', 'quotes'"
    " UNION ALL SELECT experiment, 'CHECK_NOT_RUN', c FROM exps, (SELECT unnest([" + ", ".join(f"'{c}'" for c in REQUIRED_CHECKS if c not in RUN_CHECKS) + "]) AS c)"
    " UNION ALL SELECT experiment, 'OPEN_MATERIAL_GAP', gap_id FROM exps, dec WHERE " + OPEN_FOR.format(e="experiment") + ")"
)


def _all_checks(spark, folder):
    run = IntegrityRun()
    run.daily(src.staged_daily_bars(spark, folder), iq.DS, src.security_master(spark, folder), src.splits(spark, folder), iq.LIQUID_DAILY)
    run.minutes(src.raw_minutes(spark, folder), "minutes", iq.LIQUID_MINUTES)
    run.news(src.news(spark, folder), "news", iq.RETRIEVED)
    return ledger.summary(run.ledger())


def _run_sql() -> str:
    names = [
        ("sessions", "gap_marketwide"), ("sessions", "gap_nontrading"), ("sessions", "gap_partial"), ("sessions", "gap_ticker_runs"), ("sessions", "gap_listing"),
        ("corporate_actions", "split_gaps"), ("corporate_actions", "unrecorded_jumps"), ("corporate_actions", "delisting_unknown"),
        ("minute_bars", "gap_minute_timestamps"), ("minute_bars", "gap_minute_closed"), ("duplicates", "gap_minute_dups"), ("minute_bars", "gap_minutes"),
        ("minute_bars", "gap_minutes_scattered"), ("timestamp_gaps", "gap_minute_jumps"), ("news_timestamps", "news_quality"),
        ("duplicates", "news_duplicates"), ("news_independence", "news_syndication"), ("news_coverage", "news_coverage"),
    ]
    return (
        "WITH g AS (" + " UNION ALL ".join(_part(c, n) for c, n in names)
        + ") SELECT \"check\", kind, severity, 'OPEN' AS status, count(DISTINCT gap_id) AS n_gaps FROM g GROUP BY 1, 2, 3"
    )


LEDGER = {
    "ledger_ids": (
        lambda s, f: _ledger(s, f).select("check", "kind", "severity", "ticker", "start", "end", "n", "gap_id"),
        q.with_ctes(LED) + "SELECT \"check\", kind, severity, ticker, start, \"end\", n, gap_id FROM led",
    ),
    "ledger_status": (
        lambda s, f: _decided(s, f).select("gap_id", "status", F.concat_ws(",", "excluded_from").alias("excluded_from")),
        q.with_ctes(LED, DEC) + "SELECT gap_id, status, array_to_string(ex, ',') AS excluded_from FROM dec",
    ),
    "ledger_open": (
        lambda s, f: ledger.unresolved_material(_decided(s, f), "exp2").select("gap_id", "kind"),
        q.with_ctes(LED, DEC) + "SELECT gap_id, kind FROM dec WHERE " + OPEN_FOR.format(e="'exp2'"),
    ),
    "ledger_open_any": (
        lambda s, f: ledger.unresolved_material(_decided(s, f)).select("gap_id", "kind"),
        q.with_ctes(LED, DEC) + "SELECT gap_id, kind FROM dec WHERE severity = 'MATERIAL' AND status = 'OPEN'",
    ),
    "ledger_excluded": (
        lambda s, f: ledger.excluded_gaps(_decided(s, f), "exp2").select("gap_id", "kind"),
        q.with_ctes(LED, DEC) + "SELECT gap_id, kind FROM dec WHERE status = 'EXCLUDED' AND list_contains(ex, 'exp2')",
    ),
    "ledger_summary": (
        lambda s, f: ledger.summary(_decided(s, f)),
        q.with_ctes(LED, DEC) + "SELECT \"check\", kind, severity, status, count(*) AS n_gaps FROM dec GROUP BY 1, 2, 3, 4",
    ),
    "ledger_rollup": (
        lambda s, f: ledger.rollup(_decided(s, f)),
        q.with_ctes(LED, DEC) + "SELECT grouping_id(\"check\", kind, severity, status)::INTEGER AS level, \"check\", kind, severity, status, count(*) AS n_gaps, sum(n)::BIGINT AS n_rows"
        " FROM dec GROUP BY ROLLUP (\"check\", kind, severity, status)",
    ),
    "gate_reasons": (_reasons, q.with_ctes(LED, DEC, EXPS, REASONS) + "SELECT experiment, reason, subject FROM reasons"),
    "gate": (
        lambda s, f: ledger.gate(_requirements(s), _reasons(s, f)),
        q.with_ctes(LED, DEC, EXPS, REASONS)
        + "SELECT e.experiment, count(r.reason) AS n_reasons, count(r.reason) = 0 AS open FROM exps e LEFT JOIN reasons r ON r.experiment = e.experiment GROUP BY 1",
    ),
    "integrity_run": (_all_checks, _run_sql()),
}

# ------------------------------------------------------------------ panel

GRID = (
    q.bars_cte(), "idx AS (SELECT date, (row_number() OVER (ORDER BY date) - 1)::INT AS t FROM (SELECT DISTINCT date FROM bars))",
    "life AS (SELECT ticker, min(t) AS t0, max(t) AS t1 FROM bars JOIN idx USING (date) GROUP BY ticker)",
    "grid AS (SELECT life.ticker, idx.t, idx.date, open, high, low, close, volume, idx.t BETWEEN t0 AND t1 AS alive, (idx.t BETWEEN t0 AND t1) AND open IS NULL AS excluded"
    " FROM life CROSS JOIN idx LEFT JOIN bars ON bars.ticker = life.ticker AND bars.date = idx.date)",
)


def _observed(spark, folder):
    return pan.observed_panel(src.staged_daily_bars(spark, folder))


PANEL = {
    "panel_grid": (
        lambda s, f: pan.densify(src.staged_daily_bars(s, f)).select("t", F.col("ts").cast("string").alias("ts"), "ticker", "open", "close", "volume", "alive", "excluded"),
        q.with_ctes(*GRID) + "SELECT t, date::VARCHAR AS ts, ticker, open, close, volume, alive, excluded FROM grid",
    ),
    "panel_slice": (
        lambda s, f: pan.slice_bars(_observed(s, f), 100, 400).select("t", "ticker", "close"),
        q.with_ctes(*GRID) + "SELECT t - 100 AS t, ticker, close FROM grid WHERE close IS NOT NULL AND t >= 100 AND t < 400",
    ),
    "tradable_cells": (
        lambda s, f: pan.in_bars(pan.densify(src.staged_daily_bars(s, f))).groupBy("t").agg(F.count("*").alias("names")),
        q.with_ctes(*GRID) + "SELECT t, count(*) AS names FROM grid WHERE alive AND open IS NOT NULL AND close IS NOT NULL AND NOT excluded GROUP BY t",
    ),
    "survivor_panel": (
        lambda s, f: pan.survivors(pan.densify(src.staged_daily_bars(s, f))).groupBy("ticker").agg(F.count("close").alias("bars")),
        q.with_ctes(*GRID) + "SELECT ticker, count(close) AS bars FROM grid WHERE ticker IN (SELECT ticker FROM grid WHERE alive AND t = (SELECT max(t) FROM idx)) GROUP BY ticker",
    ),
    "market_proxy": (
        lambda s, f: pan.market_proxy(pan.densify(src.staged_daily_bars(s, f))).withColumn("market_return", F.round("market_return", 6)),
        q.with_ctes(*GRID, "n AS (SELECT *, lead(open) OVER (PARTITION BY ticker ORDER BY t) AS nx FROM grid)")
        + "SELECT t, round(coalesce(avg(nx / open - 1) FILTER (alive), 0), 6) AS market_return FROM n GROUP BY t",
    ),
    "close_returns": (
        lambda s, f: pan.close_returns(_observed(s, f)).where("ret IS NOT NULL").select("t", "ticker", F.round("ret", 6).alias("ret")),
        q.with_ctes(*GRID, "n AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY t) - 1 AS ret FROM grid)")
        + "SELECT t, ticker, round(ret, 6) AS ret FROM n WHERE ret IS NOT NULL",
    ),
    "excluded_cells": (
        lambda s, f: pan.exclude_cells(_observed(s, f), _cell_gaps(s, f)).where("excluded").select("t", "ticker"),
        q.with_ctes(*GRID, q.SPLITS) + "SELECT DISTINCT t, g.ticker FROM grid g WHERE close IS NOT NULL AND (EXISTS (SELECT 1 FROM splits s WHERE s.ticker = g.ticker AND g.date"
        " BETWEEN s.execution_date AND s.execution_date + 10) OR EXISTS (SELECT 1 FROM bars b WHERE b.date = g.date AND NOT " + q.session_sql("b.date") + "))",
    ),
}


def _cell_gaps(spark, folder):
    """Ten days after every split per name, and every closed day for all names."""
    sp = src.splits(spark, folder).select("ticker", F.col("execution_date").cast("string").alias("start"), F.date_add("execution_date", 10).cast("string").alias("end"))
    off = iq._sessions(spark, folder).non_trading_days().select("ticker", "start", "end")
    return sp.unionByName(off)


# ------------------------------------------------------------------ audits


def _broken_panel(spark, folder):
    """Dense panel of coarse prices with planted defects by index arithmetic: bad highs, zero closes, lost prices, listing holes."""
    p = pan.densify(src.staged_daily_bars(spark, folder, iq.FLAT_STEP))
    k = F.regexp_extract("ticker", r"(\d+)", 1).cast("int")
    p = p.withColumn("high", F.when(F.col("t") % 50 == 1, F.col("low") - 1).otherwise(F.col("high")))
    p = p.withColumn("alive", F.col("alive") & ~((k % 3 == 0) & (F.col("t") % 400).between(100, 120)))
    return cut_lineage(p)


BROKEN = (
    *[c if i else q.bars_cte(iq.FLAT_STEP) for i, c in enumerate(GRID)],
    "pn AS (SELECT t, ticker, open, CASE WHEN t % 50 = 1 THEN low - 1 ELSE high END AS high, low, close, alive AND NOT (regexp_extract(ticker, '(\\d+)', 1)::INT % 3 = 0"
    " AND t % 400 BETWEEN 100 AND 120) AS alive FROM grid)",
    "pl AS (SELECT *, lag(close) OVER w AS pc, lag(alive) OVER w AS pa FROM pn WINDOW w AS (PARTITION BY ticker ORDER BY t))",
    "pf AS (SELECT *, coalesce(close = pc AND alive, false) AS flat FROM pl)",
    "pr AS (SELECT ticker, max(n) AS run FROM (SELECT ticker, g, count(*) AS n FROM (SELECT ticker, t - row_number() OVER (PARTITION BY ticker ORDER BY t) AS g FROM pf WHERE flat)"
    " GROUP BY 1, 2) GROUP BY 1)",
    "cc AS (SELECT 'ohlc_consistency' AS c, 'FAIL' AS s, count(*) AS n FROM pl WHERE alive AND (high < greatest(open, close) - 1e-9 OR low > least(open, close) + 1e-9) AND open IS NOT NULL"
    " UNION ALL SELECT 'nonpositive_price', 'FAIL', count(*) FROM pl WHERE alive AND close <= 0"
    " UNION ALL SELECT 'missing_alive', 'WARN', count(*) FROM pl WHERE alive AND close IS NULL"
    " UNION ALL SELECT 'bad_ticks_or_unadjusted_splits', 'WARN', count(*) FROM pl WHERE alive AND pa AND pc <> 0 AND abs(close / pc - 1) > 0.6"
    " UNION ALL SELECT 'stale_prices', 'WARN', count(*) FROM pr WHERE run >= 5"
    " UNION ALL SELECT 'alive_gaps', 'WARN', count(*) FROM (SELECT ticker FROM pl WHERE alive AND NOT pa GROUP BY ticker HAVING count(*) > 1))",
)


def _universe(spark, folder):
    """Each brand as a member of the universe on the 15th of every month of the data."""
    b = src.line_prices(spark, folder).select("ticker", F.trunc("date", "month").alias("m")).distinct()
    k = F.regexp_extract("ticker", r"(\d+)", 1).cast("int") % 5
    tk = F.when((k == 0) & (F.month("m") == 6), F.concat("ticker", F.lit("x"))).otherwise(F.col("ticker"))
    return b.select(tk.alias("ticker"), F.date_add(F.add_months("m", F.when(F.month("m") == 12, 2).otherwise(-1)), 14).alias("date"))


UNIVERSE = (
    q.bars_cte(), q.MASTER,
    "un AS (SELECT CASE WHEN regexp_extract(ticker, '(\\d+)', 1)::INT % 5 = 0 AND month(m) = 6 THEN ticker || 'x' ELSE ticker END AS ticker,"
    " ((m + CASE WHEN month(m) = 12 THEN to_months(2) ELSE to_months(-1) END)::DATE + 14) AS date FROM (SELECT DISTINCT ticker, date_trunc('month', date)::DATE AS m FROM bars))",
    "uj AS (SELECT un.*, list_date, delist_date FROM un LEFT JOIN master m ON m.ticker = un.ticker)",
)
ORDER_PAIRS = (("event_ts", "publication_ts"), ("publication_ts", "system_receipt_ts"), ("system_receipt_ts", "signal_ts"))
SIG = (
    "sg AS (SELECT event_id, date_trunc('second', ts) AS event_ts, date_trunc('second', ts) + to_seconds(user_id % 50) AS publication_ts,"
    " date_trunc('second', ts) + to_seconds(60 - CASE WHEN event_id % 31 = 0 THEN 40 ELSE 0 END) AS system_receipt_ts,"
    " date_trunc('second', ts) + to_seconds(CASE WHEN event_id % 19 = 0 THEN 0 ELSE 90 END) AS signal_ts FROM events)"
)


def _shuffled_stream(spark, folder):
    """Events in ingest order with every 41st stamped an hour early and minutes as bar times."""
    e = src.table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    late = F.expr("ts - interval 1 hour")
    return e.select("event_id", F.date_trunc("minute", F.when(F.col("event_id") % 41 == 0, late).otherwise(F.col("ts"))).alias("ts"))


STREAM = "st AS (SELECT event_id, date_trunc('minute', CASE WHEN event_id % 41 = 0 THEN ts - INTERVAL 1 HOUR ELSE ts END) AS ts FROM events)"


def _decisions(spark, folder):
    """Every 1st order of a customer and priority per line: decisions are the shipments' orders' customers at ship date."""
    li = src.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("timestamp").alias("decision_ts"))
    o = src.table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("string").alias("ticker"), F.col("o_orderpriority").alias("field"))
    return li.join(o, "l_orderkey")


AUDITS = {
    "timestamp_order": (
        lambda s, f: audits.timestamp_findings(_shuffled_stream(s, f), "event_id", block=5000).select("check", "severity", "n"),
        q.with_ctes(STREAM) + "SELECT 'timestamps_monotonic' AS \"check\", 'FAIL' AS severity, count(*) AS n FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS p FROM st) WHERE ts < p"
        " UNION ALL SELECT 'timestamps_unique', 'FAIL', (count(*) - count(DISTINCT ts)) FROM st",
    ),
    "panel_shape": (
        lambda s, f: audits.grid_findings(_observed(s, f)).select("check", "severity", "n"),
        q.with_ctes(*GRID) + "SELECT 'shape' AS \"check\", 'FAIL' AS severity, count(*) AS n FROM grid WHERE open IS NULL HAVING count(*) > 0",
    ),
    "panel_findings": (
        lambda s, f: audits.cell_findings(_broken_panel(s, f)).select("check", "severity", "n"),
        q.with_ctes(*BROKEN) + "SELECT c AS \"check\", s AS severity, n FROM cc WHERE n > 0",
    ),
    "universe_pit": (
        lambda s, f: audits.universe_violations(_universe(s, f), src.security_master(s, f)).withColumn("date", F.col("date").cast("string")),
        q.with_ctes(*UNIVERSE) + "SELECT 'universe_unknown_listing' AS \"check\", date::VARCHAR AS date, ticker FROM uj WHERE list_date IS NULL"
        " UNION ALL SELECT 'universe_leakage', date::VARCHAR, ticker FROM uj WHERE list_date > date"
        " UNION ALL SELECT 'universe_survivorship', date::VARCHAR, ticker FROM uj WHERE delist_date < date",
    ),
    "survivorship": (
        lambda s, f: audits.survivorship(pan.survivors(pan.densify(src.staged_daily_bars(s, f))), _dated_master(s, f)).select("check", "severity", "n"),
        q.with_ctes(*GRID, "alive AS (SELECT ticker FROM grid WHERE alive AND t = (SELECT max(t) FROM idx))", "dead AS (SELECT DISTINCT p_brand AS ticker FROM part)")
        + "SELECT 'survivorship_bias' AS \"check\", 'FAIL' AS severity, count(*) AS n FROM dead WHERE ticker NOT IN (SELECT ticker FROM alive) HAVING count(*) / (SELECT count(*) FROM dead) > 0.02",
    ),
    "signal_times": (
        lambda s, f: audits.signal_time_findings(src.signal_times(s, f)),
        q.with_ctes(SIG) + "SELECT * FROM (" + " UNION ALL ".join(
            f"SELECT 'timestamp_order' AS \"check\", 'FAIL' AS severity, count(*) AS n, '{a} > {b}' AS detail FROM sg WHERE {a} > {b}" for a, b in ORDER_PAIRS
        ) + " UNION ALL SELECT 'zero_latency_signal', 'FAIL', count(*), 'signal at or before publication' FROM sg WHERE signal_ts <= publication_ts) WHERE n > 0",
    ),
    "asof_filings": (
        lambda s, f: audits.asof_latest(src.filings(s, f), "1998-06-30T00:00:00Z", "filing_id").select(
            "ticker", "field", F.date_format("available_ts", "yyyy-MM-dd").alias("available_ts"), "value"),
        "SELECT o_custkey::VARCHAR AS ticker, o_orderpriority AS field, strftime(max(o_orderdate), '%Y-%m-%d') AS available_ts,"
        " arg_max(o_totalprice, epoch_us(o_orderdate)::HUGEINT * 1000000000 + o_orderkey) AS value FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30' GROUP BY 1, 2",
    ),
    "asof_join": (
        lambda s, f: audits.asof_join(_decisions(s, f), src.filings(s, f), ["ticker", "field"], "decision_ts", "available_ts", ["value"], "filing_id").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("decision_ts", "yyyy-MM-dd").alias("decision_ts"),
            F.date_format("available_ts", "yyyy-MM-dd").alias("available_ts"), "value"),
        "WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, o_custkey, o_orderpriority FROM lineitem JOIN orders ON o_orderkey = l_orderkey),"
        " f AS (SELECT o_custkey, o_orderpriority, o_orderdate, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1, 2, 3)"
        " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS decision_ts, strftime(o_orderdate, '%Y-%m-%d') AS available_ts, v AS value"
        " FROM d ASOF LEFT JOIN f ON d.o_custkey = f.o_custkey AND d.o_orderpriority = f.o_orderpriority AND d.l_shipdate >= f.o_orderdate",
    ),
}


def _dated_master(spark, folder):
    """Every brand of the catalogue counted as delisted."""
    return src.table(spark, folder, "part").select(F.col("p_brand").alias("ticker"), F.lit("2001-01-01").cast("date").alias("delist_date"))


# ------------------------------------------------------------------ experiment log


def _events(spark, folder):
    return src.experiment_events(spark, folder)


def _known(spark, folder):
    return _events(spark, folder).where(F.col("kind") != "UNLISTED_KIND")


def _sealed(spark, folder):
    return cut_lineage(eventlog.seal_events(_known(spark, folder)))


def _tampered(spark, folder):
    """Sealed chains with the payload of every 401st event edited afterwards."""
    edit = F.when(F.col("seq") % 401 == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    return _sealed(spark, folder).withColumn("payload", edit)


EV = (
    "ev AS (SELECT o_orderkey AS seq, strftime(o_orderdate, '%Y-%m-%d') AS ts_text, CASE WHEN o_orderkey % 97 = 0 THEN 'CONTAMINATION' WHEN o_orderkey % 5 = 0 THEN 'PREREG'"
    " WHEN o_orderkey % 53 = 1 THEN 'FINAL_TEST' WHEN o_orderkey % 211 = 2 THEN 'UNLISTED_KIND' ELSE 'EXPERIMENT' END AS kind, 'd' || (o_custkey % 20) AS ds,"
    " 'd' || (o_orderkey % 7) AS ds2, o_orderpriority AS family, 'h' || o_custkey AS hyp_id, o_orderstatus AS st, (o_orderkey % 3)::INT AS version,"
    " '{\"dataset_id\":\"d' || (o_custkey % 20) || '\",\"dataset_ids\":[\"d' || (o_custkey % 20) || '\",\"d' || (o_orderkey % 7) || '\"],\"family\":\"' || o_orderpriority ||"
    " '\",\"hyp_id\":\"h' || o_custkey || '\",\"params\":{\"status\":\"' || o_orderstatus || '\"},\"version\":' || (o_orderkey % 3) || '}' AS payload FROM orders)"
)
SEALED = (
    EV, "kn AS (SELECT *, row_number() OVER (PARTITION BY hyp_id ORDER BY seq) AS i FROM ev WHERE kind <> 'UNLISTED_KIND')",
)
SEAL_SQL = (
    "WITH RECURSIVE " + ", ".join(SEALED) + f", ch AS (SELECT hyp_id, seq, i, '{GENESIS_PREV}' AS prev_hash, sha256('{GENESIS_PREV}|' || ts_text || '|' || kind || '|' || payload)"
    " AS hash FROM kn WHERE i = 1 UNION ALL SELECT kn.hyp_id, kn.seq, kn.i, ch.hash, sha256(ch.hash || '|' || ts_text || '|' || kind || '|' || payload) FROM ch JOIN kn"
    " ON kn.hyp_id = ch.hyp_id AND kn.i = ch.i + 1) "
)
PRE = "pr AS (SELECT hyp_id, version, min(seq) AS seq, count(*) AS registrations, arg_min(payload, seq) AS payload FROM ev WHERE kind = 'PREREG' GROUP BY 1, 2)"

EVENTLOG = {
    "event_stream": (
        lambda s, f: eventlog.events_of(_events(s, f), "FINAL_TEST").select("seq", eventlog.field("hyp_id").alias("hyp_id"), "ts_text"),
        q.with_ctes(EV) + "SELECT seq, hyp_id, ts_text FROM ev WHERE kind = 'FINAL_TEST'",
    ),
    "unknown_kinds": (
        lambda s, f: eventlog.unknown_kinds(_events(s, f)).select("seq", "kind"),
        q.with_ctes(EV) + "SELECT seq, kind FROM ev WHERE kind NOT IN (" + ", ".join(f"'{k}'" for k in EVENT_KINDS) + ")",
    ),
    "seal_events": (
        lambda s, f: _sealed(s, f).select("chain", "seq", "prev_hash", "hash"),
        SEAL_SQL + "SELECT hyp_id AS chain, seq, prev_hash, hash FROM ch",
    ),
    "chain_verify": (
        lambda s, f: eventlog.verify_chain(_tampered(s, f), ["chain"], 4000),
        q.with_ctes(EV) + "SELECT hyp_id AS chain, seq, seq % 401 <> 0 AS hash_ok, true AS link_ok FROM ev WHERE kind <> 'UNLISTED_KIND'",
    ),
    "chain_valid": (
        lambda s, f: eventlog.chain_valid(eventlog.verify_chain(_tampered(s, f), ["chain"], 4000)),
        q.with_ctes(EV) + "SELECT count(*) AS events, count(*) FILTER (seq % 401 = 0) AS broken, count(*) FILTER (seq % 401 = 0) = 0 AS valid FROM ev WHERE kind <> 'UNLISTED_KIND'",
    ),
    "preregistrations": (
        lambda s, f: eventlog.preregistrations(_events(s, f)),
        q.with_ctes(EV, PRE) + "SELECT hyp_id, version, seq, registrations, sha256(payload) AS payload_sha FROM pr",
    ),
    "repeated_preregistrations": (
        lambda s, f: eventlog.repeated_preregistrations(_events(s, f)).select("hyp_id", "version", "registrations"),
        q.with_ctes(EV, PRE) + "SELECT hyp_id, version, registrations FROM pr WHERE registrations > 1",
    ),
    "experiments_without_prereg": (
        lambda s, f: eventlog.experiments_without_prereg(_events(s, f)),
        q.with_ctes(EV, PRE) + "SELECT e.seq, e.hyp_id, e.version FROM ev e WHERE kind = 'EXPERIMENT' AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.hyp_id = e.hyp_id"
        " AND pr.version = e.version AND pr.seq <= e.seq)",
    ),
    "trial_counts": (
        lambda s, f: eventlog.trial_counts(_events(s, f)),
        q.with_ctes(EV) + "SELECT family, count(*) AS experiments, count(DISTINCT hyp_id) AS hypotheses, count(DISTINCT hyp_id || '|' || version || '|' || st) AS variants,"
        " (SELECT count(DISTINCT d) FROM (SELECT ds AS d FROM ev x WHERE x.kind = 'EXPERIMENT' AND x.family = e.family UNION SELECT ds2 FROM ev x WHERE x.kind = 'EXPERIMENT' AND x.family = e.family))"
        " AS datasets FROM ev e WHERE kind = 'EXPERIMENT' GROUP BY family",
    ),
    "contaminated": (
        lambda s, f: eventlog.contaminated(_events(s, f)),
        q.with_ctes(EV) + "SELECT DISTINCT ds AS dataset_id FROM ev WHERE kind = 'CONTAMINATION'",
    ),
    "final_test_eligibility": (
        lambda s, f: eventlog.final_test_eligibility(_candidates(s, f), _events(s, f)),
        q.with_ctes(EV, "cand AS (SELECT 'h' || c_custkey AS hyp_id, 'd' || (c_custkey % 40) AS dataset_id, CASE WHEN c_custkey % 3 = 0 THEN 'REJECTED' ELSE 'ROBUST RESEARCH CANDIDATE' END"
                    " AS classification FROM customer)",
                    "w AS (SELECT *, CASE WHEN hyp_id IN (SELECT hyp_id FROM ev WHERE kind = 'FINAL_TEST') THEN 'LINEAGE_ALREADY_TESTED' WHEN dataset_id IN (SELECT ds FROM ev WHERE kind ="
                    " 'CONTAMINATION') THEN 'DATASET_CONTAMINATED' WHEN classification = 'REJECTED' THEN 'NOT_ROBUST_IN_DEVELOPMENT' END AS refusal FROM cand)")
        + "SELECT dataset_id, hyp_id, classification, refusal IS NULL AS eligible, refusal FROM w",
    ),
    "fingerprint": (
        lambda s, f: eventlog.fingerprint(src.table(s, f, "events").select(F.col("event_id").cast("string").alias("id"), "event_type", F.to_date("ts").alias("day"), "props"), "day", "event_type"),
        "WITH r AS (SELECT ts::DATE AS d, event_type, md5(event_id::VARCHAR || '|' || event_type || '|' || ts::DATE::VARCHAR || '|' || props) AS h FROM events)"
        " SELECT count(*) AS rows, count(DISTINCT d) AS n_bars, count(DISTINCT event_type) AS n_tickers, min(d)::VARCHAR AS start, max(d)::VARCHAR AS \"end\","
        " sum(('0x' || substr(h, 1, 8))::BIGINT)::BIGINT AS lane_a, sum(('0x' || substr(h, 9, 8))::BIGINT)::BIGINT AS lane_b FROM r",
    ),
    "fingerprint_check": (
        lambda s, f: _seal_check(s, f),
        "SELECT true AS matches FROM (SELECT count(*) AS c FROM events) WHERE c > 0 UNION ALL SELECT false FROM (SELECT count(*) AS c FROM events) WHERE c > 0",
    ),
}


def _candidates(spark, folder):
    c = src.table(spark, folder, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("h"), k.cast("string")).alias("hyp_id"), F.concat(F.lit("d"), (k % 40).cast("string")).alias("dataset_id"),
        F.when(k % 3 == 0, F.lit("REJECTED")).otherwise(F.lit("ROBUST RESEARCH CANDIDATE")).alias("classification"),
    )


def _seal_check(spark, folder):
    """The seal of the events against the same rows in another order, and against rows with one edited value."""
    e = src.table(spark, folder, "events").select(F.col("event_id").cast("string").alias("id"), "event_type", F.to_date("ts").alias("day"), "props")
    edited = e.withColumn("props", F.when(F.col("id") == "7", F.lit("{}")).otherwise(F.col("props")))
    seal = eventlog.fingerprint(e.repartition(7, "id"), "day", "event_type")
    return eventlog.seal_matches(eventlog.fingerprint(e, "day", "event_type"), seal).unionByName(
        eventlog.seal_matches(eventlog.fingerprint(edited, "day", "event_type"), seal))


QUERIES = {**LEDGER, **PANEL, **AUDITS, **EVENTLOG}
