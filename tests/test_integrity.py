"""Planted defects must be found exactly; clean data must stay silent."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barcheck.operators import calendar as cal
from barcheck.operators import ledger
from barcheck.operators.corporate import CorporateActions
from barcheck.operators.duplicates import check_duplicates, check_stale_daily
from barcheck.operators.minutes import MinuteBars
from barcheck.operators.news import News
from barcheck.operators.sessions import DailySessions
from barcheck.schemas import DAILY_BARS, MINUTE_BARS, SECURITY_MASTER, SPLITS

SHUT = {d for y in (2024, 2025) for d in cal.holidays(y)} | {date(2025, 1, 9)}


def session_days(a=date(2024, 10, 1), b=date(2025, 3, 31)):
    days = [a + timedelta(days=i) for i in range((b - a).days + 1)]
    return [d for d in days if d.weekday() < 5 and d not in SHUT]


def clean_rows(tickers=("AAA", "BBB", "ILL")):
    rows = {}
    for tk in tickers:
        for i, d in enumerate(session_days()):
            o, c = 100 + (i * 7 % 13) * 0.2, 100 + (i * 5 % 11) * 0.3 + 0.01
            rows[tk, d] = (tk, d, o, max(o, c) * 1.002, min(o, c) * 0.998, c, 2e4 if tk == "ILL" else 5e6)
    return rows


def daily(spark, rows):
    return spark.createDataFrame(list(rows.values()), DAILY_BARS)


def found(gaps):
    out = {}
    for g in gaps.collect():
        out.setdefault(g["kind"], []).append(g)
    return out


def test_calendar_facts(spark):
    days = spark.sql("SELECT explode(sequence(date'2024-11-25', date'2025-07-11')) AS date")
    kind = {str(r["date"]): r["kind"] for r in cal.classify_days(days).collect()}
    assert kind["2024-11-28"] == "HOLIDAY" and kind["2024-11-29"] == "EARLY_CLOSE"
    assert kind["2024-11-30"] == "WEEKEND" and kind["2024-11-27"] == "TRADING"
    assert kind["2025-01-09"] == kind["2025-04-18"] == kind["2025-06-19"] == kind["2025-07-04"] == "HOLIDAY"
    june = [d for d, k in kind.items() if "2025-06-02" <= d <= "2025-07-11" and k in ("TRADING", "EARLY_CLOSE")]
    assert len(june) == 28


def test_session_windows_follow_daylight_saving(spark):
    days = spark.sql("SELECT explode(array(date'2025-03-07', date'2025-03-10', date'2024-11-29')) AS date")
    w = {str(r["date"]): r for r in cal.session_windows(days).withColumn("h", F.hour("open_utc")).collect()}
    assert (w["2025-03-07"]["h"], w["2025-03-10"]["h"]) == (14, 13)
    assert w["2024-11-29"]["minutes"] == 210 and w["2025-03-10"]["minutes"] == 390


def test_unknown_market_is_refused():
    with pytest.raises(cal.UnknownMarket):
        cal.calendar_code("JP_EQUITY")


def test_clean_daily_data_is_silent(spark):
    s = DailySessions(daily(spark, clean_rows()), "d")
    assert s.gaps().count() == 0
    st = s.statistics().first()
    assert st["expected_sessions"] == st["observed_sessions"] == len(session_days())


def test_planted_session_defects(spark):
    rows = {k: v for k, v in clean_rows().items() if k[1] != date(2024, 12, 12)}
    rows["AAA", date(2024, 11, 28)] = ("AAA", date(2024, 11, 28), 1.0, 1.0, 1.0, 1.0, 5e6)
    for d in (14, 15, 16):
        del rows["AAA", date(2025, 1, d)]
    for d in (10, 11):
        del rows["ILL", date(2025, 2, d)]
    g = found(DailySessions(daily(spark, rows), "d").gaps())
    assert [x["start"] for x in g["MISSING_SESSION_MARKETWIDE"]] == ["2024-12-12"]
    assert [x["start"] for x in g["DATA_ON_NON_TRADING_DAY"]] == ["2024-11-28"]
    (liq,) = g["MISSING_SESSION_LIQUID"]
    assert (liq["ticker"], liq["n"], liq["severity"]) == ("AAA", 3, "MATERIAL")
    (amb,) = g["NO_TRADE_OR_MISSING"]
    assert (amb["ticker"], amb["n"], amb["severity"]) == ("ILL", 2, "AMBIGUOUS")


def test_market_outage_splits_a_ticker_run(spark):
    rows = {k: v for k, v in clean_rows().items() if k[1] != date(2025, 1, 15)}
    for d in (14, 16):
        del rows["AAA", date(2025, 1, d)]
    g = found(DailySessions(daily(spark, rows), "d").gaps())
    assert sorted((x["start"], x["n"]) for x in g["MISSING_SESSION_LIQUID"]) == [("2025-01-14", 1), ("2025-01-16", 1)]


def test_closed_day_bar_does_not_split_a_run(spark):
    rows = clean_rows()
    for d in (10, 13):
        del rows["AAA", date(2025, 1, d)]
    rows["AAA", date(2025, 1, 11)] = ("AAA", date(2025, 1, 11), 1.0, 1.0, 1.0, 1.0, 5e6)
    g = found(DailySessions(daily(spark, rows), "d").ticker_gaps())
    assert [(x["start"], x["end"], x["n"]) for x in g["MISSING_SESSION_LIQUID"]] == [("2025-01-10", "2025-01-13", 2)]


def test_listing_checks(spark):
    rows = {k: v for k, v in clean_rows().items() if not (k[0] == "BBB" and k[1] > date(2025, 2, 14))}
    master = spark.createDataFrame(
        [("AAA", date(2024, 8, 1), date(2025, 3, 1), None), ("BBB", None, date(2025, 3, 14), None), ("ILL", date(2024, 12, 2), None, None)], SECURITY_MASTER
    )
    g = found(DailySessions(daily(spark, rows), "d").listing_gaps(master))
    (tail,) = g["MISSING_TAIL"]
    assert tail["ticker"] == "BBB" and tail["n"] == len([d for d in session_days() if date(2025, 2, 14) < d <= date(2025, 3, 14)])
    assert [x["ticker"] for x in g["BARS_BEFORE_LISTING"]] == ["ILL"]
    assert [x["ticker"] for x in g["BARS_AFTER_DELISTING"]] == ["AAA"]
    assert "MISSING_HEAD" not in g  # sessions before the first observed date are unknown


def test_duplicates(spark):
    rows = list(clean_rows().values())
    base = spark.createDataFrame(rows, DAILY_BARS)
    assert check_duplicates(base, ["ticker", "date"], "d").count() == 0
    exact = base.union(spark.createDataFrame([rows[5]], DAILY_BARS))
    assert [(r["kind"], r["n"]) for r in check_duplicates(exact, ["ticker", "date"], "d").collect()] == [("EXACT_DUPLICATES", 2)]
    other = rows[5][:5] + (None,) + rows[5][6:]
    clash = base.union(spark.createDataFrame([other], DAILY_BARS))
    (c,) = check_duplicates(clash, ["ticker", "date"], "d").collect()
    assert c["kind"] == "CONFLICTING_DUPLICATES" and c["severity"] == "MATERIAL"


def test_stale_daily(spark):
    rows = clean_rows()
    assert check_stale_daily(daily(spark, rows), "d").count() == 0
    for d in range(6, 11):
        k = ("AAA", date(2025, 1, d))
        if k in rows:
            rows[k] = ("AAA", k[1], 123.0, 123.0, 123.0, 123.0, 5e6)
    for d in (3, 4, 5, 6, 7):
        k = ("BBB", date(2025, 2, d))
        rows[k] = ("BBB", k[1], 50.0, 50.0, 50.0, 50.0, 5e6)
    g = found(check_stale_daily(daily(spark, rows), "d"))
    assert [(x["ticker"], x["n"]) for x in sorted(g["STALE_DAILY_PRICES"], key=lambda x: x["ticker"])] == [("AAA", 4), ("BBB", 5)]


def minute_rows(tk, first, n, vol=2000.0, drop=()):
    return [(tk, first + timedelta(minutes=i), 100 + i * 0.01, 100.5 + i * 0.01, 99.5, 100.005 + i * 0.01, vol) for i in range(n) if i not in drop]


@pytest.mark.parametrize("first,n", [(datetime(2025, 3, 7, 14, 30), 390), (datetime(2025, 3, 10, 13, 30), 390), (datetime(2024, 11, 29, 14, 30), 210)])
def test_clean_minutes(spark, first, n):
    m = MinuteBars(spark.createDataFrame(minute_rows("AAA", first - timedelta(minutes=30), n + 30), MINUTE_BARS), "m")
    assert m.gaps().count() == 0
    st = m.statistics().first()
    assert (st["regular_expected"], st["regular_observed"], st["extended_hours_bars"]) == (n, n, 30)


def test_planted_minute_defects(spark):
    rows = minute_rows("AAA", datetime(2025, 3, 10, 13, 30), 390, drop=range(100, 110))
    rows += [rows[50], rows[60][:5] + (1.0,) + rows[60][6:]]
    rows[5] = (rows[5][0], rows[5][1] + timedelta(seconds=17)) + rows[5][2:]
    rows += minute_rows("ILL", datetime(2025, 3, 10, 13, 30), 390, vol=1.0, drop=range(100, 110))
    g = found(MinuteBars(spark.createDataFrame(rows, MINUTE_BARS), "m").gaps())
    assert ("AAA", 10) in [(x["ticker"], x["n"]) for x in g["MISSING_MINUTES_LIQUID"]]
    assert g["TIMESTAMP_MISALIGNED"][0]["n"] == 1
    assert [(x["kind"], x["n"]) for x in g["CONFLICTING_DUPLICATE_BARS"]] == [("CONFLICTING_DUPLICATE_BARS", 4)]
    jumps = {(x["ticker"], x["n"], x["severity"]) for x in g["INTRASESSION_TIMESTAMP_GAP"]}
    assert jumps == {("AAA", 11, "MATERIAL"), ("ILL", 11, "AMBIGUOUS")}
    assert [x["start"] for x in g["NO_TRADE_OR_MISSING_MINUTES"]] == ["2025-03-10T15:10:00+00:00"]


def test_stale_minutes_and_naive_timestamps(spark):
    rows = minute_rows("AAA", datetime(2025, 3, 10, 13, 30), 390)
    rows = [(r[0], r[1], 7.0, 7.0, 7.0, 7.0, r[6]) if 20 <= i < 35 else r for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, MINUTE_BARS)
    g = found(MinuteBars(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "m").gaps())
    assert g["STALE_MINUTE_PRICES"][0]["n"] == 14
    assert g["NAIVE_TIMESTAMPS"][0]["n"] == 390


def test_news_defects(spark):
    days = [d for d in session_days() if date(2025, 1, 2) <= d <= date(2025, 3, 28)]
    rows = [(f"id{i}-{k}", f"{d}T15:0{k}:07Z", f"Unique headline number {i} {k} about a company", "Pub", '["AAA"]') for i, d in enumerate(days) for k in range(6)]
    cols = "id string, published_utc string, title string, publisher_name string, tickers string"
    clean = spark.createDataFrame(rows, cols).withColumn("vendor_receipt_ts", F.current_timestamp()).withColumn("system_receipt_ts", F.current_timestamp())
    assert News(clean, "n", "2025-04-01T00:00:00Z").gaps().count() == 0
    hole = str(date(2025, 2, 18))
    rows = [r for r in rows if not r[1].startswith(hole)]
    rows[0] = (rows[0][0], None) + rows[0][2:]
    rows[1] = (rows[1][0], "garbage") + rows[1][2:]
    rows[2] = (rows[2][0], "2025-02-03T14:00:00") + rows[2][2:]
    rows[3] = (rows[3][0], "2026-01-01T00:00:00Z") + rows[3][2:]
    rows[4] = (rows[5][0],) + rows[4][1:]
    rows[6] = rows[6][:2] + ("Big merger announced between two firms today", "Pub", '["AAA"]')
    rows[7] = rows[7][:2] + ("BIG merger announced, between two firms today!", "Other", "[]")
    g = found(News(spark.createDataFrame(rows, cols), "n", "2025-04-01T00:00:00Z").gaps())
    assert g["MISSING_OR_UNPARSEABLE_TIMESTAMP"][0]["n"] == 2
    assert g["TIMEZONE_MISSING"][0]["n"] == 1 and g["PUBLISHED_AFTER_RETRIEVAL"][0]["n"] == 1
    assert g["NEWS_COVERAGE_GAP"][0]["start"] == hole and g["SYNDICATED_ARTICLES"][0]["n"] == 1
    assert g["NO_TICKER_MAPPING"][0]["n"] == 1 and g["CONFLICTING_DUPLICATES"][0]["n"] == 2
    assert {"NO_VENDOR_RECEIPT_TS", "NO_SYSTEM_RECEIPT_TS"} <= set(g)


def test_corporate_actions(spark):
    rows = clean_rows(("AAA", "BBB", "CCC", "DDD"))

    def scale(tk, when, f, only=False):
        for k, v in rows.items():
            if k[0] == tk and (k[1] == when if only else k[1] >= when):
                rows[k] = v[:2] + tuple(x * f for x in v[2:6]) + v[6:]

    scale("AAA", date(2024, 12, 10), 1 / 10)
    scale("CCC", date(2025, 1, 15), 1 / 4)
    scale("DDD", date(2025, 2, 5), 0.55, only=True)
    splits = spark.createDataFrame([("AAA", date(2024, 12, 10), 1.0, 10.0), ("BBB", date(2025, 2, 3), 1.0, 2.0), ("BBB", date(2030, 1, 1), 1.0, 2.0)], SPLITS)
    c = CorporateActions(daily(spark, rows), splits, "d")
    st = c.statistics().first()
    assert (st["splits_confirmed_in_prices"], st["splits_without_discontinuity"], st["recorded_splits"]) == (1, 1, 3)
    g = found(c.gaps(spark.createDataFrame([("DDD", None, date(2025, 3, 20), None)], SECURITY_MASTER)))
    assert [x["ticker"] for x in g["SPLIT_WITHOUT_DISCONTINUITY"]] == ["BBB"] == [x["ticker"] for x in g["SPLIT_NO_PRICE_DATA"]]
    assert "CCC" in [x["ticker"] for x in g["UNRECORDED_SPLIT_LIKE_DISCONTINUITY"]]
    assert [x["ticker"] for x in g["DELISTING_RETURN_UNKNOWN"]] == ["DDD"]
    assert not any(x["ticker"] == "AAA" for v in g.values() for x in v)


def test_gate_opens_only_after_exclusion(spark):
    rows = {k: v for k, v in clean_rows().items() if k[1] != date(2024, 12, 12)}
    gaps = DailySessions(daily(spark, rows), "d").gaps()
    led = ledger.merge(gaps.unionByName(gaps))
    assert led.count() == 1
    req = spark.createDataFrame([("exp1", ["US_EQUITY"], ["daily"]), ("exp2", ["US_EQUITY"], ["daily"])], "experiment string, markets array<string>, needs array<string>")
    cov = spark.createDataFrame([("daily", True, None)], "need string, complete boolean, note string")
    done = spark.createDataFrame([(c,) for c in ledger.REQUIRED_CHECKS], "check string")
    shut = ledger.gate_reasons(req, cov, done, led)
    assert {r["reason"] for r in shut.collect()} == {"OPEN_MATERIAL_GAP"}
    gid = led.first()["gap_id"]
    with pytest.raises(ValueError):
        ledger.exclude(spark, 1, gid, [], "why")
    after = ledger.apply_transitions(led, ledger.exclude(spark, 1, gid, ["exp1"], "provider outage"))
    state = {r["experiment"]: r["open"] for r in ledger.gate(req, ledger.gate_reasons(req, cov, done, after)).collect()}
    assert state == {"exp1": True, "exp2": False}


def test_gate_reports_coverage_and_checks(spark):
    req = spark.createDataFrame([("e", ["US_EQUITY", "XX"], ["daily", "news"])], "experiment string, markets array<string>, needs array<string>")
    cov = spark.createDataFrame([("daily", False, "sample only")], "need string, complete boolean, note string")
    done = spark.createDataFrame([("calendar",)], "check string")
    none = DailySessions(daily(spark, clean_rows()), "d").gaps()
    r = {(x["reason"], x["subject"]) for x in ledger.gate_reasons(req, cov, done, none).collect()}
    assert {("UNREGISTERED_MARKET", "XX"), ("COVERAGE_INCOMPLETE", "daily: sample only"), ("DATASET_NOT_INGESTED", "news"), ("CHECK_NOT_RUN", "minute_bars")} <= r
