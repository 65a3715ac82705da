"""Rows and texts that are easy to get wrong: odd time forms, days outside the calendar, repeated gaps, bad splits."""

import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from barcheck.functions.noise import gaussian
from barcheck.functions.text import iso_instant
from barcheck.operators import calendar as cal, ledger, panel as pan, signals
from barcheck.operators.corporate import CorporateActions
from barcheck.operators.gaps import GAP_COLUMNS, as_gaps
from barcheck.streaming import checks


@pytest.mark.parametrize(
    ("text", "utc"),
    [
        ("2024-01-01T10:00Z", (10, 0, 0, 0)),
        ("2024-01-01T10Z", (10, 0, 0, 0)),
        ("2024-01-01T1030Z", (10, 30, 0, 0)),
        ("2024-01-01T103015Z", (10, 30, 15, 0)),
        ("2024-01-01 10:30:15,5Z", (10, 30, 15, 500_000)),
        ("2024-01-01T10:30:15.25+02:00", (8, 30, 15, 250_000)),
        ("2024-01-01T10:30+0230", (8, 0, 0, 0)),
        ("2024-01-01T10:30-05", (15, 30, 0, 0)),
        ("2024-01-01T25:00Z", None),
        ("yesterday", None),
        (None, None),
    ],
)
def test_time_forms(spark, text, utc):
    x = spark.createDataFrame([(text,)], "s string").select(F.unix_micros(iso_instant(F.col("s"))).alias("u")).first()["u"]
    want = None if utc is None else int(datetime(2024, 1, 1, *utc, tzinfo=timezone.utc).timestamp() * 1e6 + 0.5)
    assert x == want


def test_days_outside_the_verified_years_are_unknown(spark):
    days = [date(1969, 7, 4), date(1972, 12, 28), date(1980, 11, 4), date(2101, 12, 26), date(1969, 7, 5), date(2024, 7, 4)]
    got = {r["date"]: r["kind"] for r in cal.with_kind(spark.createDataFrame([(d,) for d in days], "date date")).collect()}
    assert [got[d] for d in days] == ["UNKNOWN"] * 4 + ["WEEKEND", "HOLIDAY"]


def test_the_first_row_of_a_gap_stays(spark):
    x = spark.createDataFrame([(1, "MATERIAL", 9), (2, "AMBIGUOUS", 1)], "place int, sev string, k int")
    gaps = as_gaps(x, "d", "c", "KIND", F.col("sev"), F.lit("x"), n=F.col("k"))
    placed = gaps.withColumn("place", F.when(F.col("severity") == "MATERIAL", 1).otherwise(2))
    for rows in (ledger.merge(placed.orderBy("n"), F.col("place")), ledger.merge(gaps.coalesce(1))):
        r = rows.first()
        assert (rows.count(), r["severity"], r["n"]) == (1, "MATERIAL", 9)
    assert set(rows.columns) <= set(GAP_COLUMNS)


def test_a_split_from_zero_is_a_gap_and_no_crash(spark):
    bars = spark.createDataFrame([("A", date(2024, 1, d), 10.0, 10.0) for d in (2, 3, 4)] + [(None, date(2024, 1, 2), 1.0, 1.0)], "ticker string, date date, open double, close double")
    splits = spark.createDataFrame([("A", date(2024, 1, 3), 0.0, 2.0)], "ticker string, execution_date date, split_from double, split_to double")
    r = CorporateActions(bars, splits, "d").split_status().first()
    assert (r["bars"], r["hit"]) == (3, False)


def test_noise_is_the_recursion_over_the_whole_history(spark):
    cells = spark.range(23).select(F.col("id").cast("int").alias("t"), F.lit("A").alias("ticker"))
    e = [r["e"] for r in cells.select("t", (gaussian("noise", F.lit(0), F.col("ticker"), F.col("t")) * 0.25).alias("e")).orderBy("t").collect()]
    want, x = [], 0.0
    for v in e:
        x = 0.9 * x + v
        want.append(x)
    panel = cells.withColumn("alive", F.lit(True))
    got = [r["score"] for r in signals.noise_scores(panel, 1, phi=0.9, chunk=5).orderBy("t").collect()]
    assert got == pytest.approx(want)


def test_a_late_bar_closes_a_pause(spark, tmp_path):
    """Bars at 15:00 and 15:08, then 15:04 within the lateness, then a later day: no pause exceeds five minutes."""
    path = str(tmp_path / "in")
    for stamps in (["15:00", "15:08"], ["15:04", "15:09"], []):
        rows = [("A", f"2024-03-05 {s}:00") for s in stamps] or [("Z", "2024-03-06 15:00:00"), ("Z", "2024-03-06 15:00:00")]
        spark.createDataFrame(rows, "ticker string, s string").select("ticker", F.to_timestamp("s").alias("ts")).coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema("ticker string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    q = checks.gap_alerts(src, 3).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r["ticker"], r["minutes"]) for r in spark.read.schema("ticker string, session string, start_us long, end_us long, minutes long").parquet(out).orderBy("start_us").collect()]
    assert got == [("A", 4), ("A", 4)]


def run_in_batches(spark, tmp_path, build, batches):
    """The query stops after each batch and goes on from its checkpoint."""
    for rows in batches:
        x = spark.createDataFrame(rows, "ticker string, s string, price double").select("ticker", F.to_timestamp("s").alias("ts"), *[F.col("price").alias(c) for c in ("open", "high", "low", "close", "volume")])
        x.repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        out = build(spark.readStream.schema(x.schema).parquet(str(tmp_path / "in")))
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out"))


def test_a_pause_longer_than_the_lateness_is_found(spark, tmp_path):
    """A rests for two hours of its session while B and rows without a ticker go on. A row without an instant changes nothing, nor
    does the bar at 15:01, which comes when the watermark is at 16:20: Spark drops it before the state sees it."""
    day = "2024-03-05 "
    batches = [
        [("A", day + "15:00:00", 1.0), ("B", day + "15:00:00", 1.0), (None, day + "15:00:00", 1.0), ("A", None, 1.0)],
        [("B", day + "16:30:00", 1.0)],
        [("A", day + "17:00:00", 1.0), (None, day + "15:01:00", 1.0), (None, day + "17:10:00", 1.0)],
        [("Z", "2024-03-07 15:00:00", 1.0)],
        [("Z", "2024-03-07 15:00:00", 1.0)],
    ]
    got = run_in_batches(spark, tmp_path, lambda b: checks.gap_alerts(b, 5), batches)
    assert sorted((str(r["ticker"]), r["session"], r["minutes"]) for r in got.collect()) == [("A", "2024-03-05", 120), ("B", "2024-03-05", 90), ("None", "2024-03-05", 130)]


def test_streams_keep_rows_without_a_ticker(spark, tmp_path):
    batches = [[(None, "2024-03-05 15:00:00", 1.0), (None, "2024-03-05 15:00:00", 2.0), ("A", "2024-03-05 15:00:00", 1.0), ("A", None, 1.0)], [("Z", "2024-03-06 15:00:00", 1.0)]]
    got = run_in_batches(spark, tmp_path, checks.duplicate_counts, batches).collect()
    assert [(r["ticker"], r["n"], r["conflict"]) for r in got] == [(None, 2, True)]
    (lost,) = checks.undated(spark.read.parquet(str(tmp_path / "in"))).collect()
    assert lost["ticker"] == "A"


def test_excluded_cells_against_every_gap_and_cell(spark):
    """Nested, touching, repeated, reversed and open gaps, gaps for every name, over years; instants within a day and NULLs."""
    rnd = random.Random(9)
    text = lambda d: (date(2019, 12, 1) + timedelta(days=d)).isoformat()
    gaps = []
    for _ in range(40):
        a = rnd.randrange(800)
        gaps.append((rnd.choice(["A", "B", "C", None]) if rnd.random() < 0.9 else None, text(a), rnd.choice([text(a + rnd.randrange(-3, 25)), text(a) + "T10:00:00", None])))
    gaps += [("A", text(20), text(700)), ("A", text(20), text(700)), ("B", text(5), text(9)), ("B", text(10), text(12)), ("B", None, text(3))]
    cells = [(i, rnd.choice(["A", "B", "C", "D", None]), f"{text(rnd.randrange(830))} {rnd.randrange(10, 20)}:00:00") for i in range(300)] + [(300, "A", None)]
    df = spark.createDataFrame(cells, "t int, ticker string, s string").select("t", "ticker", F.to_timestamp("s").alias("ts"), (F.col("t") == 7).alias("excluded"))
    led = spark.createDataFrame(gaps, 'ticker string, start string, end string')
    got = {r["t"]: r["excluded"] for r in pan.exclude_cells(df, led).collect()}
    want = {t: t == 7 or any(a and s and (g is None or g == k) and a <= s[:10] <= (b or a)[:10] for g, a, b in gaps) for t, k, s in cells}
    assert got == want
    assert {r["t"] for r in pan.exclude_cells(df, led.where("false")).where("excluded").collect()} == {7}


def test_spells_join_over_late_bars_and_latencies_stay_in_their_interval(spark, tmp_path):
    """A late bar at 15:08 makes one spell of two; the pause of exactly five minutes does not end a spell."""
    day = "2024-03-05 "
    batches = [
        [("A", day + "15:00:00", 1.0), ("A", day + "15:05:00", 1.0), ("A", day + "15:12:00", 1.0), ("B", day + "15:00:00", 1.0), ("B", None, 1.0)],
        [("A", day + "15:08:00", 1.0), ("A", day + "15:18:00", 1.0), (None, day + "15:18:00", 1.0)],
        [("Z", "2024-03-06 15:00:00", 1.0)],
    ]
    got = run_in_batches(spark, tmp_path, lambda b: checks.trading_spells(b, 5), batches)
    assert sorted((str(r["ticker"]), r["start"].minute, r["end"].minute, r["bars"]) for r in got.collect()) == [("A", 0, 12, 4), ("A", 18, 18, 1), ("B", 0, 0, 1), ("None", 18, 18, 1)]
