"""Streaming forms of the bar checks. Each takes a streaming DataFrame and returns one.

A row without an instant has no place before or after a watermark: the checks leave it out, and ``undated`` returns it. A row
without a ticker belongs to the ticker NULL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import EXCHANGE_TZ, MATERIAL
from ..operators import ledger
from ..operators.gaps import as_gaps, iso_utc


def undated(rows: DataFrame) -> DataFrame:
    """Rows without an instant; stateless."""
    return rows.where("ts IS NULL")


def _dated(rows: DataFrame, lateness: str) -> DataFrame:
    return rows.where("ts IS NOT NULL").withWatermark("ts", lateness)


def minute_bars(trades: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """OHLCV minute bars of trades (ticker, ts, price, size, seq), emitted when the watermark passes a minute."""
    order = F.struct("ts", "seq")
    x = _dated(trades, lateness).groupBy(F.window("ts", "1 minute"), "ticker").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("size").alias("volume"),
    )
    return x.select("ticker", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def first_bars(bars: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Drops repeats of (ticker, ts) within the watermark; state is bounded by it."""
    return _dated(bars, lateness).dropDuplicatesWithinWatermark(["ticker", "ts"])


def duplicate_counts(bars: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Repeated instants per ticker, with a conflict mark, in append mode; two instants of one minute are no duplicates."""
    x = _dated(bars, lateness).groupBy("ticker", "ts").agg(
        F.count("*").alias("n"), *[f(c).alias(f"{c}_{k}") for c in ("open", "high", "low", "close", "volume") for k, f in (("lo", F.min), ("hi", F.max))]
    )
    conflict = F.lit(False)
    for c in ("open", "high", "low", "close", "volume"):
        conflict = conflict | (F.col(f"{c}_lo") != F.col(f"{c}_hi"))
    return x.where("n > 1").select("ticker", "ts", "n", conflict.alias("conflict"))


def gap_alerts(bars: DataFrame, max_gap_minutes: int = 5, lateness: str = "10 minutes") -> DataFrame:
    """(ticker, session, start, end, minutes) for pauses between consecutive bars of a session.

    Timestamps are held until the watermark has passed them, so a late bar within ``lateness`` still closes a pause. State per
    (ticker, exchange session) is the last settled timestamp and those not yet passed; it ends when the watermark leaves the day.
    """
    us = max_gap_minutes * 60_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, [])
        new = [] if state.hasTimedOut else [pdf["us"].to_numpy(np.int64) for pdf in batches]
        stamps = np.unique(np.concatenate([np.asarray(held, np.int64), *new]))
        mark = state.getCurrentWatermarkMs()
        settled, open_ = stamps[stamps <= mark * 1000], stamps[stamps > mark * 1000]
        chain = settled if last is None else np.concatenate([[last], settled[settled > last]])
        at = np.flatnonzero(np.diff(chain) > us)
        last = int(chain[-1]) if len(chain) else None
        # the last bar is kept until the watermark leaves the exchange's day: the next one may come after a long pause
        day = pd.Timestamp(key[1]).tz_localize(EXCHANGE_TZ) + pd.DateOffset(days=1)
        over = int(day.timestamp() * 1000)
        if len(open_) or mark < over:
            state.update((last, open_.tolist()))
            state.setTimeoutTimestamp(max(mark, int(open_[-1]) // 1000) + 1 if len(open_) else over)
        elif state.exists:
            state.remove()
        if len(at):
            start, end = chain[at], chain[at + 1]
            yield pd.DataFrame({"ticker": key[0], "session": key[1], "start_us": start, "end_us": end, "minutes": (end - start) // 60_000_000})

    keyed = _dated(bars, lateness).select(
        "ticker", "ts", F.date_format(F.from_utc_timestamp("ts", EXCHANGE_TZ), "yyyy-MM-dd").alias("session"), F.unix_micros("ts").alias("us")
    )
    return keyed.groupBy("ticker", "session").applyInPandasWithState(
        step, "ticker string, session string, start_us long, end_us long, minutes long", "last long, held array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def trading_spells(bars: DataFrame, pause_minutes: int = 5, lateness: str = "10 minutes") -> DataFrame:
    """(ticker, start, end, bars): spells of bars without a pause of more than ``pause_minutes``, first and last bar, in append mode.

    A spell is emitted once the watermark has passed its last bar by the pause; a late bar may join two spells before.
    """
    x = _dated(bars, lateness).groupBy(F.session_window("ts", f"{pause_minutes} minutes").alias("w"), "ticker").agg(F.count("*").alias("bars"))
    return x.select("ticker", F.col("w.start").alias("start"), (F.col("w.end") - F.expr(f"interval {pause_minutes} minutes")).alias("end"), "bars")


def signal_latency(publications: DataFrame, signals: DataFrame, before: str = "5 minutes", after: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """(event_id, ticker, latency_s, zero_latency) of signals from ``before`` to ``after`` around the publication of their event.

    A join of two streams, publications(event_id, publication_ts) and signals(event_id, ticker, signal_ts); the interval lets both
    sides forget rows that the watermarks have passed. Several signals of an event are several rows.
    """
    p = publications.where("publication_ts IS NOT NULL").withWatermark("publication_ts", lateness).alias("p")
    s = signals.where("signal_ts IS NOT NULL").withWatermark("signal_ts", lateness).alias("s")
    near = F.expr(f"s.event_id = p.event_id AND s.signal_ts >= p.publication_ts - interval {before} AND s.signal_ts <= p.publication_ts + interval {after}")
    latency = (F.unix_micros("s.signal_ts") - F.unix_micros("p.publication_ts")) / 1_000_000
    return s.join(p, near).select("s.event_id", "s.ticker", latency.alias("latency_s"), (latency <= 0).alias("zero_latency"))


def late_signals(signals: DataFrame) -> DataFrame:
    """Signals that precede their publication or break the life-cycle order; stateless."""
    bad = F.col("signal_ts") <= F.col("publication_ts")
    return signals.where(bad | (F.col("event_ts") > F.col("publication_ts"))).select("event_id", "ticker", "publication_ts", "signal_ts", bad.alias("zero_latency"))


def late_signal_gaps(signals: DataFrame, dataset_id: str) -> DataFrame:
    """The same signals as ledger rows, named by ticker, publication and signal instant; stateless."""
    c = F.col
    kind = F.when(c("zero_latency"), F.lit("ZERO_LATENCY_SIGNAL")).otherwise(F.lit("EVENT_AFTER_PUBLICATION"))
    detail = F.format_string("signal at %s, publication at %s", iso_utc(c("signal_ts")), iso_utc(c("publication_ts")))
    return as_gaps(late_signals(signals), dataset_id, "signal_times", kind, MATERIAL, detail, c("ticker"), iso_utc(c("publication_ts")), iso_utc(c("signal_ts")))


def ledger_sink(path: str):
    """foreachBatch writer of a ledger that holds every gap id once, whatever is replayed.

    A batch owns the folder of its number, which a replay overwrites, so a batch that was cut off while writing
    leaves nothing behind; it appends only the ids that no batch before it has.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        try:
            have = batch.sparkSession.read.schema(T.StructType([*batch.schema, T.StructField("batch_id", T.LongType())])).parquet(path)
            have = have.where(F.col("batch_id") < batch_id)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # only the first batch may find no ledger
                raise
            have = None
        ledger.merge(batch, existing=have).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write
