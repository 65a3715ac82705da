"""Building blocks of the gap ledger: rows with a deterministic id, and run grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import EXPECTED, OPEN, RESOLVED

GAP_COLUMNS = (
    "dataset_id", "check", "kind", "severity", "detail", "ticker", "start", "end", "n",
    "status", "resolution", "excluded_from", "gap_id",
)


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def gap_id(dataset_id: Column, check: Column, kind: Column, ticker: Column, start: Column, end: Column) -> Column:
    """First 12 hex digits of the sha1 of the identifying fields; a missing field reads ``None``."""
    parts = [F.coalesce(c, F.lit("None")) for c in (dataset_id, check, kind, ticker, start, end)]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)


def as_gaps(df: DataFrame, dataset_id: str, check, kind, severity, detail, ticker=None, start=None, end=None, n=1) -> DataFrame:
    """One ledger row per input row. Every argument may be a literal or a column."""
    check, kind, severity = _col(check), _col(kind), _col(severity)
    none = F.lit(None).cast("string")
    ticker = none if ticker is None else ticker
    start = none if start is None else _col(start).cast("string")
    end = none if end is None else _col(end).cast("string")
    ds = F.lit(dataset_id)
    return df.select(
        ds.alias("dataset_id"),
        check.alias("check"),
        kind.alias("kind"),
        severity.alias("severity"),
        _col(detail).alias("detail"),
        ticker.alias("ticker"),
        start.alias("start"),
        end.alias("end"),
        _col(n).cast("long").alias("n"),
        F.when(severity == EXPECTED, F.lit(RESOLVED)).otherwise(F.lit(OPEN)).alias("status"),
        F.lit("").alias("resolution"),
        F.array().cast("array<string>").alias("excluded_from"),
        gap_id(ds, check, kind, ticker, start, end).alias("gap_id"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text of an instant in UTC, with a fraction only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.when(F.unix_micros(ts) % 1000000 != 0, F.date_format(ts, ".SSSSSS")).otherwise(F.lit(""))
    return F.concat(whole, frac, F.lit("+00:00"))
