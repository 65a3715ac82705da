"""Panel validators and point-in-time audits. Each returns finding rows (check, severity, n, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import SIGNAL_CHAIN
from ..functions.shape import previous_row
from ..session import cut_lineage
from .gaps import union_all


def finding(df: DataFrame, check: str | Column, severity: str, n: Column, detail: str) -> DataFrame:
    """Finding row of a one-row count relation, absent when the count is 0."""
    check = check if isinstance(check, Column) else F.lit(check)
    x = df.select(check.alias("check"), F.lit(severity).alias("severity"), n.cast("long").alias("n"))
    return x.where("n > 0").withColumn("detail", F.format_string(detail, "n"))


def timestamp_findings(stream: DataFrame, pos: str, ts: str = "ts", block: int = 1_000_000, unique_bars: bool = True) -> DataFrame:
    """Arrival order and uniqueness. ``pos`` is the unique integer ingest position; neighbours are found block-wise."""
    x = previous_row(stream.select(pos, ts), [], [pos], [ts], F.floor(F.col(pos) / F.lit(block)))
    back = x.agg(F.count_if(F.col(ts) < F.col(f"prev_{ts}")).alias("n"))
    out = finding(back, "timestamps_monotonic", "FAIL", F.col("n"), "%d timestamps step back")
    if unique_bars:
        rep = stream.groupBy(ts).agg((F.count("*") - 1).alias("k")).agg(F.sum("k").alias("n"))
        out = out.unionByName(finding(rep, "timestamps_unique", "FAIL", F.col("n"), "%d repeated timestamps"))
    return out


def grid_findings(panel: DataFrame) -> DataFrame:
    """Cells absent from or repeated in the (t, ticker) grid. Counts only, no grid is built."""
    c = panel.agg(
        F.count("*").alias("rows"), F.countDistinct("t", "ticker").alias("cells"), F.countDistinct("t").alias("T"), F.countDistinct("ticker").alias("N")
    )
    wrong = F.abs(F.col("T") * F.col("N") - F.col("cells")) + (F.col("rows") - F.col("cells"))
    return finding(c, "shape", "FAIL", wrong, "%d cells are absent or repeated")


def cell_findings(panel: DataFrame, max_gap_ret: float = 0.6, stale_run: int = 5) -> DataFrame:
    """OHLC order, prices <= 0, missing prices, extreme moves, stale runs and listing intervals of a panel.

    Row checks and neighbour checks share one window pass per ticker; a ticker has one row per bar index.
    """
    w = Window.partitionBy("ticker").orderBy("t")
    nxt = lambda c: F.when(F.lag("t").over(w) == F.col("t") - 1, F.lag(c).over(w))
    p = panel.select("t", "ticker", "open", "high", "low", "close", "alive").withColumn("pc", nxt("close")).withColumn("pa", nxt("alive"))
    o, h, l, c, alive = (F.col(x) for x in ("open", "high", "low", "close", "alive"))
    no = lambda x: F.coalesce(x, F.lit(False))
    both = o.isNotNull() & c.isNotNull()
    ohlc = alive & both & (no(h < F.greatest(o, c) - 1e-9) | no(l > F.least(o, c) + 1e-9))
    move = F.abs(c / F.nullif(F.col("pc"), F.lit(0.0)) - 1)
    p = p.withColumn("flat", no((c == F.col("pc")) & alive)).withColumn("born", no(alive & ~F.col("pa")))
    counts = p.agg(
        F.count_if(ohlc).alias("ohlc"),
        F.count_if(alive & no(c <= 0)).alias("nonpos"),
        F.count_if(alive & c.isNull()).alias("missing"),
        F.count_if(no(move > max_gap_ret) & alive & no(F.col("pa"))).alias("jumps"),
    )
    runs = p.withColumn("g", F.sum(F.when(F.col("flat"), 0).otherwise(1)).over(w))
    per_run = runs.groupBy("ticker", "g").agg(F.count_if("flat").alias("run"), F.count_if("born").alias("born"))
    per_ticker = per_run.groupBy("ticker").agg(F.max("run").alias("run"), F.sum("born").alias("born"))
    t = per_ticker.agg(F.count_if(F.col("run") >= stale_run).alias("stale"), F.count_if(F.col("born") > 1).alias("relisted"))
    return union_all([
        finding(counts, "ohlc_consistency", "FAIL", F.col("ohlc"), "%d bars whose open or close lies outside their low and high"),
        finding(counts, "nonpositive_price", "FAIL", F.col("nonpos"), "%d closes at or below 0"),
        finding(counts, "missing_alive", "WARN", F.col("missing"), "%d listed bars without a price"),
        finding(counts, "bad_ticks_or_unadjusted_splits", "WARN", F.col("jumps"), "%d extreme close-to-close moves"),
        finding(t, "stale_prices", "WARN", F.col("stale"), "%d tickers with long runs of one close"),
        finding(t, "alive_gaps", "WARN", F.col("relisted"), "%d tickers with several listing intervals"),
    ])


def universe_violations(universe: DataFrame, master: DataFrame) -> DataFrame:
    """(check, date, ticker): members before listing, after delisting, or with no known listing."""
    m = master.select("ticker", "list_date", "delist_date")
    x = universe.join(m, "ticker", "left")
    listing = F.when(F.col("list_date").isNull(), F.lit("universe_unknown_listing")).when(F.col("list_date") > F.col("date"), F.lit("universe_leakage"))
    gone = F.when(F.col("delist_date") < F.col("date"), F.lit("universe_survivorship"))
    return x.select(F.explode(F.array_compact(F.array(listing, gone))).alias("check"), "date", "ticker")


def survivorship(panel_tickers: DataFrame, master: DataFrame, limit: float = 0.02) -> DataFrame:
    """Delisted names of the master that the panel lacks; a finding when their share exceeds the limit."""
    dead = master.where("delist_date IS NOT NULL").select("ticker").distinct()
    have = panel_tickers.select("ticker").distinct().withColumn("have", F.lit(True))
    c = dead.join(have, "ticker", "left").agg(F.count("*").alias("delisted"), F.count_if(F.col("have").isNull()).alias("n"))
    c = c.withColumn("share", F.col("n") / F.greatest(F.col("delisted"), F.lit(1)))
    return c.where(F.col("share") > limit).select(
        F.lit("survivorship_bias").alias("check"), F.lit("FAIL").alias("severity"), F.col("n").cast("long"),
        F.format_string("%d of %d delisted names are absent", "n", "delisted").alias("detail"),
    )


def signal_time_findings(signals: DataFrame) -> DataFrame:
    """Life-cycle order of signals and zero latency, for the columns that exist; one scan."""
    cols = [c for c in SIGNAL_CHAIN if c in signals.columns]
    pairs = list(zip(cols[:-1], cols[1:]))
    aggs = [F.count_if(F.col(a) > F.col(b)).alias(f"order_{i}") for i, (a, b) in enumerate(pairs)]
    late = "publication_ts" in cols and "signal_ts" in cols
    if late:
        aggs.append(F.count_if(F.col("signal_ts") <= F.col("publication_ts")).alias("late"))
    c = signals.agg(*aggs)
    rows = [F.struct(F.lit("timestamp_order").alias("check"), F.lit(f"{a} > {b}").alias("detail"), F.col(f"order_{i}").alias("n")) for i, (a, b) in enumerate(pairs)]
    if late:
        rows.append(F.struct(F.lit("zero_latency_signal").alias("check"), F.lit("signal at or before publication").alias("detail"), F.col("late").alias("n")))
    x = c.select(F.explode(F.array(*rows)).alias("f")).select("f.*").where("n > 0")
    return x.select("check", F.lit("FAIL").alias("severity"), "n", "detail")


def asof_latest(filings: DataFrame, decision_ts: Column | str, tie: str | None = None) -> DataFrame:
    """Latest filing per (ticker, field) available at one decision instant. Combines map-side: no window, no sort."""
    at = F.lit(decision_ts).cast("timestamp") if isinstance(decision_ts, str) else decision_ts
    order = F.struct(*[F.col(c) for c in ("available_ts", *([tie] if tie else []), "value")])
    return filings.where(F.col("available_ts") <= at).groupBy("ticker", "field").agg(
        F.max("available_ts").alias("available_ts"), F.max_by("value", order).alias("value")
    )


def asof_join(decisions: DataFrame, filings: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], tie: str | None = None,
              bucket: str = "month", hot: int = 100_000) -> DataFrame:
    """For each decision the latest right row with ``right_ts`` <= ``left_ts`` and equal keys.

    Both sides meet by their keys in one exchange. Only keys of about ``hot`` rows or more are cut into time buckets, whose
    carry is then a small relation; a summary per bucket of every key would be as large as the rows themselves. All columns
    of the decisions are kept; without a match values are NULL.
    """
    # hot keys are counted before the merge, so the decisions are read more than once
    left = cut_lineage(decisions)
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    # a NULL key, like a NULL instant, matches nothing: such decisions stay out of the exchange
    known = F.col(left_ts).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    order = [right_ts, *([tie] if tie else []), *values]
    rs = [f"_r{i}" for i in range(len(order))]
    l = left.where(known).select(*named, *[F.col(c).alias(f"_l{i}") for i, c in enumerate(left.columns)])
    r = filings.where(F.col(right_ts).isNotNull()).select(*named, *[F.col(c).alias(n) for n, c in zip(rs, order)]).dropna(subset=ks)
    split = cut_lineage(_hot_keys(l.select(*ks).unionByName(r.select(*ks)), ks, hot)).withColumn("_hot", F.lit(True))
    at_left = F.col(f"_l{left.columns.index(left_ts)}")
    is_left, at = at_left.isNotNull(), F.coalesce(at_left, "_r0")
    both = l.unionByName(r, allowMissingColumns=True).join(split, ks, "left").withColumn("_b", F.when(F.col("_hot"), F.date_trunc(bucket, at))).drop("_hot")
    row = F.when(~is_left, F.struct(*rs))
    tails = both.where(F.col("_b").isNotNull()).groupBy(*ks, "_b").agg(F.max(row).alias("_tail"))
    past = Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*ks, "_b", F.max("_tail").over(past).alias("_carry"))
    w = Window.partitionBy(*ks, "_b").orderBy(at, is_left, *rs[1:]).rowsBetween(Window.unboundedPreceding, 0)
    x = both.repartition(*ks, "_b").withColumn("_seen", F.last(row, ignorenulls=True).over(w)).where(is_left).join(carry, [*ks, "_b"], "left")
    hit = F.coalesce("_seen", "_carry")
    found = {c: hit[n] for n, c in zip(rs, order)}
    out = x.select(*[F.col(f"_l{i}").alias(c) for i, c in enumerate(left.columns)], *[found[c].alias(c) for c in (right_ts, *values)])
    return out.union(left.where(~known).select("*", *[F.lit(None).cast(filings.schema[c].dataType).alias(c) for c in (right_ts, *values)]))


def _hot_keys(rows: DataFrame, keys: list[str], hot: int) -> DataFrame:
    """Keys of about ``hot`` rows or more, by some 2,000 sampled rows each. They settle where rows meet, not what is found."""
    every = max(1, hot // 2_000)
    seen = rows.sample(1 / every, seed=7) if every > 1 else rows
    return seen.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= hot / every).select(*keys)
