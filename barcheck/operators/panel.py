"""The bar panel as a long table: (t, ts, ticker, prices, volume, alive, excluded).

Cells of names that are not listed need no row. Every operator that shifts by bar index compares ``t`` itself, so the dense
grid is only built where the grid is the result (``densify``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.shape import dense_index, running_sum, with_halo

BAR_CHUNK = 2048


def bar_index(bars: DataFrame, ts: str = "date") -> DataFrame:
    return dense_index(bars, ts, "t", F.trunc(ts, "month") if bars.schema[ts].dataType.typeName() == "date" else F.date_trunc("day", ts))


def observed_panel(bars: DataFrame, ts: str = "date") -> DataFrame:
    """Panel of the cells that have a bar; alive, not excluded."""
    return bars.join(bar_index(bars, ts), ts).select(
        "t", F.col(ts).alias("ts"), "ticker", "open", "high", "low", "close", "volume", F.lit(True).alias("alive"), F.lit(False).alias("excluded")
    )


def densify(bars: DataFrame, ts: str = "date") -> DataFrame:
    """Full (t, ticker) grid; alive between a ticker's first and last bar, excluded where alive without a bar.

    Each ticker unfolds its own index range; nothing is paired through one task.
    """
    idx = bar_index(bars, ts)
    b = bars.join(idx, ts).drop(ts)
    last = idx.agg(F.max("t")).scalar()
    life = b.groupBy("ticker").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    grid = life.withColumn("t", F.explode(F.sequence(F.lit(0), last)))
    alive = F.col("t").between(F.col("t0"), F.col("t1"))
    x = grid.join(b, ["ticker", "t"], "left").join(idx, "t")
    return x.select(
        "t", F.col(ts).alias("ts"), "ticker", "open", "high", "low", "close", "volume", alive.alias("alive"),
        (alive & F.col("open").isNull()).alias("excluded"),
    )


def in_bars(panel: DataFrame) -> DataFrame:
    """Cells that can be traded: listed, priced and not excluded."""
    return panel.where(F.col("alive") & F.col("open").isNotNull() & F.col("close").isNotNull() & ~F.col("excluded"))


def slice_bars(panel: DataFrame, a: int, b: int) -> DataFrame:
    return panel.where((F.col("t") >= a) & (F.col("t") < b)).withColumn("t", F.col("t") - a)


def survivors(panel: DataFrame) -> DataFrame:
    """Names listed on the last bar only: the biased dataset the survivorship audit must catch."""
    last = panel.agg(F.max("t")).scalar()
    keep = panel.where(F.col("alive") & (F.col("t") == last)).select("ticker")
    return panel.join(keep, "ticker", "left_semi")


def next_open(panel: DataFrame) -> DataFrame:
    """Adds the open of the next bar index (NULL when the name has none there)."""
    w = Window.partitionBy("ticker").orderBy("t")
    return panel.withColumn("next_open", F.when(F.lead("t").over(w) == F.col("t") + 1, F.lead("open").over(w)))


def market_proxy(panel: DataFrame) -> DataFrame:
    """Equal-weight mean of open-to-next-open over listed names; 0 on a bar without any."""
    r = F.col("next_open") / F.nullif(F.col("open"), F.lit(0.0)) - 1
    return next_open(panel).groupBy("t").agg(F.coalesce(F.avg(F.when(F.col("alive"), r)), F.lit(0.0)).alias("market_return"))


def close_returns(panel: DataFrame) -> DataFrame:
    """close[t] / close[t-1] - 1 on the bar index, never filled."""
    w = Window.partitionBy("ticker").orderBy("t")
    prev = F.when(F.lag("t").over(w) == F.col("t") - 1, F.lag("close").over(w))
    return panel.withColumn("ret", F.col("close") / F.nullif(prev, F.lit(0.0)) - 1)


def exclude_cells(panel: DataFrame, gaps: DataFrame) -> DataFrame:
    """Marks the cells of ledger gaps (ticker, start, end as dates, both included); a gap without ticker hits every name.

    A gap opens on its first day and closes after its last one; a cell is excluded where more gaps have opened than
    closed. The count runs per name in chunks of a year, so the work grows with cells and gaps, not with the days of
    long gaps. Gaps for every name become disjoint spans, at most one row per calendar day. A gap without a
    start, or with an end before it, and a cell without an instant mark nothing.
    """
    day = lambda c: F.to_date(F.substring(c, 1, 10))
    g = gaps.select("ticker", day(F.col("start")).alias("a"), F.date_add(day(F.coalesce("end", "start")), 1).alias("b")).where("a < b")
    edge = lambda c, n: F.struct(F.col(c).alias("_d"), F.lit(n).cast("long").alias("_add"))
    edges = g.select("ticker", F.explode(F.array(edge("a", 1), edge("b", -1))).alias("_e")).groupBy("ticker", "_e._d").agg(F.sum("_e._add").alias("_add"))
    # calendar rows only
    w = Window.orderBy("_d")
    market = edges.where("ticker IS NULL").select("_d", F.sum("_add").over(w).alias("_open"), F.date_sub(F.lead("_d").over(w), 1).alias("_to")).where("_open > 0")
    every = market.select(F.explode(F.sequence("_d", "_to")).alias("_d"), F.lit(True).alias("_all"))
    cells = panel.withColumn("_d", F.to_date("ts")).withColumn("_add", F.lit(0).cast("long")).withColumn("_cell", F.lit(True))
    x = cells.unionByName(edges.where("ticker IS NOT NULL").withColumn("_cell", F.lit(False)), allowMissingColumns=True)
    x = running_sum(x, ["ticker"], ["_d", "_cell"], F.col("_add"), "_in", F.trunc("_d", "year")).where("_cell").join(every, "_d", "left")
    return x.withColumn("excluded", F.col("excluded") | (F.col("_in") > 0) | F.col("_all").isNotNull()).select(*panel.columns)


def trailing(panel: DataFrame, bars: int = 20, min_obs: int = 5) -> DataFrame:
    """Adds the next bar's open, spread and tradability, and trailing dollar volume and volatility as of this bar and the next.

    Frames are RANGE frames on the bar index, so absent rows count as bars without volume, as in a dense grid. Rows are
    windowed in chunks of the index with a halo: a name with a very long history is spread over many tasks.
    """
    p = with_halo(panel, "t", BAR_CHUNK, back=bars + 1, ahead=1)
    w = Window.partitionBy("ticker", "_c").orderBy("t")
    p = p.withColumn("next_open", F.when(F.lead("t").over(w) == F.col("t") + 1, F.lead("open").over(w)))
    step = F.lead("t").over(w) == F.col("t") + 1
    ok = F.col("alive") & F.col("open").isNotNull() & ~F.col("excluded")
    p = p.withColumn("next_ok", F.coalesce(step & F.lead(ok).over(w), F.lit(False)))
    if "spread_bps" not in p.columns:
        p = p.withColumn("spread_bps", F.lit(None).cast("double"))
    p = p.withColumn("spread_next", F.when(step, F.lead("spread_bps").over(w)))
    prev = F.when(F.lag("t").over(w) == F.col("t") - 1, F.lag("close").over(w))
    p = p.withColumn("_ret", F.col("close") / F.nullif(prev, F.lit(0.0)) - 1).withColumn("_dollar", F.coalesce(F.col("close") * F.col("volume"), F.lit(0.0)))

    def adv(frame, seen):
        return F.when(seen >= min_obs, F.coalesce(F.sum("_dollar").over(frame), F.lit(0.0)) / F.least(seen, F.lit(bars)))

    def vol(frame):
        return F.when(F.count("_ret").over(frame) >= min_obs, F.stddev_samp("_ret").over(frame))

    past, upto = w.rangeBetween(-bars, -1), w.rangeBetween(-bars + 1, 0)
    p = p.withColumns({
        "adv": adv(past, F.col("t")), "vol": vol(past), "adv_next": adv(upto, F.col("t") + 1), "vol_next": vol(upto),
    })
    return p.where("_own").drop("_c", "_own", "_ret", "_dollar")
