"""Concentration of profit in few trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.shape import order_sums


def concentration(trades: DataFrame, keys: Sequence[str] = ("strategy_id",), pnl: str = "pnl") -> DataFrame:
    """Top shares and trimmed totals per strategy.

    Equal results are collapsed and ordered by ``order_sums``; the sum of the k best is then a conditional sum, so one
    strategy with most of the trades is still ranked by many tasks. Shares are NULL unless the total is positive.
    """
    keys = list(keys)
    o = order_sums(trades, keys, pnl)
    v, n = F.col(pnl), F.col("tot_cnt")
    above = n - F.col("cum_cnt")  # trades strictly better
    below = F.col("cum_cnt") - F.col("cnt")  # trades strictly worse

    def top(k: Column) -> Column:
        return F.sum(v * F.greatest(F.least(F.col("cnt"), k - above), F.lit(0)))

    def low(k: Column) -> Column:
        return F.sum(v * F.greatest(F.least(F.col("cnt"), k - below), F.lit(0)))

    one = F.lit(1)
    pct1, pct5 = F.ceil(F.lit(0.01) * n), F.ceil(F.lit(0.05) * n)
    a = o.groupBy(*keys).agg(
        F.max("tot_cnt").alias("n_trades"), F.sum(v * F.col("cnt")).alias("total"),
        top(one).alias("t1"), top(F.lit(5)).alias("t5"), top(F.lit(10)).alias("t10"), top(pct1).alias("p1"), top(pct5).alias("p5"),
        low(one).alias("l1"), low(pct1).alias("q1"), low(pct5).alias("q5"),
    )
    share = lambda c: F.when(F.col("total") > 0, F.col(c) / F.nullif(F.col("total"), F.lit(0.0)))
    less = lambda c: F.col("total") - F.col(c)
    return a.select(
        *keys, "n_trades",
        share("t1").alias("top1_share"), share("t5").alias("top5_share"), share("t10").alias("top10_share"),
        share("p1").alias("top1pct_share"), share("p5").alias("top5pct_share"),
        less("t1").alias("net_without_best"), less("l1").alias("net_without_worst"),
        less("p1").alias("net_without_top1pct"), less("q1").alias("net_without_bottom1pct"),
        less("p5").alias("net_without_top5pct"), less("q5").alias("net_without_bottom5pct"),
    )
