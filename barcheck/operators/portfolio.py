"""Portfolio accounting as table arithmetic, for many strategies and cost scenarios in one job.

Relations: weights(strategy_id, t, ticker, w) -> cells(strategy_id, scenario, t, ticker, w, r, dw, cost) ->
returns(strategy_id, scenario, t, gross, cost, net, ...). A decision at t fills at the open of t + 1 + latency.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import BASELINE_EXEC, PESSIMISTIC_EXEC, REGIMES
from .panel import trailing

KEY = ("strategy_id", "scenario")


class DataGapError(ValueError):
    """Listed bars without price that no exclusion documents, or an unknown terminal return that was held."""


def scenario(name: str, base: dict = BASELINE_EXEC, **changes) -> dict:
    return {**base, **changes, "scenario": name}


def regimes(base: dict | None = None) -> list[dict]:
    """Optimistic, baseline and pessimistic costs; mode, capital and limits follow ``base``."""
    keep = {k: base[k] for k in ("mode", "capital", "max_weight", "max_gross")} if base else {}
    return [{**r, **keep} for r in REGIMES]


def delay_ladder(base: dict = BASELINE_EXEC, steps: Sequence[int] = (1, 2)) -> list[dict]:
    return [scenario(f"delay+{d}", base, latency_bars=base["latency_bars"] + d) for d in steps]


def capacity_ladder(base: dict = BASELINE_EXEC, capitals: Sequence[float] = (1e3, 1e4, 1e5, 1e6, 1e7)) -> list[dict]:
    return [scenario(f"capital={c:.0e}", base, capital=float(c)) for c in capitals]


def _structs(scenarios: Sequence[dict]) -> Column:
    """Scenario rows as one literal array: fanning out is a generator, not a cross join."""
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in s.items()]) for s in scenarios])


# ------------------------------------------------------------------ guards


def missing_cells(panel: DataFrame) -> DataFrame:
    """Listed, not excluded, and without open or close: the engine never fills them."""
    return panel.where(F.col("alive") & ~F.col("excluded") & (F.col("open").isNull() | F.col("close").isNull())).select("t", "ticker")


def last_bars(panel: DataFrame, terminal: DataFrame | None) -> DataFrame:
    """Per name: last listed bar with a price, last such bar that is not excluded, and the terminal return."""
    priced = F.col("alive") & F.col("open").isNotNull()
    x = panel.groupBy("ticker").agg(F.max(F.when(priced, F.col("t"))).alias("t_end"), F.max(F.when(priced & ~F.col("excluded"), F.col("t"))).alias("t_end_in"))
    if terminal is None:
        return x.withColumn("delist_ret", F.lit(None).cast("double"))
    return x.join(terminal.select("ticker", "delist_ret"), "ticker", "left")


def refuse_if(df: DataFrame, violations: DataFrame, message: str) -> DataFrame:
    """``df``, or a failed job when ``violations`` has rows."""
    n = violations.agg(F.count("*")).scalar()
    return df.where(F.when(n == 0, F.lit(True)).otherwise(F.raise_error(F.concat(n.cast("string"), F.lit(f" {message}"))).cast("boolean")))


# ------------------------------------------------------------------ cells


class Accounts:
    def __init__(self, panel: DataFrame, weights: DataFrame, scenarios: Sequence[dict] = REGIMES, terminal: DataFrame | None = None,
                 charge_forced_exit: bool = True):
        self.panel, self.weights, self.scenarios = panel, weights, list(scenarios)
        self.terminal, self.charge_forced_exit = terminal, charge_forced_exit
        self.last = panel.agg(F.max("t")).scalar()

    def limited(self) -> DataFrame:
        """Weights clipped per name and scaled pro rata to the gross limit, per scenario."""
        x = self.weights.where("w <> 0").withColumn("s", F.explode(_structs([
            {k: s[k] for k in ("scenario", "max_weight", "max_gross", "latency_bars", "mode", "delist_haircut")} for s in self.scenarios
        ]))).select("strategy_id", "t", "ticker", "w", "s.*")
        clip = F.greatest(F.least(F.col("w"), F.col("max_weight")), -F.col("max_weight"))
        x = x.withColumn("w", clip).withColumn("_g", F.sum(F.abs("w")).over(Window.partitionBy(*KEY, "t")))
        scaled = F.when(F.col("_g") > F.col("max_gross"), F.col("w") * F.col("max_gross") / F.col("_g")).otherwise(F.col("w"))
        return x.withColumn("w", scaled).drop("_g")

    def prices(self) -> DataFrame:
        """Tradable cells with returns and trailing statistics."""
        ok = F.col("alive") & F.col("open").isNotNull() & ~F.col("excluded")
        return trailing(self.panel).where(ok).join(last_bars(self.panel, self.terminal), "ticker")

    def held(self) -> DataFrame:
        """Weights on the bars they are held, with the return of the holding period."""
        w = self.limited().withColumn("t", F.col("t") + 1 + F.col("latency_bars"))
        x = w.join(self.prices(), ["t", "ticker"]).withColumn("last_t", self.last)
        o2o = F.col("mode") == "open_to_open"
        x = x.where(~(o2o & (F.col("t") >= F.col("last_t"))))  # the last open-to-open period is never observed
        opened = F.nullif(F.col("open"), F.lit(0.0))
        ended = (F.col("t") == F.col("t_end")) & (F.col("t") < F.col("last_t"))
        final = F.col("close") / opened * (1 + F.col("delist_ret") - F.col("delist_haircut")) - 1
        known = F.lit(self.terminal is not None)
        r = F.when(~o2o, F.col("close") / opened - 1).when(known & ended, final).otherwise(F.col("next_open") / opened - 1)
        return x.withColumn("r", F.coalesce(r, F.lit(0.0)))

    def unknown_terminals(self) -> DataFrame:
        """Positions on the last bar of a name that ends before the panel does, with no known terminal return."""
        x = self.held().where((F.col("mode") == "open_to_open") & (F.col("t") == F.col("t_end_in")) & (F.col("t") < F.col("last_t")) & F.col("delist_ret").isNull())
        return x.select(*KEY, "t", "ticker")

    def cells(self) -> DataFrame:
        """Held and traded cells: weight, return, weight change and cost.

        Each held cell also emits its own exit one bar later; entries and exits of a cell meet in one hash aggregation,
        so no window over a strategy's history is needed. Trailing statistics of an exit come from the bar before.
        """
        h = self.held()
        none = F.lit(None).cast("double")
        stay = F.struct(F.col("t").alias("t"), F.col("w").alias("dw"), F.col("w").alias("w"), F.col("r").alias("r"), F.col("spread_bps").alias("spread"),
                        F.col("adv").alias("adv"), F.col("vol").alias("vol"), F.lit(1).alias("hold"))
        leave = F.struct((F.col("t") + 1).alias("t"), (-F.col("w")).alias("dw"), F.lit(0.0).alias("w"), F.lit(0.0).alias("r"), F.col("spread_next").alias("spread"),
                         F.col("adv_next").alias("adv"), F.col("vol_next").alias("vol"), F.lit(0).alias("hold"))
        leaves = (F.col("mode") == "open_to_open") & (F.col("t") + 1 <= F.col("last_t"))
        if not self.charge_forced_exit:
            leaves = leaves & F.col("next_ok")
        moves = h.select(*KEY, "ticker", F.explode(F.array_compact(F.array(stay, F.when(leaves, leave)))).alias("m")).select(*KEY, "ticker", "m.*")
        c = moves.groupBy(*KEY, "t", "ticker").agg(
            F.sum("dw").alias("d"), F.sum("w").alias("w"), F.sum("r").alias("r"), F.max("hold").alias("hold"),
            F.max("spread").alias("spread"), F.max("adv").alias("adv"), F.max("vol").alias("vol"),
        )
        spark = self.panel.sparkSession
        cost = spark.range(1).select(F.explode(_structs(self.scenarios)).alias("s")).select("s.*")
        c = c.join(cost, "scenario")
        dw = F.when(F.col("mode") == "open_to_close", 2 * F.abs("w")).otherwise(F.abs("d"))
        c = c.withColumn("dw", dw)
        part = F.when(F.col("adv") > 0, F.col("dw") * F.col("capital") / F.col("adv")).otherwise(F.lit(0.0))
        impact = F.col("impact_coef") * F.coalesce("vol", F.lit(0.02)) * 1e4 * F.sqrt(F.greatest(F.least(part, F.lit(5.0)), F.lit(0.0)))
        side = 0.5 * F.coalesce("spread", F.col("default_spread_bps")) * F.col("spread_mult") + F.col("slip_bps") + F.col("comm_bps") + F.col("open_penalty_bps")
        return c.withColumn("cost", F.col("dw") * (side + impact) * 1e-4).select(
            *KEY, "t", "ticker", "w", "r", "dw", "cost", "hold", F.col("spread").isNull().alias("no_spread"), F.col("vol").isNull().alias("no_vol"),
            "borrow_bps_annual", "financing_bps_annual", "periods_per_year",
        )

    def returns(self, cells: DataFrame | None = None) -> DataFrame:
        """Per bar: gross, cost, net, turnover, exposures; bars without position are rows of zeros."""
        c = self.cells() if cells is None else cells
        per = c.groupBy(*KEY, "t").agg(
            F.sum(F.col("w") * F.col("r")).alias("gross"),
            F.sum("cost").alias("trade_cost"),
            F.sum("dw").alias("turnover"),
            F.sum(F.abs("w")).alias("exposure"),
            F.sum("w").alias("net_exposure"),
            F.sum(F.greatest(-F.col("w"), F.lit(0.0))).alias("short"),
            F.first("borrow_bps_annual").alias("b"), F.first("financing_bps_annual").alias("f"), F.first("periods_per_year").alias("p"),
        )
        carry = (F.col("short") * F.col("b") + F.greatest(F.col("exposure") - 1.0, F.lit(0.0)) * F.col("f")) * 1e-4 / F.col("p")
        per = per.withColumn("cost", F.col("trade_cost") + carry)
        names = F.array(*[F.lit(s["scenario"]) for s in self.scenarios])
        grid = self.weights.select("strategy_id").distinct().select("strategy_id", F.explode(names).alias("scenario"))
        grid = grid.withColumn("t", F.explode(F.sequence(F.lit(0), self.last)))
        x = grid.join(per, [*KEY, "t"], "left")
        zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
        out = x.select(*KEY, "t", zero("gross"), zero("cost"), zero("turnover"), zero("exposure"), zero("net_exposure"))
        return out.withColumn("net", F.col("gross") - F.col("cost"))

    def assumptions(self, cells: DataFrame | None = None) -> DataFrame:
        """How often a default replaced a missing input."""
        c = self.cells() if cells is None else cells
        source = F.lit("panel" if "spread_bps" in self.panel.columns else "assumed_constant")
        return c.groupBy(*KEY).agg(
            F.count_if(F.col("no_spread") & (F.col("w") != 0)).alias("default_spread_held_cells"),
            F.count_if(F.col("no_vol") & (F.col("dw") > 0)).alias("default_vol_traded_cells"),
        ).withColumn("spread_source", source)

    def checked(self, df: DataFrame) -> DataFrame:
        """``df`` guarded by both data-gap rules."""
        df = refuse_if(df, missing_cells(self.panel), "listed bars have no price and no documented exclusion")
        return refuse_if(df, self.unknown_terminals(), "positions were held into an unknown terminal return")


def trade_episodes(cells: DataFrame) -> DataFrame:
    """Contiguous same-sign holdings per name: t_in, t_out, side, pnl. A name's history has one row per bar index."""
    h = cells.where("w <> 0").select(*KEY, "ticker", "t", F.signum("w").alias("side"), (F.col("w") * F.col("r") - F.col("cost")).alias("pnl"))
    w = Window.partitionBy(*KEY, "ticker", "side").orderBy("t")
    x = h.withColumn("g", F.col("t") - F.row_number().over(w))
    return x.groupBy(*KEY, "ticker", "side", "g").agg(F.min("t").alias("t_in"), F.max("t").alias("t_out"), F.sum("pnl").alias("pnl")).drop("g")


def break_even(returns: DataFrame) -> DataFrame:
    """Extra cost per side that brings the mean net return to 0, and gross over cost."""
    m = returns.groupBy(*KEY).agg(F.avg("turnover").alias("turn"), F.avg("net").alias("net"), F.avg("gross").alias("gross"), F.avg("cost").alias("cost"))
    inf = F.lit(float("inf"))
    flat = F.col("turn") <= 0
    return m.select(
        *KEY,
        F.when(flat, inf).otherwise(F.col("net") / F.nullif(F.col("turn"), F.lit(0.0)) * 1e4).alias("extra_bps_per_side"),
        F.when(flat | (F.col("cost") <= 0), inf).otherwise(F.col("gross") / F.nullif(F.col("cost"), F.lit(0.0))).alias("cost_multiple"),
    )


__all__ = ["Accounts", "DataGapError", "PESSIMISTIC_EXEC", "break_even", "capacity_ladder", "delay_ladder", "missing_cells", "refuse_if", "regimes",
           "scenario", "trade_episodes"]
