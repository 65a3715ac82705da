"""What an evaluation must refuse or point out: positions on missing or unknown prices, broken panels, weak evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import THRESHOLDS
from . import audits, leakage, moments
from .gaps import union_all
from .portfolio import Accounts, missing_cells

FEW_TRADES = 20


def gap_failures(accounts: Accounts, scenario: str = "baseline") -> DataFrame:
    """(strategy_id, check, n): positions of a scenario on listed cells without a price, and positions held over the end of a
    name whose terminal return is unknown. Nothing is filled: a strategy with such a row has no result."""
    held = accounts.limited().where((F.col("scenario") == scenario) & (F.col("w") != 0)).withColumn("t", F.col("t") + 1 + F.col("latency_bars"))
    holes = held.join(missing_cells(accounts.panel), ["t", "ticker"], "left_semi").select("strategy_id", F.lit("held_missing_price").alias("check"))
    ends = accounts.unknown_terminals().where(F.col("scenario") == scenario).select("strategy_id", F.lit("unknown_terminal_return").alias("check"))
    return holes.unionByName(ends).groupBy("strategy_id", "check").agg(F.count("*").alias("n"))


def panel_failures(panel: DataFrame, strategies: DataFrame, survivorship: DataFrame | None = None) -> DataFrame:
    """(strategy_id, check, n): failed checks of the panel itself and of its survivorship; they hold for every strategy."""
    found = audits.cell_findings(panel).where("severity = 'FAIL'").select("check")
    if survivorship is not None:
        found = found.unionByName(survivorship.where("severity = 'FAIL'").select("check"))
    per = found.groupBy("check").agg(F.count("*").alias("n"))
    one = F.lit(0).alias("_one")
    return strategies.select("strategy_id", one).join(per.select("*", one), "_one").select("strategy_id", "check", "n")


def hard_failures(failures: DataFrame) -> DataFrame:
    """(strategy_id, hard_fails): number of failed checks."""
    return failures.groupBy("strategy_id").agg(F.count("*").alias("hard_fails"))


def flags(
    assumptions: DataFrame, ladders: DataFrame, trades: DataFrame, baseline: DataFrame, families: DataFrame,
    ablations: DataFrame | None = None, contaminated: DataFrame | None = None, dataset_id: str | None = None, th: dict = THRESHOLDS,
) -> DataFrame:
    """(strategy_id, flag, value): remarks that do not reject.

    ``assumed_spread`` (held cells on an assumed spread), ``delay_fragility`` (Sharpe after one bar of delay),
    ``capacity`` (largest capital with a positive Sharpe, where a larger one was tried), ``few_trades``,
    ``single_variant`` (a family without a search to deflate), ``low_power`` (least Sharpe the sample can show),
    ``ablation:<name>`` (Sharpe that is left without a part), ``contaminated_dataset``. ``ladders`` are Sharpe ratios
    (strategy_id, scenario, sharpe), ``trades`` (strategy_id, n_trades), ``baseline`` returns (strategy_id, t, r).
    """
    row = lambda df, flag, value: df.select("strategy_id", flag.alias("flag"), value.cast("double").alias("value"))
    spread = assumptions.where("scenario = 'baseline' AND default_spread_held_cells > 0")
    delay = leakage.delay_fragility(ladders).where("NOT passed")
    steps = ladders.where(F.col("scenario").startswith("capital=")).select("strategy_id", F.substring("scenario", 9, 20).cast("double").alias("capital"), "sharpe")
    caps = steps.groupBy("strategy_id").agg(F.max(F.when(F.col("sharpe") > 0, F.col("capital"))).alias("most"), F.max("capital").alias("tried")).where("most < tried OR most IS NULL")
    sizes = families.groupBy("family").agg(F.count("*").alias("k")).where("k = 1")
    power = moments.power_table(baseline).where(F.col("power") < th["min_power_for_claim"])
    out = [
        row(spread, F.lit("assumed_spread"), F.col("default_spread_held_cells")), row(delay, F.lit("delay_fragility"), F.col("sharpe1")), row(caps, F.lit("capacity"), F.col("most")),
        row(trades.where(F.col("n_trades") < FEW_TRADES), F.lit("few_trades"), F.col("n_trades")), row(families.join(sizes, "family"), F.lit("single_variant"), F.col("k")),
        row(power, F.lit("low_power"), F.col("min_detectable_sharpe")),
    ]
    if ablations is not None:
        out.append(row(ablations, F.concat(F.lit("ablation:"), F.col("ablation")), F.col("ablation_sharpe")))
    if contaminated is not None:
        seen = contaminated.where(F.col("dataset_id") == dataset_id).select("dataset_id").distinct()
        one = F.lit(0).alias("_one")
        out.append(row(families.select("strategy_id", one).join(seen.select(one), "_one"), F.lit("contaminated_dataset"), F.lit(None)))
    return union_all(out)
