"""Gates and verdicts: measures per strategy become (strategy_id, gate, passed, value) rows, and rows become a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import INTERESTING, LIVE, PAPER_VALIDATED, REJECTED, ROBUST, ROBUST_DEV, SIGNIFICANCE_GATES, THRESHOLDS
from ..functions.shape import split_index
from . import moments

TH = THRESHOLDS

# measures(strategy_id, ...): a missing column or a NULL means that the gate does not apply
MEASURES = (
    "baseline_sharpe", "pessimistic_mean", "gross_to_cost", "dsr", "perm_p", "spa_p", "rc_p", "pbo", "neighbor_pos", "neighbor_ratio",
    "n_trades", "top5_share", "net_without_top1pct", "subperiod_pos", "alpha_t", "power",
)


def data_gate(findings: DataFrame, strategies: DataFrame | None = None) -> DataFrame:
    """findings(strategy_id, check, severity) -> data dimension and hard failures; PASS for ``strategies`` without findings."""
    found = findings.select("strategy_id", "severity")
    if strategies is not None:
        found = found.unionByName(strategies.select("strategy_id", F.lit(None).cast("string").alias("severity")))
    fails = F.count_if(F.col("severity") == "FAIL")
    state = F.when(fails > 0, F.lit("FAIL")).when(F.count("severity") > 0, F.lit("WARN")).otherwise(F.lit("PASS"))
    return found.groupBy("strategy_id").agg(state.alias("data_integrity"), fails.alias("hard_fails"))


def gates(measures: DataFrame, th: dict = TH) -> DataFrame:
    for c in MEASURES:
        if c not in measures.columns:
            measures = measures.withColumn(c, F.lit(None).cast("double"))
    c = F.col

    def gate(name: str, passed: Column, value: Column, applies: Column | None = None) -> Column:
        row = F.struct(F.lit(name).alias("gate"), F.coalesce(passed, F.lit(False)).alias("passed"), value.cast("double").alias("value"))
        return F.when(value.isNotNull() if applies is None else applies, row)

    worst = F.greatest(c("spa_p"), c("rc_p"))
    near = (c("neighbor_pos") >= th["min_neighbor_pos_frac"]) & (c("neighbor_ratio") >= th["min_neighbor_median_ratio"])
    spread = (c("top5_share").isNull() | (c("top5_share") <= th["max_top5_share"])) & (c("net_without_top1pct") > 0)
    rows = F.array(
        gate("baseline_net_sharpe", c("baseline_sharpe") >= th["min_baseline_net_sharpe"], c("baseline_sharpe")),
        gate("pessimistic_net_positive", c("pessimistic_mean") > 0, c("pessimistic_mean")),
        gate("cost_break_even", c("gross_to_cost") >= th["min_gross_to_cost"], c("gross_to_cost")),
        gate("deflated_sharpe", c("dsr") >= th["min_dsr"], c("dsr")),
        gate("placebo_timing_permutation", c("perm_p") <= th["max_perm_p"], c("perm_p")),
        gate("spa_reality_check", worst <= th["max_spa_p"], worst),
        gate("pbo", c("pbo") <= th["max_pbo"], c("pbo")),
        gate("parameter_neighbourhood", near, c("neighbor_pos")),
        gate("trade_concentration", spread, c("net_without_top1pct"), c("n_trades") >= 20),
        gate("subperiod_stability", c("subperiod_pos") >= th["min_subperiod_pos_frac"], c("subperiod_pos")),
        gate("factor_alpha", c("alpha_t") >= th["min_alpha_t"], c("alpha_t")),
    )
    return measures.select("strategy_id", F.explode(F.array_compact(rows)).alias("g")).select("strategy_id", "g.*")


def neighbourhood(sharpes: DataFrame, chosen: DataFrame) -> DataFrame:
    """sharpes(strategy_id, sharpe); chosen(strategy_id, neighbor): share of positive neighbours and their median over the chosen."""
    x = chosen.join(sharpes.withColumnRenamed("strategy_id", "neighbor").withColumnRenamed("sharpe", "s"), "neighbor").where("neighbor <> strategy_id")
    m = x.groupBy("strategy_id").agg(F.avg(F.when(F.col("s") > 0, 1.0).otherwise(0.0)).alias("neighbor_pos"), F.median("s").alias("_med"))
    m = m.join(sharpes, "strategy_id")
    ratio = F.when(F.col("sharpe") > 0, F.col("_med") / F.nullif(F.col("sharpe"), F.lit(0.0))).otherwise(F.lit(0.0))
    return m.select("strategy_id", "neighbor_pos", ratio.alias("neighbor_ratio"))


def subperiods(returns: DataFrame, parts: int = TH["n_subperiods"], r: str = "r") -> DataFrame:
    """Mean and Sharpe of equal stretches of the sample."""
    total = returns.agg(F.max("t") + 1).scalar()
    x = returns.withColumn("part", split_index(F.col("t"), total, parts))
    return x.groupBy("strategy_id", "part").agg(F.avg(r).alias("mean"), moments.sharpe(r).alias("sharpe"))


def subperiod_share(returns: DataFrame, parts: int = TH["n_subperiods"], r: str = "r") -> DataFrame:
    return subperiods(returns, parts, r).groupBy("strategy_id").agg(F.avg(F.when(F.col("mean") > 0, 1.0).otherwise(0.0)).alias("subperiod_pos"))


def regime_sharpe(returns: DataFrame, benchmark: DataFrame, r: str = "r", b: str = "b", lookback: int = 20, min_bars: int = 20) -> DataFrame:
    """Sharpe by tercile of the benchmark's trailing volatility (past bars only). The benchmark has one row per bar, which
    is all the un-partitioned window sees."""
    w = Window.orderBy("t").rangeBetween(-lookback, -1)
    trail = benchmark.select("t", F.when(F.col("t") > 5, F.stddev_pop(b).over(w)).alias("v"))
    cut = trail.agg(F.percentile("v", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    one = F.lit(1).alias("_one")
    x = trail.where("v IS NOT NULL").select("*", one).join(cut.select("*", one), "_one")
    x = x.select("t", F.when(F.col("v") < F.col("q")[0], "low").when(F.col("v") < F.col("q")[1], "mid").otherwise("high").alias("regime"))
    y = returns.join(x, "t").groupBy("strategy_id", "regime").agg(F.count("*").alias("bars"), moments.sharpe(r).alias("sharpe"))
    return y.where(F.col("bars") > min_bars)


def flags(sharpes: DataFrame, ablation_of: DataFrame | None = None, keep: float = 0.9) -> DataFrame:
    """Ablations (strategy_id, ablation) that leave the Sharpe of the strategy as it was."""
    a = ablation_of.join(sharpes.withColumnRenamed("strategy_id", "ablation").withColumnRenamed("sharpe", "ablation_sharpe"), "ablation").join(sharpes, "strategy_id")
    return a.where(F.col("ablation_sharpe") >= keep * F.col("sharpe")).select("strategy_id", "ablation", "ablation_sharpe", "sharpe")


def trials_for_deflation(trial_counts: DataFrame, effective: DataFrame, variance: DataFrame) -> DataFrame:
    """Per family with returns: n_trials = max(its logged variants, its effective trials, 1) and the variance of its variants'
    Sharpe ratios. All three tables have a column ``family``; a family without a log has logged 0."""
    x = effective.select("family", "effective").join(variance.select("family", "var_sr"), "family")
    x = x.join(trial_counts.groupBy("family").agg(F.max("variants").alias("logged")), "family", "left").withColumn("logged", F.coalesce("logged", F.lit(0).cast("long")))
    return x.select("family", "logged", "effective", F.greatest("logged", "effective", F.lit(1)).cast("double").alias("n_trials"), "var_sr")


def power_dimension(power: Column, th: dict = TH) -> Column:
    return F.when(power >= th["min_power_for_claim"], F.lit("ADEQUATE")).otherwise(F.lit("LOW"))


def classify(gate_rows: DataFrame, measures: DataFrame, hard: DataFrame | None = None, th: dict = TH) -> DataFrame:
    """measures(strategy_id, baseline_sharpe, power), hard(strategy_id, hard_fails): class, failed gates, power."""
    failed = gate_rows.groupBy("strategy_id").agg(F.collect_set(F.when(~F.col("passed"), F.col("gate"))).alias("failed"))
    x = measures.select("strategy_id", "baseline_sharpe", "power").join(failed, "strategy_id", "left")
    x = x.withColumn("failed", F.coalesce("failed", F.array().cast("array<string>")))
    x = x.join(hard.select("strategy_id", "hard_fails"), "strategy_id", "left") if hard is not None else x.withColumn("hard_fails", F.lit(0).cast("long"))
    bad = F.coalesce("hard_fails", F.lit(0))
    # implausibly good results are suspected leaks
    bad = bad + F.when(F.col("baseline_sharpe") >= th["max_plausible_sharpe"], 1).otherwise(0)
    low = power_dimension(F.col("power"), th) == "LOW"
    none = F.size("failed") == 0
    excusable = F.size(F.array_except("failed", F.array(*[F.lit(g) for g in SIGNIFICANCE_GATES]))) == 0
    verdict = (
        F.when(bad > 0, F.lit(REJECTED))
        .when(none & ~low, F.lit(ROBUST_DEV))
        .when(none, F.lit(INTERESTING))
        .when(excusable & low & (F.col("baseline_sharpe") >= th["min_baseline_net_sharpe"]), F.lit(INTERESTING))
        .otherwise(F.lit(REJECTED))
    )
    return x.select("strategy_id", verdict.alias("classification"), bad.cast("long").alias("n_hard_fails"), F.size("failed").cast("long").alias("n_gates_failed"),
                    power_dimension(F.col("power"), th).alias("statistical_power"))


def public(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("strategy_id", "classification", "n_hard_fails", "n_gates_failed")


def out_of_sample(measures: DataFrame, th: dict = TH) -> DataFrame:
    """measures(strategy_id, oos_sharpe, oos_p, dev_sharpe, pess_sharpe) -> four gates and the decision."""
    c = F.col
    x = measures.withColumn("oos_sharpe_ok", c("oos_sharpe") >= th["oos_min_sharpe"]).withColumn("oos_significance", c("oos_p") <= th["oos_max_p"])
    x = x.withColumn("oos_decay", c("oos_sharpe") >= th["oos_min_ratio"] * c("dev_sharpe")).withColumn("oos_pessimistic_nonneg", c("pess_sharpe") >= 0)
    ok = c("oos_sharpe_ok") & c("oos_significance") & c("oos_decay") & c("oos_pessimistic_nonneg")
    return x.withColumn("classification", F.when(ok, F.lit(ROBUST)).otherwise(F.lit(REJECTED)))


def paper_gate(paper: DataFrame, th: dict = TH) -> DataFrame:
    """paper(strategy_id, classification, r, backtest_mean, human_review): class after paper trading."""
    m = paper.groupBy("strategy_id", "classification", "backtest_mean", "human_review").agg(F.count("r").alias("days"), F.avg("r").alias("mean"))
    disc = F.abs(F.col("mean") - F.col("backtest_mean")) / F.greatest(F.abs("backtest_mean"), F.lit(1e-12))
    out = (
        F.when(~F.col("classification").startswith("ROBUST"), F.col("classification"))
        .when(F.col("days") < th["min_paper_days"], F.lit(ROBUST))
        .when((F.col("mean") <= 0) | (disc > th["max_paper_discrepancy"]), F.lit(INTERESTING))
        .when(F.col("human_review"), F.lit(LIVE))
        .otherwise(F.lit(PAPER_VALIDATED))
    )
    return m.select("strategy_id", "days", disc.alias("discrepancy"), out.alias("verdict"))
