"""Development evaluation of many strategies as one plan: data gate -> leakage -> accounting -> statistics -> verdict."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..constants import BASELINE_EXEC, REGIMES, THRESHOLDS
from ..session import cut_lineage
from ..operators import guards, leakage, moments, multiple, panel as pan, portfolio as pf, regression, resampling as rs, scorecard as sc, trades


@dataclass
class Evaluation:
    returns: DataFrame
    measures: DataFrame
    gates: DataFrame
    verdicts: DataFrame
    ladders: DataFrame
    failures: DataFrame
    flags: DataFrame


def evaluate(
    panel: DataFrame,
    weights: DataFrame,
    terminal: DataFrame | None = None,
    findings: DataFrame | None = None,
    leaks: DataFrame | None = None,
    neighbors: DataFrame | None = None,
    trial_counts: DataFrame | None = None,
    families: DataFrame | None = None,
    survivorship: DataFrame | None = None,
    ablations: DataFrame | None = None,
    ablation_weights: DataFrame | None = None,
    contaminated: DataFrame | None = None,
    dataset_id: str | None = None,
    th: dict = THRESHOLDS,
    base: dict = BASELINE_EXEC,
    capitals: Sequence[float] = (1e3, 1e4, 1e5, 1e6, 1e7),
    stage: bool = True,
) -> Evaluation:
    """Overfitting, data snooping and deflation are judged within each search family: ``families`` (strategy_id, family), or
    all strategies of ``weights`` as one. ``trial_counts`` (family, variants) is the log. ``findings`` and ``leaks`` carry
    (strategy_id, hard_fails).

    The evaluation guards itself: failed checks of the panel, positions on missing prices and positions over an unknown
    terminal return are ``failures`` (strategy_id, check, n), which reject. ``survivorship`` are findings on delisted names.
    ``flags`` (strategy_id, flag, value) do not reject; ``ablations`` (strategy_id, ablation) name strategies that lack a part.
    Those are among ``weights``, or in ``ablation_weights``: then they are priced beside them, but are no trials of a family
    and get no verdict.

    With ``stage`` the cells and returns are written once to the shared folder for the statistics that share them.
    """
    keep = {k: base[k] for k in ("mode", "capital", "max_weight", "max_gross")}
    fan = [{**r, **keep} for r in REGIMES] + pf.delay_ladder(base) + pf.capacity_ladder(base, capitals)
    acc = pf.Accounts(panel, weights, fan, terminal)
    cells = acc.cells()
    if stage:
        cells = cut_lineage(cells)
    ret = acc.returns(cells)
    if stage:
        ret = cut_lineage(ret)
    at = lambda s: ret.where(F.col("scenario") == s)
    b = at("baseline").select("strategy_id", "t", F.col("net").alias("r"), "gross", "cost")
    ladders = moments.sharpe_table(ret, "net", ("strategy_id", "scenario"))

    m = moments.power_table(b).select("strategy_id", "n", F.col("sharpe").alias("baseline_sharpe"), "power")
    pess = at("pessimistic").groupBy("strategy_id").agg(F.avg("net").alias("pessimistic_mean"))
    be = pf.break_even(at("baseline")).select("strategy_id", F.col("cost_multiple").alias("gross_to_cost"))
    names = weights.select("strategy_id").distinct()
    if families is None:
        families = names.withColumn("family", F.lit("this"))
        if trial_counts is not None:  # the log of a job with one family holds that family's rows
            trial_counts = trial_counts.agg(F.max("variants").alias("variants")).withColumn("family", F.lit("this"))
    families = families.select("strategy_id", "family").distinct()
    if stage:
        families = cut_lineage(families)
    by = ["family"]
    bf = b.join(families, "strategy_id")
    eff = multiple.effective_trials(bf, family=by)
    logged = trial_counts if trial_counts is not None else eff.select("family", F.lit(0).cast("long").alias("variants"))
    trials = sc.trials_for_deflation(logged, eff, moments.sharpe_variance(bf, by))
    per = families.join(trials.select("family", "n_trials", "var_sr"), by).drop("family")
    dsr = moments.deflated_sharpe(b, per).select("strategy_id", "dsr")
    held = cells.where((F.col("scenario") == "baseline") & (F.col("w") != 0)).select("strategy_id", "t", "ticker", "w")
    nxt = pan.next_open(panel).select("t", "ticker", F.coalesce(F.col("next_open") / F.nullif(F.col("open"), F.lit(0.0)) - 1, F.lit(0.0)).alias("r"))
    total = panel.agg(F.max("t") + 1).scalar()
    perm = rs.shift_pvalue(rs.shifted_means(held, nxt, total, th["n_perm"], 20, th["seed"])).select("strategy_id", F.col("p").alias("perm_p"))
    sums = rs.replicate_sums(bf, th["n_boot"], 10, th["seed"], family=by)
    if stage:
        sums = cut_lineage(sums)
    spa = rs.spa_test(b, sums=sums, family=by).select("family", F.col("p").alias("spa_p"))
    rc = rs.reality_check(b, sums=sums, family=by).select("family", F.col("p").alias("rc_p"))
    over = multiple.pbo(bf, family=by).select("family", "pbo")
    family = families.join(spa, by).join(rc, by).join(over, by).drop("family")
    interval = rs.sharpe_interval(sums).select("strategy_id", F.col("lo").alias("sharpe_lo"), F.col("hi").alias("sharpe_hi"))
    ep = pf.trade_episodes(cells.where("scenario = 'baseline'"))
    conc = trades.concentration(ep).select("strategy_id", "n_trades", "top5_share", "net_without_top1pct")
    sub = sc.subperiod_share(b)
    alpha = regression.factor_regression(b, pan.market_proxy(panel), ["market_return"]).select("strategy_id", "alpha_t")
    for part in (pess, be, dsr, perm, conc, sub, alpha, family, interval):
        m = m.join(part, "strategy_id", "left")
    if neighbors is not None:
        base_sharpes = ladders.where("scenario = 'baseline'").select("strategy_id", "sharpe")
        m = m.join(sc.neighbourhood(base_sharpes, neighbors), "strategy_id", "left")
    g = sc.gates(m, th)
    failures = guards.gap_failures(acc).unionByName(guards.panel_failures(panel, names, survivorship))
    if stage:
        failures = cut_lineage(failures)
    hard = guards.hard_failures(failures)
    for h in (findings, leaks):
        if h is not None:
            hard = hard.unionByName(h.select("strategy_id", "hard_fails"))
    less = None
    if ablations is not None:
        known = ladders.where("scenario = 'baseline'").select("strategy_id", "sharpe")
        if ablation_weights is not None:
            known = known.unionByName(ablated_sharpes(panel, ablation_weights, terminal, base))
        less = sc.flags(known, ablations)
    notes = guards.flags(acc.assumptions(cells), ladders, conc, b, families, less, contaminated, dataset_id, th)
    hard = hard.groupBy("strategy_id").agg(F.sum("hard_fails").alias("hard_fails"))
    return Evaluation(ret, m, g, sc.classify(g, m, hard, th), ladders, failures, notes)


def ablated_sharpes(panel: DataFrame, weights: DataFrame, terminal: DataFrame | None = None, base: dict = BASELINE_EXEC) -> DataFrame:
    """(strategy_id, sharpe) after costs of the base scenario."""
    return moments.sharpe_table(pf.Accounts(panel, weights, [base], terminal).returns(), "net")


def leak_failures(suite: DataFrame) -> DataFrame:
    return suite.groupBy("strategy_id").agg(F.count_if(~F.col("passed")).alias("hard_fails"))


__all__ = ["Evaluation", "ablated_sharpes", "evaluate", "leak_failures", "leakage"]
