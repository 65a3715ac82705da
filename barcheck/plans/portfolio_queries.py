"""Signal, portfolio and leakage queries with their verification SQL."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, functions as F

from ..constants import BASELINE_EXEC, REGIMES
from ..operators import guards, leakage, moments, panel as pan, portfolio as pf, scorecard as sc, signals as sg
from ..session import cut_lineage
from ..sources import tables as src
from . import sqltext as q
from .evaluation import ablated_sharpes
from .integrity_queries import _round

VARIANTS = [sg.variant("mom10", window=10), sg.variant("mom20", window=20), sg.variant("mom40", window=40, rebalance=10)]


def _panel(spark, folder) -> DataFrame:
    return cut_lineage(pan.observed_panel(src.staged_daily_bars(spark, folder)))


def _terminal(spark, folder) -> DataFrame:
    """Terminal return of every brand, should it stop trading: -30 % for every fifth, else 0."""
    p = src.table(spark, folder, "part").select(F.col("p_brand").alias("ticker")).distinct()
    k = F.regexp_extract("ticker", r"(\d+)", 1).cast("int") % 5
    return p.withColumn("delist_ret", F.when(k == 4, F.lit(-0.3)).otherwise(F.lit(0.0)))


def _accounts(spark, folder, scenarios=REGIMES, **kw) -> pf.Accounts:
    p = _panel(spark, folder)
    w = cut_lineage(sg.momentum(p, VARIANTS[:1]).unionByName(sg.reversal(p)))
    return pf.Accounts(p, w, scenarios, _terminal(spark, folder), **kw)


# ------------------------------------------------------------------ SQL

IDX = "idx AS (SELECT date, (row_number() OVER (ORDER BY date) - 1)::INT AS t FROM (SELECT DISTINCT date FROM bars))"
PN = "pn AS (SELECT t, ticker, open, high, low, close, volume FROM bars JOIN idx USING (date))"
BASE = (q.bars_cte(), IDX, PN)


def sides_sql(src_: str, p: str, low_sold: bool, share: str = "0.2::DOUBLE") -> str:
    a, b = ("-0.5 / m", "0.5 / m")
    body = f"CASE WHEN rn <= m THEN {a} WHEN rn > n - m THEN {b} END" if low_sold else f"CASE WHEN rn > n - m THEN {a} WHEN rn <= m THEN {b} END"
    return (
        f"{p}rk AS (SELECT *, row_number() OVER (PARTITION BY strategy_id, t ORDER BY score, ticker) AS rn, count(*) OVER (PARTITION BY strategy_id, t) AS n FROM {src_}"
        f" WHERE score IS NOT NULL), {p}bk AS (SELECT * FROM (SELECT *, {body} AS w FROM (SELECT *, greatest(1, floor(n * {share})) AS m FROM {p}rk WHERE n >= 10))"
        " WHERE w IS NOT NULL)"
    )


NOISE = "('0x' || substr(md5(concat_ws('|', 'ablation', ticker, t)), 1, 8))::BIGINT"


def momentum_sql(variants, panel: str = "pn", p: str = "m", share: str = "0.2::DOUBLE", noise: bool = False) -> str:
    score = f"CASE WHEN score IS NOT NULL THEN {NOISE} END" if noise else "score"
    sc = " UNION ALL ".join(
        f"SELECT '{v['strategy_id']}' AS strategy_id, {v['rebalance']} AS k, t, ticker, close / nullif(lag(close, {v['window']}) OVER (PARTITION BY ticker ORDER BY t), 0) - 1 AS score FROM {panel}"
        for v in variants
    )
    return (
        f"{p}sc AS (SELECT * REPLACE ({score} AS score) FROM ({sc}) WHERE t % k = k - 1), " + sides_sql(f"{p}sc", p, True, share)
        + f", {p}tm AS (SELECT DISTINCT strategy_id, k, t AS rt FROM {p}bk), {p}al AS (SELECT DISTINCT strategy_id, k FROM {p}bk),"
        f" {p}pt AS (SELECT a.strategy_id, a.k, d.t FROM {p}al a, (SELECT DISTINCT t FROM {panel}) d),"
        f" {p}as AS (SELECT x.strategy_id, x.k, x.t, y.rt FROM {p}pt x ASOF JOIN {p}tm y ON x.strategy_id = y.strategy_id AND x.t >= y.rt),"
        f" {p}w AS (SELECT s.strategy_id, s.t, b.ticker, b.w FROM {p}as s JOIN {p}bk b ON b.strategy_id = s.strategy_id AND b.t = s.rt JOIN {panel} c ON c.t = s.t AND"
        f" c.ticker = b.ticker WHERE s.t = s.rt OR s.t % s.k <> s.k - 1)"
    )


def ablated_sql(variants, panel: str = "pn", p: str = "a") -> str:
    """Books of variants that lack a part."""
    books = [momentum_sql([v], panel, f"{p}{i}", f"{v['quantile']}::DOUBLE", v.get("noise", False)) for i, v in enumerate(variants)]
    rows = " UNION ALL ".join(f"SELECT strategy_id, t, ticker, w FROM {p}{i}w" + (f" WHERE w * {v['side']} > 0" if v.get("side") else "") for i, v in enumerate(variants))
    return ", ".join([*books, f"{p}w AS ({rows})"])


def reversal_sql(panel: str = "pn", p: str = "r") -> str:
    return (
        f"{p}sc AS (SELECT 'reversal' AS strategy_id, t, ticker, CASE WHEN lag(t) OVER o = t - 1 THEN close / nullif(lag(close) OVER o, 0) - 1 END AS score FROM {panel}"
        f" WINDOW o AS (PARTITION BY ticker ORDER BY t)), " + sides_sql(f"{p}sc", p, False) + f", {p}w AS (SELECT strategy_id, t, ticker, w FROM {p}bk)"
    )


def scenario_sql(scenarios) -> str:
    keys = list(scenarios[0])

    def lit(v):
        return f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else repr(v)

    rows = " UNION ALL ".join("SELECT " + ", ".join(f"{lit(s[k])} AS {k}" for k in keys) for s in scenarios)
    return f"scen AS ({rows})"


TERMINAL = (
    "term AS (SELECT DISTINCT p_brand AS ticker, CASE WHEN regexp_extract(p_brand, '(\\d+)', 1)::INT % 5 = 4 THEN -0.3::DOUBLE ELSE 0.0::DOUBLE END AS delist_ret FROM part)"
)


def engine_sql(weights: str, scenarios, exit_where: str = "true") -> tuple[str, ...]:
    return (
        scenario_sql(scenarios), TERMINAL,
        "mx AS (SELECT max(t) AS last_t FROM pn)",
        "gr AS (SELECT k.ticker, i.t, open, close, coalesce(close * volume, 0) AS dollar FROM (SELECT DISTINCT ticker FROM pn) k CROSS JOIN idx i LEFT JOIN pn ON pn.ticker = k.ticker AND pn.t = i.t)",
        "gq AS (SELECT *, close / nullif(lag(close) OVER o, 0) - 1 AS ret, lead(open) OVER o AS nx FROM gr WINDOW o AS (PARTITION BY ticker ORDER BY t))",
        "st AS (SELECT ticker, t, open, close, nx, CASE WHEN t >= 5 THEN avg(dollar) OVER f END AS adv, CASE WHEN count(ret) OVER f >= 5 THEN stddev_samp(ret) OVER f END AS vol FROM gq"
        " WINDOW f AS (PARTITION BY ticker ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))",
        "ends AS (SELECT ticker, max(t) AS t_end FROM pn GROUP BY ticker)",
        f"cl AS (SELECT strategy_id, t, ticker, scen.*, greatest(least(w, max_weight), -max_weight) AS w FROM {weights} CROSS JOIN scen WHERE w <> 0)",
        "lw AS (SELECT * EXCLUDE (w), CASE WHEN g > max_gross THEN w * max_gross / g ELSE w END AS w FROM (SELECT *, sum(abs(w)) OVER (PARTITION BY strategy_id, scenario, t) AS g FROM cl))",
        "hd AS (SELECT lw.strategy_id, lw.scenario, lw.w, s.t, s.ticker, coalesce(CASE WHEN mode = 'open_to_close' THEN s.close / nullif(s.open, 0) - 1 WHEN s.t = t_end AND s.t < last_t THEN"
        " s.close / nullif(s.open, 0) * (1 + delist_ret - delist_haircut) - 1 ELSE nx / nullif(s.open, 0) - 1 END, 0) AS r FROM lw JOIN st s ON s.ticker = lw.ticker AND s.t = lw.t + 1 + latency_bars"
        " JOIN ends e ON e.ticker = s.ticker JOIN term ON term.ticker = s.ticker CROSS JOIN mx WHERE s.open IS NOT NULL AND (mode = 'open_to_close' OR s.t < last_t))",
        f"ex AS (SELECT strategy_id, scenario, hd.t + 1 AS t, hd.ticker, w AS w0 FROM hd JOIN scen USING (scenario) CROSS JOIN mx WHERE mode = 'open_to_open' AND hd.t + 1 <= last_t AND {exit_where})",
        "mv AS (SELECT coalesce(a.strategy_id, b.strategy_id) AS strategy_id, coalesce(a.scenario, b.scenario) AS scenario, coalesce(a.t, b.t) AS t, coalesce(a.ticker, b.ticker) AS ticker,"
        " coalesce(w, 0) AS w, coalesce(r, 0) AS r, coalesce(w0, 0) AS w0 FROM hd a FULL OUTER JOIN ex b ON a.strategy_id = b.strategy_id AND a.scenario = b.scenario AND a.t = b.t AND a.ticker = b.ticker)",
        "mc AS (SELECT mv.*, scen.* EXCLUDE (scenario), adv, vol, CASE WHEN mode = 'open_to_close' THEN 2 * abs(w) ELSE abs(w - w0) END AS dw FROM mv JOIN scen USING (scenario) JOIN st ON"
        " st.ticker = mv.ticker AND st.t = mv.t)",
        "ce AS (SELECT *, dw * (0.5 * default_spread_bps * spread_mult + slip_bps + comm_bps + open_penalty_bps + impact_coef * coalesce(vol, 0.02) * 1e4 * sqrt(greatest(least(CASE WHEN adv > 0"
        " THEN dw * capital / adv ELSE 0 END, 5), 0))) * 1e-4 AS cost FROM mc)",
        "pp AS (SELECT strategy_id, scenario, t, sum(w * r) AS gross, sum(cost) + (sum(greatest(-w, 0)) * any_value(borrow_bps_annual) + greatest(sum(abs(w)) - 1, 0) *"
        " any_value(financing_bps_annual)) * 1e-4 / any_value(periods_per_year) AS cost, sum(dw) AS turnover, sum(abs(w)) AS exposure, sum(w) AS net_exposure FROM ce GROUP BY 1, 2, 3)",
        f"rt AS (SELECT s.strategy_id, scen.scenario, idx.t, coalesce(gross, 0) AS gross, coalesce(cost, 0) AS cost, coalesce(turnover, 0) AS turnover, coalesce(exposure, 0) AS exposure,"
        f" coalesce(net_exposure, 0) AS net_exposure, coalesce(gross, 0) - coalesce(cost, 0) AS net FROM (SELECT DISTINCT strategy_id FROM {weights}) s CROSS JOIN scen CROSS JOIN idx"
        " LEFT JOIN pp ON pp.strategy_id = s.strategy_id AND pp.scenario = scen.scenario AND pp.t = idx.t)",
    )


BOTH = (momentum_sql(VARIANTS[:1]), reversal_sql(), "allw AS (SELECT strategy_id, t, ticker, w FROM mw UNION ALL SELECT strategy_id, t, ticker, w FROM rw)")
ENGINE = (*BASE, *BOTH, *engine_sql("allw", REGIMES))
LADDER = [BASELINE_EXEC, *pf.delay_ladder(), *pf.capacity_ladder()]
INTRADAY = [pf.scenario("intraday", mode="open_to_close", capital=1e6)]
SHARPE = "CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt(252) ELSE 0 END"
RETURN_COLS = ("gross", "cost", "turnover", "exposure", "net_exposure", "net")
RT_SELECT = "SELECT strategy_id, scenario, t, " + ", ".join(f"round({c}, 9) AS {c}" for c in RETURN_COLS) + " FROM rt"
EPISODES = (
    "ep AS (SELECT strategy_id, scenario, ticker, sign(w)::DOUBLE AS side, t, w * r - cost AS pnl, t - row_number() OVER (PARTITION BY strategy_id, scenario, ticker, sign(w) ORDER BY t) AS g"
    " FROM ce WHERE w <> 0), tr AS (SELECT strategy_id, scenario, ticker, side, min(t) AS t_in, max(t) AS t_out, sum(pnl) AS pnl FROM ep GROUP BY strategy_id, scenario, ticker, side, g)"
)


def _w(df):
    return df.select("strategy_id", "t", "ticker", F.round("w", 9).alias("w"))


def noise_sql(variants: int, phi: float = 0.97, shock: float = 0.25, rebalance: int = 5, panel: str = "pn", p: str = "n") -> str:
    """Books of smoothed keyed noise; the sum of all shocks with weights phi^lag is one running sum of shocks times phi^-t."""
    word = lambda at: f"('0x' || substr(md5(concat_ws('|', 'noise', v, ticker, t)), {at}, 8))::BIGINT"
    e = f"{shock}::DOUBLE * sqrt(-2.0::DOUBLE * ln(({word(1)} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)) * cos({word(9)} * {2 * math.pi / 4294967296.0!r}::DOUBLE)"
    return (
        f"{p}e AS (SELECT v, t, ticker, {e} AS e FROM {panel}, (SELECT unnest(range({variants})) AS v)),"
        f" {p}sc AS (SELECT * FROM (SELECT printf('noise%04d', v) AS strategy_id, t, ticker, sum(e * pow({phi}::DOUBLE, -t)) OVER (PARTITION BY v, ticker ORDER BY t) * pow({phi}::DOUBLE, t) AS score"
        f" FROM {p}e) WHERE t % {rebalance} = 0), " + sides_sql(f"{p}sc", p, True)
        + f", {p}w AS (SELECT strategy_id, h AS t, ticker, w FROM (SELECT strategy_id, ticker, w, unnest(range(t, t + {rebalance})) AS h FROM {p}bk) JOIN {panel} c USING (ticker) WHERE c.t = h)"
    )


def _noise_returns(spark, folder):
    """What a family of signals without information earns after costs."""
    p = _panel(spark, folder)
    w = cut_lineage(sg.noise_family(p, 4))
    return pf.Accounts(p, w, [BASELINE_EXEC], _terminal(spark, folder)).returns().select("strategy_id", "t", "gross", "cost", "net")


SIGNALS = {
    "momentum_weights": (
        lambda s, f: _w(sg.momentum(_panel(s, f), VARIANTS)),
        q.with_ctes(*BASE, momentum_sql(VARIANTS)) + "SELECT strategy_id, t, ticker, round(w, 9) AS w FROM mw",
    ),
    "ablation_weights": (
        lambda s, f: _w(sg.momentum(_panel(s, f), sg.ablations(VARIANTS))),
        q.with_ctes(*BASE, ablated_sql(sg.ablations(VARIANTS))) + "SELECT strategy_id, t, ticker, round(w, 9) AS w FROM aw",
    ),
    "reversal_weights": (
        lambda s, f: _w(sg.reversal(_panel(s, f))),
        q.with_ctes(*BASE, reversal_sql()) + "SELECT strategy_id, t, ticker, round(w, 9) AS w FROM rw",
    ),
    "score_weights": (
        lambda s, f: _w(sg.from_score(_panel(s, f).select(F.lit("volume").alias("strategy_id"), "t", "ticker", F.col("volume").alias("score")))),
        q.with_ctes(*BASE, "vs AS (SELECT 'volume' AS strategy_id, t, ticker, volume AS score FROM pn)", sides_sql("vs", "v", True)) + "SELECT strategy_id, t, ticker, round(w, 9) AS w FROM vbk",
    ),
    "leaky_next_return": (
        lambda s, f: _w(sg.leaky_next_return(_panel(s, f))),
        q.with_ctes(*BASE, "ls AS (SELECT 'leaky_next_return' AS strategy_id, t, ticker, coalesce(CASE WHEN lead(t) OVER o = t + 1 AND lead(t, 2) OVER o = t + 2 THEN lead(open, 2) OVER o /"
                    " nullif(lead(open) OVER o, 0) - 1 END, 0) AS score FROM pn WINDOW o AS (PARTITION BY ticker ORDER BY t))", sides_sql("ls", "l", True))
        + "SELECT strategy_id, t, ticker, round(w, 9) AS w FROM lbk",
    ),
    "leaky_centred_window": (
        lambda s, f: sg.leaky_centred_window(_panel(s, f)).groupBy("strategy_id", "t").agg(F.count_if(F.col("w") > 0).alias("longs"), F.count_if(F.col("w") < 0).alias("shorts")),
        q.with_ctes(*BASE, "n AS (SELECT t, count(*) AS n FROM pn GROUP BY t)")
        + "SELECT 'leaky_centred_window' AS strategy_id, t, greatest(1, floor(n * 0.2::DOUBLE))::BIGINT AS longs, greatest(1, floor(n * 0.2::DOUBLE))::BIGINT AS shorts FROM n"
        " WHERE n >= 10 AND t >= 5 AND t <= (SELECT max(t) FROM pn) - 5",
    ),
    "leaky_full_sample_scale": (
        lambda s, f: _round(sg.leaky_full_sample_scale(_panel(s, f), VARIANTS[0]), "w", digits=7),
        q.with_ctes(*BASE, momentum_sql(VARIANTS[:1]), "lr AS (SELECT CASE WHEN lag(t) OVER o = t - 1 THEN ln(close) - ln(lag(close) OVER o) END AS lr FROM pn WINDOW o AS (PARTITION BY ticker ORDER BY t))")
        + "SELECT strategy_id, t, ticker, round(w * 0.02 / (SELECT stddev_pop(lr) FROM lr), 7) AS w FROM mw",
    ),
    "noise_family": (
        lambda s, f: sg.noise_family(_panel(s, f), 4).groupBy("strategy_id", "t").agg(
            F.count("*").alias("names"), F.round(F.sum(F.abs("w")), 6).alias("gross"), F.round(F.sum("w"), 6).alias("net")),
        q.with_ctes(*BASE, noise_sql(4)) + "SELECT strategy_id, t, count(*) AS names, round(sum(abs(w)), 6) AS gross, round(sum(w), 6) AS net FROM nw GROUP BY 1, 2",
    ),
    "noise_returns": (
        lambda s, f: _round(_noise_returns(s, f), "gross", "cost", "net", digits=9),
        q.with_ctes(*BASE, noise_sql(4), *engine_sql("nw", [BASELINE_EXEC])) + "SELECT strategy_id, t, round(gross, 9) AS gross, round(cost, 9) AS cost, round(net, 9) AS net FROM rt",
    ),
}

POSITIONS = {
    "positions": (
        lambda s, f: _round(_accounts(s, f).cells().select("strategy_id", "scenario", "t", "ticker", "w", "r", "dw", "cost"), "w", "r", "dw", "cost", digits=9),
        q.with_ctes(*ENGINE) + "SELECT strategy_id, scenario, t, ticker, round(w, 9) AS w, round(r, 9) AS r, round(dw, 9) AS dw, round(cost, 9) AS cost FROM ce",
    ),
    "position_limits": (
        lambda s, f: _round(_accounts(s, f, [pf.scenario("tight", max_weight=0.05, max_gross=0.3)]).limited().select("strategy_id", "scenario", "t", "ticker", "w"), "w", digits=9),
        q.with_ctes(*BASE, *BOTH, *engine_sql("allw", [pf.scenario("tight", max_weight=0.05, max_gross=0.3)])) + "SELECT strategy_id, scenario, t, ticker, round(w, 9) AS w FROM lw",
    ),
    "returns_net": (lambda s, f: _round(_accounts(s, f).returns(), *RETURN_COLS, digits=9), q.with_ctes(*ENGINE) + RT_SELECT),
    "returns_intraday": (
        lambda s, f: _round(_accounts(s, f, INTRADAY).returns(), *RETURN_COLS, digits=9),
        q.with_ctes(*BASE, *BOTH, *engine_sql("allw", INTRADAY)) + RT_SELECT,
    ),
    "returns_free_exit": (
        lambda s, f: _round(_accounts(s, f, [BASELINE_EXEC], charge_forced_exit=False).returns(), *RETURN_COLS, digits=9),
        q.with_ctes(*BASE, *BOTH, *engine_sql("allw", [BASELINE_EXEC], "EXISTS (SELECT 1 FROM pn WHERE pn.ticker = hd.ticker AND pn.t = hd.t + 1)")) + RT_SELECT,
    ),
    "trade_episodes": (
        lambda s, f: _round(pf.trade_episodes(_accounts(s, f).cells()), "pnl", digits=8),
        q.with_ctes(*ENGINE, EPISODES) + "SELECT strategy_id, scenario, ticker, side, t_in, t_out, round(pnl, 8) AS pnl FROM tr",
    ),
    "break_even": (
        lambda s, f: _round(pf.break_even(_accounts(s, f).returns()), "extra_bps_per_side", "cost_multiple", digits=5),
        q.with_ctes(*ENGINE) + "SELECT strategy_id, scenario, round(CASE WHEN avg(turnover) <= 0 THEN 'inf'::DOUBLE ELSE avg(net) / avg(turnover) * 1e4 END, 5) AS extra_bps_per_side,"
        " round(CASE WHEN avg(turnover) <= 0 OR avg(cost) <= 0 THEN 'inf'::DOUBLE ELSE avg(gross) / avg(cost) END, 5) AS cost_multiple FROM rt GROUP BY 1, 2",
    ),
    "scenario_sharpe": (
        lambda s, f: _round(moments.sharpe_table(_accounts(s, f, LADDER).returns(), "net", ("strategy_id", "scenario")), "sharpe"),
        q.with_ctes(*BASE, *BOTH, *engine_sql("allw", LADDER)) + f"SELECT strategy_id, scenario, round({SHARPE}, 6) AS sharpe FROM rt GROUP BY 1, 2",
    ),
    "assumption_counts": (
        lambda s, f: _accounts(s, f).assumptions(),
        q.with_ctes(*ENGINE) + "SELECT strategy_id, scenario, count(*) FILTER (w <> 0) AS default_spread_held_cells, count(*) FILTER (vol IS NULL AND dw > 0) AS default_vol_traded_cells,"
        " 'assumed_constant' AS spread_source FROM ce GROUP BY 1, 2",
    ),
    "missing_cells": (
        lambda s, f: pf.missing_cells(_holes(s, f)).groupBy("ticker").agg(F.count("*").alias("cells")),
        q.with_ctes(q.bars_cte(), IDX, PN, "life AS (SELECT ticker, min(t) AS a, max(t) AS b FROM pn GROUP BY ticker)")
        + "SELECT life.ticker, count(*) AS cells FROM life JOIN idx ON idx.t BETWEEN a AND b LEFT JOIN pn ON pn.ticker = life.ticker AND pn.t = idx.t WHERE pn.open IS NULL GROUP BY 1",
    ),
    "unknown_terminals": (
        lambda s, f: _undocumented(s, f).unknown_terminals(),
        q.with_ctes(*ENGINE) + "SELECT strategy_id, scenario, hd.t, hd.ticker FROM hd JOIN ends e ON e.ticker = hd.ticker CROSS JOIN mx WHERE hd.t = t_end AND hd.t < last_t",
    ),
}


def _holes(spark, folder):
    """Dense panel in which no hole is documented."""
    return pan.densify(src.staged_daily_bars(spark, folder)).withColumn("excluded", F.lit(False))


def _undocumented(spark, folder):
    a = _accounts(spark, folder)
    return pf.Accounts(a.panel, a.weights, REGIMES, None)


def _unguarded(spark, folder):
    """Books of the observed panel on a dense one whose holes nobody documented, without terminal returns."""
    a = _accounts(spark, folder)
    return pf.Accounts(cut_lineage(_holes(spark, folder)), a.weights, [BASELINE_EXEC], None)


def _flags(spark, folder):
    """Every strategy as a family of its own, so that a search of one is pointed out."""
    a = _accounts(spark, folder, LADDER)
    cells = cut_lineage(a.cells())
    r = cut_lineage(a.returns(cells))
    b = r.where("scenario = 'baseline'")
    trades = pf.trade_episodes(cells.where("scenario = 'baseline'")).groupBy("strategy_id").agg(F.count("*").alias("n_trades"))
    families = b.select("strategy_id", F.col("strategy_id").alias("family")).distinct()
    ladders = moments.sharpe_table(r, "net", ("strategy_id", "scenario"))
    return guards.flags(a.assumptions(cells), ladders, trades, b.select("strategy_id", "t", F.col("net").alias("r")), families)


GUARDS = (
    "hl AS (SELECT life.ticker, idx.t FROM (SELECT ticker, min(t) AS a, max(t) AS b FROM pn GROUP BY ticker) life JOIN idx ON idx.t BETWEEN a AND b LEFT JOIN pn ON pn.ticker = life.ticker AND pn.t = idx.t"
    " WHERE pn.open IS NULL)"
)
GUARDS_SELECT = (
    "SELECT strategy_id, 'held_missing_price' AS check, count(*) AS n FROM lw JOIN hl ON hl.ticker = lw.ticker AND hl.t = lw.t + 1 + latency_bars GROUP BY 1 UNION ALL"
    " SELECT strategy_id, 'unknown_terminal_return', count(*) FROM hd JOIN ends e ON e.ticker = hd.ticker CROSS JOIN mx WHERE hd.t = t_end AND hd.t < last_t GROUP BY 1"
)
_Z95, _Z80 = NormalDist().inv_cdf(0.95), NormalDist().inv_cdf(0.8)
FLAGS = (
    f"sh AS (SELECT strategy_id, scenario, count(*) AS n, {SHARPE} AS s FROM rt GROUP BY 1, 2)",
    f"pz AS (SELECT strategy_id, n, greatest(s, 0) / sqrt(252) * sqrt(n) - {_Z95!r} AS z FROM sh WHERE scenario = 'baseline')",
    "pv AS (SELECT strategy_id, max(s) FILTER (scenario = 'baseline') AS s0, max(s) FILTER (scenario = 'delay+1') AS s1 FROM sh GROUP BY 1)",
    "cp AS (SELECT strategy_id, max(c) FILTER (s > 0) AS most, max(c) AS tried FROM (SELECT strategy_id, s, substr(scenario, 9)::DOUBLE AS c FROM sh WHERE scenario LIKE 'capital=%') GROUP BY 1)",
    f"fl AS (SELECT strategy_id, 'assumed_spread' AS flag, count(*)::DOUBLE AS value FROM ce WHERE scenario = 'baseline' AND w <> 0 GROUP BY 1 UNION ALL"
    f" SELECT strategy_id, 'delay_fragility', s1 FROM pv WHERE s0 > 1 AND s1 < 0.15 * s0 UNION ALL SELECT strategy_id, 'capacity', most FROM cp WHERE most IS NULL OR most < tried UNION ALL"
    f" SELECT strategy_id, 'few_trades', count(*) FROM tr WHERE scenario = 'baseline' GROUP BY 1 HAVING count(*) < 20 UNION ALL SELECT DISTINCT strategy_id, 'single_variant', 1 FROM rt UNION ALL"
    f" SELECT strategy_id, 'low_power', {(_Z95 + _Z80) * math.sqrt(252)!r} / sqrt(n) FROM pz WHERE {q.cdf_sql('z')} < 0.5)",
)

# ------------------------------------------------------------------ leakage


def _mom(p):
    return sg.momentum(p, VARIANTS[:1])


def _scaled(p):
    return sg.leaky_full_sample_scale(p, sg.variant("leaky_scale", window=10))


def _suite(pipeline):
    return lambda s, f: _round(leakage.leakage_suite(pipeline, _panel(s, f)), "max_abs_diff")


CUTS, SCRAMBLES = (0.5, 0.7, 0.85), (0.5, 0.75)


def _leaky_sql(panel: str, p: str) -> str:
    return (
        f"{p}s AS (SELECT 'leaky_next_return' AS strategy_id, t, ticker, coalesce(CASE WHEN lead(t) OVER o = t + 1 AND lead(t, 2) OVER o = t + 2 THEN lead(open, 2) OVER o / nullif(lead(open) OVER o, 0) - 1"
        f" END, 0) AS score FROM {panel} WINDOW o AS (PARTITION BY ticker ORDER BY t)), " + sides_sql(f"{p}s", p, True) + f", {p}w AS (SELECT strategy_id, t, ticker, w FROM {p}bk)"
    )


def _log_returns_sql(panel: str, p: str) -> str:
    return f"{p}lr AS (SELECT t, ticker, CASE WHEN lag(t) OVER o = t - 1 THEN ln(close) - ln(lag(close) OVER o) END AS lr FROM {panel} WINDOW o AS (PARTITION BY ticker ORDER BY t))"


def _centred_sql(panel: str, p: str) -> str:
    return (
        _log_returns_sql(panel, p) + f", {p}cs AS (SELECT 'leaky_centred_window' AS strategy_id, t, ticker, coalesce(avg(lr) OVER (PARTITION BY ticker ORDER BY t RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING), 0)"
        f" AS score FROM {p}lr QUALIFY t >= 5 AND t <= (SELECT max(t) FROM {panel}) - 5), " + sides_sql(f"{p}cs", p, True) + f", {p}w AS (SELECT strategy_id, t, ticker, w FROM {p}bk)"
    )


def _scaled_sql(panel: str, p: str) -> str:
    return (
        momentum_sql([sg.variant("leaky_scale", window=10)], panel, f"{p}m") + ", " + _log_returns_sql(panel, p)
        + f", {p}w AS (SELECT strategy_id, t, ticker, w * 0.02 / (SELECT stddev_pop(lr) FROM {p}lr) AS w FROM {p}mw)"
    )


def _history_sql(test: str, i: int, cut: float) -> str:
    """A truncated or scrambled copy of the panel, named after the test's first letter."""
    k = f"(SELECT floor((max(t) + 1) * {cut}::DOUBLE)::INT FROM pn)"
    if test == "t":
        return f"t{i} AS (SELECT * FROM pn WHERE t < {k})"
    word = lambda at: f"('0x' || substr(md5(concat_ws('|', '0', t_new, ticker)), {at}, 8))::BIGINT"
    noise = f"sqrt(-2.0::DOUBLE * ln(({word(1)} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)) * cos({word(9)} * {2 * math.pi / 4294967296.0!r}::DOUBLE)"
    return (
        f"s{i}m AS (SELECT t, {k} + row_number() OVER (ORDER BY md5(concat_ws('|', '0', t))) - 1 AS t_new FROM (SELECT DISTINCT t FROM pn) WHERE t >= {k}), s{i} AS (SELECT coalesce(t_new, t)::INT AS t, ticker,"
        f" open * m AS open, high * m AS high, low * m AS low, close * m AS close, volume FROM (SELECT pn.*, t_new, CASE WHEN t_new IS NULL THEN 1 ELSE exp({noise} * 0.05::DOUBLE) END AS m FROM pn LEFT JOIN s{i}m USING (t)))"
    )


def diffs_sql(weights, tests: str = "ts", digits: int = 9) -> str:
    """Rows (test, strategy_id, cut, max_abs_diff); ``weights(panel, prefix)`` gives CTEs ending in <prefix>w."""
    ctes, rows = [weights("pn", "f")], []
    for test, name, cuts in (("t", "truncation_invariance", CUTS), ("s", "future_scramble", SCRAMBLES)):
        for i, c in enumerate(cuts if test in tests else ()):
            ctes += [_history_sql(test, i, c), weights(f"{test}{i}", f"x{test}{i}")]
            k = f"t < (SELECT floor((max(t) + 1) * {c}::DOUBLE) FROM pn)"
            rows.append(
                f"SELECT '{name}' AS test, coalesce(a.strategy_id, b.strategy_id) AS strategy_id, {c}::DOUBLE AS cut, round(max(abs(coalesce(a.w, 0) - coalesce(b.w, 0))), {digits}) AS max_abs_diff FROM (SELECT * FROM fw"
                f" WHERE {k}) a FULL OUTER JOIN (SELECT * FROM x{test}{i}w WHERE {k}) b ON a.strategy_id = b.strategy_id AND a.t = b.t AND a.ticker = b.ticker GROUP BY 2"
            )
    return q.with_ctes(*BASE, *ctes) + " UNION ALL ".join(rows)


def suite_sql(weights) -> str:
    return f"SELECT test, strategy_id, round(max(max_abs_diff), 6) AS max_abs_diff, max(max_abs_diff) <= 1e-9::DOUBLE AS passed FROM ({diffs_sql(weights, digits=12)}) GROUP BY 1, 2"


def _mom_sql(panel: str, p: str) -> str:
    return momentum_sql(VARIANTS[:1], panel, p)


def _diffs(pipeline, **kw):
    return lambda s, f: _round(leakage.suite_diffs(pipeline, _panel(s, f), **kw), "max_abs_diff", digits=9)


LEAKAGE = {
    "truncation_diff": (_diffs(_mom, scrambles=()), diffs_sql(_mom_sql, "t")),
    "truncation_diff_leaky": (_diffs(sg.leaky_next_return, scrambles=()), diffs_sql(_leaky_sql, "t")),
    "scramble_diff": (_diffs(_mom, cuts=()), diffs_sql(_mom_sql, "s")),
    "scramble_diff_leaky": (_diffs(sg.leaky_next_return, cuts=()), diffs_sql(_leaky_sql, "s")),
    "leakage_suite_momentum": (_suite(_mom), suite_sql(_mom_sql)),
    "leakage_suite_next_return": (_suite(sg.leaky_next_return), suite_sql(_leaky_sql)),
    "leakage_suite_centred": (_suite(sg.leaky_centred_window), suite_sql(_centred_sql)),
    "leakage_suite_scaled": (_suite(_scaled), suite_sql(_scaled_sql)),
    "implausible_performance": (
        lambda s, f: _round(leakage.implausible_performance(moments.sharpe_table(_accounts(s, f, [BASELINE_EXEC]).returns(), "net")), "sharpe"),
        q.with_ctes(*BASE, *BOTH, *engine_sql("allw", [BASELINE_EXEC])) + f"SELECT strategy_id, round({SHARPE}, 6) AS sharpe, {SHARPE} < 5 AS passed FROM rt GROUP BY 1",
    ),
    "delay_fragility": (
        lambda s, f: _round(leakage.delay_fragility(moments.sharpe_table(_accounts(s, f, LADDER[:3]).returns(), "net", ("strategy_id", "scenario"))), "sharpe0", "sharpe1"),
        q.with_ctes(*BASE, *BOTH, *engine_sql("allw", LADDER[:3]), f"sh AS (SELECT strategy_id, scenario, {SHARPE} AS s FROM rt GROUP BY 1, 2)",
                    "pv AS (SELECT strategy_id, max(s) FILTER (scenario = 'baseline') AS s0, max(s) FILTER (scenario = 'delay+1') AS s1 FROM sh GROUP BY 1)")
        + "SELECT strategy_id, round(s0, 6) AS sharpe0, round(s1, 6) AS sharpe1, NOT (s0 > 1 AND s1 < 0.15 * s0) AS passed FROM pv",
    ),
}

# ------------------------------------------------------------------ ablations

ABLATED = sg.ablations(VARIANTS[:1])


def _ablated(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Sharpe ratios of a momentum strategy with and without each part, from one set of books, and which lacks which."""
    p = _panel(spark, folder)
    w = cut_lineage(sg.momentum(p, [*VARIANTS[:1], *ABLATED]))
    pairs = spark.createDataFrame([(v["base"], v["strategy_id"]) for v in ABLATED], "strategy_id string, ablation string")
    return ablated_sharpes(p, w, _terminal(spark, folder)), pairs


def _ablation_sharpes(spark, folder):
    sharpes, pairs = _ablated(spark, folder)
    return sharpes.join(pairs.select(F.col("ablation").alias("strategy_id"), F.col("strategy_id").alias("base")), "strategy_id", "left")


ABLATIONS = (*BASE, momentum_sql(VARIANTS[:1]), ablated_sql(ABLATED), "allw AS (SELECT strategy_id, t, ticker, w FROM mw UNION ALL SELECT strategy_id, t, ticker, w FROM aw)",
             *engine_sql("allw", [BASELINE_EXEC]), f"ab AS (SELECT strategy_id, split_part(strategy_id, '-', 1) AS base, {SHARPE} AS s FROM rt GROUP BY 1)")

EVALUATION = {
    "ablation_sharpes": (
        lambda s, f: _round(_ablation_sharpes(s, f), "sharpe"),
        q.with_ctes(*ABLATIONS) + "SELECT strategy_id, nullif(base, strategy_id) AS base, round(s, 6) AS sharpe FROM ab",
    ),
    "ablation_flags": (
        lambda s, f: _round(sc.flags(*_ablated(s, f)), "ablation_sharpe", "sharpe"),
        q.with_ctes(*ABLATIONS) + "SELECT a.base AS strategy_id, a.strategy_id AS ablation, round(a.s, 6) AS ablation_sharpe, round(b.s, 6) AS sharpe FROM ab a JOIN ab b ON b.strategy_id = a.base"
        " WHERE a.strategy_id <> a.base AND a.s >= 0.9 * b.s",
    ),
    "evaluation_guards": (lambda s, f: guards.gap_failures(_unguarded(s, f)), q.with_ctes(*BASE, *BOTH, *engine_sql("allw", [BASELINE_EXEC]), GUARDS) + GUARDS_SELECT),
    "evaluation_flags": (
        lambda s, f: _round(_flags(s, f), "value", digits=5),
        q.with_ctes(*BASE, *BOTH, *engine_sql("allw", LADDER), EPISODES, *FLAGS) + "SELECT strategy_id, flag, round(value, 5) AS value FROM fl",
    ),
}

QUERIES = {**SIGNALS, **POSITIONS, **LEAKAGE, **EVALUATION}
