"""Statistics queries over the variant returns, with their verification SQL."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from ..constants import EULER_GAMMA
from ..operators import moments, multiple, panel as pan, regression, resampling as rs, signals as sg, trades
from ..operators.portfolio import Accounts, scenario
from ..session import cut_lineage
from ..sources import tables as src
from . import sqltext as q
from .integrity_queries import _round
from .portfolio_queries import BASE, VARIANTS, _panel, engine_sql, momentum_sql, _terminal

B, BLOCK, SEED = 1000, 10, 7
N_TRIALS = 50.0


def _vr(spark, folder):
    return cut_lineage(src.variant_returns(spark, folder))


def _alpha(spark, folder):
    r = _vr(spark, folder)
    return regression.factor_regression(r, src.market_returns(r), ["b"])


MOM = (
    "mo AS (SELECT strategy_id, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS sd, avg(r * r) AS m2, avg(r * r * r) AS m3, avg(r * r * r * r) AS m4 FROM vr GROUP BY 1)",
    "mk AS (SELECT *, (m3 - 3 * mean * m2 + 2 * mean * mean * mean) / pow(m2 - mean * mean, 1.5) AS skew,"
    " (m4 - 4 * mean * m3 + 6 * mean * mean * m2 - 3 * mean * mean * mean * mean) / pow(m2 - mean * mean, 2) AS kurt FROM mo)",
)


def ppf_ctes(src_: str, p: str, name: str, keep: str) -> str:
    """Two-step quantile of column ``p``: start value, then one Halley step."""
    z = "z"
    step = f"(({q.cdf_sql(z)}) - p) * {math.sqrt(2 * math.pi)!r} * exp(z * z / 2)"
    return (
        f"{name}_0 AS (SELECT {keep}, {p} AS p FROM {src_}), {name}_1 AS (SELECT *, {q.ppf_start_sql('p')} AS z FROM {name}_0),"
        f" {name}_2 AS (SELECT *, {step} AS e FROM {name}_1), {name} AS (SELECT {keep}, z - e / (1 + z * e / 2) AS x FROM {name}_2)"
    )


DSR = (
    *MOM,
    ppf_ctes("mk", f"1 - 1 / {N_TRIALS}::DOUBLE", "q1", "strategy_id"),
    ppf_ctes("mk", f"1 - 1 / ({N_TRIALS}::DOUBLE * {math.e!r})", "q2", "strategy_id"),
    f"ds AS (SELECT mk.*, mean / sd AS sr, sqrt(1.0 / n) * ({1 - EULER_GAMMA!r} * q1.x + {EULER_GAMMA!r} * q2.x) AS sr0 FROM mk JOIN q1 USING (strategy_id) JOIN q2 USING (strategy_id))",
    "dz AS (SELECT *, (sr - sr0) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS z FROM ds)",
)
DD = (
    "eq AS (SELECT strategy_id, t, product(1 + r) OVER (PARTITION BY strategy_id ORDER BY t) AS e FROM vr)",
    "dd AS (SELECT strategy_id, min((e - pk) / pk) AS mdd FROM (SELECT *, max(e) OVER (PARTITION BY strategy_id ORDER BY t) AS pk FROM eq) GROUP BY 1)",
)
_P = 1 / BLOCK
BOOT = (
    f"tt AS (SELECT n, ceil(n * {_P!r}::DOUBLE + 10 * sqrt(n * {_P * (1 - _P)!r}::DOUBLE) + 20)::BIGINT AS most FROM (SELECT max(t) + 1 AS n FROM vr))",
    f"bx AS (SELECT b, j, n, most, 1 + floor(ln(1 - {q.unif(repr(str(SEED)), repr('p'), 'b', 'j')}) / {math.log(1 - _P)!r}::DOUBLE)::BIGINT AS size, floor({q.unif(repr(str(SEED)), repr('s'), 'b', 'j')} * n)::BIGINT"
    f" AS s FROM tt, LATERAL (SELECT unnest(range({B})) AS b), LATERAL (SELECT unnest(range(most)) AS j))",
    "by_ AS (SELECT *, sum(size) OVER (PARTITION BY b ORDER BY j)::BIGINT - size AS at_ FROM bx)",
    "bz AS (SELECT b, n, s, at_, CASE WHEN j = most - 1 THEN n - at_ ELSE least(size, n - at_) END AS len FROM by_ WHERE at_ < n)",
    "bi AS (SELECT b, at_ + i AS t, (s + i) % n AS idx FROM bz, LATERAL (SELECT unnest(range(len)) AS i))",
    "bs AS (SELECT strategy_id, b, sum(r) AS s1, sum(r * r) AS s2 FROM bi JOIN vr ON vr.t = bi.idx GROUP BY 1, 2)",
    "bm AS (SELECT strategy_id, split_part(strategy_id, '/', 1) AS family, avg(r) AS mu FROM vr GROUP BY 1)",
)
RC = "b1 AS (SELECT family, b, max(sqrt(n) * (s1 / n - mu)) AS vb, max(sqrt(n) * mu) AS v FROM bs JOIN bm USING (strategy_id), tt GROUP BY family, b)"
SPA = (
    "b2 AS (SELECT family, strategy_id, b, n, mu, sqrt(n) * (s1 / n - mu) AS d FROM bs JOIN bm USING (strategy_id), tt)",
    "b3 AS (SELECT b2.*, om, sqrt(n) * mu / om AS ts FROM b2 JOIN (SELECT strategy_id, greatest(stddev_samp(d), 1e-12) AS om FROM b2 GROUP BY 1) USING (strategy_id))",
    "b4 AS (SELECT family, b, greatest(max(d / om + sqrt(n) * CASE WHEN ts <= -sqrt(2 * ln(ln(n))) THEN mu ELSE 0 END / om), 0) AS vb, greatest(max(ts), 0) AS v FROM b3 GROUP BY family, b)",
)
FAMILY = ["family"]


def _families(spark, folder):
    """Variant returns with the order priority as their search family."""
    return _vr(spark, folder).withColumn("family", F.split("strategy_id", "/")[0])


def _pvals(spark, folder):
    """A p-value per order: the cube of the cents below a hundred thousand, so that ties and discoveries occur."""
    o = src.table(spark, folder, "orders")
    u = (1 + F.round(F.col("o_totalprice") * 100).cast("long") % 100000) / F.lit(100001.0)
    return o.select("o_orderkey", (u * u * u * u).alias("p"))


PV = "pv AS (SELECT o_orderkey, u * u * u * u AS p FROM (SELECT o_orderkey, (1 + round(o_totalprice * 100)::BIGINT % 100000) / 100001.0::DOUBLE AS u FROM orders))"


def _line_trades(spark, folder):
    """Line items as closed trades of six books."""
    li = src.table(spark, folder, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long") - F.round(F.col("l_quantity") * 130000).cast("long")
    return li.select(F.concat("l_returnflag", "l_linestatus").alias("strategy_id"), (cents / F.lit(1e6)).alias("pnl"))


LT = (
    "lt AS (SELECT l_returnflag || l_linestatus AS strategy_id, (round(l_extendedprice * 100)::BIGINT - round(l_quantity * 130000)::BIGINT) / 1e6 AS pnl FROM lineitem),"
    " lk AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY pnl DESC) AS d, row_number() OVER (PARTITION BY strategy_id ORDER BY pnl) AS a,"
    " count(*) OVER (PARTITION BY strategy_id) AS n FROM lt)"
)
P1, P5 = "ceil(0.01::DOUBLE * n)", "ceil(0.05::DOUBLE * n)"


def _top(k):
    return f"coalesce(sum(pnl) FILTER (d <= {k}), 0)"


CONC = (
    "SELECT strategy_id, count(*) AS n_trades, " + ", ".join(
        f"round(CASE WHEN sum(pnl) > 0 THEN {_top(k)} / sum(pnl) END, 6) AS {nm}"
        for k, nm in (("1", "top1_share"), ("5", "top5_share"), ("10", "top10_share"), (P1, "top1pct_share"), (P5, "top5pct_share"))
    ) + ", " + ", ".join(
        f"round(sum(pnl) FILTER ({cond}), 4) AS {nm}"
        for cond, nm in (("d > 1", "net_without_best"), ("a > 1", "net_without_worst"), (f"d > {P1}", "net_without_top1pct"), (f"a > {P1}", "net_without_bottom1pct"),
                         (f"d > {P5}", "net_without_top5pct"), (f"a > {P5}", "net_without_bottom5pct"))
    ) + " FROM lk GROUP BY 1"
)
CONC_SHARES = ("top1_share", "top5_share", "top10_share", "top1pct_share", "top5pct_share")
CONC_NETS = ("net_without_best", "net_without_worst", "net_without_top1pct", "net_without_bottom1pct", "net_without_top5pct", "net_without_bottom5pct")


def _conc(spark, folder):
    c = trades.concentration(_line_trades(spark, folder))
    return _round(_round(c, *CONC_SHARES), *CONC_NETS, digits=4)


S = 16
PBO_SQL = (
    f"WITH {q.VARIANTS}, tt AS (SELECT max(t) + 1 AS n FROM vr), sl AS (SELECT strategy_id, r, CASE WHEN t < (n % {S}) * (n // {S} + 1) THEN t // (n // {S} + 1) ELSE n % {S} +"
    f" (t - (n % {S}) * (n // {S} + 1)) // (n // {S}) END AS s FROM vr, tt), mk AS (SELECT unnest(range({1 << S})) AS m), ms AS (SELECT m FROM mk WHERE bit_count(m::INT) = {S // 2}),"
    f" ps AS (SELECT strategy_id, s, count(*) AS n, sum(r) AS a, sum(r * r) AS b FROM sl GROUP BY 1, 2), ag AS (SELECT m, strategy_id, sum(n) FILTER ((m >> s) & 1 = 1) AS ni, sum(a) FILTER ((m >> s) & 1 = 1) AS ai, sum(b) FILTER ((m >> s) & 1 = 1) AS bi,"
    " sum(n) FILTER ((m >> s) & 1 = 0) AS no, sum(a) FILTER ((m >> s) & 1 = 0) AS ao, sum(b) FILTER ((m >> s) & 1 = 0) AS bo FROM ps, ms GROUP BY 1, 2),"
    " sr AS (SELECT m, strategy_id, ai / ni / sqrt((bi - ai * ai / ni) / (ni - 1)) AS i, ao / no / sqrt((bo - ao * ao / no) / (no - 1)) AS o FROM ag),"
    " sf AS (SELECT *, split_part(strategy_id, '/', 1) AS family FROM sr), be AS (SELECT family, m, arg_max(o, i) AS best, count(*) AS k FROM sf GROUP BY family, m), rk AS (SELECT family, sf.m, any_value(k) AS k, (count(*) FILTER (o < best) + 0.5 * (count(*) FILTER (o = best) - 1) + 0.5) / any_value(k) AS w"
    " FROM sf JOIN be USING (family, m) GROUP BY family, sf.m) SELECT family, round(avg(CASE WHEN w <= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS pbo, count(*) AS n_combos, max(k) AS variants FROM rk GROUP BY 1"
)
THR = 0.02
EFF = (
    "vk AS (SELECT *, split_part(strategy_id, '/', 1) AS family, row_number() OVER (PARTITION BY split_part(strategy_id, '/', 1) ORDER BY strategy_id) AS i FROM (SELECT DISTINCT strategy_id FROM vr)),"
    " vi2 AS (SELECT family, i, t, r FROM vr JOIN vk USING (strategy_id)), cm AS (SELECT a.family, a.i AS a, b.i AS b, coalesce(corr(a.r, b.r), 0) AS c FROM vi2 a JOIN vi2 b ON a.family = b.family AND a.t = b.t"
    " AND b.i < a.i GROUP BY 1, 2, 3), g AS (SELECT DISTINCT family, 1::BIGINT AS i, [1]::BIGINT[] AS l FROM vk UNION ALL SELECT family, i + 1, CASE WHEN EXISTS (SELECT 1 FROM cm WHERE cm.family = g.family AND"
    f" cm.a = g.i + 1 AND list_contains(g.l, cm.b) AND abs(c) >= {THR}) THEN l ELSE list_append(l, (i + 1)::BIGINT) END FROM g WHERE i < (SELECT max(i) FROM vk WHERE vk.family = g.family)),"
    " ef AS (SELECT family, arg_max(len(l), i) AS effective, max(i) AS variants FROM g GROUP BY 1)"
)
EFF_SQL = f"WITH RECURSIVE {q.VARIANTS}, {EFF} SELECT family, effective, variants FROM ef"

SHIFT_SCEN = [scenario("base")]
DRAWS = 1000


def _shift_accounts(spark, folder):
    p = _panel(spark, folder)
    return Accounts(p, cut_lineage(sg.momentum(p, VARIANTS[:1])), SHIFT_SCEN, _terminal(spark, folder)), p


def _shift(spark, folder):
    a, p = _shift_accounts(spark, folder)
    held = a.cells().where("w <> 0").select("strategy_id", "t", "ticker", "w")
    r = pan.next_open(p).select("t", "ticker", F.coalesce(F.col("next_open") / F.nullif(F.col("open"), F.lit(0.0)) - 1, F.lit(0.0)).alias("r"))
    m = rs.shifted_means(held, r, p.agg(F.max("t") + 1).scalar(), DRAWS, 20, SEED)
    return _round(rs.shift_pvalue(m), "observed", "p", "null_avg")


SHIFT_SQL = (
    q.with_ctes(*BASE, momentum_sql(VARIANTS[:1]), *engine_sql("mw", SHIFT_SCEN), "tt AS (SELECT max(t) + 1 AS n FROM pn)",
                "rr AS (SELECT ticker, t, nx / nullif(open, 0) - 1 AS r FROM st WHERE open IS NOT NULL AND nx IS NOT NULL)",
                f"sh AS (SELECT i, (20 + floor({q.unif(repr(str(SEED)), repr('shift'), 'i')} * (greatest(n - 20, 21) - 20)))::BIGINT AS k FROM tt, LATERAL (SELECT unnest(range({DRAWS})) AS i)"
                " UNION ALL SELECT -1, 0)",
                "sm AS (SELECT strategy_id, i, sum(w * rr.r) / any_value(n) AS m FROM hd CROSS JOIN sh CROSS JOIN tt JOIN rr ON rr.ticker = hd.ticker AND rr.t = (hd.t + k) % n GROUP BY 1, 2)")
    + "SELECT strategy_id, round(any_value(o.m), 6) AS observed, round((1 + count(*) FILTER (sm.m >= o.m)) / (1 + count(*)), 6) AS p, round(avg(sm.m), 6) AS null_avg FROM sm JOIN"
    " (SELECT strategy_id, m FROM sm WHERE i < 0) o USING (strategy_id) WHERE i >= 0 GROUP BY 1"
)
FLIPS = 5024
FLIP_SQL = (
    q.with_ctes(q.VARIANTS, f"fx AS (SELECT t, g, ('0x' || substr(md5(concat_ws('|', '{SEED}', 'flip', g, t)), 1, 8))::BIGINT AS h FROM (SELECT DISTINCT t FROM vr), LATERAL (SELECT"
                f" unnest(range({FLIPS // 32})) AS g))", "fb AS (SELECT t, g, j, CASE WHEN (h >> j) & 1 = 1 THEN 1 ELSE -1 END AS s FROM fx, LATERAL (SELECT unnest(range(32)) AS j))",
                "fn AS (SELECT strategy_id, g, j, sum(s * r) AS x FROM vr JOIN fb USING (t) GROUP BY 1, 2, 3)", "fo AS (SELECT strategy_id, sum(r) AS o FROM vr GROUP BY 1)")
    + "SELECT strategy_id, round((1 + count(*) FILTER (x >= o)) / (1 + count(*)), 6) AS p FROM fn JOIN fo USING (strategy_id) GROUP BY 1"
)
ND = NormalDist()
HAC = (
    "x AS (SELECT vr.strategy_id, vr.t, r AS y, b FROM vr JOIN vb USING (t))",
    "s AS (SELECT strategy_id, count(*)::DOUBLE AS n, sum(b) AS sb, sum(b * b) AS sbb, sum(y) AS sy, sum(b * y) AS sby, avg(y) AS yb FROM x GROUP BY 1)",
    "co AS (SELECT *, (n * sby - sb * sy) / (n * sbb - sb * sb) AS beta, (sy - (n * sby - sb * sy) / (n * sbb - sb * sb) * sb) / n AS alpha, n * sbb - sb * sb AS det FROM s)",
    "u AS (SELECT x.*, y - alpha - beta * b AS u, alpha, beta, yb FROM x JOIN co USING (strategy_id))",
    "l AS (SELECT strategy_id, t, u, u * b AS v, y, yb, " + ", ".join(f"lag(u, {i}) OVER o AS u{i}, lag(u * b, {i}) OVER o AS v{i}" for i in range(1, 6))
    + " FROM u WINDOW o AS (PARTITION BY strategy_id ORDER BY t))",
    "m AS (SELECT strategy_id, sum(u * u) AS rss, sum((y - yb) * (y - yb)) AS tss, sum(u * u)" + "".join(f" + 2 * {1 - i / 6!r} * sum(u * u{i})" for i in range(1, 6)) + " AS m00, sum(u * v)"
    + "".join(f" + {1 - i / 6!r} * sum(u * v{i} + v * u{i})" for i in range(1, 6)) + " AS m01, sum(v * v)" + "".join(f" + 2 * {1 - i / 6!r} * sum(v * v{i})" for i in range(1, 6))
    + " AS m11 FROM l GROUP BY 1)",
    "z AS (SELECT *, (sbb * sbb * m00 - 2 * sbb * sb * m01 + sb * sb * m11) / (det * det) AS va, (sb * sb * m00 - 2 * sb * n * m01 + n * n * m11) / (det * det) AS vb2 FROM co JOIN m USING (strategy_id))",
)

RISK_COLS = ("ann_return", "ann_vol", "sharpe", "sortino", "calmar", "max_drawdown", "win_rate", "avg_win", "avg_loss", "expectancy", "profit_factor", "skew", "kurtosis", "var95", "es95")
RISK_SQL = (
    q.with_ctes(q.VARIANTS, *MOM, *DD, "qv AS (SELECT strategy_id, quantile_cont(r, 0.05) AS v FROM vr GROUP BY 1)",
                "es AS (SELECT strategy_id, avg(r) AS e FROM vr JOIN qv USING (strategy_id) WHERE r <= v GROUP BY 1)",
                "w AS (SELECT strategy_id, pow(product(1 + r), 252.0 / count(*)) - 1 AS ann, avg(r) / sqrt(avg(least(r, 0) * least(r, 0))) * sqrt(252) AS so, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS wr,"
                " coalesce(avg(r) FILTER (r > 0), 0) AS aw, coalesce(avg(r) FILTER (r < 0), 0) AS al, sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0) AS pf FROM vr GROUP BY 1)")
    + "SELECT strategy_id, n, " + ", ".join(f"round({e}, 6) AS {c}" for c, e in zip(RISK_COLS, (
        "ann", "sd * sqrt(252)", "mean / sd * sqrt(252)", "so", "ann / abs(mdd)", "mdd", "wr", "aw", "al", "mean", "pf", "skew", "kurt", "v", "e")))
    + " FROM mk JOIN dd USING (strategy_id) JOIN qv USING (strategy_id) JOIN es USING (strategy_id) JOIN w USING (strategy_id)"
)

QUERIES = {
    "variant_returns": (_vr, q.with_ctes(q.VARIANTS) + "SELECT strategy_id, t, r FROM vr"),
    "sharpe": (
        lambda s, f: _round(moments.sharpe_table(_vr(s, f)), "sharpe"),
        q.with_ctes(q.VARIANTS) + "SELECT strategy_id, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe FROM vr GROUP BY 1",
    ),
    "sortino": (
        lambda s, f: _vr(s, f).groupBy("strategy_id").agg(F.round(moments.sortino(), 6).alias("sortino")),
        q.with_ctes(q.VARIANTS) + "SELECT strategy_id, round(avg(r) / sqrt(avg(least(r, 0) * least(r, 0))) * sqrt(252), 6) AS sortino FROM vr GROUP BY 1",
    ),
    "max_drawdown": (
        lambda s, f: _round(moments.max_drawdown(_vr(s, f), chunk=512), "max_drawdown"),
        q.with_ctes(q.VARIANTS, *DD) + "SELECT strategy_id, round(mdd, 6) AS max_drawdown FROM dd",
    ),
    "risk_summary": (lambda s, f: _round(moments.risk_summary(_vr(s, f)), *RISK_COLS), RISK_SQL),
    "probabilistic_sharpe": (
        lambda s, f: _vr(s, f).groupBy("strategy_id").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("sk"), F.kurtosis("r").alias("ku")).select(
            "strategy_id", F.round(moments.psr(F.col("m") / F.col("sd"), F.lit(0.0), F.col("n"), F.col("sk"), F.col("ku") + 3), 6).alias("psr")),
        q.with_ctes(q.VARIANTS, *MOM, "z AS (SELECT strategy_id, mean / sd * sqrt(n - 1) / sqrt(1 - skew * mean / sd + (kurt - 1) / 4 * (mean / sd) * (mean / sd)) AS z FROM mk)")
        + f"SELECT strategy_id, round({q.cdf_sql('z')}, 6) AS psr FROM z",
    ),
    "expected_max_sharpe": (
        lambda s, f: _vr(s, f).groupBy("strategy_id").agg(F.count("r").alias("n")).select("strategy_id", F.round(moments.expected_max_sharpe(F.lit(N_TRIALS), 1.0 / F.col("n")), 6).alias("sr0")),
        q.with_ctes(q.VARIANTS, *DSR) + "SELECT strategy_id, round(sr0, 6) AS sr0 FROM ds",
    ),
    "dsr": (
        lambda s, f: _round(moments.deflated_sharpe(_vr(s, f), n_trials=N_TRIALS), "sr", "sr0", "dsr"),
        q.with_ctes(q.VARIANTS, *DSR) + f"SELECT strategy_id, n, {N_TRIALS}::DOUBLE AS n_trials, round(sr, 6) AS sr, round(sr0, 6) AS sr0, round({q.cdf_sql('z')}, 6) AS dsr FROM dz",
    ),
    "power": (
        lambda s, f: _round(moments.power_table(_vr(s, f)), "sharpe", "min_detectable_sharpe", "power"),
        q.with_ctes(q.VARIANTS, f"a AS (SELECT strategy_id, count(*) AS n, avg(r) / stddev_samp(r) * sqrt(252) AS s FROM vr GROUP BY 1), z AS (SELECT *, greatest(s, 0) / sqrt(252) * sqrt(n) - {ND.inv_cdf(0.95)!r} AS z FROM a)")
        + f"SELECT strategy_id, n, round(s, 6) AS sharpe, round({(ND.inv_cdf(0.95) + ND.inv_cdf(0.8)) * math.sqrt(252)!r} / sqrt(n), 6) AS min_detectable_sharpe, round({q.cdf_sql('z')}, 6) AS power FROM z",
    ),
    "bootstrap_index": (
        lambda s, f: rs.bootstrap_index(s, rs.bars_total(_vr(s, f)), B, BLOCK, SEED).groupBy("b").agg(F.count("*").alias("bars"), F.countDistinct("idx").alias("hit"), F.sum("idx").alias("total")),
        q.with_ctes(q.VARIANTS, *BOOT[:5]) + "SELECT b::INT AS b, count(*) AS bars, count(DISTINCT idx) AS hit, sum(idx)::BIGINT AS total FROM bi GROUP BY 1",
    ),
    "bootstrap_sharpe": (
        lambda s, f: _round(rs.sharpe_interval(rs.replicate_sums(_vr(s, f), B, BLOCK, SEED)), "lo", "hi"),
        q.with_ctes(q.VARIANTS, *BOOT, "br AS (SELECT strategy_id, s1 / n / greatest(sqrt((s2 - s1 * s1 / n) / (n - 1)), 1e-18) * sqrt(252) AS sr FROM bs, tt)")
        + "SELECT strategy_id, round(quantile_cont(sr, 0.025), 6) AS lo, round(quantile_cont(sr, 0.975), 6) AS hi FROM br GROUP BY 1",
    ),
    "reality_check": (
        lambda s, f: _round(rs.reality_check(_families(s, f), B, BLOCK, SEED, family=FAMILY), "p"),
        q.with_ctes(q.VARIANTS, *BOOT, RC) + "SELECT family, round(avg(CASE WHEN vb >= v THEN 1.0 ELSE 0 END), 6) AS p, count(*) AS replicates FROM b1 GROUP BY 1",
    ),
    "spa": (
        lambda s, f: _round(rs.spa_test(_families(s, f), B, BLOCK, SEED, family=FAMILY), "p"),
        q.with_ctes(q.VARIANTS, *BOOT, *SPA) + "SELECT family, round(avg(CASE WHEN vb >= v THEN 1.0 ELSE 0 END), 6) AS p, count(*) AS replicates FROM b4 GROUP BY 1",
    ),
    "bh": (
        lambda s, f: _round(multiple.bh(_pvals(s, f), 0.6).select("o_orderkey", "keep", "p_adj"), "p_adj"),
        q.with_ctes(PV, "rk AS (SELECT *, row_number() OVER (ORDER BY p, o_orderkey) AS i, count(*) OVER () AS m FROM pv)",
                    "ct AS (SELECT max(p) AS c FROM rk WHERE p <= 0.6::DOUBLE * i / m)",
                    "aj AS (SELECT o_orderkey, p, least(1, min(p * m / i) OVER (ORDER BY i DESC)) AS a FROM rk)")
        + "SELECT o_orderkey, coalesce(p <= (SELECT c FROM ct), false) AS keep, round(min(a) OVER (PARTITION BY p), 6) AS p_adj FROM aj",
    ),
    "pbo": (lambda s, f: _round(multiple.pbo(_families(s, f), S, family=FAMILY), "pbo"), PBO_SQL),
    "effective_trials": (lambda s, f: multiple.effective_trials(_families(s, f), THR, family=FAMILY), EFF_SQL),
    "shift_null": (_shift, SHIFT_SQL),
    "sign_flip": (lambda s, f: _round(rs.sign_flip_pvalue(_vr(s, f), FLIPS, SEED), "p"), FLIP_SQL),
    "concentration": (_conc, q.with_ctes(LT) + CONC),
    "hac_alpha": (
        lambda s, f: _round(_alpha(s, f), "alpha_ann", "alpha_t", "r2", "beta_b", "beta_t_b", digits=5),
        q.with_ctes(q.VARIANTS, *HAC) + "SELECT strategy_id, round(alpha * 252, 5) AS alpha_ann, round(alpha / sqrt(va), 5) AS alpha_t, round(1 - rss / tss, 5) AS r2, round(beta, 5) AS beta_b,"
        " round(beta / sqrt(vb2), 5) AS beta_t_b FROM z",
    ),
}
