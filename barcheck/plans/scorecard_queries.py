"""Scorecard and streaming queries with their verification SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..constants import INTERESTING, LIVE, PAPER_VALIDATED, REJECTED, ROBUST, ROBUST_DEV, THRESHOLDS
from ..operators import audits, eventlog, leakage, moments, regression, resampling as rs, scorecard as sc, signals as sg
from ..session import cut_lineage, shared_folder
from ..sources import tables as src
from ..streaming import checks
from . import ledger_queries as lq, sqltext as q, stats_queries as sq
from .evaluation import evaluate, leak_failures
from .integrity_queries import _gap_sql, _round
from .portfolio_queries import _panel, _terminal

# ------------------------------------------------------------------ gates over the variant returns


def _measures(spark, folder) -> DataFrame:
    r = sq._vr(spark, folder)
    m = moments.power_table(r).select("strategy_id", F.col("sharpe").alias("baseline_sharpe"), "power")
    dsr = moments.deflated_sharpe(r, n_trials=sq.N_TRIALS).select("strategy_id", "dsr")
    a = regression.factor_regression(r, src.market_returns(r), ["b"]).select("strategy_id", "alpha_t")
    return cut_lineage(m.join(dsr, "strategy_id").join(sc.subperiod_share(r), "strategy_id").join(a, "strategy_id"))


def _gates(spark, folder):
    return sc.gates(_measures(spark, folder))


def _verdicts(spark, folder):
    m = _measures(spark, folder)
    return sc.classify(sc.gates(m), m)


SUB = (
    "tt AS (SELECT max(t) + 1 AS n FROM vr)",
    "sp AS (SELECT strategy_id, r, CASE WHEN t < (n % 5) * (n // 5 + 1) THEN t // (n // 5 + 1) ELSE n % 5 + (t - (n % 5) * (n // 5 + 1)) // (n // 5) END AS part FROM vr, tt)",
    "sb AS (SELECT strategy_id, part, avg(r) AS mean, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe FROM sp GROUP BY 1, 2)",
    "ss AS (SELECT strategy_id, avg(CASE WHEN mean > 0 THEN 1.0 ELSE 0.0 END) AS sub FROM sb GROUP BY 1)",
)
GATE_CTES = (
    q.VARIANTS, *sq.DSR, *SUB, *sq.HAC,
    f"dv AS (SELECT strategy_id, {q.cdf_sql('z')} AS dsr FROM dz)",
    f"pw0 AS (SELECT strategy_id, avg(r) / stddev_samp(r) * sqrt(252) AS sh, greatest(avg(r) / stddev_samp(r) * sqrt(252), 0) / sqrt(252) * sqrt(count(*)) - {sq.ND.inv_cdf(0.95)!r} AS z FROM vr GROUP BY 1)",
    f"pw AS (SELECT strategy_id, sh, {q.cdf_sql('z')} AS power FROM pw0)",
    "ms AS (SELECT pw.strategy_id, sh, power, dsr, sub::DOUBLE AS sub, alpha / sqrt(va) AS ta FROM pw JOIN dv USING (strategy_id) JOIN ss USING (strategy_id) JOIN z USING (strategy_id))",
    "gt AS (SELECT strategy_id, 'baseline_net_sharpe' AS gate, sh >= 0.5 AS passed, sh AS value FROM ms UNION ALL SELECT strategy_id, 'deflated_sharpe', dsr >= 0.95, dsr FROM ms"
    " UNION ALL SELECT strategy_id, 'subperiod_stability', sub >= 0.6::DOUBLE, sub FROM ms UNION ALL SELECT strategy_id, 'factor_alpha', ta >= 2, ta FROM ms)",
    "gf AS (SELECT strategy_id, count(*) FILTER (NOT passed) AS f, count(*) FILTER (NOT passed AND gate = 'baseline_net_sharpe') AS hard FROM gt GROUP BY 1)",
)
VERDICT = (
    f"SELECT strategy_id, CASE WHEN sh >= 5 THEN '{REJECTED}' WHEN f = 0 AND power >= 0.5 THEN '{ROBUST_DEV}' WHEN f = 0 THEN '{INTERESTING}' WHEN hard = 0 AND power < 0.5 AND sh >= 0.5 THEN"
    f" '{INTERESTING}' ELSE '{REJECTED}' END AS classification, (CASE WHEN sh >= 5 THEN 1 ELSE 0 END)::BIGINT AS n_hard_fails, f AS n_gates_failed"
)


def _neighbors(spark, folder):
    """Every variant with all others of its priority as neighbours."""
    s = sq._vr(spark, folder).select("strategy_id").distinct().withColumn("fam", F.split("strategy_id", "/")[0])
    fam = s.groupBy("fam").agg(F.collect_set("strategy_id").alias("all"))  # three per priority
    return s.join(fam, "fam").select("strategy_id", F.explode("all").alias("neighbor"))


def _sharpes(spark, folder):
    return moments.sharpe_table(sq._vr(spark, folder))


def _halves(spark, folder):
    """First two thirds of the bars for development, the rest held out; twice the loss side as the pessimistic view."""
    r = sq._vr(spark, folder)
    cut = r.agg(F.floor(F.max("t") * 2 / 3)).scalar()
    dev = moments.sharpe_table(r.where(F.col("t") < cut)).withColumnRenamed("sharpe", "dev_sharpe")
    oos = r.where(F.col("t") >= cut)
    p = rs.sign_flip_pvalue(oos, sq.FLIPS, sq.SEED).withColumnRenamed("p", "oos_p")
    o = moments.sharpe_table(oos).withColumnRenamed("sharpe", "oos_sharpe")
    pess = moments.sharpe_table(oos.withColumn("r", F.col("r") - 2e-5)).withColumnRenamed("sharpe", "pess_sharpe")
    return sc.out_of_sample(dev.join(o, "strategy_id").join(p, "strategy_id").join(pess, "strategy_id"))


OOS = (
    q.VARIANTS, "ct AS (SELECT floor(max(t) * 2 / 3) AS c FROM vr)",
    "dv AS (SELECT strategy_id, avg(r) / stddev_samp(r) * sqrt(252) AS d FROM vr, ct WHERE t < c GROUP BY 1)", "ov AS (SELECT vr.* FROM vr, ct WHERE t >= c)",
    "os AS (SELECT strategy_id, avg(r) / stddev_samp(r) * sqrt(252) AS o, avg(r - 2e-5) / stddev_samp(r - 2e-5) * sqrt(252) AS pe, sum(r) AS tot FROM ov GROUP BY 1)",
    f"fx AS (SELECT t, g, ('0x' || substr(md5(concat_ws('|', '{sq.SEED}', 'flip', g, t)), 1, 8))::BIGINT AS h FROM (SELECT DISTINCT t FROM ov), LATERAL (SELECT unnest(range({sq.FLIPS // 32})) AS g))",
    "fb AS (SELECT t, g, j, CASE WHEN (h >> j) & 1 = 1 THEN 1 ELSE -1 END AS s FROM fx, LATERAL (SELECT unnest(range(32)) AS j))",
    "fn AS (SELECT strategy_id, g, j, sum(s * r) AS x FROM ov JOIN fb USING (t) GROUP BY 1, 2, 3)",
    "fp AS (SELECT strategy_id, (1 + count(*) FILTER (x >= tot)) / (1 + count(*)) AS p FROM fn JOIN os USING (strategy_id) GROUP BY 1)",
    "oj AS (SELECT strategy_id, d, o, pe, p, o >= 0.3 AS a, p <= 0.1 AS b, o >= 0.25 * d AS c, pe >= 0 AS e FROM dv JOIN os USING (strategy_id) JOIN fp USING (strategy_id))",
)


def _paper(spark, folder):
    """Shipments by customer segment as paper days: few, many, good and bad records occur."""
    o = src.table(spark, folder, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    o = o.withColumn("strategy_id", F.concat(F.lit("p"), (F.col("o_custkey") % 12).cast("string"))).withColumn("k", F.col("o_custkey") % 12)
    x = o.groupBy("strategy_id", "k", F.when(F.col("k") < 2, F.trunc("d", "year")).otherwise(F.col("d")).alias("d")).agg((F.sum("c") / F.lit(1e12)).alias("r"))
    return x.select(
        "strategy_id", "r", F.when(F.col("k") == 11, F.lit(REJECTED)).otherwise(F.lit(ROBUST)).alias("classification"),
        F.when(F.col("k") % 2 == 0, F.lit(4e-5)).otherwise(F.lit(4e-4)).alias("backtest_mean"), (F.col("k") % 3 == 0).alias("human_review"),
    )


PAPER = (
    "pa AS (SELECT 'p' || (o_custkey % 12) AS strategy_id, o_custkey % 12 AS k, CASE WHEN o_custkey % 12 < 2 THEN date_trunc('year', o_orderdate)::DATE ELSE o_orderdate::DATE END AS d,"
    " sum(round(o_totalprice * 100)::BIGINT)::BIGINT / 1e12 AS r FROM orders GROUP BY 1, 2, 3)",
    "pg AS (SELECT strategy_id, k, count(*) AS days, avg(r) AS m, CASE WHEN k % 2 = 0 THEN 4e-5 ELSE 4e-4 END AS bm FROM pa GROUP BY 1, 2)",
    "pd AS (SELECT *, abs(m - bm) / greatest(abs(bm), 1e-12) AS disc FROM pg)",
)


def _regimes(spark, folder):
    r = sq._vr(spark, folder)
    return sc.regime_sharpe(r, src.market_returns(r))


def _data_gate(spark, folder):
    f = audits.cell_findings(lq._broken_panel(spark, folder)).select(F.lit("panel").alias("strategy_id"), "check", "severity")
    t = audits.timestamp_findings(lq._shuffled_stream(spark, folder), "event_id").select(F.lit("stream").alias("strategy_id"), "check", "severity")
    return sc.data_gate(f.unionByName(t), spark.createDataFrame([("panel",), ("stream",), ("clean",)], "strategy_id string"))


def _trials(spark, folder):
    from ..operators import multiple

    r = sq._families(spark, folder)
    tc = eventlog.trial_counts(src.experiment_events(spark, folder))
    return sc.trials_for_deflation(tc, multiple.effective_trials(r, sq.THR, family=sq.FAMILY), moments.sharpe_variance(r, sq.FAMILY))


def _full(spark, folder):
    """The whole evaluation of a momentum grid and a leaky control on the brand panel."""
    p = _panel(spark, folder)
    grid = [sg.variant(f"mom{w}", window=w) for w in (5, 10, 20)]
    w = cut_lineage(sg.momentum(p, grid).unionByName(sg.leaky_next_return(p)))
    leaks = leak_failures(leakage.leakage_suite(lambda x: sg.momentum(x, grid).unionByName(sg.leaky_next_return(x)), p))
    names = [g["strategy_id"] for g in grid]
    near = spark.createDataFrame([(a, b) for a in names for b in names], "strategy_id string, neighbor string")
    return sc.public(evaluate(p, w, _terminal(spark, folder), leaks=leaks, neighbors=near, th=THRESHOLDS).verdicts)


SCORE = {
    "scorecard_gates": (
        lambda s, f: _round(_gates(s, f), "value", digits=5),
        q.with_ctes(*GATE_CTES) + "SELECT strategy_id, gate, passed, round(value, 5) AS value FROM gt",
    ),
    "scorecard": (
        lambda s, f: _verdicts(s, f),
        q.with_ctes(*GATE_CTES) + VERDICT + ", CASE WHEN power >= 0.5 THEN 'ADEQUATE' ELSE 'LOW' END AS statistical_power FROM ms JOIN gf USING (strategy_id)",
    ),
    "public_verdicts": (lambda s, f: sc.public(_verdicts(s, f)), q.with_ctes(*GATE_CTES) + VERDICT + " FROM ms JOIN gf USING (strategy_id)"),
    "subperiods": (
        lambda s, f: _round(sc.subperiods(sq._vr(s, f)).drop("mean"), "sharpe"),
        q.with_ctes(q.VARIANTS, *SUB) + "SELECT strategy_id, part::INT AS part, round(sharpe, 6) AS sharpe FROM sb",
    ),
    "regime_sharpe": (
        lambda s, f: _round(_regimes(s, f), "sharpe"),
        q.with_ctes(q.VARIANTS, "tr AS (SELECT t, CASE WHEN t > 5 THEN stddev_pop(b) OVER (ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS v FROM vb)",
                    "qc AS (SELECT quantile_cont(v, 1/3.0::DOUBLE) AS a, quantile_cont(v, 2/3.0::DOUBLE) AS b FROM tr)",
                    "rg AS (SELECT t, CASE WHEN v < a THEN 'low' WHEN v < b THEN 'mid' ELSE 'high' END AS regime FROM tr, qc WHERE v IS NOT NULL)")
        + "SELECT strategy_id, regime, count(*) AS bars, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe FROM vr JOIN rg USING (t) GROUP BY 1, 2 HAVING count(*) > 20",
    ),
    "neighbourhood": (
        lambda s, f: _round(sc.neighbourhood(_sharpes(s, f), _neighbors(s, f)), "neighbor_pos", "neighbor_ratio", digits=5),
        q.with_ctes(q.VARIANTS, "sh AS (SELECT strategy_id, avg(r) / stddev_samp(r) * sqrt(252) AS s FROM vr GROUP BY 1)")
        + "SELECT a.strategy_id, round(avg(CASE WHEN b.s > 0 THEN 1.0 ELSE 0.0 END), 5) AS neighbor_pos, round(CASE WHEN any_value(a.s) > 0 THEN median(b.s) / any_value(a.s) ELSE 0 END, 5)"
        " AS neighbor_ratio FROM sh a JOIN sh b ON split_part(a.strategy_id, '/', 1) = split_part(b.strategy_id, '/', 1) AND a.strategy_id <> b.strategy_id GROUP BY 1",
    ),
    "neighbour_flags": (
        lambda s, f: _round(sc.flags(_sharpes(s, f), _neighbors(s, f).where("strategy_id <> neighbor").withColumnRenamed("neighbor", "ablation")), "ablation_sharpe", "sharpe"),
        q.with_ctes(q.VARIANTS, "sh AS (SELECT strategy_id, avg(r) / stddev_samp(r) * sqrt(252) AS s FROM vr GROUP BY 1)")
        + "SELECT a.strategy_id, b.strategy_id AS ablation, round(b.s, 6) AS ablation_sharpe, round(a.s, 6) AS sharpe FROM sh a JOIN sh b ON split_part(a.strategy_id, '/', 1) ="
        " split_part(b.strategy_id, '/', 1) AND a.strategy_id <> b.strategy_id WHERE b.s >= 0.9 * a.s",
    ),
    "trials_for_deflation": (
        lambda s, f: _round(_trials(s, f), "var_sr", digits=9),
        "WITH RECURSIVE " + ", ".join((q.VARIANTS, lq.EV, sq.EFF, "vn AS (SELECT family, count(DISTINCT hyp_id || '|' || version || '|' || st) AS v FROM ev WHERE kind = 'EXPERIMENT' GROUP BY 1)",
                    "sh AS (SELECT split_part(strategy_id, '/', 1) AS family, var_samp(s) AS v FROM (SELECT strategy_id, avg(r) / stddev_samp(r) AS s FROM vr GROUP BY 1) GROUP BY 1)"))
        + " SELECT family, vn.v AS logged, effective, greatest(vn.v, effective, 1)::DOUBLE AS n_trials, round(sh.v, 9) AS var_sr FROM ef JOIN vn USING (family) JOIN sh USING (family)",
    ),
    "data_gate": (
        _data_gate,
        q.with_ctes(*lq.BROKEN) + "SELECT 'panel' AS strategy_id, CASE WHEN count(*) FILTER (s = 'FAIL') > 0 THEN 'FAIL' ELSE 'WARN' END AS data_integrity, count(*) FILTER (s = 'FAIL') AS hard_fails"
        " FROM cc WHERE n > 0 UNION ALL SELECT 'stream', 'FAIL', 2 UNION ALL SELECT 'clean', 'PASS', 0",
    ),
    "out_of_sample": (
        lambda s, f: _round(_halves(s, f), "dev_sharpe", "oos_sharpe", "oos_p", "pess_sharpe"),
        q.with_ctes(*OOS) + f"SELECT strategy_id, round(d, 6) AS dev_sharpe, round(o, 6) AS oos_sharpe, round(p, 6) AS oos_p, round(pe, 6) AS pess_sharpe, a AS oos_sharpe_ok, b AS oos_significance,"
        f" c AS oos_decay, e AS oos_pessimistic_nonneg, CASE WHEN a AND b AND c AND e THEN '{ROBUST}' ELSE '{REJECTED}' END AS classification FROM oj",
    ),
    "paper_gate": (
        lambda s, f: _round(sc.paper_gate(_paper(s, f)), "discrepancy", digits=5),
        q.with_ctes(*PAPER) + f"SELECT strategy_id, days, round(disc, 5) AS discrepancy, CASE WHEN k = 11 THEN '{REJECTED}' WHEN days < 60 THEN '{ROBUST}' WHEN m <= 0 OR disc > 0.5 THEN '{INTERESTING}'"
        f" WHEN k % 3 = 0 THEN '{LIVE}' ELSE '{PAPER_VALIDATED}' END AS verdict FROM pd",
    ),
    "scorecard_full": (_full, None),
}

# ------------------------------------------------------------------ streams


BATCHES = 3


def _flow(spark: SparkSession, folder: str, build: Callable[[DataFrame], DataFrame], sink: Callable[[DataStreamWriter, str], DataStreamWriter] | None = None) -> tuple[str, int, StructType]:
    """Runs a stream over the events table, which arrives in several micro-batches with late rows; returns what the sink wrote.

    Events go to batches by time, but every ninth comes one batch later, as far as it is still within the lateness; events
    without an instant come first. A batch is as many files as the table has scan partitions. The query takes what has come,
    stops, and goes on from its checkpoint with the next batch. A last batch holds one row without a type, a day after
    all others, so the watermark passes every window; its instant, in microseconds, and the
    schema are returned too. Input, output and state live in the
    shared folder the session names.
    """
    e = spark.read.parquet(f"{folder}/events.parquet")
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = e.agg(F.coalesce(F.min(ts), F.lit(0)), F.coalesce(F.max(ts), F.lit(0))).first()
    width = max(1, -(-(hi - lo + 1) // BATCHES))
    batch = F.floor((ts - lo) / width)
    late = (F.col("event_id") % 9 == 0) & (batch < BATCHES - 1) & (F.floor((ts + 480_000_000 - lo) / width) > batch)
    placed = e.withColumn("_batch", F.coalesce(batch + F.coalesce(late, F.lit(False)).cast("long"), F.lit(0)))
    closing = hi + 86_400_000_000
    end = spark.range(1).select(*[(F.timestamp_micros(F.lit(closing)) if c == "ts" else F.lit(None)).cast(t).alias(c) for c, t in e.dtypes])
    for arrived in [*[placed.where(F.col("_batch") == i).drop("_batch") for i in range(BATCHES)], end]:
        arrived.write.mode("append").parquet(f"{base}/in")
        out = build(spark.readStream.schema(e.schema).parquet(f"{base}/in"))
        writer = out.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
        writer = sink(writer, f"{base}/out") if sink else writer.format("parquet").outputMode("append").option("path", f"{base}/out")
        writer.start().awaitTermination()
    return f"{base}/out", closing, out.schema


def _drain(spark: SparkSession, folder: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the stream wrote, without what comes from the closing row."""
    out, closing, schema = _flow(spark, folder, build)
    found = spark.read.schema(schema).parquet(out)
    return found.where(F.coalesce(F.unix_micros("ts") < F.lit(closing // 60_000_000 * 60_000_000), F.lit(True))) if "ts" in found.columns else found


def _trades(e):
    return e.select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("event_id").alias("seq"))


def _stream_bars(spark, folder):
    b = _drain(spark, folder, lambda e: checks.minute_bars(_trades(e)))
    return b.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def _stream_raw(e):
    px = {c: F.col("price") for c in ("open", "high", "low", "close")}
    return _trades(e).withColumn("ts", F.date_trunc("minute", "ts")).withColumns(px).withColumn("volume", F.col("size")).select("ticker", "ts", "open", "high", "low", "close", "volume")


def _spells(spark, folder):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    # the closing row, whose spell never passes the watermark, is not written
    return _drain(spark, folder, lambda e: checks.trading_spells(_stream_raw(e))).select("ticker", text("start"), text("end"), "bars")


def _stream_ledger(spark, folder):
    """The ledger that foreachBatch wrote over all batches."""
    sink = lambda writer, path: writer.foreachBatch(checks.ledger_sink(path))
    out, _, schema = _flow(spark, folder, lambda e: checks.late_signal_gaps(_stream_signals(e), "signals"), sink)
    return spark.read.schema(schema).parquet(out).select("kind", "severity", "ticker", "start", "end", "n", "gap_id")


STREAMS = {
    "stream_bars": (
        _stream_bars,
        q.with_ctes(q.MINUTES) + "SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, open, high, low, close, volume FROM minutes",
    ),
    "stream_first_bars": (
        lambda s, f: _drain(s, f, lambda e: checks.first_bars(_stream_raw(e))).groupBy("ticker").agg(F.count("*").alias("bars")),
        "SELECT event_type AS ticker, count(DISTINCT date_trunc('minute', ts)) AS bars FROM events GROUP BY 1",
    ),
    "stream_duplicates": (
        lambda s, f: _drain(s, f, lambda e: checks.duplicate_counts(_stream_raw(e))).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")),
        "WITH d AS (SELECT event_type AS ticker, date_trunc('minute', ts) AS ts, count(*) AS n, count(DISTINCT value) > 1 AS conflict FROM events GROUP BY 1, 2 HAVING count(*) > 1)"
        " SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, n, conflict FROM d",
    ),
    "stream_gaps": (
        lambda s, f: _drain(s, f, lambda e: checks.gap_alerts(_stream_raw(e))),
        f"WITH d AS (SELECT DISTINCT event_type AS ticker, date_trunc('minute', ts) AS ts FROM events), e AS (SELECT ticker, {q.ny_date('ts')} AS session, ts, lead(ts) OVER (PARTITION BY ticker,"
        f" {q.ny_date('ts')} ORDER BY ts) AS nx FROM d) SELECT ticker, session::VARCHAR AS session, epoch_us(ts) AS start_us, epoch_us(nx) AS end_us, (epoch_us(nx) - epoch_us(ts)) // 60000000 AS minutes"
        " FROM e WHERE epoch_us(nx) - epoch_us(ts) > 300000000",
    ),
    "stream_late_signals": (
        lambda s, f: _drain(s, f, lambda e: checks.late_signals(_stream_signals(e))).select("event_id", "ticker", "zero_latency"),
        q.with_ctes(lq.SIG) + "SELECT event_id, event_type AS ticker, true AS zero_latency FROM sg JOIN events USING (event_id) WHERE signal_ts <= publication_ts",
    ),
    "stream_spells": (
        lambda s, f: _spells(s, f),
        "WITH m AS (SELECT event_type AS ticker, date_trunc('minute', ts) AS ts FROM events WHERE ts IS NOT NULL), l AS (SELECT *, lag(ts) OVER (PARTITION BY ticker ORDER BY ts) AS p FROM m),"
        " g AS (SELECT *, count(*) FILTER (p IS NULL OR ts - p > INTERVAL 5 MINUTE) OVER (PARTITION BY ticker ORDER BY ts) AS g FROM l)"
        " SELECT ticker, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS \"end\", count(*) AS bars FROM g GROUP BY ticker, g",
    ),
    "stream_signal_latency": (
        lambda s, f: _drain(s, f, lambda e: checks.signal_latency(_stream_signals(e).select("event_id", "publication_ts"), _stream_signals(e).select("event_id", "ticker", "signal_ts"))),
        q.with_ctes(lq.SIG) + "SELECT event_id, event_type AS ticker, (epoch_us(signal_ts) - epoch_us(publication_ts)) / 1000000 AS latency_s, signal_ts <= publication_ts AS zero_latency"
        " FROM sg JOIN events USING (event_id) WHERE signal_ts BETWEEN publication_ts - INTERVAL 5 MINUTE AND publication_ts + INTERVAL 1 MINUTE",
    ),
    "stream_signal_ledger": (
        _stream_ledger,
        q.with_ctes(lq.SIG, "late AS (SELECT DISTINCT event_type AS ticker, strftime(publication_ts, '%Y-%m-%dT%H:%M:%S+00:00') AS p, strftime(signal_ts, '%Y-%m-%dT%H:%M:%S+00:00') AS g"
                    " FROM sg JOIN events USING (event_id) WHERE signal_ts <= publication_ts)")
        + _gap_sql("signals", "'signal_times'", "'ZERO_LATENCY_SIGNAL'", "'MATERIAL'", "late", ticker="ticker", start="p", end="g"),
    ),
}


def _stream_signals(e):
    sec = F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp")))
    return e.select(
        "event_id", F.col("event_type").alias("ticker"), F.timestamp_seconds(sec).alias("event_ts"), F.timestamp_seconds(sec + F.col("user_id") % 50).alias("publication_ts"),
        F.timestamp_seconds(sec + F.when(F.col("event_id") % 19 == 0, F.lit(0)).otherwise(F.lit(90))).alias("signal_ts"),
    )


QUERIES = {**SCORE, **STREAMS}
