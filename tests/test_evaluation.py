"""The evaluation's own guards: what it must refuse and what it must point out, and families judged apart."""

import math
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from barcheck.constants import BASELINE_EXEC, REJECTED, THRESHOLDS
from barcheck.operators import guards, portfolio as pf
from barcheck.plans.evaluation import ablated_sharpes, evaluate
from barcheck.session import shared_folder

BARS, NAMES = 60, 3


def panel(spark, hole=None, dead=None, broken=None):
    """Calm waves; ``hole`` (name, bar) has no price though listed, ``dead`` (name, last bar) stops trading, ``broken`` (name, bar)
    has its high below its low."""
    rows = []
    for i in range(NAMES):
        for t in range(BARS):
            alive = dead is None or i != dead[0] or t <= dead[1]
            o = 100.0 + 3 * math.sin(t / (3 + i)) + i
            c = o * (1 + 0.002 * math.cos(t + i))
            ok = alive and (i, t) != hole
            hi, lo = max(o, c), min(o, c)
            if (i, t) == broken:
                hi, lo = lo - 5, hi + 5
            rows.append((t, f"A{i}", *[x if ok else None for x in (o, hi, lo, c, 1e6)], alive, False))
    x = spark.createDataFrame(rows, "t int, ticker string, open double, high double, low double, close double, volume double, alive boolean, excluded boolean")
    return x.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t") * 86_400))


def book(spark):
    """``safe`` holds A0 only, ``risky`` A1 and A2 in turns."""
    rows = [("safe", t, "A0", 0.5) for t in range(BARS)] + [("risky", t, f"A{1 + t // 5 % 2}", 0.5) for t in range(BARS)]
    return spark.createDataFrame(rows, "strategy_id string, t int, ticker string, w double")


def found(spark, **kw):
    acc = pf.Accounts(panel(spark, **kw), book(spark), [BASELINE_EXEC], None)
    return {(r["strategy_id"], r["check"]): r["n"] for r in guards.gap_failures(acc).collect()}


def test_positions_on_missing_or_unknown_prices(spark):
    assert found(spark) == {}
    # decided on bar 6 and held on bar 7, while A2 is the name of bars 5 to 9
    assert found(spark, hole=(2, 7)) == {("risky", "held_missing_price"): 1}
    assert found(spark, hole=(2, 14)) == {}
    # A0 is always held, so its last bar is too
    assert found(spark, dead=(0, 40)) == {("safe", "unknown_terminal_return"): 1}


def test_panel_failures_hold_for_every_strategy(spark):
    names = book(spark).select("strategy_id").distinct()
    assert guards.panel_failures(panel(spark), names).count() == 0
    got = {(r["strategy_id"], r["n"]) for r in guards.panel_failures(panel(spark, broken=(1, 9)), names).collect()}
    assert got == {("safe", 1), ("risky", 1)}


def test_evaluation_rejects_what_it_cannot_price_and_judges_families_apart(spark):
    th = {**THRESHOLDS, "n_perm": 20, "n_boot": 20}
    families = spark.createDataFrame([("safe", "f"), ("risky", "g")], "strategy_id string, family string")
    log = spark.createDataFrame([("f", 7), ("g", 900)], "family string, variants long")
    e = evaluate(panel(spark, hole=(2, 7)), book(spark), families=families, trial_counts=log, th=th, capitals=(1e4, 1e9))
    assert [tuple(r) for r in e.failures.collect()] == [("risky", "held_missing_price", 1)]
    v = {r["strategy_id"]: r for r in e.verdicts.collect()}
    assert v["risky"]["classification"] == REJECTED and v["risky"]["n_hard_fails"] == 1 and v["safe"]["n_hard_fails"] == 0
    m = {r["strategy_id"]: r for r in e.measures.collect()}
    assert m.keys() == {"safe", "risky"} and all(r["sharpe_lo"] <= r["sharpe_hi"] and r["pbo"] is None and 0 < r["spa_p"] <= 1 for r in m.values())
    flags = {(r["strategy_id"], r["flag"]) for r in e.flags.collect()}
    assert {("safe", "assumed_spread"), ("safe", "single_variant"), ("risky", "single_variant"), ("safe", "few_trades")} <= flags


def test_ablations_and_contaminated_data_are_flagged(spark):
    sharpes = spark.createDataFrame([("s", "baseline", 1.2), ("s", "delay+1", 0.1), ("s", "capital=1e+03", 1.0), ("s", "capital=1e+06", -0.2)], "strategy_id string, scenario string, sharpe double")
    assumed = spark.createDataFrame([("s", "baseline", 4), ("s", "pessimistic", 4)], "strategy_id string, scenario string, default_spread_held_cells long")
    trades = spark.createDataFrame([("s", 19)], "strategy_id string, n_trades long")
    base = spark.createDataFrame([("s", t, 0.01 * (-1) ** t) for t in range(40)], "strategy_id string, t int, r double")
    fam = spark.createDataFrame([("s", "f"), ("u", "f")], "strategy_id string, family string")
    without = spark.createDataFrame([("s", "no_filter", 1.19)], "strategy_id string, ablation string, ablation_sharpe double")
    seen = spark.createDataFrame([("d1",), ("d1",), ("d2",)], "dataset_id string")
    got = {(r["strategy_id"], r["flag"]): r["value"] for r in guards.flags(assumed, sharpes, trades, base, fam, without, seen, "d1").collect()}
    assert got.pop(("s", "low_power")) > 1
    assert got == {
        ("s", "assumed_spread"): 4, ("s", "delay_fragility"): 0.1, ("s", "capacity"): 1000, ("s", "few_trades"): 19, ("s", "ablation:no_filter"): 1.19,
        ("s", "contaminated_dataset"): None, ("u", "contaminated_dataset"): None,
    }


def test_a_folder_of_the_driver_is_refused_on_a_cluster():
    def session(master, **conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d)), sparkContext=SimpleNamespace(master=master, applicationId="app"))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("spark://host:7077", spark_sql_warehouse_dir="file:/home/me/spark-warehouse"))
    assert shared_folder(session("spark://host:7077", spark_sql_warehouse_dir="hdfs://x/w")) == "hdfs://x/w/_staged/app"
    assert shared_folder(session("spark://host:7077", spark_checkpoint_dir="file:/shared", spark_sql_warehouse_dir="file:/w")) == "file:/shared/app"
    assert shared_folder(session("local[4]", spark_sql_warehouse_dir="file:/w")) == "file:/w/_staged/app"


def test_ablations_are_priced_but_are_no_trials(spark):
    """A copy of the book and one that holds it the other way round: a copy keeps its Sharpe ratio exactly."""
    th = {**THRESHOLDS, "n_perm": 20, "n_boot": 20}
    same = book(spark).where("strategy_id = 'safe'").withColumn("strategy_id", F.lit("copy"))
    less = same.unionByName(same.withColumn("strategy_id", F.lit("turned")).withColumn("w", -F.col("w")))
    pairs = spark.createDataFrame([("safe", "copy"), ("safe", "turned")], "strategy_id string, ablation string")
    e = evaluate(panel(spark), book(spark), ablations=pairs, ablation_weights=less, th=th)
    assert {r["strategy_id"] for r in e.verdicts.collect()} == {r["strategy_id"] for r in e.measures.collect()} == {"safe", "risky"}
    known = {r["strategy_id"]: r["sharpe"] for r in ablated_sharpes(panel(spark), less).collect()}
    base = e.ladders.where("strategy_id = 'safe' AND scenario = 'baseline'").first()["sharpe"]
    assert known["copy"] == pytest.approx(base) != known["turned"]
    flagged = {r["flag"]: r["value"] for r in e.flags.where("flag LIKE 'ablation:%'").collect()}
    assert flagged == {f"ablation:{k}": pytest.approx(v) for k, v in known.items() if v >= 0.9 * base}
