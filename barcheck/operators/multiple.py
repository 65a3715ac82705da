"""Multiple testing: false discovery rate, overfitting probability, effective number of trials."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.shape import order_sums
from ..session import cut_lineage


def bh(pvalues: DataFrame, q: float = 0.05, p: str = "p", family: Sequence[str] = ()) -> DataFrame:
    """Adds ``keep`` (discoveries at rate q) and ``p_adj`` to every row.

    Ranks come from ``order_sums``: equal p-values are collapsed and the order is built over many tasks, so a family
    may hold all hypotheses of a run. A row without p-value stays, with NULL results, and does not count as a trial.
    """
    # one struct holds the family, so that a NULL in it is a family of its own
    pvalues = pvalues.withColumn("_family", F.struct(F.lit(0), *family))
    family = ["_family"]
    f = order_sums(pvalues.where(F.col(p).isNotNull()), family, p)
    # the last of equal p-values decides, so the inclusive count is the rank
    f = f.withColumn("_ok", F.col(p) <= q * F.col("cum_cnt") / F.col("tot_cnt")).withColumn("_raw", F.col(p) * F.col("tot_cnt") / F.col("cum_cnt"))
    up = Window.partitionBy(*family, "_b").orderBy(F.col(p).desc())
    f = f.withColumn("_min", F.min("_raw").over(up))
    per = f.groupBy(*family, "_b").agg(F.min("_raw").alias("_bm"), F.max(F.when(F.col("_ok"), F.col(p))).alias("_bp"))
    later = Window.partitionBy(*family).orderBy(F.col("_b").desc())
    per = per.select(
        *family, "_b", F.min("_bm").over(later.rowsBetween(Window.unboundedPreceding, -1)).alias("_later"),
        F.max("_bp").over(Window.partitionBy(*family)).alias("_cut"),
    )
    f = f.join(per, [*family, "_b"])
    adj = F.least(F.lit(1.0), F.col("_min"), F.col("_later"))
    flat = f.select(*family, p, F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False)).alias("keep"), adj.alias("p_adj"))
    key = lambda d: d.withColumn("_k", F.struct(*family, p))
    out = key(pvalues).join(key(flat).select("_k", "keep", "p_adj"), "_k", "left")
    return out.drop("_k", "_family")


# ------------------------------------------------------------------ overfitting probability


MOST_SLICES = 16


def pbo(returns: DataFrame, slices: int = MOST_SLICES, r: str = "r", family: Sequence[str] = ()) -> DataFrame:
    """Probability of backtest overfitting by symmetric cross-validation: a row (family, pbo, n_combos, variants) per family.

    Every variant is reduced to count, sum and square sum per slice; a split of the slices is then a few additions, whatever
    the number of bars. All splits are taken, 12,870 for 16 slices, as bit masks. A family has at most as many slices as
    bars, and an even number of them; ``slices`` above MOST_SLICES is refused. With fewer than two variants or bars nothing
    can be overfitted: pbo is NULL and n_combos 0.
    """
    if not 2 <= slices <= MOST_SLICES:
        raise ValueError(f"slices must be between 2 and {MOST_SLICES}")
    family = list(family)
    # without a family column all variants are one family; a struct keeps NULL families apart
    x = returns.select(F.struct(F.lit(0).alias("_all"), *family).alias("_f"), "strategy_id", "t", F.col(r).alias("r"))
    sizes = x.groupBy("_f").agg((F.max("t") + 1).alias("bars"), F.countDistinct("strategy_id").alias("variants"))
    sizes = sizes.withColumn("s", F.floor(F.least(F.lit(slices), F.col("bars")) / 2) * 2)
    some = x.join(sizes.where("s >= 2 AND variants > 1"), "_f")
    q = F.floor(F.col("bars") / F.col("s"))
    long = F.col("bars") % F.col("s")
    head = long * (q + 1)
    part = F.when(F.col("t") < head, F.floor(F.col("t") / (q + 1))).otherwise(long + F.floor((F.col("t") - head) / q)).cast("int")
    v = some.groupBy("_f", "variants", "s", "strategy_id", part.alias("part")).agg(F.count("*").cast("double").alias("n"), F.coalesce(F.sum("r"), F.lit(0.0)).alias("a"), F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0)).alias("b"))
    v = v.groupBy("_f", "variants", "s", "strategy_id").agg(F.map_from_entries(F.collect_list(F.struct("part", F.struct("n", "a", "b").alias("v")))).alias("m"))
    # sums over the slices of every low and every high half of a mask, once per variant; a split then adds two of them
    half = (F.col("s") / 2).cast("int")
    nothing = F.struct(*[F.lit(0.0).alias(c) for c in "nab"])

    def halves(first):
        def pick(mask):
            def add(acc, i):
                y = F.try_element_at("m", first + i)
                take = y.isNotNull() & (mask.bitwiseAND(F.element_at("_bits", i + 1)) != 0)
                return F.when(take, F.struct(*[(acc[c] + y[c]).alias(c) for c in "nab"])).otherwise(acc)

            return F.aggregate(F.sequence(F.lit(0), half - 1), nothing, add)

        return F.transform(F.sequence(F.lit(0), F.element_at("_bits", half + 1) - 1), pick)

    v = v.withColumn("_bits", F.array(*[F.lit(1 << i) for i in range(MOST_SLICES + 1)]))
    whole = F.aggregate(F.map_values("m"), nothing, lambda acc, y: F.struct(*[(acc[c] + y[c]).alias(c) for c in "nab"]))
    v = v.select("_f", "variants", "s", "strategy_id", halves(F.lit(0)).alias("low"), halves(half).alias("high"), whole.alias("whole"), F.element_at("_bits", half + 1).alias("_size"))
    masks = sizes.where("s >= 2 AND variants > 1").select("s").distinct()
    masks = masks.select("s", F.explode(F.sequence(F.lit(0), (F.pow(F.lit(2.0), "s") - 1).cast("int"))).alias("mask")).where(F.bit_count("mask") * 2 == F.col("s"))
    y = v.join(masks, "s")
    at = {"low": F.col("mask") % F.col("_size") + 1, "high": F.floor(F.col("mask") / F.col("_size")).cast("int") + 1}
    y = y.select("_f", "variants", "mask", "strategy_id", "whole", *[F.element_at(c, i).alias(c) for c, i in at.items()])
    inside = {c: F.col("low")[c] + F.col("high")[c] for c in "nab"}
    outside = {c: F.col("whole")[c] - inside[c] for c in "nab"}

    def sr(v):
        var = (v["b"] - v["a"] * v["a"] / v["n"]) / (v["n"] - 1)
        return F.when((v["n"] > 1) & (var > 1e-30), v["a"] / v["n"] / F.sqrt(var)).otherwise(F.lit(0.0))

    y = y.select("_f", "variants", "mask", "strategy_id", sr(inside).alias("is_sr"), sr(outside).alias("oos_sr"))
    # one shuffle on the split: the best variant inside, the first of equal ones, and its rank outside
    split = Window.partitionBy("_f", "mask")
    y = y.withColumn("best", F.first("oos_sr").over(split.orderBy(F.desc("is_sr"), "strategy_id")))
    z = y.groupBy("_f", "mask", "variants").agg(F.count_if(F.col("oos_sr") < F.col("best")).alias("below"), F.count_if(F.col("oos_sr") == F.col("best")).alias("same"))
    w = (F.col("below") + 0.5 * (F.col("same") - 1) + 0.5) / F.col("variants")
    w = F.greatest(F.least(w, F.lit(1 - 1e-6)), F.lit(1e-6))
    found = z.groupBy("_f").agg(F.avg(F.when(F.log(w / (1 - w)) <= 0, 1.0).otherwise(0.0)).alias("pbo"), F.count("*").alias("n_combos"))
    out = sizes.select("_f", "variants").join(found, "_f", "left")
    if not family:
        # an empty table is a family without variants
        return out.agg(F.max("pbo").alias("pbo"), F.coalesce(F.max("n_combos"), F.lit(0)).alias("n_combos"), F.coalesce(F.max("variants"), F.lit(0)).alias("variants"))
    return out.select(*[F.col("_f")[c].alias(c) for c in family], "pbo", F.coalesce("n_combos", F.lit(0)).alias("n_combos"), "variants")


# ------------------------------------------------------------------ effective trials

#: Numbers in one block of standardised series at most.
BLOCK_CELLS = 2_000_000


def correlated(returns: DataFrame, corr_thresh: float = 0.7, r: str = "r", family: Sequence[str] = (), block: int | None = None) -> DataFrame:
    """(_f, a, b): variants of one family, a before b by name, whose returns correlate at the threshold or more either way.

    Blocks of series meet block by block and one matrix product gives all correlations of two blocks; only links leave.
    """
    x = returns.select(F.struct(F.lit(0).alias("_all"), *family).alias("_f"), "strategy_id", "t", F.col(r).alias("r"))
    bars = x.agg(F.max("t") + 1).scalar()
    size = F.lit(block) if block else F.greatest(F.lit(1), F.least(F.lit(64), F.floor(F.lit(BLOCK_CELLS) / bars)))
    m = x.groupBy("_f", "strategy_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "r"))), lambda p: p["r"]).alias("v"))
    names = m.groupBy("_f").agg(F.count("*").alias("_k"))
    # variants are dealt to as many blocks as their number asks for
    m = m.join(names, "_f").withColumn("_n", F.ceil(F.col("_k") / size).cast("int")).withColumn("_b", F.pmod(F.xxhash64("strategy_id"), F.col("_n")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda o: F.struct(F.least("_b", o).alias("i"), F.greatest("_b", o).alias("j")))
    cell = m.withColumn("p", F.explode(pairs))

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        u = np.stack([_unit(np.asarray(v, float)) for v in pdf["v"]])
        of, name = pdf["_b"].to_numpy(), pdf["strategy_id"].to_numpy()
        a, b = np.nonzero(np.abs(u @ u.T) >= corr_thresh)
        # a pair inside one block is taken where the block meets itself only
        inside = pdf["_i"].iloc[0] == pdf["_j"].iloc[0]
        keep = (name[a] < name[b]) & (inside | (of[a] != of[b]))
        return pd.DataFrame({"_key": pdf["_key"].iloc[0], "a": name[a][keep], "b": name[b][keep]})

    # families travel as text, which keeps a NULL one apart
    cell = cell.select(F.to_json("_f").alias("_key"), F.col("p.i").alias("_i"), F.col("p.j").alias("_j"), "strategy_id", "v", "_b")
    found = cell.groupBy("_key", "_i", "_j").applyInPandas(links, "_key string, a string, b string")
    return found.join(names.select("_f", F.to_json("_f").alias("_key")), "_key").select("_f", "a", "b")


def effective_trials(returns: DataFrame, corr_thresh: float = 0.7, r: str = "r", family: Sequence[str] = (), block: int | None = None) -> DataFrame:
    """Clusters met when variants are taken in name order and everything correlated with a taken one is dropped.

    One row (family, effective, variants) per family. Who leads is settled in rounds of joins on the links: a variant leads
    once all linked variants before it are dropped, and is dropped once one of them leads. Only the number of open variants
    reaches the driver.
    """
    family = list(family)
    names = returns.select(F.struct(F.lit(0).alias("_all"), *family).alias("_f"), "strategy_id").distinct()
    links = cut_lineage(correlated(returns, corr_thresh, r, family, block))
    state = cut_lineage(names.join(links.select("_f", F.col("b").alias("strategy_id")).distinct().withColumn("_open", F.lit(True)), ["_f", "strategy_id"], "left").select(
        "_f", "strategy_id", F.when(F.col("_open"), F.lit("open")).otherwise("leads").alias("state")))
    while state.where("state = 'open'").limit(1).count():
        before = links.join(state.select("_f", F.col("strategy_id").alias("a"), "state"), ["_f", "a"]).groupBy("_f", F.col("b").alias("strategy_id")).agg(
            F.bool_or(F.col("state") == "leads").alias("_led"), F.bool_and(F.col("state") == "dropped").alias("_free"))
        now = F.when(F.col("state") != "open", F.col("state")).when(F.col("_led"), F.lit("dropped")).when(F.col("_free"), F.lit("leads")).otherwise("open")
        state = cut_lineage(state.join(before, ["_f", "strategy_id"], "left").select("_f", "strategy_id", now.alias("state")))
    out = state.groupBy("_f").agg(F.count_if(F.col("state") == "leads").alias("effective"), F.count("*").alias("variants"))
    if not family:
        return out.agg(F.coalesce(F.max("effective"), F.lit(0)).alias("effective"), F.coalesce(F.max("variants"), F.lit(0)).alias("variants"))
    return out.select(*[F.col("_f")[c].alias(c) for c in family], "effective", "variants")


def _unit(v: np.ndarray) -> np.ndarray:
    """Centred, scaled to length 1; a constant series correlates with nothing."""
    c = v - v.mean()
    n = np.sqrt(c @ c)
    return c / n if n > 0 else c
