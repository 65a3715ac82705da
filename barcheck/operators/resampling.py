"""Bootstraps and permutation nulls. Noise is keyed, so a recomputed or lost task reproduces the same replicate."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.noise import hash32, uniform, uniform_int


def bars_total(df: DataFrame) -> Column:
    return df.agg(F.max("t") + 1).scalar()


def bootstrap_blocks(totals: DataFrame, replicates: int, mean_block: float = 10, seed: int = 0) -> DataFrame:
    """Blocks (bars, b, j, at, start, len) of the stationary bootstrap for every length in ``totals`` (bars).

    Block j of replicate b starts at a uniform bar and has a geometric length of mean ``mean_block``; ``at`` is its place in
    the replicate. About bars / mean_block rows a replicate are drawn, ten standard deviations and twenty more than needed;
    the last one drawn would take whatever is left.
    """
    p = 1.0 / max(mean_block, 1.0)
    need = F.ceil(F.col("bars") * p + 10 * F.sqrt(F.col("bars") * (p * (1 - p))) + 20).cast("int")
    x = totals.select(F.col("bars").cast("int").alias("bars")).where("bars > 0").distinct().withColumn("most", need)
    x = x.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("most") - 1)))
    size = F.lit(1) if p >= 1 else 1 + F.floor(F.log(1 - uniform(seed, "p", F.col("b"), F.col("j"))) / F.lit(math.log(1 - p)))
    x = x.withColumn("size", size.cast("long"))
    x = x.withColumn("at", F.sum("size").over(Window.partitionBy("bars", "b").orderBy("j")) - F.col("size")).where(F.col("at") < F.col("bars"))
    left = F.col("bars") - F.col("at")
    return x.select(
        "bars", "b", "j", "at", uniform_int(F.col("bars"), seed, "s", F.col("b"), F.col("j")).alias("start"),
        F.when(F.col("j") == F.col("most") - 1, left).otherwise(F.least("size", left)).alias("len"),
    )


def bootstrap_index(spark: SparkSession, total: Column, replicates: int, mean_block: float = 10, seed: int = 0) -> DataFrame:
    """The same replicates bar by bar: (b, t, idx), one row per bar."""
    x = bootstrap_blocks(spark.range(1).select(total.cast("int").alias("bars")), replicates, mean_block, seed)
    x = x.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("len") - 1)))
    return x.select("b", (F.col("at") + F.col("i")).cast("int").alias("t"), ((F.col("start") + F.col("i")) % F.col("bars")).cast("int").alias("idx"))


#: Bars whose running sums are worked out together.
SUM_CHUNK = 4096


def prefix_sums(returns: DataFrame, keys: Sequence[str], r: str = "r") -> DataFrame:
    """(keys, e, p1, p2): sums of r and r^2 over the bars before e, for e from 1 on; chunks of bars, chained by their totals."""
    keys = list(keys)
    x = returns.select(*keys, "t", F.coalesce(F.col(r), F.lit(0.0)).alias("_r"), F.floor(F.col("t") / F.lit(SUM_CHUNK)).alias("_c"))
    per = x.groupBy(*keys, "_c").agg(F.sum("_r").alias("_s1"), F.sum(F.col("_r") * F.col("_r")).alias("_s2"))
    past = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*keys, "_c", *[F.coalesce(F.sum(f"_s{i}").over(past), F.lit(0.0)).alias(f"_k{i}") for i in (1, 2)])
    w = Window.partitionBy(*keys, "_c").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_a", F.sum("_r").over(w)).withColumn("_b", F.sum(F.col("_r") * F.col("_r")).over(w)).join(carry, [*keys, "_c"])
    return x.select(*keys, (F.col("t") + 1).alias("e"), (F.col("_a") + F.col("_k1")).alias("p1"), (F.col("_b") + F.col("_k2")).alias("p2"))


def replicate_sums(returns: DataFrame, replicates: int, mean_block: float = 10, seed: int = 0, keys: Sequence[str] = ("strategy_id",), r: str = "r",
                   family: Sequence[str] = ()) -> DataFrame:
    """(family, keys, b, bars, s1, s2): sums of r and r^2 over each replicate.

    The sum over a block is a difference of two running sums, so a replicate is a set of signed block ends: about two rows
    a block instead of one a bar. Families of one length share one bootstrap; ``keys`` are unique across families. Every
    key has one row for each bar of its family; a NULL return counts as 0. Joined rows are summed map-side, so the shuffle
    carries one row per (key, replicate) and task.
    """
    family, keys = list(family), list(keys)
    # one struct holds the family, so that a NULL in it is a family of its own
    x = returns.select(F.struct(F.lit(0).alias("_all"), *family).alias("_f"), *keys, "t", F.col(r).alias("r"))
    totals = x.groupBy("_f").agg((F.max("t") + 1).cast("int").alias("bars"))
    n, end = F.col("bars"), F.col("start") + F.col("len")
    point = lambda e, c: F.struct(e.cast("int").alias("e"), F.lit(c).alias("c"))
    ends = F.when(end <= n, F.array(point(end, 1), point(F.col("start"), -1))).otherwise(F.array(point(n, 1), point(end - n, 1), point(F.col("start"), -1)))
    signs = bootstrap_blocks(totals, replicates, mean_block, seed).select("bars", "b", F.explode(ends).alias("x")).select("bars", "b", "x.*").where("e > 0")
    signs = signs.groupBy("bars", "e", "b").agg(F.sum("c").alias("c")).where("c <> 0")
    x = prefix_sums(x, ["_f", *keys]).join(totals, "_f").join(signs, ["bars", "e"])
    x = x.groupBy("_f", *keys, "b", "bars").agg(F.sum(F.col("c") * F.col("p1")).alias("s1"), F.sum(F.col("c") * F.col("p2")).alias("s2"))
    return x.select(*[F.col("_f")[c].alias(c) for c in family], *keys, "b", "bars", "s1", "s2")


def sharpe_interval(sums: DataFrame, keys: Sequence[str] = ("strategy_id",), ppy: int = 252, level: float = 0.95) -> DataFrame:
    n = F.col("bars")
    mean = F.col("s1") / n
    sd = F.sqrt(F.greatest((F.col("s2") - n * mean * mean) / (n - 1), F.lit(0.0)))
    x = sums.withColumn("sr", mean / F.greatest(sd, F.lit(1e-18)) * math.sqrt(ppy))
    a = (1 - level) / 2
    return x.groupBy(*keys).agg(F.percentile("sr", a).alias("lo"), F.percentile("sr", 1 - a).alias("hi"))


def variant_means(returns: DataFrame, keys: Sequence[str] = ("strategy_id",), r: str = "r") -> DataFrame:
    return returns.groupBy(*keys).agg(F.avg(r).alias("mu"))


def reality_check(returns: DataFrame, replicates: int = 1000, mean_block: float = 10, seed: int = 0, sums: DataFrame | None = None, family: Sequence[str] = ()) -> DataFrame:
    """White's reality check over the variants of each family: (family, p, replicates). ``sums`` come from ``replicate_sums``
    with the same ``family``."""
    family = list(family)
    s = replicate_sums(returns, replicates, mean_block, seed, family=family) if sums is None else sums
    m = variant_means(returns)
    root = F.sqrt(F.col("bars").cast("double"))
    boot = s.join(m, "strategy_id").groupBy(*family, "b").agg(F.max(root * (F.col("s1") / F.col("bars") - F.col("mu"))).alias("vb"), F.max(root * F.col("mu")).alias("v"))
    return boot.groupBy(*family).agg(F.avg(F.when(F.col("vb") >= F.col("v"), 1.0).otherwise(0.0)).alias("p"), F.count("*").alias("replicates"))


def spa_test(returns: DataFrame, replicates: int = 1000, mean_block: float = 10, seed: int = 0, sums: DataFrame | None = None, family: Sequence[str] = ()) -> DataFrame:
    """Hansen's test per family: studentised, poor variants re-centred, statistics clamped at 0."""
    family = list(family)
    s = replicate_sums(returns, replicates, mean_block, seed, family=family) if sums is None else sums
    root = F.sqrt(F.col("bars").cast("double"))
    x = s.join(variant_means(returns), "strategy_id").withColumn("d", root * (F.col("s1") / F.col("bars") - F.col("mu")))
    om = x.groupBy("strategy_id").agg(F.greatest(F.stddev_samp("d"), F.lit(1e-12)).alias("om"))
    x = x.join(om, "strategy_id").withColumn("ts", root * F.col("mu") / F.col("om"))
    bar = -F.sqrt(2 * F.log(F.log(F.greatest(F.col("bars"), F.lit(3)).cast("double"))))
    g = F.when(F.col("ts") <= bar, F.col("mu")).otherwise(F.lit(0.0))
    z = F.col("d") / F.col("om") + root * g / F.col("om")
    zero = F.lit(0.0)
    boot = x.groupBy(*family, "b").agg(F.greatest(F.max(z), zero).alias("vb"), F.greatest(F.max("ts"), zero).alias("v"))
    return boot.groupBy(*family).agg(F.avg(F.when(F.col("vb") >= F.col("v"), 1.0).otherwise(0.0)).alias("p"), F.count("*").alias("replicates"))


# ------------------------------------------------------------------ permutations


#: Bars of one piece of a history; the sums of a longer one are put together from its pieces.
LAG_CHUNK = 1 << 16


def _piece_lags(chunk: int):
    """UDF: sums w[t] * r[t + k] of a piece of each series, for the wanted circular lags k, by the convolution theorem."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def lags(n: pd.Series, base: pd.Series, w: pd.Series, r: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for n_, base_, w_, r_, ks in zip(n, base, w, r, wanted):
            at = lambda v: np.array([x["at"] for x in v], dtype=np.int64)
            val = lambda v: np.array([x["v"] for x in v], dtype=np.float64)
            whole = n_ <= chunk
            size = n_ if whole else 2 * chunk
            a, b = np.zeros(size), np.zeros(size)
            a[at(w_)], b[at(r_)] = val(w_), val(r_)
            c = np.fft.irfft(np.conj(np.fft.rfft(a)) * np.fft.rfft(b), size)
            ks = np.asarray(ks, np.int64)
            if whole:
                out.append(c[ks % n_])
                continue
            # distances d of the pieces' own places that stand for lag k: k = base + d modulo n, -chunk < d < chunk
            s, d = np.zeros(len(ks)), (ks - base_ + chunk - 1) % n_ - (chunk - 1)
            while (inside := d < chunk).any():
                s[inside] += c[d[inside] % size]
                d = d + n_
            out.append(s)
        return pd.Series(out)

    return lags


def shift_draws(spark: SparkSession, total: Column, draws: int, min_shift: int = 20, seed: int = 0) -> DataFrame:
    span = F.greatest(total - min_shift, F.lit(min_shift + 1)) - min_shift
    return spark.range(draws).select(F.col("id").alias("i"), (F.lit(min_shift) + uniform_int(span, seed, "shift", F.col("id"))).cast("int").alias("k"))


def shifted_means(held: DataFrame, returns: DataFrame, total: Column, draws: int = 1000, min_shift: int = 20, seed: int = 0,
                  keys: Sequence[str] = ("strategy_id",), chunk: int = LAG_CHUNK) -> DataFrame:
    """Mean gross return of the book shifted in time by k bars: (keys, i, k, null_mean), and observed as i = -1.

    held(keys, t, ticker, w), returns(t, ticker, r), one row per bar; NULL weights and returns count as 0. Per (strategy, name)
    all lags come from transforms instead of one pass per shift, and only the drawn ones leave. A history longer than ``chunk``
    bars is cut in pieces: every piece of the weights meets the pieces of the returns that a drawn lag leads to, and
    their sums are added, so no cell or task holds a history.
    """
    spark = held.sparkSession
    keys = list(keys)
    shifts = shift_draws(spark, total, draws, min_shift, seed)
    wanted = shifts.agg(F.array_union(F.array(F.lit(0)), F.collect_set("k"))).scalar()
    at, piece = (F.col("t") % F.lit(chunk)).cast("int").alias("at"), F.floor(F.col("t") / F.lit(chunk)).cast("int")
    pack = lambda v: F.collect_list(F.struct(at, F.col(v).cast("double").alias("v"))).alias(v)
    w = held.where("w <> 0").groupBy(*keys, "ticker", piece.alias("wc")).agg(pack("w"))
    r = returns.where("r <> 0").groupBy("ticker", piece.alias("rc")).agg(pack("r")).withColumn("bars", total.cast("int")).withColumn("all", wanted)
    # the returns have no strategies, so it is their pieces that are copied to the pieces of the weights
    r = r.withColumn("wc", F.explode(F.sequence(F.lit(0), F.floor((F.col("bars") - 1) / F.lit(chunk)).cast("int"))))
    r = r.withColumn("base", (F.col("rc") - F.col("wc")).cast("long") * chunk)
    meets = lambda k: F.pmod(k - F.col("base") + (chunk - 1), F.col("bars")) < 2 * chunk - 1
    r = r.withColumn("ks", F.filter("all", meets)).drop("all")
    x = w.join(r.where(F.size("ks") > 0), ["ticker", "wc"])
    x = x.select(*keys, "bars", "ks", _piece_lags(chunk)("bars", "base", "w", "r", "ks").alias("s"))
    x = x.select(*keys, "bars", F.explode(F.arrays_zip("ks", "s")).alias("x")).select(*keys, "bars", F.col("x.ks").alias("k"), F.col("x.s").alias("s"))
    # a lag that leads to no piece of the returns has a sum of 0
    none = held.select(*keys).distinct().withColumn("bars", total.cast("int"))
    x = x.unionByName(none.select(*keys, "bars", F.explode(wanted).alias("k"), F.lit(0.0).alias("s")))
    per = x.groupBy(*keys, "k").agg((F.sum("s") / F.first("bars")).alias("null_mean"))
    every = shifts.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("i"), F.lit(0).alias("k")))
    return per.join(every, "k").select(*keys, "i", "k", "null_mean")


def shift_pvalue(means: DataFrame, keys: Sequence[str] = ("strategy_id",)) -> DataFrame:
    keys = list(keys)
    obs = means.where("i < 0").select(*keys, F.col("null_mean").alias("observed"))
    x = means.where("i >= 0").join(obs, keys)
    return permutation_pvalue(x, "observed", "null_mean", [*keys, "observed"])


def permutation_pvalue(nulls: DataFrame, observed: str, null: str, keys: Sequence[str]) -> DataFrame:
    hits = F.count_if(F.col(null) >= F.col(observed))
    return nulls.groupBy(*keys).agg(((1 + hits) / (1 + F.count("*"))).alias("p"), F.avg(null).alias("null_avg"))


def sign_flip_pvalue(returns: DataFrame, draws: int = 5000, seed: int = 0, keys: Sequence[str] = ("strategy_id",), r: str = "r") -> DataFrame:
    """One-sided p of mean > 0 under random signs. One digest gives the signs of 32 draws, summed as 32 columns at once."""
    keys = list(keys)
    groups = -(-draws // 32)
    x = returns.select(*keys, "t", F.col(r).alias("r")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    x = x.withColumn("h", hash32(seed, "flip", F.col("g"), F.col("t")))
    sums = [F.sum(F.when(F.col("h").bitwiseAND(F.lit(1 << j)) != 0, F.col("r")).otherwise(-F.col("r"))).alias(f"s{j}") for j in range(32)]
    per = x.groupBy(*keys, "g").agg(*sums)
    nulls = per.select(*keys, F.posexplode(F.array(*[F.col(f"s{j}") for j in range(32)])).alias("j", "s"), "g")
    nulls = nulls.where(F.col("g") * 32 + F.col("j") < draws)
    obs = returns.groupBy(*keys).agg(F.sum(r).alias("observed"))
    return permutation_pvalue(nulls.join(obs, keys), "observed", "s", keys).select(*keys, "p")
