"""Factor regression with Newey-West errors for many strategies.

The data are reduced to moment sums by Spark (p x p per strategy); only these small systems are solved in numpy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(xx, xy):
        p = len(b)
        out.append(np.linalg.pinv(np.asarray(a, float).reshape(p, p), hermitian=True) @ np.asarray(b, float))
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _errors(xx: pd.Series, meat: pd.Series) -> pd.Series:
    """Standard errors of the sandwich; with collinear or constant factors those of the shortest solution."""
    out = []
    for a, m in zip(xx, meat):
        p = int(round(len(a) ** 0.5))
        bread = np.linalg.pinv(np.asarray(a, float).reshape(p, p), hermitian=True)
        half = np.asarray(m, float).reshape(p, p)
        out.append(np.sqrt(np.diag(bread @ (half + half.T) @ bread)))
    return pd.Series(out)


def factor_regression(returns: DataFrame, factors: DataFrame, names: Sequence[str], r: str = "r", lags: int = 5, ppy: int = 252) -> DataFrame:
    """returns(strategy_id, t, r), factors(t, names...): annual alpha, its t-value, betas, their t-values, R^2.

    Bartlett weights 1 - l/(lags + 1), no small-sample correction. Lagged products use a window per strategy, which has
    one row per bar.
    """
    names = list(names)
    xs = [F.lit(1.0), *[F.col(n) for n in names]]
    p = len(xs)
    d = returns.select("strategy_id", "t", F.col(r).alias("y")).join(factors.select("t", *names), "t")
    mom = d.groupBy("strategy_id").agg(
        F.array(*[F.sum(xs[i] * xs[j]) for i in range(p) for j in range(p)]).alias("xx"),
        F.array(*[F.sum(xs[i] * F.col("y")) for i in range(p)]).alias("xy"),
        F.avg("y").alias("ybar"),
    )
    fit = mom.withColumn("beta", _solve("xx", "xy"))
    e = d.join(fit.select("strategy_id", "beta", "ybar"), "strategy_id")
    hat = sum((F.col("beta")[i] * xs[i] for i in range(1, p)), F.col("beta")[0])
    e = e.withColumn("u", F.col("y") - hat)
    w = Window.partitionBy("strategy_id").orderBy("t")
    for i in range(p):
        e = e.withColumn(f"g{i}", xs[i] * F.col("u"))
    # half of the lag-0 term plus the weighted lags: the other half is the transpose
    aggs = []
    for l in range(1, lags + 1):
        for j in range(p):
            e = e.withColumn(f"g{j}_{l}", F.lag(f"g{j}", l).over(w))
    for i in range(p):
        for j in range(p):
            term = 0.5 * F.sum(F.col(f"g{i}") * F.col(f"g{j}"))
            for l in range(1, lags + 1):
                term = term + (1 - l / (lags + 1)) * F.coalesce(F.sum(F.col(f"g{i}") * F.col(f"g{j}_{l}")), F.lit(0.0))
            aggs.append(term)
    dev = F.col("y") - F.col("ybar")
    s = e.groupBy("strategy_id").agg(F.array(*aggs).alias("meat"), F.sum(F.col("u") * F.col("u")).alias("rss"), F.sum(dev * dev).alias("tss"))
    z = fit.join(s, "strategy_id").withColumn("se", _errors("xx", "meat"))
    coef = lambda i: F.col("beta")[i]
    out = [
        (coef(0) * ppy).alias("alpha_ann"), (coef(0) / F.nullif(F.col("se")[0], F.lit(0.0))).alias("alpha_t"),
        (1 - F.col("rss") / F.nullif(F.col("tss"), F.lit(0.0))).alias("r2"),
    ]
    for i, n in enumerate(names, start=1):
        out += [coef(i).alias(f"beta_{n}"), (coef(i) / F.nullif(F.col("se")[i], F.lit(0.0))).alias(f"beta_t_{n}")]
    return z.select("strategy_id", *out)
