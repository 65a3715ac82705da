"""Portfolio weights from bars: (strategy_id, t, ticker, w), nonzero cells only.

All variants of a parameter grid share one window pass and are told apart by ``strategy_id``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.noise import gaussian, hash32
from .panel import in_bars

MIN_NAMES = 10
#: A panel may hold several worlds (versions of history) told apart by this column; every signal then treats each on its own
#: and its weights carry the column.
WORLD = "world"


def worlds(df: DataFrame) -> list[str]:
    return [WORLD] if WORLD in df.columns else []


def _with_last(df: DataFrame, panel: DataFrame) -> DataFrame:
    """Adds ``_last``, the last bar of the panel, of each world of its own."""
    w = worlds(panel)
    if not w:
        return df.withColumn("_last", panel.agg(F.max("t")).scalar())
    return df.join(panel.groupBy(*w).agg(F.max("t").alias("_last")), w)


def variant(strategy_id: str, window: int = 40, quantile: float = 0.2, rebalance: int = 5, gross: float = 1.0) -> dict:
    return {"strategy_id": strategy_id, "window": window, "quantile": quantile, "rebalance": rebalance, "gross": gross}


#: Parts of the momentum pipeline, and what a variant row becomes without each: the trailing return gives way to keyed noise,
#: the extremes to halves of all names, a book is set anew on every bar, or one leg is left out.
PARTS = {
    "ranking": {"noise": True},
    "selection": {"quantile": 0.5},
    "holding": {"rebalance": 1},
    "long_leg": {"side": -1},
    "short_leg": {"side": 1},
}


def ablations(variants: Sequence[dict], parts: Sequence[str] = tuple(PARTS)) -> list[dict]:
    """For each variant and part a row without that part, named ``<strategy>-<part>`` and naming its ``base`` and ``part``.

    The rows run beside their variants in one ``momentum`` job and share its window pass.
    """
    return [{**v, **PARTS[p], "strategy_id": f"{v['strategy_id']}-{p}", "base": v["strategy_id"], "part": p} for v in variants for p in parts]


def _sides(scored: DataFrame, short_first: bool, q: Column, gross: Column) -> DataFrame:
    """Equal weights for the lowest and highest share of names per (strategy, bar); fewer than ten names give none.

    Groups hold one row per name, so a window per bar stays small. ``short_first``: the low end is sold (momentum) or
    bought (reversal).
    """
    by = Window.partitionBy(*worlds(scored), "strategy_id", "t")
    x = scored.withColumn("_rn", F.row_number().over(by.orderBy("score", "ticker"))).withColumn("_n", F.count("*").over(by))
    x = x.where(F.col("_n") >= MIN_NAMES).withColumn("_m", F.greatest(F.lit(1), F.floor(F.col("_n") * q)))
    low, high = F.col("_rn") <= F.col("_m"), F.col("_rn") > F.col("_n") - F.col("_m")
    unit = gross / 2 / F.col("_m")
    # where the ends overlap the sold side wins, for either direction
    w = F.when(low, -unit).when(high, unit) if short_first else F.when(high, -unit).when(low, unit)
    return x.withColumn("w", w).where("w IS NOT NULL")


def from_score(scores: DataFrame, quantile: float = 0.2, gross: float = 1.0) -> DataFrame:
    """Long the top, short the bottom quantile of (strategy_id, t, ticker, score)."""
    x = scores.where(F.col("score").isNotNull() & ~F.isnan("score"))
    return _sides(x, True, F.lit(quantile), F.lit(gross)).select(*worlds(scores), "strategy_id", "t", "ticker", "w")


def momentum(panel: DataFrame, variants: Sequence[dict]) -> DataFrame:
    """Trailing-return momentum over each name's own observed bars, rebalanced every k-th bar, held in between.

    A rebalance with too few names leaves that bar empty; the earlier book resumes on the next bar. A variant's ``noise``
    ranks the same names by a hash of name and bar, its ``side`` keeps the bought (1) or the sold (-1) names only.
    """
    w = worlds(panel)
    cells = in_bars(panel)
    own = Window.partitionBy(*w, "ticker").orderBy("t")

    def score(v: dict) -> Column:
        trailing = F.col("close") / F.nullif(F.lag("close", int(v["window"])).over(own), F.lit(0.0)) - 1
        return F.when(trailing.isNotNull(), hash32("ablation", F.col("ticker"), F.col("t")).cast("double")) if v.get("noise") else trailing

    options = F.array(*[
        F.struct(
            F.lit(v["strategy_id"]).alias("strategy_id"), F.lit(float(v["quantile"])).alias("q"), F.lit(int(v["rebalance"])).alias("k"),
            F.lit(float(v["gross"])).alias("g"), F.lit(int(v.get("side", 0))).alias("side"), score(v).alias("score"),
        )
        for v in variants
    ])
    scored = cells.select(*w, "t", "ticker", options.alias("o")).select(*w, "t", "ticker", F.explode("o").alias("o")).select(*w, "t", "ticker", "o.*")
    scored = scored.where((F.col("t") % F.col("k") == F.col("k") - 1) & F.col("score").isNotNull())
    book = _sides(scored, True, F.col("q"), F.col("g")).select(*w, "strategy_id", "t", "ticker", "w", "k", "side")
    # the last bar a book serves: just before the next successful rebalance of the same strategy
    times = _with_last(book.select(*w, "strategy_id", "t").distinct(), panel)
    until = times.withColumn("until", F.coalesce(F.lead("t").over(Window.partitionBy(*w, "strategy_id").orderBy("t")) - 1, "_last")).drop("_last")
    # a leg is left out after the books' times are known, so a book of one leg serves as long as the whole one
    legs = book.where((F.col("side") == 0) | (F.col("side") * F.col("w") > 0))
    held = legs.join(until, [*w, "strategy_id", "t"]).withColumn("h", F.explode(F.sequence("t", "until")))
    held = held.where((F.col("h") == F.col("t")) | (F.col("h") % F.col("k") != F.col("k") - 1))
    held = held.select(*w, "strategy_id", F.col("h").alias("t"), "ticker", "w")
    return held.join(cells.select(*w, "t", "ticker"), [*w, "t", "ticker"], "left_semi").select(*w, "strategy_id", "t", "ticker", "w")


def reversal(panel: DataFrame, strategy_id: str = "reversal", quantile: float = 0.2, gross: float = 1.0) -> DataFrame:
    """Buy the losers and sell the winners of one bar, for names present on both bars."""
    own = Window.partitionBy(*worlds(panel), "ticker").orderBy("t")
    prev = F.when(F.lag("t").over(own) == F.col("t") - 1, F.lag("close").over(own))
    x = in_bars(panel).select(*worlds(panel), "t", "ticker", (F.col("close") / F.nullif(prev, F.lit(0.0)) - 1).alias("score")).where("score IS NOT NULL")
    x = x.withColumn("strategy_id", F.lit(strategy_id))
    return _sides(x, False, F.lit(quantile), F.lit(gross)).select(*worlds(panel), "strategy_id", "t", "ticker", "w")


# ------------------------------------------------------------------ positive controls that must be caught


def leaky_next_return(panel: DataFrame, strategy_id: str = "leaky_next_return") -> DataFrame:
    """Ranks names by the return they are about to earn."""
    own = Window.partitionBy(*worlds(panel), "ticker").orderBy("t")
    ahead = (F.lead("t", 1).over(own) == F.col("t") + 1) & (F.lead("t", 2).over(own) == F.col("t") + 2)
    r = F.when(ahead, F.lead("open", 2).over(own) / F.nullif(F.lead("open", 1).over(own), F.lit(0.0)) - 1)
    x = panel.where("alive").select(*worlds(panel), "t", "ticker", F.coalesce(r, F.lit(0.0)).alias("score"))
    return from_score(x.withColumn("strategy_id", F.lit(strategy_id)))


def log_returns(panel: DataFrame) -> DataFrame:
    own = Window.partitionBy(*worlds(panel), "ticker").orderBy("t")
    prev = F.when(F.lag("t").over(own) == F.col("t") - 1, F.lag("close").over(own))
    both = (F.col("close") > 0) & (prev > 0)
    return panel.withColumn("lr", F.when(both, F.log("close") - F.log(prev)))


def leaky_centred_window(panel: DataFrame, window: int = 11, strategy_id: str = "leaky_centred_window") -> DataFrame:
    """Scores by a moving average that reaches into the future."""
    h = window // 2
    frame = Window.partitionBy(*worlds(panel), "ticker").orderBy("t").rangeBetween(-h, h)
    x = log_returns(panel).withColumn("score", F.coalesce(F.avg("lr").over(frame), F.lit(0.0)))
    x = _with_last(x, panel).where((F.col("t") >= h) & (F.col("t") <= F.col("_last") - h) & F.col("alive"))
    return from_score(x.select(*worlds(panel), F.lit(strategy_id).alias("strategy_id"), "t", "ticker", "score"))


def leaky_full_sample_scale(panel: DataFrame, base: dict, target: float = 0.02) -> DataFrame:
    """Momentum scaled by a volatility taken over the whole sample."""
    w, book = worlds(panel), momentum(panel, [base])
    sd = log_returns(panel).groupBy(*w).agg(F.stddev_pop("lr").alias("_sd"))
    book = book.join(sd, w) if w else book.withColumn("_sd", sd.scalar())
    return book.withColumn("w", F.col("w") * F.lit(target) / F.col("_sd")).drop("_sd")


# ------------------------------------------------------------------ noise family


def noise_scores(panel: DataFrame, variants: int, phi: float = 0.97, shock: float = 0.25, chunk: int = 200) -> DataFrame:
    """(v, t, ticker, score): smoothed keyed noise per (variant, name).

    A score is the sum of all shocks so far with weights phi^lag. Each chunk of bars sums its own shocks; the states at the
    ends of the chunks before it, one number each, carry over exactly. Every shock depends on its key only.
    """
    cells = panel.where("alive").select("t", "ticker")
    x = cells.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    x = x.withColumn("e", gaussian("noise", F.col("v"), F.col("ticker"), F.col("t")) * shock)
    x = x.withColumn("b", F.floor(F.col("t") / F.lit(chunk))).withColumn("o", F.col("t") - F.col("b") * chunk)
    ends = x.groupBy("v", "ticker", "b").agg(F.sum(F.col("e") * F.pow(F.lit(phi), chunk - 1 - F.col("o"))).alias("end"))
    before = F.collect_list(F.struct("b", "end")).over(Window.partitionBy("v", "ticker").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    state = F.aggregate("before", F.lit(0.0), lambda s, z: s + z["end"] * F.pow(F.lit(phi), (F.col("b") - 1 - z["b"]) * chunk))
    carry = ends.withColumn("before", before).select("v", "ticker", "b", state.alias("carry"))
    scaled = F.sum(F.col("e") * F.pow(F.lit(phi), -F.col("o"))).over(Window.partitionBy("v", "ticker", "b").orderBy("o"))
    x = x.withColumn("own", scaled * F.pow(F.lit(phi), F.col("o"))).join(carry, ["v", "ticker", "b"])
    return x.select("v", "t", "ticker", (F.col("own") + F.col("carry") * F.pow(F.lit(phi), F.col("o") + 1)).alias("score"))


def noise_family(panel: DataFrame, variants: int, rebalance: int = 5) -> DataFrame:
    """Weights of many signals without information: noise scores, held between rebalances."""
    x = noise_scores(panel, variants).where(F.col("t") % rebalance == 0)
    x = x.select(F.format_string("noise%04d", F.col("v")).alias("strategy_id"), "t", "ticker", "score")
    book = from_score(x)
    last = panel.agg(F.max("t")).scalar()
    held = book.withColumn("h", F.explode(F.sequence(F.col("t"), F.least(F.col("t") + rebalance - 1, last))))
    held = held.select("strategy_id", F.col("h").alias("t"), "ticker", "w")
    return held.join(in_bars(panel).select("t", "ticker"), ["t", "ticker"], "left_semi").select("strategy_id", "t", "ticker", "w")
