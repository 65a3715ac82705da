"""Leakage detection: a pipeline (panel -> weights) must decide the same when the future is cut off or replaced by noise.

``truncation_diffs`` and ``scramble_diffs`` take any pipeline and run it once per version of the history; ``suite_diffs`` runs a
pipeline that knows worlds once for all versions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.noise import gaussian
from ..functions.shape import dense_index
from .gaps import union_all
from .signals import WORLD

Pipeline = Callable[[DataFrame], DataFrame]
TOL = 1e-9


def _cut(panel: DataFrame, share: float) -> Column:
    return panel.agg(F.floor((F.max("t") + 1) * F.lit(share)).cast("int")).scalar()


def _compare(full: DataFrame, other: DataFrame, k: Column, test: str, share: float) -> DataFrame:
    a = full.where(F.col("t") < k).withColumnRenamed("w", "w0")
    b = other.where(F.col("t") < k).withColumnRenamed("w", "w1")
    d = F.abs(F.coalesce("w0", F.lit(0.0)) - F.coalesce("w1", F.lit(0.0)))
    x = a.join(b, ["strategy_id", "t", "ticker"], "full_outer").groupBy("strategy_id").agg(F.max(d).alias("max_abs_diff"))
    return x.select(F.lit(test).alias("test"), "strategy_id", F.lit(share).alias("cut"), "max_abs_diff")


def truncation_diffs(pipeline: Pipeline, panel: DataFrame, cuts: Sequence[float] = (0.5, 0.7, 0.85)) -> DataFrame:
    full = pipeline(panel)
    parts = []
    for c in cuts:
        k = _cut(panel, c)
        parts.append(_compare(full, pipeline(panel.where(F.col("t") < k)), k, "truncation_invariance", c))
    return union_all(parts)


def scramble_future(panel: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Bars from the cut on are permuted in time (one permutation for all names) and their prices perturbed.

    The permutation is the order of keyed digests of the bar index: reproducible on any partitioning.
    """
    k = _cut(panel, share)
    ahead = panel.where(F.col("t") >= k).select("t").distinct().withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("t").cast("string"))))
    order = dense_index(ahead, "h", "place", F.substring("h", 1, 2))
    to = ahead.join(order, "h").select("t", (F.col("place") + k).alias("t_new"))
    x = panel.join(to, "t", "left")
    moved = F.col("t_new").isNotNull()
    shake = F.when(moved, F.exp(gaussian(seed, F.col("t_new"), F.col("ticker")) * 0.05)).otherwise(F.lit(1.0))
    x = x.withColumn("_m", shake).withColumn("t", F.coalesce("t_new", "t"))
    for c in ("open", "high", "low", "close"):
        x = x.withColumn(c, F.col(c) * F.col("_m"))
    return x.select(*panel.columns)


def scramble_diffs(pipeline: Pipeline, panel: DataFrame, cuts: Sequence[float] = (0.5, 0.75), seed: int = 0) -> DataFrame:
    full = pipeline(panel)
    return union_all([_compare(full, pipeline(scramble_future(panel, c, seed)), _cut(panel, c), "future_scramble", c) for c in cuts])


# ------------------------------------------------------------------ all histories in one pass

FULL = 0


def histories(panel: DataFrame, cuts: Sequence[float] = (0.5, 0.7, 0.85), scrambles: Sequence[float] = (0.5, 0.75), seed: int = 0) -> tuple[DataFrame, list[tuple[int, str, float, Column]]]:
    """The panel in one version per test, told apart by ``world``, and (world, test, share, first bar changed) of each version.

    World 0 is the panel itself. A truncated world holds the bars before its cut; in a scrambled one the bars from the cut
    on are permuted and shaken as in ``scramble_future``. Every row is fanned out once; the permutations, one row per bar
    and scrambled world, are the only side that is joined.
    """
    total = panel.agg(F.max("t") + 1).scalar()
    tests = [(i, "truncation_invariance", c, F.floor(total * F.lit(c)).cast("int")) for i, c in enumerate(cuts, 1)]
    tests += [(i, "future_scramble", c, F.floor(total * F.lit(c)).cast("int")) for i, c in enumerate(scrambles, len(cuts) + 1)]
    t = F.col("t")
    homes = [F.lit(FULL)] + [F.when(t < k, F.lit(i)) if i <= len(cuts) else F.lit(i) for i, _, _, k in tests]
    x = panel.withColumn(WORLD, F.explode(F.array_compact(F.array(*homes))))
    later = [F.when(t >= k, F.lit(i)) for i, test, _, k in tests if i > len(cuts)]
    if not later:
        return x, tests
    bars = panel.select("t").distinct().withColumn(WORLD, F.explode(F.array_compact(F.array(*later))))
    place = F.row_number().over(Window.partitionBy(WORLD).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), t.cast("string")))))
    first = F.coalesce(*[F.when(F.col(WORLD) == i, k) for i, _, _, k in tests])
    moves = bars.select(WORLD, "t", (first + place - 1).alias("t_new"))
    x = x.join(moves, [WORLD, "t"], "left")
    shake = F.when(F.col("t_new").isNull(), F.lit(1.0)).otherwise(F.exp(gaussian(seed, F.col("t_new"), F.col("ticker")) * 0.05))
    prices = {c: F.col(c) * shake for c in ("open", "high", "low", "close")}
    x = x.withColumns(prices).withColumn("t", F.coalesce("t_new", "t"))
    return x.select(WORLD, *panel.columns), tests


def suite_diffs(pipeline: Pipeline, panel: DataFrame, cuts: Sequence[float] = (0.5, 0.7, 0.85), scrambles: Sequence[float] = (0.5, 0.75), seed: int = 0) -> DataFrame:
    """(test, strategy_id, cut, max_abs_diff) of all tests from one run of the pipeline.

    ``pipeline`` must treat the worlds of a panel apart and keep the column ``world``, as all signals of ``signals`` do. The
    weights of the untouched world are fanned out to the worlds they are held against and meet them in one aggregation.
    """
    x, tests = histories(panel, cuts, scrambles, seed)
    t, w, world = F.col("t"), F.coalesce("w", F.lit(0.0)), F.col(WORLD)
    own = F.coalesce(*[F.when((world == i) & (t < k), F.array(F.struct(F.lit(i).alias("i"), F.lit(0.0).alias("w0"), w.alias("w1")))) for i, _, _, k in tests])
    against = F.array_compact(F.array(*[F.when(t < k, F.struct(F.lit(i).alias("i"), w.alias("w0"), F.lit(0.0).alias("w1"))) for i, _, _, k in tests]))
    y = pipeline(x).withColumn("o", F.explode(F.when(world == FULL, against).otherwise(own)))
    cell = y.groupBy("o.i", "strategy_id", "t", "ticker").agg(F.abs(F.sum("o.w0") - F.sum("o.w1")).alias("d"))
    worst = cell.groupBy("i", "strategy_id").agg(F.max("d").alias("max_abs_diff"))
    name = lambda j: F.element_at(F.create_map(*[F.lit(v) for r in tests for v in (r[0], r[j])]), F.col("i"))
    return worst.select(name(1).alias("test"), "strategy_id", name(2).alias("cut"), "max_abs_diff")


def leakage_suite(pipeline: Pipeline, panel: DataFrame, seed: int = 0, tol: float = TOL) -> DataFrame:
    """(test, strategy_id, max_abs_diff, passed); the pipeline runs once, over all versions of the history."""
    x = suite_diffs(pipeline, panel, seed=seed).groupBy("test", "strategy_id").agg(F.max("max_abs_diff").alias("max_abs_diff"))
    return x.withColumn("passed", F.col("max_abs_diff") <= tol)


def implausible_performance(sharpes: DataFrame, limit: float = 5.0) -> DataFrame:
    """sharpes(strategy_id, sharpe)."""
    return sharpes.withColumn("passed", F.col("sharpe") < limit)


def delay_fragility(sharpes: DataFrame) -> DataFrame:
    """sharpes(strategy_id, scenario, sharpe) with ``baseline`` and ``delay+1``: an edge that one bar of delay destroys."""
    at = lambda s: F.coalesce(F.max(F.when(F.col("scenario") == s, F.col("sharpe"))), F.lit(0.0))
    x = sharpes.groupBy("strategy_id").agg(at("baseline").alias("sharpe0"), at("delay+1").alias("sharpe1"))
    return x.withColumn("passed", ~((F.col("sharpe0") > 1.0) & (F.col("sharpe1") < 0.15 * F.col("sharpe0"))))
