"""Exact quantiles of hot keys without a buffer that holds all their values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Buckets of one histogram, and copies of a key's range, so that a hot key meets it in many tasks.
BUCKETS, SALTS = 1024, 16


def median_at_least(value: str, floor: float) -> Column:
    """Aggregate: whether the median of ``value`` is at least ``floor``; NULLs are left out, NULL without values.

    Counts on both sides of the floor settle it, and where they are equal the two values next to it: nothing is ordered
    or kept, and all of it combines before the shuffle.
    """
    v = F.col(value)
    below, rest = F.count_if(v < floor), F.count_if(v >= floor)
    middle = (F.max(F.when(v < floor, v)) + F.min(F.when(v >= floor, v))) / 2 >= floor
    return F.when(below + rest > 0, F.when(below == rest, middle).otherwise(rest > below))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], rounds: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(keys, one column per name in ``probs``): interpolated quantiles, equal to ``percentile``.

    Equal values are collapsed to counts. Each round cuts a key's range in ``buckets`` equal widths, counts them, and goes on
    with the buckets that hold a wanted rank, whose own least and greatest values are the next range, so one outlier costs one
    round. A window orders what is left: about 1 / buckets^rounds of a key's distinct values where they are spread evenly, all of
    a bucket where they are not; it spills, and is right in any case. One round leaves a million rows of a billion values; each more
    round reads the collapsed values again, so the plan doubles. NULL and NaN are left out; a key without values has no
    row; a NULL key is a key of its own; extra columns are not read.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    x = df.select(F.struct(F.lit(0).alias("_all"), *keys).alias("_k"), v.alias("_v")).where(~F.isnan("_v") & F.col("_v").isNotNull())
    x = x.groupBy("_k", "_v").agg(F.count("*").alias("_n"))
    per = x.groupBy("_k").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_of"))
    # a rank is a 0-based place among the values of the key; _skip values lie before the range
    place = [F.lit(float(p)) * (F.col("_of") - 1) for p in probs.values()]
    ranks = [f(p).cast("long") for p in place for f in (F.floor, F.ceil)]
    wanted = per.withColumn("_p", F.array(F.lit(0))).withColumn("_skip", F.lit(0).cast("long")).withColumn("_want", F.array_distinct(F.array(*ranks)))
    x = x.withColumn("_p", F.array(F.lit(0)))
    salt = F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int")
    for _ in range(rounds):
        copies = wanted.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        x = x.withColumn("_s", salt).join(copies, ["_k", "_p", "_s"])
        # halves, so that the width of the range stays finite
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / F.nullif(F.col("_hi") / 2 - F.col("_lo") / 2, F.lit(0.0))
        b = F.least(F.coalesce(F.floor(share * buckets), F.lit(0)), F.lit(buckets - 1)).cast("int")
        x = x.select("_k", F.col("_p").alias("_up"), F.concat("_p", F.array(b)).alias("_p"), "_v", "_n", "_skip", "_want")
        hist = x.groupBy("_k", "_up", "_p").agg(
            F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_c"), F.first("_skip").alias("_skip"), F.first("_want").alias("_want"))
        # at most ``buckets`` rows a key and bucket of the round before
        before = F.sum("_c").over(Window.partitionBy("_k", "_up").orderBy(F.element_at("_p", -1))) - F.col("_c") + F.col("_skip")
        hist = hist.withColumn("_b", before)
        hit = F.filter("_want", lambda r: (r >= F.col("_b")) & (r < F.col("_b") + F.col("_c")))
        wanted = hist.select("_k", "_p", "_lo", "_hi", F.col("_b").alias("_skip"), hit.alias("_want")).where(F.size("_want") > 0)
        x = x.select("_k", "_p", "_v", "_n")
    copies = wanted.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("_k", "_p", "_s", "_skip", "_want")
    x = x.withColumn("_s", salt).join(copies, ["_k", "_p", "_s"])
    x = x.withColumn("_to", F.sum("_n").over(Window.partitionBy("_k", "_p").orderBy("_v")) + F.col("_skip"))
    hit = F.filter("_want", lambda r: (r >= F.col("_to") - F.col("_n")) & (r < F.col("_to")))
    found = x.select("_k", F.explode(hit).alias("_r"), "_v").groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at"))
    out = found.join(per.select("_k", "_of"), "_k")
    cols = []
    for name, p in zip(probs, place):
        low, high = F.floor(p).cast("long"), F.ceil(p).cast("long")
        a, b = F.element_at("_at", low), F.element_at("_at", high)
        cols.append(F.when(low == high, a).when(a == b, a).otherwise((high - p) * a + (p - low) * b).alias(name))
    return out.select(*[F.col("_k")[k].alias(k) for k in keys], *cols)
