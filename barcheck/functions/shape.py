"""Partition-safe ordering helpers.

Spark's un-partitioned windows sort everything in one task, and a window over a hot key sorts that key in one
task. The helpers here split the ordered axis into chunks, do the work per chunk and combine the chunk
summaries, so no task ever holds more than one chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def dense_index(df: DataFrame, col: str, out: str, bucket: Column) -> DataFrame:
    """0-based position of every distinct value of ``col``; ``bucket`` is a coarser, order-preserving key of it."""
    vals = df.select(col).where(F.col(col).isNotNull()).distinct().withColumn("_b", bucket)
    sizes = vals.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_b").orderBy(col)) - 1
    return vals.withColumn("_i", local).join(before, "_b").select(col, (F.col("_off") + F.col("_i")).cast("int").alias(out))


def _chunked(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    """Adds ``_k``, the keys and the chunk as one struct: structs are equal where their fields are, NULLs included, so rows
    without a key or a date keep their place in grouped, windowed and joined relations."""
    return df.withColumn("_k", F.struct(*[F.col(k).alias(k) for k in keys], chunk.alias("_c"))).repartition("_k")


def previous_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], chunk: Column) -> DataFrame:
    """Adds ``prev_<col>``: the value in the preceding row, by ``order`` within ``keys``.

    ``chunk`` is any key that never decreases along the order (a month, a block of positions). Rows are windowed per
    chunk; the first row of a chunk takes its predecessor from the summary of the chunks before it. Both branches read
    the same exchange.
    """
    keys = list(keys)
    d = _chunked(df, keys, chunk)
    packed = F.struct(*[F.col(c).alias(f"prev_{c}") for c in cols])
    tails = d.groupBy("_k").agg(F.max_by(packed, F.struct(*order)).alias("_tail"))
    carry = tails.select("_k", F.lag("_tail").over(Window.partitionBy(*[f"_k.{c}" for c in keys]).orderBy("_k._c")).alias("_carry"))
    local = F.lag(packed).over(Window.partitionBy("_k").orderBy(*order))
    joined = d.withColumn("_local", local).join(carry, "_k")
    out = F.coalesce(F.col("_local"), F.col("_carry"))
    return joined.select(*df.columns, *[out[f"prev_{c}"].alias(f"prev_{c}") for c in cols])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, chunk: Column) -> DataFrame:
    """Inclusive running sum of ``value`` by ``order`` within ``keys``; chunk totals carry over, so no key is one task."""
    keys = list(keys)
    d = _chunked(df.withColumn("_v", value), keys, chunk)
    totals = d.groupBy("_k").agg(F.sum("_v").alias("_s"))
    carry = totals.select("_k", (F.sum("_s").over(Window.partitionBy(*[f"_k.{c}" for c in keys]).orderBy("_k._c")) - F.col("_s")).alias("_carry"))
    local = F.sum("_v").over(Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = d.withColumn("_local", local).join(carry, "_k")
    return joined.select(*df.columns, (F.col("_local") + F.col("_carry")).alias(out))


def with_halo(df: DataFrame, pos: str, chunk: int, back: int, ahead: int) -> DataFrame:
    """Assigns rows to chunks of the integer axis ``pos`` and repeats the rows that neighbours need.

    Adds ``_c`` (chunk) and ``_own`` (true where the chunk owns the row). A frame reaching at most ``back`` positions
    into the past and ``ahead`` into the future can then be evaluated per ``_c`` and filtered on ``_own``.
    """
    p = F.col(pos)
    own = F.floor(p / F.lit(chunk))
    homes = F.array_distinct(F.array(own, F.floor((p + back) / F.lit(chunk)), F.floor((p - ahead) / F.lit(chunk))))
    return df.withColumn("_c", F.explode(homes)).withColumn("_own", F.col("_c") == own)


def order_sums(df: DataFrame, keys: Sequence[str], value: str, buckets: int = 64, min_of: Column | None = None) -> DataFrame:
    """Equal values collapsed, with counts and sums of everything at or before them in ascending order of ``value``.

    Returns keys, value, ``cnt``, ``cum_cnt`` and ``cum_sum`` (inclusive), ``tot_cnt``, ``tot_sum``. Values are split
    at approximate quantiles of each key, so a hot key is ranked by ``buckets`` tasks instead of one and the result
    stays exact.
    """
    keys = list(keys)
    flat = df.groupBy(*keys, value).agg(F.count("*").alias("cnt"))
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = flat.groupBy(*keys).agg(F.percentile_approx(value, cuts, 1000).alias("_q"))
    placed = _attach(flat, bounds, keys).withColumn("_b", F.size(F.filter("_q", lambda q: q < F.col(value)))).drop("_q")
    per = placed.groupBy(*keys, "_b").agg(F.sum("cnt").alias("_bn"), F.sum(F.col(value) * F.col("cnt")).alias("_bs"))
    w = Window.partitionBy(*keys).orderBy("_b")
    whole = Window.partitionBy(*keys)
    off = per.select(
        *keys,
        "_b",
        (F.sum("_bn").over(w) - F.col("_bn")).alias("_on"),
        F.coalesce(F.sum("_bs").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_os"),
        F.sum("_bn").over(whole).alias("tot_cnt"),
        F.sum("_bs").over(whole).alias("tot_sum"),
    )
    lw = Window.partitionBy(*keys, "_b").orderBy(value)
    return (
        placed.withColumn("_ln", F.sum("cnt").over(lw))
        .withColumn("_ls", F.sum(F.col(value) * F.col("cnt")).over(lw))
        .join(off, [*keys, "_b"])
        .select(
            *keys,
            value,
            "cnt",
            (F.col("_on") + F.col("_ln")).alias("cum_cnt"),
            (F.col("_os") + F.col("_ls")).alias("cum_sum"),
            "tot_cnt",
            "tot_sum",
            "_b",
        )
    )


def _attach(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    if keys:
        return df.join(small, list(keys))
    one = F.lit(0).alias("_one")
    return df.select("*", one).join(small.select("*", one), "_one").drop("_one")


def split_index(t: Column, total: Column, parts: int) -> Column:
    """Part number (0-based) of row ``t`` when ``total`` rows are cut into ``parts`` near-equal runs, longer ones first."""
    q = F.floor(total / F.lit(parts))
    r = total % F.lit(parts)
    head = r * (q + 1)
    return F.when(t < head, F.floor(t / (q + 1))).otherwise(r + F.floor((t - head) / F.greatest(q, F.lit(1)))).cast("int")


def to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Not-a-number and infinite values become NULL at the edge; inside the library missing is always NULL."""
    bad = {c: F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf"))) for c in cols}
    return df.withColumns({c: F.when(~bad[c], F.col(c)) for c in cols})
