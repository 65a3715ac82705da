"""Mixing sources to target weights: nested thresholds on a row hash, found from histograms instead of a sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut_lineage, table, word_count

#: Fixed values of the contract: weights of the sources by name, repeating, and how often a source may be taken.
WEIGHTS = (5, 2, 1)
REPEATS = 3
#: The hash has LEVELS * BITS bits; each level splits the boundary bucket of the level before it in 2**BITS.
LEVELS, BITS = 5, 12


def row_hash(doc_id: Column) -> Column:
    """60 bits of md5 as a long. Rows with one id share it, so they are taken together."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target for ``sizes`` (source, size).

    Shares by weight, held at ``repeats`` times a source's size; what is over goes to the others by weight until no
    source is above. The sources that end at their limit are those with the smallest limit per weight, so one ordered
    pass over the sources (not the rows) finds the level at which the rest share.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")).withColumn("w", w.cast("long"))
    over = Window.orderBy((F.col("source_size") * repeats / F.col("w")), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    placed = per.select(
        "source",
        "source_size",
        "w",
        (F.sum("source_size").over(whole) - repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
    )
    #: A source is at its limit if its share of what the sources before it leave is no less than its limit.
    capped = placed.withColumn("full", F.col("left") * F.col("w") >= repeats * F.col("source_size") * F.col("w_left"))
    share = F.min(F.when(~F.col("full"), F.struct(-F.col("left"), "left", "w_left"))).over(whole)
    free = F.col("w") * share["left"] / share["w_left"]
    return capped.select("source", "source_size", F.when(F.col("full"), (repeats * F.col("source_size")).cast("double")).otherwise(free).alias("target"))


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, whole (times every row is taken), cut (rows with a hash below it once more), at_cut (also rows on it).

    Per level: words by source and bucket are summed, the bucket in which the budget ends is found, and only its rows
    are split further. The rows on the last bound share one hash; they are taken if that comes nearer to the target.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    state = wanted.withColumn("whole", whole).select("source", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("prefix"))
    #: A source taken in whole copies only has no boundary; -1 is below every hash.
    done = state.where(F.col("budget") <= 0).select("source", "whole", F.lit(-1).cast("long").alias("cut"), F.lit(False).alias("at_cut"))
    state = state.where(F.col("budget") > 0)
    sizes = sizes.where(F.col("size") > 0)
    for level in range(1, LEVELS + 1):
        low = (LEVELS - level) * BITS
        s = state.select(F.col("source").alias("s"), "whole", "budget", "prefix")
        rows = sizes.withColumn("b", F.shiftright("hash", low))
        inside = rows.join(s, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("b", BITS) == F.col("prefix")))
        hist = inside.groupBy("source", "b").agg(F.sum("size").alias("n"), F.first("whole").alias("whole"), F.first("budget").alias("budget"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("b"))
        edge = hist.withColumn("upto", upto).where(F.col("upto") >= F.col("budget")).groupBy("source").agg(F.min_by(F.struct("whole", "budget", "b", "n", "upto"), "b").alias("e"))
        state = edge.select("source", "e.whole", (F.col("e.budget") - F.col("e.upto") + F.col("e.n")).alias("budget"), F.col("e.b").alias("prefix"), F.col("e.n").alias("n"))
    found = state.select("source", "whole", F.col("prefix").alias("cut"), (2 * F.col("budget") >= F.col("n")).alias("at_cut"))
    return found.unionByName(done)


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """The staged narrow table (doc_id, source, size, hash) and one staged row per source with target and thresholds."""
    sizes = cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id")).alias("hash")))
    wanted = cut_lineage(targets(sizes, weights, repeats))
    cuts = thresholds(sizes, wanted).withColumnRenamed("source", "s")
    return sizes, cut_lineage(wanted.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))


def times() -> Column:
    """How often a row with ``hash`` is taken under the thresholds of its source."""
    more = (F.col("hash") < F.col("cut")) | ((F.col("hash") == F.col("cut")) & F.col("at_cut"))
    return F.col("whole") + more.cast("int")


def _with_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    p = plan.withColumnRenamed("source", "mix_source")
    return rows.join(p, F.col("source").eqNullSafe(F.col("mix_source"))).drop("mix_source")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source).

    NULL texts have size 0, NULL sources form one source that comes last; a source without words has target 0. Rows
    with the same doc_id (NULL included) share a hash and are taken equally often; ties at the bound are taken if that
    is nearer to the target. Other columns of ``docs`` are not read. An empty table gives an empty result. The text is
    read once; the levels work on a narrow table, whose sums are combined before each shuffle.
    """
    sizes, plan = plan_mix(docs, weights, repeats)
    return _with_source(sizes, plan).select("doc_id", "size", "source_size", "target", (F.col("size") * times()).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The mixture itself: every row as often as it is taken, with the columns of ``docs``."""
    _, plan = plan_mix(docs, weights, repeats)
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("source"), row_hash(F.col("doc_id")).alias("hash"))
    taken = _with_source(row, plan).select("row", times().alias("k")).where(F.col("k") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("k")))).select("row.*")


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"))


#: The same mixture by sorting each source, for comparison at test sizes.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM d GROUP BY source),
o AS (
  SELECT *, CAST(sum(s) OVER () - {REPEATS} * coalesce(sum(s) OVER b, 0) AS BIGINT) AS rest, CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS BIGINT) AS wrest FROM per
  WINDOW b AS (ORDER BY CAST({REPEATS} * s AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, rest * w >= {REPEATS} * s * wrest AS capped FROM o),
l AS (SELECT max(rest) AS rest, arg_max(wrest, rest) AS wrest FROM f WHERE NOT capped),
t AS (
  SELECT f.source, s, CASE WHEN capped THEN CAST({REPEATS} * s AS DOUBLE) ELSE CAST(w * l.rest AS DOUBLE) / l.wrest END AS target FROM f, l),
q AS (SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS k FROM t),
r AS (
  SELECT d.doc_id, d.size, q.s AS source_size, q.target, q.k, q.target - q.k * q.s AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS n
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (k + CASE WHEN budget > 0 AND (upto < budget OR (upto - n < budget AND 2 * (budget - upto + n) >= n)) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""
