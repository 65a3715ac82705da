"""Gap ledger: merge, status transitions, open material gaps, excluded cells, discovery gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..constants import EXCLUDED, MARKETS, MATERIAL, OPEN, REQUIRED_CHECKS, RESOLVED
from .gaps import GAP_COLUMNS

TRANSITION = T.StructType([
    T.StructField("gap_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("resolution", T.StringType()),
    T.StructField("excluded_from", T.ArrayType(T.StringType())),
])


def merge(gaps: DataFrame, seq: Column | None = None, existing: DataFrame | None = None) -> DataFrame:
    """New ledger rows: the first row of each gap id, ids already in the ledger left out.

    First is what ``seq`` says, by default the place of the row in ``gaps``; what a row holds decides between rows of one
    place only. A hash aggregation with map-side combine, so an id repeated in a third of the rows is reduced before the shuffle.
    """
    rest = [c for c in gaps.columns if c != "gap_id"]
    placed = gaps.withColumn("_at", seq if seq is not None else F.monotonically_increasing_id())
    order = F.struct(F.col("_at"), *[F.col(c) for c in rest])
    out = placed.groupBy("gap_id").agg(F.min_by(F.struct(*rest), order).alias("g")).select("g.*", "gap_id")
    if existing is not None:
        out = out.join(existing.select("gap_id"), "gap_id", "left_anti")
    return out.select(*[c for c in GAP_COLUMNS if c in out.columns])


def resolve(spark: SparkSession, seq: int, gap_id: str, how: str) -> DataFrame:
    return spark.createDataFrame([(gap_id, seq, RESOLVED, how, [])], TRANSITION)


def exclude(spark: SparkSession, seq: int, gap_id: str, experiments: Sequence[str], why: str) -> DataFrame:
    if not experiments:
        raise ValueError("an exclusion has to name the experiments it holds for")
    return spark.createDataFrame([(gap_id, seq, EXCLUDED, why, list(experiments))], TRANSITION)


def invalid_exclusions(transitions: DataFrame) -> DataFrame:
    return transitions.where((F.col("status") == EXCLUDED) & (F.coalesce(F.size("excluded_from"), F.lit(0)) <= 0))


def apply_transitions(ledger: DataFrame, transitions: DataFrame) -> DataFrame:
    """Ledger with the latest status of every gap. An exclusion without experiments stops the job."""
    named = F.when(
        (F.col("status") == EXCLUDED) & (F.coalesce(F.size("excluded_from"), F.lit(0)) <= 0),
        F.raise_error(F.lit("an exclusion has to name the experiments it holds for")),
    ).otherwise(F.col("status"))
    last = transitions.withColumn("status", named.cast("string")).groupBy("gap_id").agg(
        F.max_by(F.struct("status", "resolution", "excluded_from"), "seq").alias("_t")
    )
    x = ledger.join(last, "gap_id", "left")
    moved = F.col("_t").isNotNull()
    keep_list = moved & (F.col("_t.status") == EXCLUDED)
    return x.select(*[
        F.when(moved, F.col("_t.status")).otherwise(F.col("status")).alias(c) if c == "status"
        else F.when(moved, F.col("_t.resolution")).otherwise(F.col("resolution")).alias(c) if c == "resolution"
        else F.when(keep_list, F.col("_t.excluded_from")).otherwise(F.col("excluded_from")).alias(c) if c == "excluded_from"
        else F.col(c)
        for c in ledger.columns
    ])


def unresolved_material(ledger: DataFrame, experiment: str | None = None) -> DataFrame:
    covered = F.lit(True) if experiment is None else F.array_contains("excluded_from", experiment)
    settled = (F.col("status") == RESOLVED) | ((F.col("status") == EXCLUDED) & covered)
    return ledger.where((F.col("severity") == MATERIAL) & ~settled)


def excluded_gaps(ledger: DataFrame, experiment: str) -> DataFrame:
    return ledger.where((F.col("status") == EXCLUDED) & F.array_contains("excluded_from", experiment))


def summary(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("check", "kind", "severity", "status").agg(F.count("*").alias("n_gaps"))


def rollup(ledger: DataFrame) -> DataFrame:
    """(level, check, kind, severity, status, n_gaps, n_rows): counts of gaps and the sum of their ``n`` for every prefix of the four.

    ``level`` is the grouping id: 0 for a full row, 15 for the total; it tells a rolled-up column from a NULL value.
    """
    x = ledger.rollup("check", "kind", "severity", "status")
    return x.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n_gaps"), F.sum("n").alias("n_rows"))


def gate_reasons(requirements: DataFrame, coverage: DataFrame, checks_run: DataFrame, ledger: DataFrame) -> DataFrame:
    """(experiment, reason, subject): everything that keeps the gate shut; an experiment with no row is open.

    requirements(experiment, markets ARRAY, needs ARRAY), coverage(need, complete, note), checks_run(check),
    ledger with current statuses. Exclusions apply per experiment.
    """
    known = F.array(*[F.lit(m) for m in MARKETS])
    markets = requirements.select("experiment", F.explode("markets").alias("subject")).where(~F.array_contains(known, F.col("subject")))
    markets = markets.select("experiment", F.lit("UNREGISTERED_MARKET").alias("reason"), "subject")

    need = requirements.select("experiment", F.explode("needs").alias("need")).join(coverage, "need", "left")
    status = F.when(F.col("complete").isNull(), F.lit("DATASET_NOT_INGESTED")).when(~F.col("complete"), F.lit("COVERAGE_INCOMPLETE"))
    note = F.when(~F.coalesce("complete", F.lit(False)) & F.col("complete").isNotNull(), F.coalesce("note", F.lit("sample only")))
    needs = need.select("experiment", status.alias("reason"), F.concat_ws(": ", "need", note).alias("subject")).where("reason IS NOT NULL")

    req = requirements.select("experiment", F.explode(F.array(*[F.lit(c) for c in REQUIRED_CHECKS])).alias("check"))
    checks = req.join(checks_run.distinct(), "check", "left_anti").select("experiment", F.lit("CHECK_NOT_RUN").alias("reason"), F.col("check").alias("subject"))

    open_gaps = ledger.where((F.col("severity") == MATERIAL) & (F.col("status") != RESOLVED))
    # experiments are few and named by hand: they travel as one array per gap row
    names = requirements.agg(F.collect_set("experiment")).scalar()
    hit = open_gaps.withColumn("_e", names).select(
        F.explode(F.when(F.col("status") == EXCLUDED, F.array_except("_e", "excluded_from")).otherwise(F.col("_e"))).alias("experiment"),
        F.lit("OPEN_MATERIAL_GAP").alias("reason"), F.col("gap_id").alias("subject"),
    )
    return markets.unionByName(needs).unionByName(checks).unionByName(hit)


def gate(requirements: DataFrame, reasons: DataFrame) -> DataFrame:
    n = reasons.groupBy("experiment").agg(F.count("*").alias("n_reasons"))
    x = requirements.select("experiment").join(n, "experiment", "left")
    return x.select("experiment", F.coalesce("n_reasons", F.lit(0)).alias("n_reasons")).withColumn("open", F.col("n_reasons") == 0)


__all__ = [
    "OPEN", "TRANSITION", "apply_transitions", "exclude", "excluded_gaps", "gate", "gate_reasons", "invalid_exclusions", "merge",
    "resolve", "summary", "unresolved_material",
]
