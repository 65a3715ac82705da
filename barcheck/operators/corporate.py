"""Corporate-action checks on unadjusted daily bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import COMMON_RATIOS, MATERIAL, MINOR
from ..functions.shape import previous_row
from .gaps import as_gaps, union_all

CHECK = "corporate_actions"


class CorporateActions:
    """r is open over the previous own close; a split of ratio k shows as r near 1/k."""

    def __init__(self, daily: DataFrame, splits: DataFrame, dataset_id: str, jump: float = 0.35, tol: float = 0.12, reach: int = 4):
        self.dataset_id, self.jump, self.tol = dataset_id, jump, tol
        d = daily.select("ticker", "date", "open", "close")
        d = previous_row(d, ["ticker"], ["date", "open", "close"], ["close"], F.trunc("date", "month"))
        self.moves = d.select("ticker", "date", (F.col("open") / F.nullif(F.col("prev_close"), F.lit(0.0))).alias("r"))
        copies = splits.groupBy("ticker", "execution_date", "split_from", "split_to").agg(F.count("*").alias("copies"))
        self.splits = copies.withColumn("ratio", F.try_divide("split_to", "split_from"))
        # the +-4 day window as exact days: an equi-join instead of a range join
        around = F.sequence(F.date_sub("execution_date", reach), F.date_add("execution_date", reach), F.expr("interval 1 day"))
        self.near = self.splits.select("ticker", "execution_date", "split_from", "split_to", "copies", "ratio", F.explode(around).alias("date"))

    def split_status(self) -> DataFrame:
        """Per recorded split: bars in its window, whether one shows the ratio, and the range of r."""
        hit = F.abs(F.col("r") * F.col("ratio") - 1) < self.tol
        w = self.near.join(self.moves.withColumn("bar", F.lit(True)), ["ticker", "date"], "left")
        return w.groupBy("ticker", "execution_date", "split_from", "split_to", "copies").agg(
            F.count("bar").alias("bars"),
            F.coalesce(F.bool_or(hit), F.lit(False)).alias("hit"),
            F.min("r").alias("r_min"),
            F.max("r").alias("r_max"),
        )

    def split_gaps(self) -> DataFrame:
        s = self.split_status().where("NOT hit")
        no_data = F.col("bars") == 0
        kind = F.when(no_data, F.lit("SPLIT_NO_PRICE_DATA")).otherwise(F.lit("SPLIT_WITHOUT_DISCONTINUITY"))
        seen = F.format_string("open over previous close stays in %.2f..%.2f", F.col("r_min"), F.col("r_max"))
        why = F.when(no_data, F.lit("no bar near the date")).otherwise(F.coalesce(seen, F.lit("no earlier close")))
        detail = F.concat(F.col("ticker"), F.lit(": recorded split is not visible, "), why)
        d = F.col("execution_date")
        return as_gaps(s, self.dataset_id, CHECK, kind, MATERIAL, detail, F.col("ticker"), d, d)

    def unrecorded_moves(self) -> DataFrame:
        """Large overnight moves outside every split window, and whether they look like a split."""
        r = F.col("r")
        big = self.moves.where((r < 1 - self.jump) | (r > 1 + 2 * self.jump))
        big = big.join(self.near.select("ticker", "date").distinct(), ["ticker", "date"], "left_anti")
        ks = F.array(*[F.lit(float(k)) for k in COMMON_RATIOS])
        like = F.exists(ks, lambda k: (F.abs(r - 1 / k) / (1 / k) < self.tol) | (F.abs(r - k) / k < self.tol))
        return big.withColumn("split_like", like)

    def move_gaps(self) -> DataFrame:
        x = self.unrecorded_moves()
        like = F.col("split_like")
        kind = F.when(like, F.lit("UNRECORDED_SPLIT_LIKE_DISCONTINUITY")).otherwise(F.lit("LARGE_UNEXPLAINED_GAP"))
        sev = F.when(like, F.lit(MATERIAL)).otherwise(F.lit(MINOR))
        d = F.col("date")
        detail = F.format_string("%s: open over previous close is %.3f without a recorded action", F.col("ticker"), F.col("r"))
        return as_gaps(x, self.dataset_id, CHECK, kind, sev, detail, F.col("ticker"), d, d)

    def delisting_gaps(self, master: DataFrame) -> DataFrame:
        known = F.col("delist_return").isNotNull() if "delist_return" in master.columns else F.lit(False)
        x = master.where(F.col("delist_date").isNotNull() & ~known)
        d = F.col("delist_date")
        detail = F.concat(F.col("ticker"), F.lit(": terminal return unknown; it is not taken as 0"))
        return as_gaps(x, self.dataset_id, CHECK, "DELISTING_RETURN_UNKNOWN", MATERIAL, detail, F.col("ticker"), d, d)

    def gaps(self, master: DataFrame | None = None) -> DataFrame:
        parts = [self.split_gaps(), self.move_gaps()]
        if master is not None and "delist_date" in master.columns:
            parts.append(self.delisting_gaps(master))
        return union_all(parts)

    def statistics(self, dividends: DataFrame | None = None) -> DataFrame:
        one = F.lit(1).alias("_one")
        s = self.split_status().agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("recorded_splits"),
            F.coalesce(F.sum(F.when(F.col("hit"), F.col("copies"))), F.lit(0)).alias("splits_confirmed_in_prices"),
            F.coalesce(F.sum(F.when(~F.col("hit") & (F.col("bars") > 0), F.col("copies"))), F.lit(0)).alias("splits_without_discontinuity"),
        )
        u = self.unrecorded_moves().agg(F.count("*").alias("unrecorded_discontinuities"))
        out = s.select("*", one).join(u.select("*", one), "_one")
        if dividends is not None:
            out = out.join(dividends.agg(F.count("*").alias("recorded_dividends")).select("*", one), "_one")
        return out.drop("_one")
