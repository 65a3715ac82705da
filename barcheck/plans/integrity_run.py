"""The whole integrity run as one plan: checks -> ledger -> summary -> gate."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..operators import ledger
from ..operators.corporate import CorporateActions
from ..operators.duplicates import check_duplicates, check_stale_daily
from ..operators.gaps import union_all
from ..operators.minutes import MinuteBars
from ..operators.news import News
from ..operators.sessions import DailySessions


class IntegrityRun:
    """Collects the gap relations of the datasets given; nothing runs until a result is written."""

    def __init__(self) -> None:
        self.parts: list[DataFrame] = []
        self.checks: set[str] = set()

    def daily(self, bars: DataFrame, dataset_id: str, master: DataFrame | None = None, splits: DataFrame | None = None,
              liquid_min_volume: float = 100_000) -> IntegrityRun:
        self.parts += [
            DailySessions(bars, dataset_id, liquid_min_volume).gaps(master),
            check_duplicates(bars, ["ticker", "date"], dataset_id),
            check_stale_daily(bars, dataset_id, liquid_min_volume),
        ]
        self.checks |= {"calendar", "sessions", "duplicates", "stale"}
        if splits is not None:
            self.parts.append(CorporateActions(bars, splits, dataset_id).gaps(master))
            self.checks.add("corporate_actions")
        return self

    def minutes(self, bars: DataFrame, dataset_id: str, liquid_min_session_volume: float = 200_000) -> IntegrityRun:
        self.parts.append(MinuteBars(bars, dataset_id, liquid_min_session_volume).gaps())
        self.checks |= {"minute_bars", "timestamp_gaps"}
        return self

    def news(self, news: DataFrame, dataset_id: str, retrieved_at: datetime | str) -> IntegrityRun:
        self.parts.append(News(news, dataset_id, retrieved_at).gaps())
        self.checks.add("news_timestamps")
        return self

    def ledger(self, existing: DataFrame | None = None) -> DataFrame:
        placed = [p.withColumn("_place", F.lit(i)) for i, p in enumerate(self.parts)]
        return ledger.merge(union_all(placed), F.col("_place"), existing)

    def checks_run(self) -> DataFrame:
        spark = self.parts[0].sparkSession
        return spark.createDataFrame([(c,) for c in sorted(self.checks)], "check string")
