"""News checks: timestamp quality in one scan, identity, syndication and coverage."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F, types as T

from ..constants import MATERIAL, MINOR
from ..functions.text import headline_key, iso_instant, lacks_zone
from . import calendar as cal
from .duplicates import check_duplicates
from .gaps import as_gaps, union_all


def _instant(x: datetime | str):
    return F.lit(x).cast("timestamp") if isinstance(x, str) else F.lit(x)


class News:
    def __init__(self, news: DataFrame, dataset_id: str, retrieved_at: datetime | str):
        self.raw, self.dataset_id = news, dataset_id
        raw = F.col("published_utc")
        parsed = iso_instant(raw)
        no_zone = lacks_zone(raw)
        n = news.withColumn("unread", parsed.isNull()).withColumn("no_zone", no_zone)
        n = n.withColumn("ts", F.when(~no_zone, parsed))  # a missing zone is never guessed
        n = n.withColumn("future", F.coalesce(F.col("ts") > _instant(retrieved_at), F.lit(False)))
        n = n.withColumn("ancient", F.coalesce(F.col("ts") < _instant("1995-01-01T00:00:00Z"), F.lit(False)))
        self.news = n

    def profile(self) -> DataFrame:
        """All counts of the timestamp checks, from one scan."""
        ts = F.col("ts")
        sec0 = F.second(ts) == 0
        midnight = sec0 & (F.minute(ts) == 0) & (F.hour(ts) == 0)
        quarter = F.minute(ts).isin(0, 15, 30, 45)
        tick = F.lit(False)
        if "tickers" in self.raw.columns:
            c = F.col("tickers")
            if isinstance(self.raw.schema["tickers"].dataType, T.ArrayType):
                tick = c.isNull() | (F.size(c) == 0)
            else:
                tick = c.isNull() | F.trim(c).isin("", "[]")
        pub = F.countDistinct("publisher_name") if "publisher_name" in self.raw.columns else F.lit(None).cast("long")
        return self.news.agg(
            F.count("*").alias("n_articles"),
            F.count(ts).alias("usable"),
            F.count_if("unread").alias("unread"),
            F.count_if(F.col("unread") & ~F.col("no_zone")).alias("unparseable"),
            F.count_if("no_zone").alias("no_zone"),
            F.count_if("future").alias("future"),
            F.count_if("ancient").alias("ancient"),
            F.count_if(midnight).alias("midnight"),
            F.count_if(sec0).alias("sec0"),
            F.count_if(quarter).alias("quarter"),
            F.count_if(tick).alias("untagged"),
            pub.alias("distinct_publishers"),
        )

    def statistics(self) -> DataFrame:
        p = self.profile()
        share = lambda c: F.when(F.col("usable") > 0, F.col(c) / F.col("usable"))
        return p.select(
            "n_articles", share("midnight").alias("midnight_utc_fraction"), share("sec0").alias("zero_seconds_fraction"),
            share("quarter").alias("quarter_hour_fraction"), "distinct_publishers",
            self.per_session().agg(F.median("k")).scalar().alias("median_articles_per_session"),
            self._syndicated().agg(F.count("*")).scalar().alias("syndicated_titles"),
        )

    def _headlines(self) -> DataFrame:
        """Normalised headlines, which may be whole texts, with a digest that tells them apart."""
        x = self.news.select(headline_key(F.col("title")).alias("headline"), "publisher_name", "ts").dropna()
        return x.where(F.length("headline") > 15).select(F.sha2("headline", 256).alias("_d"), "publisher_name", "headline")

    def _syndicated(self) -> DataFrame:
        """Digests of headlines with two publishers or more: the least and the greatest of them differ. No text is shuffled."""
        x = self._headlines().groupBy("_d").agg(F.min("publisher_name").alias("a"), F.max("publisher_name").alias("b"))
        return x.where("a <> b").select("_d")

    def timestamp_gaps(self) -> DataFrame:
        def row(when, kind, severity, n, text):
            return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), n.cast("long").alias("n"), F.lit(text).alias("text")))

        c = F.col
        rows = [
            row(c("unread") > 0, "MISSING_OR_UNPARSEABLE_TIMESTAMP", MATERIAL, c("unparseable"), "publication time is missing or unreadable"),
            row(c("no_zone") > 0, "TIMEZONE_MISSING", MATERIAL, c("no_zone"), "publication time has no zone and is unusable"),
            row(c("future") > 0, "PUBLISHED_AFTER_RETRIEVAL", MATERIAL, c("future"), "published after the retrieval"),
            row(c("ancient") > 0, "IMPLAUSIBLE_EARLY_TIMESTAMP", MATERIAL, c("ancient"), "published before 1995"),
            row(c("midnight") > 0.02 * c("n_articles"), "DATE_ONLY_TIMESTAMPS", MATERIAL, c("midnight"), "many articles at exactly midnight"),
            row(c("sec0") > 0.9 * c("usable"), "MINUTE_RESOLUTION_ONLY", MINOR, F.lit(1), "publication times have whole minutes only"),
            row(c("untagged") > 0, "NO_TICKER_MAPPING", MINOR, c("untagged"), "articles without ticker tags"),
        ]
        for col in ("vendor_receipt_ts", "system_receipt_ts"):
            rows.append(row(F.lit(col not in self.raw.columns), f"NO_{col.upper()}", MATERIAL, F.lit(1), "true availability is unknown"))
        g = self.profile().select(F.explode(F.array_compact(F.array(*rows))).alias("g")).select("g.*")
        return as_gaps(g, self.dataset_id, "news_timestamps", c("kind"), c("severity"), F.concat(c("n").cast("string"), F.lit(" articles: "), c("text")), n=c("n"))

    def duplicates(self) -> DataFrame:
        return check_duplicates(self.raw.select("id", "published_utc", "title"), ["id"], self.dataset_id, "articles")

    def syndicated_titles(self) -> DataFrame:
        """Normalised headlines carried by more than one publisher (distinct pairs first: a hot headline stays cheap)."""
        # the headlines of several publishers only are fetched
        x = self._headlines()
        pairs = x.select("_d", "publisher_name").distinct()
        several = pairs.groupBy("_d").agg(F.count("*").alias("publishers")).where("publishers > 1")
        return x.join(several, "_d").groupBy("_d", "publishers").agg(F.first("headline").alias("headline")).select("headline", "publishers")

    def syndication(self) -> DataFrame:
        x = self._syndicated().agg(F.count("*").alias("n")).where("n > 0")
        return as_gaps(x, self.dataset_id, "news_independence", "SYNDICATED_ARTICLES", MINOR,
                       F.format_string("%d headlines appear under several publishers", "n"), n=F.col("n"))

    def per_session(self) -> DataFrame:
        """Articles per expected session (zero included). The session range is cut in UTC dates, the counts are by exchange date."""
        ok = self.news.where(F.col("ts").isNotNull() & ~F.col("future") & ~F.col("ancient"))
        counts = ok.groupBy(cal.exchange_date(F.col("ts")).alias("date")).agg(F.count("*").alias("k"))
        span = ok.agg(F.to_date(F.min("ts")).alias("lo"), F.to_date(F.max("ts")).alias("hi"))
        days = cal.classify_days(cal.days_between(span)).where(cal.SESSION)
        return days.join(counts, "date", "left").select("date", F.coalesce("k", F.lit(0)).alias("k"))

    def coverage_gaps(self) -> DataFrame:
        s = self.per_session()
        x = s.withColumn("med", s.agg(F.median("k")).scalar()).where("med >= 5 AND k < 0.1 * med")
        d = F.col("date")
        return as_gaps(x, self.dataset_id, "news_coverage", "NEWS_COVERAGE_GAP", MATERIAL,
                       F.format_string("%d articles against a median of %d", F.col("k"), F.col("med").cast("int")), start=d, end=d)

    def gaps(self, with_calendar: bool = True) -> DataFrame:
        parts = [self.timestamp_gaps(), self.syndication()]
        if "id" in self.raw.columns:
            parts.append(self.duplicates())
        if with_calendar:
            parts.append(self.coverage_gaps())
        return union_all(parts)
