"""Experiment log: reading, hash-chain sealing and verification, pre-registration, trial counts, contamination."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import EVENT_KINDS, GENESIS_PREV
from ..functions.shape import previous_row
from ..functions.text import canonical_json


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Canonical JSON lines. Fields are cut from the raw text, so the hashed bytes (number format included) stay as written."""
    pattern = r'^\{"hash":"([0-9a-f]{64})","kind":"([A-Z_]+)","payload":(.*),"prev_hash":"([0-9a-f]{64})","seq":(\d+),"ts":([^,}]+)\}$'
    x = spark.read.text(path)
    g = lambda i: F.regexp_extract("value", pattern, i)
    return x.select(
        g(5).cast("long").alias("seq"), g(6).alias("ts_text"), g(2).alias("kind"), g(3).alias("payload"), g(4).alias("prev_hash"), g(1).alias("hash")
    )


def to_jsonl(events: DataFrame) -> DataFrame:
    """Canonical line of every event, ready for ``write.text``."""
    return events.select(F.format_string(
        '{"hash":"%s","kind":"%s","payload":%s,"prev_hash":"%s","seq":%d,"ts":%s}', "hash", "kind", "payload", "prev_hash", "seq", "ts_text"
    ).alias("value"))


def events_of(events: DataFrame, kind: str | None = None) -> DataFrame:
    """Events in order, payload also as VARIANT."""
    x = events if kind is None else events.where(F.col("kind") == kind)
    return x.withColumn("body", F.try_parse_json("payload")).orderBy("seq")


def field(name: str, kind: str = "string", payload: str = "payload") -> Column:
    return F.try_variant_get(F.try_parse_json(payload), f"$.{name}", kind)


def unknown_kinds(events: DataFrame) -> DataFrame:
    return events.where(~F.col("kind").isin(*EVENT_KINDS))


def event_hash(prev: Column, ts_text: Column, kind: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws("|", prev, ts_text, kind, payload), 256)


def verify_chain(events: DataFrame, keys: list[str] | None = None, block: int = 1_000_000) -> DataFrame:
    """Per event: does its hash match its content, and does it link to its predecessor? Neighbours are found block-wise."""
    keys = keys or []
    e = events.select(*keys, "seq", "ts_text", "kind", "payload", F.col("prev_hash").alias("link"), "hash")
    x = previous_row(e, keys, ["seq"], ["hash"], F.floor(F.col("seq") / F.lit(block)))
    own = event_hash(F.col("link"), F.col("ts_text"), F.col("kind"), F.col("payload")) == F.col("hash")
    link = F.col("link") == F.coalesce("prev_hash", F.lit(GENESIS_PREV))
    return x.select(*keys, "seq", own.alias("hash_ok"), link.alias("link_ok"))


def chain_valid(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("events"), F.count_if(~(F.col("hash_ok") & F.col("link_ok"))).alias("broken")).withColumn("valid", F.col("broken") == 0)


def seal_events(events: DataFrame, chain: str = "chain", heads: DataFrame | None = None) -> DataFrame:
    """Adds prev_hash and hash to new events of many chains (seq, ts_text, kind, payload, chain).

    A chain is sequential by definition; each is folded in event order by one streaming pass that keeps a single hash,
    so a long chain costs time but never memory. ``heads`` (chain, hash) continues existing chains. Unknown kinds stop
    the job.
    """
    ok = F.when(F.col("kind").isin(*EVENT_KINDS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown event kind "), "kind")))
    x = events.select(F.col(chain).alias("chain"), "seq", "ts_text", ok.cast("string").alias("kind"), "payload")
    if heads is not None:
        x = x.join(heads.select("chain", F.col("hash").alias("head")), "chain", "left")
    else:
        x = x.withColumn("head", F.lit(None).cast("string"))
    x = x.withColumn("head", F.coalesce("head", F.lit(GENESIS_PREV))).repartition("chain").sortWithinPartitions("chain", "seq")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, ""
        for pdf in batches:
            prevs, hashes = [], []
            for chain_, head, ts, kind, body in zip(pdf["chain"], pdf["head"], pdf["ts_text"], pdf["kind"], pdf["payload"]):
                if chain_ != current:
                    current, last = chain_, head
                prevs.append(last)
                last = hashlib.sha256(f"{last}|{ts}|{kind}|{body}".encode()).hexdigest()
                hashes.append(last)
            yield pdf.drop(columns="head").assign(prev_hash=prevs, hash=hashes)

    return x.mapInPandas(fold, "chain string, seq long, ts_text string, kind string, payload string, prev_hash string, hash string")


def append_events(sealed: DataFrame, path: str) -> None:
    sealed.write.mode("append").parquet(path)


# ------------------------------------------------------------------ research objects


def _typed(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("kind") == kind).select("seq", "payload", field("hyp_id").alias("hyp_id"), field("version", "int").alias("version"))


def preregistrations(events: DataFrame) -> DataFrame:
    """First registration of each (hypothesis, version), the number of registrations and the digest of the spec."""
    p = _typed(events, "PREREG")
    g = p.groupBy("hyp_id", "version").agg(F.min("seq").alias("seq"), F.count("*").alias("registrations"), F.min_by("payload", "seq").alias("payload"))
    return g.withColumn("payload_sha", F.sha2(canonical_json(F.col("payload")), 256)).drop("payload")


def repeated_preregistrations(events: DataFrame) -> DataFrame:
    return preregistrations(events).where("registrations > 1")


def experiments_without_prereg(events: DataFrame) -> DataFrame:
    """Experiments that no earlier registration of the same hypothesis version covers."""
    first = preregistrations(events).select("hyp_id", "version", F.col("seq").alias("since"))
    e = _typed(events, "EXPERIMENT").drop("payload")
    x = e.join(first, ["hyp_id", "version"], "left")
    return x.where(F.col("since").isNull() | (F.col("since") > F.col("seq"))).select("seq", "hyp_id", "version")


def trial_counts(events: DataFrame) -> DataFrame:
    """Experiments, hypotheses, variants and datasets per family; failed runs count. Distinct sets are built in two steps."""
    e = events.where(F.col("kind") == "EXPERIMENT").select(
        field("family").alias("family"), field("hyp_id").alias("hyp_id"), field("version", "int").alias("version"),
        F.to_json(field("params", "variant")).alias("params"),
        field("dataset_ids", "array<string>").alias("dataset_ids"),
    )
    v = e.groupBy("family", "hyp_id", "version", "params").agg(F.count("*").alias("k"))
    h = v.groupBy("family", "hyp_id").agg(F.sum("k").alias("k"), F.count("*").alias("v"))
    main = h.groupBy("family").agg(F.sum("k").alias("experiments"), F.count("*").alias("hypotheses"), F.sum("v").alias("variants"))
    d = e.select("family", F.explode("dataset_ids").alias("d")).distinct().groupBy("family").agg(F.count("*").alias("datasets"))
    return main.join(d, "family", "left").withColumn("datasets", F.coalesce("datasets", F.lit(0)))


def contaminated(events: DataFrame) -> DataFrame:
    """Datasets whose results were disclosed."""
    return events.where(F.col("kind") == "CONTAMINATION").select(field("dataset_id").alias("dataset_id")).distinct()


def final_test_eligibility(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """candidates(hyp_id, dataset_id, classification): may the single locked test be run, and if not, why."""
    used = events.where(F.col("kind") == "FINAL_TEST").select(field("hyp_id").alias("hyp_id")).distinct().withColumn("_used", F.lit(True))
    dirty = contaminated(events).withColumn("_dirty", F.lit(True))
    x = candidates.join(used, "hyp_id", "left").join(dirty, "dataset_id", "left")
    why = (
        F.when(F.col("_used").isNotNull(), F.lit("LINEAGE_ALREADY_TESTED"))
        .when(F.col("_dirty").isNotNull(), F.lit("DATASET_CONTAMINATED"))
        .when(~F.col("classification").startswith("ROBUST"), F.lit("NOT_ROBUST_IN_DEVELOPMENT"))
    )
    return x.select(*candidates.columns, why.isNull().alias("eligible"), why.alias("refusal"))


def _lane_sum(lane: str) -> Column:
    """Sum modulo 2**62: decimals do not overflow, however many rows there are, and any order gives the same sum."""
    return (F.sum(F.col(lane).cast("decimal(18,0)")) % F.lit(1 << 62).cast("decimal(19,0)")).cast("long")


def fingerprint(df: DataFrame, ts: str, ticker: str) -> DataFrame:
    """Order-insensitive content fingerprint: two 32-bit lanes of a row digest summed, with counts and range."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in df.columns]))
    lane = lambda i: F.conv(F.substring(row, i, 8), 16, 10).cast("long")
    return df.select(F.col(ts), F.col(ticker), lane(1).alias("a"), lane(9).alias("b")).agg(
        F.count("*").alias("rows"), F.countDistinct(ts).alias("n_bars"), F.countDistinct(ticker).alias("n_tickers"),
        F.min(ts).cast("string").alias("start"), F.max(ts).cast("string").alias("end"), _lane_sum("a").alias("lane_a"), _lane_sum("b").alias("lane_b"),
    )


def seal_matches(current: DataFrame, sealed: DataFrame) -> DataFrame:
    """One row: is the fingerprint equal to the sealed one?"""
    same = F.lit(True)
    for c in current.columns:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    one = F.lit(1).alias("_one")
    return current.select("*", one).alias("x").join(sealed.select("*", one).alias("y"), "_one").select(same.alias("matches"))
