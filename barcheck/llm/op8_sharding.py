"""Uniform shuffle into shards of exact size: a hypergeometric communication matrix between two local permutations."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut_lineage, table  # noqa: F401

SHARDS = 40
SEED = 20_240_601
#: Rows that one task permutes, and the most parts of the first permutation, which bounds the matrix.
PART_ROWS, MOST_PARTS = 20_000, 1024


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Exact number of good ones among ``draws`` without replacement: inversion outwards from the mode, for counts of any size."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    lg = math.lgamma
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    log_p = lg(good + 1) - lg(mode + 1) - lg(good - mode + 1) + lg(bad + 1) - lg(draws - mode + 1) - lg(bad - draws + mode + 1)
    log_p -= lg(good + bad + 1) - lg(draws + 1) - lg(good + bad - draws + 1)
    up = down = mode
    p_up = p_down = math.exp(log_p)
    u = rng.random() - p_up
    while u >= 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u < 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u < 0:
                return down
    return mode


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows that each part sends to each shard, drawn as in a uniform permutation: both margins are met exactly."""
    rng, left, out = random.Random(seed), list(shards), []
    for n in parts:
        rest, row = sum(left), []
        for room in left:
            rest -= room
            k = hypergeometric(rng, room, rest, n)
            row.append(k)
            n -= k
        left = [a - b for a, b in zip(left, row, strict=True)]
        out.append(row)
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _mixed(seed: int, tag: str, cols: list[Column]) -> Column:
    return F.xxhash64(F.lit(f"{seed}-{tag}"), *cols)


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` as a struct ``row`` with its ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in its shard).

    A uniform shuffle with shard sizes at most one apart. Rows are dealt to parts by hash and counted; the numbers
    that go from each part to each shard are drawn exactly; a part permutes its rows and cuts them by its row of the
    matrix; after the exchange each shard permutes again in pieces, whose sizes give the slots their offsets. Only the
    counts of the parts (at most MOST_PARTS numbers) reach the driver. Reruns agree: rows are ordered by seeded
    hashes of all their columns. Rows equal in every column are interchangeable, and NULLs are values like others. An
    empty table gives an empty result; with fewer rows than shards some shards stay empty.
    """
    hashable = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    key = F.xxhash64(*hashable)
    n = docs.count()
    n_parts = min(MOST_PARTS, max(1, math.ceil(n / PART_ROWS)))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    first, second = _mixed(seed, "first", [F.col("key")]), _mixed(seed, "second", [F.col("key")])
    part = F.pmod(_mixed(seed, "part", [F.col("key")]), F.lit(n_parts)).cast("int")
    counted = {r["p"]: r["n"] for r in docs.select(key.alias("key")).groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    counts = [counted.get(p, 0) for p in range(n_parts)]
    matrix = communication_matrix(counts, shard_sizes(n, shards), seed)
    ends = [[sum(row[: s + 1]) for s in range(shards)] for row in matrix]
    bounds = F.element_at(F.from_json(F.lit(json.dumps(ends)), "array<array<bigint>>"), F.col("p") + 1)
    ties = [F.col(f"row.`{c}`") for c in hashable]
    placed = (
        keyed.withColumn("p", part)
        .withColumn("j", F.row_number().over(Window.partitionBy("p").orderBy(first, *ties)) - 1)
        .withColumn("shard", F.size(F.filter(bounds, lambda e: e <= F.col("j"))).cast("int"))
        .select("row", "key", "shard")
    )
    pieces = max(1, math.ceil(n / shards / PART_ROWS))
    cut = placed.withColumn("piece", F.pmod(second, F.lit(pieces)).cast("int"))
    local = F.row_number().over(Window.partitionBy("shard", "piece").orderBy(_mixed(seed, "third", [F.col("key")]), *ties)) - 1
    if pieces == 1:
        return cut.select("row", "shard", local.cast("long").alias("slot"))
    per = cut.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    off = per.select("shard", "piece", (F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")).alias("off"))
    return cut.withColumn("local", local).join(off, ["shard", "piece"]).select("row", "shard", (F.col("off") + F.col("local")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Writes the documents as one folder per shard, each file in slot order."""
    out = assign_shards(docs, shards, seed).repartition("shard").sortWithinPartitions("shard", "slot")
    out.select("row.*", "shard").write.partitionBy("shard").parquet(path)


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, folder, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assign_shards(docs)
    return out.select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
