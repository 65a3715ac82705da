"""Line deduplication: a sharded minimal perfect hash gives each distinct line the slot of its document count."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import cut_lineage, free_name, table
from .perfect_hash import CountIndex

MIN_DOCS, MIN_CHARS = 10, 1
#: Lines behind one shard of the index, and documents in one chunk; both bound what a task holds.
SHARD_LINES, CHUNK_DOCS = 400_000, 256


def line_key(line: bytes) -> bytes:
    """The line without blanks at both ends, A-Z lower-cased; ``bytes`` methods know ASCII only, as wanted."""
    return line.strip().lower()


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def _hash(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line_key(line))


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return x[:, 0], x[:, 1]


def line_hashes(docs: DataFrame, chunk: str, text: str, min_chars: int) -> DataFrame:
    """chunk, h1, h2, n: distinct lines of each document, summed per chunk within a batch before they leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[int, bytes], int] = {}
            for c, t in zip(b.column(0).to_pylist(), b.column(1)):
                for d in {_hash(x) for x in _lines(t.as_py()) if _long_enough(x, min_chars)}:
                    seen[c, d] = seen.get((c, d), 0) + 1
            h1, h2 = _halves([d for _, d in seen])
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in seen], pa.int64()), pa.array(h1), pa.array(h2), pa.array(list(seen.values()), pa.int64())], ["chunk", "h1", "h2", "n"])

    return docs.select(chunk, text).mapInArrow(run, "chunk long, h1 long, h2 long, n long")


def _long_enough(line: bytes, min_chars: int) -> bool:
    key = line_key(line)
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def build_index(lines: DataFrame, shards: int) -> DataFrame:
    """shard, n_keys, index: per shard the perfect hash of its distinct lines with fingerprint and count arrays.

    Counts are summed before and after the shuffle, so a line in a third of all documents costs one row per task.
    """

    def build(key: tuple, t: pa.Table) -> pa.Table:
        h1, h2 = (t[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        blob = CountIndex(h1, h2, t["n"].to_numpy()).to_bytes()
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n_keys": pa.array([len(h1)], pa.int64()), "index": pa.array([blob], pa.binary())})

    counted = lines.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    return counted.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, "shard int, n_keys long, index binary")


def _shard(shards: int):
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int")


def frequent(lines: DataFrame, index: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """chunk, h1, h2 of the lines that the arrays count in at least ``min_docs`` documents.

    A chunk asks for each of its distinct lines once, whatever the number of its documents that hold it.
    """

    def probe(key: tuple, asked: pa.Table, found: pa.Table) -> pa.Table:
        keep = np.zeros(asked.num_rows, bool)
        for blob in found["index"].to_pylist():
            h1, h2 = (asked[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
            keep |= CountIndex.from_bytes(blob).count(h1, h2) >= min_docs
        return asked.select(["chunk", "h1", "h2"]).filter(pa.array(keep))

    asked = lines.select("chunk", "h1", "h2").distinct().withColumn("shard", _shard(shards))
    return asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(probe, "chunk long, h1 long, h2 long")


def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the lines that ``min_docs`` or more documents share taken out of ``text``; adds ``n_lines`` and ``n_dropped``.

    A line's key is the line without blanks at its ends, A-Z lower-cased; keys shorter than ``min_chars`` code points
    never go. Every row counts as a document, repeated rows too; a line repeated in one document counts once. NULL and
    empty texts have one empty line and come out empty. Columns named ``n_lines`` or ``n_dropped`` are replaced, all
    others are kept. An empty table gives an empty result. Very long texts are handled line by line.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    chunk = free_name(docs, "_chunk")
    chunks = max(1, math.ceil(docs.count() / CHUNK_DOCS))
    plain = [F.col(c) for c, kind in docs.select(*own).dtypes if not kind.startswith(("map", "variant"))]
    keyed = docs.select(*own).withColumn(chunk, F.pmod(F.xxhash64(*plain), F.lit(chunks)).cast("long"))
    lines = cut_lineage(line_hashes(keyed, chunk, text, min_chars))
    shards = max(1, math.ceil(lines.count() / SHARD_LINES))
    index = cut_lineage(build_index(lines, shards))
    drops = frequent(lines, index, shards, min_docs)

    def rewrite(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        bad = {a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True) for a, b in zip(found["h1"].to_pylist(), found["h2"].to_pylist(), strict=True)}
        texts, total, dropped = [], [], []
        for t in rows[text]:
            all_ = _lines(t.as_py())
            kept = [x for x in all_ if not (_long_enough(x, min_chars) and _hash(x) in bad)]
            texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
            total.append(len(all_))
            dropped.append(len(all_) - len(kept))
        out = rows.drop_columns([chunk]).set_column(own.index(text), text, pa.array(texts, pa.string()))
        return out.append_column("n_lines", pa.array(total, pa.int64())).append_column("n_dropped", pa.array(dropped, pa.int64()))

    schema = T.StructType([*docs.select(*own).schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    by_chunk = drops.withColumnRenamed("chunk", chunk).groupBy(chunk)
    return keyed.groupBy(chunk).cogroup(by_chunk).applyInArrow(rewrite, _nullable(schema, text))


def _nullable(schema: T.StructType, text: str) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType() if f.name == text else f.dataType, True) for f in schema.fields])


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_KEY = r"translate(regexp_replace(regexp_replace({x}, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT r, i, x, {_KEY.format(x='x')} AS k FROM l),
f AS (SELECT k FROM k GROUP BY k HAVING count(DISTINCT r) >= {MIN_DOCS} AND length(k) >= {MIN_CHARS}),
m AS (SELECT k.r, k.i, k.x, f.k IS NOT NULL AS bad FROM k LEFT JOIN f USING (k)),
a AS (SELECT r, count(*) AS n_lines, CAST(sum(CAST(bad AS INTEGER)) AS BIGINT) AS n_dropped,
             coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT bad), '') AS kept FROM m GROUP BY r)
SELECT d.doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM a JOIN d USING (r)"""
