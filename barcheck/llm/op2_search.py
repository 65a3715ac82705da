"""Exact top-k search: BM25 over a sharded inverted index with block maxima, pruned by upper bounds, merged by global statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import WORD, cut_lineage, table, words_of
from .op4_minmax import WordHashes

K, K1, B = 10, 1.2, 0.75
#: A shard holds at most so many documents and about so many postings; a block of a shard, so many documents.
SHARD_DOCS, SHARD_POSTINGS, BLOCK = 16_384, 5_000_000, 64
#: Terms in at least one of DENSE documents of a shard are kept as rows of a matrix instead of lists.
DENSE = 16
#: Query terms that are broadcast at a time (6 bytes each, and 16 for each distinct one), queries scored against a matrix at a
#: time, and the number of shards that are searched first; every later phase takes in GROW times as many.
QUERY_TERMS, QUERY_ROWS, FIRST, GROW, LEVELS = 2_000_000, 256, 4, 4, 10
#: Other terms in at least one of LISTED documents of a shard are gathered for each query, rarer ones for all queries of a part.
#: Postings that are gathered at a time, and documents that are scored exactly at a time.
LISTED, POSTS, ROWS = 128, 100_000, 1024
#: Bounds are scores rounded to nine digits, upper bounds of blocks are not; a block is skipped only below this slack.
SLACK = 1e-8

_INDEX = "shard long, n_docs long, n_words long, doc_ids binary, lengths binary, terms array<long>, dfs array<int>, docs binary, tfs binary"


def build_index(docs: DataFrame) -> DataFrame:
    """One row per shard: its documents, and for each term (64-bit hash of a word) its document count and postings.

    Every row is indexed where it is read, so texts are never shuffled. Documents of a shard are put in an order by their
    most frequent common word and length, which makes the maxima of a block tight.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, words, size = WordHashes(), [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = words_of(t.as_py())
                ids.append(i)
                words.append(np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)).view(np.int64))
                size += len(w)
                if len(ids) >= SHARD_DOCS or size >= SHARD_POSTINGS:
                    yield _shard(ids, words)
                    ids, words, size = [], [], 0
        if ids:
            yield _shard(ids, words)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _INDEX)


def _shard(ids: list[int | None], words: list[np.ndarray]) -> pa.RecordBatch:
    """The row of a shard; takes the words away, as all arrays of one length of the texts count."""
    lengths, flat = np.fromiter(map(len, words), np.int64, len(words)), np.concatenate(words)
    words.clear()
    n_words = len(flat)
    terms, term = np.unique(flat, return_inverse=True)
    del flat
    term, doc = term.astype(np.int32), np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
    if len(terms):
        common = np.argsort(-np.bincount(term), kind="stable")[:32]
        kind = np.full(len(ids), len(common))
        for rank in range(len(common) - 1, -1, -1):
            kind[doc[term == common[rank]]] = rank
        order = np.lexsort((lengths, kind))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        doc, lengths, ids = place[doc], lengths[order], [ids[i] for i in order]
    pair = term * np.int64(len(ids))
    pair += doc
    del term, doc
    pair, tf = np.unique(pair, return_counts=True)
    df = np.bincount(pair // len(ids), minlength=len(terms))
    named = np.array([np.iinfo(np.int64).min if i is None else i for i in ids], np.int64)
    cells = [
        pa.array([int(named.min()) ^ n_words], pa.int64()),
        pa.array([len(ids)], pa.int64()),
        pa.array([n_words], pa.int64()),
        pa.array([named.tobytes()], pa.binary()),
        pa.array([lengths.astype(np.int32).tobytes()], pa.binary()),
        pa.array([terms], pa.list_(pa.int64())),
        pa.array([df.astype(np.int32)], pa.list_(pa.int32())),
        pa.array([(pair % len(ids)).astype(np.uint16).tobytes()], pa.binary()),
        pa.array([tf.astype(np.uint32).tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(cells, [x.split()[0] for x in _INDEX.split(", ")])


@dataclass
class Block:
    """A bounded part of the queries, QUERY_ROWS of them at a time: distinct terms in order with their weights; of each part its
    first and last pair, and as pairs in the order of terms the place of the term and the number of the query in its part."""

    ids: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    parts: np.ndarray
    places: np.ndarray
    owners: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray, weights: np.ndarray) -> Block:
        """From the terms and weights of the queries, one query after the other; the bounds are 0."""
        terms, first, places = np.unique(flat, return_index=True, return_inverse=True)
        owner = np.repeat(np.arange(len(ids)), sizes)
        order = np.lexsort((places, owner // QUERY_ROWS))
        parts = np.searchsorted(owner, np.arange(0, len(ids) + QUERY_ROWS, QUERY_ROWS))
        return cls(ids, terms, weights[first], parts, places[order].astype(np.int32), (owner[order] % QUERY_ROWS).astype(np.int16), np.zeros(len(ids)))


class Shard:
    """A shard in memory for one block of queries: what each posting of a known term adds to a score under the global
    statistics, a matrix of those of frequent terms, its block maxima."""

    def __init__(self, row: dict, mean: float, q: Block):
        self.q, self.rooms = q, {}
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.named = self.ids != np.iinfo(np.int64).min
        self.n_blocks = -(-len(self.ids) // BLOCK)
        terms, df = np.asarray(row["terms"], np.int64), np.asarray(row["dfs"], np.int64)
        found = np.searchsorted(q.terms, terms)
        found[found == len(q.terms)] = 0
        known = q.terms[found] == terms
        often = known & (df * DENSE >= len(self.ids))
        rare = known & ~often
        doc = np.frombuffer(row["docs"], np.uint16)
        tf = np.frombuffer(row["tfs"], np.uint32).astype(np.float64)
        slow = K1 * (1 - B + B * np.frombuffer(row["lengths"], np.int32) / mean)
        impact = tf * (K1 + 1) / (tf + slow[doc]) * np.repeat(np.where(known, q.weights[found], 0.0), df)
        at, n = np.repeat(often, df), int(often.sum())
        self.matrix = np.zeros((len(self.ids), n))
        #: The same in single precision by blocks, for upper bounds.
        self.single = np.zeros((n, self.n_blocks * BLOCK), np.float32)
        line = np.repeat(np.arange(n), df[often])
        self.matrix[doc[at], line] = self.single[line, doc[at]] = impact[at]
        self.single = self.single.reshape(n, self.n_blocks, BLOCK)
        self.highest = self.single.max(axis=2)
        #: Postings of the other terms, one term after the other, those of the more frequent ones close together.
        groups = [rare & (df * LISTED >= len(self.ids)), rare & (df * LISTED < len(self.ids))]
        at = [np.repeat(g, df) for g in groups]
        self.doc = np.concatenate([doc[x] for x in at]).astype(np.int64)
        self.impact = np.concatenate([impact[x] for x in at])
        self.df = np.concatenate([df[g] for g in groups])
        self.start = np.cumsum(self.df) - self.df
        self.n_listed = int(groups[0].sum())
        #: Of each query term the row of the matrix, or behind these the number among the other terms, -1 if it is not here.
        self.local = np.full(len(q.terms), -1, np.int32)
        for numbered, low in ((often, 0), (groups[0], n), (groups[1], n + self.n_listed)):
            self.local[found[numbered]] = np.arange(low, low + int(numbered.sum()))

    def search(self, k: int) -> tuple[list[int], list[int], list[float]]:
        """(query, document, score) of each query's best k documents here, as far as they reach its bound, which they raise."""
        q = self.q
        queries, docs, scores = [], [], []
        for lo, a, b in zip(range(0, len(q.ids), QUERY_ROWS), q.parts, q.parts[1:]):
            for i, rows, values in self._best(self.local[q.places[a:b]], q.owners[a:b], q.bounds[lo : lo + QUERY_ROWS], k):
                queries += [int(q.ids[lo + i])] * len(rows)
                docs += self.ids[rows].tolist()
                scores += values.tolist()
                if len(rows) == k:
                    q.bounds[lo + i] = max(q.bounds[lo + i], values[-1])
        return queries, docs, scores

    def _best(self, term: np.ndarray, owner: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        n, n_often = len(bounds), len(self.single)
        often, others = (term >= 0) & (term < n_often), term >= n_often
        asked = np.zeros((n, n_often), np.float32)
        asked[owner[often], term[often]] = 1
        rare = self._rare(term[others] - n_often, owner[others], n)
        blocks = rare.reshape(n, self.n_blocks, BLOCK)
        use = np.flatnonzero(asked.any(axis=0))
        single = asked[:, use]
        #: No term takes from a score, so what single precision loses is a share of it, less than ``lost``.
        lost = (len(use) + 64) * 2.0**-23
        least = (bounds - SLACK) * (1 - lost)
        #: Blocks that no query of these can use are left out: frequent terms by their maxima, all others as they are.
        live = np.flatnonzero((blocks.max(axis=2) + single @ self.highest[use] >= least[:, None]).any(axis=0))
        if not len(live):
            return
        total = self._room("total", n * len(live) * BLOCK, np.float64).reshape(n, len(live), BLOCK)
        blocks.take(live, axis=1, mode="clip", out=total)
        total = total.reshape(n, -1)
        total += single @ self.single[np.ix_(use, live)].reshape(len(use), total.shape[1])
        place = (live[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        least = np.maximum(least, 1e-12)
        for i in np.flatnonzero(total.max(axis=1) >= least):
            some = np.flatnonzero(total[i] >= least[i])
            some = some[self.named[place[some]]]
            if len(some) > k:
                last = len(some) - k
                some = some[total[i, some] >= (np.partition(total[i, some], last)[last] - SLACK) * (1 - 2 * lost)]
            rows, mine = place[some], np.flatnonzero(asked[i])
            s = np.concatenate([self.matrix[np.ix_(r, mine)].sum(axis=1) for r in np.split(rows, range(ROWS, len(rows), ROWS))])
            s = np.round(s + rare[i, rows], 9)
            good = (s >= bounds[i]) & (s > 0)
            rows, s = rows[good], s[good]
            best = np.lexsort((self.ids[rows], -s))[:k]
            if len(best):
                yield int(i), rows[best], s[best]

    def _rare(self, term: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """What the terms outside the matrix add to each document, for each of n queries."""
        width = self.n_blocks * BLOCK
        out = self._room("rare", n * width, np.float64).reshape(n, width)
        listed = np.flatnonzero(term < self.n_listed)
        listed = listed[np.argsort(owner[listed], kind="stable")]
        mine, size = term[listed], self.df[term[listed]]
        first = np.searchsorted(owner[listed], np.arange(n + 1))
        upto = np.r_[0, np.cumsum(size)][first]
        cuts = [0, *(np.flatnonzero(np.diff(upto[:-1] // POSTS)) + 1).tolist(), n]
        for lo, hi in zip(cuts, cuts[1:]):
            part = slice(first[lo], first[hi])
            doc, impact = self._posts(mine[part], size[part])
            ends = (upto[lo : hi + 1] - upto[lo]).tolist()
            for i, a, b in zip(range(lo, hi), ends, ends[1:]):
                out[i] = np.bincount(doc[a:b], impact[a:b], width)
        #: The rest are many short lists: in the order of terms, as reading them at random costs more than adding them at random.
        others = np.flatnonzero(term >= self.n_listed)
        mine, size = term[others], self.df[term[others]]
        row = owner[others].astype(np.int64) * width
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // POSTS)) + 1).tolist(), len(mine)]
        for lo, hi in zip(cuts, cuts[1:]):
            doc, impact = self._posts(mine[lo:hi], size[lo:hi])
            doc += np.repeat(row[lo:hi], size[lo:hi])
            np.add.at(out.reshape(-1), doc, impact)
        return out

    def _posts(self, term: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of the terms' postings, one term after the other."""
        m = int(size.sum())
        runs = _runs(self.start[term], size, self._room("runs", m, np.int64))
        return self.doc.take(runs, mode="clip", out=self._room("doc", m, np.int64)), self.impact.take(runs, mode="clip", out=self._room("impact", m, np.float64))

    def _room(self, name: str, n: int, kind: type) -> np.ndarray:
        """An array that is used again, as fresh memory costs time."""
        if name not in self.rooms or len(self.rooms[name]) < n:
            self.rooms[name] = np.empty(n + n // 4, kind)
        return self.rooms[name][:n]


def _runs(start: np.ndarray, size: np.ndarray, out: np.ndarray) -> np.ndarray:
    """All numbers of the runs, one after the other; no run is empty."""
    out[:] = 1
    if len(out):
        ends = np.cumsum(size)
        out[0] = start[0]
        out[ends[:-1]] = start[1:] - (start[:-1] + size[:-1] - 1)
    return np.cumsum(out, out=out)


def _searched(index: DataFrame, shared: Broadcast, mean: float, k: int) -> DataFrame:
    """query_id, doc_id, score: what the shards find for the broadcast block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        #: What one shard finds bounds the search of the next one in the same task.
        asked = replace(shared.value, bounds=shared.value.bounds.copy())
        for b in batches:
            for i in range(b.num_rows):
                row = {n: (b.column(n)[i].values.to_numpy() if n in ("terms", "dfs") else b.column(n)[i].as_py()) for n in ("doc_ids", "lengths", "terms", "dfs", "docs", "tfs")}
                q, d, s = Shard(row, mean, asked).search(k)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.float64())], ["query_id", "doc_id", "score"])

    return index.drop("level").mapInArrow(run, "query_id long, doc_id long, score double")


def _phases(shards: dict[int, int]) -> list[int]:
    """Lowest level of each part of the shards that are searched one after the other, from the number of shards of each level."""
    first, n = max(shards, default=0), 0
    for level in range(first, -1, -1):
        n += shards.get(level, 0)
        if n >= FIRST:
            return list(range(level, -1, -1))
    return [0]


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block(packed: DataFrame) -> Block | None:
    """The queries of a block, those that share their most frequent terms beside one another."""
    t = packed.orderBy(F.slice("t", 1, 3), F.size("t"), "query_id").select("query_id", F.col("t.term").alias("term"), F.col("t.w").alias("w")).toArrow()
    if not t.num_rows:
        return None
    ids, sizes = t["query_id"].to_numpy(), np.concatenate([c.value_lengths().to_numpy() for c in t["term"].chunks]).astype(np.int64)
    flat, weights = (t[c].combine_chunks().flatten().to_numpy() for c in ("term", "w"))
    return Block.of(ids, sizes, flat, weights)


def search(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, doc_id, rank, score: for each row of ``queries`` (doc_id, text) the k best rows of ``docs`` (doc_id, text).

    A query is the set of words of its whole text; the score is BM25 under the statistics of all documents; equal
    scores (to nine digits) are ordered by doc_id. The queries are taken in blocks of a bounded number of terms, the only
    thing that is broadcast. A few shards give each query a lower bound of its k-th score, with which the next, larger
    part of the shards skips the blocks of documents that cannot reach it, and so on; a query then sends about k * GROW
    rows per phase, however many shards there are. The result is exact.

    NULL and empty texts match nothing, as documents and as queries. Rows without a doc_id count in the statistics but
    cannot be named, so they are not returned; queries without one are left out. Repeated documents are results of
    their own, repeated queries count once. Other columns are not read. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    index = build_index(docs)
    #: One of GROW shards is of level 1 or above, one of them again of level 2 or above, and so on.
    level = sum((F.pmod(F.xxhash64("shard"), F.lit(GROW**i)) == 0).cast("int") for i in range(1, LEVELS + 1))
    index = cut_lineage(index.withColumn("level", level), "level")
    total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("w")).first()
    mean = max(1.0, total["w"] / max(1, total["n"]))
    asked = cut_lineage(_terms(queries))
    wanted = asked.select("term").distinct()
    df = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df")).join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.log(1 + (F.lit(total["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    blocks = max(1, math.ceil(asked.count() / QUERY_TERMS))
    known = asked.join(df, "term").select("query_id", "term", weight.alias("w"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    packed = cut_lineage(known.groupBy("block", "query_id").agg(F.sort_array(F.collect_list(F.struct("w", "term"))).alias("t")))
    lows = _phases({r["level"]: r["count"] for r in index.groupBy("level").count().collect()})
    out = None
    for b in range(blocks):
        #: At most about QUERY_TERMS terms, whatever the number of queries.
        block = _block(packed.where(F.col("block") == b))
        if block is None:
            continue
        best = None
        for low, below in zip(lows, [LEVELS + 1, *lows]):
            shared = spark.sparkContext.broadcast(block)
            found = _searched(index.where((F.col("level") >= low) & (F.col("level") < below)), shared, mean, k)
            best = cut_lineage(_top(found if best is None else found.union(best.drop("rank")), k))
            shared.destroy()
            if low:
                #: One number for each query of the block.
                bound = {r["query_id"]: r["s"] for r in best.where(F.col("rank") == k).select("query_id", F.col("score").alias("s")).collect()}
                block.bounds = np.array([bound.get(i, 0.0) for i in block.ids.tolist()])
        out = best if out is None else out.union(best)
    if out is None:
        return spark.createDataFrame([], "query_id long, doc_id long, rank int, score double")
    return out.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def _terms(queries: DataFrame) -> DataFrame:
    """query_id, term: the distinct terms of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = np.unique(np.fromiter((hashes[x] for x in words_of(t.as_py())), np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), i), pa.int64()), pa.array(w)], ["query_id", "term"])

    return queries.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "query_id long, term long").distinct()


def op2_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return search(docs, docs.where(F.col("doc_id") % 100 == 0))


ORACLE = rf"""
WITH w AS (
  SELECT doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '{WORD}'),
         lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS t FROM documents),
p AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY ALL),
l AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
g AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM w) / (SELECT count(*) FROM documents) AS mean),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
s AS (
  SELECT q.doc_id AS query_id, p.doc_id, round(sum(ln(1 + (g.n - df + 0.5) / (df + 0.5)) * p.tf * {K1 + 1} / (p.tf + {K1} * ({1 - B} + {B} * l.n / g.mean))), 9) AS score
  FROM p q JOIN p USING (t) JOIN f USING (t) JOIN l ON l.doc_id = p.doc_id, g WHERE q.doc_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= {K}"""
