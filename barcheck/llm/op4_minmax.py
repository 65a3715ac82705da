"""Near-duplicate documents by min-max hashing: banded candidates, links confirmed on full shingle sets, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut_lineage, free_name, table, words_of
from .components import components

WORDS, SHARE = 5, (75, 100)
#: 64 permutations give 128 values, a minimum and a maximum each: 32 bands of 4. Sets with a similarity of 0.75 share no
#: band with probability (1 - 0.75**4)**32 = 5e-6.
PERMS, ROWS = 64, 4
#: Of the 128 values at least so many agree before full sets are fetched: at 0.75 fewer do with probability 3e-7.
AGREE = 71
#: Nodes of one block of a bucket, and columns of its membership matrix at a time.
BLOCK, COLUMNS = 512, 4096

_rng = np.random.default_rng(20_240_602)
_A = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2)
_P, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of words; remembers a bounded number of them."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = h
        return h


def shingles(words: list[bytes], hashes: WordHashes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; a shorter sequence is one shingle, no words are none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(n, k)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _P + w[i : n - k + 1 + i]
    return np.unique(_mix(h))


def min_max(x: np.ndarray) -> np.ndarray:
    """Minima and maxima of the set under all permutations; one evaluation serves both."""
    lo, hi = np.full(PERMS, np.iinfo(np.uint64).max, np.uint64), np.zeros(PERMS, np.uint64)
    for i in range(0, len(x), 2048):
        h = (x[None, i : i + 2048] ^ _B[:, None]) * _A[:, None]
        lo, hi = np.minimum(lo, h.min(axis=1)), np.maximum(hi, h.max(axis=1))
    return np.concatenate([lo, hi])


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of ROWS minima or ROWS maxima."""
    v = values.reshape(-1, ROWS)
    h = np.arange(1, len(v) + 1, dtype=np.uint64)
    for i in range(ROWS):
        h = _mix(h * _P + v[:, i])
    return h.view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (64-bit hash of the set, NULL for none), bands, sketch (a byte per value)."""
    schema = "doc_id long, text_hash long, n_shingles long, node long, bands array<long>, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            n, node, bands, sketch = [], [], [], []
            for t in b.column(2):
                x = shingles(words_of(t.as_py()), hashes, k)
                n.append(len(x))
                values = min_max(x) if len(x) else None
                node.append(np.int64(np.uint64(xxhash.xxh3_64_intdigest(x)).view(np.int64)) if len(x) else None)
                bands.append(band_keys(values) if len(x) else None)
                sketch.append((_mix(values) >> np.uint64(56)).astype(np.uint8).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "node", "bands", "sketch"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def _agreeing(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches agree in at least AGREE values."""
    both = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sa, sb = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, 2 * PERMS) for c in (x.column(2), x.column(3)))
            keep = pa.array((sa == sb).sum(axis=1) >= AGREE)
            yield x.select(["a", "b"]).filter(keep)

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _full_sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, shingles (sorted hashes) for ``nodes``, from the whole text of one document of each."""
    one = rows.join(nodes, "node").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("r")).select("node", F.col("r.doc_id").alias("id"), F.col("r.text_hash").alias("h"))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = keyed.join(one, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("h"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingles(words_of(t.as_py()), hashes, k).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) with share[1] * intersection >= share[0] * union of their full sets."""
    sa, sb = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = pairs.join(sb, "b").join(sa, "a").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for s, t in zip(x.column(2), x.column(3), strict=True):
                u, v = (np.asarray(y.values) for y in (s, t))
                common = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(share[1] * common >= share[0] * (len(u) + len(v) - common))
            yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _reachable(open_: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Rows (key, node, root, n) whose node can still have a link to another component, with ``r``.

    ``r`` is the number of a node's shingles that nodes of other components have. A link to a node of size m needs a
    common part of at least share * (n + m), so a row stays only if ``r`` allows that for the smallest m that its bucket
    offers. This is exact, and it is what keeps a large group of loose copies from being paired: what sets its
    members apart are shingles that nobody else has.
    """
    top, whole = share[0], share[0] + share[1]
    nodes = open_.select("node", "root").distinct()
    each = nodes.join(sets, "node").select("node", "root", F.explode("shingles").alias("x"))
    common = each.groupBy("x").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("x")
    r = each.join(common, "x").groupBy("node").agg(F.count("*").alias("r"))
    least = open_.groupBy("key").agg(F.min("n").alias("least"))
    fit = open_.join(r, "node").join(least, "key")
    other = F.greatest(F.col("least"), F.ceil(F.col("n") * top / share[1]))
    return fit.where(whole * F.col("r") >= top * (F.col("n") + other)).drop("least")


def _within_buckets(left: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Confirmed links (a, b) between nodes of one bucket and different roots; only links leave a task, never pairs.

    A bucket is cut in blocks of about BLOCK nodes by hash, and every two blocks meet in one task with their full sets,
    so a task's memory is bounded however large a bucket is.
    """
    blocks = left.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cut = left.join(blocks, "key").withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = cut.select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "node", "root")

    def run(t: pa.Table) -> pa.Table:
        node, root = t["node"].to_numpy(), t["root"].to_numpy()
        lists = t["shingles"].combine_chunks()
        flat, sizes = np.asarray(lists.flatten()), np.diff(np.asarray(lists.offsets))
        row = np.repeat(np.arange(len(node)), sizes)
        _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
        many = count[col] > 1
        row, col = row[many], (np.cumsum(count > 1) - 1)[col[many]]
        common = np.zeros((len(node), len(node)), np.float32)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for c in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
            lo, hi = np.searchsorted(col, [c, c + COLUMNS])
            x = np.zeros((len(node), COLUMNS), np.float32)
            x[row[lo:hi], col[lo:hi] - c] = 1
            common += x @ x.T
        ok = share[1] * common >= share[0] * (sizes[:, None] + sizes[None, :] - common)
        a, b = np.nonzero(ok & (root[:, None] != root[None, :]) & (node[:, None] < node[None, :]))
        return pa.table({"a": pa.array(node[a], pa.int64()), "b": pa.array(node[b], pa.int64())})

    return rows.join(sets, "node").groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component."""
    keys = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    return placed.join(keys, "key")


def near_duplicates(docs: DataFrame, k: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every row of ``docs`` (doc_id long, text).

    Documents with equal shingle sets form one node. In every band bucket all nodes are held against one of them; the
    confirmed links are contracted to components. Then the pairs of a bucket that lie in different components and can
    still be linked, by size and by the number of shingles that they share with anyone, are held against each other. No
    link between two components is lost and members of one component are never paired. ``component_id`` is the
    smallest doc_id reachable, ``kept`` marks the row that has it.

    NULL and empty texts and texts without words have no shingles, are linked with nothing and kept. Repeated rows
    are one node; repeats of the smallest doc_id are all marked kept. A NULL doc_id is never a component_id while
    another one is there. Other columns are not read. An empty table gives an empty result. Nodes are 64-bit hashes of
    sets: two different sets meet with probability n**2 / 2**65.
    """
    sig = cut_lineage(signatures(docs, k))
    rows = sig.select("doc_id", "text_hash", "n_shingles", "node")
    nodes = cut_lineage(sig.where("node IS NOT NULL").groupBy("node").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.min("n_shingles").alias("n")))
    keys = nodes.select(F.explode("bands").alias("key"), "node", "n")
    buckets = keys.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("key", "lead")
    shared = cut_lineage(keys.join(buckets, "key"))
    sets = cut_lineage(_full_sets(docs, rows, shared.select("node").distinct(), k))
    sketches = nodes.select("node", "sketch")

    top, whole = share[0], share[0] + share[1]
    sized = shared.groupBy("node").agg(F.min("n").alias("n"))
    star = shared.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"), F.col("n").alias("nb")).distinct()
    star = star.join(sized.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").where(share[1] * F.least("na", "nb") >= top * F.greatest("na", "nb"))
    able = (share[1] * F.least("n", "nb") >= top * F.greatest("n", "nb")) & (whole * F.least("r", "r2") >= top * (F.col("n") + F.col("nb")))
    tried = cut_lineage(star.select("a", "b"))
    links = cut_lineage(_confirmed(_agreeing(tried, sketches), sets, share))
    root = F.coalesce("root", "node")
    roots = components(links)
    while True:
        placed = cut_lineage(_mixed(shared.drop("lead").join(roots, "node", "left").select("key", "node", "n", root.alias("root"))))
        left = cut_lineage(_mixed(_reachable(placed, sets, share)))
        heart = left.groupBy("key").agg(F.max_by(F.struct("node", "root", "n", "r"), F.struct("r", "node")).alias("h"))
        star = left.join(heart.select("key", F.col("h.node").alias("b"), F.col("h.root").alias("rb"), F.col("h.n").alias("nb"), F.col("h.r").alias("r2")), "key")
        new = cut_lineage(star.where((F.col("root") != F.col("rb")) & able).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
        found = cut_lineage(_confirmed(_agreeing(new, sketches), sets, share))
        tried, links = tried.union(new), links.union(found)
        if not found.limit(1).count():
            break
        roots = components(links)

    roots = components(links.union(_within_buckets(left, sets, share)))

    reps = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep")).join(roots, "node", "left").select("node", "rep", root.alias("root"))
    smallest = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    final = reps.join(smallest, "root").select("node", "component_id")
    out = rows.join(final, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_per_component(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, in all their columns, whatever the columns' names.

    Of repeated rows (same doc_id and text) one stays. Documents without words, NULL texts among them, are components of
    their own and stay; a NULL doc_id equals itself. An empty table gives an empty result.
    """
    hash_, id_, other = (free_name(docs, c) for c in ("_text_hash", "_kept_id", "_kept_hash"))
    keep = near_duplicates(docs).where("kept").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(other)).distinct()
    keyed = docs.withColumn(hash_, F.xxhash64("text"))
    kept = keyed.join(keep, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(other)))
    return kept.dropDuplicates(["doc_id", hash_]).select(*docs.columns)


def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


#: All pairs that share a shingle, for comparison at test sizes.
ORACLE = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'),
         lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {WORDS} THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i:i + {WORDS - 1}], ' ')) END)) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {SHARE[1]} * c >= {SHARE[0]} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d WHERE r.c < e.b)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id, min(r.c) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.d = w.doc_id GROUP BY w.doc_id, n.n"""
