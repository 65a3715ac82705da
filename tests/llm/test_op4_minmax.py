import random

import numpy as np
import pytest

from barcheck.llm import op4_minmax as op
from barcheck.llm.components import components
from pyspark.sql import functions as F


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    nodes = sorted({(sets_of(t)) for _, t in rows}, key=sorted)
    root = {s: s for s in nodes}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        s = find(sets_of(t))
        if i is not None:
            least[s] = min(i, least.get(s, i))
    return sorted(((i, len(sets_of(t)), least.get(find(sets_of(t))) if sets_of(t) else i) for i, t in rows), key=str)


def corpus(rng, groups, copies, edits, n=60):
    words = [f"v{i}" for i in range(4000)]
    rows = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.randint(n // 2, n * 2))
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, edits)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    return rows


@pytest.mark.parametrize(("groups", "copies", "edits", "block"), [(30, 4, 3, 512), (2, 90, 4, 16)])
def test_components_equal_brute_force(make, monkeypatch, groups, copies, edits, block):
    monkeypatch.setattr(op, "BLOCK", block)
    rows = corpus(random.Random(groups), groups, copies, edits)
    rng = random.Random(1)
    rng.shuffle(rows)
    got = op.near_duplicates(make(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edges(make, edges):
    got = op.near_duplicates(make(edges)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(edges)
    assert op.near_duplicates(make([])).count() == 0
    kept = op.one_per_component(make(edges)).select("doc_id").collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([1, 2, 3, 4, 5, 7, None], key=str)


def test_blocks_find_every_link(spark):
    sets = spark.createDataFrame([(i, list(range(i, i + 20))) for i in range(12)], "node long, shingles array<long>")
    left = spark.createDataFrame([(k, i, i, 20, 20) for k in (1, 2) for i in range(12)], "key long, node long, root long, n long, r long")
    got = {tuple(r) for r in op._within_buckets(left, sets, (75, 100)).collect()}
    assert got == {(a, b) for a in range(12) for b in range(a + 1, 12) if 100 * (20 - (b - a)) >= 75 * (20 + b - a)}


def test_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    assert {tuple(r) for r in components(links).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_min_max_estimates_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    same = [(op.min_max(x[:300] ^ np.uint64(s)) == op.min_max(x[100:] ^ np.uint64(s))).mean() for s in rng.integers(0, 1 << 60, 40)]
    assert abs(np.mean(same) - 0.5) < 0.03


def test_columns_named_like_the_helpers_stay(spark, make):
    docs = make([(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (None, "x y z u v w")])
    docs = docs.withColumn("_id", F.lit(7)).withColumn("_hash", F.lit("h")).withColumn("_text_hash", F.lit("mine")).withColumn("_kept_id", F.lit(0))
    got = op.one_per_component(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r._id, r._hash, r._text_hash, r._kept_id) for r in got.collect()) == [(k, 7, "h", "mine", 0) for k in ("1", "3", "None")]
