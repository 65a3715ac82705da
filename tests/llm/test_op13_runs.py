import hashlib
from zlib import crc32

import numpy as np
from hypothesis import given, settings, strategies as st

from barcheck.llm import op13_runs as op
from pyspark.sql import functions as F


def brute(words):
    """All maximal stretches per period, then only those whose smallest period it is."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        s = 0
        while s < n - q:
            e = s
            while e < n - q and words[e] == words[e + q]:
                e += 1
            w = words[s : e + q]
            if e > s and len(w) >= 4 * q and not any(all(w[i] == w[i + p] for i in range(len(w) - p)) for p in range(1, q)):
                out.append((s, e + q, q))
            s = e + 1
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 12)), max_size=6))
def test_runs_equal_brute_force(blocks):
    words = [x for b, k in blocks for x in b * k]
    assert sorted(op.find_runs(np.array(words, np.int64))) == brute(words)


def test_long_periods_and_joined_texts():
    rng = np.random.default_rng(5)
    texts = []
    for p in (1, 2, 3, 4, 5, 7, 8, 15, 16, 17, 31, 32, 63, 64, 100, 127, 128, 129):
        block = rng.integers(0, 50, p).tolist()
        tail = rng.integers(0, 50, 20).tolist()
        texts.append(tail + (block * 7)[: 4 * p + int(rng.integers(0, 3 * p))] + tail + (block * 5)[: 4 * p - 1])
    texts += [[1] * 700 + [2] + ([3] * 9 + [4]) * 40, [7] * 5, []]
    got = op.documents([" ".join(f"w{x}" for x in t) for t in texts])
    for t, runs in zip(texts, got["runs"], strict=True):
        assert [(r["start"], r["start"] + r["length"], r["period"]) for r in runs] == [r for r in brute(t) if r[1] - r[0] >= 6]


def expected(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    if doc_id is not None and n:
        h = crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(((s, e - s, q) for s, e, q in brute(words) if e - s >= 6), key=lambda r: (r[0], r[2]))
    drop = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2], sha("".join(f"{s},{n_},{q}\n" for s, n_, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_equals_brute_force(spark, tmp_path, make, edges):
    rng = np.random.default_rng(3)
    rows = edges + [(100 + i, " ".join(rng.choice(["a", "b", "ünï", "d\te"], int(rng.integers(1, 120))).tolist()) + " x y" * int(rng.integers(0, 9))) for i in range(80)]
    rows = [r for r in rows if len(r[1] or "") < 10_000]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op.op13_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t in rows), key=str)


def test_odd_tables(spark, make, edges):
    docs = make(edges).withColumn("runs", F.lit("x")).withColumn("_kept", F.lit(1))
    got = op.periodic_runs(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "_kept", "n_words", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == len(edges)
    long = next(r for r in rows if r.doc_id == 5)
    assert [tuple(r) for r in long.runs] == [(0, 30_000, 1)] and long.collapsed == "word"
    assert all(r.runs == [] and r.collapsed == "" for r in rows if r.doc_id in (1, 2, 3))
    assert op.periodic_runs(make([])).count() == 0
