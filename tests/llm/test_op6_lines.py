import random
from collections import Counter

import numpy as np
import pytest

from barcheck.llm import op6_lines as op
from barcheck.llm.perfect_hash import CountIndex, PerfectHash
from pyspark.sql import functions as F


def brute(rows, min_docs, min_chars):
    key = lambda x: x.encode().strip().lower().decode()
    df = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and df[key(x)] >= min_docs)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("chunk", "shard", "chars"), [(256, 400_000, 1), (3, 20, 4)])
def test_equals_brute_force(make, edges, monkeypatch, chunk, shard, chars):
    monkeypatch.setattr(op, "CHUNK_DOCS", chunk)
    monkeypatch.setattr(op, "SHARD_LINES", shard)
    rng = random.Random(2)
    lines = [f"Line {i} é" for i in range(40)] + ["", "  ", "x", "LINE 1 é ", "É"]
    rows = edges + [(i + 50, "\n".join(rng.choices(lines, k=rng.randint(0, 9)))) for i in range(60)]
    got = op.dedup_lines(make(rows), min_docs=10, min_chars=chars).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 10, chars)


def test_columns_stay_and_empty_table(make):
    docs = make([(1, "a")]).withColumnRenamed("lang", "n_lines")
    assert op.dedup_lines(docs).columns == ["doc_id", "text", "source", "n_chars", "n_lines", "n_dropped"]
    assert op.dedup_lines(make([])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
    assert sorted(PerfectHash(h1, h2).slots(h1, h2).tolist()) == list(range(n))
    counts = rng.integers(1, 100, n)
    index = CountIndex.from_bytes(CountIndex(h1, h2, counts).to_bytes())
    assert (index.count(h1, h2) == counts).all()
    other = rng.integers(0, 1 << 63, (2, 1000), dtype=np.uint64)
    assert index.count(*other).sum() == 0


def test_keys_that_no_level_separates_are_kept_in_full(monkeypatch):
    from barcheck.llm import perfect_hash

    monkeypatch.setattr(perfect_hash, "LEVELS", 1)
    h = np.arange(1, 200, dtype=np.uint64)
    assert sorted(PerfectHash(h, h).slots(h, h).tolist()) == list(range(199))


def test_a_column_named_like_the_chunk_stays(spark, make):
    got = op.dedup_lines(make([(1, "a\nb"), (2, None)]).withColumn("_chunk", F.lit("mine")))
    assert [r._chunk for r in got.collect()] == ["mine", "mine"] and "_chunk" in got.columns
