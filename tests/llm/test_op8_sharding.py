import random
from collections import Counter

import pytest

from barcheck.llm import op8_sharding as op


def test_matrix_meets_both_margins():
    parts, shards = [7, 0, 30, 13], op.shard_sizes(50, 4)
    m = op.communication_matrix(parts, shards, 1)
    assert [sum(r) for r in m] == parts
    assert [sum(c) for c in zip(*m, strict=True)] == shards


def test_draws_are_hypergeometric():
    rng, good, bad, n = random.Random(3), 6, 9, 5
    seen = Counter(op.hypergeometric(rng, good, bad, n) for _ in range(20_000))
    from math import comb

    for k in range(6):
        p = comb(good, k) * comb(bad, n - k) / comb(good + bad, n)
        assert abs(seen[k] / 20_000 - p) < 0.015
    assert 0 < op.hypergeometric(rng, 4 * 10**9, 10**11, 10**6) < 10**6


@pytest.mark.parametrize(("n", "part"), [(0, 20_000), (5, 20_000), (333, 20_000), (333, 20)])
def test_sizes_slots_and_reruns(make, monkeypatch, n, part):
    monkeypatch.setattr(op, "PART_ROWS", part)
    docs = make([(i if i % 50 else None, f"text {i % 7}") for i in range(n)])
    rows = op.assign_shards(docs, 6).select("row.doc_id", "row.text", "shard", "slot").collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == n
    assert sorted(len(slots.get(s, [])) for s in range(6)) == sorted(op.shard_sizes(n, 6))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    again = op.assign_shards(docs.repartition(5), 6).select("row.doc_id", "row.text", "shard", "slot").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_every_row_may_go_to_every_shard(make):
    docs = make([(i, "t") for i in range(12)])
    where = Counter(r.shard for seed in range(40) for r in op.assign_shards(docs, 3, seed).where("row.doc_id = 5").collect())
    assert all(4 <= where[s] <= 24 for s in range(3))


def test_clashing_columns(make):
    docs = make([(1, None)]).withColumnRenamed("lang", "shard")
    assert op.assign_shards(docs, 2).select("row.*").columns == docs.columns
