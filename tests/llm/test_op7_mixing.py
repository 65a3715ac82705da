import random

import pytest

from barcheck.llm import op7_mixing as op


def water(sizes, weights, repeats):
    """Targets by resharing until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= repeats * sizes[s]}
        if not over:
            return target | share
        target |= {s: float(repeats * sizes[s]) for s in over}
        free -= over
        left = sum(sizes.values()) - sum(target.values())
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_nearness(make, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d", "e", "Ä", "z", None]
    big = rng.choice(names)
    rows = [(i, "w " * rng.randint(0, 40), big if rng.random() < 0.4 else rng.choice(names)) for i in range(400)]
    got = op.mix(make(rows)).collect()
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = water(sizes, op.WEIGHTS, op.REPEATS)
    source = {i: s for i, _, s in rows}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s], rel=1e-9)
        assert r.taken <= op.REPEATS * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert len(got) == 400
    assert all(abs(taken[s] - want[s]) <= 20 for s in want)
    copies = op.mixed_documents(make(rows)).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in copies if len(dict((i, t) for i, t, _ in rows)[r["doc_id"]])} == {r.doc_id: r.taken // r.size for r in got if r.size and r.taken}


def test_edges(make, edges):
    rows = op.mix(make(edges)).collect()
    assert len(rows) == len(edges)
    assert sum(r.taken for r in rows) > 0
    assert op.mix(make([])).count() == 0
    nothing = op.mix(make([(1, None, None), (2, "", "a")])).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2
    docs = make([(1, "a b", "s")]).withColumnRenamed("lang", "target")
    assert op.mixed_documents(docs).columns == docs.columns
