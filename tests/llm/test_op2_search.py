import math
import random
from collections import Counter

import pytest

from barcheck.llm import op2_search as op


def brute(docs, queries, k):
    bags = [(i, Counter((t or "").lower().split())) for i, t in docs]
    n = len(bags)
    mean = max(1.0, sum(sum(b.values()) for _, b in bags) / max(1, n))
    df = Counter(w for _, b in bags for w in b)
    out = set()
    for q, text in {(q, t) for q, t in queries if q is not None}:
        scored = []
        for i, b in bags:
            size = sum(b.values())
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * (op.K1 + 1) / (b[w] + op.K1 * (1 - op.B + op.B * size / mean)) for w in sorted(set((text or "").lower().split())) if b[w])
            if s > 0 and i is not None:
                scored.append((-round(s, 9), i))
        out |= {(q, i, r + 1, round(-s, 6)) for r, (s, i) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize(("shard", "terms"), [(16_384, 1_000_000), (40, 60)])
def test_equals_brute_force_over_shards_and_query_blocks(make, monkeypatch, shard, terms):
    monkeypatch.setattr(op, "SHARD_DOCS", shard)
    monkeypatch.setattr(op, "QUERY_TERMS", terms)
    monkeypatch.setattr(op, "FIRST", 2)
    monkeypatch.setattr(op, "BLOCK", 8)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(300)], k=rng.randint(1, 60)))) for i in range(300)]
    rows += [(900 + i, rows[7][1]) for i in range(15)]
    asked = [r for r in rows if r[0] % 25 == 0 or r[0] == 7]
    got = {tuple(r) for r in op.search(make(rows, 4), make(asked), 10).collect()}
    assert got == brute(rows, asked, 10)


def test_edges(make, edges):
    asked = [(1, None), (2, ""), (4, "a b"), (4, "a b"), (None, "a")]
    assert {tuple(r) for r in op.search(make([e for e in edges if e[0] != 4]), make(asked), 3).collect()} == brute([e for e in edges if e[0] != 4], asked, 3)
    assert op.search(make([]), make([(1, "a")])).count() == 0
    assert op.search(make([(1, "a")]), make([])).count() == 0


def test_copies_whose_score_rounds_up_keep_the_smallest_ids(make, monkeypatch):
    monkeypatch.setattr(op, "SHARD_DOCS", 150)
    monkeypatch.setattr(op, "BLOCK", 8)
    copy, n_copies = "alpha beta gamma", 3_000

    def score(others):
        n, size = n_copies + others, 3
        mean = (n_copies * size + others * 2) / n
        return 3 * math.log(1 + (n - n_copies + 0.5) / (n_copies + 0.5)) * (op.K1 + 1) / (1 + op.K1 * (1 - op.B + op.B * size / mean))

    others = next(n for n in range(500, 600) if round(score(n), 9) > score(n) + 2e-10)
    rows = [(i, copy) for i in range(n_copies)] + [(n_copies + i, f"x{i} y{i}") for i in range(others)]
    random.Random(11).shuffle(rows)
    got = op.search(make(rows, 4), make([(7, copy)]), 10).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in got) == [(i + 1, i) for i in range(10)]


def test_shards_of_a_task_hand_on_their_bounds(make, monkeypatch):
    monkeypatch.setattr(op, "SHARD_DOCS", 50)
    monkeypatch.setattr(op, "FIRST", 1_000)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(300)], k=rng.randint(1, 60)))) for i in range(1_000)]
    sent, top = [], op._top
    monkeypatch.setattr(op, "_top", lambda found, k: sent.append(found.count()) or top(found, k))
    got = {tuple(r) for r in op.search(make(rows, 1), make(rows[:20]), 10).collect()}
    assert got == brute(rows, rows[:20], 10)
    #: 20 shards with 10 rows for each of 20 queries would be 4,000.
    assert sum(sent) < 3_000, sent
