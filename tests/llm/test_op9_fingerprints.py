import random

from pyspark.sql import functions as F

from barcheck.llm import op9_fingerprints as op


def test_next_text_and_edit(make, monkeypatch):
    monkeypatch.setattr(op, "CHUNK_ROWS", 3)
    rng = random.Random(1)
    ids = rng.sample(range(10_000), 40)
    rows = [(i, "é" * rng.randint(0, 9) + str(i)) for i in ids]
    got = {r.doc_id: r for r in op.with_next(make(rows)).select("doc_id", "next_text", op.edited(F.col("text"), F.col("next_text")).alias("e")).collect()}
    down = sorted(rows, reverse=True)
    for (i, t), (_, n) in zip(down, down[1:] + down[:1], strict=True):
        half = len(t) // 2
        assert (got[i].next_text, got[i].e) == (n, t[: len(t) - half] + n[:half])


def test_rows_stay_rows(make, edges):
    assert op.with_next(make(edges)).count() == len(edges)
    assert [r.next_text for r in op.with_next(make([(1, "a")])).collect()] == ["a"]
    assert op.with_next(make([])).count() == 0
    assert op.fingerprints(make([])).count() == 0


def test_likeness_is_near_the_share_of_common_shingles(make):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    a = rng.choices(words, k=3000)
    b = a[:1500] + rng.choices(words, k=600)
    docs = make([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a)), (4, "x y"), (5, "x z"), (6, ""), (7, None), (8, "x y")])
    s = {r.doc_id: r.sketch for r in op.fingerprints(docs).collect()}
    assert s[1] == s[3] and s[4] == s[8] and s[6] == s[7] == [] and s[4] != s[5]
    one = docs.limit(1).select(*[F.array(*map(F.lit, s[i])).cast("array<long>").alias(f"s{i}") for i in (1, 2, 4, 6)])
    r = one.select(op.likeness(F.col("s1"), F.col("s2")).alias("j"), op.containment(F.col("s2"), F.col("s1")).alias("c"), op.likeness(F.col("s6"), F.col("s6")).alias("e"), op.likeness(F.col("s4"), F.col("s6")).alias("z"), op.merge(F.col("s1"), F.col("s4")).alias("m")).first()
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    assert abs(r.j - len(x & y) / len(x | y)) < 0.06
    assert abs(r.c - len(x & y) / len(y)) < 0.08
    assert (r.e, r.z) == (1.0, 0.0)
    limit = (1 << op.HASH_BITS) // op.SCALE
    assert set(s[1]) <= set(r.m) and all(h < limit for h in r.m)


def test_letter_case_and_blanks_do_not_matter(make):
    s = {r.doc_id: r.sketch for r in op.fingerprints(make([(1, "A b\tc\n\nd e f"), (2, " a B c d E f ")])).collect()}
    assert s[1] == s[2] and s[1]
