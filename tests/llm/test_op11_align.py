import hashlib
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from barcheck.llm import op11_align as op


@pytest.fixture(scope="module")
def tokenizers():
    return op.load()


@pytest.fixture(scope="module")
def parts(tokenizers):
    return op.surfaces(tokenizers)


ALPHABET = "ab é\n\t▁<>x 0'世界🙂  　"


def brute(parts, rows):
    """Whole texts, all pairs of tokens, counts over all rows."""
    ta, a_bytes, tb, b_bytes, _ = parts
    docs, count = [], Counter()
    for key, text in rows:
        a = ta.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tb.encode(text) if text else []
        want = (" " + text).encode() if text else b""
        if b"".join(a_bytes[i] for i in a) != want or b"".join(b_bytes[i] for i in b) != want:
            a, b = [], []
        spans = []
        for ids, table in ((a, a_bytes), (b, b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(out)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, lo = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if lo <= s and e <= c) for side in spans))
            lo = c
        links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e]
        count.update(set(links))
        docs.append((key, a, b, groups, links))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return sorted(
        (
            (key, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
            for key, a, b, groups, links in docs
        ),
        key=str,
    )


def rows_of(n, seed):
    rng = random.Random(seed)
    words = ["hello", "Über", "naïve", "a", "antidisestablishmentarianism", "world.", "x=1;", "  two", "tab\t", "<|endoftext|>", "don't", "世界", "12345", "🙂", "line\nbreak", "end \n", "▁", "\x00"]
    return [(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(n)]


@settings(max_examples=300, deadline=None)
@given(text=st.text(ALPHABET, max_size=40))
def test_units_encode_like_whole_texts(parts, tokenizers, text):
    aligner = op.Aligner.__new__(op.Aligner)
    aligner.ta, _, aligner.tb, _, _ = parts
    aligner.space = [aligner.tb.piece_to_id("▁")]
    units = op.units_of(text)
    assert "".join(units) == " " + text and all(u[0] == " " for u in units)
    a, b = aligner.encode(units)
    assert sum(a, []) == parts[0].encode(" " + text, add_special_tokens=False).ids
    if text and "▁" not in text:
        assert sum(b, []) == parts[2].encode(text)


def test_query_equals_all_pairs_of_whole_texts(spark, tmp_path, make, edges, parts):
    rows = rows_of(60, 1) + [r for r in edges if len(r[1] or "") < 1000] + [(70, "word " * 400)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op.op11_align(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(parts, rows)


def test_pairs_in_the_join(spark, make, tokenizers, parts):
    """With room for few frequent pairs, most counts come from the join."""
    rows = rows_of(60, 2)
    x = op.corpus_alignment(make(rows), tokenizers)
    want = brute(parts, rows)
    for room in (1, 3, 10**6):
        got = op.link_counts(x, hot_pairs=room)
        assert sorted(map(tuple, got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str) == want


def test_translation_table(spark, make, tokenizers, parts):
    x = op.corpus_alignment(make([(1, "hello world"), (2, "hello"), (3, "hello hello"), (4, None)]), tokenizers)
    ta, a_bytes, _, b_bytes, _ = parts
    got = {(a_bytes[r.a], b_bytes[r.b]): r.n for r in x.pairs().collect()}
    assert got[b" world", b" world"] == 1
    assert sum(n for (a, _), n in got.items() if a == b" hello") == 3 * len({b for (a, b) in got if a == b" hello"})


def test_odd_tables(spark, make, tokenizers, edges):
    docs = make(edges).withColumn("n_a", F.lit("x")).withColumn("_row", F.lit(1)).withColumn("_text", F.lit(2))
    out = op.align(docs, tokenizers, keep=("doc_id", "n_a", "lang")).collect()
    assert len(out) == len(edges) and len({r._row for r in out}) == len(edges)
    assert all(r.n_a == 0 and r.groups_sha256 == "" for r in out if r.doc_id in (1, 2))
    assert op.link_counts(op.corpus_alignment(make([]), tokenizers)).count() == 0
