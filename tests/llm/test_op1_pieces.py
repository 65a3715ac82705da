import math
from collections import Counter

import numpy as np
import pytest

from barcheck.llm import op1_pieces as op

V = op.load()


@pytest.mark.parametrize("plain", [64, 0])
def test_segmentations_have_the_probabilities_of_the_lattice(monkeypatch, plain):
    monkeypatch.setattr(op, "PLAIN", plain)
    word, n = " hé☃l\x01lo", 20_000

    def spell(s):
        if not s:
            yield (), 0.0
            return
        for i in range(1, min(len(s), V.longest) + 1):
            p = s[:i]
            if p in V.logs:
                for rest, x in spell(s[i:]):
                    yield (V.ids[p], *rest), x + V.logs[p]
            elif i == 1:
                for rest, x in spell(s[i:]):
                    yield (V.byte_ids[ord(p)] if ord(p) < 128 else -1 - ord(p), *rest), x + V.byte_log * len(p.encode())

    exact = {k: math.exp(x) for k, x in spell(word)}
    total = sum(exact.values())
    lattices = op.Lattices(V)
    pieces, count = lattices.sample(lattices.add([word] * n), np.arange(n, dtype=np.uint64) * np.uint64(0x1234567))
    got = Counter(tuple(x.tolist()) for x in np.split(pieces, np.cumsum(count)[:-1]))
    assert set(got) <= set(exact)
    for k, p in exact.items():
        assert abs(got[k] / n - p / total) < 5 * math.sqrt(p / total / n) + 1e-4


def test_round_trip_and_reruns(make, edges):
    docs = make([*edges, (9, "x" * 5000 + " y"), (10, "  two  spaces \r\n")])
    rows = op.encode_and_decode(docs, V).collect()
    assert len(rows) == docs.count()
    assert all(r.decoded == r.text for r in rows)
    assert all((r.piece_ids is None) == (r.text is None) for r in rows)
    again = {(r.doc_id, r.text): r.piece_ids for r in op.encode_and_decode(docs.repartition(7), V).collect()}
    assert all(again[r.doc_id, r.text] == r.piece_ids for r in rows)


def test_the_library_decodes_the_samples(make):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=op.MODEL)
    for r in op.encode_and_decode(make([(1, "the quick brown fox"), (2, "déjà vu, 猫")]), V).collect():
        assert sp.decode(list(r.piece_ids)) == r.text


def test_clashing_columns_and_empty_table(make):
    docs = make([(1, "a b")]).withColumnRenamed("lang", "decoded")
    assert op.encode_and_decode(docs, V).first().decoded == "a b"
    assert op.encode_and_decode(make([]), V).count() == 0
