import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from barcheck.llm import op10_toxicity as op
from pyspark.sql import functions as F

INSULTS = ["idiot", "moron", "worthless", "pathetic"]


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["tion", "ly", "he", "an", "re", "st", "ou", "ble", "er", "in", "ha", "wh"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    rows = []
    for i in range(n):
        t = [word() for _ in range(rng.randint(5, 60))]
        y = int(rng.random() < 0.2)
        for _ in range(y * rng.randint(1, 3)):
            t.insert(rng.randrange(len(t)), rng.choice(INSULTS))
        rows.append((i, " ".join(t), y))
    return rows


@pytest.fixture(scope="module")
def model():
    return op.fit(op.Bags([(op.units(t), y) for _, t, y in corpus(1500, 1)]))


def test_held_out_documents(model):
    rows = corpus(400, 2)
    p = model.probability(np.array([op._bag(model, op.units(t)) for _, t, _ in rows]))
    y = np.array([y for *_, y in rows])
    assert (p[y == 1] >= op.CUT).mean() > 0.95
    assert (p[y == 0] < op.CUT).mean() > 0.98


@pytest.mark.parametrize("text", ["you i.d.i.o.t", "such a m o r o n here", "wor*th*less!!", "PATHETIC,", "idxiot", "worthlesss"])
def test_gapped_and_inserted_characters(model, text):
    assert model.probability(np.array([op._bag(model, op.units(text))]))[0] >= op.CUT


def test_kernel_is_symmetric_and_definite():
    words = ["idiot", "idxiot", "worthless", "theation", "a", "x" * 90]
    k = op.Kernel(words[:4]).rows(words[:4])
    assert np.allclose(k, k.T, atol=1e-6)
    assert np.linalg.eigvalsh(k).min() > -1e-9


def test_scoring_follows_the_landmarks(model):
    alpha = np.random.default_rng(1).normal(size=3)
    kernel = op.Kernel(["idiot", "moron", "the"])
    words = ["idiot", "moronic", "theation"]
    got = op.Model(kernel.weights(alpha), 0.5, 1.0, 0.0).decide(words)
    assert np.allclose(got, kernel.rows(words) @ alpha + 0.5, atol=1e-4)


def test_tables(spark, make, edges):
    rows = corpus(300, 3)
    docs = make([(i, t) for i, t, _ in rows] + [(None if i is None else i + 1000, t) for i, t in edges])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1001, None), (None, 1), (5000, 1)], "doc_id long, toxic int")
    fitted = op.train(docs, labels)
    got = op.score_texts(docs, fitted, out="lang").select("doc_id", "text", "lang").collect()
    assert len(got) == 300 + len(edges)
    assert all(0 <= r.lang <= 1 for r in got)
    clean = {r.doc_id for r in op.drop_toxic(docs, labels).collect()}
    assert {1001, 1002, 1003} <= clean
    assert op.drop_toxic(docs, labels).columns == docs.columns
    assert op.train(docs, labels.limit(0)) is None
    assert op.score_texts(docs, None).where("toxicity <> 0").count() == 0
    assert op.score_texts(make([]), fitted).count() == 0


def test_held_out_rows_are_not_learned_from(spark, make):
    from zlib import crc32

    flags = {r.doc_id: r.h for r in make([(i, "t") for i in range(50)]).select("doc_id", op.held_out(op.F.col("doc_id")).alias("h")).collect()}
    assert flags == {i: crc32(str(i).encode()) % 4 == 2 for i in range(50)}


def test_spark_fits_like_the_plain_form(spark, make, model):
    rows = corpus(1500, 1)
    docs = make([(i, t) for i, t, _ in rows])
    sample = op.Sample(docs.join(spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, y int"), "doc_id"))
    got = op.fit(sample)
    assert np.allclose(got.beta, model.beta, atol=1e-5) and got.bias == pytest.approx(model.bias, abs=1e-6)
    assert (got.slope, got.shift) == pytest.approx((model.slope, model.shift), rel=1e-5)


def plain_kernel(a, b):
    """Every pair of equal subsequences of three or four characters that span at most SPAN, each named like the machine does."""

    def subsequences(word):
        bare = "^" + "".join(filter(str.isalnum, word)) + "$"
        codes = op._codes(np.frombuffer(bare.encode("utf-32-le"), np.uint32)).tolist()
        out = Counter()
        for k in (3, 4):
            for places in combinations(range(len(codes)), k):
                width = places[-1] - places[0]
                if width < op.SPAN:
                    number = 0
                    for p in places:
                        number = number * op.CODES + codes[p]
                    if k == 4:
                        number = op.SLOTS + ((number * 2654435761) % 2**32 >> 14)
                    out[number] += op.DECAY ** (width - k + 1)
        return out, op._scale(len(codes))

    (x, m), (y, n) = subsequences(a), subsequences(b)
    return sum(v * y[u] for u, v in x.items()) / m / n


def test_kernel_equals_all_subsequences():
    words = ["idiot", "idxiot", "worthless", "i.d.i.o.t", "ünï", "ab", "世界平和", "バカ野郎"]
    got = op.Kernel(words[:5]).rows(words)
    assert np.allclose(got, [[plain_kernel(a, b) for b in words[:5]] for a in words], atol=1e-5)


def test_words_of_one_length_beyond_latin_differ():
    insult, others = "バカ野郎", ["世界平和", "東京大学", "朝鮮半島", "가나다라"]
    k = op.Kernel([insult]).rows([insult, *others])[:, 0]
    assert k[0] > 4 * k[1:].max()


def test_a_column_with_the_score_s_name_stays(spark, make):
    rows = corpus(300, 3)
    docs = make([(i, t) for i, t, _ in rows]).withColumn("_toxicity", F.lit("mine")).withColumn("__TOXICITY", F.lit(1))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = op.drop_toxic(docs, labels)
    assert got.columns == docs.columns
    assert {tuple(r) for r in got.select("_toxicity", "__TOXICITY").distinct().collect()} == {("mine", 1)}
