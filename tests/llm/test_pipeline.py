from pathlib import Path

import pytest

import corpus_pipeline as pipeline
from barcheck.llm import op6_lines, op7_mixing, op10_toxicity

from .test_op4_minmax import brute as components_of
from .test_op6_lines import brute as lines_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are absent")


def test_stages_against_brute_force(spark):
    """Every stage on what the stage before it kept, each held against a plain recomputation."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    steps = dict(pipeline.STAGES)
    assert list(steps) == ["toxicity", "line_dedup", "near_dedup", "mixing", "pieces"]

    a = pipeline.cut_lineage(steps["toxicity"](spark, docs, FOLDER))
    model = op10_toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = {r.doc_id for r in docs.collect() if model.probability(op10_toxicity.np.array([op10_toxicity._bag(model, op10_toxicity.units(r.text))]))[0] < op10_toxicity.CUT}
    assert {r.doc_id for r in a.collect()} == want

    b = pipeline.cut_lineage(steps["line_dedup"](spark, a, FOLDER))
    kept = [(i, t) for i, t, _, _ in lines_of([(r.doc_id, r.text) for r in a.collect()], op6_lines.MIN_DOCS, op6_lines.MIN_CHARS)]
    assert sorted(((r.doc_id, r.text) for r in b.collect()), key=str) == kept
    assert all(r.n_chars == len(r.text) for r in b.collect())

    c = pipeline.cut_lineage(steps["near_dedup"](spark, b, FOLDER))
    assert {r.doc_id for r in c.collect()} == {i for i, _, root in components_of(kept) if i == root}

    d = pipeline.cut_lineage(steps["mixing"](spark, c, FOLDER))
    taken = {r.doc_id: r.taken // r.size for r in op7_mixing.mix(c).collect() if r.size}
    texts = {r.doc_id: r.text for r in c.collect()}
    counts = {r["doc_id"]: r["count"] for r in d.groupBy("doc_id").count().collect() if texts[r["doc_id"]].split()}
    assert counts == {i: n for i, n in taken.items() if n}
    for x in (a, b, c, d):
        assert x.columns == columns

    e = steps["pieces"](spark, d, FOLDER).collect()
    assert len(e) == d.count()
    assert all(r.lossless and r.n_pieces == len(r.piece_ids) for r in e)


def test_run_is_the_chain_and_reruns_agree(spark):
    first, again = ({(r.doc_id, tuple(r.piece_ids)) for r in pipeline.run(spark, FOLDER).collect()} for _ in range(2))
    assert first == again and first
