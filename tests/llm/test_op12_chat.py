import hashlib
import random

import duckdb
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from barcheck.llm import op12_chat as op

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["\\", "</turn>\n", "<turn user>\n", "\\l", "\\b<", "\\### Assistant: </turn> ok", "a\nb", "", ">\n", "\\g"]


def talk(n_conv, seed, longest=40):
    rng = random.Random(seed)
    rows = []
    for c in range(n_conv):
        turns = rng.randint(1, longest)
        start = rng.choice([0, 0, 1, 62, -70])
        for t in range(turns):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2]
            text = " ".join(rng.choices(["word", "ünï", *NASTY], k=rng.choice([0, 3, 30, 200, 900 if t % 11 == 5 else 50])))
            rows.append((c, start + t * rng.choice([1, 1, 1, 2]) if c % 5 == 0 else start + t, role, text))
    return rows


ODD = [(None, 0, "user", "x"), (None, None, "assistant", "y z"), (900, 3, None, None), (900, 3, None, None), (901, 0, "system", "only"), (902, 5, "assistant", "a"), (902, 5, "assistant", "a"), (903, 0, "us<er>\n\\", "q")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain(rows):
    """Digests straight from the turns."""
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((-(1 << 62) if t is None else t), r or "", x or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


def test_read_back_and_sql(spark, tmp_path):
    rows = talk(25, 4) + ODD + [(c, t, ("user", "assistant")[t % 2], "w " * 40) for c in (800,) for t in range(400)]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op.op12_chat(spark, str(tmp_path)).collect()
    own = [(-7, 0, "user", op.PLANTED), (-7, 1, "assistant", op.PLANTED)]
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain(rows + own)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.sql(op.ORACLE).fetchall(), key=str) == sorted(map(tuple, got), key=str)


def test_windows_keep_to_the_budget(spark):
    rows = [(c, t, "system" if t == 0 else ("assistant", "user")[t % 2], "w " * (7 + t % 30)) for c in range(3) for t in range(150)]
    got = op.windows(frame(spark, rows), budget=200, history=50).collect()
    assert all(r.n_tokens <= 200 for r in got)
    assert all(r.formatted.startswith("<turn system>") for r in got)
    assert all(r.n_repeated >= 2 for r in got if r.window > 0)
    assert sum(r.n_turns for r in got) == len(rows)
    for r in got:
        assert all(r.formatted[: s.start].endswith("<turn assistant>\n") and r.formatted[s.start + s.length :].startswith("</turn>") for s in r.loss)


def test_large_turns_stay_whole(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b " * 5000), (1, 2, "user", "c")]
    got = sorted(op.windows(frame(spark, rows)).collect(), key=lambda r: (r.block, r.window))
    assert [r.n_turns for r in got] == [1, 1, 1] and sum(s.length for r in got for s in r.loss) == 10_000


@settings(max_examples=200, deadline=None)
@given(st.text("\\bl<g>x/\n", max_size=12))
def test_escape_is_reversible(text):
    e = text.replace("\\", "\\b").replace("<", "\\l")
    assert "<" not in e and e.replace("\\l", "<").replace("\\b", "\\") == text


@pytest.mark.parametrize("text", NASTY)
def test_escape_columns(spark, text):
    x = spark.range(1).select(op.unescape(op.escape(F.lit(text))).alias("back"), op.escape(F.lit(text)).alias("e")).first()
    assert x.back == text and "<" not in x.e


def test_odd_tables(spark):
    assert op.windows(frame(spark, ODD).limit(0)).count() == 0
    extra = frame(spark, ODD).withColumn("_conv", F.lit(1)).withColumn("window", F.lit("x"))
    assert op.windows(extra).agg(F.sum("n_turns")).first()[0] == len(ODD)
