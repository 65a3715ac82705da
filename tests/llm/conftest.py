import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source]) rows, with the columns of ``documents``."""

    def build(rows, parts=3):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)

    return build


#: NULLs, empty and blank texts, repeated rows, ties and one long text.
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (4, "a b"), (None, "x y z"), (5, "word " * 30_000), (6, "a b"), (7, "ünï ▁ cödé\n\n😀")]


@pytest.fixture(scope="session")
def edges():
    return list(EDGES)
