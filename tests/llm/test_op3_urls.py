import pytest

from barcheck.llm import op3_urls as op


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("http://badexample.net/en/", "badexample.net", "/en/", "net/", "block"),
        ("http://net?x", "net", "", None, "allow"),
        ("http://a.org/fr/casino", "a.org", "/fr/casino", "org/fr/", "allow"),
        ("http://example.com/en/casino", "example.com", "/en/casino", None, "block"),
        ("http://example.com/casinos", "example.com", "/casinos", None, "allow"),
        ("http://example.com/free/x-free", "example.com", "/free/x-free", None, "allow"),
        ("http://example.com/free-bonus", "example.com", "/free-bonus", None, "block"),
        ("no mark casino", "", "", None, "block"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_single_urls(url, host, path, rule, verdict):
    assert op.parts(url) == (host, path)
    found = op.Rules(op.RULES).find(host, path)
    strict, soft = op.Vocabulary(op.STRICT, op.SOFT).hits(url or "")
    assert (found[0], found[1] or ("block" if strict or soft >= op.SOFT_LIMIT else "allow")) == (rule, verdict)


def test_table(spark):
    rows = [(1, "http://x.net/a"), (1, "http://x.net/a"), (None, None), (2, "http://b.com/" + "free/" * 20_000 + "win")]
    pages = spark.createDataFrame(rows, "page_id long, host string")
    got = op.judge_urls(pages, url="host").select("page_id", "judged.rule", "judged.verdict", "judged.soft_hits").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "net/", "block", 0), (1, "net/", "block", 0), (None, None, "allow", 0), (2, None, "block", 2)], key=str)
    assert op.judge_urls(spark.createDataFrame([], "url string")).count() == 0
