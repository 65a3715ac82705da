"""URL filter: host and path rules, then a weighted vocabulary counted with an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import UPPER, table

#: Fixed values of the contract: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: One distinct strict term rejects a URL; a soft term rejects it together with others.
STRICT = ("casino", "cheap-pills", "malware", "porn", "spam-farm", "viagra", "warez", "xxx")
SOFT = ("adult", "bet", "bonus", "cheap", "click", "crack", "deal", "farm", "free", "loan", "pills", "poker", "promo", "sale", "spam", "torrent", "win")
SOFT_LIMIT = 2

_LOWER = str.maketrans(UPPER, UPPER.lower())
_EDGE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
SCHEMA = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("strict_hits", T.IntegerType()),
        T.StructField("soft_hits", T.IntegerType()),
    ]
)


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for NULL and for a text without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = _until(rest, "?#")
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def _until(s: str, stops: str) -> str:
    at = [i for i in map(s.find, stops) if i >= 0]
    return s[: min(at)] if at else s


class Rules:
    """Host rules with path prefixes, looked up by the suffixes of a host, so the cost does not grow with their number.

    A rule is ``host/path``. Among the rules that fit, the longest wins; of two equally long ones that with the longer
    host, then ``block`` before ``allow``.
    """

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, found = (-1, -1, False), (None, None)
        while host:
            for prefix, rule, verdict in self.by_host.get(host, ()):
                rank = (len(rule), len(host), verdict == "block")
                if rank > best and path.startswith(prefix):
                    best, found = rank, (rule, verdict)
            host = host.partition(".")[2]
        return found


class Vocabulary:
    """Strict and soft terms in one automaton; a term counts once, and only where no ASCII letter or digit adjoins it."""

    def __init__(self, strict: Sequence[str], soft: Sequence[str]):
        self.automaton = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            self.automaton.add_word(term, (term, term in strict))
        self.automaton.make_automaton()

    def hits(self, url: str) -> tuple[int, int]:
        text, seen = url.translate(_LOWER), set()
        for end, (term, strict) in self.automaton.iter(text):
            begin = end - len(term) + 1
            if (begin == 0 or text[begin - 1] not in _EDGE) and (end + 1 == len(text) or text[end + 1] not in _EDGE):
                seen.add((term, strict))
        n = sum(strict for _, strict in seen)
        return n, len(seen) - n


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    out: str = "judged",
    rules: Sequence[tuple[str, str]] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """``pages`` with a struct ``out`` (host, path, rule, verdict, strict_hits, soft_hits) for each row's URL.

    The rule that fits decides; without one the vocabulary does: ``block`` for one strict term or ``soft_limit``
    distinct soft terms, else ``allow``. NULL and empty URLs have empty host and path, no rule, no hits, and are
    allowed. Rows are judged one by one: repeated rows and other columns stay as they are, only a column named like
    ``out`` is replaced. An empty table gives an empty result.
    """

    @F.pandas_udf(SCHEMA)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, words = Rules(rules), Vocabulary(strict, soft)
        for urls in batches:
            rows = []
            for u in urls:
                host, path = parts(u)
                rule, verdict = known.find(host, path)
                n_strict, n_soft = words.hits(u) if u else (0, 0)
                rows.append((host, path, rule, verdict or ("block" if n_strict or n_soft >= soft_limit else "allow"), n_strict, n_soft))
            yield pd.DataFrame(rows, columns=SCHEMA.names)

    return pages.withColumn(out, judge(F.col(url)))


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages").select("page_id", "url")).select("page_id", "judged.*")


def _term(term: str) -> str:
    return f"CAST(regexp_matches(l, '(^|[^a-z0-9]){term}([^a-z0-9]|$)') AS INTEGER)"


def _fits(rule: str) -> str:
    host, slash, path = rule.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}')"


def oracle() -> str:
    longest = sorted(RULES, key=lambda r: -len(r[0]))
    rule = " ".join(f"WHEN {_fits(r)} THEN '{r}'" for r, _ in longest)
    verdict = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES)
    return f"""
    WITH u AS (
      SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{UPPER.lower()}') AS l,
             translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{UPPER.lower()}') AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    h AS (
      SELECT page_id, host, path, CASE {rule} END AS rule,
             {" + ".join(map(_term, STRICT))} AS strict_hits, {" + ".join(map(_term, SOFT))} AS soft_hits FROM u)
    SELECT page_id, host, path, rule,
           CASE rule {verdict} ELSE CASE WHEN strict_hits > 0 OR soft_hits >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END END AS verdict,
           strict_hits, soft_hits FROM h"""
