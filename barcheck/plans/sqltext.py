"""SQL fragments shared by the verification queries (DuckDB dialect). They restate the definitions independently of the
DataFrame code: plain grids, self-joins and windows, with no regard to scale."""

from __future__ import annotations

from ..constants import ADHOC_CLOSURES, ADHOC_EARLY_CLOSES
from ..functions import normal as nrm


def easter_sql(y: str) -> str:
    a, b, c = f"({y} % 19)", f"({y} // 100)", f"({y} % 100)"
    h = f"((19*{a} + {b} - {b}//4 - ({b} - ({b}+8)//25 + 1)//3 + 15) % 30)"
    l = f"((32 + 2*({b}%4) + 2*({c}//4) - {h} - ({c}%4)) % 7)"
    m = f"(({a} + 11*{h} + 22*{l}) // 451)"
    code = f"({h} + {l} - 7*{m} + 114)"
    return f"make_date({y}::BIGINT, ({code} // 31)::BIGINT, ({code} % 31 + 1)::BIGINT)"


def holiday_sql(d: str) -> str:
    y, m, day, wd = f"year({d})", f"month({d})", f"day({d})", f"isodow({d})"
    adhoc = ", ".join(f"DATE '{x}'" for x in ADHOC_CLOSURES)

    def obs(mon: int, on: int) -> str:
        return f"({m}={mon} AND ({day}={on} OR ({day}={on - 1} AND {wd}=5) OR ({day}={on + 1} AND {wd}=1)))"

    return (
        f"({wd} < 6 AND ("
        f"({m}=1 AND ({day}=1 OR ({day}=2 AND {wd}=1)))"
        f" OR ({m}=1 AND {wd}=1 AND {day} BETWEEN 15 AND 21 AND {y}>=1998)"
        f" OR ({m}=2 AND {wd}=1 AND {day} BETWEEN 15 AND 21)"
        f" OR ({d} = {easter_sql(y)} - 2)"
        f" OR ({m}=5 AND {wd}=1 AND {day} BETWEEN 25 AND 31)"
        f" OR ({obs(6, 19)} AND {y}>=2022) OR {obs(7, 4)}"
        f" OR ({m}=9 AND {wd}=1 AND {day} BETWEEN 1 AND 7)"
        f" OR ({m}=11 AND {wd}=4 AND {day} BETWEEN 22 AND 28)"
        f" OR {obs(12, 25)} OR {d} IN ({adhoc})))"
    )


def session_sql(d: str) -> str:
    return f"(isodow({d}) < 6 AND NOT {holiday_sql(d)})"


def early_sql(d: str) -> str:
    y, m, day, wd = f"year({d})", f"month({d})", f"day({d})", f"isodow({d})"
    adhoc = ", ".join(f"DATE '{x}'" for x in ADHOC_EARLY_CLOSES)
    return (
        f"({session_sql(d)} AND (({m}=11 AND {wd}=5 AND {day} BETWEEN 23 AND 29 AND {y}>=1993)"
        f" OR ({m}=12 AND {day}=24 AND {wd}<=4 AND {y}>=1993)"
        f" OR ({m}=7 AND {day}=3 AND (({wd} IN (1,2,4) AND {y}>=1995) OR ({wd}=3 AND {y}>=2013)))"
        f" OR ({m}=7 AND {day}=5 AND {wd}=5 AND {y} BETWEEN 1996 AND 2012) OR {d} IN ({adhoc})))"
    )


def kind_sql(d: str) -> str:
    return (
        f"CASE WHEN isodow({d}) >= 6 THEN 'WEEKEND' WHEN {holiday_sql(d)} THEN 'HOLIDAY'"
        f" WHEN {early_sql(d)} THEN 'EARLY_CLOSE' ELSE 'TRADING' END"
    )


def open_sql(d: str) -> str:
    return f"timezone('UTC', timezone('America/New_York', {d}::TIMESTAMP + INTERVAL 570 MINUTE))"


def ny_date(ts: str) -> str:
    return f"timezone('America/New_York', timezone('UTC', {ts}))::DATE"


def gap_id_sql(ds: str, check: str, kind: str, ticker: str = "NULL", start: str = "NULL", end: str = "NULL") -> str:
    parts = [f"'{ds}'", check, kind, ticker, start, end]
    text = " || '|' || ".join(f"coalesce(({p})::VARCHAR, 'None')" for p in parts)
    return f"substr(sha1({text}), 1, 12)"


def days_cte(src: str, name: str = "days") -> str:
    return f"{name} AS (SELECT unnest(generate_series((SELECT min(date) FROM {src})::TIMESTAMP, (SELECT max(date) FROM {src})::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date)"


SESS = f"sess AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM days WHERE {session_sql('date')})"


def bars_cte(step: float | None = None, name: str = "bars") -> str:
    px = "l_extendedprice / l_quantity" if step is None else f"floor(l_extendedprice / l_quantity / {step})"
    order = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
    return (
        f"{name}_x AS (SELECT p_brand AS ticker, l_shipdate::DATE AS date, {px} AS px, l_quantity AS q, row_number() OVER"
        f" (PARTITION BY p_brand, l_shipdate::DATE ORDER BY {order}) AS rn FROM lineitem JOIN part ON l_partkey = p_partkey),"
        f" {name} AS (SELECT ticker, date, arg_min(px, rn) AS open, max(px) AS high, min(px) AS low, arg_max(px, rn) AS close,"
        f" sum(q) AS volume FROM {name}_x GROUP BY ticker, date)"
    )


MINUTES = (
    "minutes AS (SELECT event_type AS ticker, date_trunc('minute', ts) AS ts, arg_min(value, rn) AS open, max(value) AS high,"
    " min(value) AS low, arg_max(value, rn) AS close, count(*)::DOUBLE AS volume FROM (SELECT *, row_number() OVER"
    " (ORDER BY ts, event_id) AS rn FROM events) GROUP BY 1, 2)"
)

RAW_MINUTES = (
    "minutes AS (SELECT event_type AS ticker, CASE WHEN event_id % 13 = 0 THEN date_trunc('second', ts) ELSE date_trunc('minute', ts) END AS ts,"
    " value AS open, value AS high, value AS low, value AS close, 1.0::DOUBLE AS volume FROM events)"
)

NEWS = (
    "news AS (SELECT 'a' || (doc_id - CASE WHEN doc_id % 23 = 1 THEN 1 ELSE 0 END) AS id,"
    " CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN 'garbage' WHEN doc_id % 11 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')"
    " ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS published_utc,"
    " CASE WHEN doc_id % 17 = 0 OR doc_id % 29 = 0 OR doc_id % 11 = 0 THEN NULL ELSE date_trunc('second', ts) END AS ts,"
    " CASE WHEN doc_id % 17 = 0 THEN 'null' WHEN doc_id % 29 = 0 THEN 'bad' WHEN doc_id % 11 = 0 THEN 'nozone' ELSE 'ok' END AS st,"
    " text AS title, source AS publisher_name,"
    " CASE WHEN doc_id % 7 = 0 THEN '[]' ELSE '[\"' || upper(lang) || '\"]' END AS tickers"
    " FROM documents JOIN events ON doc_id = event_id)"
)

MASTER = (
    "master AS (SELECT ticker, CASE k WHEN 0 THEN lo - 40 WHEN 1 THEN lo + 10 WHEN 2 THEN lo - 12 ELSE lo END AS list_date,"
    " CASE k WHEN 2 THEN hi + 30 WHEN 3 THEN hi - 20 WHEN 4 THEN hi END AS delist_date,"
    " CASE k WHEN 4 THEN -0.3::DOUBLE END AS delist_return FROM (SELECT ticker, min(date) AS lo, max(date) AS hi,"
    " regexp_extract(ticker, '(\\d+)', 1)::INT % 5 AS k FROM bars GROUP BY ticker))"
)

SPLITS = (
    "splits AS (SELECT ticker, CASE WHEN regexp_extract(ticker, '(\\d+)', 1)::INT % 5 = 0 AND y % 2 = 0 THEN (d + INTERVAL 240 MONTH)::DATE ELSE d END"
    " AS execution_date, 1.0::DOUBLE AS split_from, (2 + y % 3)::DOUBLE AS split_to FROM (SELECT ticker, year(date) AS y, min(date) AS d"
    " FROM bars GROUP BY ticker, year(date)))"
)

VARIANTS = (
    "vo AS (SELECT o_orderpriority || '/' || o_orderstatus AS strategy_id, o_orderdate::DATE AS date, round(o_totalprice * 100)::BIGINT AS cents FROM orders),"
    " vm AS (SELECT (sum(cents) // count(*))::BIGINT AS m FROM vo),"
    " vi AS (SELECT date, (row_number() OVER (ORDER BY date) - 1)::INT AS t FROM (SELECT DISTINCT date FROM vo)),"
    " vr AS (SELECT s.strategy_id, vi.t, coalesce((sum(cents)::BIGINT - count(cents) * (SELECT m FROM vm)) / 1e10, 0.0) AS r"
    " FROM (SELECT DISTINCT strategy_id FROM vo) s CROSS JOIN vi LEFT JOIN vo ON vo.strategy_id = s.strategy_id AND vo.date = vi.date"
    " GROUP BY s.strategy_id, vi.t),"
    " vb AS (SELECT t, sum(round(r * 1e10)::BIGINT)::BIGINT / 1.5e11 AS b FROM vr GROUP BY t)"
)


def unif(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0)"


def _horner(cs, x: str) -> str:
    acc = repr(float(cs[0]))
    for c in cs[1:]:
        acc = f"({acc} * {x} + {float(c)!r})"
    return acc


def cdf_sql(x: str) -> str:
    a = f"abs({x})"
    body = f"exp(-{a}*{a}/2.0) * {_horner(nrm.HART_NUM, a)} / {_horner(nrm.HART_DEN, a)}"
    far = f"exp(-{a}*{a}/2.0) / ({a} + 1.0/({a} + 2.0/({a} + 3.0/({a} + 4.0/({a} + 0.65))))) / 2.506628274631"
    up = f"(CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < 7.07106781186547 THEN {body} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1.0 - {up} ELSE {up} END)"


def ppf_start_sql(p: str) -> str:
    low, high = f"sqrt(-2.0*ln({p}))", f"sqrt(-2.0*ln(1.0-{p}))"
    q = f"({p}-0.5)"
    r = f"({q}*{q})"
    return (
        f"(CASE WHEN {p} < {nrm.ACKLAM_LOW} THEN {_horner(nrm.ACKLAM_C, low)} / {_horner(nrm.ACKLAM_D + (1.0,), low)}"
        f" WHEN {p} > {1 - nrm.ACKLAM_LOW!r} THEN -({_horner(nrm.ACKLAM_C, high)}) / {_horner(nrm.ACKLAM_D + (1.0,), high)}"
        f" ELSE {_horner(nrm.ACKLAM_A, r)} * {q} / {_horner(nrm.ACKLAM_B + (1.0,), r)} END)"
    )


def with_ctes(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "
