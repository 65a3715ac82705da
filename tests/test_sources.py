"""Provider files and sinks, with rows of our own."""

import json
from datetime import date

from pyspark.sql import functions as F

from barcheck.operators import ledger
from barcheck.operators.gaps import as_gaps
from barcheck.sources import provider
from barcheck.streaming.checks import ledger_sink

ROWS = "v,vw,o,c,h,l,t,n,ticker\n100.0,10.1,10.0,10.2,10.3,9.9,1748836800000,7,ZZZ\n90.0,10.1,10.2,10.1,10.4,9.8,1748923200000,5,ZZZ\n"


def test_csv_bars_take_the_exchange_date(spark, tmp_path):
    (tmp_path / "bars.csv").write_text(ROWS)
    got = provider.read_csv_bars(spark, str(tmp_path / "bars.csv")).orderBy("date").collect()
    assert [(r["ticker"], r["date"], r["open"], r["volume"]) for r in got] == [("ZZZ", date(2025, 6, 2), 10.0, 100.0), ("ZZZ", date(2025, 6, 3), 10.2, 90.0)]


def test_provenance_splits(spark, tmp_path):
    doc = {"provider": "p", "tickers": ["ZZZ"], "splits": [{"ticker": "ZZZ", "execution_date": "2025-06-10", "split_from": 1, "split_to": 15, "adjustment_type": "x"}]}
    (tmp_path / "p.json").write_text(json.dumps(doc, indent=1))
    (s,) = provider.provenance_splits(provider.read_provenance(spark, str(tmp_path / "p.json"))).collect()
    assert (s["execution_date"], s["split_to"]) == (date(2025, 6, 10), 15.0)


def test_bars_are_partitioned_by_year(spark, tmp_path):
    (tmp_path / "bars.csv").write_text(ROWS)
    provider.write_bars(provider.read_csv_bars(spark, str(tmp_path / "bars.csv")), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).where("year = 2025")
    assert back.count() == 2 and "PartitionFilters: [isnotnull(year" in back._jdf.queryExecution().toString()


def test_replayed_batches_add_nothing_to_the_ledger(spark, tmp_path):
    gaps = as_gaps(spark.range(3), "d", "sessions", "K", "MINOR", "x", ticker=F.col("id").cast("string"))
    write = ledger_sink(str(tmp_path / "ledger"))
    write(gaps, 0)
    write(gaps, 0)
    got = spark.read.parquet(str(tmp_path / "ledger"))
    assert got.count() == 3 and got.select("gap_id").distinct().count() == 3


def test_a_batch_cut_off_while_writing_is_written_again(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = lambda ids: as_gaps(spark.createDataFrame([(str(i),) for i in ids], "id string"), "d", "sessions", "K", "MINOR", "x", ticker=F.col("id"))
    write = ledger_sink(path)
    write(rows([0, 1, 1]), 0)
    # half of batch 1 is there already, then it comes whole, with an id of batch 0, and once more
    rows([2]).write.parquet(f"{path}/batch_id=1")
    for _ in range(2):
        write(rows([1, 2, 3]), 1)
    write(rows([0, 3, 4]), 2)
    got = sorted((r["ticker"], r["batch_id"]) for r in spark.read.parquet(path).collect())
    assert got == [("0", 0), ("1", 0), ("2", 1), ("3", 1), ("4", 2)]


def test_rollup_tells_a_null_from_a_total(spark):
    led = spark.createDataFrame([("c", "k", "MINOR", "OPEN", 2), ("c", None, "MINOR", "OPEN", 3)], "check string, kind string, severity string, status string, n long")
    got = sorted((r["level"], str(r["kind"]), r["n_gaps"], r["n_rows"]) for r in ledger.rollup(led).collect())
    full = [(n, k, 1, v) for n in (0, 1, 3) for k, v in (("None", 3), ("k", 2))]
    assert got == full + [(7, "None", 2, 5), (15, "None", 2, 5)]
    assert [(r["level"], r["n_gaps"]) for r in ledger.rollup(led.where("false")).collect()] in ([], [(15, 0)])
