"""Sources with canned openers, ingest that goes on, streams of marks."""

import datetime as dt
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from vintage.sources import feeds, parsers
from vintage.streaming import ticks


def chart(*closes):
    n = len(closes)
    stamps = [1_700_000_000 + 86_400 * k for k in range(n)]
    return json.dumps({"chart": {"result": [{"timestamp": stamps, "indicators": {"quote": [{c: list(closes) for c in ("open", "high", "low", "close")} | {"volume": [7] * n}], "adjclose": [{"adjclose": list(closes)}]}}]}})


class Flaky:
    def fetch(self, symbol):
        if symbol == "BAD":
            raise TimeoutError("slow")
        return {"AAA": chart(1.0, 2.0), "BBB": chart(5.0)}.get(symbol, "{}")


def test_ingest_survives_a_symbol(spark):
    existing = spark.createDataFrame([("AAA", dt.date(2023, 11, 14), 9.0, 9.0, 9.0, 9.0, 9.0, 1, dt.date(2023, 11, 14)), ("OLD", dt.date(2020, 1, 1), 3.0, 3.0, 3.0, 3.0, 3.0, 1, dt.date(2020, 1, 1))], "symbol string, date date, open double, high double, low double, close double, adj_close double, volume long, knowable_at date")
    waits = []
    table, report, got = feeds.ingest(spark, existing, "bars", Flaky(), ["AAA", "BAD", "NONE", "BBB"], parsers.chart_bars, pause=0.2, sleep=waits.append)
    assert {(r["symbol"], str(r["date"]), r["close"]) for r in table.collect()} == {("AAA", "2023-11-14", 1.0), ("AAA", "2023-11-15", 2.0), ("BBB", "2023-11-14", 5.0), ("OLD", "2020-01-01", 3.0)}
    assert got.failed == {"BAD": "TimeoutError: slow"} and waits == [0.2] * 3
    assert json.loads(feeds.coverage(report, got.failed)) == {"requested": 4, "coverage": 0.5, "succeeded": 2, "empty": 1, "failed": 1, "failures": got.failed}


def test_chart_source_refuses_the_longest_range():
    with pytest.raises(ValueError):
        feeds.ChartSource("max")
    seen = []
    feeds.ChartSource("5y", events=True, opener=lambda u: seen.append(u) or b"{}").fetch("A B")
    assert "A%20B" in seen[0] and "interval=1mo" in seen[0] and "range=5y" in seen[0]


def test_news_without_a_network_is_empty():
    def down(url):
        raise urllib.error.URLError("down")

    source = feeds.NewsSource(down)
    assert source.fetch("AAA") == "{}" and "AAA" in source.last_errors and feeds.CannedSource({"A": "x"}).fetch("B") == "{}"
    assert json.loads(feeds.fetch_exchange(down)) == {"symbols": []}


def test_klines_page_forward_and_keep_what_came():
    days = [1_700_006_400_000 + 86_400_000 * k for k in range(5)]
    calls = []

    def opener(url):
        calls.append(url)
        start = int(url.split("startTime=")[1].split("&")[0])
        rest = [[d, "1", "1", "1", "1", "1"] for d in days if d >= start]
        if len(calls) == 3:
            raise TimeoutError
        return json.dumps(rest[:2]).encode()

    rows = json.loads(feeds.fetch_klines("XUSDT", dt.date(2023, 11, 15), dt.date(2023, 12, 1), opener))
    assert [r[0] for r in rows] == days[:4] and len(calls) == 3


def test_fundamentals_capture_failures(spark):
    fact = {"units": {"USD": [{"start": "2022-01-01", "end": "2022-12-31", "val": 5, "accn": "a", "filed": "2023-02-01"}]}}

    def opener(url):
        if url == feeds.TICKERS_URL:
            return json.dumps({"0": {"ticker": "BRK-B", "cik_str": 7}, "1": {"ticker": "AAA", "cik_str": 8}}).encode()
        if "CIK0000000008" in url:
            raise urllib.error.HTTPError(url, 404 if "Net" in url else 500, "no", None, None)
        return json.dumps(fact).encode()

    facts, failed = feeds.fetch_fundamentals(spark, feeds.FilingsClient(opener), ["BRK.B", "AAA", "ZZZ"], ("NetIncomeLoss", "StockholdersEquity"))
    assert {(r["symbol"], r["concept"], r["value"]) for r in facts.collect()} == {("BRK.B", "NetIncomeLoss", 5.0), ("BRK.B", "StockholdersEquity", 5.0)}
    assert {(r["symbol"], r["concept"]) for r in failed.collect()} == {("AAA", "StockholdersEquity"), ("ZZZ", "")}


def test_membership_file_and_its_wrong_spans(spark):
    text = "ticker,start_date,end_date\nXYZ,2001-02-03,2004-05-06\n XYZ ,2009-01-01,\n,2001-01-01,\nQ,later,\n"
    found = feeds.fetch_membership(spark, "u", lambda u: text.encode("utf-8-sig")).collect()
    assert {(r["ticker"], str(r["start_date"]), str(r["end_date"])) for r in found} == {("XYZ", "2001-02-03", "2004-05-06"), ("XYZ", "2009-01-01", "None")}
    with pytest.raises(Exception, match="end before start"):
        parsers.membership(feeds.membership_lines(spark, "ticker,start_date,end_date\nXYZ,2004-01-01,2003-01-01\n")).collect()


def test_quotes_leave_out_what_has_no_price(spark):
    meta = lambda **m: json.dumps({"chart": {"result": [{"meta": m}]}})
    source = feeds.QuoteSource(spark, feeds.CannedSource({"A": meta(bid=9.0, ask=11.0), "B": meta(regularMarketPrice=4.0, bid=6.0, ask=5.0), "C": meta(bid=0.0)}))
    assert source.quotes(["A", "B", "C", "D"]) == {"A": 10.0, "B": 4.0}


def test_stream_marks_from_the_first_value_on(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 3, 1, h)
    schema = "session string, at timestamp, value double, state string"
    for k, rows in enumerate(([("s", at(9), 100.0, "REGULAR"), ("z", at(9), 0.0, "PRE")], [("s", at(10), 110.0, "REGULAR"), ("z", at(10), 5.0, "PRE")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ticks.append_marks(ticks.marked_to_market(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
        found = spark.read.json(str(tmp_path / "out")).orderBy("session", "at").collect()
        assert len(found) == 2 * (k + 1)
    assert [(r["session"], r["pnl"], r["pct"]) for r in found] == [("s", 0.0, 0.0), ("s", 10.0, 0.1), ("z", 0.0, 0.0), ("z", 5.0, 0.0)]


def test_stream_of_items_drops_the_stale_and_the_repeated(spark, tmp_path):
    now = dt.datetime(2024, 3, 2, 12)
    rows = [("A", "h1", now - dt.timedelta(hours=1), now), ("A", "h1", now - dt.timedelta(hours=1), now), ("A", "h2", now - dt.timedelta(hours=40), now), ("B", "h1", now, now)]
    schema = "symbol string, content_hash string, published_at timestamp, received_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = ticks.fresh_items(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("fresh").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["symbol"], r["content_hash"]) for r in spark.table("fresh").collect()) == [("A", "h1"), ("B", "h1")]


def test_journal_tables_append_and_skip_torn_lines(spark, tmp_path):
    from vintage.sources import store

    path = str(tmp_path / "j")
    row = spark.createDataFrame([(1, dt.date(2024, 1, 2), 10.0)], "seq long, as_of date, equity double")
    store.append_journal(row, path)
    store.append_journal(row.withColumn("seq", F.lit(2).cast("long")), path)
    (tmp_path / "j" / "part-torn.json").write_text('{"seq": 3, "as_of": "2024-01\n{"x":')
    assert sorted(r["seq"] for r in store.read_journal(spark, path).collect()) == [1, 2]
