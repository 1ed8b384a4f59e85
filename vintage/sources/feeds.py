"""Where payloads come from: vendors over HTTP, behind protocols that tests replace, and ingest that survives a symbol's failure.

A fetch returns text; the parsers make tables of many payloads at once. Every
source takes its opener, clock and pause, so nothing here needs a network.
"""

from __future__ import annotations

import csv
import datetime as dt
import gzip
import io
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.functions import scalars
from vintage.sources import parsers, store

Opener = Callable[[str], bytes]

# vendors' addresses.
CHART_URL = "https://query1.finance.yahoo.com/v8/finance/chart/{symbol}?{query}"
NEWS_URL = "https://query1.finance.yahoo.com/v1/finance/search?{query}"
TICKERS_URL = "https://www.sec.gov/files/company_tickers.json"
CONCEPT_URL = "https://data.sec.gov/api/xbrl/companyconcept/CIK{cik:010d}/us-gaap/{concept}.json"
KLINES_URL = "https://api.binance.com/api/v3/klines?{query}"
EXCHANGE_URL = "https://api.binance.com/api/v3/exchangeInfo"
CONCEPTS = ("NetIncomeLoss", "StockholdersEquity", "WeightedAverageNumberOfDilutedSharesOutstanding")
PAGE_ROWS = 1000

NETWORK = (urllib.error.URLError, TimeoutError, ConnectionError)


def http(url: str, agent: str = "vintage research", timeout: float = 30.0) -> bytes:
    """The body behind a URL, unpacked."""
    asked = urllib.request.Request(url, headers={"User-Agent": agent, "Accept-Encoding": "gzip"})
    with urllib.request.urlopen(asked, timeout=timeout) as reply:
        body = reply.read()
    return gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body


class PayloadSource(Protocol):
    """What ingest reads: the payload of one symbol."""

    def fetch(self, symbol: str) -> str: ...


@dataclass
class ChartSource:
    """Daily bars, or with events splits. The longest range is refused: for it the vendor gives quarterly bars without a word."""

    range_: str = "10y"
    events: bool = False
    opener: Opener = http

    def __post_init__(self) -> None:
        if self.range_ == "max":
            raise ValueError("range max gives quarterly bars; name a span")

    def fetch(self, symbol: str) -> str:
        query = {"range": self.range_, "interval": "1mo" if self.events else "1d"} | ({"events": "split"} if self.events else {})
        return self.opener(CHART_URL.format(symbol=urllib.parse.quote(symbol), query=urllib.parse.urlencode(query))).decode()


@dataclass
class NewsSource:
    """Recent items of a symbol; a network that fails gives none."""

    opener: Opener = http
    last_errors: dict[str, str] = field(default_factory=dict)

    def fetch(self, symbol: str) -> str:
        try:
            return self.opener(NEWS_URL.format(query=urllib.parse.urlencode({"q": symbol, "quotesCount": 0}))).decode()
        except NETWORK as problem:
            self.last_errors[symbol] = str(problem)
            return "{}"


@dataclass
class CannedSource:
    """Payloads that are there already."""

    payloads: dict[str, str]

    def fetch(self, symbol: str) -> str:
        return self.payloads.get(symbol, "{}")


@dataclass
class Fetched:
    """Payloads by symbol, and why the others have none."""

    payloads: dict[str, str] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)


def fetch_all(source: PayloadSource, symbols: Iterable[str], pause: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> Fetched:
    """Fetch every symbol; what one raises is kept and the next goes on."""
    out = Fetched()
    for k, symbol in enumerate(symbols):
        if k and pause:
            sleep(pause)
        try:
            out.payloads[symbol] = source.fetch(symbol)
        except Exception as problem:  # noqa: BLE001  whatever a vendor does, the other symbols go on
            out.failed[symbol] = f"{type(problem).__name__}: {problem}"
    return out


def ingest(spark: SparkSession, existing: DataFrame, table: str, source: PayloadSource, symbols: list[str], parse: Callable[[DataFrame], DataFrame], **options) -> tuple[DataFrame, DataFrame, Fetched]:
    """(existing with what was fetched put in, status of the symbols, what was fetched)."""
    got = fetch_all(source, symbols, **options)
    parsed = parse(spark.createDataFrame(list(got.payloads.items()), "symbol string, payload string"))
    asked = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    failed = spark.createDataFrame([(s,) for s in got.failed], "symbol string")
    report = store.ingest_report(asked, parsed, failed)
    if "knowable_at" not in parsed.columns:
        parsed = store.bars_frame(parsed)
    return store.upsert(existing, parsed.withColumn("seq", F.lit(1)), table), report, got


def coverage(report: DataFrame, failed: dict[str, str]) -> str:
    """An ingest as JSON: symbols of each status, the share that succeeded, the failures."""
    rows = {r["status"]: r["symbols"] for r in report.collect()}
    asked = sum(rows.values())
    return json.dumps({"requested": asked, "coverage": rows.get("succeeded", 0) / asked if asked else 0.0, "failures": failed} | {k: rows.get(k, 0) for k in ("succeeded", "empty", "failed")}, sort_keys=True)


def membership_lines(spark: SparkSession, text: str) -> DataFrame:
    """A membership file (ticker, start_date, end_date with a head line) as rows of text for parsers.membership."""
    rows = [tuple((r.get(c) or "") for c in ("ticker", "start_date", "end_date")) for r in csv.DictReader(io.StringIO(text))]
    return spark.createDataFrame(rows, "ticker string, start_date string, end_date string")


def fetch_membership(spark: SparkSession, url: str, opener: Opener = http) -> DataFrame:
    return parsers.membership(membership_lines(spark, opener(url).decode("utf-8-sig")))


@dataclass
class FilingsClient:
    """Company facts; a concept a company never filed is an empty payload."""

    opener: Opener = http

    def tickers(self) -> str:
        return self.opener(TICKERS_URL).decode()

    def concept(self, cik: int, concept: str) -> str:
        try:
            return self.opener(CONCEPT_URL.format(cik=cik, concept=concept)).decode()
        except urllib.error.HTTPError as problem:
            if problem.code == 404:
                return "{}"
            raise


def fetch_fundamentals(spark: SparkSession, client: FilingsClient, symbols: list[str], concepts: Iterable[str] = CONCEPTS) -> tuple[DataFrame, DataFrame]:
    """(facts, failures (symbol, concept, reason)) of symbols; one without a number at the authority is a failure."""
    map_ = parsers.ticker_map(spark.createDataFrame([(client.tickers(),)], "payload string"))
    asked = spark.createDataFrame([(s,) for s in symbols], "asked string").withColumn("symbol", scalars.filing_ticker(F.col("asked")))
    known = asked.join(map_.dropDuplicates(["symbol"]), "symbol", "left").select("asked", "cik").collect()
    rows, failed = [], [(r["asked"], "", "no number") for r in known if r["cik"] is None]
    for r in known:
        for concept in concepts if r["cik"] is not None else ():
            try:
                rows.append((r["asked"], concept, client.concept(r["cik"], concept)))
            except Exception as problem:  # noqa: BLE001
                failed.append((r["asked"], concept, f"{type(problem).__name__}: {problem}"))
    facts = parsers.concept_facts(spark.createDataFrame(rows, "symbol string, concept string, payload string"))
    return facts, spark.createDataFrame(failed, "symbol string, concept string, reason string")


def fetch_klines(symbol: str, start: dt.date, end: dt.date, opener: Opener = http) -> str:
    """All daily rows of a pair, page after page from the day behind the last; what came before a page that fails is kept."""
    midnight = lambda day: int(dt.datetime.combine(day, dt.time(), dt.UTC).timestamp() * 1000)
    rows: list[list] = []
    at, stop = midnight(start), midnight(end)
    while at <= stop:
        query = urllib.parse.urlencode({"symbol": symbol, "interval": "1d", "startTime": at, "endTime": stop, "limit": PAGE_ROWS})
        try:
            page = json.loads(opener(KLINES_URL.format(query=query)))
        except (*NETWORK, ValueError):
            break
        if not isinstance(page, list) or not page:
            break
        rows += page
        following = int(page[-1][0]) + 86_400_000
        if following <= at:
            break
        at = following
    return json.dumps(rows)


def fetch_exchange(opener: Opener = http) -> str:
    """What is listed at the exchange; nothing if it can't be reached."""
    try:
        return opener(EXCHANGE_URL).decode()
    except NETWORK:
        return '{"symbols": []}'


@dataclass
class QuoteSource:
    """Prices of symbols now; one without a usable price is left out."""

    spark: SparkSession
    source: PayloadSource
    last_errors: dict[str, str] = field(default_factory=dict)

    def table(self, symbols: list[str]) -> DataFrame:
        got = fetch_all(self.source, symbols)
        self.last_errors = got.failed
        return parsers.quotes(self.spark.createDataFrame(list(got.payloads.items()), "symbol string, payload string"))

    def quotes(self, symbols: list[str]) -> dict[str, float]:
        mid = scalars.quote_mid(F.col("last"), F.col("bid"), F.col("ask"))
        return {r["symbol"]: r["mid"] for r in self.table(symbols).select("symbol", mid.alias("mid")).where("mid IS NOT NULL").collect()}
