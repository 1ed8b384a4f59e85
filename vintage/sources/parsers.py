"""Vendor payloads to tables: each takes a frame with a payload column of JSON, or CSV lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintage.functions import scalars

CHART = "chart struct<result: array<struct<timestamp: array<bigint>, indicators: struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<bigint>>>, adjclose: array<struct<adjclose: array<double>>>>>>>"
SPLITS = "chart struct<result: array<struct<events: struct<splits: map<string, struct<date: bigint, numerator: double, denominator: double>>>>>>"
CONCEPT = "units map<string, array<struct<start: string, end: string, val: double, accn: string, filed: string, form: string>>>"
NEWS = "news array<struct<title: string, publisher: string, providerPublishTime: string>>"
QUOTE = "chart struct<result: array<struct<meta: struct<regularMarketPrice: double, bid: double, ask: double, marketState: string>>>>"


def _day(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def chart_bars(payloads: DataFrame) -> DataFrame:
    """(symbol, payload) to bars; a bar with any null, or beyond the shorter arrays, is left out."""
    one = payloads.select("symbol", F.get(F.from_json("payload", CHART)["chart"]["result"], F.lit(0)).alias("r"))
    one = one.select("symbol", "r.timestamp", F.get("r.indicators.quote", F.lit(0)).alias("q"), F.get("r.indicators.adjclose", F.lit(0)).alias("a"))
    each = one.select("symbol", "q", "a", F.posexplode("timestamp").alias("i", "ts"))
    at = lambda path: F.get(F.col(path), F.col("i"))
    bars = each.select("symbol", _day(F.col("ts")).alias("date"), *(at(f"q.{c}").alias(c) for c in ("open", "high", "low", "close")), at("a.adjclose").alias("adj_close"), at("q.volume").alias("volume"))
    return bars.dropna()


def chart_splits(payloads: DataFrame) -> DataFrame:
    one = payloads.select("symbol", F.explode(F.map_values(F.get(F.from_json("payload", SPLITS)["chart"]["result"], F.lit(0))["events"]["splits"])).alias("s"))
    ratio = F.try_divide("s.numerator", "s.denominator")
    return one.select("symbol", _day(F.col("s.date")).alias("date"), ratio.alias("ratio")).where("ratio IS NOT NULL AND ratio <> 0")


def ticker_map(payloads: DataFrame) -> DataFrame:
    """payload of {n: {ticker, cik_str}} to (symbol, cik); entries without a whole number are left out."""
    one = payloads.select(F.explode(F.map_values(F.from_json("payload", "map<string, struct<ticker: string, cik_str: string>>"))).alias("t"))
    return one.select(F.upper(F.trim("t.ticker")).alias("symbol"), F.expr("try_cast(t.cik_str AS bigint)").alias("cik")).where("cik IS NOT NULL AND symbol IS NOT NULL")


def concept_facts(payloads: DataFrame) -> DataFrame:
    """(symbol, concept, payload) to annual facts: a duration of 300 to 400 days, or an instant; known when filed."""
    one = payloads.select("symbol", "concept", F.explode(F.flatten(F.map_values(F.from_json("payload", CONCEPT)["units"]))).alias("u"))
    day = lambda c: F.expr(f"try_cast(u.{c} AS date)")
    facts = one.select("symbol", "concept", F.col("u.start").alias("start_text"), day("start").alias("start"), day("end").alias("period_end"), F.col("u.val").alias("value"), day("filed").alias("knowable_at"), F.col("u.accn").alias("accn"))
    whole = F.col("period_end").isNotNull() & F.col("value").isNotNull() & F.col("knowable_at").isNotNull() & F.col("accn").isNotNull()
    annual = F.col("start_text").isNull() | F.datediff("period_end", "start").between(300, 400)
    return facts.where(whole & annual).drop("start_text", "start")


def klines(payloads: DataFrame) -> DataFrame:
    """(symbol, payload of arrays) to bars; short rows, no numbers and prices not over 0 are left out."""
    row = F.from_json("payload", "array<array<string>>")
    each = payloads.select("symbol", F.explode(row).alias("k")).where(F.size("k") >= 6)
    number = lambda i: F.expr(f"try_cast(k[{i}] AS double)")
    bars = each.select("symbol", F.to_date(F.timestamp_millis(F.expr("try_cast(k[0] AS bigint)"))).alias("date"), number(1).alias("open"), number(2).alias("high"), number(3).alias("low"), number(4).alias("close"), number(4).alias("adj_close"), F.bround(number(5), 0).cast("bigint").alias("volume"))
    return bars.dropna().where("open > 0 AND high > 0 AND low > 0 AND close > 0")


def membership(lines: DataFrame) -> DataFrame:
    """Columns ticker, start_date, end_date as text to spans; blank or unreadable starts are left out, an end before its start fails."""
    day = lambda c: F.expr(f"try_cast(trim({c}) AS date)")
    spans = lines.select(F.trim("ticker").alias("ticker"), day("start_date").alias("start_date"), day("end_date").alias("end_date")).where("ticker <> '' AND start_date IS NOT NULL")
    wrong = F.col("end_date") < F.col("start_date")
    return spans.withColumn("end_date", F.when(wrong, F.raise_error(F.concat(F.lit("end before start: "), "ticker")).cast("date")).otherwise(F.col("end_date")))


def news_items(payloads: DataFrame, now: str, max_age_hours: int = 36) -> DataFrame:
    """(symbol, payload) to items younger than max_age_hours at now; the hash is of symbol and title."""
    each = payloads.select("symbol", F.explode(F.from_json("payload", NEWS)["news"]).alias("n"))
    at = F.expr("timestamp_seconds(try_cast(n.providerPublishTime AS bigint))")
    items = each.select("symbol", at.alias("published_at"), F.coalesce("n.publisher", F.lit("")).alias("source"), F.col("n.title").alias("headline"), F.lit("").alias("body"))
    young = items.where(F.col("headline").isNotNull() & (F.col("published_at") >= F.lit(now).cast("timestamp") - F.expr(f"interval {max_age_hours} hours")))
    return young.withColumn("content_hash", F.sha2(F.concat_ws("|", "symbol", "headline"), 256)).withColumn("knowable_at", F.to_date("published_at"))


def quotes(payloads: DataFrame) -> DataFrame:
    """(symbol, payload) to last, bid, ask and state; a quote without a price over 0 is left out."""
    meta = F.get(F.from_json("payload", QUOTE)["chart"]["result"], F.lit(0))["meta"]
    out = payloads.select("symbol", meta.alias("m")).select("symbol", F.col("m.regularMarketPrice").alias("last"), F.col("m.bid").alias("bid"), F.col("m.ask").alias("ask"), F.coalesce("m.marketState", F.lit("UNKNOWN")).alias("state"))
    return out.where(F.greatest("last", "bid", "ask") > 0)


def intraday(payloads: DataFrame) -> DataFrame:
    """(symbol, payload) to price and market state, a row for each payload: a malformed one has no price and the state UNKNOWN."""
    meta = F.get(F.from_json("payload", QUOTE)["chart"]["result"], F.lit(0))["meta"]
    price = F.when(meta["regularMarketPrice"] > 0, F.nanvl(meta["regularMarketPrice"], F.lit(None).cast("double")))
    return payloads.select("symbol", price.alias("price"), F.coalesce(meta["marketState"], F.lit("UNKNOWN")).alias("state"))


def tradable_pairs(payloads: DataFrame) -> DataFrame:
    """(symbol) of an exchange's listing: spot pairs in USDT that trade, without stable coins and leveraged tokens."""
    listed = payloads.select(F.explode(F.from_json("payload", "symbols array<struct<symbol: string, quoteAsset: string, status: string, isSpotTradingAllowed: boolean>>")["symbols"]).alias("p"))
    open_ = (F.col("p.quoteAsset") == "USDT") & (F.col("p.status") == "TRADING") & F.col("p.isSpotTradingAllowed")
    return listed.where(open_ & ~scalars.stable_or_leveraged(F.col("p.symbol"))).select("p.symbol").distinct()


def account_cash(payloads: DataFrame) -> DataFrame:
    """The cash of each account payload; 0 where it isn't a number."""
    return payloads.select(F.coalesce(F.expr("try_cast(get_json_object(payload, '$.cash') AS double)"), F.lit(0.0)).alias("cash"))


def account(payloads: DataFrame) -> DataFrame:
    """payload {cash, positions: {symbol: shares or {shares}}} to (symbol, shares); what isn't a number is left out."""
    each = payloads.select(F.explode(F.from_json("payload", "positions map<string, string>")["positions"]).alias("symbol", "v"))
    shares = F.coalesce(F.expr("try_cast(v AS double)"), F.expr("try_cast(get_json_object(v, '$.shares') AS double)"))
    return each.select("symbol", shares.alias("shares")).where("shares IS NOT NULL")
