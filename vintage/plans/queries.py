"""The query catalogue: each query over whole tables, beside the SQL it must equal."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.functions import scalars
from vintage.operators import books, evaluate, pit, portfolio, signals
from vintage.operators.simulate import Settings, simulate
from vintage.plans import studies
from vintage.sources import parsers, store
from vintage.sources.adapters import Tables, with_clause
from vintage.streaming import ticks

DAY, FIRST, LAST = "1999-06-30", "1993-01-01", "1998-06-30"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *tables: str):
    """Register a query; its SQL may read the domain tables named."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            head = with_clause(*tables) if tables else ""
            ORACLE_SQL[f.__name__] = head + (", " + sql.strip()[5:] if head and sql.strip()[:5].upper() == "WITH " else sql.strip())
        return f

    return register


def rounded(df: DataFrame, *columns: str, places: int = 8) -> DataFrame:
    """Columns rounded half away from zero on the scaled double, as SQL's round does; F.round rounds the decimal print, which parts at ties."""
    unit = float(10**places)

    def at(name):
        scaled = F.col(name).cast("double") * unit
        # Doubles from 2**53 on, and NaN, have no digits to round. Adding 0 turns -0.0 into 0.0.
        near = F.when(F.abs(scaled) < 2.0**53, F.signum(scaled) * F.floor(F.abs(scaled) + 0.5)).otherwise(scaled)
        return near / unit + 0.0

    return df.withColumns({c: at(c) for c in columns})


def decisions(t: Tables, every: int = 21) -> DataFrame:
    """(as_of, symbol) of the universe on every so many trading dates."""
    dates = t.bars.select("date").distinct()
    place = F.row_number().over(pit.Window.orderBy("date")) - 1  # a row a trading date
    return pit.universe_calendar(t.universe, dates.withColumn("i", place).where(F.col("i") % every == 0).select(F.col("date").alias("as_of")))


def decisions_sql(every: int = 21) -> str:
    return f"""cal AS (SELECT date AS as_of FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)) WHERE i % {every} = 0),
dec AS (SELECT c.as_of, u.symbol FROM cal c ASOF JOIN (SELECT DISTINCT effective FROM universe) e ON c.as_of >= e.effective JOIN universe u ON u.effective = e.effective)"""


def signal_sql(feature: str, every: int = 21) -> str:
    """feature: CTEs of which the last is f(symbol, date, v)."""
    return f"""WITH {decisions_sql(every)}, {feature}
SELECT d.as_of, d.symbol, round(coalesce(f.v, 0), 8) + 0.0 AS value, CASE WHEN f.v IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence
FROM dec d ASOF LEFT JOIN f ON d.symbol = f.symbol AND d.as_of >= f.date"""


def scored(df: DataFrame) -> DataFrame:
    return rounded(df.select("as_of", "symbol", "value", "confidence"), "value")


# --- as-of reads ---------------------------------------------------------------------------------


@query("SELECT DISTINCT date FROM bars WHERE date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'", "bars")
def scan_trading_calendar(t):
    return pit.trading_dates(t.bars, "1995-01-01", "1996-12-31")


@query(f"SELECT symbol, date, close, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS INT) AS back FROM bars WHERE knowable_at <= DATE '{LAST}' QUALIFY back <= 7", "bars")
def asof_last_n_bars(t):
    return pit.last_n_bars(t.bars, LAST, 7).select("symbol", "date", "close", "back")


@query(f"SELECT symbol, max(date) AS date, arg_max(close, date) AS close FROM bars WHERE knowable_at <= DATE '{LAST}' GROUP BY symbol", "bars")
def asof_latest_bar(t):
    return pit.latest_bars(t.bars, LAST).select("symbol", "date", "close")


@query(f"WITH {decisions_sql(1)} SELECT d.as_of, d.symbol, b.date AS bar_date, b.close FROM dec d ASOF LEFT JOIN bars b ON d.symbol = b.symbol AND d.as_of >= b.date", "bars", "universe")
def asof_latest_bar_calendar(t):
    bars = t.bars.withColumn("bar_date", F.col("date"))
    return pit.lookup(bars, decisions(t, 1), ["symbol"], "date", "as_of", ["bar_date", "close"]).select("as_of", "symbol", "bar_date", "close")


@query(f"SELECT symbol, concept, knowable_at, period_end, accn, value FROM facts WHERE knowable_at <= DATE '{LAST}' QUALIFY row_number() OVER (PARTITION BY symbol, concept ORDER BY knowable_at DESC, period_end DESC, accn DESC) = 1", "facts")
def asof_fundamentals(t):
    return pit.latest_fundamentals(t.facts, LAST).select("symbol", "concept", "knowable_at", "period_end", "accn", "value")


@query(f"""WITH {decisions_sql()}, p AS (SELECT DISTINCT d.as_of, d.symbol, f.concept FROM dec d JOIN facts f ON d.symbol = f.symbol)
SELECT p.as_of, p.symbol, p.concept, f.knowable_at AS filed, f.period_end, f.accn, f.value FROM p JOIN facts f ON p.symbol = f.symbol AND p.concept = f.concept AND f.knowable_at <= p.as_of
QUALIFY row_number() OVER (PARTITION BY p.as_of, p.symbol, p.concept ORDER BY f.knowable_at DESC, f.period_end DESC, f.accn DESC) = 1""", "bars", "universe", "facts")  # fmt: skip
def asof_fundamentals_calendar(t):
    return pit.fundamentals_calendar(t.facts, decisions(t)).select("as_of", "symbol", "concept", "filed", "period_end", "accn", "value")


@query(f"SELECT effective, symbol FROM universe WHERE effective = (SELECT max(effective) FROM universe WHERE knowable_at <= DATE '{LAST}')", "universe")
def asof_universe(t):
    return pit.universe(t.universe, LAST).select("effective", "symbol")


@query(f"WITH {decisions_sql(1)} SELECT as_of, symbol FROM dec", "bars", "universe")
def asof_universe_calendar(t):
    return decisions(t, 1).select("as_of", "symbol")


def news_items(t):
    items = t.news.withColumn("content_hash", scalars.content_hash(F.col("source"), F.col("headline"), F.col("body")))
    return items.withColumn("published_at", F.col("published_at").cast("timestamp_ntz")).withColumn("knowable_at", F.to_date("published_at"))


NEWS_SQL = "n AS (SELECT *, sha256(source || '|' || headline || '|' || body) AS content_hash, CAST(published_at AS DATE) AS knowable_at FROM news)"


@query(f"WITH {NEWS_SQL} SELECT symbol, published_at, content_hash FROM n WHERE knowable_at <= DATE '1998-06-30' ORDER BY published_at DESC, symbol, content_hash LIMIT 250", "news")
def asof_news_global_limit(t):
    return pit.news(news_items(t), "1998-06-30", 250).select("symbol", "published_at", "content_hash")


@query(f"WITH {NEWS_SQL} SELECT symbol, published_at, content_hash FROM n WHERE knowable_at <= DATE '1998-06-30' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY published_at DESC, content_hash) <= 5", "news")
def asof_news_per_symbol(t):
    return pit.news(news_items(t), "1998-06-30", 5, per_symbol=True).select("symbol", "published_at", "content_hash")


@query("SELECT f.symbol, f.concept, f.accn, f.knowable_at, coalesce(product(s.ratio), 1.0) AS factor FROM facts f LEFT JOIN splits s ON f.symbol = s.symbol AND s.date > f.knowable_at AND s.ratio > 0 GROUP BY ALL", "facts", "splits")
def split_factor_after(t):
    return pit.split_factor_after(t.splits, t.facts.select("symbol", "concept", "accn", "knowable_at"), "knowable_at")


@query("SELECT DISTINCT ticker FROM spans WHERE start_date <= DATE '1997-06-01' AND (end_date IS NULL OR end_date >= DATE '1997-06-01')", "spans")
def members_on_day(t):
    return pit.members_on(t.spans, "1997-06-01")


@query("SELECT DISTINCT ticker FROM spans WHERE start_date <= DATE '1999-12-31' AND coalesce(end_date, DATE '9999-12-31') >= DATE '1998-01-01'", "spans")
def ever_members(t):
    return pit.ever_members(t.spans, "1998-01-01", "1999-12-31")


@query("SELECT CAST(d AS DATE) AS snapshot FROM generate_series(DATE '1995-03-01', DATE '1996-11-20', INTERVAL 1 MONTH) g(d)")
def snapshot_dates(t):
    return pit.snapshot_dates(t.spark, "1995-03-17", "1996-11-20")


@query("SELECT symbol, CAST(sum(volume) AS BIGINT) AS total, CAST(row_number() OVER (ORDER BY sum(volume) DESC, symbol) AS INT) AS place FROM event_bars WHERE date >= DATE '2024-01-25' - 20 AND date < DATE '2024-01-25' GROUP BY symbol HAVING sum(volume) > 0 QUALIFY place <= 30", "event_bars")
def volume_universe(t):
    return pit.volume_universe(t.event_bars, "2024-01-25", 30, 20)


@query(f"""WITH {decisions_sql()}, f AS (SELECT symbol, date, 1 AS k, first_value(adj_close) OVER w AS a, last_value(adj_close) OVER w AS b, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 22 FOLLOWING))
SELECT d.as_of, d.symbol, round(CASE WHEN f.n >= 2 AND f.a > 0 THEN f.b / f.a - 1 END, 8) + 0.0 AS future FROM dec d ASOF JOIN f ON d.symbol = f.symbol AND d.as_of >= f.date""", "bars", "universe")  # fmt: skip
def lookahead_future_return(t):
    found = pit.lookup(pit.future_return(t.bars, 21).withColumn("known", F.lit(1)), decisions(t), ["symbol"], "date", "as_of", ["future", "known"])
    return rounded(found.where("known = 1").select("as_of", "symbol", "future"), "future")


# --- upserts and ingest ---------------------------------------------------------------------------


@query("""WITH n AS (SELECT symbol, date, open, high, low, close * 2 AS close, adj_close, volume + 1 AS volume, date + 1 AS knowable_at FROM bars WHERE volume % 3 = 0)
SELECT b.symbol, b.date, coalesce(n.close, b.close) AS close, coalesce(n.volume, b.volume) AS volume, b.knowable_at FROM bars b LEFT JOIN n USING (symbol, date)
UNION ALL SELECT 'NEW', DATE '2000-01-01', 2.0, 2, DATE '2000-01-01'""", "bars")  # fmt: skip
def upsert_bars(t):
    new = t.bars.where("volume % 3 = 0").withColumn("close", F.col("close") * 2).withColumn("volume", F.col("volume") + 1).withColumn("knowable_at", F.date_add("date", 1)).withColumn("seq", F.lit(1))
    fresh = t.spark.sql("SELECT 'NEW' AS symbol, date'2000-01-01' AS date, 1D AS open, 1D AS high, 1D AS low, 1D * id AS close, 1D AS adj_close, id AS volume, date'2000-01-01' AS knowable_at, id AS seq FROM range(1, 3)")
    return store.upsert(t.bars, new.unionByName(fresh), "bars").select("symbol", "date", "close", "volume", "knowable_at")


@query("SELECT symbol, concept, period_end, accn, CASE WHEN value > 0 THEN value * 10 ELSE value END AS value, CASE WHEN value > 0 THEN knowable_at + 5 ELSE knowable_at END AS knowable_at FROM facts", "facts")
def upsert_facts(t):
    new = t.facts.where("value > 0").withColumn("value", F.col("value") * 10).withColumn("knowable_at", F.date_add("knowable_at", 5)).withColumn("seq", F.lit(1))
    return store.upsert(t.facts, new, "facts").select("symbol", "concept", "period_end", "accn", "value", "knowable_at")


@query(f"WITH {NEWS_SQL}, u AS (SELECT DISTINCT symbol, published_at, content_hash, CASE WHEN symbol < 'Brand#2' THEN source || ' (corrected)' ELSE source END AS source, CASE WHEN symbol < 'Brand#2' THEN knowable_at + 1 ELSE knowable_at END AS knowable_at FROM n) SELECT * FROM u", "news")
def upsert_news(t):
    items = news_items(t).select("symbol", "published_at", "source", "headline", "body", "content_hash", "knowable_at")
    new = items.where("symbol < 'Brand#2'").withColumn("source", F.concat("source", F.lit(" (corrected)"))).withColumn("knowable_at", F.date_add("knowable_at", 1)).withColumn("seq", F.lit(1))
    return store.upsert(items, new, "news").select("symbol", "published_at", "content_hash", "source", "knowable_at")


@query("SELECT symbol, date, CASE WHEN ratio > 2 THEN ratio * 2 ELSE ratio END AS ratio, knowable_at FROM splits UNION ALL SELECT 'NEW', DATE '2001-02-03', 3.0::DOUBLE, DATE '2001-02-03'", "splits")
def upsert_splits(t):
    fresh = t.spark.sql("SELECT 'NEW' AS symbol, date'2001-02-03' AS date, 3D AS ratio, date'2001-02-03' AS knowable_at")
    new = t.splits.where("ratio > 2").withColumn("ratio", F.col("ratio") * 2).unionByName(fresh)
    return store.upsert(t.splits, new.withColumn("seq", F.lit(1)), "splits")


@query("SELECT effective, symbol, knowable_at FROM universe UNION SELECT DATE '1995-01-01', 'Brand#11', DATE '1995-01-01'", "universe")
def upsert_universe(t):
    new = t.spark.sql("SELECT date'1995-01-01' AS effective, 'Brand#11' AS symbol, date'1995-01-01' AS knowable_at, 1 AS seq")
    return store.upsert(t.universe, new, "universe").select("effective", "symbol", "knowable_at")


@query("""WITH r AS (SELECT DISTINCT p_brand AS symbol, CAST(substr(p_brand, 7) AS INT) AS k FROM part), s AS (SELECT CASE WHEN k % 7 = 0 THEN 'failed' WHEN k % 5 = 0 THEN 'empty' ELSE 'succeeded' END AS status FROM r)
SELECT status, count(*) AS symbols, count(*) / (SELECT count(*) FROM r) AS share FROM s GROUP BY status""")  # fmt: skip
def ingest_coverage(t):
    asked = t.raw("part").select(F.col("p_brand").alias("symbol"), F.expr("int(substr(p_brand, 7))").alias("k")).distinct()
    return store.ingest_report(asked, asked.where("k % 5 <> 0"), asked.where("k % 7 = 0"))


# --- scalars ----------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, round(least(greatest(l_quantity * 0.0035, 0.35), l_quantity * (l_extendedprice / l_quantity) * 0.01), 8) AS fee FROM lineitem")
def commission(t):
    lines = t.raw("lineitem")
    fee = scalars.commission(F.col("l_quantity"), F.col("l_extendedprice") / F.col("l_quantity"))
    return rounded(lines.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", fee.alias("fee")), "fee")


@query("SELECT DISTINCT lower(p_brand) || '.b' AS symbol, replace(lower(p_brand) || '.b', '.', '-') AS market, upper(replace(lower(p_brand) || '.b', '.', '-')) AS filing FROM part")
def ticker_normalise(t):
    symbol = F.concat(F.lower("p_brand"), F.lit(".b"))
    return t.raw("part").select(symbol.alias("symbol"), scalars.market_ticker(symbol).alias("market"), scalars.filing_ticker(symbol).alias("filing")).distinct()


@query("SELECT DISTINCT p_brand AS symbol, 'X' || upper(p_brand) || 'X' AS nav, TRUE AS nav_is_nav, FALSE AS symbol_is_nav FROM part")
def nav_symbol(t):
    nav = scalars.nav_symbol(F.col("p_brand"))
    return t.raw("part").select(F.col("p_brand").alias("symbol"), nav.alias("nav"), scalars.is_nav(nav).alias("nav_is_nav"), scalars.is_nav(F.col("p_brand")).alias("symbol_is_nav")).distinct()


@query("SELECT * FROM (VALUES ('DOTUSDT', FALSE), ('tusdUSDT', TRUE), ('DOTUPUSDT', TRUE), ('SYRUPUSDT', FALSE), ('XRPDOWNUSDT', TRUE), ('XRP5SUSDT', TRUE), ('XRP5MUSDT', FALSE), ('UPUSDT', FALSE), ('USDPUSDT', TRUE), ('S5LUSDT', TRUE), ('LUSDT', FALSE)) v(symbol, excluded)")
def leveraged_filter(t):
    names = "DOTUSDT tusdUSDT DOTUPUSDT SYRUPUSDT XRPDOWNUSDT XRP5SUSDT XRP5MUSDT UPUSDT USDPUSDT S5LUSDT LUSDT".split()
    return t.spark.createDataFrame([(n,) for n in names], "symbol string").select("symbol", scalars.stable_or_leveraged(F.col("symbol")).alias("excluded"))


@query("SELECT doc_id, sha256(coalesce(source, '') || '|' || coalesce(text, '') || '|' || coalesce(lang, '')) AS hash FROM documents")
def content_hash(t):
    return t.raw("documents").select("doc_id", scalars.content_hash(F.col("source"), F.col("text"), F.col("lang")).alias("hash"))


QUOTES = "SELECT symbol, date, CASE WHEN volume % 4 <> 0 THEN close END AS last, CASE WHEN volume % 3 <> 0 THEN low END AS bid, CASE WHEN volume % 5 <> 0 THEN CASE WHEN volume % 7 = 0 THEN low / 2 ELSE high END END AS ask FROM bars"


@query(f"SELECT symbol, date, CASE WHEN bid > 0 AND ask > 0 AND bid <= ask THEN (bid + ask) / 2 WHEN last > 0 THEN last END AS mid FROM ({QUOTES})", "bars")
def quote_mid(t):
    quotes = t.sql(QUOTES, "bars")
    return quotes.select("symbol", "date", scalars.quote_mid(F.col("last"), F.col("bid"), F.col("ask")).alias("mid"))


GAP_SQL = "SELECT *, CASE WHEN lag(close) OVER w > 0 AND open > 0 THEN open / lag(close) OVER w - 1 END AS gap FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)"
CANDLE_SQL = """c AS (SELECT symbol, date, open, high, low, close, abs(close - open) AS body, high - low AS rng, high - greatest(open, close) AS us, least(open, close) - low AS ls,
  lag(open) OVER w AS po, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
p AS (SELECT symbol, date,
  coalesce(rng <> 0 AND ph - pl <> 0 AND close > open AND pc < po AND least(open, close) <= least(po, pc) AND greatest(open, close) >= greatest(po, pc) AND po IS NOT NULL, FALSE) AS bullish_engulfing,
  coalesce(rng <> 0 AND ph - pl <> 0 AND close < open AND pc > po AND least(open, close) <= least(po, pc) AND greatest(open, close) >= greatest(po, pc) AND po IS NOT NULL, FALSE) AS bearish_engulfing,
  coalesce(rng <> 0 AND ls >= 2 * body AND us <= body AND pc > close, FALSE) AS hammer, coalesce(rng <> 0 AND us >= 2 * body AND ls <= body AND pc < close, FALSE) AS shooting_star,
  rng <> 0 AND body >= 0.90::DOUBLE * rng AND close > open AS marubozu, rng <> 0 AND body <= 0.05::DOUBLE * rng AS doji FROM c)"""  # fmt: skip
VOTES_SQL = "bullish_engulfing::INT - bearish_engulfing::INT + hammer::INT - shooting_star::INT + marubozu::INT"
PATTERNS = ("bullish_engulfing", "bearish_engulfing", "hammer", "shooting_star", "marubozu", "doji")


@query(f"SELECT symbol, date, round(gap, 8) + 0.0 AS gap FROM ({GAP_SQL})", "bars")
def overnight_gap(t):
    return rounded(signals.gaps(t.bars).select("symbol", "date", "gap"), "gap")


@query(f"WITH {CANDLE_SQL} SELECT symbol, date, {', '.join(PATTERNS)} FROM p", "bars")
def candle_patterns(t):
    return signals.patterns(t.bars).select("symbol", "date", *PATTERNS)


@query(f"WITH {CANDLE_SQL} SELECT symbol, date, CAST({VOTES_SQL} AS INT) AS votes FROM p", "bars")
def candle_votes(t):
    return signals.patterns(t.bars).select("symbol", "date", signals.votes().alias("votes"))


# --- signals ----------------------------------------------------------------------------------------

W = "WINDOW w AS (PARTITION BY symbol ORDER BY date)"
MOMENTUM_SQL = f"f AS (SELECT symbol, date, CASE WHEN lag(adj_close, 251) OVER w > 0 THEN lag(adj_close, 21) OVER w / lag(adj_close, 251) OVER w - 1 END AS v FROM bars {W})"
REVERSAL_SQL = f"f AS (SELECT symbol, date, CASE WHEN lag(adj_close, 4) OVER w > 0 THEN -(adj_close / lag(adj_close, 4) OVER w - 1) END AS v FROM bars {W})"
VOL_SQL = f"""r AS (SELECT symbol, date, adj_close, ln(adj_close / lag(adj_close) OVER w) AS r FROM bars {W}),
vol AS (SELECT symbol, date, CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) = 252 THEN stddev_samp(r) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 250 PRECEDING AND CURRENT ROW) * sqrt(252) END AS vol FROM r)"""  # fmt: skip


@query(signal_sql(MOMENTUM_SQL, 1), "bars", "universe")
def signal_momentum(t):
    return scored(signals.momentum(t.bars, decisions(t, 1)))


@query(signal_sql(REVERSAL_SQL), "bars", "universe")
def signal_reversal(t):
    return scored(signals.reversal(t.bars, decisions(t)))


@query(signal_sql(VOL_SQL + ", f AS (SELECT symbol, date, 1 / (1 + vol) AS v FROM vol)"), "bars", "universe")
def signal_lowvol(t):
    return scored(signals.low_volatility(t.bars, decisions(t)))


@query(signal_sql(f"g AS ({GAP_SQL}), f AS (SELECT symbol, date, CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) = 6 THEN avg(CASE WHEN abs(gap) >= 0.01 THEN gap END) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS v FROM g)"), "bars", "universe")
def signal_gap(t):
    return scored(signals.gap_continuation(t.bars, decisions(t)))


@query(signal_sql(CANDLE_SQL + f", f AS (SELECT symbol, date, CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 4 THEN sum({VOTES_SQL}) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / 3 END AS v FROM p)"), "bars", "universe")
def signal_candles(t):
    return scored(signals.candles(t.bars, decisions(t)))


@query(f"""WITH {decisions_sql()},
k AS (SELECT d.as_of, d.symbol, f.concept, f.knowable_at, f.value FROM dec d JOIN facts f ON d.symbol = f.symbol AND f.knowable_at <= d.as_of QUALIFY row_number() OVER (PARTITION BY d.as_of, d.symbol, f.concept ORDER BY f.knowable_at DESC, f.period_end DESC, f.accn DESC) = 1),
c AS (SELECT d.as_of, d.symbol, b.close FROM dec d ASOF JOIN bars b ON d.symbol = b.symbol AND d.as_of >= b.date),
j AS (SELECT c.as_of, c.symbol, c.close, ni.value AS ni, eq.value AS eq, sh.value AS sh, ni.knowable_at AS filed, sh.knowable_at AS sfiled FROM c JOIN k ni ON ni.as_of = c.as_of AND ni.symbol = c.symbol AND ni.concept = '{signals.NET_INCOME}'
  JOIN k eq ON eq.as_of = c.as_of AND eq.symbol = c.symbol AND eq.concept = '{signals.EQUITY}' JOIN k sh ON sh.as_of = c.as_of AND sh.symbol = c.symbol AND sh.concept = '{signals.SHARES}'),
m AS (SELECT j.as_of, j.symbol, ni, eq, close, sh, coalesce(product(s.ratio), 1.0) AS factor FROM j LEFT JOIN splits s ON s.symbol = j.symbol AND s.date > j.sfiled AND s.ratio > 0 WHERE j.as_of - j.filed <= 730 AND eq > 0 AND sh > 0 AND close > 0 GROUP BY ALL),
e AS (SELECT as_of, symbol, ni / (close * sh * factor) AS ey, ni / eq AS roe FROM m WHERE abs(ni / (close * sh * factor)) <= 1 AND abs(ni / eq) <= 3),
l AS (SELECT as_of, count(*) AS n, list_sort(list(ey)) AS le, list_sort(list(roe)) AS lr FROM e GROUP BY as_of),
w AS (SELECT e.as_of, symbol, CASE WHEN n < 3 THEN ey ELSE least(greatest(ey, le[round_even(0.05::DOUBLE * (n - 1), 0)::INT + 1]), le[round_even(0.95::DOUBLE * (n - 1), 0)::INT + 1]) END AS x,
  CASE WHEN n < 3 THEN roe ELSE least(greatest(roe, lr[round_even(0.05::DOUBLE * (n - 1), 0)::INT + 1]), lr[round_even(0.95::DOUBLE * (n - 1), 0)::INT + 1]) END AS y FROM e JOIN l USING (as_of)),
z AS (SELECT as_of, symbol, 0.5 * CASE WHEN stddev_samp(x) OVER d > 0 THEN (x - avg(x) OVER d) / stddev_samp(x) OVER d ELSE 0 END + 0.5 * CASE WHEN stddev_samp(y) OVER d > 0 THEN (y - avg(y) OVER d) / stddev_samp(y) OVER d ELSE 0 END AS v FROM w WINDOW d AS (PARTITION BY as_of))
SELECT dec.as_of, dec.symbol, round(coalesce(v, 0), 8) + 0.0 AS value, CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence FROM dec LEFT JOIN z ON z.as_of = dec.as_of AND z.symbol = dec.symbol""", "bars", "universe", "facts", "splits")  # fmt: skip
def signal_value_quality(t):
    t.keep("bars", "universe", "facts")
    return scored(signals.value_quality(t.facts, t.bars, t.splits, decisions(t)))


HITS = lambda words: " + ".join(f"contains(x, '{w}')::INT" for w in words)
JUDGED_SQL = f"{NEWS_SQL}, h AS (SELECT *, {HITS(scalars.POSITIVE)} AS up, {HITS(scalars.NEGATIVE)} AS down FROM (SELECT *, lower(headline || ' ' || body) AS x FROM n))"


@query(f"WITH {JUDGED_SQL} SELECT symbol, published_at, content_hash, CASE WHEN up + down > 0 THEN (up - down) / (up + down) ELSE 0 END::DOUBLE AS direction, CASE WHEN up + down > 0 THEN 0.5 ELSE 0 END::DOUBLE AS confidence FROM h", "news")
def classify_keywords(t):
    direction, confidence = scalars.keyword_direction(F.col("headline"), F.col("body"))
    return news_items(t).select("symbol", "published_at", "content_hash", direction.alias("direction"), confidence.alias("confidence"))


@query(f"""WITH {JUDGED_SQL}, s AS (SELECT DISTINCT symbol FROM bars), r AS (SELECT * FROM h WHERE knowable_at <= DATE '1998-08-01' AND symbol IN (SELECT symbol FROM s) ORDER BY published_at DESC, symbol, content_hash LIMIT (SELECT 5 * count(*) FROM s)),
m AS (SELECT symbol, sum((up - down) / (up + down) * 0.5) / sum(0.5) AS v FROM r WHERE DATE '1998-08-01' - knowable_at <= 7 AND up + down > 0 GROUP BY symbol)
SELECT DATE '1998-08-01' AS as_of, s.symbol, round(coalesce(v, 0), 8) + 0.0 AS value, CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence FROM s LEFT JOIN m USING (symbol)""", "bars", "news")  # fmt: skip
def signal_news(t):
    return scored(signals.news_sentiment(news_items(t), "1998-08-01", t.bars.select("symbol")))


CEF_SQL = """b AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM bars), q AS (SELECT symbol AS fund, date, close AS nav, row_number() OVER (PARTITION BY symbol ORDER BY date) AS m FROM nav),
j AS (SELECT b.symbol, b.date, b.close / q.nav - 1 AS d, n, m FROM b JOIN q ON q.fund = 'X' || upper(b.symbol) || 'X' AND b.date = q.date),
z AS (SELECT symbol, date, CASE WHEN count(*) OVER w = 252 AND n - first_value(n) OVER w = 251 AND m - first_value(m) OVER w = 251 AND stddev_samp(d) OVER w > 1e-12 THEN -(d - avg(d) OVER w) / stddev_samp(d) OVER w END AS v FROM j WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
f AS (SELECT b.symbol, b.date, z.v FROM b LEFT JOIN z ON z.symbol = b.symbol AND z.date = b.date)"""  # fmt: skip


@query(signal_sql(CEF_SQL), "bars", "universe", "nav")
def signal_cef_discount(t):
    return rounded(signals.cef_discount(t.bars, t.nav, decisions(t)), "value").select("as_of", "symbol", "value", "confidence")


def noise_sql(seed: str, symbol: str = "symbol") -> str:
    return f"CAST('0x' || substr(md5('{seed}|' || CAST(as_of AS VARCHAR) || '|' || {symbol}), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE * 2 - 1"


@query(f"WITH {decisions_sql()} SELECT as_of, symbol, round({noise_sql('7')}, 8) + 0.0 AS value, 1.0::DOUBLE AS confidence FROM dec", "bars", "universe")
def signal_random(t):
    return scored(signals.random_scores(decisions(t), 7))


@query(f"""WITH {decisions_sql()}, f AS (SELECT symbol, date, first_value(adj_close) OVER w AS a, last_value(adj_close) OVER w AS b, count(*) OVER w AS n FROM (SELECT symbol, date, adj_close FROM bars UNION ALL SELECT symbol, DATE '1900-01-01', NULL FROM bars GROUP BY symbol) WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 22 FOLLOWING)),
x AS (SELECT d.as_of, d.symbol, CASE WHEN f.n >= 2 AND f.a > 0 THEN f.b / f.a - 1 END AS future FROM dec d ASOF JOIN f ON d.symbol = f.symbol AND d.as_of >= f.date)
SELECT as_of, symbol, round(0.25::DOUBLE * future + 0.75::DOUBLE * ({noise_sql('3')}), 8) + 0.0 AS value, CASE WHEN future IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence FROM x""", "bars", "universe")  # fmt: skip
def signal_oracle(t):
    return scored(signals.oracle(t.bars, decisions(t), 0.25, 21, 3))


@query("SELECT date, CASE WHEN count(*) OVER w = 200 THEN round(adj_close - avg(adj_close) OVER w, 6) >= 0 END AS risk_on FROM bench WINDOW w AS (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)", "bench")
def trend_filter(t):
    return signals.trend(t.bench).select("date", "risk_on")


@query(f"WITH {decisions_sql()}, {VOL_SQL} SELECT d.as_of, d.symbol, round(v.vol, 8) AS vol FROM dec d ASOF JOIN vol v ON d.symbol = v.symbol AND d.as_of >= v.date WHERE v.vol IS NOT NULL", "bars", "universe")
def realised_vol(t):
    return rounded(signals.realised_vols(t.bars, decisions(t)), "vol").select("as_of", "symbol", "vol")


# --- ranks, weights, risk ---------------------------------------------------------------------------


def price_signals(t, *names: str):
    """Scores of the named price signals, or of all three from one look-up."""
    t.keep("bars", "universe")
    d, of = decisions(t), {"momentum": signals.momentum, "reversal": signals.reversal, "candles": signals.candles}
    found = {k: of[k](t.bars, d) for k in names} if names else signals.price_features(t.bars, d)
    return {k: scored(df) for k, df in found.items()}


def scores_sql(name: str, feature: str) -> str:
    return f"{name} AS ({signal_sql(feature)})"


MID = "(rank() OVER (PARTITION BY as_of ORDER BY value) - 1 + (count(*) OVER (PARTITION BY as_of, value) - 1) / 2) / nullif(count(*) OVER (PARTITION BY as_of) - 1, 0)"
SCORES_SQL = ", ".join([scores_sql("sm", MOMENTUM_SQL), scores_sql("sr", REVERSAL_SQL), scores_sql("sc", CANDLE_SQL + f", f AS (SELECT symbol, date, CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 4 THEN sum({VOTES_SQL}) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / 3 END AS v FROM p)")])


def average_sql(wm: float, wr: float, wc: float) -> str:
    part = lambda name, w: f"SELECT as_of, symbol, {w}::DOUBLE AS w, coalesce({MID}, 0.5) AS m FROM {name} WHERE confidence > 0"
    return f"""WITH {SCORES_SQL}, v AS ({part('sm', wm)} UNION ALL {part('sr', wr)} UNION ALL {part('sc', wc)}), a AS (SELECT as_of, symbol, sum(w * m) / sum(w) - 0.5 AS v FROM v GROUP BY ALL)
SELECT s.as_of, s.symbol, round(coalesce(a.v, 0), 8) + 0.0 AS value, CASE WHEN a.v IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence FROM sm s LEFT JOIN a ON a.as_of = s.as_of AND a.symbol = s.symbol"""


@query(f"WITH {SCORES_SQL} SELECT as_of, symbol, round(coalesce({MID}, 0.5), 8) AS midrank FROM sc WHERE confidence > 0", "bars", "universe")
def midrank(t):
    return rounded(portfolio.midrank(price_signals(t, "candles")["candles"], ["as_of"]).select("as_of", "symbol", "midrank"), "midrank")


@query(average_sql(1, 1, 1), "bars", "universe")
def rank_average(t):
    return scored(portfolio.rank_average(price_signals(t)))


@query(average_sql(2, 1, 0.5), "bars", "universe")
def rank_average_weighted(t):
    return scored(portfolio.rank_average(price_signals(t), {"momentum": 2, "candles": 0.5}))


@query(signal_sql(MOMENTUM_SQL), "bars", "universe")
def combine_single_passthrough(t):
    return scored(portfolio.combine({"momentum": price_signals(t, "momentum")["momentum"]}))


TOP_SQL = "SELECT as_of, symbol, value FROM sm WHERE confidence > 0 AND value > 0 QUALIFY row_number() OVER (PARTITION BY as_of ORDER BY value DESC, symbol) <= 10"
EQUAL_SQL = f"WITH {scores_sql('sm', MOMENTUM_SQL)}, top AS ({TOP_SQL})"


@query(f"{EQUAL_SQL} SELECT as_of, symbol, round(1.0::DOUBLE / count(*) OVER (PARTITION BY as_of), 8) AS weight FROM top", "bars", "universe")
def topn_equal_weight(t):
    return rounded(portfolio.equal_weights(price_signals(t, "momentum")["momentum"], 10), "weight")


@query(f"""{EQUAL_SQL}, {VOL_SQL}, k AS (SELECT t.as_of, t.symbol, v.vol FROM top t ASOF LEFT JOIN vol v ON t.symbol = v.symbol AND t.as_of >= v.date),
i AS (SELECT as_of, symbol, 1 / coalesce(CASE WHEN vol > 0 THEN vol END, median(CASE WHEN vol > 0 THEN vol END) OVER (PARTITION BY as_of), 1) AS x FROM k)
SELECT as_of, symbol, round(x / sum(x) OVER (PARTITION BY as_of), 8) AS weight FROM i""", "bars", "universe")  # fmt: skip
def topn_inverse_vol(t):
    return rounded(portfolio.inverse_vol_weights(price_signals(t, "momentum")["momentum"], signals.realised_vols(t.bars, decisions(t)), 10), "weight")


RAW_TARGETS = "SELECT effective AS as_of, symbol, CAST(CAST(substr(symbol, 7) AS INT) % 5 - 1 AS DOUBLE) / 8 AS weight FROM universe"


@query(f"""WITH r AS ({RAW_TARGETS}), k AS (SELECT * FROM r WHERE weight > 0 QUALIFY row_number() OVER (PARTITION BY as_of ORDER BY weight DESC, symbol) <= 8), c AS (SELECT as_of, symbol, least(weight, 0.20::DOUBLE) AS w FROM k)
SELECT as_of, symbol, round(CASE WHEN sum(w) OVER (PARTITION BY as_of) > 1 THEN w / sum(w) OVER (PARTITION BY as_of) ELSE w END, 8) AS weight FROM c""", "universe")  # fmt: skip
def risk_gate_stateless(t):
    return rounded(portfolio.reduce_targets(t.sql(RAW_TARGETS, "universe"), portfolio.RiskLimits(max_positions=8)), "weight")


STATES = "SELECT symbol, date, date AS today, CAST(date - INTERVAL (volume % 7) DAY AS DATE) AS data_as_of, volume % 11 = 0 AS halted, CASE WHEN volume % 22 = 0 THEN 'manual' END AS reason, volume % 13 <> 0 AS reconciled, CASE WHEN volume % 17 = 0 THEN 0 ELSE close END AS equity, open * 1.02 AS previous, high * (1 + (volume % 9) / 20) AS peak FROM bars"


@query(f"""WITH s AS ({STATES}), r AS (SELECT *, CASE WHEN halted THEN coalesce(reason, 'halted') WHEN NOT reconciled THEN 'unreconciled' WHEN today - data_as_of > 4 THEN 'stale' WHEN equity <= 0 THEN 'no-equity'
WHEN previous > 0 AND equity / previous - 1 <= -0.05 THEN 'daily-loss' WHEN peak > 0 AND equity / peak - 1 <= -0.25 THEN 'drawdown' END AS why FROM s)
SELECT symbol, date, why AS reason, round(CASE why WHEN 'stale' THEN today - data_as_of WHEN 'no-equity' THEN equity WHEN 'daily-loss' THEN equity / previous - 1 WHEN 'drawdown' THEN equity / peak - 1 END, 8) + 0.0 AS figure FROM r""", "bars")  # fmt: skip
def risk_gate_halts(t):
    states = t.sql(STATES.replace("INTERVAL (volume % 7) DAY", "make_dt_interval(int(volume % 7))"), "bars")
    reason, figure = portfolio.halt()
    return rounded(states.select("symbol", "date", reason.alias("reason"), figure.alias("figure")), "figure")


# --- books ------------------------------------------------------------------------------------------

HELD = "SELECT symbol, CAST(sum(volume) % 50 AS DOUBLE) AS shares FROM bars GROUP BY symbol HAVING CAST(substr(symbol, 7) AS INT) % 3 <> 0"
WANTED = "SELECT DISTINCT symbol, 0.06D AS weight FROM bars WHERE CAST(substr(symbol, 7) AS INT) % 4 <> 0"
PRICES = "SELECT symbol, max(close) AS price FROM bars WHERE CAST(substr(symbol, 7) AS INT) % 11 <> 0 GROUP BY symbol"
ACTUAL = "SELECT symbol, CAST(sum(volume) % 50 + CASE WHEN CAST(substr(symbol, 7) AS INT) % 5 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS shares FROM bars GROUP BY symbol HAVING CAST(substr(symbol, 7) AS INT) % 7 <> 0"


@query(f"""WITH h AS ({HELD}), w AS ({WANTED.replace('0.06D', '0.06::DOUBLE')}), p AS ({PRICES}), d AS (SELECT symbol, price, coalesce(weight, 0) * 10000 / price - coalesce(shares, 0) AS delta FROM h FULL JOIN w USING (symbol) JOIN p USING (symbol) WHERE price > 0)
SELECT CAST(row_number() OVER (ORDER BY delta > 0, symbol) AS INT) AS place, symbol, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, round(abs(delta), 8) AS shares FROM d WHERE abs(delta * price) >= 1""", "bars")  # fmt: skip
def order_diff(t):
    return rounded(books.order_diff(t.sql(HELD, "bars"), t.sql(WANTED, "bars"), t.sql(PRICES, "bars"), 10_000.0), "shares")


@query(f"""WITH e AS ({HELD}), a AS ({ACTUAL}), j AS (SELECT symbol, e.shares AS e, a.shares AS a FROM e FULL JOIN a USING (symbol))
SELECT CASE WHEN e IS NULL THEN 'unexpected' WHEN a IS NULL THEN 'missing' ELSE 'shares' END AS kind, symbol, coalesce(e, 0)::DOUBLE AS expected, coalesce(a, 0)::DOUBLE AS actual FROM j WHERE e IS NULL OR a IS NULL OR abs(e - a) > 1e-4
UNION ALL SELECT 'cash', '', 100.0::DOUBLE, 99.5::DOUBLE""", "bars")  # fmt: skip
def reconcile_breaks(t):
    return books.reconcile(t.sql(HELD, "bars"), t.sql(ACTUAL, "bars"), 100.0, 99.5)


@query(f"""WITH h AS ({HELD}), p AS ({PRICES}) SELECT round(500 + coalesce(sum(shares * price), 0), 6) AS value, count(price) AS priced, string_agg(CASE WHEN price IS NULL THEN symbol END, ',' ORDER BY symbol) AS missing FROM h LEFT JOIN p USING (symbol)""", "bars")
def mark_book(t):
    found = books.mark_book(t.sql(HELD, "bars"), t.sql(PRICES, "bars"), 500.0)
    return rounded(found.withColumn("missing", F.concat_ws(",", "missing")), "value", places=6)


@query("""SELECT user_id, arg_min(value, ts) AS first, arg_max(value, ts) AS last, round(arg_max(value, ts) - arg_min(value, ts), 8) + 0.0 AS pnl, round(CASE WHEN arg_min(value, ts) = 0 THEN 0 ELSE (arg_max(value, ts) - arg_min(value, ts)) / arg_min(value, ts) END, 8) + 0.0 AS pct, count(*) AS samples, count(*) FILTER (event_type = 'click') AS regular_samples FROM events GROUP BY user_id""")
def session_summary(t):
    samples = t.raw("events").select("user_id", F.col("ts").alias("at"), "value", F.when(F.col("event_type") == "click", "REGULAR").otherwise("CLOSED").alias("state"))
    return rounded(books.session_summary(samples, ["user_id"]), "pnl", "pct")


# --- evaluation -------------------------------------------------------------------------------------


def hold_sql(table: str, name: str, price: str = "close") -> str:
    """Curve of holding the benchmark over its whole span."""
    fee = "least(greatest(0.0035 * (10000 / entry), 0.35), 0.01 * (10000 / entry) * entry)"
    return f"{name} AS (SELECT date, (10000 - {fee}) / entry * {price} AS equity FROM {table}, (SELECT arg_min(open, date) AS entry FROM {table}))"


HOLD_SQL = hold_sql("bench", "h")
RETURNS_SQL = "x AS (SELECT date, equity, equity / nullif(lag(equity) OVER (ORDER BY date), 0) - 1 AS r, max(equity) OVER (ORDER BY date) AS peak FROM h)"
SPAN = ("1900-01-01", "2100-01-01")


def hold(t):
    return evaluate.buy_and_hold(t.bench, *SPAN)


def other_curve(t):
    """A strategy to compare: the mean of all closes on a date, on the benchmark's dates that are no tenth."""
    return t.bars.groupBy("date").agg(F.avg("close").alias("equity")).where("dayofmonth(date) % 10 <> 0")


OTHER_SQL = "o AS (SELECT date, avg(close) AS equity FROM bars WHERE day(date) % 10 <> 0 GROUP BY date)"
ALIGNED_SQL = f"{HOLD_SQL}, {OTHER_SQL}, j AS (SELECT date, o.equity AS l, h.equity AS r FROM o JOIN h USING (date)), y AS (SELECT * FROM (SELECT date, l / lag(l) OVER (ORDER BY date) - 1 AS a, r / lag(r) OVER (ORDER BY date) - 1 AS b FROM j) WHERE a IS NOT NULL)"


@query(f"WITH {HOLD_SQL} SELECT date, round(equity, 6) AS equity FROM h", "bench")
def buy_and_hold(t):
    return rounded(hold(t), "equity", places=6)


@query(f"""WITH {HOLD_SQL}, {RETURNS_SQL}, g AS (SELECT arg_min(equity, date) AS a, arg_max(equity, date) AS b, max(date) - min(date) AS days, avg(r) AS m, stddev_samp(r) AS s, min(equity / peak - 1) AS dd FROM x)
SELECT 'MKT' AS run, round(b / a - 1, 8) AS total_return, round(pow(b / a, 1 / (days / 365.25::DOUBLE)) - 1, 8) AS cagr, round(m / s * sqrt(252), 8) AS sharpe, round(dd, 8) AS max_drawdown FROM g""", "bench")  # fmt: skip
def equity_metrics(t):
    return rounded(evaluate.metrics(hold(t).withColumn("run", F.lit("MKT")), ["run"]), "total_return", "cagr", "sharpe", "max_drawdown")


@query(f"WITH {HOLD_SQL}, {RETURNS_SQL} SELECT date, round(peak, 6) AS peak, round(equity / peak - 1, 8) + 0.0 AS drawdown FROM x", "bench")
def max_drawdown(t):
    return rounded(rounded(evaluate.drawdown(hold(t).withColumn("run", F.lit("MKT")), ["run"]).select("date", "peak", "drawdown"), "drawdown"), "peak", places=6)


@query(f"WITH {ALIGNED_SQL} SELECT date, round(a, 8) + 0.0 AS r_left, round(b, 8) + 0.0 AS r_right FROM y", "bench", "bars")
def align_returns(t):
    return rounded(evaluate.aligned_returns(other_curve(t), hold(t)), "r_left", "r_right")


@query(f"""WITH {ALIGNED_SQL}, s AS (SELECT count(*) AS n, covar_samp(a, b) / var_samp(b) AS beta, avg(a) AS ma, avg(b) AS mb, avg(a - b) AS m, stddev_samp(a - b) AS s FROM y)
SELECT round((ma - beta * mb) * 252, 6) AS alpha_annual, round(beta, 6) AS beta, round(m * 252 / (s * sqrt(252)), 6) AS information_ratio, round(s * sqrt(252), 6) AS tracking_error, round(m * 252, 6) AS active_return, n AS n_days FROM s""", "bench", "bars")  # fmt: skip
def attribution(t):
    found = evaluate.attribution(evaluate.aligned_returns(other_curve(t), hold(t)))
    return rounded(found, "alpha_annual", "beta", "information_ratio", "tracking_error", "active_return", places=6)


@query(f"WITH {ALIGNED_SQL} SELECT round(corr(a, b), 8) AS correlation, 0.0::DOUBLE AS flat FROM y", "bench", "bars")
def guarded_correlation(t):
    returns = evaluate.aligned_returns(other_curve(t), hold(t)).withColumn("same", F.lit(0.01))
    return rounded(returns.agg(evaluate.guarded_correlation("r_left", "r_right").alias("correlation"), evaluate.guarded_correlation("r_left", "same").alias("flat")), "correlation")


BAR_RETURNS = "SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM bars"


def bar_returns(t):
    return t.sql(f"SELECT * FROM ({BAR_RETURNS}) WHERE r IS NOT NULL", "bars")


@query(f"WITH r AS (SELECT * FROM ({BAR_RETURNS}) WHERE r IS NOT NULL) SELECT a.symbol AS \"left\", b.symbol AS \"right\", round(corr(a.r, b.r), 6) + 0.0 AS correlation, count(*) AS n FROM r a JOIN r b ON a.date = b.date AND a.symbol < b.symbol GROUP BY ALL", "bars")
def pairwise_correlation(t):
    return rounded(evaluate.pairwise_correlation(bar_returns(t)), "correlation", places=6)


@query(f"""WITH r AS (SELECT * FROM ({BAR_RETURNS}) WHERE r IS NOT NULL), v AS (SELECT symbol, stddev_samp(r) * sqrt(252) AS vol FROM r GROUP BY symbol), p AS (SELECT stddev_samp(m) * sqrt(252) AS pv FROM (SELECT date, avg(r) AS m FROM r GROUP BY date))
SELECT round(avg(vol) / max(pv), 6) AS diversification_ratio FROM v, p""", "bars")  # fmt: skip
def diversification_ratio(t):
    returns = bar_returns(t)
    vols = returns.groupBy("symbol").agg((F.stddev_samp("r") * 252**0.5).alias("vol"))
    n = F.count("*").over(pit.Window.partitionBy(F.lit(1)))
    weights = returns.select("symbol").distinct().withColumn("weight", 1 / n)
    book = returns.groupBy("date").agg(F.avg("r").alias("m")).agg((F.stddev_samp("m") * 252**0.5).alias("pv"))
    return rounded(evaluate.diversification_ratio(weights.crossJoin(F.broadcast(book)), vols, F.col("pv")), "diversification_ratio", places=6)


@query(f"""WITH {HOLD_SQL}, p AS (SELECT date, equity * (1 + (day(date) % 3) / 1000) AS equity FROM h), j AS (SELECT date, p.equity AS l, h.equity AS r FROM p JOIN h USING (date)), y AS (SELECT date, l, r, l / lag(l) OVER (ORDER BY date) - 1 AS a, r / lag(r) OVER (ORDER BY date) - 1 AS b FROM j),
g AS (SELECT corr(a, b) AS c, arg_max(l, date) / arg_min(l, date) - arg_max(r, date) / arg_min(r, date) AS d, count(a) AS n FROM y)
SELECT round(c, 6) AS correlation, round(d, 6) + 0.0 AS cumulative_diff, n, c >= 0.90 AND abs(d) <= 0.03 AS passed FROM g""", "bench")  # fmt: skip
def papercheck(t):
    paper = hold(t).select("date", (F.col("equity") * (1 + F.dayofmonth("date") % 3 / 1000)).alias("equity"), F.lit(2).alias("seq"))
    stale = paper.withColumn("equity", F.lit(1.0)).withColumn("seq", F.lit(1))
    return rounded(evaluate.papercheck(paper.unionByName(stale), hold(t)), "correlation", "cumulative_diff", places=6)


@query("""SELECT * FROM (VALUES ('research', DATE '1993-01-01', DATE '1994-04-06'), ('research', DATE '1994-04-07', DATE '1995-07-12'), ('research', DATE '1995-07-13', DATE '1996-10-16'), ('research', DATE '1996-10-17', DATE '1998-01-22'), ('holdout', DATE '1998-01-23', DATE '1999-04-30')) v(kind, "start", "end")""")
def walk_windows(t):
    return t.spark.createDataFrame(evaluate.walk_windows(dt.date(1993, 1, 1), dt.date(1999, 4, 30)), "kind string, start date, end date")


# --- backtests and studies (rows only; tests hold the fold against a plain one) ---------------------


def span(t) -> tuple[dt.date, dt.date]:
    """First and last date; bars are written first, as what asks for a span reads them many times."""
    t.keep("bars", "universe")
    row = t.bars.agg(F.min("date"), F.max("date")).first()
    return row[0], row[1]


def backtest(t, scorers: studies.Signals, settings: Settings = Settings(), **options) -> DataFrame:
    runs = studies.runs_frame(t.spark, [("all", *span(t))])
    calendar = t.bars.select("date").distinct()
    targets = studies.targets_of(runs, t.bars, t.bench, t.universe, scorers, **options)
    return studies.equity_of(simulate(runs, calendar, t.bars, targets, settings))


def momentum_of(t) -> studies.Signals:
    return {"momentum": lambda d: signals.momentum(t.bars, d)}


@query()
def backtest_momentum(t):
    return backtest(t, momentum_of(t))


@query()
def backtest_invvol(t):
    return backtest(t, momentum_of(t), weighting="invvol")


@query()
def backtest_regime(t):
    return backtest(t, momentum_of(t), regime=200)


@query()
def backtest_risk_gate(t):
    return backtest(t, momentum_of(t), Settings(limits=portfolio.RiskLimits(), cash_buffer=0.02))


@query()
def backtest_multi_signal(t):
    return backtest(t, momentum_of(t) | {"reversal": lambda d: signals.reversal(t.bars, d), "lowvol": lambda d: signals.low_volatility(t.bars, d)})


@query()
def walk_forward_verdict(t):
    runs, windows = studies.window_runs(t.spark, ["momentum"], *span(t))
    targets = studies.targets_of(runs, t.bars, t.bench, t.universe, momentum_of(t))
    folded = simulate(runs, t.bars.select("date").distinct(), t.bars, targets)
    return studies.studied(runs, windows, folded, t.bench, ["name"])


def seeded(t, names: list[str], score) -> DataFrame:
    runs, windows = studies.window_runs(t.spark, names, *span(t))
    targets = studies.seeded_targets(runs, windows, t.bars, t.universe, score)
    folded = simulate(runs, t.bars.select("date").distinct(), t.bars, targets)
    return studies.studied(runs, windows, folded, t.bench, ["name"])


@query()
def placebo_study(t):
    """Thirty seeds of noise over the windows of a walk-forward, in one job."""
    score = lambda d: d.withColumn("value", scalars.noise(F.col("name"), F.col("as_of"), F.col("symbol"))).withColumn("confidence", F.lit(1.0))
    return seeded(t, [str(k) for k in range(30)], score)


@query()
def power_study(t):
    """Foresight of growing strength, to see where the gate notices it."""

    def score(d: DataFrame) -> DataFrame:
        ahead = signals.future_of(t.bars, d.select("as_of", "symbol").distinct(), 21)
        return signals.blended(d.join(ahead, ["as_of", "symbol"]), F.col("name").cast("double"), 0)

    return seeded(t, ["0.0", "0.05", "0.1", "0.25", "0.5", "1.0"], score)


# --- parsers ----------------------------------------------------------------------------------------


def payloads(t, rows: list[tuple], schema: str) -> DataFrame:
    return t.spark.createDataFrame(rows, schema)


CHART_JSON = '{"chart":{"result":[{"timestamp":[852076800,852163200,852249600],"indicators":{"quote":[{"open":[10,11,null],"high":[12,13,14],"low":[9,10,11],"close":[11,12,13],"volume":[100,200,300]}],"adjclose":[{"adjclose":[10.5,11.5,12.5]}]}}]}}'


@query("SELECT * FROM (VALUES ('AAA', DATE '1997-01-01', 10.0::DOUBLE, 11.0::DOUBLE, 10.5::DOUBLE, 100::BIGINT), ('AAA', DATE '1997-01-02', 11.0, 12.0, 11.5, 200)) v(symbol, date, open, close, adj_close, volume)")
def parse_chart_json(t):
    return parsers.chart_bars(payloads(t, [("AAA", CHART_JSON), ("BBB", "{}"), ("CCC", None)], "symbol string, payload string")).select("symbol", "date", "open", "close", "adj_close", "volume")


@query("SELECT * FROM (VALUES ('AAA', DATE '1997-01-01', 4.0::DOUBLE), ('AAA', DATE '1997-01-02', 10.0)) v(symbol, date, ratio)")
def parse_splits_json(t):
    body = '{"chart":{"result":[{"events":{"splits":{"1":{"date":852076800,"numerator":4,"denominator":1},"2":{"date":852163200,"numerator":10,"denominator":1},"3":{"date":852163200,"numerator":1,"denominator":0}}}}]}}'
    return parsers.chart_splits(payloads(t, [("AAA", body)], "symbol string, payload string"))


@query("SELECT * FROM (VALUES ('AAA', 'NetIncomeLoss', DATE '2025-09-30', 5.0::DOUBLE, DATE '2025-11-01', 'a1'), ('AAA', 'NetIncomeLoss', DATE '2025-09-30', 7.0, DATE '2025-11-02', 'a3')) v(symbol, concept, period_end, value, knowable_at, accn)")
def parse_edgar_json(t):
    body = '{"units":{"USD":[{"start":"2024-10-01","end":"2025-09-30","val":5,"accn":"a1","filed":"2025-11-01"},{"start":"2025-07-01","end":"2025-09-30","val":2,"accn":"a2","filed":"2025-11-01"},{"end":"2025-09-30","val":7,"accn":"a3","filed":"2025-11-02"},{"end":"2025-09-30","val":8,"accn":"a4"}]}}'
    return parsers.concept_facts(payloads(t, [("AAA", "NetIncomeLoss", body)], "symbol string, concept string, payload string"))


@query("SELECT * FROM (VALUES ('BTCUSDT', DATE '1997-01-01', 1.5::DOUBLE, 2.5::DOUBLE, 100::BIGINT)) v(symbol, date, open, close, volume)")
def parse_klines(t):
    body = '[[852076800000,"1.5","3","1","2.5","100.5"],[852163200000,"x","3","1","2","1"],[852163200000,"0","3","1","2","1"],[1,"2"],[]]'
    return parsers.klines(payloads(t, [("BTCUSDT", body)], "symbol string, payload string")).select("symbol", "date", "open", "close", "volume")


@query("SELECT * FROM (VALUES ('AAL', DATE '1996-01-02', DATE '1997-01-15'), ('AAL', DATE '2015-03-23', NULL), ('BRK.B', DATE '2010-02-16', NULL)) v(ticker, start_date, end_date)")
def parse_membership_csv(t):
    rows = [("AAL", "1996-01-02", "1997-01-15"), (" AAL ", "2015-03-23", ""), ("BRK.B", "2010-02-16", "open"), ("", "2010-01-01", ""), ("ZZZ", "soon", "")]
    return parsers.membership(payloads(t, rows, "ticker string, start_date string, end_date string"))


@query("SELECT 'AAA' AS symbol, 'Up' AS headline, 'src' AS source, sha256('AAA|Up') AS content_hash")
def parse_news_json(t):
    body = '{"news":[{"title":"Up","publisher":"src","providerPublishTime":"1700000000"},{"title":"Old","publisher":"src","providerPublishTime":"1600000000"},{"title":null,"providerPublishTime":"1700000000"},{"title":"Bad","providerPublishTime":"x"}]}'
    return parsers.news_items(payloads(t, [("AAA", body)], "symbol string, payload string"), "2023-11-15 00:00:00").select("symbol", "headline", "source", "content_hash")


@query("SELECT * FROM (VALUES ('AAA', 10.0::DOUBLE, 9.5::DOUBLE, 10.5::DOUBLE, 'REGULAR')) v(symbol, last, bid, ask, state)")
def parse_quote_json(t):
    meta = lambda text: f'{{"chart":{{"result":[{{"meta":{text}}}]}}}}'
    return parsers.quotes(payloads(t, [("AAA", meta('{"regularMarketPrice":10,"bid":9.5,"ask":10.5,"marketState":"REGULAR"}')), ("BBB", meta('{"bid":0}')), ("CCC", "junk")], "symbol string, payload string"))


# --- operations -------------------------------------------------------------------------------------

JOURNAL = "SELECT row_number() OVER (ORDER BY (CAST(date_part('day', date) AS INT) * 7) % 31, date) AS seq, date AS as_of, close AS equity, volume % 10 = 0 AS halted FROM bench"


@query(f"""WITH j AS ({JOURNAL}) SELECT count(*) AS records, arg_max(as_of, seq) AS last_as_of, arg_max(equity, seq) AS last_equity, round(arg_max(equity, as_of) / arg_min(equity, as_of) - 1, 8) AS total_return, count(*) FILTER (halted) AS halted_days FROM j""", "bench")
def journal_state(t):
    journal = t.sql(JOURNAL, "bench").withColumn("vetoes", F.when(F.col("halted"), F.array(F.lit("halted"))).otherwise(F.array().cast("array<string>")))
    return rounded(store.journal_state(journal), "total_return")


@query("SELECT 'U' || user_id AS symbol, CAST(ts AS DATE) AS date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY ALL")
def daily_bars_from_ticks(t):
    return ticks.daily_bars(t.raw("events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), "ts", "value"))


@query("SELECT * FROM (VALUES ('ABC', 320193::BIGINT), ('DE-F', 51)) v(symbol, cik)")
def parse_ticker_map(t):
    body = '{"0":{"ticker":" abc ","cik_str":320193},"1":{"ticker":"De-f","cik_str":"51"},"2":{"ticker":"GHI","cik_str":null},"3":{"ticker":"JKL","cik_str":"x1"}}'
    return parsers.ticker_map(payloads(t, [(body,)], "payload string"))


ACCOUNT_JSON = '{"cash": 250.5, "positions": {"ABC": 3, "DEF": {"shares": 2.5, "average_cost": 9}, "GHI": "none", "JKL": {"cost": 1}}}'


@query("SELECT * FROM (VALUES ('ABC', 3.0::DOUBLE, 250.5::DOUBLE), ('DEF', 2.5, 250.5)) v(symbol, shares, cash)")
def parse_account_json(t):
    one = payloads(t, [(ACCOUNT_JSON,)], "payload string")
    # One row.
    return parsers.account(one).crossJoin(F.broadcast(parsers.account_cash(one)))


@query("SELECT * FROM (VALUES ('AAA', 10.0::DOUBLE, 'REGULAR'), ('BBB', NULL, 'CLOSED'), ('CCC', NULL, 'UNKNOWN'), ('DDD', NULL, 'UNKNOWN')) v(symbol, price, state)")
def parse_intraday_json(t):
    meta = lambda text: f'{{"chart":{{"result":[{{"meta":{text}}}]}}}}'
    rows = [("AAA", meta('{"regularMarketPrice":10,"marketState":"REGULAR"}')), ("BBB", meta('{"regularMarketPrice":-1,"marketState":"CLOSED"}')), ("CCC", "junk"), ("DDD", None)]
    return parsers.intraday(payloads(t, rows, "symbol string, payload string"))


@query("SELECT * FROM (VALUES ('DOTUSDT'), ('XLMUSDT')) v(symbol)")
def tradable_pairs(t):
    pair = lambda name, quote="USDT", status="TRADING", spot="true": f'{{"symbol":"{name}","quoteAsset":"{quote}","status":"{status}","isSpotTradingAllowed":{spot}}}'
    listed = [pair("XLMUSDT"), pair("DOTUSDT"), pair("DOTBTC", "BTC"), pair("OLDUSDT", status="BREAK"), pair("MARUSDT", spot="false"), pair("USDCUSDT"), pair("DOTUPUSDT")]
    return parsers.tradable_pairs(payloads(t, [('{"symbols":[' + ",".join(listed) + "]}",), ("",)], "payload string"))


@query("SELECT DISTINCT p_brand AS symbol FROM part UNION SELECT DISTINCT 'X' || upper(p_brand) || 'X' FROM part")
def funds_with_navs(t):
    funds = t.raw("part").agg(F.collect_set("p_brand").alias("funds"))  # a brand a fund
    return funds.select(F.explode(scalars.with_navs(F.col("funds"))).alias("symbol"))


POLLS = "SELECT CAST(event_id AS BIGINT) AS place, event_type AS state FROM events"


@query(f"SELECT state FROM (SELECT state, count(*) AS n, min(place) AS seen FROM ({POLLS}) GROUP BY state) ORDER BY n DESC, seen LIMIT 1")
def modal_market_state(t):
    return books.modal_state(t.raw("events").select(F.col("event_id").cast("long").alias("place"), F.col("event_type").alias("state")))


@query(f"WITH {JUDGED_SQL}, c AS (SELECT DISTINCT content_hash FROM n WHERE symbol < 'Brand#2') SELECT content_hash, 9.0::DOUBLE AS direction, 1.0::DOUBLE AS confidence FROM c UNION ALL SELECT DISTINCT content_hash, CASE WHEN up + down > 0 THEN (up - down) / (up + down) ELSE 0 END::DOUBLE, CASE WHEN up + down > 0 THEN 0.5 ELSE 0 END::DOUBLE FROM h WHERE content_hash NOT IN (SELECT content_hash FROM c)", "news")
def classify_unseen(t):
    items = news_items(t)
    cache = items.where("symbol < 'Brand#2'").select("content_hash", F.lit(9.0).alias("direction"), F.lit(1.0).alias("confidence")).distinct()
    return store.classify(items, cache)


@query(f"WITH r AS (SELECT * FROM ({BAR_RETURNS}) WHERE r IS NOT NULL), p AS (SELECT a.symbol AS x, b.symbol AS y, corr(a.r, b.r) AS c, count(*) AS n FROM r a JOIN r b ON a.date = b.date AND a.symbol < b.symbol GROUP BY ALL) SELECT round(avg(c), 6) + 0.0 AS mean_correlation, count(*) AS n_pairs FROM p", "bars")
def mean_pairwise_correlation(t):
    return rounded(evaluate.mean_correlation(bar_returns(t)), "mean_correlation", places=6)


@query(f"""WITH h AS ({HELD}), a AS ({ACTUAL}), j AS (SELECT symbol, h.shares AS e, a.shares AS a FROM h FULL JOIN a USING (symbol))
SELECT symbol, CASE WHEN e IS NULL THEN 'unexpected' WHEN a IS NULL THEN 'missing' ELSE 'shares' END || ' ' || symbol || ': expected ' || printf('%.4f', coalesce(e, 0)::DOUBLE) || ', broker has ' || printf('%.4f', coalesce(a, 0)::DOUBLE) AS line FROM j WHERE e IS NULL OR a IS NULL OR abs(e - a) > 1e-4""", "bars")  # fmt: skip
def describe_breaks(t):
    return books.reconcile(t.sql(HELD, "bars"), t.sql(ACTUAL, "bars")).select("symbol", books.describe().alias("line"))


@query(f"SELECT symbol, date, round(close * CASE WHEN volume % 2 = 0 THEN 1.00025::DOUBLE ELSE 0.99975::DOUBLE END, 8) AS fill FROM bars", "bars")
def spread_fill(t):
    return rounded(t.bars.select("symbol", "date", scalars.fill_price(F.col("close"), F.col("volume") % 2 == 0, 5.0).alias("fill")), "fill")


def _with_plan(name: str, f) -> None:
    QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))


_with_plan("placebo_summary", lambda t: studies.summary(placebo_study(t)))
_with_plan("placebo_histogram", lambda t: studies.histogram(placebo_study(t)))


@query()
def correlation_probe(t):
    """DG1: mean pairwise correlation and diversification of what momentum picks at its last decisions, beside what noise picks."""
    t.keep("bars", "universe")
    return studies.correlation_probe(t.bars, decisions(t, 63), {"momentum": lambda d: signals.momentum(t.bars, d), "random": lambda d: signals.random_scores(d, 1)})
