"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PER_SHARE, LEAST_FEE, MOST_SHARE = 0.0035, 0.35, 0.01

# Symbols and endings of coins and leveraged tokens.
STABLE_COINS = "USDC FDUSD TUSD BUSD DAI USDP USDD PYUSD EURI USDT".split()
REAL_UP_DOWN = "JUP SYRUP PUMP UP DOWN".split()

# Words that move a headline's direction.
POSITIVE = "beat raise upgrade record growth profit buyback dividend win surge jump".split()
NEGATIVE = "miss cut downgrade loss lawsuit fraud recall layoff plunge drop investigation".split()


def commission(shares: Column, price: Column) -> Column:
    """Tiered fee: a rate a share within a least fee and a share of the notional; nothing for nothing; negative input fails."""
    fee = F.least(F.greatest(shares * PER_SHARE, F.lit(LEAST_FEE)), shares * price * MOST_SHARE)
    return F.when((shares < 0) | (price < 0), F.raise_error(F.lit("negative shares or price"))).when((shares == 0) | (price == 0), 0.0).otherwise(fee).cast("double")


def fill_price(price: Column, buy: Column, spread_bps: float) -> Column:
    half = spread_bps / 20_000
    return price * F.when(buy, 1 + half).otherwise(1 - half)


def overnight_gap(previous_close: Column, open_: Column) -> Column:
    return F.when((previous_close > 0) & (open_ > 0), open_ / previous_close - 1)


def quote_mid(last: Column, bid: Column, ask: Column) -> Column:
    both = (bid > 0) & (ask > 0) & (bid <= ask)
    return F.when(both, (bid + ask) / 2).when(last > 0, last)


def market_ticker(symbol: Column) -> Column:
    return F.replace(symbol, F.lit("."), F.lit("-"))


def filing_ticker(symbol: Column) -> Column:
    return F.upper(F.replace(symbol, F.lit("."), F.lit("-")))


def nav_symbol(symbol: Column) -> Column:
    return F.concat(F.lit("X"), F.upper(symbol), F.lit("X"))


def is_nav(symbol: Column) -> Column:
    return (F.length(symbol) >= 3) & symbol.startswith("X") & symbol.endswith("X")


def with_navs(funds: Column) -> Column:
    """The fund symbols of an array with those of their net asset values, sorted."""
    return F.array_sort(F.array_distinct(F.concat(funds, F.transform(funds, nav_symbol))))


def stable_or_leveraged(symbol: Column) -> Column:
    base = F.upper(F.regexp_replace(symbol, "USDT$", ""))
    up_down = (base.endswith("UP") | base.endswith("DOWN")) & ~base.isin(REAL_UP_DOWN)
    return base.isin(STABLE_COINS) | up_down | base.rlike("[0-9][LS]$")


def content_hash(*parts: Column) -> Column:
    """sha256 of the parts joined by a bar; a null part counts as empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def noise(seed, as_of: Column, symbol: Column) -> Column:
    """Uniform on [-1, 1] from an md5 prefix of seed|as_of|symbol."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws("|", seed.cast("string"), as_of.cast("string"), symbol)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / 4294967295.0 * 2 - 1


def keyword_direction(headline: Column, body: Column) -> tuple[Column, Column]:
    """(direction, confidence): hits of positive less negative words over all hits, each word once as a substring."""
    text = F.lower(F.concat_ws(" ", headline, body))
    hits = lambda words: sum((text.contains(w).cast("int") for w in words), F.lit(0))
    up, down = hits(POSITIVE), hits(NEGATIVE)
    return F.when(up + down > 0, (up - down) / (up + down)).otherwise(0.0), F.when(up + down > 0, 0.5).otherwise(0.0)


def parse_reply(reply: Column) -> Column:
    """A classifier's reply: the outermost braces as JSON, direction within [-1, 1], confidence within [0, 1]; else nothing and zero."""
    found = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "direction double, confidence double, rationale string")
    ok = found["direction"].isNotNull() & found["confidence"].isNotNull()
    within = lambda c, low, high: F.least(F.greatest(c, F.lit(low)), F.lit(high))
    good = F.struct(within(found["direction"], -1.0, 1.0).alias("direction"), within(found["confidence"], 0.0, 1.0).alias("confidence"), F.substring(F.coalesce(found["rationale"], F.lit("")), 1, 200).alias("rationale"))
    return F.when(ok, good).otherwise(F.struct(F.lit(0.0).alias("direction"), F.lit(0.0).alias("confidence"), F.lit("unparseable reply").alias("rationale")))


def candle(open_: Column, high: Column, low: Column, close: Column) -> dict[str, Column]:
    return {"body": F.abs(close - open_), "range": high - low, "upper": high - F.greatest(open_, close), "lower": F.least(open_, close) - low, "up": close > open_, "down": close < open_}
