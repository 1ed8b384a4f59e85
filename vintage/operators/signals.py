"""Cross-sectional signals for all decision dates at once.

A signal is a rolling feature of each bar, looked up as of every decision
(as_of, symbol). The result is (as_of, symbol, value, confidence): confidence 1,
or 0 and value 0 where there is too little history to have an opinion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintage.functions import scalars
from vintage.operators import pit

NET_INCOME, EQUITY, SHARES = "NetIncomeLoss", "StockholdersEquity", "WeightedAverageNumberOfDilutedSharesOutstanding"
DAYS_A_YEAR = 252


def _series(keep: int | None = None):
    w = Window.partitionBy("symbol").orderBy("date")
    return w if keep is None else w.rowsBetween(-(keep - 1), 0)


def _opinion(decisions: DataFrame, features: DataFrame) -> DataFrame:
    """features (symbol, date, value) looked up at each decision; null is no opinion."""
    found = pit.lookup(features.select("symbol", "date", F.struct(F.col("value").cast("double").alias("v")).alias("opinion")), decisions.select("symbol", "as_of"), ["symbol"], "date", "as_of", ["opinion"])
    value = F.col("opinion.v")
    return found.select("as_of", "symbol", F.coalesce(value, F.lit(0.0)).alias("value"), F.when(value.isNotNull(), 1.0).otherwise(0.0).alias("confidence"))


def momentum(bars: DataFrame, decisions: DataFrame, lookback: int = 252, skip: int = 21) -> DataFrame:
    """Return over lookback bars up to skip bars ago."""
    if skip >= lookback:
        raise ValueError("skip must be under lookback")
    w = _series()
    start = F.lag("adj_close", lookback - 1).over(w)
    return _opinion(decisions, bars.select("symbol", "date", F.when(start > 0, F.lag("adj_close", skip).over(w) / start - 1).alias("value")))


def reversal(bars: DataFrame, decisions: DataFrame, lookback: int = 5) -> DataFrame:
    """The last bars' return, turned round."""
    if lookback < 2:
        raise ValueError("lookback must be at least 2")
    start = F.lag("adj_close", lookback - 1).over(_series())
    return _opinion(decisions, bars.select("symbol", "date", F.when(start > 0, -(F.col("adj_close") / start - 1)).alias("value")))


def volatility(bars: DataFrame, lookback: int = 252) -> DataFrame:
    """(symbol, date, vol): annualised deviation of log returns over lookback closes; null for fewer, or where one isn't positive."""
    logs = bars.select("symbol", "date", "adj_close", F.when(F.lag("adj_close").over(_series()) > 0, F.ln(F.when(F.col("adj_close") > 0, F.col("adj_close")) / F.lag("adj_close").over(_series()))).alias("r"))
    whole = (F.count("*").over(_series(lookback)) == lookback) & (F.min("adj_close").over(_series(lookback)) > 0)
    return logs.select("symbol", "date", F.when(whole, F.stddev_samp("r").over(_series(lookback - 1)) * DAYS_A_YEAR**0.5).alias("vol"))


def low_volatility(bars: DataFrame, decisions: DataFrame, lookback: int = 252) -> DataFrame:
    return _opinion(decisions, volatility(bars, lookback).select("symbol", "date", (1 / (1 + F.col("vol"))).alias("value")))


def realised_vols(bars: DataFrame, decisions: DataFrame, lookback: int = 252) -> DataFrame:
    """(as_of, symbol, vol) where it is known."""
    found = _opinion(decisions, volatility(bars, lookback).withColumnRenamed("vol", "value"))
    return found.where("confidence > 0").select("as_of", "symbol", F.col("value").alias("vol"))


def gaps(bars: DataFrame) -> DataFrame:
    return bars.withColumn("gap", scalars.overnight_gap(F.lag("close").over(_series()), F.col("open")))


def gap_continuation(bars: DataFrame, decisions: DataFrame, lookback: int = 5, least: float = 0.01) -> DataFrame:
    """The mean of the last gaps that are large enough."""
    large = F.when(F.abs("gap") >= least, F.col("gap"))
    whole = F.count("*").over(_series(lookback + 1)) == lookback + 1
    return _opinion(decisions, gaps(bars).select("symbol", "date", F.when(whole, F.avg(large).over(_series(lookback))).alias("value")))


def patterns(bars: DataFrame) -> DataFrame:
    """bars with the candle patterns of each with its predecessor; a bar without range has none."""
    w = _series()
    before = {c: F.lag(c).over(w) for c in ("open", "high", "low", "close")}
    was, now = scalars.candle(*(before[c] for c in ("open", "high", "low", "close"))), scalars.candle(*(F.col(c) for c in ("open", "high", "low", "close")))
    low, high = F.least("open", "close"), F.greatest("open", "close")
    covers = (low <= F.least(before["open"], before["close"])) & (high >= F.greatest(before["open"], before["close"]))
    ranged, both = now["range"] != 0, (now["range"] != 0) & (was["range"] != 0)
    found = {
        "bullish_engulfing": both & now["up"] & was["down"] & covers,
        "bearish_engulfing": both & now["down"] & was["up"] & covers,
        "hammer": ranged & (now["lower"] >= 2 * now["body"]) & (now["upper"] <= now["body"]) & (before["close"] > F.col("close")),
        "shooting_star": ranged & (now["upper"] >= 2 * now["body"]) & (now["lower"] <= now["body"]) & (before["close"] < F.col("close")),
        "marubozu": ranged & (now["body"] >= 0.90 * now["range"]) & now["up"],
        "doji": ranged & (now["body"] <= 0.05 * now["range"]),
    }
    return bars.select("*", *(F.coalesce(c, F.lit(False)).alias(k) for k, c in found.items()))


def votes() -> Column:
    one = lambda c: F.col(c).cast("int")
    return one("bullish_engulfing") - one("bearish_engulfing") + one("hammer") - one("shooting_star") + one("marubozu")


def candles(bars: DataFrame, decisions: DataFrame, lookback: int = 3) -> DataFrame:
    voted = patterns(bars).withColumn("votes", votes())
    whole = F.count("*").over(_series(lookback + 1)) == lookback + 1
    return _opinion(decisions, voted.select("symbol", "date", F.when(whole, F.sum("votes").over(_series(lookback)) / lookback).alias("value")))


def price_features(bars: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """momentum, reversal and candles with their usual spans, from one pass over the bars and one look-up."""
    w, voted = _series(), patterns(bars).withColumn("votes", votes())
    start, recent = F.lag("adj_close", 251).over(w), F.lag("adj_close", 4).over(w)
    whole = F.count("*").over(_series(4)) == 4
    values = {
        "momentum": F.when(start > 0, F.lag("adj_close", 21).over(w) / start - 1),
        "reversal": F.when(recent > 0, -(F.col("adj_close") / recent - 1)),
        "candles": F.when(whole, F.sum("votes").over(_series(3)) / 3),
    }
    held = F.struct(*(v.cast("double").alias(k) for k, v in values.items()))
    found = pit.lookup(voted.select("symbol", "date", held.alias("opinions")), decisions.select("symbol", "as_of"), ["symbol"], "date", "as_of", ["opinions"])
    of = lambda k: F.col(f"opinions.{k}")
    return {k: found.select("as_of", "symbol", F.coalesce(of(k), F.lit(0.0)).alias("value"), F.when(of(k).isNotNull(), 1.0).otherwise(0.0).alias("confidence")) for k in values}


def cef_discount(prices: DataFrame, navs: DataFrame, decisions: DataFrame, lookback: int = 252) -> DataFrame:
    """How far a fund's discount to its net asset value lies below its mean, in deviations.

    Both sides' last lookback dates must be the same: the places of a common
    date counted from the start then differ by a constant over the whole
    window, and the last date of both is the same.
    """
    if lookback < 30:
        raise ValueError("lookback must be at least 30")
    own, other = Window.partitionBy("symbol").orderBy("date"), Window.partitionBy("fund").orderBy("date")
    left = prices.select("symbol", "date", "close", F.row_number().over(own).alias("n"))
    right = navs.withColumnRenamed("symbol", "fund").select("fund", "date", F.col("close").alias("nav"), F.row_number().over(other).alias("m"))
    both = left.join(right, (scalars.nav_symbol(left["symbol"]) == right["fund"]) & (left["date"] == right["date"]), "inner").select("symbol", left["date"], "close", "nav", "n", "m")
    w = _series(lookback)
    discount = F.when((F.col("close") > 0) & (F.col("nav") > 0), F.try_divide("close", "nav") - 1)
    both = both.withColumn("discount", discount)
    same = (F.count("discount").over(w) == lookback) & (F.col("n") - F.first("n").over(w) == lookback - 1) & (F.col("m") - F.first("m").over(w) == lookback - 1)
    deviation = F.stddev_samp("discount").over(w)
    scored = both.select("symbol", "date", F.when(same & (deviation > 1e-12), -(F.col("discount") - F.avg("discount").over(w)) / deviation).alias("z"))
    # The signal stands while neither side has a later bar.
    dates = prices.select("symbol", "date").union(navs.select(F.expr("substr(symbol, 2, length(symbol) - 2)").alias("upper"), "date").join(prices.select("symbol").distinct().withColumn("upper", F.upper("symbol")), "upper").select("symbol", "date")).distinct()
    features = dates.join(scored, ["symbol", "date"], "left").select("symbol", "date", F.col("z").alias("value"))
    return _opinion(decisions, features)


def _winsorised(values: DataFrame, *columns: str) -> DataFrame:
    """values with columns clipped within as_of at the nearest-rank 5 % and 95 %; under three values nothing is clipped.

    Each row learns its rank; the two rows at the cuts give the bounds, which
    every row of the day reads from a window aggregate: a row holds no list.
    """
    day = Window.partitionBy("as_of")
    n = F.count("*").over(day)
    out = values
    for c in columns:
        place = F.row_number().over(day.orderBy(c, "symbol")) - 1
        out = out.withColumn("_place", place).withColumn("_n", n)
        bound = lambda q: F.max(F.when(F.col("_place") == F.bround(q * (F.col("_n") - 1), 0), F.col(c))).over(day)  # noqa: B023, E731
        out = out.withColumn("_low", bound(0.05)).withColumn("_high", bound(0.95))
        out = out.withColumn(c, F.when(F.col("_n") < 3, F.col(c)).otherwise(F.least(F.greatest(c, "_low"), "_high")))
    return out.drop("_place", "_n", "_low", "_high")


def value_quality(facts: DataFrame, bars: DataFrame, splits: DataFrame, decisions: DataFrame, max_age: int = 730) -> DataFrame:
    """Half the z of earnings yield, half that of return on equity, among symbols whose figures are usable."""
    found = pit.fundamentals_calendar(facts, decisions)
    of = lambda concept, *cols: found.where(F.col("concept") == concept).select("as_of", "symbol", *cols)
    income = of(NET_INCOME, F.col("value").alias("income"), F.col("filed").alias("filed"))
    equity, shares = of(EQUITY, F.col("value").alias("equity")), of(SHARES, F.col("value").alias("shares"), F.col("filed").alias("shares_filed"))
    close = pit.lookup(bars, decisions.select("symbol", "as_of"), ["symbol"], "date", "as_of", ["close"])
    all_ = income.join(equity, ["as_of", "symbol"]).join(shares, ["as_of", "symbol"]).join(close, ["as_of", "symbol"])
    all_ = all_.where((F.datediff("as_of", "filed") <= max_age) & (F.col("equity") > 0) & (F.col("shares") > 0) & (F.col("close") > 0))
    all_ = pit.split_factor_after(splits, all_, "shares_filed")
    all_ = all_.withColumn("ey", F.col("income") / (F.col("close") * F.col("shares") * F.col("factor"))).withColumn("roe", F.col("income") / F.col("equity"))
    kept = all_.where((F.abs("ey") <= 1.0) & (F.abs("roe") <= 3.0)).select("as_of", "symbol", "ey", "roe")
    clipped = _winsorised(kept, "ey", "roe")
    day = Window.partitionBy("as_of")
    z = lambda c: F.when(F.stddev_samp(c).over(day) > 0, (F.col(c) - F.avg(c).over(day)) / F.stddev_samp(c).over(day)).otherwise(0.0)
    scored = clipped.select("as_of", "symbol", (0.5 * z("ey") + 0.5 * z("roe")).alias("v"))
    joined = decisions.select("as_of", "symbol").join(scored, ["as_of", "symbol"], "left")
    return joined.select("as_of", "symbol", F.coalesce("v", F.lit(0.0)).alias("value"), F.when(F.col("v").isNotNull(), 1.0).otherwise(0.0).alias("confidence"))


def news_sentiment(items: DataFrame, as_of: str, symbols: DataFrame, per_symbol: int = 5, max_age: int = 7) -> DataFrame:
    """Confidence-weighted direction of the recent items among the newest per_symbol times the number of symbols."""
    asked = symbols.select("symbol").distinct()
    n = asked.count()
    direction, confidence = scalars.keyword_direction(F.col("headline"), F.col("body"))
    recent = pit.news(items.join(asked, "symbol", "left_semi"), as_of, per_symbol * n).where(F.datediff(F.lit(as_of).cast("date"), "knowable_at") <= max_age)
    judged = recent.select("symbol", direction.alias("d"), confidence.alias("c")).where("c > 0")
    mean = judged.groupBy("symbol").agg((F.sum(F.col("d") * F.col("c")) / F.sum("c")).alias("v"))
    joined = asked.join(mean, "symbol", "left")
    return joined.select(F.lit(as_of).cast("date").alias("as_of"), "symbol", F.coalesce("v", F.lit(0.0)).alias("value"), F.when(F.col("v").isNotNull(), 1.0).otherwise(0.0).alias("confidence"))


def random_scores(decisions: DataFrame, seed: int) -> DataFrame:
    """Noise, from the decision alone: it never reads a price."""
    return decisions.select("as_of", "symbol", scalars.noise(seed, F.col("as_of"), F.col("symbol")).alias("value"), F.lit(1.0).alias("confidence"))


def future_of(bars: DataFrame, decisions: DataFrame, horizon: int = 21) -> DataFrame:
    """LOOKAHEAD, for studies of the gate only: (as_of, symbol, future) of each decision, also of symbols without a bar yet."""
    # Bars ahead of a decision: of the last bar before it the frame of the next ones; before all bars, of a mark at the start.
    first = bars.groupBy("symbol").agg(F.date_sub(F.min("date"), 1).alias("date")).select("symbol", "date", F.lit(None).cast("double").alias("adj_close"))
    ahead = pit.future_return(bars.select("symbol", "date", "adj_close").unionByName(first), horizon)
    marks = decisions.select("symbol", "as_of")
    early = marks.join(first.select("symbol", F.col("date").alias("start")), "symbol", "left").select("symbol", "as_of", F.greatest("as_of", "start").alias("at"))
    return pit.lookup(ahead, early, ["symbol"], "date", "at", ["future"]).select("as_of", "symbol", "future")


def blended(known: DataFrame, strength: Column, seed: int) -> DataFrame:
    """known (as_of, symbol, future and others) with value, a blend of the future and noise, and confidence in place of the future; null without a future."""
    value = strength * F.col("future") + (1 - strength) * scalars.noise(seed, F.col("as_of"), F.col("symbol"))
    return known.withColumn("value", value).withColumn("confidence", F.when(F.col("future").isNotNull(), 1.0).otherwise(0.0)).drop("future")


def oracle(bars: DataFrame, decisions: DataFrame, strength: float, horizon: int = 21, seed: int = 0) -> DataFrame:
    """The blended signal, to measure whether the gate would notice foresight."""
    if not 0 <= strength <= 1:
        raise ValueError("strength must lie in [0, 1]")
    return blended(future_of(bars, decisions, horizon), F.lit(float(strength)), seed)


def trend(bench: DataFrame, lookback: int = 200) -> DataFrame:
    """(date, risk_on) of the benchmark: adjusted close at or over its mean; null before lookback bars."""
    if lookback <= 0:
        raise ValueError("lookback must be positive")
    w = _series(lookback)
    return bench.select("date", F.when(F.count("*").over(w) == lookback, F.col("adj_close") >= F.avg("adj_close").over(w)).alias("risk_on"))
