"""Equity curves: metrics, attribution, correlation, drawdown, gates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintage.functions import scalars
from vintage.operators import pit

YEAR = 252
EDGE, MAJORITY, HOLDOUT = 0.30, 0.50, 0.20
PAPER_CORRELATION, PAPER_DIFFERENCE, EPSILON = 0.90, 0.03, 1e-12


def buy_and_hold(bench: DataFrame, first: str, last: str, cash: float = 10_000.0) -> DataFrame:
    """(date, equity) of holding the benchmark: bought at the open of the latest bar on the first trading date, a fee on the gross shares, no spread."""
    dates = pit.trading_dates(bench, first, last)
    start = dates.agg(F.min("date").alias("start"))
    entry = bench.join(F.broadcast(start), bench["date"] <= F.col("start")).groupBy("start").agg(F.max_by("open", "date").alias("entry"))
    gross = F.lit(cash) / F.col("entry")
    entry = entry.select("entry", ((F.lit(cash) - scalars.commission(gross, F.col("entry"))) / F.col("entry")).alias("shares"))
    # One row of entry price and shares.
    held = bench.where(F.col("date").between(first, last)).crossJoin(F.broadcast(entry))
    return held.select("date", (F.col("shares") * F.col("close")).alias("equity"))


def drawdown(curve: DataFrame, by: list[str]) -> DataFrame:
    """curve with peak (the highest equity so far) and drawdown."""
    peak = F.max("equity").over(Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return curve.withColumn("peak", peak).withColumn("drawdown", F.when(F.col("peak") > 0, F.col("equity") / F.col("peak") - 1).otherwise(0.0))


def metrics(curve: DataFrame, by: list[str]) -> DataFrame:
    """total_return, cagr, sharpe and max_drawdown for each curve (by, date, equity); a curve of under two points or a non-positive start has zeros."""
    return measured(curve, by).drop("n_dates")


def measured(curve: DataFrame, by: list[str]) -> DataFrame:
    """metrics and n_dates, the points of the curve, from one pass over it."""
    before = F.lag("equity").over(Window.partitionBy(*by).orderBy("date"))
    whole = drawdown(curve, by).withColumn("r", F.when(before > 0, F.col("equity") / before - 1))
    found = whole.groupBy(*by).agg(
        F.min_by("equity", "date").alias("first"), F.max_by("equity", "date").alias("last"), F.datediff(F.max("date"), F.min("date")).alias("days"),
        F.count("*").alias("n"), F.count("r").alias("n_r"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.min("drawdown").alias("dd"),
    )
    usable = (F.col("n") >= 2) & (F.col("first") > 0)
    years = F.greatest("days", F.lit(1)) / 365.25
    safe = F.when(usable, F.col("first"))
    grown = F.when(F.col("last") > 0, F.pow(F.col("last") / safe, 1 / years) - 1).otherwise(-1.0)
    sharpe = F.when((F.col("n_r") >= 2) & (F.col("sd") > 0), F.try_divide("mean", "sd") * YEAR**0.5).otherwise(0.0)
    zero = lambda c: F.when(usable, c).otherwise(0.0)
    return found.select(*by, zero(F.col("last") / safe - 1).alias("total_return"), zero(grown).alias("cagr"), zero(sharpe).alias("sharpe"), zero(F.least("dd", F.lit(0.0))).alias("max_drawdown"), F.col("n").alias("n_dates"))


def aligned_returns(left: DataFrame, right: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, date, r_left, r_right) over the dates both curves have, where both were positive before."""
    by = by or []
    both = left.select(*by, "date", F.col("equity").alias("l")).join(right.select(*by, "date", F.col("equity").alias("r")), [*by, "date"])
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("date")
    pl, pr = F.lag("l").over(w), F.lag("r").over(w)
    out = both.select(*by, "date", F.when((pl > 0) & (pr > 0), F.col("l") / pl - 1).alias("r_left"), F.when((pl > 0) & (pr > 0), F.col("r") / pr - 1).alias("r_right"))
    return out.where("r_left IS NOT NULL AND r_right IS NOT NULL")


def attribution(returns: DataFrame, by: list[str] | None = None) -> DataFrame:
    """alpha_annual, beta, information_ratio, tracking_error, active_return, n_days of r_left against r_right; under three days zeros."""
    active = F.col("r_left") - F.col("r_right")
    found = returns.groupBy(*(by or [])).agg(
        F.count("*").alias("n_days"), F.covar_samp("r_left", "r_right").alias("cov"), F.var_samp("r_right").alias("var"), F.avg(F.col("r_right") * F.col("r_right")).alias("square"),
        F.avg("r_left").alias("ml"), F.avg("r_right").alias("mr"), F.avg(active).alias("ma"), F.stddev_samp(active).alias("sa"),
    )
    beta = F.when(F.col("var") > EPSILON * F.greatest(F.lit(1.0), F.col("square")), F.try_divide("cov", "var")).otherwise(0.0)
    enough = F.col("n_days") >= 3
    zero = lambda c: F.when(enough, c).otherwise(0.0)
    error = F.col("sa") * YEAR**0.5
    return found.withColumn("b", beta).select(
        *(by or []), zero((F.col("ml") - F.col("b") * F.col("mr")) * YEAR).alias("alpha_annual"), zero(F.col("b")).alias("beta"), zero(F.when(error > EPSILON, F.try_divide(F.col("ma") * YEAR, error)).otherwise(0.0)).alias("information_ratio"),
        zero(error).alias("tracking_error"), zero(F.col("ma") * YEAR).alias("active_return"), "n_days",
    )


def guarded_correlation(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; 0 for under two pairs or where one side hardly varies."""
    flat = lambda c: F.var_pop(c) <= EPSILON * F.greatest(F.lit(1.0), F.avg(F.col(c) * F.col(c)))
    scale = F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    return F.when((F.count("*") < 2) | flat(x) | flat(y), 0.0).otherwise(F.coalesce(F.try_divide(F.covar_pop(x, y), scale), F.lit(0.0)))


def pairwise_correlation(returns: DataFrame) -> DataFrame:
    """(left, right, correlation) of every pair of symbols that vary, over their common dates; returns are (symbol, date, r).

    The pairs are of a universe of symbols, a stated set, not of rows.
    """
    varying = returns.groupBy("symbol").agg(F.countDistinct("r").alias("n")).where("n > 1").select("symbol")
    own = returns.join(varying, "symbol", "left_semi")
    a, b = own.select("date", F.col("symbol").alias("left"), F.col("r").alias("x")), own.select("date", F.col("symbol").alias("right"), F.col("r").alias("y"))
    return a.join(b, "date").where(F.col("left") < F.col("right")).groupBy("left", "right").agg(guarded_correlation("x", "y").alias("correlation"), F.count("*").alias("n"))


def mean_correlation(returns: DataFrame) -> DataFrame:
    pairs = pairwise_correlation(returns)
    return pairs.agg(F.when((F.count("*") > 0) & (F.min("n") >= 2), F.avg("correlation")).alias("mean_correlation"), F.count("*").alias("n_pairs"))


def diversification_ratio(weights: DataFrame, vols: DataFrame, portfolio_vol: Column | float) -> DataFrame:
    """Weighted mean vol over the portfolio's; null if that isn't positive or a weight has no vol."""
    pvol = portfolio_vol if isinstance(portfolio_vol, Column) else F.lit(portfolio_vol)
    joined = weights.join(vols, "symbol", "left")
    ratio = F.when((F.max(pvol) > 0) & ~F.bool_or(F.col("vol").isNull()), F.sum(F.col("weight") * F.col("vol")) / F.nullif(F.max(pvol), F.lit(0.0)))
    return joined.agg(F.when(~F.isnan(ratio), ratio).alias("diversification_ratio"))


def papercheck(paper: DataFrame, backtest: DataFrame) -> DataFrame:
    """correlation, cumulative_diff, n and passed of a paper curve (date, seq, equity; the last written of a date counts) against a backtest's."""
    last = paper.groupBy("date").agg(F.max_by("equity", "seq").alias("equity"))
    both = last.select("date", F.col("equity").alias("l")).join(backtest.select("date", F.col("equity").alias("r")), "date")
    ends = both.agg(F.min_by("l", "date").alias("l0"), F.max_by("l", "date").alias("l1"), F.min_by("r", "date").alias("r0"), F.max_by("r", "date").alias("r1"))
    correlation = aligned_returns(last, backtest).agg(guarded_correlation("r_left", "r_right").alias("correlation"), F.count("*").alias("n"))
    # One row each.
    joined = correlation.crossJoin(ends).withColumn("cumulative_diff", F.col("l1") / F.col("l0") - F.col("r1") / F.col("r0"))
    return joined.select("correlation", "cumulative_diff", "n", ((F.col("correlation") >= PAPER_CORRELATION) & (F.abs("cumulative_diff") <= PAPER_DIFFERENCE)).alias("passed"))


def calendar_windows(start: dt.date, end: dt.date, n: int) -> list[tuple[dt.date, dt.date]]:
    """n contiguous windows of nearly equal length; the last ends on end."""
    days = (end - start).days
    if n <= 0 or days < 0 or days < n:
        raise ValueError("too short a span for so many windows")
    cuts = [start + dt.timedelta(days=k * days // n) for k in range(n + 1)]
    return [(a, end if k == n - 1 else b - dt.timedelta(days=1)) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def walk_windows(start: dt.date, end: dt.date, n: int = 4, holdout: float = HOLDOUT) -> list[tuple[str, dt.date, dt.date]]:
    """(kind, start, end): n research windows, then the holdout at the end."""
    if not 0 < holdout < 1:
        raise ValueError("holdout must lie between 0 and 1")
    days = round((end - start).days * holdout)
    begin = end - dt.timedelta(days=days)
    research_end = begin - dt.timedelta(days=1)
    out = [("research", a, b) for a, b in calendar_windows(start, research_end, n)] if research_end >= start else []
    return out + [("holdout", begin, end)] * (days > 0)


def verdicts(windows: DataFrame, strategy: DataFrame, benchmark: DataFrame, by: list[str]) -> DataFrame:
    """One row for each of by: a window passes with an edge in Sharpe of EDGE and no deeper drawdown; the gate with most research windows and the holdout.

    windows (run, kind, window), strategy and benchmark are measured by run; a window fails where either curve has under two dates.
    """
    s = strategy.select("run", F.col("sharpe").alias("s"), F.col("max_drawdown").alias("sd"), F.col("n_dates").alias("s_dates"))
    b = benchmark.select("run", F.col("sharpe").alias("b"), F.col("max_drawdown").alias("bd"), F.col("n_dates").alias("b_dates"))
    one = windows.join(s, "run", "left").join(b, "run", "left")
    one = one.withColumn("edge", F.col("s") - F.col("b")).withColumn("passed", F.coalesce((F.col("s_dates") >= 2) & (F.col("b_dates") >= 2) & (F.col("edge") >= EDGE) & (F.col("sd") >= F.col("bd")), F.lit(False)))
    research = F.col("kind") == "research"
    return one.groupBy(*by).agg(
        F.count_if(research & F.col("passed")).alias("research_passed"), F.count_if(research).alias("research_total"),
        F.max(F.when(~research, F.col("edge"))).alias("holdout_edge"), F.coalesce(F.bool_or(F.when(~research, F.col("passed"))), F.lit(False)).alias("holdout_passed"),
    ).withColumn("gate_passed", (F.col("research_passed") > MAJORITY * F.col("research_total")) & F.col("holdout_passed"))
