"""Positions: order differences, reconciliation, marks, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARE_TOLERANCE, CASH_TOLERANCE, LEAST_TRADE = 1e-4, 0.01, 1.0


def order_diff(held: DataFrame, targets: DataFrame, prices: DataFrame, investable: Column | float) -> DataFrame:
    """Orders (place, symbol, side, shares) from held (symbol, shares) to targets (symbol, weight): sells first, then by symbol; dust and unpriced names are left."""
    money = investable if isinstance(investable, Column) else F.lit(float(investable))
    both = held.join(targets, "symbol", "full_outer").join(prices, "symbol")
    delta = F.coalesce("weight", F.lit(0.0)) * money / F.col("price") - F.coalesce("shares", F.lit(0.0))
    moved = both.where("price > 0").withColumn("delta", delta).where(F.abs(F.col("delta") * F.col("price")) >= LEAST_TRADE)
    orders = moved.select("symbol", F.when(F.col("delta") > 0, "BUY").otherwise("SELL").alias("side"), F.abs("delta").alias("shares"))
    # One row a symbol of a book.
    return orders.select(F.row_number().over(Window.orderBy(F.desc("side"), "symbol")).alias("place"), "symbol", "side", "shares")


def reconcile(believed: DataFrame, actual: DataFrame, believed_cash: float | None = None, actual_cash: float | None = None) -> DataFrame:
    """Breaks (kind, symbol, expected, actual) between believed and the broker's positions (symbol, shares)."""
    both = believed.select("symbol", F.col("shares").alias("e")).join(actual.select("symbol", F.col("shares").alias("a")), "symbol", "full_outer")
    kind = F.when(F.col("e").isNull(), "unexpected").when(F.col("a").isNull(), "missing").when(F.abs(F.col("e") - F.col("a")) > SHARE_TOLERANCE, "shares")
    out = both.select(kind.alias("kind"), "symbol", F.coalesce("e", F.lit(0.0)).alias("expected"), F.coalesce("a", F.lit(0.0)).alias("actual")).where("kind IS NOT NULL")
    if believed_cash is not None and abs(believed_cash - actual_cash) > CASH_TOLERANCE:
        cash = believed.sparkSession.createDataFrame([("cash", "", float(believed_cash), float(actual_cash))], out.schema)
        out = out.unionByName(cash)
    return out


def describe(kind: str = "kind") -> Column:
    return F.format_string("%s %s: expected %.4f, broker has %.4f", F.col(kind), F.col("symbol"), F.col("expected"), F.col("actual"))


def mark_book(positions: DataFrame, prices: DataFrame, cash: float) -> DataFrame:
    """value, priced and missing (sorted symbols without a price) of positions (symbol, shares)."""
    both = positions.join(prices, "symbol", "left")
    return both.agg(
        (F.lit(cash) + F.coalesce(F.sum(F.col("shares") * F.col("price")), F.lit(0.0))).alias("value"),
        F.count("price").alias("priced"),
        F.sort_array(F.collect_list(F.when(F.col("price").isNull(), F.col("symbol")))).alias("missing"),
    )


def session_summary(samples: DataFrame, by: list[str]) -> DataFrame:
    """first, last, pnl, pct, samples, regular_samples of samples (by, at, value, state)."""
    found = samples.groupBy(*by).agg(F.min_by("value", "at").alias("first"), F.max_by("value", "at").alias("last"), F.count("*").alias("samples"), F.count_if(F.col("state") == "REGULAR").alias("regular_samples"))
    pnl = F.col("last") - F.col("first")
    return found.select(*by, "first", "last", pnl.alias("pnl"), F.when(F.col("first") == 0, 0.0).otherwise(F.try_divide(pnl, "first")).alias("pct"), "samples", "regular_samples")


def modal_state(polls: DataFrame) -> DataFrame:
    """The state most polls (place, state) report; of equal ones the one seen first."""
    return polls.groupBy("state").agg(F.count("*").alias("n"), F.min("place").alias("seen")).orderBy(F.desc("n"), "seen").limit(1).select("state")
