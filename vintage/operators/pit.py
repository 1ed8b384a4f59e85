"""Point-in-time reads: the only way to facts is through a date on which they were known.

Every reader takes as_of, a date or a frame of dates, and returns nothing whose
knowable_at is later. Bars are known on their own date, so that the latest bar
known and the latest bar dated are the same.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Day = dt.date | str


def _known(df: DataFrame, as_of: Day) -> DataFrame:
    return df.where(F.col("knowable_at") <= F.lit(str(as_of)).cast("date"))


def trading_dates(bars: DataFrame, start: Day, end: Day) -> DataFrame:
    return bars.where(F.col("date").between(str(start), str(end))).select("date").distinct()


def last_n_bars(bars: DataFrame, as_of: Day, n: int) -> DataFrame:
    """Each symbol's n most recent bars known on as_of, with their rank from the latest."""
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    return _known(bars, as_of).withColumn("back", rank).where(F.col("back") <= n)


def latest_bars(bars: DataFrame, as_of: Day) -> DataFrame:
    """Each symbol's latest bar known on as_of, however old: one aggregate, no join."""
    whole = F.struct("date", *(c for c in bars.columns if c not in ("symbol", "date")))
    return _known(bars, as_of).groupBy("symbol").agg(F.max(whole).alias("bar")).select("symbol", "bar.*")


def lookup(facts: DataFrame, markers: DataFrame, by: list[str], at: str, marker_at: str, values: list[str]) -> DataFrame:
    """markers with the values of the latest row of facts at or before each, by key.

    facts and markers are united and carried forward in one window: one
    shuffle on the key, no inequality join. A fact at a marker's own time
    counts; markers without an earlier fact get nulls.
    """
    keys = [F.col(c) for c in by]
    rest = [c for c in markers.columns if c not in [*by, marker_at]]
    kinds = {f.name: f.dataType for f in facts.schema} | {f.name: f.dataType for f in markers.schema}
    carried = F.struct(*values)
    left = facts.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_m"), carried.alias("_v"), *(F.lit(None).cast(kinds[c]).alias(c) for c in rest))
    right = markers.select(*keys, F.col(marker_at).alias("_at"), F.lit(1).alias("_m"), F.lit(None).cast(left.schema["_v"].dataType).alias("_v"), *rest)
    back = Window.partitionBy(*by).orderBy("_at", "_m").rowsBetween(Window.unboundedPreceding, 0)
    out = left.unionByName(right).withColumn("_v", F.last("_v", ignorenulls=True).over(back)).where("_m = 1")
    return out.select(*by, F.col("_at").alias(marker_at), *rest, *(F.col("_v").getField(v).alias(v) for v in values))


def latest_fundamentals(facts: DataFrame, as_of: Day) -> DataFrame:
    """For each symbol and concept the fact filed last by as_of; of one filing date the latest period, then accession."""
    best = F.max(F.struct("knowable_at", "period_end", "accn", "value")).alias("f")
    return _known(facts, as_of).groupBy("symbol", "concept").agg(best).select("symbol", "concept", "f.*")


def fundamentals_calendar(facts: DataFrame, markers: DataFrame) -> DataFrame:
    """latest_fundamentals for each marker (symbol, as_of) and concept the symbol has.

    The best fact so far by filing date is a running maximum; markers then look it up.
    """
    order = Window.partitionBy("symbol", "concept").orderBy("knowable_at").rangeBetween(Window.unboundedPreceding, 0)
    best = facts.withColumn("f", F.max(F.struct("knowable_at", "period_end", "accn", "value")).over(order))
    best = best.groupBy("symbol", "concept", "knowable_at").agg(F.max("f").alias("f")).select("symbol", "concept", "knowable_at", "f.period_end", "f.accn", "f.value")
    asked = markers.select("symbol", "as_of").join(facts.select("symbol", "concept").distinct(), "symbol")
    best = best.withColumn("filed", F.col("knowable_at"))
    return lookup(best, asked, ["symbol", "concept"], "knowable_at", "as_of", ["filed", "period_end", "accn", "value"]).where("filed IS NOT NULL")


def universe(snapshots: DataFrame, as_of: Day) -> DataFrame:
    """The symbols of the latest snapshot known on as_of; none before the first."""
    known = _known(snapshots, as_of)
    return known.join(F.broadcast(known.agg(F.max("effective").alias("effective"))), "effective").select("effective", "symbol")


def universe_calendar(snapshots: DataFrame, dates: DataFrame) -> DataFrame:
    """(as_of, symbol) for every date of dates (as_of): the latest snapshot known by then.

    Snapshots' validity runs to the next one; dates find theirs by carrying the
    snapshot date forward, then join it by equality.
    """
    one = F.lit(1)
    marks = snapshots.select(F.col("knowable_at").alias("at"), "effective").distinct().withColumn("k", one)
    found = lookup(marks, dates.select("as_of").distinct().withColumn("k", one), ["k"], "at", "as_of", ["effective"])
    return found.where("effective IS NOT NULL").join(snapshots.select("effective", "symbol"), "effective").select("as_of", "symbol")


def news(items: DataFrame, as_of: Day, n: int, per_symbol: bool = False) -> DataFrame:
    """Known items, newest first: n for each symbol asked for altogether, or n of each symbol."""
    newest = [F.desc("published_at"), F.col("symbol"), F.col("content_hash")]
    known = _known(items, as_of)
    if per_symbol:
        own = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("published_at"), "content_hash"))
        return known.withColumn("place", own).where(F.col("place") <= n)
    return known.orderBy(*newest).limit(n)


def split_factor_after(splits: DataFrame, asked: DataFrame, after: str) -> DataFrame:
    """asked (symbol, after, ...) with factor: the product of the ratios of later splits, 1 without any."""
    good = splits.where("ratio > 0").select(F.col("symbol").alias("_s"), F.col("date").alias("_d"), "ratio")
    joined = asked.join(good, (asked["symbol"] == F.col("_s")) & (F.col("_d") > asked[after]), "left")
    return joined.groupBy(*asked.columns).agg(F.coalesce(F.product("ratio"), F.lit(1.0)).alias("factor"))


def future_return(bars: DataFrame, horizon: int) -> DataFrame:
    """LOOKAHEAD, for studies of the gate only: each bar's return from the next bar to the one horizon bars on.

    The last bars have a shorter horizon; fewer than two bars ahead give null.
    """
    ahead = Window.partitionBy("symbol").orderBy("date").rowsBetween(1, horizon + 1)
    start, end = F.first("adj_close").over(ahead), F.last("adj_close").over(ahead)
    return bars.select("symbol", "date", F.when((F.count("*").over(ahead) >= 2) & (start > 0), end / start - 1).alias("future"))


def _open_end(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("9999-12-31").cast("date"))


def members_on(spans: DataFrame, day: Day) -> DataFrame:
    on = F.lit(str(day)).cast("date")
    return spans.where((F.col("start_date") <= on) & (on <= _open_end("end_date"))).select("ticker").distinct()


def ever_members(spans: DataFrame, start: Day, end: Day) -> DataFrame:
    return spans.where((F.col("start_date") <= F.lit(str(end)).cast("date")) & (_open_end("end_date") >= F.lit(str(start)).cast("date"))).select("ticker").distinct()


def snapshot_dates(spark, start: Day, end: Day) -> DataFrame:
    """The first of each month from start's month to end."""
    return spark.sql(f"SELECT explode(sequence(trunc(date'{start}', 'MM'), date'{end}', interval 1 month)) AS snapshot")


def volume_universe(volumes: DataFrame, as_of: Day, top: int = 30, days: int = 30) -> DataFrame:
    """The top symbols by volume over the days before as_of, that day excluded; ties by symbol."""
    end = F.lit(str(as_of)).cast("date")
    total = volumes.where((F.col("date") >= F.date_sub(end, days)) & (F.col("date") < end)).groupBy("symbol").agg(F.sum("volume").alias("total"))
    rank = F.row_number().over(Window.orderBy(F.desc("total"), "symbol"))
    # The limit comes first: one task ranks top rows, whatever the number of symbols.
    return total.where("total > 0").orderBy(F.desc("total"), "symbol").limit(top).withColumn("place", rank)
