"""Backtests, walk-forward studies, placebo and power studies: many runs, one job."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintage.operators import evaluate, pit, portfolio, signals, simulate

Signals = dict[str, Callable[[DataFrame], DataFrame]]
RUNS = "run string, start date, end date"


def runs_frame(spark: SparkSession, runs: list[tuple[str, dt.date, dt.date]]) -> DataFrame:
    return spark.createDataFrame(runs, RUNS)


def decision_dates(runs: DataFrame, calendar: DataFrame, every: int) -> DataFrame:
    """(run, as_of): every so many trading dates of a run from its first, its last one excepted."""
    days = F.broadcast(runs).join(calendar, F.col("date").between(F.col("start"), F.col("end")))
    w = Window.partitionBy("run").orderBy("date")
    placed = days.select("run", F.col("date").alias("as_of"), (F.row_number().over(w) - 1).alias("i"), F.lead("date").over(w).isNotNull().alias("more"))
    return placed.where((F.col("i") % every == 0) & F.col("more")).select("run", "as_of")


def targets_of(runs: DataFrame, bars: DataFrame, bench: DataFrame, snapshots: DataFrame, scorers: Signals, *, every: int = 21, top: int = 10, weighting: str = "equal", vol_lookback: int = 252, regime: int | None = None, calendar: DataFrame | None = None) -> DataFrame:
    """The targets of all runs: scores are made once for each date, whatever the number of runs.

    scorers take decisions (as_of, symbol). Dates on which the regime is off or
    unknown have one row without a symbol, as have those nothing is chosen on.
    """
    if weighting not in ("equal", "invvol"):
        raise ValueError(f"unknown weighting: {weighting}")
    calendar = calendar if calendar is not None else bars.select("date").distinct()
    decided = decision_dates(runs, calendar, every)
    members = pit.universe_calendar(snapshots, decided.select("as_of"))
    scores = portfolio.combine({name: scorer(members) for name, scorer in scorers.items()})
    if weighting == "equal":
        weights = portfolio.equal_weights(scores, top)
    else:
        # Only the chosen are priced.
        chosen = portfolio.chosen(scores, top, ["as_of"]).select("as_of", "symbol")
        weights = portfolio.inverse_vol_weights(scores, signals.realised_vols(bars.join(chosen.select("symbol").distinct(), "symbol", "left_semi"), chosen, vol_lookback), top)
    dates = members.select("as_of").distinct()
    if regime is not None:
        state = signals.trend(bench, regime).withColumn("k", F.lit(1))
        dates = pit.lookup(state, dates.withColumn("k", F.lit(1)), ["k"], "date", "as_of", ["risk_on"]).select("as_of", F.coalesce("risk_on", F.lit(False)).alias("risk_on"))
    else:
        dates = dates.withColumn("risk_on", F.lit(None).cast("boolean"))
    kept = dates.join(weights, "as_of", "left")
    off = F.col("risk_on").eqNullSafe(F.lit(False))
    kept = kept.select("as_of", F.when(~off, F.col("symbol")).alias("symbol"), F.when(~off, F.col("weight")).alias("weight"), "risk_on").distinct()
    # The newest bar of a date's members, for the gate's limit on stale data.
    seen = pit.lookup(bars.withColumn("bar_date", F.col("date")), members, ["symbol"], "date", "as_of", ["bar_date"]).groupBy("as_of").agg(F.max("bar_date").alias("newest"))
    return decided.join(kept, "as_of").join(seen, "as_of", "left").select("run", "as_of", "symbol", "weight", "risk_on", "newest")


def equity_of(folded: DataFrame) -> DataFrame:
    return folded.where("kind = 'equity'").select("run", "date", "equity")


def trades_of(folded: DataFrame) -> DataFrame:
    return folded.where("kind = 'trade'").select("run", "date", "symbol", "side", "shares", "price", "commission")


def benchmark_curves(bench: DataFrame, runs: DataFrame, cash: float = 10_000.0) -> DataFrame:
    """(run, date, equity) of holding the benchmark in every run."""
    from vintage.functions import scalars

    days = F.broadcast(runs).join(bench, F.col("date") <= F.col("end"))
    inside = days.where("date >= start")
    first = inside.groupBy("run").agg(F.min("date").alias("first"))
    entry = days.join(F.broadcast(first), "run").where("date <= first").groupBy("run").agg(F.max_by("open", "date").alias("entry"))
    gross = F.lit(cash) / F.col("entry")
    bought = entry.select("run", ((F.lit(cash) - scalars.commission(gross, F.col("entry"))) / F.col("entry")).alias("held"))
    return inside.join(F.broadcast(bought), "run").select("run", "date", (F.col("held") * F.col("close")).alias("equity"))


def studied(runs: DataFrame, windows: DataFrame, folded: DataFrame, bench: DataFrame, by: list[str]) -> DataFrame:
    """Verdicts of runs (run) that are windows (run, kind, and by)."""
    return evaluate.verdicts(windows, evaluate.measured(equity_of(folded), ["run"]), evaluate.measured(benchmark_curves(bench, runs), ["run"]), by)


def window_runs(spark: SparkSession, names: list[str], start: dt.date, end: dt.date, n: int = 4, holdout: float = evaluate.HOLDOUT) -> tuple[DataFrame, DataFrame]:
    """(runs, windows) of every name over the windows of a walk-forward."""
    cut = evaluate.walk_windows(start, end, n, holdout)
    rows = [(f"{name}/{k}", name, kind, a, b) for name in names for k, (kind, a, b) in enumerate(cut)]
    frame = spark.createDataFrame(rows, "run string, name string, kind string, start date, end date")
    return frame.select("run", "start", "end"), frame.select("run", "name", "kind")


def seeded_targets(runs: DataFrame, windows: DataFrame, bars: DataFrame, snapshots: DataFrame, score, *, every: int = 21, top: int = 10) -> DataFrame:
    """Targets of runs whose scores differ by name: score takes decisions (name, as_of, symbol) and adds value and confidence."""
    decided = decision_dates(runs, bars.select("date").distinct(), every).join(F.broadcast(windows.select("run", "name")), "run")
    members = pit.universe_calendar(snapshots, decided.select("as_of"))
    scored = score(decided.select("name", "as_of").distinct().join(members, "as_of"))
    weights = portfolio.equal_weights(scored, top, ["name", "as_of"])
    null = F.lit(None)
    return decided.join(weights, ["name", "as_of"], "left").select("run", "as_of", "symbol", "weight", null.cast("boolean").alias("risk_on"), null.cast("date").alias("newest"))


def summary(verdicts: DataFrame) -> DataFrame:
    """trials, passed, pass_rate, median_edge and best_edge of a study's verdicts; an empty study has no rate."""
    return verdicts.agg(F.count("*").alias("trials"), F.count_if("gate_passed").alias("passed"), F.avg(F.col("gate_passed").cast("int")).alias("pass_rate"), F.median("holdout_edge").alias("median_edge"), F.max("holdout_edge").alias("best_edge"))


def histogram(verdicts: DataFrame) -> DataFrame:
    """(research_passed, trials) for every number of windows up to the most there are, zeros included."""
    most = verdicts.agg(F.max("research_total").alias("most"))
    buckets = most.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("most"))).alias("research_passed"))
    counted = verdicts.groupBy("research_passed").agg(F.count("*").alias("trials"))
    return buckets.join(counted, "research_passed", "left").select("research_passed", F.coalesce("trials", F.lit(0)).alias("trials"))


def correlation_probe(bars: DataFrame, decided: DataFrame, scorers: Signals, *, top: int = 10, lookback: int = 63) -> DataFrame:
    """(signal, as_of, n_pairs, mean_correlation, diversification_ratio) of the names each signal picks, over the lookback bars before each decision.

    A decision's names are at most top, so its pairs are at most top * (top - 1) / 2.
    """
    picks = None
    for name, scorer in scorers.items():
        own = portfolio.equal_weights(scorer(decided), top).withColumn("signal", F.lit(name))
        picks = own if picks is None else picks.unionByName(own)
    w = Window.partitionBy("symbol").orderBy("date")
    placed = bars.select("symbol", "date", (F.col("adj_close") / F.lag("adj_close").over(w) - 1).alias("r"), F.row_number().over(w).alias("n"))
    at = pit.lookup(placed, picks.select("symbol", "as_of").distinct(), ["symbol"], "date", "as_of", ["n"]).withColumnRenamed("n", "last")
    spans = picks.join(at, ["symbol", "as_of"]).where(F.col("last") > lookback)
    rows = spans.join(placed, "symbol").where((F.col("n") <= F.col("last")) & (F.col("n") > F.col("last") - lookback) & F.col("r").isNotNull())
    by = ["signal", "as_of"]
    a = rows.select(*by, "date", F.col("symbol").alias("left"), F.col("r").alias("x"))
    b = rows.select(*by, "date", F.col("symbol").alias("right"), F.col("r").alias("y"))
    pairs = a.join(b, [*by, "date"]).where(F.col("left") < F.col("right")).groupBy(*by, "left", "right").agg(evaluate.guarded_correlation("x", "y").alias("c"))
    correlation = pairs.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.avg("c").alias("mean_correlation"))
    vols = rows.groupBy(*by, "symbol").agg(F.stddev_samp("r").alias("vol"), F.first("weight").alias("weight")).groupBy(*by).agg(F.sum(F.col("weight") * F.col("vol")).alias("own"))
    book = rows.groupBy(*by, "date").agg(F.sum(F.col("weight") * F.col("r")).alias("m")).groupBy(*by).agg(F.stddev_samp("m").alias("pv"))
    ratio = F.when(F.col("pv") > 0, F.col("own") / F.col("pv"))
    return correlation.join(vols, by).join(book, by).select(*by, "n_pairs", "mean_correlation", ratio.alias("diversification_ratio"))
