"""From scores to targets: midranks, rank averages, top-n weights, the risk gate."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def midrank(scores: DataFrame, within: list[str]) -> DataFrame:
    """Voters' midrank percentile within the columns; equal values share one, a lone voter has 0.5."""
    voters = scores.where("confidence > 0")
    group, alike = Window.partitionBy(*within), Window.partitionBy(*within, "value")
    n = F.count("*").over(group)
    place = F.rank().over(group.orderBy("value")) - 1 + (F.count("*").over(alike) - 1) / 2
    return voters.withColumn("midrank", F.when(n == 1, 0.5).otherwise(F.try_divide(place, n - 1)))


def rank_average(by_signal: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean of midranks over the signals that vote, less one half; no vote, no opinion."""
    frames = [df.select("as_of", "symbol", "value", "confidence", F.lit(name).alias("signal"), F.lit(float((weights or {}).get(name, 1.0))).alias("w")) for name, df in by_signal.items()]
    all_ = reduce(DataFrame.unionByName, frames)
    ranked = midrank(all_, ["as_of", "signal"])
    mean = ranked.groupBy("as_of", "symbol").agg((F.try_divide(F.sum(F.col("w") * F.col("midrank")), F.sum("w")) - 0.5).alias("v"))
    joined = all_.select("as_of", "symbol").distinct().join(mean, ["as_of", "symbol"], "left")
    return joined.select("as_of", "symbol", F.coalesce("v", F.lit(0.0)).alias("value"), F.when(F.col("v").isNotNull(), 1.0).otherwise(0.0).alias("confidence"))


def combine(by_signal: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """One signal passes as it is; several are averaged by rank."""
    if not by_signal:
        raise ValueError("no signal")
    if len(by_signal) == 1:
        return next(iter(by_signal.values())).select("as_of", "symbol", "value", "confidence")
    return rank_average(by_signal, weights)


def chosen(scores: DataFrame, n: int, within: list[str]) -> DataFrame:
    """The n best with an opinion and a value over zero; ties by symbol."""
    if n <= 0:
        raise ValueError("n must be positive")
    place = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("value"), "symbol"))
    return scores.where("confidence > 0 AND value > 0").withColumn("place", place).where(F.col("place") <= n)


def equal_weights(scores: DataFrame, n: int, within: list[str] = ["as_of"]) -> DataFrame:
    top = chosen(scores, n, within)
    return top.select(*within, "symbol", (1 / F.count("*").over(Window.partitionBy(*within))).alias("weight"))


def inverse_vol_weights(scores: DataFrame, vols: DataFrame, n: int, within: list[str] = ["as_of"]) -> DataFrame:
    """Weights as 1 / vol among the chosen; a missing or unusable vol is the median of the usable, without any all are equal.

    vols (as_of, symbol, vol) are read for the chosen only.
    """
    top = chosen(scores, n, within).join(vols, ["as_of", "symbol"], "left")
    usable = F.when(F.col("vol") > 0, F.col("vol"))
    group = Window.partitionBy(*within)
    filled = top.withColumn("usable", usable).withColumn("vol", F.coalesce("usable", F.median("usable").over(group), F.lit(1.0)))
    return filled.withColumn("inverse", 1 / F.col("vol")).select(*within, "symbol", (F.col("inverse") / F.sum("inverse").over(group)).alias("weight"))


@dataclass(frozen=True)
class RiskLimits:
    max_weight: float = 0.20
    max_gross: float = 1.00
    max_daily_loss: float = 0.05
    max_drawdown: float = 0.25
    max_stale_days: int = 4
    min_positions: int = 1
    max_positions: int = 30


#: Why the gate stops trading, in the order in which it looks.
HALTED, UNRECONCILED, STALE, NO_EQUITY, DAILY_LOSS, DRAWDOWN = "halted", "unreconciled", "stale", "no-equity", "daily-loss", "drawdown"


def halt(limits: RiskLimits = RiskLimits()) -> tuple[Column, Column]:
    """(why trading stops, or null; the figure that stops it) from a row of state: halted, reason, reconciled, today, data_as_of, equity, previous, peak."""
    stale = F.datediff("today", "data_as_of")
    change = lambda base: F.try_divide("equity", base) - 1
    lost = (F.col("previous") > 0) & (change("previous") <= -limits.max_daily_loss)
    sunk = (F.col("peak") > 0) & (change("peak") <= -limits.max_drawdown)
    stops = [
        (F.col("halted"), F.coalesce("reason", F.lit(HALTED)), F.lit(None)),
        (~F.col("reconciled"), F.lit(UNRECONCILED), F.lit(None)),
        (stale > limits.max_stale_days, F.lit(STALE), stale),
        (F.col("equity") <= 0, F.lit(NO_EQUITY), F.col("equity")),
        (lost, F.lit(DAILY_LOSS), change("previous")),
        (sunk, F.lit(DRAWDOWN), change("peak")),
    ]
    reason, figure = F.lit(None).cast("string"), F.lit(None).cast("double")
    for stop, code, value in reversed(stops):
        reason, figure = F.when(stop, code).otherwise(reason), F.when(stop, value.cast("double")).otherwise(figure)
    return reason, figure


def reduce_targets(targets: DataFrame, limits: RiskLimits = RiskLimits(), within: list[str] = ["as_of"]) -> DataFrame:
    """The half of the gate without state: drop non-positive, trim to the largest, need enough, cap, scale down; it never adds."""
    place = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("weight"), "symbol"))
    kept = targets.where("weight > 0").withColumn("place", place).where(F.col("place") <= limits.max_positions)
    group = Window.partitionBy(*within)
    capped = kept.withColumn("n", F.count("*").over(group)).where(F.col("n") >= limits.min_positions).withColumn("capped", F.least("weight", F.lit(limits.max_weight)))
    gross = F.sum("capped").over(group)
    return capped.withColumn("weight", F.when(gross > limits.max_gross, F.col("capped") * limits.max_gross / gross).otherwise(F.col("capped"))).select(*within, "symbol", "weight")


@dataclass(frozen=True)
class State:
    """What the gate looks at beside the targets."""

    equity: float
    peak: float
    previous: float
    stale_days: int = 0
    halted: bool = False
    reconciled: bool = True
    risk_on: bool | None = None


@dataclass(frozen=True)
class Decision:
    """targets: None holds what is held, an empty mapping sells all; vetoes say what was stopped or changed."""

    targets: dict[str, float] | None
    vetoes: tuple[str, ...] = ()

    @property
    def blocked(self) -> bool:
        return self.targets is None


def judge(weights: dict[str, float], limits: RiskLimits, state: State) -> Decision:
    """The whole gate for one decision: it takes away, and never adds."""
    loss = state.equity / state.previous - 1 if state.previous > 0 else 0.0
    depth = state.equity / state.peak - 1 if state.peak > 0 else 0.0
    stops = {HALTED: state.halted, UNRECONCILED: not state.reconciled, STALE: state.stale_days > limits.max_stale_days, NO_EQUITY: state.equity <= 0, DAILY_LOSS: loss <= -limits.max_daily_loss, DRAWDOWN: depth <= -limits.max_drawdown}
    if stop := next((code for code, on in stops.items() if on), None):
        return Decision(None, (stop,))
    if state.risk_on is False:
        return Decision({}, ("risk-off",))
    best = sorted((-w, s) for s, w in weights.items() if w > 0)
    vetoes = [f"too-many:{len(best)}"] * (len(best) > limits.max_positions)
    best = best[: limits.max_positions]
    if 0 < len(best) < limits.min_positions:
        return Decision(None, (*vetoes, f"too-few:{len(best)}"))
    vetoes += [f"capped:{s}" for w, s in best if -w > limits.max_weight]
    capped = {s: min(-w, limits.max_weight) for w, s in best}
    gross = sum(capped.values())
    if gross > limits.max_gross:
        return Decision({s: w * limits.max_gross / gross for s, w in capped.items()}, (*vetoes, f"gross:{gross:.4f}"))
    return Decision(capped, tuple(vetoes))


def gate(weights: dict[str, float], limits: RiskLimits, **state) -> dict[str, float] | None:
    """The targets that the gate leaves: None holds, an empty mapping sells all."""
    return judge(weights, limits, State(**state)).targets
