"""The daily cycle: reconcile, score, gate, order, write the journal; once for each date.

What grows with the market, scores and prices as of the date, is read by
DataFrames; a book of some dozens of positions is handled on the driver.
"""

from __future__ import annotations

import datetime as dt
import json
import os
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.operators import books, pit, portfolio, signals
from vintage.operators.broker import Broker, Order, Rejected

INVESTED = 0.98
FLOOR = "2018-01-01"


class Journal:
    """Records of decisions, one JSON line each, in the order in which they were written."""

    def __init__(self, path: str):
        self.path = path

    def append(self, record: dict) -> None:
        with open(self.path, "a") as f:
            f.write(json.dumps(record, sort_keys=True, default=str) + "\n")
            f.flush()
            os.fsync(f.fileno())

    def read(self) -> list[dict]:
        """All whole records; blank, torn and foreign lines are left out."""
        out: list[dict] = []
        if os.path.exists(self.path):
            with open(self.path, encoding="utf-8", errors="replace") as f:
                for line in f:
                    try:
                        record = json.loads(line)
                    except ValueError:
                        continue
                    if isinstance(record, dict):
                        out.append(record)
        return out

    def tail(self, n: int = 10) -> list[dict]:
        return self.read()[-n:] if n > 0 else []

    def last(self) -> dict | None:
        return next(iter(self.tail(1)), None)


@dataclass
class Result:
    as_of: str
    decision: portfolio.Decision
    orders: list = field(default_factory=list)
    fills: list = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    equity: float = 0.0


@dataclass
class DailyCycle:
    """One decision a day over tables bars, universe snapshots and benchmark, with a broker and a journal.

    scorers take decisions (as_of, symbol); one that raises is noted and left
    out. quotes, if given, override the prices that orders are made at.
    """

    spark: SparkSession
    bars: DataFrame
    snapshots: DataFrame
    scorers: Mapping[str, Callable[[DataFrame], DataFrame]]
    broker: Broker
    journal: Journal
    limits: portfolio.RiskLimits = portfolio.RiskLimits()
    top: int = 10
    bench: DataFrame | None = None
    quotes: Callable[[list[str]], Mapping[str, float]] | None = None

    def _reconciled(self, believed: Mapping[str, float], cash: float | None) -> list[str]:
        """Descriptions of the breaks between what was written last and the broker's account."""
        account = self.broker.account()
        frame = lambda shares: self.spark.createDataFrame(list(shares.items()), "symbol string, shares double")
        found = books.reconcile(frame(believed), frame({s: p.shares for s, p in account.positions.items()}), cash, account.cash)
        return sorted(r["line"] for r in found.select(books.describe().alias("line")).collect())

    def run(self, as_of: dt.date, halt: bool = False) -> Result:
        marks = self.spark.createDataFrame([(as_of,)], "as_of date")
        members = pit.universe_calendar(self.snapshots, marks).select("as_of", "symbol")
        account, before, notes = self.broker.account(), self.journal.last(), []
        wanted = members.select("symbol").union(self.spark.createDataFrame([(s,) for s in account.positions], "symbol string")).distinct()
        latest = {r["symbol"]: r for r in pit.latest_bars(self.bars, as_of).join(wanted, "symbol", "left_semi").select("symbol", "date", "close").collect()}
        prices = {s: r["close"] for s, r in latest.items()}
        if before is None:
            notes.append("first cycle: the broker's account is taken as it is")
        breaks = self._reconciled(before["positions"], before["cash"]) if before else []
        equity = account.equity(prices)
        past = [r["equity"] for r in self.journal.read() if r.get("equity") is not None]
        scores = {}
        for name, scorer in self.scorers.items():
            try:
                scores[name] = self.spark.createDataFrame(scorer(members).select("as_of", "symbol", "value", "confidence").collect(), "as_of date, symbol string, value double, confidence double")
            except Exception as problem:  # noqa: BLE001  a signal that fails must not end the day
                notes.append(f"signal {name} failed: {type(problem).__name__}")
        weights = {r["symbol"]: r["weight"] for r in portfolio.equal_weights(portfolio.combine(scores), self.top).collect()} if scores else {}
        risk_on = None
        if self.bench is not None:
            row = signals.trend(self.bench.where(F.col("date") <= F.lit(as_of))).orderBy(F.desc("date")).first()
            risk_on = bool(row and row["risk_on"])
        newest = max((r["date"] for r in latest.values()), default=dt.date.min)
        state = portfolio.State(equity, max([equity, *past]), past[-1] if past else equity, (as_of - newest).days, halt, not breaks, risk_on)
        decision = portfolio.judge(weights, self.limits, state)
        result = Result(str(as_of), decision, notes=[*notes, *breaks], equity=equity)
        if not decision.blocked:
            self._trade(decision.targets, prices, equity, result)
        after = self.broker.account()
        self.journal.append({
            "as_of": str(as_of), "universe_size": members.count(), "signals": sorted(scores), "targets": decision.targets, "risk_vetoes": list(decision.vetoes), "orders": [asdict(o) for o in result.orders], "fills": [asdict(f) for f in result.fills],
            "notes": result.notes, "cash": after.cash, "equity": after.equity(prices), "positions": {s: p.shares for s, p in after.positions.items()},
        })
        return result

    def _trade(self, targets: Mapping[str, float], prices: Mapping[str, float], equity: float, result: Result) -> None:
        held = self.broker.account().positions
        if self.quotes:
            prices = {**prices, **{s: p for s, p in self.quotes(sorted({*held, *targets})).items() if p and p > 0}}
        frame = lambda rows, schema: self.spark.createDataFrame(rows, schema)
        orders = books.order_diff(frame([(s, p.shares) for s, p in held.items()], "symbol string, shares double"), frame(list(targets.items()), "symbol string, weight double"), frame(list(prices.items()), "symbol string, price double"), equity * INVESTED)
        for r in orders.orderBy("place").collect():
            order = Order(r["symbol"], r["side"], r["shares"])
            result.orders.append(order)
            try:
                result.fills.append(self.broker.place(order, prices.get(order.symbol)))
            except Rejected as problem:
                result.notes.append(f"rejected: {problem}")


def run_once(cycle: DailyCycle, floor: str = FLOOR, halt: bool = False) -> Result | None:
    """The cycle of the latest trading date from floor on, unless the journal has it."""
    day = cycle.bars.where(F.col("date") >= F.lit(floor).cast("date")).agg(F.max("date").alias("day")).first()["day"]
    if day is None or any(r.get("as_of") == str(day) for r in cycle.journal.read()):
        return None
    return cycle.run(day, halt)
