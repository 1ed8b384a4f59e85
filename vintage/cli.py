"""The engine from the command line: python -m vintage.cli COMMAND.

Tables lie below --db, a folder of keyed tables; the benchmark is one of the
symbols in bars.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.functions import scalars
from vintage.operators import evaluate, pit, portfolio, signals
from vintage.operators.broker import SimulatedBroker
from vintage.operators.simulate import Settings, simulate
from vintage.plans import cycle as daily
from vintage.plans import reports, studies
from vintage.session import get_session
from vintage.sources import feeds, parsers
from vintage.sources.store import Store

WARM_UP_DAYS = 400
STRENGTHS = ("0.0", "0.05", "0.1", "0.25", "0.5", "1.0")


def _news(store: Store) -> Callable[[DataFrame], DataFrame]:
    def score(decisions: DataFrame) -> DataFrame:
        # A calendar's dates, some hundreds at most.
        days = [r["as_of"] for r in decisions.select("as_of").distinct().collect()]
        return reduce(DataFrame.unionByName, (signals.news_sentiment(store.table("news"), str(d), decisions.where(F.col("as_of") == F.lit(d)).select("symbol")) for d in days))

    return score


def registry(store: Store) -> studies.Signals:
    """The signals by name, each from decisions to scores."""
    bars = store.table("bars")
    of = {"momentum": signals.momentum, "lowvol": signals.low_volatility, "reversal": signals.reversal, "candles": signals.candles, "gap": signals.gap_continuation}
    found = {name: (lambda f: lambda d: f(bars, d))(f) for name, f in of.items()}
    is_nav = scalars.is_nav(F.col("symbol"))
    found["fundamental"] = lambda d: signals.value_quality(store.table("facts"), bars, store.table("splits"), d)
    found["cef"] = lambda d: signals.cef_discount(bars.where(~is_nav), bars.where(is_nav), d)
    found["news"] = _news(store)
    return found


def _day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def _span(store: Store, args) -> DataFrame:
    """The bars between start and end; ends the program where there are none."""
    inside = store.table("bars").where(F.col("date").between(F.lit(args.start), F.lit(args.end)))
    if inside.isEmpty():
        sys.exit(f"no bars from {args.start} to {args.end} in {args.db}")
    return inside


def _settings(args) -> Settings:
    limits = portfolio.RiskLimits() if args.risk_gate or args.live_parity else None
    return Settings(args.cash, args.spread_bps, cash_buffer=0.02 if args.live_parity else 0.0, limits=limits)


def _fold(store: Store, args, runs: DataFrame) -> DataFrame:
    bars, known = store.table("bars"), registry(store)
    bench = bars.where(F.col("symbol") == args.benchmark)
    calendar = _span(store, args).select("date").distinct()
    options = {"every": args.rebalance_every, "top": args.top_n, "weighting": args.weighting, "regime": 200 if args.regime_filter else None}
    targets = studies.targets_of(runs, bars, bench, store.table("universe"), {name: known[name] for name in args.signal}, calendar=calendar, **options)
    return simulate(runs, calendar, bars, targets, _settings(args))


def backtest(store: Store, args) -> str:
    runs = studies.runs_frame(store.spark, [("all", args.start, args.end)])
    folded = _fold(store, args, runs).persist()
    bench = store.table("bars").where(F.col("symbol") == args.benchmark)
    curve, held = studies.equity_of(folded), studies.benchmark_curves(bench, runs, args.cash)
    one = lambda df: next((r.asDict() for r in evaluate.metrics(df, ["run"]).drop("run").collect()), {"total_return": 0.0, "cagr": 0.0, "sharpe": 0.0, "max_drawdown": 0.0})
    against = evaluate.attribution(evaluate.aligned_returns(curve.drop("run"), held.drop("run"))).first().asDict()
    text = reports.backtest("+".join(args.signal), one(curve), one(held), studies.trades_of(folded).count())
    folded.unpersist()
    return text if not against["n_days"] else f"{text}\n{reports.attribution(against)}"


def evaluated(store: Store, args) -> str:
    runs, windows = studies.window_runs(store.spark, ["+".join(args.signal)], args.start, args.end, args.windows, args.holdout)
    bench = store.table("bars").where(F.col("symbol") == args.benchmark)
    return reports.walk_forward(studies.studied(runs, windows, _fold(store, args, runs), bench, ["name"]).first().asDict())


def _seeded(store: Store, args, names: list[str], score) -> DataFrame:
    bars = store.table("bars")
    calendar = _span(store, args).select("date").distinct()
    runs, windows = studies.window_runs(store.spark, names, args.start, args.end)
    targets = studies.seeded_targets(runs, windows, bars, store.table("universe"), score, every=args.rebalance_every, top=args.top_n)
    folded = simulate(runs, calendar, bars, targets)
    return studies.studied(runs, windows, folded, bars.where(F.col("symbol") == args.benchmark), ["name"])


def placebo(store: Store, args) -> str:
    score = lambda d: d.withColumn("value", scalars.noise(F.col("name"), F.col("as_of"), F.col("symbol"))).withColumn("confidence", F.lit(1.0))
    found = _seeded(store, args, [str(k) for k in range(args.trials)], score).persist()
    return reports.placebo(studies.summary(found).first().asDict(), [r.asDict() for r in studies.histogram(found).orderBy("research_passed").collect()])


def power(store: Store, args) -> str:
    bars = store.table("bars")

    def score(d: DataFrame) -> DataFrame:
        ahead = signals.future_of(bars, d.select("as_of", "symbol").distinct())
        return signals.blended(d.join(ahead, ["as_of", "symbol"]), F.col("name").cast("double"), 0)

    return reports.power(r.asDict() for r in _seeded(store, args, list(STRENGTHS), score).collect())


def cycle(store: Store, args, opener=feeds.http) -> str:
    bars, known = store.table("bars"), registry(store)
    broker = SimulatedBroker(args.cash, args.spread_bps, args.sim_state)
    quotes = feeds.QuoteSource(store.spark, feeds.ChartSource("1d", opener=opener)).quotes if args.live else None
    bench = bars.where(F.col("symbol") == args.benchmark) if args.regime_filter else None
    day = daily.DailyCycle(store.spark, bars, store.table("universe"), {n: known[n] for n in args.signals}, broker, daily.Journal(args.journal), portfolio.RiskLimits(max_weight=args.max_weight), args.top_n, bench, quotes)
    found = day.run(args.as_of, args.halt) if args.as_of else daily.run_once(day, args.as_of_floor, args.halt)
    if found is None:
        return "nothing to do: the journal has the latest date, or there is none"
    lines = [f"{found.as_of}: equity {found.equity:.2f}, {len(found.orders)} orders, {len(found.fills)} fills", *(f"veto {v}" for v in found.decision.vetoes), *found.notes]
    return "\n".join(lines)


def journal(store: Store, args) -> str:
    return "\n".join(json.dumps(r, sort_keys=True) for r in daily.Journal(args.journal).tail(args.tail))


def watch(store: Store, args, opener=feeds.http, sleep=time.sleep, show=print) -> str:
    source, seen = feeds.QuoteSource(store.spark, feeds.ChartSource("1d", opener=opener)), 0
    while not args.count or seen < args.count:
        if seen:
            sleep(args.seconds)
        prices = source.quotes(args.symbols)
        show("  ".join(f"{s} {prices[s]:.2f}" if s in prices else f"{s} n/a" for s in args.symbols))
        seen += 1
    return f"{seen} looks"


def _members(store: Store, args, opener) -> DataFrame:
    return feeds.fetch_membership(store.spark, args.membership, opener)


def _names(store: Store, args, spans: DataFrame) -> list[str]:
    members = pit.ever_members(spans, args.start, args.end).select(scalars.market_ticker(F.col("ticker")).alias("s"))
    return sorted({r["s"] for r in members.collect()} | {args.benchmark})


def ingest(store: Store, args, opener=feeds.http) -> str:
    """Bars of all that were ever members, warm-up included, and a universe for the first of each month."""
    spans = _members(store, args, opener).persist()
    table, report, got = feeds.ingest(store.spark, store.table("bars"), "bars", feeds.ChartSource(args.range, opener=opener), _names(store, args, spans), parsers.chart_bars, pause=args.pause)
    store.replace("bars", table.where(F.col("date") >= F.lit(args.start - dt.timedelta(days=WARM_UP_DAYS))) if args.trim else table)
    days = pit.snapshot_dates(store.spark, args.start, args.end)
    on = (F.col("start_date") <= F.col("snapshot")) & (F.col("snapshot") <= F.coalesce("end_date", F.lit("9999-12-31").cast("date")))
    members = spans.join(F.broadcast(days), on).select(F.col("snapshot").alias("effective"), scalars.market_ticker(F.col("ticker")).alias("symbol"), F.col("snapshot").alias("knowable_at")).distinct()
    store.upsert("universe", members)
    return feeds.coverage(report, got.failed)


def ingest_splits(store: Store, args, opener=feeds.http) -> str:
    source = feeds.ChartSource(args.range, events=True, opener=opener)
    known = lambda p: parsers.chart_splits(p).withColumn("knowable_at", F.col("date"))
    table, report, got = feeds.ingest(store.spark, store.table("splits"), "splits", source, _names(store, args, _members(store, args, opener)), known, pause=args.pause)
    store.replace("splits", table)
    return feeds.coverage(report, got.failed)


def ingest_news(store: Store, args, opener=feeds.http) -> str:
    source = feeds.CannedSource({}) if args.stub else feeds.NewsSource(opener)
    now = args.now or dt.datetime.now(dt.UTC).strftime("%Y-%m-%d %H:%M:%S")
    names = [r["symbol"] for r in pit.universe(store.table("universe"), now[:10]).select("symbol").collect()]
    table, report, got = feeds.ingest(store.spark, store.table("news"), "news", source, sorted(names), lambda p: parsers.news_items(p, now, args.max_age_hours), pause=args.pause)
    store.replace("news", table)
    return feeds.coverage(report, got.failed)


def ingest_fundamentals(store: Store, args, opener=feeds.http) -> str:
    facts, failed = feeds.fetch_fundamentals(store.spark, feeds.FilingsClient(opener), [s for s in _names(store, args, _members(store, args, opener)) if s != args.benchmark])
    store.upsert("facts", facts)
    return json.dumps({"facts": facts.count(), "failures": [list(r) for r in failed.orderBy("symbol", "concept").collect()]}, sort_keys=True)


COMMANDS = {"ingest": ingest, "ingest-splits": ingest_splits, "ingest-news": ingest_news, "ingest-fundamentals": ingest_fundamentals, "backtest": backtest, "evaluate": evaluated, "cycle": cycle, "watch": watch, "journal": journal, "placebo": placebo, "power": power}
NEEDS_BARS = ("backtest", "evaluate", "cycle", "placebo", "power")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="vintage", description="Point-in-time research and trading on Spark.")
    out.add_argument("--db", default="data/market")
    out.add_argument("--benchmark", default="SPY")
    commands = out.add_subparsers(dest="command", required=True)
    today = dt.date.today()

    def add(name: str, start: dt.date | None = None, end: dt.date = today, **flags) -> argparse.ArgumentParser:
        one = commands.add_parser(name)
        if start:
            one.add_argument("--start", type=_day, default=start)
            one.add_argument("--end", type=_day, default=end)
        for flag, (kind, default) in flags.items():
            more = {"action": "store_true"} if kind is bool else {"type": kind, "default": default}
            one.add_argument("--" + flag.replace("_", "-"), **more)
        return one

    fetched = {"pause": (float, 0.2), "membership": (str, "")}
    add("ingest", dt.date(2018, 1, 1), range=(str, "30y"), trim=(bool, False), **fetched)
    add("ingest-splits", dt.date(2018, 1, 1), range=(str, "30y"), **fetched)
    add("ingest-fundamentals", dt.date(2018, 1, 1), **fetched | {"pause": (float, 0.12)})
    add("ingest-news", stub=(bool, False), max_age_hours=(int, 36), now=(str, ""), pause=(float, 0.3))
    traded = {"cash": (float, 10_000.0), "top_n": (int, 10), "rebalance_every": (int, 21), "spread_bps": (float, 5.0), "regime_filter": (bool, False), "risk_gate": (bool, False), "live_parity": (bool, False)}
    names = ["momentum", "fundamental", "news", "lowvol", "reversal", "candles", "gap", "cef"]
    for one in (add("backtest", dt.date(2018, 1, 1), **traded), add("evaluate", dt.date(2018, 1, 1), windows=(int, 4), holdout=(float, evaluate.HOLDOUT), **traded)):
        one.add_argument("--signal", nargs="+", choices=names, default=["momentum"])
        one.add_argument("--weighting", choices=["equal", "invvol"], default="equal")
    one = add("cycle", as_of=(_day, None), as_of_floor=(str, daily.FLOOR), max_weight=(float, 0.20), journal=(str, "journal.jsonl"), sim_state=(str, "account.json"), halt=(bool, False), live=(bool, False), cash=(float, 10_000.0), spread_bps=(float, 5.0), top_n=(int, 10), regime_filter=(bool, False))
    one.add_argument("--signals", nargs="+", choices=names, default=["momentum", "fundamental"])
    one = add("watch", seconds=(float, 15.0), count=(int, 0))
    one.add_argument("--symbols", nargs="+", required=True)
    add("journal", tail=(int, 10), journal=(str, "journal.jsonl"))
    studied = {"top_n": (int, 10), "rebalance_every": (int, 21)}
    add("placebo", dt.date(2000, 1, 1), dt.date(2026, 8, 1), trials=(int, 30), **studied)
    add("power", dt.date(2000, 1, 1), dt.date(2026, 8, 1), **studied)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    store = Store(spark or get_session(), args.db)
    if args.command in NEEDS_BARS and store.table("bars").isEmpty():
        print(f"no bars in {args.db}; ingest some first", file=sys.stderr)
        return 1
    print(COMMANDS[args.command](store, args))
    return 0


if __name__ == "__main__":
    sys.exit(main())
