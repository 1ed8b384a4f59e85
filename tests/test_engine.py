"""Pins of single operators, and the trading fold against a plain one."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from vintage.functions import scalars
from vintage.operators import evaluate, portfolio, simulate
from vintage.streaming import ticks


def test_commission_pins(spark):
    rows = [(1000.0, 50.0, 3.5), (10.0, 500.0, 0.35), (1.0, 30.0, 0.3), (0.5, 20.0, 0.1), (0.0, 100.0, 0.0)]
    df = spark.createDataFrame(rows, "s double, p double, w double")
    for r in df.withColumn("f", scalars.commission(F.col("s"), F.col("p"))).collect():
        assert r["f"] == pytest.approx(r["w"]) == pytest.approx(simulate.fee(r["s"], r["p"]))
    with pytest.raises(ValueError):
        simulate.fee(-1, 1)


def test_midrank_pins(spark):
    rows = [("d", s, v, c) for s, v, c in (("a", 1.0, 1.0), ("b", 2.0, 1.0), ("c", 2.0, 1.0), ("d", 3.0, 1.0), ("e", 9.0, 0.0))]
    df = spark.createDataFrame(rows, "as_of string, symbol string, value double, confidence double")
    assert {r["symbol"]: r["midrank"] for r in portfolio.midrank(df, ["as_of"]).collect()} == {"a": 0.0, "b": 0.5, "c": 0.5, "d": 1.0}
    assert portfolio.midrank(df.where("symbol = 'a'"), ["as_of"]).first()["midrank"] == 0.5


def test_sharpe_pin(spark):
    points = [100, 102, 103.02, 105.0804, 106.131204]
    df = spark.createDataFrame([("r", dt.date(2026, 1, 1) + dt.timedelta(days=k), float(p)) for k, p in enumerate(points)], "run string, date date, equity double")
    assert evaluate.metrics(df, ["run"]).first()["sharpe"] == pytest.approx(41.2456, rel=1e-4)


def test_windows():
    d = dt.date
    cut = evaluate.calendar_windows(d(2020, 1, 1), d(2020, 12, 31), 4)
    assert cut[0][0] == d(2020, 1, 1) and cut[-1][1] == d(2020, 12, 31) and all(b + dt.timedelta(days=1) == a for (_, b), (a, _) in zip(cut, cut[1:]))
    for bad in ((d(2020, 1, 2), d(2020, 1, 1), 1), (d(2020, 1, 1), d(2020, 1, 3), 4), (d(2020, 1, 1), d(2020, 2, 1), 0)):
        with pytest.raises(ValueError):
            evaluate.calendar_windows(*bad)


def test_gate_never_adds():
    draw = random.Random(3)
    for _ in range(200):
        weights = {f"S{k}": draw.uniform(-0.1, 0.6) for k in range(draw.randint(0, 40))}
        out = portfolio.gate(weights, portfolio.RiskLimits(), equity=1.0, peak=1.0, previous=1.0, stale_days=0)
        assert all(w <= weights[s] + 1e-12 and w <= 0.2 + 1e-12 for s, w in out.items()) and sum(out.values()) <= 1 + 1e-9 and len(out) <= 30
    assert portfolio.gate({"A": 0.1}, portfolio.RiskLimits(), equity=0.9, peak=1.3, previous=0.9, stale_days=0) is None
    assert portfolio.gate({"A": 0.1}, portfolio.RiskLimits(), equity=1, peak=1, previous=1, stale_days=0, risk_on=False) == {}


def plain_fold(dates, bars, decided, cash, spread, stale_days, buffer=0.0, gate=None):
    """A book as a list of trades: cash and holdings are summed from it anew whenever they are asked for."""
    tape, curve, orders = [], [], None  # (symbol, signed size, price, cost)
    money = lambda: cash - sum(size * price + cost for _, size, price, cost in tape)

    def held(symbol):
        total = 0.0
        for s, size, _, _ in tape:
            total = total + size if s == symbol else total
            total = 0.0 if s == symbol and abs(total) < 1e-9 else total
        return total

    def seen(symbol, today):
        return max((b for b in bars[symbol] if b[0] <= today), default=None)

    for today in dates:
        for s in sorted(bars):
            last, own = seen(s, today), held(s)
            if own and last and last[0] + dt.timedelta(days=stale_days) <= today:
                tape.append((s, -own, last[2], simulate.fee(own, last[2])))
        if orders is not None:
            trading = {s: seen(s, today)[1] for s in bars if seen(s, today) and seen(s, today)[0] == today}
            total = (money() + sum(held(s) * o for s, o in trading.items())) * (1 - buffer)
            goals = [(s, orders.get(s, 0.0) * total / o - held(s), o) for s, o in sorted(trading.items())]
            for s, move, o in goals:
                if abs(move) * o < 1:
                    continue
                price = o + o * spread / 20000 * (1 if move > 0 else -1)
                if move > 0 and money() < move * price + simulate.fee(move, price):
                    move = (money() - simulate.fee(move, price)) / price
                    if move * price < 1:
                        continue
                tape.append((s, move, price, simulate.fee(abs(move), price)))
            orders = None
        curve.append(money() + sum(held(s) * seen(s, today)[2] for s in bars if held(s) and seen(s, today)))
        if today in decided:
            orders = decided[today]
            if gate:
                newest = max(seen(s, today)[0] for s in bars if seen(s, today))
                orders = gate(orders, curve, max(cash, *curve), (today - newest).days)
    return curve, [(s, "BUY" if size > 0 else "SELL", abs(size)) for s, size, _, _ in tape]


def test_fold_equals_a_plain_one(spark):
    draw = random.Random(11)
    start = dt.date(2024, 1, 1)
    dates = [start + dt.timedelta(days=k) for k in range(60)]
    runs, bar_rows, target_rows, wanted = [], [], [], {}
    bars = {}
    for s in "ABCDE":
        price, bars[s] = 50.0, []
        for k, day in enumerate(dates):
            price *= 1 + draw.uniform(-0.05, 0.05)
            if draw.random() < 0.8 and not (s == "E" and k > 30):
                bars[s].append((day, price * (1 + draw.uniform(-0.02, 0.02)), price))
        bar_rows += [(s, *b) for b in bars[s]]
    for run in ("r1", "r2", "r3"):
        decided = {}
        for day in dates[:-1:7]:
            names = draw.sample("ABCDE", draw.randint(0, 4))
            decided[day] = {s: 1 / len(names) for s in names}
            target_rows += [(run, day, s, w, None, None) for s, w in decided[day].items()] or [(run, day, None, None, None, None)]
        runs.append((run, dates[0], dates[-1]))
        wanted[run] = plain_fold(dates, bars, decided, 10_000.0, 5.0, 5)
    out = simulate.simulate(
        spark.createDataFrame(runs, "run string, start date, end date"),
        spark.createDataFrame([(d,) for d in dates], "date date"),
        spark.createDataFrame(bar_rows, "symbol string, date date, open double, close double"),
        spark.createDataFrame(target_rows, "run string, as_of date, symbol string, weight double, risk_on boolean, newest date"),
    ).collect()
    for run, (curve, trades) in wanted.items():
        own = [r for r in out if r["run"] == run]
        assert [r["equity"] for r in sorted((r for r in own if r["kind"] == "equity"), key=lambda r: r["date"])] == pytest.approx(curve)
        assert sorted((r["symbol"], r["side"], round(r["shares"], 6)) for r in own if r["kind"] == "trade") == sorted((s, side, round(n, 6)) for s, side, n in trades)


def test_stream_of_ticks_drops_the_late(spark, tmp_path):
    day = lambda d, h: dt.datetime(2024, 1, d, h)
    schema, seen = "symbol string, ts timestamp, value double", set()
    for k, rows in enumerate(([("A", day(1, 9), 1.0), ("A", day(1, 17), 2.0)], [("A", day(4, 9), 3.0)], [("A", day(4, 10), 3.0)], [("A", day(1, 12), 99.0), ("A", day(9, 9), 4.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for file in set((tmp_path / "in").glob("*.parquet")) - seen:
            os.utime(file, (1e9 + 60 * k, 1e9 + 60 * k))  # files come in order of their time
            seen.add(file)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ticks.daily_bars(stream, "1 day").writeStream.format("memory").queryName("daily").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = {str(r["date"]): (r["open"], r["close"], r["volume"]) for r in spark.table("daily").collect()}
    assert found["2024-01-01"] == (1.0, 2.0, 2) and found["2024-01-04"][:2] == (3.0, 3.0)


def test_reply_parsing(spark):
    rows = [('so {"direction": 3, "confidence": 0.5, "rationale": "r"} ok',), ("no",), (None,)]
    found = [r["x"] for r in spark.createDataFrame(rows, "reply string").select(scalars.parse_reply(F.col("reply")).alias("x")).collect()]
    assert (found[0]["direction"], found[0]["confidence"]) == (1.0, 0.5) and found[1]["rationale"] == found[2]["rationale"] == "unparseable reply"
