"""The simulated broker, the gate's vetoes, and the daily cycle over a small market."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from vintage.operators import portfolio
from vintage.operators.broker import Account, Order, Position, Rejected, SimulatedBroker
from vintage.plans.cycle import DailyCycle, Journal, run_once

DAYS = [dt.date(2024, 5, 6) + dt.timedelta(days=k) for k in range(5)]
PRICES = {"KLM": 40.0, "NOP": 20.0, "QRS": 8.0}


@pytest.fixture
def market(spark):
    bars = spark.createDataFrame([(s, d, p, p, d) for s, p in PRICES.items() for d in DAYS], "symbol string, date date, open double, close double, knowable_at date")
    snapshots = spark.createDataFrame([(DAYS[0], s, DAYS[0]) for s in PRICES], "effective date, symbol string, knowable_at date")
    return bars, snapshots


def likes(*names):
    return lambda d: d.withColumn("value", F.when(F.col("symbol").isin(*names), 1.0).otherwise(-1.0)).withColumn("confidence", F.lit(1.0))


def cycle(spark, market, tmp_path, scorers, **more):
    limits = portfolio.RiskLimits(max_weight=0.5)
    return DailyCycle(spark, *market, scorers, SimulatedBroker(1000.0, 0.0, str(tmp_path / "book.json")), Journal(str(tmp_path / "journal.jsonl")), limits, **more)


def test_broker_fills_rejects_and_remembers(tmp_path):
    path = str(tmp_path / "s.json")
    broker = SimulatedBroker(1000.0, 20.0, path)
    first, second = broker.place(Order("KLM", "BUY", 10), 40.0), broker.place(Order("KLM", "BUY", 5), 50.0)
    assert first.price == pytest.approx(40.04) and second.price == pytest.approx(50.05)
    assert broker.account().positions["KLM"].average_cost == pytest.approx((10 * 40.04 + 5 * 50.05) / 15)
    for order, price in ((Order("KLM", "SELL", 16), 40.0), (Order("KLM", "BUY", 100), 40.0), (Order("X", "BUY", 1), None), (Order("X", "HOLD", 1), 1.0), (Order("X", "BUY", 0), 1.0), (Order("X", "BUY", float("nan")), 1.0)):
        with pytest.raises(Rejected):
            broker.place(order, price)
    sold = broker.place(Order("KLM", "SELL", 15), 60.0)
    assert sold.price == pytest.approx(59.94) and not broker.account().positions
    assert SimulatedBroker(5.0, 20.0, path).account() == broker.account()
    assert Account(1.0, {"A": Position(2.0, 3.0), "B": Position(1.0, 7.0)}).equity({"A": 10.0}) == 28.0


def test_vetoes_name_what_the_gate_changed():
    limits = portfolio.RiskLimits(max_positions=2, max_weight=0.4, max_gross=0.7, min_positions=2)
    state = portfolio.State(1.0, 1.0, 1.0)
    found = portfolio.judge({"A": 0.5, "B": 0.45, "C": 0.1, "D": -1.0}, limits, state)
    assert found.vetoes == ("too-many:3", "capped:A", "capped:B", "gross:0.8000") and found.targets == pytest.approx({"A": 0.35, "B": 0.35})
    assert portfolio.judge({"A": 0.5}, limits, state) == portfolio.Decision(None, ("too-few:1",))
    for change, code in (({"halted": True}, "halted"), ({"reconciled": False}, "unreconciled"), ({"stale_days": 5}, "stale"), ({"equity": 0.0}, "no-equity"), ({"equity": 0.95}, "daily-loss"), ({"peak": 1.4}, "drawdown")):
        now = portfolio.State(**{"equity": 1.0, "peak": 1.0, "previous": 1.0} | change)
        assert portfolio.judge({"A": 0.1, "B": 0.1}, limits, now) == portfolio.Decision(None, (code,))
    off = portfolio.State(1.0, 1.0, 1.0, risk_on=False)
    assert portfolio.judge({"A": 0.1}, limits, off) == portfolio.Decision({}, ("risk-off",))


def test_a_day_is_traded_once_and_written_down(spark, market, tmp_path):
    today = cycle(spark, market, tmp_path, {"liked": likes("KLM", "NOP")})
    found = run_once(today)
    assert [(f.symbol, f.side) for f in found.fills] == [("KLM", "BUY"), ("NOP", "BUY")] and found.as_of == str(DAYS[-1])
    assert sum(f.shares * f.price for f in found.fills) == pytest.approx(980.0)
    assert run_once(today) is None and run_once(cycle(spark, market, tmp_path, {"liked": likes("QRS")})) is None
    record = today.journal.last()
    assert record["positions"].keys() == {"KLM", "NOP"} and record["universe_size"] == 3 and record["risk_vetoes"] == []
    later = cycle(spark, market, tmp_path, {"liked": likes("QRS", "NOP"), "broken": lambda d: 1 / 0})
    found = later.run(DAYS[-1] + dt.timedelta(days=1))
    assert [o.side for o in found.orders] == sorted((o.side for o in found.orders), reverse=True) and ("KLM", "SELL") in [(f.symbol, f.side) for f in found.fills]
    assert "signal broken failed: ZeroDivisionError" in found.notes


def test_breaks_halts_and_stale_data_hold(spark, market, tmp_path):
    own = cycle(spark, market, tmp_path, {"liked": likes("KLM", "NOP")})
    run_once(own)
    own.broker.place(Order("KLM", "SELL", 3), 40.0)
    found = own.run(DAYS[-1])
    assert found.decision.vetoes == ("unreconciled",) and not found.orders and any(n.startswith("shares KLM") for n in found.notes)
    again = own.run(DAYS[-1], halt=True)
    assert again.decision.vetoes == ("halted",) and not again.fills
    assert own.run(DAYS[-1] + dt.timedelta(days=9)).decision.vetoes == ("stale",)
    assert len(own.journal.read()) == 4


def test_a_torn_journal_is_read(tmp_path):
    journal = Journal(str(tmp_path / "j"))
    assert journal.read() == [] and journal.last() is None and journal.tail(0) == []
    journal.append({"as_of": "2024-05-06", "n": 1})
    with open(journal.path, "a") as f:
        f.write("\n[1]\nnot json\n")
    journal.append({"as_of": "2024-05-07", "n": 2})
    with open(journal.path, "a") as f:
        f.write(json.dumps({"as_of": "2024-05-08"})[:9])
    assert [r["n"] for r in journal.read()] == [1, 2] and journal.last()["n"] == 2 and [r["n"] for r in journal.tail(1)] == [2]


def test_quotes_override_execution_prices(spark, market, tmp_path):
    own = cycle(spark, market, tmp_path, {"liked": likes("KLM", "NOP")}, quotes=lambda names: {"KLM": 50.0, "NOP": None})
    assert {f.symbol: f.price for f in run_once(own).fills} == {"KLM": 50.0, "NOP": 20.0}
