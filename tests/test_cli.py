"""Commands over a small market that was put in through the store, and reports of their rows."""

import datetime as dt
import json

import pytest

from vintage import cli
from vintage.plans import reports
from vintage.sources.store import Store

START = dt.date(2022, 1, 3)


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("db"))
    store, rows = Store(spark, folder), []
    assert store.table("bars").isEmpty()
    for k, (name, drift) in enumerate((("UPP", 1.004), ("FLT", 1.0), ("DWN", 0.997), ("SPY", 1.0005))):
        price = 50.0 + k
        for n in range(420):
            rows.append((name, START + dt.timedelta(days=n), price, price, price, price * drift, price * drift, 1000, START + dt.timedelta(days=n)))
            price *= drift * (1.001 if n % 2 else 0.999)
    store.upsert("bars", spark.createDataFrame(rows, store.table("bars").schema))
    store.upsert("universe", spark.createDataFrame([(START, s, START) for s in ("UPP", "FLT", "DWN")], store.table("universe").schema))
    return folder


def run(spark, capsys, db, *argv):
    code = cli.main(["--db", db, *argv], spark)
    return code, capsys.readouterr().out


def test_store_keeps_the_last_and_what_stays(spark, db):
    store = Store(spark, db)
    new = store.table("bars").where("symbol = 'FLT' AND date = date'2022-01-05'").selectExpr("symbol", "date", "open", "high", "low", "7.0D AS close", "adj_close", "volume", "date_add(knowable_at, 9) AS knowable_at")
    before = store.table("bars").count()
    store.upsert("bars", new)
    row = store.table("bars").where("symbol = 'FLT' AND date = date'2022-01-05'").first()
    assert row["close"] == 7.0 and row["knowable_at"] == dt.date(2022, 1, 5) and store.table("bars").count() == before
    kept = store.preload(START, START + dt.timedelta(days=2), ["UPP", "FLT"])
    assert kept.count() == 6 and kept.is_cached and store.preload(START, START, []).count() == 0
    store.drop_cache()
    assert store._kept is None


def test_backtest_and_evaluate(spark, capsys, db):
    code, out = run(spark, capsys, db, "backtest", "--start", "2022-10-01", "--end", "2023-02-20", "--top-n", "1", "--live-parity")
    assert code == 0 and "momentum" in out and "benchmark" in out and "Sharpe edge" in out and "beta" in out
    code, out = run(spark, capsys, db, "evaluate", "--start", "2022-10-01", "--end", "2023-02-20", "--windows", "2", "--top-n", "1")
    assert code == 0 and "research windows passed" in out
    with pytest.raises(SystemExit):
        cli.main(["--db", db, "backtest", "--start", "2030-01-01", "--end", "2030-02-01"], spark)


def test_cycle_journal_and_empty_store(spark, capsys, db, tmp_path):
    own = ["--journal", str(tmp_path / "j"), "--sim-state", str(tmp_path / "s"), "--signals", "momentum"]
    code, out = run(spark, capsys, db, "cycle", *own, "--top-n", "2")
    assert code == 0 and "1 fills" in out
    assert "nothing to do" in run(spark, capsys, db, "cycle", *own)[1]
    code, out = run(spark, capsys, db, "journal", "--journal", str(tmp_path / "j"), "--tail", "1")
    assert json.loads(out)["positions"].keys() == {"UPP"}
    assert cli.main(["--db", str(tmp_path / "none"), "backtest"], spark) == 1


def test_ingest_and_watch(spark, tmp_path):
    from test_feeds import chart

    text = b"ticker,start_date,end_date\nUP.P,2000-01-01,\n"
    opener = lambda url: text if url == "members" else b"{}" if "SPY" in url else chart(3.0, 4.0).encode()
    store = Store(spark, str(tmp_path / "db"))
    args = cli.parser().parse_args(["ingest", "--membership", "members", "--start", "2023-10-01", "--end", "2023-12-15", "--pause", "0"])
    assert json.loads(cli.ingest(store, args, opener))["coverage"] == 0.5
    assert store.table("bars").count() == 2 and sorted(str(r["effective"]) for r in store.table("universe").collect()) == ["2023-10-01", "2023-11-01", "2023-12-01"]
    seen = []
    args = cli.parser().parse_args(["watch", "--symbols", "A", "B", "--count", "2"])
    price = lambda url: json.dumps({"chart": {"result": [{"meta": {"regularMarketPrice": 5.0}}]}}).encode() if "/A?" in url else b"{}"
    assert cli.watch(store, args, price, seen.append, seen.append) == "2 looks" and seen == ["A 5.00  B n/a", 15.0, "A 5.00  B n/a"]


def test_reports():
    verdict = {"research_passed": 1, "research_total": 4, "holdout_edge": None, "gate_passed": False}
    windows = [{"kind": "research", "start": START, "end": START, "n_dates": 1, "edge": None, "passed": False}]
    assert reports.walk_forward(verdict, windows).splitlines() == ["research 2022-01-03 to 2022-01-03: insufficient data in window", "1 of 4 research windows passed, holdout edge n/a: the gate stays shut"]
    good, bad = {"total_return": 0.5, "cagr": 0.2, "sharpe": 1.0, "max_drawdown": -0.1}, {"total_return": 0.1, "cagr": 0.1, "sharpe": 0.7, "max_drawdown": -0.2}
    assert "x passes" in reports.backtest("x", good, bad, 3) and "x does not pass" in reports.backtest("x", good | {"max_drawdown": -0.3}, bad, 3)
    assert reports.placebo({"trials": 0}, []) == "no trials" and "too few" in reports.papercheck({"correlation": None, "n": 0})
    rows = [{"name": "0.5", "research_passed": 4, "holdout_edge": 0.9, "gate_passed": True}, {"name": "0.0", "research_passed": 0, "holdout_edge": -0.1, "gate_passed": False}]
    assert reports.power(rows).endswith("strength of 0.5 on") and reports.power(rows[1:]).endswith("no strength passes")
    assert reports.session({"samples": 2, "regular_samples": 1, "first": 10.0, "last": 11.0, "pnl": 1.0, "pct": 0.1}) == "2 samples, 1 in regular hours: 10.00 to 11.00, +1.00 (+10.00 %)"
    text = reports.placebo({"trials": 3, "passed": 1, "pass_rate": 1 / 3, "median_edge": 0.0, "best_edge": 0.4}, [{"research_passed": 0, "trials": 2}, {"research_passed": 1, "trials": 1}])
    assert "1 of 3" in text and "0 windows  ## 2" in text
