"""The whole of a backtest, gate, regime, inverse vol, walk-forward and seeded studies, against plain Python over a small market."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F
from test_engine import plain_fold

from vintage.operators import evaluate, portfolio, signals, simulate
from vintage.plans import studies

START = dt.date(2021, 1, 4)
DATES = [START + dt.timedelta(days=k) for k in range(150)]
NAMES = ["A", "B", "C", "D", "E", "F"]


@pytest.fixture(scope="module")
def market(spark):
    draw, bars = random.Random(4), {}
    for s in [*NAMES, "MKT"]:
        price, bars[s] = 60.0, []
        for k, day in enumerate(DATES):
            price *= 1 + draw.uniform(-0.04, 0.04)
            if s == "MKT" or draw.random() < 0.9 and not (s == "F" and k > 100):
                bars[s].append((day, price * (1 + draw.uniform(-0.01, 0.01)), price))
    rows = [(s, d, o, c, c, d) for s, own in bars.items() for d, o, c in own]
    frame = spark.createDataFrame(rows, "symbol string, date date, open double, close double, adj_close double, knowable_at date")
    snapshots = spark.createDataFrame([(START, s, START) for s in NAMES], "effective date, symbol string, knowable_at date")
    return bars, frame.where("symbol <> 'MKT'").persist(), frame.where("symbol = 'MKT'").persist(), snapshots


def last(bars, s, day):
    return max((b for b in bars[s] if b[0] <= day), default=None)


def scores_on(bars, day, lookback=5):
    out = {}
    for s in NAMES:
        own = [b[2] for b in bars[s] if b[0] <= day][-lookback:]
        if len(own) == lookback:
            out[s] = -(own[-1] / own[0] - 1)
    return out


def top(scores, n):
    return [s for _, s in sorted((-v, s) for s, v in scores.items() if v > 0)[:n]]


def inverse_vol(bars, names, day, lookback):
    vols = {}
    for s in names:
        own = [b[2] for b in bars[s] if b[0] <= day][-lookback:]
        if len(own) == lookback:
            vols[s] = statistics.stdev([math.log(b / a) for a, b in zip(own, own[1:])]) * math.sqrt(252)
    middle = statistics.median(vols.values()) if vols else 1.0
    parts = {s: 1 / vols.get(s, middle) for s in names}
    return {s: x / sum(parts.values()) for s, x in parts.items()}


def plain_run(bars, dates, every, n, *, invvol=0, regime=0, limits=None, buffer=0.0):
    decided = {}
    for day in dates[:-1:every]:
        chosen = top(scores_on(bars, day), n)
        decided[day] = inverse_vol(bars, chosen, day, invvol) if invvol else {s: 1 / len(chosen) for s in chosen}
        if regime:
            own = [b[2] for b in bars["MKT"] if b[0] <= day][-regime:]
            if len(own) < regime or own[-1] < sum(own) / regime:
                decided[day] = {}

    def gate(weights, curve, peak, stale):
        if not weights and regime:
            return weights
        return portfolio.gate(weights, limits, equity=curve[-1], peak=peak, previous=curve[-2] if len(curve) > 1 else curve[-1], stale_days=stale)

    market = {s: bars[s] for s in NAMES}
    return plain_fold(dates, market, decided, 10_000.0, 5.0, 5, buffer, gate if limits else None)


def spark_run(spark, market, settings=simulate.Settings(), runs=None, **options):
    _, frame, bench, snapshots = market
    runs = runs or studies.runs_frame(spark, [("r", DATES[0], DATES[-1])])
    targets = studies.targets_of(runs, frame, bench, snapshots, {"reversal": lambda d: signals.reversal(frame, d)}, calendar=bench.select("date"), **options)
    return simulate.simulate(runs, bench.select("date"), frame, targets, settings).persist()


CASES = {
    "plain": ({"every": 7, "top": 3}, {}, {}),
    "inverse vol": ({"every": 6, "top": 4, "weighting": "invvol", "vol_lookback": 12}, {"invvol": 12}, {}),
    "regime": ({"every": 5, "top": 2, "regime": 10}, {"regime": 10}, {}),
    "gate": ({"every": 4, "top": 2}, {"limits": portfolio.RiskLimits(max_weight=0.3, max_daily_loss=0.02, max_drawdown=0.15), "buffer": 0.02}, {"limits": portfolio.RiskLimits(max_weight=0.3, max_daily_loss=0.02, max_drawdown=0.15), "cash_buffer": 0.02}),
    "gate and regime": ({"every": 5, "top": 3, "regime": 10}, {"regime": 10, "limits": portfolio.RiskLimits(max_positions=2)}, {"limits": portfolio.RiskLimits(max_positions=2)}),
}


@pytest.mark.parametrize("name", CASES)
def test_backtest_equals_plain_python(spark, market, name):
    options, plain, settings = CASES[name]
    curve, trades = plain_run(market[0], DATES, options["every"], options["top"], **plain)
    found = spark_run(spark, market, simulate.Settings(**settings), **options)
    assert [r["equity"] for r in studies.equity_of(found).orderBy("date").collect()] == pytest.approx(curve)
    own = [(r["symbol"], r["side"], round(r["shares"], 6)) for r in studies.trades_of(found).collect()]
    assert sorted(own) == sorted((s, side, round(n, 6)) for s, side, n in trades) and own


def test_the_gate_holds_on_stale_data():
    days = [START + dt.timedelta(days=k) for k in range(12)]
    bars, limits = {"A": [(days[0], 10.0, 10.0)]}, simulate.Settings(limits=portfolio.RiskLimits(max_weight=1.0), stale_days=99)
    late = simulate.fold(days, bars | {"B": [(d, 5.0, 5.0) for d in days]}, {days[8]: ({"B": 1.0}, None)}, limits, {days[8]: days[0]})
    assert late[1] == [] and simulate.fold(days, bars | {"B": [(d, 5.0, 5.0) for d in days]}, {days[8]: ({"B": 1.0}, None)}, limits, {days[8]: days[8]})[1]


def plain_metrics(curve):
    r = [b / a - 1 for a, b in zip(curve, curve[1:]) if a > 0]
    sd = statistics.stdev(r) if len(r) > 1 else 0
    peak, dd = curve[0], 0.0
    for e in curve:
        peak = max(peak, e)
        dd = min(dd, e / peak - 1)
    return (statistics.mean(r) / sd * math.sqrt(252) if sd else 0.0), dd


def plain_verdict(bars, curves):
    """curves: (kind, dates, equity) of each window."""
    passed, edges = [], []
    for kind, dates, curve in curves:
        first = last(bars, "MKT", dates[0])
        n = (10_000 - simulate.fee(10_000 / first[1], first[1])) / first[1]
        s, b = plain_metrics(curve), plain_metrics([n * last(bars, "MKT", d)[2] for d in dates])
        passed.append((kind, s[0] - b[0] >= 0.30 and s[1] >= b[1]))
        edges.append(s[0] - b[0])
    research = [ok for kind, ok in passed if kind == "research"]
    return sum(research), edges[-1], 2 * sum(research) > len(research) and passed[-1][1]


def test_walk_forward_equals_plain_python(spark, market):
    bars, frame, bench, snapshots = market
    runs, windows = studies.window_runs(spark, ["x"], DATES[0], DATES[-1], 3, 0.25)
    found = studies.studied(runs, windows, spark_run(spark, market, runs=runs, every=7, top=3), bench, ["name"]).first()
    curves = []
    for kind, a, b in evaluate.walk_windows(DATES[0], DATES[-1], 3, 0.25):
        dates = [d for d in DATES if a <= d <= b]
        curves.append((kind, dates, plain_run(bars, dates, 7, 3)[0]))
    research, edge, gate = plain_verdict(bars, curves)
    assert (found["research_passed"], found["research_total"], found["gate_passed"]) == (research, 3, gate) and found["holdout_edge"] == pytest.approx(edge)


def test_seeded_studies_equal_plain_python(spark, market):
    import hashlib

    bars, frame, bench, snapshots = market
    runs, windows = studies.window_runs(spark, ["0.0", "1.0"], DATES[0], DATES[-1], 2, 0.3)
    ahead = lambda d: signals.future_of(frame, d.select("as_of", "symbol").distinct(), 5)
    score = lambda d: signals.blended(d.join(ahead(d), ["as_of", "symbol"]), F.col("name").cast("double"), 0)
    targets = studies.seeded_targets(runs, windows, bench, snapshots, score, every=5, top=2)
    verdicts = studies.studied(runs, windows, simulate.simulate(runs, bench.select("date"), frame, targets), bench, ["name"])
    found = {r["name"]: r for r in verdicts.collect()}
    for name in ("0.0", "1.0"):
        curves = []
        for kind, a, b in evaluate.walk_windows(DATES[0], DATES[-1], 2, 0.3):
            dates, decided = [d for d in DATES if a <= d <= b], {}
            for day in dates[:-1:5]:
                scores = {}
                for s in NAMES:
                    later = [x[2] for x in bars[s] if x[0] > day][:6]
                    noise = int(hashlib.md5(f"0|{day}|{s}".encode()).hexdigest()[:8], 16) / 4294967295.0 * 2 - 1
                    if len(later) >= 2:
                        scores[s] = float(name) * (later[-1] / later[0] - 1) + (1 - float(name)) * noise
                chosen = top(scores, 2)
                decided[day] = {s: 1 / len(chosen) for s in chosen}
            curves.append((kind, dates, plain_fold(dates, {s: bars[s] for s in NAMES}, decided, 10_000.0, 5.0, 5)[0]))
        research, edge, gate = plain_verdict(bars, curves)
        r = found[name]
        assert (r["research_passed"], r["gate_passed"]) == (research, gate) and r["holdout_edge"] == pytest.approx(edge)
    assert found["1.0"]["holdout_edge"] > found["0.0"]["holdout_edge"]
    counted = {r["research_passed"]: r["trials"] for r in studies.histogram(verdicts).collect()}
    assert counted.keys() == {0, 1, 2} and sum(counted.values()) == 2 and studies.summary(verdicts).first()["trials"] == 2


def test_probe_of_picks_equals_plain_python(spark, market):
    bars, frame, bench, snapshots = market
    decided = spark.createDataFrame([(DATES[80], s) for s in NAMES], "as_of date, symbol string")
    row = studies.correlation_probe(frame, decided, {"x": lambda d: d.withColumn("value", F.lit(1.0)).withColumn("confidence", F.lit(1.0))}, top=3, lookback=20).first()
    returns = {}
    for s in NAMES[:3]:
        own = [b for b in bars[s] if b[0] <= DATES[80]][-21:]
        returns[s] = {b[0]: b[2] / a[2] - 1 for a, b in zip(own, own[1:])}
    pairs = []
    for i, j in (("A", "B"), ("A", "C"), ("B", "C")):
        both = sorted(returns[i].keys() & returns[j].keys())
        pairs.append(statistics.correlation([returns[i][d] for d in both], [returns[j][d] for d in both]))
    assert row["n_pairs"] == 3 and row["mean_correlation"] == pytest.approx(statistics.mean(pairs))
