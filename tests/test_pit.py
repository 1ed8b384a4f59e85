"""The point-in-time invariant, swept over dates, with a planted leak to show that the sweep would notice one."""

import datetime as dt

from pyspark.sql import functions as F

from vintage.operators import pit


FIRST = dt.date(2019, 11, 4)
# Days from the first on which each symbol has a bar: now and then, in two spells, at ever longer intervals.
TRADED = {"ORE": [d for d in range(50) if d % 5 not in (1, 2)], "TIN": [*range(4, 15), *range(33, 50)], "ZNC": [k * k for k in range(7)]}


def bars(spark):
    rows = []
    for k, (symbol, days) in enumerate(TRADED.items()):
        for d in days:
            close, day = 30.0 * (k + 1) + (d * 7) % 11, FIRST + dt.timedelta(days=d)
            rows.append((symbol, day, close - 1, close + 2, close - 3, close, close / 2, 500 + d, day))
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, adj_close double, volume long, knowable_at date")


def leaks(frame):
    return frame.where("bar_date > as_of").count()


def test_no_read_sees_the_future_and_batch_equals_scalar(spark):
    b = bars(spark)
    days = [FIRST + dt.timedelta(days=k) for k in range(-2, 55, 3)]
    marks = spark.createDataFrame([(s, d) for s in (*TRADED, "NONE") for d in days], "symbol string, as_of date")
    found = pit.lookup(b.withColumn("bar_date", F.col("date")), marks, ["symbol"], "date", "as_of", ["bar_date", "close"])
    assert leaks(found) == 0
    batch = {(r["symbol"], r["as_of"]): r["close"] for r in found.collect() if r["close"] is not None}
    one = {(r["symbol"], d): r["close"] for d in days for r in pit.latest_bars(b, d).collect()}
    assert batch == one


def test_a_planted_leak_is_noticed(spark):
    b = bars(spark).withColumn("bar_date", F.col("date")).withColumn("date", F.date_sub("date", 1))
    marks = spark.createDataFrame([("TIN", FIRST + dt.timedelta(days=8))], "symbol string, as_of date")
    assert leaks(pit.lookup(b, marks, ["symbol"], "date", "as_of", ["bar_date"])) == 1


def test_last_n_are_the_naive_ones(spark):
    b = bars(spark)
    all_ = [r.asDict() for r in b.collect()]
    for day in (str(FIRST + dt.timedelta(days=d)) for d in (0, 13, 21, 40, 90)):
        for n in (2, 5, 40):
            known = sorted((r for r in all_ if str(r["knowable_at"]) <= day), key=lambda r: r["date"])
            naive = {(s, r["date"]) for s in TRADED for r in [x for x in known if x["symbol"] == s][-n:]}
            assert {(r["symbol"], r["date"]) for r in pit.last_n_bars(b, day, n).collect()} == naive


def test_a_restatement_counts_from_its_filing(spark):
    d = dt.date
    facts = spark.createDataFrame(
        [("AAA", "E", d(2025, 9, 30), 1.0, d(2025, 11, 1), "a"), ("AAA", "E", d(2024, 9, 30), 2.0, d(2025, 12, 1), "b"), ("AAA", "E", d(2025, 9, 30), 3.0, d(2025, 12, 1), "c")],
        "symbol string, concept string, period_end date, value double, knowable_at date, accn string",
    )
    marks = spark.createDataFrame([("AAA", d(2025, 10, 31)), ("AAA", d(2025, 11, 30)), ("AAA", d(2025, 12, 1))], "symbol string, as_of date")
    assert {r["as_of"]: r["value"] for r in pit.fundamentals_calendar(facts, marks).collect()} == {d(2025, 11, 30): 1.0, d(2025, 12, 1): 3.0}


def test_split_factor(spark):
    d = dt.date
    splits = spark.createDataFrame([("PLT", d(2016, 3, 7), 3.0), ("PLT", d(2018, 9, 3), 0.5), ("PLT", d(2020, 2, 3), -2.0), ("PLT", d(2021, 5, 4), 5.0)], "symbol string, date date, ratio double")
    wanted = {("PLT", d(2015, 1, 1)): 7.5, ("PLT", d(2016, 3, 6)): 7.5, ("PLT", d(2016, 3, 7)): 2.5, ("PLT", d(2018, 9, 4)): 5.0, ("PLT", d(2021, 5, 4)): 1.0, ("LED", d(2015, 1, 1)): 1.0}
    asked = spark.createDataFrame(list(wanted), "symbol string, after date")
    assert {(r["symbol"], r["after"]): r["factor"] for r in pit.split_factor_after(splits, asked, "after").collect()} == wanted
