"""Chosen filings and due dates: amendments, lost originals, ties, nulls, and holidays that follow a weekend."""

import datetime as dt

from moodtide.operators import calendars as C, choices as O

D = dt.date
HOLDINGS = "key string, form string, report date, filed date, accession string"
REPORTS = "key string, form string, report date, filed string, accepted string, accession string, description string"


def test_two_quarters(spark):
    q = [D(2025, 3, 31), D(2025, 6, 30), D(2025, 9, 30)]
    rows = [
        ("plain", "13F-HR", q[0], D(2025, 5, 1), "a"), ("plain", "13F-HR", q[1], D(2025, 8, 1), "b"), ("plain", "13F-HR", q[2], D(2025, 11, 1), "c"),
        # an amendment of an older quarter doesn't matter
        ("plain", "13F-HR/A", q[0], D(2025, 6, 1), "d"),
        ("amended", "13F-HR", q[1], D(2025, 8, 1), "e"), ("amended", "13F-HR", q[2], D(2025, 11, 1), "f"), ("amended", "13F-HR/A", q[2], D(2025, 12, 1), "g"), ("amended", "13F-HR/A", q[1], D(2025, 12, 1), "h"),
        ("before", "13F-HR/A", q[1], D(2025, 8, 1), "i"), ("before", "13F-HR", q[2], D(2025, 11, 1), "j"),
        ("one", "13F-HR", q[2], D(2025, 11, 1), "k"), ("one", "13F-HR", None, D(2025, 8, 1), "l"), ("one", "13F-NT", q[1], D(2025, 8, 1), "m"),
        ("ties", "13F-HR", q[1], D(2025, 8, 1), "n"), ("ties", "13F-HR", q[1], D(2025, 8, 1), "o"), ("ties", "13F-HR", q[2], D(2025, 11, 2), "p"), ("ties", "13F-HR", q[2], D(2025, 11, 1), "q"), ("ties", "13F-HR", q[2], D(2025, 11, 2), "p"),
        ("none", "10-K", q[1], D(2025, 8, 1), "r"), (None, "13F-HR", q[1], D(2025, 8, 1), "s"), (None, "13F-HR", q[2], None, "t"),
    ]
    df = spark.createDataFrame(rows, HOLDINGS)
    got = {r["key"]: tuple(r)[1:] for r in O.two_quarters(df, ["key"]).collect()}
    assert got == {
        "plain": ("c", "b", None), "amended": (None, None, "amended 2025-09-30"), "before": (None, None, "amended 2025-06-30"), "one": (None, None, "no earlier quarter"), "ties": ("p", "o", None), None: ("t", "s", None),
    }
    assert O.two_quarters(df.limit(0), ["key"]).count() == 0


def test_shareholder_reports(spark):
    rows = [
        ("a", "N-CSR", D(2025, 6, 30), "2025-09-05", None, "1", "Own ETF - N-CSR"), ("a", "N-CSR/A", D(2025, 6, 30), "2025-09-20", "2025-09-20T10", "2", "own etf"), ("a", "N-CSRS", D(2025, 12, 31), "2026-03-01", None, "3", "OWN ETF"),
        ("a", "N-CSR", D(2026, 6, 30), "2026-09-05", None, "4", "Another"), ("a", "N-CSRSX", D(2026, 12, 31), "2027-01-01", None, "5", "Own ETF"), ("a", "N-CSR", D(2027, 6, 30), "2027-01-01", None, "6", None),
        ("b", "N-CSR", None, "2024-01-01", None, "7", "own etf"), ("b", "N-CSR", D(2025, 6, 30), "2025-09-01", None, "8", "own etf"), ("c", "10-K", None, "2025-01-01", None, "9", "own etf"),
    ]
    dates = C.calendar(spark, "2024-01-01", "2027-12-31")
    df = spark.createDataFrame(rows, REPORTS)
    got = {(r["key"], r["kind"]): r for r in O.shareholder_reports(df, dates, ["key"], "own etf", "2026-05-01").collect()}
    assert len(got) == 6
    a, half = got["a", O.ANNUAL], got["a", O.HALF]
    assert (a["accession"], a["amends"], a["period_end"], a["due_by"], a["due"], a["rolled"]) == ("2", True, D(2026, 6, 30), D(2026, 9, 8), D(2026, 9, 8), False)
    assert (half["accession"], half["period_end"], half["due_by"]) == ("3", D(2026, 12, 31), D(2027, 3, 11))
    # a report without a date comes first, and then the last period that ended is due
    assert got["b", O.ANNUAL]["accession"] == "7" and got["b", O.ANNUAL]["period_end"] == D(2025, 6, 30)
    none = got["c", O.HALF]
    assert none["accession"] is None and none["period_end"] == D(2025, 12, 31) and none["due_by"] == D(2026, 3, 11)
    assert O.shareholder_reports(df.limit(0), dates, ["key"], "own etf", "2026-05-01").count() == 0


def test_periods_of_other_year_ends(spark):
    days = spark.sql("select explode(array(date'2024-02-28', date'2024-02-29', date'2023-02-28', date'2024-12-31')) as d")
    from pyspark.sql import functions as F

    got = {r["d"]: (r["n"], r["l"]) for r in days.select("d", O.next_period(F.col("d"), 2).alias("n"), O.last_period(F.col("d"), 2).alias("l")).collect()}
    assert got == {
        D(2024, 2, 28): (D(2024, 2, 29), D(2023, 2, 28)), D(2024, 2, 29): (D(2025, 2, 28), D(2024, 2, 29)), D(2023, 2, 28): (D(2024, 2, 29), D(2023, 2, 28)), D(2024, 12, 31): (D(2025, 2, 28), D(2024, 2, 29)),
    }


def test_reasons_for_rolling(spark):
    got = {r["date"]: (r["business_day"], r["reason"]) for r in C.with_reasons(C.calendar(spark, "2026-12-01", "2027-12-31")).collect()}
    # a Sunday before Presidents' Day, a Saturday before it, the day itself, a plain Sunday, a plain weekday, Independence Day on a Sunday
    assert got[D(2027, 2, 14)] == (D(2027, 2, 16), "a Sunday, and Presidents' Day the next working day")
    assert got[D(2027, 2, 13)] == (D(2027, 2, 16), "a weekend, and Presidents' Day the next working day")
    assert got[D(2027, 2, 15)] == (D(2027, 2, 16), "Presidents' Day")
    assert got[D(2027, 3, 7)] == (D(2027, 3, 8), "a Sunday") and got[D(2027, 3, 9)] == (D(2027, 3, 9), None)
    assert got[D(2027, 7, 3)] == (D(2027, 7, 6), "a weekend, and Independence Day the next working day")
    assert got[D(2026, 12, 25)] == (D(2026, 12, 28), "a weekend, and Christmas Day the next working day")
