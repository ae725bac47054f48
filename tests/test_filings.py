"""Text tables, identifiers and venues in the forms that filings have."""

from pyspark.sql import functions as F

from moodtide.functions import texts
from moodtide.sources import filings, tables


def test_both_layouts_of_text_tables(spark):
    text = "\r\n".join([
        "NAME OF ISSUER            TITLE OF CLASS     CUSIP      VALUE   SHARES",
        "BERKSHIRE HATHAWAY        CL B               084670702      1,234    5,000 SH       SOLE",
        "FIAT CHRYSLER AUTO  N V   SHS                n31738102  98.50  1,200  SH  CALL",
        "GOOGLE INC                CL A               38259p508   2,000 SH",
        "                          SHS NEW                        1,500.25",
        "POSCO                     SPONSORED ADR      693483109   700 PRN PUT",
        "                                             84.00",
        "NO VALUE CO               COM                123456789   700 SH",
        "TOO SHORT                 COM                12345678    10   700 SH",
        "",
    ])
    docs = spark.createDataFrame([("f", text), ("g", ""), ("h", None)], "file string, text string")
    got = filings.fixed_width_13f(filings.text_lines(docs, ["file"]), ["file"]).orderBy("n").collect()
    assert [(r.issuer, r.title, r.cusip, r.value, r.shares, r.share_type, r.put_call, r.problem) for r in got] == [
        ("BERKSHIRE HATHAWAY", "CL B", "084670702", 1234.0, 5000.0, "SH", None, None),
        ("FIAT CHRYSLER AUTO  N V", "SHS", "N31738102", 98.5, 1200.0, "SH", "CALL", None),
        ("GOOGLE INC", "CL A SHS NEW", "38259P508", 1500.25, 2000.0, "SH", None, None),
        ("POSCO", "SPONSORED ADR", "693483109", 84.0, 700.0, "PRN", "PUT", None),
        ("NO VALUE CO", "COM", "123456789", None, 700.0, "SH", None, "no value"),
    ]


def test_padded_identifiers(spark):
    cases = {"84670702": "084670702", " 8467 07 02 ": "084670702", "abc123": "000ABC123", "12345": None, "1234567890": None, "": None, "0000": None, "12-45678": None, None: None}
    got = spark.createDataFrame([(k,) for k in cases], "x string").select("x", texts.padded_cusip(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == cases


def test_files_by_their_headers(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).write_bytes(text.encode())
        return str(tmp_path / name)

    good = write("good.csv", '﻿Name,"Value, net",Date\r\n"a ""b""\nc","1,234.50",01/31/2020\r\nshort,1\r\nlong,1,2,3\r\n"",(2),02/01/2020\r\n')
    rows, problems = tables.quoted_csv(spark, good, {"date": "Date", "name": "Name", "value": "Value, net"})
    assert [tuple(r) for r in rows.collect()] == [("01/31/2020", 'a "b"\nc', "1,234.50"), ("02/01/2020", None, "(2)")]
    assert [r.problem for r in problems.collect()] == ["ragged row", "ragged row"]
    bad = write("bad.csv", "A,,A,B\n1,2,3,4\n")
    rows, problems = tables.quoted_csv(spark, bad, {"a": "A", "c": "C"})
    assert rows.collect() == [] and {r.problem for r in problems.collect()} == {"repeated header A", "empty header", "no column C"}
    empty = write("empty.csv", "")
    rows, problems = tables.quoted_csv(spark, empty, {"a": "A"})
    assert rows.collect() == [] and [r.problem for r in problems.collect()] == ["no column A"]
    rates = write("rates.csv", "DATE,DTB3\n2020-01-02,1.52\n2020-01-03,.\n2020-01-06,-0.05\nnone,1\n2021-01-01,9\n")
    read, _ = tables.dated(spark, rates, {"date": "DATE", "percent": "DTB3"}, as_of="2020-12-31")
    assert [(str(r.date), r.percent) for r in read.orderBy("date").collect()] == [("2020-01-02", 1.52), ("2020-01-06", -0.05)]


def test_snapshots_tell_what_is_wrong(spark, tmp_path):
    head = "Date,Account,StockTicker,CUSIP,SecurityName,Shares,Price,MarketValue,Weightings,NetAssets,SharesOutstanding\n"
    row = lambda day, ticker, value, weight, account="A", net="100", shares="1": f'{day},{account},{ticker},123456789,"N, x",{shares},$1.00,{value},{weight}%,{net},10\n'
    text = head + row("01/01/2020", "a", 60, 60) + row("01/01/2020", "b", 40, 40)
    text += row("01/02/2020", "a", 60, 60) + row("01/02/2020", "a", 40, 40, account="B", net="101", shares="none")
    text += row("01/03/2020", "a", 50, 50) + row("01/03/2020", "b", 40, 40)
    (tmp_path / "h.csv").write_text(text)
    rows, problems = tables.holdings(spark, str(tmp_path / "h.csv"))
    found = {(str(r.date), r.problem) for r in tables.snapshot_problems(rows).collect()}
    assert problems.collect() == [] and found == {*(("2020-01-02", p) for p in ("repeated ticker", "several accounts", "several totals", "no number")), ("2020-01-03", "weights"), ("2020-01-03", "values")}


def test_items_with_their_dates():
    from moodtide.operators.policies import item_of

    far = '{"a":1,"itemKey":"h","value":[{"x":"]}"}],' + '"pad":"' + "y" * 5000 + '","creationDate":"01/02/2026"},{"itemKey":"z","value":1,"creationDate":"09/09/2026"}'
    assert item_of(far, "h") == ('[{"x": "]}"}]', "01/02/2026")
    assert item_of('x {"itemKey":"h","value":[1],"creationDate":"01/02/2026"', "h") == ("[1]", "01/02/2026")
    assert item_of('{"itemKey":"h","value":[1],{"itemKey":"z","value":2,"creationDate":"09/09/2026"}', "h") == ("[1]", None)
    assert item_of('"itemKey":"h","value":[1', "h") == item_of("", "h") == (None, None)


def test_fund_reports_travel_as_numbers(spark):
    """What is brought together by order is no XML yet."""
    from moodtide.plans import readers

    plan = readers.fund_holdings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    partial = [x for x in plan.splitlines() if "partial_collect_list" in x]
    assert partial and not any("invstOrSec" in x for x in plan[plan.index(partial[0]) :].splitlines())
