"""Connectors: chart JSON documents, corporate actions, bar CSV round trip."""

import datetime as dt
import json

import pytest

from bars_cases import SF001
from velas.session import scratch_path
from velas.sources import files
from velas.sources.bars import bars_from_orders

# A hand-made chart document (three bars, one dividend, one split).
DOC = {"chart": {"result": [{
    "meta": {"currency": "USD", "symbol": "ABC", "exchangeName": "X", "instrumentType": "EQUITY",
             "firstTradeDate": 0, "regularMarketTime": 1700000000, "gmtoffset": -18000,
             "timezone": "EST", "exchangeTimezoneName": "America/New_York",
             "regularMarketPrice": 12.5, "dataGranularity": "1d", "range": "5d",
             "currentTradingPeriod": {"pre": {"timezone": "EST", "start": 1, "end": 2, "gmtoffset": -18000},
                                      "regular": {"timezone": "EST", "start": 2, "end": 3, "gmtoffset": -18000},
                                      "post": {"timezone": "EST", "start": 3, "end": 4, "gmtoffset": -18000}}},
    "timestamp": [1704205800, 1704292200, 1704378600],
    "events": {"dividends": {"1704292200": {"amount": 0.25, "date": 1704292200}},
               "splits": {"1704378600": {"date": 1704378600, "numerator": 2.0, "denominator": 1.0,
                                         "splitRatio": "2:1"}}},
    "indicators": {"quote": [{"open": [10.0, 11.0, 12.0], "high": [10.5, 11.5, 12.5],
                              "low": [9.5, 10.5, 11.5], "close": [10.2, 11.2, 12.2],
                              "volume": [100, 200, 300]}],
                   "adjclose": [{"adjclose": [10.1, 11.1, 12.1]}]}}], "error": None}}


@pytest.fixture()
def doc_path(spark, tmp_path):
    p = tmp_path / "abc.json"
    p.write_text(json.dumps(DOC) + "\n")
    return str(p)


def test_explode_chart(spark, doc_path):
    rows = files.explode_chart(files.read_chart_json(spark, doc_path)).orderBy("date").collect()
    assert [r.date for r in rows] == [dt.date(2024, 1, 2), dt.date(2024, 1, 3), dt.date(2024, 1, 4)]
    assert rows[1].close == 11.2 and rows[2].volume == 300.0 and rows[0].adj_close == 10.1
    assert all(r.symbol == "ABC" for r in rows)


def test_corporate_actions(spark, doc_path):
    acts = {r.kind: r for r in files.corporate_actions(files.read_chart_json(spark, doc_path)).collect()}
    assert acts["dividend"].amount == 0.25 and acts["split"].amount == 2.0 and acts["split"].ratio == "2:1"
    assert acts["dividend"].date == dt.date(2024, 1, 3)


def test_bar_csv_round_trip_with_bad_values(spark):
    bars = bars_from_orders(spark, SF001)
    path = scratch_path(spark, "test-bars-csv")
    files.write_bars_csv(bars, path)
    back = files.scan_bars(spark, path, symbols=["1-URGENT"])
    want = bars.where("symbol = '1-URGENT'")
    assert back.count() == want.count()
    assert back.exceptAll(want.select(*back.columns)).count() == 0
    # unparsable numbers become NULL rather than failing
    df = spark.createDataFrame([("2024-01-02", "n/a", "1", "1", "1", "5", None, "Z")],
                               "Date string, Open string, High string, Low string, Close string, "
                               "Volume string, `Adj Close` string, symbol string")
    bad = scratch_path(spark, "test-bars-bad")
    df.write.mode("overwrite").partitionBy("symbol").option("header", True).csv(bad)
    row = files.scan_bars(spark, bad).collect()[0]
    assert row.open is None and row.close == 1.0
