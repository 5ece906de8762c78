import datetime as dt
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplegrid.operators import panel as pa
from ripplegrid.sources import prices as src


def days(first, n):
    return [dt.datetime(2023, 1, first) + dt.timedelta(days=i) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp_ntz, asset string, price double")


def test_doubling_prices_return_ln_2(spark):
    p = pa.load_panel(table(spark, [(t, "price", 2.0**i) for i, t in enumerate(days(1, 5))]))
    rows = p.long().orderBy("rn").collect()
    assert p.assets == ["price"] and [r["rn"] for r in rows] == [0, 1, 2, 3] and all(math.isclose(r["r"], math.log(2)) for r in rows)


def test_files_are_joined_on_common_dates(spark, tmp_path):
    for name, first in (("a", 1), ("b", 3)):
        (tmp_path / f"{name}.csv").write_text(f"date,p{name}\n" + "".join(f"{t:%Y-%m-%d},1.0\n" for t in days(first, 5)))
    files = [src.read_wide_csv(spark, str(tmp_path / f"{n}.csv")) for n in "ab"]
    p = pa.load_panel(src.joined(files), log_returns=False)
    assert p.count() == 3 and p.assets == ["pa", "pb"]
    assert [(r["ts"].day, r["x"]) for r in p.rows.orderBy("rn").collect()] == [(3, [1.0, 1.0]), (4, [1.0, 1.0]), (5, [1.0, 1.0])]


def test_text_columns_are_no_assets(spark, tmp_path):
    """A column is numeric only if all that it holds is: one number among words doesn't make it one."""
    rows = ["2023-01-01,1,x,,", "2023-01-02,2,7,,", "2023-01-03,4,y,5,"]
    (tmp_path / "a.csv").write_text("\n".join(["date,p,note,late,none", *rows]))
    found = src.read_wide_csv(spark, str(tmp_path / "a.csv"))
    assert {r["asset"] for r in found.collect()} == {"p", "late"}
    assert pa.load_panel(found, log_returns=False, assets=["p"]).count() == 3


def test_an_assets_prices_at_one_time_are_averaged(spark):
    rows = [(t, "p", float(i + 1)) for i, t in enumerate(days(1, 3))]
    p = pa.load_panel(table(spark, [*rows, (rows[1][0], "p", 4.0)]), log_returns=False)
    assert [r["x"] for r in p.rows.orderBy("rn").collect()] == [[1.0], [3.0], [3.0]]


@pytest.mark.parametrize("block", [4, 7, 1000])
def test_volatility_and_lags_reach_over_many_blocks(spark, block):
    rows = counted(spark, 60)
    x = np.array([r["x"] for r in rows.orderBy("rn").collect()])
    p = pa.Panel(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "rn long, x array<double>").withColumn("ts", F.timestamp_seconds("rn")), ["a", "b"])
    got = [r["vol"] for r in pa.rolling_volatility(p, 20, block).orderBy("rn").collect()]
    assert got[:19] == [None] * 19 and np.allclose(got[19:], [x[i - 19 : i + 1].std(0, ddof=1).mean() for i in range(19, 60)])
    pairs = pa.lagged(p.rows, [1, 30], block=block).orderBy("rn").collect()
    assert [r["rn"] for r in pairs] == list(range(30, 60))
    assert all(np.array_equal(r["x"], np.r_[x[r["rn"] - 1], x[r["rn"] - 30]]) and np.array_equal(r["y"], x[r["rn"]]) for r in pairs)


def test_a_sheet_is_read(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Stocks</t></si><si><t>Sectors</t></si><si><t>x</t></si><si><t>Crypto</t></si></sst>")
        cell = lambda at, v: f'<c r="{at}" t="s"><v>{v}</v></c>'
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData><row>{cell('A1', 0)}{cell('C1', 1)}</row><row>{cell('A2', 2)}{cell('C2', 3)}</row><row><c r='A3' t='inlineStr'><is><t>y</t></is></c></row></sheetData></worksheet>")
    assert [tuple(r) for r in src.read_categories(spark, str(tmp_path / "c.xlsx")).orderBy("asset").collect()] == [("x", "Crypto", "crypto"), ("y", None, "stock")]


def test_prices_that_are_not_positive_leave_their_timestamp(spark):
    rows = [(t, a, float(i + 1 + (a == "q") * (i % 3))) for i, t in enumerate(days(1, 6)) for a in "pq"]
    rows[4] = (rows[4][0], "p", 0.0)
    assert pa.load_panel(table(spark, rows)).count() == 4


def test_categories_and_order(spark):
    a = spark.createDataFrame([("x", "Crypto"), ("y", "US ETF"), ("z", "Tech"), ("w", None)], "asset string, sector string")
    assert {r["asset"]: r["category"] for r in src.categories(a).collect()} == {"x": "crypto", "y": "etf", "z": "stock", "w": "stock"}
    assert [r["asset"] for r in src.sector_order(a).orderBy("ord").collect()] == ["w", "x", "z", "y"]


def counted(spark, n):
    return spark.range(n).select(F.col("id").alias("rn"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.array(F.rand(1), F.rand(2)).alias("x"))


@pytest.mark.parametrize(("total", "n"), [(10, 3), (7, 7), (3, 5), (100, 10)])
def test_chunks_are_those_of_array_split(spark, total, n):
    found = {r["window_id"]: r["count"] for r in pa.chunks(counted(spark, total), n, total).groupBy("window_id").count().collect()}
    assert found == {i: len(x) for i, x in enumerate(np.array_split(np.arange(total), n)) if len(x)}


def test_windows_drop_the_tail(spark):
    rows = pa.windows(counted(spark, 200), 51, 200)
    assert {(r["window_id"], r["n_rows"]) for r in pa.window_bounds(rows).collect()} == {(0, 51), (1, 51), (2, 51)}
    assert pa.windows(counted(spark, 5), 51, 5).count() == 0


def test_lags_stay_within_windows_and_are_positive(spark):
    rows = pa.windows(counted(spark, 30), 10, 30)
    pairs = pa.lagged(rows, [2], ["window_id"])
    assert pairs.groupBy("window_id").count().filter("count <> 8").count() == 0
    with pytest.raises(ValueError, match="1 or more"):
        pa.lagged(rows, [0])


def test_numbers_have_no_gaps(spark):
    stamps = spark.range(50).select(F.timestamp_seconds(F.col("id") * 17_000).cast("timestamp_ntz").alias("ts")).repartition(4)
    assert [r["rn"] for r in pa.numbered(stamps).orderBy("ts").collect()] == list(range(50))


def test_stream_bars_have_the_batch_rows(spark, tmp_path):
    from ripplegrid.streaming.prices import price_bars

    events = spark.createDataFrame([(dt.datetime(2023, 1, 1, h, m), a, float(h + m + 1)) for h in range(4) for m in (0, 30) for a in "xy"], "ts timestamp_ntz, event_type string, value double")
    events.write.parquet(str(tmp_path / "in"))
    q = price_bars(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("bars").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table("bars").collect())) == sorted(map(tuple, price_bars(events).collect()))
    finally:
        q.stop()
