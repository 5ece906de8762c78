"""Sources: price files and tables, in the long form prices(ts, asset, price)."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_wide_csv(spark: SparkSession, path: str, date_col: str = "date", schema: T.StructType | None = None) -> DataFrame:
    """A price file with a date column and one numeric column per asset, as long prices. Columns that aren't numeric are left out.

    Without a schema a column is numeric if it has a value and every value that isn't empty is a number.
    """
    if schema is None:
        names = spark.read.option("header", True).csv(path).columns
        raw = spark.read.option("header", True).schema(T.StructType([T.StructField(c, T.StringType()) for c in names])).csv(path)
        numbers = [c for c in names if c != date_col]
        number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
        filled = lambda c: F.trim(F.col(f"`{c}`")) != ""
        seen = raw.agg(*[F.struct(F.count_if(filled(c)).alias("all"), F.count(number(c)).alias("n")).alias(c) for c in numbers]).first()
        typed = raw.select(F.to_timestamp(date_col).cast("timestamp_ntz").alias("ts"), *[number(c).alias(c) for c in numbers])
        return unpivoted(typed, [c for c in numbers if 0 < seen[c]["all"] == seen[c]["n"]])
    wide = spark.read.option("header", True).schema(schema).csv(path)
    numbers = [f.name for f in schema if isinstance(f.dataType, T.NumericType) and f.name != date_col]
    return unpivoted(wide.select(F.col(date_col).cast("timestamp_ntz").alias("ts"), *[F.col(f"`{c}`").cast("double").alias(c) for c in numbers]), numbers)


def unpivoted(wide: DataFrame, assets: Sequence[str]) -> DataFrame:
    """ts and a column per asset, as (ts, asset, price)."""
    return wide.unpivot("ts", [F.col(f"`{a}`") for a in assets], "asset", "price")


def joined(prices: Sequence[DataFrame]) -> DataFrame:
    """Files joined on their timestamps: the union of their rows at the timestamps that every file has. An asset of several files is kept once for each, told apart by its file's number."""
    if len(prices) == 1:
        return prices[0]
    tagged = [p.withColumn("__file", F.lit(i)) for i, p in enumerate(prices)]
    every = tagged[0]
    for p in tagged[1:]:
        every = every.unionByName(p)
    again = every.select("asset", "__file").distinct().groupBy("asset").agg(F.count(F.lit(1)).alias("__files"))
    common = every.groupBy("ts").agg(F.count_distinct("__file").alias("__n")).filter(F.col("__n") == len(prices)).select("ts")
    named = every.join(common, "ts", "left_semi").join(F.broadcast(again), "asset")
    return named.select("ts", F.when(F.col("__files") > 1, F.concat_ws("_", "asset", "__file")).otherwise(F.col("asset")).alias("asset"), "price")


def categories(assets: DataFrame) -> DataFrame:
    """(asset, sector, category): the category follows from the sector; a missing sector is a stock's."""
    sector = F.col("sector")
    return assets.select("asset", "sector", F.when(sector == "Crypto", "crypto").when(sector == "US ETF", "etf").otherwise("stock").alias("category"))


def sector_order(assets: DataFrame) -> DataFrame:
    """assets with ord, their place by sector (missing ones first) and name."""
    return assets.withColumn("ord", F.row_number().over(Window.orderBy(F.coalesce("sector", F.lit("")), "asset")) - 1)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of an Excel workbook (xlsx) as strings, its first row as names: for dimension tables, which the driver holds. Formulas give their stored values."""
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    spare = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as book:
        parts = set(book.namelist())
        words = lambda node: "".join(t.text or "" for t in node.iter(f"{spare}t"))
        shared = [words(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in parts else []
        sheet = ElementTree.fromstring(book.read(min((p for p in parts if p.startswith("xl/worksheets/sheet")), key=lambda p: (len(p), p))))
    table = []
    for row in sheet.iter(f"{spare}row"):
        cells: dict[int, str | None] = {}
        for cell in row.iter(f"{spare}c"):
            letters = "".join(c for c in cell.get("r", "") if c.isalpha())
            at = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters))) - 1 if letters else len(cells)
            value = cell.find(f"{spare}v")
            text = words(cell) if cell.get("t") == "inlineStr" else value.text if value is not None else None
            cells[at] = shared[int(text)] if cell.get("t") == "s" and text is not None else text
        table.append(cells)
    names = table[0] if table else {}
    order = sorted(names)
    return spark.createDataFrame([tuple(r.get(i) for i in order) for r in table[1:]], ", ".join(f"`{names[i]}` string" for i in order))


def read_categories(spark: SparkSession, path: str, asset: str = "Stocks", sector: str = "Sectors") -> DataFrame:
    """(asset, sector, category) of an Excel sheet, or of a CSV or Parquet table, with a row an asset."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    rows = read_sheet(spark, path) if kind == "xlsx" else spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.parquet(path)
    return categories(rows.select(F.col(asset).alias("asset"), F.col(sector).alias("sector")))


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir); a temporary one, if there is none, on a local master alone."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ripplegrid-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
