"""Price panels over the driver's tables: the average of a measure by asset and period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _averaged(rows: DataFrame, ts: str, grain: str, asset: str, value: str) -> DataFrame:
    period = F.date_trunc(grain, F.col(ts)).cast("timestamp_ntz")
    return rows.filter(F.col(value) > 0).groupBy(period.alias("ts"), F.col(asset).alias("asset")).agg(F.avg(value).alias("price"))


def event_prices(spark: SparkSession, sf_dir: str, grain: str = "hour") -> DataFrame:
    return _averaged(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", grain, "event_type", "value")


def region_prices(spark: SparkSession, sf_dir: str, grain: str = "day") -> DataFrame:
    """Average line price by the supplier's region; the dimensions have at most 25 nations and a supplier row each."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    regions = read("nation").join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = read("supplier").join(F.broadcast(regions), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")
    lines = read("lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return _averaged(lines, "l_shipdate", grain, "r_name", "l_extendedprice")


def brand_prices(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").join(read("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return _averaged(lines, "l_shipdate", grain, "p_brand", "l_extendedprice")


def order_prices(spark: SparkSession, sf_dir: str, grain: str = "day") -> DataFrame:
    return _averaged(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate", grain, "o_orderpriority", "o_totalprice")
