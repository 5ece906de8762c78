"""Price bars from a stream of events: the long price table of a batch panel, as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def price_bars(events: DataFrame, *, ts: str = "ts", asset: str = "event_type", value: str = "value", period: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(ts, asset, price): average positive value by asset and period. On a stream a bar is final, and in append mode comes out, once the watermark has passed its end."""
    rows = events.withColumn("__t", F.col(ts).cast("timestamp")).filter(F.col(value) > 0)
    if events.isStreaming:
        rows = rows.withWatermark("__t", late)
    bars = rows.groupBy(F.window("__t", period).alias("w"), F.col(asset).alias("asset")).agg(F.avg(value).alias("price"))
    return bars.select(F.col("w.start").cast("timestamp_ntz").alias("ts"), "asset", "price")
