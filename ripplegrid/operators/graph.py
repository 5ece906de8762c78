"""The directed graph of stable links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A link is in the graph if it is found in a larger share of the chunks.
LEAST = 0.35


def edges(freq: DataFrame, weight: DataFrame, least: float = LEAST) -> DataFrame:
    """(src, dst, weight): links between different assets of a frequency above `least`."""
    held = freq.filter((F.col("freq") > least) & (F.col("src") != F.col("tgt"))).select("src", "tgt")
    return held.join(weight, ["src", "tgt"]).select("src", F.col("tgt").alias("dst"), "weight")


def nodes(links: DataFrame, freq: DataFrame, sectors: DataFrame | None = None, default: str = "autre") -> DataFrame:
    """(asset, sector, freq, in_degree, out_degree) of every linked asset; freq: its row's and its column's sum, the diagonal in both."""
    ends = links.select(F.col("src").alias("asset"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(links.select(F.col("dst").alias("asset"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    degrees = ends.groupBy("asset").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    both = freq.select(F.col("src").alias("asset"), "freq").unionByName(freq.select(F.col("tgt").alias("asset"), "freq"))
    total = both.groupBy("asset").agg(F.sum("freq").alias("freq"))
    out = degrees.join(total, "asset")
    out = out.join(sectors.select("asset", "sector"), "asset", "left") if sectors is not None else out.withColumn("sector", F.lit(None).cast("string"))
    return out.select("asset", F.coalesce("sector", F.lit(default)).alias("sector"), "freq", "in_degree", "out_degree")


def density(links: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, density): links over the ordered pairs of linked assets."""
    ends = links.select(F.col("src").alias("a")).unionByName(links.select(F.col("dst").alias("a")))
    n = ends.agg(F.count_distinct("a").alias("n_nodes"))
    e = links.agg(F.count(F.lit(1)).alias("n_edges"))
    return n.crossJoin(e).withColumn("density", F.col("n_edges") / F.greatest(F.col("n_nodes") * (F.col("n_nodes") - 1), F.lit(1)))  # one row each


def visual_sizes(found: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with size 50 + 800 * freq over the largest, links with width 0.3 + 3.5 * weight over the largest."""
    top_f, top_w = found.agg(F.max("freq").alias("__m")), links.agg(F.max("weight").alias("__m"))  # one row each
    scaled = lambda df, top, c, a, b, out: df.crossJoin(F.broadcast(top)).withColumn(out, F.lit(a) + F.lit(b) * F.coalesce(F.try_divide(c, "__m"), F.lit(0.0))).drop("__m")
    return scaled(found, top_f, "freq", 50.0, 800.0, "size"), scaled(links, top_w, "weight", 0.3, 3.5, "width")
