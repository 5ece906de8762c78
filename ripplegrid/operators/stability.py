"""How often and how strongly links act across windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import isclose
from .autoregression import by_sums, coefficients, fit
from .goodness import fit_ratio, fit_stats
from .panel import Panel, chunks, lagged


def off_diagonal(coefs: DataFrame) -> DataFrame:
    """Slopes, with those of an asset on itself as 0: they count in means."""
    return coefs.filter("NOT is_const").withColumn("coef", F.when(F.col("src") == F.col("tgt"), 0.0).otherwise(F.col("coef")))


def active_links(coefs: DataFrame, quantile: float = 0.8, eps: float = 1e-6) -> DataFrame:
    """(window_id, src, tgt, is_active): slopes off the diagonal whose size is at least the quantile of their window's sizes above eps; none in a window without any."""
    slopes = off_diagonal(coefs).withColumn("size", F.abs("coef"))
    cut = slopes.filter(F.col("size") > eps).groupBy("window_id").agg(F.percentile("size", F.lit(float(quantile))).alias("cut"))
    held = slopes.join(cut, "window_id", "left")
    return held.select("window_id", "src", "tgt", F.coalesce(F.col("size") >= F.col("cut"), F.lit(False)).alias("is_active"))


def activation_frequency(coefs: DataFrame, quantile: float = 0.8, eps: float = 1e-6) -> DataFrame:
    """(src, tgt, freq): share of the windows in which a link is active."""
    return active_links(coefs, quantile, eps).groupBy("src", "tgt").agg(F.avg(F.col("is_active").cast("int")).alias("freq"))


def mean_magnitude(coefs: DataFrame) -> DataFrame:
    """(src, tgt, magnitude): mean of the signed slopes over all windows, zeros included; the diagonal is 0."""
    return off_diagonal(coefs).groupBy("src", "tgt").agg(F.avg("coef").alias("magnitude"))


def magnitude_summary(magnitude: DataFrame, eps: float = 1e-6) -> DataFrame:
    return magnitude.agg(F.avg("magnitude").alias("mean"), F.min("magnitude").alias("min"), F.max("magnitude").alias("max"), F.sum((F.abs("magnitude") < eps).cast("long")).alias("n_small"))


def chunk_fits(panel: Panel, lag: int, q: float, n_chunks: int, way: str = "auto") -> DataFrame:
    """Fits of every chunk on the sources that its own lagged correlations single out; long chunks are reduced to moments."""
    n, total = len(panel.assets), panel.count()
    rows = chunks(panel.rows, n_chunks, total)
    return fit(lagged(rows, [lag], ["window_id"]), n, n, ["window_id"], qs=[q], by_sums=by_sums(total // n_chunks, n, n, way)).drop("q")


def chunk_stats(panel: Panel, lag: int, q: float, n_chunks: int) -> DataFrame:
    return fit_stats(chunk_fits(panel, lag, q, n_chunks), panel.assets, ["window_id"])


def chunk_coefficients(panel: Panel, lag: int, q: float, n_chunks: int) -> DataFrame:
    return coefficients(chunk_fits(panel, lag, q, n_chunks), panel.assets, [lag], ["window_id"])


def chunk_frequency(coefs: DataFrame) -> DataFrame:
    """(src, tgt, freq): share of the chunks in which a slope isn't 0; the diagonal stays."""
    return coefs.filter("NOT is_const").groupBy("src", "tgt").agg(F.avg((F.col("coef") != 0).cast("int")).alias("freq"))


def active_magnitude(coefs: DataFrame) -> DataFrame:
    """(src, tgt, weight): mean size of a slope over the chunks in which it isn't 0, else 0."""
    mean = F.avg(F.when(F.col("coef") != 0, F.abs("coef")))
    return coefs.filter("NOT is_const").groupBy("src", "tgt").agg(F.coalesce(mean, F.lit(0.0)).alias("weight"))


def sweep_fits(panel: Panel, lag: int, qs: Sequence[float], n_chunks: Sequence[int], way: str = "auto") -> DataFrame:
    """Fits of every combination of quantile and number of chunks: a row goes to one chunk of each number of chunks, where all quantiles are taken from it."""
    n, total, out = len(panel.assets), panel.count(), None
    for k in n_chunks:
        rows = chunks(panel.rows, k, total).withColumn("n_chunks", F.lit(int(k)))
        cell = fit(lagged(rows, [lag], ["n_chunks", "window_id"]), n, n, ["n_chunks", "window_id"], qs=qs, by_sums=by_sums(total // k, n, n, way))
        out = cell if out is None else out.unionByName(cell)
    return out


def sweep(panel: Panel, lag: int, qs: Sequence[float], n_chunks: Sequence[int]) -> DataFrame:
    """(n_chunks, q, r2, r2_null, ratio)"""
    keys = ["n_chunks", "q", "window_id"]
    return fit_ratio(fit_stats(sweep_fits(panel, lag, qs, n_chunks), panel.assets, keys), ["n_chunks", "q"])


def sweep_frequency(panel: Panel, lag: int, qs: Sequence[float], n_chunks: Sequence[int]) -> DataFrame:
    """(n_chunks, q, src, tgt, freq)"""
    coefs = coefficients(sweep_fits(panel, lag, qs, n_chunks), panel.assets, [lag], ["n_chunks", "q", "window_id"])
    return coefs.filter("NOT is_const").groupBy("n_chunks", "q", "src", "tgt").agg(F.avg((F.col("coef") != 0).cast("int")).alias("freq"))


def frequency_levels(freq: DataFrame, n_chunks: int) -> DataFrame:
    """(level, n_edges): links found in exactly `level` of the chunks, from 1 up."""
    levels = freq.sparkSession.range(1, n_chunks + 1).select(F.col("id").alias("level"))
    found = freq.filter("freq > 0").withColumn("level", F.round(F.col("freq") * n_chunks).cast("long"))
    found = found.filter(isclose(F.col("freq"), F.col("level") / n_chunks)).groupBy("level").agg(F.count(F.lit(1)).alias("n_edges"))
    return levels.join(found, "level", "left").select("level", F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"))
