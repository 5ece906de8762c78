"""Goodness of fit: R2 in its three forms, the white-noise baseline, information criteria."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import guarded
from .autoregression import FIT, _solve_moments, predicted
from .correlation import MOMENTS, Moments, merged_moments, moment_rows
from .panel import Panel, name, with_lags


def r2_per_asset(panel: Panel, coefs: DataFrame, lag: int = 1) -> DataFrame:
    """(asset, r2): 1 - residual over total sum of squares; 0 for a constant asset."""
    fitted = predicted(panel, coefs, lag)
    mean = fitted.groupBy("tgt").agg(F.avg("y").alias("m"))
    sums = fitted.join(mean, "tgt").groupBy("tgt").agg(F.sum(F.pow(F.col("y") - F.col("yhat"), 2)).alias("rss"), F.sum(F.pow(F.col("y") - F.col("m"), 2)).alias("tss"))
    return sums.select(F.col("tgt").alias("asset"), F.when(F.col("tss") > 0, 1 - F.try_divide("rss", "tss")).otherwise(0.0).alias("r2"))


def r2_total(r2: DataFrame) -> DataFrame:
    return r2.agg(F.avg("r2").alias("r2"))


def r2_per_category(r2: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, r2): mean over the assets of a category; an asset without one is left out."""
    return r2.join(categories.select("asset", "category"), "asset").filter(F.col("category").isNotNull()).groupBy("category").agg(F.avg("r2").alias("r2"))


def pooled_r2(fitted: DataFrame) -> DataFrame:
    """(asset, r2): 1 - variance of the residual over that of the value, over all windows together; null for a constant asset."""
    ratio = F.try_divide(F.var_pop(F.col("y") - F.col("yhat")), F.var_pop("y"))
    return fitted.groupBy(F.col("tgt").alias("asset")).agg((1 - ratio).alias("r2"))


def fit_stats(fits: DataFrame, assets: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, tgt, n, n_active, rss, tss, r2, r2_null): r2 takes a total of 0 as 1; r2_null is what white noise reaches, sources over rows less one."""
    r2 = 1 - F.col("rss") / guarded(F.col("tss"))
    null = F.try_divide(F.col("k").cast("double"), F.col("n") - 1)
    return fits.select(*keys, name(assets, F.col("tgt")).alias("tgt"), "n", F.col("k").alias("n_active"), "rss", "tss", r2.alias("r2"), null.alias("r2_null"))


def fit_ratio(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, r2, r2_null, ratio): means over windows and targets, and how often the baseline is reached."""
    means = stats.groupBy(*keys).agg(F.avg("r2").alias("r2"), F.avg("r2_null").alias("r2_null"))
    return means.withColumn("ratio", F.col("r2") / F.greatest("r2_null", F.lit(1e-12)))


def spec_fits(panel: Panel, specs: Sequence[Sequence[int]]) -> DataFrame:
    """(spec, and the columns of a fit) of the regression on each set of lags, from one pass: every task sums the moments of each set over the rows that have all its lags."""
    n, specs = len(panel.assets), [list(s) for s in specs]
    lags = sorted({k for s in specs for k in s})
    rows = with_lags(panel.rows, lags).select("x", *[f"__x{k}" for k in lags])

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, Moments] = {}
        for batch in batches:
            held = {k: batch[f"__x{k}"].notna().to_numpy() for k in lags}
            y = np.stack(batch["x"].to_numpy())
            x = {k: np.stack(batch[f"__x{k}"].map(lambda v: np.zeros(n) if v is None else v).to_numpy()) for k in lags}
            for i, spec in enumerate(specs):
                use = np.logical_and.reduce([held[k] for k in spec])
                if use.any():
                    own = Moments.of(np.concatenate([x[k][use] for k in spec] + [y[use]], 1))
                    found[(i,)] = found[(i,)].joined(own) if (i,) in found else own
        if found:
            yield moment_rows(found, ["i"])

    def solve(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                n_x = n * len(specs[row["i"]])
                m = Moments.read(row, n_x + n)
                out = pd.DataFrame(_solve_moments(m, n_x, np.ones((n_x, n), bool)), columns=["tgt", "n", "k", "const", "active", "coef", "rss", "tss"])
                yield out.assign(spec=str(specs[row["i"]]))[["spec", *out.columns]]

    sums = merged_moments(rows.mapInPandas(work, f"i int, {MOMENTS}"), ["i"])
    return sums.mapInPandas(solve, f"spec string, {FIT}")


def lag_scores(panel: Panel, specs: Sequence[Sequence[int]]) -> DataFrame:
    """(spec, bic, aic, r2_mean, r2_median) of the regression on each set of lags: criteria per equation, averaged. spec is the set in brackets."""
    fits = spec_fits(panel, specs)
    n, k, r2 = F.col("n"), F.col("k") + 1, 1 - F.col("rss") / guarded(F.col("tss"))
    base = n * F.ln(F.col("rss") / n)
    return fits.groupBy("spec").agg(F.avg(base + k * F.ln(n)).alias("bic"), F.avg(base + 2 * k).alias("aic"), F.avg(r2).alias("r2_mean"), F.median(r2).alias("r2_median"))


def one_lag(scores: DataFrame) -> DataFrame:
    return scores.filter(F.col("spec").startswith("[") & ~F.col("spec").contains(","))


def several_lags(scores: DataFrame) -> DataFrame:
    return scores.filter(F.col("spec").contains(","))


def best(scores: DataFrame, score: str = "bic", largest: bool = False) -> DataFrame:
    """The row of the least (or largest) score; of equals, the first by spec."""
    order = F.desc(score) if largest else F.asc(score)
    return scores.orderBy(order, "spec").limit(1)
