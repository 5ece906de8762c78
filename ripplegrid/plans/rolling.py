"""The main plan: a mask of all data, masked fits in consecutive windows, pooled goodness of fit, and its cache."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.autoregression import coefficients, fit, mask_matrix, predicted
from ..operators.correlation import correlation, mask_sources, quantile_mask, rmt_clip
from ..operators.goodness import pooled_r2, r2_per_category, r2_total
from ..operators.panel import Panel, lagged, window_bounds, windows
from .cache import read_through


@dataclass
class Rolling:
    """What rolling_fit returns: window bounds, coefficients by window, R2 by asset, the mask, the correlations, and the rows of a window."""

    bounds: DataFrame
    coefs: DataFrame
    r2: DataFrame
    mask: DataFrame
    corr: DataFrame
    interval: int

    def total(self) -> DataFrame:
        return r2_total(self.r2)

    def per_category(self, categories: DataFrame) -> DataFrame:
        return r2_per_category(self.r2, categories)


def rolling_fit(panel: Panel, q: float, *, lag: int = 1, interval: int | None = None, clip: bool = True, per_source: int = 2, cache: str | None = None) -> Rolling:
    """Masked regressions in windows of interval + lag rows.

    The mask is made once, of all data. Without an interval it is per_source times the most sources of a target,
    1 at least. Each window loses its first `lag` targets and a shorter tail is dropped; with fewer rows than a
    window there are none, and R2 is null. cache: a folder; equal data and parameters are read back from it.
    """
    if lag < 1:
        raise ValueError("lags must be 1 or more")
    n, total = len(panel.assets), panel.count()
    corr = correlation(panel)
    mask = quantile_mask(rmt_clip(corr, panel.assets, total) if clip else corr, q)
    allowed = mask_matrix(mask, panel.assets)
    if interval is None:
        interval = max(per_source * int(allowed.sum(0).max(initial=0)), 1)
    rows = windows(panel.rows, interval + lag, total)
    bounds = window_bounds(rows)

    def coefs() -> DataFrame:
        return coefficients(fit(lagged(rows, [lag], ["window_id"]), n, n, ["window_id"], mask=allowed), panel.assets, [lag], ["window_id"])

    found = read_through(panel.rows.sparkSession, cache, f"{fingerprint(panel)}_q{q}_lag{lag}_n{interval}_clip{clip}", coefs) if cache else coefs()
    r2 = pooled_r2(predicted(panel, found, lag, rows, ["window_id"]))
    return Rolling(bounds, found, r2, mask, corr, interval)


def fingerprint(panel: Panel) -> str:
    """A digest of assets and rows, whatever their order."""
    row = F.xxhash64("rn", "ts", F.transform("x", lambda v: F.round(v, 12)))
    s = panel.rows.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{panel.assets} {s['n']} {s['s']}".encode()).hexdigest()[:24]


def auto_interval(mask: DataFrame, per_source: int = 2) -> DataFrame:
    """(interval): the automatic number of rows, as a row."""
    return mask_sources(mask).agg(F.greatest(F.coalesce(F.max("n"), F.lit(0)) * per_source, F.lit(1)).alias("interval"))
