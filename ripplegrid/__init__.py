"""Lagged-dependence analytics on Spark: panels, correlation masks, sparse autoregressions, link stability."""
