"""The library's own queries, by name. Numbers are rounded to 9 decimals, as sums differ in their last bits with the order of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracles
from .functions.scalar import pearson
from .operators import autoregression as ar
from .operators import correlation as co
from .operators import dynamics, goodness, graph, stability, surrogates
from .operators import panel as pa
from .plans.rolling import auto_interval, rolling_fit
from .plans.study import link_graph
from .sources import prices, tables

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, Query] = {}


def query(f: Query) -> Query:
    _FOUND[f.__name__] = f
    return f


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 9 decimals (and no negative zero), whole numbers as bigint."""
    kinds = dict(df.dtypes)
    whole = ("int", "smallint", "tinyint")
    return df.select(*[(F.round(F.col(f"`{c}`"), 9) + F.lit(0.0)).alias(c) if k == "double" else F.col(f"`{c}`").cast("bigint").alias(c) if k in whole else F.col(f"`{c}`") for c, k in kinds.items()])


def e_hour(spark, sf_dir) -> pa.Panel:
    return pa.load_panel(tables.event_prices(spark, sf_dir))


def l_day(spark, sf_dir) -> pa.Panel:
    return pa.load_panel(tables.region_prices(spark, sf_dir))


def b_week(spark, sf_dir) -> pa.Panel:
    return pa.load_panel(tables.brand_prices(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pa.load_panel(tables.event_prices(spark, sf_dir, "day"))
    return rounded(co.quantile_mask(co.correlation(p), 0.6))


@query
def log_returns(spark, sf_dir):
    return rounded(e_hour(spark, sf_dir).long())


@query
def panel_join_multi(spark, sf_dir):
    both = prices.joined([tables.region_prices(spark, sf_dir), tables.order_prices(spark, sf_dir)])
    return rounded(pa.load_panel(both).long())


@query
def asset_sectors(spark, sf_dir):
    """Brands with their group as sector, its category, and their place by sector and name."""
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("asset")).distinct()
    group = F.substring("asset", 7, 1)
    sectors = brands.withColumn("sector", F.when(group == "1", "Crypto").when(group == "2", "US ETF").when(group != "5", F.concat(F.lit("group "), group)))
    return rounded(prices.sector_order(prices.categories(sectors)))


@query
def corr_lag0(spark, sf_dir):
    return rounded(co.correlation(e_hour(spark, sf_dir)))


@query
def corr_lagk(spark, sf_dir):
    p = l_day(spark, sf_dir)
    return rounded(co.correlation(p, 1).select(F.lit(1).alias("lag"), "*").unionByName(co.correlation(p, 13).select(F.lit(13).alias("lag"), "*")))


@query
def corr_pairwise(spark, sf_dir):
    """The same correlations by a join of the long returns, for few assets."""
    r = e_hour(spark, sf_dir).long()
    a, b = r.select("rn", F.col("asset").alias("src"), F.col("r").alias("x")), r.select("rn", F.col("asset").alias("tgt"), F.col("r").alias("y"))
    return rounded(a.join(b, "rn").groupBy("src", "tgt").agg(pearson("x", "y").alias("rho")))


@query
def autocorr1(spark, sf_dir):
    return rounded(co.autocorrelation(l_day(spark, sf_dir)))


@query
def corr_summary(spark, sf_dir):
    p = b_week(spark, sf_dir)
    return rounded(co.summary(co.correlation(p), p.assets))


@query
def corr_mask(spark, sf_dir):
    return rounded(co.quantile_mask(co.correlation(e_hour(spark, sf_dir)), 0.6))


@query
def mask_source_counts(spark, sf_dir):
    return rounded(co.mask_sources(co.quantile_mask(co.correlation(e_hour(spark, sf_dir)), 0.6)))


@query
def corr_mask_chunk(spark, sf_dir):
    p = l_day(spark, sf_dir)
    rows = pa.chunks(p.rows, 5, p.count())
    return rounded(co.quantile_mask(co.correlation(p, 1, ["window_id"], rows), 0.6, ["window_id"]))


@query
def var_diag(spark, sf_dir):
    return rounded(ar.var_diagonal(l_day(spark, sf_dir)))


@query
def var_masked(spark, sf_dir):
    return rounded(ar.var_masked(e_hour(spark, sf_dir), q=0.6, clip=False).select("src", "tgt", "is_const", "coef"))


@query
def var_masked_by_sums(spark, sf_dir):
    """The same from the sums of products, the way for long samples."""
    return rounded(ar.var_masked(e_hour(spark, sf_dir), q=0.6, clip=False, way="sums").select("src", "tgt", "is_const", "coef"))


@query
def var_no_source(spark, sf_dir):
    """With q = 1 every pair is masked, and every target is its mean."""
    return rounded(ar.var_masked(e_hour(spark, sf_dir), q=1.0, clip=False).select("src", "tgt", "is_const", "coef"))


@query
def var_full_p2(spark, sf_dir):
    return rounded(ar.var_full(l_day(spark, sf_dir), 2))


@query
def var_subset(spark, sf_dir):
    return rounded(ar.var_subset(l_day(spark, sf_dir), [1, 5]))


@query
def var_sigma(spark, sf_dir):
    s = ar.residual_covariance(l_day(spark, sf_dir), [1])
    return rounded(s)


@query
def coef_norms(spark, sf_dir):
    return rounded(ar.norms(ar.var_full(l_day(spark, sf_dir), 1)))


@query
def var_predictions(spark, sf_dir):
    p = e_hour(spark, sf_dir)
    return rounded(ar.predicted(p, ar.var_masked(p, q=0.6, clip=False)))


@query
def r2_per_asset(spark, sf_dir):
    p = e_hour(spark, sf_dir)
    return rounded(goodness.r2_per_asset(p, ar.var_masked(p, q=0.6, clip=False)))


@query
def r2_per_category(spark, sf_dir):
    p = e_hour(spark, sf_dir)
    kinds = spark.createDataFrame([("click", "web"), ("view", "web"), ("purchase", "shop"), ("signup", None)], "asset string, category string")
    return rounded(goodness.r2_per_category(goodness.r2_per_asset(p, ar.var_masked(p, q=0.6, clip=False)), kinds))


def _rolling(spark, sf_dir):
    return rolling_fit(e_hour(spark, sf_dir), 0.6, interval=100, clip=False)


@query
def rolling_coefs(spark, sf_dir):
    return rounded(_rolling(spark, sf_dir).coefs.select("window_id", "src", "tgt", "is_const", "coef"))


@query
def rolling_windows(spark, sf_dir):
    return rounded(_rolling(spark, sf_dir).bounds)


@query
def rolling_interval(spark, sf_dir):
    return rounded(auto_interval(_rolling(spark, sf_dir).mask))


@query
def rolling_r2(spark, sf_dir):
    return rounded(_rolling(spark, sf_dir).r2)


@query
def rolling_r2_total(spark, sf_dir):
    return rounded(_rolling(spark, sf_dir).total())


@query
def activation_freq(spark, sf_dir):
    return rounded(stability.activation_frequency(_rolling(spark, sf_dir).coefs))


@query
def mean_magnitude(spark, sf_dir):
    return rounded(stability.mean_magnitude(_rolling(spark, sf_dir).coefs))


@query
def magnitude_stats(spark, sf_dir):
    return rounded(stability.magnitude_summary(stability.mean_magnitude(_rolling(spark, sf_dir).coefs)))


@query
def sparse_fit_stats(spark, sf_dir):
    return rounded(stability.chunk_stats(l_day(spark, sf_dir), 1, 0.6, 5).select("window_id", "tgt", "n_active", "r2", "r2_null"))


@query
def sparse_fit_full(spark, sf_dir):
    """One chunk: the whole sample at lag 13, where some targets have no source."""
    return rounded(goodness.fit_ratio(stability.chunk_stats(l_day(spark, sf_dir), 13, 0.6, 1)))


@query
def sparse_sweep(spark, sf_dir):
    return rounded(stability.sweep(l_day(spark, sf_dir), 1, [0.55, 0.7], [2, 5]))


def _chunk_coefs(spark, sf_dir):
    return stability.chunk_coefficients(l_day(spark, sf_dir), 1, 0.6, 10)


@query
def chunk_freq(spark, sf_dir):
    return rounded(stability.chunk_frequency(_chunk_coefs(spark, sf_dir)))


@query
def freq_hist(spark, sf_dir):
    return rounded(stability.frequency_levels(stability.chunk_frequency(_chunk_coefs(spark, sf_dir)), 10))


SPECS = [[1], [2], [3], [5], [8], [13], [1, 5]]


@query
def lag_scores(spark, sf_dir):
    return rounded(goodness.lag_scores(l_day(spark, sf_dir), SPECS))


@query
def best_lag(spark, sf_dir):
    return rounded(goodness.best(goodness.one_lag(goodness.lag_scores(l_day(spark, sf_dir), SPECS))))


def _study(spark, sf_dir):
    return link_graph(l_day(spark, sf_dir), lag=1, q=0.6, n_chunks=10)


@query
def graph_edges(spark, sf_dir):
    return rounded(_study(spark, sf_dir).edges)


@query
def graph_nodes(spark, sf_dir):
    return rounded(_study(spark, sf_dir).nodes)


@query
def graph_density(spark, sf_dir):
    return rounded(_study(spark, sf_dir).density)


@query
def graph_sizes(spark, sf_dir):
    s = _study(spark, sf_dir)
    return rounded(graph.visual_sizes(s.nodes, s.edges)[1])


@query
def roll_vol(spark, sf_dir):
    return rounded(pa.rolling_volatility(l_day(spark, sf_dir)))


@query
def bday_resample(spark, sf_dir):
    return rounded(pa.business_bins(l_day(spark, sf_dir)))


@query
def hist_corr(spark, sf_dir):
    p = b_week(spark, sf_dir)
    return rounded(co.histogram(co.upper_triangle(co.correlation(p), p.assets), "rho", -0.2, 1.0, 79))


def _with_flat(spark, sf_dir):
    """The hourly prices, and an asset whose price never changes."""
    p = tables.event_prices(spark, sf_dir)
    return p.unionByName(p.select("ts").distinct().select("ts", F.lit("flat").alias("asset"), F.lit(2.5).alias("price")))


@query
def log_returns_flat(spark, sf_dir):
    return rounded(pa.load_panel(_with_flat(spark, sf_dir)).long())


@query
def corr_flat(spark, sf_dir):
    """An asset that never changes is in the panel, and its correlations are null."""
    return rounded(co.correlation(pa.load_panel(_with_flat(spark, sf_dir))))


@query
def corr_mask_flat(spark, sf_dir):
    return rounded(co.quantile_mask(co.correlation(pa.load_panel(_with_flat(spark, sf_dir))), 0.6))


def _levels(spark, sf_dir):
    """Price levels far from zero."""
    p = tables.region_prices(spark, sf_dir)
    return pa.load_panel(p.withColumn("price", F.col("price") + 1e7), log_returns=False)


@query
def corr_levels(spark, sf_dir):
    p = _levels(spark, sf_dir)
    return rounded(co.correlation(p).select(F.lit(0).alias("lag"), "*").unionByName(co.correlation(p, 1).select(F.lit(1).alias("lag"), "*")))


@query
def several_lag_scores(spark, sf_dir):
    return rounded(goodness.several_lags(goodness.lag_scores(l_day(spark, sf_dir), SPECS)))


@query
def sweep_freq(spark, sf_dir):
    return rounded(stability.sweep_frequency(l_day(spark, sf_dir), 1, [0.55, 0.7], [2, 5]))


@query
def chunk_freq_by_sums(spark, sf_dir):
    """Link frequencies from the chunks' moments, the way for long chunks."""
    p = l_day(spark, sf_dir)
    fits = stability.chunk_fits(p, 1, 0.6, 10, way="sums")
    return rounded(stability.chunk_frequency(ar.coefficients(fits, p.assets, [1], ["window_id"])))


def _regions(spark, sf_dir):
    """Regions with a sector; those of the middle of the alphabet have none."""
    names = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("asset"))
    return names.withColumn("sector", F.when(F.col("asset") < "AS", "south").when(F.col("asset") > "EZ", "east"))


@query
def graph_sectors(spark, sf_dir):
    return rounded(link_graph(l_day(spark, sf_dir), lag=1, q=0.6, n_chunks=10, sectors=_regions(spark, sf_dir)).nodes)


@query
def graph_node_sizes(spark, sf_dir):
    s = _study(spark, sf_dir)
    return rounded(graph.visual_sizes(s.nodes, s.edges)[0])


@query
def dynamics_given(spark, sf_dir):
    """In-sample and later R2 of the network model at given parameters, on a ring of the assets."""
    p = e_hour(spark, sf_dir)
    ring = spark.createDataFrame([(a, p.assets[(i + 1) % len(p.assets)], 0.5) for i, a in enumerate(p.assets)], "src string, tgt string, weight double")
    found = dynamics.predicted_at(p, ring, oracles.THETA)
    split = F.when(F.col("rn") < int((p.count() - 1) * 0.9), "train").otherwise("test")
    return rounded(found.groupBy(split.alias("split")).agg((1 - F.try_divide(F.sum(F.pow(F.col("y") - F.col("yhat"), 2)), F.var_pop("y") * F.count("y"))).alias("r2")))


@query
def csv_round_trip(spark, sf_dir):
    """Prices written as a wide CSV file with a column of remarks, read again, as returns."""
    path = prices.scratch(spark)
    long = tables.event_prices(spark, sf_dir)
    kinds = sorted(r[0] for r in long.select("asset").distinct().collect())
    long.groupBy(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date")).pivot("asset", kinds).agg(F.first("price")).withColumn("remark", F.lit("1 or so")).write.option("header", True).csv(path)
    return rounded(pa.load_panel(prices.read_wide_csv(spark, path)).long())


@query
def rolling_cached(spark, sf_dir):
    """Window coefficients that the second of two runs reads from the cache."""
    folder, p = prices.scratch(spark), e_hour(spark, sf_dir)
    rolling_fit(p, 0.6, interval=100, clip=False, cache=folder)
    return rounded(rolling_fit(p, 0.6, interval=100, clip=False, cache=folder).coefs.select("window_id", "src", "tgt", "is_const", "coef"))


@query
def var_masked_clipped(spark, sf_dir):
    """The default: the mask of the cleaned correlations."""
    return rounded(ar.var_masked(e_hour(spark, sf_dir), q=0.6).select("src", "tgt", "is_const", "coef"))


@query
def block_boot_fixed(spark, sf_dir):
    p = surrogates.block_bootstrap(e_hour(spark, sf_dir), 20, starts=oracles.STARTS)
    return rounded(p.long().select("rn", "asset", "r"))


@query
def train_test_split(spark, sf_dir):
    p = e_hour(spark, sf_dir)
    rows = pa.train_test(p.rows, 0.9, p.count())
    return rounded(rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


@query
def chunk_start_months(spark, sf_dir):
    """Each chunk's first row and its month."""
    p = l_day(spark, sf_dir)
    found = pa.chunks(p.rows, 7, p.count()).groupBy("window_id").agg(F.min_by("ts", "rn").alias("ts"))
    return rounded(found.select("window_id", "ts", F.date_format("ts", "yyyy-MM").alias("month")))


# Without SQL to compare with: random, iterative, or made of eigenvectors.


@query
def rmt_corr(spark, sf_dir):
    p = e_hour(spark, sf_dir)
    return rounded(co.rmt_clip(co.correlation(p), p.assets, p.count()))


@query
def adjacency(spark, sf_dir):
    p = b_week(spark, sf_dir)
    return rounded(co.as_long(spark, co.cleaned_adjacency(co.correlation(p), p.assets, p.count()), p.assets, "weight"))


@query
def var_lasso(spark, sf_dir):
    return rounded(ar.var_lasso(e_hour(spark, sf_dir)))


@query
def null_iid(spark, sf_dir):
    return rounded(surrogates.iid_gaussian(e_hour(spark, sf_dir), 1).long())


@query
def null_phase(spark, sf_dir):
    return rounded(surrogates.phase_randomized(e_hour(spark, sf_dir), 1).long())


@query
def null_comparison(spark, sf_dir):
    """Correlation summaries of the real panel and its surrogates."""
    return rounded(surrogates.compared(e_hour(spark, sf_dir), lambda p: co.summary(co.correlation(p), p.assets), 1))


def _network(spark, sf_dir):
    p = b_week(spark, sf_dir)
    return p, co.cleaned_adjacency(co.correlation(p), p.assets, p.count())


@query
def dynamics_fit(spark, sf_dir):
    p, a = _network(spark, sf_dir)
    return dynamics.dynamics_fit(p, dynamics.quadratic(a))


@query
def dynamics_grid(spark, sf_dir):
    p, a = _network(spark, sf_dir)
    return dynamics.degree_grid(p, a).withColumn("place", F.row_number().over(Window.orderBy(F.desc("r2_out"), "deg_m0", "deg_m2")))


def queries() -> dict[str, Query]:
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
