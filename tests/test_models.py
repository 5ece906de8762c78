import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplegrid.operators import autoregression as ar
from ripplegrid.operators import correlation as co
from ripplegrid.operators import dynamics, goodness, graph, stability, surrogates
from ripplegrid.operators.panel import Panel
from ripplegrid.plans.rolling import rolling_fit


def panel(spark, x, names=None):
    names = names or [chr(65 + i) for i in range(x.shape[1])]
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "rn long, x array<double>")
    return Panel(rows.withColumn("ts", F.timestamp_seconds(F.col("rn") * 60).cast("timestamp_ntz")).select("rn", "ts", "x"), names)


def driven(t=600, beta=0.5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.01, (t, 3))
    x[1:, 1] += beta * x[:-1, 0]
    return x


@pytest.fixture(scope="module")
def abc(spark):
    return panel(spark, driven(3000))


def matrix(coefs, names="ABC"):
    rows = {(r["src"], r["tgt"], r["is_const"]): r["coef"] for r in coefs.collect()}
    return np.array([[rows[("const", t, True)] for t in names]] + [[rows[(s, t, False)] for t in names] for s in names])


def test_correlation_is_numpys(spark):
    x = np.random.default_rng(1).normal(size=(100, 3))
    p = panel(spark, x)
    c = co.as_matrix(co.correlation(p), p.assets, "rho")
    assert np.allclose(c, np.corrcoef(x.T), atol=1e-12) and (c == c.T).all() and (np.diag(c) == 1).all()
    assert np.allclose(co.as_matrix(co.correlation(p, 2), p.assets, "rho"), np.corrcoef(x[:-2].T, x[2:].T)[:3, 3:], atol=1e-12)


@pytest.mark.parametrize("k", [1, 5])
def test_a_delayed_copy_correlates_at_its_lag(spark, k):
    a = np.random.default_rng(2).normal(size=100)
    p = panel(spark, np.stack([a, np.concatenate([np.zeros(k), a[:-k]])], 1))
    assert abs(co.as_matrix(co.correlation(p, k), p.assets, "rho")[0, 1] - 1) < 1e-10


def test_constant_series_have_no_correlation(spark):
    x = np.random.default_rng(3).normal(size=(50, 2))
    x[:, 1] = 2.5
    assert {r["rho"] for r in co.correlation(panel(spark, x)).filter("src <> tgt OR src = 'B'").collect()} == {None}


def test_mask_thresholds(spark):
    def kept(off, n, q):
        c = np.eye(n)
        c[np.triu_indices(n, 1)] = off
        c = np.maximum(c, c.T)
        names = [str(i) for i in range(n)]
        return co.as_matrix(co.quantile_mask(co.as_long(spark, c, names, "rho"), q), names, "rho")

    assert (kept([0.8, 0.2, 0.5], 3, 0.5) == np.eye(3)).all()
    four = kept([0.9, 0.3, 0.1, 0.5, 0.2, 0.7], 4, 0.5)
    assert sorted(four[np.triu_indices(4, 1)][four[np.triu_indices(4, 1)] > 0]) == [0.7, 0.9] and (four == four.T).all()
    assert kept([0.5], 2, 1.0).sum() == 0


def test_clipping_replaces_noise(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 20)) + rng.normal(size=(400, 1))
    c = np.corrcoef(x.T)
    d = co.clipped(c, 400)
    values = np.linalg.eigvalsh(d)
    assert np.allclose(np.diag(d), 1) and (d == d.T).all() and values[-1] > 5 and values[:-1].std() < 0.05
    assert abs(np.linalg.eigvalsh(co.cleaned_adjacency(co.as_long(spark, c, [str(i) for i in range(20)], "rho"), [str(i) for i in range(20)], 400)).max() - 1) < 1e-9


def test_full_and_masked_fits_find_the_link(spark, abc):
    x = driven(3000)
    full = matrix(ar.var_full(abc, 1).filter("lag <= 1"))
    want = np.linalg.lstsq(np.c_[np.ones(2999), x[:-1]], x[1:], rcond=None)[0]
    assert np.allclose(full, want, atol=1e-10) and abs(full[1, 1] - 0.5) < 0.05
    mask = spark.createDataFrame([(s, t, 0.0 if (s, t) == ("A", "B") else 1.0) for s in "ABC" for t in "ABC"], "src string, tgt string, rho double")
    assert matrix(ar.var_masked(abc, mask=mask))[1, 1] == 0


def test_sums_give_the_coefficients_of_rows(abc):
    for q in (None, 0.5):
        assert np.allclose(matrix(ar.var_masked(abc, q=q, clip=False)), matrix(ar.var_masked(abc, q=q, clip=False, way="sums")), atol=1e-8)


def test_more_sources_than_rows_have_the_least_norm(spark):
    x = np.random.default_rng(5).normal(size=(6, 9))
    p = panel(spark, x)
    got = matrix(ar.var_masked(p), p.assets)
    assert np.allclose(got, np.linalg.lstsq(np.c_[np.ones(5), x[:-1]], x[1:], rcond=None)[0], atol=1e-9)


def test_an_asset_named_const_is_told_apart(spark):
    p = panel(spark, driven(100), ["const", "B", "C"])
    assert ar.var_full(p).filter("src = 'const'").groupBy("is_const").count().filter("count = 3").count() == 2


def test_r2(spark, abc):
    r2 = goodness.r2_per_asset(abc, ar.var_masked(abc))
    by = {r["asset"]: r["r2"] for r in r2.collect()}
    assert by["B"] > 0.1 and by["C"] < 0.05 and 0 <= goodness.r2_total(r2).first()[0] <= 1
    kinds = spark.createDataFrame([("A", "stock"), ("B", "stock"), ("C", "crypto")], "asset string, category string")
    assert {r["category"] for r in goodness.r2_per_category(r2, kinds).collect()} == {"stock", "crypto"}
    few = spark.createDataFrame([("A", "stock"), ("B", "stock"), ("C", None)], "asset string, category string")
    assert [r["category"] for r in goodness.r2_per_category(r2, few).collect()] == ["stock"]  # an asset without one is left out


def test_rolling_fit_and_its_cache(spark, tmp_path):
    p = panel(spark, driven(200, 0.3))
    one = rolling_fit(p, 0.5, interval=50, cache=str(tmp_path))
    assert one.bounds.count() == 3 and one.coefs.count() == 3 * 4 * 3  # 200 // 51 windows
    files = sorted(f.name for f in tmp_path.iterdir())
    again = rolling_fit(p, 0.5, interval=50, cache=str(tmp_path))
    assert sorted(map(tuple, again.coefs.collect())) == sorted(map(tuple, one.coefs.collect())) and sorted(f.name for f in tmp_path.iterdir()) == files
    rolling_fit(p, 0.5, interval=50, clip=False, cache=str(tmp_path))
    assert len(list(tmp_path.iterdir())) == len(files) + 1


def test_too_few_rows_give_no_window(spark):
    out = rolling_fit(panel(spark, driven(20)), 0.5, interval=50)
    assert out.coefs.count() == 0 and out.bounds.count() == 0 and out.r2.count() == 0
    with pytest.raises(ValueError, match="1 or more"):
        rolling_fit(panel(spark, driven(20)), 0.5, lag=0)


def test_everything_masked_leaves_means(spark):
    x = driven(60)
    out = rolling_fit(panel(spark, x), 1.0, clip=False)
    assert out.interval == 1 and out.coefs.filter("NOT is_const AND coef <> 0").count() == 0


def test_activation(spark):
    rows = [(0, "A", "B", False, 0.5), (0, "B", "A", False, -0.1), (0, "A", "A", False, 9.0), (1, "A", "B", False, 0.0), (1, "B", "A", False, 0.0), (1, "A", "A", False, 1.0)]
    coefs = spark.createDataFrame(rows, "window_id int, src string, tgt string, is_const boolean, coef double")
    freq = {(r["src"], r["tgt"]): r["freq"] for r in stability.activation_frequency(coefs, 0.8).collect()}
    assert freq == {("A", "B"): 0.5, ("B", "A"): 0.0, ("A", "A"): 0.0}
    assert {(r["src"], r["tgt"]): r["magnitude"] for r in stability.mean_magnitude(coefs).collect()} == {("A", "B"): 0.25, ("B", "A"): -0.05, ("A", "A"): 0.0}


def test_graph_drops_isolated_assets(spark):
    freq = spark.createDataFrame([("A", "B", 0.5), ("B", "B", 1.0), ("C", "A", 0.35), ("C", "C", 0.1)], "src string, tgt string, freq double")
    links = graph.edges(freq, freq.withColumn("weight", F.lit(2.0)))
    assert [tuple(r) for r in links.collect()] == [("A", "B", 2.0)]
    assert {(r["asset"], r["freq"], r["in_degree"], r["out_degree"]) for r in graph.nodes(links, freq).collect()} == {("A", 0.85, 0, 1), ("B", 2.5, 1, 0)}
    assert graph.density(links).first()["density"] == 0.5


def folds_of(x, y, n):
    return [co.Moments.of(part) for part in np.array_split(np.c_[x, y], n)]


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 6))
    y = np.c_[x[:, 0] - 0.5 * x[:, 3] + rng.normal(0, 0.3, 150) + 2, x[:, 5] * 3 + rng.normal(0, 1, 150)]
    const, w, _ = ar.lasso_path(folds_of(x, y, 5), 6, 0.1, 5000, True)
    z, r = (x - x.mean(0)) / x.std(0), y - const - x @ w
    slope, on = z.T @ r / len(y), w != 0
    assert np.allclose(slope[on], 0.1 * np.sign(w[on]), atol=1e-8) and (np.abs(slope[~on]) <= 0.1 + 1e-8).all() and 0 < on.sum() < 12
    # Alphas by brute force: every fold held out in turn, errors from the rows.
    _, _, alphas = ar.lasso_path(folds_of(x, y, 5), 6, None, 5000, True)
    for j in range(2):
        top = np.abs(z.T @ (y[:, j] - y[:, j].mean())).max() / len(y)
        grid, errors = np.geomspace(top, top * 1e-3, 100), np.zeros(100)
        for held in np.array_split(np.arange(150), 5):
            rest = np.setdiff1d(np.arange(150), held)
            zm, ym, w1 = z[rest].mean(0), y[rest, j].mean(), np.zeros((6, 1))
            gram, xy = (z[rest] - zm).T @ (z[rest] - zm) / len(rest), (z[rest] - zm).T @ (y[rest, j] - ym)[:, None] / len(rest)
            for a, alpha in enumerate(grid):
                w1 = ar._descend(gram, xy, alpha, w1, 5000)
                errors[a] += ((y[held, j] - ym - (z[held] - zm) @ w1[:, 0]) ** 2).mean()
        assert abs(alphas[j] / grid[errors.argmin()] - 1) < 1e-9


@pytest.mark.parametrize("mean", [0.0, 1e6, 1e8])
def test_levels_far_from_zero_correlate_as_in_numpy(spark, mean):
    rng = np.random.default_rng(8)
    x = np.cumsum(rng.normal(size=(500, 3)), 0) * 0.1 + mean
    x[:, 1] += x[:, 0] - mean
    p = panel(spark, x)
    p.rows = p.rows.repartition(5)
    assert np.allclose(co.as_matrix(co.correlation(p), p.assets, "rho"), np.corrcoef(x.T), atol=1e-9)
    assert np.allclose(co.as_matrix(co.correlation(p, 1), p.assets, "rho"), np.corrcoef(x[:-1].T, x[1:].T)[:3, 3:], atol=1e-9)
    # The sums' coefficients are those of the same rows without their mean, but for the intercept.
    assert np.allclose(matrix(ar.var_full(p, way="sums"))[1:], matrix(ar.var_full(panel(spark, x - mean), way="rows"))[1:], atol=1e-6)


def test_constant_series_have_no_place_in_a_cleaned_matrix(spark):
    x = np.random.default_rng(9).normal(size=(300, 4)) + np.random.default_rng(10).normal(size=(300, 1)) * 2
    x[:, 2] = 7.0
    p = panel(spark, x)
    out = {(r["src"], r["tgt"]): r["rho"] for r in co.rmt_clip(co.correlation(p), p.assets, 300).collect()}
    assert all((v is None) == ("C" in k) for k, v in out.items()) and out["A", "A"] == 1
    a = co.cleaned_adjacency(co.correlation(p), p.assets, 300)
    assert not a[2].any() and abs(np.linalg.eigvalsh(a).max() - 1) < 1e-9
    assert ar.var_masked(p, q=0.5).filter("coef IS NULL").count() == 0


def test_lag_scores_are_those_of_each_regression(spark, abc):
    x, got = driven(3000), {r["spec"]: r for r in goodness.lag_scores(abc, [[1], [3], [1, 5]]).collect()}
    for spec in ([1], [3], [1, 5]):
        k = max(spec)
        d = np.c_[np.ones(3000 - k), *[x[k - s : 3000 - s] for s in spec]]
        rss = ((x[k:] - d @ np.linalg.lstsq(d, x[k:], rcond=None)[0]) ** 2).sum(0)
        n = 3000 - k
        assert abs(got[str(spec)]["bic"] - (n * np.log(rss / n) + d.shape[1] * np.log(n)).mean()) < 1e-6


def test_sweeps_by_rows_and_by_sums_agree(spark, abc):
    read = lambda way: sorted((r["n_chunks"], r["q"], r["window_id"], r["tgt"], r["k"], round(r["rss"], 9)) for r in stability.sweep_fits(abc, 1, [0.4, 0.8], [2, 3], way).collect())
    assert read("rows") == read("sums") and len(read("sums")) == 2 * (2 + 3) * 3


def test_lasso_by_target(spark):
    out = ar.var_lasso(panel(spark, driven(300)), alpha=1e-4)
    assert out.count() == 12 and out.filter("src = 'A' AND tgt = 'B' AND coef > 0.3").count() == 1


def test_surrogates_keep_what_they_should(spark):
    x = driven(256)
    p = panel(spark, x)
    values = lambda q: np.array([r["x"] for r in q.rows.orderBy("rn").collect()])
    a = values(surrogates.phase_randomized(p, 3))
    assert np.allclose(np.abs(np.fft.rfft(a, axis=0)), np.abs(np.fft.rfft(x, axis=0)), atol=1e-9) and np.allclose(a.mean(0), x.mean(0), atol=1e-12)
    assert np.abs(np.corrcoef(a.T, x.T)[:3, 3:]).max() < 0.3
    b = values(surrogates.iid_gaussian(p, 3))
    assert b.shape == x.shape and np.allclose(b, values(surrogates.iid_gaussian(Panel(p.rows.repartition(7), p.assets), 3)))
    assert (np.abs(b.std(0) / x.std(0) - 1) < 0.2).all()
    c = values(surrogates.block_bootstrap(p, 20, seed=1))
    assert c.shape == (240, 3) and {tuple(r) for r in c} <= {tuple(r) for r in x}


def test_dynamics_recover_their_parameters(spark):
    rng = np.random.default_rng(7)
    a = np.array([[0, 0.8, 0.1], [0.3, 0, 0.5], [0.6, 0.2, 0]])
    theta = np.array([0.02, -0.3, 0.1, 0.4, 0.01, 0.35, 0.2])
    model = dynamics.quadratic(a)
    x = np.zeros((1500, 3))
    for t in range(1499):
        x[t + 1] = model.predict(x[t : t + 1], theta)[0] + rng.normal(0, 0.3, 3)
    p = panel(spark, x)
    out = {r["split"]: r for r in dynamics.dynamics_fit(p, model).collect()}
    assert out["train"]["r2"] > 0.05 and abs(out["train"]["theta"][1] + 0.3) < 0.1 and abs(out["train"]["theta"][5] - 0.35) < 0.12
    best = dynamics.degree_grid(p, a, range(2)).orderBy(F.desc("r2_out")).first()
    assert (best["deg_m0"], best["deg_m2"]) == (1, 1)
