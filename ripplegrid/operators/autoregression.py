"""Least-squares vector autoregressions: full, on chosen lags, masked, diagonal, Lasso.

Two ways lead to the same coefficients. A group of rows (a window, a chunk, a sample) that fits a task is solved
by singular values, which gives the minimum-norm solution where there are more sources than rows. A longer one is
reduced to the sums of products, one matrix a task, and solved from those; mask and targets are picked afterwards.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .correlation import Moments, correlation, cross_sums, quantile_mask, rmt_clip
from .panel import Panel, chunks, lagged, name

#: Values of x and y of a group up to which it is solved in one task.
TASK_VALUES = 20_000_000
FIT = "tgt int, n long, k int, const double, active array<boolean>, coef array<double>, rss double, tss double"


def _key_schema(rows: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name in keys)


def _threshold(c: np.ndarray, q: float) -> np.ndarray:
    """Entries above the quantile of all absolute values; undefined ones neither count nor pass."""
    known = np.abs(c[~np.isnan(c)])
    return np.abs(c) > (np.quantile(known, q) if len(known) else np.inf)


def _group_rows(key: dict, out: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=["tgt", "n", "k", "const", "active", "coef", "rss", "tss"])
    for i, (k, v) in enumerate(key.items()):
        frame.insert(i, k, v)
    return frame


def _solve_rows(x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> list[tuple]:
    out, n = [], len(x)
    solved: dict[bytes, tuple] = {}
    for j in range(y.shape[1]):
        active, t = mask[:, j], y[:, j]
        if active.any():
            # Targets with the same sources share their factors.
            if (sig := active.tobytes()) not in solved:
                design = np.concatenate([np.ones((n, 1)), x[:, active]], 1)
                solved[sig] = design, [k for k in range(y.shape[1]) if np.array_equal(mask[:, k], active)]
            design, same = solved[sig]
            if isinstance(same, list):
                solution = np.linalg.lstsq(design, y[:, same], rcond=None)[0]
                solved[sig] = design, dict(zip(same, solution.T, strict=True))
            b = solved[sig][1][j]
            fitted = design @ b
        else:
            b, fitted = np.array([t.mean()]), np.full(n, t.mean())
        coef = np.zeros(len(active))
        coef[active] = b[1:]
        out.append((j, n, int(active.sum()), float(b[0]), active, coef, float(((t - fitted) ** 2).sum()), float(((t - t.mean()) ** 2).sum())))
    return out


def _solve_moments(m: Moments, n_x: int, mask: np.ndarray) -> list[tuple]:
    xx, xy, tss = m.products[:n_x, :n_x], m.products[:n_x, n_x:], np.diag(m.products)[n_x:]
    out = []
    for j in range(mask.shape[1]):
        active = mask[:, j]
        coef = np.zeros(n_x)
        if active.any():
            coef[active] = np.linalg.lstsq(xx[np.ix_(active, active)], xy[active, j], rcond=None)[0]
        const = m.mean[n_x + j] - coef @ m.mean[:n_x]
        out.append((j, m.n, int(active.sum()), float(const), active, coef, float(tss[j] - coef @ xy[:, j]), float(tss[j])))
    return out


def fit(pairs: DataFrame, n_x: int, n_y: int, keys: Sequence[str] = (), *, mask: np.ndarray | None = None, qs: Sequence[float] | None = None, by_sums: bool = False) -> DataFrame:
    """(keys, tgt, n, k, const, active, coef, rss, tss): the regression of every target on its allowed sources, in every group of pairs (keys, x, y).

    mask: allowed (source, target) pairs for all groups (None: all). With qs each group is fitted once for each q, a
    column more, and the mask is made of the group's own correlations above their quantile; rows are read and moved
    once for all qs. A target without a source is its mean.
    """
    fixed = np.ones((n_x, n_y), bool) if mask is None else np.asarray(mask) != 0
    keys = list(keys)

    def each(key: dict, m: Callable[[], Moments], solve: Callable[[np.ndarray], list[tuple]]) -> Iterator[pd.DataFrame]:
        if qs is None:
            yield _group_rows(key, solve(fixed))
            return
        own = m()
        for q in qs:
            yield _group_rows(key | {"q": float(q)}, solve(_own_mask(own, n_x, q)))

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(group["x"].to_numpy()), np.stack(group["y"].to_numpy())
        return pd.concat(each({k: group[k].iloc[0] for k in keys}, lambda: Moments.of(np.concatenate([x, y], 1)), lambda allowed: _solve_rows(x, y, allowed)), ignore_index=True)

    def reduced(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                m = Moments.read(row, n_x + n_y)
                yield from each({k: row[k] for k in keys}, lambda m=m: m, lambda allowed, m=m: _solve_moments(m, n_x, allowed))

    schema = _key_schema(pairs, keys) + ("q double, " if qs is not None else "") + FIT
    if by_sums:
        return cross_sums(pairs, keys).mapInPandas(reduced, schema)
    return pairs.select(*keys, "x", "y").groupBy(*keys).applyInPandas(whole, schema)


def _own_mask(m: Moments, n_x: int, q: float) -> np.ndarray:
    """Allowed pairs of a group's own lagged correlations."""
    with np.errstate(invalid="ignore"):
        return _threshold(m.correlations()[:n_x, n_x:], q)


def by_sums(rows: int, n_x: int, n_y: int, way: str) -> bool:
    """Whether a group of so many rows is reduced to sums: if it is too long for a task, and long enough to be well conditioned."""
    if way not in ("auto", "rows", "sums"):
        raise ValueError("way: auto, rows or sums")
    return way == "sums" or way == "auto" and rows * (n_x + n_y) > TASK_VALUES and rows >= 5 * (n_x + 1)


def coefficients(fits: DataFrame, assets: Sequence[str], lags: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, lag, src, tgt, is_const, coef): a row for each intercept (source 'const', lag 0) and each source, 0 where it isn't allowed."""
    tgt, n = name(assets, F.col("tgt")).alias("tgt"), len(assets)
    const = fits.select(*keys, F.lit(0).alias("lag"), F.lit("const").alias("src"), tgt, F.lit(True).alias("is_const"), F.col("const").alias("coef"))
    each = fits.select(*keys, "tgt", F.posexplode("coef").alias("i", "coef"))
    lag = F.element_at(F.array(*[F.lit(k) for k in lags]), F.floor(F.col("i") / n).cast("int") + 1)
    slopes = each.select(*keys, lag.alias("lag"), name(assets, F.col("i") % n).alias("src"), tgt, F.lit(False).alias("is_const"), "coef")
    return const.unionByName(slopes)


def var_full(panel: Panel, lags: int = 1, way: str = "auto") -> DataFrame:
    """Coefficients of every asset on all assets at lags 1 to `lags`."""
    return var_subset(panel, range(1, lags + 1), way)


def subset_fits(panel: Panel, lags: Sequence[int], way: str = "auto") -> DataFrame:
    n = len(panel.assets)
    return fit(lagged(panel.rows, lags), n * len(lags), n, by_sums=by_sums(panel.count(), n * len(lags), n, way))


def var_subset(panel: Panel, lags: Sequence[int], way: str = "auto") -> DataFrame:
    """Coefficients on all assets at the given lags alone."""
    return coefficients(subset_fits(panel, list(lags), way), panel.assets, list(lags))


def residual_covariance(panel: Panel, lags: Sequence[int]) -> DataFrame:
    """(a, b, sigma): products of the residuals of two targets, over rows less coefficients, 1 at least; from the sums alone."""
    n, n_x, assets = len(panel.assets), len(panel.assets) * len(lags), panel.assets

    def solve(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                m = Moments.read(row, n_x + n)
                xx, xy, yy = m.products[:n_x, :n_x], m.products[:n_x, n_x:], m.products[n_x:, n_x:]
                sigma = (yy - xy.T @ np.linalg.lstsq(xx, xy, rcond=None)[0]) / max(m.n - n_x - 1, 1)
                i, j = np.indices((n, n)).reshape(2, -1)
                yield pd.DataFrame({"i": i, "j": j, "sigma": ((sigma + sigma.T) / 2).ravel()})

    sums = cross_sums(lagged(panel.rows, list(lags)), []).mapInPandas(solve, "i int, j int, sigma double")
    return sums.select(name(assets, F.col("i")).alias("a"), name(assets, F.col("j")).alias("b"), "sigma")


def mask_matrix(mask: DataFrame, assets: Sequence[str]) -> np.ndarray:
    """Allowed pairs of a long mask, for the tasks: N x N."""
    place = {a: i for i, a in enumerate(assets)}
    out = np.zeros((len(assets), len(assets)), bool)
    for r in mask.filter("rho <> 0").select("src", "tgt").collect():
        out[place[r["src"]], place[r["tgt"]]] = True
    return out


def masked_fits(panel: Panel, lag: int = 1, *, q: float | None = None, mask: DataFrame | None = None, clip: bool = True, way: str = "auto", rows: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Fits at one lag on allowed sources. mask wins; else, with q, the mask of this panel's correlations at lag 0, cleaned unless clip is False; else all are allowed."""
    n = len(panel.assets)
    if mask is None and q is not None:
        corr = correlation(panel)
        mask = quantile_mask(rmt_clip(corr, panel.assets, panel.count()) if clip else corr, q)
    allowed = None if mask is None else mask_matrix(mask, panel.assets)
    pairs = lagged(panel.rows if rows is None else rows, [lag], keys)
    return fit(pairs, n, n, keys, mask=allowed, by_sums=not keys and by_sums(panel.count(), n, n, way) or way == "sums")


def var_masked(panel: Panel, lag: int = 1, **options) -> DataFrame:
    """Coefficients of masked_fits."""
    return coefficients(masked_fits(panel, lag, **options), panel.assets, [lag], options.get("keys", ()))


def var_diagonal(panel: Panel, lag: int = 1) -> DataFrame:
    """(asset, a, c, r2): each asset on its own value `lag` rows before."""
    pairs = lagged(panel.rows, [lag]).select(F.posexplode(F.arrays_zip(F.col("x").alias("x"), F.col("y").alias("y"))).alias("i", "p")).select("i", "p.x", "p.y")
    out = pairs.groupBy("i").agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("c"), F.regr_r2("y", "x").alias("r2"))
    return out.select(name(panel.assets, F.col("i")).alias("asset"), "a", "c", "r2")


def _descend(gram: np.ndarray, xy: np.ndarray, alpha: np.ndarray, w: np.ndarray, most: int, tolerance: float = 1e-10) -> np.ndarray:
    """Coordinate descent on 1/2 w'Gw - w'b + alpha * |w| for each column of w and xy, whose alphas may differ; all columns move a coordinate at once."""
    left, scale = xy - gram @ w, np.diag(gram)
    for _ in range(most):
        before = w.copy()
        for i in np.flatnonzero(scale > 0):
            z = left[i] + scale[i] * w[i]
            step = np.sign(z) * np.maximum(np.abs(z) - alpha, 0) / scale[i] - w[i]
            if step.any():
                left -= np.outer(gram[:, i], step)
                w[i] += step
        if np.abs(w - before).max(initial=0) < tolerance:
            break
    return w


def lasso_path(folds: Sequence[Moments], n_x: int, alpha: float | None, most: int, standardize: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(intercepts, coefficients, alphas) by target of 1/(2n) |y - Xw|^2 + alpha |w|, from the moments of (x, y) of each fold.

    Without an alpha each target takes, of 100 on a log grid down to 1e-3 of the largest that matters, that of the
    least mean squared error over the folds held out. Sources are scaled once, over all rows.
    """
    whole = functools.reduce(Moments.joined, folds)
    scale = np.sqrt(np.diag(whole.products)[:n_x] / whole.n) if standardize else np.ones(n_x)
    scale = np.where(scale > 0, scale, 1.0)
    scaled = lambda m: (m.products[:n_x, :n_x] / np.outer(scale, scale) / m.n, m.products[:n_x, n_x:] / scale[:, None] / m.n)
    gram, xy = scaled(whole)
    targets = xy.shape[1]
    if alpha is None:
        top = np.maximum(np.abs(xy).max(0), 1e-15)
        grid = np.geomspace(top, top * 1e-3, 100)
        errors = np.zeros((len(grid), targets))
        for f, held in enumerate(folds):
            rest = functools.reduce(Moments.joined, [m for i, m in enumerate(folds) if i != f])
            (own_gram, own_xy), (held_gram, held_xy) = scaled(rest), scaled(held)
            w = np.zeros((n_x, targets))
            for a, alphas in enumerate(grid):
                w = _descend(own_gram, own_xy, alphas, w, most)
                off = (held.mean - rest.mean)[n_x:] - ((held.mean - rest.mean)[:n_x] / scale) @ w
                errors[a] += np.diag(held.products)[n_x:] / held.n - 2 * (w * held_xy).sum(0) + (w * (held_gram @ w)).sum(0) + off**2
        alphas = grid[errors.argmin(0), np.arange(targets)]
    else:
        alphas = np.full(targets, float(alpha))
    w = _descend(gram, xy, alphas, np.zeros((n_x, targets)), most) / scale[:, None]
    return whole.mean[n_x:] - whole.mean[:n_x] @ w, w, alphas


def var_lasso(panel: Panel, lag: int = 1, *, alpha: float | None = None, cv: int = 5, max_iter: int = 5000, standardize: bool = True, at_once: int = 16) -> DataFrame:
    """(lag, src, tgt, is_const, coef, alpha): each target's L1 regression on all assets; alpha by cross-validation over contiguous folds unless it is given.

    The panel is passed over once, for the folds' moments (N x N each); blocks of at_once targets are then solved in tasks of their own.
    """
    n, assets, spark = len(panel.assets), panel.assets, panel.rows.sparkSession
    total = max(panel.count() - lag, 0)
    if total < cv:
        raise ValueError("fewer rows than folds")
    pairs = chunks(lagged(panel.rows, [lag]).withColumn("rn", F.col("rn") - lag), cv, total)
    folds = [Moments.read(r, 2 * n) for r in sorted(cross_sums(pairs, ["window_id"]).collect(), key=lambda r: r["window_id"])]  # a row a fold
    shared = spark.sparkContext.broadcast(folds)

    def solve(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in batch["id"]:
                use = np.r_[:n, n + first : n + min(first + at_once, n)]
                const, w, alphas = lasso_path([Moments(m.n, m.mean[use], m.products[np.ix_(use, use)]) for m in shared.value], n, alpha, max_iter, standardize)
                yield pd.DataFrame({"tgt": first + np.arange(len(const)), "const": const, "coef": list(w.T), "alpha": alphas})

    fits = spark.range(0, n, at_once, -(-n // at_once)).mapInPandas(solve, "tgt int, const double, coef array<double>, alpha double")
    out = coefficients(fits.select("tgt", "const", "coef", "alpha"), assets, [lag], ["alpha"])
    return out.select("lag", "src", "tgt", "is_const", "coef", "alpha")


def predicted(panel: Panel, coefs: DataFrame, lag: int = 1, rows: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, rn, tgt, y, yhat): x @ A + c. Without keys the matrix (N x N) goes to every task and no row is shuffled; with keys each group of rows meets its own."""
    pairs = lagged(panel.rows if rows is None else rows, [lag], keys)
    n, place = len(panel.assets), {a: i for i, a in enumerate(panel.assets)}
    index = F.create_map(*[F.lit(v) for a, i in place.items() for v in (a, i)])
    at = lambda c: F.try_element_at(index, F.col(c))
    cells = coefs.filter("coef <> 0").select(*keys, F.when(F.col("is_const"), F.lit(n)).otherwise(at("src")).alias("i"), at("tgt").alias("j"), "coef")

    def filled(i, j, v) -> np.ndarray:
        out = np.zeros((n + 1, n))
        out[np.asarray(i, int), np.asarray(j, int)] = v
        return out

    def answers(part: pd.DataFrame, a: np.ndarray) -> pd.DataFrame:
        x = np.stack(part["x"].to_numpy())
        return part[[*keys, "rn", "y"]].assign(yhat=list(x @ a[:n] + a[n]))

    head = _key_schema(pairs, keys)
    schema = f"{head}rn long, y array<double>, yhat array<double>"
    if keys:
        matrices = cells.groupBy(*keys).agg(F.collect_list("i").alias("i"), F.collect_list("j").alias("j"), F.collect_list("coef").alias("coef"))  # at most N * (N + 1) each

        def own(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return left.assign(yhat=None)[[*keys, "rn", "y", "yhat"]]
            a = filled(right["i"].iloc[0], right["j"].iloc[0], right["coef"].iloc[0]) if len(right) else np.zeros((n + 1, n))
            return answers(left, a)

        found = pairs.select(*keys, "rn", "x", "y").groupBy(*keys).cogroup(matrices.groupBy(*keys)).applyInPandas(own, schema)
    else:
        held = cells.collect()  # at most N * (N + 1)
        shared = panel.rows.sparkSession.sparkContext.broadcast(filled([r["i"] for r in held], [r["j"] for r in held], [r["coef"] for r in held]))

        def every(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield answers(batch, shared.value)

        found = pairs.select("rn", "x", "y").mapInPandas(every, schema)
    each = found.select(*keys, "rn", F.posexplode(F.arrays_zip("y", "yhat")).alias("j", "v"))
    return each.select(*keys, "rn", name(panel.assets, F.col("j")).alias("tgt"), F.col("v.y").alias("y"), F.col("v.yhat").alias("yhat"))


def predicted(panel: Panel, coefs: DataFrame, lag: int = 1, rows: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, rn, tgt, y, yhat): the sum of the sources' values times their coefficients, plus the intercept. Only coefficients that aren't 0 are joined."""
    pairs = lagged(panel.rows if rows is None else rows, [lag], keys)
    source = pairs.select(*keys, "rn", F.posexplode("x").alias("i", "v")).select(*keys, "rn", name(panel.assets, F.col("i")).alias("src"), "v")
    target = pairs.select(*keys, "rn", F.posexplode("y").alias("j", "y")).select(*keys, "rn", name(panel.assets, F.col("j")).alias("tgt"), "y")
    slopes = coefs.filter("NOT is_const AND coef <> 0").select(*keys, "src", "tgt", "coef")
    moved = source.join(slopes, [*keys, "src"]).groupBy(*keys, "rn", "tgt").agg(F.sum(F.col("v") * F.col("coef")).alias("s"))
    const = coefs.filter("is_const").select(*keys, "tgt", F.col("coef").alias("const"))
    held = target.join(const, [*keys, "tgt"]).join(moved, [*keys, "rn", "tgt"], "left")
    return held.select(*keys, "rn", "tgt", "y", (F.col("const") + F.coalesce("s", F.lit(0.0))).alias("yhat"))


def norms(coefs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Frobenius norms of the coefficients, of their diagonal and of the rest; mean and largest absolute value; share above 0.05."""
    slopes = coefs.filter("NOT is_const")
    square, own = F.col("coef") * F.col("coef"), F.col("src") == F.col("tgt")
    root = lambda c: F.sqrt(F.sum(c))
    return slopes.groupBy(*keys).agg(
        root(square).alias("fro"), root(F.when(own, square).otherwise(0.0)).alias("fro_diag"), root(F.when(own, 0.0).otherwise(square)).alias("fro_off"),
        F.avg(F.abs("coef")).alias("mean_abs"), F.max(F.abs("coef")).alias("max_abs"), F.avg((F.abs("coef") > 0.05).cast("int")).alias("share_large"),
    )
