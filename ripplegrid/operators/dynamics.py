"""Non-linear network dynamics: r_i(t+1) = M0(x_i) + M1(x_i) * sum_j A_ij M2(x_j), fitted by least squares.

Each step needs the residuals' products with the parameters' derivatives alone: every task adds up one small
matrix, and the driver takes a damped Gauss-Newton step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import polyval
from .panel import Panel, lagged, train_test

Function = Callable[..., np.ndarray]


def polynomial(first: float | None = None) -> Function:
    """A polynomial as a function of x and its coefficients, the constant first; first: a constant that isn't a parameter."""

    def value(x, *p):
        out = np.zeros_like(x)
        for c in reversed(p if first is None else (first, *p)):
            out = out * x + c
        return out

    return value


@dataclass
class Model:
    """Three functions of x and their parameters, how many parameters each has, and the adjacency A."""

    m0: Function
    m1: Function
    m2: Function
    sizes: tuple[int, int, int]
    adjacency: np.ndarray

    def predict(self, x: np.ndarray, theta: np.ndarray) -> np.ndarray:
        a, b, c = np.split(np.asarray(theta, float), np.cumsum(self.sizes)[:-1])
        return self.m0(x, *a) + self.m1(x, *b) * (self.m2(x, *c) @ self.adjacency.T)

    def slopes(self, x: np.ndarray, theta: np.ndarray, step: float = 1e-6) -> np.ndarray:
        """(parameters, values): central differences."""
        out = []
        for i in range(len(theta)):
            up, down = np.array(theta, float), np.array(theta, float)
            up[i] += step
            down[i] -= step
            out.append(((self.predict(x, up) - self.predict(x, down)) / (2 * step)).ravel())
        return np.array(out)


def of_degrees(m0: int, m2: int, adjacency: np.ndarray) -> Model:
    """M0 and M2 of these degrees, M1 = 1 + b x."""
    return Model(polynomial(), polynomial(1.0), polynomial(), (m0 + 1, 1, m2 + 1), adjacency)


def quadratic(adjacency: np.ndarray) -> Model:
    return of_degrees(2, 2, adjacency)


@dataclass
class Normal:
    """J'J, J'r, the sum of squared residuals, and of y the number of values, their mean and sum of squares about it."""

    jj: np.ndarray
    jr: np.ndarray
    sse: float
    n: int
    mean: float
    sst: float

    @staticmethod
    def of(model: Model, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> Normal:
        with np.errstate(all="ignore"):
            r, j = (y - model.predict(x, theta)).ravel(), model.slopes(x, theta)
            return Normal(j @ j.T, j @ r, r @ r, y.size, y.mean(), ((y - y.mean()) ** 2).sum())

    def joined(self, o: Normal) -> Normal:
        n, gap = self.n + o.n, o.mean - self.mean
        return Normal(self.jj + o.jj, self.jr + o.jr, self.sse + o.sse, n, self.mean + gap * o.n / n, self.sst + o.sst + gap * gap * self.n * o.n / n)

    @property
    def r2(self) -> float:
        return float(1 - self.sse / self.sst) if self.sst > 0 else 0.0

    @property
    def finite(self) -> bool:
        return bool(np.isfinite(self.jj).all() and np.isfinite(self.jr).all() and np.isfinite(self.sse))


def normal_sums(pairs: DataFrame, asked: dict[int, tuple[Model, np.ndarray]]) -> dict[int, Normal]:
    """Normal of each model at its parameters, all in one pass over pairs (x, y): every task hands on a row a model, which the driver adds up."""

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, Normal] = {}
        for batch in batches:
            x, y = np.stack(batch["x"].to_numpy()), np.stack(batch["y"].to_numpy())
            for k, (model, theta) in asked.items():
                own = Normal.of(model, theta, x, y)
                total[k] = total[k].joined(own) if k in total else own
        if total:
            yield pd.DataFrame([(k, v.jj.ravel(), v.jr, v.sse, v.n, v.mean, v.sst) for k, v in total.items()], columns=["k", "jj", "jr", "sse", "n", "mean", "sst"])

    out: dict[int, Normal] = {}
    rows = pairs.select("x", "y").mapInPandas(work, "k int, jj array<double>, jr array<double>, sse double, n long, mean double, sst double")
    for r in rows.collect():  # a few numbers a model and task
        own = Normal(np.reshape(r["jj"], (len(r["jr"]), -1)), np.array(r["jr"]), r["sse"], r["n"], r["mean"], r["sst"])
        out[r["k"]] = out[r["k"]].joined(own) if r["k"] in out else own
    return out


def damped_fits(pairs: DataFrame, models: dict[int, Model], most: int = 30, tolerance: float = 1e-10) -> dict[int, tuple[np.ndarray, float]]:
    """Levenberg-Marquardt from zeros for all models side by side: (parameters, R2) of each.

    Each round tries a step of every model that isn't done, in one pass over the rows. Parameters without a slope
    yet stay where they are until one appears.
    """
    theta = {k: np.zeros(sum(m.sizes)) for k, m in models.items()}
    damping, open_ = dict.fromkeys(models, 1e-3), set(models)
    now = normal_sums(pairs, {k: (models[k], theta[k]) for k in models})
    if not now:
        return {k: (t, 0.0) for k, t in theta.items()}
    for _ in range(most):
        steps = {}
        for k in sorted(open_):
            d = np.diag(now[k].jj)
            steps[k] = theta[k] + np.linalg.lstsq(now[k].jj + damping[k] * np.diag(d + 1e-12 * max(d.max(), 1e-300)), now[k].jr, rcond=None)[0]
        if not steps:
            break
        tried = normal_sums(pairs, {k: (models[k], t) for k, t in steps.items()})
        for k, t in steps.items():
            if tried[k].finite and tried[k].sse <= now[k].sse:
                done = now[k].sse - tried[k].sse < tolerance * max(now[k].sse, 1e-300)
                theta[k], now[k], damping[k] = t, tried[k], damping[k] / 10
            else:
                damping[k] *= 10
                done = damping[k] > 1e8
            if done:
                open_.remove(k)
    return {k: (theta[k], now[k].r2) for k in models}


def scored(panel: Panel, models: dict[int, Model], share: float) -> tuple[dict[int, tuple[np.ndarray, float]], dict[int, Normal]]:
    """Each model fitted to the first rows, and its Normal on the rest."""
    split = train_test(lagged(panel.rows, [1]), share, panel.count()).select("x", "y", "split").persist()
    try:
        found = damped_fits(split.filter("split = 'train'"), models)
        return found, normal_sums(split.filter("split = 'test'"), {k: (models[k], found[k][0]) for k in models})
    finally:
        split.unpersist()


def dynamics_fit(panel: Panel, model: Model, share: float = 0.9) -> DataFrame:
    """(split, r2, theta) of the model fitted to the first rows; R2 there and on the rest."""
    found, rest = scored(panel, {0: model}, share)
    theta, inside = found[0]
    return panel.rows.sparkSession.createDataFrame([("train", inside, theta.tolist()), ("test", rest[0].r2 if rest else 0.0, theta.tolist())], "split string, r2 double, theta array<double>")


def degree_grid(panel: Panel, adjacency: np.ndarray, degrees: Sequence[int] = range(5), share: float = 0.9) -> DataFrame:
    """(deg_m0, deg_m2, r2_in, r2_out): every pair of degrees of M0 and M2, with M1 = 1 + b x, fitted to the first rows side by side; R2 there and on the rest."""
    grid = dict(enumerate((a, b) for a in degrees for b in degrees))
    found, rest = scored(panel, {k: of_degrees(a, b, adjacency) for k, (a, b) in grid.items()}, share)
    rows = [(a, b, found[k][1], rest[k].r2 if rest else 0.0) for k, (a, b) in grid.items()]
    return panel.rows.sparkSession.createDataFrame(rows, "deg_m0 int, deg_m2 int, r2_in double, r2_out double")


def predicted_at(panel: Panel, adjacency: DataFrame, theta: Sequence[float], sizes: tuple[int, int, int] = (3, 1, 3)) -> DataFrame:
    """(rn, asset, y, yhat) of the polynomial model at given parameters, in DataFrame functions alone; adjacency is (src, tgt, weight)."""
    a, b, c = np.split(np.asarray(theta, float), np.cumsum(sizes)[:-1])
    links = adjacency.filter("weight <> 0").select(F.col("src").alias("asset"), F.col("tgt").alias("src"), "weight")  # at most N * N rows
    now = panel.long().select("rn", "asset", F.col("r").alias("x"))
    own = now.select("rn", F.col("asset").alias("src"), polyval(c[::-1], F.col("x")).alias("m2"))
    pull = own.join(F.broadcast(links), "src").select("rn", "asset", (F.col("m2") * F.col("weight")).alias("v"))
    pull = pull.groupBy("rn", "asset").agg(F.sum("v").alias("pull"))
    after = panel.long().select((F.col("rn") - 1).alias("rn"), "asset", F.col("r").alias("y"))
    joined = now.join(after, ["rn", "asset"]).join(pull, ["rn", "asset"], "left")
    return joined.select("rn", "asset", "y", (polyval(a[::-1], F.col("x")) + polyval([*b[::-1], 1.0], F.col("x")) * F.coalesce("pull", F.lit(0.0))).alias("yhat"))
