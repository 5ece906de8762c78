"""Correlation matrices, lagged or not, quantile masks and random-matrix cleaning."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .panel import Panel, lagged, name

#: Entries of a cleaned matrix below this are noise of the rebuilding and become 0.
NOISE = 1e-12


@dataclass
class Moments:
    """Row count, means and sums of centred products of some columns."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    @staticmethod
    def of(z: np.ndarray) -> Moments:
        mean = z.mean(0)
        off = z - mean
        return Moments(len(z), mean, off.T @ off)

    @staticmethod
    def read(row, columns: int) -> Moments:
        return Moments(int(row["n"]), np.asarray(row["mean"], float), np.asarray(row["s"], float).reshape(columns, columns))

    def joined(self, other: Moments) -> Moments:
        """Of both sets of rows; nothing is subtracted that is large beside what is left, whatever the columns' means."""
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.products + other.products + np.outer(gap, gap) * (self.n * other.n / n))

    def spread(self) -> np.ndarray:
        """Each column's variance; NaN where rounding is all that is left of a constant."""
        var = np.diag(self.products) / self.n
        return np.where(var > 1e-28 * self.mean**2, var, np.nan)

    def correlations(self) -> np.ndarray:
        """NaN with a constant column."""
        sd = np.sqrt(self.spread())
        return self.products / self.n / np.outer(sd, sd)


MOMENTS = "n long, mean array<double>, s array<double>"


def moment_rows(found: dict[tuple, Moments], keys: Sequence[str]) -> pd.DataFrame:
    held = list(found.values())
    return pd.DataFrame({**{k: [key[i] for key in found] for i, k in enumerate(keys)}, "n": [m.n for m in held], "mean": [m.mean for m in held], "s": [m.products.ravel() for m in held]})


def merged_moments(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a key of rows (keys, n, mean, s), merged in two steps so that no task gets a row of every other task."""
    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in parts.schema if f.name in keys)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        rows = [Moments.read(r, len(r["mean"])) for _, r in group.iterrows()]
        return moment_rows({tuple(group[k].iloc[0] for k in keys): functools.reduce(Moments.joined, rows)}, keys)

    salted = parts.withColumn("__salt", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(16)))
    once = salted.groupBy(*keys, "__salt").applyInPandas(lambda g: merge(g), head + MOMENTS)
    return once.groupBy(*keys).applyInPandas(merge, head + MOMENTS)


def cross_sums(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, mean, s): Moments of (x, y) by key. Each task sums its own rows in numpy; only one matrix per task and key is shuffled."""
    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in pairs.schema if f.name in keys)

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, Moments] = {}
        for batch in batches:
            for key, rows in batch.groupby(list(keys), sort=False) if keys else [((), batch)]:
                own = Moments.of(np.concatenate([np.stack(rows["x"].to_numpy()), np.stack(rows["y"].to_numpy())], 1))
                key = key if isinstance(key, tuple) else (key,)
                found[key] = found[key].joined(own) if key in found else own
        if found:
            yield moment_rows(found, keys)

    return merged_moments(pairs.select(*keys, "x", "y").mapInPandas(work, head + MOMENTS), keys)


def correlation(panel: Panel, lag: int = 0, keys: Sequence[str] = (), rows: DataFrame | None = None) -> DataFrame:
    """(keys, src, tgt, rho): correlation of the source `lag` rows before with the target, null where a series is constant.

    At lag 0 each pair is computed once, so that mirrored entries are equal and the diagonal is exactly 1.
    """
    rows, n = panel.rows if rows is None else rows, len(panel.assets)
    pairs = lagged(rows, [lag], keys) if lag else rows.select(*keys, "x", F.array().cast("array<double>").alias("y"))
    sums = cross_sums(pairs, keys)
    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in sums.schema if f.name in keys)

    def entries(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                with np.errstate(invalid="ignore"):
                    c = Moments.read(row, n * (1 + bool(lag))).correlations()
                if lag:
                    c = c[:n, n:]
                else:
                    own = np.where(np.isnan(np.diag(c)), np.nan, 1.0)
                    c = np.clip(np.triu(c, 1), -1, 1)
                    c += c.T
                    np.fill_diagonal(c, own)
                i, j = np.indices((n, n)).reshape(2, -1)
                yield pd.DataFrame({**{k: row[k] for k in keys}, "i": i, "j": j, "rho": pd.Series(c.ravel()).where(~np.isnan(c.ravel()), None)})

    long = sums.mapInPandas(entries, f"{head}i int, j int, rho double")
    return long.select(*keys, name(panel.assets, F.col("i")).alias("src"), name(panel.assets, F.col("j")).alias("tgt"), "rho")


def autocorrelation(panel: Panel, lag: int = 1) -> DataFrame:
    """(asset, rho): each asset's correlation with itself `lag` rows before."""
    return correlation(panel, lag).filter("src = tgt").select(F.col("src").alias("asset"), "rho")


def upper_triangle(corr: DataFrame, assets: Sequence[str]) -> DataFrame:
    """Entries whose source stands before their target in the order."""
    names = F.array(*[F.lit(a) for a in assets])
    return corr.filter(F.array_position(names, F.col("src")) < F.array_position(names, F.col("tgt")))


def summary(corr: DataFrame, assets: Sequence[str]) -> DataFrame:
    """(mean_abs, std, max_abs) off the diagonal; std with the number of entries as divisor."""
    return upper_triangle(corr, assets).agg(F.avg(F.abs("rho")).alias("mean_abs"), F.stddev_pop("rho").alias("std"), F.max(F.abs("rho")).alias("max_abs"))


def quantile_mask(corr: DataFrame, q: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, src, tgt, rho): the entries whose absolute value is above the q-quantile, linearly interpolated, of all entries of the matrix that aren't null."""
    cut = corr.groupBy(*keys).agg(F.percentile(F.abs("rho"), F.lit(float(q))).alias("__cut"))
    held = corr.join(cut, list(keys)) if keys else corr.crossJoin(F.broadcast(cut))  # one row
    return held.filter(F.abs("rho") > F.col("__cut")).drop("__cut")


def mask_sources(mask: DataFrame) -> DataFrame:
    """(tgt, n): allowed sources of each target."""
    return mask.groupBy("tgt").agg(F.count(F.lit(1)).alias("n"))


def as_matrix(long: DataFrame, assets: Sequence[str], value: str, fill: float = 0.0) -> np.ndarray:
    """A matrix of at most len(assets) ** 2 rows, on the driver."""
    place = {a: i for i, a in enumerate(assets)}
    out = np.full((len(assets), len(assets)), fill)
    for r in long.select("src", "tgt", value).collect():
        if r[value] is not None and r["src"] in place and r["tgt"] in place:
            out[place[r["src"]], place[r["tgt"]]] = r[value]
    return out


def as_long(spark, matrix: np.ndarray, assets: Sequence[str], value: str) -> DataFrame:
    return spark.createDataFrame([(a, b, None if np.isnan(matrix[i, j]) else float(matrix[i, j])) for i, a in enumerate(assets) for j, b in enumerate(assets)], f"src string, tgt string, {value} double")


def noise_free(corr: np.ndarray, observations: int) -> np.ndarray:
    """Factors F of a cleaned correlation matrix F F': eigenvalues below the Marchenko-Pastur edge become their mean, and rows have length 1."""
    values, vectors = np.linalg.eigh(corr)
    edge = values.mean() * (1 + np.sqrt(len(corr) / observations)) ** 2
    if (low := values < edge).any():
        values[low] = values[low].mean()
    factors = vectors * np.sqrt(np.maximum(values, 0))
    return factors / np.linalg.norm(factors, axis=1, keepdims=True)


def clipped(corr: np.ndarray, observations: int) -> np.ndarray:
    """The cleaned matrix; rows and columns of a series without correlations (NaN on the diagonal) stay NaN."""
    out = np.full(corr.shape, np.nan)
    known = np.flatnonzero(~np.isnan(np.diag(corr)))
    if len(known):
        factors = noise_free(corr[np.ix_(known, known)], observations)
        upper = np.triu(factors @ factors.T, 1)
        upper[np.abs(upper) < NOISE] = 0
        out[np.ix_(known, known)] = upper + upper.T + np.eye(len(known))
    return out


def rmt_clip(corr: DataFrame, assets: Sequence[str], observations: int) -> DataFrame:
    """clipped() of a long lag-0 matrix; it is N x N, which the driver holds."""
    return as_long(corr.sparkSession, clipped(as_matrix(corr, assets, "rho", np.nan), observations), assets, "rho")


def cleaned_adjacency(corr: DataFrame, assets: Sequence[str], observations: int) -> np.ndarray:
    """The clipped matrix with a zero diagonal, over its largest eigenvalue; all 0 where nothing but noise was found.

    Without its unit diagonal the matrix F F' - I has the squared singular values of F less 1 as eigenvalues, so the
    factors tell the largest. Series without correlations have no links.
    """
    whole = as_matrix(corr, assets, "rho", np.nan)
    out, known = clipped(whole, observations), np.flatnonzero(~np.isnan(np.diag(whole)))
    np.fill_diagonal(out, 0)
    out = np.nan_to_num(out)
    if not out.any():
        return out
    return out / (np.linalg.norm(noise_free(whole[np.ix_(known, known)], observations), 2) ** 2 - 1)


def histogram(values: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, density): share of the values within [low, high] in each of `bins` equal bins, over their width; the last bin holds its upper edge."""
    width = (high - low) / bins
    v = F.col(value)
    counted = values.filter((v >= low) & (v <= high)).groupBy(F.least(F.floor((v - low) / F.lit(width)), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    every = values.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counted, "bin", "left").crossJoin(F.broadcast(total))
    return every.select("bin", F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)), F.col("total") * F.lit(width)), F.lit(0.0)).alias("density"))
