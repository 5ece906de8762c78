"""Null models: panels that keep some properties of the real one and lose the links between assets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .panel import Panel

#: Rows whose normal numbers are drawn together, so that a number depends on asset and row alone.
BLOCK = 4096


def iid_gaussian(panel: Panel, seed: int = 0) -> Panel:
    """Independent normal values with each asset's standard deviation and mean zero, the same on any partitioning."""
    sd = {r["asset"]: r["sd"] or 0.0 for r in panel.long().groupBy("asset").agg(F.stddev_samp("r").alias("sd")).collect()}  # a row per asset
    scale = np.array([sd[a] for a in panel.assets])

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        block = int(group["b"].iloc[0])
        values = np.random.default_rng([seed, block]).normal(size=(BLOCK, len(scale))) * scale
        return pd.DataFrame({"rn": group["rn"], "ts": group["ts"], "x": list(values[group["rn"].to_numpy() - block * BLOCK])})

    rows = panel.rows.select("rn", "ts", F.floor(F.col("rn") / BLOCK).cast("long").alias("b"))
    return Panel(rows.groupBy("b").applyInPandas(draw, _schema(panel)), panel.assets)


def _schema(panel: Panel) -> str:
    return f"rn long, ts {panel.rows.schema['ts'].dataType.simpleString()}, x array<double>"


def turned(values: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Series (rows, assets) whose spectra are multiplied by the unit phasors of complex draws (frequencies, assets).

    Every frequency keeps its amplitude. The bins that are real in any real series, the mean's and, with an even
    length, the fastest one's, are left alone, so each series keeps its mean.
    """
    unit = draws / np.abs(draws)
    unit[0] = 1
    if not len(values) % 2:
        unit[-1] = 1
    return np.fft.irfft(np.fft.rfft(values, axis=0) * unit, n=len(values), axis=0)


def phase_randomized(panel: Panel, seed: int = 0, at_once: int = 8) -> Panel:
    """Each asset's phases drawn anew, a task for at_once assets: a Fourier transform needs a whole series."""
    blocks = [(i, panel.assets[i : i + at_once]) for i in range(0, len(panel.assets), at_once)]
    cut = panel.rows.select("rn", "ts", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.slice("x", i + 1, len(names)).alias("x")) for i, names in blocks])).alias("part"))

    def turn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rn")
        values = np.stack(group["x"].to_numpy())
        rng = np.random.default_rng([seed, int(group["i"].iloc[0])])
        draws = rng.normal(size=(2, len(values) // 2 + 1, values.shape[1]))
        return group.assign(x=list(turned(values, draws[0] + 1j * draws[1])))

    kind = panel.rows.schema["ts"].dataType.simpleString()
    parts = cut.select("rn", "ts", "part.*").groupBy("i").applyInPandas(turn, f"rn long, ts {kind}, i int, x array<double>")
    joined = parts.groupBy("rn", "ts").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return Panel(joined.select("rn", "ts", F.flatten(F.transform("v", lambda s: s["x"])).alias("x")), panel.assets, panel.total)


def block_starts(total: int, block: int, seed: int = 0) -> list[int]:
    return np.random.default_rng(seed).integers(0, total - block + 1, total // block).tolist() if total >= block else []


def block_bootstrap(panel: Panel, block: int = 20, seed: int = 0, starts: Sequence[int] | None = None) -> Panel:
    """Blocks of consecutive rows from drawn (or given) starts, one after the other, all assets together. A row's ts is that of the row it was copied from."""
    spark = panel.rows.sparkSession
    starts = block_starts(panel.count(), block, seed) if starts is None else list(starts)
    drawn = spark.createDataFrame(list(enumerate(starts)), "b long, start long")
    step = drawn.select("b", "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("k"))
    copied = step.select((F.col("b") * block + F.col("k")).alias("rn"), (F.col("start") + F.col("k")).alias("from"))
    return Panel(copied.join(panel.rows.withColumnRenamed("rn", "from"), "from").select("rn", "ts", "x"), panel.assets)


def compared(panel: Panel, measure: Callable[[Panel], DataFrame], seed: int = 0, block: int = 20) -> DataFrame:
    """measure's rows for the real panel and its three surrogates, with a column dataset."""
    kinds = {"real": panel, "iid": iid_gaussian(panel, seed), "phase": phase_randomized(panel, seed), "block": block_bootstrap(panel, block, seed)}
    out = None
    for name, one in kinds.items():
        rows = measure(one).select(F.lit(name).alias("dataset"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out
