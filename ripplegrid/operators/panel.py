"""Aligned log-return panels, lags, windows and chunks.

A panel has one row per complete timestamp, numbered from 0 without gaps, and holds the assets' values as an
array in a fixed order. Rows are matched by number through equi-joins, so no step sorts a long series in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Timestamps are numbered within days, and days among each other.
DAY = "to_date(ts)"


@dataclass
class Panel:
    """rows(rn, ts, x), the assets in the order of x, and the number of rows once it is known."""

    rows: DataFrame
    assets: list[str]
    total: int | None = None

    def long(self) -> DataFrame:
        """(rn, ts, asset, r)"""
        each = self.rows.select("rn", "ts", F.posexplode("x").alias("i", "r"))
        return each.select("rn", "ts", name(self.assets, F.col("i")).alias("asset"), "r")

    def count(self) -> int:
        if self.total is None:
            self.total = self.rows.count()
        return self.total

    @contextmanager
    def kept(self) -> Iterator[Panel]:
        """The panel with its rows persisted, for callers that pass over them several times; released at the end."""
        self.rows.persist()
        try:
            yield self
        finally:
            self.rows.unpersist()


def name(assets: Sequence[str], i: Column) -> Column:
    """The asset at a place of the order (from 0)."""
    return F.element_at(F.array(*[F.lit(a) for a in assets]), i.cast("int") + 1)


def numbered(stamps: DataFrame) -> DataFrame:
    """(ts, rn) of distinct timestamps: in-day numbers plus the sum of the days before; only a row a day meets in one task."""
    day = F.expr(DAY)
    days = stamps.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    before = days.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = stamps.withColumn("day", day).withColumn("i", F.row_number().over(Window.partitionBy("day").orderBy("ts")) - 1)
    return inside.join(before.select("day", "before"), "day").select("ts", (F.col("before") + F.col("i")).cast("long").alias("rn"))


def load_panel(prices: DataFrame, *, log_returns: bool = True, assets: Sequence[str] | None = None) -> Panel:
    """Returns (or prices) of all assets at the timestamps at which each of them has a price. assets: those taken, in their order; by default all, by name.

    A return is ln(price / price at the complete timestamp before), of positive prices; without log_returns any price
    counts that is neither null nor NaN. An asset's prices at one timestamp are averaged. Series that never change
    stay: their correlations are null. An asset that was asked for and has no price is left out. Rows are made dense by
    one shuffle on the timestamp, and matched with the row before by number.
    """
    usable = F.col("price").isNotNull() & ~F.isnan("price")
    valid = prices.filter(usable & (F.col("price") > 0) if log_returns else usable)
    if assets is not None:
        valid = valid.filter(F.col("asset").isin(list(assets)))
    found = {r["asset"] for r in valid.select("asset").distinct().collect()}  # a row per asset
    names = [a for a in assets if a in found] if assets is not None else sorted(found)
    once = valid.repartition("ts").groupBy("ts", "asset").agg(F.avg("price").alias("r"))
    full = wide(once, ["ts"], names).filter(F.size("x") == len(names))
    rows = full.join(numbered(full.select("ts")), "ts").select("rn", "ts", "x")
    if log_returns:
        before = rows.select((F.col("rn") + 1).alias("rn"), F.col("x").alias("x0"))
        change = F.zip_with("x", "x0", lambda now, then: F.ln(now / then))
        rows = rows.join(before, "rn").select((F.col("rn") - 1).alias("rn"), "ts", change.alias("x"))
    return Panel(rows, names)


def wide(long: DataFrame, keys: Sequence[str], assets: Sequence[str]) -> DataFrame:
    """(keys, x): the values of (keys, asset, r) as arrays in the order of the assets; others are left out."""
    place = F.create_map(*[F.lit(v) for i, a in enumerate(assets) for v in (a, i)]) if assets else F.create_map()
    ranked = long.filter(F.col("asset").isin(list(assets))).withColumn("i", F.try_element_at(place, F.col("asset")) if assets else F.lit(0))
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda s: s["r"]).alias("x"))


def dense(returns: DataFrame, assets: Sequence[str]) -> Panel:
    """A panel of long returns (rn, ts, asset, r)."""
    return Panel(wide(returns, ["rn", "ts"], assets).select("rn", "ts", "x"), list(assets))


def overlapping(rows: DataFrame, reach: int, block: int) -> DataFrame:
    """rows with b, a block of row numbers: each row is in its own block (own: true) and in all that begin at most `reach` rows after it.

    So a window function over `reach` rows back runs in each block, and no task gets a whole series.
    """
    first = F.floor(F.col("rn") / block)
    dealt = rows.withColumn("b", F.explode(F.sequence(first, F.floor((F.col("rn") + reach) / block))))
    return dealt.withColumn("own", F.col("b") == first)


def lagged(rows: DataFrame, lags: Sequence[int], keys: Sequence[str] = (), block: int = 4096) -> DataFrame:
    """(keys, rn, ts, x, y): each row's values as y, and as x the values `lag` rows before, one lag after the other, within equal keys. One shuffle serves all lags."""
    cut = with_lags(rows, lags, keys, block)
    for k in lags:
        cut = cut.filter(F.col(f"__x{k}").isNotNull())
    return cut.select(*keys, "rn", "ts", F.concat(*[F.col(f"__x{k}") for k in lags]).alias("x"), F.col("x").alias("y"))


def with_lags(rows: DataFrame, lags: Sequence[int], keys: Sequence[str] = (), block: int = 4096) -> DataFrame:
    """(keys, rn, ts, x, __x1 ...): rows with the values of the row numbered `lag` less, null where there is none."""
    if not lags or any(k < 1 for k in lags):
        raise ValueError("lags must be 1 or more")
    w = Window.partitionBy(*keys, "b").orderBy("rn")
    dealt = overlapping(rows.select(*keys, "rn", "ts", "x"), max(lags), block)
    return dealt.select("*", *[F.first("x").over(w.rangeBetween(-k, -k)).alias(f"__x{k}") for k in dict.fromkeys(lags)]).filter("own").drop("own", "b")


def windows(rows: DataFrame, size: int, total: int) -> DataFrame:
    """rows with window_id: windows of `size` rows one after the other; a shorter tail is dropped."""
    if size < 1:
        raise ValueError("a window needs a row")
    return rows.withColumn("window_id", F.floor(F.col("rn") / size).cast("int")).filter(F.col("window_id") < total // size)


def chunks(rows: DataFrame, n: int, total: int) -> DataFrame:
    """rows with window_id: n chunks of equal size, the first total % n of them with a row more."""
    if n < 1:
        raise ValueError("at least one chunk is needed")
    size, more = divmod(total, n)
    cut = more * (size + 1)
    late = F.lit(more) + F.floor((F.col("rn") - cut) / max(size, 1))
    return rows.withColumn("window_id", F.when(F.col("rn") < cut, F.floor(F.col("rn") / (size + 1))).otherwise(late).cast("int"))


def window_bounds(rows: DataFrame) -> DataFrame:
    """(window_id, start_ts, end_ts, n_rows)"""
    return rows.groupBy("window_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n_rows"))


def train_test(rows: DataFrame, share: float, total: int) -> DataFrame:
    """rows with split: train for the first int(total * share), then test."""
    return rows.withColumn("split", F.when(F.col("rn") < int(total * share), "train").otherwise("test"))


def rolling_volatility(panel: Panel, size: int = 50, block: int = 4096) -> DataFrame:
    """(rn, ts, vol): mean over the assets of the standard deviation of the last `size` rows; null before there are so many."""
    dealt = overlapping(panel.long(), size - 1, block)
    w = Window.partitionBy("asset", "b").orderBy("rn").rowsBetween(-(size - 1), 0)
    sd = F.when(F.count("r").over(w) == size, F.stddev_samp("r").over(w))
    return dealt.withColumn("sd", sd).filter("own").groupBy("rn", "ts").agg(F.avg("sd").alias("vol"))


def business_bins(panel: Panel, days: int = 3) -> DataFrame:
    """(bin_ts, r): in bins of `days` business days from the first row's, each asset's last value, its change from the bin before, averaged over the assets. Rows of a weekend belong to the Friday before."""
    long = panel.long().withColumn("d", F.to_date("ts"))
    # Business days since Monday 1970-01-05.
    gone = F.datediff("d", F.lit("1970-01-05").cast("date"))
    ordinal = (F.floor(gone / 7) * 5 + F.least(F.pmod(gone, F.lit(7)), F.lit(4))).cast("long")
    marked = long.withColumn("o", ordinal)
    first = marked.agg(F.min("o").alias("o0"))  # one row
    binned = marked.join(F.broadcast(first)).withColumn("bin", F.floor((F.col("o") - F.col("o0")) / days))
    last = binned.groupBy("asset", "bin").agg(F.max_by("r", "rn").alias("v"), F.min("o0").alias("o0"))
    w = Window.partitionBy("asset").orderBy("bin")
    change = last.withColumns({"r": F.col("v") - F.lag("v").over(w), "gap": F.col("bin") - F.lag("bin").over(w)}).filter("gap = 1")
    at = F.col("o0") + F.col("bin") * days
    label = F.date_add(F.lit("1970-01-05").cast("date"), (F.floor(at / 5) * 7 + F.pmod(at, F.lit(5))).cast("int"))
    return change.groupBy("bin", label.alias("bin_ts")).agg(F.avg("r").alias("r"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(panel.assets)).select("bin_ts", "r")
