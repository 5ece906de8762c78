"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A document of source s is repeated Poisson(rate_s) times, where rate_s = total * weight_s / n_s, so
that source s is expected to supply its share of `total` rows. The Poisson number is the inverse of
the distribution function at a uniform number hashed from seed and document id: equal input and seed
give equal output on any partitioning, and a lost task repeats itself exactly.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest mean that is inverted at once; a larger rate is a sum of independent draws below it.
MEAN_AT_ONCE = 16.0
#: Terms of the distribution function: beyond 80, a Poisson(16) has less than 1e-28.
TERMS = 80
#: Sources up to which their rates (under 1 kB each) are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 10_000
_HEX = 13


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the parts, joined by colons."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, _HEX), 16, 10).cast("double") / F.lit(float(16**_HEX))


def shuffle_key(*parts: Column | str) -> Column:
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, alpha: float, total: float | None, source: str) -> DataFrame:
    """One row per source: src, n, rate, draws (of at most MEAN_AT_ONCE each) and the draw's distribution function.

    weights: by source, not negative; sources that are missing get 0. None: n ** alpha.
    """
    n = docs.groupBy(F.col(source).alias("src")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    else:
        if any(not v >= 0 for v in weights.values()):
            raise ValueError("weights can't be negative")
        if weights:
            given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
            n = n.withColumn("w", F.coalesce(F.try_element_at(given, F.coalesce("src", F.lit(""))), F.lit(0.0)))
        else:
            n = n.withColumn("w", F.lit(0.0))
    sums = n.agg(F.sum("w").alias("all_w"), F.sum("n").cast("double").alias("all_n"))  # one row
    share = F.coalesce(F.try_divide(F.col("w"), F.col("all_w")), F.lit(0.0))
    out = n.join(F.broadcast(sums)).withColumn("rate", (F.lit(float(total)) if total is not None else F.col("all_n")) * share / F.col("n"))
    out = out.withColumn("draws", F.greatest(F.ceil(F.col("rate") / F.lit(MEAN_AT_ONCE)), F.lit(1)).cast("int"))
    out = out.withColumn("mean", F.col("rate") / F.col("draws"))
    steps = F.expr(
        f"aggregate(sequence(1, {TERMS}), named_struct('p', exp(-mean), 'c', array(exp(-mean))),"
        " (s, k) -> named_struct('p', s.p * mean / k, 'c', concat(s.c, array(element_at(s.c, -1) + s.p * mean / k))),"
        " s -> s.c)"
    )
    return out.select("src", "n", "rate", "draws", steps.alias("cdf"))


def poisson_mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    *,
    alpha: float = 0.5,
    total: float | None = None,
    seed: str = "mix-1",
    key: str = "doc_id",
    source: str = "source",
    copy_col: str = "copy",
    order_col: str = "shuffle_key",
) -> DataFrame:
    """docs with each row repeated Poisson(rate of its source) times, plus copy (from 1) and shuffle_key, in random order.

    total: expected number of rows (default: as many as docs has). Without weights, a source's weight is
    its rows to the power alpha. The rows are dealt by shuffle_key, a hash of seed, id and copy, and sorted
    by it within each partition, which is a global random order. Null ids hash as a missing part and null
    sources are a source of their own; rows with equal ids get equal counts; no rows give no rows. Any
    other columns are kept; columns of docs named like the two new ones are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(copy_col, order_col)
    rates = source_rates(docs, weights, alpha, total, source)
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    names = docs.columns
    d, r = docs.alias("d"), rates.select("src", "draws", "cdf").alias("r")
    joined = d.join(r, F.col(f"d.{source}").eqNullSafe(F.col("r.src")))
    ident = F.col(f"d.{key}").cast("string")
    count = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.col("r.draws")), lambda j: F.size(F.filter(F.col("r.cdf"), lambda c: c <= uniform(seed, j.cast("string"), ident)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    counted = joined.select(*[F.col(f"d.`{c}`") for c in names], count.alias("__n")).filter("__n > 0")
    copies = counted.select(*[F.col(f"`{c}`") for c in names], F.explode(F.sequence(F.lit(1), F.col("__n"))).alias(copy_col))
    keyed = copies.withColumn(order_col, shuffle_key(seed, "order", F.col(key).cast("string"), F.col(copy_col).cast("string")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, F.col(order_col)).sortWithinPartitions(order_col, key)
