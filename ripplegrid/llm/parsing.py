"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing parses a text into phrases of two or more symbols whose borders depend on a few
neighbouring symbols alone; a phrase's name is a hash of its symbols, and the names are parsed again. So equal
substrings get equal names in their interior, wherever they stand. A fingerprint is the bottom-k sketch of a
text's phrase names of the middle levels, and the likeness of two is their estimated resemblance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, runs, tasks
from .wordscan import mixed

#: Levels whose names make the fingerprint (a phrase of level n spans about 3.5 ** n characters), and its size.
LEVELS, SKETCH = (2, 3, 4), 64
#: Rounds of coin tossing: labels of 64-bit names are below 128, 14 and 8.
ROUNDS = 3
_LOWEST = np.array([0] + [(i & -i).bit_length() - 1 for i in range(1, 256)], np.uint8)
_ODD = mixed(np.arange(1, 1025, dtype=np.uint64)) | np.uint64(1)
CHARS = 1 << 19


def merged_runs(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names with each run of equal ones in a text turned into one, named after its symbol whatever its length, so that a longer or shorter repetition looks alike."""
    begin = np.ones(len(names), bool)
    np.not_equal(names[1:], names[:-1], out=begin[1:])
    begin[first[:-1][first[:-1] < len(names)]] = True
    at = np.flatnonzero(begin)
    if len(at) == len(names):
        return names, first
    size = np.diff(at, append=len(names))
    out, long = names[at], size > 1
    out[long] = mixed(out[long] + _ODD[7])
    return out, np.searchsorted(at, first)


def coin_labels(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A label below 8 of each symbol, from it and the ROUNDS symbols before it in its text; neighbours that differ have labels that differ."""
    differ = names.copy()
    differ[1:] ^= names[:-1]
    differ[starts] = names[starts]
    low = differ & (~differ + np.uint64(1))
    bit = np.bitwise_count(low - np.uint64(1)).astype(np.uint8)
    label = (bit & 63) << 1 | ((names & low) != 0)
    for _ in range(ROUNDS - 1):
        d = label.copy()
        d[1:] ^= label[:-1]
        d[starts] = label[starts]
        bit = _LOWEST[d]
        label = bit << 1 | (label >> bit & 1)
    return label


def phrases(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases, and how many stand before each text. A phrase starts at a local maximum of the labels, or with its text."""
    names, first = merged_runs(names, first)
    if not len(names):
        return names, first
    starts = first[:-1][np.diff(first) > 0]
    label = coin_labels(names, starts)
    begin = np.zeros(len(names), bool)
    begin[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    begin[starts[1:] - 1] = False  # a text's last symbol has no neighbour after it
    begin[starts] = True
    at = np.flatnonzero(begin)
    size = np.diff(at, append=len(names))
    place = np.arange(len(names)) - np.repeat(at, size)
    place &= len(_ODD) - 1
    sums = np.add.reduceat(names * _ODD[place], at)
    return mixed(sums + size.astype(np.uint64) * _ODD[3]), np.searchsorted(at, first)


def names_of(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, names, first) of each level of the texts' parse, up to the highest in LEVELS."""
    size = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    names = chars.astype(np.uint64) + np.uint64(1)
    for level in range(1, max(LEVELS) + 1):
        names, first = phrases(names, first)
        yield level, names, first


def sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(values, first): each text's at most SKETCH smallest distinct 32-bit values of its phrase names, ascending."""
    keys = []
    for level, names, first in names_of(texts):
        if level in LEVELS:
            text = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(first))
            keys.append(text << np.uint64(32) | (mixed(names + np.uint64(level)) >> np.uint64(32)))
    return _lowest(np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64), len(texts))


def _lowest(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted distinct keys (group, value): the SKETCH lowest values of each group."""
    first = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    place = np.arange(len(keys)) - np.repeat(first[:-1], np.diff(first))
    kept = place < SKETCH
    return (keys[kept] & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.concatenate([[0], np.cumsum(np.minimum(np.diff(first), SKETCH))])


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Estimated resemblance of pairs of sketches: of the lowest values of both together, the share that both have. Two empty ones: 1; one: 0."""
    n = len(a)
    pair = lambda x: np.repeat(np.arange(n, dtype=np.uint64), [len(v) for v in x]) << np.uint64(32)
    flat = lambda x: np.concatenate(x).astype(np.uint64) if n else np.zeros(0, np.uint64)
    keys, count = np.unique(np.concatenate([pair(a) | flat(a), pair(b) | flat(b)]), return_counts=True)
    first = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    place = np.arange(len(keys)) - np.repeat(first[:-1], np.diff(first))
    used = place < SKETCH
    group = (keys >> np.uint64(32)).astype(np.int64)
    total = np.bincount(group[used], minlength=n)
    both = np.bincount(group[used & (count == 2)], minlength=n)
    return np.where(total > 0, both / np.maximum(total, 1), 1.0)


def hexed(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order_with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, key, text, last): rows dealt by ranges of the key, sorted; each range ends with a copy (last) of the next range's first row, the last range with the first row of all.

    The texts are moved once. The ranges' bounds are approximate quantiles, one range a task; only a row a range is moved twice.
    """
    from pyspark.ml.feature import Bucketizer

    n = tasks(docs.sparkSession)
    order = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    rows = docs.select(order.alias("k"), F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text)).withColumn("kd", F.col("k").cast("double"))
    found = docs.select(order.cast("double").alias("kd")).approxQuantile("kd", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    splits = [-float("inf"), *(sorted(set(found)) or [0.0]), float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="kd", outputCol="b").transform(rows).withColumn("b", F.col("b").cast("int"))
    least = dealt.groupBy("b").agg(F.min("k").alias("k")).orderBy("b").collect()  # a row a range
    if not least:
        return rows.select("k", key, text, F.lit(False).alias("last"), F.lit(0).alias("b"))
    # The first row of each range goes to the range before it too.
    to = docs.sparkSession.createDataFrame([(r["k"], least[i - 1]["b"]) for i, r in enumerate(least)], "k long, before int")
    heads = dealt.join(F.broadcast(to), "k").groupBy("before").agg(F.min(F.struct("k", text)).alias("h"), F.first(key).alias(key))
    ends = heads.select(F.col("h.k").alias("k"), F.col(key), F.col(f"h.{text}").alias(text), F.lit(True).alias("last"), F.col("before").alias("b"))
    every = dealt.select("k", key, text, F.lit(False).alias("last"), "b").unionByName(ends)
    return every.repartitionById(len(splits) - 1, F.col("b")).sortWithinPartitions("b", "last", "k", text)


def fingerprint_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The next document is that with the next larger key, after the last the first; rows with equal keys follow by
    text, null keys come first, and a single row is its own next. Null texts count as empty: their fingerprint is
    an empty string. Repeated rows stay.
    """
    ordered = in_order_with_next(docs, key, text)

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row before: key, text, sketch, fingerprint, range
        for batch in released(batches):
            for a, b in runs(batch[text], CHARS):
                part = batch.iloc[a:b]
                texts = part[text].tolist()
                values, first = sketches(texts)
                own = [values[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                # Copies with which ranges end have no next row themselves.
                rows = list(zip(part[key], texts, own, part["last"], part["b"], strict=True))
                line = ([held] if held else []) + rows
                pairs = [(x, y) for x, y in zip(line[:-1], line[1:], strict=True) if not x[3] and x[4] == y[4]]
                held = line[-1]
                if pairs:
                    yield joined(pairs)

    def joined(pairs: list) -> pd.DataFrame:
        news = [edited(x[1], y[1]) for x, y in pairs]
        values, first = sketches(news)
        changed = [values[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        mine = [x[2] for x, _ in pairs]
        return pd.DataFrame(
            {
                key: pd.Series([x[0] for x, _ in pairs], dtype=object), "n_chars": [len(x[1]) for x, _ in pairs], "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in news],
                "fingerprint": [hexed(s) for s in mine], "edited_fingerprint": [hexed(s) for s in changed], "near_edited": likeness(mine, changed), "near_next": likeness(mine, [y[2] for _, y in pairs]),
            }
        )

    kind = docs.schema[key].dataType.simpleString()
    return ordered.select(key, text, "last", "b").mapInPandas(work, f"{key} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
