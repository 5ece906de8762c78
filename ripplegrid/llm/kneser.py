"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Units are words, marks and single ideographs; a unit outside the vocabulary is one of those left out, each as likely.
Trigrams of the trusted documents are counted in shards by their middle word, where a trigram's context, its lower
order and that one's context all meet, so the smoothed probabilities are made shard by shard. They are kept as what
each n-gram adds to the log-probability of the next lower order; a document's log-probability is then a sum over its
n-grams, in any order. The most frequent n-grams go to every task, a bloom filter tells which others the model can't
have, and the rest of each document's n-grams, counted once per document, are joined with the shards of the model, for
one part of the documents after the other, as these n-grams take more disk than all else.
A document is kept if its perplexity is at most its language's quantile among trusted documents that weren't counted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import erased, released, runs, settled, shared_folder, trimmed, without
from .wordscan import BLANKS, Words, mixed

#: Units of the vocabulary, at most: numbers have 16 bits. They occur at least twice; PAD stands before a text, END after it.
VOCABULARY, PAD, END, UNKNOWN, FIRST = 60_000, 0, 1, 2, 3
#: Trigrams found less often are left out of the model, and their share goes to the lower order.
LEAST_TRIGRAM = 2
#: A document is kept up to this quantile of its language's trusted documents.
QUANTILE = 0.99
#: Shards of the model for each TOKENS of trusted text; n-grams that every task gets (12 bytes each); bits of the bloom filter and of each n-gram in it.
SHARDS, TOKENS, HEAD, BLOOM_BITS, BLOOM_HASHES = 64, 1 << 28, 300_000, 1 << 26, 4
#: Documents that are scored together, and those that one task joins with a shard of the model.
BLOCK, DOCUMENTS = 1024, 500_000
#: Parts of the documents that are joined one after the other: their n-grams are on disk a part at a time, and texts are read once a part.
PARTS = 2
#: N-grams that a task counts before it hands them on.
FLUSH = 1 << 21
#: Languages up to which they are broadcast; ids of one broadcast, and the most broadcasts that ids are dealt to.
BROADCAST_LANGS, BROADCAST_IDS, BROADCASTS = 10_000, 1_000_000, 8
#: How often an n-gram is used matters up to this: only the head is chosen by it.
MOST = np.iinfo(np.int32).max
_PAIR, _CONTEXT, _TRIPLE = (np.int64(k) << np.int64(50) for k in (1, 2, 3))
_KEY = (np.int64(1) << np.int64(52)) - np.int64(1)

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True
_MARK = np.array([33 <= b < 128 and not chr(b).isalnum() for b in range(256)])
#: Leading bytes of ideographs and kana (from U+3000 up), and of characters beyond the basic plane.
_IDEOGRAPH = np.array([0xE3 <= b <= 0xE9 or b >= 0xF0 for b in range(256)])


def units_of(texts: list[str]) -> Words:
    """Words of the texts, case kept: a mark is one by itself, and so is an ideograph."""
    words = Words(texts, ~_BLANK, lower=False)
    data = words.bytes
    inside = ~_BLANK[data]
    alone = _MARK[data] | _IDEOGRAPH[data]
    # A unit begins after a blank, at each mark or ideograph, and after one (its trailing bytes aside).
    trailing = (data & 0xC0) == 0x80
    single = alone.copy()
    for _ in range(3):  # an ideograph has at most 4 bytes
        single[1:] |= single[:-1] & trailing[1:]
    begins = inside & ~(trailing & single)
    begins[1:] &= ~inside[:-1] | single[1:] | single[:-1]
    ends = np.zeros(len(data) + 1, bool)
    ends[1:-1] = inside[:-1] & (~inside[1:] | begins[1:])
    if len(data):
        ends[-1] = inside[-1]
    words.starts, words.ends = np.flatnonzero(begins), np.flatnonzero(ends)
    words.first = np.searchsorted(words.starts, words.text_starts)
    return words


def discounts(of_counts) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 1, 2 and above, from how many n-grams have counts 1 to 4; plain ones where those are missing."""
    n1, n2, n3, n4 = (float(x) for x in of_counts)
    if not n1 or not n2:
        return np.array([0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)])


def counted(counts: np.ndarray) -> np.ndarray:
    """How many are 1, 2, 3 and 4."""
    return np.bincount(np.clip(counts, 0, 5), minlength=6)[1:5]


def off(counts: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return cut[np.minimum(counts, 3) - 1]


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, first place of each, number of each key) of sorted keys."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], first, np.repeat(np.arange(len(first)), np.diff(first, append=len(keys)))


def planes(values: np.ndarray) -> bytes:
    """Numbers as one run of bytes for each of their bytes, lowest first: what compresses well, if they are small."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def steps(keys: np.ndarray) -> bytes:
    """Sorted keys, by their differences."""
    return planes(np.diff(keys, prepend=0))


def from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.int64))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) % shards


class Numbering:
    """Numbers of the vocabulary's words, by sorted hashes; spared: log10 of one of the units left out; shards: of the model of all its text."""

    def __init__(self, hashes: np.ndarray, left_out: int, tokens: int = 0):
        self.hashes, self.spared = np.sort(hashes), -np.log10(left_out + 1)
        self.shards = SHARDS * max(1, -(-tokens // TOKENS))

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(line, first): the numbers of all units of the texts, with two PADs before and END after each; first[i]: where text i's PADs begin."""
        words = units_of(texts)
        names, counts = words.hashes(), words.counts()
        number = np.full(len(names), UNKNOWN, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, names), len(self.hashes) - 1)
            number = np.where(self.hashes[at] == names, at + FIRST, UNKNOWN)
        first = np.concatenate([[0], np.cumsum(counts + 3)])
        line = np.full(int(first[-1]), PAD, np.int64)
        line[first[1:] - 1] = END
        line[np.arange(len(number)) + np.repeat(first[:-1] + 2 - words.first[:-1], counts)] = number
        return line, first


def triples(line: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ends): the trigrams that end at each unit but PADs, and where they end."""
    real = np.ones(len(line), bool)
    real[first[:-1]] = real[first[:-1] + 1] = False
    ends = np.flatnonzero(real)
    return line[ends - 2] << 32 | line[ends - 1] << 16 | line[ends], ends


def numbering(texts: DataFrame, text: str) -> Numbering:
    """The most frequent words with two occurrences; the driver gets at most VOCABULARY of them and a histogram of the counts."""

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, size = [], 0
        for batch in released(batches):
            for a, b in runs(batch[text]):
                kept.append(np.unique(units_of(batch[text].iloc[a:b].tolist()).hashes(), return_counts=True))
                size += len(kept[-1][0])
                if size > FLUSH:
                    yield summed(kept)
                    kept, size = [], 0
        if kept:
            yield summed(kept)

    def summed(kept):
        h, back = np.unique(np.concatenate([x for x, _ in kept]), return_inverse=True)
        return pd.DataFrame({"h": h.view(np.int64), "c": np.bincount(back, np.concatenate([c for _, c in kept])).astype(np.int64)})

    counts = settled(texts.select(text).mapInPandas(work, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    step = F.floor(F.log2("c") * 4).cast("int")
    found = counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect()
    steps, tokens = {r["s"]: r["n"] for r in found}, sum(r["c"] for r in found)
    total, least = 0, 4  # of 2 or more
    for s in sorted(steps, reverse=True):
        total += steps[s]
        if total > VOCABULARY:
            least = max(least, s + 1)
            break
    found = counts.filter(step >= least).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    erased(counts)
    trimmed()
    return Numbering(found, sum(steps.values()) - len(found), tokens)


def count_triples(texts: DataFrame, numbers: Numbering, text: str) -> DataFrame:
    """(shard, keys, counts, of_triples, of_pairs, follows): the trigrams of each shard, sorted; how many trigrams and bigram types have counts 1 to 4; and in after how many words each word is found."""
    shared, shards = texts.sparkSession.sparkContext.broadcast(numbers), numbers.shards

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in released(batches):
            for a, b in runs(batch[text]):
                held.append(np.unique(triples(*shared.value.lines(batch[text].iloc[a:b].tolist()))[0], return_counts=True))
                size += len(held[-1][0])
                if size > FLUSH:
                    yield sharded(held)
                    held, size = [], 0
        if held:
            yield sharded(held)

    def added(parts):
        keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)

    def sharded(parts):
        keys, counts = added(parts)
        shard = shard_of(keys >> 16 & 0xFFFF, shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = [(s, steps(keys[use]), planes(counts[use])) for s in range(shards) if len(use := order[cuts[s] : cuts[s + 1]])]
        return pd.DataFrame(rows, columns=["shard", "keys", "counts"])

    def merge(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A shard's parts come in a row; they are added up whenever there is as much again, so that not all of them are held."""
        here, held, size, limit = None, [], 0, FLUSH
        for batch in batches:
            for s, k, c in zip(batch["shard"], batch["keys"], batch["counts"], strict=True):
                if s != here and held:
                    yield merged(here, held)
                    held, size, limit = [], 0, FLUSH
                    trimmed()
                here = s
                held.append((from_steps(k), from_planes(c, np.int64)))
                size += len(held[-1][0])
                if size > limit:
                    held = [added(held)]
                    size = len(held[0][0])
                    limit = max(FLUSH, 2 * size)
        if held:
            yield merged(here, held)
        del held
        trimmed()

    def merged(s, parts):
        keys, counts = added(parts)
        pairs, many = np.unique(keys & 0xFFFFFFFF, return_counts=True)
        follows = np.bincount(pairs & 0xFFFF, minlength=VOCABULARY + FIRST).astype(np.int32)
        return pd.DataFrame({"shard": [s], "keys": [steps(keys)], "counts": [planes(counts)], "of_triples": [counted(counts)], "of_pairs": [counted(many)], "follows": [follows.tobytes()]})

    parts = texts.select(text).mapInPandas(work, "shard int, keys binary, counts binary")
    dealt = parts.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
    return settled(dealt.mapInPandas(merge, "shard int, keys binary, counts binary, of_triples array<long>, of_pairs array<long>, follows binary"))


@dataclass
class Base:
    """Lowest orders, for every task: log10 p(word), and log10 of what each word as context leaves to it (0 for one that isn't); three and two are the higher orders' discounts."""

    word: np.ndarray
    spared: np.ndarray
    three: np.ndarray
    two: np.ndarray


def totals(group: pd.DataFrame) -> pd.DataFrame:
    follows = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in group["follows"])
    return pd.DataFrame({**{c: [np.sum(np.stack(group[c].to_numpy()), 0)] for c in ("of_triples", "of_pairs")}, "follows": [follows.astype(np.int32).tobytes()]})


def lowest(rows: list, vocabulary: int) -> Base:
    """From what count_triples tells besides the trigrams."""
    follows = sum((np.frombuffer(r["follows"], np.int32).astype(np.int64) for r in rows), np.zeros(VOCABULARY + FIRST, np.int64))
    cut = [discounts(sum((np.array(r[c]) for r in rows), np.zeros(4))) for c in ("of_triples", "of_pairs")]
    own = discounts(counted(follows))
    total, seen = follows.sum(), follows > 0
    less = np.where(seen, off(np.maximum(follows, 1), own), 0.0)
    p = (follows - less + less.sum() / (vocabulary + FIRST - 1)) / total if total else np.full(len(follows), 1 / (vocabulary + FIRST - 1))
    return Base(np.log10(p), np.zeros(len(follows)), *cut)


def smoothed(keys: np.ndarray, counts: np.ndarray, base: Base) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, values, counts, contexts, spared) of a shard: what each bigram, each trigram context and each trigram adds to a document's log10 probability; and of each word as context, log10 of what it leaves to the lowest order."""
    # Bigram types and their contexts; a type's count is the number of words before it.
    by_pair = np.argsort(keys & 0xFFFFFFFF, kind="stable")
    pairs, begin, of = grouped((keys & 0xFFFFFFFF)[by_pair])
    many = np.diff(begin, append=len(keys))
    uses = np.add.reduceat(counts[by_pair], begin) if len(begin) else many
    pair_of = np.empty(len(keys), np.int64)
    pair_of[by_pair] = of
    contexts, begin, of = grouped(pairs >> 16)
    less, total = off(many, base.two), np.add.reduceat(many, begin)
    spared = np.add.reduceat(less, begin) / total
    low = 10 ** base.word[pairs & 0xFFFF]
    p2 = (many - less) / total[of] + spared[of] * low
    # Trigrams; what the rare ones had goes to the lower order too.
    before, begin, of3 = grouped(keys >> 16)
    all3, kept = np.add.reduceat(counts, begin), counts >= LEAST_TRIGRAM
    own = np.where(kept, (counts - off(counts, base.three)) / all3[of3], 0.0)
    rest = 1 - np.add.reduceat(own, begin)
    p3 = own + rest[of3] * p2[pair_of]
    some = np.add.reduceat(kept, begin) > 0
    out = [
        (_PAIR | pairs, np.log10(p2) - np.log10(spared[of] * low), uses),
        (_CONTEXT | before[some], np.log10(rest[some]), all3[some]),
        (_TRIPLE | keys[kept], (np.log10(p3) - np.log10(rest[of3] * p2[pair_of]))[kept], counts[kept]),
    ]
    return *(np.concatenate(x) for x in zip(*out, strict=True)), contexts, np.log10(spared)


def bloom_places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    h = mixed(keys.astype(np.uint64) + np.uint64(0x51_7C_C1_B7))
    step = (h >> np.uint64(33)) | np.uint64(1)
    for _ in range(BLOOM_HASHES):
        yield (h % np.uint64(bits)).astype(np.int64)
        h = h + step * np.uint64(0x9E3779B97F4A7C15)


@dataclass
class KneserNey:
    """numbers, base; head: sorted keys and values of frequent n-grams; bloom: a row of bits a shard for all others, which are in the table values (shard, keys, vals)."""

    numbers: Numbering
    base: Base
    head: np.ndarray
    head_values: np.ndarray
    bloom: np.ndarray
    values: DataFrame | None
    sent: Broadcast | None = None

    @staticmethod
    def trained(texts: DataFrame, text: str = "text") -> KneserNey:
        """The driver gets the vocabulary, the lowest order, the head and the bloom filter, all of bounded size."""
        spark = texts.sparkSession
        numbers = numbering(texts, text)
        grams = count_triples(texts, numbers, text)
        parts = grams.select(F.pmod("shard", F.lit(4)).alias("part"), "of_triples", "of_pairs", "follows").groupBy("part").applyInPandas(totals, "of_triples array<long>, of_pairs array<long>, follows binary")
        base = lowest(parts.collect(), len(numbers.hashes))
        shared = spark.sparkContext.broadcast(base)
        shards = numbers.shards
        quota, bits = HEAD // shards, BLOOM_BITS // shards // 8 * 8

        def smooth(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for k, c in zip(batch["keys"], batch["counts"], strict=True):
                    keys, values, uses, contexts, spared = smoothed(from_steps(k), from_planes(c, np.int64), shared.value)
                    shard = shard_of(keys, shards)
                    order = np.lexsort((keys, shard))
                    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                    rows = []
                    for s in range(shards):
                        use = order[cuts[s] : cuts[s + 1]]
                        rows.append((s, steps(keys[use]), planes(values[use].astype(np.float32)), planes(np.minimum(uses[use], MOST).astype(np.int32)), None, None))
                    rows.append((-1, None, None, None, contexts.tobytes(), spared.tobytes()))
                    del keys, values, uses, shard, order, use
                    yield pd.DataFrame(rows, columns=["shard", "keys", "vals", "uses", "contexts", "spared"])
                    del rows
                    trimmed()

        def placed(group: pd.DataFrame) -> pd.DataFrame:
            if group["shard"].iloc[0] < 0:
                return group[["shard", "keys", "vals", "contexts", "spared"]].assign(head=None, head_vals=None, bloom=None)
            keys = np.concatenate([from_steps(k) for k in group["keys"]])
            vals, uses = (np.concatenate([from_planes(x, kind) for x in group[c]]) for c, kind in (("vals", np.float32), ("uses", np.int32)))
            order = np.lexsort((keys, -uses))
            top, rest = np.sort(order[:quota]), np.sort(order[quota:])
            rest = rest[np.argsort(keys[rest])]
            seen = np.zeros(bits, bool)
            for at in bloom_places(keys[rest], bits):
                seen[at] = True
            return pd.DataFrame({"shard": group["shard"].iloc[:1], "keys": [steps(keys[rest])], "vals": [planes(vals[rest])], "contexts": None, "spared": None, "head": [keys[top].tobytes()], "head_vals": [vals[top].tobytes()], "bloom": [np.packbits(seen).tobytes()]})

        parts = grams.select("keys", "counts").mapInPandas(smooth, "shard int, keys binary, vals binary, uses binary, contexts binary, spared binary")
        model = settled(parts.groupBy("shard").applyInPandas(placed, "shard int, keys binary, vals binary, contexts binary, spared binary, head binary, head_vals binary, bloom binary"))
        head, head_values, bloom = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)], np.zeros((shards, bits // 8), np.uint8)
        for r in model.drop("keys", "vals").toLocalIterator():  # HEAD n-grams, BLOOM_BITS and the vocabulary's contexts
            if r["shard"] < 0:
                base.spared[np.frombuffer(r["contexts"], np.int64)] = np.frombuffer(r["spared"])
            else:
                head.append(np.frombuffer(r["head"], np.int64))
                head_values.append(np.frombuffer(r["head_vals"], np.float32))
                bloom[r["shard"]] = np.frombuffer(r["bloom"], np.uint8)
        head, head_values = np.concatenate(head), np.concatenate(head_values)
        order = np.argsort(head)
        erased(grams)
        shared.destroy()
        trimmed()
        return KneserNey(numbers, base, head[order], head_values[order], bloom, model.filter("shard >= 0").select("shard", "keys", "vals"))

    def shared(self, spark):
        """Its tables, sent once however often it is used."""
        if self.sent is None:
            self.sent = spark.sparkContext.broadcast((self.numbers, self.base, self.head, self.head_values, self.bloom))
        return self.sent

    def known(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(log10 p, units, asked, times): each text's sum as far as the head tells it, its units with its END, and the n-grams to be joined, text << 52 | n-gram, with how often the text has them."""
        line, first = self.numbers.lines(texts)
        keys, ends = triples(line, first)
        n, base = np.diff(first) - 2, self.base
        before, now = line[ends - 1], line[ends]
        logs = base.word[now] + base.spared[before] + np.where(now == UNKNOWN, self.numbers.spared, 0.0)
        text = np.repeat(np.arange(len(texts)), n)
        sums = np.bincount(text, logs, len(texts))
        grams, owner = np.concatenate([_PAIR | keys & 0xFFFFFFFF, _CONTEXT | keys >> 16, _TRIPLE | keys]), np.concatenate([text] * 3)
        if len(self.head):
            at = np.minimum(np.searchsorted(self.head, grams), len(self.head) - 1)
            hit = self.head[at] == grams
            sums += np.bincount(owner[hit], self.head_values[at[hit]], len(texts))
            grams, owner = grams[~hit], owner[~hit]
        shard, bits = shard_of(grams, len(self.bloom)), self.bloom.shape[1] * 8
        may = np.ones(len(grams), bool)
        for place in bloom_places(grams, bits):
            may &= (self.bloom[shard, place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1) > 0
        asked, times = np.unique(owner[may] << 52 | grams[may], return_counts=True)
        return sums, n, asked, times


def perplexities(model: KneserNey, docs: DataFrame, text: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """(carried, log10_perplexity, n_units) of every row, as a written() table; an empty or null text has its END as only unit. carried: SQL expressions with names.

    The rows are dealt to PARTS by a hash of text and carried, so docs must have the same rows whenever it is read.
    """
    path = shared_folder(docs.sparkSession)
    part = F.pmod(F.xxhash64(F.lit("part"), F.col(f"`{text}`").cast("string"), *[F.expr(c) for c in carried]), F.lit(PARTS))
    subs = max(1, -(-docs.count() * SHARDS // (PARTS * DOCUMENTS * model.numbers.shards)))
    for i in range(PARTS):
        out = settled(looked_up(model, docs.filter(part == i), text, carried, subs), path, "append")
    return out


def looked_up(model: KneserNey, docs: DataFrame, text: str, carried: tuple[str, ...], subs: int) -> DataFrame:
    """What perplexities() returns, of one part; subs: how many tasks share a shard's documents.

    A document's n-grams beyond the head, once each with how often it has them, go to the model's shards; back come
    sums by document, a row a block of documents and shard. No text is moved.
    """
    spark = docs.sparkSession
    shape = docs.selectExpr(*carried).schema
    rows = docs.select(F.to_json(F.struct(*[F.expr(c) for c in carried], F.lit(0).alias("_")), {"ignoreNullFields": "false"}).alias("carried"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    shared, shards = model.shared(spark), model.numbers.shards

    def ask(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = KneserNey(*shared.value, None)
        turn = TaskContext.get().partitionId()
        block = turn << 32
        for batch in released(batches):
            for a, b in runs(batch["__text"]):
                for i in range(a, b, BLOCK):
                    part = batch.iloc[i : min(i + BLOCK, b)]
                    sums, n, asked, times = own.known(part["__text"].tolist())
                    yield pd.DataFrame({"block": block, "shard": turn % shards, "sub": turn % subs, "place": np.arange(len(part)), "logp": sums, "n": n, "carried": part["carried"].to_numpy()})
                    order = np.argsort(asked & _KEY)
                    asked, times = asked[order], times[order]
                    shard, packed = shard_of(asked & _KEY, shards), []
                    by_shard = np.argsort(shard, kind="stable")
                    cuts = np.searchsorted(shard[by_shard], np.arange(shards + 1))
                    for s in range(shards):
                        if len(u := by_shard[cuts[s] : cuts[s + 1]]):
                            packed.append((block, s, turn % subs, steps(asked[u] & _KEY), planes((asked[u] >> 52).astype(np.uint16)), planes(times[u].astype(np.int32))))
                    if packed:
                        yield pd.DataFrame(packed, columns=["block", "shard", "sub", "asked", "texts", "times"])
                    block, turn = block + 1, turn + 1

    columns = ["block", "shard", "sub", "place", "logp", "n", "carried", "asked", "texts", "times"]

    def framed(batches):
        for out in ask(batches):
            yield out.reindex(columns=columns).astype({"place": "Int32", "n": "Int64", "carried": object, "asked": object, "texts": object, "times": object})

    asked = rows.mapInPandas(framed, "block long, shard int, sub int, place int, logp double, n long, carried string, asked binary, texts binary, times binary")
    none = lambda f: F.lit(None).cast(f.dataType).alias(f.name)
    table = model.values.withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(subs - 1))))
    line = asked.select("*", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("vals"))
    table = table.select(*[F.col(f.name) if f.name in ("shard", "sub", "keys", "vals") else none(f) for f in line.schema])

    def answer(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, keys, vals = None, None, None
        for batch in batches:
            model_rows = batch["keys"].notna()
            yield batch.loc[batch["place"].notna(), given]
            out = []
            for r in batch[model_rows | batch["asked"].notna()].itertuples(index=False):
                if r.keys is not None:
                    here, keys, vals = (r.shard, r.sub), from_steps(r.keys), from_planes(r.vals, np.float32)
                elif here == (r.shard, r.sub) and len(keys):
                    wanted = from_steps(r.asked)
                    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    hit = keys[at] == wanted
                    sums = np.bincount(from_planes(r.texts, np.uint16)[hit], vals[at[hit]] * from_planes(r.times, np.int32)[hit])
                    if len(sums):
                        out.append((r.block, sums.tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["block", "more"]).reindex(columns=[*given, "more"])

    given = ["block", "place", "logp", "n", "carried"]

    def answered(batches):
        for out in answer(batches):
            yield out.reindex(columns=[*given, "more"]).astype({"place": "Int32", "n": "Int64", "carried": object, "more": object})

    dealt = line.unionByName(table).repartitionById(shards * subs, F.col("shard") * subs + F.col("sub")).sortWithinPartitions("shard", "sub", F.col("block").asc_nulls_first())
    found = dealt.mapInPandas(answered, "block long, place int, logp double, n long, carried string, more binary")

    def added(group: pd.DataFrame) -> pd.DataFrame:
        docs_of = group[group["place"].notna()]
        total = np.zeros(int(docs_of["place"].max()) + 1)
        for more in group["more"].dropna():
            sums = np.frombuffer(more)
            total[: len(sums)] += sums
        logs = docs_of["logp"].to_numpy(float) + total[docs_of["place"].to_numpy(int)]
        return docs_of[["carried"]].assign(log10_perplexity=-logs / docs_of["n"].to_numpy(float), n_units=docs_of["n"].to_numpy(np.int64))

    # A block's group holds at most BLOCK documents and a row a shard.
    out = found.groupBy("block").applyInPandas(added, "carried string, log10_perplexity double, n_units long")
    given_back = F.from_json("carried", shape).alias("c")
    return out.select(given_back, "log10_perplexity", "n_units").select(*[f"c.`{c}`" for c in shape.names], "log10_perplexity", "n_units")


def having(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of docs whose key is in ids (key), distinct ones. Up to BROADCASTS times BROADCAST_IDS ids go to every task in as many parts as that takes, and no text is shuffled; beyond that, rows are matched by shuffle."""
    parts = max(1, -(-ids.count() // BROADCAST_IDS))
    if parts == 1 or parts > BROADCASTS:
        return docs.join(F.broadcast(ids) if parts == 1 else ids, key, "left_semi")
    names = [f"c{i}" for i in range(len(docs.columns))]
    found, own = docs.toDF(*names), names[docs.columns.index(key)]
    for i in range(parts):
        part = ids.filter(F.pmod(F.xxhash64(F.lit("part"), F.col(key)), F.lit(parts)) == i).select(F.col(key).alias(f"k{i}"))
        found = found.join(F.broadcast(part), F.col(own) == F.col(f"k{i}"), "left")
    return found.filter(F.coalesce(*[F.col(f"k{i}") for i in range(parts)]).isNotNull()).select(*names).toDF(*docs.columns)


def trusted_ids(labels: DataFrame, key: str = "doc_id", *, fold: bool = False) -> DataFrame:
    """Ids labelled as good; with fold only those whose crc32 as text, modulo 3, is not 1, so that the others can be evaluated."""
    good = labels.filter("quality = 1").select(F.col(key)).dropna().distinct()
    return good.filter(F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1) if fold else good


@dataclass
class QualityClassifier:
    """A model (none, if there was nothing to learn from), the ids (key) of trusted documents that weren't counted, and their quantile that thresholds are."""

    model: KneserNey | None
    rest: DataFrame
    quantile: float

    @staticmethod
    def trained(docs: DataFrame, labels: DataFrame, *, quantile: float = QUANTILE, rows: int | None = None, fold: bool = False, key: str = "doc_id", text: str = "text") -> QualityClassifier:
        """All trusted documents are used: a fifth, by a hash of their ids, for the thresholds, as the counts would flatter a document of their own; n-grams are counted in all others. With `rows` these are at most so many, and what is left goes to the thresholds."""
        good = settled(trusted_ids(labels, key, fold=fold))
        chosen = good.filter(F.pmod(F.xxhash64(F.lit("split"), F.col(key)), F.lit(5)) != 0)
        if rows is not None:
            chosen = chosen.orderBy(F.xxhash64(F.lit("trusted"), F.col(key)), key).limit(rows)
        texts = having(docs.filter(F.col(text).isNotNull()).select(key, text), chosen, key).select(text)
        model = None if texts.isEmpty() else KneserNey.trained(texts, text)
        return QualityClassifier(model, good.join(chosen, key, "left_anti"), quantile)

    def limits(self, scored: DataFrame, lang: str) -> dict[str | None, float]:
        """Each language's threshold, and None's, that of all: the quantile of the scored trusted documents; infinite without any."""
        found = scored.rollup(lang).agg(F.percentile_approx("log10_perplexity", self.quantile, 100_000).alias("q"), F.grouping_id().alias("g"))
        found = found.filter(f"q IS NOT NULL AND (g = 1 OR `{lang}` IS NOT NULL)").collect()  # a row a language
        return {None: float("inf")} | {None if r["g"] else r[lang]: r["q"] for r in found}


def limited(scored: DataFrame, lang: str, limits: dict[str | None, float]) -> DataFrame:
    """scored with columns threshold and kept; a language without trusted documents, or null, has the threshold of all."""
    own = scored.sparkSession.createDataFrame([(k, float(v)) for k, v in limits.items() if k is not None], "__lang string, __own double")
    joined = scored.join(F.broadcast(own) if len(limits) <= BROADCAST_LANGS else own, F.col(lang) == F.col("__lang"), "left")
    out = joined.withColumn("threshold", F.coalesce("__own", F.lit(limits[None]))).drop("__lang", "__own")
    return out.withColumn("kept", F.col("log10_perplexity") <= F.col("threshold"))


def classify_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE, rows: int | None = None) -> DataFrame:
    """(key, lang, n_units, log10_perplexity, threshold, kept) of every document; a perplexity that equals its threshold is kept.

    Null texts count as empty, repeated rows and null keys stay. Without any trusted document all are kept, with a
    null perplexity.
    """
    found = QualityClassifier.trained(docs, labels, quantile=quantile, rows=rows, key=key, text=text)
    if found.model is None:
        return docs.select(key, F.col(lang).cast("string").alias(lang), F.lit(None).cast("long").alias("n_units"), F.lit(None).cast("double").alias("log10_perplexity"), F.lit(float("inf")).alias("threshold"), F.lit(True).alias("kept"))
    scored = perplexities(found.model, docs, text, (f"`{key}` AS k", f"cast(`{lang}` AS string) AS lang"))
    limits = found.limits(scored.join(found.rest.select(F.col(key).alias("k")), "k", "left_semi"), "lang")
    return limited(scored, "lang", limits).select(F.col("k").alias(key), F.col("lang").alias(lang), "n_units", "log10_perplexity", "threshold", "kept")


def keep_good(docs: DataFrame, labelled: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """The rows of docs that the classifier trained on labelled documents keeps, with docs' columns; no names are reserved.

    Null and empty texts are their END alone, rows with a null id or language are judged as all others are, and
    repeated rows share their fate. Without any trusted document all rows stay. Of labelled, only trusted documents are
    read: those counted, and those that make the thresholds.
    """
    found = QualityClassifier.trained(labelled, labels, quantile=quantile, key=key, text=text)
    if found.model is None:
        return docs
    rest = perplexities(found.model, having(labelled, found.rest, key), text, (f"cast(`{lang}` AS string) AS lang",))
    limits = found.limits(rest, "lang")
    tag = F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.col(f"`{lang}`").cast("string"))
    tagged = f"xxhash64(coalesce(cast(`{text}` AS string), ''), cast(`{lang}` AS string)) AS t"
    scored = perplexities(found.model, docs, text, (f"`{key}` AS k", f"cast(`{lang}` AS string) AS lang", tagged))
    kept = without(docs, limited(scored, "lang", limits).filter("NOT kept"), key, tag)
    erased(rest, scored)
    return kept
