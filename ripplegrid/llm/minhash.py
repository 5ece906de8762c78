"""Near-duplicate classes by min-max hashing of word shingles.

Of each of HASHES permutations the minimum and the maximum over a document's shingles are kept, which gives
twice as many signature values as hash evaluations. Bands of ROWS values put alike documents into equal
buckets: two documents with a resemblance of 0.8 meet in none with a probability below 1e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import erased, released, runs, text_hash, without, written
from .wordscan import Words, mixed

#: Words of a shingle, permutations, values of a band.
SHINGLE, HASHES, ROWS = 5, 120, 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Pairs whose signatures agree in a smaller share than this aren't confirmed: 6.5 standard errors below 0.8.
LEAST_ESTIMATE = 0.62
_FACTORS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PLACES = mixed(np.arange(101, 121, dtype=np.uint64)) | np.uint64(1)
CHARS = 1 << 19


def shingle_sets(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(values, first): the distinct shingle hashes of each text, ascending. Fewer words than size make one shingle; no word, none."""
    words = Words(texts)
    names, first = words.hashes(), words.first
    counts = np.diff(first)
    line = np.zeros(len(names), np.uint64)
    padded = np.concatenate([names, np.zeros(size, np.uint64)])
    for k in range(size):
        line += padded[k : k + len(names)] * _PLACES[k]
    line = mixed(line)
    text = words.of_text()
    inside = np.arange(len(names)) - np.repeat(first[:-1], counts)
    keep = inside <= (counts - size)[text]
    for i in np.flatnonzero((counts > 0) & (counts < size)).tolist():  # a whole sequence as one
        own = names[first[i] : first[i + 1]]
        line[first[i]] = mixed(np.array([(own * _PLACES[10 : 10 + len(own)]).sum() + np.uint64(len(own))], np.uint64))[0]
        keep[first[i]] = True
    line, text = line[keep], text[keep]
    order = np.lexsort((line, text))
    line, text = line[order], text[order]
    fresh = np.ones(len(line), bool)
    fresh[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
    line, text = line[fresh], text[fresh]
    return line, np.searchsorted(text, np.arange(len(texts) + 1))


def signatures(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sig) : the sets that aren't empty, and (rows, 2 * HASHES) minima and maxima of their values under each permutation."""
    full = np.flatnonzero(np.diff(first))
    cuts = first[full]
    sig = np.empty((2 * HASHES, len(full)), np.uint64)
    if len(full):
        for i, factor in enumerate(_FACTORS):
            h = values * factor
            np.minimum.reduceat(h, cuts, out=sig[i])
            np.maximum.reduceat(h, cuts, out=sig[HASHES + i])
    return full, sig.T


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, bands) keys of the bands: of ROWS minima, or of ROWS maxima, of permutations that differ; the band's number is part of its key."""
    bands = sig.reshape(len(sig), -1, ROWS)
    key = np.repeat(np.arange(bands.shape[1], dtype=np.uint64)[None], len(sig), 0)
    for k in range(ROWS):
        key = mixed(key * np.uint64(31) + bands[:, :, k])
    return key.view(np.int64)


#: Members of a bucket up to which its pairs are listed; larger ones are compared set by set in blocks.
SMALL = 32
#: Shingles of a block of a large bucket, on average.
BLOCK = 500_000
#: Pairs of one leader that a task confirms in a row.
SALTED = 512
#: Ids up to which a semi-join is broadcast (16 MB).
BROADCAST_IDS = 2_000_000


def described(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, t, h, n, sig, bands) of each row with an id: t hashes the text, h names the set (null if empty), sig has a byte of each signature value."""

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in released(batches):
            for a, b in runs(batch["text"], CHARS):
                values, first = shingle_sets(batch["text"].iloc[a:b].tolist(), size)
                full, sig = signatures(values, first)
                keys, small = band_keys(sig), np.ascontiguousarray(sig.astype(np.uint8))
                out = pd.DataFrame({"id": batch["id"].iloc[a:b].to_numpy(), "t": batch["t"].iloc[a:b].to_numpy(), "h": None, "n": np.diff(first), "sig": None, "bands": None}, dtype=object)
                for i, row in enumerate(full.tolist()):
                    out.iat[row, 2] = hashlib.md5(values[first[row] : first[row + 1]].tobytes()).digest()
                    out.iat[row, 4] = small[i].tobytes()
                    out.iat[row, 5] = keys[i]
                yield out

    rows = with_hash(docs, key, text)
    return rows.mapInPandas(work, f"id {rows.schema['id'].dataType.simpleString()}, t long, h binary, n long, sig binary, bands array<long>")


def with_hash(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text, t) of rows with an id; a null text counts as empty."""
    return docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), text_hash(text).alias("t"))


def member_sets(docs: DataFrame, members: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(h, set) of the members (h, rep): the sorted shingle hashes of each set, from the representative's whole text."""
    some = members.select("h", "rep").distinct()
    ids = some.select(F.col("rep").alias("id")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in released(batches):
            for a, b in runs(batch["text"], CHARS):
                values, first = shingle_sets(batch["text"].iloc[a:b].tolist(), size)
                sets = [values[i:j].tobytes() for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pd.DataFrame({"h": [hashlib.md5(s).digest() for s in sets], "set": sets})

    found = with_hash(docs, key, text).join(ids, "id", "left_semi").select("text").mapInPandas(work, "h binary, set binary")
    return found.join(some.select("h"), "h", "left_semi").dropDuplicates(["h"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose full sets have 100 * intersection >= PERCENT * union.

    b, the leader, may be in very many pairs: they are dealt to parts of about SALTED, each of which gets the leader's
    set once and then reads its partners' sets one batch after the other.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / F.lit(SALTED)).alias("parts"))
    one = sets.select(F.col("h").alias("__h"), "set")
    salted = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")))
    partners = salted.join(one, F.col("a") == F.col("__h")).select("b", "part", "a", "set")
    leaders = salted.select("b", "part").distinct().join(one, F.col("b") == F.col("__h")).select("b", "part", F.lit(None).cast("binary").alias("a"), "set")

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, leader = None, None
        for batch in released(batches):
            good = []
            for a, b, part, packed in zip(batch["a"], batch["b"], batch["part"], batch["set"], strict=True):
                own = np.frombuffer(packed, np.uint64)
                if a is None:
                    here, leader = (bytes(b), part), own
                    continue
                if here != (bytes(b), part):
                    raise ValueError("a leader's set is missing")
                both = len(np.intersect1d(own, leader, assume_unique=True))
                if 100 * both >= PERCENT * (len(own) + len(leader) - both):
                    good.append((a, b))
            yield pd.DataFrame(good, columns=["a", "b"])

    line = partners.unionByName(leaders).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return line.mapInPandas(work, "a binary, b binary")


def likely(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, sig_a, sig_b), those whose signatures agree in LEAST_ESTIMATE of their values."""

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in released(batches):
            for i in range(0, len(batch), 4096):
                part = batch.iloc[i : i + 4096]
                x, y = (np.frombuffer(b"".join(part[c]), np.uint8).reshape(len(part), -1) for c in ("sig_a", "sig_b"))
                yield part.loc[(x == y).mean(1) >= LEAST_ESTIMATE, ["a", "b"]]

    return pairs.mapInPandas(work, "a binary, b binary")


def sized(n: str, m: str):
    """Whether sets of n and m shingles can be alike enough."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def linked_in_blocks(big: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) links between components in large buckets (key, h, c, n): blocks of about BLOCK shingles are compared in pairs, each set of one component with the sets of the others. A pair of components is linked once in a pair of blocks."""
    weight = big.groupBy("key").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = big.join(weight, "key").withColumn("at", F.expr("int(pmod(xxhash64(h), blocks))"))
    # A pair of blocks i <= j gets the members of both.
    dealt = placed.withColumn("j", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"lo": F.least("at", "j"), "hi": F.greatest("at", "j")})

    def work(group: pd.DataFrame) -> pd.DataFrame:
        sets_of = [np.frombuffer(s, np.uint64) for s in group["set"]]
        size = np.array([len(s) for s in sets_of])
        names, code = np.unique(np.concatenate(sets_of), return_inverse=True)
        cuts = np.cumsum(size) - size
        comp = pd.factorize(group["c"])[0]
        rows = group["h"].tolist()
        largest = np.bincount(comp).argmax()
        mark, found = np.zeros(len(names), np.int32), {}
        # Pairs with the largest component are seen from the other side.
        for i in np.flatnonzero(comp != largest).tolist():
            own = code[cuts[i] : cuts[i] + size[i]]
            mark[own] = 1
            both = np.add.reduceat(mark[code], cuts)
            mark[own] = 0
            near = np.flatnonzero((100 * both >= PERCENT * (size + size[i] - both)) & (comp != comp[i]))
            for c, at in zip(*np.unique(comp[near], return_index=True), strict=True):
                found.setdefault((min(comp[i], c), max(comp[i], c)), (rows[i], rows[near[at]]))
        return pd.DataFrame(list(found.values()), columns=["a", "b"])

    return dealt.join(sets, "h").select("key", "lo", "hi", "h", "c", "set").groupBy("key", "lo", "hi").applyInPandas(work, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, label): every node of links (a, b) with the least node it reaches, by alternating stars; each round is written to the shared folder."""
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:
        # Large star: larger neighbours of each node are linked to the least of its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: each node and its smaller neighbours are linked to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        before, edges = edges, written(small)
        erased(before)
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if now == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
        last = now


def classified(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, t, h, n, c, least) of each row with an id: c names the component, least is its least id; both null for an empty set."""
    base = written(described(docs, key, text, size))
    classes = written(base.filter("h IS NOT NULL").groupBy("h").agg(F.min(F.struct("id", "n", "sig", "bands")).alias("r")).select("h", F.col("r.id").alias("rep"), "r.n", "r.sig", "r.bands"))
    rows = classes.select("h", "n", F.explode("bands").alias("key"))
    # A bucket's leader is its first by a hash, so that alike sets have few leaders in all their buckets.
    leaders = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("h").alias("o"), "h", "n")).alias("l"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = written(rows.join(leaders.select("key", F.col("l.h").alias("leader"), F.col("l.n").alias("leader_n"), "size"), "key"))
    sigs = classes.select("h", "sig")
    sets = written(member_sets(docs, members.select("h").distinct().join(classes.select("h", "rep"), "h"), key, text, size))

    def tested(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(sigs.select(F.col("h").alias("a"), F.col("sig").alias("sig_a")), "a")
        return likely(with_a.join(sigs.select(F.col("h").alias("b"), F.col("sig").alias("sig_b")), "b").select("a", "b", "sig_a", "sig_b"))

    stars = members.filter((F.col("h") != F.col("leader")) & sized("n", "leader_n")).select(F.col("h").alias("a"), F.col("leader").alias("b")).distinct()
    tried = written(tested(stars))
    links = written(confirmed(tried, sets))

    comp = components(links)
    labelled = members.join(comp, members["h"] == comp["node"], "left").select("key", "h", "n", "size", F.coalesce("label", "h").alias("c"))
    spread = labelled.groupBy("key").agg((F.min("c") != F.max("c")).alias("many")).filter("many").select("key")
    open_ = written(labelled.join(spread, "key", "left_semi"))
    few = open_.filter(F.col("size") <= SMALL)
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, F.col("x.key") == F.col("y.key")).filter((F.col("x.h") < F.col("y.h")) & (F.col("x.c") != F.col("y.c")) & sized("x.n", "y.n"))
    both = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pairs.select(F.col("x.h").alias("a"), F.col("y.h").alias("b")).distinct().join(both, ["a", "b"], "left_anti")
    more = confirmed(tested(pairs), sets).unionByName(linked_in_blocks(open_.filter(F.col("size") > SMALL), sets))
    again = components(links.unionByName(more))

    least = again.join(classes.select(F.col("h").alias("node"), "rep"), "node").groupBy("label").agg(F.min("rep").alias("least"))
    named = again.join(least, "label").select(F.col("node").alias("h"), "label", "least")
    of_class = written(classes.select("h", "rep").join(named, "h", "left").select("h", F.coalesce("label", "h").alias("c"), F.coalesce("least", "rep").alias("least")))
    erased(members, sets, tried, links, open_, classes)
    return base.select("id", "t", "h", "n").join(of_class, "h", "left")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every document with an id.

    A document's set holds its distinct shingles of `shingle` words; fewer words are one shingle, no words none, which
    is linked with nothing. Sets of 100 * intersection >= PERCENT * union are linked; component_id is the least id
    reachable. Equal sets are one class, and only classes are compared: each with the leader of each of its
    buckets first, then, where a bucket still spans components, with all of the other components in it. So links
    within a component need not be looked at, and none between two is missed that shares a bucket. Null texts are
    empty; rows of equal ids and texts get equal results; rows without an id are left out.
    """
    component = F.coalesce("least", "id")
    found = classified(docs, key, text, shingle)
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component, of the least id and then the least hash of its text.

    Rows are told apart by id and text, so texts that share an id but are linked to nothing stay; of rows that agree
    in both one stays, whichever it is. Texts without words and rows without an id are linked to nothing; of the former
    one stays of each id and text. Columns are docs'; no names are reserved. Only the keys of what goes are moved, while
    there are at most BROADCAST_ROWS of them.
    """
    found = written(classified(docs, key, text, shingle).select("id", "t", "c"))
    first = found.filter("c IS NOT NULL").groupBy("c").agg(F.min(F.struct("id", "t")).alias("f"))
    gone = found.join(first, "c").filter((F.col("id") != F.col("f.id")) | (F.col("t") != F.col("f.t"))).select(F.col("id").alias("k"), "t")
    left = without(docs, gone, key, text_hash(text))
    twice = written(found.groupBy("id", "t").count().filter("count > 1").select(F.col("id").alias("k"), "t"))
    if twice.isEmpty():
        return left
    # Rows that others repeat, apart from all others; of each kind one stays.
    rare = F.broadcast(twice) if twice.count() <= BROADCAST_IDS else twice
    repeated = left.join(rare, left[key].eqNullSafe(rare["k"]) & (text_hash(text) == rare["t"]), "left_semi")
    return without(left, twice, key, text_hash(text)).unionByName(_distinct(repeated, key, text))


def _distinct(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row of each key and text, with the columns as they are."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).select(*names, F.col(names[docs.columns.index(key)]).alias("k"), F.coalesce(F.col(names[docs.columns.index(text)]).cast("string"), F.lit("")).alias("t"))
    return plain.dropDuplicates(["k", "t"]).select(*names).toDF(*docs.columns)
