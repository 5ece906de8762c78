"""Language-model scores of a tree-factored log-bilinear model, trained with noise-contrastive estimation.

A word is reached by at most three choices. The root has the most frequent words, the end of a document and CLASSES
classes, to which other words fall by their last two bytes. Each class has its most frequent words and as many
subclasses, by first three bytes; each subclass has all its other words of the head with LEAST_COUNT training
occurrences, and what is left. So the words that the network tells apart grow with the training text, up to HEAD,
while a word costs about as many products as a choice has outcomes. The CONTEXT units before (words, or what is
left of a subclass) are embedded, weighted by position and summed to a prediction; its products with the vectors of
a choice's outcomes, in batched matrix products, are normalised over all of them. Embeddings and outcomes are
trained by NCE. A word in what is left of a subclass has its smoothed share of the counts there, and so is the base
score made. The counts are of all training text, joined by shuffle but for those of the head, which every task gets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, released, runs, written
from .wordscan import Words, mixed

#: Frequent words that are outcomes of the root; classes, subclasses of a class, and frequent words of a class.
OWN, CLASSES, BRANCH = 63, 64, 64
END, ROOT, LEAVES = OWN, OWN + 1 + CLASSES, CLASSES * BRANCH
CONTEXT, DIM, NOISE, INNER_NOISE, BATCH, RATE, SEED = 4, 8, 16, 1, 2048, 0.15, 7
#: Words found less often in the training text have no vectors of their own.
LEAST_COUNT = 40
#: Training documents are dealt to buckets of about so many tokens by a hash, at most MOST_BUCKETS; each bucket learns a share of its documents in each round, between which the buckets' networks are averaged.
BUCKET_TOKENS, MOST_BUCKETS, ROUNDS = 16_000_000, 4096, 2
#: Tokens that are put in a line to be learned from together, and those that are scored together.
LINE, SCORED = 1 << 17, 1 << 20
#: Weights in a row of those handed on, and networks added up in a task.
SLICE, ADDED = 1 << 16, 64
#: Most words whose counts are sent to every task, and that have vectors (under 200 bytes each).
HEAD = 100_000
#: Distinct words that a task counts before it hands them on.
FLUSH = 400_000


class Tree:
    """Of each unit (own words, the end, other words with vectors, what is left of each subclass) the root's outcome and its cells, at most two; a cell is an outcome of a class's or a subclass's choice. Cells stand in the order of their nodes."""

    def __init__(self, path: np.ndarray, node: np.ndarray, counts: np.ndarray):
        order = np.argsort(node, kind="stable")
        back = np.empty(len(order) + 1, np.int64)
        back[order], back[-1] = np.arange(len(order)), -1
        self.path = np.concatenate([path[:, :1], back[path[:, 1:]]], 1).astype(np.int32)
        self.node, counts = node[order].astype(np.int32), np.maximum(counts[order], 0) + 0.5
        nodes = int(node.max(initial=-1)) + 1
        self.start = np.searchsorted(self.node, np.arange(nodes + 1))
        self.cum = np.concatenate([[0.0], np.cumsum(counts)])
        # log of each cell's share of its node's counts
        self.share = np.log(counts / np.diff(self.cum[self.start])[self.node]).astype(np.float32)

    def drawn(self, cells: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """(cells, INNER_NOISE) cells drawn by count from each one's node."""
        nodes = self.node[cells]
        first, after = self.start[nodes], self.start[nodes + 1]
        low, high = self.cum[first], self.cum[after]
        at = np.searchsorted(self.cum, low[:, None] + rng.random((len(cells), INNER_NOISE)) * (high - low)[:, None], "right") - 1
        return np.clip(at, first[:, None], after[:, None] - 1)


@dataclass
class Vocabulary:
    """head: sorted hashes of frequent words, with their counts and units (-1: none); left: log10 of the smoothed size of what is left of each subclass; root_counts: of the root's outcomes."""

    head: np.ndarray
    head_counts: np.ndarray
    head_units: np.ndarray
    tree: Tree
    left: np.ndarray
    root_counts: np.ndarray
    tokens: int
    types: int

    @property
    def first_leaf(self) -> int:
        return len(self.tree.path) - LEAVES


def leaves_of(words: Words) -> np.ndarray:
    """The subclass of each word: a hash of its last two bytes and one of its first three."""
    byte = lambda at: words.bytes[at].astype(np.uint64)
    first, last = words.starts, words.ends - 1
    end = byte(last) << np.uint64(8) | byte(np.maximum(last - 1, first))
    start = byte(first) << np.uint64(16) | byte(np.minimum(first + 1, last)) << np.uint64(8) | byte(np.minimum(first + 2, last))
    place = lambda x, n: (mixed(x) >> np.uint64(20)).astype(np.int64) % n
    return (place(end, CLASSES) * BRANCH + place(start, BRANCH)).astype(np.int32)


def tokens_of(texts: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, places in the head or -1, units, words before each text) of all words; ends are not among them."""
    words = Words(texts)
    names = words.hashes()
    units = vocab.first_leaf + leaves_of(words)
    place = np.full(len(names), -1, np.int64)
    if len(vocab.head):
        at = np.minimum(np.searchsorted(vocab.head, names), len(vocab.head) - 1)
        hit = np.flatnonzero(vocab.head[at] == names)
        place[hit] = at[hit]
        own = vocab.head_units[at[hit]]
        units[hit] = np.where(own >= 0, own, units[hit])
    return names, place, units.astype(np.int32), words.first


def with_ends(units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, targets, ends): the texts' units with CONTEXT ends before and one after each; where the targets stand; and how many targets there are up to each text."""
    counts = np.diff(first)
    size = counts + CONTEXT + 1
    line = np.full(int(size.sum()), END, np.int32)
    begin = np.cumsum(size) - size
    at = np.arange(len(units)) + np.repeat(begin + CONTEXT - first[:-1], counts)
    line[at] = units
    real = np.ones(len(line), bool)
    for k in range(CONTEXT):
        real[begin + k] = False
    return line, np.flatnonzero(real), np.cumsum(counts + 1)


def log_shares(left: np.ndarray, right: np.ndarray, own: np.ndarray, calm: bool) -> np.ndarray:
    """log of the share of column own of each row of the exponentials of left @ right.T; calm: no product is far from 0."""
    scores = left @ right.T
    picked = scores.ravel().take(np.arange(0, scores.size, len(right)) + own)
    if calm:
        np.exp(scores, out=scores)
        return picked - np.log(scores @ np.ones(len(right), np.float32))
    top = scores.max(1, keepdims=True)
    return picked - top[:, 0] - np.log(np.exp(scores - top).sum(1))


def with_column(vectors: np.ndarray, column: np.ndarray) -> np.ndarray:
    return np.concatenate([vectors, np.broadcast_to(column, len(vectors))[:, None]], 1).astype(np.float32)


class LogBilinear:
    """Embeddings of units before, weights of positions, and vectors and biases of the root's outcomes and of cells; one flat array holds them all."""

    def __init__(self, flat: np.ndarray, tree: Tree):
        self.flat, self.tree = flat, tree
        u, c = len(tree.path), len(tree.node)
        parts = np.split(flat, np.cumsum([u * DIM, c * DIM, c, ROOT * DIM, CONTEXT * DIM]))
        self.embed, self.inner, self.inner_bias = parts[0].reshape(u, DIM), parts[1].reshape(c, DIM), parts[2]
        self.out, self.position, self.bias = parts[3].reshape(ROOT, DIM), parts[4].reshape(CONTEXT, DIM), parts[5]

    @staticmethod
    def size(tree: Tree) -> int:
        return len(tree.path) * DIM + len(tree.node) * (DIM + 1) + ROOT * (DIM + 1) + CONTEXT * DIM

    @staticmethod
    def fresh(root_counts: np.ndarray, tree: Tree) -> LogBilinear:
        """Units that share a root outcome start with the same embedding; outcomes start at their shares of the counts."""
        net, rng = LogBilinear(np.zeros(LogBilinear.size(tree), np.float32), tree), np.random.default_rng(SEED)
        net.embed[:] = rng.normal(0, 0.1, (ROOT, DIM)).astype(np.float32)[tree.path[:, 0]]
        net.out[:] = rng.normal(0, 0.1, (ROOT, DIM))
        net.inner_bias[:] = tree.share
        net.position[:] = 1 / CONTEXT
        net.bias[:] = np.log((root_counts + 1) / (root_counts + 1).sum())
        return net

    def predictions(self, line: np.ndarray) -> np.ndarray:
        """Of each place of the line, from the units before it in the line; places are taken in parts that stay in the processor's cache."""
        out = np.zeros((len(line), DIM), np.float32)
        for i in range(0, len(line), 1 << 13):
            begin = max(0, i - CONTEXT)
            embedded, part = self.embed.take(line[begin : i + (1 << 13)], 0), out[i : i + (1 << 13)]
            for k in range(CONTEXT):
                skip = max(0, k + 1 - (i - begin))  # places of this part that have no unit k + 1 before
                from_ = i - begin + skip - k - 1
                part[skip:] += embedded[from_ : from_ + max(0, len(part) - skip)] * self.position[k]
        return out

    def log_probs(self, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 of the normalised probability of the unit at each place: of the root's outcome and of its cells."""
        tree, out = self.tree, np.empty(len(at), np.float64)
        guess, path = with_column(self.predictions(line).take(at, 0), np.float32(1)), tree.path.take(line.take(at), 0)
        root, inner = with_column(self.out, self.bias), with_column(self.inner, self.inner_bias)
        longest = lambda x: float(np.sqrt((x * x).sum(1).max(initial=0)))
        calm = longest(guess) * max(longest(root), longest(inner)) < 60
        for i in range(0, len(at), 4096):
            part, own = guess[i : i + 4096], path[i : i + 4096, 0]
            out[i : i + 4096] = log_shares(part, root, own, calm)
        for level in (1, 2):
            column = np.ascontiguousarray(path[:, level])
            use = np.flatnonzero(column >= 0)
            use = use.take(np.argsort(column.take(use)))
            cells, own = column.take(use), guess.take(use, 0)
            logs, cuts = np.empty(len(use), np.float32), np.searchsorted(cells, tree.start)
            for n in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = tree.start[n], tree.start[n + 1]
                step = max(1, (1 << 19) // (b - a))
                for i in range(cuts[n], cuts[n + 1], step):
                    j = min(i + step, cuts[n + 1])
                    logs[i:j] = log_shares(own[i:j], inner[a:b], cells[i:j] - a, calm)
            out[use] += logs
        return out / np.log(10)

    def learn(self, line: np.ndarray, at: np.ndarray, seen: np.ndarray, noise: np.ndarray, rng: np.random.Generator) -> None:
        """One Adagrad step of noise-contrastive estimation for each BATCH places of the line, of which those in `at` are predicted: NOISE outcomes of the root drawn from `noise` are told apart from the true ones, and INNER_NOISE cells of its node from each true cell."""
        logs = np.log(NOISE * noise).astype(np.float32)
        tree, state = self.tree, LogBilinear(seen, self.tree)
        noise_share = tree.share + np.float32(np.log(INNER_NOISE))

        def summed(ids, values):
            """The distinct ids, and the sums of each one's rows of values(order)."""
            line = np.sort(ids.astype(np.int64) << 32 | np.arange(len(ids)))  # quicker than an argsort
            order, line = line & 0xFFFFFFFF, line >> 32
            first = np.flatnonzero(np.diff(line, prepend=-1))
            return line.take(first), np.add.reduceat(values(order), first, axis=0)

        def step(own, old, rows, grad):
            # One rate a row: a row's squared slopes are averaged over its columns.
            g = grad / np.float32(len(use))
            square = old[rows, -1] + np.einsum("rd,rd->r", g, g) / np.float32(g.shape[1]) if g.ndim > 1 else old[rows] + g * g
            if g.ndim > 1:
                old[rows, -1] = square
                square = square[:, None]
            else:
                old[rows] = square
            own[rows] -= RATE * g / np.sqrt(square + 1e-8)

        sigmoid = lambda x: 1 / (1 + np.exp(-x))
        every = slice(None)
        np.seterr(over="ignore")  # a sigmoid of a large negative number is 0
        cuts = np.searchsorted(at, np.arange(CONTEXT, len(line) + BATCH, BATCH))
        for i, low, high in zip(range(CONTEXT, len(line), BATCH), cuts[:-1], cuts[1:], strict=False):
            use = at[low:high] - i
            if not len(use):
                continue
            here = line[i - CONTEXT : i + BATCH]
            embedded, size = self.embed.take(here, 0), len(here) - CONTEXT
            shifted = [embedded[CONTEXT - 1 - k : CONTEXT - 1 - k + size] for k in range(CONTEXT)]
            guess = sum(e * p for e, p in zip(shifted, self.position, strict=True)).take(use, 0)
            path = tree.path.take(here[CONTEXT:].take(use), 0)
            true, drawn = np.ascontiguousarray(path[:, 0]), rng.choice(ROOT, NOISE, p=noise)
            good, bad = self.out.take(true, 0), self.out[drawn]
            to_good = sigmoid(np.einsum("td,td->t", guess, good) + (self.bias - logs).take(true)) - 1
            to_bad = sigmoid(guess @ bad.T + (self.bias - logs)[drawn])
            good *= to_good[:, None]
            to_guess = good + to_bad @ bad
            out = np.zeros((ROOT, DIM), np.float32)
            rows, sums = summed(true, lambda order: to_good.take(order)[:, None] * guess.take(order, 0))  # noqa: B023
            out[rows] = sums
            np.add.at(out, drawn, to_bad.T @ guess)
            bias = (np.bincount(true, to_good, ROOT) + np.bincount(drawn, to_bad.sum(0), ROOT)).astype(np.float32)
            some = [np.flatnonzero(path[:, level] >= 0) for level in (1, 2)]
            token = np.concatenate(some)
            if len(token):
                cells = np.concatenate([path[t, level] for t, level in zip(some, (1, 2), strict=True)])
                ids = np.concatenate([cells[:, None], tree.drawn(cells, rng)], 1)  # the true cell first
                vectors = self.inner.take(ids, 0)
                slope = sigmoid(np.einsum("td,tkd->tk", guess.take(token, 0), vectors) + self.inner_bias.take(ids) - noise_share.take(ids))
                slope[:, 0] -= 1
                more = np.einsum("tk,tkd->td", slope, vectors)
                to_guess[some[0]] += more[: len(some[0])]
                to_guess[some[1]] += more[len(some[0]) :]
                flat, wide, whole_guess = slope.reshape(-1, 1), INNER_NOISE + 1, with_column(guess, np.float32(1))
                rows, sums = summed(ids.ravel(), lambda order: flat.take(order, 0) * whole_guess.take(token.take(order // wide), 0))  # noqa: B023
                step(self.inner, state.inner, rows, sums[:, :DIM])
                step(self.inner_bias, state.inner_bias, rows, sums[:, DIM])
            # Each place hands its slope on to the CONTEXT places before it.
            whole, to_embedded = np.zeros((size, DIM), np.float32), np.zeros((len(here), DIM), np.float32)
            whole[use] = to_guess
            position = np.stack([np.einsum("td,td->d", whole, e) for e in shifted])
            for k in range(CONTEXT):
                to_embedded[CONTEXT - 1 - k : CONTEXT - 1 - k + size] += whole * self.position[k]
            rows, sums = summed(here, lambda order: to_embedded.take(order, 0))  # noqa: B023
            step(self.embed, state.embed, rows, sums)
            step(self.position, state.position, every, position)
            step(self.out, state.out, every, out)
            step(self.bias, state.bias, every, bias)


def is_training(key: str):
    """Whether a row is learned from: crc32 of its id as text, modulo 5, is not 1 (a null id: yes)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 1, F.lit(True))


def distinct(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, counts): names[order] is sorted, and its distinct values begin at first."""
    order = np.argsort(names)
    line = names[order]
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    return order, first, np.diff(first, append=len(line))


def count_words(train: DataFrame, text: str) -> DataFrame:
    """(h, leaf, c): hash of each word, its subclass, its count; each task sums its own first."""

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, size = [], 0

        def handed_on():
            names, leaves, counts = (np.concatenate(x) for x in zip(*kept, strict=True))
            order, first, _ = distinct(names)
            return names[order[first]], leaves[order[first]], np.add.reduceat(counts[order], first)

        for batch in released(batches):
            for a, b in runs(batch[text]):
                words = Words(batch[text].iloc[a:b].tolist())
                names, leaves = words.hashes(), leaves_of(words)
                order, first, c = distinct(names)
                kept.append((names[order[first]], leaves[order[first]], c))
                size += len(c)
                if size > 2 * FLUSH:
                    kept = [handed_on()]
                    size = len(kept[0][0])
                    if size > FLUSH:
                        yield frame(*kept.pop())
                        size = 0
        if size:
            yield frame(*handed_on())

    def frame(h, leaves, c):
        return pd.DataFrame({"h": h.view(np.int64), "leaf": leaves, "c": c})

    return train.select(text).mapInPandas(work, "h long, leaf int, c long").groupBy("h").agg(F.max("leaf").alias("leaf"), F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, documents: int) -> Vocabulary:
    """Sums over all counts, the head and the tree; the driver gets at most HEAD words, a histogram of the counts by powers of 2 ** 0.25 and a row a subclass."""
    step = F.floor(F.log2("c") * 4).cast("int")
    steps = {r["s"]: r["n"] for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, from_step = 0, 0
    for s in sorted(steps, reverse=True):
        total += steps[s]
        if total > HEAD:
            from_step = s + 1
            break
    head = counts.withColumn("s", step).filter(F.col("s") >= from_step).select("h", "c", "leaf").toPandas()
    head = head.sort_values(["c", "h"], ascending=[False, True])
    sums = counts.groupBy("leaf").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).toPandas()
    left, left_n = np.zeros(LEAVES), np.zeros(LEAVES)
    left[sums["leaf"]], left_n[sums["leaf"]] = sums["c"], sums["n"]
    tokens, types = int(left.sum()) + documents, int(left_n.sum()) + (documents > 0)
    names, many, leaf = head["h"].to_numpy(np.int64).view(np.uint64), head["c"].to_numpy(np.int64), head["leaf"].to_numpy(np.int64)
    own = min(OWN, len(head))
    last = max(own, int((many >= LEAST_COUNT).sum()))
    # Words with vectors leave what is left of their subclass.
    np.subtract.at(left, leaf[:last], many[:last])
    np.subtract.at(left_n, leaf[:last], 1)
    ranks = np.arange(own, last)
    of_class = leaf[own:last] // BRANCH
    by_class = np.argsort(of_class, kind="stable")
    first = np.searchsorted(of_class[by_class], np.arange(CLASSES))
    place = np.empty(len(ranks), np.int64)
    place[by_class] = np.arange(len(ranks)) - first[of_class[by_class]]  # by frequency within the class
    high, low = ranks[place < BRANCH], ranks[place >= BRANCH]
    # Cells: subclasses of classes, frequent words of classes, other words of subclasses, what is left of subclasses.
    below = left.copy()
    np.add.at(below, leaf[low], many[low])
    node = np.concatenate([np.repeat(np.arange(CLASSES), BRANCH), leaf[high] // BRANCH, CLASSES + leaf[low], CLASSES + np.arange(LEAVES)])
    cell_counts = np.concatenate([below, many[high], many[low], left])
    path = np.full((OWN + 1 + len(ranks) + LEAVES, 3), -1, np.int64)
    path[: OWN + 1, 0] = np.arange(OWN + 1)
    unit = np.full(len(head), -1, np.int64)
    unit[:own], unit[high], unit[low] = np.arange(own), END + 1 + np.arange(len(high)), END + 1 + len(high) + np.arange(len(low))
    path[unit[high], 0], path[unit[high], 1] = END + 1 + leaf[high] // BRANCH, LEAVES + np.arange(len(high))
    path[unit[low], 0], path[unit[low], 1], path[unit[low], 2] = END + 1 + leaf[low] // BRANCH, leaf[low], LEAVES + len(high) + np.arange(len(low))
    leaves = np.arange(LEAVES)
    chosen = np.bincount(leaf[low], minlength=LEAVES) > 0  # else there is nothing to choose between
    path[len(path) - LEAVES :] = np.stack([END + 1 + leaves // BRANCH, leaves, np.where(chosen, LEAVES + len(ranks) + leaves, -1)], 1)
    root = np.zeros(ROOT)
    root[:own], root[END] = many[:own], documents
    np.add.at(root, END + 1 + of_class, many[own:last])
    np.add.at(root, END + 1 + leaves // BRANCH, left)
    by_hash = np.argsort(names)
    return Vocabulary(names[by_hash], many[by_hash], unit[by_hash], Tree(path, node, cell_counts), np.log10(left + 0.5 * (left_n + 1)), root, tokens, types)


def coded(docs: DataFrame, vocab: Vocabulary, key: str, text: str) -> DataFrame:
    """(uid, key, learned, order, n, known, logs, left, h, tf, units) of every document.

    learned: whether it is trained on; order: a hash of id and text; n: tokens; known: those of the head, and the end;
    logs: the head's share of the base score; left: log10 of the smoothed sizes of what its words without a unit are
    left in; h, tf: its words beyond the head, and how often it has them; units: 32-bit numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, uid = shared.value, TaskContext.get().partitionId() << 40
        end_log = np.log10(vocab.root_counts[END] + 0.5)
        for batch in released(batches):
            for a, b in runs(batch[text]):
                part = batch.iloc[a:b]
                names, place, units, first = tokens_of(part[text].tolist(), vocab)
                of = np.repeat(np.arange(b - a), np.diff(first))
                summed = lambda v, of=of, n=b - a: np.bincount(of, v, n)
                hit, leaf = place >= 0, units - vocab.first_leaf  # a leaf that isn't negative: a word without a unit of its own
                logs = np.zeros(len(names))
                logs[hit] = np.log10(vocab.head_counts[place[hit]] + 0.5)
                rest = np.flatnonzero(~hit)
                order = np.argsort(names[rest])
                order = order[np.argsort(of[rest][order].astype(np.uint16 if b - a < 1 << 16 else np.int64), kind="stable")]
                h, t = names[rest][order].view(np.int64), of[rest][order]
                begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])) if len(h) else np.zeros(0, np.int64)
                tf = np.diff(begin, append=len(h)).astype(np.int32)
                cuts = np.searchsorted(t[begin], np.arange(b - a + 1))
                yield pd.DataFrame(
                    {
                        "uid": uid + np.arange(b - a), key: part[key].to_numpy(), "learned": part["learned"].to_numpy(), "order": part["order"].to_numpy(), "n": np.diff(first) + 1,
                        "known": summed(hit).astype(np.int64) + (vocab.root_counts[END] > 0), "logs": summed(logs) + end_log, "left": summed(np.where(leaf >= 0, logs - vocab.left[np.maximum(leaf, 0)], 0.0)),
                        "h": [h[begin[i:j]] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], "tf": [tf[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], "units": [units[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)],
                    }
                )
                uid += b - a

    rows = docs.select(key, text, is_training(key).alias("learned"), F.xxhash64(key, text).alias("order"))
    return rows.mapInPandas(work, f"uid long, {key} {rows.schema[key].dataType.simpleString()}, learned boolean, order long, n long, known long, logs double, left double, h array<long>, tf array<int>, units binary")


def trained_network(lines: DataFrame, vocab: Vocabulary) -> LogBilinear:
    """Learned from every training document of coded(); the same on any partitioning, as documents are dealt and ordered by hashes of id and text."""
    spark = lines.sparkSession.sparkContext
    noise = (vocab.root_counts + 1) ** 0.75
    noise /= noise.sum()
    net = LogBilinear.fresh(vocab.root_counts, vocab.tree)
    words = spark.broadcast(vocab)
    buckets = min(max(1, -(-vocab.tokens // BUCKET_TOKENS)), MOST_BUCKETS)
    lines = lines.filter("learned").select(F.col("order").alias("h"), "units")
    for turn in range(ROUNDS):
        start = spark.broadcast(net.flat)

        def learned(batches: Iterable[pd.DataFrame], start=start, turn=turn) -> Iterator[pd.DataFrame]:
            net, rng = None, np.random.default_rng([SEED, turn, TaskContext.get().partitionId()])
            held, size, n = [], 0, 0

            def taken():
                first = np.concatenate([[0], np.cumsum([len(x) for x in held])])
                line, at, _ = with_ends(np.concatenate(held), first)
                net.learn(line, at, seen, noise, rng)
                return len(at)

            for batch in released(batches):
                if net is None and len(batch):
                    net, seen = LogBilinear(start.value.copy(), words.value.tree), np.zeros(len(start.value), np.float32)
                for units in batch["units"]:
                    held.append(np.frombuffer(units, np.int32))
                    size += len(held[-1]) + 1
                    if size >= LINE:
                        n, held, size = n + taken(), [], 0
            if held:
                n += taken()
            for i in range(0, len(net.flat) if n else 0, SLICE):
                yield pd.DataFrame({"g": [i], "bucket": [TaskContext.get().partitionId()], "n": [n], "weights": [net.flat[i : i + SLICE].tobytes()]})

        def averaged(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("bucket")
            total = sum(np.frombuffer(w, np.float32).astype(np.float64) * n for w, n in zip(group["weights"], group["n"], strict=True))
            return pd.DataFrame({"g": [int(group["g"].iloc[0])], "bucket": [int(group["bucket"].iloc[0])], "n": [int(group["n"].sum())], "weights": [(total / group["n"].sum()).astype(np.float32).tobytes()]})

        schema = "g int, bucket int, n long, weights binary"
        own = lines.filter(F.pmod(F.xxhash64(F.lit("round"), "h"), F.lit(ROUNDS)) == turn)
        dealt = own.withColumn("bucket", F.pmod(F.xxhash64(F.lit("bucket"), "h"), F.lit(buckets)).cast("int"))
        parts = dealt.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("h", "units").select("units").mapInPandas(learned, schema)
        if buckets > 1:  # in two steps, so that no task gets a slice of every bucket
            parts = parts.withColumn("many", F.floor(F.col("bucket") / ADDED)).groupBy("g", "many").applyInPandas(lambda d: averaged(d), schema)
        found = parts.groupBy("g").applyInPandas(averaged, schema).collect()  # one network
        if found:
            net = LogBilinear(np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(found, key=lambda r: r["g"])]), vocab.tree)
    return net


def score_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    The model learns from rows that are not held out (crc32 of the id as text, modulo 5, is 1). Words are runs of
    characters other than ASCII blanks, with A-Z lowered, then one end; an empty or null text is its end alone.
    Words are told apart by 64-bit hashes. Null ids are learned from; repeated rows stay. Without any training
    row N is 0 and all scores come from the smoothing.
    """
    spark = docs.sparkSession
    rows = keyed_text(docs, key, text)
    train = rows.filter(is_training(key))
    counts = written(count_words(train, text))
    vocab = vocabulary(counts, docs.filter(is_training(key)).count())
    part = written(coded(rows, vocab, key, text))
    net = trained_network(part, vocab)
    shared = spark.sparkContext.broadcast((vocab.tree, net.flat))

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, flat = shared.value
        net, held, size = LogBilinear(flat, tree), [], 0

        def scored():
            rows = pd.concat(held)
            own = [np.frombuffer(x, np.int32) for x in rows["units"]]
            line, at, ends = with_ends(np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])]))
            sums = np.concatenate([[0.0], np.cumsum(net.log_probs(line, at))])
            return rows[given].assign(model=np.diff(sums[np.concatenate([[0], ends])]))

        # A choice costs some time however few words take it, so words of several batches are scored together.
        for batch in released(batches):
            for a, b in runs(batch["units"], 4 * SCORED):
                part = batch.iloc[a:b]
                held.append(part)
                size += sum(map(len, part["units"])) // 4 + len(part)
                if size >= SCORED:
                    yield scored()
                    held, size = [], 0
        if held:
            yield scored()

    given = ["uid", key, "n", "known", "logs", "left"]
    kind = rows.schema[key].dataType.simpleString()
    scored = part.select(*given, "units").mapInPandas(work, f"uid long, {key} {kind}, n long, known long, logs double, left double, model double")
    rare = part.filter(F.size("h") > 0).select("uid", F.explode(F.arrays_zip("h", "tf")).alias("w")).select("uid", "w.h", "w.tf")
    joined = rare.join(counts.select("h", "c"), "h", "left")
    more = joined.groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more_known"), F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more_logs"))
    out = scored.join(more, "uid", "left")
    logs = F.coalesce("more_logs", F.lit(0.0))
    all_log = float(np.log10(vocab.tokens + 0.5 * (vocab.types + 1)))
    return out.select(
        key, (~is_training(key)).alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + logs - F.col("n") * F.lit(all_log)).alias("base_score"), (F.col("model") + F.col("left") + logs).alias("score"),
    )
