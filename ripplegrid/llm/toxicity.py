"""Toxicity: a convolutional text classifier over hashed word embeddings, in numpy.

A word is the sum of the embeddings of its hash and of its first bytes' hash, so that inflected and compounded
forms share a part. Filters one, two and three words wide slide over the whole text; each filter's largest
answer is kept, and a logistic layer reads these maxima. As the filters are linear, scoring needs only sums of
rows of a table that holds each embedding's answer to each column of each filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, runs, trimmed, written
from .wordscan import LETTERS, Words

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 8, 8, (1, 2, 3)
STEM_BYTES = 4
#: The classifier is fitted on at most so many labelled rows of each label, each of at most so many characters, chosen by a hash of their ids.
SAMPLE_ROWS, SAMPLE_CHARS = 1_500, 10_000
#: A share of the labelled rows is never fitted. These and all that the sample had no room for calibrate the score and the languages' thresholds.
HELD = 0.25
#: Calibration counts logits in steps of 1 / STEPS up to LIMIT either way; a language with fewer than FEW such rows has the threshold of all.
STEPS, LIMIT, FEW = 64, 64, 40
EPOCHS, RATE, SEED = 6, 0.05, 11
#: Buckets found in fewer sampled texts than this have no embedding: what is that rare there can't be learned from.
LEAST_TEXTS = 3
#: Score from which a document counts as toxic whatever its language.
PREDICTED_FROM = 0.7


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n_words, 2) buckets of each word and of its stem, and the words before each text. Words are runs of letters."""
    words = Words(texts, LETTERS)
    pairs = np.empty((len(words), 2), np.int32)
    pairs[:, 0] = words.hashes() % np.uint64(BUCKETS)
    pairs[:, 1] = (words.hashes(STEM_BYTES) * np.uint64(3) + np.uint64(1)) % np.uint64(BUCKETS)
    return pairs, words.first


@dataclass
class Cnn:
    embed: np.ndarray  # (BUCKETS, DIM)
    filters: list[np.ndarray]  # for each width w: (w, DIM, FILTERS)
    bias: np.ndarray  # (widths * FILTERS,)
    out: np.ndarray  # (widths * FILTERS,)
    out_bias: float

    @staticmethod
    def fresh(seed: int = SEED) -> Cnn:
        rng = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        return Cnn(rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), [rng.normal(0, 0.5 / w, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(n, np.float32), rng.normal(0, 0.3, n).astype(np.float32), 0.0)

    def answers(self) -> list[np.ndarray]:
        """For each width and column: every embedding's answer to the filters."""
        return [self.embed @ f[k] for f in self.filters for k in range(len(f))]

    def pooled(self, pairs: np.ndarray, first: np.ndarray, answers: list[np.ndarray] | None = None, where: bool = False):
        """(texts, widths * FILTERS) largest answers, at least 0; with where also the position of each, or -1."""
        answers = self.answers() if answers is None else answers
        n, at = len(first) - 1, 0
        out = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        place = np.full(out.shape, -1, np.int64)
        for i, w in enumerate(WIDTHS):
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            size = len(pairs) - w + 1
            if size > 0:
                sums = np.zeros((size, FILTERS), np.float32)
                for k in range(w):
                    sums += answers[at + k][pairs[k : k + size, 0]]
                    sums += answers[at + k][pairs[k : k + size, 1]]
                full = np.flatnonzero(np.diff(first) >= w)
                # Windows of each text: from its first word to w - 1 before its last.
                begin, end = first[full], first[full + 1] - w + 1
                if len(full):
                    cuts = np.stack([begin, end], 1).ravel()
                    cuts = cuts[:-1] if cuts[-1] >= size else cuts
                    best = np.maximum.reduceat(sums, cuts, axis=0)[::2]
                    out[full, cols] = np.maximum(best + self.bias[cols], 0)
                    if where:
                        text = np.repeat(np.arange(len(full)), end - begin)
                        rows = np.arange(len(text)) + np.repeat(begin - np.cumsum(end - begin) + (end - begin), end - begin)
                        at_row, unit = np.nonzero((sums[rows] == best[text]) & (out[full, cols] > 0)[text])
                        # The first of equals is written last.
                        place[full[text[at_row[::-1]]], i * FILTERS + unit[::-1]] = rows[at_row[::-1]]
            at += w
        return (out, place) if where else out

    def logits(self, pairs: np.ndarray, first: np.ndarray, answers: list[np.ndarray] | None = None) -> np.ndarray:
        return self.pooled(pairs, first, answers).astype(np.float64) @ self.out + self.out_bias

    def start(self, parts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        """Rare buckets lose their embedding; the first dimension of the others starts as the log-odds of the label given that a text has the bucket, and one filter of each width reads it."""
        having = np.zeros((2, BUCKETS))
        for (pairs, _), y in zip(parts, labels, strict=True):
            having[int(y), np.unique(pairs)] += 1
        n = np.array([(labels == 0).sum(), (labels == 1).sum()])
        odds = np.log((having[1] + 0.5) / (n[1] + 1)) - np.log((having[0] + 0.5) / (n[0] + 1))
        self.embed[:, 0] = np.clip(odds, -2, 4) / 4
        self.embed[having.sum(0) < LEAST_TEXTS] = 0
        for f in self.filters:
            f[:, :, 0] = 0
            f[:, 0, 0] = 1
        self.out[::FILTERS] = 1.0

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> None:
        """Adagrad on the logistic loss, with both labels weighing the same; gradients reach the words under each maximum."""
        rng = np.random.default_rng(seed)
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        parts = [features([t]) for t in texts]
        self.start(parts, labels)
        known = self.embed.any(1)
        state = [np.full_like(x, 1e-2, np.float32) for x in (self.embed, *self.filters, self.bias, self.out)]
        seen_bias = 1e-2
        for _ in range(epochs):
            for chosen in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 32)):
                pairs = np.concatenate([parts[i][0] for i in chosen])
                first = np.concatenate([[0], np.cumsum([len(parts[i][0]) for i in chosen])])
                hidden, place = self.pooled(pairs, first, where=True)
                score = 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.out_bias, -30, 30)))
                slope = ((score - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
                to_hidden = slope[:, None] * self.out * (place >= 0)
                grads = [np.zeros_like(f) for f in self.filters]
                rows, values = [], []
                for i, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                    cols = slice(i * FILTERS, (i + 1) * FILTERS)
                    text, unit = np.nonzero(place[:, cols] >= 0)
                    p, g = place[:, cols][text, unit], to_hidden[:, cols][text, unit]
                    for k in range(w):
                        for side in range(2):
                            ids = pairs[p + k, side]
                            np.add.at(grads[i][k].T, unit, g[:, None] * self.embed[ids])
                            rows.append(ids)
                            values.append(g[:, None] * f[k][:, unit].T)
                steps = [*grads, to_hidden.sum(0), hidden.T @ slope]
                for own, seen, grad in zip((*self.filters, self.bias, self.out), state[1:], steps, strict=True):
                    seen += grad * grad
                    own -= rate * grad / np.sqrt(seen)
                seen_bias += float(slope.sum()) ** 2
                self.out_bias -= rate * float(slope.sum()) / seen_bias**0.5
                if rows:
                    ids, back = np.unique(np.concatenate(rows), return_inverse=True)
                    grad = np.zeros((len(ids), DIM), np.float32)
                    np.add.at(grad, back, np.concatenate(values))
                    state[0][ids] += grad * grad
                    self.embed[ids] -= rate * grad / np.sqrt(state[0][ids]) * known[ids, None]

    def scores(self, texts: list[str], answers: list[np.ndarray] | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*features(texts), answers), -500, 500)))


def training_labels(labels: DataFrame, key: str) -> DataFrame:
    """(key, toxic, __h, __held) of the labelled ids of the training fold; held ones are not fitted."""
    own = labels.filter("toxic IN (0, 1)").select(key, "toxic").dropna().groupBy(key).agg(F.max("toxic").alias("toxic"))
    own = own.filter(F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1).withColumn("__h", F.xxhash64(F.lit(SEED), F.col(key)))
    return own.withColumn("__held", F.pmod(F.xxhash64(F.lit("held"), F.col(key)), F.lit(100)) < int(100 * HELD))


def fitted_ids(own: DataFrame, rows: int, key: str) -> DataFrame:
    """(key, toxic) of at most so many ids of each label; chosen before the texts are read, so that no text is shuffled."""
    free = own.filter("NOT __held")
    return free.filter("toxic = 0").orderBy("__h", key).limit(rows).unionByName(free.filter("toxic = 1").orderBy("__h", key).limit(rows)).select(key, "toxic")


def fits(text: str) -> Column:
    return F.coalesce(F.length(text) <= SAMPLE_CHARS, F.lit(False))


def sampled(docs: DataFrame, chosen: DataFrame, key: str, text: str) -> pd.DataFrame:
    """(text, toxic) of the chosen ids, each with the least of its texts, as an id may be repeated without end."""
    some = docs.filter(fits(text)).select(key, text).join(F.broadcast(chosen), key).groupBy(key, "toxic").agg(F.min(text).alias(text)).toPandas()
    # The rows' order must not depend on how they were read.
    return some.sort_values([key, text], kind="stable", ignore_index=True)[[text, "toxic"]]


def logit_column(net: Cnn, text: Column, spark) -> Column:
    shared = spark.sparkContext.broadcast((net, net.answers()))

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net, answers = shared.value
        for batch in released(batches):
            parts = [net.logits(*features(batch.iloc[a:b].tolist()), answers) for a, b in runs(batch)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return of(F.coalesce(text.cast("string"), F.lit("")))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def calibrated(scored: DataFrame, own: DataFrame, chosen: DataFrame, key: str) -> tuple[float | None, dict[str, float]]:
    """The logit that parts the labels best, over all and by language, in every labelled row that was not fitted.

    scored is (key, lang, logit, fits). Both labels weigh what they do among all labelled rows, fitted ones too, as
    the fit takes a larger share of the rarer one. The driver gets one histogram and a row per language.
    """
    rows = scored.join(own.select(key, "toxic"), key).join(F.broadcast(chosen.select(key, F.lit(True).alias("chosen"))), key, "left")
    free = ~(F.coalesce("chosen", F.lit(False)) & F.col("fits"))
    level = F.floor(F.greatest(F.least("logit", F.lit(LIMIT)), F.lit(-LIMIT)) * STEPS).cast("int")
    least, most = F.min(F.when(free, F.col("logit"))), F.max(F.when(free, F.col("logit")))
    found = rows.groupBy("lang", "toxic", level.alias("level")).agg(F.count(F.lit(1)).alias("all"), F.count_if(free).alias("n"), least.alias("lo"), most.alias("hi"))
    found = written(found)
    mix = {r["toxic"]: r["all"] / r["n"] for r in found.groupBy("toxic").agg(F.sum("all").alias("all"), F.sum("n").alias("n")).collect() if r["n"]}
    if len(mix) < 2:
        return None, {}
    whole = found.filter("n > 0").groupBy("toxic", "level").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas()

    def of(group: pd.DataFrame) -> pd.DataFrame:
        use = group["n"].sum() >= FEW and group["toxic"].nunique() == 2
        return pd.DataFrame([(str(group["lang"].iloc[0]), histogram_cut(group, mix))] if use else [], columns=["lang", "cut"]).astype({"lang": object, "cut": float})

    cuts = found.filter("n > 0 AND lang IS NOT NULL").groupBy("lang").applyInPandas(of, "lang string, cut double").collect()
    return histogram_cut(whole, mix), {r["lang"]: r["cut"] for r in cuts}


@dataclass
class ToxicityClassifier:
    """A network, and thresholds by language; None is that of other languages and of a null one."""

    net: Cnn
    thresholds: dict[str | None, float]
    shift: float = 0.0

    @staticmethod
    def trained(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[ToxicityClassifier, DataFrame]:
        """The classifier and (key, lang, logit, fits) of all docs, before the shift, written to the shared folder.

        Fitted on a bounded sample, calibrated on all labelled rows of the training fold that the fit doesn't see;
        without rows of both labels every score is near 0.
        """
        spark, own = docs.sparkSession, training_labels(labels, key)
        chosen = fitted_ids(own, rows, key)
        some = sampled(docs, chosen, key, text)
        net, y = Cnn.fresh(), some["toxic"].to_numpy(np.float64)
        learns = len(some) >= 8 and y.min() < y.max()
        if learns:
            net.fit(some[text].tolist(), y)
        else:
            net.out[:], net.out_bias = 0, -6.0
        del some
        trimmed()
        scored = written(docs.select(F.col(key), F.col(lang).cast("string").alias("lang"), logit_column(net, F.col(text), spark).alias("logit"), fits(text).alias("fits")))
        middle, cuts = calibrated(scored, own, chosen, key) if learns else (None, {})
        # Centre the score: the logit that parts the labels best becomes the score PREDICTED_FROM.
        shift = 0.0 if middle is None else float(np.log(PREDICTED_FROM / (1 - PREDICTED_FROM))) - middle
        net.out_bias += shift
        of = {name: float(1 / (1 + np.exp(-np.clip(cut + shift, -500, 500)))) for name, cut in cuts.items()}
        return ToxicityClassifier(net, {None: PREDICTED_FROM, **of}, shift), scored

    def column(self, text: Column, spark) -> Column:
        """Scores of a text column, 0 to 1."""
        return sigmoid(logit_column(self.net, text, spark))

    def threshold(self, lang: Column) -> Column:
        own = {k: v for k, v in self.thresholds.items() if k is not None}
        if not own:
            return F.lit(self.thresholds[None])
        given = F.create_map(*[F.lit(x) for k, v in own.items() for x in (k, v)])
        return F.coalesce(F.try_element_at(given, F.coalesce(lang, F.lit(""))), F.lit(self.thresholds[None]))


def histogram_cut(found: pd.DataFrame, weight: dict[int, float]) -> float:
    """The level that parts labels 0 and 1 with the least weight of errors, halfway between the neighbouring steps' values; the middle one of equals. found is (toxic, level, n, lo, hi)."""
    steps = found.assign(clean=found["n"] * (found["toxic"] == 0) * weight[0], toxic=found["n"] * (found["toxic"] == 1) * weight[1])
    steps = steps.groupby("level", sort=True).agg({"clean": "sum", "toxic": "sum", "lo": "min", "hi": "max"})
    lo, hi = steps["lo"].to_numpy(float), steps["hi"].to_numpy(float)
    errors = np.concatenate([[0], np.cumsum(steps["toxic"])]) + np.concatenate([np.cumsum(steps["clean"][::-1])[::-1], [0]])
    least = np.flatnonzero(errors <= errors.min() * (1 + 1e-9) + 1e-9)
    i = int(least[len(least) // 2])
    return float(lo[0] - 1e-6 if i == 0 else hi[-1] + 1e-6 if i == len(lo) else (hi[i - 1] + lo[i]) / 2)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, score, predicted, threshold, flagged) of every document; null texts count as empty, repeated rows and null keys stay.

    Labels are learned only where crc32(key as text) modulo 3 is not 1; held_out marks the rest. The score is a
    function of the text alone; flagged compares it to the threshold calibrated for the row's language.
    """
    model, scored = ToxicityClassifier.trained(docs, labels, key=key, text=text, lang=lang)
    rows = scored.select(key, "lang", sigmoid(F.col("logit") + model.shift).alias("score"))
    held = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    limit = model.threshold(F.col("lang"))
    return rows.select(key, held.alias("held_out"), "score", (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"), limit.alias("threshold"), (F.col("score") >= limit).alias("flagged"))


def drop_toxic(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score is below their language's threshold and below PREDICTED_FROM, with docs' columns; no names are reserved.

    Null and empty texts have the score of no word, and a null or unseen language the threshold of all. A score that
    equals its limit goes. Repeated rows share their fate; without labels of both kinds all rows stay.
    """
    model, _ = ToxicityClassifier.trained(labelled, labels)
    return docs.filter(model.column(F.col("text"), docs.sparkSession) < F.least(model.threshold(F.col("lang")), F.lit(PREDICTED_FROM)))
