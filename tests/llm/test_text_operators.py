"""Encoding, token files, fingerprints, quality, toxicity and language-model scores against brute force."""

import collections
import hashlib
import math
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ripplegrid.llm import bpe, common, kneser, lbl, parsing, tokenfiles, toxicity, wordscan

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
LONG = "the cat sat on a mat and " * 3000
ROWS = [
    (1, "", "en", "s", 0, "x", 1), (2, None, "en", None, None, None, 2), (3, "one two", None, "s", 7, "x", 3), (4, LONG, "en", "t", len(LONG), "x", 4),
    (5, "Été à l'école, n'est-ce pas? ＦＵＬＬ ½ 日本", "fr", "t", 9, "x", 5), (6, "one two", "en", "s", 7, "x", 6), (6, "one two", "en", "s", 7, "x", 6), (None, "no id here", "en", "s", 3, "x", 7),
    (8, "<|endoftext|> x<|startoftext|>", "en", "s", 3, "x", 8), (9, " \t\n ", "en", "s", 3, "x", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use too."""
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long, score string, n long").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def odd_texts():
    rnd = random.Random(1)
    texts = ["", " \n ", "a" * 3000, "ab" * 2000, "!!!???...", "İstanbul ΣΑΣ ẞ ſ", "\x1ca\x1fb\x85c", "x²½Ⅷ foo_bar 'S don't", "<|ENDOFTEXT|><|endoftext|>a"]
    texts += ["".join(rnd.choice("abtheingo'rsx .,<|é漢\n") for _ in range(rnd.randint(1, 80))) for _ in range(500)]
    return texts + ["".join(chr(rnd.choice([rnd.randint(1, 0x2FF), rnd.randint(0x300, 0xD7FF), rnd.randint(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(500)]


def test_encoding_is_the_librarys(sample):
    codec = bpe.built(bpe.vocabulary())
    for text in odd_texts() + [r["text"] for r in sample.limit(50).collect()]:
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(codec.encode(text), "<u2")
        assert got.tolist() == ids
        assert codec.decode(got) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_bpe_digests(docs, none):
    rows = bpe.bpe_digests(docs).collect()
    assert len(rows) == len(ROWS) and bpe.bpe_digests(none).count() == 0
    want = collections.Counter()
    for key, text, *_ in ROWS:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        want[key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, rows)) == want


def test_token_counts(docs, none):
    got = collections.Counter(map(tuple, tokenfiles.document_token_counts(docs).collect()))
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    assert got == collections.Counter((k, len(plain.encode(t or "", add_special_tokens=False).ids)) for k, t, *_ in ROWS if k is not None)
    assert tokenfiles.document_token_counts(none).count() == 0


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_scan_stitches_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want = []
    for name in ("a", "b", "c"):
        tokens = rng.integers(0, 5, 200).astype("<u2")
        tokens[tokens == 4] = 65535
        if name == "a":
            tokens[-1] = 65535
        (tmp_path / name).write_bytes(tokens.tobytes())
        start = 0
        for end in [*np.flatnonzero(tokens == 65535).tolist(), len(tokens)]:
            if end < len(tokens) or start < len(tokens):
                want.append((name, start, end - start, end < len(tokens)))
            start = end + 1
    (tmp_path / "empty").write_bytes(b"")
    got = tokenfiles.scan_token_files(spark, str(tmp_path), separator=65535, block_tokens=block).collect()
    assert sorted((r["file"].rsplit("/", 1)[1], r["start"], r["n_tokens"], r["closed"]) for r in got) == sorted(want)


def test_token_files_are_rolled(spark, docs, tmp_path):
    tokenfiles.write_token_files(docs, str(tmp_path / "a"), file_bytes=40)
    found = tokenfiles.scan_token_files(spark, str(tmp_path / "a"), lead=tokenfiles.ID_TOKENS).collect()
    assert len({r["file"] for r in found}) > 3 and len(found) == len([r for r in ROWS if r[0] is not None]) and all(r["closed"] for r in found)


def test_id_tokens():
    ids = np.array([0, 1, -1, 2**63 - 1, -(2**63), 123456789012345])
    assert (tokenfiles.ids_of(tokenfiles.id_tokens(ids)) == ids).all() and tokenfiles.id_tokens(ids).max() < 1 << 15


def test_words_are_those_of_the_pattern():
    texts = ["", "Ab  cD\x0be\x1cf é É", "\n\n", "x"]
    words = wordscan.Words(texts)
    assert words.strings() == ["ab", "cd", "e\x1cf", "é É", "x"] and words.counts().tolist() == [0, 4, 0, 1]
    assert words.hashes()[0] == wordscan.Words(["zz ab"]).hashes()[1]
    assert words.hashes(1)[0] == wordscan.Words(["a"]).hashes()[0]


def test_fingerprints(docs, none):
    rows = parsing.fingerprint_documents(docs).collect()
    assert parsing.fingerprint_documents(none).count() == 0 and len(rows) == len(ROWS)
    order = sorted(ROWS, key=lambda r: (-math.inf if r[0] is None else r[0], r[1] or ""))
    texts = [r[1] or "" for r in order]
    want = collections.Counter()
    for key, text, following in zip([r[0] for r in order], texts, texts[1:] + texts[:1], strict=True):
        new = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        own, changed, after = (parsing.hexed(parsing.sketches([t])[0]) for t in (text, new, following))
        sets = [{s[i : i + 8] for i in range(0, len(s), 8)} for s in (own, changed, after)]

        def like(x, y):
            low = sorted(x | y)[: parsing.SKETCH]
            return len(set(low) & x & y) / len(low) if low else 1.0

        want[key, len(text), hashlib.sha256(new.encode()).hexdigest(), own, changed, like(sets[0], sets[1]), like(sets[0], sets[2])] += 1
    assert collections.Counter(map(tuple, rows)) == want


def test_fingerprints_follow_the_text(sample):
    texts = [r["text"] for r in sample.collect() if len(r["text"]) > 1000]
    sketch = lambda ts: [parsing.sketches([t])[0] for t in ts]
    own = sketch(texts)
    assert parsing.likeness(own, sketch(["zz " + t for t in texts])).mean() > 0.85
    assert parsing.likeness(own, own[1:] + own[:1]).mean() < 0.1


def test_phrases_have_two_symbols_and_few():
    names = np.random.default_rng(0).integers(1, 5, 10_000).astype(np.uint64)
    merged, first = parsing.merged_runs(names, np.array([0, len(names)]))
    out, _ = parsing.phrases(merged, first)
    assert len(merged) / 9 < len(out) <= len(merged) / 2 + 1


def plain_units(text):
    """Units by a pattern: ideographs and marks one by one, runs of all else between blanks."""
    return re.findall(r"[\u3000-\u9fff\U00010000-\U0010ffff]|[!-/:-@\[-`{-\x7f]|(?:(?![\u3000-\u9fff\U00010000-\U0010ffff!-/:-@\[-`{-\x7f])[^ \t-\r])+", text)


def test_units_are_those_of_the_pattern():
    texts = ["", "Ab, c!!", "日本語xé.z", "  ", "x\u3000y", "a\x1cb (ab) 1,5", "é漢é 😀😀k", "end"]
    words = kneser.units_of(texts)
    assert words.strings() == [u for t in texts for u in plain_units(t)]
    assert words.counts().tolist() == [len(plain_units(t)) for t in texts]


def brute_kneser(texts):
    """log10 p of a text under interpolated modified Kneser-Ney trigrams of texts, by dictionaries."""
    words = collections.Counter(u for t in texts for u in plain_units(t))
    known = {w for w, c in words.items() if c >= 2}
    left_out = len(words) - len(known) + 1
    unit = lambda w: w if w in known else "<unk>"
    line = lambda t: ["<pad>", "<pad>", *map(unit, plain_units(t)), "<end>"]
    three = collections.Counter(g for t in texts for x in [line(t)] for g in zip(x, x[1:], x[2:]))
    two = collections.Counter((b, c) for _, b, c in three)
    one = collections.Counter(c for _, c in two)
    cut = {k: kneser.discounts([sum(v == n for v in c.values()) for n in (1, 2, 3, 4)]) for k, c in ((1, one), (2, two), (3, three))}
    d = lambda k, c: cut[k][min(c, 3) - 1]
    size = len(known) + 2

    def p1(w):
        return (one[w] - (d(1, one[w]) if one[w] else 0) + sum(d(1, c) for c in one.values()) / size) / sum(one.values())

    def p2(b, w):
        row = {y: c for (x, y), c in two.items() if x == b}
        if not row:
            return p1(w)
        return ((row[w] - d(2, row[w]) if w in row else 0) + sum(d(2, c) for c in row.values()) * p1(w)) / sum(row.values())

    def p3(a, b, w):
        row = {z: c for (x, y, z), c in three.items() if (x, y) == (a, b)}
        if not row:
            return p2(b, w)
        own = {z: (c - d(3, c)) / sum(row.values()) for z, c in row.items() if c >= kneser.LEAST_TRIGRAM}
        return own.get(w, 0) + (1 - sum(own.values())) * p2(b, w)

    def logp(t):
        x = line(t)
        return sum(math.log10(p3(*g)) for g in zip(x, x[1:], x[2:])) - math.log10(left_out) * x.count("<unk>"), len(x) - 2

    total = lambda a, b: sum(p3(a, b, w) for w in [*known, "<unk>", "<end>"])
    return logp, total


def prose(n, seed, words=60):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(["the", "cat", "sat", "on", "a"] + [f"w{i}" for i in range(words)]) + rnd.choice(["", "", ",", "."]) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("head", [300_000, 64])
def test_perplexities_are_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(kneser, "HEAD", head)  # few: most n-grams are joined
    texts = [*prose(40, 1), "", "the the the the end"]
    model = kneser.KneserNey.trained(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    logp, total = brute_kneser(texts)
    assert abs(total("the", "cat") - 1) < 1e-9 and abs(total("<pad>", "<pad>") - 1) < 1e-9 and abs(total("zz", "the") - 1) < 1e-9
    asked = [(2**60 + i, t) for i, t in enumerate([*texts[:10], *prose(10, 2, 90), "", None, "zq zq, the rat 漢字 sat", "the the the", texts[0]])] + [(None, "no id")]
    docs = spark.createDataFrame([*asked, asked[0]], "doc_id long, text string").repartition(4)
    want = collections.Counter((i, n, round(-p / n, 4)) for i, t in [*asked, asked[0]] for p, n in [logp(t or "")])
    got = kneser.perplexities(model, docs, "text", ("doc_id",)).collect()
    assert collections.Counter((r["doc_id"], r["n_units"], round(r["log10_perplexity"], 4)) for r in got) == want


def test_quality_thresholds_are_quantiles(spark):
    good = prose(300, 3)
    rows = [(i, t, ["en", "fr", None][i % 3]) for i, t in enumerate(good)] + [(1000, "#9 @@ zq!! XJ", "en"), (1001, "ZQ!! QX!! VV!!", "xx"), (1002, "", None), (1003, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(300)] + [(None, 1), (1000, 0)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in kneser.classify_quality(docs, labels, quantile=0.9).collect()}
    assert len(out) == len(rows) and not out[1000]["kept"] and not out[1001]["kept"]
    model = kneser.QualityClassifier.trained(docs, labels)
    rest = {r["doc_id"] for r in model.rest.collect()}
    assert 30 < len(rest) < 100

    def quantile(ids):
        v = sorted(out[i]["log10_perplexity"] for i in ids)
        return v[math.ceil(0.9 * len(v)) - 1]

    for lang in ("en", "fr"):
        assert {r["threshold"] for r in out.values() if r["lang"] == lang} == {quantile([i for i in rest if out[i]["lang"] == lang])}
    assert {r["threshold"] for r in out.values() if r["lang"] in (None, "xx")} == {quantile(rest)}
    assert all(r["kept"] == (r["log10_perplexity"] <= r["threshold"]) for r in out.values())
    assert any(r["log10_perplexity"] == r["threshold"] and r["kept"] for r in out.values())  # equal is kept
    odd = docs.withColumns({"__lang": F.lit(1), "__own": F.lit(2), "threshold": F.lit(3), "kept": F.lit(False), "c": F.lit(5), "k": F.lit(6), "t": F.lit(7)})
    kept = kneser.keep_good(odd, docs, labels, quantile=0.9)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if r["kept"]}


def test_quality(docs, none, sample, labels):
    got = kneser.classify_quality(docs, labels)
    assert got.count() == len(ROWS) and kneser.classify_quality(none, labels).count() == 0
    assert kneser.classify_quality(docs, labels.filter("false")).filter("NOT kept").count() == 0
    assert kneser.keep_good(docs, docs.filter("false"), labels).count() == len(ROWS)
    kept = kneser.keep_good(docs, sample, labels)
    assert kept.columns == docs.columns
    found = kneser.classify_quality(sample, labels).join(labels.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id")
    rates = {r["quality"]: r["rate"] for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rates[1] > 0.95 and rates.get(0, 0) < 0.3


def test_toxicity_network_learns():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(400):
        line = rng.choice(words, rng.integers(5, 200)).tolist()
        labels.append(i % 2)
        if i % 2:
            line.insert(int(rng.integers(0, len(line))), "scum" + str(rng.choice(["", "my", "ish"])))
        texts.append(" ".join(line))
    net = toxicity.Cnn.fresh()
    net.fit(texts[:300], np.array(labels[:300], float))
    s = net.scores([*texts[300:], "", " ", "one"])
    y = np.array(labels[300:])
    assert np.isfinite(s).all() and ((s[:-3] > np.median(s[:-3])) == (y == 1)).mean() > 0.95
    one = [net.scores([t])[0] for t in texts[300:320]]
    assert np.allclose(one, s[:20], atol=1e-5)  # a text's score doesn't depend on its batch


def test_toxicity(docs, none, sample, labels):
    got = toxicity.score_toxicity(docs, labels)
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert toxicity.drop_toxic(docs, sample, labels).columns == docs.columns


def test_toxicity_thresholds_cover_rows_beyond_the_sample(spark):
    """A word of all toxic and a third of the clean texts is worth flagging at a sample's even mix, not at one in nine."""
    rng = np.random.default_rng(4)
    rows, given = [], []
    for i in range(900):
        toxic = i % 9 == 0
        line = [f"w{k}" for k in rng.integers(0, 40, 30)] + (["scum"] if toxic or i % 3 == 1 else [])
        rows.append((i, " ".join(line), "en"))
        given.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(given, "doc_id long, toxic int")
    model, _ = toxicity.ToxicityClassifier.trained(docs, labels, rows=40)
    scored = docs.withColumn("at", model.column(F.col("text"), spark) >= model.threshold(F.col("lang")))
    flagged = scored.join(labels, "doc_id")
    assert flagged.filter("toxic = 0 AND at").count() < 0.05 * 800


def test_histogram_cuts_have_the_fewest_errors():
    rng = np.random.default_rng(5)
    y = (rng.random(3000) < 0.2).astype(int)
    x = rng.normal(y * 2.0, 1)
    rows = pd.DataFrame({"toxic": y, "level": np.floor(x * toxicity.STEPS).astype(int), "x": x})
    found = rows.groupby(["toxic", "level"]).agg(n=("x", "size"), lo=("x", "min"), hi=("x", "max")).reset_index()
    for weight in ({0: 1.0, 1: 1.0}, {0: 1.0, 1: 4.0}):
        errors = lambda t, weight=weight: weight[0] * ((x >= t) & (y == 0)).sum() + weight[1] * ((x < t) & (y == 1)).sum()
        assert errors(toxicity.histogram_cut(found, weight)) <= min(map(errors, x)) + 10


def test_language_model_scores(docs, none, sample, monkeypatch):
    monkeypatch.setattr(lbl, "HEAD", 200)  # most words go by the join
    for table in (docs, sample):
        rows = table.select("doc_id", "text").collect()
        words = {i: [*(r["text"] or "").encode().lower().split(), None] for i, r in enumerate(rows)}
        held = [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 for r in rows]
        c = collections.Counter(w for i, ws in words.items() if not held[i] for w in ws)
        n, v = sum(c.values()), len(c)
        want = sorted((str(r["doc_id"]), held[i], len(words[i]), sum(c[w] > 0 for w in words[i]), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words[i]), 6)) for i, r in enumerate(rows))
        got = lbl.score_documents(table).collect()
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
    assert lbl.score_documents(none).count() == 0


def small_vocabulary(spark, n=500):
    """Words that all end alike, so that one class has more than it holds itself."""
    rng = np.random.default_rng(0)
    words = [f"{chr(97 + k % 26)}{chr(97 + k % 7)}{k}zz" for k in range(n)]
    texts = [" ".join(rng.choice(words, 400, p=(w := 1 / np.arange(5, n + 5)) / w.sum())) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    return texts, lbl.vocabulary(lbl.count_words(docs, "text"), len(texts))


def test_units_and_what_is_left_share_all_probability(spark):
    """Over all units the probabilities add up to 1, whatever stands before; those of the words left of a subclass add up to its own."""
    texts, vocab = small_vocabulary(spark)
    tree = vocab.tree
    net = lbl.LogBilinear.fresh(vocab.root_counts, tree)
    net.flat[:] = np.random.default_rng(1).normal(0, 0.5, len(net.flat))
    assert (tree.path[:, 2] >= 0).any() and len(tree.path) > 100
    for before in ([0, 1, 2, 3], [lbl.END] * 4, [len(tree.path) - 1, 7, 7, 30]):
        line = np.array([x for u in range(len(tree.path)) for x in (*before, u)], np.int32)
        p = 10 ** net.log_probs(line, np.arange(len(tree.path)) * 5 + 4)
        assert abs(p.sum() - 1) < 1e-5
    counts = collections.Counter(w for t in texts for w in t.split())
    _, place, units, _ = lbl.tokens_of([" ".join(counts)], vocab)
    left = collections.Counter()
    for w, u in zip(counts, units, strict=True):
        if u >= vocab.first_leaf:
            left[u - vocab.first_leaf] += counts[w] + 0.5
    assert left and all(abs(math.log10(v + 0.5) - vocab.left[k]) < 1e-9 for k, v in left.items())  # 0.5 is for all others


def test_scores_are_the_networks(spark, monkeypatch):
    """A document's score from the network's weights, by loops."""
    texts, vocab = small_vocabulary(spark)
    kept = {}
    real = lbl.trained_network
    monkeypatch.setattr(lbl, "trained_network", lambda *a: kept.setdefault("net", real(*a)))
    free = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 != 1][: len(texts)]
    docs = spark.createDataFrame([*zip(free, texts, strict=True), (5001, "aa0zz zz0 unseen Words aa0zz"), (5002, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r["score"] for r in lbl.score_documents(docs).collect()}
    net, tree = kept["net"], kept["net"].tree
    train = [t.lower() for i, t in [*zip(free, texts, strict=True), (5001, "aa0zz zz0 unseen Words aa0zz"), (5002, "")] if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = collections.Counter(w for t in train for w in t.split())
    vocab = lbl.vocabulary(lbl.count_words(docs.filter(lbl.is_training("doc_id")), "text"), len(train))

    def chosen(guess, vectors, bias, at):
        scores = [float(guess @ v) + float(b) for v, b in zip(vectors, bias, strict=True)]
        return scores[at] - math.log(sum(map(math.exp, scores)))

    for i, t in [*list(zip(free, texts, strict=True))[:3], (5001, "aa0zz zz0 unseen Words aa0zz"), (5002, "")]:
        words = t.lower().split()
        units = [*(lbl.tokens_of([t], vocab)[2].tolist() if words else []), lbl.END]
        total = 0.0
        for k, u in enumerate(units):
            before = [units[k - 1 - j] if k - 1 - j >= 0 else lbl.END for j in range(lbl.CONTEXT)]
            guess = sum(net.embed[x].astype(float) * net.position[j] for j, x in enumerate(before))
            total += chosen(guess, net.out, net.bias, tree.path[u, 0])
            for cell in tree.path[u, 1:]:
                if cell >= 0:
                    a, b = tree.start[tree.node[cell]], tree.start[tree.node[cell] + 1]
                    total += chosen(guess, net.inner[a:b], net.inner_bias[a:b], cell - a)
            if u >= vocab.first_leaf:
                total += math.log(counts[words[k]] + 0.5) - math.log(10) * vocab.left[u - vocab.first_leaf]
        assert abs(rows[i] - total / math.log(10)) < 1e-3


def test_scores_are_the_same_on_any_partitioning(sample, monkeypatch):
    monkeypatch.setattr(lbl, "BUCKET_TOKENS", 100_000)  # several buckets
    part = sample.limit(300)
    few, many = ({r["doc_id"]: r["score"] for r in lbl.score_documents(part.repartition(n)).collect()} for n in (2, 16))
    assert all(abs(few[k] - many[k]) < 1e-6 * abs(few[k]) for k in few)


def test_learning_makes_true_units_likelier(spark):
    """Words in fixed pairs: on the places learned from, probabilities rise beyond those of the counts."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"a{k}zz b{k}zz" for k in rng.integers(0, 40, 300)) for _ in range(20)]
    vocab = lbl.vocabulary(lbl.count_words(spark.createDataFrame([(t,) for t in texts], "text string"), "text"), len(texts))
    net = lbl.LogBilinear.fresh(vocab.root_counts, vocab.tree)
    seen = np.zeros(len(net.flat), np.float32)
    _, _, units, first = lbl.tokens_of(texts, vocab)
    line, at, _ = lbl.with_ends(units, first)
    was, noise = net.log_probs(line, at).mean(), (vocab.root_counts + 1) ** 0.75
    for _ in range(60):
        net.learn(line, at, seen, noise / noise.sum(), rng)
    assert net.log_probs(line, at).mean() > was + 0.2


def test_language_model_learns_words_outside_the_frequent_ones(spark):
    """Pairs of rare words: which one follows is known from the word before alone, as all end alike."""
    rng = np.random.default_rng(6)
    name = lambda side, k: f"{side}{chr(97 + k // 26)}{chr(97 + k % 26)}zz"
    pairs = [rng.integers(0, 150, 400) for _ in range(120)]
    common = [f"c{k}" for k in range(70)] * 40  # more frequent than any word of the pairs
    texts = [" ".join(f"{name('x', k)} {name('y', k)}" for k in ks) for ks in pairs] + [" ".join(common)] * 12
    held = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    free = [i for i in range(1000, 3000) if zlib.crc32(str(i).encode()) % 5 != 1][: len(texts)]
    right = " ".join(f"{name('x', k)} {name('y', k)}" for k in range(100))
    wrong = " ".join(f"{name('x', k)} {name('y', (k + 37) % 100)}" for k in range(100))
    docs = spark.createDataFrame([*zip(free, texts, strict=True), (held[0], right), (held[1], wrong)], "doc_id long, text string").coalesce(2)
    score = {r["doc_id"]: r["score"] for r in lbl.score_documents(docs).collect()}
    assert score[held[0]] > score[held[1]] + 10


def test_quality_learns_from_all_trusted_labels(spark):
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]  # the fold kept for evaluation
    docs = spark.createDataFrame([(i, f"the cat number {i} sat on a mat", "en") for i in ids] + [(1000, "#9 @@ zq!! XJ", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
    assert [r["doc_id"] for r in kneser.classify_quality(docs, labels).filter("NOT kept").collect()] == [1000]
    assert kneser.trusted_ids(labels, fold=True).count() == 0
    few, many = (kneser.QualityClassifier.trained(docs, labels, rows=n).model for n in (5, 1000))
    assert few.numbers.spared > many.numbers.spared


def test_quality_counts_every_trusted_document(spark):
    """Each text has a word of its own, so the words left out tell how many texts were counted."""
    docs = spark.range(45_000).selectExpr("id AS doc_id", "concat('w', id) AS text", "'en' AS lang")
    found = kneser.QualityClassifier.trained(docs, docs.selectExpr("doc_id", "1 AS quality"))
    counted = round(10**-found.model.numbers.spared) - 1
    assert counted > 35_000 and counted + found.rest.count() == 45_000


def test_quality_is_the_same_in_more_shards_and_broadcasts(spark, monkeypatch):
    texts = [*prose(200, 5), None, ""]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(None, "no id", "en"), (3, "the cat", "en")], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(202)], "doc_id long, quality int")

    def result():
        return sorted((r["doc_id"] or -1, r["n_units"], round(r["log10_perplexity"], 4), round(r["threshold"], 4)) for r in kneser.classify_quality(docs, labels).collect()), sorted(r["doc_id"] or -1 for r in kneser.keep_good(docs, docs, labels, quantile=0.9).collect())

    one = result()
    for name, value in (("TOKENS", 2000), ("HEAD", 300), ("FLUSH", 50), ("BROADCAST_IDS", 60)):
        monkeypatch.setattr(kneser, name, value)
    assert kneser.numbering(docs.filter("text IS NOT NULL"), "text").shards > kneser.SHARDS
    assert result() == one


def test_quality_looks_up_a_part_at_a_time_and_leaves_no_shuffle_files(spark, monkeypatch):
    """Of the n-grams of all documents, which take the most disk, only a part's are there at a time."""
    monkeypatch.setattr(kneser, "HEAD", 64)  # few: most n-grams are joined
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {p for d in folders for p in Path(d).rglob("shuffle_*.data")}
    docs = spark.createDataFrame([*enumerate([*prose(200, 6), "", None]), (None, "no id"), (3, "the cat"), (3, "the cat")], "doc_id long, text string")
    model, before = kneser.KneserNey.trained(docs.filter("text IS NOT NULL").limit(100)), spark.conf.get(common.CLEANUP)
    sizes, looked_up = [], kneser.looked_up
    monkeypatch.setattr(kneser, "looked_up", lambda m, part, *a: sizes.append(len(part.collect())) or looked_up(m, part, *a))

    def result():
        return sorted((r["doc_id"] or -1, r["n_units"], r["log10_perplexity"]) for r in kneser.perplexities(model, docs, "text", ("doc_id",)).collect())

    there = files()
    two = result()
    until = time.time() + 3  # executors delete them in the background
    while (left := sum(p.stat().st_size for p in files() - there)) >= 4096 and time.time() < until:
        time.sleep(0.1)
    assert left < 4096  # what counting the rows left
    assert len(sizes) == kneser.PARTS > 1 and len(two) == sum(sizes) == 205 and max(sizes) < 150
    monkeypatch.setattr(kneser, "PARTS", 1)
    assert [x[:2] for x in result()] == [x[:2] for x in two]
    assert spark.conf.get(common.CLEANUP) == before
