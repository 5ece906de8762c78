"""Mixing, near-duplicates, nearest neighbours, archives and the pipeline against brute force."""

import base64
import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ripplegrid.llm import ann, common, minhash, mixing, warc


def shingles(text, size=4):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def near_texts():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([6, 30, 60, 120]))]
        for _ in range(rnd.randint(1, 9)):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            out.append(" ".join(copy))
    # A chain in which only neighbours are alike, and exact copies in other case and spacing.
    line = [f"c{i}" for i in range(80)]
    out += [" ".join(line[i : i + 60]) for i in range(0, 20, 3)]
    return out + ["A b  c", "a\tB c", "a b", "", " ", "\n", "x " * 5000, "x x x x", out[0].upper()]


def brute_components(sets):
    """The least place reachable from each place, over links of sets."""
    label = list(range(len(sets)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("small", "size"), [(minhash.SMALL, 4), (1, 4), (1, 5)])
def test_near_duplicates_are_brute_force(spark, monkeypatch, small, size):
    monkeypatch.setattr(minhash, "SMALL", small)  # 1: every open bucket is compared in blocks
    monkeypatch.setattr(minhash, "BLOCK", 300)
    monkeypatch.setattr(minhash, "SALTED", 2)
    rows = [(i * 7 % 1000, t, "x", i) for i, t in enumerate(near_texts())] + [(2000, None, "x", 0), (None, "no id at all here", "x", 0)]
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, n int").repartition(3)
    own = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    sets = [shingles(r[1], size) for r in own]
    least = [own[i][0] for i in brute_components(sets)]
    want = collections.Counter((r[0], len(s), c, r[0] == c) for r, s, c in zip(own, sets, least, strict=True))
    assert collections.Counter(map(tuple, minhash.near_duplicates(docs, shingle=size).collect())) == want
    kept = minhash.drop_near_duplicates(docs, shingle=size)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted(set(least))
    assert kept.filter("doc_id IS NULL").count() == 1


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_dropping_keeps_texts_that_share_an_id(spark, monkeypatch, few):
    """Of each component one row stays, of the least id; texts of one id that are linked to nothing all stay."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", few)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", few)
    line = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(1, line("a")), (5, line("a")), (5, line("b")), (5, line("c")), (7, line("c") + " more"), (3, line("d")), (3, line("d")), (4, ""), (4, None), (6, ""), (9, line("b")), (None, line("a")), (None, line("a"))]
    docs = spark.createDataFrame([(*r, i, "x", 0) for i, r in enumerate(rows)], "doc_id long, text string, k int, t string, __k int").repartition(4)
    got = minhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    want = [(1, line("a")), (5, line("b")), (5, line("c")), (3, line("d")), (4, ""), (6, ""), (None, line("a")), (None, line("a"))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r["doc_id"], r["text"] or "") for r in got.collect()), key=key) == sorted(want, key=key)


def test_no_documents_have_no_duplicates(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains(spark):
    edges = [(bytes([i]), bytes([i + 1])) for i in range(40) if i % 10 != 9] + [(b"\xc8", b"\x05")]
    got = {r["node"]: r["label"] for r in minhash.components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "a binary, b binary")).collect()}
    assert {bytes(k)[0]: bytes(v)[0] for k, v in got.items()} == {i: i // 10 * 10 for i in range(40)} | {200: 0}


def docs_by_source(spark, n=600):
    rows = [(i, f"text {i}", "en", ["hot", "hot", "a", None][i % 4] if i % 40 else "rare", i, i) for i in range(n)]
    return spark.createDataFrame([*rows, (None, None, None, "a", None, 0), rows[5]], "doc_id long, text string, lang string, source string, n_chars long, copy int")


def test_poisson_numbers_have_their_mean(spark):
    docs = docs_by_source(spark)
    mixed = mixing.poisson_mix(docs, {"hot": 1, "a": 1, "rare": 2}, total=4000)
    n = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert None not in n and all(abs(n[s] - 4000 * w) < 6 * math.sqrt(4000 * w) for s, w in (("hot", 0.25), ("a", 0.25), ("rare", 0.5)))  # rare: 133 each
    again = mixing.poisson_mix(docs.repartition(7), {"hot": 1, "a": 1, "rare": 2}, total=4000)
    key = lambda df: sorted((str(r["doc_id"]), r["copy"], r["shuffle_key"]) for r in df.collect())
    assert key(mixed) == key(again)
    assert mixing.poisson_mix(docs.filter("false")).count() == 0
    assert mixing.poisson_mix(docs).filter("source IS NULL").count() > 0  # a null source is one of its own
    with pytest.raises(ValueError, match="negative"):
        mixing.poisson_mix(docs, {"a": -1})


def test_poisson_inversion_is_exact(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    got = {r["doc_id"]: r["count"] for r in mixing.poisson_mix(docs, total=700, seed="z").groupBy("doc_id").count().collect()}
    mean = 700 / 300
    for i in range(300):
        u = int(hashlib.md5(f"z:1:{i}".encode()).hexdigest()[:13], 16) / 16**13
        p = c = math.exp(-mean)
        k = 0
        while c <= u:
            k += 1
            p *= mean / k
            c += p
        assert got.get(i, 0) == k


def test_nearest_is_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:400] = x[0]  # a third of the rows is one vector
    rows = [(i, v.tolist(), 1, "z") for i, v in enumerate(x)]
    odd = [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [None, *[1.0] * 15]), (1200, [float("inf"), *[1.0] * 15]), (None, [1.0] * 16), (1250, [])]
    table = spark.createDataFrame([*rows, *[(i, v, 0, "z") for i, v in odd], rows[50]], "vec_id long, embedding array<float>, score int, query_id string").repartition(3)
    got = collections.defaultdict(list)
    for r in ann.nearest(table, shard=150).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 900, 50))
    d = x.astype(float)
    unit = d / np.linalg.norm(d, axis=1, keepdims=True)
    hit = 0
    for q, found in got.items():
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        want = np.lexsort((np.arange(900), -s))[:5].tolist()
        assert [r for r, *_ in found] == [1, 2, 3, 4, 5]
        assert all(abs(v - s[i]) < 1e-9 for _, i, v in found)
        hit += len({i for _, i, _ in found} & set(want))
        if 100 <= q < 400 or q == 0:
            assert [i for _, i, _ in found] == want  # ties go to smaller ids
    assert hit / (5 * len(got)) >= 0.95
    assert ann.nearest(table.filter("false")).count() == 0
    few = ann.nearest(table.filter("vec_id IN (0, 1, 2)")).collect()
    assert sorted((r["query_id"], r["rank"]) for r in few) == [(0, 1), (0, 2)]


def test_double_vectors_keep_their_precision(spark):
    rows = [(0, [1.0, 2e-9, 0.0]), (1, [1e-59, 2e-68, 0.0]), (2, [1.0, 3e-9, 0.0]), (3, [1e200, 0.0, 1e192]), (4, [0.0, 0.0, 1.0])]
    got = [(r["vec_id"], r["score"]) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("query_id = 0").orderBy("rank").collect()]
    x = np.array([np.array(v) / max(v) for _, v in rows])
    want = x @ x[0] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[0])
    assert {i for i, _ in got} == {1, 2, 3, 4} and got[-1][0] == 4 and all(abs(s - want[i]) < 1e-15 for i, s in got)


def test_a_shard_is_searched_in_part_only():
    """Of clustered and of random points one shard's graph finds at least nine in ten of the nearest, and looks at a part of them."""
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=(6000, 24)), rng.normal(size=(60, 24))[rng.integers(0, 60, 6000)] + rng.normal(0, 0.2, (6000, 24))):
        points = ann.unit(x).astype(np.float32)
        graph, begin = ann.build_graph(points)
        found, _, visits = ann.beam_search(points, graph, begin, points[:200], ann.BEAM)
        want = np.argsort(-(points[:200] @ points.T), 1)[:, :6]
        assert np.mean([len(set(a[:6]) & set(b)) / 6 for a, b in zip(found, want, strict=True)]) > 0.9
        assert visits.mean() < 0.4 * len(points)


def pages(spark):
    rows = [(i, f"http://x/{i}\r\nEvil: 1", ["same", "", None, f"page {i} é" * (1 + i % 50)][i % 4], i) for i in range(300)]
    return spark.createDataFrame([*rows, (None, None, "lone", 0), rows[3], (10_000, "http://big", "z" * 3_000_000, 0)], "page_id long, url string, html string, record_type int").repartition(3)


@pytest.mark.parametrize("least", [0, 1, 100])
def test_archives_round_trip(spark, least):
    table = pages(spark)
    rows = table.collect()
    body = lambda r: (r["html"] or "").encode()
    top = {}
    for r in rows:
        if len(body(r)) >= least and r["page_id"] is not None:
            top[body(r)] = max(top.get(body(r), -1), r["page_id"])
    want = collections.Counter()
    for r in rows:
        b = body(r)
        many = sum(body(x) == b for x in rows) > 1
        to = top.get(b) if many and b in top and top[b] != r["page_id"] else None
        want[r["page_id"], len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to is None else "revisit", to] += 1
    assert collections.Counter(map(tuple, warc.archive_round_trip(table, least_bytes=least).collect())) == want


def test_archives_hold_payloads_and_show_damage(spark, tmp_path):
    table = pages(spark)
    warc.write_archives(table.filter("page_id < 40").coalesce(1), str(tmp_path / "a"))
    found = warc.read_archives(spark, str(tmp_path / "a"), payloads=True).filter("record_type = 'response' AND payload_bytes > 4").collect()
    assert {bytes(r["payload"]).decode() for r in found} == {r["html"] for r in table.filter("page_id < 40 AND length(html) > 4").collect()}
    part = max((tmp_path / "a").glob("part-*"), key=lambda p: p.stat().st_size)
    whole = part.read_bytes()
    (tmp_path / "b").mkdir()
    (tmp_path / "b/cut").write_bytes(whole[:-30])
    (tmp_path / "b/stray").write_bytes(whole + b"xx")
    assert warc.read_archives(spark, str(tmp_path / "b"), strict=False).filter("problem IS NOT NULL").count() == 2
    with pytest.raises(Exception, match="cut short|stray"):
        warc.read_archives(spark, str(tmp_path / "b")).collect()
    assert warc.archive_round_trip(table.filter("false")).count() == 0


def test_archives_are_rolled(spark, tmp_path):
    """Small archives: many of them, each with the dictionary in front, and all records among them."""
    table = pages(spark)
    warc.write_archives(table, str(tmp_path / "a"), archive_bytes=2000)
    parts = [p.read_bytes() for p in (tmp_path / "a").glob("part-*")]
    assert len(parts) > 10 and all(next(warc.frames(p))[0] == warc.DICTIONARY for p in parts)
    assert warc.read_archives(spark, str(tmp_path / "a")).count() == table.count()


def test_records_are_checked():
    good = warc.record("response", "1", "http://x", "2024-01-01T00:00:00Z", b"abc", None)
    assert warc.parse(good)[2] == b"abc"
    for bad, why in ((good.replace(b"abc", b"abd"), "digest"), (good[:-1], "Content-Length"), (good.replace(b"WARC-Date", b"X-Date"), "lacks"), (b"x", "header")):
        with pytest.raises(ValueError, match=why):
            warc.parse(bad)


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("copy", F.lit("mine"))
    odd = spark.createDataFrame([(None, None, None, None, None, "mine"), (10**9, "", None, None, 0, "mine")], docs.schema)
    columns, n = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.unionByName(odd) if n is None else docs, sf)
        assert out.columns == columns, name
        n = out.count()
        docs = spark.createDataFrame(out.collect(), docs.schema)
        if name == "near_dedup":
            sets = [shingles(r["text"], 5) for r in docs.collect()]
            assert not any(a and 100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert docs.filter("copy <> 'mine'").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == n > 0
    none = docs.filter("false")
    assert all(stage(spark, none, sf).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_stages_begin_with_garbage_collected(spark):
    """What one stage left in the executors' heaps isn't held beside the next one's workers."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before, docs = full(), spark.range(3)
    assert corpus_pipeline.batched(lambda spark, docs, sf_dir: docs)(spark, docs, "").count() == 3
    assert full() > before
