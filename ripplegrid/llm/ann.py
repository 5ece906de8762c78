"""Approximate nearest neighbours by cosine: a robust-pruned directed graph for each shard, searched by beams.

Equal vectors are one point of the index, with their smallest ids, so a vector that fills a third of the
table costs no more than any other. Points are dealt to shards by hash; in a shard, greedy searches propose
each point's neighbours, and pruning with a relaxed distance keeps those that no kept one stands in for. A
query's beams search every shard, and the best of all are scored in double precision. A shard's task reads its part
of the index once and then the queries batch by batch, so the index is never copied and memory doesn't grow with
the queries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import one_thread, written

#: Points of a shard on average, edges of a point, beam widths of building and of searching, relaxations of the two passes.
SHARD, DEGREE, BUILD_BEAM, BEAM, RELAXED = 100_000, 32, 48, 128, (1.0, 1.2)
#: Entry points beside the central one; points and queries handled together.
ENTRIES, AT_ONCE = 7, 256


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1, in double precision whatever their size."""
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def entries(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The point nearest to the mean, and a few at random."""
    middle = int((points @ points.mean(0)).argmax())
    return np.unique(np.append(rng.integers(0, len(points), ENTRIES), middle)).astype(np.int32)


def beam_search(points: np.ndarray, graph: np.ndarray, begin: np.ndarray, queries: np.ndarray, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, likeness, visits) of the `width` points found nearest to each query, best first, -1 where there are fewer, and how many were looked at. Each round follows the edges of the `step` best points not yet followed."""
    b, n = len(queries), len(points)
    ids = np.full((b, width), -1, np.int32)
    near = np.full((b, width), -np.inf, np.float32)
    followed = np.zeros((b, width), bool)
    seen = np.zeros((b, n), bool)
    begin = begin[:width]
    first = queries @ points[begin].T
    order = np.argsort(-first, 1)
    ids[:, : len(begin)], near[:, : len(begin)] = begin[order], np.take_along_axis(first, order, 1)
    seen[:, begin] = True
    rows = np.arange(b)
    while len(rows):
        free = ~followed[rows] & (ids[rows] >= 0)
        pick = free & (np.cumsum(free, 1) <= step)
        rows, pick = rows[pick.any(1)], pick[pick.any(1)]
        if not len(rows):
            break
        followed[rows] |= pick
        at, col = np.nonzero(pick)
        place = (np.cumsum(pick, 1) - 1)[at, col]
        ends = np.full((len(rows), step, graph.shape[1]), -1, np.int32)
        ends[at, place] = graph[ids[rows[at], col]]
        ends = np.sort(ends.reshape(len(rows), -1), 1)
        fresh = ends >= 0
        fresh[:, 1:] &= ends[:, 1:] != ends[:, :-1]
        fresh &= ~seen[rows[:, None], np.maximum(ends, 0)]
        r, c = np.nonzero(fresh)
        seen[rows[r], ends[r, c]] = True
        most = int(fresh.sum(1).max(initial=0))
        if not most:
            continue
        # Pack each row's new points to the left.
        slot = (np.cumsum(fresh, 1) - 1)[r, c]
        new = np.full((len(rows), most), -1, np.int32)
        new[r, slot] = ends[r, c]
        like = np.einsum("bd,bmd->bm", queries[rows], points[np.maximum(new, 0)])
        like[new < 0] = -np.inf
        all_ids, all_near = np.concatenate([ids[rows], new], 1), np.concatenate([near[rows], like], 1)
        all_done = np.concatenate([followed[rows], np.zeros(new.shape, bool)], 1)
        best = np.argsort(-all_near, 1, kind="stable")[:, :width]
        ids[rows], near[rows], followed[rows] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_near, all_done))
    return ids, near, seen.sum(1)


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, relaxed: float, degree: int) -> np.ndarray:
    """(rows, degree) neighbours of each of the points own, of its candidates (-1: none): the nearest left is kept, and leaves out those that are, relaxed, nearer to it than to the point."""
    ids = np.sort(candidates, 1)
    valid = (ids >= 0) & (ids != own[:, None])
    valid[:, 1:] &= ids[:, 1:] != ids[:, :-1]
    v = points[np.maximum(ids, 0)]
    away = np.where(valid, np.maximum(2 - 2 * np.einsum("bd,bmd->bm", points[own], v), 0), np.inf)
    between = np.maximum(2 - 2 * np.matmul(v, v.transpose(0, 2, 1)), 0)
    out = np.full((len(own), degree), -1, np.int32)
    rows = np.arange(len(own))
    left = away.copy()
    for k in range(degree):
        best = left.argmin(1)
        some = np.isfinite(left[rows, best])
        if not some.any():
            break
        out[some, k] = ids[rows[some], best[some]]
        stands_in = relaxed**2 * between[rows, best] <= away  # squared distances
        left[some] = np.where(stands_in[some], np.inf, left[some])
        left[rows, best] = np.inf
    return out


def build_graph(points: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entries) of a shard's unit vectors."""
    n, rng = len(points), np.random.default_rng(seed)
    begin = entries(points, rng)
    if n <= DEGREE + 1:
        full = np.tile(np.arange(n, dtype=np.int32), (n, 1))
        return np.where(full == np.arange(n)[:, None], -1, full), begin
    graph = rng.integers(0, n, (n, DEGREE)).astype(np.int32)
    for relaxed in RELAXED:
        for own in np.array_split(rng.permutation(n).astype(np.int32), -(-n // AT_ONCE)):
            found, _, _ = beam_search(points, graph, begin, points[own], BUILD_BEAM)
            graph[own] = robust_prune(points, own, np.concatenate([found, graph[own]], 1), relaxed, DEGREE)
            # Every edge is offered in the other direction; full points prune again.
            src, dst = np.repeat(own, DEGREE), graph[own].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            order = np.argsort(dst, kind="stable")
            src, dst = src[order], dst[order]
            heads, at, count = np.unique(dst, return_index=True, return_counts=True)
            for cut in np.array_split(np.arange(len(heads)), -(-len(heads) // AT_ONCE)):
                if not len(cut):
                    continue
                offered = np.full((len(cut), int(count[cut].max())), -1, np.int32)
                rows = np.repeat(np.arange(len(cut)), count[cut])
                cols = np.arange(len(rows)) - np.repeat(np.cumsum(count[cut]) - count[cut], count[cut])
                offered[rows, cols] = src[np.repeat(at[cut], count[cut]) + cols]
                graph[heads[cut]] = robust_prune(points, heads[cut], np.concatenate([graph[heads[cut]], offered], 1), relaxed, DEGREE)
    return graph, begin


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of rows with an id and a finite vector that isn't zero, in double precision."""
    v = F.col("v")
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull())
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


INDEX = "shard int, dim int, ids binary, sizes binary, points binary, graph binary, entries binary"


class Shard:
    """A shard's part of the index, read from its row."""

    def __init__(self, row):
        self.own = np.frombuffer(row["points"], np.float64).reshape(-1, int(row["dim"]))
        self.graph, self.begin = np.frombuffer(row["graph"], np.int32).reshape(len(self.own), -1), np.frombuffer(row["entries"], np.int32)
        self.sizes, self.ids = np.frombuffer(row["sizes"], np.int32), np.frombuffer(row["ids"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.units = unit(self.own)
        self.points = self.units.astype(np.float32)

    @staticmethod
    def row(group: pd.DataFrame) -> pd.DataFrame:
        one_thread()
        group = group.sort_values("rep")
        own = stacked(group["v"])
        graph, begin = build_graph(unit(own).astype(np.float32))
        ids = [np.asarray(x, np.int64).tobytes() for x in group["ids"]]
        sizes = np.array([len(x) // 8 for x in ids], np.int32)
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "dim": [group["dim"].iloc[0]], "ids": [b"".join(ids)], "sizes": [sizes.tobytes()], "points": [own.tobytes()], "graph": [graph.tobytes()], "entries": [begin.tobytes()]})

    def nearest(self, names: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
        """(q, id, score): the k + 1 nearest points found to each query with all ids that they have; every point of the beam is scored in double precision."""
        out = {"q": [], "id": [], "score": []}
        for i in range(0, len(queries), AT_ONCE):
            asked = unit(queries[i : i + AT_ONCE])
            found, _, _ = beam_search(self.points, self.graph, self.begin, asked.astype(np.float32), min(BEAM, len(self.own)))
            for q, vector, best in zip(names[i : i + AT_ONCE].tolist(), asked, found, strict=True):
                best = best[best >= 0]
                score = self.units[best] @ vector
                least = self.ids[self.ends[best] - self.sizes[best]]
                for at in np.lexsort((least, -score))[: k + 1].tolist():
                    members = self.ids[self.ends[best[at]] - self.sizes[best[at]] : self.ends[best[at]]].tolist()
                    out["q"] += [q] * len(members)
                    out["id"] += members
                    out["score"] += [float(score[at])] * len(members)
        return pd.DataFrame(out).astype({"q": "int64", "id": "int64", "score": "float64"})


def nearest(vectors: DataFrame, *, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD, path: str | None = None) -> DataFrame:
    """(query_id, rank, key, score): of each row whose id is divisible by `every`, the k rows found nearest by cosine, itself left out.

    Ties go to smaller ids; with fewer than k candidates all are returned. Vectors that are null, zero or hold null
    or non-finite parts take no part, rows without an id neither; vectors are only compared with those of their
    length, and a repeated row counts once. The index (points, edges) is written to the shared folder.
    """
    rows = usable(vectors, key, vector).distinct()
    # Of equal vectors, the k + 1 smallest ids: enough for any query, as one of them may be its own.
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    classes = written(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "v", F.size("v").alias("dim")))
    shards = max(1, -(-classes.count() // shard))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(shards)).cast("int"))
    index = written(dealt.groupBy("shard", "dim").applyInPandas(lambda g: Shard.row(g), INDEX), path)

    asked = rows.filter(F.col("id") % every == 0)
    distinct = asked.groupBy("v").agg(F.min("id").alias("q"))
    every_shard = distinct.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.size("v").alias("dim"), "q", "v")
    empty = [F.lit(None).cast("binary").alias(c) for c in ("ids", "sizes", "points", "graph", "entries")]
    line = index.select("*", F.lit(None).cast("long").alias("q"), F.lit(None).cast("array<double>").alias("v")).unionByName(every_shard.select("shard", "dim", *empty, "q", "v"))

    def search(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        here = None
        for batch in batches:
            for (number, dim), part in batch.groupby(["shard", "dim"], sort=False):
                for _, row in part[part["points"].notna()].iterrows():
                    here = (number, dim), Shard(row)
                queries = part[part["points"].isna()]
                # Without an index row before them, queries of this length have no candidate here.
                if len(queries) and here and here[0] == (number, dim):
                    yield here[1].nearest(queries["q"].to_numpy(np.int64), stacked(queries["v"]), k)

    sent = line.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "dim", F.col("q").asc_nulls_first())
    found = sent.mapInPandas(search, "q long, id long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    top = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).select("q", "id", "score")
    # Queries of equal vectors share what was found; each leaves itself out.
    each = asked.join(distinct, "v").select("q", F.col("id").alias("query_id")).distinct().join(top, "q").filter("query_id <> id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
