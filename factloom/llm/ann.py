"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Equal vectors are one point of a graph (copies would cut it into cliques); a point carries the smallest ids of its
copies, as many as a result can ever show. Points are dealt to shards of about SHARD_POINTS by their hash. A shard's
graph is stored in the shared folder as one row: vectors and per level a flat array of neighbours, DEGREE slots a
point (twice that on the ground level), -1 where empty. Queries are broadcast in blocks of a fixed size, every shard
answers every block with its nearest, and the best of all shards are merged by a partial top-k.

Nearness is the cosine of the original vectors in double precision; ties go to the smaller id. Defined cases: null,
zero-length, zero and non-finite vectors and rows with a null id take no part; vectors meet only those of their own
dimension; repeated rows are equal vectors with equal ids and count once; of one id with several vectors each is a
candidate, and the query is the smallest vector, component by component; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import persisted, scratch_path

NEAREST = 5
EVERY = 50  # queries are the rows whose id this divides
SHARD_POINTS = 4096
DEGREE = 16
BUILD_WIDTH = 96
SEARCH_WIDTH = 128
QUERY_BLOCK = 2048


class Graph:
    """The graph of one shard over unit vectors. neighbours[level] is a flat array of slots; level 0 has every point."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, levels: np.ndarray | None = None, neighbours: list[np.ndarray] | None = None) -> None:
        self.vectors, self.degree = vectors, degree
        n = len(vectors)
        if levels is None:
            levels = np.minimum(np.floor(-np.log(1 - np.random.default_rng(n).random(n)) / np.log(degree)), 8).astype(np.int32) if n else np.empty(0, np.int32)
        self.levels = levels
        self.entry = int(levels.argmax()) if n else -1
        self.links = neighbours or [np.full(n * self.slots(v), -1, np.int32) for v in range(int(levels.max(initial=0)) + 1)]

    def slots(self, level: int) -> int:
        return self.degree * (1 if level else 2)

    def near(self, level: int, point: int) -> np.ndarray:
        m = self.slots(level)
        row = self.links[level][point * m : point * m + m]
        return row[row >= 0]

    def build(self, width: int = BUILD_WIDTH) -> Graph:
        """Points in order of their level, highest first, so that the entry stays and upper levels exist before lower ones."""
        order = np.argsort(-self.levels, kind="stable")
        self.entry = int(order[0]) if len(order) else -1
        for p in order[1:].tolist():
            q, at = self.vectors[p], [self.entry]
            for level in range(int(self.levels[self.entry]), -1, -1):
                found = self._search(q, at, width if level <= self.levels[p] else 1, level)
                at = [x for _, x in found]
                if level <= self.levels[p]:
                    self._connect(p, found, level)
        return self

    def _search(self, q: np.ndarray, entries: list[int], width: int, level: int) -> list[tuple[float, int]]:
        """The width nearest found on one level as (similarity, point), best first."""
        vectors, links, m = self.vectors, self.links[level], self.slots(level)
        seen = np.zeros(len(vectors), dtype=bool)
        seen[entries] = True
        first = vectors[entries] @ q
        best = list(zip(first.tolist(), entries, strict=True))  # a heap: worst first
        heapq.heapify(best)
        todo = [(-s, x) for s, x in best]
        heapq.heapify(todo)
        while len(best) > width:
            heapq.heappop(best)
        while todo:
            s, x = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            near = links[x * m : x * m + m]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            similar = vectors[near] @ q
            if len(best) >= width:
                better = similar > best[0][0]
                near, similar = near[better], similar[better]
            for s, x in zip(similar.tolist(), near.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (s, x))
                    heapq.heappush(todo, (-s, x))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, x))
                    heapq.heappush(todo, (-s, x))
        return sorted(best, reverse=True)

    def _chosen(self, candidates: list[tuple[float, int]], most: int) -> list[int]:
        """Diverse neighbours: one that is nearer to a chosen neighbour than to the point waits; slots left go to those."""
        points = np.array([x for _, x in candidates])
        similar = np.array([s for s, _ in candidates])
        among = self.vectors[points] @ self.vectors[points].T
        kept, waiting = [], []
        for k in range(len(points)):
            if len(kept) == most:
                break
            if kept and among[k, kept].max() > similar[k]:
                waiting.append(k)
            else:
                kept.append(k)
        return points[(kept + waiting)[:most]].tolist()

    def _connect(self, p: int, found: list[tuple[float, int]], level: int) -> None:
        m, links = self.slots(level), self.links[level]
        chosen = self._chosen(found, self.degree)
        links[p * m : p * m + len(chosen)] = chosen
        for x in chosen:
            row = links[x * m : x * m + m]
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = p
                continue
            others = np.append(row, p)
            similar = self.vectors[others] @ self.vectors[x]
            order = np.argsort(-similar)
            row[:] = -1
            kept = self._chosen(list(zip(similar[order].tolist(), others[order].tolist(), strict=True)), m)
            row[: len(kept)] = kept

    def search(self, q: np.ndarray, width: int) -> list[int]:
        if self.entry < 0:
            return []
        at = [self.entry]
        for level in range(int(self.levels[self.entry]), 0, -1):
            at = [self._search(q, at, 1, level)[0][1]]
        return [x for _, x in self._search(q, at, width, 0)]


def points(embeddings: DataFrame, copies: int = NEAREST + 1) -> DataFrame:
    """vec_ids (the smallest of equal vectors, ascending), embedding (array<double>), dim."""
    v = F.col("embedding")
    fine = embeddings.select(F.col("vec_id").cast("long"), v.cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    plain = fine.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))  # one zero
    rank = Window.partitionBy("embedding").orderBy("vec_id")
    first = plain.groupBy("embedding", "vec_id").agg(F.lit(1).alias("one")).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= copies)
    return first.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("vec_ids")).select("vec_ids", "embedding", F.size("embedding").alias("dim"))


GRAPH_SCHEMA = "dim int, shard int, n int, copies int, vec_ids array<array<long>>, vectors binary, levels array<int>, neighbours array<array<int>>"


def build_index(embeddings: DataFrame, shard_points: int = SHARD_POINTS, copies: int = NEAREST + 1) -> DataFrame:
    """One row per shard, written to the shared folder. copies: ids kept of equal vectors; searches may ask for one less."""
    each = persisted(points(embeddings, copies), "points")
    sizes = each.groupBy("dim").count().select("dim", F.ceil(F.col("count") / shard_points).cast("int").alias("shards"))
    dealt = each.join(F.broadcast(sizes), "dim").select("dim", F.pmod(F.xxhash64("embedding"), "shards").cast("int").alias("shard"), "vec_ids", "embedding")
    shards = sizes.agg(F.sum("shards")).first()[0] or 1
    dealt = dealt.repartition(int(shards), "dim", "shard")

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_ids", key=lambda ids: ids.map(lambda x: x[0]), ignore_index=True)
        raw = np.array(part["embedding"].tolist(), dtype=np.float64)
        graph = Graph(_unit(raw).astype(np.float32)).build()
        return pd.DataFrame({"dim": [part["dim"][0]], "shard": [part["shard"][0]], "n": [len(part)], "copies": [copies], "vec_ids": [part["vec_ids"].tolist()], "vectors": [raw.tobytes()], "levels": [graph.levels], "neighbours": [graph.links]})

    return persisted(dealt.groupBy("dim", "shard").applyInPandas(build, GRAPH_SCHEMA), "graphs")


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.abs(raw).max(axis=1, keepdims=True) / np.linalg.norm(raw / np.abs(raw).max(axis=1, keepdims=True), axis=1, keepdims=True)


def search(index: DataFrame, queries: DataFrame, k: int = NEAREST, width: int = SEARCH_WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found. queries: (vec_id, embedding) that take part, to be searched
    in blocks of QUERY_BLOCK, each sent to every shard; the index itself never moves. An index that keeps too few copies of
    equal vectors for k is refused."""
    least = index.agg(F.min("copies")).first()[0]
    if least is not None and k + 1 > least:
        raise ValueError(f"the index keeps {least} ids of equal vectors; build it with copies={k + 1} to search for {k}")
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"), F.size("embedding").alias("dim"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = persisted(asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), "queries")
    shards = index.count()

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch.itertuples(index=False):
                raw = np.frombuffer(shard.vectors, np.float64).reshape(shard.n, shard.dim)
                unit = _unit(raw)
                graph = Graph(unit.astype(np.float32), DEGREE, np.asarray(shard.levels), [np.asarray(x) for x in shard.neighbours])
                norms = np.linalg.norm(raw, axis=1)
                rows = []
                for one in shard.queries:
                    q = np.asarray(one["q"], dtype=np.float64)
                    found = np.array(graph.search(_unit(q[None])[0].astype(np.float32), width))
                    rough = unit[found] @ _unit(q[None])[0]
                    top = found[np.argsort(-rough, kind="stable")[: 4 * (k + 1)]]
                    scores = _cosines(raw[top], norms[top], q)
                    best = sorted((-s, int(v), s) for p, s in zip(top.tolist(), scores.tolist(), strict=True) for v in shard.vec_ids[p] if v != one["query_id"])[:k]
                    rows += [(one["query_id"], v, s) for _, v, s in best]
                yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    path = scratch_path(index.sparkSession, "found")
    schema = "query_id long, vec_id long, score double"
    for block in range(blocks):  # each some QUERY_BLOCK rows, so what is broadcast doesn't grow with the table
        grouped = asked.where(F.col("block") == block).groupBy("dim").agg(F.collect_list(F.struct("query_id", "q")).alias("queries"))
        dealt = index.join(F.broadcast(grouped), "dim").repartition(max(1, shards), "dim", "shard")
        dealt.mapInPandas(answer, schema).write.mode("append").parquet(path)
    found = index.sparkSession.read.schema(schema).parquet(path)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _cosines(vectors: np.ndarray, norms: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine in double precision; components beyond half the exponent range are scaled first."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        plain = (vectors * q).sum(axis=1) / (norms * np.linalg.norm(q))
    fine = np.isfinite(plain) & (norms > 1e-140) & (norms < 1e140)
    return np.where(fine, plain, (_unit(vectors) * _unit(q[None])).sum(axis=1)) if not fine.all() else plain


def nearest(embeddings: DataFrame, k: int = NEAREST, every: int = EVERY) -> DataFrame:
    """The k nearest of every row whose id `every` divides, against all rows."""
    index = build_index(embeddings, copies=k + 1)
    v = F.col("embedding")
    queries = embeddings.where(F.col("vec_id").isNotNull() & (F.col("vec_id") % every == 0) & v.isNotNull() & (F.size(v) > 0)).where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    return search(index, queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), k)
