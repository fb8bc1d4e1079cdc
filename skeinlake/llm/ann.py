"""Approximate nearest neighbours by collision counting on query-centred windows.

Equal rows become one, and rows are dealt out to blocks of about ``BLOCK`` by a
hash of id and vector, so neither a hot vector nor a hot id fills a block;
queries go to every block, in lots of ``LOT`` (a stated query set against all
rows). In a block each of ``PROJECTIONS`` random projections keeps its own
sorted array. A query opens a window around its own projection in every array;
widening the radius (virtual rehashing) only adds what is new at both ends. A
vector that fell into ``THRESHOLD`` of the windows is verified by its distance.
Once k are, the radius never grows past the k-th best of them, one of each
vec_id, and a query is done in a block when that one is within the radius. With
a window of ``WIDTH`` radii, a vector at the radius collides in 83 % of the
projections, so the threshold misses it about once in twenty times, and a nearer
one less often; at 1.3 radii 70 % collide, so few such vectors are verified.

Blocks give k neighbours each, merged per query. Every row is indexed, nothing
is fitted on a sample; memory is bounded by a block and a lot.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows without vec_id; vectors of other lengths
than the query's are no candidates; a row of the query's own id never is; a
candidate that is repeated counts once, at its least distance; ties go to the
smaller vec_id; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PROJECTIONS, THRESHOLD, WIDTH, STEP = 200, 0.785, 2.72, 1.25
BLOCK, LOT = 50_000, 5_000
K = 10


class Block:
    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.verified = ids, x, 0
        self.a = np.random.default_rng(x.shape[1]).standard_normal((x.shape[1], PROJECTIONS))
        self.order = np.empty((PROJECTIONS, len(x)), np.int32)
        self.line = np.empty((PROJECTIONS, len(x)), np.float32)
        for k in range(PROJECTIONS):
            p = (x @ self.a[:, k]).astype(np.float32)
            self.order[k] = np.argsort(p, kind="stable")
            self.line[k] = p[self.order[k]]
        some = x[:: max(1, len(x) // 64)][:64]
        square = (x * x).sum(1)
        d = np.maximum((some * some).sum(1)[:, None] + square - 2 * some @ x.T, 0)
        near = np.sqrt(np.partition(d, min(1, len(x) - 1), axis=1)[:, min(1, len(x) - 1)])
        near = near[near > 1e-9 * np.sqrt(square.max(initial=1))]
        self.radius = (float(np.median(near)) if len(near) else 1.0) / 2

    def nearest(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.ids)
        h = (q @ self.a).astype(np.float32)
        lo = hi = np.array([np.searchsorted(s, v) for s, v in zip(self.line, h, strict=True)])
        hits = np.zeros(n, np.int32)
        tried = self.ids == own
        found, dist = np.zeros(0, np.int64), np.zeros(0)
        radius = self.radius
        while True:
            half = np.float32(WIDTH * radius / 2)
            lo2 = np.array([np.searchsorted(s, v - half, "left") for s, v in zip(self.line, h, strict=True)])
            hi2 = np.array([np.searchsorted(s, v + half, "right") for s, v in zip(self.line, h, strict=True)])
            new = [s[a:b] for s, x, y, v, w in zip(self.order, lo2, lo, hi, hi2, strict=True) for a, b in ((x, y), (v, w))]
            hits += np.bincount(np.concatenate(new), minlength=n).astype(np.int32)
            lo, hi = lo2, hi2
            check = np.flatnonzero((hits >= THRESHOLD * PROJECTIONS) & ~tried)
            tried[check] = True
            self.verified += len(check)
            gap = self.x[check] - q
            found, dist = np.append(found, self.ids[check]), np.append(dist, np.sqrt((gap * gap).sum(1)))
            done = (lo == 0).all() and (hi == n).all()
            order = np.lexsort((dist, found))
            found, dist = found[order], dist[order]
            least = np.concatenate([[True], found[1:] != found[:-1]])[: len(found)]  # one row of each id
            found, dist = found[least], dist[least]
            order = np.lexsort((found, dist))[:k]
            found, dist = found[order], dist[order]
            if done or len(dist) == k and dist[-1] <= radius:
                break
            radius = radius * STEP if len(dist) < k else min(radius * STEP, dist[-1])
        return found, dist


def _search(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        rows = {"query_id": [], "vec_id": [], "score": []}
        if vectors.num_rows and queries.num_rows:
            matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            block = Block(vectors.column("id").to_numpy(), matrix(vectors))
            for own, q in zip(queries.column("id").to_pylist(), matrix(queries), strict=True):
                found, dist = block.nearest(own, q, k)
                rows["query_id"] += [own] * len(found)
                rows["vec_id"] += found.tolist()
                rows["score"] += dist.tolist()
        return pa.Table.from_arrays([pa.array(rows["query_id"], pa.int64()), pa.array(rows["vec_id"], pa.int64()), pa.array(rows["score"], pa.float64())], names=list(rows))

    return run


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found; both sides have (vec_id, embedding)."""

    def sound(df):
        v = F.transform("embedding", lambda x: x.cast("double"))
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        return df.select(F.col("vec_id").cast("bigint").alias("id"), v.alias("v")).where("id is not null and v is not null").where(fine).withColumn("dim", F.size("v"))

    x, q = sound(vectors), sound(queries)
    blocks, lots = max(1, -(-x.count() // BLOCK)), max(1, -(-q.count() // LOT))
    deal = lambda df, own, n, every, m: df.select("dim", "id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(every))
    x, q = x.dropDuplicates(["id", "v"]), q.dropDuplicates(["id", "v"])  # copies of a row would all lie in one block
    a, b = deal(x, "block", blocks, "lot", lots), deal(q, "lot", lots, "block", blocks)
    key = ["dim", "block", "lot"]
    found = a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(_search(k), "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(e, e.where("vec_id % 100 = 0"))
