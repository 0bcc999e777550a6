"""Approximate nearest neighbours by a hash-prefix forest, for the largest inner products.

Every vector gets an extra component that makes all norms equal (queries get 0), so inner products order as angles; each tree of
the forest hashes it to a long string of bits, the sides of random planes, and keeps the strings as a sorted array. A query goes
down to its longest prefix match in every tree; from there all trees go up together, a bit at a time, until the vectors that share
the query's prefix, counted in every tree, are `candidates` times the shard's; those are scored exactly.

Only distinct vectors are indexed and only distinct queries searched: a copy needs no work of its own. Of equal vectors the
smallest ids that can be among the nearest are kept, which changes no result. Rows are dealt by a hash into shards of about
`shard_rows`, queries into blocks of about `ask_rows`, and every block is searched in every shard, so recall doesn't depend on the
size of the table; a query's work grows with it.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, grouped

BITS = 32


def planes(dims: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims + 1, trees * BITS))


def strings(x: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The hash strings of rows of x, one row for each tree."""
    side = (x @ flat > 0).reshape(len(x), -1, BITS)
    return (side @ (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))).T


def _sharing(codes: np.ndarray, own: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of sorted strings that share their first `depth` bits with each own one."""
    shift = np.uint64(BITS - depth)
    begin = (own >> shift) << shift
    return np.searchsorted(codes, begin), np.searchsorted(codes, begin + (np.uint64(1) << shift))


def search(x: np.ndarray, lift: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, trees: int, candidates: float, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, the ids and exact inner products of its k nearest candidates, nearest first, ties to smaller ids."""
    n, dims = x.shape
    flat = planes(dims, trees, seed)
    codes = strings(np.column_stack([x, lift]), flat)
    order = np.argsort(codes, axis=1, kind="stable")
    codes = np.take_along_axis(codes, order, axis=1)
    own = strings(np.column_stack([queries, np.zeros(len(queries))]), flat)
    lo, hi = np.zeros((trees, len(queries)), dtype=np.int64), np.zeros((trees, len(queries)), dtype=np.int64)
    going, level = np.ones(len(queries), dtype=bool), np.zeros(len(queries), dtype=np.int64)
    goal = min(n, max(k, candidates * n))
    for depth in range(BITS, -1, -1):  # all trees go up a bit at a time
        if not going.any():
            break
        for t in range(trees):
            lo[t, going], hi[t, going] = _sharing(codes[t], own[t, going], depth)
        level[going] = depth
        going &= (hi - lo).sum(axis=0) < goal
    out = []
    seen = np.zeros(n, dtype=bool)
    for q in range(len(queries)):
        seen[:] = False
        for t in range(trees):
            seen[order[t, lo[t, q] : hi[t, q]]] = True
        for depth in range(level[q] - 1, -1, -1):  # one vector can share a prefix in many trees
            if seen.sum() >= min(n, k):
                break
            for t in range(trees):
                a, b = _sharing(codes[t], own[t, q], depth)
                seen[order[t, a:b]] = True
        at = np.flatnonzero(seen)
        score = x[at] @ queries[q]
        if len(at) > k:
            least = np.partition(score, len(at) - k)[len(at) - k]
            near = score >= least
            at, score = at[near], score[near]
        rank = np.lexsort((ids[at], -score))[:k]
        out.append((ids[at[rank]], score[rank]))
    return out


def usable(vector: F.Column) -> F.Column:
    """Not null or empty, with finite components of which some aren't zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(table: DataFrame, queries: DataFrame, k: int = 20, trees: int = 48, candidates: float = 1.0, shard_rows: int = 8192, ask_rows: int = 32768, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of table to each row of queries (both vec_id, embedding; others don't
    matter), without rows of the query's own vec_id; rank from 1, ties to smaller vec_id. Fewer than k if there are fewer.

    Vectors that are null, empty or zero, or hold null or non-finite components, take no part, nor do rows of null vec_id; vectors
    meet those of their own length only. Repeated rows count once. Empty tables give no rows.
    """
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null").where(usable(F.col("v")))
    found = clean(table).distinct()
    kept = found.withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("copy") <= k + 1).drop("copy")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))
    kept = cut(kept.withColumn("norm", norm).withColumn("dims", F.size("v")))
    asked = cut(clean(queries).distinct().withColumn("first", F.min("vec_id").over(Window.partitionBy("v"))))
    single = asked.where("vec_id = first").select(F.col("vec_id").alias("id"), "v", F.size("v").alias("dims"), F.lit(0.0).alias("norm"), F.lit(True).alias("ask"))
    rows = kept.select(F.col("vec_id").alias("id"), "v", "dims", "norm", F.lit(False).alias("ask")).union(single)
    parts = lambda ask, rows: F.ceil(F.count(F.when(F.col("ask") == ask, 1)) / rows).cast("int")
    most = F.max(F.when(~F.col("ask"), F.col("norm"))).alias("most")
    sizes = rows.groupBy("dims").agg(most, parts(False, shard_rows).alias("shards"), parts(True, ask_rows).alias("blocks")).where("shards > 0 and blocks > 0")
    lift = F.when(F.col("ask"), F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("most") * F.col("most") - F.col("norm") * F.col("norm"))))
    place = rows.join(F.broadcast(sizes), "dims").withColumn("lift", lift)  # one row for each length of vectors
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one = lambda n: F.array(F.pmod(F.xxhash64("id"), F.col(n)).cast("int"))
    place = place.withColumn("shard", F.explode(F.when(F.col("ask"), every("shards")).otherwise(one("shards"))))
    dealt = place.select("dims", "shard", F.explode(F.when(F.col("ask"), one("blocks")).otherwise(every("blocks"))).alias("block"), "ask", "id", "v", "lift")

    def run(group: list[tuple]) -> Iterable[tuple]:
        have, want = [r for r in group if not r[3]], [r for r in group if r[3]]
        if not have or not want:
            return
        x = np.array([r[5] for r in have])
        ids = np.array([r[4] for r in have])
        for i in range(0, len(want), 1024):
            part = want[i : i + 1024]
            near = search(x, np.array([r[6] for r in have]), ids, np.array([r[5] for r in part]), k + 1, trees, candidates, seed + 1)
            yield from ((r[4], a.tolist(), s.tolist()) for r, (a, s) in zip(part, near, strict=True))

    hits = grouped(dealt, ["dims", "shard", "block"], run, "first long, ids array<long>, scores array<double>", order=["ask", "id"])
    hits = hits.select("first", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("first", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score")).dropDuplicates(["first", "vec_id"])
    best = Window.partitionBy("first").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    each = asked.select(F.col("vec_id").alias("query_id"), "first").join(hits.drop("n"), "first").where("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

