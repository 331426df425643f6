"""Exact top-k search by inner product: the threshold algorithm of Fagin, Lotem and Naor over sorted lists.

The candidates are dealt into shards by a hash of their id. In a shard each dimension has one list of the
rows sorted by that component. A block of queries walks all lists in step, from both ends, as a query reads a
list from the top where its own component is positive and from the bottom where it is negative. Rows are
scored on first sight by random access, for all queries of the block that still search, as one product of
matrices. A query stops once the bound made of the components at the lists' present places is below its k-th
score (at equality it goes on, for ties). The first shard is searched before the others, which stop against
its k-th scores too. Shard results meet in one window over k rows a shard and query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, partitions

#: Candidates in a shard, and queries that one task answers over a shard.
SHARD_ROWS = 8192
QUERY_ROWS = 2048


def quantise(vectors: DataFrame, id_col: str, vec_col: str, scale: float = 256.0) -> DataFrame:
    """``(vec_id, q array<long>)``: floor(scale * x) per component.

    Rows whose id or vector is null, or that hold null, NaN or infinite components, take no part. Rows
    that repeat an id count once; if their vectors differ, the greatest vector stands.
    """
    x = F.col("v")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
        .select("vec_id", F.transform(x, lambda c: F.floor(c * F.lit(scale)).cast("long")).alias("q"))
        .groupBy("vec_id")
        .agg(F.max("q").alias("q"))
    )


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offs = np.asarray(column.offsets)
    flat = np.asarray(column.values)[offs[0] : offs[-1]]
    return flat.reshape(len(column), -1)


def threshold_topk(rows: np.ndarray, ids: np.ndarray, lists: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each query ids and scores of its k best of ``rows``, ties to the smaller id; and how many rows it had scored.

    ``lists[:, d]`` has row numbers by ascending component d, ``ids`` ascend, ``own`` are the queries' ids. Scores
    below ``floor`` (null: none) are not wanted, so a query whose bound is below it stops. Reads the lists in
    growing steps.
    """
    n, m = len(rows), len(queries)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    best_s = [np.zeros(0, rows.dtype)] * m
    best_i = [np.zeros(0, np.int64)] * m
    scored = np.zeros(m, np.int64)
    seen, live = np.zeros(n, np.bool_), np.arange(m)
    depth, step = 0, max(32, k)
    while len(live):
        upto = min(n, depth + step)
        ends = np.zeros(n, np.bool_)
        ends[lists[depth:upto]] = True
        ends[lists[n - upto : n - depth]] = True
        new = np.flatnonzero(ends & ~seen) if lists.shape[1] else np.arange(n)
        seen[new] = True
        scores = queries[live] @ rows[new].T
        depth, step = upto, step * 2
        over = seen.all()
        bound = up[live] @ rows[lists[n - depth], np.arange(rows.shape[1])] + down[live] @ rows[lists[depth - 1], np.arange(rows.shape[1])] if not over else None
        found, stays = ids[new], np.ones(len(live), np.bool_)
        for j, q in enumerate(live.tolist()):
            s = scores[j]
            if len(s) > k + 1:  # the own row may be among them
                s_k = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                near = np.flatnonzero(s >= (max(s_k, best_s[q][-1]) if len(best_s[q]) == k else s_k))
            else:
                near = np.arange(len(s))
            near = near[found[near] != own[q]]
            s, i = np.concatenate([best_s[q], s[near]]), np.concatenate([best_i[q], found[near]])
            keep = np.lexsort((i, -s))[:k]
            best_s[q], best_i[q] = s[keep], i[keep]
            if not over:
                low = bound[j] < best_s[q][-1] if len(keep) == k else False
                stays[j] = not (low or floor is not None and floor[q] is not None and bound[j] < floor[q])
        scored[live] += len(new)
        live = live[stays] if not over else live[:0]
    return best_i, best_s, scored


def _exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest type that holds every sum of products exactly; Python integers beyond 64 bits."""
    if not a.size or not b.size:
        return np.float64
    bound = sum(int(x) * int(y) for x, y in zip(np.abs(a.astype(object)).max(0), np.abs(b.astype(object)).max(0)))
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object


#: Queries that walk the lists together.
TOGETHER = 256


def _search(k: int):
    def group(key, left, right):
        out: tuple[list, ...] = ([], [], [], [])
        if left.num_rows and right.num_rows:
            ids, own = (np.asarray(c.combine_chunks()) for c in (left["vec_id"], right["own_id"]))
            by = np.argsort(ids)
            rows, queries = _matrix(left["q"])[by], _matrix(right["w"])
            ids, floor = ids[by], right["floor"].to_pylist()
            kind = _exact_type(rows, queries)
            rows, queries = rows.astype(kind), queries.astype(kind)
            lists = np.argsort(rows, axis=0, kind="stable").astype(np.int32)
            for a in range(0, len(own), TOGETHER):
                part = slice(a, a + TOGETHER)
                for q, i, s, scored in zip(own[part].tolist(), *threshold_topk(rows, ids, lists, queries[part], own[part], k, floor[part])):
                    n = max(1, len(i))  # a query without result still tells how much it read
                    out[0].extend([q] * n)
                    out[1].extend([int(x) for x in i] or [None])
                    out[2].extend([int(x) for x in s] or [None])
                    out[3].extend([int(scored)] + [0] * (n - 1))
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score", "scored"), out)})

    return group


def search_shards(candidates: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``(query_id, vec_id, score, scored)``: k rows a shard and query at most; ``scored`` sums to the rows a query had scored."""
    n, m = candidates.count(), queries.count()
    shards, blocks = partitions(n, shard_rows), partitions(m, query_rows)
    dim = F.size("q").alias("dim")
    left = candidates.select("vec_id", "q", dim, F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    # other names than those of the candidates: a table may meet itself
    asked = queries.select(F.col("vec_id").alias("own_id"), F.col("q").alias("w"), dim.alias("own_dim"), F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int").alias("own_block"))

    def meet(rows: DataFrame, own: DataFrame) -> DataFrame:
        return rows.groupBy("shard", "block", "dim").cogroup(own.groupBy("own_shard", "own_block", "own_dim")).applyInArrow(_search(k), "query_id long, vec_id long, score long, scored long")

    first = meet(left.where("shard = 0"), asked.withColumns({"own_shard": F.lit(0), "floor": F.lit(None).cast("long")}))
    if shards == 1:
        return first
    scratch = Scratch(candidates.sparkSession, "topk")
    first = scratch.table(first, "first")
    floors = first.groupBy(F.col("query_id").alias("own_id")).agg(F.count("score").alias("n"), F.min("score").alias("least")).select("own_id", F.when(F.col("n") >= k, F.col("least")).alias("floor"))
    others = asked.join(floors, "own_id", "left").withColumn("own_shard", F.explode(F.sequence(F.lit(1), F.lit(shards - 1))))
    return first.unionByName(meet(left.where("shard > 0"), others))


def topk_inner_product(candidates: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query its k candidates of highest integer inner product.

    Both inputs are ``(vec_id long, q array<long>)`` as ``quantise`` gives; other columns are ignored. A candidate
    of the query's own id never counts. Vectors are compared within equal dimension counts; others share no
    result. Fewer than k candidates give fewer rows; empty tables give none. A score beyond 64 bits raises.
    Queries and candidates meet in blocks of bounded size: (shards) x (query blocks) groups.
    """
    part = search_shards(candidates, queries, k, shard_rows, query_rows).where("score IS NOT NULL")
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return part.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return topk_inner_product(vectors, vectors.where(F.col("vec_id") % 50 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, max(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""
