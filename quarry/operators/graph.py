"""Duplicate graphs: order-dependent leaders and connected components.

Edges are dealt to blocks of bounded size. A block solves what it can by itself in one task; rounds of joins on
tables carry on only between blocks, so that a graph of one block needs no round and a long chain inside a block none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import prefix
from quarry.sources.scratch import delete, scratch_root, settle

#: Edges in a block.
BLOCK_EDGES = 500_000


def _both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).where("i <> j")
    return e.union(e.select("j", "i")).distinct()


def sweep(vertices: np.ndarray, led: np.ndarray, waits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """What a pass in order decides of some vertices: 1 leader, 2 member, 0 for what waits for a vertex elsewhere.

    ``vertices`` ascend; ``led`` marks those next to a smaller leader outside, ``waits`` those with a smaller neighbour
    outside that is not decided. ``i`` and ``j`` are places in ``vertices`` of edges to smaller neighbours.
    """
    order = np.argsort(i, kind="stable")
    less, ends = j[order].tolist(), np.searchsorted(i[order], np.arange(len(vertices) + 1)).tolist()
    state = [0] * len(vertices)
    led, waits = led.tolist(), waits.tolist()
    for v in range(len(vertices)):
        around = {state[u] for u in less[ends[v] : ends[v + 1]]}
        if led[v] or 1 in around:
            state[v] = 2
        elif not waits[v] and 0 not in around:
            state[v] = 1
    return np.array(state, np.int32)


def greedy_leaders(edges: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """``(id, keeper)`` of every vertex with an edge: what a sequential pass in id order keeps.

    Each vertex not yet claimed becomes a leader and claims its later, unclaimed neighbours. Vertices are cut into
    blocks of successive ids with about ``block_edges`` edges to smaller neighbours. In a round every block passes
    over its open vertices in order; what hangs on an open vertex of an earlier block waits for the next round. As
    claims only go from smaller to larger ids, there are no more rounds than blocks, and no more than the longest
    chain of claims between blocks: however long a chain is inside a block, it takes no round. A vertex's neighbours
    in other blocks count, before the block is gathered, as one row.
    """
    spark = edges.sparkSession
    root = scratch_root(spark)
    less = settle(_both_ways(edges).where("j < i"), root, "less")  # the edges are computed once
    blocks = max(1, -(-less.count() // block_edges))
    dealt = settle(less.repartitionByRange(blocks, "i").withColumn("block", F.spark_partition_id()), root, "dealt")
    places = dealt.select(F.col("i").alias("j"), F.col("block").alias("at")).distinct()  # a vertex without smaller neighbours has none, and leads
    placed = dealt.join(places, "j", "left") if blocks > 1 else dealt.join(places.select("j").withColumn("at", F.lit(0)), "j", "left")
    adjacent = settle(placed, root, "adjacent")

    def run(key, t):
        i, j = np.asarray(t["i"]), np.asarray(t["j"].fill_null(-1))
        own = np.asarray(t["own"])
        vertices = np.unique(i)
        place = np.searchsorted(vertices, i)
        led, waits = np.zeros(len(vertices), np.bool_), np.zeros(len(vertices), np.bool_)
        led[place[~own]] = np.asarray(t["led"])[~own]
        waits[place[~own]] = np.asarray(t["waits"])[~own]
        # a neighbour of this block that is not among the open vertices has been counted as decided
        state = sweep(vertices, led, waits, place[own], np.searchsorted(vertices, j[own]))
        return pa.table({"id": vertices[state > 0], "s": state[state > 0]})

    known = spark.createDataFrame([], "id long, s int")
    open_edges, step = adjacent, 0
    while True:
        seen = open_edges.join(known.select(F.col("id").alias("j"), "s"), "j", "left") if step else open_edges.withColumn("s", F.lit(None).cast("int"))
        own = (F.col("at") == F.col("block")) & F.col("s").isNull()
        outside = seen.where(~F.coalesce(own, F.lit(False))).groupBy("block", "i").agg(
            F.bool_or(F.col("at").isNull() | F.coalesce(F.col("s") == 1, F.lit(False))).alias("led"), F.bool_or(F.col("at").isNotNull() & F.col("s").isNull()).alias("waits")
        )
        rows = outside.select("block", "i", F.lit(None).cast("long").alias("j"), F.lit(False).alias("own"), "led", "waits").unionByName(
            seen.where(own).select("block", "i", "j", F.lit(True).alias("own"), F.lit(False).alias("led"), F.lit(False).alias("waits"))
        )
        new = settle(rows.groupBy("block").applyInArrow(run, "id long, s int"), root, f"new{step}")
        known = new if not step else settle(known.unionByName(new), root, f"known{step}")
        step += 1
        if blocks == 1:
            break
        left = settle(open_edges.join(new.select(F.col("id").alias("i")), "i", "left_anti"), root, f"open{step}")
        if step > 1:
            delete(spark, f"{root}/open{step - 1}")
        open_edges = left
        if open_edges.isEmpty():
            break
    leads = known.where("s = 1").select("id").unionByName(adjacent.where("at IS NULL").select(F.col("j").alias("id")).distinct())
    claims = adjacent.join(leads.select(F.col("id").alias("j")), "j", "left_semi").groupBy("i").agg(F.min("j").alias("keeper"))
    return claims.select(F.col("i").alias("id"), "keeper").unionByName(leads.select("id", F.col("id").alias("keeper")))


def class_pass(t):
    """The pass in id order over rows ``(kind, a, b)``: 0 an id and its class, 1 a class and one around it, 2 an edge to a smaller id."""
    kind, a, b = (np.asarray(t[n]) for n in ("kind", "a", "b"))
    pairs = lambda k: zip(a[kind == k].tolist(), b[kind == k].tolist())
    of, around, less = dict(pairs(0)), {}, {}
    for k, k2 in pairs(1):
        around.setdefault(k, []).append(k2)
    for i, j in pairs(2):
        less.setdefault(i, []).append(j)
    first, keeper = {}, {}  # the first leader of each class; whom each row has as leader
    for v in sorted({*of, *less, *(j for js in less.values() for j in js)}):
        k = of.get(v)
        found = [first[x] for x in around.get(k, ()) if x in first] + [u for u in less.get(v, ()) if keeper[u] == u]
        keeper[v] = min(found, default=v)
        if keeper[v] == v and k is not None:
            first.setdefault(k, v)
    return pa.table({"id": pa.array(keeper.keys(), pa.int64()), "keeper": pa.array(keeper.values(), pa.int64())})


def class_leaders(members: DataFrame, near: DataFrame, edges: DataFrame, block_rows: int = BLOCK_EDGES) -> DataFrame:
    """``greedy_leaders`` of a graph whose edges are mostly those of whole classes, without writing these out.

    ``members`` ``(id, k)`` puts a row in at most one class. Rows are tied if their classes are the same or tied
    by ``near`` ``(i, j)``, or if ``edges`` ``(i, j)`` ties the rows themselves. Every row of a class has the same
    neighbours by class, so the least open row and the least leader of each class decide for all of its rows. A graph
    of no more than ``block_rows`` rows, ties and edges is passed over in one task; a larger one takes rounds.
    """
    spark = members.sparkSession
    root = scratch_root(spark)
    own = _both_ways(edges).where("j < i")
    copies = members.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k", F.col("k").alias("k2"))
    tied = near.select("i", "j").union(near.select("j", "i")).toDF("k", "k2").union(copies)
    # a class is around itself too: of its rows only the least open one may lead
    around = tied.union(tied.select("k", F.col("k").alias("k2"))).distinct()
    part = lambda df, kind: df.toDF("a", "b").select(F.lit(kind).alias("kind"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    both = settle(part(around, 1).unionByName(part(own, 2)), root, "around")
    around, own = both.where("kind = 1").select(F.col("a").alias("k"), F.col("b").alias("k2")), both.where("kind = 2").select(F.col("a").alias("i"), F.col("b").alias("j"))
    rows = settle(members.join(around.select("k").distinct(), "k", "left_semi").select(F.col("id").cast("long").alias("id"), F.col("k").cast("long").alias("k")), root, "rows")
    if both.count() + rows.count() <= block_rows:
        return both.unionByName(part(rows.select("id", "k"), 0)).withColumn("all", F.lit(0)).groupBy("all").applyInArrow(class_pass, "id long, keeper long")
    ends = own.select("i").union(own.select("j")).distinct().toDF("id")
    state = settle(rows.join(ends, "id", "full").withColumn("s", F.lit(0)), root, "s0")  # 0 open, 1 leader, 2 member
    step = 0

    def by_class(state: DataFrame) -> DataFrame:
        least = state.where("k IS NOT NULL AND s < 2").groupBy("k").agg(F.min(F.when(F.col("s") == 0, F.col("id"))).alias("open"), F.min(F.when(F.col("s") == 1, F.col("id"))).alias("lead"))
        return around.join(least.withColumnRenamed("k", "k2"), "k2").groupBy("k").agg(F.min("open").alias("open"), F.min("lead").alias("lead"))

    while True:
        seen = own.join(state.select(F.col("id").alias("j"), F.col("s").alias("sj")), "j").groupBy("i").agg(F.bool_or(F.col("sj") == 1).alias("led"), F.bool_and(F.col("sj") == 2).alias("free"))
        step += 1
        led = F.coalesce(F.col("led"), F.lit(False)) | F.coalesce(F.col("lead") < F.col("id"), F.lit(False))
        free = F.coalesce(F.col("free"), F.lit(True)) & F.coalesce(F.col("open") >= F.col("id"), F.lit(True))
        both = state.join(by_class(state), "k", "left").join(seen.withColumnRenamed("i", "id"), "id", "left")
        state = settle(both.select("id", "k", F.when(F.col("s") > 0, F.col("s")).when(led, 2).when(free, 1).otherwise(0).alias("s")), root, f"s{step}")
        if state.where("s = 0").isEmpty():
            break
    leaders = state.where("s = 1")
    claims = own.join(leaders.select(F.col("id").alias("j")), "j", "left_semi").groupBy(F.col("i").alias("id")).agg(F.min("j").alias("claim"))
    taken = state.where("s = 2").join(by_class(leaders).select("k", "lead"), "k", "left").join(claims, "id", "left")
    keeper = F.least(F.when(F.col("lead") < F.col("id"), F.col("lead")), "claim")
    return taken.select("id", keeper.alias("keeper")).unionByName(leaders.select("id", F.col("id").alias("keeper")))


def contracted(edges: DataFrame, block_edges: int = BLOCK_EDGES, blocks: int | None = None) -> tuple[DataFrame, int]:
    """``(i, j)``: edges that tie the same vertices, fewer of them; and how many blocks they come from.

    Each block of edges is joined up in one task and gives an edge from each of its vertices to its smallest one.
    """
    blocks = blocks or max(1, -(-edges.count() // block_edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(v: int) -> int:
            top = v
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[v] != top:
                parent[v], v = top, parent[v]
            return top

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p, q = find(u), find(v)
                if p != q:
                    parent[max(p, q)] = min(p, q)
        pairs = [(v, t) for v in list(parent) if (t := find(v)) != v]
        yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in pairs], pa.int64()), pa.array([t for _, t in pairs], pa.int64())], ["i", "j"])

    # by hash: dealing in turn sorts all rows of a task; one block is one task, however many partitions keys are dealt to
    dealt = edges.repartition(blocks, "i", "j") if blocks > 1 else edges.repartition(1)
    return dealt.mapInArrow(run, "i long, j long"), blocks


def connected_components(edges: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """``(id, component)``: the smallest id reachable, of every vertex with an edge.

    Blocks of edges are contracted to stars first. More than one block goes on with large-star and small-star rounds
    (Kiveris et al. 2014), whose number grows with the logarithm of what is left.
    """
    spark = edges.sparkSession
    root = scratch_root(spark)
    own = edges.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).where("i <> j")
    first, blocks = contracted(settle(own, root, "edges"), block_edges)
    now = settle(first, root, "e0")
    if blocks == 1:
        return now.select(F.col("i").alias("id"), F.col("j").alias("component")).unionByName(now.select(F.col("j").alias("id"), F.col("j").alias("component")).distinct())
    mark, step = None, 0
    while True:
        around = now.union(now.select("j", "i"))
        low = around.groupBy("i").agg(F.least(F.min("j"), F.first("i")).alias("m"))
        large = around.join(low, "i").where("j > i").select(F.col("j").alias("i"), F.col("m").alias("j")).where("i <> j")
        least = large.groupBy("i").agg(F.min("j").alias("m"))
        small = large.join(least, "i").where("j <> m").select(F.col("j").alias("i"), F.col("m").alias("j")).union(least.select("i", F.col("m"))).distinct()
        step += 1
        now = settle(small, root, f"e{step}")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("i", "j").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            roots = now.select(F.col("j").alias("id")).distinct()
            return now.select(F.col("i").alias("id"), F.col("j").alias("component")).unionByName(roots.select("id", F.col("id").alias("component"))).distinct()
        mark = new


def duplicate_groups(keepers: DataFrame, part_rows: int = 10_000) -> DataFrame:
    """``(keeper, part, n_members, members)`` for keepers that claim any: a row for each ``part_rows`` of its members, in order.

    Members are counted by ranges and sums over ranges, so that neither a task nor a row holds a group of any size.
    """
    placed = prefix.running_count(keepers.where("id <> keeper").select("keeper", "id"), "keeper", ["id"], "place", total="n_members")
    part = F.floor((F.col("place") - 1) / part_rows).cast("long")
    return placed.groupBy("keeper", part.alias("part"), "n_members").agg(F.array_sort(F.collect_list("id")).alias("members")).select("keeper", "part", "n_members", "members")


def least(rows: DataFrame, keys: list[str], id: str, n: int, salts: int = 64) -> DataFrame:
    """``(*keys, size, first)``: how many rows a group has and its ``n`` least ids, in order, whatever its size.

    Each of ``salts`` parts of a group keeps its own n least, by rank; these merge. Memory holds n ids a part.
    """
    part = F.pmod(F.xxhash64(id), F.lit(salts))
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(id))
    best = rows.withColumn("_part", part).withColumn("_place", place).where(F.col("_place") <= n)  # a rank limit: map tasks send n rows a part at most
    merged = best.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(id)), 1, n).alias("first"))
    return rows.groupBy(*keys).agg(F.count("*").alias("size")).join(merged, keys)


def cluster_stats(components: DataFrame, total: int, large: int = 3, names: int = 5) -> DataFrame:
    """``(component, size, first)`` of clusters of at least ``large``, their first ids named."""
    return least(components, ["component"], "id", names).where(F.col("size") >= large)
