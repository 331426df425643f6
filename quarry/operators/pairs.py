"""Pairwise similarity: blocks of bounded size meet in numpy, so neither side is broadcast or collected.

All-pairs work is quadratic by its nature; blocks keep memory bounded and spread it evenly. Means over all
partners need no pairs: they follow from the sum of the vectors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.vectors import dot, hamming
from quarry.sources.scratch import scratch_root, settle

#: Vectors in a block, pivots that neighbours are dealt by, and bytes of block centres that the driver holds at most.
BLOCK, PIVOTS, SUMMARY_BYTES = 2048, 256, 64 << 20
#: Parts that a side has, so that a row is sent to so many tasks whatever the number of rows; rows a part holds at most.
PARTS, PART_ROWS = 24, 32_768
#: Rows on each side of one product.
TILE = 1024
#: Hash classes with one band's value from which their further bits are cut into bands.
CROWD = 2000


def _parts(n: int) -> int:
    """Parts of ``n`` rows: blocks while these are few, then ``PARTS``, and more only for what a task can hold."""
    blocks = max(1, -(-n // BLOCK))
    return max(blocks if blocks <= 4 else PARTS, -(-n // PART_ROWS))


def _matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    a = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offs = np.asarray(a.offsets)
    if not len(a):
        return np.zeros((0, 0))
    return np.asarray(a.values)[offs[0] : offs[-1]].astype(np.float64).reshape(len(a), -1)


def _meet(left: DataFrame, right: DataFrame, kernel, schema: str) -> DataFrame:
    """Every part of ``(id, v)`` on the left meets every part on the right once."""
    m, n = _parts(left.count()), _parts(right.count())
    spread = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    at = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    a = left.select("id", "v", at(m).alias("bi"), spread(n).alias("bj"))
    # other names on the right: a frame may meet itself
    b = right.select(F.col("id").alias("rid"), F.col("v").alias("w"), at(n).alias("rj"), spread(m).alias("ri"))

    def named(one, two):
        return kernel(one, pa.table({"id": two["rid"], "v": two["w"]}))

    return a.groupBy("bi", "bj").cogroup(b.groupBy("ri", "rj")).applyInArrow(named, schema)


def _meet_self(rows: DataFrame, kernel, schema: str) -> DataFrame:
    """Every two parts of ``(id, v)``, and each part with itself, meet once: (parts) * (parts + 1) / 2 groups."""
    n = _parts(rows.count())
    block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(F.least(k, F.col("block")).alias("bi"), F.greatest(k, F.col("block")).alias("bj")))
    dealt = rows.select("id", "v", block.alias("block")).select("id", "v", "block", F.explode(met).alias("t")).select("id", "v", "block", "t.bi", "t.bj")

    def named(key, t):
        i, j = (k.as_py() for k in key)
        of = np.asarray(t["block"])
        one = t.take(pa.array(np.flatnonzero(of == i)))
        return kernel(one, one if i == j else t.take(pa.array(np.flatnonzero(of == j))), i == j)

    return dealt.groupBy("bi", "bj").applyInArrow(named, schema)


def _grid(n: int, m: int, same: bool = False) -> Iterator[tuple[slice, slice, bool]]:
    """Tiles of ``n`` by ``m`` rows; of rows with themselves each two tiles once. The last item tells a tile with itself."""
    for a in range(0, n, TILE):
        for b in range(a if same else 0, m, TILE):
            yield slice(a, min(a + TILE, n)), slice(b, min(b + TILE, m)), same and a == b


def _ordered(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(x, y), np.maximum(x, y)


def _reached(sim: np.ndarray, least: float, over: bool) -> np.ndarray:
    return sim > least if over else sim >= least


def edges_of(x: np.ndarray, xs: np.ndarray, y: np.ndarray, ys: np.ndarray, tiles: Iterable[tuple[slice, slice, bool]], least: float, over: bool) -> pa.Table:
    """All pairs in ``tiles`` that reach ``least``: of the vectors ``xs`` with ids ``x`` and ``ys`` with ``y``."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for a, b, own in tiles:
        sim = xs[a] @ ys[b].T
        hit = _reached(sim, least, over)
        i, j = np.nonzero(hit & (x[a][:, None] < y[b][None, :]) if own else hit)
        out.append((*_ordered(x[a][i], y[b][j]), sim[i, j]))
    return pa.table(dict(zip(("i", "j", "sim"), map(np.concatenate, zip(*out)))))


def forest_of(x: np.ndarray, xs: np.ndarray, y: np.ndarray, ys: np.ndarray, tiles: Iterable[tuple[slice, slice, bool]], least: float, over: bool) -> pa.Table:
    """Edges that tie the same vertices as those of ``edges_of``: one from each vertex to the smallest it reaches.

    A tile whose vertices are tied already tells nothing new and is left out.
    """
    ids = np.union1d(x, y)
    at, to, label = np.searchsorted(ids, x), np.searchsorted(ids, y), np.arange(len(ids))
    for a, b, own in tiles:
        p, q = label[at[a]], label[to[b]]
        if (p == p[0]).all() and (q == p[0]).all():
            continue
        i, j = np.nonzero(_reached(xs[a] @ ys[b].T, least, over))
        p, q = p[i], q[j]
        while (apart := p != q).any():
            p, q = p[apart], q[apart]
            np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
            while (label[label] != label).any():
                label = label[label]
            p, q = label[p], label[q]
    tied = np.flatnonzero(label != np.arange(len(ids)))
    return pa.table({"i": ids[tied], "j": ids[label[tied]]})


@dataclass
class Blocks:
    """Vectors in blocks of neighbours: ``rows`` ``(id, v, block)``, and each block's centre, radius, greatest length and part."""

    rows: DataFrame | None
    centres: np.ndarray
    radii: np.ndarray
    lengths: np.ndarray
    parts: np.ndarray

    def bounds(self, which: np.ndarray, other: Blocks) -> np.ndarray:
        """At least the dot product of any vector in the blocks ``which`` and any in each block of ``other``."""
        c, d = self.centres[which], other.centres
        r, s = self.radii[which][:, None], other.radii[None, :]
        inner = c @ d.T
        near = inner + np.linalg.norm(c, axis=1)[:, None] * s + np.linalg.norm(d, axis=1)[None, :] * r + r * s
        apart = np.sqrt(np.maximum(0, (c * c).sum(1)[:, None] + (d * d).sum(1)[None, :] - 2 * inner))
        longest = (self.lengths[which][:, None] ** 2 + other.lengths[None, :] ** 2) / 2
        far = longest - np.maximum(0, apart - r - s) ** 2 / 2
        return np.minimum(near, far) + 1e-9 * (1 + longest)


def neighbourhoods(rows: DataFrame, each: int | None = None, pivots: int = PIVOTS) -> Blocks | None:
    """``rows`` ``(id, v)`` by their nearest pivot, in blocks of about ``each`` (a quarter of ``BLOCK``); None where too few rows or too many blocks.

    Pivots are taken from a bounded sample of least hash of their id, each the farthest from those before it, so that
    clusters get one before any gets a second. A pivot with many vectors has several blocks. The driver holds a centre
    for each block, up to ``SUMMARY_BYTES``.
    """
    n, each = rows.count(), each or max(1, BLOCK // 4)
    if n <= 4 * BLOCK:
        return None
    sample = _matrix(rows.orderBy(F.xxhash64("id"), "id").limit(16 * pivots).toArrow()["v"])
    chosen, gap = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, -(-2 * n // each)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    centres = sample[chosen]
    if -(-n // each) * centres.shape[1] * 8 > SUMMARY_BYTES:
        return None
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(centres)  # a bounded number

    def assign(batches):
        for b in batches:
            v, p = _matrix(b.column(1)), shared.value
            best = ((p * p).sum(1)[None, :] - 2 * v @ p.T).argmin(1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.int32())], ["id", "v", "pivot"])

    root = scratch_root(spark, "pairs")
    kind = rows.schema["v"].dataType.simpleString()
    near = settle(rows.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(assign, f"id long, v {kind}, pivot int"), root, "near")
    counts = {r["pivot"]: r["count"] for r in near.groupBy("pivot").count().collect()}
    many = np.array([-(-counts.get(p, 0) // each) for p in range(len(centres))])
    first = np.cumsum(many) - many
    at = lambda values: F.element_at(F.array(*(F.lit(int(x)) for x in values)), F.col("pivot") + 1)
    block = at(first) + F.pmod(F.xxhash64("id"), at(np.maximum(1, many))).cast("int")
    dealt = settle(near.select("id", "v", block.alias("block")), root, "blocks")

    def centre(key, t):
        v = _matrix(t["v"])
        mean = v.mean(0)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "centre": pa.array([mean.tolist()]), "radius": [float(np.linalg.norm(v - mean, axis=1).max())], "length": [float(np.linalg.norm(v, axis=1).max())], "n": pa.array([len(v)], pa.int64())})

    summary = dealt.groupBy("block").applyInArrow(centre, "block int, centre array<double>, radius double, length double, n long").toArrow().sort_by("block")
    full = np.zeros((int(many.sum()), centres.shape[1])), np.full(int(many.sum()), -np.inf), np.zeros(int(many.sum()))
    index = np.asarray(summary["block"])
    full[0][index], full[1][index], full[2][index] = _matrix(summary["centre"]), np.asarray(summary["radius"]), np.asarray(summary["length"])
    sizes = np.zeros(int(many.sum()), np.int64)
    sizes[index] = np.asarray(summary["n"])
    return Blocks(dealt, *full, (np.cumsum(sizes) - sizes) * _parts(n) // n)  # a part is a run of blocks


def _bare(blocks: Blocks) -> Blocks:
    return Blocks(None, blocks.centres, blocks.radii, blocks.lengths, blocks.parts)


def _reaching(one: Blocks, two: Blocks, least: np.ndarray, which: np.ndarray, same: bool) -> np.ndarray:
    """Of each block in ``which`` with each of ``two``: whether the bound reaches ``least`` (one for each block of ``one``)."""
    keep = (one.bounds(which, two) >= least[which][:, None]) & (one.radii[which] >= 0)[:, None] & (two.radii >= 0)[None, :]
    return keep & (which[:, None] <= np.arange(len(two.radii))[None, :]) if same else keep


def _kept(left: Blocks, right: Blocks, least, same: bool = False, parts: bool = False) -> DataFrame:
    """``(bi, bj)``: the pairs of blocks whose bound reaches ``least`` (a number, or one for each left block); or the pairs of parts with any."""
    spark = left.rows.sparkSession
    shared = spark.sparkContext.broadcast((_bare(left), _bare(right), np.broadcast_to(least, len(left.radii))))

    def run(batches):
        one, two, least = shared.value
        for batch in batches:
            every = np.asarray(batch.column(0))
            for at in range(0, len(every), 64):
                which = every[at : at + 64]
                i, j = np.nonzero(_reaching(one, two, least, which, same))
                i = which[i]
                if parts:
                    i, j = np.unique(np.stack([one.parts[i], two.parts[j]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32())], ["bi", "bj"])

    found = spark.range(len(left.radii)).mapInArrow(run, "bi int, bj int")
    return settle(found.distinct(), scratch_root(spark, "pairs"), "met") if parts else found


def pruned_share(vectors: DataFrame, least: float, id: str = "vec_id", vec: str = "embedding") -> float:
    """The share of block pairs that ``similar_pairs`` skips; 0 where all meet."""
    found = neighbourhoods(vectors.select(F.col(id).alias("id"), F.col(vec).alias("v")).where("v IS NOT NULL"))
    if found is None:
        return 0.0
    n = int((found.radii >= 0).sum())
    return 1 - _kept(found, found, least, True).count() / (n * (n + 1) / 2)


def _with_part(blocks: Blocks) -> DataFrame:
    shared = blocks.rows.sparkSession.sparkContext.broadcast(blocks.parts)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value[np.asarray(b.column(2))], pa.int32())], ["id", "v", "block", "part"])

    return blocks.rows.select("id", "v", "block").mapInArrow(run, f"id long, v {blocks.rows.schema['v'].dataType.simpleString()}, block int, part int")


@dataclass
class Side:
    """A part's rows in the order of their blocks, and where each block ends."""

    ids: np.ndarray
    vectors: np.ndarray
    blocks: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(ids, vectors, blocks) -> Side:
        blocks = np.asarray(blocks)
        order = np.lexsort((np.asarray(ids), blocks))
        which, first = np.unique(blocks[order], return_index=True)
        return Side(np.asarray(ids)[order], _matrix(vectors)[order], which, np.append(first, len(order)))

    def rows(self, k: int) -> slice:
        return slice(int(self.ends[k]), int(self.ends[k + 1]))


def _dealt(left: Blocks, right: Blocks, least, kernel, schema: str, same: bool = False) -> DataFrame:
    """``kernel(one, two, keep, bound)`` on each pair of parts: sides, and which of their blocks meet; ``least`` as in ``_kept``."""
    spark = left.rows.sparkSession
    met = F.broadcast(_kept(left, right, least, same, parts=True))  # a row for each pair of parts
    a = _with_part(left).join(met.withColumnRenamed("bi", "part"), "part").select("id", "v", "block", F.col("part").alias("bi"), "bj")
    b = _with_part(right).join(met.withColumnRenamed("bj", "part"), "part").select(F.col("id").alias("rid"), F.col("v").alias("w"), F.col("block").alias("other"), F.col("bi").alias("ri"), F.col("part").alias("rj"))
    shared = spark.sparkContext.broadcast((_bare(left), _bare(right), np.broadcast_to(least, len(left.radii))))

    def named(t, u):
        one, two = Side.of(t["id"], t["v"], t["block"]), Side.of(u["rid"], u["w"], u["other"])
        x, y, floors = shared.value
        return kernel(one, two, _reaching(x, y, floors, one.blocks, same)[:, two.blocks], x.bounds(one.blocks, y)[:, two.blocks])

    return a.groupBy("bi", "bj").cogroup(b.groupBy("ri", "rj")).applyInArrow(named, schema)


def _similar(vectors: DataFrame, least: float, over: bool, id: str, vec: str, core, schema: str) -> DataFrame:
    """``core`` (``edges_of`` or ``forest_of``) on all pairs of parts."""
    rows = vectors.select(F.col(id).alias("id"), F.col(vec).alias("v")).where("v IS NOT NULL")
    found = neighbourhoods(rows)

    def whole(left, right, same):
        return core(np.asarray(left["id"]), _matrix(left["v"]), np.asarray(right["id"]), _matrix(right["v"]), _grid(left.num_rows, right.num_rows, same), least, over)

    def blocks(one, two, keep, bound):
        tiles = ((one.rows(i), two.rows(j), one.blocks[i] == two.blocks[j]) for i, j in zip(*np.nonzero(keep)))
        return core(one.ids, one.vectors, two.ids, two.vectors, tiles, least, over)

    return _meet_self(rows, whole, schema) if found is None else _dealt(found, found, least, blocks, schema, True)


def similar_pairs(vectors: DataFrame, least: float, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``(i, j, sim)``, i < j, of all pairs with a dot product of at least ``least``. Null vectors take no part.

    Vectors are dealt to blocks of neighbours; blocks whose centres and radii show that no pair can reach ``least``
    never meet. Runs of blocks are parts, of which two meet in a task; a row goes to one task for each part.
    """
    return _similar(vectors, least, False, id, vec, edges_of, "i long, j long, sim double")


def similar_forest(vectors: DataFrame, least: float, over: bool = False, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``(i, j)``: edges that tie the same vectors as ``similar_pairs`` does, at most one for each vector and pair of parts.

    With ``over`` a product must be greater than ``least``. For components: the pairs themselves, which grow as the
    square of the rows, are never written.
    """
    return _similar(vectors, least, over, id, vec, forest_of, "i long, j long")


def top_pairs(vectors: DataFrame, k: int, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``(i, j, sim)``, i < j, of the k pairs of greatest dot product, in order; of equals the smaller ids.

    Each pair of blocks gives its own k best, and these merge.
    """
    rows = vectors.select(F.col(id).alias("id"), F.col(vec).alias("v")).where("v IS NOT NULL")

    def kernel(left, right, same):
        x, y, xs, ys = np.asarray(left["id"]), np.asarray(right["id"]), _matrix(left["v"]), _matrix(right["v"])
        first, second, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for a, b, own in _grid(len(x), len(y), same):
            sim = xs[a] @ ys[b].T
            if own:
                sim[x[a][:, None] >= y[b][None, :]] = -np.inf
            most = sim.max(1)
            # k rows reach the k-th greatest of the rows' maxima, so no pair below it is among the k best
            bound = np.partition(most, len(most) - k)[len(most) - k] if len(most) > k else -np.inf
            bound = max(bound, s[-1]) if len(s) == k else bound
            i, j = np.nonzero((sim >= bound) & (sim > -np.inf))
            one, two = _ordered(x[a][i], y[b][j])
            first, second, s = np.concatenate([first, one]), np.concatenate([second, two]), np.concatenate([s, sim[i, j]])
            best = np.lexsort((second, first, -s))[:k]
            first, second, s = first[best], second[best], s[best]
        return pa.table({"i": first, "j": second, "sim": s})

    return _meet_self(rows, kernel, "i long, j long, sim double").orderBy(F.col("sim").desc(), "i", "j").limit(k)


def pair_extremes(vectors: DataFrame, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``(id, least, greatest)`` dot product of each vector with any other; rows without partner are absent."""
    rows = vectors.select(F.col(id).alias("id"), F.col(vec).alias("v")).where("v IS NOT NULL")

    def kernel(left, right, same):
        x, y, xs, ys = np.asarray(left["id"]), np.asarray(right["id"]), _matrix(left["v"]), _matrix(right["v"])
        sides = [(np.full(len(ids), np.inf), np.full(len(ids), -np.inf)) for ids in (x, y)]
        sides = [sides[0], sides[0]] if same else sides
        for a, b, _ in _grid(len(x), len(y), same):
            sim = xs[a] @ ys[b].T
            own = x[a][:, None] == y[b][None, :]
            low, high = np.where(own, np.inf, sim), np.where(own, -np.inf, sim)
            for (lo, hi), at, axis in zip(sides, (a, b), (1, 0)):
                lo[at], hi[at] = np.minimum(lo[at], low.min(axis)), np.maximum(hi[at], high.max(axis))
        parts = [(x, *sides[0])] if same else [(x, *sides[0]), (y, *sides[1])]
        ids, lo, hi = (np.concatenate(c) for c in zip(*parts))
        real = np.isfinite(lo)
        return pa.table({"id": ids[real], "lo": lo[real], "hi": hi[real]})

    return _meet_self(rows, kernel, "id long, lo double, hi double").groupBy("id").agg(F.min("lo").alias("least"), F.max("hi").alias("greatest"))


def leave_one_out(vectors: DataFrame, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``(id, average, least)``: mean and least dot product with all others.

    The mean is the dot product with the sum of all vectors, less the own part: no pairs are formed for it.
    """
    rows = vectors.select(F.col(id).alias("id"), F.col(vec).alias("v")).where("v IS NOT NULL")
    total = vector_sum(rows, "v")
    mean = (dot(F.col("v"), F.col("total")) - dot(F.col("v"), F.col("v"))) / (F.col("n") - 1)
    averages = rows.crossJoin(F.broadcast(total)).where("n > 1").select("id", mean.alias("average"))  # one row
    return averages.join(pair_extremes(rows, "id", "v").select("id", "least"), "id")


def vector_sum(rows: DataFrame, vec: str) -> DataFrame:
    """One row ``(total array<double>, n)``: the element-wise sum, combined by position."""
    parts = rows.select(F.posexplode(vec).alias("pos", "x")).groupBy("pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
    total = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("total"))
    return total.crossJoin(rows.agg(F.count(vec).alias("n")))


def global_coherence(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """One row ``(n, coherence)``: the mean dot product of all pairs, from the squared length of the sum."""
    total = vector_sum(vectors.select(F.col(vec).alias("v")).where("v IS NOT NULL"), "v")
    own = vectors.where(F.col(vec).isNotNull()).agg(F.coalesce(F.sum(dot(F.col(vec), F.col(vec))), F.lit(0.0)).alias("own"))
    mean = (dot(F.col("total"), F.col("total")) - F.col("own")) / (F.col("n") * (F.col("n") - 1))
    return total.crossJoin(own).select("n", F.when(F.col("n") > 1, mean).alias("coherence"))


def nearest(left: DataFrame, right: DataFrame, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``(id, nearest_id, sim)``: the right row of greatest dot product, the smaller id of equals."""
    side = lambda df: df.select(F.col(id).alias("id"), F.col(vec).alias("v")).where("v IS NOT NULL")

    def found(ids, best, near):
        return pa.table({"id": ids, "nearest_id": near, "sim": best})

    def better(best, near, sim, ids):
        """Lays what ``sim`` with the ascending ``ids`` has over the best so far; of equals the smaller id."""
        at = sim.argmax(1)
        top, of = sim[np.arange(len(at)), at], ids[at]
        win = (top > best) | (top == best) & (of < near)
        best[win], near[win] = top[win], of[win]

    def none(n):
        return np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)

    def kernel(a, b):
        if not (a.num_rows and b.num_rows):
            return found(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        order = np.argsort(np.asarray(b["id"]))
        ids, ys, xs = np.asarray(b["id"])[order], _matrix(b["v"])[order], _matrix(a["v"])
        best, near = none(len(xs))
        for x, y, _ in _grid(len(xs), len(ys)):
            better(best[x], near[x], xs[x] @ ys[y].T, ids[y])
        return found(np.asarray(a["id"]), best, near)

    schema = "id long, nearest_id long, sim double"
    one, two = neighbourhoods(side(left)), neighbourhoods(side(right))
    best_of = lambda df: df.groupBy("id").agg(F.max(F.struct("sim", (-F.col("nearest_id")).alias("o"))).alias("b")).select("id", (-F.col("b.o")).alias("nearest_id"), F.col("b.sim").alias("sim"))
    if one is None or two is None:
        return best_of(_meet(side(left), side(right), kernel, schema))
    # each block meets the block of greatest bound first; what it finds tells which others can hold better ones
    spark = left.sparkSession
    first = np.concatenate([one.bounds(np.arange(a, min(a + 64, len(one.radii))), two).argmax(1) for a in range(0, len(one.radii), 64)])
    start = F.broadcast(spark.createDataFrame([(i, int(j)) for i, j in enumerate(first.tolist())], "bi int, bj int"))  # a row for each block
    a = one.rows.select("id", "v", F.col("block").alias("bi"))
    b = two.rows.join(start.withColumnRenamed("bj", "block"), "block").select(F.col("id").alias("rid"), F.col("v").alias("w"), F.col("bi").alias("ri"))
    met = a.groupBy("bi").cogroup(b.groupBy("ri")).applyInArrow(lambda t, u: kernel(t, pa.table({"id": u["rid"], "v": u["w"]})), schema)
    known = settle(met, scratch_root(spark, "pairs"), "first")
    floors = np.full(len(one.radii), -np.inf)
    for r in one.rows.join(known.select("id", "sim"), "id", "left").groupBy("block").agg(F.min(F.coalesce("sim", F.lit(float("-inf")))).alias("least")).collect():  # a row for each block
        floors[r["block"]] = r["least"]

    def rest(one, two, keep, bound):
        best, near = none(len(one.ids))
        for i in range(len(one.blocks)):
            own = one.rows(i)
            for j in np.argsort(-bound[i], kind="stable"):  # those of greatest bound first
                if not keep[i, j] or bound[i, j] < best[own].min():
                    break
                better(best[own], near[own], one.vectors[own] @ two.vectors[two.rows(j)].T, two.ids[two.rows(j)])
        got = np.isfinite(best)
        return found(one.ids[got], best[got], near[got])

    return best_of(known.unionByName(_dealt(one, two, floors, rest, schema)))


def reference_stats(generated: DataFrame, references: DataFrame, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``(id, average, greatest, least, nearest_id)`` dot product of each generated vector with all references."""
    side = lambda df: df.select(F.col(id).alias("id"), F.col(vec).alias("v")).where("v IS NOT NULL")

    def kernel(a, b):
        names = ("id", "total", "n", "hi", "lo", "near")
        if not (a.num_rows and b.num_rows):
            return pa.table({n: np.zeros(0, np.int64 if n in ("id", "n", "near") else np.float64) for n in names})
        order = np.argsort(np.asarray(b["id"]))
        ids, ys, xs = np.asarray(b["id"])[order], _matrix(b["v"])[order], _matrix(a["v"])
        n = len(xs)
        total, hi, lo, near = np.zeros(n), np.full(n, -np.inf), np.full(n, np.inf), np.zeros(n, np.int64)
        for x, y, _ in _grid(n, len(ys)):
            sim = xs[x] @ ys[y].T
            best, top = sim.argmax(1), sim.max(1)
            more = top > hi[x]  # tiles come by ascending id, so that the smaller id stays
            near[x] = np.where(more, ids[y][best], near[x])
            total[x], hi[x], lo[x] = total[x] + sim.sum(1), np.maximum(hi[x], top), np.minimum(lo[x], sim.min(1))
        return pa.table(dict(zip(names, (np.asarray(a["id"]), total, np.full(n, len(ys)), hi, lo, near))))

    found = _meet(side(generated), side(references), kernel, "id long, total double, n long, hi double, lo double, near long")
    return found.groupBy("id").agg(
        (F.sum("total") / F.sum("n")).alias("average"), F.max("hi").alias("greatest"), F.min("lo").alias("least"), F.max(F.struct("hi", (-F.col("near")).alias("o"))).alias("b")
    ).select("id", "average", "greatest", "least", (-F.col("b.o")).alias("nearest_id"))


def _masks(varying: Column, parts: int) -> Column:
    """Masks of ``parts`` runs of the bits that are set in ``varying``, as even as can be."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(varying, b) == 1)
    n = F.size(places)
    ends = [F.floor(n * k / parts).cast("int") for k in range(parts + 1)]
    run = lambda k: F.slice(places, ends[k] + 1, ends[k + 1] - ends[k])
    return F.array(*(F.aggregate(run(k), F.lit(0).cast("long"), lambda m, b: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))) for k in range(parts)))


def hamming_pairs(hashes: DataFrame, max_distance: int, id: str = "image_id", bits: str = "phash", crowd: int = CROWD) -> DataFrame:
    """``(i, j, distance, n_i, n_j)``: pairs of hash classes that differ in 1 to ``max_distance`` bits.

    A class has all rows of one 64-bit hash; its smallest id stands for it and ``n`` counts it. Two such hashes
    agree in one of max_distance + 1 bands, so an equi-join on bands misses none. The bands share out the bits that
    differ anywhere in the table. Where more than ``crowd`` classes have one band's value, the bits that still differ
    among these are cut into bands again, and so on: two of them must agree in one of those too. Only classes that
    differ in ``max_distance`` bits at most stay together in any number, as all of their pairs belong to the result.
    """
    spark = hashes.sparkSession
    root = scratch_root(spark, "hamming")
    classes = settle(hashes.where(F.col(bits).isNotNull()).groupBy(F.col(bits).cast("long").alias("h")).agg(F.min(id).alias("rep"), F.count("*").alias("n")), root, "classes")
    varying = F.bit_or("h").bitwiseXOR(F.bit_and("h"))
    held, found, level = classes.withColumn("key", F.lit("")), [], 0
    while True:
        groups = held.groupBy("key").agg(F.count("*").alias("size"), varying.alias("varying"))
        dense = F.bit_count("varying") <= max_distance
        groups = settle(groups.withColumn("crowded", (F.lit(level == 0) | (F.col("size") > crowd)) & ~dense), root, f"groups{level}")
        found.append(held.join(groups.where(~F.col("crowded")).select("key"), "key", "left_semi"))
        crowded = groups.where("crowded").select("key", _masks(F.col("varying"), max_distance + 1).alias("masks"))
        if crowded.isEmpty():
            break
        cut = F.posexplode(F.transform("masks", lambda m: F.col("h").bitwiseAND(m))).alias("band", "value")
        held = held.join(crowded, "key").select("h", "rep", "n", "key", cut).select("h", "rep", "n", F.concat_ws("/", "key", "band", "value").alias("key"))
        level += 1
        held = settle(held, root, f"held{level}")
    near = None
    for rows in found:
        other = rows.select(F.col("h").alias("g"), F.col("rep").alias("rep2"), F.col("n").alias("n2"), "key")
        part = rows.join(other, "key").where("rep < rep2").withColumn("distance", hamming(F.col("h"), F.col("g"))).where(F.col("distance") <= max_distance)
        near = part if near is None else near.unionByName(part)
    return near.select(F.col("rep").alias("i"), F.col("rep2").alias("j"), "distance", F.col("n").alias("n_i"), F.col("n2").alias("n_j")).distinct()
