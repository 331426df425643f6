"""Operators that cut their work into blocks, against plain loops, with blocks small enough to matter."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import graph, pairs, prefix
from quarry.operators import leaders as leading
from quarry.sources import scratch


def around(edges):
    adjacent = {}
    for i, j in edges:
        if i != j:
            adjacent.setdefault(i, set()).add(j)
            adjacent.setdefault(j, set()).add(i)
    return adjacent


def leaders(edges):
    adjacent, keeper = around(edges), {}
    for v in sorted(adjacent):
        keeper[v] = min((u for u in adjacent[v] if u < v and keeper[u] == u), default=v)
    return keeper


def components(edges):
    adjacent, out = around(edges), {}
    for v in sorted(adjacent):
        reach = [] if v in out else [v]
        while reach:
            x = reach.pop()
            if x not in out:
                out[x] = v
                reach += adjacent[x]
    return out


RANDOM = random.Random(3)
GRAPHS = {
    "random": [(RANDOM.randrange(200), RANDOM.randrange(200)) for _ in range(400)],
    "band": [(i, i + k) for i in range(200) for k in (1, 2, 3)] + [(3, 3), (4, 5), (5, 4)],
    "hub": [(0, i) for i in range(1, 150)] + [(i, 300) for i in range(1, 150)],
}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("block", [40, 500_000])
def test_graphs_in_blocks(spark, name, block):
    df = spark.createDataFrame(GRAPHS[name], "i long, j long")
    assert dict(map(tuple, graph.greedy_leaders(df, block).collect())) == leaders(GRAPHS[name])
    assert dict(map(tuple, graph.connected_components(df, block).collect())) == components(GRAPHS[name])


def test_a_long_chain_takes_no_more_tables(spark, monkeypatch):
    tables, write = [], scratch.settle
    monkeypatch.setattr(graph, "settle", lambda df, root, name: tables.append(name) or write(df, root, name))
    counts = []
    for n in (10, 10_000):
        tables.clear()
        chain = spark.range(n).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
        found = dict(map(tuple, graph.greedy_leaders(chain).collect()))
        assert found == {i: i - i % 2 for i in range(n + 1)}
        counts.append(len(tables))
    assert counts[0] == counts[1] <= 5


def test_empty_graph(spark):
    none = spark.createDataFrame([], "i long, j long")
    assert graph.greedy_leaders(none).count() == graph.connected_components(none).count() == 0


def test_least_of_a_group(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("component"))
    got = {r.component: (r.size, list(r.first)) for r in graph.least(rows, ["component"], "id", 5).collect()}
    assert got == {0: (4500, [1, 2, 3, 4, 5]), 1: (500, [0, 10, 20, 30, 40])}


def test_neighbours_meet_and_others_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 64)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    x = np.repeat(centres / np.linalg.norm(centres, axis=1)[:, None], 40, axis=0) + rng.normal(size=(800, 16)) * 0.02
    x[5] = 0
    frame = lambda v, at: spark.createDataFrame([(at + int(i), v[i].tolist()) for i in rng.permutation(len(v))] + [(at + 9999, None)], "vec_id long, embedding array<double>")
    got = {(r.i, r.j) for r in pairs.similar_pairs(frame(x, 0), 0.9).collect()}
    i, j = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    assert got == set(zip(i.tolist(), j.tolist())) and pairs.pruned_share(frame(x, 0), 0.9) > 0.5
    y = x + rng.normal(size=x.shape) * 0.01
    y[7] = y[3]  # equals: the smaller id
    near = {r.id: r.nearest_id for r in pairs.nearest(frame(x, 0), frame(y, 10_000)).collect()}
    assert near == {i: 10_000 + int(k) for i, k in enumerate((x @ y.T).argmax(1))}


def test_rows_go_to_as_many_parts_however_many_there_are(spark, monkeypatch):
    assert pairs._parts(10_000) == pairs._parts(500_000) and pairs._parts(10**7) <= 10**7 // 30_000
    for name, size in (("BLOCK", 64), ("PARTS", 5), ("TILE", 48)):
        monkeypatch.setattr(pairs, name, size)
    rng = np.random.default_rng(4)
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (rng.normal(size=(600, 8)), rng.normal(size=(500, 8))))
    frame = lambda v, at: spark.createDataFrame([(at + int(i), v[i].tolist()) for i in rng.permutation(len(v))], "vec_id long, embedding array<double>")
    a, b, sim, own = frame(x, 0), frame(y, 1000), x @ y.T, x @ x.T
    i, j = np.nonzero(np.triu(own >= 0.6, 1))
    edges = list(zip(i.tolist(), j.tolist()))
    assert {(r.i, r.j) for r in pairs.similar_pairs(a, 0.6).collect()} == set(edges)
    for least in (0.6, 0.85):
        i, j = np.nonzero(np.triu(own > least, 1))
        forest = pairs.similar_forest(a, least, over=True)
        assert dict(map(tuple, graph.connected_components(forest).collect())) == components(list(zip(i.tolist(), j.tolist()))) and forest.count() <= 600 * 5
    assert {r.id: r.nearest_id for r in pairs.nearest(a, b).collect()} == {i: 1000 + int(k) for i, k in enumerate(sim.argmax(1))}
    stats = {r.id: r for r in pairs.reference_stats(a, b).collect()}
    assert [stats[i].nearest_id - 1000 for i in range(600)] == sim.argmax(1).tolist() and np.allclose([stats[i].average for i in range(600)], sim.mean(1)) and np.allclose([stats[i].least for i in range(600)], sim.min(1))
    np.fill_diagonal(own, np.nan)
    ends = {r.id: (r.least, r.greatest) for r in pairs.pair_extremes(a).collect()}
    assert np.allclose([ends[i] for i in range(600)], np.stack([np.nanmin(own, 1), np.nanmax(own, 1)], 1))
    i, j = np.triu_indices(600, 1)
    best = np.argsort(-own[i, j])[:30]
    assert [(r.i, r.j) for r in pairs.top_pairs(a, 30).collect()] == list(zip(i[best].tolist(), j[best].tolist()))


def test_a_crowded_band_is_cut_again(spark):
    rnd = random.Random(2)
    hashes = [0x0F0F | rnd.getrandbits(40) << 20 if rnd.random() < 0.9 else rnd.getrandbits(64) - 2**63 for _ in range(3000)]
    hashes += [h ^ (1 << rnd.randrange(60)) for h in hashes[:300]] + hashes[:5]
    df = spark.createDataFrame([*enumerate(hashes), (9999, None)], "image_id long, phash long")
    least = {}
    for i, h in enumerate(hashes):
        least.setdefault(h, i)
    k, ids = np.array([h % 2**64 for h in least], np.uint64), list(least.values())
    d = np.bitwise_count(k[:, None] ^ k[None, :])
    want = {(min(ids[a], ids[b]), max(ids[a], ids[b]), int(d[a, b])) for a, b in zip(*np.nonzero(np.triu(d <= 4, 1)))}
    for crowd in (50, 2000):
        got = pairs.hamming_pairs(df, 4, crowd=crowd)
        assert {(r.i, r.j, r.distance) for r in got.collect()} == want
    assert pairs.hamming_pairs(df.where("image_id = 9999"), 4).count() == 0


def test_running_counts_of_one_key(spark):
    rows = [("hot", (i * 37) % 100, i) for i in range(500)] + [(None, 1, 600), (None, 0, 601), ("cold", None, 602), ("cold", 5, 603)]
    df = spark.createDataFrame(rows, "k string, t long, id long")
    got = {r.id: (r.done, r.total) for r in prefix.running_count(df, "k", ["t", "id"], "done", "total", parts=7).collect()}
    want = {}
    for key in ("hot", "cold", None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: (n, len(own)) for n, r in enumerate(own, 1)}
    assert got == want


def test_totals_before_a_place(spark):
    rows = [(k, p, (p * 7 + k) % 11) for k in range(3) for p in range(0, 60, k + 1)]
    df = spark.createDataFrame(rows, "k long, p long, v long").withColumn("m", F.col("v"))
    got = {(r.k, r.p): (r.v, r.m) for r in prefix.before(df, ["k"], "p", {"v": "sum", "m": "max"}, block=8).collect()}
    for k, p, _ in rows:
        less = [v for a, b, v in rows if a == k and b < p]
        assert got[k, p] == ((sum(less), max(less)) if less else (None, None))


@pytest.mark.parametrize("block", [0, 500_000])
def test_leaders_of_classes(spark, block):
    """In one pass and in rounds: rows of one class or of tied classes, and rows tied by themselves."""
    rnd = random.Random(7)
    of = {i: rnd.randrange(12) for i in range(60) if rnd.random() < 0.9}
    first = {}
    for i, k in sorted(of.items()):
        first.setdefault(k, i)
    of = {i: first[k] for i, k in of.items()}  # a class is named by its first row
    near = [(a, b) for a in first.values() for b in first.values() if a < b and rnd.random() < 0.1]
    own = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(25)]
    edges = [(i, j) for i in of for j in of if i < j and (of[i] == of[j] or (min(of[i], of[j]), max(of[i], of[j])) in near)] + own
    frame = lambda rows, a, b: spark.createDataFrame(rows, f"{a} long, {b} long")
    got = graph.class_leaders(frame(list(of.items()), "id", "k"), frame(near, "i", "j"), frame(own, "i", "j"), block)
    assert dict(map(tuple, got.collect())) == leaders(edges)


@pytest.mark.parametrize("batch", [40, 8192])
def test_leaders_of_vectors_and_classes(spark, monkeypatch, batch):
    """Equal to the pass over all edges, without any edge of vectors written; rows with a class, a vector, both or neither."""
    monkeypatch.setattr(pairs, "similar_pairs", None)
    rnd, rng = random.Random(5), np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] = 0
    own = [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(x @ x.T > 0.8, 1)))]
    v = spark.createDataFrame([(i, x[i].tolist()) for i in range(300)] + [(900, None)], "vec_id long, embedding array<double>")
    assert dict(map(tuple, leading.similar_leaders(v, 0.8, batch=batch).collect())) == leaders(own)
    of, first = {i: rnd.randrange(60) for i in range(400) if rnd.random() < 0.5}, {}
    for i, k in sorted(of.items()):
        first.setdefault(k, i)
    of = {i: first[k] for i, k in of.items()}
    near = [(a, b) for a in first.values() for b in first.values() if a < b and rnd.random() < 0.02]
    edges = [(i, j) for i in of for j in of if i < j and (of[i] == of[j] or (min(of[i], of[j]), max(of[i], of[j])) in near)] + own
    frame = lambda rows, a, b: spark.createDataFrame(rows, f"{a} long, {b} long")
    members, tied, want = frame(list(of.items()), "id", "k"), frame(near, "i", "j"), leaders(edges)
    assert dict(map(tuple, leading.similar_leaders(v, 0.8, True, members, tied, batch=batch).collect())) == want
    claims = leading.similar_leaders(v, 0.8, True, members, tied, leaders=False, batch=batch)
    assert dict(map(tuple, claims.collect())) == {i: k for i, k in want.items() if i != k}


def test_members_of_a_large_group_come_in_parts(spark):
    keepers = spark.range(1000).select("id", F.when(F.col("id") < 900, 0).otherwise(900).alias("keeper"))
    rows = {(r.keeper, r.part): (r.n_members, list(r.members)) for r in graph.duplicate_groups(keepers, 200).collect()}
    assert rows == {(0, k): (899, list(range(1 + 200 * k, min(900, 201 + 200 * k)))) for k in range(5)} | {(900, 0): (99, list(range(901, 1000)))}
