"""Vector codes: nearest entries and whole runs against plain distances; what the bounds spare."""

import hashlib
import math
import random

import duckdb
import numpy as np

from quarry.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, entries=256, rounds=4, parts=4):
    """``(code, error)`` of integer vectors, a list in the order of ids; and the codebooks."""
    x = np.array(vectors, np.int64).reshape(len(vectors), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        d = [((x[:, p, None, :] - books[p][None]) ** 2).sum(2) for p in range(parts)]
        return np.stack([e.argmin(1) for e in d], 1), sum(e.min(1) for e in d)

    for _ in range(rounds):
        a, _ = assign()
        for p in range(parts):
            for e in set(a[:, p].tolist()):
                books[p][e] = np.floor_divide(x[a[:, p] == e, p].sum(0), (a[:, p] == e).sum())
    a, error = assign()
    return ["".join(f"{e:02x}" for e in r) for r in a], error.tolist(), books


def test_nearest_is_exact_and_spares_entries():
    rng = np.random.default_rng(2)
    centres = rng.integers(-200, 200, (64, 16))
    rows = centres[rng.integers(0, 64, 500)] + rng.integers(-9, 10, (500, 16))
    for entries in (centres, np.concatenate([centres, centres]), rng.integers(-3, 3, (300, 16)), np.zeros((5, 16), np.int64)):
        entry, distance, taken = vc.nearest(rows, vc.Blocks(entries))
        d = ((rows[:, None, :] - entries[None]) ** 2).sum(2)
        assert (entry == d.argmin(1)).all() and (distance == d.min(1)).all()
        if entries is centres:
            assert taken < 0.2 * d.size
    for width in (1, 3, 4, 6, 8):
        a, b = rng.integers(-50, 50, (40, width)), rng.integers(-50, 50, (9, width))
        assert (vc.nearest(a, vc.Blocks(b))[0] == ((a[:, None] - b[None]) ** 2).sum(2).argmin(1)).all()


def rows_of(n, seed=3):
    rnd = random.Random(seed)
    good = [(3 * i, [rnd.choice([0.0, 0.5, -0.25, rnd.uniform(-1, 1)]) for _ in range(8)], rnd.choice([None, 1, 2])) for i in range(n)]
    return good, [(1, None, 1), (2, [0.5, None] + [0.0] * 6, 1), (4, [float("nan")] + [0.0] * 7, None), (5, [float("inf")] + [0.0] * 7, 2), (7, [], 1), (8, [1e38] + [0.0] * 7, 1)]


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    good, bad = rows_of(700)
    bad.pop()  # too large for the integers; the contract has none
    bad = [r for r in bad if r[1] != []]
    spark.createDataFrame([(*r, "x") for r in random.Random(1).sample(good + bad, len(good) + len(bad))], SCHEMA + ", code string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in vc.query(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    codes, errors, books = brute([[math.floor(1024 * float(np.float32(x))) for x in v] for _, v, _ in good])
    sums = {}
    for (_, _, label), e in zip(good, errors):
        sums[label] = sums.get(label, 0) + e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    assert got == [(i, c, e, sums[label], digest) for (i, _, label), c, e in zip(good, codes, errors)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    table = con.sql(vc.SQL).to_arrow_table()
    assert sorted(zip(*(table[n].to_pylist() for n in ("vec_id", "code", "error", "label_error", "codebooks_sha256")))) == got


def test_few_vectors_other_lengths_and_none(spark):
    good, bad = rows_of(5)
    odd = [(100, [1.0] * 4, 1), (101, [1.0] * 6, 1), (None, good[1][1], 1), good[2]]
    coded, books = vc.compress(spark.createDataFrame(good + bad + odd, SCHEMA), entries=3, rounds=2)
    rows = sorted(map(tuple, coded.collect()), key=repr)
    assert [r[0] for r in rows] == sorted([0, 3, 6, 9, 12, 6, None], key=repr) and books.shape == (4, 3, 2)
    by_id = {r[0]: r for r in rows}
    v = [math.floor(1024 * float(np.float32(x))) for x in good[4][1]]
    assert ((vc.decode(by_id[12][1], books) - v) ** 2).sum() == by_id[12][2] and by_id[None][1] == by_id[3][1]
    for none in ([], [(None, [1.0] * 8, 1)], [(1, None, 1)]):
        assert vc.compress(spark.createDataFrame(none, SCHEMA))[0].count() == 0
