import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import minhash, suffix_dedup


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset() if not w else frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def near_brute(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i, _ in rows)


def near_rows():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(2, 6)))
    common = [word() for _ in range(30)]
    rows, base = [], [word() for _ in range(120)]
    for i in range(60):  # a group whose members straddle the threshold, and texts around one passage
        w = list(base)
        for _ in range(rnd.randrange(0, 7)):
            w[rnd.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join([*(word() for _ in range(rnd.randrange(0, 60))), *common])) for i in range(40)]
    rows += [(200 + i, " ".join(word() for _ in range(rnd.randrange(0, 7)))) for i in range(40)]
    return [*rows, (300, None), (301, ""), (302, " \t "), (303, "One two"), (304, "one TWO "), (305, rows[3][1]), (306, "one"), rows[4]]


def test_near_duplicates(spark, monkeypatch):
    """Blocks are small, so that pools of lists span several."""
    monkeypatch.setattr(minhash, "BLOCK_CLASSES", 16)
    monkeypatch.setattr(minhash, "FIRST", 1)
    rows = near_rows()
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n long, component string")
    got = sorted(map(tuple, minhash.near_duplicates(df, words=4).collect()))
    assert got == near_brute(rows, 4)


def test_no_near_duplicates_in_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df).count() == 0
    one = spark.createDataFrame([(None, "a b c d e f"), (1, None)], "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(one).collect()), key=str) == [(1, 0, 1, True), (None, 2, None, True)]


def test_cross_links():
    rnd = random.Random(8)
    base = [rnd.randrange(1000) for _ in range(40)]
    sets = [np.unique(np.array([rnd.choice(base) if rnd.random() < 0.97 else rnd.randrange(1000) for _ in range(120)], np.uint64)) for _ in range(40)]
    x, y = sets[:18], sets[18:]
    want = [(i, j) for i, a in enumerate(x) for j, b in enumerate(y) if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))]
    assert [*zip(*(v.tolist() for v in minhash.cross_links(x, y)))] == want and want
    assert len(minhash.cross_links([np.array([1], np.uint64)], [np.array([2], np.uint64)])[0]) == 0


def test_union_sketch():
    rnd = random.Random(2)
    for _ in range(20):
        a, b = (np.unique(np.array([rnd.randrange(50) for _ in range(rnd.randrange(1, 30))], np.uint64))[:8] for _ in range(2))
        import pyarrow as pa

        lists = lambda x: pa.array([x.view(np.int64).tolist()], pa.list_(pa.int64()))
        assert minhash._estimates(lists(a), lists(b), 8)[0] == pytest.approx(minhash.union_overlap(a, b, 8))


def repeats_brute(rows, length):
    raws = [(i, (t or "").encode()) for i, t in rows]
    windows = Counter(r[k : k + length] for _, r in raws for k in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - length + 1):
            if windows[r[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((i, len(r), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeat_rows():
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abé ") for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(120):
        t = "".join(rnd.choice("abcdefgh é") for _ in range(rnd.randrange(0, 60)))
        for _ in range(rnd.randrange(3)):
            x = rnd.randrange(40)
            t += rnd.choice(base)[x : x + rnd.randrange(30)] + "".join(rnd.choice("xyz") for _ in range(rnd.randrange(12)))
        rows.append((i, t))
    return [*rows, (200, "a" * 100), (201, None), (202, ""), (3, rows[3][1]), (203, "ab" * 40), (None, rows[9][1])]


@pytest.mark.parametrize(("length", "shard"), [(12, None), (12, 8), (40, 4)])
def test_repeats_go(spark, length, shard):
    """With small shards prints are spread over many and merged by binary search."""
    rows = repeat_rows()
    df = spark.createDataFrame([(*r, "p") for r in rows], "doc_id long, text string, print string")
    got = suffix_dedup.removal_digests(df, length, shard).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == repeats_brute(rows, length)
    assert all("\ufffd" in r.kept_text or hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_long_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 64)
    rows = repeat_rows()
    rows += [(500, "".join(t or "" for _, t in rows[:40])), (501, "q" * 500)]
    import pyarrow as pa

    from quarry.llm.suffix_dedup import anchors

    got = anchors_of(rows, 12, 64, anchors, pa)
    assert got == anchors_of(rows, 12, 1 << 22, anchors, pa)


def anchors_of(rows, length, block, anchors, pa):
    """Window starts by print, from the function that maps over batches, whatever the blocks."""

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    suffix_dedup.BLOCK_BYTES = block
    batch = pa.RecordBatch.from_pydict({"k1": pa.array(range(len(rows)), pa.int64()), "k2": pa.array(range(len(rows)), pa.int64()), "text": [t or "" for _, t in rows]})
    out = set()
    for b in anchors(Rows(), length)([batch]):
        for r in b.to_pylist():
            lo = r["at"] >> 32
            out |= {(r["k1"], r["print"], s) for s in range(lo, lo + (r["at"] >> 16 & 0xFFFF) + 1)}
    return out


def test_suffix_array_and_prefixes():
    rnd = random.Random(4)
    for n in (1, 2, 50, 400):
        s = np.array([rnd.randrange(1, 3) for _ in range(n)] + [0])
        order, rank = suffix_dedup.suffix_array(s)
        assert order.tolist() == sorted(range(n + 1), key=lambda i: s[i:].tolist()) and (rank[order] == np.arange(n + 1)).all()
        lcp = suffix_dedup.common_prefixes(s, order, rank, np.array([0, n // 2]), np.array([n // 2, n + 1]))
        for i in range(n + 1):
            before = order[rank[i] - 1] if rank[i] else None
            want = 0
            while before is not None and i + want <= n and before + want <= n and s[i + want] == s[before + want]:
                want += 1
            assert lcp[i] == want


def test_cleaned_keeps_characters(spark):
    part = "wörld of shared passages, ñ!"
    df = spark.createDataFrame([(1, "é" + part + "é", 5), (2, "ü" + part, 6), (3, None, 7)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.cleaned(df, 12).collect()}
    assert got == {1: "éé", 2: "ü", 3: None}
    assert suffix_dedup.cleaned(df.limit(0), 12).count() == 0


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_repeated_ids_by_text(spark):
    """An id with two texts: each text has its own links, in whatever order the rows come."""
    rnd = random.Random(9)
    words = lambda n: ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    a, b = words(80), words(80)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (10, " ".join([*a[:-1], "near"])), (20, " ".join([*b[:-1], "near"]))]
    for order in (rows, [rows[1], rows[0], *rows[2:]], rows[::-1]):
        got = minhash.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").coalesce(1), words=4).collect()
        assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (10, 1, False), (20, 1, False)]


def test_texts_of_equal_polynomials_differ(spark):
    """Thue-Morse strings and their mirror images defeat polynomials modulo 2^64."""
    x = thue_morse(2048)
    y = x.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{x} one two three four five"), (2, f"{y} one two three four five"), (3, x), (4, y)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(df, words=4).collect())) == near_brute(rows, 4)
    got = suffix_dedup.removal_digests(df, 400).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == repeats_brute(rows, 400)


def test_estimates_miss_no_similar_pair():
    """Of 20,000 pairs right at the threshold the union sketch drops none."""
    rnd = np.random.default_rng(6)
    for n in (40, 90, 400):
        common = round(n * 0.8)
        values = rnd.integers(0, 1 << 63, (7000, n), dtype=np.int64).astype(np.uint64)
        a, b = np.concatenate([values[:, :common], values[:, common::2]], 1), np.concatenate([values[:, :common], values[:, common + 1 :: 2]], 1)
        import pyarrow as pa

        lists = lambda x: pa.array(np.sort(x, 1)[:, : minhash.K].astype(np.int64).tolist(), pa.list_(pa.int64()))
        assert minhash._estimates(lists(a), lists(b), minhash.K).min() >= minhash.LEAST


def test_a_passage_in_most_texts(spark):
    """One passage in 1,500 texts with different neighbours, and 1,200 copies of one text: more than single entries take."""
    rnd = random.Random(17)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(90))
    own = lambda: "".join(rnd.choice("uvwxyz") for _ in range(rnd.randrange(12)))
    rows = [(i, own() + passage + own()) for i in range(1500)] + [(2000 + i, "copied " * 9) for i in range(1200)]
    got = suffix_dedup.removal_digests(spark.createDataFrame(rows, "doc_id long, text string"), 40, 100).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == repeats_brute(rows, 40)


def test_many_texts_of_one_id(spark):
    """Near copies under one id are found as under many, and a text is met once however often its id repeats."""
    rnd = random.Random(9)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    texts = [t for _ in range(400) for b in [text(30)] for t in (b, f"{b} more")]
    many = minhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5)
    one = minhash.near_groups(spark.createDataFrame([(7, t) for t in texts] + [(7, texts[0])] * 50, "doc_id long, text string"), 5)
    assert many.select("group").distinct().count() == one.select("group").distinct().count() == 400
    assert one.count() == 850 and one.groupBy("k1", "k2").agg({"group": "count"}).count() == 800


@pytest.mark.parametrize("block, tables", [(10_000, 2), (700, 99), (40, 99)])
def test_components_of_blocks_take_no_rounds(spark, monkeypatch, block, tables):
    """A long path, small cycles and a star: one block ends after two tables (rounds took more), many blocks give the same."""
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(700)] + [(2000 + i, 2000 + i // 3 * 3 + (i + 1) % 3) for i in range(300)] + [(5000, 5000 + i) for i in range(1, 200)] + [(7, 7)]
    names = list(range(6000))
    rnd.shuffle(names)
    edges = [(names[i], names[j]) for i, j in edges] + [(names[1], names[0])]
    parent = {i: i for e in edges for i in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in edges:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    made = []
    table = minhash.Scratch.table
    monkeypatch.setattr(minhash.Scratch, "table", lambda self, df, name: made.append(name) or table(self, df, name))
    got = minhash.components(spark.createDataFrame(edges, "a long, b long"), minhash.Scratch(spark, "t"), "c", block).collect()
    assert sorted(map(tuple, got)) == sorted((i, root(i)) for i in parent if root(i) != i)
    assert len(made) <= tables
    none = spark.createDataFrame([], "a long, b long")
    assert minhash.components(none, minhash.Scratch(spark, "t"), "none", block).count() == 0
