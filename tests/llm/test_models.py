"""Toxicity, language-model scores and decontamination."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import decontam, katz, toxicity

BAD = ["idiot", "moron", "trash"]


def toxic_tables(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    rows, labels = [], []
    for i in range(900):
        w = [word() for _ in range(rnd.randrange(5, 40))]
        bad = rnd.random() < 0.15
        if bad:
            w.insert(rnd.randrange(len(w)), rnd.choice(BAD) + rnd.choice(["", "!", ","]))
        rows.append((i, " ".join(w)))
        if rnd.random() < 0.7:
            labels.append((i, 1, int(bad)))
    rows += [(2000, None), (2001, ""), (None, "idiot"), (2002, "IDIOT " * 500), (5, rows[5][1])]
    labels += [(None, 1, 1), (2001, 0, None), (9999, 1, 1), labels[0]]
    return rows, spark.createDataFrame(rows, "doc_id long, text string"), labels, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_folds(spark):
    rows, docs, _, labels = toxic_tables(spark)
    model = toxicity.train(docs, labels)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = [(r["score"] >= 0.5) == any(b in (r["text"] or "").lower() for b in BAD) for r in held]
    assert len(held) > 100 and sum(right) / len(right) > 0.97


def test_labels_of_held_out_rows_do_not_count(spark):
    _, docs, rows, labels = toxic_tables(spark)
    flipped = spark.createDataFrame([(i, q, 1 - t if i is not None and t is not None and zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in rows], labels.schema)
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_toxicity_without_labels(spark):
    _, docs, _, labels = toxic_tables(spark)
    assert all(r["score"] < 0.5 for r in toxicity.score_documents(docs, toxicity.train(docs, labels.limit(0))).collect())
    assert toxicity.score_documents(docs.limit(0), toxicity.train(docs.limit(0), labels.limit(0))).count() == 0


def test_buckets_ignore_case_and_marks():
    flat, bounds = toxicity.word_buckets(pa.array(["Idiot!", "(idiot) idiot", "!!! ---", "", "id iot"]))
    rows = [set(flat[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
    assert rows[0] == rows[1] and len(rows[0]) == 1 and not rows[2] and not rows[3] and len(rows[4]) == 2


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def katz_brute(rows):
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    uni, pairs = Counter(), defaultdict(Counter)
    for i, t in rows:
        if not held(i):
            for u, v in zip(["S", *tokens(t)], tokens(t)):
                uni[v] += 1
                pairs[u][v] += 1
    n, types = sum(uni.values()), len(uni)
    of = lambda counts: np.array([sum(c == r for c in counts) for r in range(1, 7)])
    du, db = katz.discounts(of(uni.values())), katz.discounts(of([c for m in pairs.values() for c in m.values()]))
    cut = lambda c, d: (d[c] if c <= 5 else 1) * c
    seen = sum(cut(c, du) for c in uni.values())
    scale = (1 - 1 / (n + 1)) * n / seen if n and 1 - seen / n < 1 / (n + 1) else 1.0
    unknown = 1 - scale * seen / n if n else 1.0
    own = lambda v: scale * cut(uni[v], du) / n if uni.get(v) else unknown

    def p(v, u):
        m = pairs.get(u)
        if not m:
            return own(v)
        c = sum(m.values())
        kept = sum(cut(x, db) for x in m.values()) / c
        s, left = (1.0, 1 - kept) if 1 - kept >= 1 / (c + 1) else ((1 - 1 / (c + 1)) / kept, 1 / (c + 1))
        return s * cut(m[v], db) / c if v in m else left / (1 - sum(map(own, m))) * own(v)

    for u in [*list(pairs)[:8], "never"]:
        assert sum(p(v, u) for v in [*uni, "unknown token"]) == pytest.approx(1)
    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((uni.get(v, 0) + 0.1) / (n + 0.1 * (types + 1))) for v in w)
        out.append((i, held(i), len(w), sum(v in uni for v in w), n, base, sum(math.log10(p(v, u)) for u, v in zip(["S", *w], w))))
    return sorted(out, key=lambda r: repr(r[0]))


def test_katz_is_normalised_and_exact(spark, monkeypatch):
    monkeypatch.setattr(katz, "ENTRIES", 60)  # several partitions of the tables
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["a", "B", "b", "the", "of", f"x{rnd.randrange(30)}"]) for _ in range(rnd.randrange(0, 20)))) for i in range(60)]
    rows += [(None, "a b"), (500, None), (7, "  the \x0b of "), rows[3], (501, "the " * 3000)]
    df = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, words string")
    got = sorted(map(tuple, katz.score_documents(df).collect()), key=lambda r: repr(r[0]))
    for a, b in zip(sorted(got, key=repr), sorted(katz_brute(rows), key=repr), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_katz_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score_documents(df).count() == 0
    i = next(i for i in range(100) if held(i))
    only = katz.score_documents(spark.createDataFrame([(i, "a b")], "doc_id long, text string")).collect()
    assert tuple(only[0]) == (i, True, 3, 0, 0, 0.0, 0.0)


RX = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def window_brute(rows, items, size):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    windows = defaultdict(set)
    for i, t in items:
        w = RX.findall(low(t))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(i)
    out = []
    for i, t in rows:
        w = RX.findall(low(t))
        hit, found = np.zeros(len(w), bool), set()
        for k in range(len(w)):
            for n in set(map(len, windows)):
                if tuple(w[k : k + n]) in windows and k + n <= len(w):
                    hit[k : k + n] = True
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), int(hit.sum()), sorted(x for x in found if x is not None), bool(hit.any() and 20 * hit.sum() >= len(w))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 20, 30])
def test_decontamination(spark, block):
    """Also with a benchmark too large for one automaton."""
    rnd = random.Random(2)
    word = lambda: rnd.choice(["Ab", "c-d", "é", "E9", "f", "g"])
    items = [(i, " ".join(word() for _ in range(rnd.randrange(0, 8)))) for i in range(12)] + [(50, None), (None, "f g f g"), (3, "é é é é é"), (51, "!!")]
    rows = [(i, " ".join(word() for _ in range(rnd.randrange(0, 60)))) for i in range(60)] + [(90, None), (91, ""), (92, "Ab. C D! é"), (92, "x"), (93, "zz " * 5000)]
    docs, bench = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    found = decontam.judge(decontam.scan_documents(docs, bench, window=4, block_bytes=block)).collect()
    assert sorted(((r["doc_id"], r["_n_words"], r["_n_hit"], list(r["_items"]), r["_contaminated"]) for r in found), key=repr) == window_brute(rows, items, 4)


def test_spans_lie_in_the_original(spark):
    docs = spark.createDataFrame([(1, "Say: éT, one-Two! ok")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "Ét one")], "item_id long, text string")
    assert decontam.contaminated_spans(docs, bench).collect() == []  # only A-Z change case
    bench = spark.createDataFrame([(7, "Ét, ONE")], "item_id long, text string")
    (r,) = decontam.contaminated_spans(spark.createDataFrame([(1, "Say: Ét, one-Two! ok")], "doc_id long, text string"), bench).collect()
    assert "Say: Ét, one-Two! ok".encode()[r["start"] : r["end"]].decode() == "Ét, one"


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_byte_ranges_cover_the_hit_words(spark, block):
    """Ranges of original bytes hold what the scan counts as hit, with one automaton and with several."""
    rnd = random.Random(8)
    word = lambda: rnd.choice(["Ab", "é", "E9", "日本", "f", "gÉ"])
    items = [(i, " ".join(word() for _ in range(rnd.randrange(1, 7)))) for i in range(15)] + [(99, None)]
    rows = [(i, rnd.choice([" ", "  ", "-", ",\n"]).join(word() for _ in range(rnd.randrange(0, 50)))) for i in range(40)] + [(90, None), (91, "")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    spans = {}
    for r in decontam.contaminated_spans(docs, bench, window=4, block_bytes=block).collect():
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    for i, _, hit, *_ in window_brute(rows, items, 4):
        raw, own = (dict(rows)[i] or "").encode(), sorted(spans.get(i, []))
        assert sum(len(decontam.words_of(raw[a:b])) for a, b in own) == hit and all(x[1] < y[0] for x, y in zip(own, own[1:]))
    assert any(len(x) > 1 for x in spans.values())


def test_empty_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (r,) = decontam.judge(decontam.scan_documents(docs, spark.createDataFrame([], "item_id long, text string"))).collect()
    assert (r["_n_words"], r["_n_hit"], list(r["_items"]), r["_contaminated"]) == (2, 0, [], False)
    assert decontam.scan_documents(docs.limit(0), docs.selectExpr("doc_id AS item_id", "text")).count() == 0


def test_many_items_in_one_scan(spark):
    """Items that share passages, repeat, overlap and end short, against all windows one by one."""
    rnd = random.Random(21)
    word = lambda: rnd.choice("ab") + rnd.choice("cdefg")
    base = [[word() for _ in range(40)] for _ in range(5)]
    items = []
    for i in range(300):
        b = rnd.choice(base)
        a = rnd.randrange(30)
        items.append((i, " ".join([*(word() for _ in range(rnd.randrange(3))), *b[a : a + rnd.randrange(1, 30)], *(word() for _ in range(rnd.randrange(4)))])))
    items += [(400, items[3][1]), (None, " ".join(base[0])), (401, None), (402, "--")]
    machine, single = decontam.Automaton(items), {}
    for i, t in items:
        w = decontam.words_of((t or "").encode())
        for k in range(max(1, len(w) - 12) if w else 0):
            single.setdefault(tuple(w[k : k + 13]), set()).add(i)
    for _ in range(300):
        b = rnd.choice(base)
        text = [*(word() for _ in range(rnd.randrange(6))), *b[rnd.randrange(20) :][: rnd.randrange(40)], *(word() for _ in range(rnd.randrange(20)))]
        words = [w.encode() for w in text]
        hit, who = set(), set()
        for size in range(1, 14):
            for k in range(len(words) - size + 1):
                if found := single.get(tuple(words[k : k + size])):
                    hit |= set(range(k, k + size))
                    who |= found - {None}
        spans, items_found = machine.scan(words)
        assert {x for a, b in spans for x in range(a, b)} == hit and items_found == who
    docs = spark.createDataFrame([(1, " ".join(base[1]), "x", 2)], "doc_id long, text string, _spans string, _n_hit int")
    got = decontam.judge(decontam.scan_documents(docs, spark.createDataFrame(items, "item_id long, text string")))
    assert got.columns[:4] == docs.columns and got.first()["__contaminated"] and got.first()["_spans"] == "x"
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
