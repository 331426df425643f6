"""Quality rules: counts and verdicts against plain loops, the estimate against one on all rows, and planted outliers."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np

from quarry.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, text string, lang string, source string"


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def vector(text):
    n, chars, symbols, dup, repeat = plain(text)
    lines = max(1, sum(bool(WORD.search(x)) for x in text.split("\n")))
    raw = (math.log(chars / n), math.log1p(10 * symbols / n), math.log1p(dup / lines), math.log1p(repeat / n))
    return [math.floor(min(x, top) / step + 0.5) for x, (_, step, top, _) in zip(raw, q.VECTOR)]


def texts(n, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9)))
    out = [" ".join(word() for _ in range(rnd.randrange(12, 80))) for _ in range(n)]
    return out, word, rnd


def test_counts(spark):
    base, word, rnd = texts(30)
    rows = [*base, None, "", " \t\n\n", "a\na\n a\na\r\n\nb", "x x x x x x x", "é ü *# <b> 日本 " * 9, " ".join(["A b C d e f"] * 3 + ["a B c D e f"]), "w " * 20_000, "one two three four five six one two three four five", "\n".join(["same line"] * 4 + ["Same line"])]
    df = spark.createDataFrame([(i, t, "en", "s", "x") for i, t in enumerate(rows)], SCHEMA + ", n_words string")
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in q.statistics(df).collect()}
    assert got == {i: plain(t) for i, t in enumerate(rows)}


def test_kept_equals_the_estimate_on_rows(spark):
    base, word, rnd = texts(260)
    rows = [(i, t, "en", "a" if i % 2 else None) for i, t in enumerate(base)]
    rows += [(1000 + i, " ".join(word() + "$%&" for _ in range(30)), "en", "a") for i in range(25)]
    rows += [(2000 + i, " ".join(word() for _ in range(4)), "en", "a") for i in range(5)] + [(3000 + i, t, None, "few") for i, t in enumerate(base[:5])] + [rows[3], (None, base[1], "en", "a"), (5000, None, None, None)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], SCHEMA + ", kept int, centre double")
    got = sorted(((r.doc_id, r.base_failed, r.kept) for r in q.quality(df).collect()), key=repr)
    failed = {id(r): (c := plain(r[1]))[0] < 10 or 100 * c[4] > 20 * c[0] for r in rows}
    steps, models = np.array([v[1] for v in q.VECTOR]), {}

    def model(rows):
        x = np.array(sorted(vector(r[1]) for r in rows)) * steps
        return q.covariance_determinant(x, np.ones(len(x), np.int64))

    passed = [r for r in rows if not failed[id(r)]]
    want = []
    for r in rows:
        if failed[id(r)]:
            want.append((r[0], True, False))
            continue
        group = next(g for g in ([s for s in passed if s[2:] == r[2:]], [s for s in passed if s[2] == r[2]], passed) if len(g) >= q.LEAST or len(g) == len(passed))
        key = tuple(map(id, group))
        models[key] = models.get(key) or model(group)
        d = q.distances(np.array([vector(r[1])]) * steps, *models[key])[0]
        want.append((r[0], False, bool(d <= q.chi2_quantile(q.CUTOFF, 4))))
    assert got == sorted(want, key=repr) and len(models) == 3
    assert not any(k for i, _, k in got if i and 1000 <= i < 2000) and sum(k for i, _, k in got if i and i < 1000) >= 258


def test_estimate_is_the_least_determinant():
    """On few points the concentration steps find the subset of least determinant of all subsets."""
    rng = np.random.default_rng(4)
    x = np.round(np.concatenate([rng.normal(size=(9, 2)), rng.normal(size=(3, 2)) + 8]), 2)
    floor, h = np.zeros(2) + 1e-9, 9
    best = min(itertools.combinations(range(12), h), key=lambda s: np.linalg.det(q._moments(x[list(s)], np.ones(h))[1]))
    assert set(best) == set(range(9))
    centre, scatter = q.covariance_determinant(x, np.ones(12, np.int64), h / 12, floor)
    d = q.distances(x, centre, scatter)
    assert d[9:].min() > q.chi2_quantile(0.9999, 2) > d[:9].max()
    twice = q.covariance_determinant(x, np.full(12, 2, np.int64), h / 12, floor)  # copies weigh as rows
    assert np.allclose(twice[0], centre) and np.allclose(twice[1], scatter)


def test_chi_square():
    assert [round(q.chi2_quantile(p, 4), 3) for p in (0.5, 0.975, 0.9999)] == [3.357, 11.143, 23.513]


def test_no_documents(spark):
    assert q.quality(spark.createDataFrame([], SCHEMA)).count() == 0
    got = q.quality(spark.createDataFrame([(1, "few words", "en", "s")], SCHEMA)).first()
    assert got.base_failed and not got.kept and got.distance is None
