"""Quality rules: counts per text, and robust multivariate outliers by language and source.

1. Every whole text gives counts: words, their characters, symbols, repeated lines, words in repeated windows.
   Two fixed rules on them come first (``base_failed``).
2. What passes becomes a vector of four transformed statistics (``VECTOR``), rounded to a grid. The distinct vectors
   of a language and source and how often each occurs are all that the estimate needs, and the grid bounds their
   number whatever the corpus, so a group of any size is one bounded row.
3. Each group's centre and scatter are minimum-covariance-determinant estimates: concentration steps (Rousseeuw and
   Van Driessen 1999) from three deterministic starts keep the ``SHARE`` of vectors nearest to the estimate until the
   determinant stands still, corrected for consistency and reweighted. ``FLOOR`` is added to the scatter: a statistic
   that is the same in most texts would have no spread else (as in Boudt et al. 2020).
4. A text whose squared Mahalanobis distance exceeds the ``CUTOFF`` quantile of chi-square is rejected. Groups of less
   than ``LEAST`` texts that passed the fixed rules use the estimate of their language, or of all texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quarry.llm.common import HASH_BYTES, Scratch, bytes_of, chunks, mix, small_batches, text_array, tidy, unused, word_hashes, word_spans

#: Words of a repeated window.
WINDOW = 5
#: Share of the vectors that an estimate concentrates on, and quantiles of chi-square: for reweighting and rejection.
SHARE, REWEIGHT, CUTOFF = 0.75, 0.975, 0.9999
#: Vectors below which a group uses a wider one's estimate.
LEAST = 100
#: The statistics: name, step of the grid, largest value, and least standard deviation.
VECTOR = (("word_length", 0.04, 5.0, 0.12), ("symbols", 0.1, 6.0, 0.2), ("same_lines", 0.05, 0.7, 0.15), ("repeats", 0.02, 0.7, 0.08))
FLOOR = np.array([v[3] ** 2 for v in VECTOR])
#: Groups that are looked up from a broadcast; more meet the texts in a shuffle.
BROADCAST_GROUPS = 10_000

_SYMBOL = np.zeros(256, np.bool_)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def counts(texts: pa.Array, window: int = WINDOW) -> list[np.ndarray]:
    """``COUNTS`` of each text.

    Words are parted by white space as they stand. Lines are parted by ``\\n`` and count if they have a word; one that
    equals an earlier line is repeated. A word is repeated if it lies in a run of ``window`` words that the text has twice.
    """
    data, offs = bytes_of(texts)
    starts, ends, first = word_spans(data, offs)
    n_words = np.diff(first)
    total = lambda mark: np.diff(np.concatenate([[0], np.cumsum(mark)])[offs])
    start = (data & 0xC0) != 0x80  # of a code point
    before = np.concatenate([[0], np.cumsum(start)])
    in_words = np.concatenate([[0], np.cumsum(before[ends] - before[starts])])
    word_chars = np.diff(in_words[first])

    row = np.repeat(np.arange(len(n_words)), n_words)
    h = word_hashes(data, starts, ends, fold=False)
    covered = np.zeros(len(h) + 1, np.int64)
    n = len(h) - window + 1
    if n > 0:
        with np.errstate(over="ignore"):
            weights = mix(np.arange(1, window + 1, dtype=np.uint64)) | np.uint64(1)
            rolled = mix(sum((h[i : i + n] * weights[i] for i in range(window)), np.zeros(n, np.uint64)))
        place = np.flatnonzero(row[:n] == row[window - 1 :])  # windows within one text
        order = place[np.lexsort((rolled[place], row[place]))]
        same = (rolled[order[1:]] == rolled[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
        twice = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
        np.add.at(covered, twice, 1)
        np.subtract.at(covered, twice + window, 1)
    repeated = np.bincount(row, np.cumsum(covered)[:-1] > 0, len(n_words)).astype(np.int64)

    n_lines, n_dup = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
    raw = memoryview(np.ascontiguousarray(data))
    for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        lines = [x for x in bytes(raw[a:b]).split(b"\n") if x and not x.isspace()]
        n_lines[i], n_dup[i] = len(lines), len(lines) - len(set(lines))
    return [n_words, word_chars, total(_SYMBOL[data]), n_dup, repeated, n_lines]


def statistics(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without ``text``, with ``COUNTS`` as longs. A null text has no words and no lines.

    Columns of ``docs`` with these names are replaced. A text of any length is one set of arrays in one task.
    """
    kept = [c for c in docs.columns if c != text and c not in COUNTS]
    rows = docs.select(*kept, F.col(text).cast("string").alias(unused("text", kept)))
    name = rows.columns[-1]
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, name, HASH_BYTES):
            found = counts(text_array(t[name]), window)
            yield pa.RecordBatch.from_arrays([*(t[c].combine_chunks() for c in kept), *(pa.array(x, pa.int64()) for x in found)], [*kept, *COUNTS])

    return rows.mapInArrow(tidy(run), rows.drop(name).withColumns({c: F.lit(0).cast("long") for c in COUNTS}).schema)


def base_failed() -> Column:
    """Fewer than ten words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vector() -> list[Column]:
    """Grid places (integers) of the transformed statistics of a text that has words."""
    n = F.col("n_words").cast("double")
    raw = (F.log(F.col("word_chars") / n), F.log1p(10 * F.col("n_symbols") / n), F.log1p(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), F.log1p(F.col("n_repeat_words") / n))
    return [F.floor(F.least(x, F.lit(top)) / F.lit(step) + F.lit(0.5)).cast("int").alias(name) for x, (name, step, top, _) in zip(raw, VECTOR)]


# --- estimates -----------------------------------------------------------------------------------


def chi2_share(x: float, df: int) -> float:
    """The distribution function of chi-square, for even degrees of freedom."""
    term = total = 1.0
    for i in range(1, df // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, df: int) -> float:
    lo, hi = 0.0, 1.0
    while chi2_share(hi, df) < p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_share(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def _moments(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    centre = w @ x / w.sum()
    d = x - centre
    return centre, (d * w[:, None]).T @ d / w.sum()


def distances(x: np.ndarray, centre: np.ndarray, scatter: np.ndarray) -> np.ndarray:
    d = x - centre
    return np.einsum("ij,ij->i", d @ np.linalg.inv(scatter), d)


def _nearest(d: np.ndarray, w: np.ndarray, h: int) -> np.ndarray:
    """How many of each vector's copies are among the h of least distance; of equals the earlier vectors."""
    order = np.argsort(d, kind="stable")
    before = np.cumsum(w[order]) - w[order]
    taken = np.zeros_like(w)
    taken[order] = np.clip(h - before, 0, w[order])
    return taken


def concentrate(x: np.ndarray, w: np.ndarray, h: int, centre: np.ndarray, scatter: np.ndarray, factor: float, floor: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Concentration steps from one start until the determinant stands still: its logarithm, centre and scatter."""
    last = np.inf
    while True:
        c, s = _moments(x, _nearest(distances(x, centre, scatter), w, h))
        s = s * factor + np.diag(floor)
        det = float(np.linalg.slogdet(s)[1])
        if det >= last - 1e-12:
            return last, centre, scatter
        last, centre, scatter = det, c, s


def covariance_determinant(x: np.ndarray, w: np.ndarray, share: float = SHARE, floor: np.ndarray = FLOOR) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter of vectors ``x``, each ``w`` times: the reweighted minimum-covariance-determinant estimate."""
    df = x.shape[1]
    x = x.astype(np.float64)
    h = int(math.ceil(share * int(w.sum())))
    factor = lambda p: p / chi2_share(chi2_quantile(p, df), df + 2)

    def median(v: np.ndarray, weight: np.ndarray) -> float:
        order = np.argsort(v, kind="stable")
        return float(v[order][np.searchsorted(np.cumsum(weight[order]), weight.sum() / 2)])

    middle = np.array([median(c, w) for c in x.T])
    spread = np.array([1.4826 * median(np.abs(c - m), w) for c, m in zip(x.T, middle)])
    wide = np.diag(spread**2 + floor)
    unit = (x - middle) / np.sqrt(np.diag(wide))
    length = np.sqrt((unit * unit).sum(1))
    signs = unit / np.where(length > 0, length, 1)[:, None]
    turned = (signs * w[:, None]).T @ signs / w.sum() * df
    scale = np.sqrt(np.diag(wide))
    classic = _moments(x, w)
    starts = [(middle, wide), (middle, turned * scale[:, None] * scale + np.diag(floor)), (classic[0], classic[1] + np.diag(floor))]
    _, centre, scatter = min((concentrate(x, w, h, c, s, factor(share), floor) for c, s in starts), key=lambda r: r[0])
    inside = np.where(distances(x, centre, scatter) <= chi2_quantile(REWEIGHT, df), w, 0)
    centre, scatter = _moments(x, inside)
    return centre, scatter * factor(REWEIGHT) + np.diag(floor)


_KEYS = ("lang", "source")


def estimates(stats: DataFrame, least: int = LEAST) -> DataFrame:
    """``(lang, source, centre, inverse)`` for each language and source of ``stats``, null being one of them.

    ``stats`` has ``lang``, ``source`` and ``COUNTS``. Groups without a text that passes the fixed rules are absent.
    """
    size, steps = len(VECTOR), np.array([v[1] for v in VECTOR])
    names = [v[0] for v in VECTOR]
    cells = stats.where(~base_failed()).select(*_KEYS, *vector()).groupBy(*_KEYS, *names).agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            centres, inverses = [], []
            for cell in b.column(b.schema.get_field_index("cells")):
                if not len(cell):  # the row of all texts, without any
                    centres.append(None)
                    inverses.append(None)
                    continue
                rows = np.array(sorted(tuple(c.values()) for c in cell.as_py()), np.int64)
                centre, scatter = covariance_determinant(rows[:, :size] * steps, rows[:, size])
                centres.append(centre.tolist())
                inverses.append(np.linalg.inv(scatter).ravel().tolist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(centres, pa.list_(pa.float64())), pa.array(inverses, pa.list_(pa.float64()))], [*b.schema.names[:-1], "centre", "inverse"])

    def fitted(keys: list[str]) -> DataFrame:
        each = cells.groupBy(*keys, *names).agg(F.sum("n").alias("n")).groupBy(*keys)
        # the cells of a group are bounded by the grid
        rows = each.agg(F.sum("n").alias("texts"), F.collect_list(F.struct(*names, "n")).alias("cells"))
        numbers = [StructField(n, ArrayType(DoubleType())) for n in ("centre", "inverse")]
        return rows.mapInArrow(tidy(run), StructType([*rows.schema.fields[:-1], *numbers]))

    scratch = Scratch(stats.sparkSession, "quality")
    cells = scratch.table(cells, "cells")
    groups, langs, every = (scratch.table(fitted(keys), f"level{len(keys)}") for keys in (list(_KEYS), ["lang"], []))
    wider = lambda df, mark: df.select(*(F.col(c).alias(f"{mark}_{c}") for c in df.columns))
    both = groups.join(wider(langs, "l"), F.col("lang").eqNullSafe(F.col("l_lang"))).crossJoin(F.broadcast(wider(every, "e")))  # one row
    pick = lambda c: F.when(F.col("texts") >= least, F.col(c)).when(F.col("l_texts") >= least, F.col(f"l_{c}")).otherwise(F.col(f"e_{c}")).alias(c)
    return scratch.table(both.select(*_KEYS, pick("centre"), pick("inverse")), "estimates")


def judge(stats: DataFrame, models: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``stats`` with ``base_failed``, ``distance`` (squared; null where the fixed rules failed) and ``kept``."""
    size, stats = len(VECTOR), stats.drop("base_failed", "distance", "kept")
    lang, source, centre, inverse, off = own = [unused(f"_{n}", stats.columns) for n in ("lang", "source", "centre", "inverse", "off")]
    m = models.select(*(F.col(a).alias(b) for a, b in zip(("lang", "source", "centre", "inverse"), own)))
    m = F.broadcast(m) if models.count() <= BROADCAST_GROUPS else m
    rows = stats.withColumn("base_failed", base_failed()).join(m, F.col("lang").eqNullSafe(F.col(lang)) & F.col("source").eqNullSafe(F.col(source)), "left")
    apart = F.array(*(x * F.lit(step) - F.col(centre)[i] for i, (x, (_, step, *_)) in enumerate(zip(vector(), VECTOR))))
    squared = sum((F.col(off)[i] * F.col(off)[j] * F.col(inverse)[i * size + j] for i in range(size) for j in range(size)), F.lit(0.0))
    found = rows.withColumn(off, F.when(~F.col("base_failed"), apart)).withColumn("distance", squared)
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= F.lit(chi2_quantile(cutoff, size)))).drop(*own)


def quality(docs: DataFrame, text: str = "text", least: int = LEAST, cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` without ``text``, with ``COUNTS``, ``base_failed``, ``distance`` and ``kept``, one row per input row.

    ``docs`` has ``lang`` and ``source``; a null there is a value like others. Null and empty texts have no words and
    fail. Repeated rows stay and count as often as they stand. An empty table gives an empty result. Columns of ``docs``
    with the new names are replaced; others stay.
    """
    stats = Scratch(docs.sparkSession, "quality").table(statistics(docs, text), "counts")
    return judge(stats, estimates(stats, least), cutoff)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
