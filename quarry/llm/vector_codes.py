"""Vector code compression: product codes whose nearest entries are found by segment-mean lower bounds.

A vector's components become integers and are cut into equal parts; each part is replaced by the number of its
nearest codebook entry. The codebooks are refined in rounds: every part goes to its nearest entry, and entries move
to the floor of the mean of their parts. All sums are of integers, so results don't depend on how Spark deals rows.

Nearest entries are found coarse to fine. Over a block of L components two vectors are at least
``(S - S')^2 / L + (R - R')^2`` apart, with S the blocks' sums and R the lengths of what is left after their means
are taken off. The bound over one block per part drops most entries, bounds over two and four blocks drop more, and
exact integer distances decide among the survivors. An entry is dropped only if its bound, less a margin for
rounding, is above the exact distance of an entry already looked at; ties all survive.

Per round a task returns one row of sums for each entry it used, at most ``PARTS * ENTRIES``; the driver holds the
codebooks, whose size does not depend on the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, tidy

#: Parts of a vector, entries of a part's codebook, rounds of refinement, and what a component is multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components from here on, after scaling, would not leave squared distances exact.
LARGEST = 1 << 27
#: Vectors that one numpy pass works on.
ROWS = 4096
#: Least components of a block.
BLOCK = 4


def integers(vectors: DataFrame, vec: str = "embedding", scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component as ``array<int>``; null where the vector can't take part.

    That is a null or empty vector and one with a null, non-finite or, after scaling, too large component.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(F.floor(F.lit(float(scale)) * F.when(F.isnan(x) | (F.abs(x) > 1e300), 0.0).otherwise(x))) >= LARGEST) | (F.abs(x) > 1e300)
    doubles = F.transform(F.col(vec), lambda x: x.cast("double"))
    usable = F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.exists(doubles, bad)
    return F.when(usable, F.transform(doubles, lambda x: F.floor(F.lit(float(scale)) * x).cast("int")))


class Blocks:
    """Block sums and residual lengths of some parts, by level from coarse to fine."""

    def __init__(self, rows: np.ndarray):
        self.rows, width = rows, rows.shape[1]
        self.levels = []
        n = 1
        while n == 1 or (width % n == 0 and width // n >= BLOCK):
            cut = rows.reshape(len(rows), n, width // n).astype(np.float64)
            total = cut.sum(2)
            rest = np.sqrt(np.maximum(0, (cut * cut).sum(2) - total * total / (width // n)))
            self.levels.append((total, rest, width // n))
            n *= 2
        self.square = (rows.astype(np.float64) ** 2).sum(1)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(-1)


def nearest(rows: np.ndarray, entries: Blocks) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row (integers) the nearest entry - the lowest of equals - and its squared distance; and how many exact distances it took."""
    own = Blocks(rows)
    row = np.repeat(np.arange(len(rows)), len(entries.rows))
    entry = np.tile(np.arange(len(entries.rows)), len(rows))
    best, taken = np.full(len(rows), np.iinfo(np.int64).max), 0
    for level, ((sx, rx, width), (sy, ry, _)) in enumerate(zip(own.levels, entries.levels)):
        if level == 0:
            bound = ((sx - sy.T) ** 2 / width + (rx - ry.T) ** 2).ravel()  # one block: all entries at once
        else:
            bound = ((sx[row] - sy[entry]) ** 2 / width + (rx[row] - ry[entry]) ** 2).sum(1)
        bound -= 1e-9 * (own.square[row] + entries.square[entry])
        # the entry of least bound in each row is looked at
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(bound, starts)
        hit = np.flatnonzero(bound == np.repeat(least, np.diff(np.append(starts, len(row)))))
        first = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
        best[row[first]] = np.minimum(best[row[first]], exact(rows[row[first]], entries.rows[entry[first]]))
        taken += len(first)
        left = bound <= best[row]
        row, entry = row[left], entry[left]
    distance = exact(rows[row], entries.rows[entry])
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(distance, starts)
    hit = np.flatnonzero(distance == np.repeat(least, np.diff(np.append(starts, len(row)))))
    first = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
    return entry[first], distance[first], taken + len(row)


def _cut(lists: pa.Array, parts: int) -> np.ndarray:
    """Rows, parts, components."""
    return np.asarray(lists.flatten(), dtype=np.int64).reshape(len(lists), parts, -1)


def _chosen(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of batches with their vectors, entries and distances, of all parts."""
    entries = [Blocks(b) for b in books]
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            cut = _cut(b.column(b.schema.get_field_index("v")), len(books))
            found = [nearest(cut[:, p], e) for p, e in enumerate(entries)]
            yield b, cut, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def refine(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over ``table`` (v array<int>): entries become the floor of their parts' mean."""
    parts, k, width = books.shape
    shared = table.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for _, cut, entry, _ in _chosen(batches, shared.value):
            for p in range(parts):
                np.add.at(total[p], entry[:, p], cut[:, p])
                count[p] += np.bincount(entry[:, p], minlength=k)
        p, e = np.nonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), pa.array(total[p, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), sums], ["part", "entry", "n", "s"])

    sums = table.select("v").mapInArrow(tidy(run), "part int, entry int, n long, s array<long>")
    out = books.copy()
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width))).collect():  # parts x entries at most
        out[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    shared.unpersist()
    return out


def train(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks ``[part, entry, component]`` from a table ``(vec_id, v array<int>)`` of vectors of one length.

    They start as the vectors of the least ``entries`` ids; an id that repeats counts once, with its least vector,
    and rows without id don't serve as start. A table without ids has no entries.
    """
    first = table.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = refine(table, books)
    return books


def encode(table: DataFrame, books: np.ndarray) -> DataFrame:
    """The rows of ``table`` without ``v``, with ``code`` (two hex digits a part) and ``error`` (squared distances summed over parts)."""
    shared = table.sparkSession.sparkContext.broadcast(books)
    kept = [f for f in table.schema.fields if f.name != "v"]
    digits = np.array([f"{i:02x}" for i in range(ENTRIES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, entry, distance in _chosen(batches, shared.value):
            codes = ["".join(r) for r in digits[entry].tolist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in kept), pa.array(codes, pa.string()), pa.array(distance.sum(1), pa.int64())], [*(f.name for f in kept), "code", "error"])

    schema = table.select(*(f.name for f in kept)).withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).schema
    return table.mapInArrow(tidy(run), schema)


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([books[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(len(books))])


def usable(vectors: DataFrame, scratch: Scratch, id: str = "vec_id", vec: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """The table ``(vec_id, *keep, v)`` of the vectors that take part, written once.

    Besides those that ``integers`` rules out, vectors go whose length differs from that of the least id's vector or
    is no multiple of ``parts``. Repeated rows stay.
    """
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), *keep, integers(vectors, vec, scale).alias("v")).where(F.col("v").isNotNull() & (F.size("v") % parts == 0))
    table = scratch.table(rows, "integers")
    size = table.groupBy(F.size("v").alias("size")).agg(F.min("vec_id").alias("least")).orderBy(F.col("least").asc_nulls_last(), "size").first()
    return table.where(F.size("v") == size["size"]) if size else table


def codebooks_text(books: np.ndarray) -> str:
    """All components, decimal, by part, entry and place, with commas between."""
    return ",".join(map(str, books.ravel().tolist()))


def compress(vectors: DataFrame, id: str = "vec_id", vec: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, *keep, code, error)`` and the codebooks. Which vectors take part: see ``usable``.

    Without a vector with an id there are no codebooks, and no vector has a code. At most 256 entries.
    """
    if not 0 < entries <= ENTRIES:
        raise ValueError(f"a code digit pair names 1 to {ENTRIES} entries")
    table = usable(vectors, Scratch(vectors.sparkSession, "vector-codes"), id, vec, keep, parts, scale)
    books = train(table, parts, entries, rounds)
    return encode(table if books.shape[1] else table.limit(0), books), books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), keep=("label",))
    table = Scratch(spark, "vector-codes").table(coded, "codes")  # read for the labels' sums and for the rows
    sums = table.groupBy(F.col("label").alias("other")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return table.join(sums, F.col("label").eqNullSafe(F.col("other"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The same by plain distances to all entries, round by round."""
    floor = "CAST(FLOOR(1024 * CAST(x AS DOUBLE)) AS BIGINT)"
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: {floor}) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT vec_id, label, CAST(part AS INTEGER) AS part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS x FROM v, range(4) AS r(part))",
        "b0 AS MATERIALIZED (SELECT part, CAST(ROW_NUMBER() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS INTEGER) AS entry, x AS c FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY part ORDER BY vec_id) <= 256)",
    ]
    distance = "list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT p.vec_id, p.part, MIN({distance} * 256 + b.entry) AS m FROM p JOIN b{i} b USING (part) GROUP BY p.vec_id, p.part)")
        if i < ROUNDS:
            steps.append(
                f"s{i} AS MATERIALIZED (SELECT part, entry, k, SUM(y) AS s, COUNT(*) AS n FROM (SELECT a.part, CAST(a.m % 256 AS INTEGER) AS entry, UNNEST(range(len(p.x))) AS k, UNNEST(p.x) AS y FROM a{i} a JOIN p USING (vec_id, part)) GROUP BY part, entry, k), "
                f"n{i} AS MATERIALIZED (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS c FROM s{i} GROUP BY part, entry), "
                f"b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, COALESCE(n.c, b.c) AS c FROM b{i} b LEFT JOIN n{i} n USING (part, entry))"
            )
    last = ROUNDS
    return (
        "WITH " + ", ".join(steps) + f", e AS (SELECT vec_id, string_agg(printf('%02x', CAST(m % 256 AS INTEGER)), '' ORDER BY part) AS code, CAST(SUM(m // 256) AS BIGINT) AS error FROM a{last} GROUP BY vec_id), "
        f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{last}) "
        "SELECT e.vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN v USING (vec_id), h"
    )


SQL = _sql()
