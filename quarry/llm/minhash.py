"""MinHash near-duplicates: bottom-k sketches from one hash function, and exact confirmation.

1. Every text becomes a set of word shingles (64-bit hashes), its size, a digest of the set and a sketch: the
   k least hashes. Texts of one set are one class from here on, whatever their ids; a class has a number of its own.
2. Inverted lists of the retained values: a class keeps as keys only its rarest retained values - as many as
   guarantee that two sketches with the required overlap share a key - so common passages make no long lists.
   A value that only one class retains has no list at all.
3. A few lists of each class tie it to a hub that the list chooses. If the sketch of the union - the k least
   values of both sketches - estimates enough overlap, the pair is confirmed on the full sets. Components form.
4. What is left: classes that lists join, whose components differ. They meet in blocks of bounded size, on
   the full sets, each pair of blocks in one task, which returns a spanning forest of the links it finds.
   Members of the largest component of what lists join never meet each other; no pair is a row of a table.
5. Components by joining up blocks of links, each in a task; between blocks by alternating large-star and small-star
   steps (Kiveris et al. 2014) on tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import HASH_BYTES, Scratch, bytes_of, chunks, mix, partitions, small_batches, text_array, tidy, word_hashes, word_spans
from quarry.operators import graph

#: Values in a sketch.
K = 64
#: Share of the union sketch that must agree for a candidate: five standard deviations below 0.8 at k = 64.
LEAST = 0.55
#: Lists of a class whose hubs are tried first.
FIRST = 4
#: Classes and shingles in a block.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 250_000
#: Links that one task joins up.
BLOCK_EDGES = 200_000


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle; one without words has none."""
    data, offs = bytes_of(texts)
    starts, ends, first = word_spans(data, offs)
    h = word_hashes(data, starts, ends)
    out = []
    with np.errstate(over="ignore"):
        weights = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
        n = len(h) - words + 1
        rolled = mix(sum((h[i : i + n] * weights[i] for i in range(words)), np.zeros(max(n, 0), np.uint64))) if n > 0 else np.zeros(0, np.uint64)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                s = np.sort(rolled[a : b - words + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif b > a:
                out.append(mix((h[a:b] * weights[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _signed(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([s.tobytes() for s in sets], pa.binary())


def sketches(docs: DataFrame, words: int, k: int = K) -> DataFrame:
    """``(doc_id, k1, k2, n, digest binary, sketch array<long>)`` of each row; digest is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, "text", HASH_BYTES):
            sets = shingle_sets(text_array(t["text"]), words)
            low = [s[:k].view(np.int64) for s in sets]
            bounds = np.concatenate([[0], np.cumsum([len(s) for s in low])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(t[c].combine_chunks() for c in ("doc_id", "k1", "k2")), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest_of(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(low) if low else np.zeros(0, np.int64))),
                ], ["doc_id", "k1", "k2", "n", "digest", "sketch"],
            )

    return docs.mapInArrow(tidy(run), "doc_id long, k1 long, k2 long, n long, digest binary, sketch array<bigint>")


def digest_of(s: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def class_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """``(id, full)``: the full set of each class of ``wanted`` (id), from its representative text.

    ``docs`` is ``(doc_id, k1, k2, text)``: id and text's keys name one text, however often either repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, "text", HASH_BYTES):
            yield pa.RecordBatch.from_arrays([t["id"].combine_chunks(), _signed(shingle_sets(text_array(t["text"]), words))], ["id", "full"])

    named = wanted.join(classes.select("id", "rep.*"), "id")
    return docs.join(named, ["doc_id", "k1", "k2"]).select("id", "text").mapInArrow(tidy(run), "id long, full binary").dropDuplicates(["id"])


def union_overlap(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """The share of the union's sketch that lies in both sketches (unsigned order)."""
    both = np.union1d(a, b)[:k]
    return float(np.isin(both, a, assume_unique=True).__and__(np.isin(both, b, assume_unique=True)).mean()) if len(both) else 0.0


def _estimates(x: pa.Array, y: pa.Array, k: int) -> np.ndarray:
    """``union_overlap`` of many pairs at once."""

    def padded(lists: pa.Array) -> np.ndarray:
        offs, flat = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint64)
        n = np.diff(offs)
        out = np.full((len(n), k), np.iinfo(np.uint64).max)
        out[np.repeat(np.arange(len(n)), n), np.arange(offs[0], offs[-1]) - np.repeat(offs[:-1], n)] = flat[offs[0] : offs[-1]]
        return out

    both = np.sort(np.concatenate([padded(x), padded(y)], axis=1), axis=1)
    real = both != np.iinfo(np.uint64).max
    twin = np.zeros_like(real)
    twin[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~twin, axis=1)  # of each distinct value
    inside = rank <= k
    return (twin & inside).sum(1) / np.maximum(1, (real & ~twin & inside).sum(1))


def estimate_pairs(pairs: DataFrame, classes: DataFrame, k: int, least: float) -> DataFrame:
    """``(a, b, est)`` of the pairs that sizes and the union's sketch leave over."""
    side = lambda p: classes.select(F.col("id").alias(p), F.col("sketch").alias(f"s{p}"), F.col("n").alias(f"n{p}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                est = _estimates(t.column(2), t.column(3), k)
                keep = np.flatnonzero(est >= least)
                yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(keep)), t.column(1).take(pa.array(keep)), pa.array(est[keep])], ["a", "b", "est"])

    return both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * 80).select("a", "b", "sa", "sb").mapInArrow(tidy(run), "a long, b long, est double")


def confirm_pairs(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, scratch: Scratch, name: str) -> DataFrame:
    """``(a, b)`` of the pairs whose full sets have 100 * intersection >= 80 * union."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    full = scratch.table(class_sets(wanted, classes, docs, words), f"sets{name}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for i, (x, y) in enumerate(zip(t.column(2), t.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= 80 * (len(both) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(keep, pa.int64())), t.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    both = pairs.select("a", "b").join(full.select(F.col("id").alias("a"), F.col("full").alias("fa")), "a").join(full.select(F.col("id").alias("b"), F.col("full").alias("fb")), "b")
    out = scratch.table(both.select("a", "b", "fa", "fb").mapInArrow(tidy(run), "a long, b long"), f"links{name}")
    scratch.drop(f"sets{name}")
    return out


def components(links: DataFrame, scratch: Scratch, name: str, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """``(id, component)``: the smallest id reachable, for every other id in ``links`` (a, b).

    Blocks of edges are joined up in one task each, again while that halves them; one block ends it. Else large-star
    and small-star rounds carry on until the star forest stands still. Each step is a table.
    """
    edges = scratch.table(links.where("a <> b").select(F.greatest("a", "b").alias("i"), F.least("a", "b").alias("j")).distinct(), f"{name}-0")
    step, left = 0, edges.count()
    while True:
        stars, blocks = graph.contracted(edges, blocks=partitions(left, block_edges))
        step += 1
        edges, before = scratch.table(stars, f"{name}-{step}"), left
        scratch.drop(f"{name}-{step - 1}")
        if blocks == 1:
            return edges.select(F.col("i").alias("id"), F.col("j").alias("component"))
        left = edges.count()
        if 2 * left > before:
            break
    edges, state = edges.select(F.col("i").alias("u"), F.col("j").alias("v")), None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        nxt = scratch.table(small, f"{name}-{step}")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{step - 1}")
        if now == state or not now[0]:
            return nxt.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state, edges = now, nxt


def cross_links(x: list[np.ndarray], y: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and y of the sets with 100 * intersection >= 80 * union.

    Values that few pairs share are counted pair by pair, the others by products of indicator matrices.
    """
    nx, ny = (np.fromiter(map(len, s), np.int64, len(s)) for s in (x, y))
    vx, vy = np.concatenate(x), np.concatenate(y)
    dx, dy = np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(y)), ny)
    common = np.intersect1d(vx, vy)
    if not len(common):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def coded(v: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(common, v), len(common) - 1)
        real = common[at] == v
        order = np.argsort(at[real], kind="stable")
        return at[real][order], d[real][order], np.bincount(at[real], minlength=len(common))

    (cx, dx, fx), (cy, dy, fy) = coded(vx, dx), coded(vy, dy)
    out = np.zeros((len(x), len(y)))
    few = fx * fy <= 256
    kx, ky = few[cx], few[cy]
    sx, sy = np.cumsum(fx) - fx, np.cumsum(fy) - fy
    # each entry of x meets the entries of y with its value
    left = np.flatnonzero(kx)
    n = fy[cx[left]]
    right = np.repeat(sy[cx[left]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out += np.bincount(np.repeat(dx[left], n) * len(y) + dy[right], minlength=len(x) * len(y)).reshape(out.shape)
    many = np.flatnonzero(~few)
    for a in range(0, len(many), 4096):
        part = many[a : a + 4096]
        place = np.full(len(common), -1)
        place[part] = np.arange(len(part))
        mx, my = np.zeros((len(x), len(part)), np.float32), np.zeros((len(y), len(part)), np.float32)
        px, py = place[cx], place[cy]
        mx[dx[px >= 0], px[px >= 0]] = 1
        my[dy[py >= 0], py[py >= 0]] = 1
        out += mx @ my.T
    return np.nonzero(100 * out >= 80 * (nx[:, None] + ny[None, :] - out))


def block_links(tied: DataFrame, classes: DataFrame, comp: DataFrame, docs: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """``(a, b)``: links between classes of different components among those that lists join, enough to connect them."""
    joined = components(tied.select(F.col("id").alias("a"), F.col("hub").alias("b")), scratch, "joined").withColumnRenamed("component", "pool")
    joined = joined.unionByName(joined.select(F.col("pool").alias("id"), "pool").distinct()).distinct()
    named = joined.join(comp, "id", "left").join(classes.select("id", "n"), "id").select("id", "pool", "n", F.coalesce("component", "id").alias("c"))
    sizes = named.groupBy("pool", "c").agg(F.count("*").alias("m"))
    main = sizes.groupBy("pool").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("pool", "main")
    mixed = scratch.table(named.join(main, "pool").select("id", "pool", "n", "c", (F.col("c") == F.col("main")).alias("major")), "mixed")
    blocks = mixed.groupBy("pool", "major").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_CLASSES)).cast("int").alias("blocks"))
    wide = blocks.groupBy("pool").agg(F.coalesce(F.max(F.when(F.col("major"), F.col("blocks"))), F.lit(0)).alias("p"), F.coalesce(F.max(F.when(~F.col("major"), F.col("blocks"))), F.lit(0)).alias("q"))

    full = class_sets(mixed.select("id"), classes, docs, words)
    # blocks 0 to q - 1 hold the minor components, q to q + p - 1 the largest one; a minor block meets all blocks from itself on
    count = F.when(F.col("major"), F.col("p")).otherwise(F.col("q"))
    own = F.pmod(F.xxhash64("id"), count).cast("int") + F.when(F.col("major"), F.col("q")).otherwise(0)
    placed = scratch.table(mixed.join(wide, "pool").withColumn("block", own).join(full, "id").select("id", "c", "pool", "p", "q", "block", "full"), "placed")
    lower = F.transform(F.sequence(F.lit(0), F.least("block", F.col("q") - 1)), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))
    upper = F.when(F.col("block") < F.col("q"), F.transform(F.sequence(F.col("block"), F.col("p") + F.col("q") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    dealt = placed.select("id", "c", "pool", "block", "full", F.explode(F.array_distinct(F.concat(lower, upper))).alias("t")).select("id", "c", "pool", "block", "full", "t.i", "t.j")

    def run(key, t):
        _, i, j = (k.as_py() for k in key)
        block, ids, comps = (np.asarray(t[n]) for n in ("block", "id", "c"))
        every = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["full"].combine_chunks()] if t.num_rows else []
        x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links = []
        if len(x) and len(y):
            a, b = cross_links([every[k] for k in x], [every[k] for k in y])
            root: dict[int, int] = {}

            def find(v: int) -> int:
                while root.setdefault(v, v) != v:
                    root[v] = v = root[root[v]]
                return v

            for u, v in zip(x[a].tolist(), y[b].tolist()):
                p, q = find(int(comps[u])), find(int(comps[v]))
                if p != q:
                    root[p] = q
                    links.append((int(ids[u]), int(ids[v])))
        return pa.table({"a": pa.array([u for u, _ in links], pa.int64()), "b": pa.array([v for _, v in links], pa.int64())})

    out = scratch.table(dealt.groupBy("pool", "i", "j").applyInArrow(run, "a long, b long"), "links2")
    scratch.drop("placed", "mixed")
    return out


def near_groups(docs: DataFrame, words: int = 5, k: int = K, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, k1, k2, n_shingles, component_id, group)``, one row per input row.

    ``k1`` and ``k2`` (``text_keys``) tell the texts of an id apart. ``group`` numbers what links connect and is null
    for rows without id or words; two groups share a ``component_id`` only if an id repeats with texts of both.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "minhash")
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    every = scratch.table(sketches(rows.select("*", *text_keys("text")), words, k), "sketches")
    known = every.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    best = known.groupBy("digest").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = scratch.table(best.withColumn("id", F.monotonically_increasing_id()), "classes")  # written, so that numbers stay
    every = scratch.table(every.select("doc_id", "k1", "k2", "n", "digest"), "members")
    scratch.drop("sketches")
    texts = rows.where("doc_id IS NOT NULL").select("doc_id", *text_keys("text"), "text")

    values = classes.select("id", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    entries = scratch.table(values.join(shared, "value"), "entries")
    # values that no other class retains come first in the order of rarity; they use up keys without a list
    rare = Window.partitionBy("id").orderBy("df", "value")
    tally = Window.partitionBy("id")
    must = F.ceil(F.col("size") * F.lit(LEAST))
    keys = scratch.table(
        entries.withColumns({"place": F.row_number().over(rare), "listed": F.count("*").over(tally)})
        .where(F.col("size") - F.col("listed") + F.col("place") <= F.col("size") - must + 1)
        .select("value", "id", "place"),
        "keys",
    )
    scratch.drop("entries")

    hub = keys.groupBy("value").agg(F.min_by("id", F.xxhash64("value", "id")).alias("hub"), F.count("*").alias("m")).where("m > 1").select("value", "hub")
    tied = scratch.table(keys.join(hub, "value").where("id <> hub").select("id", "hub", "place"), "tied")
    scratch.drop("keys")
    first = tied.where(F.col("place") <= FIRST).select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct()
    near = scratch.table(estimate_pairs(first, classes, k, LEAST), "near")
    links1 = confirm_pairs(near, classes, texts, words, scratch, "1")
    comp1 = components(links1, scratch, "stars1")
    links2 = block_links(tied, classes, comp1, texts, words, scratch)
    final = components(links1.unionByName(links2), scratch, "stars2")

    named = scratch.table(classes.select("id", "digest", F.col("rep.doc_id").alias("least")).join(final, "id", "left").select("digest", "least", F.coalesce("component", "id").alias("group")), "named")
    smallest = named.groupBy("group").agg(F.min("least").alias("component_id"))
    names = named.join(smallest, "group").select("digest", "group", "component_id")
    linked = F.col("doc_id").isNotNull()
    return every.join(names, "digest", "left").select(
        "doc_id", "k1", "k2", F.col("n").alias("n_shingles"), F.when(linked, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(linked, F.col("group")).alias("group")
    )


def text_keys(text: str) -> tuple[Column, Column]:
    """128 bits that tell texts apart, as ``k1`` and ``k2``."""
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")


def near_duplicates(docs: DataFrame, words: int = 5, k: int = K, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per input row.

    Texts are linked if their sets of ``words``-word shingles have a Jaccard similarity of 0.8 or more;
    ``component_id`` is the smallest id reachable over links, the own id included; ``kept`` marks the row whose
    id it is. Words are parted by white space and lower-cased in A-Z. Null and empty texts have no shingles and
    are linked to nothing. Rows that repeat an id stay: with one text each has the same result, with different
    texts each has that of its own text, whatever the order of rows. Rows of a null id keep null as component
    and are kept. Further columns are ignored. A text of any length is one set, in one task's memory.
    """
    found = near_groups(docs, words, k, doc, text)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("component_id") == F.col("doc_id"))).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
