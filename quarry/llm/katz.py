"""Language-model scoring: a Katz backoff bigram model with Good-Turing discounts.

Training text is what the held-out rule leaves. The probability of a token after its context is

    P(v | u) = d(c(u,v)) c(u,v) / c(u)      if the pair was seen in training,
               a(u) P(v)                    else;
    P(v)     = d'(c(v)) c(v) / N            if the token was seen, else the mass left over,

with Good-Turing discounts d, d' for counts up to five and backoff weights a(u) that make the sum over all
tokens, the unknown one included, exactly one. An unseen context backs off with weight one. Where the
counts of counts give no usable discount a count stays whole; a context that would leave nothing to unseen
tokens leaves them 1 / (c(u) + 1).

Texts are numbered once into a table of blocks. The n-gram tables are partitioned by hash: a block sends
the distinct words, then the distinct pairs it holds - each with its training count - to the partitions
they belong to, as packed arrays, and gets counts back; so a word or pair that fills a third of the corpus
is still one entry a block. Backoff weights need only sums over a context's pairs, which combine before
they are sent. No table is broadcast; only counts of counts reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, bytes_of, chunks, mix, partitions, small_batches, text_array, tidy, word_hashes

#: Text bytes in a block; entries in a partition of the word and pair tables; counts that are discounted.
BLOCK_BYTES, ENTRIES, K = 12 << 20, 400_000, 5
#: The context before a text's first token.
START = -1


def held_out(doc: Column) -> Column:
    """Rows never learned from: crc32(id as text) mod 10 is 0; a null id is learned from."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def pack(a: np.ndarray) -> bytes:
    """Numbers by byte planes - first all lowest bytes, then all next - compressed."""
    flat = np.ascontiguousarray(a).ravel()
    return zlib.compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, flat.itemsize).T).tobytes(), 1)


def unpack(raw: bytes, kind=np.int64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_words(words: pa.Array) -> bytes:
    """Words, which never hold a line end, one a line."""
    data, offs = bytes_of(words)
    return zlib.compress(np.insert(data, offs[1:], 10).tobytes(), 1)


def unpack_words(raw: bytes) -> pa.Array:
    data = np.frombuffer(zlib.decompress(raw), np.uint8)
    ends = np.flatnonzero(data == 10)
    offs = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data[data != 10]))])


def discounts(of: np.ndarray, k: int = K) -> np.ndarray:
    """Good-Turing discounts of counts 0 to k (Katz's form); ``of[r - 1]`` is how many have count r, r to k + 1.

    One, that is none, where the counts of counts give nothing between 0 and 1.
    """
    d = np.ones(k + 1)
    n = np.concatenate([[0], of]).astype(float)
    if n[1] > 0:
        a = (k + 1) * n[k + 1] / n[1]
        for r in range(1, k + 1):
            if n[r] > 0 and a < 1:
                x = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a)
                if 0 < x < 1:
                    d[r] = x
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c < len(d), d[np.minimum(c, len(d) - 1)], 1.0) * c


class Unigrams:
    """P(v) from counts: training tokens, distinct tokens and counts of counts."""

    def __init__(self, n: int, v: int, of: np.ndarray):
        self.n, self.v, self.d = n, v, discounts(of)
        small = np.arange(len(self.d))
        # of[r - 1] types have count r; the others keep their counts whole
        seen = n - float((of[:K] * small[1:]).sum()) + float((of[:K] * discounted(small, self.d)[1:]).sum())
        least = 1 / (n + 1)
        self.scale = (1 - least) * n / seen if n and 1 - seen / n < least else 1.0
        self.unknown = 1 - self.scale * seen / n if n else 1.0

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.scale * discounted(c, self.d) / max(1, self.n), self.unknown)


class Contexts:
    """What is left to unseen tokens after each context, from the sums over its pairs."""

    def __init__(self, ones: np.ndarray, large: np.ndarray, d: np.ndarray):
        """``ones[:, r - 1]``: pairs with count r; ``large``: the sum of counts above."""
        small = np.arange(1, K + 1)
        self.count = ones @ small + large
        kept = (ones @ discounted(np.arange(K + 1), d)[1:] + large) / np.maximum(self.count, 1)
        least = 1 / (self.count + 1)
        low = 1 - kept < least
        self.scale = np.where(low, (1 - least) / np.maximum(kept, 1e-300), 1.0)
        self.left = np.where(low, least, 1 - kept)


_BLOCK = "block long, docs array<bigint>, held array<boolean>, sizes binary, tokens binary, n_words long, words binary"


def number_blocks(rows: DataFrame) -> DataFrame:
    """Texts ``(doc_id, held, text)`` as blocks: token numbers (0 ends a text) into a list of distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for seq, t in enumerate(chunks(batches, "text", BLOCK_BYTES)):
            lists = pc.ascii_split_whitespace(pc.ascii_lower(text_array(t["text"]).cast(pa.large_string())))
            flat = lists.flatten()
            real = np.asarray(pc.binary_length(flat)) > 0
            bounds = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            sizes = np.diff(np.concatenate([[0], np.cumsum(real)])[bounds])
            coded = flat.filter(pa.array(real)).dictionary_encode()
            ends = np.cumsum(sizes)
            tokens = np.insert(np.asarray(coded.indices).astype(np.int32) + 1, ends, 0)
            words = coded.dictionary.cast(pa.large_binary()).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | seq], pa.int64()), pa.array([t["doc_id"].to_pylist()], pa.list_(pa.int64())), pa.array([t["held"].to_pylist()], pa.list_(pa.bool_())),
                    pa.array([pack((sizes + 1).astype(np.int32))], pa.binary()), pa.array([pack(tokens)], pa.binary()),
                    pa.array([len(words)], pa.int64()), pa.array([pack_words(words)], pa.binary()),
                ], ["block", "docs", "held", "sizes", "tokens", "n_words", "words"],
            )

    return rows.mapInArrow(tidy(run), _BLOCK)


def _word_parts(words: pa.Array, parts: int) -> np.ndarray:
    """The partition of each word of a block, with that of the end mark - partition 0 - before them."""
    data, offs = bytes_of(words)
    return np.concatenate([[0], (word_hashes(data, offs[:-1], offs[1:]) % np.uint64(parts)).astype(np.int64)])


class Block:
    """A block's arrays."""

    def __init__(self, row: dict):
        self.sizes, self.tokens = unpack(row["sizes"], np.int32).astype(np.int64), unpack(row["tokens"], np.int32).astype(np.int64)
        self.held = np.array(row["held"], np.bool_)
        self.learn = np.repeat(~self.held, self.sizes)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts and tokens of the distinct pairs (START is one past the last word), and the pair of each token."""
        start = int(self.tokens.max()) + 1 if len(self.tokens) else 1
        before = np.concatenate([[start], self.tokens[:-1]])
        before[np.cumsum(self.sizes) - self.sizes] = start
        key, which = np.unique(before << 32 | self.tokens, return_inverse=True)
        u = key >> 32
        return np.where(u == start, START, u), key & 0xFFFFFFFF, which


def _groups(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Members of each partition that has any, in ascending order."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, order[cuts[b] : cuts[b + 1]]


def send_words(blocks: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                row = {n: one.column(one.schema.get_field_index(n)) for n in ("block", "held", "sizes", "tokens", "words")}
                block = Block({n: row[n][0].as_py() for n in ("held", "sizes", "tokens")})
                words = unpack_words(row["words"][0].as_py())
                counts = np.bincount(block.tokens[block.learn], minlength=len(words) + 1)
                every = pa.concat_arrays([pa.array([b""], pa.binary()), words])
                out: list[list] = [[], [], [], []]
                for part, members in _groups(_word_parts(words, parts), parts):
                    for c, x in zip(out, (part, row["block"][0].as_py(), pack_words(every.take(pa.array(members))), pack(counts[members]))):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n < 2 else pa.binary()) for n, c in enumerate(out)], ["part", "block", "words", "counts"])

    return blocks.mapInArrow(tidy(run), "part long, block long, words binary, counts binary")


_HIST = [f"h{r}" for r in range(1, K + 2)]


def count_words(sent: DataFrame, parts: int) -> DataFrame:
    """A partition of the word table: numbers words (partition + parts * rank), sums counts and answers the blocks."""

    def run(key, t):
        part = key[0].as_py()
        lists = [unpack_words(x) for x in t["words"].to_pylist()]
        coded = pa.concat_arrays(lists).dictionary_encode()
        which = np.asarray(coded.indices).astype(np.int64)
        counts = np.concatenate([unpack(x) for x in t["counts"].to_pylist()])
        total = np.bincount(which, counts, len(coded.dictionary)).astype(np.int64)  # exact below 2^53
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        n = t.num_rows
        out = {"part": np.full(n, part), "block": np.asarray(t["block"])}
        ids, back = part + parts * which, total[which]
        out["ids"] = pa.array([pack(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
        out["counts"] = pa.array([pack(back[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
        first = np.arange(n) == 0
        for r, name in enumerate(_HIST, 1):
            out[name] = np.where(first, (total == r).sum(), 0)
        out["types"], out["total"] = np.where(first, (total > 0).sum(), 0), np.where(first, total.sum(), 0)
        return pa.table(out)

    return sent.groupBy("part").applyInArrow(run, "part long, block long, ids binary, counts binary, " + ", ".join(f"{h} long" for h in [*_HIST, "types", "total"]))


def _local(block_row: dict, words: pa.Array, answers: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Global numbers and training counts of a block's words, the end mark at 0."""
    ids, counts = np.zeros(len(words) + 1, np.int64), np.zeros(len(words) + 1, np.int64)
    got = dict(zip(answers["part"].to_pylist(), zip(answers["ids"].to_pylist(), answers["counts"].to_pylist())))
    for part, members in _groups(_word_parts(words, parts), parts):
        a, b = got[part]
        ids[members], counts[members] = unpack(a), unpack(b)
    return ids, counts


def _pair_parts(u: np.ndarray, v: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(mix(u.view(np.uint64)) + v.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _one(t: pa.Table) -> tuple[dict, pa.Array]:
    row = {n: t[n][0].as_py() for n in ("block", "docs", "held", "sizes", "tokens")}
    return row, unpack_words(t["words"][0].as_py())


def send_pairs(blocks: DataFrame, answers: DataFrame, word_parts: int, parts: int) -> DataFrame:
    def run(key, left, right):
        out: dict[str, list] = {n: [] for n in ("part", "block", "u", "v", "n", "cv")}
        if left.num_rows:
            row, words = _one(left)
            ids, counts = _local(row, words, right, word_parts)
            block = Block(row)
            u, v, which = block.pairs()
            n = np.bincount(which[block.learn], minlength=len(u)).astype(np.int32)
            gu, gv, cv = np.where(u == START, START, ids[np.maximum(u, 0)]), ids[v], counts[v]
            for part, members in _groups(_pair_parts(gu, gv, parts), parts):
                m = members[np.lexsort((gv[members], gu[members]))]
                for c, x in zip(out.values(), (part, row["block"], pack(np.diff(gu[m], prepend=0)), pack(gv[m]), pack(n[m]), pack(cv[m]))):
                    c.append(x)
        return pa.table({n: pa.array(c, pa.int64() if n in ("part", "block") else pa.binary()) for n, c in out.items()})

    return blocks.groupBy("block").cogroup(answers.select("block", "part", "ids", "counts").groupBy("block")).applyInArrow(run, "part long, block long, u binary, v binary, n binary, cv binary")


def count_pairs(sent: DataFrame, unigrams: Unigrams, word_parts: int) -> DataFrame:
    """A partition of the pair table: sums counts and answers the blocks (kind 0); sends each context's sums on (kind 1)."""

    def run(key, t):
        part = key[0].as_py()
        us = [np.cumsum(unpack(x)) for x in t["u"].to_pylist()]
        u, v, cv = np.concatenate(us), np.concatenate([unpack(x) for x in t["v"].to_pylist()]), np.concatenate([unpack(x) for x in t["cv"].to_pylist()])
        n = np.concatenate([unpack(x, np.int32) for x in t["n"].to_pylist()]).astype(np.int64)
        order = np.lexsort((v, u))
        su, sv = u[order], v[order]
        head = np.concatenate([[True], (su[1:] != su[:-1]) | (sv[1:] != sv[:-1])])
        which = np.empty(len(u), np.int64)
        which[order] = np.cumsum(head) - 1
        total = np.bincount(which, n).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in us])])
        back = total[which]
        seen = total > 0
        hu, c, p = su[head][seen], total[seen], unigrams(cv[order][head][seen])
        context, at = np.unique(hu, return_inverse=True)
        sums = [np.bincount(at[c == r], minlength=len(context)) for r in range(1, K + 1)]
        sums.append(np.bincount(at, np.where(c > K, c, 0), len(context)))
        sums.append(np.bincount(at, p, len(context)))
        rows: dict[str, list] = {n: [] for n in ("kind", "part", "block", "counts")}
        for b, x, y in zip(t["block"].to_pylist(), bounds[:-1], bounds[1:]):
            for col, value in zip(rows.values(), (0, part, b, pack(back[x:y]))):
                col.append(value)
        for b, members in _groups(np.where(context == START, 0, context % word_parts), word_parts):
            stats = np.concatenate([context[members].astype(np.float64), *(s[members].astype(np.float64) for s in sums)])
            for col, value in zip(rows.values(), (1, b, 0, pack(stats))):
                col.append(value)
        size = len(rows["kind"])
        out = {n: pa.array(c, pa.binary() if n == "counts" else pa.int64()) for n, c in rows.items()}
        for r, name in enumerate(_HIST, 1):
            out[name] = np.where(np.arange(size) == 0, (total == r).sum(), 0)
        return pa.table(out)

    return sent.groupBy("part").applyInArrow(run, "kind long, part long, block long, counts binary, " + ", ".join(f"{h} long" for h in _HIST))


def weigh_contexts(answers: DataFrame, stats: DataFrame, d: np.ndarray) -> DataFrame:
    """Backoff weight, scale and count of every context a block has, in the order of its words; START's last in partition 0."""

    def run(key, left, right):
        if right.num_rows:
            each = [unpack(x, np.float64).reshape(K + 3, -1) for x in right["counts"].to_pylist()]
            every = np.concatenate(each, axis=1)
            context, at = np.unique(every[0].astype(np.int64), return_inverse=True)
            sums = np.stack([np.bincount(at, row, len(context)) for row in every[1:]])
            c = Contexts(sums[:K].T, sums[K], d)
            table = np.stack([c.left / np.maximum(1 - sums[K + 1], 1e-300), c.scale, c.count])
        else:
            context, table = np.zeros(0, np.int64), np.zeros((3, 0))
        out: list[bytes] = []
        for ids in left["ids"].to_pylist():
            ids = unpack(ids)
            if key[0].as_py() == 0:
                ids = np.append(ids, START)
            place = np.minimum(np.searchsorted(context, ids), max(0, len(context) - 1))
            got = np.repeat(np.array([[1.0], [1.0], [0.0]]), len(ids), axis=1)  # unseen contexts back off whole
            if len(context):
                found = context[place] == ids
                got[:, found] = table[:, place[found]]
            out.append(pack(got))
        return pa.table({"kind": pa.array([2] * len(out), pa.int64()), "part": left["part"], "block": left["block"], "ids": pa.array(out, pa.binary()), "counts": pa.array([None] * len(out), pa.binary())})

    return answers.select("part", "block", "ids").groupBy("part").cogroup(stats.select("part", "counts").groupBy("part")).applyInArrow(run, "kind long, part long, block long, ids binary, counts binary")


def score_blocks(blocks: DataFrame, answers: DataFrame, unigrams: Unigrams, d: np.ndarray, word_parts: int, pair_parts: int) -> DataFrame:
    """Evaluates each token: its pair's discounted share, else backoff weight times the token's own probability."""

    def run(key, left, right):
        out: dict[str, np.ndarray | pa.Array] = {}
        row, words = _one(left)
        kinds = np.asarray(right["kind"])
        ids, counts = _local(row, words, right.filter(pa.array(kinds == 1)), word_parts)
        block = Block(row)
        u, v, which = block.pairs()
        gu, gv = np.where(u == START, START, ids[np.maximum(u, 0)]), ids[v]
        weigh = {p: unpack(x, np.float64).reshape(3, -1) for p, x in zip(*(right.filter(pa.array(kinds == 2))[n].to_pylist() for n in ("part", "ids")))}
        backoff = np.zeros((3, len(words) + 2))  # START in the last place
        for part, members in _groups(_word_parts(words, word_parts), word_parts):
            backoff[:, members] = weigh[part][:, : len(members)]
        backoff[:, -1] = weigh[0][:, -1]
        pair_counts = {p: unpack(x) for p, x in zip(*(right.filter(pa.array(kinds == 0))[n].to_pylist() for n in ("part", "counts")))}
        c = np.zeros(len(u), np.int64)
        for part, members in _groups(_pair_parts(gu, gv, pair_parts), pair_parts):
            c[members[np.lexsort((gv[members], gu[members]))]] = pair_counts[part]
        weight, scale, total = backoff[:, u]
        own = unigrams(counts[v])
        with np.errstate(divide="ignore"):
            logp = np.log10(np.where(c > 0, scale * discounted(c, d) / np.maximum(total, 1), weight * own))
        doc = np.repeat(np.arange(len(block.sizes)), block.sizes)
        n = len(block.sizes)
        mine = counts[block.tokens]
        base = np.log10((counts + 0.1) / (unigrams.n + 0.1 * (unigrams.v + 1)))
        out["doc_id"], out["held_out"] = pa.array(row["docs"], pa.int64()), pa.array(block.held)
        out["n_tokens"], out["n_known"] = block.sizes, np.bincount(doc, mine > 0, n).astype(np.int64)
        out["train_tokens"] = np.full(n, unigrams.n)
        out["base_score"], out["score"] = np.bincount(doc, base[block.tokens], n), np.bincount(doc, logp[which], n)
        return pa.table(out)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per input row.

    Tokens are the white-space parted words, lower-cased in A-Z, and one end. Null text counts as empty: just
    the end. Repeated rows all count and stay; other columns are ignored. Without training texts every token
    is the unknown one, of probability one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "katz")
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), held_out(F.col(doc)).alias("held"), F.col(text).cast("string").alias("text"))
    blocks = scratch.table(number_blocks(rows), "blocks")
    n_words = blocks.agg(F.sum("n_words")).first()[0] or 0
    word_parts = partitions(n_words, ENTRIES)
    words = scratch.table(count_words(send_words(blocks, word_parts), word_parts), "words")
    *of, types, total = words.agg(*(F.sum(c) for c in [*_HIST, "types", "total"])).first()
    unigrams = Unigrams(total or 0, types or 0, np.array([x or 0 for x in of]))
    # a text has at most as many different pairs as tokens, whose packed size bounds nothing: count them
    n_tokens = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pair_parts = partitions(n_tokens // 6, ENTRIES)
    pairs = scratch.table(count_pairs(send_pairs(blocks, words, word_parts, pair_parts), unigrams, word_parts), "pairs")
    d = discounts(np.array([x or 0 for x in pairs.agg(*(F.sum(c) for c in _HIST)).first()]))
    weights = weigh_contexts(words, pairs.where("kind = 1"), d)
    none = F.lit(None).cast("binary")
    answers = words.select(F.lit(1).cast("long").alias("kind"), "part", "block", "ids", "counts").unionByName(pairs.where("kind = 0").select("kind", "part", "block", none.alias("ids"), "counts")).unionByName(weights)
    return score_blocks(blocks, answers, unigrams, d, word_parts, pair_parts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
