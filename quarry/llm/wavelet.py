"""Token-id output as wavelet matrices: one compressed succinct file per shard.

Documents in id order are cut into shards; a shard's token ids (each document closed by an end id) become a
wavelet matrix: bit-planes from the highest bit down, each plane a stable partition of the sequence by the
plane above. Rank directories over the planes give access to any token, counts of an id in a prefix and the
place of its n-th occurrence without unpacking the file. Files are rows of a Parquet table in a folder that
all executors share, so any store that Spark writes will do.

File format (little-endian): magic "QWM1", uint32 bits, uint64 tokens, uint64 documents; then, each with
uint32 length before it, zlib streams of: document ids (int64), document starts (uint64, documents + 1) and
every plane's 64-bit words. Rank directories are rebuilt when a file is opened.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import pretoken
from quarry.llm.bpe import gather
from quarry.llm.common import Scratch, bytes_of, chunks, partitions, small_batches, text_array, tidy
from quarry.llm.token_counts import segments

VOCABULARY = "byte_bpe_50k.json"
MAGIC = b"QWM1"
#: Text bytes in a range partition of documents; words, and bytes of them, that a worker remembers before it keeps only those of its block.
RANGE_BYTES, MAX_WORDS, MAX_BYTES = 32 << 20, 500_000, 64 << 20


class WaveletMatrix:
    """Access, rank and select over a sequence of unsigned integers."""

    def __init__(self, planes: list[np.ndarray], n: int):
        self.planes, self.n, self.bits = planes, n, len(planes)  # planes: uint64 words, bit i of word j is place 64 j + i
        self.ranks = [np.concatenate([[0], np.cumsum(np.bitwise_count(p), dtype=np.int64)]) for p in planes]
        self.zeros = [n - int(r[-1]) for r in self.ranks]

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        now, planes = values.astype(np.uint16 if bits <= 16 else np.uint32), []
        for b in range(bits - 1, -1, -1):
            one = now & now.dtype.type(1 << b) != 0
            packed = np.packbits(one, bitorder="little")
            planes.append(np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view(np.uint64))
            now = np.concatenate([np.compress(~one, now), np.compress(one, now)])
        return cls(planes, len(values))

    def _ones(self, level: int, places: np.ndarray) -> np.ndarray:
        """Ones of a plane before each place."""
        word, low = places >> 6, (places & 63).astype(np.uint64)
        plane = self.planes[level]
        if not len(plane):
            return np.zeros(len(places), np.int64)
        part = plane[np.minimum(word, len(plane) - 1)] & ((np.uint64(1) << low) - np.uint64(1))
        return self.ranks[level][word] + np.bitwise_count(part)

    def access(self, places) -> np.ndarray:
        """The values at some places."""
        at, out = np.asarray(places, np.int64).copy(), np.zeros(np.size(places), np.int64)
        for level in range(self.bits):
            one = (self.planes[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._ones(level, at)
            at = np.where(one, self.zeros[level] + ones, at - ones)
            out = out << 1 | one
        return out

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._ones(level, np.array([start, end]))
            start, end = (self.zeros[level] + int(a), self.zeros[level] + int(b)) if value >> (self.bits - 1 - level) & 1 else (start - int(a), end - int(b))
        return start, end

    def rank(self, value: int, end: int) -> int:
        """How often a value stands before a place."""
        if value < 0 or value >> self.bits:
            return 0
        a, b = self._range(value, 0, end)
        return b - a

    def select(self, value: int, nth: int) -> int:
        """The place of the nth occurrence (from 0) of a value; -1 if it has fewer."""
        if value < 0 or value >> self.bits:
            return -1
        a, b = self._range(value, 0, self.n)
        if nth >= b - a:
            return -1
        at = a + nth
        for level in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - level) & 1
            k = at - self.zeros[level] if one else at
            lo, hi = 0, self.n  # the least place with more than k such bits before it
            while lo < hi:
                mid = (lo + hi) // 2
                ones = int(self._ones(level, np.array([mid + 1]))[0])
                if (ones if one else mid + 1 - ones) > k:
                    hi = mid
                else:
                    lo = mid + 1
            at = lo
        return at

    def decode(self) -> np.ndarray:
        """The whole sequence: planes undone from the last to the first."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level].view(np.uint8), bitorder="little", count=self.n).view(np.bool_)
            z = self.zeros[level]
            back = np.empty_like(now)
            # places as numbers: faster than masks where bits change often
            back[np.flatnonzero(~one)] = now[:z]
            back[np.flatnonzero(one)] = now[z:] | now.dtype.type(1 << (self.bits - 1 - level))
            now = back
        return now


def dump(ids: np.ndarray, docs: np.ndarray, starts: np.ndarray, bits: int) -> bytes:
    """One shard's file."""
    matrix = WaveletMatrix.build(ids, bits)
    out = [MAGIC, struct.pack("<IQQ", bits, len(ids), len(docs))]
    for part in (docs.astype("<i8"), starts.astype("<u8"), *matrix.planes):
        stream = zlib.compressobj(1, strategy=zlib.Z_RLE)  # bits hold runs, but few longer repeats
        packed = stream.compress(part.tobytes()) + stream.flush()
        out += [struct.pack("<I", len(packed)), packed]
    return b"".join(out)


def load(raw: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray]:
    """The wavelet matrix, document ids and document starts of a file."""
    if raw[:4] != MAGIC:
        raise ValueError("no wavelet shard")
    bits, n, _ = struct.unpack_from("<IQQ", raw, 4)
    at, parts = 4 + 20, []
    for _ in range(2 + bits):
        (size,) = struct.unpack_from("<I", raw, at)
        parts.append(zlib.decompress(raw[at + 4 : at + 4 + size]))
        at += 4 + size
    return WaveletMatrix([np.frombuffer(p, np.uint64) for p in parts[2:]], n), np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], "<u8").astype(np.int64)


class Encoder:
    """The tokenizers library on distinct pre-tokens, which it encodes as it does within a text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of the library only add to its work
        self.library = Tokenizer.from_file(path)
        self.specials = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.bits = max(1, int(self.library.get_vocab_size() - 1).bit_length())
        #: Bytes that each id stands for; byte-level tokens have one character for each byte.
        self.sizes = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            self.sizes[i] = len(token)
        (self.newline,) = self.library.encode("\n", add_special_tokens=False).ids
        #: What a worker remembers: words, their ids one after another, and how many each has.
        self.known, self.flat, self.counts = pa.array([], pa.binary()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def words(self, words: pa.BinaryArray) -> np.ndarray:
        """Places of distinct pre-tokens in the memory, which learns those that are new; if it is full, it keeps only these."""
        at = np.asarray(pc.index_in(words, value_set=self.known).fill_null(-1)).astype(np.int64)
        new = words.filter(pa.array(at < 0))
        if len(self.known) + len(new) > MAX_WORDS or self.known.nbytes + new.nbytes > MAX_BYTES:
            old = at[at >= 0]
            self.known, self.flat, self.counts = self.known.take(pa.array(old)), gather(self.flat, self.counts, old)[0], self.counts[old]
            at[at >= 0] = np.arange(len(old))
        if len(new):
            at[at < 0] = np.arange(len(self.known), len(self.known) + len(new))
            flat, counts = self._ids(new)
            self.known = pa.concat_arrays([self.known, new])
            self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])
        return at

    def _ids(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens one after another, and how many each has.

        Those with more than white space are put one after another, a newline before each that has no blank there: so
        joined, they part again just there. White space would join what is beside it and goes by itself.
        """
        text = words.cast(pa.string())
        blank = pc.starts_with(text, " ")
        lone = np.asarray(pc.equal(pc.utf8_ltrim(text, pretoken.white_space()), ""))
        flat, counts = self._joined(text.filter(pa.array(~lone)), np.asarray(blank)[~lone])
        if not lone.any():
            return flat, counts
        own = [e.ids for e in self.library.encode_batch_fast(text.filter(pa.array(lone)).to_pylist(), add_special_tokens=False)]
        sizes, order = np.empty(len(words), np.int64), np.argsort(lone, kind="stable")
        sizes[order] = all_ = np.concatenate([counts, np.fromiter(map(len, own), np.int64, len(own))])
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return gather(np.concatenate([flat, *(np.array(x, np.uint32) for x in own)]), all_, place)[0], sizes

    def _joined(self, words: pa.StringArray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        joined = pc.binary_join_element_wise(pc.if_else(pa.array(blank), "", "\n"), words, "")
        data, offs = bytes_of(joined)
        blocks = (data[offs[a] : offs[min(a + 2000, len(joined))]].tobytes().decode() for a in range(0, len(joined), 2000))
        # one by one, so that what the library holds besides ids is given up at once
        flat = np.concatenate([np.array(self.library.encode_batch_fast([b], add_special_tokens=False)[0].ids, np.uint32) for b in blocks])
        ends, stops = np.cumsum(self.sizes[flat]), offs[1:]
        at = np.searchsorted(ends, stops)
        first = np.concatenate([[0], at[:-1] + 1])
        extra = first[~blank]  # the newlines
        if ends[-1] != stops[-1] or (ends[at] != stops).any() or (flat[extra] != self.newline).any():
            raise ValueError("pre-tokens don't part where they were joined")
        return np.delete(flat, extra), at + 1 - first - ~blank

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows with ``end`` after each, and the rows' bounds."""
        rows, _, parts = segments(texts, list(self.specials))
        data, offs = bytes_of(parts)
        starts, first = pretoken.split(data, offs)
        found = pretoken.pieces(data, offs, starts)
        places = self.words(found.dictionary)
        n = len(self.counts)
        # after each segment's words comes the special id that parted it from the next, or the row's end
        last = np.append(rows[1:] != rows[:-1], True) if len(rows) else np.zeros(0, np.bool_)
        extra = [end]
        picks = np.insert(places[np.asarray(found.indices)], first[1:], n)
        if not last.all():
            names = list(self.specials)
            extra += [self.specials[s] for s in names]
            picks[first[1:] + np.arange(len(rows))] = np.where(last, n, n + 1 + self._which(texts, names, last))
        flat, bounds = gather(np.append(self.flat, np.array(extra, np.uint32)), np.append(self.counts, np.ones(len(extra), np.int64)), picks)
        close = np.concatenate([[0], bounds[first[1:] + np.arange(1, len(rows) + 1)]])
        return flat, np.concatenate([[0], close[1:][last]])

    @staticmethod
    def _which(texts: pa.Array, names: list[str], last: np.ndarray) -> np.ndarray:
        import regex

        pattern = regex.compile("|".join(map(regex.escape, sorted(names, key=len, reverse=True))))
        out = np.zeros(len(last), np.int64)
        out[~last] = [names.index(m) for t in texts.to_pylist() for m in pattern.findall(t)]
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_shards(docs: DataFrame, path: str, scratch: Scratch, end: int = 0, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shard files; ``(part, seq, n_docs, n_tokens, payload)`` - (part, seq) order is document order.

    Documents are ordered by id (nulls first), repeated ids by text. Null text is empty: one end id.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tool = TaskContext.get().partitionId(), encoder(path)
        for seq, t in enumerate(chunks(batches, "text")):
            ids, bounds = tool.encode(text_array(t["text"]), end)
            payload = dump(ids, np.asarray(t["doc_id"].combine_chunks().fill_null(-(1 << 63))), bounds, tool.bits)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([t.num_rows], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64()), "payload": pa.array([payload], pa.binary())})

    ordered = rows.repartitionByRange(partitions(total, RANGE_BYTES), "doc_id").sortWithinPartitions("doc_id", "text")
    return scratch.table(ordered.mapInArrow(tidy(run), "part int, seq int, n_docs long, n_tokens long, payload binary"), "shards")


def read_digests(shards: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files.

    ``start`` counts the ids of all documents before it. Only one count per part and shard is gathered for it.
    """
    place = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.withColumn("part_start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    sizes = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(place), F.lit(0)).alias("in_part"))
    starts = sizes.join(before, "part").select("part", "seq", (F.col("part_start") + F.col("in_part")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                matrix, ids, bounds = load(payload.as_buffer().to_pybytes())
                raw = memoryview(matrix.decode().astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), part, np.int32)), pa.array(np.full(len(ids), seq, np.int32)), pa.array(ids, pa.int64(), mask=ids == -(1 << 63)), pa.array(bounds[:-1]), pa.array(np.diff(bounds)),
                        pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.int64()),
                    ], ["part", "seq", "doc_id", "in_shard", "n_tokens", "ids_crc32"],
                )

    found = shards.select("part", "seq", "payload").mapInArrow(tidy(run), "part int, seq int, doc_id long, in_shard long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "seq"]).select("doc_id", (F.col("start") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_digests(write_shards(docs, public_tokenizers.path(VOCABULARY), Scratch(spark, "op7")))
