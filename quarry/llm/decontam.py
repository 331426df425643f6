"""Benchmark decontamination: one Aho-Corasick automaton over normalised test questions and answers.

A window is 13 consecutive words of an item; a shorter item is one window. Items are cut into blocks of seven
words from their start, and the automaton holds each different block once, as a sequence of word numbers: every
window of 13 words holds one whole block, so that the automaton has as many nodes as the items have words and
misses none. Each text is scanned once, word by word. Where a block occurs, the words around it are compared
with those around the block in the items, as far as a window reaches; if a window's length agrees, these words
are hit. Hits are mapped back to the words - and, for spans, the bytes - of the original text.
"""

from __future__ import annotations

import hashlib
import pickle
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quarry.llm.common import small_batches, text_array, tidy, unused

WINDOW = 13
#: The number of a word that no item has.
UNKNOWN = (1 << 32) - 1
#: Benchmark text that one automaton takes (about 15 bytes of a worker's memory each); a larger benchmark has several.
BLOCK_BYTES = 8 << 20

#: Lower-cases A-Z; all other ASCII but a-z and 0-9 parts words; bytes from 0x80 on belong to words.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_NORMAL).split()


class Automaton:
    """Windows of some benchmark items, ready to scan."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.window, self.block = window, (window + 1) // 2
        texts: dict[tuple, set] = defaultdict(set)  # and the items that have it
        for item, text in items:
            texts[tuple([self.number.setdefault(w, len(self.number) + 1) for w in words_of((text or "").encode())])].add(item)
        texts.pop((), None)
        self.owners = [tuple(sorted(i for i in who if i is not None)) for who in texts.values()]
        #: All texts' words with a zero before, between and after them, and where each text begins.
        self.words, self.begins = array("i", [0]), array("q")
        found: dict[tuple, list[int]] = {}
        for words in texts:
            begin = len(self.words)
            self.begins.append(begin)
            if len(words) < window:
                found.setdefault(words, []).append(begin)
            else:
                for i in range(0, len(words) - self.block + 1, self.block):
                    found.setdefault(words[i : i + self.block], []).append(begin + i)
            self.words.extend(words)
            self.words.append(0)
        self.begins.append(len(self.words))
        del texts
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        #: Of each pattern its size and its place, or its different places where it has several.
        self.sizes, self.place, self.several = array("i"), array("q"), {}
        for n, (pattern, places) in enumerate(found.items()):
            self.machine.add_word(pattern, n)
            self.sizes.append(len(pattern))
            self.place.append(places[0])
            if len(places) > 1:
                self.several[n] = self._different(places)
        if found:
            self.machine.make_automaton()

    def _text(self, place: int) -> tuple[int, bool]:
        """The text around a place, and whether it is one window as a whole."""
        which = bisect_right(self.begins, place) - 1
        return which, self.begins[which + 1] - 1 - self.begins[which] < self.window

    def _different(self, places: list[int]) -> list[tuple[int, tuple]]:
        """One place for all with the same words around them, as far as a window reaches, and whose they are."""
        around = self.window - self.block
        kinds: dict[tuple, tuple[int, set]] = {}
        for place in places:
            which, whole = self._text(place)
            begin, end = self.begins[which], self.begins[which + 1] - 1
            sides = () if whole else (tuple(self.words[max(begin, place - around) : place]), tuple(self.words[place : min(end, place + self.block + around)]))
            kinds.setdefault(sides, (place, set()))[1].update(self.owners[which])
        return [(place, tuple(sorted(who))) for place, who in kinds.values()]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """The (first, last + 1) word ranges that a window covers, merged and in order; and the items found."""
        if not self.sizes or not words:
            return [], set()
        get, own, around = self.number.get, self.words, self.window - self.block
        text = tuple([get(w, UNKNOWN) for w in words])
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        for last, n in self.machine.iter(text):
            for place, who in self.several.get(n) or ((self.place[n], None),):
                which, whole = self._text(place)
                a, b = last + 1 - self.sizes[n], last + 1
                if not whole:
                    # the zeros around an item's words equal no word
                    left, right, i, j = max(0, a - around), min(len(text), b + around), place - 1, place + self.block
                    while a > left and text[a - 1] == own[i]:
                        a, i = a - 1, i - 1
                    while b < right and text[b] == own[j]:
                        b, j = b + 1, j + 1
                    if b - a < self.window:
                        continue
                found.append((a, b))
                items.update(self.owners[which] if who is None else who)
        return merge(found), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def blocks_of(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple]]:
    """The items in blocks of bounded text; no more than one block is held at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col(item).cast("long"), F.col(text).cast("string")).toLocalIterator():
        n = len((row[1] or "").encode())
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += n
    if held:
        yield held


_ADDED = {"n_words": "long", "spans": "array<struct<a:int,b:int>>", "items": "array<bigint>"}
_RANGES = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
_PAIRS = lambda x, y: pa.list_(pa.struct([(x, pa.int32()), (y, pa.int32())]))


def _machine(broadcast) -> Automaton:
    """The broadcast block's automaton, built once in each worker."""
    key, raw, window = broadcast.value
    built = _BUILT.get(key)
    if built is None:
        _BUILT.clear()
        built = _BUILT[key] = Automaton(pickle.loads(raw), window)
    return built


_BUILT: dict = {}


def scan_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, byte_ranges: bool = False) -> DataFrame:
    """``docs`` with three columns after its own: ``_n_words``, ``_spans`` (hit word ranges, merged) and ``_items`` (ids of found items).

    With ``byte_ranges`` a fourth, ``_bytes``, has the spans as byte ranges of the text. Where ``docs`` has such a
    name, all four begin with as many underscores more as it takes. A benchmark within ``block_bytes`` is one
    automaton and one scan; a larger one has an automaton for each so many bytes, of which the driver holds one at
    a time, and texts go through all of them in the same stage. Null text has no words and no hits; items without
    words have no window; items with a null id hit words but are not listed; repeated rows stay.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lead = "_"
    while any(unused(lead + n, docs.columns) != lead + n for n in (*_ADDED, "bytes")):
        lead += "_"
    out = docs.withColumns({lead + n: F.lit(0 if n == "n_words" else None).cast(t) for n, t in _ADDED.items()})
    n_docs = len(docs.columns)
    blocks = blocks_of(benchmark, item, item_text, block_bytes)
    block, following = next(blocks, []), next(blocks, None)
    while True:
        key = hashlib.sha256(raw := pickle.dumps(block)).hexdigest() + f"-{window}"
        shared = spark.sparkContext.broadcast((key, raw, window))
        with_bytes = byte_ranges and following is None

        def run(batches: Iterator[pa.RecordBatch], shared=shared, with_bytes=with_bytes) -> Iterator[pa.RecordBatch]:
            machine = _machine(shared)
            for b in batches:
                n_words, spans, items, places = [], [], [], []
                texts = text_array(b.column(b.schema.get_field_index(text)).cast(pa.string()))
                for t, s, i in zip(texts.to_pylist(), b.column(n_docs + 1).to_pylist(), b.column(n_docs + 2).to_pylist()):
                    raw = t.encode()
                    words = words_of(raw)
                    found, who = machine.scan(words)
                    found = merge([*found, *((z["a"], z["b"]) for z in s)]) if s else found
                    n_words.append(len(words))
                    spans.append([{"a": x, "b": y} for x, y in found])
                    items.append(sorted(who | set(i or ())))
                    if with_bytes:
                        places.append([{"start": x, "end": y} for x, y in byte_spans(raw, found)])
                cols = [*b.columns[:n_docs], pa.array(n_words, pa.int64()), pa.array(spans, _PAIRS("a", "b")), pa.array(items, pa.list_(pa.int64()))]
                names = b.schema.names
                if with_bytes:
                    cols, names = [*cols, pa.array(places, _PAIRS("start", "end"))], [*names, f"{lead}bytes"]
                yield pa.RecordBatch.from_arrays(cols, names)

        schema = StructType([*out.schema.fields, StructField(f"{lead}bytes", _RANGES)]) if with_bytes else out.schema
        out = out.mapInArrow(tidy(run), schema)
        if following is None:
            return out
        block, following = following, next(blocks, None)


def judge(scanned: DataFrame) -> DataFrame:
    """Adds ``_n_hit`` and ``_contaminated`` to what ``scan_documents`` gives: at least one in twenty words lies in a window."""
    n_words, spans, _ = scanned.columns[-3:]
    lead = n_words.removesuffix("n_words")
    hit = F.aggregate(F.transform(spans, lambda s: (s["b"] - s["a"]).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    n_hit = F.col(f"{lead}n_hit")
    return scanned.withColumn(f"{lead}n_hit", hit).withColumn(f"{lead}contaminated", (n_hit > 0) & (20 * n_hit >= F.col(n_words)))


def byte_spans(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of the original text (UTF-8) that word ranges stand for."""
    if not spans:
        return []
    flat = np.frombuffer(raw.translate(_NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], flat.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(int(starts[a]), int(ends[b - 1])) for a, b in spans]


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``(doc_id, start, end)``: byte ranges of original texts that windows cover."""
    found = scan_documents(docs.select("doc_id", "text"), benchmark, byte_ranges=True, **options)
    return found.select("doc_id", F.inline("_bytes"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = judge(scan_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    names = F.array_join(F.array_sort(F.transform("_items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"), F.col("_contaminated").alias("contaminated"),
    )
