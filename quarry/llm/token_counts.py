"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers take the place of the tokenizer. The first (``pretoken``) parts text into
pre-tokens: chunk state maps of the text composed by a parallel prefix scan. The second reads the bytes of
a pre-token and annotates each transition with the number of tokens it adds (it may be negative: a byte can
complete a longer token). A state of the second is the set of token prefixes that end here and may still
grow - each with the token before it and how many tokens lie behind - which is all that the rest of the
encoding can depend on: a sequence of tokens is the byte-pair encoding of its bytes exactly if each
neighbouring pair is the encoding of its own bytes. States are compiled as texts reach them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import pretoken
from quarry.llm.common import bytes_of, chunks, small_batches, text_array, tidy

VOCABULARY = "byte_bpe_50k.json"
#: Compiled transitions and counted words that a worker keeps before it starts anew.
MAX_EDGES, MAX_WORDS = 1_000_000, 500_000


def byte_of_char() -> dict[str, int]:
    """The published byte-level alphabet: printable bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Counts the tokens of a pre-token; states are compiled on demand."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_of_char()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        merges = [tuple(map(to_bytes, m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        #: Rank of a pair of tokens, and the pair that makes a token.
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        for i, (a, b) in enumerate(merges):
            self.rank.setdefault((a, b), i)
            self.parts.setdefault(a + b, (a, b))
        tokens = {bytes([b]) for b in range(256)} | set(self.parts)
        # only tokens that encode to themselves can occur
        self.tokens = {t for t in tokens if len(t) == 1 or self.merge(t) == [t]}
        self.grows = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.edges: dict[int, int] = {}
        self.pairs.clear()
        self.start = self._number((((b"", None, 0)),))

    def merge(self, raw: bytes) -> list[bytes]:
        """Plain byte-pair encoding of a short byte string."""
        t = [raw[i : i + 1] for i in range(len(raw))]
        while len(t) > 1:
            best = min(range(len(t) - 1), key=lambda i: self.rank.get((t[i], t[i + 1]), 1 << 30))
            if (t[best], t[best + 1]) not in self.rank:
                break
            t[best : best + 2] = [t[best] + t[best + 1]]
        return t

    def fits(self, a: bytes | None, b: bytes) -> bool:
        """Whether token b may follow token a: their bytes together encode to just these two."""
        if a is None:
            return True
        found = self.pairs.get((a, b))
        if found is None:
            found = self.pairs[a, b] = self._fits(a, b)
        return found

    def _fits(self, a: bytes, b: bytes) -> bool:
        # Undo both sides' merges from the latest on. A pair across the border spoils it if it merges before
        # the later of the merges that hid one of its sides.
        never = 1 << 30
        until_a = until_b = never  # the merge that takes this piece up
        while True:
            made_a = self.rank[self.parts[a]] if len(a) > 1 else -1
            made_b = self.rank[self.parts[b]] if len(b) > 1 else -1
            across = self.rank.get((a, b))
            # the left side's own later merge at an equal rank comes first, being further left
            if across is not None and across < until_a and (across < until_b or across == until_b):
                return False
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b or made_a == made_b and made_b >= 0:
                until_a, a = made_a, self.parts[a][1]
                if made_a == made_b:
                    # both were made by the same merge: the left one first, then the right one
                    across = self.rank.get((a, b))
                    if across is not None and across < until_a and across < until_b:
                        return False
            else:
                until_b, b = made_b, self.parts[b][0]

    def _number(self, state: tuple) -> int:
        found = self.ids.get(state)
        if found is None:
            found = self.ids[state] = len(self.states)
            self.states.append(state)
        return found

    def _compile(self, source: int, byte: int) -> int:
        """Add a transition: target state and token count change, packed."""
        b = bytes([byte])
        grown, ends = [], []
        for prefix, before, count in self.states[source]:
            t = prefix + b
            if t in self.tokens and self.fits(before, t):
                ends.append((t, count + 1))
            if t in self.grows:
                grown.append((t, before, count))
        (token, count), *more = ends
        assert not more, "two encodings"
        edge = self._number((*((p, q, n - count) for p, q, n in grown), (b"", token, 0))) << 8 | (count + 128)
        self.edges[source << 8 | byte] = edge
        return edge

    def count(self, word: bytes) -> int:
        if len(self.edges) > MAX_EDGES:
            self.reset()
        edges, state, n = self.edges, self.start, 0
        for byte in word:
            edge = edges.get(state << 8 | byte)
            if edge is None:
                edge = self._compile(state, byte)
            state = edge >> 8
            n += (edge & 255) - 128
        return n


class Counter:
    """Token counts of texts, special strings included as the library's default has them."""

    def __init__(self, path: str):
        self.transducer = Transducer(path)
        self.memo: dict[bytes, int] = {}

    def words(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) > MAX_WORDS:
            self.memo.clear()
        out = np.empty(len(words), np.int64)
        memo, count = self.memo, self.transducer.count
        for i, w in enumerate(words):
            n = memo.get(w)
            if n is None:
                n = memo[w] = count(w)
            out[i] = n
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        rows, extra, texts = segments(texts, self.transducer.specials)
        data, offs = bytes_of(texts)
        starts, first = pretoken.split(data, offs)
        if len(starts):
            found = pretoken.pieces(data, offs, starts)
            sums = np.concatenate([[0], np.cumsum(self.words(found.dictionary.to_pylist())[np.asarray(found.indices)])])
        else:
            sums = np.zeros(1, np.int64)
        per = sums[first[1:]] - sums[first[:-1]]
        return extra + np.bincount(rows, weights=per, minlength=len(extra)).astype(np.int64) if len(per) else extra


def segments(texts: pa.Array, specials: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Texts parted at special strings: the row of each segment, the specials in each row, the segments.

    The leftmost special string comes first and the longest where two begin together.
    """
    none = np.zeros(len(texts), np.int64)
    hit = np.zeros(len(texts), np.bool_)
    for s in specials:
        hit |= np.asarray(pc.match_substring(texts, s))
    if not hit.any():
        return np.arange(len(texts)), none, texts
    import regex

    pattern = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True))))
    rows, out = [], []
    for i, t in enumerate(texts.to_pylist()):
        parts = pattern.split(t) if hit[i] else [t]
        none[i] = len(parts) - 1
        rows += [i] * len(parts)
        out += parts
    return np.array(rows), none, pa.array(out, pa.large_string() if pa.types.is_large_string(texts.type) else pa.string())


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per input row; over_limit: more than ``limit`` tokens.

    Null text counts as empty (0 bytes, 0 tokens); repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, "text"):
            texts = text_array(t["text"])
            n = counter(path).count(texts)
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY), 1024)
