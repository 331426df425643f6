"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

Encoding: the distinct pre-tokens of a text block become token-position rows; a recursive query joins
neighbouring positions to the merge table and contracts each word's leftmost pair of least rank until no
pair merges. A long word goes through the same query piece by piece, and its pieces are joined by encoding
the seams: tokens are the encoding of their bytes if and only if each two neighbours are the encoding of
theirs. (The first merge across a border between tokens would be the leftmost of least rank of the two
neighbours alone too, as merges elsewhere touch neither; and no merge crosses the ends of a run of tokens of an
encoding.) So two encodings that have a token in common can be joined at it. Decoding: token-position rows join the vocabulary and an ordered aggregation puts the bytes
together. Both run in an in-process DuckDB in every Python worker, over blocks of bounded size; nothing is
shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import pretoken
from quarry.llm.common import bytes_of, chunks, small_batches, text_array, tidy

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of pre-tokens that one recursive query takes, and words a worker remembers before it starts anew.
QUERY_BYTES, MEMO_WORDS = 1 << 18, 300_000
#: Text bytes that are encoded at once.
BLOCK_BYTES = 2 << 20
#: Bytes of a word that one row state holds; longer words go in pieces of this size.
PIECE = 64
#: Tokens on each side of a border that its seam takes at first.
SEAM = 8

#: State of a word: its list of tokens, which each round replaces. A round pairs neighbours (as token-position rows),
#: takes the merge of least (rank, position) and contracts it.
_ENCODE = """
WITH RECURSIVE s(w, ids, it) AS (
  SELECT w, list(t ORDER BY p), 0 FROM token_rows GROUP BY w
  UNION ALL
  SELECT s.w, s.ids[:b.p - 1] || [b.m] || s.ids[b.p + 2:], s.it + 1
  FROM s JOIN (
    SELECT w, (k >> 32)::INTEGER AS m, k & 4294967295 AS p FROM (
      SELECT u.w, min((merges.m::BIGINT << 32) + u.p) AS k
      FROM (SELECT w, unnest(range(1, len(ids))) AS p, unnest(ids[:-2]) AS l, unnest(ids[2:]) AS r FROM s) u
      JOIN merges ON merges.lr = (u.l::BIGINT << 32) + u.r GROUP BY u.w)
  ) b ON b.w = s.w
)
SELECT w, arg_max(ids, it) AS ids FROM s GROUP BY w ORDER BY w
"""
_DECODE = "SELECT w, string_agg(s, '' ORDER BY p) AS text FROM id_rows JOIN vocab USING (id) GROUP BY w ORDER BY w"


class Codec:
    """One vocabulary of ranks in one DuckDB connection."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        rows = [(x, y, m) for token, m in self.ranks.items() for i in range(1, len(token)) if (x := self.ranks.get(token[:i])) is not None and (y := self.ranks.get(token[i:])) is not None]
        left, right, merged = (np.array(c, np.int32) for c in zip(*rows))
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.con.register("merge_rows", pa.table({"l": left, "r": right, "m": merged}))
        self.con.execute("CREATE TABLE merges AS SELECT *, (l::BIGINT << 32) + r AS lr FROM merge_rows")
        self.con.register("vocab_rows", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "s": [t.decode("latin-1") for t in self.ranks]}))
        self.con.execute("CREATE TABLE vocab AS SELECT * FROM vocab_rows")
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        #: Byte pairs inside some token; no merge ever joins the bytes of any other pair.
        self.joins = np.zeros((256, 256), np.bool_)
        for token in self.ranks:
            raw = np.frombuffer(token, np.uint8)
            self.joins[raw[:-1], raw[1:]] = True
        #: Ids whose bytes begin with a blank or line end: where the decoder may part a document's ids.
        self.opens = np.array([t[:1] in (b" ", b"\n") for t in self.tokens])
        self.memo: dict[bytes, bytes] = {}

    def _run(self, sql: str, view: str, rows: pa.Table) -> pa.Table:
        self.con.register(view, rows)
        try:
            return self.con.sql(sql).to_arrow_table()
        finally:
            self.con.unregister(view)

    def _query(self, words: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"".join(words), np.uint8)
        n = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(n) - n
        rows = pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), n), "p": (np.arange(len(data)) - np.repeat(first, n)).astype(np.int32), "t": self.byte[data]})
        ids = self._run(_ENCODE, "token_rows", rows)["ids"].combine_chunks()
        flat, offs = np.asarray(ids.values).astype(np.int32), np.asarray(ids.offsets)
        return [flat[a:b] for a, b in zip(offs[:-1], offs[1:])]

    def _encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of non-empty words, in queries of bounded size."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(words):
            size, end = 0, at
            while end < len(words) and (end == at or size + len(words[end]) <= QUERY_BYTES):
                size += len(words[end])
                end += 1
            out += self._query(words[at:end])
            at = end
        return out

    def _long(self, word: bytes) -> np.ndarray:
        """Ids of a word of any length: pieces, joined one after the other at their seams."""
        raw = np.frombuffer(word, np.uint8)
        pieces: list[bytes] = []
        cuts = [0, *(np.flatnonzero(~self.joins[raw[:-1], raw[1:]]) + 1).tolist(), len(word)]  # no merge crosses these
        first = []  # the pieces that begin after such a cut
        for a, b in zip(cuts, cuts[1:]):
            first.append(len(pieces))
            pieces += [word[x : min(b, x + PIECE)] for x in range(a, b, PIECE)]
        short: dict[bytes, np.ndarray] = {}

        def learn(wanted: list[bytes]) -> None:
            new = [w for w in dict.fromkeys(wanted) if w not in short]
            short.update(zip(new, self._encode(new)))

        def text(ids: np.ndarray) -> bytes:
            return b"".join([self.tokens[i] for i in ids.tolist()])

        learn(pieces)
        free = set(first)
        learn([text(short[a][-SEAM:]) + text(short[b][:SEAM]) for i, (a, b) in enumerate(zip(pieces, pieces[1:]), 1) if i not in free])
        done, tail = [], short[pieces[0]]  # ``tail`` ends what is settled so far; ``done`` comes before it
        for i, piece in enumerate(pieces[1:], 1):
            right = short[piece]
            if i in free:
                done.append(tail)
                tail = right
                continue
            n = SEAM
            while True:
                while len(tail) < n and done:
                    tail = np.concatenate([done.pop(), tail])
                left = tail[-n:]
                before, after = text(left), text(right[:n])
                learn([before + after])
                joined = self._join(left, right[:n], short[before + after], len(before), len(left) == len(tail) and not done, n >= len(right))
                if joined is not None:
                    break
                n *= 2
            tail = np.concatenate([tail[: len(tail) - len(left)], joined, right[n:]])
            if len(tail) > 4 * PIECE:
                done.append(tail[: -2 * PIECE])
                tail = tail[-2 * PIECE :]
        return np.concatenate([*done, tail])

    def _join(self, left: np.ndarray, right: np.ndarray, seam: np.ndarray, border: int, whole_left: bool, whole_right: bool) -> np.ndarray | None:
        """``left`` and ``right`` joined by the encoding of their bytes, if that has a token of either - or an end - in common."""
        ends = lambda ids: np.cumsum([len(self.tokens[t]) for t in ids.tolist()])
        own, at, beyond = ends(left), ends(seam), border + ends(right)
        span = lambda ids, end: {(e, int(t)): i for i, (e, t) in enumerate(zip(end.tolist(), ids.tolist()))}
        seams = span(seam, at)
        # the ends of a run of an encoding's tokens are borders for sure only where nothing comes before or after
        a = max(((i, seams[k]) for k, i in span(left, own).items() if k in seams), default=(-1, -1) if whole_left else None)
        b = min(((i, seams[k]) for k, i in span(right, beyond).items() if k in seams), default=(len(right), len(seam)) if whole_right else None)
        if a is None or b is None or a[1] >= b[1] and len(seam):
            return None
        return np.concatenate([left[: a[0] + 1], seam[a[1] + 1 : b[1]], right[b[0] :]])

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids (as int32 bytes) of each pre-token; short words seen before come from a bounded memory."""
        new = [w for w in words if w not in self.memo and len(w) <= PIECE]
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
            new = [w for w in words if len(w) <= PIECE]
        self.memo.update(zip(new, (ids.tobytes() for ids in self._encode(new))))
        return [self.memo[w] if len(w) <= PIECE else self._long(w).tobytes() for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and each row's bounds in them."""
        data, offs = bytes_of(texts)
        starts, first = pretoken.split(data, offs)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        found = pretoken.pieces(data, offs, starts)
        words = self.encode_words(found.dictionary.to_pylist())
        flat, bounds = gather(np.frombuffer(b"".join(words), np.int32), np.fromiter((len(w) >> 2 for w in words), np.int64, len(words)), np.asarray(found.indices))
        return flat, bounds[first]

    def decode(self, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of rows of ids, and each row's bounds in them.

        Rows are parted before ids that open with white space; each distinct part is decoded once.
        """
        if not len(flat):
            return np.zeros(0, np.uint8), np.zeros(len(bounds), np.int64)
        begun = self.opens[flat]
        begun[bounds[:-1][bounds[:-1] < len(flat)]] = True
        starts = np.flatnonzero(begun)
        raw = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((np.append(starts, len(flat)) * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))]).dictionary_encode()
        ids, offs = bytes_of(raw.dictionary)
        ids, n = ids.view(np.int32), np.diff(offs) >> 2
        texts, sizes = [], []
        for a in range(0, len(n), 20_000):
            part = n[a : a + 20_000]
            lo = int(offs[a] >> 2)
            hi = lo + int(part.sum())
            rows = pa.table({"w": np.repeat(np.arange(len(part), dtype=np.int32), part), "p": np.arange(hi - lo, dtype=np.int32), "id": ids[lo:hi]})
            text = self._run(_DECODE, "id_rows", rows)["text"].combine_chunks()  # a character for each byte
            texts.append(bytes_of(text)[0].tobytes().decode("utf-8").encode("latin-1"))
            sizes.append(np.asarray(pc.utf8_length(text)))
        data, ends = gather(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(sizes).astype(np.int64), np.asarray(raw.indices))
        return data, ends[np.searchsorted(starts, bounds)]


def gather(flat: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs ``picks`` of ``flat`` (run i has sizes[i] values); and the bounds of the picked."""
    n = sizes[picks]
    bounds = np.concatenate([[0], np.cumsum(n)])
    jump = (np.cumsum(sizes) - sizes)[picks] - bounds[:-1]
    return flat[np.repeat(jump, n) + np.arange(bounds[-1])], bounds


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _columns(doc: str, text: str):
    return [F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text")]


def encode_documents(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)``, one row per input row. Null text has no ids, as the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, "text", BLOCK_BYTES):
            flat, bounds = codec(path).encode(text_array(t["text"]))
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))], ["doc_id", "ids"])

    small_batches(docs.sparkSession)
    rows = docs.select(*_columns(doc, text))
    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, doc: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(doc_id, text_bytes binary)``, one row per input row. Null ids give no bytes; null or unknown ids raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1).fill_null([]) if b.column(1).null_count else b.column(1)
            flat, bounds = lists.flatten(), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int64)
            if flat.null_count:
                raise ValueError("an id is null")
            data, ends = codec(path).decode(np.asarray(flat).astype(np.int32), bounds)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[x:y] for x, y in zip(ends[:-1], ends[1:])], pa.binary())], ["doc_id", "text_bytes"])

    small_batches(encoded.sparkSession)
    rows = encoded.select(F.col(doc).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_bytes binary")


def roundtrip_digests(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: each text encoded, its ids decoded, both digested.

    One row per input row, repeated ids included; null text counts as empty; other columns are ignored.
    ``ids_sha256`` is over the decimal ids joined by commas.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [str(i).encode() for i in range(len(codec(path).tokens))]
        for t in chunks(batches, "text", BLOCK_BYTES):
            flat, bounds = codec(path).encode(text_array(t["text"]))
            data, ends = codec(path).decode(flat, bounds)
            words = [names[i] for i in flat.tolist()]
            raw = memoryview(data.tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    t["doc_id"].combine_chunks(), pa.array(np.diff(bounds)), pa.array([hashlib.sha256(b",".join(words[a:b])).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])], pa.string()),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])], pa.string()),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    small_batches(docs.sparkSession)
    rows = docs.select(*_columns(doc, text))
    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(RANKS))
