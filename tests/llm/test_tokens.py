"""Pre-tokens, BPE round trip, token counts and wavelet files against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from quarry.llm import bpe, pretoken, token_counts, wavelet
from quarry.llm.common import Scratch, bytes_of, text_array

TEXTS = [
    "", None, "hello  world\n\n don't we'll 'tis '' 's", " lead", "trail  ", "a" * 700, "ab" * 400 + "!", "日本語" * 200, "x<|endoftext|>y <|endoftext|>", "<|endoftext|>", "\t\r\n  x", "7 ７ ½",
    "=" * 500, "Straße œuvre ñandú", "　" * 300, "\x00\x1c mix",
]


def random_texts(n: int) -> list[str]:
    rnd = random.Random(1)
    parts = ["a", "s", "t", "re", "ve", "ll", "m", "d", "'", " ", "\n", "\t", "1", "é", "!", "“", "７", "\r\n"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.choice([0, 1, 3, 10, 200]))) for _ in range(n)]


def test_split_is_the_pattern():
    rows = [t or "" for t in TEXTS] + random_texts(500) + [" " * 1000 + "x", "\n" * 300 + "'"]
    data, offs = bytes_of(pa.array(rows))
    starts, first = pretoken.split(data, offs)
    ends = np.append(starts, len(data))
    rx = regex.compile(public_tokenizers.PATTERN)
    for i, r in enumerate(rows):
        assert [bytes(data[ends[j] : ends[j + 1]]).decode() for j in range(first[i], first[i + 1])] == rx.findall(r)


def table(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS + random_texts(40))]
    return rows + rows[:3], spark.createDataFrame(rows + rows[:3], "doc_id long, text string, ids string")


def test_roundtrip_matches_tiktoken(spark):
    rows, df = table(spark)
    path = public_tokenizers.path(bpe.RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(path).ranks, special_tokens={})
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.roundtrip_digests(df, path).collect())) == sorted(want)
    encoded = bpe.encode_documents(df, path)
    back = bpe.decode_documents(encoded, path).collect()
    assert sorted((r[0], bytes(r[1])) for r in back) == sorted((i, (t or "").encode()) for i, t, _ in rows)


def test_long_words_match_tiktoken():
    codec = bpe.codec(public_tokenizers.path(bpe.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rnd = random.Random(3)
    words = ["a" * 3001, "ab" * 700, "".join(rnd.choice("abcdeéñ") for _ in range(900)), "".join(rnd.choice("ACGT") for _ in range(1500))]
    flat, bounds = codec.encode(pa.array(words))
    assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode_ordinary(w) for w in words]


def test_a_word_of_a_megabyte(spark):
    """Joined word pieces, and one letter over and over, within the memory of one query."""
    path = public_tokenizers.path(bpe.RANKS)
    codec = bpe.codec(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rnd = random.Random(4)
    pieces = [t.decode() for t in codec.ranks if t.isalpha() and t.isascii()]
    words = ["".join(rnd.choice(pieces) for _ in range(300_000))[: 1 << 20], "e" * 300_000]
    want = [library._core_bpe.encode_single_piece(w.encode()) for w in words]
    rows = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    for r in bpe.roundtrip_digests(rows, path).collect():
        ids = ",".join(map(str, want[r.doc_id])).encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want[r.doc_id]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(words[r.doc_id].encode()).hexdigest())


def test_counts_match_library(spark):
    rows, df = table(spark)
    path = public_tokenizers.path(token_counts.VOCABULARY)
    library = Tokenizer.from_file(path)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 20) for i, t, _ in rows]
    assert sorted(map(tuple, token_counts.count_tokens(df, path, 20).collect())) == sorted(want)


def test_pairs_of_tokens_fit_as_merging_says():
    t = token_counts.counter(public_tokenizers.path(token_counts.VOCABULARY)).transducer
    rnd, tokens = random.Random(1), sorted(t.tokens)
    for _ in range(4000):
        a, b = rnd.choice(tokens), rnd.choice(tokens)
        if rnd.random() < 0.5:
            k = rnd.randrange(1, len(a + b))
            a, b = (a + b)[:k], (a + b)[k:]
        if a in t.tokens and b in t.tokens:
            assert t.fits(a, b) == (t.merge(a + b) == [a, b])


def wavelet_want(rows):
    library, out, at = Tokenizer.from_file(public_tokenizers.path(wavelet.VOCABULARY)), [], 0
    for i, t in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r)):
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_wavelet_files_read_back(spark):
    rows, df = table(spark)
    path = public_tokenizers.path(wavelet.VOCABULARY)
    got = wavelet.read_digests(wavelet.write_shards(df, path, Scratch(spark, "t"))).collect()
    assert sorted(map(tuple, got)) == sorted(wavelet_want(rows))
    assert wavelet.read_digests(wavelet.write_shards(df.limit(0), path, Scratch(spark, "t"))).count() == 0


class Counting:
    """The tokenizers library, with the texts and characters that it was given."""

    def __init__(self, library):
        self.library, self.texts, self.size = library, 0, 0

    def encode_batch_fast(self, texts, **options):
        self.texts, self.size = self.texts + len(texts), self.size + sum(map(len, texts))
        return self.library.encode_batch_fast(texts, **options)


def test_library_gets_each_word_once_and_many_at_a_time(monkeypatch):
    """words without a blank went to the library one by one, and a full memory forgot those still in use."""
    tool = wavelet.Encoder(public_tokenizers.path(wavelet.VOCABULARY))
    library = tool.library
    tool.library = count = Counting(library)

    def check(rows):
        flat, bounds = tool.encode(pa.array(rows), 0)
        assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode(r, add_special_tokens=False).ids + [0] for r in rows]

    rows = [f"Word{'abcdefghij'[i % 10] * (i % 7)}x{'klmnop'[i % 6]}é {'q' * (i % 300)}-\n{i}\t\t  ü" for i in range(1000)]
    check(rows)
    assert count.texts < 20
    monkeypatch.setattr(wavelet, "MAX_WORDS", len(tool.known))
    count.texts = count.size = 0
    check([*rows, "Onemore"])
    assert count.size < 20 and "Onemore" in [w.decode() for w in tool.known.to_pylist()]
    check([" other words", *rows[:3]])
    assert len(tool.known) < 40


def test_odd_white_space_matches_library():
    tool = wavelet.Encoder(public_tokenizers.path(wavelet.VOCABULARY))
    rnd = random.Random(8)
    parts = [*" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u2003\u3000\u200b\ufeffa1!'é", "'s", "'ll", "<|endoftext|>", "<|", "|>"]
    rows = ["a b", "a   b    b"] + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(3000)]
    flat, bounds = tool.encode(pa.array(rows), 0)
    assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids + [0] for e in tool.library.encode_batch(rows, add_special_tokens=False)]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_wavelet_matrix(n):
    rnd = random.Random(n)
    v = np.array([rnd.choice([0, 5, 9, 50256, 300]) for _ in range(n)], np.int64)
    raw = wavelet.dump(v, np.arange(1), np.array([0, n]), 16)
    m, docs, starts = wavelet.load(raw)
    assert m.decode().tolist() == v.tolist() and m.access(np.arange(n)).tolist() == v.tolist() and starts.tolist() == [0, n]
    for x in (0, 5, 50256, 7, 1 << 20):
        places = np.flatnonzero(v == x)
        assert m.rank(x, n // 2) == (places < n // 2).sum()
        assert [m.select(x, k) for k in range(0, len(places), 29)] == places[::29].tolist() and m.select(x, len(places)) == -1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.roundtrip_digests(df, public_tokenizers.path(bpe.RANKS)).count() == 0
    assert token_counts.count_tokens(df, public_tokenizers.path(token_counts.VOCABULARY), 5).count() == 0
    assert text_array(pa.chunked_array([], pa.string())).to_pylist() == []
