"""Each module's ``query`` over a folder of tables, against the public libraries and plain loops."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_dedup import near_brute, repeats_brute
from test_models import katz_brute, window_brute
from tokenizers import Tokenizer

from quarry.llm import bpe, decontam, katz, minhash, suffix_dedup, token_counts, toxicity, wavelet


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("contract"))
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(60 if i in (3, 5) else rnd.randrange(0, 90))) for i in range(60)]
    passage = text(120)
    rows += [(100, f"{text(20)} {passage}"), (101, f"{passage}\n{text(30)}"), (102, rows[3][1]), (103, rows[3][1] + " more"), (104, None), (105, ""), (106, " \t"), (107, "Ünï " * 40 + "日本語" * 30)]
    rows += [(200 + i, text(12) + " idiot " + text(4)) for i in range(30)]
    items = [(7, " ".join(rows[5][1].split()[:20])), (30, "Idiot"), (31, "zz, " + text(30)), (5, " ".join(rows[5][1].split()[2:18])), (8, None)]
    schema = "doc_id long, text string"
    spark.createDataFrame([(*r, "x") for r in rows], schema + ", lang string").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int("idiot" in (t or ""))) for i, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out, rows, items


def got(spark, module, folder, *names):
    return sorted((tuple(r) for r in module.query(spark, folder).select(*names).collect()), key=lambda r: r[0])


def test_byte_bpe(spark, folder):
    out, rows, _ = folder
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(public_tokenizers.path(bpe.RANKS)).ranks, special_tokens={})
    want = []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got(spark, bpe, out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_token_counts(spark, folder):
    out, rows, _ = folder
    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in sorted(rows, key=lambda r: r[0])]
    assert got(spark, token_counts, out, "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_wavelet_files(spark, folder):
    out, rows, _ = folder
    library, want, at = Tokenizer.from_file(public_tokenizers.path(wavelet.VOCABULARY)), [], 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got(spark, wavelet, out, "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_near_duplicates(spark, folder):
    out, rows, _ = folder
    want = near_brute(rows, 4)
    assert got(spark, minhash, out, "doc_id", "n_shingles", "component_id", "kept") == want and any(not r[3] for r in want)


def test_repeated_passages(spark, folder):
    out, rows, _ = folder
    want = repeats_brute(rows, 400)
    found = got(spark, suffix_dedup, out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
    assert sorted((r[:5] for r in found), key=str) == want and sum(r[2] > 0 for r in want) >= 2


def test_scores(spark, folder):
    out, rows, _ = folder
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for a, b in zip(got(spark, katz, out, *names), sorted(katz_brute(rows)), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_toxicity(spark, folder):
    out, rows, _ = folder
    found = got(spark, toxicity, out, "doc_id", "held_out", "score", "predicted")
    assert [r[0] for r in found] == sorted(i for i, _ in rows)
    for i, held, score, predicted in found:
        assert held == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= score <= 1 and predicted == int(score >= 0.5)
    truth = {i: "idiot" in (t or "") for i, t in rows}
    assert sum(truth[i] == bool(p) for i, *_, p in found) / len(found) > 0.95


def test_decontamination(spark, folder):
    out, rows, items = folder
    want = []
    for i, n, hit, who, flag in window_brute(rows, items, 13):
        want.append((i, n, hit, len(who), hashlib.sha256(",".join(sorted(map(str, who))).encode()).hexdigest(), flag))
    found = got(spark, decontam, out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert found == sorted(want) and any(r[3] == 2 for r in want)
