"""The corpus pipeline, stage by stage, on a small set with one planted case of each kind."""

import random
import zlib

import corpus_pipeline as cp
import pytest
from quarry.llm import registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    rnd = random.Random(7)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghijk") for _ in range(rnd.randrange(3, 9))) for _ in range(n))
    rows = [(i, text(60), "en", "s", 0) for i in range(300)]
    labels = []
    for i in range(0, 300, 3):  # a third toxic, by a word
        rows[i] = (i, rows[i][1] + (" idiot" if i % 2 else " moron") + " end", *rows[i][2:])
    for i in range(300):
        labels.append((i, 1, int(i % 3 == 0)))
    passage = text(60)
    rows[1] = (1, rows[1][1] + " " + passage, *rows[1][2:])
    rows[2] = (2, text(30) + " " + passage + " " + rows[2][1], *rows[2][2:])
    words = rows[4][1].split()
    rows += [(1000, rows[4][1], "en", "s", 0), (1001, " ".join([*words[:-1], "changed"]), "en", "s", 0), (1002, None, "en", "s", 0), (1003, "", "en", "s", 0)]
    item = text(20)
    rows[5] = (5, item + " " + text(50), *rows[5][2:])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, passage


def test_stages(spark, folder):
    out, passage = folder
    docs, kept = spark.read.parquet(f"{out}/documents.parquet"), []
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, out).collect(), docs.schema)
        assert tuple(docs.columns) == cp.COLUMNS
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    clean = {i for i in range(300) if i % 3} | {1000, 1001, 1002, 1003}
    assert set(kept[0]) == clean
    assert set(kept[1]) == clean - {1000, 1001}
    assert passage[30:-30] not in kept[2][1] and passage[30:-30] not in kept[2][2] and kept[2][1] and all(kept[2][i] == kept[1][i] for i in kept[1] if i not in (1, 2))
    assert set(kept[3]) == clean - {1000, 1001, 5}
    last = cp.STAGES[-1][1](spark, docs, out).collect()
    assert {r["doc_id"] for r in last} == set(kept[3]) and all(r["n_tokens"] > 0 for r in last if kept[3][r["doc_id"]])


def test_short_words(spark):
    """A passage of over 50 words goes even below ``PASSAGE`` bytes; one of 50 words stays."""
    rnd = random.Random(3)
    words = lambda n, a, b: " ".join("".join(rnd.choice("abcdefghijk") for _ in range(rnd.randrange(a, b))) for _ in range(n))
    long, short, own = words(53, 2, 4), words(50, 2, 4), [words(30, 4, 8) for _ in range(5)]
    assert len(long) < cp.PASSAGE
    texts = [f"{own[0]} {long} end", f"{long}\n{own[1]}", f"{own[2]} {short} this", f"{short} that {own[3]}", own[4], None, ""]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.cut_repeats(spark, df, "").collect()}
    want = [f"{own[0]}  end", f"\n{own[1]}", *texts[2:]]
    assert got == {i: (t, len(t or "")) for i, t in enumerate(want)}
    twice = spark.createDataFrame([(7, long, "en", "s", 0), (7, long, "en", "s", 0), (8, "a " * 60, "en", "s", 0)], df.schema)
    assert sorted(r.text for r in cp.cut_repeats(spark, twice, "").collect()) == ["", "", " "]


def test_registry():
    assert sorted(registry.queries()) == sorted(f"op{n}_{x}" for n, x in ((1, "topk_search"), (2, "byte_bpe"), (3, "lm_scoring"), (4, "token_counts"), (5, "perspective_rotation"), (6, "minhash_dedup"), (7, "wavelet_tokens"), (8, "suffix_dedup"), (9, "toxicity"), (10, "decontamination"), (11, "quality_rules"), (12, "vector_codes"), (13, "feature_history")))
    assert zlib.crc32(b"0") and set(registry.oracle_sql()) == {"op1_topk_search", "op5_perspective_rotation", "op12_vector_codes", "op13_feature_history"}


def test_rows_that_repeat_ids(spark):
    """A text that nothing resembles stays, though its id repeats; of equal rows one stays; null ids, null and empty texts stay."""
    rnd = random.Random(13)
    text = lambda: " ".join("".join(rnd.choice("abcdefghijk") for _ in range(5)) for _ in range(40))
    a, b, c = text(), text(), text()
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 2), (2, a, "en", "s", 3), (3, c, "en", "t", 4), (3, c, "en", "s", 4), (3, c, "en", "s", 4), (4, None, "en", "s", 0), (4, "", "en", "s", 0), (None, a, "en", "s", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, schema)
        got = sorted(map(tuple, cp.drop_near_duplicates(spark, df, "").collect()), key=str)
        assert got == sorted([rows[0], rows[1], rows[4], rows[6], rows[7], rows[8]], key=str)


def test_nothing_at_all(spark, tmp_path):
    """Empty tables go through all stages."""
    out = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    assert cp.run(spark, out).count() == 0
