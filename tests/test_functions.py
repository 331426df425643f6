"""Boundaries of every threshold, on literal rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import audio, classify, geometry, text
from quarry.operators import aggregates, export, graph, incremental, pairs
from quarry.sources import dimensions, files, sinks
from quarry.streaming import progress

c = F.col


def values(df, expression):
    return [r[0] for r in df.select(expression.alias("x")).collect()]


def test_quality_label(spark):
    rows = [(99.9, 100.0, 50.0, 1.0), (100.0, 39.9, 50.0, 1.0), (100.0, 220.1, 24.9, 0.49), (500.0, 220.0, 25.0, 0.5), (500.1, 40.0, 25.0, 0.5), (None, None, None, None)]
    df = spark.createDataFrame(rows, "s double, b double, k double, m double")
    assert values(df, classify.quality_label(c("s"), c("b"), c("k"), c("m"))) == ["blurry", "dark", "overexposed + flat + low_res", "ok", "very_sharp", "ok"]


def test_framing_and_ratios(spark):
    df = spark.createDataFrame([(0, 50.0), (1, 15.0), (1, 14.9), (1, 2.0), (1, 1.9), (None, None)], "f int, p double")
    assert values(df, classify.shot_type(c("f"), c("p"))) == ["body_only", "face_only", "both", "both", "body_only", "body_only"]
    df = spark.createDataFrame([(49, 100), (50, 100), (89, 100), (90, 100), (110, 100), (111, 100), (200, 100), (201, 100)], "w int, h int")
    assert values(df, classify.aspect_bucket(c("w"), c("h"))) == ["tall_portrait", "portrait", "portrait", "square", "square", "landscape", "landscape", "wide_landscape"]


#: duplicate, artifacts, sharp, megapixels, faces, reference, average, proportion, yaw, brightness -> verdict, codes
VERDICTS = [
    ((False, "none", 100.0, 0.4, 1, 0.5, 0.1, 1.0, 50.0, 220.0), "yes", "ok"), ((True, "none", 200.0, 1.0, 1, 0.9, 0.9, 5.0, 0.0, 100.0), "no", "duplicate"), ((False, "high", 200.0, 1.0, 1, 0.9, 0.9, 5.0, 0.0, 100.0), "no", "artifacts_high"),
    ((False, "medium", 200.0, 1.0, 1, 0.9, 0.9, 5.0, 0.0, 100.0), "borderline", "artifacts_medium"), ((False, "none", 99.9, 1.0, 1, 0.9, 0.9, 5.0, 0.0, 100.0), "no", "blurry"), ((False, "none", 200.0, 0.39, 1, 0.9, 0.9, 5.0, 0.0, 100.0), "no", "low_res"),
    ((False, "none", None, None, None, 0.9, 0.9, None, None, None), "no", "no_face"), ((False, "none", 200.0, 1.0, 2, 0.9, 0.9, 5.0, 0.0, 100.0), "no", "many_faces"), ((False, "none", 200.0, 1.0, 1, 0.34, 0.9, 5.0, 0.0, 100.0), "no", "wrong_person"),
    ((False, "none", 200.0, 1.0, 1, 0.35, 0.9, 5.0, 0.0, 100.0), "borderline", "doubtful_person"), ((False, "none", 200.0, 1.0, 1, None, 0.29, 5.0, 0.0, 100.0), "no", "outlier_face"), ((False, "none", 200.0, 1.0, 1, None, 0.3, 5.0, 0.0, 100.0), "borderline", "weak_face"),
    ((False, "none", 200.0, 1.0, 1, 0.9, 0.9, 0.9, 0.0, 100.0), "borderline", "tiny_face"), ((False, "none", 200.0, 1.0, 1, 0.9, 0.9, 5.0, -75.1, 100.0), "no", "extreme_angle"), ((False, "none", 200.0, 1.0, 1, 0.9, 0.9, 5.0, 75.0, 100.0), "borderline", "strong_angle"),
    ((False, "none", 200.0, 1.0, 1, 0.9, 0.9, 5.0, 0.0, 39.9), "no", "dark"), ((False, "none", 200.0, 1.0, 1, None, 0.4, 5.0, 0.0, 220.1), "borderline", "overexposed"), ((False, "none", 200.0, 1.0, 1, None, 0.4, 0.5, 0.0, 230.0), "borderline", "tiny_face"),
]


def test_viability(spark):
    df = spark.createDataFrame([r for r, _, _ in VERDICTS], "d boolean, a string, s double, m double, f int, r double, v double, p double, y double, b double")
    reasons = classify.viability_reasons(*(c(n) for n in "dasmfrvpyb"))
    got = df.select(classify.viability(reasons, c("b"), c("r"), c("v")).alias("v"), classify.reason_codes(reasons).alias("codes")).collect()
    assert [tuple(r) for r in got] == [(v, codes) for _, v, codes in VERDICTS]


def test_tags_and_captions(spark):
    one = spark.range(1)
    tags = "array(struct('a' AS tag, 0 AS category, 0.35D AS p), struct('b(c)' AS tag, 0 AS category, 0.6D AS p), struct('d' AS tag, 4 AS category, 0.86D AS p), struct('Solo' AS tag, 0 AS category, 0.9D AS p), struct('e' AS tag, 0 AS category, 0.6D AS p))"
    assert values(one, classify.select_tags(F.expr(tags))) == ["d, b\\(c\\), e"]
    rows = [("wd14", "red, Ann", None, None, None), ("wd14", "", "joy", "nat", None), ("natural", "a, b", "", "", "best, ,"), ("natural", "a", "joy", "nat", "best"), ("natural", "a", None, "nat", ""), ("other", "a", "j", "n", None)]
    df = spark.createDataFrame(rows, "k string, t string, j string, n string, p string")
    got = values(df, text.build_caption(c("k"), c("t"), c("j"), c("n"), F.lit("Ann"), c("p")))
    assert got == ["red, Ann", "Ann", "best, , a photo of Ann, a and b", "best, Ann, joy", "Ann, nat", "Ann"]


def test_artifacts_and_provenance(spark):
    df = spark.createDataFrame([("1girl, Bad Hands, lowres", "a deformed eye", None), (None, "", "extra arm seen"), ("lowres", None, None), ("", "", "")], "t string, j string, n string")
    cats, worst = text.combined_artifacts(c("t"), c("j"), c("n"))
    assert [(r[0], r[1]) for r in df.select(F.array_join(cats, ","), worst).collect()] == [("eyes,hands,quality", "high"), ("limbs", "medium"), ("quality", "low"), ("", "none")]
    names = spark.createDataFrame([("X_SDXL.png",), ("ComfyUI_1.png",), ("holiday.png",)], "n string")
    assert values(names, text.filename_match(c("n"))) == ["_sdxl", "comfyui_", None]


def test_artifacts_are_searched_once(spark):
    """Each pattern stands once in what runs, though both categories and severity need it."""
    df = spark.createDataFrame([("bad_hands, blurry face", "", "Three Legs"), ("bad eyes", None, "a lazy eye"), ("", "fine", "extra arm"), (None, None, None)], "t string, j string, n string")
    found = df.select(text.artifact_findings(c("t"), c("j"), c("n")).alias("f")).select("f.categories", "f.severity")
    assert [(*r,) for r in found.collect()] == [(["hands", "limbs", "quality"], "high"), (["eyes"], "high"), ([], "none"), ([], "none")]
    from quarry.plans import text_queries

    plan = text_queries.severity(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert [plan.count(p) for p in ("bad_hands", "worst_quality", "twisted limb")] == [1, 1, 1] and "rlike" not in plan.lower()


def test_suggestions(spark):
    df = spark.createDataFrame([("Generate 3-5 profile photos",), ("7 shots",), ("side view",), ("Add 2 3/4 views",)], "s string")
    assert values(df, text.suggestion_count(c("s"))) == [5, 7, 5, 3]
    assert values(df, text.match_shot(c("s"))["category"]) == ["profile", None, "profile", "three_quarter"]


def test_versions_and_text(spark):
    df = spark.createDataFrame([("v1.10", "1.9")], "a string, b string")
    assert values(df, text.version_key(c("a")) > text.version_key(c("b"))) == [True]
    assert values(spark.createDataFrame([("a → “b” 😀 日",)], "t string"), text.latin_text(c("t"))) == ['a -> "b"  ?']


def test_crops(spark):
    df = spark.createDataFrame([(90.0, 90.0, 100.0, 100.0, 100, 100), (0.0, 0.0, 10.0, 10.0, 100, 100), (0.0, 0.0, 80.0, 90.0, 100, 60)], "x1 double, y1 double, x2 double, y2 double, w int, h int")
    got = values(df, geometry.square_crop(*(c(n) for n in ("x1", "y1", "x2", "y2", "w", "h"))))
    assert [tuple(b) for b in got] == [(78, 78, 100, 100), (0, 0, 22, 22), (10, 0, 70, 60)]
    res = F.expr("array(struct(720 AS w, 720 AS h), struct(832 AS w, 480 AS h), struct(480 AS w, 832 AS h))")
    assert [tuple(b) for b in values(spark.createDataFrame([(100, 100), (300, 100), (10, 100)], "w int, h int"), geometry.nearest_bucket(c("w"), c("h"), res))] == [(720, 720), (832, 480), (480, 832)]


def test_audio(spark):
    rows = [(False, 2.9, 40000, -35.0, 20.0, "wav"), (False, 30.1, 39999, -35.1, 19.9, "mp3"), (False, 3.0, 40000, -35.0, 30.0, "flac"), (False, 30.0, 40000, -20.0, None, "wav"), (True, None, None, None, None, "wav"), (False, 5.0, 48000, -20.0, 25.0, "ogg")]
    df = spark.createDataFrame(rows, "e boolean, d double, r int, l double, s double, x string").withColumn("i", audio.voice_issues(c("e"), c("d"), c("r"), c("l"), c("s"), c("x")))
    assert [(r[0], r[1]) for r in df.select(F.array_join("i", ","), audio.voice_grade(c("i"), c("s"))).collect()] == [
        ("too_short", "D"), ("too_long,low_sample_rate,too_quiet,noisy,lossy_format", "C"), ("", "A"), ("", "B"), ("unreadable", "F"), ("lossy_format", "B"),
    ]
    waves = spark.createDataFrame([([0.0] * 40,), ([0.5] * 40,), ([1.0],)], "w array<double>")
    assert values(waves, audio.voice_level_db(c("w"))) == [-120.0, -6.0, 0.0] and values(waves, audio.music_level_db(c("w"))) == [-240.0, -6.0, 0.0]
    assert values(waves, audio.noise_ratio_db(c("w"), F.lit(48000))) == [0.0, 0.0, None]


def test_leaders_differ_from_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "i long, j long")
    assert sorted(map(tuple, graph.greedy_leaders(edges).collect())) == [(1, 1), (2, 1), (3, 3), (4, 3)]
    assert sorted(map(tuple, graph.connected_components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (4, 1)]
    star = spark.createDataFrame([(1, 9), (2, 9), (3, 9)], "i long, j long")
    assert sorted(map(tuple, graph.greedy_leaders(star).collect())) == [(1, 1), (2, 2), (3, 3), (9, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_duplicates_equal_the_sequential_loop(spark, seed):
    from quarry.plans.analyze import duplicate_keepers

    if seed:
        rng = np.random.default_rng(seed)
        pool = [0, 0b1, 0b111111, 0b1111, 1 << 40, 0xFF << 20]
        rows = [(i, None if rng.random() < 0.1 else int(rng.choice(pool)) ^ int(rng.choice([0, 0, 0b11, 1 << 50]))) for i in range(1, 81)]
        faces = [(i, [1.0, 0.0] if rng.random() < 0.05 else [0.0, 0.0]) for i in range(1, 81)]
    else:  # copies of two near hashes: row 1 claims 5, 20 and 30
        rows, faces = [(1, 0), (5, 0b11), (20, 0b11), (30, 0b11), (40, 0xFF << 30), (41, None)], [(40, [1.0, 0.0]), (41, [1.0, 0.0])]
    v, keeper = dict(faces), {}
    for n, (i, h) in enumerate(rows):
        if i in keeper:
            continue
        for j, g in rows[n + 1 :]:
            if j not in keeper and ((h is not None and g is not None and (h ^ g).bit_count() < 5) or np.dot(v.get(i, [0, 0]), v.get(j, [0, 0])) > 0.96):
                keeper[j] = i
    features, vectors = spark.createDataFrame(rows, "image_id long, phash long"), spark.createDataFrame(faces, "vec_id long, embedding array<double>")
    got = {r.id: r.keeper for r in duplicate_keepers(features, vectors).collect() if r.id != r.keeper}
    assert got == keeper and (seed or got == {5: 1, 20: 1, 30: 1, 41: 40})


def test_hamming_bands(spark):
    rows = [(1, 0), (2, 0b1111), (3, 0b11111), (4, -1), (5, -1 ^ (1 << 40)), (6, None), (7, 0)]
    got = sorted(map(tuple, pairs.hamming_pairs(spark.createDataFrame(rows, "image_id long, phash long"), 4).collect()))
    assert got == [(1, 2, 4, 2, 1), (2, 3, 1, 1, 1), (4, 5, 1, 1, 1)]


def test_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 7)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(30, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "vec_id long, embedding array<double>")
    sim = v @ v.T
    assert sorted((r.i, r.j) for r in pairs.similar_pairs(df, 1.0).collect()) == [(i, j) for i in range(30) for j in range(i + 1, 30) if sim[i, j] >= 1.0]
    got = {r.id: (r.average, r.least) for r in pairs.leave_one_out(df).collect()}
    for i in range(30):
        rest = np.delete(sim[i], i)
        assert got[i] == pytest.approx((rest.mean(), rest.min()))
    assert pairs.global_coherence(df).first()["coherence"] == pytest.approx(sim[np.triu_indices(30, 1)].mean())


def test_top_pairs_need_no_threshold(spark, monkeypatch, tmp_path):
    from quarry.plans.similarity_queries import top_pairs

    monkeypatch.setattr(pairs, "BLOCK", 4)
    v = {i: [0.25 if k == i % 5 else 0.0 for k in range(8)] + [0.01 * (i % 3)] for i in range(1, 19)}  # no product reaches 0.30
    spark.createDataFrame([*v.items(), (99, None)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = sorted(((i, j, float(np.dot(v[i], v[j]))) for i in v for j in v if i < j), key=lambda p: (-round(p[2], 9), p[0], p[1]))[:20]
    assert [(r.i, r.j) for r in top_pairs(spark, str(tmp_path)).collect()] == [p[:2] for p in want]


def test_cache_and_edits(spark):
    scan = spark.createDataFrame([("a|1|1",), ("b|1|2",)], "file_key string")
    cache = spark.createDataFrame([("a|1|1", 5, 2), ("b|1|1", 6, 2), ("b|1|2", 7, 1)], "file_key string, f int, version int")
    merged = incremental.cache_merge(scan, cache)
    assert sorted(map(tuple, merged.collect())) == [("a|1|1", 5, True), ("b|1|2", None, False)]
    after = incremental.cache_next(merged, spark.createDataFrame([("b|1|2", 8)], "file_key string, f int"))
    assert sorted(map(tuple, after.collect())) == [("a|1|1", 5, 2), ("b|1|2", 8, 2)]
    rows = spark.createDataFrame([("x", "t", "j", "n")], "name string, tags string, joy string, natural string")
    assert tuple(incremental.apply_edits(rows, spark.createDataFrame([("x", None, "J", None)], rows.schema)).select("tags", "joy", "natural").first()) == ("t", "J", "J")


def test_numbering_and_moves(spark):
    df = spark.createDataFrame([(i,) for i in range(1205, 0, -1)], "image_id long")
    got = {r.image_id: r.out_name for r in export.numbered(df, "image_id", "P").collect()}
    assert got[1] == "P_001" and got[1205] == "P_1205" and len(set(got.values())) == 1205
    moves = export.move_plan(spark.createDataFrame([(1, "a.png"), (2, "a.png"), (3, "b")], "image_id long, file string"), "image_id", "file")
    assert [r.target for r in moves.orderBy("image_id").collect()] == ["a.png", "a_1.png", "b"]


def test_verdict_scores(spark):
    rows = [(0.8, 0.1, 0, 10, 10, 0.1), (0.5, 0.02, 2, 10, 20, 0.41), (None, None, 0, 0, 5, None), (0.5, 0.02, 0, 9, 9, 0.4)]
    df = spark.createDataFrame(rows, "m double, s double, k int, f int, t int, h double")
    assert values(df, aggregates.evaluator_score(*(c(n) for n in "mskfth"))) == [100.0, 0.0, 0.0, 40.0]


def test_files(spark, tmp_path):
    import struct
    import wave
    import zlib

    grey = (np.add.outer(np.arange(20), np.arange(30)) * 5).astype(np.uint8)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = zlib.compress(b"".join(b"\0" + row.tobytes() for row in grey))
    (tmp_path / "A.PNG").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 30, 20, 8, 0, 0, 0, 0)) + chunk(b"IDAT", raw) + chunk(b"IEND", b""))
    (tmp_path / "b.jpg").write_bytes(b"junk")
    (tmp_path / "c.txt").write_text("no")
    got = [tuple(r) for r in files.image_features(files.image_files(spark, str(tmp_path), content=True)).orderBy("image_id").select("image_id", "name", "width", "height", "bright", "error").collect()]
    assert got == [(1, "A.PNG", 30, 20, round(float(grey.mean()), 1), None), (2, "b.jpg", None, None, None, "unreadable")]
    with wave.open(str(tmp_path / "v.wav"), "wb") as f:
        f.setnchannels(2), f.setsampwidth(2), f.setframerate(8000)
        f.writeframes(np.array([[16384, 0], [-16384, 0]], "<i2").tobytes())
    assert files.decode_wave((tmp_path / "v.wav").read_bytes()) == ([0.25, -0.25], 8000) and files.decode_wave(b"") is None
    assert files.difference_hash(np.tile(np.arange(32.0), (32, 1)) * 8) == -1


def test_sinks(spark, tmp_path):
    t = dimensions.targets(spark)
    plan = sinks.config_files(t, str(tmp_path / "cfg"), "Ann")
    assert plan.count() == 18 and {r.state for r in sinks.write_texts(plan).collect()} == {"written"}
    assert 'target = "sdxl_kohya"' in (tmp_path / "cfg/sdxl_kohya/dataset_config.toml").read_text()
    assert {r.state for r in sinks.write_texts(plan, overwrite=False).collect()} == {"kept"}


def test_progress_lines(spark):
    lines = [("TOTAL 5",), ("PROGRESS 2/5 a b.png",), ("STEP go on",), ("PROGRESS_DONE",), ("noise",)]
    got = [tuple(r) for r in progress.parse_lines(spark.createDataFrame(lines, "line string")).select("kind", "done", "total", "detail").collect()]
    assert got == [("TOTAL", None, 5, "5"), ("PROGRESS", 2, 5, "a b.png"), ("STEP", None, None, "go on"), ("PROGRESS_DONE", None, None, "")]
