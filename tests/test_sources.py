"""Sources and sinks on real files: folders, sidecars, caches, publishing, providers and progress."""

import json
import threading
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import providers
from quarry.functions.providers import Provider, features, two_phase
from quarry.sources import files, publish, sinks
from quarry.streaming.progress import Progress


def names(df, column="name"):
    return sorted(r[column] for r in df.collect())


@pytest.fixture
def folder(tmp_path):
    for sub in ("gen", "ref", "train"):
        (tmp_path / sub).mkdir()
    for sub, found in (("gen", ("b.PNG", "a.jpg", "note.txt")), ("ref", ("1.png", "2.webp", "3.jpeg")), ("train", ("x.png",))):
        for name in found:
            (tmp_path / sub / name).write_bytes(b"x" * len(name))
    return tmp_path


def test_image_folders(spark, folder):
    gen = files.image_files(spark, f"{folder}/gen").orderBy("image_id").collect()
    assert [(r.name, r.ext, r.length) for r in gen] == [("a.jpg", "jpg", 5), ("b.PNG", "png", 5)] and all(r.file_key.startswith(f"{r.name}|5|") for r in gen)
    every = files.evaluation_files(spark, f"{folder}/gen", f"{folder}/ref", f"{folder}/train")
    assert {(r.role, r["count"]) for r in every.groupBy("role").count().collect()} == {("gen", 2), ("ref", 3), ("train", 1)}
    with pytest.raises(ValueError, match="three reference"):
        files.evaluation_files(spark, f"{folder}/gen", f"{folder}/train")
    (folder / "none").mkdir()
    (folder / "none" / "a.txt").write_text("")
    with pytest.raises(ValueError, match="no generated"):
        files.evaluation_files(spark, f"{folder}/none", f"{folder}/ref")
    assert names(files.reference_files(spark, f"{folder}/ref/2.webp")) == ["2.webp"] and len(names(files.reference_files(spark, f"{folder}/ref"))) == 3
    some = spark.createDataFrame([("b.PNG",), ("b.PNG",), ("other.png",)], "name string")
    assert names(files.mask_inputs(spark, f"{folder}/gen", some)) == ["b.PNG"] and len(names(files.mask_inputs(spark, f"{folder}/gen"))) == 2


def test_sound_folder_and_sidecars(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("a.wav", "deep/b.MP3", "a.lyrics.txt", "deep/b.json", "deep/a.caption.txt", "c.m4a"):
        (tmp_path / name).write_bytes(b"x")
    music = files.media_files(spark, str(tmp_path), files.MUSIC, recursive=True)
    assert names(music) == ["a.wav", "b.MP3"] and names(files.media_files(spark, str(tmp_path), files.VOICES)) == ["a.wav", "c.m4a"]
    every = files.media_files(spark, str(tmp_path), ("txt", "json"), recursive=True)
    got = {r.name: (r.has_lyrics, r.has_json, r.has_caption) for r in files.with_sidecars(music, every).collect()}
    assert got == {"a.wav": (True, False, False), "b.MP3": (False, True, False)}


def test_voices(spark, tmp_path):
    with wave.open(f"{tmp_path}/v.wav", "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes((np.sin(np.arange(8000) * 2 * np.pi * 200 / 8000) * 20000).astype("<i2").tobytes())
    (tmp_path / "broken.wav").write_bytes(b"RIFFxxxx")
    got = {r.name: (r.duration_s, r.sample_rate, r.f0_mean_hz) for r in files.voice_measures(files.media_files(spark, str(tmp_path), files.VOICES, content=True)).collect()}
    assert got["v.wav"][:2] == (1.0, 8000) and abs(got["v.wav"][2] - 200) < 5 and got["broken.wav"][2] is None


def test_small_files(spark, tmp_path):
    (tmp_path / "tags.csv").write_text("tag_id,name,category,count\n1,hat,0,9\n2,ann,4,3\n")
    assert sorted(map(tuple, files.tag_vocabulary(spark, f"{tmp_path}/tags.csv").collect())) == [("ann", 4), ("hat", 0)]
    (tmp_path / "r.json").write_text(json.dumps({"grade": "A", "images": [{"name": "x"}]}, indent=1))
    r = files.saved_report(spark, f"{tmp_path}/r.json").first()
    assert r.grade == "A" and r.images[0].name == "x"
    assert names(files.job_payload(spark, '[{"name": "a", "n": 1}, {"name": "b", "n": 2}]')) == ["a", "b"] and files.job_payload(spark, "[]").count() == 0
    assert files.with_defaults({"a": 2}, {"a": 1, "b": 3}) == {"a": 2, "b": 3}
    sinks.write_results(spark.createDataFrame([("é", None)], "name string, x int"), f"{tmp_path}/out")
    assert [r.name for r in spark.read.json(f"{tmp_path}/out").collect()] == ["é"]


def test_reports(spark, tmp_path):
    one = lambda row, schema: spark.createDataFrame([row], schema)
    lines = sinks.report_lines(
        one(("B", 3, 9), "grade string, n_yes long, total long"), one(("front", 2, "low"), "part string, n long, state string"), one(("sdxl", 70, "B"), "family string, score int, grade string"), one((1, "small_set", 9), "ord int, code string, n long"),
        one((1, "profile", 4), "ord int, shot string, n long"), one((1, "blurry", 2), "ord int, code string, n long"), one((7, "a.png", "yes", "ok"), "image_id long, name string, viable string, reason string"),
    )
    sinks.write_lines(lines, f"{tmp_path}/report")
    text = "".join(p.read_text() for p in (tmp_path / "report").glob("part-*"))
    assert text.splitlines() == ["grade B, usable 3 of 9", "coverage front: 2 (low)", "missing profile: 4", "action blurry: 2", "target sdxl: 70 B", "advice small_set: 9", "image a.png: yes (ok)"]
    (doc,) = sinks.workflow_documents(one(("profile", "side view", 4), "category string, fragment string, n long"), "ann", "ref.png").collect()
    flow = json.loads(doc.document)
    assert [n["type"] for n in flow["nodes"]] == ["reference", "prompt", "batch", "sampler"] and flow["nodes"][1]["value"] == "ann, side view" and {k["target"] for k in flow["links"]} == {4}


def test_a_cache_is_replaced_while_it_is_read(spark, tmp_path):
    path, schema = f"{tmp_path}/cache", "file_key string, v int, version int"
    rows = lambda: sorted((r.file_key, r.v) for r in files.read_cache(spark, path, schema).collect())
    assert rows() == []
    sinks.write_cache(spark.createDataFrame([("a", 1), ("b", 2)], "file_key string, v int"), path)
    held = files.read_cache(spark, path, schema)
    sinks.write_cache(held.where("file_key <> 'b'").drop("version").withColumn("v", F.col("v") + 1), path)  # from itself
    assert rows() == [("a", 2)] and sorted(r.v for r in held.collect()) == [1, 2]
    with pytest.raises(Exception):
        sinks.write_cache(held.select("file_key", F.raise_error(F.lit("died")).cast("int").alias("v")), path)
    assert rows() == [("a", 2)] and files.read_cache(spark, path, schema, version=3).count() == 0


def test_publishing_is_all_or_nothing(spark, tmp_path):
    out = tmp_path / "out"
    plan = spark.range(40, numPartitions=4).select(F.concat(F.lit("10_ann/"), F.col("id").cast("string"), F.lit(".txt")).alias("path"), F.when(F.col("id") != 7, F.repeat(F.lit("ü"), F.col("id").cast("int"))).alias("body"))
    with pytest.raises(Exception):  # one task dies after others have written
        publish.publish(plan.withColumn("body", F.when(F.col("path") == "10_ann/39.txt", F.raise_error(F.lit("died"))).otherwise(F.col("body"))), str(out))
    assert not [p for p in out.rglob("*") if p.is_file()] and not list(out.glob(".staging-*"))
    assert publish.publish(plan, f"file://{out}") == {"written": 39, "kept": 0, "errors": 1}
    assert (out / "10_ann/3.txt").read_text() == "üüü" and len(list(out.glob("10_ann/*"))) == 39 and not list(out.glob(".staging-*"))
    again = plan.limit(3).withColumn("body", F.lit("new")).union(spark.createDataFrame([("fresh.txt", "f"), ("../away", "x"), ("/abs", "x"), (None, "x")], "path string, body string"))
    assert publish.publish(again, str(out), keep=True) == {"written": 1, "kept": 3, "errors": 3} and (out / "10_ann/2.txt").read_text() == "üü"
    assert publish.publish(plan.limit(3).withColumn("body", F.lit("new")), str(out))["written"] == 3 and (out / "10_ann/2.txt").read_text() == "new"
    assert not (tmp_path / "away").exists() and len(list((out / publish.RUNS).iterdir())) == 3


def test_providers(spark):
    rows = spark.range(10, numPartitions=2).withColumn("_due", F.lit("own"))
    double = lambda: lambda b: {"twice": [2 * x for x in b.column(0).to_pylist()]}

    def broken():
        raise ImportError("no model")

    def slow():
        time.sleep(0.2)
        return double()

    def strict():
        def run(b):
            assert b.num_rows <= 2 and all(x % 4 == 0 for x in b.column(0).to_pylist())
            return {"twice": [2 * x for x in b.column(0).to_pylist()]}

        return run

    make = lambda load, required=False: Provider("p", "twice long", load, required)
    got = lambda df: {r.id: r.twice for r in df.collect()}
    assert got(features(rows, make(slow))) == {i: 2 * i for i in range(10)} and features(rows, make(slow)).columns == ["id", "_due", "twice"]
    assert set(got(features(rows, make(broken))).values()) == {None}
    with pytest.raises(Exception, match="no model"):
        features(rows, make(broken, True)).collect()
    some = two_phase(rows, F.when(F.col("id") < 9, F.col("id") % 4 == 0), make(strict))  # only due rows reach the model
    assert got(some) == {i: 2 * i if i in (0, 4, 8) else None for i in range(10)}
    assert set(got(two_phase(rows, F.lit(False), make(broken, True))).values()) == {None}  # a model that nobody needs isn't loaded
    for kind in providers.BOUNDARIES:
        df = features(rows, providers.boundary(kind, "no_such_module"))
        assert df.drop("id", "_due").where(" AND ".join(f"{n} IS NULL" for n in df.columns[2:])).count() == 10


def test_progress_of_a_stream(spark, tmp_path):
    seen, told = [], threading.Event()

    def callback(done, total, name):
        seen.append((done, total, name))
        if done >= 6:
            told.set()

    listener = Progress(callback, 6, "own")
    spark.streams.addListener(listener)
    try:
        for i in range(2):
            spark.range(i * 3, i * 3 + 3).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for name in ("own", "other"):
            s = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.queryName(name).foreachBatch(lambda b, _: b.count() and None)
            s.option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        assert told.wait(20)
    finally:
        spark.streams.removeListener(listener)
    assert seen[-1] == (6, 6, "own") and {n for *_, n in seen} == {"own"} and [d for d, *_ in seen] == sorted(d for d, *_ in seen)
