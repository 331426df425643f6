"""Decoders, metadata, training folders, configurations and caches on small files."""

import io
import json
import struct
import tomllib
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import export
from quarry.sources import dimensions, files, scratch, sinks


def png(pixels, depth=8, colour=2, extra=b"", kind=0):
    """A PNG whose rows all have the filter ``kind``, written by the letter of the format."""
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    h, w = pixels.shape[:2]
    flat = pixels.reshape(h, -1).astype(np.int32)
    step = pixels.shape[2] if pixels.ndim == 3 else 1
    out, above = b"", np.zeros(flat.shape[1], np.int32)
    for row in flat:
        left = np.concatenate([np.zeros(step, np.int32), row[:-step]])
        corner = np.concatenate([np.zeros(step, np.int32), above[:-step]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][kind]
        out += bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes()
        above = row
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def text_chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    x = np.random.default_rng(kind).integers(0, 256, (9, 11, 3)).astype(np.uint8)
    assert (files.decode_png(png(x, kind=kind)) == x).all()


def test_png_kinds():
    grey = np.random.default_rng(1).integers(0, 256, (4, 6, 1)).astype(np.uint8)
    assert (files.decode_png(png(grey, colour=0)) == grey).all()
    palette = text_chunk(b"PLTE", bytes([1, 2, 3, 9, 8, 7]))
    assert files.decode_png(png(np.array([[0x40]], np.uint8), depth=1, colour=3, extra=palette))[0, 0].tolist() == [1, 2, 3]
    assert files.decode_png(b"") is None and files.decode_png(png(grey, colour=0)[:40]) is None
    assert (files.decode_png(files.encode_png(grey)) == grey).all()


def tiff(tags):
    at, head, tail = 10 + 12 * len(tags) + 4 - 2, b"II*\0" + struct.pack("<IH", 8, len(tags)), b""
    for tag, value in tags.items():
        raw = value.encode() + b"\0"
        head += struct.pack("<HHII", tag, 2, len(raw), at + 2 + len(tail))
        tail += raw
    return head + b"\0\0\0\0" + tail


def test_metadata():
    x = np.zeros((2, 2, 3), np.uint8)
    extra = text_chunk(b"tEXt", b"parameters\0steps 20, ComfyUI " + b"x" * 300) + text_chunk(b"zTXt", b"Comment\0\0" + zlib.compress(b"packed")) + text_chunk(b"iTXt", b"prompt\0\0\0\0\0caf\xc3\xa9") + text_chunk(b"eXIf", tiff({305: "Fooocus 2", 270: "a picture"}))
    got = files.image_metadata(png(x, extra=extra))
    assert got["png_parameters"].startswith("steps 20") and len(got["png_parameters"]) == 200 and got["marker"] == "parameters"
    assert (got["png_comment"], got["png_prompt"], got["exif_305"], got["exif_270"], got["software"]) == ("packed", "café", "Fooocus 2", "a picture", "fooocus 2")
    block = b"Exif\0\0" + tiff({305: "Camera"})
    assert files.image_metadata(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xda")["exif_305"] == "Camera"
    assert files.image_metadata(b"nothing") == {} and files.c2pa_manifest(b"", "image/png") is None


def sound(seconds, rate=8000, channels=1):
    t = np.arange(int(seconds * rate)) / rate
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.repeat((np.sin(2 * np.pi * 200 * t) * 20000).astype("<i2"), channels).tobytes())
    return out.getvalue()


def test_audio():
    raw = sound(2)
    assert files.audio_meta(raw) == (2.0, 8000) and abs(files.mean_pitch(np.asarray(files.decode_wave(raw)[0]), 8000) - 200) < 1
    for cut in (1, 2, 3):
        assert files.decode_wave(sound(0.1, channels=2)[:-cut]) is not None
    flac = b"fLaC" + bytes(14) + ((44100 << 44) | (441000)).to_bytes(8, "big")
    assert files.audio_meta(flac) == (10.0, 44100)
    ogg = b"OggS" + bytes(24) + b"\x01vorbis" + struct.pack("<IBI", 0, 2, 32000) + b"OggS\0\0" + struct.pack("<q", 64000)
    assert files.audio_meta(ogg) == (2.0, 32000)
    assert files.audio_meta(b"ID3\x04\0\0\0\0\0\0" + b"\xff\xfb\x90\x00" + bytes(15996)) == (1.0, 44100)
    assert files.audio_meta(b"no sound") == (None, None) and files.mean_pitch(np.zeros(9000), 8000) is None


def test_training_folder(spark, tmp_path):
    target = dimensions.target(spark, "sdxl_kohya")
    with pytest.raises(ValueError, match="no target"):
        dimensions.target(spark, "unknown")
    x = np.random.default_rng(2).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    rows = [(1, "yes", bytes(png(x)), "a, b", "", ""), (2, "no", bytes(png(x)), "a", "", ""), (3, "borderline", b"broken", "a", "", "")]
    plan = export.export_plan(spark.createDataFrame(rows, "image_id long, viable string, content binary, tags string, joy string, natural string"), target, "ann", F.expr("named_struct('x1', 2, 'y1', 3, 'x2', 12, 'y2', 13)"))
    home = str(tmp_path / "out")
    target["resolutions"] = [{"w": 8, "h": 8}]
    states = {r.path.rsplit("/", 1)[1]: r.state for r in sinks.write_training_images(export.training_files(plan, target, "ann", home)).collect()}
    assert states == {"ann_001.png": "written", "ann_002.png": "unreadable"}
    assert files.decode_png((tmp_path / "out/10_ann/ann_001.png").read_bytes()).shape == (8, 8, 3)
    assert {r.state for r in sinks.write_texts(sinks.caption_files(plan, f"{home}/10_ann")).collect()} == {"written"}
    assert (tmp_path / "out/10_ann/ann_001.txt").read_text() == "ann, a, b"
    counted = export.export_counters(spark.createDataFrame([("written",), ("skipped",), ("unreadable",)], "state string")).first()
    assert tuple(counted) == (1, 1, 1)


def test_configurations(spark, tmp_path):
    plan = sinks.config_files(dimensions.targets(spark), str(tmp_path), "ann")
    bodies = configs = {r.path: r.body for r in plan.collect()}
    assert len(configs) == 18 and {p.rsplit("/", 1)[1] for p in configs} == set(sinks.CONFIG_FILES.values())
    launch = {r.path: r.body for r in sinks.launch_files(dimensions.targets(spark), str(tmp_path), "ann").collect()}
    assert len(launch) == 19 and "Trigger word: ann" in launch[f"{tmp_path}/onetrainer_sdxl/README.txt"]
    for path, body in configs.items():
        if path.endswith(".toml"):
            assert tomllib.loads(body)
        else:
            assert all(":" in line for line in body.splitlines()[1:])
    kohya = tomllib.loads(bodies[f"{tmp_path}/sdxl_kohya/dataset_config.toml"])
    assert kohya["datasets"][0]["subsets"][0] == {"image_dir": f"{tmp_path}/sdxl_kohya/10_ann", "num_repeats": 10}
    pipe = tomllib.loads(bodies[f"{tmp_path}/hunyuan_diffpipe/diffusion_pipe_config.toml"])
    assert pipe["adapter"]["rank"] == 32 and pipe["dataset"]["directory"][0]["path"].endswith("/images")
    assert {r.state for r in sinks.write_texts(plan).collect()} == {"written"} and (tmp_path / "flux_kohya/kohya_flux_config.toml").exists()


def test_masks(spark, tmp_path):
    path = str(tmp_path / "m/a.png")
    big = [float(i) for i in range(40 * 40)]
    df = lambda mask, h: spark.createDataFrame([(path, h, 40, mask)], "path string, height int, width int, mask array<float>")
    assert sinks.write_masks(df(big, 40)).first().state == "written"
    assert sinks.write_masks(df(big, 40)).first().state == "kept" and sinks.write_masks(df(big, 41)).first().state == "error"
    got = files.decode_png((tmp_path / "m/a.png").read_bytes())
    assert got.min() == 0 and got.max() == 255
    sinks.write_config({"a": 1}, str(tmp_path / "c.json"))
    assert json.loads((tmp_path / "c.json").read_text()) == {"a": 1}


def test_folder_of_photographs(spark, tmp_path):
    """JPEG goes through Spark's image source; what it can't read stays with an error."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(32, 24, 1)
    for x in range(32):
        for y in range(24):
            image.setRGB(x, y, 0x00FF0000 if x < 16 else 0x000000FF)
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(tmp_path / "a.jpg")))
    (tmp_path / "b.png").write_bytes(png(np.full((5, 6, 3), 77, np.uint8)))
    (tmp_path / "c.jpg").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.folder_features(spark, str(tmp_path)).collect()}
    assert (got["a.jpg"].width, got["a.jpg"].height, got["a.jpg"].error) == (32, 24, None) and got["a.jpg"].contrast > 20
    assert got["b.png"].bright == 77.0 and got["c.jpg"].error == "unreadable" and got["c.jpg"].width is None
    plain = {r.name: r.error for r in files.image_features(files.image_files(spark, str(tmp_path), content=True)).collect()}
    assert plain == {"a.jpg": "no decoder", "b.png": None, "c.jpg": "unreadable"}
    meta = files.with_metadata(files.image_files(spark, str(tmp_path), content=True)).select("name", "metadata", "c2pa").collect()
    assert all(r.metadata == {} and r.c2pa is None for r in meta)


def test_broken_cache_is_empty(spark, tmp_path):
    schema = "file_key string, version int"
    good, bad = str(tmp_path / "good"), tmp_path / "bad"
    spark.createDataFrame([("a", 2), ("b", 1)], schema).write.parquet(good)
    bad.mkdir()
    (bad / "part.parquet").write_bytes(b"PAR1 not really")
    assert [r.file_key for r in files.read_cache(spark, good, schema).collect()] == ["a"]
    assert files.read_cache(spark, str(bad), schema).count() == 0 and files.read_cache(spark, str(tmp_path / "none"), schema).count() == 0


def test_scratch_goes(spark):
    root = scratch.scratch_root(spark, "gone")
    df = scratch.settle(spark.range(3), root, "x")
    assert df.count() == 3
    others = [x for x in scratch._LIVE if x[1] != root]
    scratch._LIVE[:] = [x for x in scratch._LIVE if x[1] == root]
    scratch.clear_scratch()
    scratch._LIVE[:] = others
    assert not spark._jvm.java.io.File(root.removeprefix("file:")).exists()
