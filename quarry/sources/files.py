"""Sources: media folders, sidecars, caches, tag vocabularies, saved reports and progress logs."""

from __future__ import annotations

import io
import json
import struct
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import classify
from quarry.operators.export import ranked
from quarry.sources.snapshots import Snapshots

c = F.col
IMAGES, VOICES, MUSIC = ("png", "jpg", "jpeg", "webp"), ("wav", "mp3", "flac", "ogg", "m4a", "opus"), ("mp3", "wav", "flac", "ogg", "opus")


def media_files(spark: SparkSession, folder: str, endings: tuple[str, ...], recursive: bool = False, content: bool = False) -> DataFrame:
    """``(path, name, folder, stem, ext, length, modificationTime, file_key[, content])`` of the files with such an ending, whatever its case."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    name = F.element_at(F.split("path", "/"), -1)
    files = read.load(folder).withColumn("ext", ext).where(c("ext").isin(*endings)).withColumn("name", name)
    files = files.withColumns({"folder": F.regexp_replace("path", r"/[^/]*$", ""), "stem": F.regexp_replace("name", r"\.[^.]*$", ""), "file_key": classify.file_key(c("name"), c("length"), c("modificationTime"))})
    return files if content else files.drop("content")


def image_files(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """The images of one folder, numbered by path as ``image_id``; the number decides ties everywhere."""
    return ranked(media_files(spark, folder, IMAGES, content=content), "path", "image_id")


def mask_inputs(spark: SparkSession, folder: str, names: DataFrame | None = None, content: bool = False) -> DataFrame:
    """The images of a folder to make masks of: all, or those whose name is in ``names`` (name)."""
    found = image_files(spark, folder, content)
    return found if names is None else found.join(names.select("name").distinct(), "name", "left_semi")


def reference_files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """The reference: one file, or the images of a folder."""
    return ranked(media_files(spark, path, IMAGES, content=content), "path", "image_id")


def evaluation_files(spark: SparkSession, generated: str, references: str, training: str | None = None) -> DataFrame:
    """The files of all roles; raises without generated files or with fewer than three references."""
    roles = [("gen", generated), ("ref", references), *([("train", training)] if training else [])]
    out = None
    for role, folder in roles:
        files = image_files(spark, folder).withColumn("role", F.lit(role))
        out = files if out is None else out.unionByName(files)
    n = {r["role"]: r["n"] for r in out.groupBy("role").agg(F.count("*").alias("n")).collect()}
    if not n.get("gen"):
        raise ValueError("no generated files")
    if n.get("ref", 0) < 3:
        raise ValueError("at least three reference files are needed")
    return out


def with_sidecars(files: DataFrame, every: DataFrame) -> DataFrame:
    """Adds ``has_lyrics``, ``has_json`` and ``has_caption``: whether such a file lies beside (by folder and stem)."""
    kind = F.when(c("name").endswith(".lyrics.txt"), "lyrics").when(c("name").endswith(".caption.txt"), "caption").when(c("name").endswith(".json"), "json")
    stem = F.regexp_replace("name", r"(\.lyrics\.txt|\.caption\.txt|\.json)$", "")
    found = every.select("folder", stem.alias("stem"), kind.alias("kind")).where("kind IS NOT NULL").groupBy("folder", "stem").agg(*(F.bool_or(c("kind") == k).alias(f"has_{k}") for k in ("lyrics", "json", "caption")))
    joined = files.join(found, ["folder", "stem"], "left")
    return joined.withColumns({f"has_{k}": F.coalesce(f"has_{k}", F.lit(False)) for k in ("lyrics", "json", "caption")})


def parse_sidecar(text: str) -> Column:
    """A JSON annotation's tempo and key; malformed text gives nulls."""
    return F.from_json(text, "bpm double, keyscale string, language string, caption string", {"mode": "PERMISSIVE"})


def read_cache(spark: SparkSession, path: str, schema: str, version: int = 2) -> DataFrame:
    """A feature cache of the right version; an absent or unreadable one is empty."""
    try:
        cache = Snapshots(spark, path, ["file_key"]).read()
        if cache is not None:
            return cache.where(c("version") == version)
        # reading is lazy: files that turn out unreadable count as empty too
        return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path).where(c("version") == version)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def tag_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``(tag, category)`` of a vocabulary file: header, then name in the second and category in the third column."""
    rows = spark.read.csv(path, header=True)
    return rows.select(c(rows.columns[1]).alias("tag"), c(rows.columns[2]).cast("int").alias("category"))


def saved_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def job_payload(spark: SparkSession, text: str) -> DataFrame:
    """The rows of a JSON job list; an empty list has no columns but ``name``."""
    rows = json.loads(text)
    return spark.createDataFrame(rows) if rows else spark.createDataFrame([], "name string")


def with_defaults(config: dict, defaults: dict) -> dict:
    return {**defaults, **config}


# --- decoders ------------------------------------------------------------------------------------


def decode_wave(raw: bytes) -> tuple[list[float], int] | None:
    """Mono samples from -1 to 1 and the rate of a PCM file; None for what can't be read."""
    try:
        with wave.open(io.BytesIO(raw)) as f:
            width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
            data = f.readframes(f.getnframes())
    except (wave.Error, EOFError, struct.error):
        return None
    if width not in (1, 2, 4) or not channels:
        return None
    data = data[: len(data) // (width * channels) * width * channels]  # a file cut short ends with whole frames
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    else:
        x = np.frombuffer(data, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(1).tolist(), rate


def png_chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and body of each chunk; none for what is no PNG. A chunk cut short ends the walk."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        return
    at = 8
    while at + 12 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        if at + 12 + size > len(raw):
            return
        yield kind, raw[at + 8 : at + 8 + size]
        at += 12 + size


def _unfilter(flat: np.ndarray, step: int) -> np.ndarray:
    """Undo the row filters of a PNG; ``step`` is a pixel's bytes."""
    out = np.zeros((len(flat), flat.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.int32)
    for y, row in enumerate(flat):
        kind, line = int(row[0]), row[1:].astype(np.int32)
        if kind == 1:
            line = np.cumsum(line.reshape(-1, step), 0).ravel() & 255
        elif kind == 2:
            line = (line + above) & 255
        elif kind:
            rows, up = line.reshape(-1, step), above.reshape(-1, step)
            left, corner = np.zeros(step, np.int32), np.zeros(step, np.int32)
            for x in range(len(rows)):  # all channels of a pixel at once
                if kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    p = left + up[x] - corner
                    near = np.abs(np.stack([p - left, p - up[x], p - corner])).argmin(0)
                    guess = np.choose(near, [left, up[x], corner])
                left = rows[x] = (rows[x] + guess) & 255
                corner = up[x]
            line = rows.ravel()
        out[y] = above = line
    return out


def decode_png(raw: bytes) -> np.ndarray | None:
    """Pixels (height, width, channels) of a PNG that is not interlaced, of any depth, in 8 bits; None for anything else."""
    data, head, palette = b"", None, None
    for kind, body in png_chunks(raw):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(head[3]) if head else None
    if not channels or head[6] or head[3] == 3 and palette is None:
        return None
    width, height, depth = head[0], head[1], head[2]
    try:
        flat = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, -(-width * channels * depth // 8) + 1)
    except (zlib.error, ValueError):
        return None
    rows = _unfilter(flat, max(1, channels * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        rows = np.unpackbits(rows, axis=1).reshape(height, -1, depth) @ (1 << np.arange(depth)[::-1])
        rows = rows[:, : width * channels].astype(np.uint8)
        if palette is None:
            rows = rows * (255 // ((1 << depth) - 1))
    if palette is not None:
        return palette[np.minimum(rows, len(palette) - 1)].reshape(height, width, 3)
    return rows.reshape(height, width, channels).astype(np.uint8)


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of (height, width) or (height, width, 1 to 4) 8-bit values, without row filters."""
    p = pixels if pixels.ndim == 3 else pixels[:, :, None]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", p.shape[1], p.shape[0], 8, {1: 0, 2: 4, 3: 2, 4: 6}[p.shape[2]], 0, 0, 0)
    flat = np.concatenate([np.zeros((p.shape[0], 1), np.uint8), p.reshape(p.shape[0], -1)], 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(flat.tobytes(), 6)) + chunk(b"IEND", b"")


#: EXIF tags that are read, PNG text keys that are kept, bytes of a value that are kept.
EXIF_TAGS, TEXT_KEYS, VALUE_CHARS = (305, 270, 33432), ("parameters", "prompt", "workflow", "comment", "software", "description"), 200


def exif_values(tiff: bytes) -> dict[int, str]:
    """Text values of the tags ``EXIF_TAGS`` in the first directory of a TIFF block."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order or len(tiff) < 8:
        return {}
    found = {}
    try:
        at = struct.unpack(order + "I", tiff[4:8])[0]
        for i in range(struct.unpack(order + "H", tiff[at : at + 2])[0]):
            tag, kind, n = struct.unpack(order + "HHI", tiff[at + 2 + 12 * i : at + 10 + 12 * i])
            if tag in EXIF_TAGS and kind == 2:
                place = at + 10 + 12 * i if n <= 4 else struct.unpack(order + "I", tiff[at + 10 + 12 * i : at + 14 + 12 * i])[0]
                found[tag] = tiff[place : place + n].split(b"\0")[0].decode("utf-8", "replace")
    except struct.error:
        return found
    return found


def image_metadata(raw: bytes) -> dict[str, str]:
    """EXIF values (``exif_<tag>``) and PNG text (``png_<key>``), cut to 200 characters; ``software`` and ``marker`` too.

    ``marker`` names a text chunk that speaks of a generator. Empty without any.
    """
    exif, texts = {}, []
    for kind, body in png_chunks(raw):
        try:
            if kind == b"eXIf":
                exif = exif_values(body)
            elif kind == b"tEXt":
                key, _, value = body.partition(b"\0")
                texts.append((key.decode("latin-1"), value.decode("latin-1")))
            elif kind == b"zTXt":
                key, _, value = body.partition(b"\0")
                texts.append((key.decode("latin-1"), zlib.decompress(value[1:]).decode("latin-1")))
            elif kind == b"iTXt":
                key, _, rest = body.partition(b"\0")
                value = rest[2:].split(b"\0", 2)[2]
                texts.append((key.decode("latin-1"), (zlib.decompress(value) if rest[0] else value).decode("utf-8", "replace")))
        except (zlib.error, IndexError):
            continue
    at = 2
    while raw[:2] == b"\xff\xd8" and raw[at : at + 1] == b"\xff" and at + 4 <= len(raw) and raw[at + 1] != 0xDA:
        size = struct.unpack(">H", raw[at + 2 : at + 4])[0]
        if raw[at + 1] == 0xE1 and raw[at + 4 : at + 10] == b"Exif\0\0":
            exif = exif_values(raw[at + 10 : at + 2 + size])
        at += 2 + size
    out = {f"exif_{t}": v[:VALUE_CHARS] for t, v in exif.items() if v}
    for key, value in texts:
        if key.lower() in TEXT_KEYS:
            out[f"png_{key.lower()}"] = value[:VALUE_CHARS]
        if "stable" in value.lower() or "comfyui" in value.lower():
            out["marker"] = key
    if exif.get(305):
        out["software"] = exif[305].lower()[:VALUE_CHARS]
    return out


def c2pa_manifest(raw: bytes, kind: str) -> str | None:
    """The first 500 characters of a file's manifest, where the optional library can read it; else null."""
    try:
        import c2pa
    except ImportError:
        return None
    try:
        return c2pa.Reader(kind, io.BytesIO(raw)).json()[:500]
    except Exception:  # whatever a reader of foreign files raises
        return None


def with_metadata(files: DataFrame) -> DataFrame:
    """Adds ``metadata`` (map) and ``c2pa`` from ``content``; unreadable files have an empty map and null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws, exts = (b.column(b.schema.get_field_index(n)).to_pylist() for n in ("content", "ext"))
            maps = pa.array([list(image_metadata(r or b"").items()) for r in raws], pa.map_(pa.string(), pa.string()))
            marks = pa.array([c2pa_manifest(r or b"", f"image/{e}") for r, e in zip(raws, exts)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, maps, marks], [*b.schema.names, "metadata", "c2pa"])

    schema = ", ".join(f"`{n}` {t}" for n, t in files.dtypes) + ", metadata map<string,string>, c2pa string"
    return files.mapInArrow(run, schema)


def _mp3_frame(raw: bytes) -> tuple[int, int] | None:
    """Bits a second and sample rate of the first frame header of an MPEG layer-3 file."""
    at = 0
    if raw[:3] == b"ID3" and len(raw) >= 10:
        at = 10 + (raw[6] << 21 | raw[7] << 14 | raw[8] << 7 | raw[9])
    while at + 4 <= len(raw):
        head = struct.unpack(">I", raw[at : at + 4])[0]
        version, layer, rate, speed = head >> 19 & 3, head >> 17 & 3, head >> 12 & 15, head >> 10 & 3
        if head >> 21 == 0x7FF and version != 1 and layer == 1 and 0 < rate < 15 and speed < 3:
            # Kilobits a second by index, of MPEG 1 and of MPEG 2
            table = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320) if version == 3 else (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
            return table[rate - 1] * 1000, (44100, 48000, 32000)[speed] >> {3: 0, 2: 1, 0: 2}[version]
        at += 1
    return None


def audio_meta(raw: bytes) -> tuple[float | None, int | None]:
    """Seconds (one decimal) and sample rate from a file's headers: WAV, FLAC, Ogg, then MP3 by its first frame; else nulls."""
    try:
        if raw[:4] == b"RIFF":
            with wave.open(io.BytesIO(raw)) as f:
                return round(f.getnframes() / f.getframerate(), 1), f.getframerate()
        if raw[:4] == b"fLaC":
            bits = int.from_bytes(raw[18:26], "big")
            rate, samples = bits >> 44, bits & (1 << 36) - 1
            return round(samples / rate, 1), rate
        if raw[:4] == b"OggS":
            last = raw.rfind(b"OggS")
            samples = struct.unpack("<q", raw[last + 6 : last + 14])[0]
            vorbis = raw.find(b"\x01vorbis")
            rate = struct.unpack("<I", raw[vorbis + 12 : vorbis + 16])[0] if vorbis >= 0 else 48000  # Opus counts at 48 kHz
            return round(samples / rate, 1), rate
        frame = _mp3_frame(raw)
        if frame:
            return round(len(raw) * 8 / frame[0], 1), frame[1]
    except (wave.Error, EOFError, struct.error, ZeroDivisionError):
        pass
    return None, None


def mean_pitch(wave_: np.ndarray, rate: int, low: float = 50, high: float = 600, frame: int = 2048) -> float | None:
    """Mean fundamental frequency in Hz over voiced frames, one decimal; null without any.

    The period of a frame is the first deep dip of the cumulative mean normalised difference (de Cheveigne and
    Kawahara 2002), refined by a parabola; a frame whose dip stays above 0.15 is not voiced.
    """
    x = np.asarray(wave_, np.float64)
    least, most = int(rate / high), min(int(rate / low), frame // 2)
    found = []
    for a in range(0, len(x) - frame + 1, frame // 2):
        part = x[a : a + frame]
        if least < 1 or most <= least + 2 or not np.any(part):
            continue
        n = frame - most
        size = 1 << (2 * frame - 1).bit_length()
        cross = np.fft.irfft(np.fft.rfft(part, size) * np.conj(np.fft.rfft(part[:n], size)), size)[: most + 1]
        energy = np.concatenate([[0], np.cumsum(part * part)])
        diff = energy[n] + (energy[n + np.arange(most + 1)] - energy[np.arange(most + 1)]) - 2 * cross
        mean = diff[1:] * np.arange(1, most + 1) / np.maximum(np.cumsum(diff[1:]), 1e-12)
        dips = np.flatnonzero((mean[least:-1] < 0.15) & (mean[least:-1] <= mean[least - 1 : -2]) & (mean[least:-1] <= mean[least + 1 :]))
        if len(dips):
            i = int(dips[0]) + least
            l, m, r = mean[i - 1], mean[i], mean[i + 1]
            bend = l - 2 * m + r
            found.append(rate / (i + 1 + ((l - r) / (2 * bend) if bend else 0)))
    return round(float(np.mean(found)), 1) if found else None


def voice_measures(files: DataFrame) -> DataFrame:
    """Adds ``duration_s``, ``sample_rate`` and ``f0_mean_hz`` of ``content``; the pitch is null for what no decoder reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw in b.column(b.schema.get_field_index("content")).to_pylist():
                sound = decode_wave(raw or b"")
                rows.append((*audio_meta(raw or b""), mean_pitch(np.asarray(sound[0]), sound[1]) if sound else None))
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.float64(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "duration_s", "sample_rate", "f0_mean_hz"])

    schema = ", ".join(f"`{n}` {t}" for n, t in files.dtypes) + ", duration_s double, sample_rate int, f0_mean_hz double"
    return files.mapInArrow(run, schema)


def luma(pixels: np.ndarray) -> np.ndarray:
    """Grey values by the Rec. 601 weights."""
    if pixels.shape[2] < 3:
        return pixels[:, :, 0].astype(np.float64)
    return np.floor(pixels[:, :, :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114]) + 0.5)


def _lanczos(n: int, to: int) -> np.ndarray:
    scale = max(1.0, n / to)
    centre = (np.arange(to) + 0.5) * n / to
    x = (np.arange(n) + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)
    return w / w.sum(1, keepdims=True)


def resized(pixels: np.ndarray, w: int, h: int) -> np.ndarray:
    """Pixels (height, width, channels) brought to another size by Lanczos weights."""
    rows = np.tensordot(_lanczos(pixels.shape[0], h), pixels.astype(np.float64), (1, 0))
    both = np.tensordot(rows, _lanczos(pixels.shape[1], w), (1, 1)).transpose(0, 2, 1)
    return np.clip(np.floor(both + 0.5), 0, 255).astype(np.uint8)


def difference_hash(grey: np.ndarray) -> int:
    """64 bits, row by row: whether the right neighbour is brighter, in a 9 x 8 Lanczos reduction. Signed."""
    small = np.clip(np.floor(_lanczos(grey.shape[0], 8) @ grey @ _lanczos(grey.shape[1], 9).T + 0.5), 0, 255)
    bits = int("".join("1" if b else "0" for b in (small[:, 1:] > small[:, :-1]).ravel()), 2)
    return bits - (1 << 64) if bits >> 63 else bits


def pixel_stats(grey: np.ndarray) -> tuple[float, float, float]:
    """Sharpness (variance of the Laplacian, mirrored at the border), brightness and contrast."""
    p = np.pad(grey, 1, mode="reflect") if min(grey.shape) > 1 else np.pad(grey, 1, mode="edge")
    edge = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * grey
    return round(float(edge.var()), 1), round(float(grey.mean()), 1), round(float(grey.std()), 1)


_FEATURES = "width int, height int, phash long, sharp double, bright double, contrast double, error string"
_FEATURE_KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string())
_FEATURE_NAMES = ("width", "height", "phash", "sharp", "bright", "contrast", "error")


def _measure(pixels: np.ndarray | None, error: str) -> tuple:
    if pixels is None:
        return (None,) * 6 + (error,)
    grey = luma(pixels)
    return pixels.shape[1], pixels.shape[0], difference_hash(grey), *pixel_stats(grey), None


def image_features(files: DataFrame) -> DataFrame:
    """Adds width, height, phash and pixel statistics of ``content``; what can't be read has an ``error`` and nulls.

    PNG is decoded here; ``no decoder`` marks other formats (``folder_features`` reads JPEG), ``unreadable`` broken files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [r or b"" for r in b.column(b.schema.get_field_index("content")).to_pylist()]
            rows = [_measure(decode_png(r), "no decoder" if r[:2] == b"\xff\xd8" or r[:4] == b"RIFF" else "unreadable") for r in raws]
            keep = [i for i, n in enumerate(b.schema.names) if n != "content"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(_FEATURE_KINDS))], [*(b.schema.names[i] for i in keep), *_FEATURE_NAMES])

    kept = files.drop("content")
    schema = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes) + ", " + _FEATURES
    return files.select(*kept.columns, "content").mapInArrow(run, schema)


def folder_features(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, ...)`` as ``image_features`` gives, decoded in the JVM by Spark's image source: JPEG, PNG, GIF and BMP.

    Files it can't decode stay, with the error ``unreadable``.
    """
    rows = spark.read.format("image").option("dropInvalid", "false").load(folder).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, h, w, n, data in zip(*(b.column(i).to_pylist() for i in range(5))):
                pixels = None
                if h > 0 and w > 0:
                    pixels = np.frombuffer(data, np.uint8).reshape(h, w, n)
                    pixels = pixels[:, :, [2, 1, 0, *range(3, n)]] if n >= 3 else pixels  # stored blue first
                out.append(_measure(pixels, "unreadable"))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate(_FEATURE_KINDS))], ["path", *_FEATURE_NAMES])

    return rows.mapInArrow(run, "path string, " + _FEATURES)


def normalise_mask(mask: np.ndarray, threshold: float | None = None) -> np.ndarray:
    """A mask stretched to 0..255; with a threshold, only 0 and 255."""
    low, high = float(mask.min()), float(mask.max())
    out = np.zeros(mask.shape, np.uint8) if high <= low else ((mask - low) / (high - low) * 255).astype(np.uint8)
    return out if threshold is None else np.where(out >= int(threshold * 255), 255, 0).astype(np.uint8)
