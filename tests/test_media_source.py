"""The media source: listing, filters, shares by bytes, and a stream that sees changed files."""

import os
import time

import pytest

from quarry.sources import media as m
from quarry.streaming import stateful


def put(path, body, age=60.0):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body)
    os.utime(path, (time.time() - age,) * 2)


@pytest.fixture
def folder(tmp_path):
    for i, (name, body) in enumerate({"a.png": b"12", "b.JPG": b"", "c.txt": b"x", "deep/d.png": b"345", ".hidden/e.png": b"x", "_f.png": b"x", "noend": b"y"}.items()):
        put(tmp_path / name, body, 60 - i)
    return tmp_path


def test_listing_and_contents(spark, folder):
    rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    images = m.media(spark, str(folder), ("png", "jpg"), recursive=True, content=True)
    assert rows(images, "name", "ext", "length", "content") == [("a.png", "png", 2, b"12"), ("b.JPG", "jpg", 0, b""), ("d.png", "png", 3, b"345")]
    assert rows(m.media(spark, f"file://{folder}"), "name") == [("a.png",), ("b.JPG",), ("c.txt",), ("noend",)]
    (folder / "none").mkdir()
    assert m.media(spark, f"{folder}/none").count() == 0
    first = m.media(spark, str(folder)).where("name = 'a.png'").first()
    assert abs(first.modificationTime.timestamp() - os.path.getmtime(folder / "a.png")) < 0.001


def test_filters_on_the_ending_reach_the_listing(spark, folder):
    reader = m.FilteredReader({"path": str(folder), "recursive": "true", "endings": "png,jpg,txt"})
    left = list(reader.pushFilters([m.In(("ext",), ("png", "gif")), m.EqualTo(("name",), "a.png")]))
    assert left == [m.EqualTo(("name",), "a.png")] and reader.endings == {"png"}
    assert [[f[0].rsplit("/", 1)[-1] for f in s.files] for s in reader.partitions()] == [["a.png", "d.png"]]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = m.media(spark, str(folder)).where("ext = 'png'")
        assert [r.name for r in df.collect()] == ["a.png"]
        assert "= png" not in df._jdf.queryExecution().executedPlan().toString()  # nothing is left for Spark to filter
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_shares_are_even(spark):
    files = [(f"f{i}", 1000 if i % 10 else 1_000_000, 0) for i in range(200)]
    shares = m.dealt(files, 2_000_000 + m.FILE_BYTES * 10)
    sums = [sum(f[1] + m.FILE_BYTES for f in s.files) for s in shares]
    assert sorted(f for s in shares for f in s.files) == sorted(files) and len(shares) > 5 and max(sums) < 1.2 * sum(sums) / len(sums)
    assert m.dealt([], 10) == []


def test_a_stream_reads_changed_files_again(spark, tmp_path):
    src, seen = tmp_path / "in", []
    run = lambda: stateful.run_to_end(m.media(spark, str(src), ("png",), content=True, stream=True, settle=1), str(tmp_path), lambda b, _: seen.extend((r.name, bytes(r.content)) for r in b.collect()))
    put(src / "a.png", b"1", 50)
    put(src / "b.png", b"2", 40)
    run()
    assert sorted(seen) == [("a.png", b"1"), ("b.png", b"2")]
    seen.clear()
    run()
    assert seen == []
    put(src / "a.png", b"new", 30)
    put(src / "c.png", b"3", 20)
    (src / "fresh.png").write_bytes(b"still written to")
    os.utime(src / "fresh.png", (time.time() + 60,) * 2)
    run()
    assert sorted(seen) == [("a.png", b"new"), ("c.png", b"3")]
