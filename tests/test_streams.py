"""Streams with state and keyed tables: several calls on one checkpoint, replays, late rows, and a job that dies."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.sources.snapshots import Snapshots
from quarry.streaming import stateful
from quarry.streaming.progress import progress_eta

T0 = dt.datetime(2024, 5, 1)
SCHEMA = "run long, ts timestamp, id long"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def feed(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).parquet(folder)


def test_snapshots_change_as_a_whole(spark, tmp_path):
    t = Snapshots(spark, f"{tmp_path}/t", ["k"])
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    assert t.read() is None and t.version == 0
    assert t.commit(frame([(1, "a"), (2, "b"), (None, "n")]), "s", 0)
    held = t.read()
    assert not t.commit(frame([(1, "lost")]), "s", 0)  # the batch again
    assert t.commit(frame([(2, "c"), (3, "d")]), "s", 1)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(held) == [(1, "a"), (2, "b"), (None, "n")]  # readers keep their version
    assert rows(t.read()) == [(1, "a"), (2, "c"), (3, "d"), (None, "n")] and rows(t.read(1)) == rows(held)
    assert t.commit(t.read().where("k < 3").withColumn("v", F.upper("v")))  # from the table itself
    with pytest.raises(Exception):  # a task dies: the table stays as it was
        t.commit(frame([(9, "x")]).select("k", F.raise_error(F.lit("died")).alias("v")), "s", 2)
    assert t.done("s") == 1 and rows(t.read()) == [(1, "A"), (2, "C"), (3, "d"), (None, "n")]
    for i in range(12):
        t.commit(frame([(i, f"x{i}")]), "s", 2 + i)
    assert dict(rows(t.read()))[11] == "x11" and t.read().count() == 13
    parts = list((tmp_path / "t" / "parts").iterdir())
    assert len(parts) <= 12 and len(list((tmp_path / "t" / "manifests").glob("0*.json"))) == 3
    t.commit(frame([(5, "only")]), replace=True)
    assert rows(t.read()) == [(5, "only")]


def test_newest_row_counts(spark, tmp_path):
    t = Snapshots(spark, f"{tmp_path}/t", ["k"], ["at"])
    frame = lambda rows: spark.createDataFrame(rows, "k long, at long, v string")
    t.commit(frame([(1, 5, "b"), (1, 7, "c"), (2, 1, "x")]))
    t.commit(frame([(1, 6, "late"), (2, 1, "again")]))
    assert sorted(map(tuple, t.read().collect())) == [(1, 7, "c"), (2, 1, "again")]


def test_estimates_in_three_calls(spark, tmp_path):
    rows = [(i % 3, at(i * (1 + i % 3)), i) for i in range(40)]
    rows.sort(key=lambda r: r[1])
    every = spark.createDataFrame(rows, SCHEMA)
    totals, out = every.groupBy("run").agg(F.count("*").alias("total")), []
    for part in (rows[:10], rows[10:11], rows[11:]):
        feed(spark, f"{tmp_path}/in", part)
        n = stateful.run_to_end(stateful.eta_stream(stream(spark, f"{tmp_path}/in"), totals, "run", "ts", "id"), str(tmp_path), lambda b, _: out.extend(map(tuple, b.collect())))
        assert n == len(part)
    assert sorted(out) == sorted(map(tuple, progress_eta(every, "run", "ts", "id").collect()))


def test_one_alarm_for_each_silence(spark, tmp_path):
    """Rows out of order within the watermark fill a gap; the last silence of a run is told as others go on."""
    calls = [
        [(1, at(0), 0), (1, at(5), 1), (2, at(0), 2), (2, at(40), 3)],  # watermark 30
        [(1, at(33), 4), (2, at(45), 5), (1, at(60), 6)],  # run 1 is silent from 5 to 33 only
        [(2, at(52), 7), (2, at(48), 12), (3, at(200), 8)],  # 48 is before the watermark; all before 190 is settled now
        [(3, at(205), 9), (1, at(61), 10), (3, at(300), 11)],  # one that is too late
    ]
    found = []
    for rows in calls:
        feed(spark, f"{tmp_path}/in", rows)
        stateful.run_to_end(stateful.silence_stream(stream(spark, f"{tmp_path}/in"), "run", "ts"), str(tmp_path), lambda b, _: found.extend(map(tuple, b.select("run", F.unix_micros("last_ts"), F.unix_micros("silent_at")).collect())))
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    told = sorted((r, (a // 1_000_000 - base) // 60, (b - a) // 60_000_000) for r, a, b in found)
    assert told == [(1, 60, 30), (2, 0, 30), (2, 52, 30), (3, 205, 30)]


def test_silences_of_many_runs_need_no_python(spark, tmp_path):
    """A run with state in Python costs several calls of a worker in each batch; sessions run in the engine."""
    feed(spark, f"{tmp_path}/in", [(r, at(r % 7), r) for r in range(500)] + [(-1, at(500), 500)])
    found, plans = [], []

    def sink(b, _):
        plans.append(b._jdf.queryExecution().toString())
        found.extend(map(tuple, b.select("run", "last_ts", "silent_at").collect()))

    stateful.run_to_end(stateful.silence_stream(stream(spark, f"{tmp_path}/in"), "run", "ts"), str(tmp_path), sink)
    assert sorted(found) == [(r, at(r % 7), at(r % 7 + 30)) for r in range(500)] and plans and not any("Python" in p or "Pandas" in p for p in plans)


def test_latest_table_and_replay(spark, tmp_path):
    columns, rows = ["id"], [(i % 4, at((i * 7) % 50), i) for i in range(60)]
    t = stateful.latest_table(spark, str(tmp_path), "run", "ts", columns)
    sink = stateful.latest_sink(t, "run", "ts", columns)
    for a in (0, 20, 40):
        feed(spark, f"{tmp_path}/in", rows[a : a + 20])
        stateful.run_to_end(stream(spark, f"{tmp_path}/in"), str(tmp_path), sink)
        best = {}
        for r, ts, i in rows[: a + 20]:
            best[r] = max(best.get(r, (ts, i)), (ts, i))
        assert {r.run: (r.ts, r.id) for r in t.read().collect()} == best
    version = t.version
    sink(spark.createDataFrame([(0, at(999), 999)], SCHEMA), 2)  # the last batch comes again, as after a crash
    assert t.version == version and t.read().where("id = 999").isEmpty()


def test_each_version_of_a_file_is_read_once(spark, tmp_path):
    seen = []

    def analyse(rows):
        seen.extend(r.path for r in rows.collect())
        return rows.select("path", "file_key", F.length("path").alias("n"))

    def scan(*files):
        return spark.createDataFrame([(p, f"{p}|{m}") for p, m in files], "path string, file_key string")

    job = lambda: stateful.Incremental(spark, str(tmp_path), "path", analyse, batch_rows=2)
    first = [("a", 1), ("bb", 1), ("ccc", 1), ("dddd", 1), ("e", 1)]
    rows, read = job().run(scan(*first))
    assert read == 5 and sorted(seen) == ["a", "bb", "ccc", "dddd", "e"] and rows.count() == 5
    seen.clear()
    assert job().run(scan(*first))[1] == 0 and seen == []  # another program: nothing to read
    rows, read = job().run(scan(("a", 2), *first[1:4], ("new", 1)))
    assert sorted(seen) == ["a", "new"] and {(r.path, r.file_key) for r in rows.collect()} == {("a", "a|2"), ("bb", "bb|1"), ("ccc", "ccc|1"), ("dddd", "dddd|1"), ("new", "new|1")}


def test_a_batch_that_dies_is_read_again(spark, tmp_path):
    broken = [True]

    def analyse(rows):
        if broken:
            raise RuntimeError("died")
        return rows.select("path", "file_key")

    scan = spark.createDataFrame([("a", "a|1"), ("b", "b|1")], "path string, file_key string")
    job = lambda: stateful.Incremental(spark, str(tmp_path), "path", analyse)
    with pytest.raises(Exception, match="died"):
        job().run(scan)
    broken.clear()
    rows, read = job().run(scan)
    assert rows.count() == 2 and job().run(scan)[1] == 0


def test_counts_go_on_from_a_root(spark, tmp_path):
    from quarry.streaming.progress import available_now

    counts = lambda: {r.run: r.n for r in available_now(spark, f"{tmp_path}/in", "run", f"{tmp_path}/root").collect()}
    feed(spark, f"{tmp_path}/in", [(1, at(0), 0), (2, at(1), 1)])
    assert counts() == counts() == {1: 1, 2: 1}
    feed(spark, f"{tmp_path}/in", [(1, at(2), 2)])
    assert counts() == {1: 2, 2: 1} and len(list((tmp_path / "root" / "out").glob("batch=*"))) == 2
