"""Progress streams with state: running estimates, silence alarms, latest verdicts and incremental analysis.

State lives in a checkpoint folder and results in a keyed table beside it (``quarry.sources.snapshots``), both below a
root that the caller names, so that a program can stop after any batch and go on in another call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.sources.scratch import delete
from quarry.sources.snapshots import Snapshots, exists
from quarry.streaming.progress import _pace

c = F.col
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Minutes without an event that are a silence.
SILENCE = 30


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that keyed processors need, for queries started inside; the session's own comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def run_to_end(stream: DataFrame, root: str, sink: Callable[[DataFrame, int], None], mode: str = "append", name: str = "state") -> int:
    """Runs a stream over all that its source has now; returns the rows read. What a batch gives goes to ``sink(rows, batch)``."""
    with keyed_state(stream.sparkSession):
        query = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{root}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


class _Counter(StatefulProcessor):
    """Numbers a run's events as they come; the state is how many there were and the first time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long, first long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        n, first = self.seen.get() if self.seen.exists() else (0, None)
        batch = pd.concat(list(rows)).sort_values(["us", "id"], kind="stable")
        first = int(batch["us"].iloc[0]) if first is None else min(first, int(batch["us"].iloc[0]))
        out = pd.DataFrame({"id": batch["id"].to_numpy(), "done": n + np.arange(1, len(batch) + 1), "total": batch["total"].to_numpy(), "elapsed": (batch["us"].to_numpy() - first) // 1_000_000})
        self.seen.update((n + len(batch), first))
        yield out

    def close(self) -> None: ...


def eta_stream(events: DataFrame, totals: DataFrame, run: str, ts: str, order: str) -> DataFrame:
    """``progress_eta`` as a stream: each event is numbered when it comes, in the order of its batch.

    ``totals`` (run, total) is a table of how many events each run announces. Batches come in the order of time; a
    task holds one run's events of one batch. Runs without total, and events without run or time, take no part.
    """
    rows = events.where(c(run).isNotNull() & c(ts).isNotNull()).select(c(run).alias("run"), F.unix_micros(c(ts).cast("timestamp")).alias("us"), c(order).alias("id"))
    known = rows.join(totals.select(c(run).alias("run"), "total"), "run")
    kind = known.schema["id"].dataType.simpleString()
    counted = known.groupBy("run").transformWithStateInPandas(_Counter(), f"id {kind}, done long, total long, elapsed long", "Append", "None")
    return _pace(counted.withColumnRenamed("id", order), order)


def silence_stream(events: DataFrame, run: str, ts: str, minutes: int = SILENCE, late: str = "10 minutes") -> DataFrame:
    """``(run, last_ts, silent_at)``: one row for each time that a run gives no event for ``minutes``.

    A silence is told when the watermark, ``late`` behind the latest event of all runs, has passed its end: rows that
    come before that in any order count. Later ones are dropped, unless ``minutes`` after them are still to come: such
    a row counts, though a silence that was told before it stays told. The last silence of a run that has ended is told
    like others as other runs go on. Runs are sessions parted by silences, of which the state keeps only the ends.
    """
    rows = events.where(c(run).isNotNull()).select(c(run).alias("run"), c(ts).cast("timestamp").alias("ts")).withWatermark("ts", late)
    found = rows.groupBy("run", F.session_window("ts", f"{minutes} minutes")).agg(F.max("ts").alias("last_ts"))
    return found.select(c("run").alias(run), "last_ts", (c("last_ts") + F.make_dt_interval(mins=F.lit(minutes))).alias("silent_at"))


def latest_sink(table: Snapshots, run: str, ts: str, columns: list[str], stream: str = "latest") -> Callable[[DataFrame, int], None]:
    """A sink that keeps the last event of each run in ``table``; a batch that comes again changes nothing."""

    def sink(rows: DataFrame, batch: int) -> None:
        table.commit(rows.select(run, *columns, ts), stream, batch)

    return sink


def latest_table(spark: SparkSession, root: str, run: str, ts: str, columns: list[str]) -> Snapshots:
    """The table of ``latest_sink``: of a run's events the one with the greatest time and then ``columns`` counts."""
    return Snapshots(spark, f"{root}/latest", [run], [ts, *columns])


class Incremental:
    """Analysis of a growing set of files: each version of a file is read once, however often it is called for.

    ``scan`` lists what is there now as ``(key, file_key, ...)``; ``file_key`` changes with the file. Files whose
    version the table has not seen go to an inbox, which a stream reads ``batch_rows`` at a time; each batch is analysed
    and laid over the table by its number. A program that dies goes on with the batch it was in.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, analyse: Callable[[DataFrame], DataFrame], batch_rows: int = 10_000):
        """``analyse`` takes rows of the scan and keeps ``key`` and ``file_key`` in what it returns, a row each."""
        self.spark, self.root, self.key, self.analyse, self.batch_rows = spark, root.rstrip("/"), key, analyse, batch_rows
        self.table = Snapshots(spark, f"{self.root}/analysis", [key])

    def _drain(self, schema) -> int:
        """Analyses what is in the inbox, and empties it; returns the files that were in it."""
        inbox = f"{self.root}/inbox"
        if not exists(self.spark, inbox):
            return 0
        held = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(inbox)
        waiting, parts = held.count(), len(held.inputFiles())
        each = max(1, parts // max(1, -(-waiting // self.batch_rows)))  # so many of its parts make a batch
        source = self.spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", each)

        def sink(rows: DataFrame, batch: int) -> None:
            self.table.commit(self.analyse(rows), "inbox", batch)

        if waiting:
            run_to_end(source.parquet(inbox), self.root, sink)
        delete(self.spark, inbox)
        return waiting

    def run(self, scan: DataFrame) -> tuple[DataFrame, int]:
        """What the table has of the files in ``scan``, and how many files this call read. Files that are gone drop out."""
        read = self._drain(scan.schema)  # of a call that did not end
        known = self.table.read()
        new = scan if known is None else scan.join(known.select(self.key, "file_key"), [self.key, "file_key"], "left_anti")
        new.write.mode("overwrite").option("maxRecordsPerFile", self.batch_rows).parquet(f"{self.root}/inbox/after={self.table.version:012d}")
        read += self._drain(scan.schema)
        known = self.table.read()
        if known is None:
            return self.analyse(scan.limit(0)), read
        return known.join(scan.select(self.key, "file_key"), [self.key, "file_key"], "left_semi"), read
