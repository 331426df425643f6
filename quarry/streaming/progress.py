"""Progress streams: line protocol, running estimates, inactivity, latest state and incremental runs.

Each function takes a batch or a streaming DataFrame where its operators allow both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from quarry.operators import prefix
from quarry.sources.scratch import scratch_root

c = F.col
SILENCE = "30 minutes"


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``kind, done, total, detail`` of protocol lines; lines of no known kind go."""
    kind = F.regexp_extract(c(line), r"^(TOTAL|PROGRESS_DONE|PROGRESS|STEP|IMGINFO|PREVIEW)\b", 1)
    number = lambda i: F.nullif(F.regexp_extract(c(line), r"^(?:PROGRESS (\d+)/(\d+)|TOTAL (\d+))", i), F.lit("")).cast("long")
    detail = F.trim(F.regexp_replace(c(line), r"^(PROGRESS \d+/\d+|\w+)", ""))
    return lines.withColumns({"kind": kind, "done": number(1), "total": F.coalesce(number(2), number(3)), "detail": detail}).where("kind <> ''")


def _pace(rows: DataFrame, order: str) -> DataFrame:
    """``(order, done, percent, eta_s)`` from ``done``, ``total`` and whole seconds ``elapsed``."""
    pace = c("done") / c("elapsed").cast("double")
    eta = F.when(c("elapsed") > 0, F.floor((c("total") - c("done")) / pace + F.lit(0.5)).cast("long"))
    return rows.select(order, "done", (F.floor(c("done") * 1000 / c("total") + F.lit(0.5)) / F.lit(10.0)).alias("percent"), eta.alias("eta_s"))


def progress_eta(events: DataFrame, run: str, ts: str, order: str) -> DataFrame:
    """``(event, done, percent, eta_s)`` of each event of a run by its pace so far; whole seconds.

    Events are counted by ranges and sums over ranges, so that a run of any length is spread over tasks.
    """
    counted = prefix.running_count(events.select(run, ts, order), run, [ts, order], "done", total="total")
    first = events.groupBy(c(run).alias("_run")).agg(F.min(F.unix_micros(c(ts).cast("timestamp"))).alias("_first"))
    elapsed = F.floor((F.unix_micros(c(ts).cast("timestamp")) - c("_first")) / 1_000_000)
    return _pace(counted.join(first, c(run).eqNullSafe(c("_run"))).withColumn("elapsed", elapsed), order)


def inactivity_sessions(events: DataFrame, run: str, ts: str, gap: str = SILENCE) -> DataFrame:
    """``(run, first_ts, last_ts, n)``: stretches of activity that a silence of ``gap`` ends."""
    s = events.groupBy(run, F.session_window(ts, gap)).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))
    return s.drop("session_window")


def latest_events(events: DataFrame, run: str, ts: str, columns: list[str]) -> DataFrame:
    """The last event of each run; the greatest values of ``columns`` at equal times."""
    last = F.max(F.struct(ts, *columns)).alias("e")
    return events.groupBy(run).agg(last).select(run, *(c(f"e.{n}") for n in (*columns, ts)))


class Progress(StreamingQueryListener):
    """Calls ``callback(done, total, name)`` after each micro-batch of a named stream with the rows read so far."""

    def __init__(self, callback, total: int, name: str | None = None):
        self.callback, self.total, self.name, self.done = callback, total, name, 0

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        if self.name in (None, event.progress.name):
            self.done += event.progress.numInputRows
            self.callback(min(self.done, self.total), self.total, event.progress.name)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def available_now(spark: SparkSession, path: str, key: str, root: str | None = None) -> DataFrame:
    """Counts by ``key`` from a file stream run to the end of what is there; state and output are in shared tables.

    With a ``root`` they stay there, and a later call reads only what is new; a batch that comes again replaces its counts.
    """
    root = root or scratch_root(spark)
    folder, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 10).option("recursiveFileLookup", "true")
    stream = source.parquet(path) if spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(path)).isDirectory() else source.option("pathGlobFilter", name).parquet(folder)

    def sink(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    run = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy(key).agg(F.sum("n").alias("n"))
