"""Queries that run streams over the tables: in several calls on one checkpoint, as a program that is started again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.event_queries import table
from quarry.plans.registry import ORACLES, query
from quarry.sources.scratch import scratch_root
from quarry.sources.snapshots import Snapshots
from quarry.streaming import stateful

c = F.col
#: Calls in which the queries feed their streams.
CALLS = 3


def calls(events: DataFrame, ts: str, folder: str, n: int = CALLS):
    """Writes the next part of ``events`` by time to ``folder``, ``n`` times: for each call that reads it."""
    us = F.unix_micros(c(ts).cast("timestamp"))
    cuts = events.select(us.alias("us")).approxQuantile("us", [k / n for k in range(1, n)], 0.01)
    part = sum((F.when(us > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    for k in range(n):
        events.where(part == k).write.parquet(f"{folder}/call={k}")
        yield k


def _stream(spark, events: DataFrame, folder: str) -> DataFrame:
    return spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(folder)


def _fed(spark, sf, name: str, build, sink=None) -> tuple[str, Snapshots]:
    """Runs the stream that ``build`` makes of the events in several calls; its rows are kept by batch."""
    events = table(spark, sf, "events")
    root = scratch_root(spark, name)
    out = Snapshots(spark, f"{root}/out", ["_batch", "_row"])

    def keep(rows: DataFrame, batch: int) -> None:
        out.commit(rows.withColumns({"_batch": F.lit(batch), "_row": F.monotonically_increasing_id()}), name, batch)

    for _ in calls(events, "ts", f"{root}/events"):
        stateful.run_to_end(build(_stream(spark, events, f"{root}/events")), root, sink(root) if sink else keep)
    return root, out


@query("q104_incremental_rerun", """SELECT d.doc_id, length(d.text) AS n_chars, CASE WHEN l.quality = 1 THEN 1 ELSE 2 END AS call, CASE WHEN l.quality = 0 THEN 2 ELSE 1 END AS readings,
 (SELECT count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) AS read_1, (SELECT count(*) FROM documents) - (SELECT count(*) FROM labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM documents)) AS read_2, 0::BIGINT AS read_3
 FROM documents d LEFT JOIN labels l USING (doc_id)""")
def incremental_rerun(spark, sf):
    """Three calls over the documents: the labelled ones, those of quality 0 as an older version; then all; then all again."""
    docs, labels = table(spark, sf, "documents").select("doc_id", "text", "n_chars"), table(spark, sf, "labels").select("doc_id", "quality")
    key = lambda n: F.concat_ws("|", "doc_id", n.cast("string"))
    first = docs.join(labels, "doc_id").withColumn("file_key", key(c("n_chars") - (c("quality") == 0).cast("long"))).drop("quality")
    second = docs.withColumn("file_key", key(c("n_chars")))
    lengths = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"))  # a batch fetches what it needs; texts are not shuffled
    root, read = scratch_root(spark, "incremental"), []
    for number, scan in ((1, first), (2, second), (3, second)):

        def analyse(rows, number=number):
            return rows.join(lengths, "doc_id").select("doc_id", "file_key", "n_chars", F.lit(number).alias("call"))

        rows, n = stateful.Incremental(spark, root, "doc_id", analyse, batch_rows=1_000_000).run(scan.select("doc_id", "file_key"))
        read.append(n)
    older = labels.where("quality = 0").select("doc_id").withColumn("older", F.lit(1))
    readings = rows.join(older, "doc_id", "left")
    return readings.select("doc_id", "n_chars", "call", (F.lit(1) + F.coalesce("older", F.lit(0))).alias("readings"), *(F.lit(n).cast("long").alias(f"read_{i}") for i, n in enumerate(read, 1)))


@query("q105_eta_stream", ORACLES["q52_progress_eta"])
def eta_stream(spark, sf):
    totals = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("total"))
    _, out = _fed(spark, sf, "eta", lambda events: stateful.eta_stream(events, totals, "user_id", "ts", "event_id"))
    return out.read().drop("_batch", "_row")


@query("q106_silence_alarms", """WITH g AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS later FROM (SELECT DISTINCT user_id, ts FROM events)), w AS (SELECT epoch_ms(max(ts)) - 600000 AS seen FROM events)
SELECT user_id, ts AS last_ts, ts + INTERVAL 30 MINUTE AS silent_at FROM g, w WHERE (later IS NULL OR later - ts >= INTERVAL 30 MINUTE) AND epoch_ms(ts) + 1800000 <= seen""")
def silence_alarms(spark, sf):
    _, out = _fed(spark, sf, "silence", lambda events: stateful.silence_stream(events, "user_id", "ts"))
    return out.read().select("user_id", *(c(t).cast("timestamp_ntz").alias(t) for t in ("last_ts", "silent_at")))


@query("q107_latest_table", ORACLES["q54_latest_event"])
def latest_table(spark, sf):
    made = lambda root: stateful.latest_table(spark, root, "user_id", "ts", ["event_id", "event_type"])
    root, _ = _fed(spark, sf, "latest", lambda events: events, lambda root: stateful.latest_sink(made(root), "user_id", "ts", ["event_id", "event_type"]))
    return made(root).read()
