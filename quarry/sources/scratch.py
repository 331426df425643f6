"""Tables between the steps of iterative operators, in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LIVE: list[tuple[SparkSession, str]] = []
#: The folders of local sessions without a shared one, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; in a local session without it, a folder of our own.

    On a cluster the setting must be there, as a folder of one machine would lose what other machines write.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    given = sc._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="quarry-")
    return _OWN[sc.applicationId]


def scratch_root(spark: SparkSession, name: str = "quarry") -> str:
    """A new folder below the shared one, deleted by ``clear_scratch`` or when the driver's program ends."""
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _LIVE.append((spark, root))
    return root


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch() -> None:
    """Delete all tables between steps; results not yet written or collected can't be read after it."""
    while _LIVE:
        try:
            delete(*_LIVE.pop())
        except Exception:  # the session has ended
            continue


atexit.register(clear_scratch)


def settle(df: DataFrame, root: str, name: str) -> DataFrame:
    """Write a step's rows and read them back: computed once, lineage cut, safe from lost executors."""
    df.write.mode("overwrite").parquet(f"{root}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}")
