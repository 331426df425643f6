"""Keyed tables that commits change as a whole: a stream's results outlive the call, and a replayed batch changes nothing.

A table is a folder of data parts and manifests. A commit writes its rows as a part that nobody reads yet, and then the
next manifest, which names all parts that count and the last batch of each stream; the newest manifest is the table.
A job that dies before that leaves the table as it was, and readers keep the version they began with. One writer at a
time. Parts are merged on reading, and by a commit once there are many.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.scratch import delete

#: Parts from which a commit merges them into one.
PARTS = 8
#: Manifests, and the parts that only they name, which stay for readers that began before.
KEPT = 3


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


class Snapshots:
    """The table below ``root`` with one row for each ``key``.

    Of the rows of a key the one with the greatest ``newest`` columns counts, of equals - or without ``newest`` - that of
    the last commit; a commit's own rows are reduced in the same way. Null keys are keys.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str], newest: list[str] | None = None):
        self.spark, self.root, self.key, self.newest = spark, root.rstrip("/"), key, newest or []

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[int]:
        fs, path = self._path("manifests")
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit())

    def _manifest(self, version: int | None = None) -> dict:
        versions = self._versions()
        if not versions:
            return {"version": 0, "parts": [], "batches": {}}
        fs, path = self._path(f"manifests/{version or versions[-1]:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """The manifest appears under its name as a whole or not at all."""
        name = f"{manifest['version']:012d}.json"
        fs, draft = self._path(f"manifests/.{name}.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(draft, self._path(f"manifests/{name}")[1]):
            raise OSError(f"another writer has published {name}")

    @property
    def version(self) -> int:
        return self._manifest()["version"]

    def done(self, stream: str) -> int:
        """The last batch of a stream that the table has; -1 for none."""
        return self._manifest()["batches"].get(stream, -1)

    def _merged(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        whole = F.max_by(F.struct(*columns), F.struct(*self.newest, "_commit"))
        return rows.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(self.key))).agg(whole.alias("_row")).select(*(F.col("_row")[c].alias(c) for c in columns))

    def _union(self, parts: list[dict]) -> DataFrame:
        out = None
        for p in parts:
            rows = self.spark.read.schema(p["schema"]).parquet(f"{self.root}/{p['path']}").withColumn("_commit", F.lit(p["commit"]))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as it is now, or as of a version; None before the first commit."""
        parts = self._manifest(version)["parts"]
        if not parts:
            return None
        rows = self._union(parts)
        columns = [c for c in rows.columns if c != "_commit"]
        return rows.select(*columns) if len(parts) == 1 else self._merged(rows, columns)

    def _write(self, rows: DataFrame, commit: int) -> dict:
        path = f"parts/{commit:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{path}")
        return {"path": path, "commit": commit, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)}

    def commit(self, rows: DataFrame, stream: str | None = None, batch: int = 0, replace: bool = False) -> bool:
        """Lays ``rows`` over the table, or puts them in its place; False, and nothing done, if it has the stream's batch already.

        ``rows`` may come from the table itself: it changes only when they are written.
        """
        before = self._manifest()
        if stream is not None and before["batches"].get(stream, -1) >= batch:
            return False
        number = before["version"] + 1
        own = self._merged(rows.withColumn("_commit", F.lit(number)), rows.columns)
        parts = ([] if replace else before["parts"]) + [self._write(own, number)]
        if len(parts) >= PARTS:
            every = self._union(parts)
            parts = [self._write(self._merged(every, [c for c in every.columns if c != "_commit"]), number)]
        self._publish({"version": number, "parts": parts, "batches": before["batches"] | ({stream: batch} if stream is not None else {})})
        self._forget(number)
        return True

    def _forget(self, number: int) -> None:
        """Deletes manifests before the last few, and the parts no other names."""
        versions = self._versions()
        old, kept = versions[:-KEPT], versions[-KEPT:]
        named = {p["path"] for v in kept for p in self._manifest(v)["parts"]}
        for v in old:
            for p in self._manifest(v)["parts"]:
                if p["path"] not in named:
                    delete(self.spark, f"{self.root}/{p['path']}")
            delete(self.spark, f"{self.root}/manifests/{v:012d}.json")
