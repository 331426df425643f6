"""Files that appear together: tasks stage what they write, one commit publishes it and counts.

For trainers and viewers that expect plain files. The folder must be on a store that all executors and the driver mount.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Where a run's counters stay, below its folder.
RUNS = "_runs"


@dataclass
class Staged(WriterCommitMessage):
    """What one task has ready: its folder, which holds the list of its files, and how many it could not make."""

    folder: str
    errors: int


def _inside(path: str | None) -> bool:
    """Whether a path stays below the folder, and out of what the writer keeps there."""
    parts = (path or "").split("/")
    return bool(path) and not os.path.isabs(path) and ".." not in parts and parts[0] != RUNS and not parts[0].startswith(".staging-")


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, run: str, keep: bool):
        self.folder, self.run, self.keep = folder, run, keep

    @property
    def staging(self) -> str:
        return f"{self.folder}/.staging-{self.run}"

    def write(self, batches: Iterator) -> Staged:
        """Each attempt has a folder of its own, so that a task that runs twice never shares a file with itself."""
        home = f"{self.staging}/{uuid.uuid4().hex}"
        os.makedirs(home, exist_ok=True)
        names, errors = [], 0
        with open(f"{home}/names", "w", encoding="utf-8") as listed:
            for b in batches:
                for path, body in zip(b.column("path").to_pylist(), b.column("body").to_pylist()):
                    if body is None or not _inside(path):
                        errors += 1
                        continue
                    with open(f"{home}/{len(names)}", "wb") as f:
                        f.write(body)
                    names.append(path)
                    listed.write(json.dumps(path) + "\n")
        return Staged(home, errors)

    def commit(self, messages: list) -> None:
        """Moves every staged file to its name, and then writes the counters. Of a path that comes twice one file stays."""
        n = {"written": 0, "kept": 0, "errors": 0}
        for m in messages:
            n["errors"] += m.errors
            with open(f"{m.folder}/names", encoding="utf-8") as listed:
                for i, line in enumerate(listed):
                    target = f"{self.folder}/{json.loads(line)}"
                    if self.keep and os.path.exists(target):
                        n["kept"] += 1
                        continue
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    os.replace(f"{m.folder}/{i}", target)
                    n["written"] += 1
        os.makedirs(f"{self.folder}/{RUNS}", exist_ok=True)
        draft = f"{self.staging}/counters"
        with open(draft, "w", encoding="utf-8") as f:
            json.dump(n, f)
        os.replace(draft, f"{self.folder}/{RUNS}/{self.run}.json")
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class Files(DataSource):
    """Sink ``quarry_files``: rows ``(path, body binary)``; options ``folder``, ``run`` and ``keep``."""

    @classmethod
    def name(cls) -> str:
        return "quarry_files"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["folder"], self.options["run"], self.options.get("keep", "false") == "true")


def publish(plan: DataFrame, folder: str, keep: bool = False) -> dict[str, int]:
    """Writes each ``(path, body)`` below ``folder``, all or none; the counters ``written``, ``kept`` and ``errors``.

    Paths are relative and unique. With ``keep`` a file that is there already stays. Rows without path or body, and paths
    that leave the folder, count as errors. Where a task fails for good nothing appears. Moving files is one
    rename each, in the driver's commit; bodies never leave the tasks.
    """
    spark, run = plan.sparkSession, uuid.uuid4().hex
    folder = folder.removeprefix("file://").rstrip("/")
    spark.dataSource.register(Files)
    rows = plan.select("path", F.col("body").cast("binary").alias("body"))
    rows.write.format("quarry_files").option("folder", folder).option("run", run).option("keep", str(keep).lower()).mode("append").save()
    with open(f"{folder}/{RUNS}/{run}.json", encoding="utf-8") as f:
        return json.load(f)
