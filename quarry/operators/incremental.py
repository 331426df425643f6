"""Incremental re-analysis: a feature cache keyed by file, edits and template rows for what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cache tables of any other version count as empty.
VERSION = 2


def cache_merge(scan: DataFrame, cache: DataFrame, key: str = "file_key", version: int = VERSION) -> DataFrame:
    """``scan`` with the cache's columns and ``hit``; rows without hit are to be analysed anew.

    Cached features only: derived columns are for the caller to compute again. A key twice in the cache counts once.
    """
    known = cache.where(F.col("version") == version).drop("version").dropDuplicates([key]).withColumn("hit", F.lit(True))
    return scan.join(known, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_counters(merged: DataFrame, cache: DataFrame, key: str = "file_key", version: int = VERSION) -> DataFrame:
    """One row: ``reused`` and ``fresh`` files of a scan, and ``dropped`` cache entries that it doesn't hold."""
    gone = cache.where(F.col("version") == version).select(key).distinct().join(merged.select(key), key, "left_anti").agg(F.count("*").alias("dropped"))
    return merged.agg(F.count_if("hit").alias("reused"), F.count_if(~F.col("hit")).alias("fresh")).crossJoin(gone)  # one row each


def cache_next(merged: DataFrame, fresh: DataFrame, version: int = VERSION) -> DataFrame:
    """The next cache: hits of this run and fresh rows; files that are gone drop out."""
    kept = merged.where("hit").drop("hit")
    return kept.unionByName(fresh.select(*kept.columns)).withColumn("version", F.lit(version))


def apply_edits(rows: DataFrame, edits: DataFrame, key: str = "name") -> DataFrame:
    """Caption edits laid over rows by key; a new joy caption replaces the natural one too."""
    e = edits.select(key, *(F.col(c).alias(f"_{c}") for c in ("tags", "joy", "natural")))
    return rows.join(e, key, "left").withColumns(
        {"tags": F.coalesce("_tags", "tags"), "natural": F.coalesce("_joy", "_natural", "natural"), "joy": F.coalesce("_joy", "joy")}
    ).drop("_tags", "_joy", "_natural")


def missing_templates(files: DataFrame, sidecars: DataFrame, key: str) -> DataFrame:
    """``(key, template)``: an empty annotation for every file without sidecar."""
    blank = F.to_json(F.struct(F.lit(0).alias("bpm"), F.lit("").alias("keyscale"), F.lit("").alias("language"), F.lit("").alias("caption")))
    return files.join(sidecars.select(key).distinct(), key, "left_anti").select(key, blank.alias("template"))
