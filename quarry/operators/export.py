"""Export plans: what to write where, as tables; the byte writers act on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import prefix
from quarry.sources.scratch import scratch_root, settle


def ranked(rows: DataFrame, order: str, name: str = "place") -> DataFrame:
    """Adds the 1-based place of each row by ``order`` without gathering the rows in one task.

    Rows are range-partitioned; only one count per partition is summed up to place the ranges.
    """
    from pyspark.sql import Window

    ranges = rows.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id())
    spread = settle(ranges, scratch_root(rows.sparkSession), "ranges")  # both uses see the same ranges
    counts = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return spread.withColumn("_in", inner).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_part", "_n", "_in", "_before")


def numbered(rows: DataFrame, order: str, persona: str) -> DataFrame:
    """Adds ``out_name``: persona and place in order, three digits at least."""
    digits = F.col("place").cast("string")
    padded = F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), F.lit("0"))
    return ranked(rows, order).withColumn("out_name", F.concat(F.lit(f"{persona}_"), padded)).drop("place")


def move_plan(rows: DataFrame, order: str, file: str) -> DataFrame:
    """Adds ``target``: the file name, with ``_<moved so far>`` before its ending where the name is taken.

    A name that any share of the rows has is counted by ranges and sums over ranges.
    """
    counted = prefix.running_count(rows, file, [order], "_n")
    n = F.col("_n") - 1
    clash = F.regexp_replace(F.col(file), r"\.([^.]*)$", "")
    ending = F.regexp_extract(F.col(file), r"(\.[^.]*)$", 1)
    return counted.withColumn("target", F.when(n == 0, F.col(file)).otherwise(F.concat(clash, F.lit("_"), n.cast("string"), ending))).drop("_n")


def caption_pending(judged: DataFrame, joy_active: bool, florence_active: bool) -> DataFrame:
    """Rows that still need a costly caption: viable, without error, and without what the active captioner gives."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    need = (F.lit(joy_active) & empty("joy")) | (F.lit(florence_active and not joy_active) & empty("natural"))
    return judged.where((F.col("viable") != "no") & need)


def export_plan(judged: DataFrame, target: dict, persona: str, boxes: Column | None = None) -> DataFrame:
    """Name, caption and crop of every row that goes into a training folder for one catalogue target."""
    kept = judged.where(~F.col("viable").eqNullSafe("no"))
    caption = text.build_caption(F.lit(target["captioner"]), F.col("tags"), F.col("joy"), F.col("natural"), F.lit(persona), F.lit(target["quality_prefix"]))
    out = numbered(kept, "image_id", persona).withColumn("caption", caption)
    return out.withColumn("box", boxes) if boxes is not None else out


def training_files(plan: DataFrame, target: dict, persona: str, folder: str) -> DataFrame:
    """``(path, content, box, size)`` for ``write_training_images``, from an export plan with ``content`` and ``box``."""
    repeats = target["repeats"] or 10
    home = f"{folder}/{repeats}_{persona}" if target["folder_naming"] == "kohya" else f"{folder}/images"
    first = target["resolutions"][0]
    size = F.col("size") if "size" in plan.columns else F.struct(F.lit(first["w"]).alias("w"), F.lit(first["h"]).alias("h"))
    return plan.select(F.concat(F.lit(f"{home}/"), F.col("out_name"), F.lit(".png")).alias("path"), "content", "box", size.alias("size"))


def export_states(judged: DataFrame, present: Column, viable_only: bool = True) -> DataFrame:
    """Adds ``state``: skipped, ``error`` where the file is not ``present``, or written."""
    out = F.lit(viable_only) & F.col("viable").eqNullSafe("no")
    return judged.withColumn("state", F.when(out, "skipped").when(~F.coalesce(present, F.lit(False)), "error").otherwise("written"))


def export_counters(states: DataFrame) -> DataFrame:
    """One row: ``written``, ``skipped`` and ``errors``."""
    n = lambda state, name: F.count_if(F.col("state") == state).alias(name)
    return states.agg(n("written", "written"), n("skipped", "skipped"), F.count_if(F.col("state").isin("error", "unreadable")).alias("errors"))


def upscale_moves(rows: DataFrame, folder: str, order: str, file: str) -> DataFrame:
    """Where blurry pictures go that can be saved, and their captions: ``target`` and ``sidecar``, names made unique."""
    from quarry.functions import classify

    plan = move_plan(rows.where(classify.upscale_candidate(F.col("sharp"), F.col("faces"))), order, file)
    target = F.concat(F.lit(f"{folder}/"), F.col("target"))
    return plan.withColumns({"target": target, "sidecar": F.regexp_replace(target, r"\.[^./]*$", ".txt")})
