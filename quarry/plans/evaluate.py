"""Evaluation of a trained model: generated against reference and training vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import classify
from quarry.functions.numeric import half_up
from quarry.operators import aggregates, pairs

c = F.col


@dataclass
class Evaluation:
    rows: DataFrame
    black_holes: DataFrame
    verdict: DataFrame


def evaluate(generated: DataFrame, references: DataFrame, training: DataFrame | None = None, copy: float = 0.95, id: str = "vec_id", vec: str = "embedding") -> Evaluation:
    """Per-row statistics, the training rows that attract most, and a graded verdict.

    Rows without vector count as generated without a face. Fewer than three references raise.
    """
    if len(references.limit(3).take(3)) < 3:
        raise ValueError("at least three reference files are needed")
    stats = pairs.reference_stats(generated, references, id, vec)
    near = pairs.nearest(generated, training if training is not None else generated.limit(0), id, vec)
    rows = generated.select(c(id).alias("id")).join(stats.withColumnRenamed("nearest_id", "nearest_ref"), "id", "left").join(near.select("id", c("nearest_id").alias("nearest_train"), "sim"), "id", "left")
    rows = rows.withColumn("copycat", c("sim") > copy).withColumn("tag", classify.evaluator_tag(c("average").isNotNull(), c("copycat"), c("average")))
    holes = near.groupBy("nearest_id").agg(F.count("*").alias("n"))
    holes = aggregates.with_total(holes, "n").select("nearest_id", "n", half_up(c("n") / c("total"), 2).alias("ratio")).orderBy(c("n").desc(), "nearest_id").limit(5)
    std = F.when(F.count("average") == 1, 0.0).otherwise(F.stddev_samp("average"))
    one = rows.agg(half_up(F.avg("average"), 3).alias("mean"), half_up(std, 3).alias("std"), F.count("average").alias("with_face"), F.count("*").alias("total"), F.count_if("copycat").alias("copies"))
    one = one.crossJoin(holes.agg(F.max("ratio").alias("top")))  # one row each
    score = aggregates.evaluator_score(c("mean"), c("std"), c("copies"), c("with_face"), c("total"), c("top"))
    verdict = one.withColumn("score", score).select("mean", "std", "copies", "top", "score", aggregates.evaluator_grade(c("score")).alias("grade"))
    return Evaluation(rows, holes, verdict)
