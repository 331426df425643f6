"""The dataset analysis as one plan: features in, a bundle of report tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.numeric import half_up
from quarry.operators import aggregates, graph, pairs
from quarry.operators.leaders import similar_leaders
from quarry.plans.advice import advice
from quarry.sources.adapters import judged
from quarry.sources.scratch import scratch_root, settle

c = F.col


@dataclass
class Report:
    images: DataFrame
    summary: DataFrame
    aspects: DataFrame
    coverage: DataFrame
    scores: DataFrame
    advice: DataFrame
    next_shots: DataFrame
    diversity: DataFrame


def duplicate_keepers(features: DataFrame, vectors: DataFrame | None, max_bits: int = 4, least: float = 0.96, claimed: bool = False) -> DataFrame:
    """``(id, keeper)``: near-equal hashes, or faces whose product is over ``least``. Every row is compared, by hash class.

    A class has all rows of one hash and is named by its first; classes are tied by bands, faces row by row.
    With ``claimed`` only rows that have another one as keeper come.
    """
    hashed = features.where("phash IS NOT NULL").select("image_id", "phash")
    named = hashed.groupBy("phash").agg(F.min("image_id").alias("k"))
    members = hashed.join(named, "phash").select(c("image_id").alias("id"), "k")
    near = pairs.hamming_pairs(features, max_bits).select("i", "j")
    if vectors is None:
        found = graph.class_leaders(members, near, near.limit(0))
        return found.where("id <> keeper") if claimed else found
    return similar_leaders(vectors, least, True, members, near, leaders=not claimed)


#: Product over which two images look nearly the same, and the bodies from which clusters count.
LOOKS, BODIES = 0.92, 5


def looks(bodies: DataFrame | None, spark: SparkSession) -> DataFrame:
    """``(id, component)`` of images tied to others that look nearly the same."""
    if bodies is None:
        return spark.createDataFrame([], "id long, component long")
    return graph.connected_components(pairs.similar_forest(bodies, LOOKS, over=True))


def diversity(bodies: DataFrame | None, tied: DataFrame, overfit: DataFrame) -> DataFrame:
    """One row ``(clusters, overfit_categories, score, verdict)``; a part without enough data, or without alerts, is null."""
    k = overfit.agg(F.nullif(F.count_distinct("category"), F.lit(0)).alias("overfit_categories"))
    if bodies is None:
        k = k.select("*", F.lit(None).cast("long").alias("total"), F.lit(None).cast("long").alias("clusters"))
    else:
        counts = bodies.agg(F.count("embedding").alias("all")).crossJoin(tied.agg(F.count("*").alias("tied"), F.count_distinct("component").alias("parts")))  # one row each
        k = k.crossJoin(counts).withColumn("total", F.when(c("all") >= BODIES, c("all"))).withColumn("clusters", c("total") - c("tied") + c("parts"))
    score = aggregates.diversity(c("clusters"), c("total"), c("overfit_categories"))
    k = k.withColumn("score", score)
    return k.select("clusters", "overfit_categories", "score", F.when(c("score").isNotNull(), aggregates.diversity_verdict(c("score"))).alias("verdict"))


def analyze(features: DataFrame, vectors: DataFrame | None = None, legacy_stats: bool = False, bodies: DataFrame | None = None) -> Report:
    """Judges every image and sums the set up. Features are settled once; all tables read that copy.

    ``vectors`` ``(vec_id, embedding)`` add face averages and face duplicates, ``bodies`` of the same form the
    clusters of look-alikes that diversity counts. With ``legacy_stats`` target scores don't know the mix of
    formats nor diversity; else they take 50 only where diversity is null or 0.
    """
    spark, root = features.sparkSession, scratch_root(features.sparkSession)
    rows = settle(features, root, "features")
    if vectors is not None:
        keepers = duplicate_keepers(rows, vectors, claimed=True).select(c("id").alias("image_id"), "keeper")
        average = pairs.leave_one_out(vectors).select(c("id").alias("image_id"), half_up(c("average"), 3).alias("_avg"))
        rows = rows.join(keepers, "image_id", "left").join(average, "image_id", "left").withColumns({"duplicate": c("keeper").isNotNull(), "avg_sim": F.coalesce("_avg", "avg_sim")}).drop("_avg")
    images = settle(judged(rows), root, "images")
    usable = images.where("viable <> 'no'")
    overfit = settle(aggregates.overfit_alerts(usable), root, "overfit")
    tied = settle(looks(bodies, spark), root, "looks")
    mix = settle(diversity(bodies, tied, overfit), root, "diversity")
    scores = aggregates.target_scores(images, F.lit(mix.first()["score"]).cast("double"), legacy_stats)
    shots = aggregates.next_shots(images)
    return Report(images, aggregates.summary_counts(images), aggregates.aspect_histogram(usable), aggregates.coverage_panel(usable), scores, advice(images, vectors, bodies, scores, mix, tied, overfit, shots), shots, mix)
