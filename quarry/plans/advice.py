"""Every recommendation on a set of images, in order: the rules on the images alone and those on all other results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import classify, text
from quarry.functions.numeric import cascade, half_up
from quarry.operators import aggregates, graph, pairs

c = F.col

#: All codes, in the order of the list.
ORDER = (
    "artifacts_high", "artifacts_medium", "ai_mostly", "ai_some", "metadata", "duplicates", "captions", "reference_ok", "reference_doubts", "reference_wrong", "reference_doubtful", "no_face", "many_faces",
    "face_coherence_low", "face_coherence_fair", "face_coherence_ok", "body_coherence_low", "body_coherence_fair", "body_coherence_ok", "mixed_sizes", "blurry", "dark", "overexposed", "sharp_good", "sharp_fair", "sharp_low",
    "viability", "too_few_viable", "enough_viable", "expressions", "expression_dominant", "expression_single", "expression_varied", "small_set", "large_set", "best_target", "diversity_low", "diversity_fair", "diversity_ok",
    "cluster", "tall_portraits", "wide_landscapes", "square_only", "mostly_square", "portrait_heavy", "landscape_heavy", "balanced", "overfit", "upscale_candidates", "next_shot",
)


def _rules(one: DataFrame, *rules: tuple[str | Column, Column, Column, Column]) -> DataFrame:
    """``(code, sub, n, detail)`` of the rules (code, n, detail, condition) that hold in a frame of one row."""
    text_ = lambda x: F.lit(x) if isinstance(x, str) else x
    each = F.array(*(F.struct(text_(code).alias("code"), F.lit(0).cast("long").alias("sub"), n.cast("long").alias("n"), detail.cast("string").alias("detail"), on.alias("on_")) for code, n, detail, on in rules))
    return one.select(F.explode(each).alias("r")).select("r.*").where("on_").drop("on_")


def _ranked(rows: DataFrame, order: list[Column], code: str, n: Column, detail: Column, most: int | None = None) -> DataFrame:
    """Rows of a table of a few rows as one rule each, numbered in order; the first ``most``."""
    numbered = rows.withColumn("sub", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return (numbered.where(c("sub") <= most) if most else numbered).select(F.lit(code).alias("code"), "sub", n.cast("long").alias("n"), detail.cast("string").alias("detail"))


def _coherence(vectors: DataFrame, name: str, low: float, fair: float) -> DataFrame:
    one = pairs.global_coherence(vectors).select("n", half_up(c("coherence"), 3).alias("x"))
    return _rules(one, (cascade((c("x") < low, f"{name}_low"), (c("x") < fair, f"{name}_fair"), otherwise=f"{name}_ok"), c("n"), c("x"), c("x").isNotNull()))


def advice(images: DataFrame, vectors: DataFrame | None, bodies: DataFrame | None, scores: DataFrame, diversity: DataFrame, tied: DataFrame, overfit: DataFrame, next_shots: DataFrame) -> DataFrame:
    """``(ord, code, n, detail)``. Metadata count by file name and, where the features have them, ``metadata`` and ``c2pa``.

    Rules on vectors need these; that a reference can't be used is not known here.
    """
    usable = images.where("viable <> 'no'")
    have = lambda name, kind: c(name) if name in images.columns else F.lit(None).cast(kind)
    sources = text.provenance_sources(text.filename_match(have("name", "string")), have("metadata", "boolean"), have("c2pa", "boolean"))
    match, n = classify.reference_match(c("ref_sim")), lambda cond, name: F.count_if(cond).alias(name)
    s = images.agg(
        n(F.size(sources) > 0, "meta"), n(F.coalesce(c("tags"), F.lit("")) != "", "captions"), n(match == "match", "ok"), n(match == "doubtful", "doubt"), n(match == "wrong_person", "wrong"), half_up(F.avg("ref_sim"), 3).alias("ref"),
        F.count("*").alias("total"), *(n(c("viable") == v, v) for v in ("yes", "borderline", "no")),
    )
    none, known = F.lit(None), c("ref").isNotNull()
    parts = [
        aggregates.recommendations(images).select("code", F.lit(0).cast("long").alias("sub"), "n", none.cast("string").alias("detail")),
        _rules(
            s, ("metadata", c("meta"), none, c("meta") > 0), ("captions", c("captions"), none, c("captions") > 0), ("reference_ok", c("ok"), c("ref"), known & (c("wrong") == 0) & (c("doubt") == 0)),
            ("reference_doubts", c("doubt"), c("ref"), known & (c("wrong") == 0) & (c("doubt") > 0)), ("reference_wrong", c("wrong"), c("ref"), c("wrong") > 0), ("reference_doubtful", c("doubt"), c("ref"), (c("wrong") > 0) & (c("doubt") > 0)),
            ("viability", c("yes"), F.concat_ws("/", "yes", "borderline", "no"), c("total") > 0),
        ),
    ]
    if vectors is not None:
        parts.append(_coherence(vectors, "face_coherence", 0.4, 0.6))
    if bodies is not None:
        seen = images.where("shot <> 'face_only'").select(c("image_id").alias("vec_id"))
        parts.append(_coherence(bodies.join(seen, "vec_id", "left_semi"), "body_coherence", 0.65, 0.78))
        named = F.array_join(F.transform(F.slice("first", 1, 3), lambda x: x.cast("string")), ", ")
        parts.append(_ranked(graph.cluster_stats(tied, 0).orderBy("component").limit(3), [c("component")], "cluster", c("size"), named))
    kinds = usable.where("expression <> ''").groupBy("expression").agg(F.count("*").alias("k"))
    e = kinds.agg(F.count("*").alias("kinds"), F.sum("k").alias("all"), F.max_by("expression", F.struct("k", "expression")).alias("top"), F.max("k").alias("most")).where("kinds > 0").withColumn("share", c("most") / c("all"))
    single = (c("share") <= 0.7) & (c("kinds") < 2)
    parts.append(_rules(e, ("expressions", c("kinds"), c("top"), F.lit(True)), ("expression_dominant", c("most"), c("top"), c("share") > 0.7), ("expression_single", c("kinds"), c("top"), single), ("expression_varied", c("kinds"), none, (c("kinds") >= 3) & (c("share") < 0.6))))
    first = F.array_position(F.array(*map(F.lit, aggregates.FAMILIES)), c("family"))
    best = scores.agg(F.max_by(F.struct("family", "grade", "score"), F.struct(c("score"), -first)).alias("b"))
    parts.append(_rules(best, ("best_target", c("b.score"), F.concat_ws(" ", "b.family", "b.grade"), c("b").isNotNull())))
    main = overfit.agg(F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("main"))  # categories are few
    parts.append(_rules(diversity.crossJoin(main), (cascade((c("score") < 40, "diversity_low"), (c("score") < 60, "diversity_fair"), otherwise="diversity_ok"), c("score"), F.concat_ws(": ", "verdict", F.nullif("main", F.lit(""))), c("score").isNotNull())))
    mix = aggregates.aspect_alerts(usable).crossJoin(aggregates.aspect_counts(usable).withColumn("shown", sum((c(a) for a in aggregates.ASPECTS[1:]), c(aggregates.ASPECTS[0]))))  # one row each
    enough = c("shown") >= 5
    parts.append(_rules(mix, ("tall_portraits", c("tall_portrait"), none, enough & c("tall_alert")), ("wide_landscapes", c("wide_landscape"), none, enough & c("wide_alert")), (c("mix"), c("shown"), none, enough & (c("mix") != "mixed"))))
    tag = F.concat("tag", F.lit(" ("), F.floor(c("share") * 100).cast("string"), F.lit("%)"))
    top = overfit.withColumn("rn", F.row_number().over(Window.partitionBy("category").orderBy(c("n").desc(), "tag"))).groupBy("category").agg(
        F.count("*").alias("tags"), F.max("n").alias("most"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c("rn") <= 3, F.struct("rn", tag.alias("t"))))), lambda x: x["t"]), ", ").alias("named")
    )
    parts.append(_ranked(top, [c("most").desc(), c("category")], "overfit", c("tags"), F.concat_ws(": ", "category", "named")))
    parts.append(next_shots.select(F.lit("next_shot").alias("code"), c("ord").cast("long").alias("sub"), "n", c("shot").alias("detail")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # at most one row a code, save few clusters, categories and shots: one window takes them
    place = F.array_position(F.array(*map(F.lit, ORDER)), c("code"))
    return every.select(F.row_number().over(Window.orderBy(place, "sub")).alias("ord"), "code", "n", "detail")
