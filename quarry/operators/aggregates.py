"""Dataset-level aggregates: histograms, alerts, grades, target scores, recommendations. One pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import classify, text
from quarry.functions.numeric import cascade, half_up, truthy_or

c = F.col
FAMILIES = ("sdxl_classic", "sdxl_anime", "flux", "wan_video", "other_video")
ASPECTS = ("square", "portrait", "tall_portrait", "landscape", "wide_landscape")


def with_total(counts: DataFrame, n: str) -> DataFrame:
    """Adds ``total``, the sum of a small table of counts, as a one-row join."""
    return counts.crossJoin(F.broadcast(counts.agg(F.sum(n).alias("total"))))


def _fixed_rows(wide: DataFrame, names: tuple[str, ...], key: str, value: str) -> DataFrame:
    """One row of counts turned into one row a name; zeros stay."""
    return wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias(key), c(n).alias(value)) for n in names))).alias("r")).select("r.*")


def aspect_counts(rows: DataFrame) -> DataFrame:
    bucket = classify.aspect_bucket(c("w"), c("h"))
    return rows.select(bucket.alias("aspect")).agg(*(F.count_if(c("aspect") == a).alias(a) for a in ASPECTS))


def aspect_histogram(rows: DataFrame) -> DataFrame:
    wide = aspect_counts(rows).withColumn("total", sum((c(a) for a in ASPECTS[1:]), c(ASPECTS[0])))
    each = wide.select("total", F.explode(F.array(*(F.struct(F.lit(a).alias("aspect"), c(a).alias("n")) for a in ASPECTS))).alias("r"))
    return each.select("r.aspect", "r.n", half_up(c("r.n") / c("total"), 3).alias("share"))


def aspect_alerts(rows: DataFrame) -> DataFrame:
    """One row: alerts for three and more extreme formats, and the advice on the mix."""
    t = aspect_counts(rows).withColumn("total", sum((c(a) for a in ASPECTS[1:]), c(ASPECTS[0])).cast("double"))
    sq, po, la = c("square") / c("total"), (c("portrait") + c("tall_portrait")) / c("total"), (c("landscape") + c("wide_landscape")) / c("total")
    mix = cascade(
        (c("total") < 5, "too_few"), (sq > 0.95, "square_only"), ((sq > 0.7) & (la < 0.1) & (po < 0.2), "mostly_square"), (po > 0.5, "portrait_heavy"), (la > 0.5, "landscape_heavy"),
        ((sq > 0.3) & (po > 0.2) & (la > 0.1), "balanced"), otherwise="mixed",
    )
    return t.select((c("tall_portrait") >= 3).alias("tall_alert"), (c("wide_landscape") >= 3).alias("wide_alert"), mix.alias("mix"))


def quality_counts(rows: DataFrame) -> DataFrame:
    mean = F.avg("sharp")
    return rows.agg(
        F.count_if(c("sharp") < 100).alias("blurry"), F.count_if(c("bright") < 40).alias("dark"), F.count_if(c("bright") > 220).alias("overexposed"), half_up(mean, 1).alias("mean_sharp"),
        cascade((mean > 300, "good"), (mean > 150, "fair"), otherwise="low").alias("band"),
    )


def summary_counts(rows: DataFrame) -> DataFrame:
    n = lambda cond, name: F.count_if(cond).alias(name)
    captioned = (F.coalesce(c("joy"), F.lit("")) != "") | (F.coalesce(c("natural"), F.lit("")) != "")
    return rows.agg(
        F.count("*").alias("total"), n(c("viable") == "yes", "n_yes"), n(c("viable") == "borderline", "n_borderline"), n(c("viable") == "no", "n_no"), n(c("faces") == 0, "faces_0"), n(c("faces") == 1, "faces_1"),
        n(c("faces") > 1, "faces_many"), n(c("duplicate"), "duplicates"), n(captioned, "captioned"), n(c("ai_score") >= 0.5, "ai"), half_up(F.avg("ai_score"), 3).alias("mean_ai"),
    )


def dataset_grade(n_yes: Column, coherence: Column) -> Column:
    return cascade((n_yes == 0, "F"), (n_yes < 10, "D"), (n_yes < 15, "C"), (n_yes < 20, "B-"), (n_yes < 30, "B+"), (coherence > 0.6, "A"), otherwise="B")


def diversity(clusters: Column, total: Column, overfit_categories: Column) -> Column:
    """Mean of the cluster score and of what overfit categories leave of 100, rounded; parts that are null don't count."""
    clip = F.when(total > 0, F.least(F.lit(100), F.floor(clusters / total * 100)))
    fit = F.when(overfit_categories.isNotNull(), F.greatest(F.lit(0), F.lit(100) - 15 * overfit_categories))
    parts = F.array_compact(F.array(clip.cast("double"), fit.cast("double")))
    return half_up(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(parts), F.lit(0)), 0)


def diversity_verdict(score: Column) -> Column:
    return cascade((score >= 75, "excellent"), (score >= 55, "good"), (score >= 35, "fair"), otherwise="poor")


#: Points of a family by rule: (condition in terms of the statistics, points), first that holds.
def _rules(legacy: bool = False) -> dict[str, list[list[tuple[str, str]]]]:
    r = "/ greatest(n, 1)"
    classic = [
        [("n >= 30", "25"), ("n >= 20", "22"), ("n >= 15", "18"), ("n >= 10", "12"), ("true", "5")],
        [(f"r1024 {r} >= 0.9", "20"), (f"r1024 {r} >= 0.5", "15"), (f"r512 {r} >= 0.9", "10"), ("true", "5")],
        [(f"tagged {r} >= 0.95", "15"), (f"tagged {r} >= 0.7", "10"), ("true", "3")],
        [("true", "floor(d * 0.20)")],
        [("ar > 0 AND sq / ar >= 0.8", "10"), ("ar > 0 AND sq / ar >= 0.5", "6"), ("true", "0")],
        [("true", "greatest(0, 10 - 2 * ah)")],
    ]
    flux = [
        [("n >= 25", "25"), ("n >= 15", "20"), ("n >= 10", "12"), ("true", "5")],
        [(f"r1024 {r} >= 0.9", "20"), (f"r1024 {r} >= 0.5", "15"), ("true", "5")],
        [(f"joyed {r} >= 0.9", "20"), (f"captioned {r} >= 0.9", "15"), (f"tagged {r} >= 0.9", "7"), ("true", "3")],
        [("kinds >= 3", "15"), ("kinds = 2", "10"), ("true", "5")],
        [("true", "floor(d * 0.15)")],
        [("ah = 0", "5"), ("true", "0")],
    ]
    wan = [
        [("n >= 30", "25"), ("n >= 20", "18"), ("n >= 10", "10"), ("true", "3")],
        [(f"r512 {r} >= 0.9", "15"), ("true", "5")],
        [(f"longs {r} >= 0.7", "20"), (f"captioned {r} >= 0.7", "12"), (f"tagged {r} >= 0.7", "4"), ("true", "0")],
        [("kinds >= 2", "15"), ("kinds = 1", "8"), ("true", "0")],
        [("po >= 2 AND la >= 2", "10"), ("po >= 1 OR la >= 1", "5"), ("true", "0")],
        [("true", "floor(d * 0.15)")],
    ]
    return {"sdxl_classic": classic, "flux": flux, "wan_video": wan}


def _family_sql() -> dict[str, str]:
    """The score of each family in SQL that Spark and DuckDB share."""
    points = lambda rules: " + ".join("CASE " + " ".join(f"WHEN {w} THEN {p}" for w, p in part) + " END" for part in rules)
    base = {k: f"least(100, {points(v)})" for k, v in _rules().items()}
    return {
        "sdxl_classic": base["sdxl_classic"], "sdxl_anime": f"least(100, {base['sdxl_classic']} + CASE WHEN ah > 0 THEN least(8, ah * 2) ELSE 0 END)", "flux": base["flux"],
        "wan_video": base["wan_video"], "other_video": f"greatest(0, {base['wan_video']} - 5)",
    }


def target_scores(judged: DataFrame, diversity_score: Column, legacy: bool = False) -> DataFrame:
    """``(family, score, grade)`` of five target families; no rows without any viable image.

    ``diversity_score`` is an aggregate over the judged rows, or a literal. ``legacy`` takes the mix of formats as unknown and diversity as 50, whatever they are.
    """
    v = judged.where("viable IN ('yes', 'borderline')")
    count = lambda cond, name: F.count_if(cond).cast("double").alias(name)
    aspect = classify.aspect_bucket(c("w"), c("h"))
    cap = F.coalesce(F.nullif(c("joy"), F.lit("")), F.nullif(c("natural"), F.lit("")), F.lit(""))
    known = F.lit(not legacy)
    s = v.agg(
        F.count("*").alias("rows"), count(c("viable") == "yes", "n"), count((c("w") >= 1024) & (c("h") >= 1024), "r1024"), count((c("w") >= 512) & (c("h") >= 512), "r512"), count(F.coalesce(c("tags"), F.lit("")) != "", "tagged"),
        count(cap != "", "captioned"), count(F.coalesce(c("joy"), F.lit("")) != "", "joyed"), count(F.length(cap) >= 100, "longs"), count(known & (aspect == "square"), "sq"), count(known & aspect.isin("portrait", "tall_portrait"), "po"),
        count(known & aspect.isin("landscape", "wide_landscape"), "la"), count(c("artifacts") == "high", "ah"), diversity_score.cast("double").alias("d0"),
    ).where("rows > 0")
    s = s.withColumns({"d": F.lit(50.0) if legacy else truthy_or(c("d0"), 50.0).cast("double"), "ar": c("sq") + c("po") + c("la"), "kinds": (c("sq") > 0).cast("int") + (c("po") > 0).cast("int") + (c("la") > 0).cast("int")})
    each = s.select(F.explode(F.array(*(F.struct(F.lit(k).alias("family"), F.expr(e).cast("long").alias("score")) for k, e in _family_sql().items()))).alias("r")).select("r.*")
    return each.withColumn("grade", classify.letter(c("score")))


def target_scores_sql(judged: str, diversity: str = "50::DOUBLE") -> str:
    ratio = "w / CAST(h AS DOUBLE)"
    cap = "coalesce(nullif(joy, ''), nullif(\"natural\", ''), '')"
    stats = f"""SELECT count(*) FILTER (WHERE viable = 'yes')::DOUBLE AS n, count(*) FILTER (WHERE w >= 1024 AND h >= 1024)::DOUBLE AS r1024, count(*) FILTER (WHERE w >= 512 AND h >= 512)::DOUBLE AS r512, count(*) FILTER (WHERE coalesce(tags, '') <> '')::DOUBLE AS tagged,
 count(*) FILTER (WHERE {cap} <> '')::DOUBLE AS captioned, count(*) FILTER (WHERE coalesce(joy, '') <> '')::DOUBLE AS joyed, count(*) FILTER (WHERE length({cap}) >= 100)::DOUBLE AS longs, count(*) FILTER (WHERE {ratio} >= 0.9::DOUBLE AND {ratio} <= 1.1::DOUBLE)::DOUBLE AS sq,
 count(*) FILTER (WHERE {ratio} < 0.9::DOUBLE)::DOUBLE AS po, count(*) FILTER (WHERE {ratio} > 1.1::DOUBLE)::DOUBLE AS la, count(*) FILTER (WHERE artifacts = 'high')::DOUBLE AS ah, {diversity} AS d FROM j WHERE viable <> 'no'"""
    more = "SELECT *, sq + po + la AS ar, (sq > 0)::INTEGER + (po > 0)::INTEGER + (la > 0)::INTEGER AS kinds FROM s0"
    rows = " UNION ALL ".join(f"SELECT '{k}' AS family, CAST({e} AS BIGINT) AS score FROM s1" for k, e in _family_sql().items())
    grade = "CASE WHEN score >= 90 THEN 'A+' WHEN score >= 80 THEN 'A' WHEN score >= 70 THEN 'B+' WHEN score >= 60 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END"
    return f"{judged}, s0 AS ({stats}), s1 AS ({more}), ts AS ({rows}) SELECT family, score, {grade} AS grade FROM ts"


def recommendations(judged: DataFrame) -> DataFrame:
    """Ordered ``(ord, code, n)`` of the rules that apply to the whole set; one aggregation feeds them all."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    s = judged.agg(
        F.count("*").alias("total"), n(c("viable") == "yes", "n_yes"), n(c("duplicate"), "dup"), n(c("artifacts") == "high", "ah"), n(c("artifacts") == "medium", "am"), n(c("faces") == 0, "f0"), n(c("faces") > 1, "f2"),
        n(c("ai_score") >= 0.5, "ai"), n(c("sharp") < 100, "blurry"), n(c("bright") < 40, "dark"), n(c("bright") > 220, "over"), F.avg("sharp").alias("ms"), (F.max("w") - F.min("w")).alias("dw"),
        (F.max("h") - F.min("h")).alias("dh"), n(classify.upscale_candidate(c("sharp"), c("faces")), "up"),
    )
    rules = [
        ("artifacts_high", c("ah"), c("ah") > 0), ("artifacts_medium", c("am"), c("am") > 0), (F.when(c("ai") * 2 >= c("total"), "ai_mostly").otherwise("ai_some"), c("ai"), c("ai") > 0), ("duplicates", c("dup"), c("dup") > 0),
        ("no_face", c("f0"), c("f0") > 0), ("many_faces", c("f2"), c("f2") > 0), ("mixed_sizes", F.greatest("dw", "dh"), (c("dw") > 200) | (c("dh") > 200)), ("blurry", c("blurry"), c("blurry") > 0), ("dark", c("dark"), c("dark") > 0),
        ("overexposed", c("over"), c("over") > 0), (cascade((c("ms") > 300, "sharp_good"), (c("ms") > 150, "sharp_fair"), otherwise="sharp_low"), c("total"), F.lit(True)),
        (F.when(c("n_yes") < 15, "too_few_viable").otherwise("enough_viable"), c("n_yes"), (c("n_yes") < 15) | (c("n_yes") >= 20)), (F.when(c("total") < 15, "small_set").otherwise("large_set"), c("total"), (c("total") < 15) | (c("total") > 50)),
        ("upscale_candidates", c("up"), c("up") > 0),
    ]
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), (F.lit(code) if isinstance(code, str) else code).alias("code"), value.cast("long").alias("n"), on.alias("on_")) for i, (code, value, on) in enumerate(rules, 1)))
    return s.select(F.explode(rows).alias("r")).select("r.*").where("on_").drop("on_")


#: What a coverage part needs to count as complete.
COVERAGE = {"front": 1, "three_quarter": 3, "profile": 2, "close_up": 1, "mid": 3, "wide": 1}


def coverage_panel(rows: DataFrame) -> DataFrame:
    """``(part, n, state)`` of every angle and framing; parts without any image are there too."""
    framing = cascade((c("shot") == "face_only", "close_up"), (c("shot") == "both", "mid"), otherwise="wide")
    marked = rows.select(classify.angle_bucket(c("yaw")).alias("a"), framing.alias("f"))
    wide = marked.agg(*(F.count_if((c("a") == p) | (c("f") == p)).alias(p) for p in COVERAGE))
    each = _fixed_rows(wide, tuple(COVERAGE), "part", "n")
    need = cascade(*((c("part") == p, F.lit(k)) for p, k in COVERAGE.items()), otherwise=F.lit(1))
    return each.withColumn("state", cascade((c("n") >= need, "ok"), (c("n") > 0, "thin"), otherwise="absent"))


def next_shots(judged: DataFrame) -> DataFrame:
    """``(ord, shot, n)``: what to generate next, by the gaps among viable images."""
    v = judged.where("viable <> 'no'")
    angle = classify.angle_bucket(c("yaw"))
    n = lambda cond, name: F.count_if(cond).alias(name)
    s = v.agg(
        F.count("*").alias("n"), F.count("yaw").alias("yaws"), n(angle == "front", "front"), n(angle == "three_quarter", "tq"), n(angle == "profile", "prof"), n(c("shot") == "face_only", "close"), n(c("shot") == "both", "mid"),
        n(c("shot") == "body_only", "wide"), F.count_distinct("expression").alias("kinds"),
    )
    known = c("yaws") >= 5
    rules = [
        ("three_quarter", F.greatest(F.lit(3), F.floor(0.3 * c("n")) - c("tq")), known & (c("front") / c("yaws") > 0.75)), ("three_quarter_few", F.lit(4) - c("tq"), known & (c("tq") / c("yaws") < 0.15) & (c("tq") < 4)),
        ("profile", F.lit(2) - c("prof"), known & (c("prof") < 2) & (c("n") >= 15)), ("vary_framing", c("n"), (c("close") == c("n")) & (c("n") >= 10)), ("mid_shot", F.lit(3), (c("mid") == 0) & (c("n") >= 15)),
        ("wide_shot", F.lit(2), (c("wide") == 0) & (c("n") >= 20)), ("expressions", F.lit(3) - c("kinds"), (c("kinds") < 3) & (c("n") >= 15)),
    ]
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(code).alias("shot"), value.cast("long").alias("n"), on.alias("on_")) for i, (code, value, on) in enumerate(rules, 1)))
    return s.select(F.explode(rows).alias("r")).select("r.*").where("on_").drop("on_")


def tag_frequency(rows: DataFrame, id: str, tags: str) -> DataFrame:
    """``(tag, n)``: in how many rows a comma-parted tag occurs, trimmed and in lower case."""
    each = F.array_distinct(F.transform(F.split(F.lower(c(tags)), ","), lambda t: F.trim(t)))
    return rows.select(F.explode(each).alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count("*").alias("n"))


def overfit_alerts(viable: DataFrame, least: float = 0.5, support: int = 5) -> DataFrame:
    """``(tag, n, category, share)`` of accessory tags in at least ``least`` of the tagged rows; none below ``support`` such rows."""
    tagged = viable.where(F.coalesce(c("tags"), F.lit("")) != "")
    f = tag_frequency(tagged, "image_id", "tags").crossJoin(F.broadcast(tagged.agg(F.count("*").alias("total"))))  # one row
    each = f.select("tag", "n", text.first_category(c("tag")).alias("category"), (c("n") / c("total")).alias("share"), "total")
    return each.where(c("category").isNotNull() & (c("share") >= least) & (c("total") >= support)).drop("total")


def overfit_by_category(alerts: DataFrame) -> DataFrame:
    """``(category, n_tags, top, alert)``: the three most frequent tags of each category, and whether one of them is in 75 % of rows."""
    best = alerts.groupBy("category").agg(F.count("*").alias("n_tags"), F.slice(F.array_sort(F.collect_list(F.struct((-c("n")).alias("o"), "tag", "share"))), 1, 3).alias("t"))  # tags of accessories are few
    return best.select("category", "n_tags", F.array_join(F.transform("t", lambda x: x["tag"]), ", ").alias("top"), F.exists("t", lambda x: x["share"] >= 0.75).alias("alert"))


def overfit_categories(alerts: DataFrame) -> DataFrame:
    """One row ``(categories, names)``: the distinct categories of alerts; null without any, which diversity leaves out."""
    n = F.count_distinct("category")
    return alerts.agg(F.when(n > 0, n).alias("categories"), F.array_sort(F.collect_set("category")).alias("names"))


#: Usable images that a stable and an ideal set have.
SET_LEAST, SET_IDEAL = 20, 30


def action_plan(judged: DataFrame) -> DataFrame:
    """Ordered ``(ord, code, n)``: what to remove, then what to add, or that the set is large enough."""
    s = judged.agg(F.count_if(c("viable") == "no").alias("n_no"), F.count_if(c("viable") == "yes").alias("n_yes"))
    more = cascade((c("n_yes") < SET_LEAST, "generate"), (c("n_yes") < SET_IDEAL, "add_optional"), otherwise="ready")
    short = cascade((c("n_yes") < SET_LEAST, F.lit(SET_LEAST) - c("n_yes")), (c("n_yes") < SET_IDEAL, F.lit(SET_IDEAL) - c("n_yes")), otherwise=F.lit(0))
    rows = F.array(F.when(c("n_no") > 0, F.struct(F.lit(1).alias("ord"), F.lit("remove").alias("code"), c("n_no").cast("long").alias("n"))), F.struct(F.lit(2).alias("ord"), more.alias("code"), short.cast("long").alias("n")))
    return s.select(F.explode(F.array_compact(rows)).alias("r")).select("r.*")


def action_gates(judged: DataFrame, suggestions: DataFrame) -> DataFrame:
    """One row of booleans: which further steps a set allows."""
    kept = F.count_if(c("viable").isin("yes", "borderline"))
    gates = judged.agg(
        (kept >= 10).alias("can_export"), (kept >= 1).alias("can_mask"), (F.count_if(c("viable") == "no") > 0).alias("can_move"),
        (F.count_if(classify.upscale_candidate(c("sharp"), c("faces"))) > 0).alias("can_upscale"),
    )
    return gates.crossJoin(suggestions.agg((F.count("*") > 0).alias("can_generate")))  # one row each


def identity_centroid(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """``(pos, x)`` of the mean vector brought to length one; as it is where it is zero."""
    mean = vectors.where(c(vec).isNotNull()).select(F.posexplode(vec).alias("pos", "x")).groupBy("pos").agg(F.avg(c("x").cast("double")).alias("x"))
    length = mean.agg(F.sqrt(F.sum(c("x") * c("x"))).alias("len"))
    return mean.crossJoin(F.broadcast(length)).select("pos", F.when(c("len") > 0, c("x") / c("len")).otherwise(c("x")).alias("x"))


def reference_use(references: DataFrame, vec: str = "embedding", names: int = 5) -> DataFrame:
    """One row: how many references have a vector, how many have none, and the first names of those without."""
    failed = references.where(c(vec).isNull()).orderBy("name").limit(names).agg(F.array_sort(F.collect_list("name")).alias("failed_first"))
    return references.agg(F.count(vec).alias("used"), F.count_if(c(vec).isNull()).alias("failed")).crossJoin(failed)  # one row each


def evaluator_score(mean: Column, std: Column, copycats: Column, with_face: Column, total: Column, top_ratio: Column) -> Column:
    """The verdict's score from statistics rounded before; null mean scores 0."""
    base = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (mean - 0.3) * 200))
    penalty = F.least(F.lit(30), 5 * copycats) + (1 - with_face / F.greatest(total, F.lit(1))) * 20
    penalty = penalty + F.when((std < 0.03) & (with_face >= 10), 15).otherwise(0) + F.when(top_ratio > 0.4, 15).otherwise(0)
    return F.when(mean.isNull(), 0.0).otherwise(half_up(F.greatest(F.lit(0.0), base - penalty), 0))


def evaluator_grade(score: Column) -> Column:
    return cascade((score >= 85, "A"), (score >= 70, "B+"), (score >= 55, "B"), (score >= 40, "C"), (score >= 25, "D"), otherwise="F")
