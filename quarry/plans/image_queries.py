"""Queries over image features: verdicts, histograms, alerts, crops, export plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import classify, geometry, text
from quarry.functions.numeric import cascade, half_up
from quarry.operators import aggregates, export
from quarry.plans.registry import query
from quarry.sources.adapters import IMG_SQL, JUDGED_SQL, images, judged, r_sql
from quarry.sources.dimensions import TARGETS_SQL, targets

c = F.col


@query("q01_viability_counts", JUDGED_SQL + "SELECT viable, count(*) AS n FROM j GROUP BY viable")
def viability_counts(spark, sf):
    return judged(images(spark, sf)).groupBy("viable").agg(F.count("*").alias("n"))


@query("q02_viability_rows_reasons", JUDGED_SQL + "SELECT image_id, viable, reason_codes FROM j")
def viability_rows(spark, sf):
    return judged(images(spark, sf)).select("image_id", "viable", classify.reason_codes(c("reasons")).alias("reason_codes"))


@query(
    "q03_quality_label",
    JUDGED_SQL
    + """, f AS (SELECT image_id, sharp, concat_ws(' + ', CASE WHEN sharp < 100 THEN 'blurry' END, CASE WHEN bright < 40 THEN 'dark' WHEN bright > 220 THEN 'overexposed' END,
  CASE WHEN contrast < 25 THEN 'flat' END, CASE WHEN mp < 0.5::DOUBLE THEN 'low_res' END) AS flags FROM j)
SELECT image_id, CASE WHEN flags <> '' THEN flags WHEN sharp > 500 THEN 'very_sharp' ELSE 'ok' END AS quality FROM f""",
)
def quality_rows(spark, sf):
    return judged(images(spark, sf)).select("image_id", classify.quality_label(c("sharp"), c("bright"), c("contrast"), c("mp")).alias("quality"))


@query("q04_shot_type_hist", JUDGED_SQL + "SELECT shot, count(*) AS n, sum(CASE WHEN viable <> 'no' THEN 1 ELSE 0 END)::BIGINT AS n_viable FROM j GROUP BY shot")
def shot_hist(spark, sf):
    return judged(images(spark, sf)).groupBy("shot").agg(F.count("*").alias("n"), F.count_if(c("viable") != "no").alias("n_viable"))


@query("q05_angle_hist", JUDGED_SQL + "SELECT CASE WHEN abs(yaw) < 15 THEN 'front' WHEN abs(yaw) < 50 THEN 'three_quarter' ELSE 'profile' END AS angle, count(*) AS n FROM j WHERE viable <> 'no' GROUP BY 1")
def angle_hist(spark, sf):
    return judged(images(spark, sf)).where("viable <> 'no'").groupBy(classify.angle_bucket(c("yaw")).alias("angle")).agg(F.count("*").alias("n"))


_ASPECT = "CASE WHEN w / CAST(h AS DOUBLE) < 0.5::DOUBLE THEN 'tall_portrait' WHEN w / CAST(h AS DOUBLE) < 0.9::DOUBLE THEN 'portrait' WHEN w / CAST(h AS DOUBLE) <= 1.1::DOUBLE THEN 'square' WHEN w / CAST(h AS DOUBLE) <= 2 THEN 'landscape' ELSE 'wide_landscape' END"
_HIST = f", a AS (SELECT *, {_ASPECT} AS aspect FROM j WHERE viable <> 'no'), hist AS (SELECT b.aspect, count(a.aspect) AS n FROM (VALUES ('square'), ('portrait'), ('tall_portrait'), ('landscape'), ('wide_landscape')) b(aspect) LEFT JOIN a ON a.aspect = b.aspect GROUP BY b.aspect)"


@query("q06_aspect_hist_shares", JUDGED_SQL + _HIST + f" SELECT aspect, n, {r_sql('n / CAST((SELECT sum(n) FROM hist) AS DOUBLE)', 3)} AS share FROM hist")
def aspect_hist(spark, sf):
    return aggregates.aspect_histogram(judged(images(spark, sf)).where("viable <> 'no'"))


_MIX = "max(CASE WHEN aspect='{0}' THEN n END)"
_ALERTS = JUDGED_SQL + _HIST + f""", t AS (SELECT sum(n)::DOUBLE AS total, {_MIX.format('square')} AS sq, {_MIX.format('portrait')} AS po, {_MIX.format('tall_portrait')} AS tall, {_MIX.format('landscape')} AS la, {_MIX.format('wide_landscape')} AS wide FROM hist)
SELECT tall >= 3 AS tall_alert, wide >= 3 AS wide_alert,
 CASE WHEN total < 5 THEN 'too_few' WHEN sq/total > 0.95::DOUBLE THEN 'square_only' WHEN sq/total > 0.7::DOUBLE AND (la+wide)/total < 0.1::DOUBLE AND (po+tall)/total < 0.2::DOUBLE THEN 'mostly_square'
      WHEN (po+tall)/total > 0.5::DOUBLE THEN 'portrait_heavy' WHEN (la+wide)/total > 0.5::DOUBLE THEN 'landscape_heavy'
      WHEN sq/total > 0.3::DOUBLE AND (po+tall)/total > 0.2::DOUBLE AND (la+wide)/total > 0.1::DOUBLE THEN 'balanced' ELSE 'mixed' END AS mix FROM t"""


@query("q07_aspect_alerts", _ALERTS)
def aspect_alerts(spark, sf):
    return aggregates.aspect_alerts(judged(images(spark, sf)).where("viable <> 'no'"))


@query("q08_resolution_minmax", f"WITH img AS ({IMG_SQL}) SELECT concat(min(w), 'x', min(h)) AS smallest, concat(max(w), 'x', max(h)) AS largest FROM img")
def resolution_minmax(spark, sf):
    return images(spark, sf).agg(F.concat(F.min("w"), F.lit("x"), F.min("h")).alias("smallest"), F.concat(F.max("w"), F.lit("x"), F.max("h")).alias("largest"))


@query("q09_quality_counts", f"""WITH img AS ({IMG_SQL}) SELECT count(*) FILTER (WHERE sharp < 100) AS blurry, count(*) FILTER (WHERE bright < 40) AS dark, count(*) FILTER (WHERE bright > 220) AS overexposed,
  {r_sql('avg(sharp)', 1)} AS mean_sharp, CASE WHEN avg(sharp) > 300 THEN 'good' WHEN avg(sharp) > 150 THEN 'fair' ELSE 'low' END AS band FROM img""")
def quality_counts(spark, sf):
    return aggregates.quality_counts(images(spark, sf))


@query("q10_upscale_candidates", f"WITH img AS ({IMG_SQL}) SELECT image_id, sharp FROM img WHERE sharp >= 50 AND sharp < 100 AND faces > 0")
def upscale(spark, sf):
    return images(spark, sf).where(classify.upscale_candidate(c("sharp"), c("faces"))).select("image_id", "sharp")


_SQUARE = """side AS (SELECT *, least(greatest(x2 - x1, y2 - y1) * 2.2::DOUBLE, least(w, h)::DOUBLE) / 2 AS half FROM box),
ctr AS (SELECT *, greatest(half, least(w - half, (x1 + x2) / 2)) AS cx, greatest(half, least(h - half, (y1 + y2) / 2)) AS cy FROM side)"""
_BOX = f"""WITH img AS ({IMG_SQL}), box AS (SELECT image_id, faces, w, h, w * (n_chars % 10) / 20::DOUBLE AS x1, h * (n_chars % 13) / 26::DOUBLE AS y1,
  w * (n_chars % 10) / 20::DOUBLE + w * (1 + n_chars % 7) / 20::DOUBLE AS x2, h * (n_chars % 13) / 26::DOUBLE + h * (1 + n_chars % 5) / 20::DOUBLE AS y2 FROM img)"""


def boxes(spark, sf):
    d = lambda e: F.expr(e)
    return images(spark, sf).select(
        "image_id", "faces", "w", "h", d("w * (n_chars % 10) / CAST(20 AS DOUBLE)").alias("x1"), d("h * (n_chars % 13) / CAST(26 AS DOUBLE)").alias("y1"),
        d("w * (n_chars % 10) / CAST(20 AS DOUBLE) + w * (1 + n_chars % 7) / CAST(20 AS DOUBLE)").alias("x2"), d("h * (n_chars % 13) / CAST(26 AS DOUBLE) + h * (1 + n_chars % 5) / CAST(20 AS DOUBLE)").alias("y2"),
    )


_T = "CAST(trunc({}) AS INTEGER)"


@query("q36_square_crop_boxes", f"{_BOX}, {_SQUARE} SELECT image_id, {_T.format('cx - half')} AS left_, {_T.format('cy - half')} AS top_, {_T.format('cx + half')} AS right_, {_T.format('cy + half')} AS bottom_ FROM ctr WHERE faces > 0")
def square_boxes(spark, sf):
    b = boxes(spark, sf).where("faces > 0").withColumn("b", geometry.square_crop(c("x1"), c("y1"), c("x2"), c("y2"), c("w"), c("h")))
    return b.select("image_id", c("b.x1").alias("left_"), c("b.y1").alias("top_"), c("b.x2").alias("right_"), c("b.y2").alias("bottom_"))


_BUCKET = f"""{_BOX}, tgt AS ({TARGETS_SQL}), res AS (SELECT key, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS bw, unnest(hs) AS bh FROM tgt WHERE crop = 'bucket'),
pick AS (SELECT *, row_number() OVER (PARTITION BY image_id, key ORDER BY abs(bw / bh::DOUBLE - w / h::DOUBLE), i) AS rn FROM box CROSS JOIN res),
a AS (SELECT *, bw / bh::DOUBLE AS ratio, CASE WHEN faces > 0 THEN (x1 + x2) / 2 ELSE w / 2::DOUBLE END AS mx, CASE WHEN faces > 0 THEN (y1 + y2) / 2 ELSE h / 2::DOUBLE END AS my,
  (CASE WHEN faces > 0 THEN greatest(x2 - x1, y2 - y1) ELSE least(w, h) / 4::DOUBLE END) * 2.4::DOUBLE AS side FROM pick WHERE rn = 1),
b AS (SELECT *, CASE WHEN ratio >= 1 THEN greatest(side, side * ratio) ELSE greatest(side, side / ratio) * ratio END AS ww, CASE WHEN ratio >= 1 THEN greatest(side, side * ratio) / ratio ELSE greatest(side, side / ratio) END AS wh FROM a),
d AS (SELECT *, least(ww, w::DOUBLE) AS cw, least(wh, h::DOUBLE) AS ch FROM b),
e AS (SELECT *, CASE WHEN cw / ch > ratio THEN ch * ratio ELSE cw END / 2 AS hw, CASE WHEN cw / ch > ratio THEN ch ELSE cw / ratio END / 2 AS hh FROM d),
f AS (SELECT *, greatest(hw, least(w - hw, mx)) AS cx, greatest(hh, least(h - hh, my)) AS cy FROM e)
SELECT image_id, key, bw AS bucket_w, bh AS bucket_h, {_T.format('cx - hw')} AS left_, {_T.format('cy - hh')} AS top_, {_T.format('cx + hw')} AS right_, {_T.format('cy + hh')} AS bottom_ FROM f"""


@query("q37_bucket_crop_boxes", _BUCKET)
def bucket_boxes(spark, sf):
    t = targets(spark).where("crop = 'bucket'").select("key", "resolutions")
    rows = boxes(spark, sf).crossJoin(F.broadcast(t))  # a catalogue of 19 rows
    box = F.when(c("faces") > 0, F.struct("x1", "y1", "x2", "y2"))
    rows = rows.withColumn("k", geometry.nearest_bucket(c("w"), c("h"), c("resolutions"))).withColumn("face", box)
    rows = rows.withColumn("b", geometry.bucket_crop(c("face"), c("w"), c("h"), c("k")))
    return rows.select("image_id", "key", c("k.w").alias("bucket_w"), c("k.h").alias("bucket_h"), c("b.x1").alias("left_"), c("b.y1").alias("top_"), c("b.x2").alias("right_"), c("b.y2").alias("bottom_"))


@query("q38_export_plan_numbering", JUDGED_SQL + "SELECT image_id, name, concat('P_', lpad(CAST(row_number() OVER (ORDER BY image_id) AS VARCHAR), CAST(greatest(3, length(CAST(row_number() OVER (ORDER BY image_id) AS VARCHAR))) AS INTEGER), '0')) AS out_name FROM j WHERE viable <> 'no'")
def export_numbering(spark, sf):
    kept = judged(images(spark, sf)).where(~c("viable").eqNullSafe("no"))
    return export.numbered(kept, "image_id", "P").select("image_id", "name", "out_name")


@query("q39_dataset_grade", JUDGED_SQL + """, n AS (SELECT count(*) FILTER (WHERE viable = 'yes') AS n_yes, count(*) FILTER (WHERE viable = 'borderline') AS n_bl, count(*) AS total FROM j),
v AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) e FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT i, sum(e[i]) x FROM v, range(1, 65) r(i) GROUP BY i),
co AS (SELECT floor(((SELECT sum(x * x) FROM s) - (SELECT sum(list_dot_product(e, e)) FROM v)) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1)) * 1000::DOUBLE + 0.5::DOUBLE) / 1000::DOUBLE AS coherence)
SELECT n_yes, n_bl, total, coherence, CASE WHEN n_yes = 0 THEN 'F' WHEN n_yes < 10 THEN 'D' WHEN n_yes < 15 THEN 'C' WHEN n_yes < 20 THEN 'B-' WHEN n_yes < 30 THEN 'B+' WHEN coherence > 0.6::DOUBLE THEN 'A' ELSE 'B' END AS grade FROM n, co""")
def dataset_grade(spark, sf):
    from quarry.operators.pairs import global_coherence

    counts = judged(images(spark, sf)).agg(F.count_if(c("viable") == "yes").alias("n_yes"), F.count_if(c("viable") == "borderline").alias("n_bl"), F.count("*").alias("total"))
    coherence = global_coherence(spark.read.parquet(f"{sf}/embeddings.parquet")).select(half_up(c("coherence"), 3).alias("coherence"))
    return counts.crossJoin(coherence).withColumn("grade", aggregates.dataset_grade(c("n_yes"), c("coherence")))  # one row each


_REC = JUDGED_SQL + """, s AS (SELECT count(*) AS total, count(*) FILTER (WHERE viable = 'yes') AS n_yes, count(*) FILTER (WHERE duplicate) AS dup, count(*) FILTER (WHERE artifacts = 'high') AS ah, count(*) FILTER (WHERE artifacts = 'medium') AS am,
 count(*) FILTER (WHERE faces = 0) AS f0, count(*) FILTER (WHERE faces > 1) AS f2, count(*) FILTER (WHERE ai_score >= 0.5) AS ai, count(*) FILTER (WHERE sharp < 100) AS blurry, count(*) FILTER (WHERE bright < 40) AS dark, count(*) FILTER (WHERE bright > 220) AS over,
 avg(sharp) AS ms, max(w) - min(w) AS dw, max(h) - min(h) AS dh, count(*) FILTER (WHERE sharp >= 50 AND sharp < 100 AND faces > 0) AS up FROM j)
SELECT ord, code, n FROM (
 SELECT 1 AS ord, 'artifacts_high' AS code, ah AS n, ah > 0 AS on_ FROM s UNION ALL SELECT 2, 'artifacts_medium', am, am > 0 FROM s UNION ALL
 SELECT 3, CASE WHEN ai * 2 >= total THEN 'ai_mostly' ELSE 'ai_some' END, ai, ai > 0 FROM s UNION ALL SELECT 4, 'duplicates', dup, dup > 0 FROM s UNION ALL
 SELECT 5, 'no_face', f0, f0 > 0 FROM s UNION ALL SELECT 6, 'many_faces', f2, f2 > 0 FROM s UNION ALL SELECT 7, 'mixed_sizes', greatest(dw, dh), dw > 200 OR dh > 200 FROM s UNION ALL
 SELECT 8, 'blurry', blurry, blurry > 0 FROM s UNION ALL SELECT 9, 'dark', dark, dark > 0 FROM s UNION ALL SELECT 10, 'overexposed', over, over > 0 FROM s UNION ALL
 SELECT 11, CASE WHEN ms > 300 THEN 'sharp_good' WHEN ms > 150 THEN 'sharp_fair' ELSE 'sharp_low' END, total, true FROM s UNION ALL
 SELECT 12, CASE WHEN n_yes < 15 THEN 'too_few_viable' ELSE 'enough_viable' END, n_yes, n_yes < 15 OR n_yes >= 20 FROM s UNION ALL
 SELECT 13, CASE WHEN total < 15 THEN 'small_set' ELSE 'large_set' END, total, total < 15 OR total > 50 FROM s UNION ALL SELECT 14, 'upscale_candidates', up, up > 0 FROM s) WHERE on_"""


@query("q42_recommendation_rules", _REC)
def recommendations(spark, sf):
    return aggregates.recommendations(judged(images(spark, sf)))


@query("q56_viability_vs_labels", JUDGED_SQL + "SELECT viable, quality, toxic, count(*) AS n FROM j JOIN labels l ON j.image_id = l.doc_id GROUP BY ALL")
def viability_vs_labels(spark, sf):
    return judged(images(spark, sf)).select(c("image_id").alias("doc_id"), "viable").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("viable", "quality", "toxic").agg(F.count("*").alias("n"))


@query("q60_move_plan_suffix", JUDGED_SQL + """, r AS (SELECT image_id, concat(source, '.png') AS file, row_number() OVER (PARTITION BY source ORDER BY image_id) AS rn FROM j WHERE viable = 'no')
SELECT image_id, CASE WHEN rn = 1 THEN file ELSE regexp_replace(file, '\\.([^.]*)$', concat('_', CAST(rn - 1 AS VARCHAR), '.\\1')) END AS target FROM r""")
def move_plan(spark, sf):
    rejects = judged(images(spark, sf)).where("viable = 'no'").select("image_id", F.concat("source", F.lit(".png")).alias("file"))
    return export.move_plan(rejects, "image_id", "file").select("image_id", "target")


@query("q61_expression_hist_dominance", JUDGED_SQL + f", h AS (SELECT expression, count(*) AS n FROM j WHERE viable <> 'no' GROUP BY expression) SELECT expression, n, {r_sql('n / CAST((SELECT sum(n) FROM h) AS DOUBLE)', 3)} AS share, n / CAST((SELECT sum(n) FROM h) AS DOUBLE) > 0.7::DOUBLE AS dominant FROM h")
def expression_hist(spark, sf):
    h = judged(images(spark, sf)).where("viable <> 'no'").groupBy("expression").agg(F.count("*").alias("n"))
    share = c("n") / c("total")
    return aggregates.with_total(h, "n").select("expression", "n", half_up(share, 3).alias("share"), (share > 0.7).alias("dominant"))


@query("q66_coverage_panel", JUDGED_SQL + """, k AS (SELECT CASE WHEN abs(yaw) < 15 THEN 'front' WHEN abs(yaw) < 50 THEN 'three_quarter' ELSE 'profile' END AS part FROM j WHERE viable <> 'no' UNION ALL
  SELECT CASE shot WHEN 'face_only' THEN 'close_up' WHEN 'both' THEN 'mid' ELSE 'wide' END FROM j WHERE viable <> 'no')
SELECT d.part, count(k.part) AS n, CASE WHEN count(k.part) >= d.least THEN 'ok' WHEN count(k.part) > 0 THEN 'thin' ELSE 'absent' END AS state
FROM (VALUES ('front', 1), ('three_quarter', 3), ('profile', 2), ('close_up', 1), ('mid', 3), ('wide', 1)) d(part, least) LEFT JOIN k ON k.part = d.part GROUP BY d.part, d.least""")
def coverage(spark, sf):
    return aggregates.coverage_panel(judged(images(spark, sf)).where("viable <> 'no'"))


@query("q67_summary_counts", JUDGED_SQL + f"""SELECT count(*) AS total, count(*) FILTER (WHERE viable = 'yes') AS n_yes, count(*) FILTER (WHERE viable = 'borderline') AS n_borderline, count(*) FILTER (WHERE viable = 'no') AS n_no, count(*) FILTER (WHERE faces = 0) AS faces_0,
  count(*) FILTER (WHERE faces = 1) AS faces_1, count(*) FILTER (WHERE faces > 1) AS faces_many, count(*) FILTER (WHERE duplicate) AS duplicates, count(*) FILTER (WHERE joy <> '' OR coalesce("natural", '') <> '') AS captioned, count(*) FILTER (WHERE ai_score >= 0.5) AS ai, {r_sql('avg(ai_score)', 3)} AS mean_ai FROM j""")
def summary(spark, sf):
    return aggregates.summary_counts(judged(images(spark, sf)))


@query("q68_reference_summary", f"""WITH img AS ({IMG_SQL}) SELECT {r_sql('avg(ref_sim)', 3)} AS mean_sim, min(ref_sim) AS least, max(ref_sim) AS greatest, count(*) FILTER (WHERE ref_sim >= 0.5) AS ok, count(*) FILTER (WHERE ref_sim >= 0.35 AND ref_sim < 0.5) AS doubtful, count(*) FILTER (WHERE ref_sim < 0.35) AS wrong FROM img""")
def reference_summary(spark, sf):
    m = images(spark, sf).withColumn("match", classify.reference_match(c("ref_sim")))
    count = lambda name: F.count_if(c("match") == name)
    return m.agg(half_up(F.avg("ref_sim"), 3).alias("mean_sim"), F.min("ref_sim").alias("least"), F.max("ref_sim").alias("greatest"), count("match").alias("ok"), count("doubtful").alias("doubtful"), count("wrong_person").alias("wrong"))


@query("q69_coherence_labels", JUDGED_SQL + """SELECT image_id, CASE WHEN shot = 'body_only' THEN 'tiny_face' WHEN avg_sim < 0.3::DOUBLE THEN 'outlier' WHEN avg_sim < 0.5::DOUBLE THEN 'weak' ELSE 'ok' END AS face_label,
  CASE WHEN shot = 'face_only' THEN 'not_applicable' WHEN avg_sim < 0.7::DOUBLE THEN 'very_different' WHEN avg_sim < 0.82::DOUBLE THEN 'variable' ELSE 'coherent' END AS body_label FROM j""")
def coherence_labels(spark, sf):
    return judged(images(spark, sf)).select("image_id", classify.face_coherence(c("shot"), c("faces"), c("avg_sim")).alias("face_label"), classify.body_coherence(c("shot"), c("avg_sim")).alias("body_label"))


@query("q70_caption_pending", JUDGED_SQL + "SELECT image_id FROM j WHERE viable <> 'no' AND joy = ''")
def caption_pending(spark, sf):
    return export.caption_pending(judged(images(spark, sf)), joy_active=True, florence_active=False).select("image_id")


@query("q71_centre_crops", f"""WITH img AS ({IMG_SQL}), s AS (SELECT *, w / h::DOUBLE > 4 / 3::DOUBLE AS wide FROM img), n AS (SELECT *, CASE WHEN wide THEN CAST(trunc(h * (4 / 3::DOUBLE)) AS BIGINT) ELSE w END AS nw, CASE WHEN wide THEN h ELSE CAST(trunc(w / (4 / 3::DOUBLE)) AS BIGINT) END AS nh FROM s)
SELECT image_id, CAST((w - nw) // 2 AS INTEGER) AS left_, CAST((h - nh) // 2 AS INTEGER) AS top_, CAST((w - nw) // 2 + nw AS INTEGER) AS right_, CAST((h - nh) // 2 + nh AS INTEGER) AS bottom_ FROM n""")
def centre_crops(spark, sf):
    b = images(spark, sf).withColumn("b", geometry.centre_crop(c("w"), c("h"), F.lit(4), F.lit(3)))
    return b.select("image_id", c("b.x1").alias("left_"), c("b.y1").alias("top_"), c("b.x2").alias("right_"), c("b.y2").alias("bottom_"))
