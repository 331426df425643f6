"""Queries over what a report adds: alerts at their own thresholds, actions, gates, counters, views and single-face rules."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quarry.functions import classify, display, geometry, text
from quarry.functions.numeric import half_up
from quarry.operators import aggregates, export, graph, incremental, pairs
from quarry.plans.advice import ORDER, advice
from quarry.plans.event_queries import table
from quarry.plans.image_queries import _ALERTS, _BOX, _REC, boxes
from quarry.plans.registry import query
from quarry.plans.similarity_queries import _COMP, _P, EDGE, vectors
from quarry.plans.text_queries import _CATEGORY, _SUGGESTION, documents
from quarry.sources.adapters import IMG_SQL, JUDGED_SQL, images, judged, r_sql
from quarry.sources.scratch import scratch_root, settle

c = F.col

#: Two of the commonest words stand for accessories, so that alerts occur at the real thresholds.
_WORN = "replace(replace(concat(', ', tags, ', '), ', the, ', ', red hat, '), ', in, ', ', small room, ')"


def alerts_sql(tags: str, judged_name: str = "j") -> str:
    """CTEs ``f0``, ``t0`` and ``al`` of alerts from half of the tagged usable rows, of which there are five at least."""
    return f"""w0 AS (SELECT image_id, {tags} AS tags FROM {judged_name} WHERE viable <> 'no' AND tags <> ''), t0 AS (SELECT count(*)::DOUBLE AS total FROM w0),
f0 AS (SELECT tag, count(*) AS n FROM (SELECT image_id, unnest(list_distinct(list_transform(string_split(lower(tags), ','), lambda x: trim(x)))) AS tag FROM w0) WHERE tag <> '' GROUP BY tag),
al AS (SELECT tag, n, n / total AS share, {_CATEGORY} AS category FROM f0, t0 WHERE total >= 5 AND n / total >= 0.5::DOUBLE AND {_CATEGORY} IS NOT NULL)"""


def worn_alerts(spark, sf):
    rows = judged(images(spark, sf)).where("viable <> 'no' AND tags <> ''").withColumn("tags", F.expr(_WORN))
    return aggregates.overfit_alerts(rows)


@query("q75_overfit_alerts_half", f"{JUDGED_SQL}, {alerts_sql(_WORN)} SELECT tag, n, category, {r_sql('share', 2)} AS share, share >= 0.75::DOUBLE AS alert FROM al")
def overfit_half(spark, sf):
    return worn_alerts(spark, sf).select("tag", "n", "category", half_up(c("share"), 2).alias("share"), (c("share") >= 0.75).alias("alert"))


@query("q76_overfit_by_category", f"{JUDGED_SQL}, {alerts_sql(_WORN)}, r0 AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, tag) AS rn FROM al) SELECT category, count(*) AS n_tags, string_agg(CASE WHEN rn <= 3 THEN tag END, ', ' ORDER BY rn) AS top, bool_or(rn <= 3 AND share >= 0.75::DOUBLE) AS alert FROM r0 GROUP BY category")
def overfit_categories(spark, sf):
    return aggregates.overfit_by_category(worn_alerts(spark, sf))


def clusters_sql() -> str:
    """CTE ``cl`` with the number of clusters and of vectors, after those of ``_COMP`` (a recursive WITH)."""
    return "cl AS (SELECT (SELECT count(*) FROM v) - (SELECT count(DISTINCT id) FROM r) + (SELECT count(DISTINCT x) FROM (SELECT id, min(x) AS x FROM r GROUP BY id)) AS clusters, (SELECT count(*) FROM v) AS total)"


def diversity_sql(tags: str) -> str:
    """CTE ``dv`` (clusters, categories, score): the mean of what there is of cluster score and overfit score."""
    judged_part = JUDGED_SQL.strip().removeprefix("WITH ")
    return f"""{_COMP}, {judged_part}, {alerts_sql(tags)}, {clusters_sql()}, k0 AS (SELECT clusters, total, (SELECT nullif(count(DISTINCT category), 0) FROM al) AS categories FROM cl),
k1 AS (SELECT clusters, categories, CASE WHEN total > 0 THEN least(100, floor(clusters / total::DOUBLE * 100)) END AS a, greatest(0, 100 - 15 * categories)::DOUBLE AS b FROM k0),
dv AS (SELECT clusters, categories, {r_sql('CASE WHEN a IS NULL THEN b WHEN categories IS NULL THEN a ELSE (a + b) / 2 END', 0)} AS score FROM k1)"""


_BANDS = "CASE WHEN score >= 75 THEN 'excellent' WHEN score >= 55 THEN 'good' WHEN score >= 35 THEN 'fair' ELSE 'poor' END AS verdict"


def diversity(spark, sf, alerts):
    """One row: clusters, overfit categories (null without alerts) and score."""
    v = vectors(spark, sf)
    comp = graph.connected_components(pairs.similar_forest(v, EDGE)).agg(F.count("*").alias("linked"), F.count_distinct("component").alias("comps"))
    k = v.agg(F.count("*").alias("total")).crossJoin(comp).crossJoin(aggregates.overfit_categories(alerts).select("categories"))  # one row each
    k = k.withColumn("clusters", c("total") - c("linked") + c("comps"))
    return k.select("clusters", "categories", aggregates.diversity(c("clusters"), c("total"), c("categories")).alias("score"))


def plain_alerts(spark, sf):
    return aggregates.overfit_alerts(judged(images(spark, sf)).where("viable <> 'no'"))


@query("q40_diversity_score", f"{diversity_sql('tags')} SELECT clusters, score, {_BANDS} FROM dv")
def diversity_score(spark, sf):
    return diversity(spark, sf, plain_alerts(spark, sf)).select("clusters", "score", aggregates.diversity_verdict(c("score")).alias("verdict"))


@query("q77_diversity_with_overfit", f"{diversity_sql(_WORN)} SELECT clusters, categories, score, {_BANDS} FROM dv")
def diversity_with_overfit(spark, sf):
    return diversity(spark, sf, worn_alerts(spark, sf)).withColumn("verdict", aggregates.diversity_verdict(c("score")))


@query("q41_target_family_scores", aggregates.target_scores_sql(diversity_sql("tags"), "(SELECT coalesce(nullif(score, 0), 50) FROM dv)"))
def target_scores(spark, sf):
    rows = judged(images(spark, sf))
    score = diversity(spark, sf, plain_alerts(spark, sf)).select(c("score").alias("diversity_score"))
    return aggregates.target_scores(rows.crossJoin(F.broadcast(score)), F.max("diversity_score"))  # one row


@query("q78_action_plan", f"""{JUDGED_SQL}, s AS (SELECT count(*) FILTER (WHERE viable = 'no') AS n_no, count(*) FILTER (WHERE viable = 'yes') AS n_yes FROM j)
SELECT 1 AS ord, 'remove' AS code, n_no AS n FROM s WHERE n_no > 0 UNION ALL SELECT 2, CASE WHEN n_yes < 20 THEN 'generate' WHEN n_yes < 30 THEN 'add_optional' ELSE 'ready' END, CASE WHEN n_yes < 20 THEN 20 - n_yes WHEN n_yes < 30 THEN 30 - n_yes ELSE 0 END FROM s""")
def action_plan(spark, sf):
    return aggregates.action_plan(judged(images(spark, sf)))


_SHOTS_SQL = f"""{JUDGED_SQL}, v0 AS (SELECT *, CASE WHEN abs(yaw) < 15 THEN 'front' WHEN abs(yaw) < 50 THEN 'three_quarter' WHEN yaw IS NOT NULL THEN 'profile' END AS angle FROM j WHERE viable <> 'no'),
s AS (SELECT count(*) AS n, count(yaw) AS yaws, count(*) FILTER (WHERE angle = 'front') AS front, count(*) FILTER (WHERE angle = 'three_quarter') AS tq, count(*) FILTER (WHERE angle = 'profile') AS prof,
 count(*) FILTER (WHERE shot = 'face_only') AS close_, count(*) FILTER (WHERE shot = 'both') AS mid, count(*) FILTER (WHERE shot = 'body_only') AS wide, count(DISTINCT expression) AS kinds FROM v0),
ns AS (SELECT 1 AS ord, 'three_quarter' AS shot, greatest(3, CAST(floor(0.3::DOUBLE * n) AS BIGINT) - tq) AS n, yaws >= 5 AND front / yaws > 0.75::DOUBLE AS on_ FROM s UNION ALL SELECT 2, 'three_quarter_few', 4 - tq, yaws >= 5 AND tq / yaws < 0.15::DOUBLE AND tq < 4 FROM s UNION ALL
 SELECT 3, 'profile', 2 - prof, yaws >= 5 AND prof < 2 AND n >= 15 FROM s UNION ALL SELECT 4, 'vary_framing', n, close_ = n AND n >= 10 FROM s UNION ALL SELECT 5, 'mid_shot', 3, mid = 0 AND n >= 15 FROM s UNION ALL
 SELECT 6, 'wide_shot', 2, wide = 0 AND n >= 20 FROM s UNION ALL SELECT 7, 'expressions', 3 - kinds, kinds < 3 AND n >= 15 FROM s)"""
#: Sides that leave gaps: only frontal close views with two expressions.
_FRONTAL = "(image_id, viable, shot, yaw, expression) AS (SELECT image_id, viable, 'face_only', yaw / 7, CASE WHEN n_chars % 2 = 0 THEN 'laughing' ELSE 'sad' END FROM j)"


@query("q79_next_shots", _SHOTS_SQL + " SELECT ord, shot, n FROM ns WHERE on_")
def next_shots(spark, sf):
    return aggregates.next_shots(judged(images(spark, sf)))


_FRONTAL_SHOTS_SQL = _SHOTS_SQL.replace(", v0 AS", f", fr{_FRONTAL}, v0 AS").replace("FROM j WHERE viable <> 'no'),\ns AS", "FROM fr WHERE viable <> 'no'),\ns AS")


@query("q80_next_shots_of_frontal_views", _FRONTAL_SHOTS_SQL + " SELECT ord, shot, n FROM ns WHERE on_")
def next_shots_frontal(spark, sf):
    rows = judged(images(spark, sf)).select("image_id", "viable", F.lit("face_only").alias("shot"), (c("yaw") / 7).alias("yaw"), F.when(c("n_chars") % 2 == 0, "laughing").otherwise("sad").alias("expression"))
    return aggregates.next_shots(rows)


@query("q81_action_gates", f"{_SHOTS_SQL} SELECT count(*) FILTER (WHERE viable <> 'no') >= 10 AS can_export, count(*) FILTER (WHERE viable <> 'no') >= 1 AS can_mask, count(*) FILTER (WHERE viable = 'no') > 0 AS can_move, count(*) FILTER (WHERE sharp >= 50 AND sharp < 100 AND faces > 0) > 0 AS can_upscale, (SELECT count(*) > 0 FROM ns WHERE on_) AS can_generate FROM j")
def action_gates(spark, sf):
    rows = judged(images(spark, sf))
    return aggregates.action_gates(rows, aggregates.next_shots(rows))


@query("q82_export_counters", f"{JUDGED_SQL} SELECT count(*) FILTER (WHERE viable <> 'no' AND n_chars % 37 <> 0) AS written, count(*) FILTER (WHERE viable = 'no') AS skipped, count(*) FILTER (WHERE viable <> 'no' AND n_chars % 37 = 0) AS errors FROM j")
def export_counters(spark, sf):
    return export.export_counters(export.export_states(judged(images(spark, sf)), c("n_chars") % 37 != 0))


@query("q83_cache_counters", "SELECT count(l.doc_id) AS reused, count(*) - count(l.doc_id) AS fresh, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)) AS dropped FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def cache_counters(spark, sf):
    cache = table(spark, sf, "labels").select("doc_id", "quality", F.lit(2).alias("version"))
    merged = incremental.cache_merge(table(spark, sf, "documents").where("doc_id % 3 <> 0").select("doc_id"), cache, "doc_id")  # a scan that misses cached files
    return incremental.cache_counters(merged, cache, "doc_id")


_DUP = (f"{_P}, img AS ({IMG_SQL}), e AS (SELECT DISTINCT i, j FROM (SELECT i, j FROM p WHERE s > {EDGE}::DOUBLE UNION ALL SELECT a.image_id, b.image_id FROM img a JOIN img b ON a.image_id < b.image_id WHERE bit_count(xor(a.phash, b.phash)) <= 4))").replace("WITH", "WITH RECURSIVE", 1) + """,
adj AS (SELECT j AS id, list(i ORDER BY i) AS less FROM e GROUP BY j), ids AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT i AS id FROM e UNION SELECT j FROM e)), o AS (SELECT ids.id, n, coalesce(less, []::BIGINT[]) AS less FROM ids LEFT JOIN adj ON ids.id = adj.id),
g(n, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.n, CASE WHEN list_has_any(leaders, less) THEN leaders ELSE list_append(leaders, o.id) END FROM g JOIN o ON o.n = g.n + 1), f AS (SELECT leaders FROM g ORDER BY n DESC LIMIT 1),
kp AS (SELECT id, CASE WHEN list_contains(leaders, id) THEN id ELSE list_min(list_intersect(leaders, less)) END AS keeper FROM o, f)"""


def keepers(spark, sf):
    from quarry.plans.analyze import duplicate_keepers

    return duplicate_keepers(images(spark, sf), vectors(spark, sf), 4, EDGE, claimed=True)


@query("q84_duplicate_keepers", _DUP + " SELECT id, keeper FROM kp WHERE id <> keeper")
def duplicate_rows(spark, sf):
    return keepers(spark, sf)


@query("q85_duplicate_groups", _DUP + ", mp AS (SELECT keeper, id, (row_number() OVER (PARTITION BY keeper ORDER BY id) - 1) // 10000 AS part, count(*) OVER (PARTITION BY keeper) AS n_members FROM kp WHERE id <> keeper) SELECT keeper, part, n_members, array_to_string(list(id ORDER BY id), ',') AS members FROM mp GROUP BY keeper, part, n_members")
def duplicate_groups(spark, sf):
    found = graph.duplicate_groups(keepers(spark, sf))
    return found.select("keeper", "part", "n_members", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("q86_top_expressions", f"{JUDGED_SQL} SELECT expression, count(*) AS n FROM j WHERE viable <> 'no' GROUP BY expression ORDER BY n DESC, expression LIMIT 5")
def top_expressions(spark, sf):
    return judged(images(spark, sf)).where("viable <> 'no'").groupBy("expression").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "expression").limit(5)


_T = "CAST(trunc({}) AS INTEGER)"
#: A second face in the corner; the greater one is the main face, the first of equals.
_FACES = f"""{_BOX}, fa AS (SELECT image_id, w, h, {_T.format('x1')} AS ax1, {_T.format('y1')} AS ay1, {_T.format('x2')} AS ax2, {_T.format('y2')} AS ay2, CAST(w // 6 AS INTEGER) AS bx2, CAST(h // 6 AS INTEGER) AS by2, faces FROM box WHERE faces > 0),
mf AS (SELECT image_id, w, h, first_, CASE WHEN first_ THEN ax1 ELSE 0 END AS x1, CASE WHEN first_ THEN ay1 ELSE 0 END AS y1, CASE WHEN first_ THEN ax2 ELSE bx2 END AS x2, CASE WHEN first_ THEN ay2 ELSE by2 END AS y2 FROM (SELECT *, (ax2 - ax1) * (ay2 - ay1) >= bx2 * by2 AS first_ FROM fa))"""


def faces(spark, sf):
    b = boxes(spark, sf).where("faces > 0")
    first = F.struct(*(c(n).cast("int").alias(n) for n in ("x1", "y1", "x2", "y2")))
    second = F.struct(F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.expr("CAST(w DIV 6 AS INT)").alias("x2"), F.expr("CAST(h DIV 6 AS INT)").alias("y2"))
    return b.select("image_id", "w", "h", geometry.main_face(F.array(first, second)).alias("b"))


@query("q87_main_face", f"{_FACES} SELECT image_id, x1, y1, x2, y2, CAST((x2 - x1) * (y2 - y1) AS BIGINT) AS pixels, {r_sql('((x2 - x1) * (y2 - y1))::DOUBLE / (w::DOUBLE * h::DOUBLE) * 100', 1)} AS share FROM mf")
def main_face(spark, sf):
    return faces(spark, sf).select("image_id", "b.x1", "b.y1", "b.x2", "b.y2", geometry.face_size_px(c("b")).alias("pixels"), geometry.face_proportion(c("b"), c("w"), c("h")).alias("share"))


_M = "0.15::DOUBLE"


@query("q88_face_and_body_crops", f"""{_FACES} SELECT image_id, {_T.format(f'greatest(0, x1 - (x2 - x1) * {_M})')} AS ex1, {_T.format(f'greatest(0, y1 - (y2 - y1) * {_M})')} AS ey1, {_T.format(f'least(w::DOUBLE, x2 + (x2 - x1) * {_M})')} AS ex2, {_T.format(f'least(h::DOUBLE, y2 + (y2 - y1) * {_M})')} AS ey2,
 CASE WHEN h - y2 > 50 THEN y2 ELSE 0 END AS body_top FROM mf""")
def face_crops(spark, sf):
    e, body = geometry.expression_crop(c("b"), c("w"), c("h")), geometry.body_crop(c("b"), c("w"), c("h"))
    return faces(spark, sf).withColumns({"e": e, "body": body}).select("image_id", c("e.x1").alias("ex1"), c("e.y1").alias("ey1"), c("e.x2").alias("ex2"), c("e.y2").alias("ey2"), c("body.y1").alias("body_top"))


@query("q89_yaw_estimate", f"WITH img AS ({IMG_SQL}), k AS (SELECT image_id, CASE WHEN n_chars % 3 = 0 THEN yaw END AS pose, (n_chars % 50)::DOUBLE AS nose, 10::DOUBLE AS l, (n_chars % 40)::DOUBLE AS r FROM img) SELECT image_id, {r_sql('coalesce(pose, CASE WHEN r <> l THEN (nose - (l + r) / 2) / abs(r - l) * 90 END)', 1)} AS yaw FROM k")
def yaw_estimate(spark, sf):
    d = lambda e: e.cast("double")
    return images(spark, sf).select("image_id", classify.yaw_of(F.when(c("n_chars") % 3 == 0, c("yaw")), d(c("n_chars") % 50), F.lit(10.0), d(c("n_chars") % 40)).alias("yaw"))


@query("q90_file_keys", "SELECT event_id, CASE WHEN user_id % 7 = 0 THEN event_type ELSE concat_ws('|', event_type, user_id, CAST(floor(epoch(ts)) AS BIGINT)) END AS key FROM events")
def file_keys(spark, sf):
    size = F.when(c("user_id") % 7 != 0, c("user_id"))
    return table(spark, sf, "events").select("event_id", classify.file_key(c("event_type"), size, F.col("ts").cast("timestamp")).alias("key"))


_MARKS = (("‘", "''"), ("’", "''"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("…", "..."), ("→", "->"), ("≥", ">="), ("≤", "<="), ("•", "-"))
_LATIN = "concat('“', text, '” … 日𝄞')"
_LATIN_SQL = _LATIN
for _mark, _plain in _MARKS:
    _LATIN_SQL = f"replace({_LATIN_SQL}, '{_mark}', '{_plain}')"


@query("q91_latin_text", f"SELECT doc_id, md5(regexp_replace(regexp_replace({_LATIN_SQL}, '[\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'), '[^\\x{{0000}}-\\x{{00FF}}]', '?', 'g')) AS latin_md5 FROM documents WHERE text IS NOT NULL")
def latin(spark, sf):
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.md5(text.latin_text(F.expr(_LATIN)).cast("binary")).alias("latin_md5"))


@query("q92_excluded_paths", "SELECT page_id FROM pages WHERE list_has_any(string_split(url, '/'), ['fr', 'de']) OR string_split(url, '/')[-1] IN ('25#top')")
def excluded_paths(spark, sf):
    return table(spark, sf, "pages").where(text.excluded_path(c("url"), ("fr", "de"), ("25#top",))).select("page_id")


@query("q93_prompts", f"WITH s AS (SELECT doc_id, {_SUGGESTION} AS s FROM documents) SELECT doc_id, concat_ws(', ', 'anna', s, 'daylight from a window', 'plain backdrop') AS prompt, replace(trim(concat(' an ', doc_id % 50, ' na ')), ' ', '_') AS persona FROM s")
def prompts(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.expr(_SUGGESTION).alias("s"))
    return rows.select("doc_id", text.shot_prompt(F.lit("anna"), c("s")).alias("prompt"), text.persona_name(F.concat(F.lit(" an "), c("doc_id") % 50, F.lit(" na "))).alias("persona"))


@query("q94_row_marks", f"{JUDGED_SQL} SELECT image_id, CASE viable WHEN 'yes' THEN 'ok' WHEN 'borderline' THEN 'warn' ELSE 'err' END AS tag, CASE viable WHEN 'yes' THEN 'green' WHEN 'borderline' THEN 'yellow' ELSE 'red' END AS colour, CASE WHEN faces = 0 OR avg_sim > 0.95::DOUBLE THEN 'err' WHEN ref_sim < 0.4::DOUBLE THEN 'warn' ELSE 'ok' END AS eval_tag FROM j")
def row_marks(spark, sf):
    tag = classify.evaluator_tag(c("faces") > 0, c("avg_sim") > 0.95, c("ref_sim"))
    return judged(images(spark, sf)).select("image_id", classify.severity_tag(c("viable")).alias("tag"), display.row_colour(c("viable")).alias("colour"), tag.alias("eval_tag"))


@query("q95_presentation_bands", f"""WITH img AS ({IMG_SQL}), k AS (SELECT image_id, CASE WHEN sharp >= 200 THEN 'good' WHEN sharp >= 100 THEN 'fair' ELSE 'poor' END AS sharp, CASE WHEN ai_score > 0.7::DOUBLE THEN 'high' WHEN ai_score > 0.4::DOUBLE THEN 'medium' ELSE 'low' END AS ai,
 CASE WHEN ai_score > 0.5::DOUBLE THEN 'high' ELSE 'low' END AS live, CASE WHEN n_chars % 100 >= 70 THEN 'good' WHEN n_chars % 100 >= 50 THEN 'fair' ELSE 'poor' END AS diversity,
 CASE WHEN n_chars % 100 >= 70 THEN 'green' WHEN n_chars % 100 >= 60 THEN CASE WHEN n_chars % 100 >= 80 THEN 'green' ELSE 'yellow' END WHEN n_chars % 100 >= 50 THEN 'orange' ELSE 'red' END AS colour0 FROM img)
SELECT k.image_id, k.sharp, ai, live, diversity, CASE WHEN n_chars % 100 >= 80 THEN 'green' WHEN n_chars % 100 >= 60 THEN 'yellow' WHEN n_chars % 100 >= 50 THEN 'orange' ELSE 'red' END AS colour FROM k JOIN img USING (image_id)""")
def presentation(spark, sf):
    score = c("n_chars") % 100
    return images(spark, sf).select(
        "image_id", display.sharpness_band(c("sharp")).alias("sharp"), display.ai_band(c("ai_score")).alias("ai"), display.ai_band(c("ai_score"), live=True).alias("live"), display.diversity_band(score).alias("diversity"),
        display.grade_colour(classify.letter(score)).alias("colour"),
    )


@query("q96_table_rows", f"""{JUDGED_SQL} SELECT image_id, concat_ws(' | ', concat(w, 'x', h), printf('%.0f', {r_sql('sharp', 0)}), faces::VARCHAR, CASE WHEN prop = 0 THEN '-' ELSE concat(printf('%.1f', {r_sql('prop', 1)}), '%') END, printf('%+.0f', {r_sql('yaw', 0)}), expression,
 printf('%.2f', {r_sql('avg_sim', 2)}), CASE WHEN ref_sim IS NULL THEN 'NA' ELSE printf('%.2f', {r_sql('ref_sim', 2)}) END) AS cells FROM j""")
def table_rows(spark, sf):
    cells = display.table_row(c("w"), c("h"), c("sharp"), c("faces"), c("prop"), c("yaw"), c("expression"), c("avg_sim"), c("ref_sim"))
    return judged(images(spark, sf)).select("image_id", F.array_join(cells, " | ").alias("cells"))


@query("q97_live_verdicts", f"{JUDGED_SQL} SELECT image_id, name, faces, prop, yaw, sharp, expression, viable, substr(coalesce(tags, ''), 1, 200) AS tags, substr(coalesce(\"natural\", ''), 1, 300) AS natural_caption FROM j")
def live_verdicts(spark, sf):
    return judged(images(spark, sf)).select("image_id", "name", "faces", "prop", "yaw", "sharp", "expression", "viable", display.prefix(c("tags"), "live_tags").alias("tags"), display.prefix(c("natural"), "summary").alias("natural_caption"))


@query("q98_upscale_moves", f"""WITH img AS ({IMG_SQL}), k AS (SELECT image_id, concat(source, '.png') AS file, row_number() OVER (PARTITION BY source ORDER BY image_id) - 1 AS n FROM img WHERE sharp >= 50 AND sharp < 100 AND faces > 0),
t AS (SELECT image_id, concat('up/', CASE WHEN n = 0 THEN file ELSE replace(file, '.png', concat('_', n, '.png')) END) AS target FROM k) SELECT image_id, target, replace(target, '.png', '.txt') AS sidecar FROM t""")
def upscale_moves(spark, sf):
    rows = images(spark, sf).withColumn("file", F.concat("source", F.lit(".png")))
    return export.upscale_moves(rows, "up", "image_id", "file").select("image_id", "target", "sidecar")


@query("q99_reference_names", "SELECT count(*) FILTER (WHERE vec_id % 9 <> 0) AS used, count(*) FILTER (WHERE vec_id % 9 = 0) AS failed, array_to_string(list_sort(list(concat('ref_', vec_id)) FILTER (WHERE vec_id % 9 = 0))[1:5], ',') AS failed_first FROM embeddings WHERE label IN (0, 1, 2)")
def reference_names(spark, sf):
    ref = table(spark, sf, "embeddings").where("label IN (0, 1, 2)").select(F.concat(F.lit("ref_"), c("vec_id")).alias("name"), F.when(c("vec_id") % 9 != 0, c("embedding")).alias("embedding"))
    return aggregates.reference_use(ref).select("used", "failed", F.array_join("failed_first", ",").alias("failed_first"))


@query("q100_two_phase", f"WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, label FROM embeddings WHERE embedding IS NOT NULL) SELECT vec_id, CASE WHEN label < 5 THEN {r_sql('sqrt(list_dot_product(e, e))', 3)} END AS length FROM v")
def two_phase(spark, sf):
    from quarry.functions.providers import REGISTRY
    from quarry.functions.providers import two_phase as phases

    return phases(vectors(spark, sf).select("vec_id", "embedding", "label"), c("label") < 5, REGISTRY["unit_norm"]).select("vec_id", "length")


@query("q101_absent_models", "SELECT doc_id, CAST(NULL AS VARCHAR) AS caption, true AS no_tags FROM documents")
def absent_models(spark, sf):
    from quarry.functions.providers import boundary, features

    rows = features(features(table(spark, sf, "documents").select("doc_id"), boundary("captioner", "no_such_models")), boundary("tagger", "no_such_models"))
    return rows.select("doc_id", "caption", c("scored_tags").isNull().alias("no_tags"))


@query("q102_event_times", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, strftime(ts, '%d/%m') AS day FROM events")
def event_times(spark, sf):
    ts = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", F.date_format(ts, "yyyy-MM-dd HH:mm").alias("minute"), F.date_format(ts, "dd/MM").alias("day"))


_TAGGED = """WITH t AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS tags FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(list_sort(tags)) AS tag, unnest(range(1, len(tags) + 1)) AS pos FROM t),
k AS (SELECT doc_id, tag, pos, CASE WHEN pos % 5 = 0 THEN 4 ELSE 0 END AS category, ((length(tag) * 17 + pos * 7) % 100) / 100::DOUBLE AS p FROM u)
SELECT doc_id, coalesce(string_agg(replace(replace(tag, '(', '\\('), ')', '\\)'), ', ' ORDER BY p DESC, pos) FILTER (WHERE (category = 0 AND p > 0.35::DOUBLE OR category = 4 AND p > 0.85::DOUBLE) AND tag NOT IN ('1girl', '1boy', 'solo')), '') AS tags FROM k GROUP BY doc_id"""


@query("q103_tag_selection", _TAGGED)
def tag_selection(spark, sf):
    tags = F.array_sort(F.array_distinct(F.split(F.lower("text"), " ")))
    scored = F.transform(tags, lambda t, i: F.struct(t.alias("tag"), F.when((i + 1) % 5 == 0, 4).otherwise(0).alias("category"), (((F.length(t) * 17 + (i + 1) * 7) % 100) / F.lit(100.0)).alias("p")))
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", classify.select_tags(scored).alias("tags"))


def _full_advice_sql() -> str:
    """The list of all rules from the statistics that other queries have: one row each, numbered in the order of codes."""
    scores, _, grade = aggregates.target_scores_sql(diversity_sql(_WORN), "(SELECT coalesce(nullif(score, 0), 50) FROM dv)").rpartition(" SELECT family, score, ")
    rules = re.sub(r"\bFROM s\b", "FROM sr", _REC.removeprefix(JUDGED_SQL).replace(", s AS (", ", sr AS (", 1))
    stats, _, listed = rules.partition("\nSELECT ord, code, n FROM (")
    shots = _FRONTAL_SHOTS_SQL.removeprefix(JUDGED_SQL)
    mix = _ALERTS.removeprefix(JUDGED_SQL).replace("SELECT tall >= 3", ", mx AS (SELECT tall, wide, total, tall >= 3", 1) + ")"
    rule = lambda code, n, detail, on, frame, sub="0": f"SELECT {code} AS code, {sub} AS sub, CAST({n} AS BIGINT) AS n, CAST({detail} AS VARCHAR) AS detail FROM {frame} WHERE {on}"
    coherence = lambda name, low, fair: rule(f"CASE WHEN x < {low}::DOUBLE THEN '{name}_low' WHEN x < {fair}::DOUBLE THEN '{name}_fair' ELSE '{name}_ok' END", "n", "x", "x IS NOT NULL", name)
    parts = [
        f"SELECT code, 0 AS sub, n, CAST(NULL AS VARCHAR) AS detail FROM (SELECT ord, code, n FROM ({listed})", rule("'metadata'", "meta", "NULL", "meta > 0", "sa"), rule("'captions'", "captions", "NULL", "captions > 0", "sa"),
        rule("'reference_ok'", "ok", "ref", "ref IS NOT NULL AND wrong = 0 AND doubt = 0", "sa"), rule("'reference_doubts'", "doubt", "ref", "ref IS NOT NULL AND wrong = 0 AND doubt > 0", "sa"),
        rule("'reference_wrong'", "wrong", "ref", "wrong > 0", "sa"), rule("'reference_doubtful'", "doubt", "ref", "wrong > 0 AND doubt > 0", "sa"), rule("'viability'", "n_yes", "concat_ws('/', n_yes, n_bl, n_no)", "total > 0", "sa"),
        coherence("face_coherence", 0.4, 0.6), coherence("body_coherence", 0.65, 0.78),
        rule("'cluster'", "size", "array_to_string(first, ', ')", "sub <= 3", "cs", "sub"), rule("'expressions'", "kinds", "top", "true", "ex"), rule("'expression_dominant'", "most", "top", "share > 0.7::DOUBLE", "ex"),
        rule("'expression_single'", "kinds", "top", "share <= 0.7::DOUBLE AND kinds < 2", "ex"), rule("'expression_varied'", "kinds", "NULL", "kinds >= 3 AND share < 0.6::DOUBLE", "ex"), rule("'best_target'", "score", "concat_ws(' ', family, grade)", "true", "bt"),
        rule("CASE WHEN score < 40 THEN 'diversity_low' WHEN score < 60 THEN 'diversity_fair' ELSE 'diversity_ok' END", "score", "concat_ws(': ', verdict, main)", "score IS NOT NULL", "dm"),
        rule("'tall_portraits'", "tall", "NULL", "total >= 5 AND tall_alert", "mx"), rule("'wide_landscapes'", "wide", "NULL", "total >= 5 AND wide_alert", "mx"), rule("mix", "total", "NULL", "total >= 5 AND mix <> 'mixed'", "mx"),
        rule("'overfit'", "tags", "concat_ws(': ', category, named)", "true", "oc", "sub"), rule("'next_shot'", "n", "shot", "on_", "ns", "ord"),
    ]
    codes = ", ".join(f"'{x}'" for x in ORDER)
    return f"""{scores}, tg AS (SELECT family, score, {grade}){mix}{stats}{shots},
sa AS (SELECT count(*) FILTER (WHERE image_id % 5 = 0 OR image_id % 7 = 0) AS meta, count(*) FILTER (WHERE coalesce(tags, '') <> '') AS captions, count(*) FILTER (WHERE ref_sim >= 0.5::DOUBLE) AS ok, count(*) FILTER (WHERE ref_sim >= 0.35::DOUBLE AND ref_sim < 0.5::DOUBLE) AS doubt,
 count(*) FILTER (WHERE ref_sim < 0.35::DOUBLE) AS wrong, {r_sql('avg(ref_sim)', 3)} AS ref, count(*) AS total, count(*) FILTER (WHERE viable = 'yes') AS n_yes, count(*) FILTER (WHERE viable = 'borderline') AS n_bl, count(*) FILTER (WHERE viable = 'no') AS n_no FROM j),
face_coherence AS (SELECT (SELECT count(*) FROM v) AS n, {r_sql('avg(s)', 3)} AS x FROM p), bv AS (SELECT vec_id FROM v JOIN j ON j.image_id = v.vec_id WHERE j.shot <> 'face_only'),
body_coherence AS (SELECT (SELECT count(*) FROM bv) AS n, {r_sql('avg(s)', 3)} AS x FROM p WHERE i IN (SELECT vec_id FROM bv) AND j IN (SELECT vec_id FROM bv)),
cs AS (SELECT size, first, row_number() OVER (ORDER BY component) AS sub FROM (SELECT component, count(*) AS size, list_sort(list(id))[1:3] AS first FROM (SELECT id, min(x) AS component FROM r GROUP BY id) GROUP BY component HAVING count(*) >= 3)),
ek AS (SELECT expression, count(*) AS k FROM j WHERE viable <> 'no' AND expression <> '' GROUP BY expression), ex AS (SELECT count(*) AS kinds, arg_max(expression, (k, expression)) AS top, max(k) AS most, max(k) / sum(k)::DOUBLE AS share FROM ek HAVING count(*) > 0),
bt AS (SELECT family, grade, score FROM tg ORDER BY score DESC, list_position([{', '.join(f"'{f}'" for f in aggregates.FAMILIES)}], family) LIMIT 1),
dm AS (SELECT score, {_BANDS}, (SELECT string_agg(DISTINCT category, ', ' ORDER BY category) FROM al) AS main FROM dv),
og AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, tag) AS rn FROM al), oc AS (SELECT *, row_number() OVER (ORDER BY most DESC, category) AS sub FROM (SELECT category, count(*) AS tags, max(n) AS most,
 string_agg(CASE WHEN rn <= 3 THEN concat(tag, ' (', CAST(floor(share * 100) AS BIGINT), '%)') END, ', ' ORDER BY rn) AS named FROM og GROUP BY category)),
every AS ({" UNION ALL ".join(parts)}) SELECT CAST(row_number() OVER (ORDER BY list_position([{codes}], code), sub) AS INTEGER) AS ord, code, n, detail FROM every"""


@query("q111_full_advice", _full_advice_sql())
def full_advice(spark, sf):
    """Every rule on the images, with common words worn as accessories and frontal views as the gaps."""
    from quarry.plans import analyze

    rows = judged(images(spark, sf)).withColumns({"metadata": c("image_id") % 5 == 0, "c2pa": c("image_id") % 7 == 0})
    v, alerts, root = vectors(spark, sf), worn_alerts(spark, sf), scratch_root(spark, "advice")
    rows, alerts = settle(rows, root, "images"), settle(alerts, root, "overfit")
    tied = settle(graph.connected_components(pairs.similar_forest(v, EDGE)), root, "tied")
    mix = settle(analyze.diversity(v, tied, alerts), root, "diversity")
    scores = aggregates.target_scores(rows, F.lit(mix.first()["score"]).cast("double"))
    frontal = rows.select("image_id", "viable", F.lit("face_only").alias("shot"), (c("yaw") / 7).alias("yaw"), F.when(c("n_chars") % 2 == 0, "laughing").otherwise("sad").alias("expression"))
    return advice(rows, v, v, scores, mix, tied, alerts, aggregates.next_shots(frontal))
