"""Queries over tags, captions, provenance and suggestions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import classify, text
from quarry.functions.numeric import half_up
from quarry.operators import aggregates
from quarry.plans.registry import query
from quarry.sources.adapters import IMG_SQL, JUDGED_SQL, images, judged, r_sql
from quarry.sources.dimensions import TARGETS, TARGETS_SQL, targets

c = F.col


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_sql(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(p)})" for p in patterns) + ")"


_FREQ = JUDGED_SQL + """, t AS (SELECT image_id, unnest(list_distinct(list_transform(string_split(lower(tags), ','), lambda x: trim(x)))) AS tag FROM j WHERE viable <> 'no' AND tags <> ''),
f AS (SELECT tag, count(*) AS n FROM t WHERE tag <> '' GROUP BY tag), k AS (SELECT count(*)::DOUBLE AS total FROM j WHERE viable <> 'no' AND tags <> '')"""
_CATEGORY = "CASE " + " ".join(f"WHEN {any_sql('tag', ps)} THEN '{name}'" for name, ps in text.ACCESSORIES.items()) + " END"


def frequencies(spark, sf):
    rows = judged(images(spark, sf)).where("viable <> 'no' AND tags <> ''")
    return aggregates.tag_frequency(rows, "image_id", "tags").crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


@query("q26_tag_document_frequency", _FREQ + f" SELECT tag, n, {r_sql('n / total', 2)} AS share FROM f, k ORDER BY n DESC, tag LIMIT 20")
def tag_frequency(spark, sf):
    return frequencies(spark, sf).orderBy(c("n").desc(), "tag").limit(20).select("tag", "n", half_up(c("n") / c("total"), 2).alias("share"))


#: Share of rows from which a tag is suspect here; the test texts reach no half in any accessory.
_LEAST = 0.001


def alerts(spark, sf):
    f = frequencies(spark, sf).withColumn("category", text.first_category(c("tag"))).withColumn("share", c("n") / c("total"))
    return f.where(c("category").isNotNull() & (c("share") >= _LEAST) & (c("total") >= 5))


_AL = _FREQ + f", a AS (SELECT tag, n, n / total AS share, {_CATEGORY} AS category FROM f, k WHERE total >= 5), al AS (SELECT * FROM a WHERE category IS NOT NULL AND share >= {_LEAST}::DOUBLE)"


@query("q27_overfit_alerts", _AL + f" SELECT tag, n, category, {r_sql('share', 2)} AS share, CASE WHEN share >= 0.75::DOUBLE THEN 'alert' WHEN share >= 0.5::DOUBLE THEN 'warn' ELSE 'info' END AS level FROM al")
def overfit_alerts(spark, sf):
    level = F.when(c("share") >= 0.75, "alert").when(c("share") >= 0.5, "warn").otherwise("info")
    return alerts(spark, sf).select("tag", "n", "category", half_up(c("share"), 2).alias("share"), level.alias("level"))


@query("q28_overfit_top3_per_category", _AL + ", r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, tag) AS rn FROM al) SELECT category, count(*) AS n_tags, string_agg(CASE WHEN rn <= 3 THEN tag END, ', ' ORDER BY rn) AS top FROM r GROUP BY category")
def overfit_top(spark, sf):
    w = Window.partitionBy("category").orderBy(c("n").desc(), "tag")
    ranked = alerts(spark, sf).select("category", "tag", "n").withColumn("rn", F.row_number().over(w))
    top = F.array_sort(F.collect_list(F.when(c("rn") <= 3, F.struct("rn", "tag"))))
    return ranked.groupBy("category").agg(F.count("*").alias("n_tags"), F.array_join(F.transform(top, lambda s: s["tag"]), ", ").alias("top"))


def _cats(column: str, patterns: dict) -> str:
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN {any_sql(column, ps)} THEN '{n}' END" for n, ps in patterns.items()) + "], lambda x: x IS NOT NULL))"


_SEV = "CASE WHEN list_has_any({0}, ['hands', 'eyes']) THEN 3 WHEN list_has_any({0}, ['limbs', 'anatomy']) THEN 2 WHEN list_has_any({0}, ['quality']) THEN 1 ELSE 0 END"
#: Words of the test texts stand in for fault words, one for each category, so that every severity occurs.
_WORDS = {"hands": "idiot", "eyes": "trash", "limbs": "worthless", "anatomy": "stupid", "quality": "clown"}


def _stand_ins(column: str) -> str:
    out = f"lower(coalesce({column}, ''))"
    for name, word in _WORDS.items():
        out = f"replace({out}, {q(word)}, {q(text.ARTIFACT_TAGS[name][0])})"
    return out


@query("q29_pattern_severity", f"""WITH img AS ({IMG_SQL}), m AS (SELECT image_id, {_stand_ins('tags')} AS t, {_stand_ins('coalesce(nullif(joy, \'\'), "natural")')} AS p FROM img),
k AS (SELECT image_id, {_cats('t', text.ARTIFACT_TAGS)} AS a, {_cats('p', text.ARTIFACT_PHRASES)} AS b FROM m)
SELECT image_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS categories, (['none', 'low', 'medium', 'high'])[1 + greatest({_SEV.format('a')}, {_SEV.format('b')})] AS severity FROM k""")
def severity(spark, sf):
    rows = images(spark, sf).select("image_id", F.expr(_stand_ins("tags")).alias("t"), F.expr(_stand_ins("nullif(joy, '')")).alias("joy"), F.expr(_stand_ins("natural")).alias("natural"))
    found = rows.select("image_id", text.artifact_findings(c("t"), c("joy"), c("natural")).alias("found"))
    return found.select("image_id", F.array_join("found.categories", ",").alias("categories"), "found.severity")


@query("q30_caption_regex", f"""WITH m AS (SELECT doc_id, {_stand_ins('text')} AS p FROM documents), k AS (SELECT doc_id, {_cats('p', text.ARTIFACT_PHRASES)} AS b FROM m) SELECT doc_id, array_to_string(b, ',') AS categories FROM k WHERE len(b) > 0""")
def caption_faults(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.expr(_stand_ins("text")).alias("p"))
    return rows.select("doc_id", text.matched_categories(c("p"), text.ARTIFACT_PHRASES).alias("b")).where(F.size("b") > 0).select("doc_id", F.array_join("b", ",").alias("categories"))


_FIRST = "CASE " + " ".join(f"WHEN contains({{0}}, {q(p)}) THEN {q(p)}" for p in text.FILENAME_PATTERNS) + " END"
#: File names derived from page addresses, one in four of a generator's style.
_NAME = "lower(concat(CASE page_id % 4 WHEN 0 THEN 'ComfyUI_' WHEN 1 THEN 'x_sdxl' ELSE 'photo_' END, url))"


@query("q31_url_provenance", f"WITH p AS (SELECT page_id, {_NAME} AS name FROM pages) SELECT page_id, {_FIRST.format('name')} AS pattern FROM p")
def url_provenance(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.expr(_NAME).alias("name")).select("page_id", text.filename_match(c("name")).alias("pattern"))


@query("q32_metadata_confidence", f"""WITH p AS (SELECT page_id, {_FIRST.format(_NAME)} AS pattern, page_id % 5 = 0 AS meta, page_id % 7 = 0 AS c2pa FROM pages)
SELECT page_id, concat_ws(',', CASE WHEN pattern IS NOT NULL THEN 'filename' END, CASE WHEN meta THEN 'exif/png_text' END, CASE WHEN c2pa THEN 'c2pa' END) AS sources,
 CASE WHEN meta OR c2pa THEN 'high' WHEN pattern IS NOT NULL THEN 'medium' ELSE 'none' END AS confidence FROM p""")
def metadata_confidence(spark, sf):
    meta = F.when(c("page_id") % 5 == 0, F.create_map(F.lit("software"), F.lit("ComfyUI 1"))).otherwise(F.create_map(F.lit("software"), F.lit("camera")))
    p = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.expr(_NAME).alias("name"), meta.alias("m"))
    sources = text.provenance_sources(text.filename_match(c("name")), text.metadata_signal(c("m")), c("page_id") % 7 == 0)
    return p.select("page_id", sources.alias("s")).select("page_id", F.array_join("s", ",").alias("sources"), text.provenance_confidence(c("s")).alias("confidence"))


_CAP = f"""WITH img AS ({IMG_SQL}), t AS ({TARGETS_SQL}), x AS (SELECT image_id, key, coalesce(rtrim(trim(quality_prefix), ','), '') AS lead, CASE captioner WHEN 'wd14' THEN tags ELSE
 coalesce(nullif(joy, ''), nullif("natural", ''), CASE WHEN tags <> '' THEN 'a photo of The, ' || trim(replace(tags, ',', ' and')) ELSE '' END) END AS body FROM img CROSS JOIN t)
SELECT image_id, key, md5(concat_ws(', ', nullif(lead, ''), CASE WHEN body = '' OR NOT contains(lower(body), 'the') THEN 'The' END, nullif(body, ''))) AS caption_md5 FROM x"""


@query("q33_caption_build", _CAP)
def captions(spark, sf):
    # a body for each captioner, a caption for each captioner and prefix, then the targets that share it
    kinds = targets(spark).groupBy("captioner", "quality_prefix").agg(F.collect_list("key").alias("keys")).groupBy("captioner").agg(F.collect_list(F.struct("quality_prefix", "keys")).alias("leads"))
    rows = images(spark, sf).select("image_id", "tags", "joy", "natural").crossJoin(F.broadcast(kinds))  # a row a captioner
    name = F.lit("The")
    bodies = rows.select("image_id", "leads", text.caption_body(c("captioner"), c("tags"), c("joy"), c("natural"), name).alias("body"))
    words = bodies.select("image_id", "body", text.trigger_word(c("body"), name).alias("word"), F.explode("leads").alias("lead"))
    caps = words.select("image_id", "lead.keys", F.md5(text.led_caption(c("body"), c("word"), name, c("lead.quality_prefix")).cast("binary")).alias("caption_md5"))
    return caps.select("image_id", F.explode("keys").alias("key"), "caption_md5")


#: A suggestion for each document, as analyses word them; understood alike by Spark SQL and DuckDB.
_SUGGESTION = (
    "CASE doc_id % 6 WHEN 0 THEN concat('Generate ', n_chars % 7, '-', n_chars % 11, ' side profile shots') WHEN 1 THEN concat('Add ', n_chars % 5, ' three-quarter views, yaw 30') "
    "WHEN 2 THEN concat('only ', n_chars % 4, ' wide shot, full body') WHEN 3 THEN concat('another profile, yaw ', n_chars % 90) WHEN 4 THEN 'vary the smile' ELSE concat('nothing here ', n_chars % 9) END"
)
_SHOT_SQL = " UNION ALL ".join(f"SELECT {i} AS ord, '{n}' AS category, {q(f)} AS fragment, [{', '.join(map(q, ws))}] AS words" for i, (n, (ws, f)) in enumerate(text.SHOTS.items()))


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars")


@query("q34_suggestion_match", f"""WITH s AS (SELECT doc_id, {_SUGGESTION} AS s FROM documents), m AS ({_SHOT_SQL}), k AS (SELECT doc_id, s, ord, category, fragment, len(list_filter(words, lambda w: contains(lower(s), w))) AS score FROM s CROSS JOIN m),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS rn FROM k WHERE score > 0)
SELECT doc_id, category, fragment, coalesce(greatest(TRY_CAST(nullif(regexp_extract(s, '(\\d+)[-\\s]?(\\d+)?', 1), '') AS BIGINT), TRY_CAST(nullif(regexp_extract(s, '(\\d+)[-\\s]?(\\d+)?', 2), '') AS BIGINT)), 5) AS n, doc_id = min(doc_id) OVER (PARTITION BY category) AS kept FROM b WHERE rn = 1""")
def suggestions(spark, sf):
    """What each suggestion asks for; the first of each category is kept."""
    rows = documents(spark, sf).select("doc_id", F.expr(_SUGGESTION).alias("s")).withColumn("m", text.match_shot(c("s"))).where("m IS NOT NULL")
    rows = rows.select("doc_id", "m.category", "m.fragment", text.suggestion_count(c("s")).alias("n"))
    first = rows.groupBy("category").agg(F.min("doc_id").alias("first"))  # a row for each category of shots
    return rows.join(F.broadcast(first), "category").select("doc_id", "category", "fragment", "n", (c("doc_id") == c("first")).alias("kept"))


#: The target that each document asks for; one in twenty is not in the catalogue.
_WANTED = "element_at({0}, CAST(doc_id % 20 + 1 AS INTEGER))"
_WANTED_KEYS = [t[0] for t in TARGETS] + ["other_kohya"]
_WANTED_SQL = f"SELECT doc_id, [{', '.join(map(q, _WANTED_KEYS))}][CAST(doc_id % 20 + 1 AS INTEGER)] AS key FROM documents"
_CATEGORY_SQL = "coalesce(category, CASE WHEN contains(lower(label), 'video') OR contains(lower(label), 'wan') OR contains(lower(key), 'hunyuan') THEN 'video' WHEN contains(lower(label), 'anime') THEN 'image_anime' ELSE 'image_photo' END)"


def wanted_targets(spark, sf):
    """``(doc_id, key)`` and the catalogue's columns, null for a target that it has not."""
    keys = "array(" + ", ".join(map(q, _WANTED_KEYS)) + ")"
    rows = documents(spark, sf).select("doc_id", F.expr(_WANTED.format(keys)).alias("key"))
    return rows.join(F.broadcast(targets(spark)), "key", "left")  # 19 rows


@query("q35_target_catalogue_lookup", f"""WITH t AS ({TARGETS_SQL}), w AS ({_WANTED_SQL}) SELECT w.doc_id, w.key, t.key IS NOT NULL AS known, CASE WHEN t.key IS NOT NULL THEN {_CATEGORY_SQL.replace("lower(key)", "lower(t.key)")} END AS category,
 CASE WHEN t.key IS NOT NULL THEN coalesce(repeats, 10) END::INTEGER AS repeats, config_format, CASE WHEN contains(w.key, 'kohya') THEN 'kohya' ELSE split_part(w.key, '_', 1) END AS folder FROM w LEFT JOIN t ON w.key = t.key""")
def catalogue(spark, sf):
    known = c("label").isNotNull()
    category, repeats = F.when(known, text.target_category(c("category"), c("label"), c("key"))), F.when(known, F.coalesce("repeats", F.lit(10)))
    return wanted_targets(spark, sf).select("doc_id", "key", known.alias("known"), category.alias("category"), repeats.alias("repeats"), "config_format", text.folder_prefix(c("key")).alias("folder"))


@query("q57_caption_priority", "SELECT conv_id, coalesce(arg_min(CASE WHEN role = 'assistant' THEN text END, CASE WHEN role = 'assistant' AND text <> '' THEN turn END), arg_min(text, CASE WHEN text <> '' THEN turn END), '') AS caption FROM conversations GROUP BY conv_id")
def caption_priority(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    said = c("text") != ""  # a conversation without any has the empty caption
    first = lambda cond: F.min_by(F.when(cond & said, c("text")), F.when(cond & said, c("turn")))
    return rows.groupBy("conv_id").agg(F.coalesce(first(c("role") == "assistant"), first(F.lit(True)), F.lit("")).alias("caption"))


#: Two versions of a document, as program releases are named.
_VERSIONS = ("concat('v', n_chars % 3, '.', doc_id % 12, CASE WHEN doc_id % 4 = 0 THEN '.0' ELSE '' END)", "concat(CASE WHEN doc_id % 5 = 0 THEN 'release-' ELSE '' END, n_chars % 4, '.', n_chars % 12)")


@query("q59_version_compare", f"""WITH v AS (SELECT doc_id, {_VERSIONS[0]} AS a, {_VERSIONS[1]} AS b FROM documents), k AS (SELECT doc_id, list_transform(regexp_extract_all(a, '\\d+'), lambda x: x::INTEGER) AS x, list_transform(regexp_extract_all(b, '\\d+'), lambda x: x::INTEGER) AS y FROM v)
SELECT doc_id, CASE WHEN x < y THEN 'older' WHEN x > y THEN 'newer' ELSE 'same' END AS state FROM k""")
def versions(spark, sf):
    x, y = (text.version_key(F.expr(v)) for v in _VERSIONS)
    return documents(spark, sf).select("doc_id", F.when(x < y, "older").when(x > y, "newer").otherwise("same").alias("state"))


#: What a classifier says of each document: two labels and their scores.
_LABELS = ("CASE doc_id % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'Fake' WHEN 2 THEN 'real' ELSE 'AI' END", "CASE doc_id % 3 WHEN 0 THEN 'artificial' WHEN 1 THEN 'real' ELSE 'Synthetic' END")
_MADE = "lower({0}) IN (" + ", ".join(map(q, classify.AI_LABELS)) + ")"


@query("q65_ai_classifier_rules", f"""WITH p AS (SELECT doc_id, {_LABELS[0]} AS l1, {_LABELS[1]} AS l2, (n_chars % 100) / 100::DOUBLE AS s1, (100 - n_chars % 100) / 100::DOUBLE AS s2 FROM documents), k AS (SELECT *, CASE WHEN {_MADE.format('l1')} THEN s1 WHEN {_MADE.format('l2')} THEN s2 ELSE 0::DOUBLE END AS s FROM p)
SELECT doc_id, {r_sql('s', 3)} AS score, s >= 0.5::DOUBLE AS is_ai, CASE WHEN s1 >= s2 THEN l1 ELSE l2 END AS label FROM k""")
def ai_rules(spark, sf):
    hundredth = lambda x: x / F.lit(100.0)
    scores = (hundredth(c("n_chars") % 100), hundredth(100 - c("n_chars") % 100))
    found = F.array(*(F.struct(F.expr(label).alias("label"), score.alias("score")) for label, score in zip(_LABELS, scores)))
    rows = documents(spark, sf).select("doc_id", found.alias("p"))
    s = classify.ai_score(c("p"))
    return rows.select("doc_id", half_up(s, 3).alias("score"), (s >= 0.5).alias("is_ai"), classify.ai_label(c("p")).alias("label"))


@query("q73_targets_by_category", f"WITH t AS ({TARGETS_SQL}), w AS ({_WANTED_SQL}), k AS (SELECT t.key, {_CATEGORY_SQL} AS category FROM w JOIN t ON w.key = t.key) SELECT category, count(*) AS n, string_agg(DISTINCT key, ',' ORDER BY key) AS keys FROM k GROUP BY category".replace("lower(key)", "lower(t.key)"))
def targets_by_category(spark, sf):
    t = wanted_targets(spark, sf).where("label IS NOT NULL").select("key", text.target_category(c("category"), c("label"), c("key")).alias("category"))
    return t.groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("key")), ",").alias("keys"))
