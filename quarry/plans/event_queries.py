"""Queries over events, labels and derived audio: incremental runs, sidecars, summaries, progress streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import audio, classify
from quarry.functions.numeric import cascade, half_up
from quarry.operators import aggregates, export, incremental
from quarry.plans.registry import query
from quarry.sources import files
from quarry.sources.adapters import r_sql

c = F.col


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("q43_cache_merge", "SELECT d.lang, l.doc_id IS NOT NULL AS hit, count(*) AS n, sum(l.quality)::BIGINT AS quality FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL")
def cache_merge(spark, sf):
    cache = table(spark, sf, "labels").select("doc_id", "quality", F.lit(2).alias("version"))
    merged = incremental.cache_merge(table(spark, sf, "documents").select("doc_id", "lang"), cache, "doc_id")
    return merged.groupBy("lang", "hit").agg(F.count("*").alias("n"), F.sum("quality").alias("quality"))


@query("q44_missing_sidecars", "SELECT doc_id, '{\"bpm\":0,\"keyscale\":\"\",\"language\":\"\",\"caption\":\"\"}' AS template FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing(spark, sf):
    return incremental.missing_templates(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("q45_names_semi", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def names_semi(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left_semi")


@query("q46_category_except", "SELECT DISTINCT lang FROM documents WHERE lang NOT IN ('en', 'de')")
def category_except(spark, sf):
    fixed = spark.createDataFrame([("en",), ("de",)], "lang string")
    return table(spark, sf, "documents").select("lang").subtract(fixed)


@query("q47_set_union_distinct", "SELECT source AS name FROM documents UNION SELECT split_part(url, '/', 3) FROM pages")
def set_union(spark, sf):
    hosts = table(spark, sf, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("name"))
    return table(spark, sf, "documents").select(c("source").alias("name")).union(hosts).distinct()


#: Voice measures of an event: duration, rate, level, noise ratio and ending follow from its value and id.
_VOICE = "event_id, value / 4 AS duration, CASE WHEN event_id % 9 = 0 THEN 22050 ELSE 48000 END AS rate, -20 - value / 10 AS level, CASE WHEN event_id % 13 = 0 THEN NULL ELSE 10 + value / 5 END AS snr, CASE event_id % 3 WHEN 0 THEN 'mp3' ELSE 'wav' END AS ext, event_id % 50 = 0 AS error"
_ISSUES = f"""WITH v AS (SELECT {_VOICE} FROM events), i AS (SELECT *, CASE WHEN error THEN ['unreadable'] ELSE list_filter([CASE WHEN duration < 3 THEN 'too_short' END, CASE WHEN duration > 30 THEN 'too_long' END, CASE WHEN rate < 40000 THEN 'low_sample_rate' END,
 CASE WHEN level < -35 THEN 'too_quiet' END, CASE WHEN snr < 20 THEN 'noisy' END, CASE WHEN ext NOT IN ('wav', 'flac') THEN 'lossy_format' END], lambda x: x IS NOT NULL) END AS issues FROM v),
g AS (SELECT *, CASE WHEN list_contains(issues, 'unreadable') THEN 'F' WHEN list_contains(issues, 'too_short') THEN 'D' WHEN len(issues) > 1 THEN 'C' WHEN len(issues) = 1 THEN 'B' WHEN coalesce(snr, 0) >= 30 THEN 'A' ELSE 'B' END AS grade FROM i)"""


def voice(spark, sf):
    v = table(spark, sf, "events").selectExpr(*_split(_VOICE))
    v = v.withColumn("issues", audio.voice_issues(c("error"), c("duration"), c("rate"), c("level"), c("snr"), c("ext")))
    return v.withColumn("grade", audio.voice_grade(c("issues"), c("snr")))


def _split(expressions: str) -> list[str]:
    return [e.strip() for e in expressions.split(", ") if e.strip()]


@query("q48_topk_issues", _ISSUES + ", x AS (SELECT unnest(issues) AS issue FROM g) SELECT issue, count(*) AS n FROM x GROUP BY issue ORDER BY n DESC, issue LIMIT 5")
def top_issues(spark, sf):
    return voice(spark, sf).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "issue").limit(5)


_COUNTS = ", ".join(f"count(*) FILTER (WHERE grade = '{g}') AS {g.lower()}" for g in "ABCDF")


@query("q49_grade_counts_pivot", _ISSUES + f""", s AS (SELECT count(*) AS total, {r_sql('sum(duration) / 60', 1)} AS minutes, {r_sql('sum(duration) / count(*)', 1)} AS mean_s, {_COUNTS}, count(DISTINCT rate) > 1 AS mixed_rates FROM g)
SELECT *, CASE WHEN a / total::DOUBLE > 0.7::DOUBLE THEN 'A' WHEN (a + b) / total::DOUBLE > 0.6::DOUBLE THEN 'B' WHEN f = 0 THEN 'C' ELSE 'D' END AS overall, f = 0 AND minutes >= 3 AS ready FROM s""")
def voice_summary(spark, sf):
    s = voice(spark, sf).agg(
        F.count("*").alias("total"), half_up(F.sum("duration") / 60, 1).alias("minutes"), half_up(F.sum("duration") / F.count("*"), 1).alias("mean_s"), *(F.count_if(c("grade") == g).alias(g.lower()) for g in "ABCDF"),
        (F.min("rate") != F.max("rate")).alias("mixed_rates"),
    )
    return s.withColumn("overall", audio.voice_overall(c("a"), c("b"), c("f"), c("total"))).withColumn("ready", (c("f") == 0) & (c("minutes") >= 3))


_MUSIC = "event_id, value * 3 AS duration, -20 - value / 8 AS level, event_id % 4 <> 0 AS lyrics, event_id % 5 <> 0 AS sidecar, event_id % 6 <> 0 AS caption, event_id % 60 = 0 AS error, event_type AS keyscale"
_MG = f"""WITH m AS (SELECT {_MUSIC}, CAST(json_extract(props, '$.k') AS BIGINT) AS bpm FROM events), i AS (SELECT *, CASE WHEN error THEN ['unreadable'] ELSE list_filter([CASE WHEN duration < 30 THEN 'too_short' END, CASE WHEN duration > 600 THEN 'too_long' END, CASE WHEN NOT lyrics THEN 'missing_lyrics' END,
 CASE WHEN NOT sidecar AND NOT caption THEN 'missing_annotation' END, CASE WHEN sidecar AND coalesce(bpm, 0) = 0 THEN 'no_bpm' END, CASE WHEN sidecar AND coalesce(keyscale, '') = '' THEN 'no_key' END, CASE WHEN level < -30 THEN 'too_quiet' END], lambda x: x IS NOT NULL) END AS issues FROM m),
g AS (SELECT *, CASE WHEN list_contains(issues, 'unreadable') THEN 'F' WHEN list_has_any(issues, ['missing_lyrics', 'missing_annotation']) THEN 'D' WHEN len(issues) > 1 THEN 'C' WHEN len(issues) = 1 THEN 'B' ELSE 'A' END AS grade FROM i),
s AS (SELECT count(*) AS total, {_COUNTS}, count(*) FILTER (WHERE NOT lyrics) AS no_lyrics, count(*) FILTER (WHERE NOT sidecar) AS no_json, min(nullif(bpm, 0)) AS bpm_min, max(nullif(bpm, 0)) AS bpm_max, count(DISTINCT nullif(bpm, 0)) AS bpms, string_agg(DISTINCT keyscale, ',' ORDER BY keyscale) AS keys FROM g)
SELECT *, CASE WHEN f > 0 THEN 'D' WHEN (a + b) / total::DOUBLE > 0.8::DOUBLE THEN 'A' WHEN (a + b) / total::DOUBLE > 0.6::DOUBLE THEN 'B' ELSE 'C' END AS overall, no_lyrics = 0 AND f = 0 AS ready FROM s"""


@query("q50_music_summary", _MG)
def music_summary(spark, sf):
    bpm = F.from_json("props", "k bigint")["k"]
    m = table(spark, sf, "events").select(*(F.expr(e) for e in _split(_MUSIC)), bpm.alias("bpm"))
    m = m.withColumn("issues", audio.music_issues(c("error"), c("duration"), c("lyrics"), c("sidecar"), c("caption"), c("sidecar"), c("bpm"), c("keyscale"), c("level"))).withColumn("grade", audio.music_grade(c("issues")))
    real = F.nullif(c("bpm"), F.lit(0))
    s = m.agg(
        F.count("*").alias("total"), *(F.count_if(c("grade") == g).alias(g.lower()) for g in "ABCDF"), F.count_if(~c("lyrics")).alias("no_lyrics"), F.count_if(~c("sidecar")).alias("no_json"), F.min(real).alias("bpm_min"), F.max(real).alias("bpm_max"),
        F.count_distinct(real).alias("bpms"), F.array_join(F.array_sort(F.collect_set("keyscale")), ",").alias("keys"),
    )
    return s.withColumn("overall", audio.music_overall(c("a") + c("b"), c("f"), c("total"))).withColumn("ready", (c("no_lyrics") == 0) & (c("f") == 0))


_W = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_SQ = "list_sum(list_transform({0}, lambda x: x * x)) / len({0})"


@query("q51_rms_snr", f"""WITH w AS (SELECT vec_id, {_W} AS e FROM embeddings), n AS (SELECT *, e[1:16] AS head FROM w)
SELECT vec_id, {r_sql(f"20 * log10(sqrt(greatest(1e-12::DOUBLE, {_SQ.format('e')})))", 1)} AS voice_db, {r_sql(f"20 * log10(greatest(1e-12::DOUBLE, sqrt({_SQ.format('e')})))", 1)} AS music_db,
 {r_sql(f"20 * log10(greatest(1e-12::DOUBLE, sqrt({_SQ.format('e')})) / greatest(1e-12::DOUBLE, sqrt({_SQ.format('head')})))", 1)} AS snr_db FROM n""")
def levels(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.select("vec_id", audio.voice_level_db(c("embedding")).alias("voice_db"), audio.music_level_db(c("embedding")).alias("music_db"), audio.noise_ratio_db(c("embedding"), F.lit(48000)).alias("snr_db"))


_ETA = """WITH r AS (SELECT user_id, event_id, ts, count(*) OVER w AS done, count(*) OVER (PARTITION BY user_id) AS total, epoch(ts) - min(epoch(ts)) OVER (PARTITION BY user_id) AS elapsed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, done, floor(done * 1000 / total::DOUBLE + 0.5::DOUBLE) / 10::DOUBLE AS percent, CASE WHEN elapsed > 0 THEN CAST(floor((total - done) / (done / floor(elapsed)::DOUBLE) + 0.5::DOUBLE) AS BIGINT) END AS eta_s FROM r"""


@query("q52_progress_eta", _ETA.replace("epoch(ts) - min(epoch(ts)) OVER (PARTITION BY user_id)", "date_diff('microsecond', min(ts) OVER (PARTITION BY user_id), ts) // 1000000").replace("floor(elapsed)", "elapsed"))
def eta(spark, sf):
    from quarry.streaming.progress import progress_eta

    return progress_eta(table(spark, sf, "events"), "user_id", "ts", "event_id")


_SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k"""


@query("q53_inactivity_sessions", _SESSIONS)
def sessions(spark, sf):
    from quarry.streaming.progress import inactivity_sessions

    return inactivity_sessions(table(spark, sf, "events"), "user_id", "ts")


@query("q54_latest_event", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest(spark, sf):
    from quarry.streaming.progress import latest_events

    return latest_events(table(spark, sf, "events"), "user_id", "ts", ["event_id", "event_type"])


@query("q55_batch_of_ten", "WITH r AS (SELECT event_id, value, (row_number() OVER (ORDER BY ts, event_id) - 1) // 10 AS batch FROM events) SELECT batch, count(*) AS n, max(event_id) AS last_id FROM r GROUP BY batch")
def batches(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts").withColumn("o", F.struct("ts", "event_id"))
    return export.ranked(e, "o").groupBy(F.floor((c("place") - 1) / 10).alias("batch")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query("q58_json_template", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, concat('{\"id\":', event_id, ',\"k\":', json_extract(props, '$.k'), '}') AS doc FROM events")
def json_rows(spark, sf):
    parsed = table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})["k"].alias("k"))
    return parsed.select("event_id", "k", F.to_json(F.struct(c("event_id").alias("id"), "k")).alias("doc"))


@query("q64_stream_incremental", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_incremental(spark, sf):
    from quarry.streaming.progress import available_now

    return available_now(spark, f"{sf}/events.parquet", "event_type")


@query("q74_music_grades", _MG.split(",\ns AS")[0] + " SELECT grade, count(*) AS n FROM g GROUP BY grade")
def music_grades(spark, sf):
    bpm = F.from_json("props", "k bigint")["k"]
    m = table(spark, sf, "events").select(*(F.expr(e) for e in _split(_MUSIC)), bpm.alias("bpm"))
    issues = audio.music_issues(c("error"), c("duration"), c("lyrics"), c("sidecar"), c("caption"), c("sidecar"), c("bpm"), c("keyscale"), c("level"))
    return m.select(audio.music_grade(issues).alias("grade")).groupBy("grade").agg(F.count("*").alias("n"))


#: A sound file for each document, and the files beside some of them; understood alike by Spark SQL and DuckDB.
_STEM = "concat('track_', doc_id)"
_BESIDE = {"has_lyrics": ("doc_id % 2 = 0", ".lyrics.txt"), "has_json": ("doc_id % 3 = 0", ".json"), "has_caption": ("n_chars % 5 = 0", ".caption.txt")}


@query("q108_sidecar_probe", f"SELECT {_STEM} AS stem, " + ", ".join(f"coalesce({on}, false) AS {name}" for name, (on, _) in _BESIDE.items()) + " FROM documents")
def sidecar_probe(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    stem = docs.select(c("source").alias("folder"), F.expr(_STEM).alias("stem"), "doc_id", "n_chars")
    beside = None
    for on, ending in [*_BESIDE.values(), ("true", ".wav")]:
        part = stem.where(on).select("folder", F.concat("stem", F.lit(ending)).alias("name"))
        beside = part if beside is None else beside.unionByName(part)
    return files.with_sidecars(stem.select("folder", "stem"), beside).drop("folder")


_SIDE = "CASE WHEN doc_id % 10 = 0 THEN '{\"bpm\": 12' WHEN doc_id % 10 = 1 THEN '[]' WHEN doc_id % 10 = 2 THEN NULL ELSE concat('{\"bpm\": ', n_chars % 200, ', \"keyscale\": \"', lang, '\"}') END"


@query("q109_sidecar_parse", f"SELECT doc_id, CASE WHEN doc_id % 10 > 2 THEN CAST(n_chars % 200 AS DOUBLE) END AS bpm, CASE WHEN doc_id % 10 > 2 THEN lang END AS keyscale FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL")
def sidecar_parse(spark, sf):
    docs = table(spark, sf, "documents").where("lang IS NOT NULL AND n_chars IS NOT NULL").select("doc_id", F.expr(_SIDE).alias("body"))
    return docs.select("doc_id", files.parse_sidecar(c("body")).alias("s")).select("doc_id", "s.bpm", "s.keyscale")


@query("q110_file_sizes", f"SELECT doc_id, {r_sql('(n_chars * 997)::DOUBLE / 1024 / 1024', 2)} AS filesize_mb FROM documents")
def file_sizes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", classify.filesize_mb(c("n_chars") * 997).alias("filesize_mb"))
