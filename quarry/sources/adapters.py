"""The image-feature relation, derived from ``documents`` so that every rule has rows on both of its sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import classify

#: (column, expression) understood alike by Spark SQL and DuckDB; n is n_chars, D is the double type.
_COLUMNS = (
    ("image_id", "doc_id"),
    ("name", "concat('img_', CAST(doc_id AS {S}), '.png')"),
    ("w", "256 + (n_chars * 37) % 1537"),
    ("h", "256 + (n_chars * 91) % 1537"),
    ("sharp", "((n_chars * 7) % 6000) / CAST(10 AS DOUBLE)"),
    ("bright", "((n_chars * 13) % 2560) / CAST(10 AS DOUBLE)"),
    ("contrast", "((n_chars * 17) % 800) / CAST(10 AS DOUBLE)"),
    ("faces", "CASE WHEN n_chars % 17 = 0 THEN 0 WHEN n_chars % 19 = 0 THEN 2 ELSE 1 END"),
    ("prop", "((n_chars * 11) % 300) / CAST(10 AS DOUBLE)"),
    ("yaw", "((n_chars * 29) % 1801) / CAST(10 AS DOUBLE) - 90"),
    ("ref_sim", "CASE WHEN n_chars % 7 = 0 THEN NULL ELSE ((n_chars * 31) % 1000) / CAST(1000 AS DOUBLE) END"),
    ("avg_sim", "((n_chars * 43) % 1000) / CAST(1000 AS DOUBLE)"),
    ("duplicate", "n_chars % 31 = 0"),
    ("artifacts", "CASE WHEN n_chars % 23 = 0 THEN 'high' WHEN n_chars % 29 = 0 THEN 'medium' ELSE 'none' END"),
    ("joy", "CASE WHEN n_chars % 5 = 0 THEN text ELSE '' END"),
    ("natural", "CASE WHEN n_chars % 3 = 0 THEN text END"),
    ("tags", "CASE WHEN n_chars % 11 = 0 THEN '' ELSE replace(lower(text), ' ', ', ') END"),
    ("phash", "(n_chars * 2654435761) % 1048576"),
    ("expression", "CASE n_chars % 7 WHEN 0 THEN 'neutral expression' WHEN 1 THEN 'slight smile' WHEN 2 THEN 'big smile with teeth' WHEN 3 THEN 'laughing' WHEN 4 THEN 'serious focused look' WHEN 5 THEN 'surprised' ELSE 'sad' END"),
    ("ai_score", "((n_chars * 53) % 1000) / CAST(1000 AS DOUBLE)"),
    ("lang", "lang"),
    ("source", "source"),
    ("n_chars", "n_chars"),
)

IMG_SQL = "SELECT " + ", ".join(f"{e.format(S='VARCHAR')} AS {n}" for n, e in _COLUMNS) + " FROM documents"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.selectExpr(*(f"{e.format(S='STRING')} AS {n}" for n, e in _COLUMNS))


def judged(img: DataFrame) -> DataFrame:
    """With megapixels, framing, reasons and viability."""
    c = F.col
    out = img.withColumns({"mp": classify.megapixels(c("w"), c("h")), "shot": classify.shot_type(c("faces"), c("prop"))})
    out = out.withColumn("reasons", classify.viability_reasons(c("duplicate"), c("artifacts"), c("sharp"), c("mp"), c("faces"), c("ref_sim"), c("avg_sim"), c("prop"), c("yaw"), c("bright")))
    return out.withColumn("viable", classify.viability(c("reasons"), c("bright"), c("ref_sim"), c("avg_sim")))


def r_sql(x: str, digits: int) -> str:
    return f"(floor(({x}) * CAST({10**digits} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST({10**digits} AS DOUBLE))"


_LATE = "dup_c IS NULL AND art_c IS NULL AND sharp_c IS NULL AND mp_c IS NULL AND face_c IS NULL AND ref_c IS NULL AND prop_c IS NULL AND yaw_c IS NULL AND dark_c IS NULL"
#: The judged relation in SQL, written as one code column for each rule.
JUDGED_SQL = f"""
WITH img AS ({IMG_SQL}),
m AS (SELECT *, {r_sql("CAST(w AS DOUBLE) * CAST(h AS DOUBLE) / CAST(1000000 AS DOUBLE)", 2)} AS mp,
  CASE WHEN faces = 0 THEN 'body_only' WHEN prop >= 15 THEN 'face_only' WHEN prop >= 2 THEN 'both' ELSE 'body_only' END AS shot FROM img),
c AS (SELECT *,
  CASE WHEN duplicate THEN 'duplicate' END AS dup_c,
  CASE artifacts WHEN 'high' THEN 'artifacts_high' WHEN 'medium' THEN 'artifacts_medium' END AS art_c,
  CASE WHEN sharp < 100 THEN 'blurry' END AS sharp_c,
  CASE WHEN mp < 0.4::DOUBLE THEN 'low_res' END AS mp_c,
  CASE WHEN faces = 0 THEN 'no_face' WHEN faces > 1 THEN 'many_faces' END AS face_c,
  CASE WHEN ref_sim < 0.35::DOUBLE THEN 'wrong_person' WHEN ref_sim < 0.5::DOUBLE THEN 'doubtful_person' WHEN ref_sim IS NULL AND avg_sim < 0.3::DOUBLE THEN 'outlier_face' END AS ref_c,
  CASE WHEN prop > 0 AND prop < 1 THEN 'tiny_face' END AS prop_c,
  CASE WHEN abs(yaw) > 75 THEN 'extreme_angle' WHEN abs(yaw) > 50 THEN 'strong_angle' END AS yaw_c,
  CASE WHEN bright < 40 THEN 'dark' END AS dark_c,
  bright > 220 AS over, ref_sim IS NULL AND avg_sim >= 0.3::DOUBLE AND avg_sim < 0.5::DOUBLE AS weak FROM m),
j AS (SELECT *,
  CASE WHEN dup_c IS NOT NULL OR art_c = 'artifacts_high' OR sharp_c IS NOT NULL OR mp_c IS NOT NULL OR face_c IS NOT NULL OR ref_c IN ('wrong_person', 'outlier_face') OR yaw_c = 'extreme_angle' OR dark_c IS NOT NULL THEN 'no'
       WHEN art_c = 'artifacts_medium' OR ref_c = 'doubtful_person' OR prop_c IS NOT NULL OR yaw_c = 'strong_angle' OR over OR weak THEN 'borderline' ELSE 'yes' END AS viable,
  coalesce(nullif(concat_ws(';', dup_c, art_c, sharp_c, mp_c, face_c, ref_c, prop_c, yaw_c, dark_c,
    CASE WHEN {_LATE} AND over THEN 'overexposed' WHEN {_LATE} AND weak THEN 'weak_face' END), ''), 'ok') AS reason_codes FROM c)
"""
