"""Every query with SQL equals DuckDB on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from quarry.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(table, names):
    return sorted(map(repr, zip(*(table[n].to_pylist() for n in names), strict=True)))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toArrow()
    want = duck.sql(catalogue.oracle_sql()[name]).to_arrow_table()
    names = sorted(want.column_names)
    assert sorted(got.column_names) == names and rows(got, names) == rows(want, names)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_analysis_bundle(spark):
    from quarry.plans.analyze import analyze
    from quarry.sources.adapters import images

    report = analyze(images(spark, SF), spark.read.parquet(f"{SF}/embeddings.parquet"))
    total = report.summary.first()["total"]
    assert total == report.images.count() and report.coverage.count() == 6 and report.aspects.count() == 5 and report.advice.count() > 0


@pytest.fixture(scope="module")
def small_set(spark):
    """Twelve usable images of which all wear a hat, ten stand in a room, three look alike, and one that is not usable."""
    from pyspark.sql import functions as F

    from quarry.sources.adapters import images

    base = images(spark, SF).limit(1).drop("image_id", "tags")
    ids = spark.range(1, 14).select(F.col("id").alias("image_id"), F.when(F.col("id") <= 10, "red hat, a room").when(F.col("id") <= 12, "red hat").otherwise("neon").alias("tags"))
    plain = {"w": 1024, "h": 1024, "sharp": 200.0, "bright": 100.0, "contrast": 50.0, "faces": 1, "prop": 10.0, "yaw": 0.0, "ref_sim": 0.9, "avg_sim": 0.9, "duplicate": False, "artifacts": "none", "ai_score": 0.0, "phash": None, "joy": "", "natural": None, "expression": "laughing"}
    rows = ids.crossJoin(base).withColumns({k: F.lit(v).cast(base.schema[k].dataType) for k, v in plain.items()})
    rows = rows.withColumn("sharp", F.when(F.col("image_id") == 13, 1.0).otherwise(F.col("sharp")))
    bodies = [(i, [float(i == k) for k in range(13)]) for i in range(10)] + [(i, [1.0] + [0.0] * 12) for i in (10, 11)] + [(12, None)]
    return rows, spark.createDataFrame(bodies, "vec_id long, embedding array<double>")


def test_analysis_computes_diversity(spark, small_set):
    from quarry.plans.analyze import analyze

    rows, bodies = small_set
    full, alone, legacy = analyze(rows, bodies=bodies), analyze(rows), analyze(rows, bodies=bodies, legacy_stats=True)
    # 10 clusters of 12: 83; two overfit categories: 70
    assert tuple(full.diversity.first()) == (10, 2, 77.0, "excellent") and tuple(alone.diversity.first()) == (None, 2, 70.0, "good")
    score = [{r.family: r.score for r in x.scores.collect()} for x in (full, alone, legacy)]
    # 15 of 77 and 14 of 70, with 10 for square images; legacy has 10 of 50 and none for these
    assert [s["sdxl_classic"] - score[2]["sdxl_classic"] for s in score] == [15, 14, 0]
    bare = analyze(rows.drop("tags").withColumn("tags", rows["joy"]))
    assert tuple(bare.diversity.first()) == (None, None, None, None) and bare.scores.count() == 5


def test_analysis_gives_all_advice(spark, small_set):
    from quarry.plans.advice import ORDER
    from quarry.plans.analyze import analyze

    rows, bodies = small_set
    got = [tuple(r) for r in analyze(rows, bodies, bodies=bodies).advice.orderBy("ord").collect()]
    assert [r[0] for r in got] == list(range(1, len(got) + 1)) and {r[1] for r in got} <= set(ORDER)
    want = [
        ("duplicates", 2, None), ("captions", 13, None), ("reference_ok", 13, "0.9"), ("face_coherence_low", 12, "0.045"), ("body_coherence_low", 11, "0.018"), ("blurry", 1, None), ("sharp_fair", 13, None), ("viability", 10, "10/0/3"),
        ("too_few_viable", 10, None), ("expressions", 1, "laughing"), ("expression_dominant", 10, "laughing"), ("small_set", 13, None), ("best_target", 82, "sdxl_classic A"), ("diversity_ok", 77, "excellent: accessory, background"),
        ("cluster", 3, "0, 10, 11"), ("square_only", 10, None), ("overfit", 1, "accessory: red hat (100%)"), ("overfit", 1, "background: a room (90%)"),
    ]
    assert [r[1:] for r in got if r[1] != "next_shot"] == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
