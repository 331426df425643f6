"""Queries over embeddings: pairwise statistics, duplicates, clusters, model evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import classify
from quarry.functions.numeric import cascade, half_up
from quarry.functions.vectors import dot
from quarry.operators import aggregates, graph, pairs
from quarry.operators.leaders import similar_leaders
from quarry.plans.registry import query
from quarry.sources.adapters import IMG_SQL, images, r_sql

c = F.col
#: Similarity from which two vectors of the test tables count as linked, and shares of the roles by label.
EDGE = 0.30

_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL)"
_P = f"WITH {_V}, p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id < b.vec_id)"
_E = _P + f", e AS (SELECT i, j FROM p WHERE s >= {EDGE}::DOUBLE)"
_ROLES = f"WITH {_V}, ref AS (SELECT * FROM v WHERE label IN (0, 1, 2)), gen AS (SELECT * FROM v WHERE label BETWEEN 3 AND 6), train AS (SELECT * FROM v WHERE label >= 7)"


def vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding IS NOT NULL")


def roles(spark, sf):
    v = vectors(spark, sf)
    return v.where("label IN (0, 1, 2)"), v.where("label BETWEEN 3 AND 6"), v.where("label >= 7")


@query("q11_face_pairs_topk", _P + f" SELECT i, j, {r_sql('s', 3)} AS sim FROM p ORDER BY s DESC, i, j LIMIT 20")
def top_pairs(spark, sf):
    return pairs.top_pairs(vectors(spark, sf), 20).select("i", "j", half_up(c("sim"), 3).alias("sim"))


_LOO = _P + ", b AS (SELECT i AS id, s FROM p UNION ALL SELECT j, s FROM p)"


@query("q12_leave_one_out_similarity", _LOO + f" SELECT id, {r_sql('avg(s)', 3)} AS average, {r_sql('min(s)', 3)} AS least FROM b GROUP BY id")
def leave_one_out(spark, sf):
    return pairs.leave_one_out(vectors(spark, sf)).select("id", half_up(c("average"), 3).alias("average"), half_up(c("least"), 3).alias("least"))


@query("q13_global_coherence", _P + f" SELECT {r_sql('avg(s)', 3)} AS coherence FROM p")
def coherence(spark, sf):
    return pairs.global_coherence(vectors(spark, sf)).select(half_up(c("coherence"), 3).alias("coherence"))


@query("q14_body_coherence_visible", f"WITH img AS ({IMG_SQL}), {_V}, x AS (SELECT v.* FROM v JOIN img ON v.vec_id = img.image_id WHERE NOT (img.faces > 0 AND img.prop >= 15)), p AS (SELECT list_dot_product(a.e, b.e) AS s FROM x a JOIN x b ON a.vec_id < b.vec_id) SELECT (SELECT count(*) FROM x) AS n, {r_sql('avg(s)', 3)} AS coherence FROM p")
def body_coherence(spark, sf):
    shot = classify.shot_type(c("faces"), c("prop"))
    seen = images(spark, sf).where(shot != "face_only").select(c("image_id").alias("vec_id"))
    return pairs.global_coherence(vectors(spark, sf).join(seen, "vec_id", "left_semi")).select("n", half_up(c("coherence"), 3).alias("coherence"))


_CENTROID = ", m AS (SELECT k AS pos, avg(e[k + 1]) AS x FROM {0}, range(0, 64) r(k) GROUP BY k), ctr AS (SELECT pos, x / sqrt((SELECT sum(x * x) FROM m)) AS x FROM m)"


@query("q15_reference_centroid", _ROLES + _CENTROID.format("ref") + f" SELECT pos::INTEGER AS pos, {r_sql('x', 6)} AS x FROM ctr")
def centroid(spark, sf):
    return aggregates.identity_centroid(roles(spark, sf)[0]).select("pos", half_up(c("x"), 6).alias("x"))


_MATCH = _ROLES + _CENTROID.format("ref") + f""", u AS (SELECT list(x ORDER BY pos) AS u FROM ctr), s AS (SELECT vec_id, list_dot_product(e, u) AS s FROM v, u)
SELECT vec_id, {r_sql('s', 3)} AS sim, CASE WHEN s >= 0.5::DOUBLE THEN 'match' WHEN s >= 0.35::DOUBLE THEN 'doubtful' ELSE 'wrong_person' END AS match FROM s"""


@query("q16_reference_match", _MATCH)
def reference_match(spark, sf):
    ctr = aggregates.identity_centroid(roles(spark, sf)[0]).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("u"))
    rows = vectors(spark, sf).crossJoin(F.broadcast(ctr)).select("vec_id", dot(c("embedding"), c("u")).alias("s"))  # one row
    return rows.select("vec_id", half_up(c("s"), 3).alias("sim"), classify.reference_match(c("s")).alias("match"))


@query("q17_dup_edges", _P + f" SELECT i, j, {r_sql('s', 3)} AS sim FROM p WHERE s >= {EDGE}::DOUBLE")
def dup_edges(spark, sf):
    return pairs.similar_pairs(vectors(spark, sf), EDGE).select("i", "j", half_up(c("sim"), 3).alias("sim"))


_GREEDY = _E.replace("WITH", "WITH RECURSIVE", 1) + """, adj AS (SELECT j AS id, list(i ORDER BY i) AS less FROM e GROUP BY j), ids AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT i AS id FROM e UNION SELECT j FROM e)),
o AS (SELECT ids.id, n, coalesce(less, []::BIGINT[]) AS less FROM ids LEFT JOIN adj ON ids.id = adj.id),
g(n, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.n, CASE WHEN list_has_any(leaders, less) THEN leaders ELSE list_append(leaders, o.id) END FROM g JOIN o ON o.n = g.n + 1),
f AS (SELECT leaders FROM g ORDER BY n DESC LIMIT 1)
SELECT id, CASE WHEN list_contains(leaders, id) THEN id ELSE list_min(list_intersect(leaders, less)) END AS keeper FROM o, f"""


@query("q18_greedy_duplicates", _GREEDY)
def greedy(spark, sf):
    return similar_leaders(vectors(spark, sf), EDGE)


_COMP = _E.replace("WITH", "WITH RECURSIVE", 1) + ", both_ AS (SELECT i, j FROM e UNION SELECT j, i FROM e), r(id, x) AS (SELECT i, i FROM both_ UNION SELECT b.j, r.x FROM r JOIN both_ b ON b.i = r.id)"


@query("q19_components", _COMP + " SELECT id, min(x) AS component FROM r GROUP BY id")
def components(spark, sf):
    return graph.connected_components(pairs.similar_forest(vectors(spark, sf), EDGE))


_HAM = f"""WITH img AS ({IMG_SQL}), k AS (SELECT phash AS h, min(image_id) AS rep, count(*) AS n FROM img WHERE phash IS NOT NULL GROUP BY phash)
SELECT a.rep AS i, b.rep AS j, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance, a.n AS n_i, b.n AS n_j FROM k a JOIN k b ON a.rep < b.rep WHERE bit_count(xor(a.h, b.h)) <= 4"""


@query("q20_hamming_band_join", _HAM)
def hamming(spark, sf):
    return pairs.hamming_pairs(images(spark, sf), 4)


_RF = _ROLES + ", s AS (SELECT g.vec_id AS id, r.vec_id AS ref_id, list_dot_product(g.e, r.e) AS s FROM gen g CROSS JOIN ref r), st AS (SELECT id, avg(s) AS average, max(s) AS greatest, min(s) AS least, arg_max(ref_id, s) AS nearest_id FROM s GROUP BY id)"


@query("q21_rfacesim", _RF + f" SELECT id, {r_sql('average', 3)} AS average, {r_sql('greatest', 3)} AS greatest, {r_sql('least', 3)} AS least, nearest_id FROM st")
def rfacesim(spark, sf):
    ref, gen, _ = roles(spark, sf)
    s = pairs.reference_stats(gen, ref)
    return s.select("id", *(half_up(c(n), 3).alias(n) for n in ("average", "greatest", "least")), "nearest_id")


_GLOBAL = f"{r_sql('avg(average)', 3)} AS mean, {r_sql('CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(average) END', 3)} AS std, {r_sql('min(average)', 3)} AS least, {r_sql('max(average)', 3)} AS greatest"


def global_stats(stats):
    std = F.when(F.count("*") == 1, 0.0).otherwise(F.stddev_samp("average"))
    return stats.agg(half_up(F.avg("average"), 3).alias("mean"), half_up(std, 3).alias("std"), half_up(F.min("average"), 3).alias("least"), half_up(F.max("average"), 3).alias("greatest"))


@query("q22_rfacesim_global", _RF + f" SELECT {_GLOBAL} FROM st")
def rfacesim_global(spark, sf):
    ref, gen, _ = roles(spark, sf)
    return global_stats(pairs.reference_stats(gen, ref))


_NT = _ROLES + ", t AS (SELECT g.vec_id AS id, r.vec_id AS t_id, list_dot_product(g.e, r.e) AS s FROM gen g CROSS JOIN train r), nt AS (SELECT id, first(t_id ORDER BY s DESC, t_id) AS nearest_id, max(s) AS sim FROM t GROUP BY id)"


@query("q23_nearest_train_copycat", _NT + f" SELECT id, nearest_id, {r_sql('sim', 3)} AS sim, sim > {EDGE}::DOUBLE AS copycat FROM nt")
def nearest_train(spark, sf):
    _, gen, train = roles(spark, sf)
    return pairs.nearest(gen, train).select("id", "nearest_id", half_up(c("sim"), 3).alias("sim"), (c("sim") > EDGE).alias("copycat"))


@query("q24_black_hole_ranking", _NT + f" SELECT nearest_id, count(*) AS n, {r_sql('count(*) / (SELECT count(*) FROM nt)::DOUBLE', 2)} AS ratio FROM nt GROUP BY nearest_id ORDER BY n DESC, nearest_id LIMIT 5")
def black_holes(spark, sf):
    _, gen, train = roles(spark, sf)
    counts = aggregates.with_total(pairs.nearest(gen, train).groupBy("nearest_id").agg(F.count("*").alias("n")), "n")
    return counts.orderBy(c("n").desc(), "nearest_id").limit(5).select("nearest_id", "n", half_up(c("n") / c("total"), 2).alias("ratio"))


_VERDICT = _RF + ", t AS (SELECT g.vec_id AS id, r.vec_id AS t_id, list_dot_product(g.e, r.e) AS s FROM gen g CROSS JOIN train r), nt AS (SELECT id, first(t_id ORDER BY s DESC, t_id) AS nearest_id, max(s) AS sim FROM t GROUP BY id)" + f""",
g AS (SELECT {_GLOBAL}, count(*) AS n FROM st), k AS (SELECT count(*) FILTER (WHERE sim > 0.95::DOUBLE) AS copies FROM nt), h AS (SELECT {r_sql('max(n) / sum(n)', 2)} AS top FROM (SELECT count(*)::DOUBLE AS n FROM nt GROUP BY nearest_id)),
sc AS (SELECT *, floor(greatest(0, least(100, greatest(0, (mean - 0.3::DOUBLE) * 200)) - least(30, 5 * copies) - CASE WHEN std < 0.03::DOUBLE AND n >= 10 THEN 15 ELSE 0 END - CASE WHEN top > 0.4::DOUBLE THEN 15 ELSE 0 END) + 0.5::DOUBLE) AS score FROM g, k, h)
SELECT mean, std, copies, top, score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B+' WHEN score >= 55 THEN 'B' WHEN score >= 40 THEN 'C' WHEN score >= 25 THEN 'D' ELSE 'F' END AS grade FROM sc"""


@query("q25_evaluator_verdict", _VERDICT)
def verdict(spark, sf):
    from quarry.plans.evaluate import evaluate

    ref, gen, train = roles(spark, sf)
    return evaluate(gen, ref, train).verdict


@query("q62_expression_argmax", f"WITH {_V}, x AS (SELECT vec_id, unnest(range(0, 7)) AS k, unnest(e[1:7]) AS s FROM v), b AS (SELECT vec_id, first(k ORDER BY s DESC, k) AS best, max(s) AS s FROM x GROUP BY vec_id) SELECT vec_id, best::INTEGER AS best, {r_sql('s', 3)} AS confidence FROM b")
def expression(spark, sf):
    each = F.transform(F.slice("embedding", 1, 7), lambda x, i: F.struct(x.cast("double").alias("s"), (-i).alias("o")))
    return vectors(spark, sf).select("vec_id", F.array_max(each).alias("b")).select("vec_id", (-c("b.o")).cast("int").alias("best"), half_up(c("b.s"), 3).alias("confidence"))


@query("q63_model_udf_stub", f"WITH {_V} SELECT vec_id, embedding, {r_sql('sqrt(list_dot_product(e, e))', 3)} AS length FROM v JOIN embeddings USING (vec_id)")
def model_stub(spark, sf):
    from quarry.functions.providers import REGISTRY, features

    return features(vectors(spark, sf).select("vec_id", "embedding"), REGISTRY["unit_norm"])


@query("q72_cluster_stats", _COMP + ", m AS (SELECT id, min(x) AS component FROM r GROUP BY id) SELECT component, count(*) AS size, array_to_string(list_sort(list(id))[1:5], ',') AS first FROM m GROUP BY component HAVING count(*) >= 3")
def clusters(spark, sf):
    comp = graph.connected_components(pairs.similar_forest(vectors(spark, sf), EDGE))
    return graph.cluster_stats(comp, 0).select("component", "size", F.array_join(F.transform("first", lambda x: x.cast("string")), ",").alias("first"))
