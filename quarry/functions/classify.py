"""Row-wise labels of images: quality, framing, identity, viability. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.numeric import cascade, half_up


def megapixels(w: Column, h: Column) -> Column:
    return half_up(w.cast("double") * h.cast("double") / F.lit(1e6), 2)


def filesize_mb(size: Column) -> Column:
    return half_up(size.cast("double") / F.lit(1024.0) / F.lit(1024.0), 2)


def file_key(name: Column, size: Column, modified: Column) -> Column:
    """``name|size|seconds``; the bare name where the file has no status."""
    return F.when(size.isNull() | modified.isNull(), name).otherwise(F.concat_ws("|", name, size.cast("string"), modified.cast("long").cast("string")))


def quality_label(sharp: Column, bright: Column, contrast: Column, mp: Column) -> Column:
    """Flags joined by ' + '; without any, ``very_sharp`` above 500, else ``ok``. Null measures raise no flag."""
    flags = F.concat_ws(" + ", F.when(sharp < 100, "blurry"), F.when(bright < 40, "dark").when(bright > 220, "overexposed"), F.when(contrast < 25, "flat"), F.when(mp < 0.5, "low_res"))
    return cascade((flags != "", flags), (sharp > 500, F.lit("very_sharp")), otherwise="ok")


def shot_type(faces: Column, proportion: Column) -> Column:
    """Framing by the unrounded share of the face in the picture."""
    return cascade((F.coalesce(faces, F.lit(0)) == 0, "body_only"), (proportion >= 15, "face_only"), (proportion >= 2, "both"), otherwise="body_only")


def yaw_of(pose: Column, nose_x: Column, left_eye_x: Column, right_eye_x: Column) -> Column:
    """The pose's yaw, else estimated from key points; null with the eyes at one place."""
    gap = right_eye_x - left_eye_x
    estimate = F.when(gap != 0, (nose_x - (left_eye_x + right_eye_x) / 2) / F.abs(gap) * 90)
    return half_up(F.coalesce(pose, estimate), 1)


def reference_match(similarity: Column) -> Column:
    return cascade((similarity.isNull(), F.lit(None).cast("string")), (similarity >= 0.5, "match"), (similarity >= 0.35, "doubtful"), otherwise="wrong_person")


def face_coherence(shot: Column, faces: Column, average: Column) -> Column:
    return cascade(
        (average.isNull() & (F.coalesce(faces, F.lit(0)) == 0), "no_face"), (average.isNull(), "body_or_back"), (shot == "body_only", "tiny_face"),
        (average < 0.3, "outlier"), (average < 0.5, "weak"), otherwise="ok",
    )


def body_coherence(shot: Column, average: Column) -> Column:
    return cascade((shot == "face_only", "not_applicable"), (average.isNull(), F.lit(None).cast("string")), (average < 0.7, "very_different"), (average < 0.82, "variable"), otherwise="coherent")


def viability_reasons(duplicate: Column, artifacts: Column, sharp: Column, mp: Column, faces: Column, ref: Column, average: Column, proportion: Column, yaw: Column, bright: Column) -> Column:
    """Ordered array of ``code:effect`` with effect ``no`` (out) or ``bl`` (borderline).

    Two rules speak only while nothing before them has: overexposure, and a weak face without reference.
    """
    t = F.lit(True)
    f = lambda c: F.coalesce(c, F.lit(False))
    n_faces, size = F.coalesce(faces, F.lit(0)), F.coalesce(mp, F.lit(1.0))
    turn = F.abs(yaw)
    early = F.array(
        F.when(f(duplicate), "duplicate:no"),
        F.when(f(artifacts == "high"), "artifacts_high:no").when(f(artifacts == "medium"), "artifacts_medium:bl"),
        F.when(f(sharp < 100), "blurry:no"),
        F.when(size < 0.4, "low_res:no"),
        F.when(n_faces == 0, "no_face:no").when(n_faces > 1, "many_faces:no"),
        F.when(f(ref < 0.35), "wrong_person:no").when(f(ref < 0.5), "doubtful_person:bl").when(ref.isNull() & f(average < 0.3), "outlier_face:no"),
        F.when(f((proportion > 0) & (proportion < 1)), "tiny_face:bl"),
        F.when(f(turn > 75), "extreme_angle:no").when(f(turn > 50), "strong_angle:bl"),
        F.when(f(bright < 40), "dark:no"),
    )
    early = F.array_compact(early)
    clean = F.size(early) == 0
    late = F.array_compact(F.array(F.when(clean & f(bright > 220), "overexposed:bl"), F.when(clean & ~f(bright > 220) & ref.isNull() & f((average >= 0.3) & (average < 0.5)), "weak_face:bl")))
    return F.when(t, F.concat(early, late))


def viability(reasons: Column, bright: Column, ref: Column, average: Column) -> Column:
    """``no`` if any rule puts the image out, ``borderline`` if any lowers it - silent rules too - else ``yes``."""
    f = lambda c: F.coalesce(c, F.lit(False))
    lowered = F.exists(reasons, lambda r: r.endswith(":bl")) | f(bright > 220) | (ref.isNull() & f((average >= 0.3) & (average < 0.5)))
    return cascade((F.exists(reasons, lambda r: r.endswith(":no")), "no"), (lowered, "borderline"), otherwise="yes")


def reason_codes(reasons: Column) -> Column:
    return F.when(F.size(reasons) == 0, "ok").otherwise(F.array_join(F.transform(reasons, lambda r: F.substring_index(r, ":", 1)), ";"))


def upscale_candidate(sharp: Column, faces: Column) -> Column:
    return F.coalesce((sharp >= 50) & (sharp < 100) & (faces > 0), F.lit(False))


def aspect_bucket(w: Column, h: Column) -> Column:
    r = w.cast("double") / h.cast("double")
    return cascade((r < 0.5, "tall_portrait"), (r < 0.9, "portrait"), (r <= 1.1, "square"), (r <= 2.0, "landscape"), otherwise="wide_landscape")


def letter(score: Column) -> Column:
    return cascade((score >= 90, "A+"), (score >= 80, "A"), (score >= 70, "B+"), (score >= 60, "B"), (score >= 50, "C"), (score >= 40, "D"), otherwise="F")


def angle_bucket(yaw: Column) -> Column:
    a = F.abs(yaw)
    return cascade((yaw.isNull(), F.lit(None).cast("string")), (a < 15, "front"), (a < 50, "three_quarter"), otherwise="profile")


def severity_tag(verdict: Column) -> Column:
    return cascade((verdict == "yes", "ok"), (verdict == "borderline", "warn"), otherwise="err")


def evaluator_tag(has_face: Column, copycat: Column, similarity: Column) -> Column:
    return cascade((~has_face | F.coalesce(copycat, F.lit(False)), "err"), (similarity < 0.4, "warn"), otherwise="ok")


#: Labels that count as machine-made.
AI_LABELS = ("artificial", "ai", "fake", "synthetic", "sdxl", "generated")


def ai_score(predictions: Column) -> Column:
    """From ``array<struct<label,score>>``: the score of the first machine-made label, else 0."""
    hits = F.filter(predictions, lambda p: F.lower(p["label"]).isin(*AI_LABELS))
    return F.coalesce(F.try_element_at(hits, F.lit(1))["score"], F.lit(0.0))


def ai_label(predictions: Column) -> Column:
    """The label of the highest score; the first of equals."""
    best = F.array_max(F.transform(predictions, lambda p: p["score"]))
    return F.try_element_at(F.filter(predictions, lambda p: p["score"] == best), F.lit(1))["label"]


def select_tags(scored: Column, excluded: tuple[str, ...] = ("1girl", "1boy", "solo"), general: float = 0.35, character: float = 0.85) -> Column:
    """From ``array<struct<tag,category,p>>`` (0 general, 4 character): kept tags by falling p, ties in order."""
    kept = F.filter(scored, lambda t: (((t["category"] == 0) & (t["p"] > general)) | ((t["category"] == 4) & (t["p"] > character))) & ~F.lower(t["tag"]).isin(*excluded))
    ranked = F.array_sort(F.transform(kept, lambda t, i: F.struct((-t["p"]).alias("o"), i.alias("i"), t["tag"].alias("tag"))))
    return F.array_join(F.transform(ranked, lambda t: F.replace(F.replace(t["tag"], F.lit("("), F.lit("\\(")), F.lit(")"), F.lit("\\)"))), ", ")
