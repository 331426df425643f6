"""How values are shown: number formats, marks for what is missing, bands and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.numeric import cascade, half_up

#: How many characters of a text each view keeps.
PREFIX = {"live_tags": 200, "summary": 300, "manifest": 500, "file_name": 80, "advice": 60}


def number(x: Column, digits: int, sign: bool = False, after: str = "", missing: str = "-") -> Column:
    """``x`` with so many decimals, rounded half up, a sign if wanted; ``missing`` for null."""
    shown = F.format_string(f"%{'+' if sign else ''}.{digits}f", half_up(x, digits))
    return F.when(x.isNull(), missing).otherwise(F.concat(shown, F.lit(after)))


def share(x: Column) -> Column:
    """A percentage with one decimal; null and zero are missing."""
    return F.when(F.coalesce(x, F.lit(0)) == 0, "-").otherwise(number(x, 1, after="%"))


def prefix(x: Column, view: str) -> Column:
    """The first characters of a text, as many as a view keeps; null is empty."""
    return F.substring(F.coalesce(x, F.lit("")), 1, PREFIX[view])


def table_row(rows_w: Column, rows_h: Column, sharp: Column, faces: Column, proportion: Column, yaw: Column, expression: Column, face: Column, body: Column) -> Column:
    """The cells of an image's row in a report, in order."""
    text = lambda x, missing: F.coalesce(x.cast("string"), F.lit(missing))
    return F.array(
        F.concat(text(rows_w, "?"), F.lit("x"), text(rows_h, "?")), number(sharp, 0), text(faces, "?"), share(proportion), number(yaw, 0, sign=True), F.coalesce(F.nullif(expression, F.lit("")), F.lit("-")),
        number(face, 2), number(body, 2, missing="NA"),
    )


def sharpness_band(sharp: Column) -> Column:
    return cascade((sharp >= 200, "good"), (sharp >= 100, "fair"), otherwise="poor")


def ai_band(score: Column, live: bool = False) -> Column:
    """Bands of a machine-made score; the live view has one step at 0.5."""
    return cascade((score > 0.5, "high"), otherwise="low") if live else cascade((score > 0.7, "high"), (score > 0.4, "medium"), otherwise="low")


def diversity_band(score: Column) -> Column:
    return cascade((score >= 70, "good"), (score >= 50, "fair"), otherwise="poor")


def grade_colour(grade: Column) -> Column:
    return cascade((grade.startswith("A"), "green"), (grade.startswith("B"), "yellow"), (grade.startswith("C"), "orange"), otherwise="red")


def row_colour(viable: Column) -> Column:
    return cascade((viable == "yes", "green"), (viable == "borderline", "yellow"), otherwise="red")
