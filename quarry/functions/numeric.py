"""Rounding and falsy-value rules shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int) -> Column:
    """Round half up on the binary value: the same IEEE steps in any engine."""
    scale = F.lit(float(10**digits))
    return F.floor(x.cast("double") * scale + F.lit(0.5)).cast("double") / scale


def truthy_or(x: Column, other) -> Column:
    """``x`` unless it is null, zero or the empty string."""
    return F.coalesce(F.when((x.cast("string") != "") & (x.cast("string") != "0") & (x.cast("string") != "0.0"), x), F.lit(other) if not isinstance(other, Column) else other)


def cascade(*steps: tuple[Column, object], otherwise=None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in steps:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)
