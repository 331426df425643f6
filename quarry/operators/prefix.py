"""Running totals within keys of any size: two levels of prefix sums, so that no key fills a task.

A window over a key runs in one task. Here a key's rows are dealt to blocks of bounded size, each block runs
alone, and what came before a block follows from the blocks' totals, of which a key has few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.scratch import scratch_root, settle

#: Places that one block takes in ``before``.
BLOCK = 1024


def _plus(kind: str, x: Column, y: Column) -> Column:
    """Two parts of a total in one, where a null is nothing."""
    return F.coalesce(x + y, x, y) if kind == "sum" else F.greatest(x, y)


def before(totals: DataFrame, keys: list[str], place: str, parts: dict[str, str], block: int = BLOCK) -> DataFrame:
    """``totals`` with each column of ``parts`` (its kind: sum or max) replaced by that of all rows of lesser ``place`` in its key.

    ``place`` is an integer, one row each in a key; nothing before a row gives null. Blocks of ``block`` places run
    alone, and a second window runs over the blocks' totals: a task holds neither more than ``block`` rows of a key
    nor more than one row a block of it.
    """
    at = F.floor(F.col(place) / F.lit(block))
    rows = totals.withColumn("_block", at)
    each = rows.groupBy(*keys, "_block").agg(*(getattr(F, kind)(c).alias(f"_{c}") for c, kind in parts.items()))
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = each.select(*keys, "_block", *(getattr(F, kind)(f"_{c}").over(over).alias(f"_{c}") for c, kind in parts.items()))
    inner = Window.partitionBy(*keys, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({c: getattr(F, kind)(c).over(inner) for c, kind in parts.items()})
    both = local.join(carry, [*keys, "_block"])
    kept = [c for c in totals.columns if c not in parts]
    return both.select(*kept, *(_plus(kind, F.col(f"_{c}"), F.col(c)).alias(c) for c, kind in parts.items()))


def ranges(rows: DataFrame, order: list[str | Column], parts: int | None = None) -> DataFrame:
    """``rows`` dealt to ranges of ``order`` and settled; ``_range`` numbers them in that order.

    Keys that come first in ``order`` stay together but where they fill whole ranges.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return settle(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), scratch_root(spark, "ranges"), "rows")


def running_count(rows: DataFrame, key: str, order: list[str | Column], name: str = "done", total: str | None = None, ties: list[str | Column] = [], parts: int | None = None) -> DataFrame:
    """``rows`` with the number of rows up to each in its key by ``order``, and with ``total`` the key's rows.

    Rows equal in ``order`` stay in one range, there in the order of ``ties``, and else one after the other.
    A null key is a key. Nulls come first.
    """
    dealt = ranges(rows, [key, *order], parts)
    sums = dealt.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_part")).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_key")
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("_key", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_total"))  # a row for each range of a key
    both = dealt.join(carry, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_part")))
    local = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order, *ties))
    extra = {total: F.col("_total")} if total else {}
    return both.withColumns({name: F.col("_before") + local, **extra}).drop("_key", "_part", "_range", "_before", "_total")
