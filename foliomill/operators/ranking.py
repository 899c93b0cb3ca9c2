"""Ordering, numbering and budgets within groups.

A group may hold a large part of all rows, so none is ordered in one task: a coarse
expression, which must not decrease in the order, splits every group into ranges. Counts
and sums of the ranges give each its offset, and rows are ordered within ranges only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.operators.store import latest

#: Consecutive numbers that share a range.
RANGE = 1024
#: The range of rows without a number; they come last.
LAST = 1 << 40


def ranges(number: Column, then: Column | None = None) -> Column:
    """The range of an ascending integer, nulls last; rows without a number, however many,
    are split by the integer that orders them next."""
    last = F.lit(LAST) if then is None else F.lit(LAST) + F.coalesce(F.floor(then / RANGE), F.lit(LAST))
    return F.coalesce(F.floor(number / RANGE), last).cast("long")


def _with_offsets(rows: DataFrame, group: str, coarse: Column, size: Column) -> DataFrame:
    """Rows with ``_c``, their range, and ``_n0`` and ``_s0``, the number and size of the
    rows of the group in earlier ranges."""
    keyed = rows.withColumn("_c", coarse)
    sums = keyed.groupBy(group, "_c").agg(F.count("*").alias("_n"), F.sum(size).alias("_s"))
    before = Window.partitionBy(group).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = sums.select(F.col(group).alias("_g"), F.col("_c").alias("_c2"), total("_n").alias("_n0"), total("_s").alias("_s0"))
    return keyed.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_c") == F.col("_c2"))).drop("_g", "_c2")


def dense_index(rows: DataFrame, group: str, order: list[Column], coarse: Column, name: str = "n") -> DataFrame:
    """Number the rows of each group from one in an order."""
    offset = _with_offsets(rows, group, coarse, F.lit(0))
    within = F.row_number().over(Window.partitionBy(group, "_c").orderBy(*order))
    return offset.withColumn(name, (F.col("_n0") + within).cast("int")).drop("_c", "_n0", "_s0")


def first_occurrences(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, found by aggregation."""
    return latest(rows, key, order)


def within_budget(rows: DataFrame, group: str, order: list[Column], coarse: Column, size: str, bytes_: int, count: int) -> DataFrame:
    """The rows of each group that come before a running sum or number passes a limit,
    with ``running`` and ``n``. Null sizes count as nothing."""
    weight = F.coalesce(F.col(size), F.lit(0))
    offset = _with_offsets(rows, group, coarse, weight)
    w = Window.partitionBy(group, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = offset.withColumn("running", F.col("_s0") + F.sum(weight).over(w)).withColumn("n", F.col("_n0") + F.count("*").over(w))
    return summed.where((F.col("running") <= bytes_) & (F.col("n") <= count)).drop("_c", "_n0", "_s0")
