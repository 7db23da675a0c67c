"""Running totals and row numbers over whole tables without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.sources.staging import staged


def running_total(rows: DataFrame, group: list[str], order: list[str | Column], amount: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``amount`` over the rows of the same group up to and including this one.

    Rows are dealt out by ranges of (group, order). Each range sums up its own rows, and the ranges' totals, a
    few numbers per range, are joined back as offsets; so a group that holds most of the table is spread over
    all tasks. Rows that tie in ``order`` come in any order.
    """
    by = [*group, *order]
    dealt = staged(rows.withColumn("_amount", amount).repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy(*group, "_range").agg(F.sum("_amount").alias("_total"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    within = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("l._range") == F.col("r._range")
    for g in group:
        same = same & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    joined = dealt.withColumn(name, F.sum("_amount").over(within)).alias("l").join(offsets.alias("r"), same)
    return joined.select(*[F.col(f"l.{c}") for c in rows.columns], (F.col(f"l.{name}") + F.col("r._offset")).alias(name))


def numbered(rows: DataFrame, group: list[str], order: list[str | Column], name: str) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... within each group in ``order``."""
    return running_total(rows, group, order, F.lit(1).cast("long"), name)
