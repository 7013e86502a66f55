"""Gaps and islands: line ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_numbers(spans: Column, start: Column, end: Column) -> Column:
    """The lines of ``spans``, or of ``start``..``end`` where there are none."""
    of_spans = F.flatten(F.transform(spans, lambda s: F.sequence(s["start_line"], s["end_line"])))
    return F.when(F.size(spans) > 0, F.array_distinct(of_spans)).otherwise(F.sequence(start, end))


def format_ranges(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """``keys, ranges`` of distinct numbers: 1, 2, 3, 7 give ``1-3,7-7``."""
    order = Window.partitionBy(*keys).orderBy(number)
    numbered = rows.select(*keys, number).distinct().withColumn("island", F.col(number) - F.row_number().over(order))
    islands = numbered.groupBy(*keys, "island").agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("lo", "hi"))), lambda r: F.concat_ws("-", r["lo"], r["hi"]))
    return islands.groupBy(*keys).agg(F.array_join(text, ",").alias("ranges"))


def merge_ranges(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """``keys, start, end`` of overlapping or adjacent inclusive ranges made one."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = rows.withColumn("new", (before.isNull() | (F.col(start) > before + 1)).cast("int"))
    numbered = new.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def duplicate_ids(rows: DataFrame, keys: list[str], order: list[str], base: str) -> DataFrame:
    """``chunk_id``: ``base``, with ``~2``, ``~3`` ... for its repeats within ``keys``, in ``order``."""
    n = F.row_number().over(Window.partitionBy(*keys, base).orderBy(*order))
    return rows.withColumn("chunk_id", F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("~"), n)))
