"""Token budgets: greedy parts and max-min fair shares, as folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy_parts(sizes: Column, budget: Column) -> Column:
    """Inclusive index ranges (0-based) of consecutive items filled up to ``budget``; an item over the
    budget is a part of its own. ``sizes`` is an array of whole numbers, which must not be empty."""
    start = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("done"), F.lit(0).alias("first"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("i"))

    def step(s: Column, x: Column) -> Column:
        full = (s["i"] > s["first"]) & (s["used"] + x > budget)
        part = F.struct(s["first"].alias("first"), (s["i"] - 1).alias("last"))
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(part))).otherwise(s["done"]).alias("done"),
            F.when(full, s["i"]).otherwise(s["first"]).alias("first"),
            F.when(full, x.cast("long")).otherwise(s["used"] + x).alias("used"),
            (s["i"] + 1).alias("i"),
        )

    return F.aggregate(sizes, start, step, lambda s: F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), (s["i"] - 1).alias("last")))))


def fair_shares(rows: DataFrame, keys: list[str], size: str, position: str, budget: Column) -> DataFrame:
    """``share`` of each row: small sizes whole, the rest of the budget split evenly (whole numbers). Sorted
    by size, the first row above its equal share of what is left settles the share of all that follow."""
    order = Window.partitionBy(*keys).orderBy(size, position)
    whole = Window.partitionBy(*keys)
    n, i = F.count("*").over(whole), F.row_number().over(order)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("equal", F.floor((F.greatest(budget, F.lit(0)) - before) / (n - i + 1)).cast("long"))
    over = F.when(F.col(size) > F.col("equal"), F.col("equal"))
    settled = F.first(over, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("share", F.coalesce(settled, F.col(size)).cast("long")).drop("equal")
