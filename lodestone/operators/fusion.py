"""Reciprocal rank fusion and the budget that bounds what an expansion may change."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import batch

RRF_K = 60
PROTECTED, WINDOW, BUDGET = 3, 10, 3
#: Keys whose fused lists leave a worker at once.
SWEPT_ROWS = 64


def fuse(lists: DataFrame, keys: list[str], k: int = RRF_K, unique: bool = False, of: str = "") -> DataFrame:
    """``keys, item, score, best_rank, ranks, fused_rank`` of ranked ``lists`` (keys, source, item,
    item_rank, weight): the sum of weight / (k + rank). An item that comes twice in a list counts with its
    best rank; with ``unique`` none does. Ties go to the better single rank, then to the smaller item. ``k``
    may be a column of ``keys`` by name. ``of`` is a source whose rank becomes the column ``of_rank``. Lists
    that are partitioned by ``keys`` aren't shuffled."""
    base = F.col(k) if isinstance(k, str) else F.lit(k)
    once = lists if unique else lists.groupBy(*keys, "source", "item").agg(F.min("item_rank").alias("item_rank"), F.first("weight").alias("weight"))
    scored = once.groupBy(*keys, "item").agg(
        F.round(F.sum(F.col("weight").cast("double") / (base + F.col("item_rank"))), 9).alias("score"),
        F.min("item_rank").alias("best_rank"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "item_rank")))).alias("ranks"),
        *([F.min(F.when(F.col("source") == of, F.col("item_rank"))).alias("of_rank")] if of else []),
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "best_rank", "item")
    return scored.withColumn("fused_rank", F.row_number().over(order))


def sweep(lists: DataFrame, key: str, configs: list[tuple[int, float]], of: str) -> DataFrame:
    """``config, key, item, score, fused_rank`` of ``fuse`` for each of ``configs`` (k, weight of the source
    ``of``) by its number; the other source weighs 1. ``lists`` has key, source, item (long), item_rank, each item
    once a list. Lists that are partitioned by ``key`` aren't shuffled."""
    side = lambda mine: F.collect_list(F.when((F.col("source") == of) == mine, F.struct("item", F.col("item_rank").cast("int").alias("item_rank"))))
    return sweep_rows(lists.groupBy(key).agg(side(F.lit(True)).alias("a"), side(F.lit(False)).alias("b")), key, configs)


def sweep_rows(rows: DataFrame, key: str, configs: list[tuple[int, float]]) -> DataFrame:
    """``sweep`` of one row a key: key, and the lists ``a`` (which is weighed) and ``b`` as arrays of item and
    item_rank. With a column ``wanted`` (array of items) only these come out, with their rank in ``a`` as
    ``of_rank``; they are ranked among all."""
    wanted = "wanted" in rows.columns
    kind = rows.schema[key].dataType.simpleString()
    out = f"config int, {key} {kind}, item long, score double, fused_rank int" + ", of_rank int" * wanted
    return rows.select(key, "a", "b", *["wanted"] * wanted).mapInArrow(_swept(configs, key), out)


def _swept(configs: list[tuple[int, float]], key: str):
    k, weight = (np.array(x, np.float64)[:, None] for x in zip(*configs))
    number = np.arange(len(configs), dtype=np.int32)[:, None]

    def lists(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
        flat = column.flatten()
        values = [x.to_numpy(zero_copy_only=False) for x in (flat.flatten() if pa.types.is_struct(flat.type) else [flat])]
        ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        for lo, hi in zip([0, *ends], ends):
            yield tuple(x[lo:hi] for x in values)

    def fused(b: pa.RecordBatch) -> pa.RecordBatch:
        found: list[tuple[np.ndarray, ...]] = []
        for mine, other, *only in zip(*(lists(c) for c in b.columns[1:])):
            item, at = np.unique(np.concatenate([mine[0], other[0]]), return_inverse=True)
            ranks = np.full((2, len(item)), np.inf)
            ranks[0, at[: len(mine[0])]], ranks[1, at[len(mine[0]) :]] = mine[1], other[1]
            # by the better rank, then the item: the order of equal scores
            order = np.argsort(ranks.min(axis=0), kind="stable")
            item, ranks = item[order], ranks[:, order]
            score = np.floor((weight / (k + ranks[0]) + 1.0 / (k + ranks[1])) * 1e9 + 0.5) / 1e9
            by = np.argsort(-score, axis=1, kind="stable")
            place = np.broadcast_to(np.arange(1, len(item) + 1, dtype=np.int32), by.shape)
            if only:
                rank = np.empty(by.shape, np.int32)
                np.put_along_axis(rank, by, place, axis=1)
                by = np.broadcast_to(np.flatnonzero(np.isin(item, only[0][0])), (len(configs), np.isin(item, only[0][0]).sum()))
                place = np.take_along_axis(rank, by, axis=1)
            columns = [np.broadcast_to(number, by.shape), item[by], np.take_along_axis(score, by, axis=1), place, *([ranks[0][by]] if only else [])]
            found.append(tuple(c.ravel() for c in columns))
        n = np.fromiter((len(x[0]) for x in found), np.int64, len(found))
        config, item, score, place, *of = (np.concatenate(x) for x in zip(*found))
        keys = b.column(0).take(pa.array(np.repeat(np.arange(len(b)), n)))
        more = [pa.array(np.where(np.isinf(of[0]), 0, of[0]).astype(np.int32), mask=np.isinf(of[0]))] if of else []
        return batch(["config", key, "item", "score", "fused_rank", *["of_rank"] * len(of)], [pa.array(config, pa.int32()), keys, pa.array(item, pa.int64()), pa.array(score), pa.array(place, pa.int32()), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), SWEPT_ROWS):
                yield fused(b.slice(lo, SWEPT_ROWS))

    return run


def apply_budget(base: DataFrame, expanded: DataFrame, keys: list[str], protected: int = PROTECTED, window: int = WINDOW, budget: int = BUDGET) -> DataFrame:
    """``keys, item, final_rank``: the expanded order (keys, item, item_rank), except that the first
    ``protected`` items of ``base`` stay first and that at most ``budget`` items from outside its first
    ``window`` come into the window; the rest follows in expanded order and nothing is lost."""
    b = base.where(F.col("item_rank") <= window).select(*keys, "item", F.col("item_rank").alias("base_rank"))
    return budgeted(expanded.join(b, [*keys, "item"], "full"), keys, protected, window, budget)


def budgeted(rows: DataFrame, keys: list[str], protected: int = PROTECTED, window: int = WINDOW, budget: int = BUDGET) -> DataFrame:
    """``apply_budget`` of rows (keys, item, item_rank, base_rank) that have both ranks, null where the item is
    not in the order or not in the first ``window`` of the base."""
    rows = rows.withColumn("kept", F.coalesce(F.col("base_rank") <= protected, F.lit(False)))
    rows = rows.where(F.col("item_rank").isNotNull() | F.col("kept"))
    by_rank = Window.partitionBy(*keys, "kept").orderBy("item_rank", "item")
    so_far = by_rank.rowsBetween(Window.unboundedPreceding, 0)
    outside = F.col("base_rank").isNull()
    rows = rows.withColumn("n_outside", F.sum(outside.cast("int")).over(so_far))
    rows = rows.withColumn("n_protected", F.sum(F.col("kept").cast("int")).over(Window.partitionBy(*keys)))
    rows = rows.withColumn("admitted", ~F.col("kept") & (~outside | (F.col("n_outside") <= budget)))
    rows = rows.withColumn("place", F.sum(F.col("admitted").cast("int")).over(so_far))
    group = F.when(F.col("kept"), 0).when(F.col("admitted") & (F.col("place") <= F.lit(window) - F.col("n_protected")), 1).otherwise(2)
    rows = rows.withColumn("zone", group)
    order = Window.partitionBy(*keys).orderBy("zone", F.when(F.col("zone") == 0, F.col("base_rank")).otherwise(F.col("item_rank")), "item")
    return rows.select(*keys, "item", F.row_number().over(order).alias("final_rank"))
