"""Exact dense retrieval: queries and vectors of a part meet in tiles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalised
from ..session import durable
from .tiles import DOCUMENTS, QUERIES, tiles

#: Scores that a task holds at once: 32 MB.
BLOCK_NUMBERS = 4_000_000
#: Vectors and queries of a tile.
TILE_VECTORS, TILE_QUERIES = DOCUMENTS, QUERIES


def usable(vector: Column, dim: int) -> Column:
    """Of the given length, without null, NaN or infinite values, and not all zero."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column, at length 1."""
    rows = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _tile(k: int):
    """The ``k`` best documents of a tile for each of its queries, by their best part."""

    def run(key: tuple, parts: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if len(parts) and len(asked):
            docs, no = parts.column("doc").to_numpy(), parts.column("part_no").to_numpy()
            # by document, then part: the first of equal scores is the smaller part
            order = np.lexsort((no, docs))
            docs, no, vectors = docs[order], no[order], _unit(parts.column("vector"))[order]
            own, starts = np.unique(docs, return_index=True)
            ends = np.append(starts[1:], len(docs))
            qids, q = asked.column("qid").to_numpy(), _unit(asked.column("vector"))
            step = max(1, BLOCK_NUMBERS // len(docs))
            for lo in range(0, len(qids), step):
                scores = np.round(q[lo : lo + step] @ vectors.T, 5) + 0.0
                best = np.maximum.reduceat(scores, starts, axis=1)
                keep = best >= np.partition(best, -k, axis=1)[:, -k][:, None] if k < best.shape[1] else np.ones_like(best, bool)
                row, col = np.nonzero(keep)
                at, top = starts[col], best[row, col]
                for _ in range(int((ends - starts).max()) - 1):
                    at = np.where(scores[row, at] == top, at, at + 1)
                found.append((qids[lo + row], own[col], no[at], top))
        qid, doc, part_no, cosine = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.float64))
        return pa.table({"part": pa.array([key[0].as_py()] * len(qid), pa.string()), "qid": qid, "doc": doc, "part_no": part_no, "cosine": cosine})

    return run


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("part", F.col("qid").cast("long").alias("qid"), normalised(F.col("vector")).alias("vector"))


def dense(parts: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """``part, qid, doc, part_no, cosine, dense_rank``: the ``n`` documents of a query's part whose best
    vector is nearest by cosine. ``parts`` has part (string), doc, part_no, vector; ``queries`` part, qid,
    vector, all vectors usable. Cosines are rounded to 5 digits before they are ranked; among a document's
    vectors ties go to the smaller number, among documents to the smaller ``doc``.

    Vectors are moved once to the tiles of their part, all of a document to the same; what is shuffled then
    are the best ``n`` of each tile.
    """
    held = durable(parts.where("part is not null").select("part", F.col("doc").cast("long").alias("doc"), F.col("part_no").cast("int").alias("part_no"), "vector"))
    asked = durable(queries.where("part is not null").select("part", F.col("qid").cast("long").alias("qid"), "vector"))
    met = tiles(held, asked, held.groupBy("part").agg(F.count("*").alias("n")), asked.groupBy("part").agg(F.count("*").alias("n")), (TILE_VECTORS, TILE_QUERIES))
    best = met.applyInArrow(_tile(n), "part string, qid long, doc long, part_no int, cosine double")
    order = Window.partitionBy("part", "qid").orderBy(F.desc("cosine"), "doc")
    return best.withColumn("dense_rank", F.row_number().over(order)).where(F.col("dense_rank") <= n)


def relevance(parts: DataFrame, queries: DataFrame, key: str = "qid") -> Callable[[DataFrame], DataFrame]:
    """A function from pairs (``key``, item) to ``key, item, relevance``: the cosine of the item's best vector over
    the best of all documents of the query's part, from 0 to 1; 0 where that best isn't positive. Only the
    vectors of the items are looked up. Items without a vector, or of another part, have no row."""
    best = durable(dense(parts, queries, 1).select(F.col("qid").alias(key), F.col("cosine").alias("best")))
    asked = durable(_asked(queries).select("part", F.col("qid").alias(key), F.col("vector").alias("asked")))
    held = parts.select("part", F.col("doc").cast("long").alias("item"), normalised(F.col("vector")).alias("vector"))

    def of(pairs: DataFrame) -> DataFrame:
        dot = F.aggregate(F.zip_with("asked", "vector", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
        rows = pairs.select(key, F.col("item").cast("long").alias("item")).distinct().join(asked, key).join(held, ["part", "item"])
        rows = rows.groupBy(key, "item").agg(F.max(F.round(dot, 5)).alias("cosine")).join(best, key)
        share = F.least(F.greatest(F.col("cosine") / F.col("best"), F.lit(0.0)), F.lit(1.0))
        return rows.select(key, "item", F.when(F.col("best") > 0, share).otherwise(0.0).alias("relevance"))

    return of
