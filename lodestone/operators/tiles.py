"""Tiles of a part: some of its documents and some of its queries, of bounded size, which meet in one task.

Each pair of a document and a query of a part meets in one tile, so pairs need not be moved to be ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCUMENTS, QUERIES = 65_536, 2_048
KEYS = ["part", "slice", "parcel"]


def _pieces(sizes: dict[str, int], most: int) -> Column:
    """Pieces of a part by its name, of about ``most`` each."""
    many = [F.lit(x) for part, n in sizes.items() if n > most for x in (part, math.ceil(n / most))]
    return F.coalesce(F.element_at(F.create_map(*many), F.col("part")), F.lit(1)) if many else F.lit(1)


def _large(sizes: DataFrame, most: int) -> Column:
    """``_pieces`` of a table part, n; only parts of more than ``most`` come to the driver."""
    return _pieces({r.part: r.n for r in sizes.where(F.col("n") > most).collect()}, most)


def tiles(documents: DataFrame, queries: DataFrame, documents_of: DataFrame, queries_of: DataFrame, most: tuple[int, int] = (DOCUMENTS, QUERIES)):
    """``documents`` (part, doc, ...) and ``queries`` (part, qid, ...) grouped by tile, to be cogrouped; the
    others have the number ``n`` of documents and of queries of each ``part``."""
    slices, parcels = _large(documents_of, most[0]), _large(queries_of, most[1])
    piece = lambda key, many: F.pmod(F.xxhash64(key), many).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), many - 1))
    left = documents.select("*", piece("doc", slices).alias("slice"), each(parcels).alias("parcel"))
    right = queries.select("*", piece("qid", parcels).alias("parcel"), each(slices).alias("slice"))
    return left.groupBy(*KEYS).cogroup(right.groupBy(*KEYS))
