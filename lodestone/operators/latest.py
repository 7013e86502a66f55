"""One row per key of re-delivered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Keys with several versions that may be broadcast (about 12 MB); more are joined by a shuffle.
FEW = 500_000


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row of each key with the greatest ``by`` (nulls least; among equals any). Aggregates map-side,
    so a key of very many rows costs no single task."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(by).isNotNull().alias("has"), F.col(by).alias("by"))
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row"))
    return picked.select(*keys, "row.*")


def newest(df: DataFrame, key: str, by: str) -> DataFrame:
    """``latest`` by one key for wide rows: rows of keys that come once stay where they are."""
    several = durable(df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").select("_key"))
    n = several.count()
    if n > FEW:
        return latest(df, [key], by)
    same = F.col(key).eqNullSafe(F.col("_key"))
    once = df.join(F.broadcast(several), same, "left_anti")
    return once.unionByName(latest(df.join(F.broadcast(several), same, "left_semi"), [key], by)) if n else df


def current(df: DataFrame, key: str, by: str) -> DataFrame:
    """``df`` without the rows of which a later version, by ``by`` (nulls first), has the same ``key``. Equal
    versions all stay. Wide columns aren't moved: only the keys are counted, and those of several versions
    looked up. Rows with a null key go."""
    newest = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(by).alias("_top"), F.min(by).alias("_low"), F.count("*").alias("_n"), F.count(by).alias("_known"))
    several = durable(newest.where("_top > _low or (_known > 0 and _known < _n)").select("_key", "_top"))
    n = several.count()
    if not n:
        return df.where(F.col(key).isNotNull())
    rows = df.where(F.col(key).isNotNull()).join(F.broadcast(several) if n <= FEW else several, F.col(key) == F.col("_key"), "left")
    return rows.where(F.col("_key").isNull() | (F.col(by) == F.col("_top"))).drop("_key", "_top")
