"""Running totals over a global order, without a single-task window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable, shuffle_width


def _add(offsets: dict[tuple[int, str | None], float], group: int | None, value: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now, total = (), 0
        for b in batches:
            values = np.asarray(b.column(value).to_numpy(zero_copy_only=False), np.int64)
            out = np.empty(len(values), np.int64)
            names = b.column(group).dictionary_encode() if group is not None else None
            codes = names.indices.to_numpy(zero_copy_only=False) if names is not None else np.zeros(len(values), np.int64)
            words = names.dictionary.to_pylist() if names is not None else [None]
            edges = np.concatenate([[0], np.nonzero(np.diff(codes))[0] + 1, [len(codes)]])
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                name = words[int(codes[lo])]
                if (name,) != now:
                    now, total = (name,), offsets.get((part, name), 0)
                out[lo:hi] = total + np.cumsum(values[lo:hi])
                total = int(out[hi - 1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "running"])

    return run


def running_total(df: DataFrame, order: list[str], value: str, group: str | None = None) -> DataFrame:
    """``df`` with ``running``: the sum of ``value`` (whole numbers, not null) from the first row of its
    ``group`` to this row, in the order of the columns ``order``, which should be total.

    Rows are range-partitioned by group and order, so a group of any size spreads over partitions. Only
    one sum per partition and group in it reaches the driver: at most partitions plus groups. The values
    of ``group`` must not be null.
    """
    keys = [group, *order] if group else order
    laid = durable(df.repartitionByRange(shuffle_width(df.sparkSession), *keys).sortWithinPartitions(*keys))
    name = F.col(group) if group else F.lit(None).cast("string")
    sums = laid.groupBy(F.spark_partition_id().alias("part"), name.alias("name")).agg(F.sum(value).alias("total")).collect()
    before: dict[str | None, int] = {}
    offsets = {}
    for r in sorted(sums, key=lambda r: r["part"]):
        offsets[r["part"], r["name"]] = before.get(r["name"], 0)
        before[r["name"]] = offsets[r["part"], r["name"]] + r["total"]
    columns = laid.columns
    schema = T.StructType([*laid.schema.fields, T.StructField("running", T.LongType())])
    return laid.mapInArrow(_add(offsets, columns.index(group) if group else None, columns.index(value)), schema)
