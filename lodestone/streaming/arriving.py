"""Structured streaming: files that arrive are indexed, replies that loop are stopped."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.latest import latest
from ..operators.replies import LoopState
from ..sources.files import Files
from ..sources.store import IndexStore


def index_arrivals(spark: SparkSession, folder: str, store: IndexStore, repository: str, state: str, checkpoint: str) -> StreamingQuery:
    """Parquet files of (path string, source string, delivered timestamp) that come into ``folder`` are
    merged into the table of current files below ``state`` (the last delivery of a path wins), and the index
    is brought up to date with each batch; unchanged chunks keep their vectors. A batch that is delivered
    again after a failure changes nothing. ``state`` holds the table of the last batch and that before it, and
    which of them counts."""
    arriving = spark.readStream.schema("path string, source string, delivered timestamp").parquet(folder)

    def merge(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        files = Files(s, state)
        told = json.loads(files.read("current.json") or "null")
        if told is None or told["batch"] < number:
            held = s.read.parquet(f"{state}/{told['table']}").unionByName(batch) if told else batch
            table = f"files-{number}"
            latest(held, ["path"], "delivered").write.mode("overwrite").parquet(f"{state}/{table}")
            files.write("current.json", json.dumps({"batch": number, "table": table}))
            for name in files.names():
                if name.startswith("files-") and name not in (table, told and told["table"]):
                    files.delete(name)
            told = {"table": table}
        store.build(s.read.parquet(f"{state}/{told['table']}").select("path", "source"), repository)

    return arriving.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_STATE = "length long, line string, tail string, places string, keep long"


def guard_replies(pieces: DataFrame) -> DataFrame:
    """``answer_id, keep`` once for each reply that loops, from a stream of (answer_id long, seq long, piece
    string) whose pieces come in order; ``keep`` is the length to keep. A null piece ends its reply, which is
    then forgotten; of one that loops only that is remembered until then."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        s = LoopState()
        if held.exists:
            length, line, tail, places, keep = held.get
            s = LoopState(length, line, tail, json.loads(places), keep if keep >= 0 else None)
        known = s.keep is not None
        rows = pd.concat(list(frames)).sort_values("seq")
        over = bool(rows["piece"].isna().any())
        if not known and any(s.feed(piece) for piece in rows["piece"].dropna()):
            yield pd.DataFrame({"answer_id": [key[0]], "keep": [s.keep]})
            s = LoopState(keep=s.keep)
        if over:
            if held.exists:
                held.remove()
        else:
            held.update((s.length, s.line, s.tail, json.dumps(s.places), -1 if s.keep is None else s.keep))

    return pieces.where(F.col("answer_id").isNotNull()).groupBy("answer_id").applyInPandasWithState(step, "answer_id long, keep long", _STATE, "append", GroupStateTimeout.NoTimeout)
