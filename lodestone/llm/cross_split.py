"""Same or nearly same questions across splits, by compressed full-text indexes of evaluation shards.

Questions of one side with the same words in the same order and the same relevant ids are a class, named by
its smallest id; from here on a class is one question.

A question is routed by keys: one for its whole word sequence, and one for each pair of a relevant id and
a word of its prefix (two questions that share ``share`` of their distinct words share one of the first
``n - ceil(share * n) + 1`` words of each, in any fixed order; longer words come first). Evaluation
questions with the same key lie in one shard; keys of very many questions are cut into tiles of at most
about ``tile`` questions a side, each with its own number, so no shard grows with a hot key.

Each shard's evaluation questions become an FM-index over symbols: separator, the question's keys,
separator, its words, separator. The shard's training questions stream through backward search: their
keys give the candidate questions, the bracketed word sequence gives the equal ones, and the maximal
matches of their words give the spans that evaluation text covers. Candidates are then decided exactly.

Maximal matches alone can't give the candidates of near pairs: those share a set of words, in any order, and
a question whose words lie in shorter runs than another question's is never where a maximal match is
located. The keys are therefore part of the index's text, and found in it by the same backward search.

Defined cases: null and blank texts have no words and match nothing. A null, blank or unknown split counts
as training. Null and empty lists of relevant ids share nothing. Re-delivered rows count once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import batch
from ..session import durable, shuffle_width
from .fm_index import FMIndex, spread_ranges

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class OverlapSettings:
    share: float = 0.6
    tile: int = 2000
    shard_rows: int = 40_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def reduced_split(split: Column) -> Column:
    """``heldout`` or ``tune`` of the split reduced to its letters."""
    letters = F.regexp_replace(F.lower(split), r"[^\p{L}]", "")
    return F.when(letters == "heldout", F.lit("heldout")).otherwise(F.lit("tune"))


def routing_keys(words: list[str], relevant: list[str] | None, share: float) -> list[str]:
    if not words:
        return []
    distinct = sorted(set(words), key=lambda w: (-len(w), w))
    prefix = distinct[: len(distinct) - math.ceil(share * len(distinct) - 1e-9) + 1]
    ids = sorted({r for r in relevant or () if r})
    return ["=" + " ".join(words), *(f"{r}\x1f{w}" for r in ids for w in prefix)]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and relevant ids of each question, and two hashes of its class."""
    strings = pa.list_(pa.string())
    for b in batches:
        ids, texts, relevant, held = (c.to_pylist() for c in b.columns)
        words = [words_of(t) for t in texts]
        named = [sorted({r for r in own or () if r}) for own in relevant]
        whole = np.array([f"{h}\x1e" + "\x1f".join(w) + "\x1e" + "\x1f".join(n) for h, w, n in zip(held, words, named)], object)
        marks = [pd.util.hash_array(whole, hash_key=k, categorize=False).view(np.int64) for k in ("0123456789123456", "6543219876543210")]
        yield batch(("id", "held", "one", "two", "words", "ids"), (pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(marks[0]), pa.array(marks[1]), pa.array(words, strings), pa.array(named, strings)))


def _route(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, held, words, ids in zip(*(c.to_pylist() for c in b.columns)):
                keys = routing_keys(words, ids, share)
                marks = pd.util.hash_array(np.array(keys, object), categorize=False).view(np.int64)
                rows.extend((int(k), i, held, words, ids) for k in marks)
            if rows:
                key, i, held, words, ids = zip(*rows)
                strings = pa.list_(pa.string())
                yield batch(("key", "id", "held", "words", "ids"), (pa.array(key, pa.int64()), pa.array(i, pa.int64()), pa.array(held, pa.bool_()), pa.array(words, strings), pa.array(ids, strings)))

    return run


class _Shard:
    """The evaluation side of a shard."""

    def __init__(self, held: pd.DataFrame):
        first = held.drop_duplicates("id")
        self.ids, self.words, self.relevant = first["id"].to_numpy(), list(first["words"]), list(first["ids"])
        keys: dict[int, list[int]] = {}
        for i, k in zip(held["id"], held["key"]):
            keys.setdefault(i, []).append(k)
        self.number: dict = {}
        number = lambda x: self.number.setdefault(x, len(self.number) + 1)
        parts, self.starts, at = [], [], 0
        #: A mark of its own stands at both ends of a word sequence.
        self.edge = number(("edge",))
        for i, words in zip(self.ids, self.words):
            own = [*(number(k) for k in sorted(set(keys[i]))), 0, self.edge, *(number(w) for w in words), self.edge, 0]
            parts.append(own)
            self.starts.append(at)
            at += len(own)
        self.starts = np.array(self.starts)
        self.index = FMIndex(np.array([s for p in parts for s in p], np.int64), len(self.number) + 1)

    def questions(self, rows: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, self.index.locate(rows), side="right") - 1


def _shard_pairs(share: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held, train = rows[rows["held"]], rows[~rows["held"]]
        columns = ["id", "other", "kind", "common", "either", "longest_run", "covered"]
        if held.empty or train.empty:
            return pd.DataFrame({c: [] for c in columns}).astype({c: "str" if c == "kind" else "int64" for c in columns})
        shard = _Shard(held)
        own = train.drop_duplicates("id")
        texts, relevant = dict(zip(own["id"], own["words"])), dict(zip(own["id"], own["ids"]))
        # keys: candidates
        known = train[train["key"].isin(shard.number.keys())]
        symbols = np.array([shard.number[k] for k in known["key"]], np.int64).reshape(-1, 1)
        lo, hi = shard.index.search(symbols)
        rows, which = spread_ranges(lo, hi)
        pairs = pd.DataFrame({"id": known["id"].to_numpy()[which], "place": shard.questions(rows)}).drop_duplicates()
        # words: maximal matches, merged into spans
        ids = sorted(set(pairs["id"]))
        stream, begin = [0], {}
        for i in ids:
            begin[i] = len(stream)
            stream += [*(shard.number.get(w, 0) for w in texts[i]), 0]
        match = shard.index.maximal(np.array(stream, np.int64))
        spans = {i: _merged(match[begin[i] : begin[i] + len(texts[i])]) for i in ids}
        # whole sequences between their edges
        equal = set()
        by_length: dict[int, list] = {}
        for i in ids:
            p = [shard.edge, *(shard.number.get(w, 0) for w in texts[i]), shard.edge]
            if 0 not in p:
                by_length.setdefault(len(p), []).append((i, p))
        for group in by_length.values():
            lo, hi = shard.index.search(np.array([p for _, p in group], np.int64))
            rows, which = spread_ranges(lo, hi)
            equal.update(zip((group[w][0] for w in which), shard.questions(rows).tolist()))
        out = []
        for i, place in zip(pairs["id"], pairs["place"]):
            a, b = set(texts[i]), set(shard.words[place])
            common = len(a & b)
            if (i, place) in equal:
                kind = "same"
            elif common >= share * len(a | b) - 1e-9 and set(relevant[i]) & set(shard.relevant[place]):
                kind = "near"
            else:
                continue
            out.append((int(shard.ids[place]), int(i), kind, common, len(a | b), *spans[i]))
        return pd.DataFrame(out, columns=columns)

    return run


def _merged(match: np.ndarray) -> tuple[int, int]:
    """Longest maximal match, and how many words lie in any of at least two words."""
    cover = np.zeros(len(match) + 1, np.int64)
    for end in np.nonzero(match > 1)[0]:
        cover[end + 1 - match[end]] += 1
        cover[end + 1] -= 1
    return int(match.max(initial=0)), int((np.cumsum(cover[:-1]) > 0).sum())


def class_overlaps(df: DataFrame, id_col: str, text_col: str, relevant_col: str, split_col: str, s: OverlapSettings = OverlapSettings()) -> tuple[DataFrame, DataFrame]:
    """One row per pair of a held-out (``id``) and a training class (``other``) that are the ``same`` word
    sequence or ``near``: their common and all distinct words, the longest run of the training question's
    words found in its shard's evaluation text and how many of its words such runs cover. And the
    ``members`` ``id, rep, n`` of all classes, with the class's size."""
    spark = df.sparkSession
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(relevant_col).alias("relevant"),
        (reduced_split(F.col(split_col)) == "heldout").alias("held"),
    ).where("id is not null").dropDuplicates(["id"])
    strings = "words array<string>, ids array<string>"
    read = durable(rows.mapInArrow(_read, f"id long, held boolean, one long, two long, {strings}").where(F.size("words") > 0))
    classes = durable(read.groupBy("one", "two").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.min_by(F.struct("held", "words", "ids"), "id").alias("q")))
    members = read.select("id", "one", "two").join(classes.select("one", "two", "rep", "n"), ["one", "two"]).select("id", "rep", "n")
    asked = classes.select(F.col("rep").alias("id"), "q.held", "q.words", "q.ids")
    routed = durable(asked.mapInArrow(_route(s.share), f"key long, id long, held boolean, {strings}"))
    # keys that both sides have; how often, for the tiles
    sides = routed.groupBy("key").agg(F.count_if("held").alias("nh"), F.count_if(~F.col("held")).alias("nt")).where("nh > 0 and nt > 0")
    tiles = sides.select("key", F.ceil(F.col("nh") / s.tile).cast("int").alias("th"), F.ceil(F.col("nt") / s.tile).cast("int").alias("tt"))
    placed = routed.join(tiles, "key")
    mine = F.col("held")
    own = F.pmod(F.xxhash64("id"), F.when(mine, F.col("th")).otherwise(F.col("tt")))
    placed = placed.withColumn("own", own).withColumn("partner", F.explode(F.sequence(F.lit(0), F.when(mine, F.col("tt")).otherwise(F.col("th")) - 1)))
    tile = F.when(mine, F.struct("own", "partner")).otherwise(F.struct(F.col("partner").alias("own"), F.col("own").cast("int").alias("partner")).cast("struct<own:bigint,partner:int>"))
    placed = placed.select(F.xxhash64("key", tile).alias("key"), "id", "held", "words", "ids")
    placed = durable(placed)
    shards = max(shuffle_width(spark), math.ceil(placed.count() / s.shard_rows))
    pairs = placed.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").applyInPandas(
        _shard_pairs(s.share), "id long, other long, kind string, common long, either long, longest_run long, covered long"
    )
    best = [F.max(c).alias(c) for c in ("kind", "common", "either", "longest_run", "covered")]
    return pairs.groupBy("id", "other").agg(*best), members


def expanded(pairs: DataFrame, members: DataFrame, block: int = 1024) -> DataFrame:
    """``pairs`` of classes as pairs of all their members, in blocks of about ``block`` members a class."""
    slots = members.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("slot", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sizes = durable(slots.select("rep", "blocks").distinct())
    rest = [c for c in pairs.columns if c not in ("id", "other")]
    one = pairs.join(sizes.toDF("id", "na"), "id").join(sizes.toDF("other", "nb"), "other")
    one = one.withColumn("sa", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("sb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    mine = slots.select(F.col("rep").alias("id"), F.col("slot").alias("sa"), F.col("id").alias("a"))
    theirs = slots.select(F.col("rep").alias("other"), F.col("slot").alias("sb"), F.col("id").alias("b"))
    return one.join(mine, ["id", "sa"]).join(theirs, ["other", "sb"]).select(F.col("a").alias("id"), F.col("b").alias("other"), *rest)


def overlaps(df: DataFrame, id_col: str, text_col: str, relevant_col: str, split_col: str, s: OverlapSettings = OverlapSettings()) -> DataFrame:
    """The pairs of :func:`class_overlaps` for all members of the classes."""
    pairs, members = class_overlaps(df, id_col, text_col, relevant_col, split_col, s)
    return expanded(durable(pairs), members)
