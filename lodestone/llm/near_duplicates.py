"""Near-duplicate records: an exact similarity join on sets of word shingles.

1. Each record becomes the sorted array of its distinct shingles (64-bit hashes) and a 256-bit signature.
   Records with equal sets form a class; its smallest id stands for it from here on.
2. Two sets of similarity t share a shingle among the first ``size - ceil(t * size) + 1`` of each, in any
   fixed order. The order puts those first that are rare in a bounded sample, which only decides how much
   work is done. Records meet at those shingles. The records that meet at each are counted, all of them: a
   shingle that more than an eighth of ``tile`` records of one size class have is cut into tiles. Size
   classes are so wide that sets of the similarity lie in the same or in neighbouring ones, and a class is
   cut by a hash of the id into bands of about ``tile`` records; only the tiles of two bands whose classes
   may meet exist. So no task compares more than about twice ``tile`` records of a hot shingle at once.
3. A pair that met must pass, in turn: the size ratio, the bound from its places in both prefixes, the
   bound that the signatures' bit counts put on the overlap, and the exact intersection of its arrays.

No pair of different sets at or above the similarity is lost: each bound is a true one.

Defined cases: null texts and texts below ``least`` tokens take no part. Rows that repeat an id count
once. Classes and links come out as all their pairs of records, except that more than ``expand`` records
of exactly equal text are tied to their smallest id, which alone takes part in further pairs.
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

from ..functions.arrow import batch, fixed_binary, matrix
from ..session import durable, shuffle_width

_TOKEN = re.compile(r"[A-Za-z0-9_]+")
SIGNATURE = 256
#: Ids that may be broadcast (4 MB); more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Records of a class that meet others in one block.
BLOCK = 1024


@dataclass(frozen=True)
class JoinSettings:
    similarity: float = 0.8
    shingle: int = 5
    least: int = 1
    tile: int = 1024
    sample: int = 16_384
    common: int = 200_000
    expand: int = 16


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], shingle: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which texts take part, the size of each one's set, and all sets (sorted) in one array."""
    tokens = [_TOKEN.findall(t) if t else [] for t in texts]
    need = max(least, shingle)
    part = [i for i, t in enumerate(tokens) if len(t) >= need]
    lengths = np.array([len(tokens[i]) for i in part], np.int64)
    if not len(part):
        return np.zeros(0, np.int64), lengths, np.zeros(0, np.int64)
    flat = np.array([w.lower() for i in part for w in tokens[i]], dtype=object)
    with np.errstate(over="ignore"):
        codes = pd.util.hash_array(flat, categorize=False)
        n = len(codes) - shingle + 1
        mark = np.zeros(n, np.uint64)
        for i in range(shingle):
            mark = _mixed(mark * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n])
    owner = np.repeat(np.arange(len(part)), lengths)
    inside = np.arange(n) + shingle <= np.cumsum(lengths)[owner[:n]]
    mark, owner = mark[inside].view(np.int64), owner[:n][inside]
    order = np.lexsort((mark, owner))
    mark, owner = mark[order], owner[order]
    new = np.ones(len(mark), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (owner[1:] != owner[:-1])
    mark, owner = mark[new], owner[new]
    return np.array(part), np.bincount(owner, minlength=len(part)), mark


def signatures(sizes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    bits = np.zeros((len(sizes), SIGNATURE), bool)
    bits[np.repeat(np.arange(len(sizes)), sizes), marks.view(np.uint64) % np.uint64(SIGNATURE)] = True
    return np.packbits(bits, axis=1)


def _var_binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and values of a column of int64 arrays in binary form."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return np.diff(offsets) // 8, data.view(np.int64)


def _prepare(s: JoinSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            texts = b.column(1).to_pylist()
            for lo in range(0, len(texts), 2048):
                part, sizes, marks = shingle_sets(texts[lo : lo + 2048], s.shingle, s.least)
                if not len(part):
                    continue
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                with np.errstate(over="ignore"):
                    m = marks.view(np.uint64)
                    same = np.stack([np.add.reduceat(_mixed(m ^ np.uint64(k)), first) for k in (0x1234567, 0x89ABCDE)], 1)
                yield batch(
                    ("id", "text_mark", "size", "same", "signature", "marks"),
                    (pa.array(ids[lo + part]), b.column(2).take(pa.array(lo + part)), pa.array(sizes.astype(np.int32)), fixed_binary(same), fixed_binary(signatures(sizes, marks)), _var_binary(marks, sizes)),
                )

    return run


class _Order:
    """Which shingles of a bounded sample are common, and how often they came."""

    def __init__(self, marks: np.ndarray, s: JoinSettings):
        values, counts = np.unique(marks, return_counts=True)
        keep = counts > 1
        values, counts = values[keep], counts[keep]
        if len(values) > s.common:
            top = np.sort(np.argpartition(-counts, s.common)[: s.common])
            values, counts = values[top], counts[top]
        self.values, self.counts = values, counts

    def rank(self, marks: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.zeros(len(marks), np.int64)
        at = np.minimum(np.searchsorted(self.values, marks), len(self.values) - 1)
        return np.where(self.values[at] == marks, self.counts[at], 0)


#: Bits of a posting's place in its prefix; above them lie two bits for its side of a tile, then the size.
PLACE = 24


def _postings(order: _Order, s: JoinSettings):
    t = s.similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            sizes, marks = _flat(b.column(1))
            owner = np.repeat(np.arange(len(ids)), sizes)
            o = np.lexsort((marks, order.rank(marks), owner))
            marks = marks[o]
            place = np.arange(len(marks)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            prefix = sizes - np.ceil(t * sizes - 1e-9).astype(np.int64) + 1
            take = place < prefix[owner]
            marks, owner, place = marks[take], owner[take], place[take]
            # a little wider than the ratio, so that rounding can't put a class between two sizes that may meet
            classes = np.floor(np.log(np.maximum(sizes, 1)) / math.log(1.0001 / t) if t < 1 else sizes).astype(np.int32)
            meta = (sizes[owner] << (PLACE + 2)) | np.minimum(place, (1 << PLACE) - 1)
            yield batch(("key", "id", "cls", "meta"), (pa.array(marks), pa.array(ids[owner]), pa.array(classes[owner]), pa.array(meta)))

    return run


def _tiled(postings: DataFrame, s: JoinSettings) -> DataFrame:
    """``key, id, meta`` with the postings of hot shingles in tiles. A row of band i meets, in its own class,
    the bands from both sides of i (its own in the tile i, i), and all bands of the classes next to it."""
    counts = postings.groupBy("key", "cls").agg(F.count("*").alias("n")).where(F.col("n") > s.tile / 8)
    bands = F.struct("cls", F.ceil(F.col("n") / s.tile).cast("int").alias("bands"))
    hot = durable(counts.groupBy("key").agg(F.map_from_entries(F.collect_list(bands)).alias("bands")))
    n_hot = hot.count()
    if not n_hot:
        return postings.select("key", "id", "meta")
    # a row of ``hot`` stands for tile / 8 postings and more
    rows = postings.join(F.broadcast(hot) if n_hot <= BROADCAST_IDS // 10 else hot, "key", "left")
    cls = F.col("cls")
    number = lambda c: F.coalesce(F.try_element_at("bands", c), F.lit(1))
    others = lambda c: F.sequence(F.lit(0), number(c) - 1)
    mine = F.pmod(F.xxhash64("id"), number(cls)).cast("int")

    def tile(low: Column, high: Column, i: Column, j: Column, side: Column) -> Column:
        return F.struct(F.xxhash64("key", low, high, i, j).alias("key"), side.cast("long").alias("side"))

    within = F.transform(others(cls), lambda j: tile(cls, cls, F.least(mine, j), F.greatest(mine, j), F.when(mine == j, 0).when(mine < j, 1).otherwise(2)))
    above = F.transform(others(cls + 1), lambda j: tile(cls, cls + 1, mine, j, F.lit(1)))
    below = F.transform(others(cls - 1), lambda j: tile(cls - 1, cls, j, mine, F.lit(2)))
    whole = F.array(F.struct(F.col("key"), F.lit(0).cast("long").alias("side")))
    tiles = F.when(F.col("bands").isNull(), whole).otherwise(F.concat(within, above, below))
    each = rows.select("id", "meta", F.explode(tiles).alias("t"))
    return each.select("t.key", "id", (F.col("meta") + F.shiftleft(F.col("t.side"), PLACE)).alias("meta"))


def _meet(s: JoinSettings):
    """Pairs of ids that share a key and pass the bounds of size and place. Reads rows sorted by key."""
    t = s.similarity

    def pairs(keys: np.ndarray, ids: np.ndarray, meta: np.ndarray) -> np.ndarray:
        end = np.searchsorted(keys, keys, side="right")
        size, side, place = meta >> (PLACE + 2), (meta >> PLACE) & 3, meta & ((1 << PLACE) - 1)
        live, step, out = np.arange(len(keys)), 1, []
        while True:
            live = live[live + step < end[live]]
            if not len(live):
                break
            i, j = live, live + step
            si, sj = size[i], size[j]
            need = np.ceil(t / (1 + t) * (si + sj) - 1e-9)
            reach = 1 + np.minimum(si - place[i] - 1, sj - place[j] - 1)
            ok = (np.minimum(si, sj) >= t * np.maximum(si, sj) - 1e-9) & (reach >= need) & (ids[i] != ids[j])
            ok &= (side[i] == 0) | (side[i] != side[j])
            a, b = ids[i][ok], ids[j][ok]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
            step += 1
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        for b in batches:
            cols = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, b.columns)]
            cut = np.searchsorted(cols[0], cols[0][-1]) if len(cols[0]) else 0
            found = pairs(*(c[:cut] for c in cols))
            rest = [c[cut:] for c in cols]
            if len(found):
                found = np.unique(found, axis=0) if len(found) < 200_000 else found
                yield batch(("a", "b"), (pa.array(found[:, 0]), pa.array(found[:, 1])))
        found = pairs(*rest)
        if len(found):
            yield batch(("a", "b"), (pa.array(found[:, 0]), pa.array(found[:, 1])))

    return run


def _bound(s: JoinSettings):
    """Pairs whose signatures allow the overlap: bits of one that the other lacks stand for shingles that
    aren't common."""
    t = s.similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = (b.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            sa, sb = (matrix(b.column(i), np.uint64, SIGNATURE // 64) for i in (4, 5))
            lack_a, lack_b = (np.bitwise_count(x & ~y).sum(1).astype(np.int64) for x, y in ((sa, sb), (sb, sa)))
            keep = pa.array(np.minimum(na - lack_a, nb - lack_b) >= np.ceil(t / (1 + t) * (na + nb) - 1e-9))
            yield batch(("a", "b"), (b.column(0).filter(keep), b.column(1).filter(keep)))

    return run


def _check(s: JoinSettings):
    t = s.similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            one, two = b.column(0).to_numpy(), b.column(1).to_numpy()
            (na, ma), (nb, mb) = _flat(b.column(2)), _flat(b.column(3))
            fa, fb = np.cumsum(na) - na, np.cumsum(nb) - nb
            keep = []
            for i in range(b.num_rows):
                x, y = ma[fa[i] : fa[i] + na[i]], mb[fb[i] : fb[i] + nb[i]]
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if common >= t * (na[i] + nb[i] - common) - 1e-9:
                    keep.append((one[i], two[i], common / (na[i] + nb[i] - common)))
            if keep:
                a, c, j = zip(*keep)
                yield batch(("a", "b", "similarity"), (pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(j, pa.float64())))

    return run


def _few(ids: DataFrame) -> DataFrame:
    """``ids`` with a broadcast hint if they are few enough; larger ones are shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def similar(df: DataFrame, id_col: str, text_col: str, s: JoinSettings) -> tuple[DataFrame, DataFrame]:
    """Links ``a, b, similarity`` between classes of equal sets (each named by its smallest id, a < b), and
    the ``members`` ``id, rep, copy`` of all classes of two and more; ``copy`` is the smallest id with the same text."""
    spark = df.sparkSession
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and length(text) > 0")
    source = source.withColumn("text_mark", F.unhex(F.md5("text")))
    sets = durable(source.mapInArrow(_prepare(s), "id long, text_mark binary, size int, same binary, signature binary, marks binary"))
    records = sets.count()
    classes = sets.groupBy("same").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last").select("same", "rep")
    marked = durable(sets.select("same", "id", "text_mark").join(classes, "same").groupBy("id", "rep").agg(F.min("text_mark").alias("text_mark")))
    copies = marked.groupBy("rep", "text_mark").agg(F.min("id").alias("copy"))
    members = durable(marked.join(copies, ["rep", "text_mark"]).select("id", "rep", "copy"))
    others = _few(members.where("id <> rep").select("id"))
    reps = sets.join(others, "id", "left_anti").select("id", "size", "signature", "marks")

    every = max(1, records // s.sample)
    sample = sets.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(every)) == 0).select("marks").limit(2 * s.sample).toArrow().combine_chunks()
    order = _Order(_flat(sample.column(0).chunk(0))[1] if sample.num_rows else np.zeros(0, np.int64), s)
    postings = reps.select("id", "marks").mapInArrow(_postings(order, s), "key long, id long, cls int, meta long")
    met = _tiled(postings, s).repartition(max(shuffle_width(spark), math.ceil(records / 20_000)), "key").sortWithinPartitions("key")
    pairs = met.mapInArrow(_meet(s), "a long, b long").distinct()
    signed = reps.select("id", "size", "signature").dropDuplicates(["id"])
    both = pairs.join(signed.toDF("a", "na", "sa"), "a").join(signed.toDF("b", "nb", "sb"), "b")
    able = durable(both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_bound(s), "a long, b long"))

    # the arrays of just those records that are still in a pair
    named = able.select(F.col("a").alias("id")).unionByName(able.select(F.col("b").alias("id"))).distinct()
    mine = reps.select("id", "marks").join(_few(durable(named)), "id", "left_semi").dropDuplicates(["id"])
    both = able.join(mine.toDF("a", "ma"), "a").join(mine.toDF("b", "mb"), "b").select("a", "b", "ma", "mb")
    return both.mapInArrow(_check(s), "a long, b long, similarity double"), members


def expanded_pairs(links: DataFrame, members: DataFrame, expand: int = 16) -> DataFrame:
    """Pairs ``a, b`` of records: all pairs within classes and of linked classes, in blocks of about
    ``BLOCK`` records a class. More than ``expand`` records of equal text take part by their smallest id, to
    which the others are tied."""
    large = durable(members.groupBy("rep", "copy").agg(F.count("*").alias("n")).where(F.col("n") > expand).select("rep", "copy"))
    shown = members.join(large, ["rep", "copy"], "left_anti").select("rep", "id").unionByName(large.select("rep", F.col("copy").alias("id")))
    blocks = durable(shown.groupBy("rep").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    shown = durable(shown.join(blocks, "rep").withColumn("slot", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    one = links.select("a", "b").join(blocks.toDF("a", "na"), "a", "left").join(blocks.toDF("b", "nb"), "b", "left")
    slots = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    one = one.withColumn("sa", slots(F.col("na"))).withColumn("sb", slots(F.col("nb"))).select("a", "b", "sa", "sb")
    two = one.join(shown.select(F.col("rep").alias("a"), F.col("slot").alias("sa"), F.col("id").alias("ia")), ["a", "sa"], "left")
    two = two.join(shown.select(F.col("rep").alias("b"), F.col("slot").alias("sb"), F.col("id").alias("ib")), ["b", "sb"], "left")
    across = two.select(F.coalesce("ia", "a").alias("x"), F.coalesce("ib", "b").alias("y"))
    every = shown.withColumn("slot", slots(F.col("blocks"))).select("rep", "slot", F.col("id").alias("y"))
    inside = shown.select("rep", "slot", F.col("id").alias("x")).join(every, ["rep", "slot"]).where("x < y").select("x", "y")
    tied = members.join(large, ["rep", "copy"], "left_semi").where("id <> copy").select(F.col("copy").alias("x"), F.col("id").alias("y"))
    rows = across.unionByName(inside).unionByName(tied)
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """``id, group_id, n_links``: each record that has a link or a copy, with the smallest id it is joined
    to over any number of steps and the number of classes linked to its own."""
    degree = links.select("a").union(links.select("b")).groupBy("a").agg(F.count("*").alias("n_links"))
    edges = durable(links.select(F.col("b").alias("u"), F.col("a").alias("v")).unionByName(members.where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))).distinct())
    while True:
        # each node's larger neighbours go to the smallest of its neighbourhood, then the same for its smaller ones
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = durable(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            break
        edges = after
    root = edges.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    whole = root.unionByName(root.select(F.col("group_id").alias("id"), "group_id")).distinct()
    classed = whole.join(members.withColumnRenamed("rep", "own"), "id", "left").withColumn("own", F.coalesce("own", "id"))
    return classed.join(degree.withColumnRenamed("a", "own"), "own", "left").select("id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
