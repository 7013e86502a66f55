"""Most similar vectors for every vector, by shifted space-filling curves.

Each vector is projected several times onto a few random directions; the shifted projections are laid
on a Hilbert curve. The rows of every curve are range-partitioned by curve position and read in order:
each block is compared with itself and the block before it, and every row keeps its best neighbours of
each window. The lists of all curves merge into one and are ranked again.

Windows of a fixed length can't hold everything, so two kinds of rows are compared with all rows, in
blocks of ``block`` such rows, and get their true list:

- crowded rows, whose ``k`` best on the curves all reach ``crowd``: they stand in a group of similar but
  unequal vectors that may be longer than any window;
- with ``settle``, rows that the curves don't agree about: one of the ``k`` best came up on fewer than
  ``agree`` curves, or there are fewer than ``k``. What several independent curves find again and again is
  near to complete; what just one finds tells that others were missed.

The lists of all other rows are those of the curves.

Defined cases: vectors that are null, of another length, all zero or that hold nulls, NaN or infinite
values take no part. An empty table gives an empty result. Ties of cosine go to the smaller id. Rows that
repeat an id with the same vector count once. Vectors of equal codes (below) have cosine 1 to each other
and the same cosine to others: of any number of them the smallest ids are named. The input may have any
further columns; only the two named ones are read.

Precision: curves carry unit vectors as 16-bit integers (cosine error below 3e-5). Pairs that near to
``min_cosine`` are decided again from the stored values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import batch, fixed_binary, matrix
from ..functions.hilbert import hilbert_key
from ..session import durable

SCALE = 32767.0
NEAR = 3e-5
#: Ids that may be broadcast (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
SALT_BITS = 22


@dataclass(frozen=True)
class CurveSettings:
    """``sample`` bounds the rows that the projections' spread and the range bounds are fitted on; every
    row is indexed. ``window`` is the block length; ``rows_per_range`` the rows of one range of a curve.
    ``crowd`` is the cosine that all neighbours of a crowded row reach, ``agree`` the number of curves that
    must know each neighbour of a row that counts as settled, ``block`` how many rows are compared with all
    rows at once."""

    dim: int = 64
    k: int = 5
    min_cosine: float = -1.0
    curves: int = 6
    axes: int = 8
    bits: int = 5
    window: int = 1024
    rows_per_range: int = 60_000
    sample: int = 16_384
    seed: int = 5
    crowd: float = 0.85
    settle: bool = False
    agree: int = 2
    block: int = 16_384


def unit_vectors(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors (float32) of the usable rows."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    keep = (lengths == dim) & ids.is_valid().to_numpy(zero_copy_only=False)
    own = np.nonzero(keep)[0]
    flat = vectors.take(pa.array(own)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1))
        good = np.isfinite(norm) & (norm > 0)
        unit = (x[good] / norm[good][:, None]).astype(np.float32)
    return ids.take(pa.array(own[good])).to_numpy(zero_copy_only=False).astype(np.int64), unit


def _mix(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Curve:
    """One projection, its shift and the bounds of its ranges; small enough to go with each task."""

    def __init__(self, sample: np.ndarray, rows: int, s: CurveSettings, number: int):
        rng = np.random.default_rng([s.seed, number])
        self.s = s
        self.axes = np.linalg.qr(rng.standard_normal((s.dim, s.axes)))[0].astype(np.float32)
        spread = np.maximum((sample @ self.axes).std(0), 1e-6) if len(sample) else np.ones(s.axes)
        self.scale = (2.2 * spread).astype(np.float32)
        self.shift = (rng.uniform(-0.25, 0.25, s.axes) * spread).astype(np.float32)
        self.ranges = max(1, math.ceil(rows / s.rows_per_range))
        keys = np.sort(self.key(sample, np.arange(len(sample))))
        m = len(keys)
        cut = np.arange(1, self.ranges) * m // self.ranges
        back = math.ceil(max(1.0, 1.2 * s.window * m / max(rows, 1)))
        self.bounds = keys[cut] if m else np.zeros(0, np.int64)
        #: A row from here on, below its bound, is also read before the next range.
        self.overlap = keys[np.maximum(cut - back, 0)] if m else np.zeros(0, np.int64)

    def key(self, unit: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Curve position, then a hash of the id, so that bounds also split equal positions."""
        top = (1 << self.s.bits) - 1
        at = ((unit @ self.axes + self.shift) / self.scale + 1) * (0.5 * (top + 1))
        position = hilbert_key(np.clip(at, 0, top).astype(np.int64), self.s.bits)
        return (position << SALT_BITS) | (_mix(ids) >> np.uint64(64 - SALT_BITS)).astype(np.int64)


def _place(curves: list[_Curve], dim: int):
    first = np.cumsum([0] + [c.ranges for c in curves])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, unit = unit_vectors(b.column(0), b.column(1), dim)
            if not len(ids):
                continue
            code = np.rint(unit * SCALE).astype(np.int16)
            seen = code.astype(np.float32) / np.float32(SCALE)
            for n, c in enumerate(curves):
                key = c.key(seen, ids)
                own = np.searchsorted(c.bounds, key, side="right")
                # ranges whose overlap holds the row: from its own one, exclusive, on
                upto = np.searchsorted(c.overlap, key, side="right")
                times = np.maximum(upto - own, 0) + 1
                row = np.repeat(np.arange(len(ids)), times)
                step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                part = first[n] + own[row] + step
                yield batch(
                    ("part", "key", "vec_id", "code"),
                    (pa.array(part.astype(np.int32)), pa.array(key[row]), pa.array(ids[row]), fixed_binary(code[row])),
                )

    return run


def _best(scores: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's ``k`` highest scores of at least ``least``; -2 is never one."""
    if k < scores.shape[1]:
        hits = scores >= max(least, -1.5)
        many = hits.sum(1) > k
        if many.any():
            at = np.nonzero(many)[0]
            part = np.argpartition(-scores[at], k - 1, axis=1)[:, :k]
            kept = np.zeros((len(at), scores.shape[1]), bool)
            np.put_along_axis(kept, part, True, 1)
            hits[at] &= kept
    else:
        hits = scores >= max(least, -1.5)
    return np.nonzero(hits)


def _windows(s: CurveSettings, curve_of: np.ndarray):
    """Neighbours within the windows of each range, with the bit of the range's curve. Reads rows sorted by
    range and key."""
    least = (-1.0 if s.settle else min(s.min_cosine, s.crowd)) - NEAR

    def block(held: tuple[np.ndarray, np.ndarray], ids: np.ndarray, code: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], list]:
        new = code.astype(np.float32)
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
        names, unit = np.concatenate([held[0], ids]), np.concatenate([held[1], new])
        scores = new @ unit.T
        scores[ids[:, None] == names[None, :]] = -2
        r, c = _best(scores, s.k, least)
        back = scores[:, : len(held[0])].T
        u, v = _best(back, s.k, least)
        out = [(ids[r], names[c], scores[r, c]), (held[0][u], ids[v], back[u, v])]
        return (ids, new), out

    def rows_out(out: list, curve: int) -> pa.RecordBatch:
        q, n, c = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float32)))
        one = np.full(len(q), 1 << curve, np.int32)
        return batch(("vec_id", "neighbour_id", "cosine", "curves"), (pa.array(q), pa.array(n), pa.array(np.minimum(c.astype(np.float64), 1.0)), pa.array(one)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (np.zeros(0, np.int64), np.zeros((0, s.dim), np.float32))
        part_now, held = None, empty
        ids, code = np.zeros(0, np.int64), np.zeros((0, s.dim), np.int16)

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, code, held
            end = len(ids) if final else len(ids) // s.window * s.window
            for i in range(0, end, s.window):
                held, out = block(held, ids[i : min(i + s.window, end)], code[i : min(i + s.window, end)])
                yield rows_out(out, int(curve_of[part_now]))
            ids, code = ids[end:], code[end:]

        for b in batches:
            parts = b.column(0).to_numpy()
            own, codes = b.column(1).to_numpy(), matrix(b.column(2), np.int16, s.dim)
            edges = [0, *(np.nonzero(np.diff(parts))[0] + 1), len(parts)]
            for lo, hi in zip(edges, edges[1:]):
                if hi == lo:
                    continue
                if parts[lo] != part_now:
                    yield from flush(True)
                    part_now, held = parts[lo], empty
                ids, code = np.concatenate([ids, own[lo:hi]]), np.concatenate([code, codes[lo:hi]])
                yield from flush(False)
        yield from flush(True)

    return run


def _marks(dim: int):
    """Two hashes of each row's code: equal codes are one point of every curve."""
    weights = np.random.default_rng(7).integers(1, 2**63 - 1, (dim, 2), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, unit = unit_vectors(b.column(0), b.column(1), dim)
            with np.errstate(over="ignore"):
                marks = np.rint(unit * SCALE).astype(np.int64) @ weights
            yield batch(("vec_id", "one", "two"), (pa.array(ids), pa.array(marks[:, 0]), pa.array(marks[:, 1])))

    return run


def _fit(vectors: DataFrame, s: CurveSettings) -> list[_Curve]:
    rows = vectors.count()
    every = max(1, rows // s.sample)
    sample = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(s.seed)), F.lit(every)) == 0).limit(2 * s.sample).toArrow()
    if sample.num_rows:
        table = sample.combine_chunks()
        unit = unit_vectors(table.column(0).chunk(0), table.column(1).chunk(0), s.dim)[1]
    else:
        unit = np.zeros((0, s.dim), np.float32)
    return [_Curve(unit, rows, s, n) for n in range(s.curves)]


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    curves = [F.expr("bit_or(curves)").alias("curves")] if "curves" in pairs.columns else []
    best = pairs.groupBy("vec_id", "neighbour_id").agg(F.max("cosine").alias("cosine"), *curves)
    order = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "neighbour_id")
    return best.withColumn("neighbour_rank", F.row_number().over(order)).where(F.col("neighbour_rank") <= k)


def _copies(vectors: DataFrame, s: CurveSettings) -> tuple[DataFrame, DataFrame]:
    """``vec_id, rep`` of the rows whose code others have too (``rep`` is the smallest id), and ``rep, names``
    with the first ``k + 1`` ids of each such group."""
    marks = vectors.mapInArrow(_marks(s.dim), "vec_id long, one long, two long")
    groups = marks.groupBy("one", "two").agg(F.min("vec_id").alias("rep"), F.max("vec_id").alias("last")).where("rep < last")
    members = durable(marks.join(groups.drop("last"), ["one", "two"]).select("vec_id", "rep").distinct())
    first = members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).where(F.col("n") <= s.k + 1)
    return members, first.groupBy("rep").agg(F.collect_list("vec_id").alias("names"))


def _named(pairs: DataFrame, members: DataFrame, names: DataFrame) -> DataFrame:
    """``pairs`` with the smallest ids of each group of copies as its names, and the pairs within groups."""
    known = pairs.join(members.select(F.col("vec_id").alias("neighbour_id"), "rep"), "neighbour_id", "left")
    one = known.groupBy("vec_id", F.coalesce("rep", "neighbour_id").alias("rep")).agg(F.max("cosine").alias("cosine"), F.expr("bit_or(curves)").alias("curves"))
    own = members.select("vec_id", "rep", F.lit(1.0).alias("cosine"), F.lit(-1).alias("curves"))
    every = one.join(names, "rep", "left").select("vec_id", F.explode(F.coalesce("names", F.array("rep"))).alias("neighbour_id"), "cosine", "curves")
    every = every.unionByName(own.join(names, "rep").select("vec_id", F.explode("names").alias("neighbour_id"), "cosine", "curves"))
    return every.where("vec_id <> neighbour_id").groupBy("vec_id", "neighbour_id").agg(F.max("cosine").alias("cosine"), F.expr("bit_or(curves)").alias("curves"))


def nearest(df: DataFrame, id_col: str, vector_col: str, s: CurveSettings = CurveSettings()) -> DataFrame:
    """``vec_id, neighbour_id, cosine, neighbour_rank``: up to ``s.k`` neighbours of each vector, of at least
    ``s.min_cosine``: the true ones of crowded (and, with ``s.settle``, of unsettled) rows, those that the
    curves find of others. See the module for the defined cases."""
    vectors = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    curves = _fit(vectors, s)
    ranges = sum(c.ranges for c in curves)
    curve_of = np.repeat(np.arange(len(curves)), [c.ranges for c in curves])
    placed = vectors.mapInArrow(_place(curves, s.dim), "part int, key long, vec_id long, code binary")
    ordered = placed.repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "key")
    found = ordered.select("part", "vec_id", "code").mapInArrow(_windows(s, curve_of), "vec_id long, neighbour_id long, cosine double, curves int")
    pairs = found.groupBy("vec_id", "neighbour_id").agg(F.max("cosine").alias("cosine"), F.expr("bit_or(curves)").alias("curves"))
    members, names = _copies(vectors, s)
    if not members.isEmpty():
        pairs = _named(pairs, members, names)
    pairs = durable(pairs)
    if s.settle:
        # a row that the curves never paired is asked, too
        known = _ranked(pairs, s.k).groupBy("vec_id").agg((F.count("*") >= s.k).alias("full"), F.min(F.bit_count("curves")).alias("agree"))
        usable = vectors.mapInArrow(_marks(s.dim), "vec_id long, one long, two long").select("vec_id").distinct()
        asking = usable.join(known.where(F.col("full") & (F.col("agree") >= s.agree)), "vec_id", "left_anti")
    else:
        # k copies leave nothing nearer to be found
        counts = pairs.groupBy("vec_id").agg(F.count_if(F.col("cosine") >= s.crowd - NEAR).alias("near"), F.count_if(F.col("curves") < 0).alias("copies"))
        asking = counts.where((F.col("near") >= s.k) & (F.col("copies") < s.k)).select("vec_id")
    asking = durable(asking)
    n = asking.count()
    pairs = pairs.select("vec_id", "neighbour_id", "cosine")
    if n:
        few = F.broadcast(asking) if n <= BROADCAST_IDS else asking
        asked = durable(vectors.join(few, "vec_id", "left_semi"))
        pairs = pairs.join(few, "vec_id", "left_anti")
        for hits in _compared(vectors, asked, n, s.block, s, s.min_cosine - NEAR):
            pairs = pairs.unionByName(durable(hits))
    if s.min_cosine <= -1:
        return _ranked(pairs, s.k).select("vec_id", "neighbour_id", "cosine", "neighbour_rank")
    return _ranked(_decided(pairs.where(F.col("cosine") >= s.min_cosine - 2 * NEAR), vectors, s), s.k)


def _decided(pairs: DataFrame, vectors: DataFrame, s: CurveSettings) -> DataFrame:
    """Pairs at or above the limit; the cosine of those too near to it comes from the stored vectors."""
    near = F.abs(F.col("cosine") - s.min_cosine) <= 2 * NEAR
    sure = pairs.where(~near & (F.col("cosine") > s.min_cosine))
    if pairs.where(near).isEmpty():
        return sure
    one = vectors.groupBy("vec_id").agg(F.first("embedding").alias("embedding"))
    both = pairs.where(near).join(one, "vec_id").join(
        one.select(F.col("vec_id").alias("neighbour_id"), F.col("embedding").alias("other")), "neighbour_id"
    )
    as_double = [F.transform(c, lambda x: x.cast("double")) for c in ("embedding", "other")]

    def total(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)

    a, b = as_double
    exact = both.select("vec_id", "neighbour_id", (total(a, b) / F.sqrt(total(a, a) * total(b, b))).alias("cosine"))
    return sure.unionByName(exact.where(F.col("cosine") >= s.min_cosine))


def _scan(ids: np.ndarray, queries: np.ndarray, dim: int, k: int, least: float = -1.5):
    """The ``k`` nearest rows of at least ``least`` for each of ``queries``, of the rows that a task reads."""

    def merge(top: np.ndarray, who: np.ndarray, at: np.ndarray, scores: np.ndarray, own: np.ndarray) -> None:
        both = np.concatenate([top[at], scores[at]], 1)
        names = np.concatenate([who[at], np.broadcast_to(own, (len(at), len(own)))], 1)
        r, c = np.nonzero(both >= np.partition(both, -k, axis=1)[:, -k][:, None])
        order = np.lexsort((names[r, c], -both[r, c], r))
        r, c = r[order], c[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        r, c, place = r[place < k], c[place < k], place[place < k]
        top[at[r], place], who[at[r], place] = both[r, c], names[r, c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full((len(ids), k), -2.0, np.float32)
        who = np.full((len(ids), k), -1, np.int64)
        seen = np.zeros(0, np.int64)
        for b in batches:
            own, unit = unit_vectors(b.column(0), b.column(1), dim)
            own, first = np.unique(own, return_index=True)
            fresh = ~np.isin(own, seen)
            own, unit = own[fresh], unit[first[fresh]]
            seen = np.concatenate([seen, own])
            for lo in range(0, len(own), 2048):
                part = own[lo : lo + 2048]
                for q in range(0, len(ids), 2048):
                    mine = slice(q, q + 2048)
                    scores = queries[mine] @ unit[lo : lo + 2048].T
                    self_at = np.minimum(np.searchsorted(part, ids[mine]), len(part) - 1)
                    self_in = np.nonzero(part[self_at] == ids[mine])[0]
                    scores[self_in, self_at[self_in]] = -2
                    at = np.nonzero(scores.max(1) >= np.maximum(top[mine, -1], least))[0]
                    if len(at):
                        merge(top[mine], who[mine], at, scores, part)
        q, n, c = np.repeat(ids, k), who.ravel(), top.ravel().astype(np.float64)
        real = (n >= 0) & (c >= least)
        yield batch(("vec_id", "neighbour_id", "cosine"), (pa.array(q[real]), pa.array(n[real]), pa.array(c[real])))

    return run


def _compared(vectors: DataFrame, asked: DataFrame, n: int, block: int, s: CurveSettings, least: float) -> Iterator[DataFrame]:
    """``vec_id, neighbour_id, cosine``, a table for each block of about ``block`` of the ``n`` rows ``asked``:
    the best that every task finds."""
    blocks = math.ceil(n / block)
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        ids, unit = unit_vectors(part.column(0).chunk(0), part.column(1).chunk(0), s.dim)
        ids, first = np.unique(ids, return_index=True)
        yield vectors.mapInArrow(_scan(ids, unit[first], s.dim, s.k, least), "vec_id long, neighbour_id long, cosine double")


def nearest_of(
    df: DataFrame, id_col: str, vector_col: str, queries: DataFrame, s: CurveSettings, block: int = 4096
) -> DataFrame:
    """The ``s.k`` nearest rows of all of ``df`` for each of a stated set of ``queries`` (same columns): each
    is compared with every row, ``block`` queries at a time. Ids are taken as unique.
    """
    vectors = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    asked = durable(queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")))
    none = df.sparkSession.createDataFrame([], "vec_id long, neighbour_id long, cosine double")
    result = _ranked(none, s.k)
    for hits in _compared(vectors, asked, asked.count(), block, s, -1.5):
        result = result.unionByName(_ranked(hits, s.k))
    return result
