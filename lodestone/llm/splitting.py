"""Cutting oversized texts at natural boundaries, by pointer doubling.

Every possible boundary of a text (before a definition, after a blank line, at a line end, inside a line
that alone is over the limit) is joined to its farthest legal successor, the overlap of the next piece
counted in. Squaring that successor table gives the boundaries 2, 4, 8, ... cuts ahead, so that all cuts
of all texts of a batch come out in a logarithmic number of array steps. The cuts are those of greedy
filling: of the boundaries within reach, the last one before a definition, else after a blank line, else
at a line end, where the better kinds must lie in the second half of the piece.

Defined cases: null texts and texts within the limit give no rows. Lengths are code points; lines end at
line feeds. A piece begins with the last ``overlap`` lines of the piece before it, with fewer where those
and the next line don't fit, and with none inside a line that is cut. Rows that repeat an id are cut
once. The pieces without their overlap put the text together again, character by character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import batch

LINE, BLANK, DEFINITION = 1, 2, 3
_DEFINITION = re.compile(r"^[ \t]*(?:@\w|(?:async[ \t]+)?def[ \t]|class[ \t])", re.M)
_BLANK = re.compile(r"\n[ \t\r]*\n")


def boundaries(text: str, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions where ``text`` may be cut, with both ends; the kind of each (0 inside a line); the line
    that begins at or holds each."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.nonzero(codes == 10)[0] + 1])
    starts = starts[starts < len(codes)] if len(codes) else starts
    kinds = np.full(len(starts), LINE, np.int8)
    kinds[np.isin(starts, [m.end() for m in _BLANK.finditer(text)])] = BLANK
    at = np.searchsorted(starts, [m.start() for m in _DEFINITION.finditer(text)])
    decorated = [text.startswith("@", starts[i - 1] + _indent(text, starts[i - 1])) if i else False for i in at]
    kinds[at[~np.array(decorated, bool)]] = DEFINITION
    ends = np.append(starts[1:], len(codes))
    positions, kept, lines = [starts], [kinds], [np.arange(len(starts))]
    for i in np.nonzero(ends - starts > limit)[0]:
        inside, p = [], int(starts[i])
        while ends[i] - p > limit:
            gap = text.rfind(" ", p + limit // 2, p + limit)
            p = gap + 1 if gap >= 0 else p + limit
            inside.append(p)
        positions.append(np.array(inside))
        kept.append(np.zeros(len(inside), np.int8))
        lines.append(np.full(len(inside), i))
    p, k, ln = np.concatenate(positions), np.concatenate(kept), np.concatenate(lines)
    order = np.argsort(p, kind="stable")
    end = [len(codes)]
    return np.append(p[order], end), np.append(k[order], LINE), np.append(ln[order], len(starts))


def _indent(text: str, at: int) -> int:
    end = at
    while end < len(text) and text[end] in " \t":
        end += 1
    return end - at


def _overlap_starts(p: np.ndarray, kind: np.ndarray, line: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """Where the piece that continues at each boundary begins."""
    line_at = p[np.searchsorted(line, np.arange(line[-1] + 1))]
    following = np.append(p[1:], p[-1])
    begin = p.copy()
    for back in range(1, overlap + 1):
        earlier = line_at[np.maximum(line - back, 0)]
        fits = (kind > 0) & (following - earlier <= limit)
        begin = np.where(fits, np.minimum(begin, earlier), begin)
    return begin


def _successors(p: np.ndarray, kind: np.ndarray, begin: np.ndarray, limit: int) -> np.ndarray:
    """The farthest legal next boundary of each boundary; the last one is its own."""
    m = len(p)
    here = np.arange(m)
    last = np.maximum(np.searchsorted(p, begin + limit, side="right") - 1, np.minimum(here + 1, m - 1))
    best = last.copy()
    open_ = last < m - 1
    half = np.searchsorted(p, begin + limit // 2, side="left")
    for least in (LINE, BLANK, DEFINITION):
        latest = np.maximum.accumulate(np.where(kind >= least, here, -1))[last]
        low = here + 1 if least == LINE else np.maximum(half, here + 1)
        best = np.where(open_ & (latest >= low), latest, best)
    return best


def cuts(texts: list[str], limit: int, overlap: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: begin, continuation and end of each piece."""
    per = [boundaries(t, limit) for t in texts]
    begins = [_overlap_starts(*b, limit, overlap) for b in per]
    base = np.cumsum([0] + [len(b[0]) for b in per])
    step = np.concatenate([_successors(b[0], b[1], s, limit) + o for b, s, o in zip(per, begins, base)])
    reached = np.zeros(base[-1], bool)
    reached[base[:-1]] = True
    while True:
        grown = reached.copy()
        grown[step[reached]] = True
        if (grown == reached).all():
            break
        reached, step = grown, step[step]
    out = []
    for (p, _, _), begin, lo, hi in zip(per, begins, base, base[1:]):
        at = np.nonzero(reached[lo:hi])[0]
        out.append((begin[at[:-1]], p[at[:-1]], p[at[1:]]))
    return out


def _pieces(limit: int, overlap: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, ids, texts = (c.to_pylist() for c in b.columns)
            for lo in range(0, len(texts), 512):
                part = texts[lo : lo + 512]
                rows: list[tuple] = []
                for kind, item, text, (begin, at, end) in zip(kinds[lo:], ids[lo:], part, cuts(part, limit, overlap)):
                    feeds = np.nonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10)[0]
                    first, last = np.searchsorted(feeds, begin), np.searchsorted(feeds, end - 1)
                    for n in range(len(begin)):
                        piece = text[begin[n] : end[n]] if with_text else None
                        rows.append((kind, item, n, int(begin[n]), int(at[n]), int(end[n]), int(first[n]), int(last[n]), piece))
                if rows:
                    yield batch(
                        ("item_kind", "item_id", "piece_no", "start_pos", "new_pos", "end_pos", "first_line", "last_line", "piece"),
                        [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)],
                    )

    return run


_TYPES = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
_SCHEMA = "item_kind string, item_id long, piece_no int, start_pos int, new_pos int, end_pos int, first_line int, last_line int, piece string"


def split_oversized(
    df: DataFrame, kind: str, id_col: str, text_col: str, limit: int = 2000, overlap: int = 2, with_text: bool = True
) -> DataFrame:
    """One row per piece of each text of more than ``limit`` code points: its number, code-point range
    (``new_pos`` is where its overlap ends), first and last line (0-based, of the text) and text."""
    large = df.select(F.lit(kind).alias("item_kind"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    large = large.where(F.col("item_id").isNotNull() & (F.length("text") > limit))
    pieces = large.mapInArrow(_pieces(limit, overlap, with_text), _SCHEMA)
    pieces = pieces if with_text else pieces.drop("piece")
    return pieces.dropDuplicates(["item_kind", "item_id", "piece_no"])
