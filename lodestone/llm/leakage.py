"""Evaluation passages inside a training corpus, by an FM-index per shard of the corpus.

Every partition of the corpus is read in shards of a bounded number of words. A shard becomes an FM-index
over word numbers of the evaluation vocabulary (all other words separate, since no evaluation phrase goes
across them); every phrase of ``run`` words of the evaluation items is searched backwards in it, located
by sampled suffix positions, and the hits of a document and item merge into spans.

Words are lower-cased runs of letters and digits. Defined cases: null and empty texts have no words.
Items of fewer than ``run`` words can't be found. Re-delivered documents and items count once. The
evaluation items go to every task in blocks of at most ``block`` items, one pass over the corpus a block.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import batch
from .fm_index import FMIndex, spread_ranges

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    # a final sigma depends on its surroundings only where the length stays the same
    return _WORD.findall(low if len(low) == len(text) else "".join(c.lower() for c in text))


def word_places(text: str) -> list[tuple[int, int]]:
    """Code-point ranges of the words in ``text``, also where lower-casing changes lengths."""
    low = text.lower()
    if len(low) == len(text):
        return [m.span() for m in _WORD.finditer(low)]
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    low = "".join(c.lower() for c in text)
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in _WORD.finditer(low)]


class Phrases:
    """The distinct phrases of a block of items as word numbers, and which items hold each."""

    def __init__(self, items: list[tuple[int, str]], run: int):
        self.run = run
        self.number: dict[str, int] = {}
        phrase_of: dict[tuple[int, ...], int] = {}
        holder: list[tuple[int, int]] = []
        for item, text in items:
            own = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for i in range(len(own) - run + 1):
                p = phrase_of.setdefault(tuple(own[i : i + run]), len(phrase_of))
                holder.append((p, item))
        self.patterns = np.array(list(phrase_of), np.int64).reshape(-1, run)
        pairs = np.array(sorted(set(holder)), np.int64).reshape(-1, 2)
        self.items = pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(phrase_of) + 1))


def _hits(texts: list[str | None], p: Phrases) -> Iterator[tuple[int, int, int, int]]:
    """Document (by place), item, first word and end word of each span."""
    look = p.number.get
    sequences = [np.array([look(w, 0) for w in words_of(t)], np.int32) for t in texts]
    # segments of at least ``run`` evaluation words, each followed by one separator
    kept, segment_doc, segment_at = [], [], []
    for d, s in enumerate(sequences):
        if len(s) < p.run:
            continue
        gaps = np.concatenate([[-1], np.nonzero(s == 0)[0], [len(s)]])
        for i in np.nonzero(np.diff(gaps) > p.run)[0]:
            kept.append(s[gaps[i] + 1 : gaps[i + 1]])
            segment_doc.append(d)
            segment_at.append(gaps[i] + 1)
    if not kept:
        return
    lengths = np.array([len(k) + 1 for k in kept])
    start = np.cumsum(lengths) - lengths
    seq = np.zeros(lengths.sum(), np.int32)
    for at, k in zip(start, kept):
        seq[at : at + len(k)] = k
    index = FMIndex(seq, len(p.number) + 1)
    lo, hi = index.search(p.patterns)
    rows, phrase = spread_ranges(lo, hi)
    at = index.locate(rows)
    segment = np.searchsorted(start, at, side="right") - 1
    word = at - start[segment] + np.array(segment_at)[segment]
    hit, which = spread_ranges(p.first[phrase], p.first[phrase + 1])
    docs, items, words = np.array(segment_doc)[segment][which], p.items[hit], word[which]
    o = np.lexsort((words, items, docs))
    docs, items, words = docs[o], items[o], words[o]
    if len(docs):
        fresh = np.ones(len(docs), bool)
        fresh[1:] = (docs[1:] != docs[:-1]) | (items[1:] != items[:-1]) | (words[1:] > words[:-1] + p.run)
        begin = np.nonzero(fresh)[0]
        end = np.append(begin[1:], len(docs)) - 1
        yield from zip(docs[begin].tolist(), items[begin].tolist(), words[begin].tolist(), (words[end] + p.run).tolist())


def _search(p: Phrases, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[str | None] = []
        held = 0

        def shard() -> pa.RecordBatch:
            rows = []
            places: dict[int, list[tuple[int, int]]] = {}
            for doc, item, first, end in _hits(texts, p):
                if doc not in places:
                    places[doc] = word_places(texts[doc])
                spans = places[doc]
                rows.append((ids[doc], item, spans[first][0], spans[end - 1][1], end - first))
            cols = list(zip(*rows)) or [[]] * 5
            return batch(("doc_id", "item_id", "start_pos", "end_pos", "n_words"), [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))])

        for b in batches:
            for i, t in zip(*(c.to_pylist() for c in b.columns)):
                ids.append(i)
                texts.append(t)
                held += len(t or "") // 6
                if held >= shard_words:
                    yield shard()
                    ids, texts, held = [], [], 0
        if ids:
            yield shard()

    return run


def leaked_spans(
    docs: DataFrame, doc_col: str, text_col: str, items: DataFrame, item_col: str, item_text: Column,
    run: int = 13, shard_words: int = 600_000, block: int = 2_000,
) -> DataFrame:
    """``doc_id, item_id, start_pos, end_pos, n_words``: the maximal unions of phrases of ``run`` words that
    a document shares with an item, as code-point positions to remove."""
    corpus = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and length(text) > 0")
    held = items.select(F.col(item_col).cast("long").alias("item_id"), item_text.alias("text")).where("item_id is not null and text is not null").distinct()
    blocks = max(1, math.ceil(held.count() / block))
    found = None
    for i in range(blocks):
        part = held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect()
        phrases = Phrases([(r["item_id"], r["text"]) for r in part], run)
        hits = corpus.mapInArrow(_search(phrases, shard_words), "doc_id long, item_id long, start_pos int, end_pos int, n_words int")
        found = hits if found is None else found.unionByName(hits)
    return found.distinct()
