"""Repetition inside one text.

Two measures. ``repeated_share`` is exact: the share of characters that lie in a stretch of ``stretch``
characters which also begins at an earlier position of the same text. ``char_divergence`` and
``word_divergence`` are Jensen-Shannon distances (base 2, 0 to 1) of the text's histograms of character
classes and of common words to the references of its language, which are counted over all texts.

A text that is said twice as a whole has the very histograms of the text said once. Divergence from a
language reference therefore can't decide whether half of a text repeats; it is reported, and
``repeated_share`` decides.

Defined cases: texts are compared with runs of white space made one blank, trimmed and lower-cased. Null
and empty texts, and those below ``least`` characters, have null measures. Rows that repeat an id count
once, with the row whose text sorts first. A text without words has a null word divergence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import batch
from ..session import durable

# Frequent short words by language.
FREQUENT = {
    "en": "the of and to a in is that it for with as on by this from",
    "de": "der die das und ist nicht mit von den zu ein eine auf wird im",
    "es": "el la de que y en los una un por con para del se las",
    "fr": "le la les et des une un du est dans pour que pas sur ne",
}
_BY_WORD = {w: [g for g, ws in FREQUENT.items() if w in ws.split()] for ws in FREQUENT.values() for w in ws.split()}
_WORD = re.compile(r"[^\W\d_]+")
#: Code points where a character class begins, and the class: 0 blank, 1 digit, 2 letter, 3 punctuation,
#: 4 joining mark, 5 other Latin, 6 Cyrillic, 7 other alphabets, 8 kana, 9 Han, 10 Hangul, 11 other,
#: 12 Arabic, 13 Devanagari, 14 Thai.
_BOUNDS = np.array([0, 33, 48, 58, 65, 91, 95, 96, 97, 123, 0xC0, 0x400, 0x530, 0x600, 0x700, 0x900, 0x980, 0xE00, 0xE80, 0x3040, 0x3100, 0x4E00, 0xA000, 0xAC00, 0xD7B0])
_CLASS = np.array([0, 3, 1, 3, 2, 3, 4, 3, 2, 3, 5, 6, 7, 12, 7, 13, 7, 14, 7, 8, 11, 9, 11, 10, 11])
CLASSES = 15
#: Languages told by a fifth of the characters in their class.
_BY_CLASS = (("ja", 8), ("zh", 9), ("ru", 6), ("ar", 12), ("hi", 13), ("th", 14))
#: Languages written without blanks: a word of theirs is a letter, else it would be a whole clause.
_UNSPACED = frozenset(("ja", "zh", "th"))


class Texts:
    """A block of texts in one array of code points, with their histograms, languages and words."""

    def __init__(self, texts: list[str]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.owner = np.repeat(np.arange(len(texts)), self.lengths)
        kind = _CLASS[np.searchsorted(_BOUNDS, self.codes, side="right") - 1]
        self.classes = np.bincount(self.owner * CLASSES + kind, minlength=len(texts) * CLASSES).reshape(-1, CLASSES)
        self.words = [_WORD.findall(t) for t in texts]
        self.langs = [self._language(i) for i in range(len(texts))]
        for i, g in enumerate(self.langs):
            if g in _UNSPACED:
                self.words[i] = [c for w in self.words[i] for c in w]

    def _language(self, i: int) -> str:
        """The reference a text is held against: by script, else by its frequent words, else English."""
        for name, k in _BY_CLASS:
            if self.classes[i, k] * 5 >= max(1, self.lengths[i]):
                return name
        votes: Counter[str] = Counter(g for w in self.words[i] for g in _BY_WORD.get(w, ()))
        return max(sorted(votes), key=votes.__getitem__) if votes else "en"


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def _mixed(x: np.ndarray, factor: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def repeated_shares(texts: list[str] | Texts, stretch: int = 24) -> np.ndarray:
    """``repeated_share`` of each text. All texts are laid in one array; hashes of their stretches come by
    doubling, and one sort finds the first place of each."""
    texts = texts if isinstance(texts, Texts) else Texts(texts)
    lengths, codes, owner = texts.lengths, texts.codes, texts.owner
    shares = np.zeros(len(lengths))
    if not len(codes):
        return shares
    end = np.cumsum(lengths)
    with np.errstate(over="ignore"):
        level, width = _mixed(codes.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15), 1
        total, done = None, 0
        while width <= stretch:
            if stretch & width:
                if total is None:
                    total = level
                else:
                    n = len(codes) - done - width + 1
                    total = _mixed(total[: max(n, 0)] * np.uint64(0xD6E8FEB86659FD93) + level[done : done + max(n, 0)], 0xBF58476D1CE4E5B9)
                done += width
            if len(level) <= width:
                break
            level = _mixed(level[:-width] * np.uint64(0x94D049BB133111EB) + level[width:], 0xBF58476D1CE4E5B9)
            width *= 2
        if total is None or done != stretch:
            return shares
        at = np.arange(len(total))
        at = at[at + stretch <= end[owner[: len(total)]]]
        key = total[at] ^ _mixed(owner[at].astype(np.uint64) + np.uint64(77), 0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    # all but the first place of each stretch
    key = key[order]
    again = at[order[1:][key[1:] == key[:-1]]]
    cover = np.zeros(len(codes) + 1, np.int64)
    cover[again] += 1
    cover[again + stretch] -= 1
    count = np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=len(lengths))
    return count / np.maximum(lengths, 1)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The distance of each row of ``p`` to ``q``; NaN where either has no counts."""
    with np.errstate(all="ignore"):
        p = p / p.sum(1, keepdims=True)
        q = (q / q.sum())[None, :]
        m = (p + q) / 2
        part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / m), 0).sum(1)
        total = (part(p) + part(q)) / 2
        empty = np.isnan(p).any(1) | bool(np.isnan(q).any())
        return np.where(empty, np.nan, np.sqrt(np.maximum(0.0, total)))


def _blocks(b: pa.RecordBatch, size: int = 1_000_000) -> Iterator[tuple[list, list[str]]]:
    ids, texts = (c.to_pylist() for c in b.columns)
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size or i + 1 == len(texts):
            yield ids[lo : i + 1], texts[lo : i + 1]
            lo, held = i + 1, 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    classes: dict[str, np.ndarray] = {}
    words: dict[str, Counter[str]] = {}

    def out() -> pa.RecordBatch:
        rows = [(g, str(i), False, int(n)) for g, h in classes.items() for i, n in enumerate(h) if n]
        rows += [(g, w, True, n) for g, own in words.items() for w, n in own.items()]
        cols = list(zip(*rows)) or [[], [], [], []]
        return batch(("lang", "item", "is_word", "n"), [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.int64()))])

    for b in batches:
        for _, block in _blocks(b):
            texts = Texts(block)
            langs = np.array(texts.langs)
            for g in set(texts.langs):
                mine = np.nonzero(langs == g)[0]
                classes[g] = classes.get(g, 0) + texts.classes[mine].sum(0)
                own = words.setdefault(g, Counter())
                for i in mine:
                    own.update(texts.words[i])
        if sum(map(len, words.values())) > 200_000:
            yield out()
            classes, words = {}, {}
    yield out()


def _measure(reference: dict[str, tuple[np.ndarray, dict[str, int], np.ndarray]], stretch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, block in _blocks(b):
                texts = Texts(block)
                langs, n = np.array(texts.langs), len(block)
                chars, words = np.full(n, np.nan), np.full(n, np.nan)
                for g in set(texts.langs):
                    classes, index, common = reference[g]
                    mine = np.nonzero(langs == g)[0]
                    chars[mine] = jensen_shannon(texts.classes[mine], classes)
                    # the last place is for all other words
                    width = len(common)
                    places = [[index.get(w, width - 1) for w in texts.words[i]] for i in mine]
                    row = np.repeat(np.arange(len(mine)), [len(p) for p in places])
                    flat = np.array([x for p in places for x in p], np.int64)
                    own = np.bincount(row * width + flat, minlength=len(mine) * width).reshape(-1, width)
                    words[mine] = jensen_shannon(own, common)
                known = lambda x: pa.array(x, pa.float64(), from_pandas=True)
                yield batch(
                    ("item_id", "n_chars", "lang", "repeated_share", "char_divergence", "word_divergence"),
                    (pa.array(ids, pa.int64()), pa.array(texts.lengths.astype(np.int32)), pa.array(texts.langs, pa.string()), pa.array(repeated_shares(texts, stretch)), known(chars), known(words)),
                )

    return run


def repetition(df: DataFrame, id_col: str, text: Column, stretch: int = 24, least: int = 80, common: int = 64) -> DataFrame:
    """``item_id, n_chars, lang, repeated_share, char_divergence, word_divergence`` of each text.

    ``common`` words a language are the bound of what the references hold.
    """
    items = df.select(F.col(id_col).cast("long").alias("item_id"), normal(text).alias("text"))
    items = items.where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    sized = items.withColumn("n_chars", F.length("text"))
    long_ones = durable(sized.where(F.col("n_chars") >= least))
    counted = long_ones.select("item_id", "text").mapInArrow(_count, "lang string, item string, is_word boolean, n long")
    counted = counted.groupBy("lang", "item", "is_word").agg(F.sum("n").alias("n"))
    counted = durable(counted)
    # each task cuts its words of a language to the first ``common`` before they meet
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "item"))
    most = counted.where("is_word").withColumn("place", place).where(F.col("place") <= common).drop("place")
    sums = counted.where("is_word").groupBy("lang").agg(F.lit(None).cast("string").alias("item"), F.lit(None).cast("boolean").alias("is_word"), F.sum("n").alias("n"))
    kept = most.unionByName(counted.where("not is_word")).unionByName(sums)
    # bounded: the languages above times (common words + character classes + 1)
    chars: dict[str, np.ndarray] = {}
    known: dict[str, list[tuple[str, int]]] = {}
    total: dict[str, int] = {}
    for r in kept.collect():
        if r["is_word"] is None:
            total[r["lang"]] = r["n"]
        elif r["is_word"]:
            known.setdefault(r["lang"], []).append((r["item"], r["n"]))
        else:
            chars.setdefault(r["lang"], np.zeros(CLASSES))[int(r["item"])] = r["n"]
    tables = {}
    for g, histogram in chars.items():
        own = sorted(known.get(g, ()), key=lambda x: (-x[1], x[0]))
        counts = [n for _, n in own]
        tables[g] = (histogram, {w: i for i, (w, _) in enumerate(own)}, np.array([*counts, total.get(g, 0) - sum(counts)], float))
    measured = long_ones.select("item_id", "text").mapInArrow(
        _measure(tables, stretch), "item_id long, n_chars int, lang string, repeated_share double, char_divergence double, word_divergence double"
    )
    short = sized.where(F.coalesce(F.col("n_chars"), F.lit(0)) < least).select(
        "item_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), *(F.lit(None).cast(t).alias(c) for c, t in
        (("lang", "string"), ("repeated_share", "double"), ("char_divergence", "double"), ("word_divergence", "double"))),
    )
    return measured.unionByName(short)
