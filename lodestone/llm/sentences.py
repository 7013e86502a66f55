"""Sentence boundaries across languages and scripts, by a pushdown automaton.

The automaton reads the marks of a paragraph: terminators, opening and closing quotation marks and
brackets (pushed and popped; one without a partner is ignored), and the white space around Thai letters.
With an empty stack, a terminator ends the sentence unless what surrounds it says otherwise: an
abbreviation before it (tries of endings by what may follow them), an initial, an ordinal before a month,
no white space behind it, or a continuation in lower case. With marks on the stack nothing ends; when the
last one is popped right behind a terminator, what follows decides. Blank lines end sentences, single
line breaks don't. In layouts other than prose, list items, headings, quoted lines, table rows and fenced
code are units of their own. The automaton's second stack holds the indents of the open lists: a bullet or
the number 1 opens a list inside the item above it, a further number goes on with an open list of its indent
and is plain text elsewhere, and text that is indented less closes lists.

Defined cases: null, empty and blank texts give no rows. Positions are code points. Re-delivered
documents count once, all rows of a document from the same delivery. The rows of a document cover all its
characters but white space.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import batch

# Abbreviations after which a sentence goes on, whatever follows.
INNER = (
    "e.g i.e cf vs viz approx fig figs Fig Figs eq Eq sec Sec ch vol Vol pp ed eds Dr Mr Mrs Ms Prof St Mt Rev Gen Col Lt Sgt Capt Hon Jr "
    "Abb Tab Nr Bd Hr Fr Hrn Str Kap bzw ca vgl Vgl sog evtl ggf inkl zzgl z.B d.h u.a o.ä i.d.R "
    "Sr Sra Srta Dra Dña Ud Uds art núm pág págs cap aprox p.ej Mme Mlle MM Mgr env chap réf p.ex c.-à-d "
    "рис напр см стр гл т.е т.к им ул проф акад डॉ श्री"
).split()
# Abbreviations after which a sentence goes on before a number.
BEFORE_NUMBER = "no No nos Nos p S n° Art Nr art г л c v".split()
# Abbreviations that may also end a sentence.
OUTER = "etc p.m a.m al usw u.s.w т.д т.п др Inc Ltd Co Corp U.S U.K Jh".split()
# Months that an ordinal may stand before.
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split()

# What may follow the first letter of an abbreviation of several parts.
CHAINS = {"z": "B", "d": "h i", "u": "a ä U", "o": "ä", "i": "d", "p": "ej ex m", "a": "m", "т": "е д п к", "и": "о", "c": "-à-d"}

STRONG = "!?。！？।॥؟۔"
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "「": "」", "『": "』", "«": "»", "“": "”", "„": "“", "‹": "›", "《": "》", "〈": "〉"}
_CLOSERS = frozenset(_PAIRS.values()) | {'"'}
_EVENT = re.compile(r"[.…!?。！？।॥؟۔]+|(?<=[฀-๿])\s+|\s+(?=[฀-๿])")
_MARKS = re.compile(r"""[("\[{（【「『«“„‹《〈)\]}）】」』»”›》〉]""")
_PARAGRAPH = re.compile(r"[^\S\n]*\n[^\S\n]*\n\s*")
_FILL = re.compile(r"\s*")
_NAME = re.compile(r"[a-z][A-Za-z0-9]*(?:[_.]\w|\(|[A-Z])")
_LINE = re.compile(r"([ \t]*)(?:([-*+•])(?=\s)|(\d{1,9})[.)](?=\s)|(#{1,6}(?=\s)|>|\|))?")
_ITEM_HEAD = re.compile(r"[ \t]*(?:[-*+•]|\d{1,9}[.)])\s+")
_FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n(?:.*?\n)?[ \t]*\1[^\n]*$", re.M | re.S)


class _Trie:
    """Abbreviations read from their last character backwards; blanks inside are skipped."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in reversed(w):
                node = node.setdefault(c, {})
            node[""] = {}

    def ends(self, text: str, at: int, floor: int) -> bool:
        """Whether an entry stands right before ``at``."""
        node, at = self.root, at - 1
        while True:
            if "" in node and (at < floor or not (text[at].isalnum() or text[at] in "._-")):
                return True
            if at < floor:
                return False
            c = text[at]
            if c.isspace() and at + 1 < len(text) and "." in node:
                # "z. B": a blank may follow an inner full stop
                at -= 1
                continue
            node = node.get(c)
            if node is None:
                return False
            at -= 1


_INNER, _NUMBERED, _OUTER = _Trie(INNER), _Trie(BEFORE_NUMBER), _Trie(OUTER)
_CHAIN = {k: re.compile(rf"\s*(?:{'|'.join(v.split())})\.") for k, v in CHAINS.items()}
_ORDINAL_MONTH = re.compile(rf"\s+(?:{'|'.join(MONTHS)})\b")


def _outer_spans(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """The outermost pairs of quotation marks and brackets: place of the opening, end of the closing."""
    stack: list[tuple[str, int]] = []
    waits: Counter[str] = Counter()  # openings on the stack by their closing mark
    pairs: list[tuple[int, int]] = []
    for m in _MARKS.finditer(text, lo, hi):
        c = m.group()
        if c in _CLOSERS and waits[c]:
            while True:
                close, at = stack.pop()
                waits[close] -= 1
                if close == c:
                    break
            pairs.append((at, m.end()))
        elif c == '"' or c in _PAIRS:
            close = _PAIRS.get(c, c)
            stack.append((close, m.start()))
            waits[close] += 1
    pairs.sort()
    out: list[tuple[int, int]] = []
    for p in pairs:
        if not out or p[0] >= out[-1][1]:
            out.append(p)
    return out


def _begins(text: str, at: int, hi: int) -> bool:
    """Whether a sentence may begin at ``at``, after a mark that needn't end one."""
    c = text[at]
    if c in "\"«„“「『《‹¿¡`([（【":
        return True
    if c.islower():
        m = _NAME.match(text, at, hi)
        return bool(m)
    return c.isalnum()


def _ends(text: str, floor: int, start: int, end: int, hi: int) -> bool:
    """Whether the terminators ``start:end``, met with an empty stack, end the sentence."""
    if end >= hi:
        return True
    run, after = text[start:end], text[end]
    spaced = after.isspace()
    following = _FILL.match(text, end, hi).end()
    if any(c in "。！？।॥" for c in run):
        return spaced or after not in "，、,;；:：」』”）"
    if not spaced:
        if any(c in "؟۔" for c in run):
            return True
        return any(c in "!?" for c in run) and not after.isascii() and after.isalpha()
    if any(c in STRONG for c in run):
        return text[following] not in ",;:—–،"
    if not _begins(text, following, hi):
        return False
    if run != ".":
        return True
    if _INNER.ends(text, start, floor):
        return False
    before = text[start - 1] if start > floor else " "
    lone = start - 2 < floor or not (text[start - 2].isalnum() or text[start - 2] in "._")
    if lone and before in _CHAIN and _CHAIN[before].match(text, end, hi):
        return False
    if lone and before.isalpha() and before.isupper():
        return False  # an initial
    if text[following].isdigit() and _NUMBERED.ends(text, start, floor):
        return False
    if before.isdigit() and lone | (start - 3 < floor or not (text[start - 3].isalnum() or text[start - 3] in ".,_")) and _ORDINAL_MONTH.match(text, end, hi):
        return False
    return True


def _closed(text: str, start: int, end: int, hi: int) -> bool:
    """Whether a sentence ends with the span ``start:end`` of marks that just emptied the stack."""
    inside = end - 1
    while inside > start and (text[inside - 1].isspace() or text[inside - 1] in _CLOSERS):
        inside -= 1
    if text[inside - 1] not in ".…" and text[inside - 1] not in STRONG or inside - 1 <= start:
        return False
    if end >= hi:
        return True
    after = text[end]
    if not after.isspace():
        # without blanks: a particle goes on, and so does any mark
        return text[inside - 1] in "。！？" and after.isalnum() and not "぀" <= after <= "ヿ"
    return _begins(text, _FILL.match(text, end, hi).end(), hi)


def _trimmed(text: str, lo: int, hi: int) -> tuple[int, int]:
    while lo < hi and text[lo].isspace():
        lo += 1
    while hi > lo and text[hi - 1].isspace():
        hi -= 1
    return lo, hi


def _paragraph(text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    begin, at = lo, lo
    spans = iter(_outer_spans(text, lo, hi))
    span = next(spans, None)
    while True:
        m = _EVENT.search(text, at, hi)
        if span and (m is None or m.start() > span[0] or m.end() > span[0]):
            start, at = span
            span = next(spans, None)
            if _closed(text, start, at, hi):
                yield begin, at
                begin = at
            continue
        if m is None:
            break
        at = m.end()
        if m.group()[0].isspace():
            if m.start() > begin:
                yield begin, m.start()
                begin = at
        elif _ends(text, begin, m.start(), at, hi):
            yield begin, at
            begin = at
    if begin < hi:
        yield begin, hi


def _paragraphs(text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    at = lo
    for m in _PARAGRAPH.finditer(text, lo, hi):
        yield at, m.start()
        at = m.end()
    yield at, hi


def _items(text: str, lo: int, hi: int, levels: list[int]) -> Iterator[tuple[int, int, bool]]:
    """The list items, headings, quoted lines and plain parts of a paragraph, and whether each begins with a
    list mark. ``levels`` holds the indents of the lists that are open, and is kept from paragraph to
    paragraph."""
    begin, marked, line = lo, False, lo
    while line < hi:
        end = text.find("\n", line, hi)
        end = hi if end < 0 else end
        m = _LINE.match(text, line, end)
        blank, bullet, number, sign = m.groups()
        # the first line comes without its indent
        indent = len((text[text.rfind("\n", 0, lo) + 1 : lo] + blank if line == lo else blank).expandtabs(4))
        while levels and levels[-1] > indent:
            levels.pop()
        sibling = bool(levels) and levels[-1] == indent
        item = bool(bullet) or number is not None and (sibling or int(number) == 1 or line == lo)
        if item or sign:
            if line > begin:
                yield begin, line, marked
            begin, marked = line, item
            if item and not sibling:
                levels.append(indent)
            if sign and sign[0] == "#":
                levels.clear()
                yield line, end, False
                begin, marked = end, False
        elif line == lo and indent <= (levels[-1] if levels else 0):
            levels.clear()
        line = end + 1
    if begin < hi:
        yield begin, hi, marked


def sentences(text: str, layout: str = "prose") -> Iterator[tuple[int, int]]:
    """Code-point ranges of the sentences of ``text``."""
    lo, hi = _trimmed(text, 0, len(text))
    if layout == "prose":
        blocks = [(lo, hi, False)]
    else:
        blocks, at = [], lo
        for m in _FENCE.finditer(text, lo, hi):
            blocks += [(at, m.start(), False), (m.start(), m.end(), True)]
            at = m.end()
        blocks.append((at, hi, False))
    for a, b, fenced in blocks:
        a, b = _trimmed(text, a, b)
        if a >= b:
            continue
        if fenced:
            yield a, b
            continue
        levels: list[int] = []
        for u, v in _paragraphs(text, a, b):
            for p, q, marked in [(u, v, False)] if layout == "prose" else _items(text, u, v, levels):
                head = _ITEM_HEAD.match(text, p, q) if marked else None
                first = True
                for x, y in _paragraph(text, head.end() if head else p, q):
                    x, y = _trimmed(text, p if first and head else x, y)
                    first = False
                    if x < y:
                        yield x, y


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places = pa.list_(pa.int32())
    for b in batches:
        ids, starts, ends = [], [], []
        for i, text, layout in zip(*(c.to_pylist() for c in b.columns)):
            spans = list(sentences(text, (layout or "prose").strip().lower()))
            ids.append(i)
            starts.append([x for x, _ in spans])
            ends.append([y for _, y in spans])
        yield batch(("doc_id", "starts", "ends"), (pa.array(ids, pa.int64()), pa.array(starts, places), pa.array(ends, places)))


def split_sentences(df: DataFrame, id_col: str, text_col: str, layout_col: str) -> DataFrame:
    """``doc_id, start_pos, end_pos`` of every sentence: 0-based code points, the end exclusive."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(layout_col).alias("layout"))
    found = docs.where("doc_id is not null and length(text) > 0").mapInArrow(_split, "doc_id long, starts array<int>, ends array<int>")
    # one row a document is moved; of several deliveries the one whose places sort last
    once = found.groupBy("doc_id").agg(F.max(F.struct("starts", "ends")).alias("s"))
    each = once.select("doc_id", F.explode(F.arrays_zip(F.col("s.starts").alias("starts"), F.col("s.ends").alias("ends"))).alias("p"))
    return each.select("doc_id", F.col("p.starts").alias("start_pos"), F.col("p.ends").alias("end_pos"))
