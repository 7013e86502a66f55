"""Replies: loops in generated text, and what is kept of them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# A line of so many characters counts, the third time is a loop; so does a phrase of 8 to 80
# characters that ends the text six times in a row.
LINE_CHARS, LINE_TIMES = 12, 3
PHRASE_TIMES, PHRASES = 6, (8, 80)
_LINE = re.compile(r"([^\n]*)\n")
#: Read from the end of the text backwards, so that the shortest phrase is found first.
_PHRASE = re.compile(rf"(.{{{PHRASES[0]},{PHRASES[1]}}}?)\1{{{PHRASE_TIMES - 1}}}", re.S)


@dataclass
class LoopState:
    """What a guard remembers between pieces of one reply: the unfinished line, the tail that a repeated
    phrase can lie in, and the first places of the lines so far."""

    length: int = 0
    line: str = ""
    tail: str = ""
    places: dict[str, list[int]] = field(default_factory=dict)
    keep: int | None = None

    def feed(self, piece: str) -> bool:
        """Takes the next piece; True once the reply loops, with ``keep`` the length worth keeping: all
        before the first repeat of a line that comes the third time, or one copy of a repeated phrase."""
        if self.keep is None:
            here = self.length - len(self.line)
            self.length += len(piece)
            whole = self.line + piece
            ends = [0]
            for m in _LINE.finditer(whole):
                ends.append(m.end())
                self._note(m.group(1).strip(), here + m.start())
            self.line = whole[ends[-1] :]
            self.tail = (self.tail + piece)[-PHRASES[1] * PHRASE_TIMES :]
            again = _PHRASE.match(self.tail[::-1]) if self.keep is None else None
            if again and again.group(1).strip():
                self.keep = self.length - len(again.group(1)) * (PHRASE_TIMES - 1)
        return self.keep is not None

    def _note(self, text: str, place: int) -> None:
        if self.keep is None and len(text) >= LINE_CHARS and not text.startswith("```"):
            places = self.places.setdefault(text, [])
            places.append(place)
            if len(places) == LINE_TIMES:
                self.keep = places[1]


def guarded(pieces: Iterable[str]) -> Iterator[str]:
    """The pieces up to the one with which the reply loops."""
    state = LoopState()
    for p in pieces:
        looped = state.feed(p)
        yield p
        if looped:
            return


def kept_length(text: str | None, piece: int = 16) -> int | None:
    """The length kept of a reply that is fed in pieces; null if it doesn't loop."""
    state = LoopState()
    for i in range(0, len(text or ""), piece):
        if state.feed(text[i : i + piece]):
            return len(text[: state.keep].rstrip())
    return None


def loop_cut(text: Column) -> Column:
    """``kept_length`` of each reply of a column."""

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([kept_length(t) for t in texts], dtype="Int32")

    return run(text)
