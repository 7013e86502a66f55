"""Tokens of words in Python workers: the same as those of the column expressions in ``text`` and ``stem``.

A word is cut once for all its texts in a task, however often it comes. Words of texts that aren't ASCII are found by the
JVM's pattern, so that one table of letters decides what a word is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import identifier_words

ASCII_WORD = re.compile("[A-Za-z_][A-Za-z0-9_]*|[0-9]+")
_CAMEL = re.compile("(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def word_tokens(word: str, stem: Callable[[str], str] | None = None) -> list[str]:
    """The tokens of one word, with the stems that ``stem`` makes of its parts where they differ from them."""
    marked = _CAMEL.sub("_", word)
    several = "_" in word or marked.find("_", 1) > 0
    low = word.lower()
    parts = [p for p in marked.lower().split("_") if p] if several else [low]
    tokens = [low, *parts] if several else [low]
    if stem:
        tokens += [s for p in parts if (s := stem(p)) != p]
    return tokens


def found_words(text: Column) -> tuple[Column, Column]:
    """A text, if it is ASCII, and else its words."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, text), F.when(~ascii_only, identifier_words(text))


def counted(words: Iterable[str], known: dict[str, tuple[int, list[int]]], wanted: dict[str, int], cut: Callable[[str], list[str]]) -> tuple[int, dict[int, int]]:
    """How many tokens ``cut`` makes of ``words``, and how often each wanted one comes, by its number. ``known``
    keeps what is known of a word."""
    n, found = 0, {}
    for w, times in Counter(words).items():
        entry = known.get(w)
        if entry is None:
            tokens = cut(w)
            entry = known[w] = (len(tokens), [wanted[t] for t in tokens if t in wanted])
        n += times * entry[0]
        for i in entry[1]:
            found[i] = found.get(i, 0) + times
    return n, found
