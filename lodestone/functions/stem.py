"""English stems by the published Porter2 algorithm."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithm.
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

_VOWEL = "aeiouy"
_REGION = re.compile(f"[{_VOWEL}][^{_VOWEL}]")


def _regions(w: str) -> tuple[int, int]:
    special = re.match("gener|commun|arsen", w)
    if special:
        r1 = special.end()
    else:
        m = _REGION.search(w)
        r1 = m.end() if m else len(w)
    m = _REGION.search(w, r1)
    return r1, m.end() if m else len(w)


def _ends_short(w: str) -> bool:
    return bool(re.search(f"(?:[^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY]|^[{_VOWEL}][^{_VOWEL}])$", w))


def stem_word(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters stay."""
    if len(word) < 3:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = word.lstrip("'") if word.startswith("'") else word
    w = re.sub(f"(?<=[{_VOWEL}])y|^y", "Y", w)
    r1, r2 = _regions(w)
    # 0
    for e in ("'s'", "'s", "'"):
        if w.endswith(e):
            w = w[: -len(e)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_VOWEL}].+$", w[:-1]):
        w = w[:-1]
    if w in KEPT_AFTER_1A:
        return w
    # 1b
    for e in ("eedly", "eed"):
        if w.endswith(e):
            if len(w) - len(e) >= r1:
                w = w[: -len(e)] + "ee"
            break
    else:
        for e in ("ingly", "edly", "ing", "ed"):
            if w.endswith(e):
                rest = w[: -len(e)]
                if re.search(f"[{_VOWEL}]", rest):
                    w = rest
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(DOUBLES):
                        w = w[:-1]
                    elif len(w) <= r1 and _ends_short(w):
                        w += "e"
                break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    # 2
    for e, to in STEP2:
        if w.endswith(e):
            at = len(w) - len(e)
            if at >= r1 and (e != "ogi" or w[at - 1 : at] == "l") and (e != "li" or w[at - 1 : at] in tuple(LI_ENDINGS)):
                w = w[:at] + to
            break
    # 3
    for e, to in STEP3:
        if w.endswith(e):
            at = len(w) - len(e)
            if at >= r1 and (e != "ative" or at >= r2):
                w = w[:at] + to
            break
    # 4
    for e in STEP4:
        if w.endswith(e):
            at = len(w) - len(e)
            if at >= r2 and (e != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    # 5
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or at >= r1 and not _ends_short(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stems(word: Column) -> Column:
    """The stem of each word of a column; apply it to distinct words and join back."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(stem_word, na_action="ignore")

    return run(word)


def added_stems(parts: Column) -> Column:
    """The stems of an array's words where they differ from the word; each distinct word is stemmed once a batch."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def one(words):
            out = []
            for w in words:
                s = known.get(w)
                if s is None:
                    s = known[w] = stem_word(w)
                if s != w:
                    out.append(s)
            return out

        return lists.map(one, na_action="ignore")

    return run(parts)
