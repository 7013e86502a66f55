"""Text and code functions as column expressions; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WORD = r"[\p{L}_][\p{L}\p{N}_]*|\p{Nd}+"
QUERY_STOPWORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
    has had having do does did doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
    just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn
    wasn weren won wouldn""".split()
)
TERM_STOPWORDS = tuple(
    "a an and are as at be by can do does for from how i in is it of on or should that the this to use used uses what when where which who why with work works".split()
)
HEADER_DOC_CHARS = 400


def identifier_words(text: Column) -> Column:
    """Identifiers and digit runs, in order, case kept; null gives null."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _marked(text: Column) -> Column:
    """``text`` with an underscore at each camel boundary; its words stay as many and in order."""
    return F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_")


def _word_tokens(word: Column, marked: Column) -> Column:
    # without an underscore the word is its only part; each expression is named once, as lambdas share none
    parts = F.filter(F.split(F.lower(marked), "_"), lambda p: p != "")
    # a mark before the word's first letter only parts it from digits
    several = F.contains(word, F.lit("_")) | (F.locate("_", marked, 2) > 0)
    return F.when(several, F.concat(F.array(F.lower(word)), parts)).otherwise(F.array(F.lower(word)))


def identifier_tokens(word: Column) -> Column:
    """The lower-cased word, followed by its snake and camel parts if it has several or its only part
    differs from it."""
    return _word_tokens(word, _marked(word))


def _word_parts(word: Column, marked: Column) -> Column:
    several = F.contains(word, F.lit("_")) | (F.locate("_", marked, 2) > 0)
    return F.when(several, F.filter(F.split(F.lower(marked), "_"), lambda p: p != "")).otherwise(F.array(F.lower(word)))


def identifier_parts(word: Column) -> Column:
    """The lower-cased snake and camel parts of a word; a word of one part is its own part."""
    return _word_parts(word, _marked(word))


def code_parts(text: Column) -> Column:
    """The parts of all words of ``text``, in order."""
    return F.flatten(F.zip_with(identifier_words(text), identifier_words(_marked(text)), _word_parts))


def code_tokens(text: Column) -> Column:
    """The tokens of all words of ``text``, in order."""
    return F.flatten(F.zip_with(identifier_words(text), identifier_words(_marked(text)), _word_tokens))


def looks_like_identifier(word: Column) -> Column:
    return F.contains(word, F.lit("_")) | (F.rlike(word, F.lit(r"^.\P{Lu}*\p{Lu}")) & F.rlike(word, F.lit(r"\p{Ll}")))


def query_words(query: Column) -> Column:
    """Structs ``word, quoted`` of a question: ``quoted`` words stand between backticks."""
    pieces = F.split(query, "`")
    # an odd piece (from 0) is quoted if a closing backtick follows it
    marked = F.transform(pieces, lambda p, i: F.transform(identifier_words(p), lambda w: F.struct(w.alias("word"), ((i % 2 == 1) & (i < F.size(pieces) - 1)).alias("quoted"))))
    return F.flatten(marked)


def query_terms(question: Column) -> Column:
    """The distinct tokens of a question of more than one character that aren't common words."""
    return F.array_distinct(F.filter(code_tokens(question), lambda t: (F.length(t) > 1) & ~t.isin(*TERM_STOPWORDS)))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def embedding_header(path: Column, qualname: Column, kind: Column, docstring: Column) -> Column:
    doc = collapsed(docstring)
    cut = F.when(F.length(doc) > HEADER_DOC_CHARS, F.concat(F.rtrim(F.substring(doc, 1, HEADER_DOC_CHARS)), F.lit("…"))).otherwise(doc)
    line = F.when(F.length(docstring) > 0, F.concat(F.lit("# doc: "), cut, F.lit("\n"))).otherwise("")
    return F.concat(F.lit("# file: "), path, F.lit("\n# symbol: "), qualname, F.lit(" ("), kind, F.lit(")\n"), line)


def content_hash(fingerprint: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(fingerprint, F.decode(F.unhex(F.lit("00")), "UTF-8"), text), 256), 1, 32)


def module_name(path: Column) -> Column:
    """Dotted module of a path: ``src/`` is a source root, a package is named by its folder."""
    bare = F.regexp_replace(path, r"\.[^./]+$", "")
    rooted = F.regexp_replace(bare, r"^src/(?=.)", "")
    return F.translate(F.regexp_replace(rooted, r"(?:^|/)__init__$", ""), "/", ".")


def is_test_path(path: Column) -> Column:
    return F.rlike(path, F.lit(r"(?:^|/)tests?/")) | F.rlike(path, F.lit(r"(?:^|/)(?:test_[^/]*|[^/]*_test\.py|conftest\.py)$"))


def absolute_import(module: Column, level: Column, package: Column) -> Column:
    """``from ..x`` seen from ``package`` (dotted): one part less per level beyond the first; empty past the root."""
    parts = F.filter(F.split(package, r"\."), lambda p: p != "")
    keep = F.size(parts) - (level - 1)
    base = F.array_join(F.slice(parts, 1, F.greatest(keep, F.lit(0))), ".")
    joined = F.concat_ws(".", F.when(base != "", base), F.when(F.length(module) > 0, module))
    return F.when(level == 0, module).when(keep < 0, F.lit("")).otherwise(joined)


def signature(source: Column, kind: Column) -> Column:
    """The first line with text that is neither decorator nor comment; null for modules."""
    lines = F.filter(F.split(source, "\n"), lambda x: (F.trim(x) != "") & ~F.rlike(x, F.lit(r"^\s*[@#]")))
    return F.when(kind != "module", F.trim(F.get(lines, F.lit(0))))


def attribute(value: Column) -> Column:
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def closed_block(body: Column) -> Column:
    return F.replace(body, F.lit("</chunk"), F.lit("</ chunk"))


def query_prefix(model: Column) -> Column:
    """The instruction that English bge models but m3 want before a query."""
    bge = F.contains(F.lower(model), F.lit("bge")) & F.contains(F.lower(model), F.lit("-en")) & ~F.contains(F.lower(model), F.lit("m3"))
    return F.when(bge, F.lit("Represent this sentence for searching relevant passages: ")).otherwise("")


def idf(documents: Column, holding: Column) -> Column:
    return F.log(F.lit(1.0) + (documents - holding + F.lit(0.5)) / (holding + F.lit(0.5)))


def normalised(vector: Column) -> Column:
    """The vector at length 1; a zero vector as it is."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda t, x: t + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm)).otherwise(wide)


def newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


_TAG_GROUP = r"\[\s*C\d+(?:\s*[,;]\s*C\d+)*\s*\]"


def cited_tags(text: Column) -> Column:
    """Cited tags without leading zeros, distinct, in order of first appearance."""
    groups = F.regexp_extract_all(text, F.lit(_TAG_GROUP), F.lit(0))
    tags = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"C(\d+)"), F.lit(1))))
    return F.array_distinct(F.transform(tags, lambda t: F.concat(F.lit("C"), F.regexp_replace(t, r"^0+(?=\d)", ""))))


# Fixed values.
ABSTENTION = "None of the retrieved code answers this question."
_CONTEXT = r"(?:retrieved|provided|given|supplied|above|these|those)\s+(?:code\s+)?(?:chunks?|snippets?|excerpts?|context|sources?)"
_CODE = r"(?:retrieved|provided|given|supplied|above)\s+code"
NEAR_MISS = (
    rf"\b(?:{_CONTEXT}|{_CODE})\b[^.]{{0,80}}?\b(?:do(?:es)?\s+not|do(?:es)?n[’']t|did\s+not|cannot|can[’']t|lacks?|contains?\s+no|has\s+no|have\s+no|without)\b",
    rf"\b(?:not|no|nothing)\b[^.]{{0,60}}?\b(?:in|from|within)\s+(?:the\s+)?(?:{_CONTEXT}|{_CODE})\b",
    r"\b(?:i|we)\s+(?:cannot|can[’']t|could\s+not|couldn[’']t|am\s+unable\s+to|are\s+unable\s+to)\s+(?:find|determine|answer|see|locate|tell)\b",
    r"\bnot\s+(?:enough|sufficient)\s+(?:information|context)\b",
)


def plain_reply(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), "[*_`\"'“”‘’]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"^[ .]+|[ .]+$", "")


def answer_status(text: Column, sentence: str = ABSTENTION) -> Column:
    target = re.sub(r"[ .]+$", "", sentence.lower())
    plain = plain_reply(text)
    return F.when(plain == target, "abstained").when(F.contains(plain, F.lit(target)), "mixed").otherwise("answered")


def near_miss(text: Column) -> Column:
    found = F.lit(False)
    for p in NEAR_MISS:
        found = found | F.rlike(text, F.lit("(?i)" + p))
    return found
