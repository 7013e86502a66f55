"""Functions paired with their documentation, by island grammars.

Only islands are parsed: decorators or annotations, signatures, documentation and the extent of bodies.
All else is water, of which just strings, comments and brackets are told apart so that no island is
seen inside them. Two grammars: indented bodies (Python) and braced bodies (documentation comments
before the signature; Java, JavaScript, TypeScript, C, C++, C#, Go, Rust, Kotlin, Swift, PHP, Scala).

Defined cases: null and empty sources give no rows. A signature that never closes, or whose parameters
don't parse, gives no row; the scan goes on at the next line that begins a definition. Line ends may be
mixed. A language that has no grammar here is read as Python, as is a null one. Re-delivered rows count
once. Documentation is trivial, and its function dropped, if after punctuation it begins with a
placeholder word, or if fewer than ``least`` words remain that aren't words of the function's own name.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from inspect import cleandoc
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import batch

# Fixed values.
PLACEHOLDERS = frozenset(("todo", "fixme", "xxx", "tbd", "placeholder"))
BRACED = frozenset("java javascript typescript js ts c cpp c++ c# csharp go rust kotlin swift php scala".split())

_WORD = re.compile(r"[^\W_]+")
_HEAD = re.compile(r"[ \t\f]*(?:(?P<none>(?:#[^\n]*)?(?:\n|\Z))|(?P<mark>(?:<{7}|={7}|>{7})[^\n]*(?:\n|\Z))|(?P<def>(?:async[ \t]+)?def[ \t]+(?P<name>\w+))|(?P<class>class[ \t]+\w+)|(?P<dec>@)|)")
_STRING = r"""(?:[rRbBuUfFtT]{1,2})?(?:\"{3}|'{3}|"(?:[^"\\\n]|\\(?:.|\n))*+"|'(?:[^'\\\n]|\\(?:.|\n))*+')"""
_TOKEN = re.compile(rf"{_STRING}|#[^\n]*|[(\[{{]|[)\]}}]|\\\n|\n")
_LITERAL = re.compile(_STRING)
_GAP = re.compile(r"(?:[ \t\f]|\\\n)*")
_WIDE_GAP = re.compile(r"(?:\s|\\\n|#[^\n]*)*")
_RESET = re.compile(r"[ \t\f]*(?:(?:async[ \t]+)?def[ \t]+\w+[ \t]*[(\[]|class[ \t]+\w+[ \t]*[(:\[])")
_HEADER_REST = re.compile(r"[ \t]*(?=[(\[])")
_ODD = re.compile(r"[(,]\s*[=:,]|\(\s*\*\s*\)|=\s*[,)]")


class Found(NamedTuple):
    start_line: int
    end_line: int
    name: str
    kind: str
    docstring: str | None
    source: str


def is_trivial(doc: str, name: str, least: int = 4) -> bool:
    words = _WORD.findall(doc.lower())
    if words and words[0] in PLACEHOLDERS:
        return True
    own = set(name.lower().split("_"))
    return sum(w not in own for w in words) < least


def _string_end(src: str, start: int, end: int) -> int:
    """Where the literal that matched ``start:end`` ends; a triple quote's match is only its opening."""
    mark = src[end - 3 : end]
    if mark not in ('"""', "'''") or end - start > 5:
        return end
    at = end
    while True:
        close = src.find(mark, at)
        if close < 0:
            return len(src)
        back = close
        while back > end and src[back - 1] == "\\":
            back -= 1
        if (close - back) % 2 == 0:
            return close + 3
        at = close + 1


def _documentation(src: str, at: int) -> str | None:
    """The string, perhaps in brackets, that is the first statement from ``at`` on, inside a body."""
    parts, brackets = [], 0
    while src.startswith("(", at):
        brackets += 1
        at = _WIDE_GAP.match(src, at + 1).end()
    gap = _WIDE_GAP if brackets else _GAP
    while True:
        m = _LITERAL.match(src, at)
        if not m:
            break
        end = _string_end(src, at, m.end())
        raw = src[at:end]
        prefix = raw[: min(raw.index(q) for q in "\"'" if q in raw)].lower()
        if set(prefix) & set("bft"):
            return None
        body = raw[len(prefix) :]
        body = body[3:-3] if body[:3] in ('"""', "'''") and len(body) >= 6 else body[1:-1]
        if "\\" in body and "r" not in prefix:
            try:
                body = ast.literal_eval(raw)
            except (ValueError, SyntaxError):
                return None
        parts.append(body)
        at = gap.match(src, end).end()
    for _ in range(brackets):
        if not src.startswith(")", at):
            return None
        brackets -= 1
        at = (_WIDE_GAP if brackets else _GAP).match(src, at + 1).end()
    if not parts or (at < len(src) and src[at] not in "\n;#"):
        return None
    return "".join(parts)


class _Header(NamedTuple):
    end: int
    parameters: str


def _header(src: str, at: int) -> _Header | None:
    """The signature whose name ends at ``at``: where its colon ends; None if it is unsound."""
    m = _HEADER_REST.match(src, at)
    if not m:
        return None
    depth, pos, opened = 0, m.end(), m.end()
    for t in _TOKEN.finditer(src, pos):
        if t.start() < pos:
            continue
        text = t.group()
        if text in "([{":
            depth += 1
        elif text in ")]}":
            depth -= 1
            if depth < 0:
                return None
            if depth == 0:
                rest = re.compile(r"[ \t]*(?=[(\[])|[ \t]*(?=:)|[ \t]*(?=->)").match(src, t.end()) if src[opened] == "[" else None
                if rest and src[rest.end() : rest.end() + 1] == "(":
                    continue
                pos = t.end()
                break
        elif text == "\n":
            if _RESET.match(src, t.end()):
                return None
        elif text[0] not in "#\\":
            pos = _string_end(src, t.start(), t.end())
    if depth or pos <= opened:
        return None
    parameters = src[opened:pos]
    # the returned type, up to the colon at depth 0
    for t in re.compile(r":|\n|[(\[{]|[)\]}]|#").finditer(src, pos):
        text = t.group()
        if text in "([{":
            depth += 1
        elif text in ")]}":
            depth -= 1
        elif text == "\n" and depth == 0 or text == "#":
            return None
        elif text == ":" and depth == 0:
            between = src[pos : t.start()].strip()
            if between and not (between.startswith("->") and between[2:].strip()):
                return None
            if _ODD.search(parameters) or len(between) > 2 and "=" in between:
                try:
                    ast.parse(f"def f{parameters}{between}: pass")
                except (SyntaxError, ValueError):
                    return None
            return _Header(t.end(), parameters)
    return None


def _width(blank: str) -> int:
    return len(blank.expandtabs(8))


def scan_indented(source: str) -> Iterator[Found]:
    """Every function and method of Python source with its documentation, also if it is None or trivial."""
    src = re.sub(r"\r\n?", "\n", source)
    feeds = [i for i, c in enumerate(src) if c == "\n"] if len(src) < 256 else [m.start() for m in re.finditer("\n", src)]
    pos, pending, last_end = 0, None, 0
    open_: list[list] = []  # indent, kind, start, name, documentation

    def close(to: int) -> Iterator[Found]:
        while open_ and open_[-1][0] >= to:
            _, kind, start, name, doc = open_.pop()
            if kind != "class":
                yield Found(bisect_right(feeds, start - 1) + 1, bisect_right(feeds, max(last_end - 1, start)) + 1, name, kind, doc, src[start:last_end])

    while pos < len(src):
        m = _HEAD.match(src, pos)
        kind = m.lastgroup
        if kind == "name":
            kind = "def"
        if kind in ("none", "mark"):
            pos = m.end() if m.end() > pos else pos + 1
            continue
        body = m.end() if kind is None else m.start(kind)
        indent = _width(src[pos:body])
        if open_ and open_[-1][0] >= indent:
            yield from close(indent)
        start, at = pos, m.end()
        if kind == "dec":
            pending = pos if pending is None else pending
        elif kind == "class":
            open_.append([indent, "class", pos, "", None])
            pending = None
        elif kind == "def":
            head = _header(src, m.end())
            if head:
                at = head.end
                start = pos if pending is None else pending
                inside = "method" if open_ and open_[-1][1] == "class" else "function"
                open_.append([indent, inside, start, m.group("name"), _first_statement(src, at, indent)])
            pending = None
        else:
            pending = None
        # the rest of the logical line
        depth, pos = 0, len(src)
        skip = at
        for t in _TOKEN.finditer(src, at):
            if t.start() < skip:
                continue
            text = t.group()
            if text == "\n":
                if depth <= 0:
                    pos = t.end()
                    break
                ahead = _RESET.match(src, t.end())
                if ahead:
                    pos, pending = _before(src, t.end(), start)
                    break
            elif text in "([{":
                depth += 1
            elif text in ")]}":
                depth -= 1
            elif text[0] not in "#\\":
                skip = _string_end(src, t.start(), t.end())
                if skip > t.end() and skip - t.start() > 5:
                    # the finditer goes on inside a triple-quoted string: start anew behind it
                    depth, pos, pending = yield from _resume(src, skip, depth, start, pending)
                    break
        last_end = len(src[:pos].rstrip()) if pos >= len(src) else pos - 1
    yield from close(0)


def _resume(src: str, at: int, depth: int, start: int, pending: int | None):
    """The rest of a logical line behind a triple-quoted string; a generator only so that it nests."""
    while True:
        for t in _TOKEN.finditer(src, at):
            text = t.group()
            if text == "\n":
                if depth <= 0:
                    return depth, t.end(), pending
                if _RESET.match(src, t.end()):
                    pos, pending = _before(src, t.end(), start)
                    return depth, pos, pending
            elif text in "([{":
                depth += 1
            elif text in ")]}":
                depth -= 1
            elif text[0] not in "#\\":
                end = _string_end(src, t.start(), t.end())
                if end != t.end():
                    at = end
                    break
        else:
            return depth, len(src), pending
        yield from ()


def _before(src: str, at: int, start: int) -> tuple[int, int | None]:
    """Where a definition found inside an unclosed bracket begins: its decorator lines go with it."""
    pending = None
    line = at
    while line > start:
        above = src.rfind("\n", 0, line - 1) + 1
        if above <= start or not src[above:line].lstrip().startswith("@"):
            break
        pending = line = above
    return at, pending


def _first_statement(src: str, at: int, indent: int) -> str | None:
    """Documentation of the body whose header's colon ends at ``at``."""
    here = _GAP.match(src, at).end()
    if here < len(src) and src[here] not in "#\n":
        return _documentation(src, here)
    line = src.find("\n", here) + 1
    while line:
        m = re.compile(r"[ \t\f]*").match(src, line)
        if m.end() >= len(src):
            return None
        if src[m.end()] in "#\n":
            line = src.find("\n", m.end()) + 1
            continue
        return _documentation(src, m.end()) if _width(m.group()) > indent else None
    return None


_BRACE_TOKEN = re.compile(r"""/\*\*?(?:[^*]|\*(?!/))*\*/|//[^\n]*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|[{};]""", re.S)
_NAME_BEFORE = re.compile(r"(?:^|[\s*&:.>])(~?[A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?\s*$")
_AFTER = re.compile(r"[^{};=]*(?:=>\s*)?$")
_NOT_NAMES = frozenset("if for while switch catch return synchronized using lock function func fn sizeof match when with".split())
_TYPE = re.compile(r"\b(?:class|interface|struct|impl|trait|enum|object|record)\b[^()=]*$")
_PARENTHESIS = re.compile(r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[()]""")
_COMMENT_MARK = re.compile(r"^\s*(?:/\*\*?|\*/|\*|///?!?)|\*/\s*$", re.M)


def _signature(head: str) -> tuple[str, int] | None:
    """Name and place of the function whose signature ends ``head``: its parameters are the first bracket of
    balanced parentheses with a name before it and no statement behind it."""
    depth, groups, at = 0, [], 0
    for m in _PARENTHESIS.finditer(head):
        if m.group() == "(":
            at = m.start() if depth == 0 else at
            depth += 1
        elif m.group() == ")" and depth:
            depth -= 1
            if depth == 0:
                groups.append((at, m.end()))
    for begin, end in groups:
        m = _NAME_BEFORE.search(head, max(0, begin - 400), begin)
        if m and m.group(1) not in _NOT_NAMES and _AFTER.match(head, end):
            return m.group(1), m.start(1)
    return None


def scan_braced(source: str) -> Iterator[Found]:
    """Every function with a braced body; its documentation is the comment that stands right before it."""
    src = re.sub(r"\r\n?", "\n", source)
    feeds = [m.start() for m in re.finditer("\n", src)]
    since, comments, open_ = 0, [], []
    for t in _BRACE_TOKEN.finditer(src):
        text = t.group()
        if text[0] == "/":
            if src[since : t.start()].strip() == "":
                if not comments or src[comments[-1][1] : t.start()].count("\n") > 1 or text.startswith("/*"):
                    comments = []
                comments.append((t.start(), t.end()))
                since = t.end()
        elif text == "{":
            head = src[since : t.start()]
            named = _signature(head)
            if named and not re.search(r"\b(?:new|return|else|=)\s*$", head[: named[1]]):
                doc = "\n".join(src[a:b] for a, b in comments)
                kind = "method" if open_ and open_[-1][1] == "class" else "function"
                begin = since + len(head) - len(head.lstrip())
                open_.append((begin, kind, named[0], cleandoc(_COMMENT_MARK.sub("", doc)).strip() or None))
            else:
                open_.append((since, "class" if _TYPE.search(head) else "block", "", None))
            since, comments = t.end(), []
        elif text == "}":
            if open_:
                begin, kind, name, doc = open_.pop()
                if name:
                    yield Found(bisect_right(feeds, begin - 1) + 1, bisect_right(feeds, t.start()) + 1, name, kind, doc, src[begin : t.end()])
            since, comments = t.end(), []
        elif text == ";":
            since, comments = t.end(), []


def _pairs(least: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for item, lang, source in zip(*(c.to_pylist() for c in b.columns)):
                scan = scan_braced if (lang or "").strip().lower() in BRACED else scan_indented
                for f in scan(source):
                    if f.docstring is None or is_trivial(f.docstring, f.name, least):
                        continue
                    text = (cleandoc(f.docstring), f.source) if with_text else (None, None)
                    rows.append((item, f.start_line, f.end_line, f.name, f.kind, *text))
            if rows:
                yield batch(("file_id", "start_line", "end_line", "symbol", "kind", "docstring", "source"), [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)])

    return run


_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
_SCHEMA = "file_id long, start_line int, end_line int, symbol string, kind string, docstring string, source string"


def documented_functions(
    df: DataFrame, id_col: str, lang_col: str, source_col: str, least: int = 4, with_text: bool = True
) -> DataFrame:
    """One row per function or method with documentation that isn't trivial: its lines (1-based, from its
    first decorator on), name, kind, documentation and code."""
    files = df.select(F.col(id_col).cast("long").alias("file_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    found = files.where("file_id is not null and length(source) > 0").mapInArrow(_pairs(least, with_text), _SCHEMA)
    found = found if with_text else found.drop("docstring", "source")
    return found.dropDuplicates(["file_id", "start_line"])
