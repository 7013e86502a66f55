"""Python files of a folder: the driver lists names, executors read and decode."""

from __future__ import annotations

import fnmatch
import io
import os
import re
import tokenize
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.arrow import batch

# Fixed values.
SKIPPED = frozenset((".git", ".hg", ".svn", ".venv", "venv", "node_modules", "__pycache__"))
MAX_BYTES = 2_000_000


class Ignore:
    """The rules of one ignore file: later ones win, ``!`` takes back, a slash ties to the folder."""

    def __init__(self, text: str):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.splitlines():
            rule = line.rstrip()
            if not rule or rule.startswith("#"):
                continue
            taken_back = rule.startswith("!")
            rule = rule.removeprefix("!").removeprefix("\\")
            only_dirs = rule.endswith("/")
            rule = rule.rstrip("/")
            tied = "/" in rule
            parts = [p for p in rule.split("/") if p]
            pattern = "/".join(".*" if p == "**" else fnmatch.translate(p)[4:-3].replace(".*", "[^/]*") for p in parts).replace(".*/", "(?:.*/)?")
            self.rules.append((re.compile(("" if tied else "(?:.*/)?") + pattern + r"\Z", re.S), not taken_back, only_dirs))

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        out = None
        for pattern, ignored, only_dirs in self.rules:
            if (is_dir or not only_dirs) and pattern.match(path):
                out = ignored
        return out


def list_files(root: str | Path, skip: frozenset[str] = SKIPPED) -> list[str]:
    """Relative paths of the Python files, sorted; no links, no skipped or ignored folders. Of the ignore
    files on the way to a path the deepest with a verdict decides."""
    root, out = Path(root), []

    def walk(folder: Path, rules: list[tuple[str, Ignore]]) -> None:
        own = folder / ".gitignore"
        here = folder.relative_to(root).as_posix()
        base = "" if here == "." else here + "/"
        if own.is_file():
            rules = [*rules, (base, Ignore(own.read_text(errors="replace")))]

        def ignored(name: str, is_dir: bool) -> bool:
            path = base + name
            told = [v for at, r in rules if (v := r.verdict(path[len(at) :], is_dir)) is not None]
            return bool(told and told[-1])

        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            if entry.is_symlink() or entry.name.startswith("._"):
                continue
            if entry.is_dir():
                if entry.name not in skip and not ignored(entry.name, True):
                    walk(Path(entry.path), rules)
            elif entry.name.endswith(".py") and not ignored(entry.name, False):
                out.append(base + entry.name)

    walk(root, [])
    return out


def decode(data: bytes) -> str:
    """By byte order mark or coding line, else UTF-8 with replacement; without the mark."""
    try:
        name, _ = tokenize.detect_encoding(io.BytesIO(data).readline)
        text = data.decode(name)
    except (SyntaxError, UnicodeDecodeError, LookupError):
        text = data.decode("utf-8", errors="replace")
    return text.removeprefix("﻿")


def _read(root: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, sources = [], []
            for path in b.column(0).to_pylist():
                try:
                    data = Path(root, path).read_bytes()
                except OSError:
                    continue
                if len(data) <= limit and b"\0" not in data:
                    paths.append(path)
                    sources.append(decode(data))
            yield batch(("path", "source"), (pa.array(paths, pa.string()), pa.array(sources, pa.string())))

    return run


def read_repository(spark: SparkSession, root: str | Path, max_bytes: int = MAX_BYTES, skip: frozenset[str] = SKIPPED) -> DataFrame:
    """``path, source`` of a folder that the executors can read. Files that are too large, unreadable or
    hold a zero byte are left out."""
    paths = list_files(root, skip)
    tasks = max(1, min(len(paths) // 50, 1000))
    names = spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks)
    return names.mapInArrow(_read(str(root), max_bytes), "path string, source string")
