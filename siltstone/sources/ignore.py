"""Ignore rules of a project. [SRC-3]"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is never indexed.
DEFAULT_PATTERNS = ("node_modules", ".git", "dist", "build", ".next", ".nuxt", "coverage", ".cache", ".siltstone", ".DS_Store", "*.pyc", "__pycache__", ".venv", "venv", ".env", ".idea", ".vscode", "*.min.js", "*.min.css", "*.map", "package-lock.json", "yarn.lock", "pnpm-lock.yaml")


def read_patterns(ignore_text: str | None) -> list[str]:
    """The defaults and a .gitignore's lines: comments, blank lines and ``!`` exceptions are left out, a slash at the end goes."""
    own = [line.strip() for line in (ignore_text or "").splitlines()]
    own = [line.rstrip("/") for line in own if line and line[0] not in "#!"]
    return [*DEFAULT_PATTERNS, *[p for p in own if p]]


def segment_regex(pattern: str) -> str | None:
    """The expression that a single path segment is held against; None for a pattern without ``*``, which is taken literally."""
    if "*" not in pattern:
        return None
    return "^" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern) + "$"


def is_ignored(path: Column, patterns: Sequence[str]) -> Column:
    """True where the path equals a pattern, lies under one, or has a segment that fits one. One alternation per kind of test."""
    literal = [p for p in patterns if "*" not in p]
    globs = [r for p in patterns if (r := segment_regex(p))]
    segments = F.split(path, "/")
    out = F.lit(False)
    if literal:
        out = out | F.arrays_overlap(segments, F.lit(literal))
        for p in literal:
            if "/" in p:
                out = out | (path == p) | path.startswith(p + "/")
    if globs:
        out = out | F.exists(segments, lambda s: s.rlike("|".join(f"(?:{g})" for g in globs)))
    return out
