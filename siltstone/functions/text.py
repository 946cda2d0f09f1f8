"""Scalar functions as Spark columns: text, tokens, paths, languages. All stay in the JVM.

Survey ids are given in brackets.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript's trim sees it.
SPACES = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# Words that carry no meaning in names.
STOP_WORDS = ("a", "an", "and", "for", "get", "has", "is", "of", "on", "or", "set", "the", "to")

# Words of programming languages that are never reported as a symbol.
LANGUAGE_KEYWORDS = (
    "if", "else", "for", "while", "do", "switch", "case", "break", "continue", "return", "throw", "try", "catch", "finally", "new",
    "delete", "typeof", "instanceof", "in", "of", "void", "class", "extends", "super", "import", "export", "default", "const", "let",
    "var", "function", "async", "await", "yield", "with", "debugger", "enum", "implements", "interface", "package", "private",
    "protected", "public", "static", "abstract", "readonly", "declare", "type", "namespace", "module", "from", "as", "get", "set",
    "true", "false", "null", "undefined", "this", "def", "elif", "except", "lambda", "pass", "raise", "assert", "global", "nonlocal",
    "and", "or", "not", "is", "end", "then", "begin", "fn", "mut", "pub", "use", "mod", "crate", "impl", "trait", "where", "loop",
    "match", "move", "ref", "struct", "Self", "self", "unsafe", "extern",
)

# File extensions of each language.
LANGUAGES = {
    "typescript": (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"),
    "python": (".py", ".pyi"),
    "csharp": (".cs",),
    "gdscript": (".gd",),
    "ruby": (".rb",),
}
EXTENSION_LANGUAGE = {e: name for name, es in LANGUAGES.items() for e in es}

# Names of test files by extension; the part before them is free.
TEST_FOLDERS = r"(?i)(__tests?__/|(^|/)(tests?|spec|fixtures)/)"
TEST_NAMES = {
    ".ts": r"(?i)\.(test|spec)\.ts$",
    ".tsx": r"(?i)\.(test|spec)\.tsx$",
    ".js": r"(?i)\.(test|spec)\.js$",
    ".jsx": r"(?i)\.(test|spec)\.jsx$",
    ".mjs": r"(?i)\.(test|spec)\.mjs$",
    ".py": r"(?i)(^|/)(test_|_test\.py$)",
    ".cs": r"(?i)(tests?|specs?)\.cs$",
    ".rb": r"(?i)(^|/)(_test\.rb$|_spec\.rb$)",
    ".gd": r"(?i)\.test\.gd$",
}
#: What the rules above miss, with ``strict``.
STRICT_TEST_NAMES = {".py": r"(?i)(^|/)(test_[^/]*|[^/]*_test)\.py$", ".rb": r"(?i)_(test|spec)\.rb$"}
TEST_PATH = r"(/__tests__/|/__test__/|/tests/|/test/|/fixtures/|[./](spec|test)\.[^/]+$)"

# Symbol kinds in the order in which they are preferred.
KIND_ORDER = ("class", "function", "method", "interface", "type")


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def hash_text(text: Column) -> Column:
    """[FN-1] SHA-256 of the text with line ends made LF, byte order marks and trailing white space removed."""
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\ufeff"), F.lit(""))
    return F.sha2(F.rtrim(unix, F.lit(SPACES)), 256)


def token_estimate(text: Column) -> Column:
    """[FN-2] A quarter of the trimmed length, rounded up; 0 for blank."""
    return F.ceil(F.length(trimmed(text)) / 4).cast("int")


def stem(token: Column) -> Column:
    """[FN-4] The first rule that fits: -ing, -ied, -ed, -es, -s of words long enough."""
    n = F.length(token)
    cut = lambda k: token.substr(F.lit(1), n - k)
    return (
        F.when((n > 5) & token.endswith("ing"), cut(3))
        .when((n > 4) & token.endswith("ied"), F.concat(cut(3), F.lit("y")))
        .when((n > 4) & token.endswith("ed"), cut(2))
        .when((n > 4) & token.endswith("es"), cut(2))
        .when((n > 3) & token.endswith("s"), cut(1))
        .otherwise(token)
    )


def name_tokens(text: Column) -> Column:
    """[FN-3] Stemmed words of a name or text: camel case and ``_``/``-`` split, lower-cased, stop words dropped after stemming."""
    return _stemmed(_words(text))


def _words(text: Column) -> Column:
    return F.split(F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+")


def _stemmed(words: Column) -> Column:
    return F.filter(F.transform(words, stem), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def distinct_tokens(text: Column) -> Column:
    """The distinct ``name_tokens``. Words are made distinct before they are stemmed, so a long text's repeats cost little."""
    return F.array_distinct(_stemmed(F.array_distinct(_words(text))))


def token_overlap(query: Column, text: Column) -> Column:
    """[AGG-15, SET-4] How many distinct tokens of ``query`` (an array) the text has."""
    return F.size(F.array_intersect(query, distinct_tokens(text)))


def normalize_path(path: Column) -> Column:
    """[PRJ-8] ``\\`` made ``/``, ``.`` and empty segments dropped, ``..`` folded into what it follows."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    up = lambda done: (F.size(done) > 0) & (F.element_at(done, -1) != "..")
    fold = lambda done, s: F.when((s == "..") & up(done), F.slice(done, 1, F.size(done) - 1)).otherwise(F.array_append(done, s))
    folded = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), fold), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), folded)).otherwise(folded)


def extension(path: Column) -> Column:
    """The lower-cased extension with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def language_of(path: Column) -> Column:
    """[SRC-12] Language of a path by extension, ``plaintext`` for others."""
    found = F.lit("plaintext")
    for name, extensions in LANGUAGES.items():
        found = F.when(extension(path).isin(*extensions), name).otherwise(found)
    return found


def is_test_file(path: Column, *, strict: bool = False) -> Column:
    """[FLT-6] Test file by folder or by the name rule of its extension; ``strict`` adds names that the plain rules miss."""
    unix = F.regexp_replace(path, r"\\", "/")
    found = unix.rlike(TEST_FOLDERS)
    for ext, pattern in TEST_NAMES.items():
        found = found | (unix.endswith(ext) & unix.rlike(pattern))
    if strict:
        for ext, pattern in STRICT_TEST_NAMES.items():
            found = found | (unix.endswith(ext) & unix.rlike(pattern))
    return found


def is_test_path(path: Column) -> Column:
    """[FLT-7] The module graph's rule: a test folder below the top, or a ``.test.``/``.spec.`` name."""
    return F.lower(path).rlike(TEST_PATH)


def module_key(path: Column) -> Column:
    """[PRJ-6] The first two path segments; ``root`` for a path of one."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) == 1, F.lit("root")).otherwise(F.array_join(F.slice(parts, 1, 2), "/"))


def glob_regex(pattern: str) -> str:
    """[FLT-8] An anchored expression for ``**`` (anything) and ``*`` (anything but ``/``). A pattern with ``?`` fits nothing but
    a literal ``[``-text, as in the original rule."""
    pattern = pattern.strip().replace("\\", "/").removeprefix("./")
    out = []
    for piece in re.split(r"(\*\*|\*|\?)", pattern):
        out.append({"**": ".*", "*": "[^/]*", "?": r"\[^/]"}.get(piece) or re.escape(piece).replace("/", "/"))
    return "^" + "".join(out) + "$"


def matches_globs(path: Column, patterns: Sequence[str]) -> Column:
    """[FLT-8, FLT-9]"""
    unix = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", "")
    out = F.lit(False)
    for p in patterns:
        out = out | unix.rlike(glob_regex(p))
    return out


def under_prefix(path: Column, prefix: str) -> Column:
    """[FLT-3] The path itself or anything below it, by whole segments."""
    p = prefix.rstrip("/")
    return (path == p) | path.startswith(p + "/")


def has_prefix(path: Column, prefix: str) -> Column:
    """[FLT-1, FLT-2, FLT-4] Starts with the prefix as text, letter case counting, no wildcards."""
    return path.startswith(prefix)


def clean_prefix(prefix: str | None) -> str | None:
    """[PRJ-9] A trimmed prefix; None for an empty one or one that means the root."""
    p = (prefix or "").strip()
    p = p.removeprefix("./")
    return None if p in ("", ".") else p


def contains_name(name: Column, query: str) -> Column:
    """[FLT-5, FLT-4] Substring match whatever the letter case."""
    return F.instr(F.lower(name), query.lower()) > 0


def name_rank(name: Column, query: str) -> Column:
    """[WIN-4] 0 the same, 1 the same but for letter case, 2 starts so, 3 other."""
    low = F.lower(name)
    return F.when(name == query, 0).when(low == query.lower(), 1).when(low.startswith(query.lower()), 2).otherwise(3)


def kind_rank(kind: Column) -> Column:
    """[WIN-4, SRT-6]"""
    out = F.lit(len(KIND_ORDER))
    for i, k in enumerate(KIND_ORDER):
        out = F.when(kind == k, i).otherwise(out)
    return out


def camel_head(name: Column) -> Column:
    """[FN-8] The part of a camel-case name before its first inner capital."""
    return F.element_at(F.split(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), " "), 1)


def parse_symbol(query: str) -> tuple[str | None, str]:
    """[FN-9] ``file::symbol`` as (file, symbol). The left side is a file only if it looks like a path, so ``A::B`` is a name."""
    head, mark, rest = query.partition("::")
    if mark and ("/" in head or "." in head):
        return head, rest.partition("::")[0]
    return None, query


def relative_to(path: Column, base: str) -> Column:
    """[FN-12] The path without ``base/`` in front."""
    b = base.rstrip("/") + "/"
    return F.when(path.startswith(b), path.substr(F.lit(len(b) + 1), F.length(path))).otherwise(path)


def line_slice(content: Column, start: Column, end: Column) -> Column:
    """[PRJ-4] Lines start to end, counted from 1, clamped to the text."""
    lines = F.split(content, "\n", -1)
    first = F.greatest(start, F.lit(1))
    last = F.least(end, F.size(lines))
    return F.when(last >= first, F.array_join(F.slice(lines, first, last - first + 1), "\n")).otherwise("")


def locale_order(path: Column) -> Column:
    """[SRT-5] The path as a sort key in the order of the Unicode collation, as file lists are shown: letter case decides last."""
    return F.collate(path, "UNICODE")


def parse_version(version: str) -> tuple[int, int, int] | None:
    """[FN-16] Major, minor and patch of ``1.2.3``; None for anything else."""
    found = re.fullmatch(r"\s*(\d+)\.(\d+)\.(\d+)\s*", version)
    return tuple(int(g) for g in found.groups()) if found else None


def newer_version(a: str, b: str) -> bool:
    """[FN-16] Whether ``a`` is a later version than ``b``; false where either isn't one."""
    x, y = parse_version(a), parse_version(b)
    return bool(x and y and x > y)


def signature(text: Column) -> Column:
    """[PRJ-5] The first line of the trimmed text."""
    return trimmed(F.element_at(F.split(trimmed(text), r"\r?\n", -1), 1))


def framework_hint(content: Column, language: Column) -> Column:
    """[FN-13] A framework that the text shows signs of; null without one."""
    low = F.lower(content)
    python = F.when(low.contains("django"), "django").when(low.contains("fastapi"), "fastapi").when(low.contains("flask"), "flask")
    ruby = F.when(content.rlike(r"\b(Rails|ActiveRecord)\b"), "rails").when(content.contains("Sinatra"), "sinatra")
    return (
        F.when(language == "python", python)
        .when((language == "csharp") & content.rlike(r"(?m)^\s*using\s+UnityEngine(\.[\w.]+)?\s*;"), F.lit("unity"))
        .when((language == "gdscript") & content.rlike(r"(?m)^\s*(extends|class_name|signal|onready|export)\b|^\s*@(onready|export)"), F.lit("godot"))
        .when(language == "ruby", ruby)
    )


def exported(language: Column, name: Column, declaration: Column, kind: Column, visibility: Column) -> Column:
    """[FN-14] Whether a symbol is part of its file's surface, by the rule of its language."""
    hidden = name.startswith("_")
    return (
        F.when(language == "typescript", (kind != "method") & declaration.rlike(r"^\s*export\b"))
        .when(language == "csharp", declaration.rlike(r"\b(public|internal)\b"))
        .when(language == "gdscript", (kind == "signal") | ~hidden)
        .when(language == "ruby", kind.isin("class", "module") | ((F.coalesce(visibility, F.lit("public")) == "public") & ~hidden))
        .otherwise(~hidden)
    )


CHUNK_TYPES = ("full_file", "imports", "preamble", "declaration", "module_section", "impl", "types")
IMPORT_LINE = r"(?i)^(import\b|from\s+\S+\s+import\b|using\s+\S+\s*;|export\b.+\bfrom\b|const\s+.+\s*=\s*require\()"
TYPE_WORD = r"(?i)(^|\s)(interface|type|enum|protocol|trait|typedef|delegate)\b"


def chunk_type(stated: Column, content: Column, symbol: Column) -> Column:
    """[FN-10] The stated type if it is one; else told from the symbol, the share of import lines, and type words."""
    known = F.lower(trimmed(stated))
    lines = F.filter(F.transform(F.split(trimmed(content), r"\r?\n"), trimmed), lambda x: x != "")
    imports = F.size(F.filter(lines, lambda x: x.rlike(IMPORT_LINE)))
    return (
        F.when(known.isin(*CHUNK_TYPES), known)
        .when(F.coalesce(symbol, F.lit("")) != "", F.lit("impl"))
        .when(trimmed(content) == "", F.lit("full_file"))
        .when(imports / F.size(lines) >= 0.8, F.lit("imports"))
        .when(trimmed(content).rlike(TYPE_WORD), F.lit("types"))
        .otherwise("impl")
    )


def trim_to_budget(text: str, budget: int) -> str:
    """[FN-11, VEC-4] The text cut until its token estimate fits: once in proportion, then by 15 percent at a time, not below
    32 characters. Plain Python, as the embedding step applies it inside its Arrow batches."""
    estimate = lambda t: -(-len(t.strip()) // 4)
    if budget <= 0 or estimate(text) <= budget:
        return text
    size = max(32, int(len(text) * min(1.0, budget / estimate(text)) * 0.95))
    while estimate(text[:size]) > budget and size > 32:
        size = max(32, int(size * 0.85))
    return text[:size]
