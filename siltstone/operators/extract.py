"""Language extractors: symbols, imports and chunks of each file, in Arrow batches. [EXT-*, CHK-4]

Python is read by the standard library's parser (by line rules where it doesn't parse); the other languages by scanners that
blank out comments and strings and follow braces, ``end`` or indentation. Registering a reader for more extensions is a matter
of adding to ``READERS``.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import EXTENSION_LANGUAGE, trim_to_budget
from siltstone.runtime import ship

SYMBOL = "struct<kind:string,name:string,container_name:string,exported:boolean,start_line:int,end_line:int,signature:string,metadata_json:string>"
IMPORT = "struct<kind:string,specifier:string,line:int>"
CHUNK = "struct<start_line:int,end_line:int,chunk_type:string,primary_symbol:string,content:string>"


@dataclass
class Symbol:
    kind: str
    name: str
    container_name: str | None
    exported: bool
    start_line: int
    end_line: int
    signature: str
    metadata_json: str | None = None


@dataclass
class Import:
    kind: str
    specifier: str
    line: int


@dataclass
class Chunk:
    start_line: int
    end_line: int
    chunk_type: str
    primary_symbol: str | None
    content: str


@dataclass
class Parsed:
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    chunks: list[Chunk] = field(default_factory=list)


def blanked(text: str, *, line: str, block: tuple[str, str] | None, quotes: str) -> str:
    """The text with comments and the insides of strings made spaces; lines stay where they are."""
    parts = [re.escape(line) + r"[^\n]*"]
    if block:
        parts.append(re.escape(block[0]) + r"[\s\S]*?(?:" + re.escape(block[1]) + r"|\Z)")
    parts += [rf"{q}(?:\\.|[^\\{q}\n])*{q}" if q != "`" else r"`(?:\\.|[^\\`])*`" for q in quotes]

    def wipe(m: re.Match) -> str:
        s = m[0]
        keep = s[0] if s[0] in quotes else ""
        body = re.sub(r"[^\n]", " ", s)
        return keep + body[len(keep) : len(body) - len(keep)] + keep if keep and len(s) > 1 else body

    return re.sub("|".join(parts), wipe, text)


def _line_of(text: str) -> Callable[[int], int]:
    starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def at(offset: int) -> int:
        low, high = 0, len(starts)
        while high - low > 1:
            mid = (low + high) // 2
            if starts[mid] <= offset:
                low = mid
            else:
                high = mid
        return low + 1

    return at


def _brace_end(code: str, start: int) -> int:
    """Offset after the brace block that opens at or after ``start``, or after the statement if none opens."""
    depth, i = 0, start
    while i < len(code):
        c = code[i]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return i + 1
        elif c == ";" and depth == 0:
            return i + 1
        i += 1
    return len(code)


def _first_line(text: str) -> str:
    return text.strip().split("\n", 1)[0].strip()


def _slice(lines: list[str], start: int, end: int) -> str:
    return "\n".join(lines[start - 1 : end])


def read_python(text: str, path: str) -> Parsed:
    out, lines = Parsed(), text.split("\n")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return _read_python_lines(text)
    import_lines: list[int] = []

    def walk(node: ast.AST, container: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.Import):
                out.imports += [Import("import", a.name, child.lineno) for a in child.names]
                import_lines.extend((child.lineno, child.end_lineno or child.lineno))
            elif isinstance(child, ast.ImportFrom):
                out.imports.append(Import("import", "." * child.level + (child.module or ""), child.lineno))
                import_lines.extend((child.lineno, child.end_lineno or child.lineno))
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "method" if container else "function"
                meta = json.dumps({"baseClasses": [ast.unparse(b) for b in child.bases]}) if is_class and child.bases else None
                start = min([child.lineno, *[d.lineno for d in child.decorator_list]])
                end = child.end_lineno or child.lineno
                out.symbols.append(Symbol(kind, child.name, container, not child.name.startswith("_"), child.lineno, child.lineno, lines[child.lineno - 1].strip(), meta))
                out.chunks.append(Chunk(start, end, "types" if is_class else "impl", child.name, _slice(lines, start, end)))
                walk(child, child.name if is_class else container)
            else:
                walk(child, container)

    walk(tree, None)
    if import_lines:
        first, last = min(import_lines), max(import_lines)
        out.chunks.insert(0, Chunk(first, last, "imports", None, _slice(lines, first, last)))
    return out


def _read_python_lines(text: str) -> Parsed:
    out, classes = Parsed(), []
    for number, line in enumerate(text.split("\n"), 1):
        indent = len(line) - len(line.lstrip())
        if line.strip():
            classes = [c for c in classes if c[0] < indent]
        if m := re.match(r"\s*import\s+(.+)", line):
            out.imports += [Import("import", p.split(" as ")[0].strip(), number) for p in m[1].split(",")]
        elif m := re.match(r"\s*from\s+(\S+)\s+import\b", line):
            out.imports.append(Import("import", m[1], number))
        elif m := re.match(r"\s*(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)", line):
            kind = "class" if m[1] == "class" else "method" if classes else "function"
            out.symbols.append(Symbol(kind, m[2], classes[-1][1] if classes else None, not m[2].startswith("_"), number, number, line.strip()))
            if kind == "class":
                classes.append((indent, m[2]))
    return out


_TS_WORDS = frozenset("if for while switch catch return new function typeof await super import do else try with".split())


def read_typescript(text: str, path: str) -> Parsed:
    out, lines = Parsed(), text.split("\n")
    code = blanked(text, line="//", block=("/*", "*/"), quotes="\"'`")
    at = _line_of(text)
    depth, depths = 0, []
    for c in code:
        depths.append(depth)
        depth += (c == "{") - (c == "}")
    top = lambda i: depths[i] == 0
    pattern = re.compile(r"(?m)^[ \t]*((?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?)(?:(async\s+)?function\s*\*?\s*([\w$]*)|class\s+([\w$]+)|interface\s+([\w$]+)|type\s+([\w$]+)\s*(?:<[^=]*>)?\s*=)")
    spans: list[tuple[int, int, str, str | None]] = []
    for m in pattern.finditer(code):
        if not top(m.start(1) if m[1] else m.end(1)):
            continue
        kind, name = next((k, m[g]) for k, g in (("class", 4), ("interface", 5), ("type", 6), ("function", 3)) if m[g] is not None)
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        end = _brace_end(code, m.end()) if kind != "type" else _statement_end(code, m.end())
        out.symbols.append(Symbol(kind, name or "anonymous", None, "export" in m[1], at(begin), at(end - 1), _first_line(text[begin:end])))
        spans.append((begin, end, "types" if kind in ("interface", "type") else "impl", name or None))
        if kind == "class":
            inner = depths[begin] + 1
            method = re.compile(r"(?m)^[ \t]*(?:(?:public|protected|private|static|readonly|override|abstract|async|declare|get|set)\s+)*\*?\s*([A-Za-z_$#][\w$]*)\s*(?:<[^>()]*>)?\(")
            for f in method.finditer(code, m.end(), end):
                if depths[f.start(1)] == inner and f[1] not in _TS_WORDS and f[1] != "constructor":
                    stop = _brace_end(code, _close_paren(code, f.end() - 1))
                    begin_line = f.start() + len(f[0]) - len(f[0].lstrip())
                    out.symbols.append(Symbol("method", f[1], name, False, at(begin_line), at(stop - 1), _first_line(text[begin_line:stop])))
    imports = re.compile(r"(?m)^[ \t]*(import|export)\b([^;'\"`]*?\bfrom\s*)?\s*(['\"])")
    import_end = 0
    for m in imports.finditer(code):
        if not top(m.start(1)) or (m[1] == "export" and not m[2]):
            continue
        close = text.find(m[3], m.end())
        if close > 0:
            out.imports.append(Import(m[1], text[m.end() : close], at(m.start(1))))
            if m[1] == "import":
                import_end = max(import_end, at(close))
    out.imports += [Import("require", m[2], at(m.start())) for m in re.finditer(r"\brequire\(\s*(['\"])([^'\"]+)\1", text) if code[m.start() : m.start() + 7] == "require"]
    out.imports += [Import("dynamic_import", m[2], at(m.start())) for m in re.finditer(r"\bimport\(\s*(['\"])([^'\"]+)\1", text) if code[m.start() : m.start() + 6] == "import"]
    out.chunks = _merge_segments(lines, import_end, [(at(a), at(b - 1), k, n) for a, b, k, n in spans], _statement_lines(code))
    return out


def _statement_lines(code: str) -> list[int]:
    """Numbers of the lines on which a top-level statement begins: outside of all brackets, and not going on with the line before."""
    out, depth = [], 0
    for number, line in enumerate(code.split("\n"), 1):
        begun = line.strip()
        if depth == 0 and begun and begun[0] not in ".)]},;?:&|+*=":
            out.append(number)
        depth = max(0, depth + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
    return out


def _statement_end(code: str, start: int) -> int:
    depth = 0
    for i in range(start, len(code)):
        c = code[i]
        depth += (c in "{([") - (c in "})]")
        if depth == 0 and (c == ";" or (c == "\n" and re.match(r"\s*(?:export|import|type|interface|class|function|const|let|var|$)", code[i + 1 :]) and code[start:i].strip())):
            return i + 1
    return len(code)


def _close_paren(code: str, start: int) -> int:
    depth = 0
    for i in range(start, len(code)):
        depth += (code[i] == "(") - (code[i] == ")")
        if depth == 0:
            return i + 1
    return len(code)


# Token sizes of merged TypeScript chunks: what to fill up to, and the most.
TARGET_TOKENS, MAX_TOKENS = 280, 560


def _tokens(text: str) -> int:
    t = text.strip()
    return -(-len(t) // 4)


def _pieces(lines: list[str], start: int, end: int, most: int, shared: int) -> list[tuple[int, int]]:
    """Line ranges of a segment that is too long: each filled up to ``most`` tokens, each begun so far back in the one before that
    they have ``shared`` tokens in common."""
    sizes = [_tokens(line) for line in lines[start - 1 : end]]
    out, first, size = [], 0, 0
    for i, own in enumerate(sizes):
        if i > first and size + own > most:
            out.append((start + first, start + i - 1))
            back, again = i, 0
            while back > first and again < shared:
                back -= 1
                again += sizes[back]
            first, size = back, again
        size += own
    return [*out, (start + first, end)]


def _merge_segments(lines: list[str], import_end: int, spans: list[tuple[int, int, str, str | None]], statements: list[int] = (), target: int = TARGET_TOKENS, most: int = MAX_TOKENS) -> list[Chunk]:
    """Top-level statements as chunks: cut where one has over ``most`` tokens, else gathered until they reach ``target``. Imports and types
    at the top of a file share no chunk with code, and a tiny rest joins the chunk before it."""
    least, shared = min(50, max(1, target // 10)), min(120, target * 15 // 100)
    segments: list[tuple[int, int, str, str | None]] = [(1, import_end, "imports", None)] if import_end else []
    after = import_end + 1
    for start, end, kind, name in [*sorted(spans), (len(lines) + 1, len(lines), "impl", None)]:
        cuts = [after, *(n for n in statements if after < n < start), start]
        segments += [(a, b - 1, "impl", None) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        if end >= after:
            segments.append((max(start, after), end, kind, name))
        after = max(after, end + 1)
    size_of = lambda seg: _tokens(_slice(lines, seg[0], seg[1]))
    preamble = lambda group: group[0][0] == 1 and all(s[2] != "impl" for s in group)
    groups: list[list[tuple[int, int, str, str | None]]] = []
    open_, held = [], 0

    def close() -> None:
        nonlocal open_, held
        if open_:
            groups.append(open_)
        open_, held = [], 0

    for segment in segments:
        whole = size_of(segment) <= most
        for start, end in [segment[:2]] if whole else _pieces(lines, segment[0], segment[1], most, shared):
            piece = (start, end, *segment[2:])
            size = size_of(piece)
            if not size:
                continue
            if open_ and preamble(open_) and piece[2] == "impl" or size > most:
                close()
            if size > most:
                groups.append([piece])
                continue
            fits = held + size <= most or held < least
            if not fits:
                close()
            open_.append(piece)
            held += size
            if fits and held >= target:
                close()
    close()
    if len(groups) > 1 and sum(map(size_of, groups[-1])) < least:
        both = groups[-2] + groups[-1]
        if sum(map(size_of, both)) <= most and not (preamble(groups[-2]) and any(s[2] == "impl" for s in groups[-1])):
            groups[-2:] = [both]
    out = []
    for i, g in enumerate(groups):
        kinds = {s[2] for s in g}
        kind = "impl" if "impl" in kinds else "imports" if kinds == {"imports"} else "preamble" if i == 0 and "imports" in kinds else "types"
        out.append(Chunk(g[0][0], g[-1][1], kind, next((s[3] for s in g if s[3]), None), _slice(lines, g[0][0], g[-1][1]).strip()))
    return out


# Methods that the Unity engine calls by name.
UNITY_LIFECYCLE = frozenset("Awake Start Update FixedUpdate LateUpdate OnEnable OnDisable OnDestroy OnGUI OnTriggerEnter OnTriggerExit OnTriggerStay OnCollisionEnter OnCollisionExit OnCollisionStay Reset OnValidate OnApplicationQuit OnApplicationPause OnApplicationFocus".split())


def read_csharp(text: str, path: str) -> Parsed:
    out, lines = Parsed(), text.split("\n")
    code = blanked(text, line="//", block=("/*", "*/"), quotes="\"'")
    at = _line_of(text)
    uses = list(re.finditer(r"(?m)^[ \t]*using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", code))
    out.imports = [Import("using", m[1], at(m.start(1))) for m in uses]
    if uses:
        first, last = at(uses[0].start(1)), at(uses[-1].start(1))
        out.chunks.append(Chunk(first, last, "imports", None, _slice(lines, first, last)))
    types = re.compile(r"(?m)^[ \t]*((?:\[[^\]\n]*\]\s*)*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|new|unsafe)\s+)*)(class|interface|enum|struct|record)\s+([A-Za-z_]\w*)[^{;]*")
    owners: list[tuple[int, int, str, bool]] = []
    for m in types.finditer(code):
        end = _brace_end(code, m.end())
        bases = [b.strip() for b in (re.search(r":\s*([^{]*)", code[m.end(3) : m.end()]) or [None, ""])[1].split("where")[0].split(",") if b.strip()]
        unity = any(b in ("MonoBehaviour", "ScriptableObject") for b in bases)
        owners.append((m.start(2), end, m[3], unity))
        if m[2] == "class":
            meta = json.dumps({"baseTypes": bases, "unityComponent": unity}) if bases else None
            out.symbols.append(Symbol("class", m[3], None, bool(re.search(r"\b(public|internal)\b", m[1])), at(m.start(2)), at(m.start(2)), lines[at(m.start(2)) - 1].strip(), meta))
        begin = at(m.start(2))
        out.chunks.append(Chunk(begin, at(end - 1), "types" if m[2] in ("interface", "enum", "struct") else "impl", m[3], _slice(lines, begin, at(end - 1))))
    methods = re.compile(r"(?m)^[ \t]*((?:(?:public|private|protected|internal|static|virtual|override|sealed|partial|async|extern|unsafe|abstract|new|readonly)\s+)*)(?:([\w.<>,\[\]?]+(?:\s*<[^>]*>)?)\s+)?([A-Za-z_]\w*)\s*(?:<[^>()]*>)?\(")
    for m in methods.finditer(code):
        name = m[3]
        owner = next((o for o in reversed(owners) if o[0] < m.start(3) < o[1]), None)
        if owner is None or name in ("if", "for", "while", "switch", "catch", "return", "using", "lock", "foreach", "nameof", "typeof", "new", "base", "this") or m[2] in ("return", "new", "await", "else", "throw", "yield"):
            continue
        after = code[_close_paren(code, m.end() - 1) :].lstrip()
        constructor = m[2] is None and name == owner[2]
        if not (after.startswith(("{", "=>", ";", "where", ":")) and (m[1] or m[2]) and (m[2] or constructor)) or (after.startswith(";") and not m[1] and m[2] is None):
            continue
        end = _brace_end(code, _close_paren(code, m.end() - 1))
        line = at(m.start(3))
        if not constructor:
            meta = json.dumps({"lifecycle": True}) if owner[3] and name in UNITY_LIFECYCLE else None
            out.symbols.append(Symbol("method", name, owner[2], bool(re.search(r"\b(public|internal)\b", m[1])), line, line, lines[line - 1].strip(), meta))
        out.chunks.append(Chunk(line, at(end - 1), "impl", name, _slice(lines, line, at(end - 1))))
    return out


def read_gdscript(text: str, path: str) -> Parsed:
    out, lines, container, inner_indent = Parsed(), text.split("\n"), None, 0
    definitions: list[tuple[int, str, str]] = []
    headers: list[int] = []
    for number, line in enumerate(lines, 1):
        s = line.strip()
        indent = len(line) - len(line.lstrip())
        if s and container and indent < inner_indent:
            container = None
        if m := re.match(r"extends\s+(\S+)", s):
            out.imports.append(Import("import", m[1].strip("\"'"), number))
            headers.append(number)
        if m := re.match(r"(?:const|var)\s+\w+\s*(?::\s*\w*\s*)?:?=\s*preload\(\s*[\"']([^\"']+)", s):
            out.imports.append(Import("asset_reference", m[1], number))
            headers.append(number)
        if m := re.match(r"(class_name|class)\s+([A-Za-z_]\w*)", s):
            out.symbols.append(Symbol("class", m[2], None, not m[2].startswith("_"), number, number, s))
            definitions.append((number, "types", m[2]))
            if m[1] == "class":
                container, inner_indent = m[2], indent + 1
        elif m := re.match(r"signal\s+([A-Za-z_]\w*)", s):
            out.symbols.append(Symbol("signal", m[1], container, True, number, number, s))
        elif m := re.match(r"(?:static\s+)?func\s+([A-Za-z_]\w*)\s*\(", s):
            out.symbols.append(Symbol("method" if container else "function", m[1], container, not m[1].startswith("_"), number, number, s))
            definitions.append((number, "impl", m[1]))
    if headers:
        out.chunks.append(Chunk(min(headers), max(headers), "imports", None, _slice(lines, min(headers), max(headers))))
    for i, (number, kind, name) in enumerate(definitions):
        end = max(number, definitions[i + 1][0] - 1) if i + 1 < len(definitions) else len(lines)
        out.chunks.append(Chunk(number, end, kind, name, _slice(lines, number, end).strip()))
    return out


_RUBY_OPENS = re.compile(r"^(?:class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|=\s*(?:if|unless|case|begin)\b")


def read_ruby(text: str, path: str) -> Parsed:
    out, lines = Parsed(), text.split("\n")
    code = blanked(text, line="#", block=None, quotes="\"'").split("\n")
    stack: list[tuple[str, int, str | None, int]] = []  # (what, chunk, name, line)
    visibility: list[str] = ["public"]
    requires: list[int] = []
    chunk_at: dict[int, int] = {}
    for number, line in enumerate(code, 1):
        s = line.strip()
        if m := re.match(r"(?:require|require_relative)\s+[\"']([^\"']+)", lines[number - 1].strip()):
            out.imports.append(Import("require", m[1], number))
            requires.append(number)
        names = [n for w, _, n, _ in stack if w in ("class", "module") and n]
        if s in ("private", "protected", "public"):
            visibility[-1] = s
        opened = None
        if m := re.match(r"(class|module)\s+([A-Z][\w:]*)", s):
            opened = (m[1], m[2])
            out.symbols.append(Symbol(m[1], m[2], "::".join(names) or None, True, number, number, lines[number - 1].strip()))
        elif m := re.match(r"(?:(private|protected|public)\s+)?def\s+(self\.)?([A-Za-z_]\w*[!?=]?)", s):
            opened = ("def", m[3])
            seen = m[1] or ("public" if m[2] else visibility[-1])
            out.symbols.append(Symbol("method", m[3], "::".join(names) or None, seen == "public" and not m[3].startswith("_"), number, number, lines[number - 1].strip(), json.dumps({"visibility": seen})))
        if opened:
            out.chunks.append(Chunk(number, number, "impl" if opened[0] == "def" else "types", opened[1], ""))
            chunk_at[number] = len(out.chunks) - 1
            if opened[0] == "def" and re.search(r"\)\s*=\s|\bend\s*$", s):
                continue
            stack.append((opened[0], len(out.chunks) - 1, opened[1], number))
            if opened[0] != "def":
                visibility.append("public")
            if re.search(r"\bend\s*$", s):
                what = stack.pop()
                if what[0] != "def":
                    visibility.pop()
        elif s == "end" or re.match(r"end\b", s):
            if stack:
                what, i, _, _ = stack.pop()
                if what in ("class", "module"):
                    visibility.pop()
                if i >= 0:
                    out.chunks[i].end_line = number
        elif _RUBY_OPENS.search(s) and not re.search(r"\bend\s*$", s):
            stack.append(("block", -1, None, number))
    for c in out.chunks:
        c.content = _slice(lines, c.start_line, c.end_line)
    if requires:
        out.chunks.insert(0, Chunk(min(requires), max(requires), "imports", None, _slice(lines, min(requires), max(requires))))
    return out


READERS: dict[str, Callable[[str, str], Parsed]] = {"typescript": read_typescript, "python": read_python, "csharp": read_csharp, "gdscript": read_gdscript, "ruby": read_ruby}


def language_of_path(path: str) -> str:
    m = re.search(r"\.[^./]+$", path)
    return EXTENSION_LANGUAGE.get(m[0].lower() if m else "", "plaintext")


def parse_file(path: str, content: str) -> Parsed:
    """One file by the reader of its language; nothing for other languages."""
    reader = READERS.get(language_of_path(path))
    return reader(content, path) if reader else Parsed()


def function_chunks(content: str) -> list[Chunk]:
    """[CHK-4] TypeScript by top-level statements: leading imports, then leading types as the preamble, then declarations."""
    out: list[Chunk] = []
    leading = True
    for c in read_typescript(content, "x.ts").symbols:
        if c.container_name:
            continue
        kind = "preamble" if leading and c.kind in ("type", "interface") else "declaration"
        leading = leading and kind == "preamble"
        out.append(Chunk(c.start_line, c.end_line, kind, c.name, _slice(content.split("\n"), c.start_line, c.end_line)))
    lines = [i.line for i in read_typescript(content, "x.ts").imports if i.kind == "import"]
    return ([Chunk(min(lines), max(lines), "imports", None, _slice(content.split("\n"), min(lines), max(lines)))] if lines else []) + out


def extract(files: DataFrame, *, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """``files`` without content, with symbols, imports, chunks (arrays of structs) and error (null where the file was read).

    A file that a reader can't handle keeps its row, with empty arrays and the error's text; it never stops the run.
    """
    ship(files.sparkSession)
    kept = [f for f in files.schema.fields if f.name != content_col]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], f"symbols array<{SYMBOL}>, imports array<{IMPORT}>, chunks array<{CHUNK}>, error string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for path, content in zip(frame[path_col], frame[content_col], strict=True):
                try:
                    p = parse_file(path, content or "")
                    made.append(([asdict(s) for s in p.symbols], [asdict(i) for i in p.imports], [asdict(c) for c in p.chunks], None))
                except Exception as e:  # noqa: BLE001  recorded with the file
                    made.append(([], [], [], f"{type(e).__name__}: {e}"))
            out = frame.drop(columns=[content_col])
            out["symbols"], out["imports"], out["chunks"], out["error"] = (list(c) for c in zip(*made, strict=True)) if made else ([], [], [], [])
            yield out

    return files.select(*[f.name for f in kept], F.coalesce(content_col, F.lit("")).alias(content_col)).mapInPandas(run, schema)


# How good an entry point's file name is.
ENTRY_NAMES = {
    8: ("App.tsx", "app.tsx"),
    7: ("main.ts", "main.mts", "main.cts", "server.ts", "server.mts", "server.cts"),
    6: ("main.js", "main.jsx", "main.tsx", "server.js", "server.jsx", "app.ts", "app.mts", "app.cts", "cli.ts", "cli.mts", "cli.cts"),
    5: ("cli.js", "index.tsx", "index.ts", "index.mts", "index.cts"),
    4: ("index.js", "index.jsx"),
}
OTHER_ENTRIES = {
    "python": r"(__main__|manage)\.py$",
    "csharp": r"(GameManager|Bootstrap)\.cs$",
    "gdscript": r"(?i)/(main|bootstrap|game_manager)\.gd$",
    "ruby": r"(/bin/[^/]*\.rb|/(main|app|cli|boot)\.rb)$",
}


def entry_points(files: DataFrame, *, has_main: str | None = None, limit: int = 20) -> DataFrame:
    """[SRT-7] (path, language_id, score): TypeScript files ranked by name, exported main function (column ``has_main``), depth
    and folder; files of other languages that fit their language's pattern."""
    path = F.col("path")
    name = F.regexp_extract(path, r"[^/]+$", 0)
    by_name = F.lit(0)
    for value, names in ENTRY_NAMES.items():
        by_name = F.when(name.isin(*names), value).otherwise(by_name)
    base = F.greatest(by_name, F.when(F.col(has_main), 6).otherwise(0)) if has_main else by_name
    score = base * 10 - F.size(F.split(path, "/")) + F.when(path.contains("/src/"), 1).otherwise(0) - F.when(path.contains("/dist/"), 3).otherwise(0)
    ranked = files.where("language_id = 'typescript'").withColumn("score", score).where(base > 0).orderBy(F.desc("score"), "path").limit(limit)
    out = ranked.select("path", "language_id", "score")
    for language, pattern in OTHER_ENTRIES.items():
        out = out.unionByName(files.where((F.col("language_id") == language) & path.rlike(pattern)).select("path", "language_id", F.lit(0).alias("score")))
    return out


__all__ = ["READERS", "Chunk", "Import", "Parsed", "Symbol", "entry_points", "extract", "function_chunks", "parse_file", "trim_to_budget"]
