"""Chunkers: line windows, the adaptive rule, and the heuristic splitter on definition lines. [CHK-*, WIN-6, AGG-12]

All work inside a row on arrays of lines, so chunking a corpus shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import trimmed

OVERLAP = 20
#: Lines up to which a file is one chunk, and lines of a window by language.
WHOLE, WINDOW, WINDOW_TYPESCRIPT = 220, 220, 180
MODULE_WINDOW = 200

_CHUNK = "array<struct<start_line:int,end_line:int,chunk_type:string,primary_symbol:string,content:string>>"

# For each language the lines of an import header, and its definition lines as (expression, group of the
# name, chunk type or None for "types if the keyword group is one of the listed, else impl").
IMPORT_LINES = {
    "python": r"^(import\s+\S+|from\s+\S+\s+import\s+)",
    "csharp": r"^using\s+[^;]+;",
    "gdscript": r"^(extends\s+\S+|class_name\s+\S+|const\s+\S+\s*=\s*preload\(|var\s+\S+\s*=\s*preload\()",
    "ruby": r"^(require|require_relative|include|extend)\b",
    "typescript": r"^(import\s+|export\s+.+\s+from\s+|const\s+.+\s*=\s*require\()",
}
DEFINITIONS = {
    "python": [(r"^class\s+([A-Za-z_][A-Za-z0-9_]*)", "types"), (r"^(?:async\s+def|def)\s+([A-Za-z_][A-Za-z0-9_]*)", "impl")],
    "csharp": [
        (r"\b(?:interface|enum)\s+([A-Za-z_][A-Za-z0-9_]*)", "types"),
        (r"\b(?:class|struct|record)\s+([A-Za-z_][A-Za-z0-9_]*)", "impl"),
        (r"\b(?:public|private|protected|internal|static|virtual|override|sealed|partial|async|extern|unsafe|abstract|new|readonly|ref|out|in)+\s+[A-Za-z_][A-Za-z0-9_<>,\[\]?]*\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", "impl"),
    ],
    "gdscript": [(r"^(?:class_name|class)\s+([A-Za-z_][A-Za-z0-9_]*)", "types"), (r"^(?:static\s+)?func\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", "impl")],
    "ruby": [(r"^(?:class|module)\s+([A-Z][A-Za-z0-9_:]*)", "types"), (r"^def\s+(?:self\.)?([A-Za-z_][A-Za-z0-9_]*[!?=]?)", "impl")],
    "typescript": [(r"^(?:export\s+)?(?:async\s+)?(?:function|class|const|let|var)\s+([A-Za-z_][A-Za-z0-9_]*)", None)],
}


def let(value: Column, body) -> Column:
    """``body`` of ``value``, with the value computed once."""
    return F.transform(F.array(value), body)[0]


def joined(lines: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, start, end - start + 1), "\n")


def _chunk(start: Column, end: Column, kind: Column, symbol: Column, content: Column) -> Column:
    return F.struct(start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), kind.alias("chunk_type"), symbol.cast("string").alias("primary_symbol"), content.alias("content"))


def window_bounds(n: Column, size: Column, overlap: Column) -> Column:
    """Array of (start, end) of windows over lines 1 to n: each begins ``size - overlap`` after the one before, and the first
    that reaches the end is the last."""
    step = F.greatest(size - overlap, F.lit(1))
    count = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int") + 1
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * step + 1).alias("start"), F.least(n, i * step + size).alias("end")))


def line_windows(docs: DataFrame, *, text_col: str = "text", size: int = 20, overlap: int = 5) -> DataFrame:
    """``docs`` with a row for each window of lines: start_line, end_line, content."""
    lines = F.split(F.col(text_col), r"\r?\n", -1)
    made = let(lines, lambda x: F.transform(window_bounds(F.size(x), F.lit(size), F.lit(overlap)), lambda w: F.struct(w["start"].alias("start_line"), w["end"].alias("end_line"), joined(x, w["start"], w["end"]).alias("content"))))
    return docs.select("*", F.inline(made))


def adaptive_chunks(content: Column, language: Column, *, whole: int = WHOLE, window: int = WINDOW, window_typescript: int = WINDOW_TYPESCRIPT, overlap: int = OVERLAP) -> Column:
    """[CHK-1] Array of chunks: none of a blank text, one of a short one, else overlapping windows of which blank ones are left
    out; the first kept is a module section, the others are impl."""
    size = F.when(language == "typescript", window_typescript).otherwise(window)

    def windows(x: Column) -> Column:
        all_of = F.transform(window_bounds(F.size(x), size, F.lit(overlap)), lambda w: _chunk(w["start"], w["end"], F.lit("impl"), F.lit(None), trimmed(joined(x, w["start"], w["end"]))))
        kept = F.filter(all_of, lambda c: c["content"] != "")
        return F.transform(kept, lambda c, i: c.withField("chunk_type", F.when(i == 0, "module_section").otherwise("impl")))

    def choose(x: Column) -> Column:
        one = F.array(_chunk(F.lit(1), F.size(x), F.lit("full_file"), F.lit(None), trimmed(content)))
        return F.when(trimmed(content) == "", F.array().cast(_CHUNK)).when(F.size(x) <= whole, one.cast(_CHUNK)).otherwise(windows(x).cast(_CHUNK))

    return let(F.split(content, r"\r?\n", -1), choose)


def single_chunk(content: Column) -> Column:
    """[CHK-2] The whole text, from line 0."""
    return F.array(_chunk(F.lit(0), F.size(F.split(content, r"\r?\n", -1)), F.lit("full_file"), F.lit(None), content)).cast(_CHUNK)


def module_chunks(content: Column, *, window: int = MODULE_WINDOW, overlap: int = OVERLAP) -> Column:
    """[CHK-3] Windows of 200 lines counted from 0, later ones marked as continued."""
    mark = lambda i, text: F.when(i > 0, F.concat(F.lit("// ...\n"), text)).otherwise(text)

    def windows(x: Column) -> Column:
        return F.transform(window_bounds(F.size(x), F.lit(window), F.lit(overlap)), lambda w, i: _chunk(w["start"] - 1, w["end"], F.lit("module_section"), F.lit(None), mark(i, joined(x, w["start"], w["end"]))))

    return let(F.split(content, r"\r?\n", -1), windows).cast(_CHUNK)


def heuristic_chunks(content: Column, language: str) -> Column:
    """[CHK-5] Array of chunks of one language's text: the import header, then one chunk from each definition line to before
    the next; the rest as one chunk where nothing is defined; none for an unknown language."""
    if language not in DEFINITIONS:
        return F.array().cast(_CHUNK)
    imports, rules = IMPORT_LINES[language], DEFINITIONS[language]

    def define(line: Column, number: Column) -> Column:
        kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
        for pattern, fixed in reversed(rules):
            hit = line.rlike(pattern)
            told = F.lit(fixed) if fixed else F.when(line.rlike(r"\bclass\b"), "types").otherwise("impl")
            kind, name = F.when(hit, told).otherwise(kind), F.when(hit, F.regexp_extract(line, pattern, 1)).otherwise(name)
        return F.struct(number.alias("line"), kind.alias("kind"), name.alias("name"))

    def split(x: Column) -> Column:
        short = F.transform(x, trimmed)
        passes = lambda s: (s == "") | s.rlike(r"^(//|#|/[*])") | s.rlike(imports)
        stop = let(F.filter(F.transform(short, lambda s, i: F.when(~passes(s), i)), lambda i: i.isNotNull()), lambda a: F.when(F.size(a) > 0, a[0]).otherwise(F.size(x)))
        header_end = let(F.filter(F.transform(F.slice(short, 1, stop), lambda s, i: F.when(s.rlike(imports), i + 1)), lambda i: i.isNotNull()), lambda a: F.when(F.size(a) > 0, F.element_at(a, -1)).otherwise(0))
        return let(header_end, lambda h: rest(x, short, h))

    def rest(x: Column, short: Column, h: Column) -> Column:
        n = F.size(x)
        header = F.when(h > 0, F.array(_chunk(F.lit(1), h, F.lit("imports"), F.lit(None), trimmed(joined(x, F.lit(1), h))))).otherwise(F.array().cast(_CHUNK))
        found = F.filter(F.transform(short, lambda s, i: F.when(i >= h, define(s, i + 1))), lambda d: d["kind"].isNotNull())

        def pieces(d: Column) -> Column:
            end = lambda i: F.when(i + 1 < F.size(d), F.greatest(d[i]["line"], F.get(d, i + 1)["line"] - 1)).otherwise(n)
            made = F.transform(d, lambda c, i: _chunk(c["line"], end(i), c["kind"], c["name"], trimmed(joined(x, c["line"], end(i)))))
            whole = trimmed(joined(x, h + 1, n))
            left = F.when(whole == "", F.array().cast(_CHUNK)).otherwise(F.array(_chunk(h + 1, n, F.lit("impl"), F.lit(None), whole)).cast(_CHUNK))
            return F.when(F.size(d) == 0, left).otherwise(F.filter(made.cast(_CHUNK), lambda c: c["content"] != ""))

        return F.concat(header.cast(_CHUNK), let(found, pieces))

    return let(F.split(content, r"\r?\n", -1), split)


def chunk_files(files: DataFrame, *, content_col: str = "content", language_col: str = "language_id", plugin_chunks: str | None = None) -> DataFrame:
    """[CHK-6] A row for each chunk of each file: those of the language's extractor if it made any (array column
    ``plugin_chunks``), else heuristic ones, else adaptive ones. The chunk's content takes the place of the file's."""
    content, language = F.col(content_col), F.col(language_col)
    heuristic = F.array().cast(_CHUNK)
    for name in DEFINITIONS:
        heuristic = F.when(language == name, heuristic_chunks(content, name)).otherwise(heuristic)
    made = F.when(F.size(heuristic) > 0, heuristic).otherwise(adaptive_chunks(content, language))
    if plugin_chunks:
        made = F.when(F.size(F.coalesce(F.col(plugin_chunks), F.array().cast(_CHUNK))) > 0, F.col(plugin_chunks).cast(_CHUNK)).otherwise(made)
    kept = [c for c in files.columns if c not in (content_col, plugin_chunks)]
    return files.withColumn("_chunks", made).select(*kept, F.inline("_chunks"))


def definition_chunks(docs: DataFrame, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """[WIN-6] (id, start_line, end_line, header) for each line that fits the pattern, up to the line before the next."""
    def made(x: Column) -> Column:
        hits = F.filter(F.transform(x, lambda s, i: F.struct((i + 1).alias("line"), s.alias("text"))), lambda d: d["text"].rlike(pattern))
        return let(hits, lambda d: F.transform(d, lambda c, i: F.struct(c["line"].alias("start_line"), F.when(i + 1 < F.size(d), F.greatest(c["line"], F.get(d, i + 1)["line"] - 1)).otherwise(F.size(x)).alias("end_line"), c["text"].alias("header"))))

    return docs.select(id_col, F.inline(let(F.split(F.col(text_col), "\n", -1), made)))
