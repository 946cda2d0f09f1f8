"""Import resolution as joins of exploded candidates with the known files; the first candidate that exists wins. [RES-*, JOIN-10..12]"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import language_of, normalize_path

# Modules that come with Node, Python and Ruby, and root namespaces of .NET.
NODE_BUILTINS = (
    "assert", "async_hooks", "buffer", "child_process", "crypto", "dns", "events", "fs", "http", "https", "net", "os", "path",
    "punycode", "querystring", "readline", "stream", "string_decoder", "tls", "url", "util", "zlib",
)
PYTHON_BUILTINS = (
    "abc", "argparse", "ast", "asyncio", "base64", "bisect", "calendar", "cmath", "collections", "concurrent", "configparser",
    "contextlib", "contextvars", "copy", "csv", "ctypes", "dataclasses", "datetime", "decimal", "difflib", "enum", "fileinput",
    "functools", "glob", "gzip", "hashlib", "hmac", "http", "io", "itertools", "json", "keyword", "linecache", "locale", "logging",
    "mailbox", "marshal", "math", "mimetypes", "multiprocessing", "numbers", "operator", "os", "pathlib", "pickle", "platform",
    "pprint", "queue", "re", "secrets", "select", "shelve", "signal", "smtplib", "socket", "sqlite3", "ssl", "statistics", "string",
    "struct", "subprocess", "sys", "tarfile", "tempfile", "textwrap", "threading", "time", "traceback", "typing", "unicodedata",
    "unittest", "urllib", "uuid", "warnings", "weakref", "xml", "zipfile", "zlib",
)
RUBY_BUILTINS = (
    "base64", "benchmark", "bigdecimal", "csv", "date", "delegate", "digest", "drb", "erb", "etc", "fcntl", "fiddle", "fileutils",
    "find", "forwardable", "getoptlong", "io", "ipaddr", "json", "logger", "matrix", "minitest", "monitor", "net", "nkf", "objspace",
    "observer", "open3", "optparse", "ostruct", "pathname", "pp", "prettyprint", "prime", "pstore", "psych", "pty", "racc", "random",
    "rdoc", "readline", "resolv", "rexml", "ripper", "rss", "rubygems", "scanf", "sdbm", "securerandom", "set", "shell", "shellwords",
    "singleton", "socket", "stringio", "strscan", "syslog", "tempfile", "test", "thread", "thwait", "time", "timeout", "tmpdir",
    "tracer", "tsort", "un", "uri", "weakref", "webrick", "yaml", "zlib",
)
DOTNET_ROOTS = ("System", "Microsoft", "Mono", "NET")


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _joined(folder: Column, rest: Column) -> Column:
    return normalize_path(F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest)))


def _each(base: Column, endings: list[str]) -> Column:
    return F.array(*[F.concat(base, F.lit(e)) for e in endings])


def candidates(spec: Column, from_path: Column, language: Column) -> Column:
    """Paths that the specifier may mean, best first."""
    folder = _folder(from_path)
    relative = _joined(folder, spec)
    bare = F.regexp_replace(relative, r"(?i)\.(jsx?|mjs|cjs)$", "")
    typescript = F.concat(F.array(relative, bare), _each(bare, [".ts", ".tsx", ".mts", ".cts", "/index.ts", "/index.tsx"]))
    dots = F.length(F.regexp_extract(spec, r"^\.+", 0))
    rest = F.regexp_replace(F.regexp_replace(spec, r"^\.+", ""), r"\.", "/")
    up = F.concat(F.repeat(F.lit("../"), dots - 1), rest)
    base = F.regexp_replace(_joined(folder, up), "/$", "")
    py_relative = _each(base, [".py", "/__init__.py"])
    parts = F.split(spec, r"\.")
    lengths = F.sequence(F.size(parts), F.lit(1), F.lit(-1))
    py_absolute = F.flatten(F.transform(lengths, lambda n: _each(F.array_join(F.slice(parts, 1, n), "/"), ["", ".py", "/__init__.py"])))
    resource = F.when(spec.startswith("res://"), normalize_path(F.regexp_replace(spec, "^res://", ""))).otherwise(F.when(spec.startswith("/"), F.regexp_replace(normalize_path(spec), "^/", "")).otherwise(relative))
    godot = F.concat(F.array(resource), _each(resource, [".gd", ".tscn", "/index.gd"]))
    ruby = F.concat(F.array(relative), _each(relative, [".rb", "/index.rb"]))
    empty = F.array().cast("array<string>")
    pathlike = spec.startswith(".") | spec.startswith("/") | spec.startswith("res://")
    return (
        F.when(language == "typescript", F.when(spec.startswith("."), typescript).otherwise(empty))
        .when(language == "python", F.when(spec.startswith("."), py_relative).otherwise(py_absolute))
        .when(language == "gdscript", F.when(pathlike | spec.rlike(r"\.gd$|\.tscn$"), F.concat(godot, F.array(normalize_path(spec)))).otherwise(empty))
        .when(language == "ruby", F.when(spec.startswith("."), ruby).otherwise(empty))
        .otherwise(empty)
    )


def known_type(spec: Column, language: Column) -> Column:
    """What the specifier is whatever files there are: builtin, external, or null for "depends on the files"."""
    top_dot = F.element_at(F.split(spec, r"\."), 1)
    top_slash = F.element_at(F.split(spec, "/"), 1)
    return (
        F.when((language == "typescript") & (spec.startswith("node:") | top_slash.isin(*NODE_BUILTINS)), "builtin")
        .when((language == "typescript") & ~spec.startswith("."), "external")
        .when((language == "python") & ~spec.startswith(".") & top_dot.isin(*PYTHON_BUILTINS), "builtin")
        .when((language == "csharp") & (top_dot.isin(*DOTNET_ROOTS) | top_dot.startswith("Unity")), "external")
        .when((language == "ruby") & top_slash.isin(*RUBY_BUILTINS), "builtin")
        .when((language == "ruby") & ~spec.startswith("."), "external")
        .when(~language.isin("typescript", "python", "csharp", "gdscript", "ruby"), "external")
    )


def resolve(imports: DataFrame, files: DataFrame, *, spec_col: str = "to_specifier", from_col: str = "from_path") -> DataFrame:
    """``imports`` with to_path and dependency_type. ``files`` has the column path.

    Every distinct (specifier, file) is resolved once: candidates are exploded with their rank and met with the files by an
    equi-join; the least rank wins. C# namespaces are matched with folder names and base names of C# files (last part first,
    then any part, the first file in path order), GDScript class names with base names.
    """
    asked = imports.select(F.col(spec_col).alias("spec"), F.col(from_col).alias("src")).distinct().withColumn("language", language_of(F.col("src")))
    asked = asked.withColumn("sure", known_type(F.col("spec"), F.col("language")))
    open_ = asked.where("sure is null")
    paths = files.select("path").distinct()
    tried = open_.select("spec", "src", F.posexplode(candidates(F.col("spec"), F.col("src"), F.col("language"))).alias("rank", "path"))
    hits = tried.join(paths, "path")
    stem = F.regexp_extract("path", r"([^/]+?)\.[^./]+$", 1)
    by_class = open_.where("language = 'gdscript'").join(paths.where("path like '%.gd'").select(stem.alias("spec"), "path"), "spec").select("path", "spec", "src", F.lit(1000).alias("rank"))
    sharp = paths.where("path like '%.cs'").select("path", F.explode(F.array_distinct(F.concat(F.filter(F.split(_folder(F.col("path")), "/"), lambda s: s != ""), F.array(stem)))).alias("part"))
    parts = open_.where("language = 'csharp'").select("spec", "src", F.posexplode(F.reverse(F.split("spec", r"\."))).alias("_at", "part"))
    by_namespace = parts.join(sharp, "part").groupBy("spec", "src").agg(F.min(F.struct((F.col("_at") > 0).cast("int").alias("rank"), "path")).alias("m")).select(F.col("m.path").alias("path"), "spec", "src", F.col("m.rank").alias("rank"))
    found = hits.select("path", "spec", "src", "rank").unionByName(by_class).unionByName(by_namespace).groupBy("spec", "src").agg(F.min(F.struct("rank", "path"))["path"].alias("to_path"))
    solved = asked.join(found, ["spec", "src"], "left")
    local = F.col("spec").startswith(".") | ((F.col("language") == "gdscript") & (F.col("spec").startswith("res://") | F.col("spec").startswith("/")))
    kind = F.coalesce("sure", F.when(F.col("to_path").isNotNull() | local, "internal").otherwise("external"))
    solved = solved.select(F.col("spec").alias(spec_col), F.col("src").alias(from_col), "to_path", kind.alias("dependency_type"))
    return imports.drop("to_path", "dependency_type").join(solved, [spec_col, from_col], "left")


def canonical_source(dependencies: DataFrame, files: DataFrame, *, col: str = "to_path") -> DataFrame:
    """[PRJ-7] ``/dist/….js`` targets replaced by the ``/src/….ts`` or ``.tsx`` that they were built from, where known."""
    target = F.col(col)
    built = target.contains("/dist/") & target.rlike(r"\.jsx?$")
    base = F.regexp_replace(F.regexp_replace(target, "/dist/", "/src/"), r"\.jsx?$", "")
    known = files.select(F.col("path").alias("_known")).distinct()
    ts, tsx = known.withColumnRenamed("_known", "_ts"), known.withColumnRenamed("_known", "_tsx")
    keyed = dependencies.withColumn("_one", F.when(built, F.concat(base, F.lit(".ts")))).withColumn("_two", F.when(built, F.concat(base, F.lit(".tsx"))))
    met = keyed.join(ts, F.col("_one") == F.col("_ts"), "left").join(tsx, F.col("_two") == F.col("_tsx"), "left")
    return met.withColumn(col, F.coalesce("_ts", "_tsx", target)).drop("_one", "_two", "_ts", "_tsx")
