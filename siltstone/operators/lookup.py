"""Symbol lookup with callers and callees, structure, dependency and status queries. [JOIN-7, JOIN-8, WIN-4, WIN-5, WIN-7, SRT-6, AGG-2, AGG-3]"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import camel_head, clean_prefix, contains_name, has_prefix, is_test_path, kind_rank, matches_globs, name_rank, parse_symbol, under_prefix
from siltstone.operators.graph import reachable, reverse

#: Folders that symbol lookup leaves out unless asked for.
FIXTURE_PREFIXES = ("tests/", "fixtures/", "vendor/")
MAX_MATCHES = 5


def find_symbols(symbols: DataFrame, query: str, *, prefix: str | None = None, include_fixtures: bool = False, limit: int = MAX_MATCHES) -> DataFrame:
    """[WIN-4, WIN-5, FLT-12, SRT-8] The best symbol of each file by name, kind and name order. Where a name is the same as the
    query only such are returned, all of them; else the first ``limit``."""
    file, name = parse_symbol(query)
    rows = symbols.where(contains_name(F.col("name"), name))
    if file:
        rows = rows.where(F.col("file_path").contains(file))
    if prefix := clean_prefix(prefix):
        rows = rows.where(has_prefix(F.col("file_path"), prefix))
    if not include_fixtures:
        for p in FIXTURE_PREFIXES:
            rows = rows.where(~F.col("file_path").startswith(p))
    ranked = rows.withColumn("name_rank", name_rank(F.col("name"), name)).withColumn("kind_rank", kind_rank(F.col("kind")))
    order = ["name_rank", "kind_rank", "name", "start_line"]
    best = ranked.groupBy("file_path").agg(F.min(F.struct(*order, *[c for c in ranked.columns if c not in (*order, "file_path")])).alias("b")).select("file_path", "b.*")
    exact = best.where("name_rank = 0")
    if not exact.isEmpty():
        return exact.orderBy("kind_rank", "name", "file_path")
    return best.orderBy("name_rank", "kind_rank", "name", "file_path").limit(limit)


def suggestions(symbols: DataFrame, query: str, limit: int = MAX_MATCHES) -> DataFrame:
    """[FN-8, SRT-8] Symbols whose name contains the first camel-case part of a query that found nothing."""
    head = symbols.select(F.instr(F.lower("name"), F.lower(camel_head(F.lit(query)))).alias("at"), "name", "kind", "file_path")
    return head.where("at > 0").select("name", "kind", "file_path").distinct().orderBy("name", "file_path").limit(limit)


def explain(symbols: DataFrame, dependencies: DataFrame, query: str, **options) -> DataFrame:
    """[JOIN-8] The matches of ``find_symbols`` with sorted distinct callers (files that depend on the symbol's file) and callees."""
    found = find_symbols(symbols, query, **options)
    inner = dependencies.where("to_path is not null")
    callers = inner.join(found.select(F.col("file_path").alias("to_path")).distinct(), "to_path", "left_semi").groupBy(F.col("to_path").alias("file_path")).agg(F.array_sort(F.collect_set("from_path")).alias("callers"))
    callees = inner.join(found.select(F.col("file_path").alias("from_path")).distinct(), "from_path", "left_semi").groupBy(F.col("from_path").alias("file_path")).agg(F.array_sort(F.collect_set("to_path")).alias("callees"))
    none = F.array().cast("array<string>")
    out = found.join(callers, "file_path", "left").join(callees, "file_path", "left")
    return out.withColumn("callers", F.coalesce("callers", none)).withColumn("callees", F.coalesce("callees", none)).orderBy("name_rank", "kind_rank", "name", "file_path")


def deps(files: DataFrame, dependencies: DataFrame, path: str, *, direction: str = "both", depth: int = 1) -> DataFrame:
    """[GRF-1] (direction, node) for callers and/or callees of the files at or under a path."""
    if direction not in ("callers", "callees", "both"):
        raise ValueError(f"unknown direction {direction}")
    if not isinstance(depth, int):
        raise ValueError("depth must be a whole number")
    seeds = files.where(under_prefix(F.col("path"), path)).select(F.col("path").alias("node"))
    edges = dependencies.where("to_path is not null")
    out = None
    if direction in ("callers", "both"):
        out = reachable(reverse(edges, src="from_path", dst="to_path"), seeds, depth, src="from_path", dst="to_path").select(F.lit("callers").alias("direction"), "node")
    if direction in ("callees", "both"):
        down = reachable(edges.where("dependency_type = 'internal'"), seeds, depth, src="from_path", dst="to_path").select(F.lit("callees").alias("direction"), "node")
        out = down if out is None else out.unionByName(down)
    return out.orderBy("direction", "node")


def structure(files: DataFrame, symbols: DataFrame, *, prefix: str | None = None, kind: str | None = None, include_internal: bool = False, tests: bool = True, excludes: Sequence[str] = ()) -> DataFrame:
    """[JOIN-7, FLT-13, SRT-6] (path, language_id, kind, name, exported, start_line): visible files, each with its symbols in display
    order, or once with nulls where it has none."""
    seen = files.where(~matches_globs(F.col("path"), excludes))
    if prefix := clean_prefix(prefix):
        seen = seen.where(under_prefix(F.col("path"), prefix))
    if not tests:
        seen = seen.where(~is_test_path(F.col("path")))
    shown = symbols.select(F.col("file_path").alias("path"), "kind", "name", "exported", "start_line")
    if kind:
        shown = shown.where(F.col("kind") == kind)
    if not include_internal:
        shown = shown.where("exported")
    return seen.select("path", "language_id").join(shown, "path", "left").orderBy("path", kind_rank(F.col("kind")), "kind", F.desc("exported"), "name")


def tree_budget(files: DataFrame, max_files: int, path_col: str = "path") -> DataFrame:
    """[WIN-7] (folder, shown, hidden): a tree is listed folders first, then files, both by name, and ``max_files`` files are shown in
    all; each folder's own files count.

    The running number is taken over one row a folder, in the order in which the folders' own files are listed (a folder after all
    those below it); files are never brought into one order.
    """
    folder = F.regexp_extract(F.col(path_col), r"^(.*)/[^/]*$", 1)
    counts = files.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    last = F.array(F.lit("\uffff"))  # after every name below
    listed = F.when(F.col("folder") == "", last).otherwise(F.concat(F.split("folder", "/"), last))
    before = F.coalesce(F.sum("n").over(Window.orderBy("listed").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shown = F.greatest(F.lit(0), F.least(F.col("n"), F.lit(max_files) - F.col("before")))
    return counts.withColumn("listed", listed).withColumn("before", before).select("folder", shown.alias("shown"), (F.col("n") - shown).alias("hidden"))


def language_counts(files: DataFrame, col: str = "language_id") -> DataFrame:
    """[AGG-2] Files per language, an empty or null one as ``unknown``."""
    name = F.coalesce(F.when(F.col(col) != "", F.col(col)), F.lit("unknown"))
    return files.groupBy(name.alias("language")).agg(F.count(F.lit(1)).alias("files"))


def kind_counts(symbols: DataFrame, col: str = "kind") -> DataFrame:
    """[AGG-3]"""
    return symbols.groupBy(F.col(col).alias("kind")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def status(tables: dict[str, DataFrame]) -> DataFrame:
    """The counts of ``index --status``: (what, n) for each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out
