"""Graphs as edge tables: bounded search, contraction to modules, cycles of two, filters. [GRF-*]"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import matches_globs, module_key
from siltstone.runtime import materialize

MAX_DEPTH = 5


def reachable(edges: DataFrame, seeds: DataFrame, depth: int, *, src: str = "src", dst: str = "dst") -> DataFrame:
    """[GRF-1] (node): everything 1 to ``depth`` (clamped to 1..5) steps from the seeds (column node) along the edges.

    Seeds themselves are left out but for one that follows another seed, in path order, as its direct neighbour: seeds are
    expanded one after the other and a node is reported unless it was expanded before. Each level is written to the shared
    folder, so the plan doesn't double with every step.
    """
    steps = max(1, min(MAX_DEPTH, int(depth)))
    links = edges.where(F.col(dst).isNotNull()).select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct()
    start = seeds.select("node").distinct()
    levels, frontier, seen = [], start, start
    for _ in range(steps):
        found = links.join(frontier.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        frontier = materialize(found.join(seen.select("node"), "node", "left_anti"), "bfs-level")
        levels.append(frontier)
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    one, two = start.select(F.col("node").alias("a")), start.select(F.col("node").alias("b"))
    leaked = links.join(one, "a").join(two, "b").where("a < b").select(F.col("b").alias("node")).distinct()
    return out.unionByName(leaked).distinct()


def reverse(edges: DataFrame, *, src: str = "src", dst: str = "dst") -> DataFrame:
    """The same edges the other way round, for callers instead of callees."""
    return edges.withColumnsRenamed({src: "_was_src", dst: src}).withColumnRenamed("_was_src", dst)


def mutual_edges(edges: DataFrame, *, src: str = "src", dst: str = "dst") -> DataFrame:
    """[GRF-3, JOIN-15] Pairs (low, high) with an edge each way. One aggregate on the unordered pair, no self-join."""
    pairs = edges.where(F.col(src) != F.col(dst)).select(F.least(src, dst).alias("low"), F.greatest(src, dst).alias("high"), (F.col(src) < F.col(dst)).alias("up"))
    return pairs.groupBy("low", "high").agg(F.max("up").alias("up"), F.min("up").alias("down")).where("up and not down").select("low", "high")


def contract(dependencies: DataFrame) -> DataFrame:
    """[GRF-2, AGG-5] File dependencies as module edges (bucket, from_module, target), distinct.

    Internal ones with a path go to the target's module, edges inside a module dropped; all others keep the specifier. An
    unknown type counts as unresolved.
    """
    kind = F.col("dependency_type")
    bucket = F.when(kind.isin("internal", "external", "builtin"), kind).otherwise("unresolved")
    inner = (bucket == "internal") & F.col("to_path").isNotNull()
    edges = dependencies.select(bucket.alias("bucket"), module_key(F.col("from_path")).alias("from_module"), F.when(inner, module_key(F.col("to_path"))).when(bucket != "internal", F.col("to_specifier")).alias("target"))
    return edges.where("target is not null and not (bucket = 'internal' and from_module = target)").distinct()


def targets_of(module_edges: DataFrame) -> DataFrame:
    """[AGG-5] (bucket, from_module, targets): sorted distinct targets."""
    return module_edges.groupBy("bucket", "from_module").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def target_usage(module_edges: DataFrame) -> DataFrame:
    """[AGG-6, AGG-7] (bucket, target, modules): how many modules use each target."""
    return module_edges.groupBy("bucket", "target").agg(F.countDistinct("from_module").alias("modules"))


def without(files: DataFrame, dependencies: DataFrame, patterns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """[GRF-4] Files and dependencies that survive exclude globs: the file, and of an edge both ends."""
    kept = files.where(~matches_globs(F.col("path"), patterns))
    gone = matches_globs(F.col("from_path"), patterns) | F.coalesce(matches_globs(F.col("to_path"), patterns), F.lit(False))
    return kept, dependencies.where(~gone)


def ancestors(path: Column) -> Column:
    """All folders above a path, the root as the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def subtree_counts(files: DataFrame, path_col: str = "path") -> DataFrame:
    """[AGG-9, AGG-10, GRF-6] (folder, files, children): files anywhere below, and entries directly inside."""
    depth = F.size(F.filter(F.split(F.col("folder"), "/"), lambda s: s != ""))
    paths = files.select(F.col(path_col).alias("path")).distinct()
    below = paths.withColumn("folder", F.explode(ancestors(F.col("path"))))
    child = F.element_at(F.split("path", "/"), depth + 1)
    return below.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.countDistinct(child).alias("children"))


def first_seen(rows: DataFrame, *, keys: list[str], at: str) -> DataFrame:
    """[AGG-13] (keys, first_seen, n): the least ``at`` and the number of rows of each key."""
    return rows.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.count(F.lit(1)).alias("n"))
