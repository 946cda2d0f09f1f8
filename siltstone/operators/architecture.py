"""The architecture summary of a snapshot and its filters. [GRF-2..5, AGG-2, AGG-5..8]"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import clean_prefix, module_key, under_prefix
from siltstone.operators import graph
from siltstone.operators.extract import entry_points
from siltstone.operators.lookup import language_counts
from siltstone.operators.resolve import canonical_source


@dataclass
class Architecture:
    """Lazy tables of one summary."""

    file_stats: DataFrame  # language, files
    entry_points: DataFrame  # path, language_id, score
    modules: DataFrame  # module, path: a row a file
    edges: DataFrame  # bucket, from_module, target
    cycles: DataFrame  # low, high

    def dependency_map(self) -> DataFrame:
        return graph.targets_of(self.edges)

    def module_sizes(self) -> DataFrame:
        """[AGG-8] (module, files): how many files each module has."""
        return self.modules.groupBy("module").agg(F.count(F.lit(1)).alias("files"))

    def summary(self) -> DataFrame:
        return graph.target_usage(self.edges)


def summarise(files: DataFrame, dependencies: DataFrame, *, excludes: Sequence[str] = ()) -> Architecture:
    """Language counts, ranked entry points, modules with their files, module edges by bucket, pairs of modules that need each
    other. Exclude globs take files and the edges at either end out first."""
    kept, edges = graph.without(files, dependencies, excludes)
    edges = canonical_source(edges, files)
    module_edges = graph.contract(edges)
    modules = kept.select(module_key(F.col("path")).alias("module"), "path").distinct()
    inner = module_edges.where("bucket = 'internal'")
    return Architecture(language_counts(kept), entry_points(kept), modules, module_edges, graph.mutual_edges(inner, src="from_module", dst="target"))


def under(architecture: Architecture, files: DataFrame, prefix: str | None) -> Architecture:
    """[GRF-5] Only modules with a file at or under the prefix. Internal targets outside go; a module stays even if it has no target
    left (it is in ``modules``); language counts and entry points are not filtered."""
    if not (p := clean_prefix(prefix)):
        return architecture
    inside = files.where(under_prefix(F.col("path"), p)).select(module_key(F.col("path")).alias("module")).distinct()
    modules = architecture.modules.join(inside, "module", "left_semi")
    edges = architecture.edges.join(inside.withColumnRenamed("module", "from_module"), "from_module", "left_semi")
    internal = edges.where("bucket = 'internal'").join(inside.withColumnRenamed("module", "target"), "target", "left_semi")
    edges = edges.where("bucket <> 'internal'").unionByName(internal.select(*edges.columns))
    cycles = graph.mutual_edges(edges.where("bucket = 'internal'"), src="from_module", dst="target")
    return Architecture(architecture.file_stats, architecture.entry_points, modules, edges, cycles)
