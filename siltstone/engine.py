"""The engine: index a project into the store, keep it fresh, and answer the five discovery queries. [INC-*, VEC-7, GRF-*, JOIN-8]"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.embed import HashingProvider, Provider, embed
from siltstone.functions.text import chunk_type, clean_prefix, has_prefix, hash_text, token_estimate
from siltstone.operators import architecture, lookup
from siltstone.operators.attribute import primary_symbols
from siltstone.operators.chunk import chunk_files
from siltstone.operators.extract import extract
from siltstone.operators.resolve import resolve
from siltstone.operators.search import search as run_search
from siltstone.runtime import materialize
from siltstone.schemas import import_kind
from siltstone.sources import git
from siltstone.sources.config import Config
from siltstone.sources.files import read_contents, scan_files
from siltstone.sources.store import Store

#: More changed files than this are a reason to index everything anew.
FULL_REINDEX = 20_000


class Engine:
    """One project in one store. ``provider`` makes vectors; without a model server the hashing one is used."""

    def __init__(self, spark: SparkSession, root: str, store: Store, project: str, *, config: Config | None = None, provider: Provider | None = None, auto_refresh: bool = True):
        """``auto_refresh``: the queries index what has changed since the latest snapshot first. [INC-2]"""
        self.auto_refresh = auto_refresh
        self.spark, self.root, self.store, self.project = spark, root, store, project
        self.config, self.provider = config or Config(), provider or HashingProvider()

    # Indexing
    def _scan(self, *, content: bool = True) -> DataFrame:
        rules = os.path.join(self.root, ".gitignore")
        text = None
        if os.path.exists(rules):
            with open(rules, encoding="utf-8", errors="replace") as f:
                text = f.read()
        return scan_files(self.spark, self.root, ignore_text=text, content=content)

    def _write(self, snapshot: str, changed: DataFrame, every: DataFrame) -> int:
        """Extract, chunk, resolve, embed and write the changed files (with content). ``every``: all paths of the snapshot."""
        ids = [F.lit(self.project).alias("project_id"), F.lit(snapshot).alias("snapshot_id")]
        key = lambda *cols: F.sha2(F.concat_ws("\0", F.lit(snapshot), *[F.col(c).cast("string") for c in cols]), 256)
        content = changed.select("path", "content", "language_id")
        parsed = materialize(extract(content).select("path", "language_id", "symbols", "imports", "chunks", "error"), "parsed")
        self.store.write("files", changed.select(*ids, "path", "sha256", "mtime_ms", "size", "language_id"))
        symbols = parsed.select("path", F.inline("symbols")).withColumn("id", key("path", "kind", "container_name", "name", "start_line"))
        symbols = symbols.select(*ids, "id", F.col("path").alias("file_path"), "kind", "name", "container_name", "exported", "start_line", "end_line", "signature", F.lit(None).cast("string").alias("doc_comment"), "metadata_json")
        symbols = symbols.dropDuplicates(["id"])
        self.store.write("symbols", symbols)
        imports = parsed.select(F.col("path").alias("from_path"), F.inline("imports")).select("from_path", import_kind(F.col("kind")).alias("kind"), F.col("specifier").alias("to_specifier")).distinct()
        resolved = resolve(imports, every).withColumn("id", key("from_path", "kind", "to_specifier"))
        self.store.write("dependencies", resolved.select(*ids, "id", "from_path", "to_specifier", "to_path", "kind", F.coalesce("dependency_type", F.lit("unresolved")).alias("dependency_type")))
        made = chunk_files(content.join(parsed.select("path", "chunks"), "path"), plugin_chunks="chunks")
        made = materialize(made.select(F.col("path").alias("file_path"), "start_line", "end_line", F.col("chunk_type").alias("stated"), "primary_symbol", F.col("content").alias("text")).where("trim(text) <> ''").dropDuplicates(["file_path", "start_line", "end_line"]), "chunks")
        best = primary_symbols(made.drop("text"), symbols.select("file_path", "kind", "name", "start_line", "end_line"), keys=["file_path"], chunk_key=["file_path", "start_line", "end_line"])
        best = best.select("file_path", "start_line", "end_line", F.col("s_name").alias("inferred"))
        rows = made.join(best, ["file_path", "start_line", "end_line"], "left")
        symbol = F.coalesce(F.when(F.col("primary_symbol") != "", F.col("primary_symbol")), F.when(F.col("stated") != "imports", F.col("inferred")))
        rows = rows.select(*ids, "file_path", "start_line", "end_line", hash_text(F.col("text")).alias("content_hash"), token_estimate(F.col("text")).alias("token_estimate"), chunk_type(F.col("stated"), F.col("text"), symbol).alias("chunk_type"), symbol.alias("primary_symbol"), F.lit(False).alias("has_overlap"), "text")
        rows = rows.withColumn("chunk_id", key("file_path", "start_line", "end_line", "content_hash"))
        self.store.write("chunks", rows)
        asked = rows.where("chunk_type <> 'imports'") if self.config.skipImportChunksInVectors else rows  # [FLT-16]
        vectors = embed(asked, self.provider, text_col="text", batch=self.config.indexBatchSize).where("embedding is not null")
        self.store.upsert("vectors", vectors, ["chunk_id"])
        metrics = git.with_churn(changed.select("path"), git.churn_table(self.spark, self.root)).select(F.col("path").alias("file_path"), F.to_json(F.struct(F.lit(0).alias("complexity"), F.lit(100).alias("maintainability"), "churn")).alias("metrics_json"))
        self.store.write("file_metrics", metrics.select(*ids, "file_path", "metrics_json", F.unix_millis(F.current_timestamp()).alias("updated_at")))
        self.errors = parsed.where("error is not null").select("path", "error")
        return changed.count()

    def index(self, *, full: bool = False) -> str:
        """[INC-1] Index the working tree: all of it, or what changed against the latest completed snapshot. Returns the id of the
        snapshot that is now the latest; nothing changed, nothing is written. Files are compared by content hash, so the working
        tree's own changes count whether or not they are committed. [INC-2, INC-3, JOIN-14]"""
        self.store.fail_stale(self.project)
        old = self.store.latest_snapshot(self.project)
        now = materialize(self._scan(), "scan")
        if old and not full:
            before = self.store.read("files", self.project, old)
            changes = materialize(git.compare_versions(before, now, key="path", value="sha256"), "changes")
            n = changes.count()
            if n == 0:
                return old
            full = n > FULL_REINDEX
        with self.store.transaction(self.project, git.head_commit(self.root)) as snapshot:
            if old and not full:
                self.store.copy(self.project, old, snapshot, changes)
                changed = now.join(changes.where("change <> 'deleted'").select("path"), "path", "left_semi")
            else:
                changed = now
            done = self._write(snapshot, changed, now.select("path"))
            self.store.set_progress(snapshot, done, done)
        self.store.clear(self.project, snapshot)
        return snapshot

    def dry_run(self) -> DataFrame:
        """(change, n): what ``index`` would do."""
        old = self.store.latest_snapshot(self.project)
        before = self.store.read("files", self.project, old) if old else self.spark.createDataFrame([], "path string, sha256 string")
        return git.compare_versions(before, self._scan(), key="path", value="sha256").groupBy("change").agg(F.count(F.lit(1)).alias("n"))

    def _latest(self) -> str:
        snapshot = self.store.latest_snapshot(self.project)
        if snapshot is None:
            raise LookupError("the project isn't indexed")
        return snapshot

    def refresh(self) -> str:
        """[INC-2] Index again if a file came, went or was written since the latest snapshot; names and times are compared, so
        nothing is read if all is as it was. A run that fails leaves the old snapshot in use."""
        snapshot = self._latest()
        known = self.store.read("files", self.project, snapshot).select("path", "mtime_ms")
        now = self._scan(content=False)
        same = now.count() == known.count() and now.join(known, ["path", "mtime_ms"], "left_anti").isEmpty()
        return snapshot if same else self.index()

    def _current(self) -> str:
        return self.refresh() if self.auto_refresh else self._latest()

    def table(self, name: str, snapshot: str | None = None) -> DataFrame:
        return self.store.read(name, self.project, snapshot or self._latest())

    # Queries
    def _prefix(self, prefix: str | None, files: DataFrame) -> str | None:
        """[FLT-14] A prefix that fits no file is dropped."""
        p = clean_prefix(prefix)
        return p if p and not files.where(has_prefix(F.col("path"), p)).isEmpty() else None

    def search(self, query: str, *, k: int = 3, prefix: str | None = None, chunk_types: Sequence[str] = (), include_imports: bool = False, min_score: float | None = None) -> DataFrame:
        snapshot = self._current()
        least = self.config.searchMinScore if min_score is None else min_score
        vector = self.provider.embed([query])[0]
        return run_search(self.table("vectors", snapshot), self.table("symbols", snapshot), query, vector, project=self.project, snapshot=snapshot, k=k, prefix=self._prefix(prefix, self.table("files", snapshot)), chunk_types=chunk_types, include_imports=include_imports, min_score=least, contents=lambda paths: read_contents(self.spark, self.root, paths))

    def structure(self, **options) -> DataFrame:
        files = self.table("files", self._current())
        options["prefix"] = self._prefix(options.get("prefix"), files)
        options.setdefault("excludes", () if options.pop("include_fixtures", False) else self.config.excludePaths)
        return lookup.structure(files, self.table("symbols"), **options)

    def architecture(self, *, prefix: str | None = None, include_fixtures: bool = False) -> architecture.Architecture:
        files = self.table("files", self._current())
        made = architecture.summarise(files, self.table("dependencies"), excludes=() if include_fixtures else self.config.excludePaths)
        return architecture.under(made, files, self._prefix(prefix, files))

    def explain(self, query: str, **options) -> DataFrame:
        snapshot = self._current()
        return lookup.explain(self.table("symbols", snapshot), self.table("dependencies", snapshot), query, **options)

    def deps(self, path: str, **options) -> DataFrame:
        snapshot = self._current()
        return lookup.deps(self.table("files", snapshot), self.table("dependencies", snapshot), path, **options)

    def status(self) -> DataFrame:
        return lookup.status({name: self.table(name) for name in ("files", "symbols", "chunks", "dependencies", "vectors")})
