"""The versioned catalogue: Parquet partitioned by project and snapshot, with an append-only log of snapshot states. [SNK-*, WIN-1, INC-1]

A snapshot's rows are written to partitions of its own and become visible with the state ``completed``; readers use the latest
completed snapshot, so a failed run leaves everything as it was and nothing is deleted before its replacement is there.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.runtime import materialize, release
from siltstone.schemas import FILE_COLUMN, SNAPSHOTS, TABLES, read_status, stored_status
from siltstone.sources.git import latest

STALE_MS = 30 * 60 * 1000


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """[SNK-1, SNK-3] ``new`` rows replace ``old`` ones of the same keys; the last of several new ones must be made single before."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert_latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """[SNK-1] One row a key: the one with the greatest ``order``."""
    return latest(rows, keys=keys, order=[F.desc(order)])


def replace_for_files(old: DataFrame, new: DataFrame, changed: DataFrame, file_col: str) -> DataFrame:
    """[SNK-2] Rows of changed files (column path) are dropped, new ones added."""
    return old.join(changed.select(F.col("path").alias(file_col)).distinct(), file_col, "left_anti").unionByName(new)


def copy_forward(rows: DataFrame, snapshot: str, gone: DataFrame, file_col: str) -> DataFrame:
    """[SNK-4, SNK-6, SET-1] The rows of files that are not in ``gone`` (column path), under a new snapshot id. A copy: the old
    snapshot keeps its rows."""
    return rows.join(gone.select(F.col("path").alias(file_col)).distinct(), file_col, "left_anti").withColumn("snapshot_id", F.lit(snapshot)).select(*rows.columns)


def mark_stale(snapshots: DataFrame, now_ms: int, after_ms: int = STALE_MS) -> DataFrame:
    """[SNK-10] Snapshots still indexing after half an hour have failed."""
    old = (F.col("status") == "indexing") & (F.col("created_at") < now_ms - after_ms)
    return snapshots.withColumn("failure_reason", F.when(old, "Indexing process crashed").otherwise(F.col("failure_reason"))).withColumn("status", F.when(old, "failed").otherwise(F.col("status")))


def kept_snapshots(snapshots: DataFrame, keep: str | None, now_ms: int, *, spare_indexing: bool = True) -> DataFrame:
    """[SNK-9] What a clean-up leaves: the one to keep, and young ones that are being indexed."""
    young = (F.col("status") == "indexing") & (F.col("created_at") >= now_ms - STALE_MS)
    chosen = F.col("id").eqNullSafe(F.lit(keep))
    return snapshots.where(chosen | young if spare_indexing else chosen)


def schema_version(migrations: DataFrame) -> DataFrame:
    """[AGG-11] (version): the greatest one applied, 0 where none is."""
    return migrations.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def page(snapshots: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """[SRT-3] One page of a list of snapshots, newest first, ties by id."""
    return snapshots.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


#: The order in which each table is listed. [SRT-4]
LISTED = {"files": ["path"], "chunks": ["file_path", "start_line"], "symbols": ["file_path", "name"], "dependencies": ["from_path", "to_specifier"]}


class Store:
    """Tables under one folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    # Snapshots: a log of states, the latest entry of an id counts. [SNK-8, SRT-3]
    def _log(self, row: dict) -> None:
        entry = self.spark.createDataFrame([tuple(row.get(f.name) for f in SNAPSHOTS.fields)], SNAPSHOTS)
        entry.withColumn("logged_at", F.lit(time.time_ns())).coalesce(1).write.mode("append").parquet(self._path("snapshot_log"))

    def snapshots(self) -> DataFrame:
        if not self._exists(self._path("snapshot_log")):
            return self.spark.createDataFrame([], SNAPSHOTS)
        rows = latest(self.spark.read.parquet(self._path("snapshot_log")), keys=["id"], order=[F.desc("logged_at")]).drop("logged_at")
        return rows.where("status <> 'removed'").withColumn("status", read_status(F.col("status")))

    def create_snapshot(self, project: str, git_ref: str | None = None, *, now_ms: int | None = None) -> str:
        snapshot = uuid.uuid4().hex
        self._log({"id": snapshot, "project_id": project, "git_ref": git_ref, "status": "indexing", "created_at": now_ms or int(time.time() * 1000), "processed_files": 0, "total_files": 0})
        return snapshot

    def _update(self, snapshot: str, **values: object) -> None:
        row = self.snapshots().where(F.col("id") == snapshot).first()
        if row is None:
            raise KeyError(snapshot)
        self._log(row.asDict() | values)

    @contextmanager
    def transaction(self, project: str, git_ref: str | None = None) -> Iterator[str]:
        """[SNK-11] A new snapshot to write to. What is written is seen by readers from the end of the block on, all of it at once; if
        the block fails, the rows are removed, the snapshot is marked as failed with the reason, and the error goes on."""
        snapshot = self.create_snapshot(project, git_ref)
        try:
            yield snapshot
        except BaseException as e:
            for table in TABLES:
                self._delete(f"{self._path(table)}/project_id={project}/snapshot_id={snapshot}")
            self.set_status(snapshot, "failed", str(e)[:500])
            raise
        self.set_status(snapshot, "completed")

    def set_status(self, snapshot: str, status: str, reason: str | None = None) -> None:
        self._update(snapshot, status=stored_status(status), failure_reason=reason)

    def set_progress(self, snapshot: str, processed: int, total: int) -> None:
        self._update(snapshot, processed_files=processed, total_files=total)

    def latest_snapshot(self, project: str, *, completed: bool = True) -> str | None:
        """[WIN-1] Newest by creation time, then id."""
        rows = self.snapshots().where(F.col("project_id") == project)
        row = (rows.where("status = 'completed'") if completed else rows).orderBy(F.desc("created_at"), F.desc("id")).first()
        return row["id"] if row else None

    # Rows. [SRC-9]
    def write(self, table: str, rows: DataFrame) -> None:
        """Add rows to their snapshots' partitions."""
        schema = TABLES[table]
        rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).write.mode("append").partitionBy("project_id", "snapshot_id").parquet(self._path(table))

    def upsert(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        """[SNK-5] Rows replace those of their snapshots that have the same keys; only these snapshots' partitions are written anew."""
        schema = TABLES[table]
        rows = materialize(rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]), "upsert-new")
        if not self._exists(self._path(table)):
            self.write(table, rows)
            return
        parts = ["project_id", "snapshot_id"]
        touched = rows.select(*parts).distinct()
        old = self.spark.read.schema(schema).parquet(self._path(table)).join(F.broadcast(touched), parts, "left_semi").select(*schema.names)
        merged = materialize(upsert(old, rows, [*parts, *keys]).select(*schema.names), "upsert-merged")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(self._path(table))
        release(merged)
        release(rows)

    def read(self, table: str, project: str, snapshot: str, *, ordered: bool = False) -> DataFrame:
        """One snapshot's rows: one partition is read. ``ordered``: in the table's listing order."""
        schema = TABLES[table]
        if not self._exists(self._path(table)):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(self._path(table))
        rows = rows.where((F.col("project_id") == project) & (F.col("snapshot_id") == snapshot)).select(*schema.names)
        return rows.orderBy(*LISTED.get(table, [])) if ordered and table in LISTED else rows

    def copy(self, project: str, old: str, new: str, gone: DataFrame, tables: Iterable[str] = tuple(FILE_COLUMN)) -> None:
        for table in tables:
            self.write(table, copy_forward(self.read(table, project, old), new, gone, FILE_COLUMN[table]))

    def remove(self, project: str, snapshot: str) -> None:
        """[SNK-7]"""
        for table in TABLES:
            self._delete(f"{self._path(table)}/project_id={project}/snapshot_id={snapshot}")
        self._update(snapshot, status="removed")

    def list_snapshots(self, project: str, limit: int = 50, offset: int = 0) -> DataFrame:
        """[SRT-3]"""
        return page(self.snapshots().where(F.col("project_id") == project), limit, offset)

    def fail_stale(self, project: str, *, now_ms: int | None = None) -> list[str]:
        """[SNK-10] Mark the project's snapshots whose indexing has crashed as failed; returns their ids."""
        mine = self.snapshots().where(F.col("project_id") == project)
        crashed = mark_stale(mine, now_ms or int(time.time() * 1000)).where("status = 'failed'").join(mine.where("status = 'indexing'").select("id"), "id", "left_semi").collect()
        for row in crashed:
            self.set_status(row["id"], "failed", row["failure_reason"])
        return [row["id"] for row in crashed]

    def remove_project(self, project: str) -> None:
        """[SNK-7] All snapshots of a project."""
        for row in self.snapshots().where(F.col("project_id") == project).select("id").collect():
            self.remove(project, row["id"])

    def clear(self, project: str, keep: str | None, *, spare_indexing: bool = True) -> list[str]:
        """[SNK-9] Remove the project's other snapshots; returns their ids."""
        mine = self.snapshots().where(F.col("project_id") == project)
        kept = {r["id"] for r in kept_snapshots(mine, keep, int(time.time() * 1000), spare_indexing=spare_indexing).select("id").collect()}
        gone = [r["id"] for r in mine.select("id").collect() if r["id"] not in kept]
        for snapshot in gone:
            self.remove(project, snapshot)
        return gone
