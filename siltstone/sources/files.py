"""Scans of project folders as DataFrames. [SRC-1, SRC-2, SRC-12]"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import EXTENSION_LANGUAGE, extension, hash_text, language_of
from siltstone.sources.ignore import is_ignored, read_patterns


def _plain(path: str) -> str:
    """A path without a local file's scheme and without a slash at the end."""
    return re.sub("^file:(//)?", "", path).rstrip("/")


def _folders(spark: SparkSession, root: str) -> Iterator[tuple[str, bool]]:
    """(folder, readable) of the root and the folders below it. One that can't be read, but for the root, is passed over."""
    sc = spark.sparkContext
    start = sc._jvm.org.apache.hadoop.fs.Path(root)
    system = start.getFileSystem(sc._jsc.hadoopConfiguration())
    todo = [start]
    while todo:
        folder = todo.pop()
        try:
            found = system.listStatus(folder)
        except Py4JJavaError:
            if folder.equals(start):
                raise
            yield folder.toString(), False
            continue
        yield folder.toString(), True
        todo += [f.getPath() for f in found if f.isDirectory()]


def scan_files(spark: SparkSession, root: str, *, extensions: Sequence[str] = tuple(EXTENSION_LANGUAGE), ignore_text: str | None = None, content: bool = True) -> DataFrame:
    """(path, content, size, mtime_ms, sha256, language_id) of the project's files that no rule ignores, paths relative to root; or,
    without ``content``, (path, mtime_ms) alone, which reads no file.

    ``root`` may be in any file system. Files that vanish while reading are skipped, as are folders that can't be read. Only files of
    the extensions are listed, and folders that the rules ignore are left out before anything is read.
    """
    patterns = read_patterns(ignore_text)
    base = quote(_plain(root)) + "/"
    first, *folders = [f for f, readable in _folders(spark, root) if readable]
    inside = spark.createDataFrame([(f, _plain(f).removeprefix(_plain(root) + "/")) for f in folders], "folder string, path string")
    kept = [first, *[r["folder"] for r in inside.where(~is_ignored(F.col("path"), patterns)).collect()]]
    endings = ",".join(e.removeprefix(".") for e in extensions)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{endings}}}").option("ignoreMissingFiles", True).load(kept)
    path = F.url_decode(F.element_at(F.split("path", base, 2), 2))
    mtime = (F.col("modificationTime").cast("double") * 1000).cast("long").alias("mtime_ms")
    rows = listed.select(path.alias("path"), mtime, *(["content"] if content else []))
    rows = rows.where(extension(F.col("path")).isin(*extensions)).where(~is_ignored(F.col("path"), patterns))
    if not content:
        return rows
    rows = rows.withColumn("content", F.decode("content", "UTF-8"))
    return rows.select("path", "content", F.length("content").cast("long").alias("size"), "mtime_ms", hash_text(F.col("content")).alias("sha256"), language_of(F.col("path")).alias("language_id"))


def read_contents(spark: SparkSession, root: str, paths: Sequence[str]) -> DataFrame:
    """(file_path, content) of a few files; those that aren't there have no row."""
    sc = spark.sparkContext
    whole = [f"{root.rstrip('/')}/{p}" for p in paths]
    there = []
    for w in whole:
        p = sc._jvm.org.apache.hadoop.fs.Path(w)
        if p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p):
            there.append(w)
    if not there:
        return spark.createDataFrame([], "file_path string, content string")
    base = quote(_plain(root)) + "/"
    rows = spark.read.format("binaryFile").load(there)
    return rows.select(F.url_decode(F.element_at(F.split("path", base, 2), 2)).alias("file_path"), F.decode("content", "UTF-8").alias("content"))
