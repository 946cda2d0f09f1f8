"""Change sets from git. Parsers are plain functions of git's output; readers run git in a subprocess. [SRC-4..8, AGG-4, AGG-14]"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
import uuid
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.runtime import shared_dir


@dataclass(frozen=True)
class Changes:
    added: tuple[str, ...] = ()
    modified: tuple[str, ...] = ()
    deleted: tuple[str, ...] = ()


def _changes(found: list[tuple[str, str]]) -> Changes:
    of = lambda kind: tuple(sorted({p for k, p in found if k == kind}))
    return Changes(of("added"), of("modified"), of("deleted"))


def parse_name_status(text: str) -> Changes:
    """Output of ``git diff --name-status``; a rename deletes one path and adds another, unknown states modify."""
    found: list[tuple[str, str]] = []
    for line in text.splitlines():
        state, *paths = line.strip().split("\t")
        if not paths:
            continue
        if state[:1] == "R" and len(paths) > 1:
            found += [("deleted", paths[0]), ("added", paths[1])]
        else:
            found.append(({"A": "added", "D": "deleted"}.get(state[:1], "modified"), paths[-1]))
    return _changes(found)


def parse_porcelain(text: str) -> Changes:
    """Output of ``git status --porcelain``."""
    found: list[tuple[str, str]] = []
    for line in text.splitlines():
        if len(line) < 3:
            continue
        if line[1] == " " and line[2:3] != " " and not line.startswith("??") and line[0] != " " and len(line.split(" ", 1)[0]) == 1:
            line = " " + line  # the first line of output whose leading space was trimmed
        state, path = line[:2], line[3:].strip().strip('"')
        if "R" in state and " -> " in path:
            old, new = path.split(" -> ", 1)
            found += [("deleted", old.strip('"')), ("added", new.strip('"'))]
        else:
            found.append(("added" if state == "??" or "A" in state else "deleted" if "D" in state else "modified", path))
    return _changes(found)


def parse_numstat(text: str) -> dict[str, int]:
    """Lines added plus removed per path from ``git log --numstat``; binary files count 0."""
    churn: Counter[str] = Counter()
    for line in text.splitlines():
        parts = line.split("\t")
        if len(parts) == 3:
            churn[parts[2]] += sum(int(n) if n.isdigit() else 0 for n in parts[:2])
    return dict(churn)


def merge_changes(*sets: Changes) -> Changes:
    """Change sets one after the other: the last state of a path wins, but what was added and then modified stays added."""
    state: dict[str, str] = {}
    for c in sets:
        for path in c.deleted:
            state[path] = "deleted"
        for path in c.added:
            state[path] = "added"
        for path in c.modified:
            state[path] = "added" if state.get(path) == "added" else "modified"
    return _changes([(kind, path) for path, kind in state.items()])


def merge_log(log: DataFrame, *, key: str, state: str, order: str) -> DataFrame:
    """[AGG-14] The same over a table of events (key, state, order): final state of each key, by two aggregates in one pass."""
    other = F.when(F.col(state) != "modified", F.col(order))
    got = log.groupBy(key).agg(F.max_by(state, order).alias("last"), F.max_by(state, other).alias("before"))
    return got.select(key, F.when((F.col("last") == "modified") & (F.col("before") == "added"), "added").otherwise(F.col("last")).alias("state"))


def _git(root: str, *args: str) -> str | None:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=120)
    return done.stdout if done.returncode == 0 else None


def head_commit(root: str) -> str | None:
    out = _git(root, "rev-parse", "HEAD")
    return out.strip() if out else None


def is_dirty(root: str) -> bool:
    return bool((_git(root, "status", "--porcelain") or "").strip())


def changed_files(root: str, since: str) -> Changes:
    return parse_name_status(_git(root, "diff", "--name-status", f"{since}..HEAD") or "")


def working_tree_changes(root: str) -> Changes:
    return parse_porcelain(_git(root, "status", "--porcelain", "--untracked-files=all") or "")


def churn_by_file(root: str, days: int = 30) -> dict[str, int]:
    return parse_numstat(_git(root, "log", f"--since={max(1, days)} days ago", "--numstat", "--format=") or "")


def numstat_churn(lines: DataFrame, col: str = "value") -> DataFrame:
    """[AGG-4, SRC-8] (path, churn) from lines of ``git log --numstat``: lines added plus removed; binary files count 0, other
    lines nothing."""
    parts = F.split(col, "\t")
    number = lambda i: F.coalesce(F.when(parts[i].rlike("^[0-9]+$"), parts[i]).cast("long"), F.lit(0))
    rows = lines.where(F.size(parts) == 3).select(parts[2].alias("path"), (number(0) + number(1)).alias("churn"))
    return rows.groupBy("path").agg(F.sum("churn").alias("churn"))


def churn_table(spark: SparkSession, root: str, days: int = 30) -> DataFrame:
    """(path, churn) of the last days; the log goes through a file of the shared folder, not through the plan."""
    folder = tempfile.mkdtemp(prefix="siltstone-log-")
    try:
        local = os.path.join(folder, "numstat.txt")
        with open(local, "w", encoding="utf-8") as f:
            done = subprocess.run(["git", "-C", root, "log", f"--since={max(1, days)} days ago", "--numstat", "--format="], stdout=f, stderr=subprocess.DEVNULL, timeout=600)
        if done.returncode:
            return spark.createDataFrame([], "path string, churn long")
        sc = spark.sparkContext
        shared = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/numstat-{uuid.uuid4().hex}.txt")
        shared.getFileSystem(sc._jsc.hadoopConfiguration()).copyFromLocalFile(sc._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), shared)
        return numstat_churn(spark.read.text(shared.toString()))
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def with_churn(files: DataFrame, churn: DataFrame, *, key: str = "path") -> DataFrame:
    """[JOIN-13] ``files`` with churn, 0 for files that the log doesn't name."""
    return files.join(churn.select(F.col("path").alias(key), "churn"), key, "left").withColumn("churn", F.coalesce("churn", F.lit(0)))


def as_table(spark: SparkSession, changes: Changes) -> DataFrame:
    """(path, change)"""
    rows = [(p, k) for k in ("added", "modified", "deleted") for p in getattr(changes, k)]
    return spark.createDataFrame(rows, "path string, change string")


def compare_versions(old: DataFrame, new: DataFrame, *, key: str, value: str) -> DataFrame:
    """[SRC-6] (key, change) between two versions of a table, by one full join."""
    a = old.select(F.col(key).alias("a_key"), F.col(value).alias("a_value"))
    b = new.select(F.col(key).alias("b_key"), F.col(value).alias("b_value"))
    met = a.join(b, F.col("a_key") == F.col("b_key"), "full")
    change = F.when(F.col("a_key").isNull(), "added").when(F.col("b_key").isNull(), "deleted").when(~F.col("a_value").eqNullSafe(F.col("b_value")), "modified")
    return met.select(F.coalesce("a_key", "b_key").alias(key), change.alias("change")).where("change is not null")


def latest(rows: DataFrame, *, keys: list[str], order: list) -> DataFrame:
    """[WIN-1] The first row of each key in an order."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


#: Lines that mark this engine's part of a hook.
HOOK_START, HOOK_END = "# >>> siltstone >>>", "# <<< siltstone <<<"


def install_hook(root: str, command: str) -> bool:
    """[INC-4] Let git run ``command`` in the background after each commit. An own hook is kept and added to; a second call changes
    nothing, nor does one outside of a repository. Returns whether the hook was written."""
    folder = os.path.join(root, ".git")
    if not os.path.isdir(folder):
        return False
    path = os.path.join(folder, "hooks", "post-commit")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    old = "#!/bin/sh\n"
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            old = f.read()
    if HOOK_START in old:
        return False
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"{old.rstrip(chr(10))}\n\n{HOOK_START}\nnohup sh -c '{command}' > /dev/null 2>&1 &\n{HOOK_END}\n")
    os.chmod(path, 0o755)
    return True
