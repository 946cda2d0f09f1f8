"""Session helpers shared by every operator: inputs, shared scratch tables, code shipping."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Collection

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Applications whose executors have this package.
_SHIPPED: set[str] = set()
#: Tables that ``materialize`` wrote and nothing has removed: file system and path by name.
_WRITTEN: dict[str, tuple] = {}
#: Bytes that a row of a broadcast hash table takes beside its values.
ROW_BYTES = 48


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``, and must. Where that is unset in local mode (tests, a laptop) a temporary folder
    of this process is made once and removed at exit.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="siltstone-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _WRITTEN[path] = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop
    out._siltstone_table = path
    return out


def materialize_alone(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``materialize`` of what ``make`` returns; the tables that were written on the way are removed."""
    before = set(_WRITTEN)
    out = materialize(make(), label)
    release_tables(keep=before | {out._siltstone_table})
    return out


def release(df: DataFrame) -> None:
    """Remove the table that ``materialize`` returned, as soon as nothing reads it any more."""
    system, path = _WRITTEN.pop(df._siltstone_table, (None, None))
    if system:
        system.delete(path, True)


def release_tables(keep: Collection[str] = ()) -> None:
    """Remove the tables that this process materialised, but for those to keep. Results that were built on them must have been
    written before."""
    for name in [n for n in _WRITTEN if n not in keep]:
        system, path = _WRITTEN.pop(name)
        system.delete(path, True)


@atexit.register
def _release_at_exit() -> None:
    try:
        release_tables()
    except Exception:  # noqa: BLE001  the JVM may have ended first; a cluster's shared folder is then cleared by its owner
        _WRITTEN.clear()


def small(df: DataFrame, bound: int = 64 << 20) -> DataFrame:
    """``df``, whose columns must be numbers, marked for broadcasting if its rows take at most ``bound`` bytes in a hash table; else
    as it is, to be joined by shuffling."""
    width = ROW_BYTES + 8 * len(df.schema)
    most = bound // width
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python functions can be unpickled there."""
    sc: SparkContext = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="siltstone-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "siltstone_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.join("siltstone", os.path.relpath(full, root)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
