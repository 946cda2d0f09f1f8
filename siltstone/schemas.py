"""Tables of the catalogue: one StructType each, the state names and their stored forms. [§1.2, §1.3]"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "array<float>": T.ArrayType(T.FloatType())}


def _S(columns: str) -> T.StructType:
    """A schema from "name type, name type"; unlike Spark's DDL it can be read without a session."""
    return T.StructType([T.StructField(*(n, _TYPES[t])) for n, t in (c.split() for c in columns.split(", "))])


SNAPSHOTS = _S("id string, project_id string, git_ref string, status string, created_at long, failure_reason string, processed_files int, total_files int")
FILES = _S("project_id string, snapshot_id string, path string, sha256 string, mtime_ms long, size long, language_id string")
CHUNKS = _S("project_id string, snapshot_id string, chunk_id string, file_path string, start_line int, end_line int, content_hash string, token_estimate int, chunk_type string, primary_symbol string, has_overlap boolean")
SYMBOLS = _S("project_id string, snapshot_id string, id string, file_path string, kind string, name string, container_name string, exported boolean, start_line int, end_line int, signature string, doc_comment string, metadata_json string")
DEPENDENCIES = _S("project_id string, snapshot_id string, id string, from_path string, to_specifier string, to_path string, kind string, dependency_type string")
ARTIFACTS = _S("project_id string, snapshot_id string, artifact_type string, scope string, data_json string, updated_at long")
FILE_METRICS = _S("project_id string, snapshot_id string, file_path string, metrics_json string, updated_at long")
VECTORS = _S("project_id string, snapshot_id string, chunk_id string, file_path string, start_line int, end_line int, content_hash string, chunk_type string, primary_symbol string, embedding array<float>")

TABLES = {"files": FILES, "chunks": CHUNKS, "symbols": SYMBOLS, "dependencies": DEPENDENCIES, "artifacts": ARTIFACTS, "file_metrics": FILE_METRICS, "vectors": VECTORS}
#: The column of each table that names the file a row belongs to.
FILE_COLUMN = {"files": "path", "chunks": "file_path", "symbols": "file_path", "dependencies": "from_path", "file_metrics": "file_path", "vectors": "file_path"}

DEPENDENCY_TYPES = ("internal", "external", "builtin", "unresolved")
#: Import kinds of the extractors that the dependency table tells apart; all others are stored as ``import``.
IMPORT_KINDS = ("import", "require", "dynamic_import")


def stored_status(status: str) -> str:
    """``completed`` is stored as ``ready``."""
    return "ready" if status == "completed" else status


def read_status(stored: Column) -> Column:
    """[PRJ-1] ``ready`` and ``completed`` are completed, unknown states pending."""
    return F.when(stored.isin("ready", "completed"), "completed").when(stored.isin("pending", "indexing", "failed"), stored).otherwise("pending")


def read_metrics(metrics_json: Column) -> Column:
    """[PRJ-3] Metrics with defaults 0, 0, 0 and null; the same for malformed JSON."""
    got = F.from_json(metrics_json, "complexity double, maintainability double, churn bigint, testCoverage double")
    return F.struct(*[F.coalesce(got[c], F.lit(0)).cast(k).alias(c) for c, k in (("complexity", "double"), ("maintainability", "double"), ("churn", "bigint"))], got["testCoverage"].alias("testCoverage"))


def import_kind(kind: Column) -> Column:
    return F.when(kind.isin(*IMPORT_KINDS), kind).otherwise("import")
