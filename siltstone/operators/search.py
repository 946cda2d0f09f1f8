"""Semantic search in one plan. [VEC-7, FLT-10, FLT-11, SRT-2]"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import is_test_file, name_tokens
from siltstone.operators import vector
from siltstone.operators.attribute import attribute
from siltstone.runtime import materialize

DEFAULT_MIN_SCORE, DEFAULT_RESULTS = 0.55, 3


def search(vectors: DataFrame, symbols: DataFrame, query: str, embedded: Sequence[float], *, project: str, snapshot: str, k: int = DEFAULT_RESULTS, prefix: str | None = None, chunk_types: Sequence[str] = (), include_imports: bool = False, min_score: float = DEFAULT_MIN_SCORE, contents: DataFrame | Callable[[list[str]], DataFrame] | None = None) -> DataFrame:
    """Prefilter, exact top k, symbol attribution, penalties, least score, order.

    Import and preamble chunks and low scores are dropped after the top k was taken, so fewer than k rows may come back. With
    ``contents`` (file_path, content), or a function that reads it for a list of paths, symbols are scored by their bodies too
    [JOIN-6]; it joins at most k rows, and a file that is missing there counts as empty.
    """
    if not 0 <= min_score <= 1:
        raise ValueError("min_score must be between 0 and 1")
    if k <= 0:
        raise ValueError("k must be positive")
    found = vector.top_k(vector.prefilter(vectors, project=project, snapshot=snapshot, prefix=prefix, chunk_types=chunk_types), embedded, k)
    if not include_imports and not chunk_types:
        found = found.where(~F.col("chunk_type").isin("imports", "preamble"))
    found = found.drop("embedding")
    if callable(contents):
        found = materialize(found, "search-top")  # k rows at most
        contents = contents([r["file_path"] for r in found.select("file_path").distinct().collect()])
    if contents is not None:
        found = found.join(contents.select("file_path", F.col("content").alias("_content")), "file_path", "left").withColumn("_content", F.coalesce("_content", F.lit("")))
    here = symbols.where((F.col("project_id") == project) & (F.col("snapshot_id") == snapshot)).drop("project_id", "snapshot_id")
    tokens = name_tokens(F.lit(query))
    out = attribute(found, here, tokens, result_key=["chunk_id"], content_col="_content" if contents is not None else None)
    score = vector.penalised(F.col("score"), F.col("chunk_type"), is_test_file(F.col("file_path")))
    return out.withColumn("score", score).where(F.col("score") >= min_score).drop("_content").orderBy(F.desc("score"), "distance", "chunk_id")
