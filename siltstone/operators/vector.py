"""Vector search: exact cosine top-k with prefilters, penalties, and a blocked k-nearest-neighbour graph. [VEC-*, SRT-1, PRJ-2]"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import has_prefix
from siltstone.runtime import ship

#: Factors that lower the score of chunks which say little about what was asked. [FN-7]
IMPORTS_PENALTY, PREAMBLE_PENALTY, TEST_PENALTY = 0.5, 0.7, 0.75
#: Vectors of one block of the neighbour graph.
BLOCK_ROWS = 4096


def cosine_distance(vector: Column, query: Sequence[float]) -> Column:
    """[FN-18] 1 - cosine, 0 to 2, in doubles. The query's norm is folded into its literal."""
    norm = math.sqrt(sum(x * x for x in query)) or 1.0
    unit = F.lit([float(x) / norm for x in query])
    doubles = vector.cast("array<double>")
    add = lambda total, x: total + x
    dot = F.aggregate(F.zip_with(doubles, unit, lambda a, b: a * b), F.lit(0.0), add)
    own = F.sqrt(F.aggregate(F.transform(doubles, lambda a: a * a), F.lit(0.0), add))
    return 1 - dot / own


def valid_vector(vector: Column, size: int) -> Column:
    """[VEC-5] The right length, and every component a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == size) & fine, F.lit(False))


def similarity(distance: Column) -> Column:
    """[PRJ-2] A distance of 0 is a score of 1, of 2 a score of 0."""
    return F.greatest(F.lit(0.0), 1 - distance / 2)


def prefilter(vectors: DataFrame, *, project: str, snapshot: str | None = None, file: str | None = None, prefix: str | None = None, chunk_types: Sequence[str] = ()) -> DataFrame:
    """[FLT-1] The conjunction that goes before the top k; it reaches the Parquet scan. A file wins over a prefix."""
    if not project:
        raise ValueError("a project is required")
    out = vectors.where(F.col("project_id") == project)
    if snapshot:
        out = out.where(F.col("snapshot_id") == snapshot)
    if file:
        out = out.where(F.col("file_path") == file)
    elif prefix:
        out = out.where(has_prefix(F.col("file_path"), prefix))
    wanted = [t.strip() for t in chunk_types if t.strip()]
    return out.where(F.col("chunk_type").isin(*wanted)) if wanted else out


def top_k(vectors: DataFrame, query: Sequence[float], k: int, *, vector_col: str = "embedding", id_col: str = "chunk_id", digits: int = 9) -> DataFrame:
    """[VEC-6, SRT-1] The k nearest with distance and score, ties by id. A map and TakeOrderedAndProject: every task keeps k rows
    and the driver merges k rows a task; nothing is shuffled."""
    far = F.round(cosine_distance(F.col(vector_col), query), digits)
    ranked = vectors.where(valid_vector(F.col(vector_col), len(query))).withColumn("distance", far)
    return ranked.orderBy("distance", id_col).limit(k).withColumn("score", similarity(F.col("distance")))


def penalised(score: Column, chunk_type: Column, is_test: Column) -> Column:
    """[FN-7] Lowered for import and preamble chunks, and again in test files."""
    by_type = F.when(chunk_type == "imports", IMPORTS_PENALTY).when(chunk_type == "preamble", PREAMBLE_PENALTY).otherwise(1.0)
    return score * by_type * F.when(is_test, TEST_PENALTY).otherwise(1.0)


def count_vectors(vectors: DataFrame, **filters) -> int:
    """[AGG-1]"""
    return prefilter(vectors, **filters).count()


def knn_graph(vectors: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 9, block_rows: int = BLOCK_ROWS, queries: Column | None = None) -> DataFrame:
    """(src, dst, distance, rank): the k nearest other vectors of each one, ties by id.

    Vectors are dealt into blocks by a hash; each pair of (query block, block) is one matrix product in one task and gives at
    most k rows a query, which a window cuts to k over all blocks. ``queries`` (a condition) restricts the query side. Vectors
    that are null, empty or not finite are left out; all others have one length.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), (queries if queries is not None else F.lit(True)).alias("asks"))
    rows = rows.where("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    blocks = max(1, -(-rows.count() // block_rows))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    asking = rows.where("asks").select(block.alias("q"), F.explode(every).alias("b"), F.lit(True).alias("asks"), "id", "v")
    asked = rows.select(F.explode(every).alias("q"), block.alias("b"), F.lit(False).alias("asks"), "id", "v")
    pairs = asking.unionByName(asked).repartition(blocks * blocks, "q", "b").sortWithinPartitions("q", "b")
    near = pairs.mapInArrow(_nearest(k, digits), "src long, dst long, distance double")
    best = Window.partitionBy("src").orderBy("distance", "dst")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _nearest(k: int, digits: int):
    def solve(q: np.ndarray, q_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray) -> pa.RecordBatch:
        src, dst, far = [], [], []
        order = np.argsort(b_ids, kind="stable")
        b, b_ids = b[order], b_ids[order]
        for start in range(0, len(q), 512):
            part = np.round(1 - q[start : start + 512] @ b.T, digits)
            part[q_ids[start : start + 512, None] == b_ids[None]] = np.inf
            keep = np.argsort(part, axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(part, keep, axis=1)
            row, col = np.nonzero(np.isfinite(value))
            src.append(q_ids[start + row])
            dst.append(b_ids[keep[row, col]])
            far.append(value[row, col])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (src, dst, far)], ["src", "dst", "distance"])

    def unit(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        ids, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300), ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])  # those asked, those asking
        for batch in batches:
            if not batch.num_rows:
                continue
            q, b, ids = (batch.column(i).to_numpy() for i in (0, 1, 3))
            asks = batch.column(2).to_numpy(zero_copy_only=False)
            vectors = batch.column(4).flatten().to_numpy().reshape(batch.num_rows, -1)
            edges = np.flatnonzero((q[1:] != q[:-1]) | (b[1:] != b[:-1])) + 1
            for start, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if key != (q[start], b[start]):
                    if all(sides):
                        yield solve(*unit(sides[1]), *unit(sides[0]))
                    key, sides = (q[start], b[start]), ([], [])
                for asking in (False, True):
                    own = asks[start:end] == asking
                    if own.any():
                        sides[asking].append((ids[start:end][own], vectors[start:end][own]))
        if all(sides):
            yield solve(*unit(sides[1]), *unit(sides[0]))

    return run
