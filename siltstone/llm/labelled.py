"""Bounded samples of labelled rows for fitting classifiers, and fits that run in one task of an executor."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.names import col, cols
from siltstone.runtime import materialize, ship


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1, which is no fold, for null."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)).cast("int"), F.lit(-1))


def sample(docs: DataFrame, labels: DataFrame, label: str, *, folds: int, held_out: int, per_class: int, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = ()) -> tuple[DataFrame, dict[int, int]]:
    """(text, label and ``others``) of at most ``per_class`` training rows of each class 0 and 1, and the classes' counts in training.

    Rows of the held-out fold, with null ids or with labels other than 0 and 1 are not used, nor ids that are labelled both ways. An
    id counts once, however often it is labelled or stands in ``docs`` (there the row with the least text counts), so that the
    sample is bounded. Which ids are taken is decided by a hash of the id, so that the sample doesn't hang on the order or layout
    of the tables.
    """
    given = labels.select(col(id_col).alias("id"), col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)").where(fold(F.col("id"), folds) != held_out)
    training = given.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    counts = {r["label"]: r["count"] for r in training.groupBy("label").count().collect()}
    by_hash = F.xxhash64(F.lit(5), F.col("id"))
    chosen = reduce(DataFrame.unionByName, [training.where(F.col("label") == c).orderBy(by_hash, "id").limit(per_class) for c in (0, 1)])
    texts = docs.select(col(id_col).alias("id"), F.struct(col(text_col).alias("text"), *[col(o).alias(o) for o in others]).alias("row"))
    # 2 * per_class rows of some 20 bytes at most are broadcast.
    joined = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("row").alias("row"), F.first("label").alias("label"))
    return materialize(joined.select("row.*", "label"), "labelled-sample"), counts


def fit_in_task(rows: DataFrame, fit: Callable[[pa.Table], Any], columns: list[str]) -> Any:
    """What ``fit`` makes of the bounded rows, all of them in one task of an executor; only its result comes to the driver."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        made = fit(pa.Table.from_batches(held)) if held else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["made"])

    return pickle.loads(rows.select(*cols(columns)).repartition(1).mapInArrow(run, "made binary").first()[0])
