"""Mixing sources to target weights by systematic sampling.

Each source gets a target of words. Its documents, in an order that puts like sizes side by side, are given equal expected
copies; the running sum of those, moved by one random offset per source, is a number line on which a document is emitted
once for each integer boundary that its own piece crosses.

The running sum of a source is not taken in one task: its documents are dealt into cells (size class and salt), each cell
numbers its own rows, and the cells' counts, a few thousand a source, are summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import names

WORD = r"[^\x20\x09-\x0D]+"
#: Salted parts of each size class of a source.
SALTS = 16


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, *, source: str = "source", size: str = "size", weights: tuple[float, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """One row per source: source_size, target.

    Sources by code point, null last, take ``weights`` in turn. They share the sum of all sizes in proportion, but none gets
    over ``max_repeat`` times its own size; what is over goes to the others by weight until no source is above. That fixed
    point is min(cap, level * weight) with one level for all; with the sources in order of cap / weight, the level is the
    largest of (rest of the sum) / (rest of the weights).
    """
    totals = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    alphabetical = Window.orderBy(F.col("source").asc_nulls_last())
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (((F.row_number().over(alphabetical) - 1) % len(weights)) + 1).cast("int"))
    w = totals.withColumn("weight", share).withColumn("cap", F.lit(max_repeat) * F.col("source_size"))
    w = w.withColumn("ratio", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    w = w.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(upto), F.lit(0)))
    w = w.withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    w = w.withColumn("level", F.max(F.col("rest") / F.col("rest_weight")).over(everything))
    return w.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _md5_number(*parts: Column) -> Column:
    """The first 32 bits of the MD5 of the parts as text (null is empty): 0 to 2**32 - 1."""
    return F.conv(F.substring(F.md5(F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 8), 16, 10).cast("long")


def plan_mix(sized: DataFrame, *, id_col: str = "doc_id", source: str = "source", size: str = "size", weights: tuple[float, ...] = (1, 2, 3), max_repeat: int = 3, seed: int = 7, salts: int = SALTS) -> DataFrame:
    """``sized`` with the columns source_size, target and copies (how often the mix takes the row; 0 to ``max_repeat``).

    Null sources are a source of their own, null sizes count as 0. Repeated rows and ties in the id are separate rows, in the
    order of size, id and id hash. Sizes of 0 may be taken, at no words. A source without words has target 0 and is not
    taken. An empty table gives an empty result. Other columns, whatever their names, pass through; the added names replace
    columns so called.
    """
    given = names.without(sized, "source_size", "target", "copies")
    own = F.coalesce(F.concat(F.lit("s"), names.col(source)), F.lit("")).alias("own")
    words = F.coalesce(names.col(size), F.lit(0)).cast("long").alias("words")
    salt = (_md5_number(F.lit(f"{seed}:"), names.col(id_col)) % salts).cast("int").alias("salt")
    rows = given.select(own, words, names.col(id_col).alias("id"), names.col(source).alias("source"), salt, F.struct(*names.cols(given.columns)).alias("row"))
    rows = rows.withColumn("class", F.floor(F.sqrt("words")).cast("int"))
    cell = ["own", "class", "salt"]
    targets = source_targets(rows, size="words", weights=weights, max_repeat=max_repeat)
    targets = targets.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("own"), "source_size", "target")
    earlier = Window.partitionBy("own").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    cells = cells.join(targets, "own")
    placed = rows.withColumn("at", F.row_number().over(Window.partitionBy(*cell).orderBy("words", "id"))).join(cells, cell)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = _md5_number(F.lit(f"{seed}:"), F.col("own")) / F.lit(float(1 << 32))
    end = F.col("before") + F.col("at")
    copies = F.floor(end * rate + offset) - F.floor((end - 1) * rate + offset)
    return placed.select(*[F.col("row").getField(c).alias(c) for c in given.columns], "source_size", "target", F.least(copies, F.lit(max_repeat)).cast("int").alias("copies"))


def emit_mix(planned: DataFrame) -> DataFrame:
    """Each row of ``plan_mix`` as often as its copies say, without the plan's columns."""
    kept = names.without(planned, "source_size", "target", "copies").columns
    taken = planned.where("copies > 0").select(F.struct(*names.cols(kept)).alias("row"), F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in kept])
