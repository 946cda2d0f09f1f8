"""Symbols of chunks and search results: interval joins, scores, top one. [JOIN-4, JOIN-5, WIN-2, WIN-3, FN-5, FN-6]"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import LANGUAGE_KEYWORDS, distinct_tokens, line_slice, token_overlap

NAME_WEIGHT, SIGNATURE_WEIGHT, BODY_WEIGHT, BODY_BONUS, START_BONUS, THRESHOLD = 3, 2, 2, 1, 0.25, 1
#: Symbol kinds by how well they stand for a chunk.
KIND_WEIGHT = {"function": 5, "method": 5, "class": 4, "interface": 3, "type": 2, "variable": 1}


def overlapping(chunks: DataFrame, symbols: DataFrame, *, keys: list[str]) -> DataFrame:
    """[JOIN-4, JOIN-5] chunk rows x symbols of the same ``keys`` whose line ranges meet. An equi-join with the range test as its
    residue; symbol columns are prefixed ``s_``."""
    named = symbols.select(*keys, *[F.col(c).alias(f"s_{c}") for c in symbols.columns if c not in keys])
    return chunks.join(named, keys).where("s_start_line <= end_line and s_end_line >= start_line")


def primary_symbols(chunks: DataFrame, symbols: DataFrame, *, keys: list[str], chunk_key: list[str]) -> DataFrame:
    """[WIN-3] The symbol that stands for each chunk: best kind; then one that starts inside, the earliest; else the tightest
    around it."""
    weight = F.lit(0)
    for kind, w in KIND_WEIGHT.items():
        weight = F.when(F.col("s_kind") == kind, w).otherwise(weight)
    inside = F.col("s_start_line") >= F.col("start_line")
    order = [F.desc("_weight"), F.desc("_inside"), F.when(inside, F.col("s_start_line")).otherwise(F.col("s_end_line") - F.col("s_start_line")), "s_name", "s_start_line"]
    ranked = overlapping(chunks, symbols, keys=keys).withColumn("_weight", weight).withColumn("_inside", inside.cast("int"))
    first = F.row_number().over(Window.partitionBy(*chunk_key).orderBy(*order))
    return ranked.withColumn("_place", first).where("_place = 1").drop("_place", "_weight", "_inside")


def symbol_score(query: Column, name: Column, signature: Column, body: Column, starts_inside: Column) -> Column:
    """[FN-5] Weighted token overlap of the query with name, signature and body. A null body counts nothing."""
    count = lambda text: token_overlap(query, F.coalesce(text, F.lit("")))
    in_body = count(body)
    return NAME_WEIGHT * count(name) + SIGNATURE_WEIGHT * count(signature) + BODY_WEIGHT * in_body + F.when(in_body > 0, BODY_BONUS).otherwise(0) + F.when(starts_inside, START_BONUS).otherwise(0.0)


def ranked_matches(queries: DataFrame, texts: DataFrame, k: int, *, query_id: str, text_id: str, text_col: str = "text") -> DataFrame:
    """[AGG-15, SET-4, FN-5] For each query text the ``k`` texts whose first line (as the name) and whole (as the body) it fits best:
    (query_id, text_id, score, place), ties to the lesser id. Both sides have an id and ``text_col``.

    An inverted join on tokens, never all pairs: a text's tokens and what each is worth are computed inside its row, and the
    queries' tokens are broadcast by the planner while they are small. Pairs without a common token have no row.
    """
    asked = queries.select(query_id, F.explode_outer(distinct_tokens(F.col(text_col))).alias("token")).where("token is not null")
    first = F.substring_index(text_col, "\n", 1)
    told = texts.select(text_id, distinct_tokens(first).alias("name"), distinct_tokens(F.col(text_col)).alias("tokens"))
    worth = lambda t: F.lit(BODY_WEIGHT) + F.when(F.array_contains("name", t), NAME_WEIGHT).otherwise(0)
    each = told.select(text_id, F.explode_outer(F.transform("tokens", lambda t: F.struct(t.alias("token"), worth(t).alias("worth")))).alias("t"))
    met = each.select(text_id, F.col("t.token").alias("token"), F.col("t.worth").alias("worth")).join(asked, "token")
    scored = met.groupBy(query_id, text_id).agg((F.sum("worth") + BODY_BONUS).alias("score"))
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), text_id))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def attribute(results: DataFrame, symbols: DataFrame, query_tokens: Column, *, result_key: list[str], content_col: str | None = None) -> DataFrame:
    """[WIN-2, FN-6, FLT-15] ``results`` with ``symbol``: the function or method in the result's lines that the query fits best,
    from a score of 1 on; else the chunk's stored primary symbol; never a word of the language."""
    made = overlapping(results, symbols.where(F.col("kind").isin("function", "method")), keys=["file_path"])
    body = line_slice(F.col(content_col), F.col("s_start_line"), F.col("s_end_line")) if content_col else F.lit(None).cast("string")
    scored = made.withColumn("_score", symbol_score(query_tokens, F.col("s_name"), F.col("s_signature"), body, F.col("s_start_line") >= F.col("start_line")))
    best = scored.groupBy(*result_key).agg(F.min(F.struct((-F.col("_score")).alias("low"), F.col("s_name").alias("name"))).alias("best"))
    out = results.join(best, result_key, "left")
    stored = F.when(F.col("primary_symbol") != "", F.col("primary_symbol"))
    chosen = F.when(-F.col("best.low") >= THRESHOLD, F.col("best.name")).otherwise(stored)
    return out.withColumn("symbol", F.when(~chosen.isin(*LANGUAGE_KEYWORDS), chosen)).drop("best")
