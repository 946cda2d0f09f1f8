"""A training-data pipeline of five stages, each one operator of ``siltstone.llm``.

quality -> near_duplicates -> decontaminate -> mix -> shard. Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate as clean
from siltstone.llm import mix, names, ngram_join, quality, shards
from siltstone.runtime import load, materialize, materialize_alone, release, small

#: Near duplicates: five-word shingles, a likeness of 80 percent.
WORDS, PERCENT = 5, 80
SHARDS = 40


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (a score of 0.7 or more)."""
    scored = quality.score_quality(docs, load(spark, sf_dir, "labels"), metadata=("n_chars",))
    return scored.where(F.col("quality_score") >= quality.THRESHOLD).select(*names.cols(docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id (and the least text hash, where an id has several
    texts in the group). Rows are told apart by id and text, so an id's other texts stay; of rows that repeat both one stays.
    Rows without an id stay."""
    grouped = materialize(ngram_join.jaccard_components(docs, words=WORDS, percent=PERCENT), "pipeline-groups").where("doc_id is not null")
    own = grouped.where("n_shingles > 0 and component_id = doc_id").groupBy("component_id").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most")).where("least <> most")
    losers = grouped.where("component_id <> doc_id").select("doc_id", "text_hash")
    second = grouped.where("n_shingles > 0 and component_id = doc_id").join(own, "component_id").where("text_hash <> least").select("doc_id", "text_hash")
    losers = materialize(losers.unionByName(second).distinct(), "pipeline-losers")
    repeated = materialize(grouped.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash"), "pipeline-repeated")
    (hashed,) = names.fresh(docs.columns, "text_hash")
    key, mark = ["doc_id", hashed], F.xxhash64("text").alias(hashed)
    out = docs.select("*", mark).join(small(losers.withColumnRenamed("text_hash", hashed)), key, "left_anti")
    if not repeated.isEmpty():
        repeated = small(repeated.withColumnRenamed("text_hash", hashed))
        once = out.join(repeated, key, "left_semi").dropDuplicates(key)
        out = out.join(repeated, key, "left_anti").unionByName(once)
    return out.select(*names.cols(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside an occurrence of a benchmark window."""
    scanned = clean.decontaminate(docs, load(spark, sf_dir, "benchmark"))
    return scanned.where("n_hit = 0").select(*names.cols(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    (words,) = names.fresh(docs.columns, "words")
    sized = docs.withColumn(words, mix.word_count(F.col("text")))
    return mix.emit_mix(mix.plan_mix(sized, size=words)).select(*names.cols(docs.columns))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot."""
    return shards.shard(docs, n_shards=SHARDS)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("shard", shard),
]

#: SQL can't express the trained classifier; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and read again as the next one's input; what a stage wrote for
    itself and what it read are removed then."""
    docs = load(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
        if number:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
