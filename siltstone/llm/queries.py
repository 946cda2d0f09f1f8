"""The registered queries of the subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, fingerprint, html_extract, labelled, mix, ngram_join, quality, secret_scan, shards, toxicity, url_filter
from siltstone.runtime import load, materialize


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(load(spark, sf_dir, "documents"), words=3, percent=90).drop("text_hash")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.host_rule(verdict, rule) for verdict, rule in url_filter.CONTRACT_RULES]
    judged = url_filter.judge_urls(load(spark, sf_dir, "pages").select("page_id", "url"), [*rules, *url_filter.DEFAULT_PATTERNS])
    return judged.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"), F.col("url_pattern").alias("pattern"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark")
    scanned = decontaminate.decontaminate(docs, benchmark, keep_text=False)
    items = F.array_join("items", ",")
    return scanned.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", mix.word_count(F.col("text")).alias("size"))
    planned = mix.plan_mix(materialize(docs, "mix-sizes"))  # words are counted once, not for each use of the sizes
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    findings = F.col("secret_findings")
    base = F.filter(findings, lambda f: f["kind"] != "generic")
    count = lambda field, value: F.size(F.filter(findings, lambda f: f[field] == value)).cast("long")
    return found.select(
        "doc_id",
        *[count("kind", k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_spans(base), 256).alias("base_sha256"),
        _spans(findings).alias("spans"),
        count("verdict", "live").alias("n_live"),
        count("verdict", "example").alias("n_example"),
    )


def _spans(findings):
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels")
    scored = toxicity.score_toxicity(docs, labels, keep_text=False)
    score = F.col("toxicity_score")
    return scored.select("doc_id", (labelled.fold(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD_OUT).alias("held_out"), score.alias("score"), (score >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), load(spark, sf_dir, "labels")
    scored = quality.score_quality(docs, labels, keep_text=False, metadata=("n_chars",))
    score = F.col("quality_score")
    return scored.select("doc_id", (labelled.fold(F.col("doc_id"), quality.FOLDS) == quality.HELD_OUT).alias("held_out"), score.alias("score"), (score >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_pages(pages, text_col="text").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shards.shard(load(spark, sf_dir, "documents").select("doc_id", "text"), n_shards=40)
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharded.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprint.fingerprint_pairs(load(spark, sf_dir, "documents").select("doc_id", "text"))
    sketches = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return made.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited_text"), 256).alias("edited_sha256"),
        fingerprint.to_text(sketches[0]).alias("fingerprint"),
        fingerprint.to_text(sketches[1]).alias("edited_fingerprint"),
        fingerprint.resemblance(sketches[0], sketches[1]).alias("near_edited"),
        fingerprint.resemblance(sketches[0], sketches[2]).alias("near_next"),
    )


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_join, op2_url_filter, op3_decontaminate, op4_mix, op5_secret_scan, op6_toxicity, op7_quality, op8_html_extract, op9_shard, op10_fingerprint)}
