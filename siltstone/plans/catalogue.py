"""The registered queries: each operator applied to the driver's tables, with its twin in DuckDB SQL.

A query whose result SQL can't express has none and is tested in ``tests/``.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.functions import text
from siltstone.functions.embed import HashingProvider, embed
from siltstone.operators import architecture, attribute, chunk, graph, lookup, resolve, vector
from siltstone.operators.extract import entry_points
from siltstone.runtime import load, materialize, shared_dir
from siltstone.sources import git, ignore, store
from siltstone.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- shared pieces -----------------------------------------------------------------------------------------------------------

HEADER_LINE = "^[A-Z][a-z]+[.,]"
HREF = 'href="([^"]*)"'
NAME_QUERY, TEXT_QUERY = "an", "the rest of thereTion and reading_them"


def _page_paths(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, host, path): the URL's host, and the path without leading slash, query and fragment."""
    url = F.col("url")
    return load(spark, sf, "pages").select("page_id", F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract(url, "^[a-z]+://[^/?#]*/([^?#]*)", 1).alias("path"), "html")


_PATHS = """paths AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1) AS path, html FROM pages)"""


def _links(spark: SparkSession, sf: str) -> DataFrame:
    """(module, href), distinct: which links the pages of a host have."""
    pages = _page_paths(spark, sf)
    return pages.select(F.col("host").alias("module"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href")).distinct()


_LINKS = rf"""{_PATHS}, links AS (SELECT DISTINCT host AS module, unnest(regexp_extract_all(html, '{HREF}', 1)) AS href FROM paths)"""


def _stem_sql(t: str) -> str:
    return f"""CASE WHEN length({t}) > 5 AND {t} LIKE '%ing' THEN left({t}, length({t}) - 3) WHEN length({t}) > 4 AND {t} LIKE '%ied' THEN left({t}, length({t}) - 3) || 'y'
      WHEN length({t}) > 4 AND {t} LIKE '%ed' THEN left({t}, length({t}) - 2) WHEN length({t}) > 4 AND {t} LIKE '%es' THEN left({t}, length({t}) - 2)
      WHEN length({t}) > 3 AND {t} LIKE '%s' THEN left({t}, length({t}) - 1) ELSE {t} END"""


def _tokens_sql(x: str) -> str:
    stops = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
    spaced = rf"lower(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_-]+', ' ', 'g'))"
    return f"list_filter(list_transform(string_split_regex({spaced}, '[^a-z0-9]+'), lambda t: {_stem_sql('t')}), lambda w: w <> '' AND w NOT IN ({stops}))"


_Q0 = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_FAR = "round(list_cosine_distance(e.embedding::DOUBLE[], q.q), 9)"
_SCORE = "greatest(0.0, 1 - distance / 2)"


def _query_vector(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    return list(load(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


# --- vectors -------------------------------------------------------------------------------------------------------------------


@query(f"WITH {_Q0}, d AS (SELECT vec_id, {_FAR} AS distance FROM embeddings e, q) SELECT vec_id, distance, round({_SCORE}, 9) AS score FROM d ORDER BY distance, vec_id LIMIT 10")
def vec_topk(spark: SparkSession, sf: str) -> DataFrame:
    """VEC-6, SRT-1, PRJ-2, FN-18"""
    found = vector.top_k(load(spark, sf, "embeddings"), _query_vector(spark, sf), 10, id_col="vec_id")
    return found.select("vec_id", "distance", F.round("score", 9).alias("score"))


@query(f"WITH {_Q0} SELECT vec_id, label, {_FAR} AS distance FROM embeddings e, q WHERE label IN (1, 2, 3) ORDER BY distance, vec_id LIMIT 10")
def vec_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """A filter before the top k; ``vec_prefiltered`` has the library's."""
    rows = load(spark, sf, "embeddings").where(F.col("label").isin(1, 2, 3))
    return vector.top_k(rows, _query_vector(spark, sf), 10, id_col="vec_id").select("vec_id", "label", "distance")


@query(f"WITH {_Q0}, t AS (SELECT vec_id, label, {_FAR} AS distance FROM embeddings e, q ORDER BY distance, vec_id LIMIT 20) SELECT * FROM t WHERE label > 4")
def vec_topk_postfilter(spark: SparkSession, sf: str) -> DataFrame:
    """A filter after the top k, so fewer rows come back; ``search_pipeline`` has the library's."""
    return vector.top_k(load(spark, sf, "embeddings"), _query_vector(spark, sf), 20, id_col="vec_id").where("label > 4").select("vec_id", "label", "distance")


@query(f"""WITH {_Q0}, t AS (SELECT vec_id, label, {_FAR} AS distance FROM embeddings e, q ORDER BY distance, vec_id LIMIT 50),
s AS (SELECT vec_id, round({_SCORE} * CASE WHEN label = 0 THEN 0.5 WHEN label = 1 THEN 0.7 ELSE 1.0 END * CASE WHEN vec_id % 5 = 0 THEN 0.75 ELSE 1.0 END, 9) AS score FROM t)
SELECT vec_id, score FROM s WHERE score >= 0.35""")
def vec_penalised_rank(spark: SparkSession, sf: str) -> DataFrame:
    """FN-7, FLT-11, SRT-2"""
    kind = F.when(F.col("label") == 0, "imports").when(F.col("label") == 1, "preamble").otherwise("impl")
    path = F.concat(F.lit("src/v"), F.col("vec_id").cast("string"), F.when(F.col("vec_id") % 5 == 0, ".test.ts").otherwise(".ts"))
    found = vector.top_k(load(spark, sf, "embeddings"), _query_vector(spark, sf), 50, id_col="vec_id")
    score = F.round(vector.penalised(F.col("score"), kind, text.is_test_file(path)), 9)
    return found.select("vec_id", score.alias("score")).where("score >= 0.35").orderBy(F.desc("score"), "vec_id")


@query("""SELECT len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true) AS valid, count(*) AS n FROM embeddings GROUP BY 1""")
def vec_validate(spark: SparkSession, sf: str) -> DataFrame:
    """VEC-5"""
    return load(spark, sf, "embeddings").groupBy(vector.valid_vector(F.col("embedding"), 64).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def vec_count_by_label(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of each label"""
    return load(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_KNN = """knn AS MATERIALIZED (SELECT src, dst, distance, rank FROM (
  SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 3)"""


def _knn(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(vector.knn_graph(load(spark, sf, "embeddings"), 3).select("src", "dst"), "knn")


@query(f"WITH {_KNN} SELECT src, dst, distance, rank FROM knn")
def knn_graph(spark: SparkSession, sf: str) -> DataFrame:
    """VEC-6 of every vector, by blocked matrix products"""
    return vector.knn_graph(load(spark, sf, "embeddings"), 3).select("src", "dst", "distance", "rank")


@query(f"WITH {_KNN} SELECT DISTINCT least(a.src, a.dst) AS low, greatest(a.src, a.dst) AS high FROM knn a JOIN knn b ON a.src = b.dst AND a.dst = b.src")
def mutual_edges(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-3, JOIN-15"""
    return graph.mutual_edges(vector.knn_graph(load(spark, sf, "embeddings"), 3))


def _bfs_sql(start: str, src: str, dst: str, leak: bool) -> str:
    leaked = f" UNION SELECT k.{dst} FROM knn k JOIN seed a ON a.node = k.{src} JOIN seed b ON b.node = k.{dst} WHERE k.{src} < k.{dst}" if leak else ""
    return f"""WITH RECURSIVE {_KNN}, seed AS ({start}), walk(node, depth) AS (SELECT node, 0 FROM seed UNION SELECT k.{dst}, w.depth + 1 FROM walk w JOIN knn k ON k.{src} = w.node WHERE w.depth < 3)
SELECT node FROM (SELECT node, min(depth) AS depth FROM walk GROUP BY node) WHERE depth > 0{leaked}"""


def _seeds(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("node"))


@query(_bfs_sql("SELECT 0::BIGINT AS node", "src", "dst", False))
def bfs_callees(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-1, JOIN-9"""
    return graph.reachable(_knn(spark, sf), _seeds(spark, 1), 3)


@query(_bfs_sql("SELECT 0::BIGINT AS node", "dst", "src", False))
def bfs_callers(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-1 against the edges"""
    return graph.reachable(graph.reverse(_knn(spark, sf)), _seeds(spark, 1), 3)


@query(_bfs_sql("SELECT range AS node FROM range(40)", "src", "dst", True))
def bfs_multi_seed(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-1 with several seeds, and the rule for neighbouring ones"""
    return graph.reachable(_knn(spark, sf), _seeds(spark, 40), 3)


# --- modules and links --------------------------------------------------------------------------------------------------------------


@query(f"WITH {_LINKS} SELECT module, string_agg(href, ',' ORDER BY href) AS targets FROM links GROUP BY module")
def module_graph(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-2, AGG-5"""
    return _links(spark, sf).groupBy("module").agg(F.array_join(F.array_sort(F.collect_set("href")), ",").alias("targets"))


@query(f"WITH {_LINKS} SELECT href, count(DISTINCT module) AS modules FROM links GROUP BY href")
def link_usage(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-7"""
    return _links(spark, sf).groupBy("href").agg(F.countDistinct("module").alias("modules"))


@query(f"WITH {_LINKS} SELECT module, count(*) AS links FROM links GROUP BY module")
def links_per_module(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-5, AGG-8"""
    return _links(spark, sf).groupBy("module").agg(F.count(F.lit(1)).alias("links"))


def _link_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """Links as a dependency table: a page's folder and file, and a bucket told from the link's length."""
    pages = _page_paths(spark, sf)
    links = pages.select(F.concat_ws("/", "host", "path").alias("from_path"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("to_specifier"))
    n = F.length("to_specifier")
    kind = F.when(n % 4 == 0, "internal").when(n % 4 == 1, "external").when(n % 4 == 2, "builtin").otherwise("odd")
    return links.withColumn("dependency_type", kind).withColumn("to_path", F.when(kind == "internal", F.concat(F.lit("www"), F.col("to_specifier"), F.lit("/x.ts"))))


_DEPENDENCIES = rf"""{_PATHS}, dep AS (SELECT from_path, spec, CASE length(spec) % 4 WHEN 0 THEN 'internal' WHEN 1 THEN 'external' WHEN 2 THEN 'builtin' ELSE 'odd' END AS kind FROM (SELECT host || '/' || path AS from_path, unnest(regexp_extract_all(html, '{HREF}', 1)) AS spec FROM paths)),
edge AS (SELECT DISTINCT CASE WHEN kind = 'odd' THEN 'unresolved' ELSE kind END AS bucket, CASE WHEN strpos(from_path, '/') = 0 THEN 'root' ELSE array_to_string(string_split(from_path, '/')[1:2], '/') END AS from_module,
  CASE WHEN kind = 'internal' THEN array_to_string(string_split('www' || spec || '/x.ts', '/')[1:2], '/') ELSE spec END AS target FROM dep)"""


@query(f"WITH {_DEPENDENCIES} SELECT bucket, target, count(DISTINCT from_module) AS modules FROM edge WHERE NOT (bucket = 'internal' AND from_module = target) GROUP BY bucket, target")
def dep_summary(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-2, AGG-6, PRJ-6"""
    return graph.target_usage(graph.contract(_link_dependencies(spark, sf)))


@query(f"WITH {_DEPENDENCIES} SELECT bucket, from_module, string_agg(target, ',' ORDER BY target) AS targets FROM edge WHERE NOT (bucket = 'internal' AND from_module = target) GROUP BY bucket, from_module")
def dependency_map(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-5"""
    return graph.targets_of(graph.contract(_link_dependencies(spark, sf))).withColumn("targets", F.array_join("targets", ","))


@query(f"WITH {_LINKS} SELECT href, string_agg(DISTINCT module, ',' ORDER BY module) AS dependents FROM links GROUP BY href")
def dependents_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The files that need each target, for every link; ``explain_symbols`` has the library's callers"""
    return _links(spark, sf).groupBy("href").agg(F.array_join(F.array_sort(F.collect_set("module")), ",").alias("dependents"))


# --- text functions -----------------------------------------------------------------------------------------------------------------

_HASH = r"sha256(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(65279), ''), '\s+$', ''))"


@query(f"SELECT doc_id, {_HASH} AS sha256 FROM documents")
def hash_text(spark: SparkSession, sf: str) -> DataFrame:
    """FN-1"""
    return load(spark, sf, "documents").select("doc_id", text.hash_text(F.col("text")).alias("sha256"))


@query(f"SELECT {_HASH} AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark: SparkSession, sf: str) -> DataFrame:
    """FN-1"""
    hashed = load(spark, sf, "documents").select("doc_id", text.hash_text(F.col("text")).alias("sha256"))
    return hashed.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query(r"SELECT doc_id, CAST(ceil(length(regexp_replace(text, '^\s+|\s+$', '', 'g')) / 4.0) AS INTEGER) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """FN-2"""
    return load(spark, sf, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT token, count(*) AS docs FROM (SELECT unnest(list_distinct({_tokens_sql('text')})) AS token FROM documents) GROUP BY token HAVING count(*) > 1")
def term_df(spark: SparkSession, sf: str) -> DataFrame:
    """FN-3, FN-4"""
    # The outer form: for the inner one Spark infers a filter on the array's size, which would compute the tokens again.
    words = load(spark, sf, "documents").select(F.explode_outer(text.distinct_tokens(F.col("text"))).alias("token")).where("token is not null")
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")


@query(f"""WITH i AS (SELECT DISTINCT item_id, unnest({_tokens_sql('text')}) AS token FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct({_tokens_sql('text')})) AS token, text FROM documents),
h AS (SELECT doc_id, token, list_contains({_tokens_sql("string_split(text, chr(10))[1]")}, token) AS head FROM d),
s AS (SELECT item_id, doc_id, CAST(sum(2 + CASE WHEN head THEN 3 ELSE 0 END) + 1 AS BIGINT) AS score FROM i JOIN h USING (token) GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s) SELECT item_id, doc_id, score, place FROM r WHERE place <= 3""")
def token_overlap_rank(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-15, FN-5, SET-4"""
    return attribute.ranked_matches(load(spark, sf, "benchmark"), load(spark, sf, "documents"), 3, query_id="item_id", text_id="doc_id")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, line, text): the documents' lines, counted from 1."""
    rows = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line_text"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("line"), "line_text")


_LINES = "lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line, unnest(string_split(text, chr(10))) AS line_text FROM documents)"


def _overlap_sql(x: str) -> str:
    return f"len(list_intersect(list_distinct({_tokens_sql(x)}), {_tokens_sql(repr(TEXT_QUERY))}))"


@query(f"""WITH {_LINES}, s AS (SELECT doc_id, line, 3 * {_overlap_sql("string_split(line_text, ' ')[1]")} + 2 * {_overlap_sql("line_text")} AS score FROM lines),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line) AS place FROM s) SELECT doc_id, line, CAST(score AS DOUBLE) AS score FROM r WHERE place = 1 AND score >= 1""")
def best_symbol(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-2, FN-5, FN-6: a line is a symbol, its first word the name"""
    name = F.element_at(F.split("line_text", " "), 1)
    score = attribute.symbol_score(text.name_tokens(F.lit(TEXT_QUERY)), name, F.col("line_text"), F.lit(None).cast("string"), F.lit(False))
    scored = _lines(spark, sf).select("doc_id", "line", score.alias("score"))
    best = scored.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("low"), "line")).alias("b"))
    return best.select("doc_id", "b.line", (-F.col("b.low")).cast("double").alias("score")).where(F.col("score") >= attribute.THRESHOLD)


# --- chunks ---------------------------------------------------------------------------------------------------------------------------


def _windows_sql(size: int, overlap: int) -> str:
    """(doc_id, n, start_line, end_line, lines)"""
    step = size - overlap
    return f"""win AS (SELECT doc_id, n, lines, 1 + i * {step} AS start_line, least(n, i * {step} + {size}) AS end_line FROM (
  SELECT doc_id, len(string_split(text, chr(10))) AS n, string_split(text, chr(10)) AS lines, unnest(range(0, CAST(greatest(ceil((len(string_split(text, chr(10))) - {size}) / {step}.0), 0) AS BIGINT) + 1)) AS i FROM documents))"""


@query(f"WITH {_windows_sql(20, 5)} SELECT doc_id, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, length(array_to_string(lines[start_line:end_line], chr(10))) AS chars FROM win")
def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    """CHK-1, CHK-3 windows"""
    made = chunk.line_windows(load(spark, sf, "documents").select("doc_id", "text"), size=20, overlap=5)
    return made.select("doc_id", "start_line", "end_line", F.length("content").cast("long").alias("chars"))


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(f"""WITH {_windows_sql(9, 2)}, c AS (SELECT doc_id, n, start_line, end_line, {_TRIM.format("array_to_string(lines[start_line:end_line], chr(10))")} AS content FROM win WHERE n > 12),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) AS place FROM c WHERE content <> '')
SELECT doc_id, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, CASE WHEN place = 1 THEN 'module_section' ELSE 'impl' END AS chunk_type, length(content) AS chars FROM k
UNION ALL SELECT doc_id, 1, CAST(len(string_split(text, chr(10))) AS INTEGER), 'full_file', length({_TRIM.format("text")}) FROM documents WHERE len(string_split(text, chr(10))) <= 12 AND {_TRIM.format("text")} <> ''""")
def chunk_adaptive(spark: SparkSession, sf: str) -> DataFrame:
    """CHK-1 with small sizes, as the tables have short texts"""
    made = chunk.adaptive_chunks(F.col("text"), F.col("lang"), whole=12, window=9, overlap=2)
    return load(spark, sf, "documents").select("doc_id", F.inline(made)).select("doc_id", "start_line", "end_line", "chunk_type", F.length("content").cast("long").alias("chars"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS part FROM documents")
def line_slice(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-4"""
    return load(spark, sf, "documents").select("doc_id", text.line_slice(F.col("text"), F.lit(2), F.lit(4)).alias("part"))


@query(f"WITH {_LINES}, h AS (SELECT doc_id, line, line_text, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS nxt FROM lines WHERE regexp_matches(line_text, '{HEADER_LINE}')), n AS (SELECT doc_id, max(line) AS n FROM lines GROUP BY doc_id) SELECT doc_id, line AS start_line, CAST(CASE WHEN nxt IS NULL THEN n ELSE greatest(line, nxt - 1) END AS INTEGER) AS end_line, line_text AS header FROM h JOIN n USING (doc_id)")
def def_chunks_lead(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-6, CHK-5"""
    return chunk.definition_chunks(load(spark, sf, "documents"), HEADER_LINE)


@query(f"WITH lines AS (SELECT page_id, generate_subscripts(string_split(html, '>'), 1)::INTEGER AS line, unnest(string_split(html, '>')) AS line_text FROM pages) SELECT page_id, min(line) AS first_line, max(line) AS last_line FROM lines WHERE contains(line_text, 'href=') GROUP BY page_id")
def import_block_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds inside the row, on the array of tags"""
    hits = F.filter(F.transform(F.split("html", ">"), lambda s, i: F.when(s.contains("href="), i + 1)), lambda i: i.isNotNull())
    rows = load(spark, sf, "pages").select("page_id", hits.alias("hits")).where("size(hits) > 0")
    return rows.select("page_id", F.array_min("hits").alias("first_line"), F.array_max("hits").alias("last_line"))


def _windows_and_symbols(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    chunks = chunk.line_windows(load(spark, sf, "documents").select("doc_id", "text"), size=20, overlap=5).select("doc_id", "start_line", "end_line")
    n = F.length("line_text")
    kind = F.when(n > 400, "function").when(n > 200, "class").when(n > 80, "interface").otherwise("type")
    rows = _lines(spark, sf).where(F.col("line_text").rlike(HEADER_LINE))
    return chunks, rows.select("doc_id", F.concat(F.lit("L"), F.col("line")).alias("name"), kind.alias("kind"), F.col("line").alias("start_line"), (F.col("line") + 2).alias("end_line"))


_SYMBOLS = f"""{_LINES}, {_windows_sql(20, 5)}, sym AS (SELECT doc_id, 'L' || line AS name, CASE WHEN length(line_text) > 400 THEN 'function' WHEN length(line_text) > 200 THEN 'class' WHEN length(line_text) > 80 THEN 'interface' ELSE 'type' END AS kind, line AS s, line + 2 AS e FROM lines WHERE regexp_matches(line_text, '{HEADER_LINE}'))"""


@query(f"WITH {_SYMBOLS} SELECT doc_id, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, name FROM win JOIN sym USING (doc_id) WHERE s <= end_line AND e >= start_line")
def overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-4, JOIN-5"""
    chunks, symbols = _windows_and_symbols(spark, sf)
    return attribute.overlapping(chunks, symbols, keys=["doc_id"]).select("doc_id", "start_line", "end_line", F.col("s_name").alias("name"))


@query(f"""WITH {_SYMBOLS}, o AS (SELECT doc_id, start_line, end_line, name, kind, row_number() OVER (PARTITION BY doc_id, start_line, end_line ORDER BY CASE kind WHEN 'function' THEN 5 WHEN 'class' THEN 4 WHEN 'interface' THEN 3 ELSE 2 END DESC, s >= start_line DESC, CASE WHEN s >= start_line THEN s ELSE e - s END, name) AS place FROM win JOIN sym USING (doc_id) WHERE s <= end_line AND e >= start_line)
SELECT doc_id, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, name, kind FROM o WHERE place = 1""")
def primary_symbol(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-3"""
    chunks, symbols = _windows_and_symbols(spark, sf)
    made = attribute.primary_symbols(chunks, symbols, keys=["doc_id"], chunk_key=["doc_id", "start_line", "end_line"])
    return made.select("doc_id", "start_line", "end_line", F.col("s_name").alias("name"), F.col("s_kind").alias("kind"))


@query(rf"""WITH t AS (SELECT doc_id, {_TRIM.format("text")} AS t FROM documents), l AS (SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: {_TRIM.format("x")}), lambda x: x <> '') AS lines FROM t)
SELECT doc_id, CASE WHEN t = '' THEN 'full_file' WHEN len(list_filter(lines, lambda x: regexp_matches(x, '{text.IMPORT_LINE}'))) / len(lines) >= 0.8 THEN 'imports' WHEN regexp_matches(t, '{text.TYPE_WORD}') THEN 'types' ELSE 'impl' END AS chunk_type FROM l""")
def chunk_type_inference(spark: SparkSession, sf: str) -> DataFrame:
    """FN-10"""
    none = F.lit(None).cast("string")
    return load(spark, sf, "documents").select("doc_id", text.chunk_type(none, F.col("text"), none).alias("chunk_type"))


# --- counts, versions, logs -----------------------------------------------------------------------------------------------------------


@query("SELECT coalesce(nullif(lang, ''), 'unknown') AS language, count(*) AS files FROM documents GROUP BY 1")
def lang_stats(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-2"""
    return lookup.language_counts(load(spark, sf, "documents"), "lang")


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def kind_counts_desc(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-3"""
    return lookup.kind_counts(load(spark, sf, "events"), "event_type")


@query(" UNION ALL ".join(f"SELECT '{t}' AS what, count(*) AS n FROM {t}" for t in ("documents", "labels", "embeddings", "pages")))
def status_summary(spark: SparkSession, sf: str) -> DataFrame:
    """index --status"""
    return lookup.status({t: load(spark, sf, t) for t in ("documents", "labels", "embeddings", "pages")})


@query("SELECT user_id, round(sum(value), 6) AS churn FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY user_id")
def churn_recent(spark: SparkSession, sf: str) -> DataFrame:
    """The last week's sum for each key; ``churn_from_log`` and ``rolling_churn_windows`` run the library's"""
    events = load(spark, sf, "events")
    newest = events.agg(F.max("ts").alias("newest"))
    recent = events.join(F.broadcast(newest), F.col("ts") >= F.col("newest") - F.expr("interval 7 days"))
    return recent.groupBy("user_id").agg(F.round(F.sum("value"), 6).alias("churn"))


@query("SELECT c_custkey, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def churn_left_join(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-13"""
    counts = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.count(F.lit(1)).alias("churn"))
    return git.with_churn(load(spark, sf, "customer").select("c_custkey"), counts, key="c_custkey").withColumnRenamed("churn", "orders")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place = 1")
def latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-1: every task keeps one row a key before the shuffle (a group limit of the window)"""
    return git.latest(load(spark, sf, "events"), keys=["user_id"], order=[F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus AS v FROM orders WHERE o_orderkey % 10 <> 3), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 10 <> 4)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.v <> b.v""")
def diff_added_modified_deleted(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-6, SET-1, SET-2, JOIN-14: two versions of a table"""
    orders = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    old = orders.where("o_orderkey % 10 <> 3")
    new = orders.where("o_orderkey % 10 <> 4").withColumn("v", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("v")))
    return git.compare_versions(old, new, key="o_orderkey", value="v")


_STATE = "CASE event_type WHEN 'click' THEN 'added' WHEN 'view' THEN 'modified' WHEN 'purchase' THEN 'deleted' ELSE CASE event_id % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'deleted' END END"


@query(f"""WITH s AS (SELECT user_id, event_id, {_STATE} AS state FROM events), m AS (SELECT user_id, arg_max(state, event_id) AS last, arg_max(state, event_id) FILTER (WHERE state <> 'modified') AS before FROM s GROUP BY user_id)
SELECT user_id, CASE WHEN last = 'modified' AND before = 'added' THEN 'added' ELSE last END AS state FROM m""")
def diff_merge(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-14, SET-5"""
    log = load(spark, sf, "events").select("user_id", "event_id", F.expr(_STATE).alias("state"))
    return git.merge_log(log, key="user_id", state="state", order="event_id")


@query("SELECT doc_id, 'next' AS snapshot_id FROM documents WHERE doc_id % 9 <> 4")
def copy_forward(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-4, SNK-6, SET-1"""
    docs = load(spark, sf, "documents").select("doc_id", F.lit("first").alias("snapshot_id"))
    gone = docs.where("doc_id % 9 = 4").select(F.col("doc_id").alias("path"))
    return store.copy_forward(docs, "next", gone, "doc_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def upsert_latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-1"""
    orders = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return store.upsert(orders, orders.where("o_orderkey % 5 = 0").withColumn("status", F.lit("new")), ["o_orderkey"])


@query("SELECT event_id, CASE WHEN event_type = 'click' AND epoch_ms(ts) < 1705000000000 - 1800000 THEN 'failed' ELSE CASE WHEN event_type = 'click' THEN 'indexing' ELSE 'completed' END END AS status FROM events")
def stale_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-10"""
    rows = load(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "click", "indexing").otherwise("completed").alias("status"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"), F.lit(None).cast("string").alias("failure_reason"))
    return store.mark_stale(rows, 1705000000000).select("event_id", "status")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) SELECT user_id, event_id FROM r WHERE place <= 2""")
def prune_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The two newest versions of each key; ``kept_snapshots`` has the library's clean-up"""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return load(spark, sf, "events").withColumn("place", place).where("place <= 2").select("user_id", "event_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_of_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A page of a sorted list; ``page_of_snapshots`` has the library's"""
    return load(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(50).limit(25).select("o_orderkey", "o_orderstatus")


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS churn, 0.0::DOUBLE AS complexity FROM events")
def json_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-1, PRJ-3"""
    got = schemas.read_metrics(F.regexp_replace("props", '"k"', '"churn"'))
    return load(spark, sf, "events").select("event_id", got["churn"].alias("churn"), got["complexity"].alias("complexity"))


@query("SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY conv_id, role")
def conversation_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-13"""
    return graph.first_seen(load(spark, sf, "conversations"), keys=["conv_id", "role"], at="turn").select("conv_id", "role", F.col("first_seen").alias("first_turn"))


# --- names and paths -------------------------------------------------------------------------------------------------------------------


@query(f"""WITH r AS (SELECT p_brand, p_name, p_partkey, CASE WHEN p_name = '{NAME_QUERY}' THEN 0 WHEN lower(p_name) = '{NAME_QUERY}' THEN 1 WHEN starts_with(lower(p_name), '{NAME_QUERY}') THEN 2 ELSE 3 END AS name_rank FROM part WHERE contains(lower(p_name), '{NAME_QUERY}')),
b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY name_rank, p_name, p_partkey) AS place FROM r) SELECT p_brand, p_name, p_partkey, name_rank FROM b WHERE place = 1""")
def name_search_rank(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-4, FLT-5, WIN-4"""
    rows = load(spark, sf, "part").where(text.contains_name(F.col("p_name"), NAME_QUERY)).withColumn("name_rank", text.name_rank(F.col("p_name"), NAME_QUERY))
    best = rows.groupBy("p_brand").agg(F.min(F.struct("name_rank", "p_name", "p_partkey")).alias("b"))
    return best.select("p_brand", "b.p_name", "b.p_partkey", "b.name_rank")


@query("""WITH r AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 500 = 0 THEN 0 ELSE 3 END AS name_rank FROM part), g AS (SELECT min(name_rank) AS least FROM r)
SELECT p_partkey, name_rank FROM (SELECT r.*, least, row_number() OVER (ORDER BY name_rank, p_partkey) AS place FROM r, g) WHERE (least = 0 AND name_rank = 0) OR (least > 0 AND place <= 5)""")
def exact_match_gate(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-5: all exact matches, else the first five"""
    n = F.col("p_partkey")
    rows = load(spark, sf, "part").select(F.lpad(n.cast("string"), 12, "0").alias("file_path"), n.alias("p_partkey"), F.when(n % 500 == 0, "Target").otherwise("aTarget").alias("name"), F.lit("class").alias("kind"), F.lit(1).alias("start_line"))
    return lookup.find_symbols(rows, "Target").select("p_partkey", "name_rank")


@query(r"SELECT p_partkey, string_split(regexp_replace('part' || upper(p_name[1]) || p_name[2:], '([a-z])([A-Z])', '\1 \2', 'g'), ' ')[1] AS head FROM part")
def camel_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """FN-8"""
    name = F.concat(F.lit("part"), F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"))
    return load(spark, sf, "part").select("p_partkey", text.camel_head(name).alias("head"))


@query(f"WITH {_PATHS} SELECT page_id, path = 'en' OR starts_with(path, 'en/') AS under_it, starts_with(path, 'en/1') AS has_it FROM paths")
def prefix_boundary(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-1, FLT-2, FLT-3"""
    path = F.col("path")
    return _page_paths(spark, sf).select("page_id", text.under_prefix(path, "en/").alias("under_it"), text.has_prefix(path, "en/1").alias("has_it"))


@query(rf"WITH {_PATHS} SELECT page_id FROM paths WHERE NOT regexp_matches(path, '^fr/[^/]*$') AND NOT regexp_matches(path, '^.*/1.*[.]html$')")
def glob_exclude(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-8, FLT-9, GRF-4"""
    return _page_paths(spark, sf).where(~text.matches_globs(F.col("path"), ["fr/*", "**/1**.html"])).select("page_id")


_TEST_PATHS = ["src/a.ts", "src/a.test.ts", "src/__tests__/a.ts", "tests/a.py", "pkg/test_a.py", "pkg/a_test.py", "spec/a.rb", "lib/a_spec.rb", "Game/PlayerTests.cs", "Game/Contest.cs", "x/fixtures/a.gd", "player.test.gd", "a.spec.jsx", "src/latest/a.ts"]


@query(
    f"WITH {_PATHS} SELECT path, "
    + " OR ".join([f"regexp_matches(path, '{text.TEST_FOLDERS}')", *[f"(ends_with(path, '{e}') AND regexp_matches(path, '{p}'))" for e, p in text.TEST_NAMES.items()]])
    + f" AS is_test_file, regexp_matches(lower(path), '{text.TEST_PATH}') AS is_test_path FROM (VALUES "
    + ", ".join(f"('{p}')" for p in _TEST_PATHS)
    + " UNION ALL SELECT DISTINCT host || '/test/' || path FROM paths WHERE page_id % 2 = 0 UNION ALL SELECT DISTINCT host || '/' || path FROM paths WHERE page_id % 2 = 1) v(path)"
)
def test_path_flags(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-6, FLT-7: names of each rule, and all pages' paths, every second one under a test folder"""
    path, even = F.col("path"), F.col("page_id") % 2 == 0
    pages = _page_paths(spark, sf).select(F.concat("host", F.when(even, "/test/").otherwise("/"), "path").alias("path"), even.alias("even")).distinct().select("path")
    rows = spark.createDataFrame([(p,) for p in _TEST_PATHS], "path string").unionByName(pages)
    return rows.select("path", text.is_test_file(path).alias("is_test_file"), text.is_test_path(path).alias("is_test_path"))


@query(rf"WITH {_PATHS} SELECT page_id, list_contains(string_split(path, '/'), 'de') OR len(list_filter(string_split(path, '/'), lambda s: regexp_matches(s, '^.*[.]html$'))) > 0 AS ignored FROM paths")
def ignore_filter(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-3"""
    rules = ignore.read_patterns("# comment\n\nde/\n!fr\n*.html\n")
    return _page_paths(spark, sf).select("page_id", ignore.is_ignored(F.col("path"), rules).alias("ignored"))


@query("""WITH f AS (SELECT DISTINCT 'lib/' || regexp_extract(p_name, '^[a-z A-Z]*', 0) || CASE p_size % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '/index.ts' END AS path FROM part),
i AS (SELECT p_partkey, 'lib/' || regexp_extract(p_name, '^[a-z A-Z]*', 0) AS base FROM part),
c AS (SELECT p_partkey, base || e AS path, r FROM i, (VALUES ('', 0), ('.ts', 2), ('.tsx', 3), ('.mts', 4), ('.cts', 5), ('/index.ts', 6), ('/index.tsx', 7)) v(e, r))
SELECT p_partkey, arg_min(path, r) AS to_path, 'internal' AS dependency_type FROM c JOIN f USING (path) GROUP BY p_partkey""")
def candidate_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-10, RES-TS"""
    name = F.regexp_extract("p_name", "^[a-z A-Z]*", 0)
    part = load(spark, sf, "part")
    ending = F.when(F.col("p_size") % 3 == 0, ".ts").when(F.col("p_size") % 3 == 1, ".tsx").otherwise("/index.ts")
    files = part.select(F.concat(F.lit("lib/"), name, ending).alias("path")).distinct()
    imports = part.select("p_partkey", F.concat(F.lit("./"), name).alias("to_specifier"), F.lit("lib/main.ts").alias("from_path"))
    return resolve.resolve(imports, files).select("p_partkey", "to_path", "dependency_type")


_SPECIFIERS = [("node:fs", "a.ts"), ("path", "a.ts"), ("react", "a.ts"), ("fs/promises", "a.tsx"), ("os.path", "a.py"), ("numpy", "a.py"), ("System.IO", "a.cs"), ("UnityEngine.UI", "a.cs"), ("json", "a.rb"), ("rails", "a.rb"), ("Node2D", "a.gd"), ("./gone", "a.ts")]


@query(
    "SELECT spec AS to_specifier, path AS from_path, CASE WHEN starts_with(spec, '.') THEN 'internal' WHEN starts_with(spec, 'node:') OR (path LIKE 'a.ts%' AND string_split(spec, '/')[1] IN ('fs', 'path')) OR (path = 'a.py' AND string_split(spec, '.')[1] = 'os') OR (path = 'a.rb' AND spec = 'json') THEN 'builtin' ELSE 'external' END AS dependency_type FROM (VALUES "
    + ", ".join(f"('{s}', '{p}')" for s, p in _SPECIFIERS)
    + f" UNION ALL (WITH {_LINKS} SELECT DISTINCT href, 'a.ts' FROM links)) v(spec, path)"
)
def builtin_external_split(spark: SparkSession, sf: str) -> DataFrame:
    """RES-TS, RES-PY, RES-CS, RES-GD, RES-RB: specifiers of each rule, and all links of the pages as specifiers of one file"""
    links = _links(spark, sf).select(F.col("href").alias("to_specifier"), F.lit("a.ts").alias("from_path")).distinct()
    imports = spark.createDataFrame(_SPECIFIERS, "to_specifier string, from_path string").unionByName(links)
    return resolve.resolve(imports, spark.createDataFrame([("b.ts",)], "path string")).select("to_specifier", "from_path", "dependency_type")


@query(rf"""WITH {_PATHS}, p AS (SELECT DISTINCT host || '/' || path AS path FROM paths), a AS (SELECT path, unnest(range(0, len(string_split(path, '/')))) AS depth FROM p),
f AS (SELECT path, array_to_string(string_split(path, '/')[1:depth], '/') AS folder, depth FROM a)
SELECT folder, count(DISTINCT path) AS files, count(DISTINCT string_split(path, '/')[len(list_filter(string_split(folder, '/'), lambda s: s <> '')) + 1]) AS children FROM f GROUP BY folder""")
def tree_subtree_counts(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-9, AGG-10, GRF-6"""
    return graph.subtree_counts(_page_paths(spark, sf).select(F.concat_ws("/", "host", "path").alias("path")))


@query(rf"""WITH {_PATHS}, c AS (SELECT regexp_extract(p, '^(.*)/[^/]*$', 1) AS folder, count(*) AS n FROM (SELECT host || '/' || path AS p FROM paths) GROUP BY 1),
o AS (SELECT folder, n, coalesce(sum(n) OVER (ORDER BY list_append(CASE WHEN folder = '' THEN [] ELSE string_split(folder, '/') END, chr(65535)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT folder, CAST(greatest(0, least(n, 150 - before)) AS BIGINT) AS shown, CAST(n - greatest(0, least(n, 150 - before)) AS BIGINT) AS hidden FROM o""")
def tree_order_budget(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-7"""
    return lookup.tree_budget(_page_paths(spark, sf).select(F.concat_ws("/", "host", "path").alias("path")), 150)


@query(rf"""WITH {_PATHS}, p AS (SELECT DISTINCT 'apps/' || host || '/src/' || CASE page_id % 4 WHEN 0 THEN 'main.ts' WHEN 1 THEN 'index.js' WHEN 2 THEN 'dist/cli.ts' ELSE 'util.ts' END AS path FROM paths),
s AS (SELECT path, CASE regexp_extract(path, '[^/]+$', 0) WHEN 'main.ts' THEN 7 WHEN 'cli.ts' THEN 6 WHEN 'index.js' THEN 4 ELSE 0 END AS base FROM p)
SELECT path, 'typescript' AS language_id, base * 10 - len(string_split(path, '/')) + CASE WHEN contains(path, '/src/') THEN 1 ELSE 0 END - CASE WHEN contains(path, '/dist/') THEN 3 ELSE 0 END AS score FROM s WHERE base > 0 ORDER BY score DESC, path LIMIT 20""")
def entry_point_rank(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-7"""
    pages = _page_paths(spark, sf)
    n = F.col("page_id") % 4
    name = F.when(n == 0, "main.ts").when(n == 1, "index.js").when(n == 2, "dist/cli.ts").otherwise("util.ts")
    files = pages.select(F.concat(F.lit("apps/"), F.col("host"), F.lit("/src/"), name).alias("path"), F.lit("typescript").alias("language_id")).distinct()
    return entry_points(files).withColumn("score", F.col("score").cast("long"))


@query(rf"""WITH {_PATHS} SELECT page_id, regexp_replace(regexp_replace(host || '/x/../' || path, '/x/../', '/'), '/$', '') AS path FROM paths""")
def path_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-8"""
    return _page_paths(spark, sf).select("page_id", text.normalize_path(F.concat(F.lit("./"), F.col("host"), F.lit("\\x/./../"), F.col("path"))).alias("path"))


@query("""WITH d AS (SELECT l_orderkey AS k, l_linenumber AS line, 'p/dist/f' || l_orderkey || '.js' AS t FROM lineitem), s AS (SELECT 'p/src/f' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '.mts' WHEN 1 THEN '.ts' ELSE '.tsx' END AS path FROM orders)
SELECT k, line, coalesce(a.path, b.path, t) AS to_path FROM d LEFT JOIN s a ON a.path = replace(replace(t, '/dist/', '/src/'), '.js', '.ts') LEFT JOIN s b ON b.path = replace(replace(t, '/dist/', '/src/'), '.js', '.tsx')""")
def dist_to_source(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-7: a third of the files has an ending that is not looked for"""
    key = F.col("o_orderkey")
    deps = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.concat(F.lit("p/dist/f"), F.col("l_orderkey"), F.lit(".js")).alias("to_path"))
    files = load(spark, sf, "orders").select(F.concat(F.lit("p/src/f"), key, F.when(key % 3 == 0, ".mts").when(key % 3 == 1, ".ts").otherwise(".tsx")).alias("path"))
    return resolve.canonical_source(deps, files).select("k", "line", "to_path")


@query(rf"""WITH {_DEPENDENCIES}, f AS (SELECT DISTINCT from_path AS path FROM dep) SELECT CASE WHEN strpos(path, '/') = 0 THEN 'root' ELSE array_to_string(string_split(path, '/')[1:2], '/') END AS module, count(*) AS files FROM f WHERE NOT regexp_matches(path, '^.*/de/.*$') GROUP BY 1""")
def architecture_modules(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-8, GRF-4 through the whole summary"""
    deps = _link_dependencies(spark, sf)
    files = deps.select(F.col("from_path").alias("path")).distinct().withColumn("language_id", F.lit("html"))
    made = architecture.summarise(files, deps, excludes=["**/de/**"])
    return made.module_sizes()


@query("""SELECT o_orderkey, o_orderdate, o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' GROUP BY ALL ORDER BY revenue DESC, o_orderkey LIMIT 10""")
def tpch_q3_like(spark: SparkSession, sf: str) -> DataFrame:
    """Joins, aggregate and top k together"""
    customers = load(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    orders = load(spark, sf, "orders").join(customers, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderpriority")
    money = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue")
    out = load(spark, sf, "lineitem").join(orders, "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey"), "o_orderdate", "o_orderpriority").agg(money)
    return out.orderBy(F.desc("revenue"), "o_orderkey").limit(10)


# --- without SQL twins -------------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type, round(value, 6) AS value, epoch_us(ts) AS ts_us FROM events")
def streaming_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """INC-1, INC-2: a file source read to its end, appended exactly once"""
    here = f"{shared_dir(spark)}/stream-{os.urandom(8).hex()}"
    schema = load(spark, sf, "events").schema
    load(spark, sf, "events").write.parquet(f"{here}/in")
    ingest.ingest(spark, f"{here}/in", schema, f"{here}/out", f"{here}/state").awaitTermination()
    out = spark.read.schema(schema).parquet(f"{here}/out")
    return out.select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


@query()
def embed_hash(spark: SparkSession, sf: str) -> DataFrame:
    """VEC-1, VEC-5: whole texts; trimming is for a provider whose context overflows (VEC-4)."""
    return embed(load(spark, sf, "documents").select("doc_id", "text"), HashingProvider(64), text_col="text").select("doc_id", "embedding")


from siltstone.plans import code_queries  # noqa: E402, F401  registers its queries here
