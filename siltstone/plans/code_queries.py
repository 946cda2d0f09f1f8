"""Registered queries that run the library's code operators over the driver's tables, each with its twin in DuckDB SQL.

The tables hold no source code, so files, symbols and imports are made of their rows by a stated rule: a row of ``part`` is a file
whose text a template gives, and the twin states what must be found in it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.engine import Engine
from siltstone.functions import text
from siltstone.operators import architecture, chunk, graph, lookup, resolve, vector
from siltstone.operators.extract import extract
from siltstone.operators.search import search
from siltstone.plans.catalogue import _DEPENDENCIES, _FAR, _PATHS, _Q0, _SCORE, NAME_QUERY, _link_dependencies, _page_paths, _query_vector, _tokens_sql, query
from siltstone.runtime import load, shared_dir
from siltstone.sources import git, store
from siltstone.sources.config import Config
from siltstone.sources.files import scan_files
from siltstone.streaming import ingest

# --- search ------------------------------------------------------------------------------------------------------------------------


def _chunks_of_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as chunk vectors: lines 1 to 9 of a file each, every fifth a test file; labels 0 and 1 are imports and preambles."""
    n = F.col("vec_id")
    path = F.concat(F.lit("src/v"), n, F.when(n % 5 == 0, ".test.ts").otherwise(".ts"))
    kind = F.when(F.col("label") == 0, "imports").when(F.col("label") == 1, "preamble").otherwise("impl")
    stored = F.when(n % 7 == 0, "const").otherwise("stored")
    return load(spark, sf, "embeddings").select(F.lit("p").alias("project_id"), F.when(n % 11 == 3, "old").otherwise("now").alias("snapshot_id"), F.lpad(n.cast("string"), 9, "0").alias("chunk_id"), path.alias("file_path"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), kind.alias("chunk_type"), stored.alias("primary_symbol"), "embedding")


def _chunks_sql(least: str = "") -> str:
    return f"""{_Q0}, v AS (SELECT lpad(vec_id::VARCHAR, 9, '0') AS chunk_id, vec_id, 'src/v' || vec_id || CASE WHEN vec_id % 5 = 0 THEN '.test.ts' ELSE '.ts' END AS file_path,
  CASE label WHEN 0 THEN 'imports' WHEN 1 THEN 'preamble' ELSE 'impl' END AS chunk_type, CASE WHEN vec_id % 7 = 0 THEN 'const' ELSE 'stored' END AS stored, {_FAR} AS distance FROM embeddings e, q WHERE vec_id % 11 <> 3{least})"""


@query(f"""WITH {_chunks_sql()}, t AS (SELECT * FROM v ORDER BY distance, chunk_id LIMIT 40),
s AS (SELECT chunk_id, file_path, CASE WHEN vec_id % 2 = 0 THEN 'loadIndex' WHEN vec_id % 3 = 0 THEN 'other' WHEN stored <> 'const' THEN stored END AS symbol, {_SCORE} * CASE WHEN vec_id % 5 = 0 THEN 0.75 ELSE 1.0 END AS score FROM t WHERE chunk_type = 'impl')
SELECT chunk_id, file_path, symbol, round(score, 9) AS score FROM s WHERE score >= 0.3""")
def search_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """VEC-7, JOIN-4, JOIN-6, FLT-10, FLT-11, FLT-15, WIN-2, FN-5, FN-6, SRT-2: the whole search, symbols told from names and bodies"""
    vectors = _chunks_of_embeddings(spark, sf)
    n = F.regexp_extract("file_path", "([0-9]+)", 1).cast("long")
    files = vectors.select("project_id", "snapshot_id", "file_path", n.alias("n"))
    both = F.array(F.struct(F.lit("loadIndex").alias("name"), F.lit("function loadIndex()").alias("signature"), F.lit(2).alias("start_line"), F.lit(4).alias("end_line")), F.struct(F.lit("other").alias("name"), F.lit(None).cast("string").alias("signature"), F.lit(6).alias("start_line"), F.lit(8).alias("end_line")))
    symbols = files.select("project_id", "snapshot_id", "file_path", "n", F.lit("function").alias("kind"), F.inline(both)).where("name = 'other' or n % 2 = 0").drop("n")
    contents = files.where("n % 3 = 0").select("file_path", F.lit("1\n2\n3\n4\n5\n6\nloading an index\n8\n9").alias("content")).distinct()
    found = search(vectors, symbols, "load the index", _query_vector(spark, sf), project="p", snapshot="now", k=40, min_score=0.3, contents=contents)
    return found.select("chunk_id", "file_path", "symbol", F.round("score", 9).alias("score"))


@query(f"WITH {_chunks_sql()} SELECT chunk_id, distance FROM v WHERE starts_with(file_path, 'src/v1') AND chunk_type IN ('impl', 'preamble') ORDER BY distance, chunk_id LIMIT 25")
def vec_prefiltered(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-1, FLT-2, JOIN-1: the library's conjunction before the top k"""
    rows = vector.prefilter(_chunks_of_embeddings(spark, sf), project="p", snapshot="now", prefix="src/v1", chunk_types=["impl", " preamble ", ""])
    return vector.top_k(rows, _query_vector(spark, sf), 25).select("chunk_id", "distance")


@query("SELECT count(*) AS n FROM embeddings WHERE vec_id % 11 <> 3 AND label NOT IN (0, 1)")
def vec_count_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-1"""
    n = vector.count_vectors(_chunks_of_embeddings(spark, sf), project="p", snapshot="now", chunk_types=["impl"])
    return spark.createDataFrame([(n,)], "n long")


# --- symbols -----------------------------------------------------------------------------------------------------------------------


def _symbols_of_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as symbols: a file a brand, one in nine of them under tests/."""
    n = F.col("p_partkey")
    path = F.concat(F.when(n % 9 == 0, "tests/").otherwise("src/"), F.regexp_replace("p_brand", "#", "/"), F.lit(".ts"))
    return load(spark, sf, "part").select(path.alias("file_path"), F.when(n % 3 == 0, "class").when(n % 3 == 1, "function").otherwise("type").alias("kind"), F.col("p_name").alias("name"), (n % 2 == 0).alias("exported"), n.cast("int").alias("start_line"))


_PART_SYMBOLS = """sym AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN 'tests/' ELSE 'src/' END || replace(p_brand, '#', '/') || '.ts' AS file_path, CASE p_partkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'type' END AS kind,
  CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 4 END AS kind_rank, p_name AS name, p_partkey % 2 = 0 AS exported, p_partkey AS start_line FROM part),
dep AS (SELECT DISTINCT 'src/app' || p_partkey % 7 || '.ts' AS from_path, 'src/' || replace(p_brand, '#', '/') || '.ts' AS to_path FROM part)"""


@query(f"""WITH {_PART_SYMBOLS}, r AS (SELECT *, CASE WHEN lower(name) = '{NAME_QUERY}' THEN 1 WHEN starts_with(lower(name), '{NAME_QUERY}') THEN 2 ELSE 3 END AS name_rank FROM sym WHERE contains(lower(name), '{NAME_QUERY}') AND NOT starts_with(file_path, 'tests/')),
b AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY name_rank, kind_rank, name, start_line) AS place FROM r),
f AS (SELECT * FROM b WHERE place = 1 ORDER BY name_rank, kind_rank, name, file_path LIMIT 5)
SELECT file_path, name, kind, (SELECT coalesce(string_agg(from_path, ',' ORDER BY from_path), '') FROM dep WHERE to_path = f.file_path) AS callers, '' AS callees FROM f""")
def explain_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-8, FLT-12, WIN-4, WIN-5, SRT-8: the library's lookup with callers and callees"""
    deps = load(spark, sf, "part").select(F.concat(F.lit("src/app"), F.col("p_partkey") % 7, F.lit(".ts")).alias("from_path"), F.concat(F.lit("src/"), F.regexp_replace("p_brand", "#", "/"), F.lit(".ts")).alias("to_path")).distinct()
    found = lookup.explain(_symbols_of_parts(spark, sf), deps, NAME_QUERY)
    return found.select("file_path", "name", "kind", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


@query("""WITH r AS (SELECT 'f' || p_partkey || '.ts' AS file_path, CASE WHEN p_partkey % 50 = 0 THEN 'Target' ELSE 'xTarget' END AS name FROM part WHERE p_partkey % 6 <> 1) SELECT file_path, name FROM r WHERE name = 'Target'""")
def exact_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-5, FN-9: all symbols of the very name, however many; the query names the file's ending too"""
    n = F.col("p_partkey")
    path = F.concat(F.lit("f"), n, F.when(n % 6 == 1, ".py").otherwise(".ts"))
    rows = load(spark, sf, "part").select(path.alias("file_path"), F.lit("class").alias("kind"), F.when(n % 50 == 0, "Target").otherwise("xTarget").alias("name"), F.lit(True).alias("exported"), F.lit(1).alias("start_line"))
    return lookup.find_symbols(rows, ".ts::Target").select("file_path", "name")


@query(f"WITH {_PART_SYMBOLS} SELECT DISTINCT name, kind, file_path FROM sym WHERE contains(lower(name), 'steel') ORDER BY name, file_path, kind LIMIT 5")
def symbol_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """FN-8, SRT-8"""
    return lookup.suggestions(_symbols_of_parts(spark, sf), "steelEverything")


@query("""WITH f AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'src/tests/s' ELSE 'src/s' END || s_suppkey || '.ts' AS path FROM supplier),
s AS (SELECT 'src/s' || c_custkey % 150 || '.ts' AS path, CASE c_custkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'type' END AS kind, c_name AS name FROM customer WHERE c_custkey % 2 = 0)
SELECT path, kind, name FROM f LEFT JOIN s USING (path) WHERE NOT regexp_matches(path, '/tests/') AND NOT regexp_matches(path, '^src/s1[^/]*[.]ts$')""")
def structure_listing(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-7, FLT-13, SRT-6, PRJ-9"""
    n, c = F.col("s_suppkey"), F.col("c_custkey")
    files = load(spark, sf, "supplier").select(F.concat(F.when(n % 4 == 0, "src/tests/s").otherwise("src/s"), n, F.lit(".ts")).alias("path"), F.lit("typescript").alias("language_id"))
    symbols = load(spark, sf, "customer").select(F.concat(F.lit("src/s"), c % 150, F.lit(".ts")).alias("file_path"), F.when(c % 3 == 0, "class").when(c % 3 == 1, "function").otherwise("type").alias("kind"), F.col("c_name").alias("name"), (c % 2 == 0).alias("exported"), F.lit(1).alias("start_line"))
    return lookup.structure(files, symbols, prefix="./src/", tests=False, excludes=["src/s1*.ts"]).select("path", "kind", "name")


# --- imports -----------------------------------------------------------------------------------------------------------------------


def _asked(spark: SparkSession, sf: str, from_path: str, specifier: Column) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", specifier.alias("to_specifier"), F.lit(from_path).alias("from_path"))


def _known(spark: SparkSession, sf: str, path: Column) -> DataFrame:
    return load(spark, sf, "part").select(path.alias("path"))


def _n() -> Column:
    return F.col("p_partkey")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 'pkg/m' || p_partkey || CASE p_partkey % 2 WHEN 0 THEN '.py' ELSE '/__init__.py' END END AS to_path, CASE p_partkey % 3 WHEN 2 THEN 'builtin' ELSE 'internal' END AS dependency_type FROM part WHERE p_partkey % 4 <> 3
UNION ALL SELECT p_partkey, NULL, 'external' FROM part WHERE p_partkey % 4 = 3""")
def resolve_python(spark: SparkSession, sf: str) -> DataFrame:
    """RES-PY, JOIN-10: relative and absolute modules and packages, the standard library, unknown ones"""
    n = _n()
    spec = F.when(n % 4 == 3, F.concat(F.lit("gone"), n, F.lit(".part"))).when(n % 3 == 0, F.concat(F.lit(".m"), n)).when(n % 3 == 1, F.concat(F.lit("pkg.m"), n, F.lit(".thing"))).otherwise("os.path")
    files = _known(spark, sf, F.concat(F.lit("pkg/m"), n, F.when(n % 2 == 0, ".py").otherwise("/__init__.py")))
    return resolve.resolve(_asked(spark, sf, "pkg/main.py", spec), files).select("p_partkey", "to_path", "dependency_type")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Game/N' || p_partkey || '/Actor.cs' END AS to_path, CASE p_partkey % 3 WHEN 0 THEN 'internal' ELSE 'external' END AS dependency_type FROM part""")
def resolve_csharp(spark: SparkSession, sf: str) -> DataFrame:
    """RES-CS, JOIN-11: namespaces matched with folders, the first file in path order; engine and system roots; unknown ones"""
    n = _n()
    spec = F.when(n % 3 == 0, F.concat(F.lit("Company.N"), n)).when(n % 3 == 1, F.concat(F.lit("System.T"), n)).otherwise(F.concat(F.lit("Missing.X"), n))
    files = _known(spark, sf, F.concat(F.lit("Game/N"), n, F.lit("/Player.cs"))).unionByName(_known(spark, sf, F.concat(F.lit("Game/N"), n, F.lit("/Actor.cs"))))
    return resolve.resolve(_asked(spark, sf, "Main.cs", spec), files).select("p_partkey", "to_path", "dependency_type")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN 'scripts/h' || p_partkey || '.gd' END AS to_path, 'internal' AS dependency_type FROM part""")
def resolve_gdscript(spark: SparkSession, sf: str) -> DataFrame:
    """RES-GD, JOIN-12: resource paths, relative paths, class names, and a relative path that isn't there"""
    n = _n()
    spec = F.when(n % 4 == 0, F.concat(F.lit("res://scripts/h"), n, F.lit(".gd"))).when(n % 4 == 1, F.concat(F.lit("./h"), n)).when(n % 4 == 2, F.concat(F.lit("h"), n)).otherwise(F.concat(F.lit("./gone"), n, F.lit(".gd")))
    return resolve.resolve(_asked(spark, sf, "scripts/main.gd", spec), _known(spark, sf, F.concat(F.lit("scripts/h"), n, F.lit(".gd")))).select("p_partkey", "to_path", "dependency_type")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'lib/m' || p_partkey || '.rb' WHEN 1 THEN 'lib/m' || p_partkey || '/index.rb' END AS to_path, CASE p_partkey % 4 WHEN 2 THEN 'builtin' WHEN 3 THEN 'external' ELSE 'internal' END AS dependency_type FROM part""")
def resolve_ruby(spark: SparkSession, sf: str) -> DataFrame:
    """RES-RB"""
    n = _n()
    spec = F.when(n % 4 < 2, F.concat(F.lit("../lib/m"), n)).when(n % 4 == 2, "json").otherwise(F.concat(F.lit("gem"), n))
    files = _known(spark, sf, F.concat(F.lit("lib/m"), n, F.when(n % 4 == 0, ".rb").otherwise("/index.rb")))
    return resolve.resolve(_asked(spark, sf, "bin/run.rb", spec), files).select("p_partkey", "to_path", "dependency_type")


# --- extractors --------------------------------------------------------------------------------------------------------------------

_PYTHON = "import os\nfrom .m@ import x\n\n\nclass C@(Base):\n    def run_@(self):\n        pass\n\n\ndef _hid@():\n    return 1\n"
_TYPESCRIPT = "import { a } from './m@';\nimport fs from 'node:fs';\n\nexport class C@ {\n  run@(x: string): void {\n  }\n}\n\nfunction hid@() {\n  return 1;\n}\n\nexport type T@ = { a: 1 };\n"
_CSHARP = "using A.B@;\n\npublic class C@ : Base {\n  private void Hid@() {\n  }\n  public int Get@(int x) {\n    return x;\n  }\n}\n"
_GDSCRIPT = 'extends Node\nclass_name C@\nconst X = preload("res://m@.tscn")\nsignal hit@\n\nfunc run@():\n\tpass\n\nfunc _hid@():\n\tpass\n'
_RUBY = "require 'json'\nrequire_relative 'm@'\n\nclass C@\n  def run@\n  end\n\n  private\n\n  def hid@\n  end\nend\n"


def _extracted(spark: SparkSession, sf: str, ending: str, template: str) -> DataFrame:
    """(p_partkey, what, kind, name, inside, exported, line): symbols, imports and chunks of a file for each part."""
    files = load(spark, sf, "part").select("p_partkey", F.concat(F.lit("f"), F.col("p_partkey"), F.lit(ending)).alias("path"), F.regexp_replace(F.lit(template), "@", F.col("p_partkey").cast("string")).alias("content"))
    read = extract(files).where("error is null")
    none = F.lit(None).cast("string")
    symbols = read.select("p_partkey", F.inline("symbols")).select("p_partkey", F.lit("symbol").alias("what"), "kind", "name", F.col("container_name").alias("inside"), "exported", F.col("start_line").alias("line"))
    imports = read.select("p_partkey", F.inline("imports")).select("p_partkey", F.lit("import").alias("what"), "kind", F.col("specifier").alias("name"), none.alias("inside"), F.lit(None).cast("boolean").alias("exported"), "line")
    chunks = read.select("p_partkey", F.inline("chunks")).select("p_partkey", F.lit("chunk").alias("what"), F.col("chunk_type").alias("kind"), F.col("primary_symbol").alias("name"), F.col("end_line").cast("string").alias("inside"), F.lit(None).cast("boolean").alias("exported"), F.col("start_line").alias("line"))
    return symbols.unionByName(imports).unionByName(chunks)


def _extracted_sql(rows: list[tuple]) -> str:
    """Expected rows (what, kind, name, inside, exported, line); ``@`` stands for the part's key."""
    value = lambda v: "NULL" if v is None else str(v) if isinstance(v, (bool, int)) else f"'{v}'"
    listed = ", ".join("(" + ", ".join(value(v) for v in row) + ")" for row in rows)
    return f"SELECT p_partkey, what, kind, replace(name, '@', p_partkey::VARCHAR) AS name, replace(inside, '@', p_partkey::VARCHAR) AS inside, exported::BOOLEAN AS exported, line FROM part, (VALUES {listed}) x(what, kind, name, inside, exported, line)"


@query(_extracted_sql([
    ("symbol", "class", "C@", None, True, 5), ("symbol", "method", "run_@", "C@", True, 6), ("symbol", "function", "_hid@", None, False, 10), ("import", "import", "os", None, None, 1), ("import", "import", ".m@", None, None, 2),
    ("chunk", "imports", None, "2", None, 1), ("chunk", "types", "C@", "7", None, 5), ("chunk", "impl", "run_@", "7", None, 6), ("chunk", "impl", "_hid@", "11", None, 10),
]))
def extract_python(spark: SparkSession, sf: str) -> DataFrame:
    """EXT-PY, FN-14"""
    return _extracted(spark, sf, ".py", _PYTHON)


@query(_extracted_sql([
    ("symbol", "class", "C@", None, True, 4), ("symbol", "method", "run@", "C@", False, 5), ("symbol", "function", "hid@", None, False, 9), ("symbol", "type", "T@", None, True, 13), ("import", "import", "./m@", None, None, 1), ("import", "import", "node:fs", None, None, 2),
    ("chunk", "imports", None, "2", None, 1), ("chunk", "impl", "C@", "13", None, 4),
]))
def extract_typescript(spark: SparkSession, sf: str) -> DataFrame:
    """EXT-TS, FN-14"""
    return _extracted(spark, sf, ".ts", _TYPESCRIPT)


@query(_extracted_sql([
    ("symbol", "class", "C@", None, True, 3), ("symbol", "method", "Hid@", "C@", False, 4), ("symbol", "method", "Get@", "C@", True, 6), ("import", "using", "A.B@", None, None, 1),
    ("chunk", "imports", None, "1", None, 1), ("chunk", "impl", "C@", "9", None, 3), ("chunk", "impl", "Hid@", "5", None, 4), ("chunk", "impl", "Get@", "8", None, 6),
]))
def extract_csharp(spark: SparkSession, sf: str) -> DataFrame:
    """EXT-CS, FN-14"""
    return _extracted(spark, sf, ".cs", _CSHARP)


@query(_extracted_sql([
    ("symbol", "class", "C@", None, True, 2), ("symbol", "signal", "hit@", None, True, 4), ("symbol", "function", "run@", None, True, 6), ("symbol", "function", "_hid@", None, False, 9), ("import", "import", "Node", None, None, 1), ("import", "asset_reference", "res://m@.tscn", None, None, 3),
    ("chunk", "imports", None, "3", None, 1), ("chunk", "types", "C@", "5", None, 2), ("chunk", "impl", "run@", "8", None, 6), ("chunk", "impl", "_hid@", "11", None, 9),
]))
def extract_gdscript(spark: SparkSession, sf: str) -> DataFrame:
    """EXT-GD, FN-14"""
    return _extracted(spark, sf, ".gd", _GDSCRIPT)


@query(_extracted_sql([
    ("symbol", "class", "C@", None, True, 4), ("symbol", "method", "run@", "C@", True, 5), ("symbol", "method", "hid@", "C@", False, 10), ("import", "require", "json", None, None, 1), ("import", "require", "m@", None, None, 2),
    ("chunk", "imports", None, "2", None, 1), ("chunk", "types", "C@", "12", None, 4), ("chunk", "impl", "run@", "6", None, 5), ("chunk", "impl", "hid@", "11", None, 10),
]))
def extract_ruby(spark: SparkSession, sf: str) -> DataFrame:
    """EXT-RB, WIN-8, FN-14"""
    return _extracted(spark, sf, ".rb", _RUBY)


# --- chunks ------------------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, 0 AS start_line, CAST(len(string_split_regex(text, '\\r?\\n')) AS INTEGER) AS end_line, 'full_file' AS chunk_type, length(text) AS chars FROM documents")
def chunk_single(spark: SparkSession, sf: str) -> DataFrame:
    """CHK-2"""
    return load(spark, sf, "documents").select("doc_id", F.inline(chunk.single_chunk(F.col("text")))).select("doc_id", "start_line", "end_line", "chunk_type", F.length("content").cast("long").alias("chars"))


@query("""WITH l AS (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS x FROM documents), w AS (SELECT doc_id, x, len(x) AS n, unnest(range(0, CAST(greatest(ceil((len(x) - 30) / 20.0), 0) AS BIGINT) + 1)) AS i FROM l)
SELECT doc_id, CAST(i * 20 AS INTEGER) AS start_line, CAST(least(n, i * 20 + 30) AS INTEGER) AS end_line, length(array_to_string(x[i * 20 + 1:least(n, i * 20 + 30)], chr(10))) + CASE WHEN i > 0 THEN 7 ELSE 0 END AS chars FROM w""")
def chunk_module(spark: SparkSession, sf: str) -> DataFrame:
    """CHK-3: windows counted from line 0, later ones marked as continued"""
    made = chunk.module_chunks(F.col("text"), window=30, overlap=10)
    return load(spark, sf, "documents").select("doc_id", F.inline(made)).select("doc_id", "start_line", "end_line", F.length("content").cast("long").alias("chars"))


@query(_extracted_sql([("chunk", "imports", None, "2", None, 1), ("chunk", "types", "C@", "5", None, 5), ("chunk", "impl", "run_@", "9", None, 6), ("chunk", "impl", "_hid@", "12", None, 10)]))
def chunk_heuristic(spark: SparkSession, sf: str) -> DataFrame:
    """CHK-5, AGG-12: the import header, then a chunk from each definition line to before the next"""
    content = F.regexp_replace(F.lit(_PYTHON), "@", F.col("p_partkey").cast("string"))
    made = load(spark, sf, "part").select("p_partkey", F.inline(chunk.heuristic_chunks(content, "python")))
    return made.select("p_partkey", F.lit("chunk").alias("what"), F.col("chunk_type").alias("kind"), F.col("primary_symbol").alias("name"), F.col("end_line").cast("string").alias("inside"), F.lit(None).cast("boolean").alias("exported"), F.col("start_line").alias("line"))


@query("""SELECT p_partkey, start_line, end_line, chunk_type FROM part, (VALUES (0, 3, 9, 'impl'), (1, 1, 3, 'types'), (1, 4, 5, 'impl'), (2, 1, 2, 'full_file')) x(m, start_line, end_line, chunk_type) WHERE p_partkey % 3 = m""")
def chunk_files_mix(spark: SparkSession, sf: str) -> DataFrame:
    """CHK-6, CHK-1: the extractor's chunks where there are any, else heuristic ones, else adaptive ones"""
    n = _n()
    own = F.array(F.struct(F.lit(3).alias("start_line"), F.lit(9).alias("end_line"), F.lit("impl").alias("chunk_type"), F.lit("x").alias("primary_symbol"), F.lit("own").alias("content")))
    files = load(spark, sf, "part").select("p_partkey", F.when(n % 3 == 2, "plaintext").otherwise("python").alias("language_id"), F.when(n % 3 == 2, "a\nb").otherwise("class A:\n  x = 1\n\ndef f():\n  return 1").alias("content"), F.when(n % 3 == 0, own).alias("chunks"))
    return chunk.chunk_files(files, plugin_chunks="chunks").select("p_partkey", "start_line", "end_line", "chunk_type")


# --- the store ---------------------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 7 = 2 THEN 'new' ELSE lang END AS language_id, length(text) AS size FROM documents WHERE doc_id % 7 <> 3""")
def store_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-9, SNK-1..9, WIN-1, SRT-3, SRT-4, SET-1, SET-3, JOIN-2, JOIN-3, FN-17, INC-3: a snapshot is written, the next one copies what
    is neither deleted nor changed and adds the changed rows, a failed one stays unseen, older ones are removed, the latest is read"""
    catalog = store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    ids = lambda s: [F.lit("p").alias("project_id"), F.lit(s).alias("snapshot_id")]
    docs = load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("h").alias("sha256"), F.lit(0).cast("long").alias("mtime_ms"), F.length("text").cast("long").alias("size"), F.col("lang").alias("language_id"))
    first = catalog.create_snapshot("p", now_ms=1_000)
    catalog.write("files", docs.select(*ids(first), *docs.columns))
    catalog.set_status(first, "completed")
    second = catalog.create_snapshot("p", now_ms=2_000)
    changed = docs.where("path % 7 in (2, 3)")
    catalog.copy("p", first, second, changed.select("path"), tables=["files"])
    catalog.write("files", changed.where("path % 7 = 2").withColumn("language_id", F.lit("old")).select(*ids(second), *docs.columns))
    catalog.upsert("files", changed.where("path % 7 = 2").withColumn("language_id", F.lit("new")).select(*ids(second), *docs.columns), ["path"])
    catalog.set_status(second, "completed")
    crashed = catalog.create_snapshot("p", now_ms=3_000)
    catalog.write("files", docs.select(*ids(crashed), *docs.columns))
    catalog.fail_stale("p")
    catalog.clear("p", second)
    latest = catalog.latest_snapshot("p")
    assert [r["id"] for r in catalog.list_snapshots("p").collect()] == [latest]
    return catalog.read("files", "p", latest, ordered=True).select("path", "language_id", "size")


@query("""WITH s AS (SELECT event_id::VARCHAR AS id, event_id, event_type, epoch_us(ts) // 1000 AS created_at FROM events) SELECT id FROM s WHERE event_id = 5 OR (event_type = 'click' AND created_at >= (SELECT max(created_at) FROM s) - 1800000)""")
def kept_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-9, SET-3: what a clean-up keeps"""
    rows = load(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") == "click", "indexing").otherwise("completed").alias("status"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"))
    now = rows.agg(F.max("created_at")).first()[0]
    return store.kept_snapshots(rows, "5", now).select("id")


@query("SELECT event_id::VARCHAR AS id FROM events ORDER BY epoch_us(ts) DESC, event_id::VARCHAR DESC LIMIT 25 OFFSET 50")
def page_of_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-3"""
    rows = load(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_at"))
    return store.page(rows, 25, 50).select("id")


@query("SELECT coalesce(max(p_size), 0) AS version FROM part")
def schema_version(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-11"""
    return store.schema_version(load(spark, sf, "part").select(F.col("p_size").alias("version")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 10 <> 0")
def replace_changed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-2: all rows of changed files go, the new ones come"""
    orders = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    changed = orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("path"))
    return store.replace_for_files(orders, orders.where("o_orderkey % 5 = 0 and o_orderkey % 10 <> 0").withColumn("status", F.lit("new")), changed, "o_orderkey")


# --- a project of files --------------------------------------------------------------------------------------------------------------


def _write_files(spark: SparkSession, root: str, files: DataFrame) -> None:
    """Rows (path, content) as files of a project; they come from ``nation``, which has 25 rows at every scale."""
    sc = spark.sparkContext
    for r in files.collect():
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{root}/{r['path']}")
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(r["content"].encode()))
        out.close()


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as Python files, one in five of them in an ignored folder."""
    n = F.col("n_nationkey")
    folder = F.when(n % 5 == 4, "build/").otherwise(F.concat(F.lit("src/r"), F.col("n_regionkey"), F.lit("/")))
    content = F.concat(F.lit("import os\nfrom .n0 import Nation0\n\n\nclass Nation"), n, F.lit(":\n    name = '"), F.col("n_name"), F.lit("'\n"))
    return load(spark, sf, "nation").select(n.alias("key"), F.concat(folder, F.lit("n"), n, F.lit(".py")).alias("path"), content.alias("content"))


_NATION_FILES = (
    "f AS (SELECT n_nationkey, 'src/r' || n_regionkey || '/n' || n_nationkey || '.py' AS path, 'import os' || chr(10) || 'from .n0 import Nation0' || repeat(chr(10), 3) || 'class Nation' || n_nationkey || ':' || chr(10) "
    "|| '    name = ' || chr(39) || n_name || chr(39) || chr(10) AS content FROM nation WHERE n_nationkey % 5 <> 4)"
)


@query(f"WITH {_NATION_FILES} SELECT path, length(content) AS size, sha256(rtrim(content, chr(10))) AS sha256, 'python' AS language_id FROM f")
def scan_project(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-1, SRC-2, SRC-3, SRC-12, FN-1, FLT-17: a project's files read from its folder"""
    root = f"{shared_dir(spark)}/project-{uuid.uuid4().hex}"
    _write_files(spark, root, _nations(spark, sf))
    return scan_files(spark, root).select("path", "size", "sha256", "language_id")


@query(f"""WITH {_NATION_FILES}, now AS (SELECT n_nationkey, path FROM f WHERE n_nationkey <> 7)
SELECT path, 'class' AS kind, CASE WHEN n_nationkey = 3 THEN 'Changed' ELSE 'Nation' || n_nationkey END AS name, CASE WHEN n_nationkey = 3 THEN 1 ELSE 5 END AS line,
  CASE WHEN n_nationkey = 0 THEN (SELECT string_agg(path, ',' ORDER BY path) FROM now WHERE starts_with(path, 'src/r0/') AND n_nationkey <> 3) ELSE '' END AS callers FROM now""")
def engine_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """INC-1, INC-2, INC-3, SNK-1, SNK-4, SNK-8, SNK-11, EXT-PY, RES-PY, JOIN-7, SRC-9: a project is indexed, changed (a file goes, another is
    written anew), and read: the reading indexes what has changed first"""
    root = f"{shared_dir(spark)}/project-{uuid.uuid4().hex}"
    files = _nations(spark, sf)
    _write_files(spark, root, files)
    engine = Engine(spark, root, store.Store(spark, f"{root}-store"), "p")
    engine.index()
    sc = spark.sparkContext
    for r in files.where("key in (3, 7)").select("path").collect():
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{root}/{r['path']}")
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, False)
    _write_files(spark, root, files.where("key = 3").withColumn("content", F.lit("class Changed:\n    pass\n")))
    listed = engine.structure().select("path", "kind", "name", F.col("start_line").alias("line"))
    callers = engine.table("dependencies").where("to_path is not null").groupBy(F.col("to_path").alias("path")).agg(F.array_join(F.array_sort(F.collect_set("from_path")), ",").alias("callers"))
    return listed.join(callers, "path", "left").withColumn("callers", F.coalesce("callers", F.lit("")))


# --- logs --------------------------------------------------------------------------------------------------------------------------


@query("SELECT 'f' || user_id AS path, CAST(sum(CASE WHEN event_type = 'click' THEN event_id % 50 ELSE event_id % 50 + event_id % 7 END) AS BIGINT) AS churn FROM events GROUP BY user_id")
def churn_from_log(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-4, SRC-8: lines of git's numstat, a binary file's dash among them"""
    n = F.col("event_id")
    line = F.concat_ws("\t", (n % 50).cast("string"), F.when(F.col("event_type") == "click", "-").otherwise((n % 7).cast("string")), F.concat(F.lit("f"), F.col("user_id")))
    lines = load(spark, sf, "events").select(F.explode(F.array(line, F.lit(""), F.lit("commit line"))).alias("value"))
    return git.numstat_churn(lines)


@query("SELECT c_custkey AS path, coalesce(n, 0) AS churn FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def files_with_churn(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-13"""
    counts = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.count(F.lit(1)).alias("churn"))
    return git.with_churn(load(spark, sf, "customer").select(F.col("c_custkey").alias("path")), counts)


@query("""WITH e AS (SELECT user_id, value, epoch_us(ts) // 86400000000 AS day FROM events), w AS (SELECT user_id, value, unnest(range(day - 2, day + 1)) AS start_day FROM e) SELECT start_day, user_id, round(sum(value), 6) AS churn FROM w GROUP BY start_day, user_id""")
def rolling_churn_windows(spark: SparkSession, sf: str) -> DataFrame:
    """INC-5: the streaming aggregate, here over the whole table"""
    events = load(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    made = ingest.rolling_churn(events, ts="ts", key="user_id", value="value", window="3 days", slide="1 day")
    return made.select(F.expr("unix_millis(start) div 86400000").alias("start_day"), "user_id", F.round("churn", 6).alias("churn"))


# --- modules -----------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {_DEPENDENCIES}, inside AS (SELECT DISTINCT array_to_string(string_split(p, '/')[1:2], '/') AS module FROM (SELECT DISTINCT from_path AS p FROM dep) WHERE starts_with(p, 'example.org/') OR starts_with(p, 'www.example.org/'))
SELECT bucket, from_module, target FROM edge WHERE NOT (bucket = 'internal' AND from_module = target) AND from_module IN (SELECT module FROM inside WHERE starts_with(module, 'example.org/')) AND (bucket <> 'internal' OR target IN (SELECT module FROM inside WHERE starts_with(module, 'example.org/')))""")
def architecture_under(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-5, JOIN-16: the summary of what lies under a prefix"""
    deps = _link_dependencies(spark, sf)
    files = deps.select(F.col("from_path").alias("path")).distinct().withColumn("language_id", F.lit("html"))
    return architecture.under(architecture.summarise(files, deps), files, "example.org/").edges.select("bucket", "from_module", "target")


@query(f"""WITH {_DEPENDENCIES}, f AS (SELECT DISTINCT from_path AS path FROM dep) SELECT path FROM f WHERE NOT regexp_matches(path, '^.*/fr/.*$')""")
def files_without_excluded(spark: SparkSession, sf: str) -> DataFrame:
    """GRF-4, FLT-8: files that survive exclude globs"""
    deps = _link_dependencies(spark, sf)
    kept, _ = graph.without(deps.select(F.col("from_path").alias("path")).distinct(), deps, ["**/fr/**"])
    return kept


@query("SELECT conv_id, role, min(turn) AS first_seen, count(*) AS n FROM conversations GROUP BY conv_id, role")
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-13"""
    return graph.first_seen(load(spark, sf, "conversations"), keys=["conv_id", "role"], at="turn")


# --- scalar functions --------------------------------------------------------------------------------------------------------------

_TRIMMED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_ENDINGS = ("ts", "tsx", "py", "PYI", "cs", "gd", "rb", "mjs", "txt", "d.ts")


@query(rf"SELECT doc_id, {_TRIMMED.format('string_split_regex(' + _TRIMMED.format('text') + ', chr(13) || chr(63) || chr(10))[1]')} AS signature FROM documents")
def signature_lines(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-5"""
    return load(spark, sf, "documents").select("doc_id", text.signature(F.col("text")).alias("signature"))


@query("SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'typescript' WHEN 1 THEN 'typescript' WHEN 2 THEN 'python' WHEN 3 THEN 'python' WHEN 4 THEN 'csharp' WHEN 5 THEN 'gdscript' WHEN 6 THEN 'ruby' WHEN 7 THEN 'typescript' WHEN 8 THEN 'plaintext' ELSE 'typescript' END AS language FROM part")
def language_of_paths(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-12, FLT-17"""
    ending = F.element_at(F.array(*[F.lit(e) for e in _ENDINGS]), (F.col("p_partkey") % 10 + 1).cast("int"))
    return load(spark, sf, "part").select("p_partkey", text.language_of(F.concat(F.lit("a.b/"), F.col("p_brand"), F.lit("."), ending)).alias("language"))


@query(f"""WITH {_PATHS} SELECT page_id, CASE WHEN starts_with(p, 'example.org/en/') THEN substr(p, 16) ELSE p END AS relative, p LIKE 'example.org/en/1%' AS under FROM (SELECT page_id, host || '/' || path AS p FROM paths)""")
def relative_paths(spark: SparkSession, sf: str) -> DataFrame:
    """FN-12, PRJ-9, FLT-4"""
    path = F.concat_ws("/", "host", "path")
    return _page_paths(spark, sf).select("page_id", text.relative_to(path, "example.org/en/").alias("relative"), text.has_prefix(path, text.clean_prefix(" ./example.org/en/1")).alias("under"))


@query("""SELECT p_partkey, p_partkey % 4 IN (0, 1, 2) AS excluded FROM part""")
def default_excludes(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-9: the configuration's globs"""
    n = _n()
    path = F.concat(F.when(n % 4 == 0, "fixtures/").when(n % 4 == 1, "a/b/fixtures/").when(n % 4 == 2, "vendor/").otherwise("src/vendor/"), F.regexp_replace("p_name", " ", "/"))
    return load(spark, sf, "part").select("p_partkey", text.matches_globs(path, Config().excludePaths).alias("excluded"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'django' WHEN 1 THEN 'unity' WHEN 2 THEN 'godot' WHEN 3 THEN 'rails' WHEN 4 THEN NULL ELSE 'sinatra' END AS hint FROM part""")
def framework_hints(spark: SparkSession, sf: str) -> DataFrame:
    """FN-13"""
    m = (F.col("p_partkey") % 6 + 1).cast("int")
    of = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), m)
    content = F.concat(F.col("p_name"), F.lit("\n"), of("import Django", "  using UnityEngine.UI;", "extends Node", "Rails.app", "django", "Sinatra::Base"))
    return load(spark, sf, "part").select("p_partkey", text.framework_hint(content, of("python", "csharp", "gdscript", "ruby", "typescript", "ruby")).alias("hint"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN false ELSE p_partkey % 4 <> 1 END AS exported FROM part""")
def exported_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """FN-14"""
    n = _n()
    m = (n % 6 + 1).cast("int")
    of = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), m)
    name = F.concat(F.when((n % 6 == 5) & (n % 4 == 1), "_").otherwise(""), F.lit("run"), n)
    made = text.exported(of("typescript", "typescript", "csharp", "gdscript", "ruby", "python"), name, of("export function x", "function x", "public int X", "signal x", "def x", "def x"), of("function", "function", "method", "signal", "method", "function"), of("", "", "", "", "private", ""))
    return load(spark, sf, "part").select("p_partkey", made.alias("exported"))


@query(f"SELECT doc_id, len(list_intersect(list_distinct({_tokens_sql('text')}), ['rest', 'word', 'line'])) AS common FROM documents")
def token_overlap_counts(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-15, SET-4"""
    return load(spark, sf, "documents").select("doc_id", text.token_overlap(text.name_tokens(F.lit("rest_words lines")), F.col("text")).cast("long").alias("common"))
