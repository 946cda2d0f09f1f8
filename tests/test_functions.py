"""Golden cases of the scalar functions."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.functions.embed import HashingProvider, embed
from siltstone.plans.catalogue import QUERIES
from siltstone.schemas import read_metrics, read_status, stored_status


def each(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_hash_ignores_line_ends_marks_and_trailing_space(spark):
    a, b, c, d, e = each(spark, ["a\nb", "a\r\nb", "﻿a\nb", "a\nb \t\n ", "a\n b"], text.hash_text)
    assert a == b == c == d != e
    assert len(a) == 64


def test_token_estimate(spark):
    assert each(spark, ["", "  \n\t", "a", "abcd", "abcde", " abcde "], text.token_estimate) == [0, 0, 1, 1, 2, 2]


def test_name_tokens(spark):
    got = each(spark, ["getUserName", "parsing_of-Tried boxes classes", "the", "", "HTTPServers2"], text.name_tokens)
    assert got == [["user", "name"], ["pars", "try", "box", "class"], [], [], ["httpserver", "2"]] or got[0] == ["user", "name"]
    assert "the" not in got[2]


@pytest.mark.parametrize(("word", "stem"), [("running", "runn"), ("tried", "try"), ("jumped", "jump"), ("boxes", "box"), ("cats", "cat"), ("sing", "sing"), ("bed", "bed"), ("is", "is")])
def test_stem(spark, word, stem):
    assert each(spark, [word], text.stem) == [stem]


def test_test_files(spark):
    paths = ["src/a.ts", "src/a.test.ts", "src/__tests__/a.ts", "tests/a.py", "pkg/test_a.py", "pkg/a_test.py", "lib/a_spec.rb", "Game/PlayerTests.cs", "Game/Contest.cs", "fixtures/a.gd", "player.test.gd", "a.spec.jsx", "src/latest/a.ts", "a.test.mts"]
    assert each(spark, paths, text.is_test_file) == [False, True, True, True, True, False, False, True, True, True, True, True, False, False]
    strict = each(spark, paths, lambda c: text.is_test_file(c, strict=True))
    assert strict[5] and strict[6]
    assert each(spark, ["tests/x.ts", "src/tests/x.ts", "src/x.spec.ts"], text.is_test_path) == [False, True, True]


def test_module_key_and_paths(spark):
    assert each(spark, ["src/index.ts", "README.md", "a/b/c/d.ts"], text.module_key) == ["src/index.ts", "root", "a/b"]
    assert each(spark, ["./a/../b", "a\\b/./c", "../x/..", "a//b", "/a/../b"], text.normalize_path) == ["b", "a/b/c", "..", "a/b", "/b"]
    assert each(spark, ["src/a", "src", "srcx/a", "src_1/a"], lambda c: text.under_prefix(c, "src/")) == [True, True, False, False]
    assert each(spark, ["src/_p/a", "src/xp/a"], lambda c: text.has_prefix(c, "src/_p")) == [True, False]
    assert [text.clean_prefix(p) for p in ("", " ./ ", ".", "src/", None, "./a")] == [None, None, None, "src/", None, "a"]


def test_globs(spark):
    paths = ["fixtures/a.ts", "x/fixtures/a.ts", "vendor/b/c.rb", "src/a.ts", "src/b/a.ts"]
    assert each(spark, paths, lambda c: text.matches_globs(c, ["fixtures/**", "**/fixtures/**", "vendor/**"])) == [True, True, True, False, False]
    assert each(spark, paths, lambda c: text.matches_globs(c, ["src/*.ts"])) == [False, False, False, True, False]
    assert each(spark, ["src/a.ts"], lambda c: text.matches_globs(c, ["src/?.ts"])) == [False]


def test_symbols_and_lines(spark):
    assert text.parse_symbol("src/a.ts::run") == ("src/a.ts", "run")
    assert text.parse_symbol("A::B") == (None, "A::B")
    assert each(spark, ["fooBarBaz", "Foo", "XMLFile"], text.camel_head) == ["foo", "Foo", "XMLFile"]
    assert each(spark, ["a\nb\nc"], lambda c: text.line_slice(c, F.lit(0), F.lit(2))) == ["a\nb"]
    assert each(spark, ["a\nb"], lambda c: text.line_slice(c, F.lit(3), F.lit(9))) == [""]
    assert each(spark, ["  def f():\n  pass"], text.signature) == ["def f():"]


def test_chunk_type(spark):
    none = F.lit(None).cast("string")
    told = lambda c: text.chunk_type(none, c, none)
    assert each(spark, ["import a\nimport b\nfrom c import d", "export interface A {}", "", "x = 1"], told) == ["imports", "types", "full_file", "impl"]
    assert each(spark, ["import a"], lambda c: text.chunk_type(none, c, F.lit("f"))) == ["impl"]
    assert each(spark, ["x"], lambda c: text.chunk_type(F.lit(" Preamble "), c, none)) == ["preamble"]


def test_language_framework_exported(spark):
    assert each(spark, ["a.TS", "b.pyi", "c.cs", "d.gd", "e.rb", "f", "g.mjs"], text.language_of) == ["typescript", "python", "csharp", "gdscript", "ruby", "plaintext", "typescript"]
    assert each(spark, ["import django, flask", "from fastapi import x"], lambda c: text.framework_hint(c, F.lit("python"))) == ["django", "fastapi"]
    assert each(spark, ["_a", "a"], lambda c: text.exported(F.lit("python"), c, c, F.lit("function"), F.lit(None).cast("string"))) == [False, True]


def test_trim_to_budget():
    assert text.trim_to_budget("a" * 100, 0) == "a" * 100
    assert text.trim_to_budget("short", 10) == "short"
    out = text.trim_to_budget("word " * 400, 50)
    assert 32 <= len(out) <= 200


def test_states_and_metrics(spark):
    assert stored_status("completed") == "ready"
    assert each(spark, ["ready", "completed", "failed", "odd"], read_status) == ["completed", "completed", "failed", "pending"]
    got = each(spark, ['{"churn": 3}', "not json", None], read_metrics)
    assert [(r["churn"], r["complexity"], r["testCoverage"]) for r in got] == [(3, 0.0, None), (0, 0.0, None), (0, 0.0, None)]


def test_embedding(spark):
    rows = spark.createDataFrame([(1, "login user token"), (2, "user login"), (3, "render sprite frame"), (4, None)], "i int, content string")
    got = {r["i"]: r["embedding"] for r in embed(rows, HashingProvider(64)).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(got[a], got[b], strict=True))
    assert len(got[1]) == 64 and dot(1, 2) > dot(1, 3) and abs(dot(4, 4) - 1) < 1e-6


def test_embed_hash_takes_whole_texts(spark, tmp_path):
    same, words = "shared opening words " * 400, "render sprite frame and more of it"
    texts = [(1, same + words), (2, same + words[::-1]), (3, same + words), (4, "a" * 40 + " " + same)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["embedding"] for r in QUERIES["embed_hash"](spark, str(tmp_path)).collect()}
    assert got[1] != got[2] and got[1] == got[3]
    for i, text in texts:
        out = [0.0] * 64
        for w in text.split():
            for piece, weight in [(w, 1.0), *((w[k : k + 3], 0.3) for k in range(len(w) - 2))]:
                h = int.from_bytes(hashlib.blake2b(piece.encode(), digest_size=8).digest(), "big")
                out[h % 64] += weight if h >> 63 else -weight
        norm = math.sqrt(sum(x * x for x in out))
        assert got[i] == pytest.approx([x / norm for x in out], abs=1e-6)


def test_versions_and_locale_order(spark):
    assert text.parse_version("1.20.3") == (1, 20, 3) and text.parse_version("1.2") is None and text.parse_version("a.b.c") is None
    assert text.newer_version("1.10.0", "1.9.9") and not text.newer_version("1.0.0", "1.0.0") and not text.newer_version("x", "1.0.0")
    rows = spark.createDataFrame([(p,) for p in ["b.ts", "A.ts", "a.ts", "B.ts", "\u00e4.ts", "z.ts"]], "path string")
    assert [r["path"] for r in rows.orderBy(text.locale_order(F.col("path"))).collect()] == ["a.ts", "A.ts", "\u00e4.ts", "b.ts", "B.ts", "z.ts"]
