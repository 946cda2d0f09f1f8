"""Golden cases and brute-force twins of the operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import architecture, attribute, chunk, graph, lookup, resolve, vector
from siltstone.operators.extract import entry_points, extract, function_chunks, parse_file
from siltstone.operators.search import search
from siltstone.plans import render
from siltstone.plans.catalogue import QUERIES
from siltstone.sources import git, ignore, store


def test_top_k_order_filters_and_penalties(spark):
    rows = spark.createDataFrame(
        [("p", "s", "far", "src/a.ts", 1, 9, "h", "impl", "", [0.0, 1.0, 0.0]), ("p", "s", "near", "src/b.ts", 1, 9, "h", "impl", "", [1.0, 0.0, 0.0]), ("p", "s", "bad", "src/c.ts", 1, 9, "h", "impl", "", [float("nan"), 0.0, 0.0]), ("q", "s", "other", "src/d.ts", 1, 9, "h", "impl", "", [1.0, 0.0, 0.0])],
        "project_id string, snapshot_id string, chunk_id string, file_path string, start_line int, end_line int, content_hash string, chunk_type string, primary_symbol string, embedding array<float>",
    )
    mine = vector.prefilter(rows, project="p", snapshot="s", prefix="src/", chunk_types=[" impl "])
    assert [(r["chunk_id"], r["distance"], r["score"]) for r in vector.top_k(mine, [1, 0, 0], 1).collect()] == [("near", 0.0, 1.0)]
    assert vector.top_k(mine, [1, 0, 0], 9).count() == 2
    with pytest.raises(ValueError):
        vector.prefilter(rows, project="")
    score = vector.penalised(F.lit(0.8), F.lit("imports"), F.lit(True))
    assert abs(spark.range(1).select(score).first()[0] - 0.8 * 0.5 * 0.75) < 1e-12


def test_knn_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5))
    v[7] = v[3]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None), (100, [float("nan")] * 5)], "vec_id long, embedding array<double>")
    got = sorted((r["src"], r["dst"], r["rank"]) for r in vector.knn_graph(rows, 4, block_rows=17).collect())
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 9)
    want = sorted((i, j, k + 1) for i in range(60) for k, j in enumerate(sorted((j for j in range(60) if j != i), key=lambda j: (d[i, j], j))[:4]))
    assert got == want


def bfs(edges, seeds, depth):
    """One seed after the other, level by level; a node is reported unless it was expanded before."""
    out, expanded, frontier = set(), set(), sorted(seeds)
    for _ in range(depth):
        following = []
        for n in frontier:
            if n in expanded:
                continue
            expanded.add(n)
            for a, b in edges:
                if a == n and b not in expanded:
                    out.add(b)
                    following.append(b)
        frontier = following
    return out


@pytest.mark.parametrize("case", range(4))
def test_bfs_against_a_plain_search(spark, case):
    rng = random.Random(case)
    edges = [(rng.randrange(14), rng.randrange(14)) for _ in range(26)]
    seeds, depth = rng.sample(range(14), 1 + case % 3), 1 + case
    frame = spark.createDataFrame(edges, "src long, dst long")
    found = {r["node"] for r in graph.reachable(frame, spark.createDataFrame([(s,) for s in seeds], "node long"), depth).collect()}
    one_step = {b for a, b in edges if a in seeds}
    reach, level = set(), set(seeds)
    for _ in range(depth):
        level = {b for a, b in edges if a in level}
        reach |= level
    leak = {b for a, b in edges if a in seeds and b in seeds and a < b}
    assert found == (reach - set(seeds)) | leak
    if len(seeds) == 1:
        assert found == bfs(edges, seeds, depth) - set(seeds)
    assert one_step - set(seeds) <= found


FILES = [("apps/web/src/main.ts", "typescript"), ("apps/web/src/a.ts", "typescript"), ("packages/shared/src/index.ts", "typescript"), ("packages/ui/src/b.tsx", "typescript"), ("packages/ui/src/c.ts", "typescript"), ("tools/x/run.js", "javascript"), ("README.md", "")]
DEPS = [
    ("apps/web/src/main.ts", "@app/shared", "packages/shared/src/index.ts", "internal"),
    ("apps/web/src/a.ts", "./main", "apps/web/src/main.ts", "internal"),
    ("apps/web/src/a.ts", "react", None, "external"),
    ("packages/shared/src/index.ts", "zod", None, "external"),
    ("apps/web/src/main.ts", "node:path", None, "builtin"),
    ("apps/web/src/main.ts", "@/missing", None, "odd"),
]


def test_architecture(spark):
    files = spark.createDataFrame(FILES, "path string, language_id string")
    deps = spark.createDataFrame(DEPS, "from_path string, to_specifier string, to_path string, dependency_type string")
    made = architecture.summarise(files, deps)
    assert {r["language"]: r["files"] for r in made.file_stats.collect()} == {"typescript": 5, "javascript": 1, "unknown": 1}
    got = {(r["bucket"], r["from_module"]): r["targets"] for r in made.dependency_map().collect()}
    assert got == {("internal", "apps/web"): ["packages/shared"], ("external", "apps/web"): ["react"], ("external", "packages/shared"): ["zod"], ("builtin", "apps/web"): ["node:path"], ("unresolved", "apps/web"): ["@/missing"]}
    assert all(r["modules"] == 1 for r in made.summary().collect())
    assert [r["path"] for r in made.entry_points.collect()][0] == "apps/web/src/main.ts"
    assert "root" in {r["module"] for r in made.modules.collect()}
    less = architecture.summarise(files, deps, excludes=["packages/**"])
    assert ("internal", "apps/web") not in {(r["bucket"], r["from_module"]) for r in less.edges.collect()}
    under = architecture.under(made, files, "packages/ui/")
    assert {r["module"] for r in under.modules.collect()} == {"packages/ui"} and under.edges.count() == 0


def test_mutual_edges_and_tree(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 3), (4, 2), (2, 4), (2, 4)], "src int, dst int")
    assert {tuple(r) for r in graph.mutual_edges(edges).collect()} == {(1, 2), (2, 4)}
    tree = graph.subtree_counts(spark.createDataFrame([("a/b/x",), ("a/b/y",), ("a/z",), ("q",)], "path string"))
    assert {r["folder"]: (r["files"], r["children"]) for r in tree.collect()} == {"": (4, 2), "a": (3, 2), "a/b": (2, 2)}


def chunks_of(spark, content, made):
    rows = spark.createDataFrame([(content,)], "content string").select(F.inline(made(F.col("content")))).collect()
    return [(r["start_line"], r["end_line"], r["chunk_type"], r["primary_symbol"]) for r in rows]


def test_adaptive_chunks(spark):
    text = "\n".join(f"line {i}" for i in range(221))
    assert chunks_of(spark, text, lambda c: chunk.adaptive_chunks(c, F.lit("python"))) == [(1, 220, "module_section", None), (201, 221, "impl", None)]
    assert chunks_of(spark, text, lambda c: chunk.adaptive_chunks(c, F.lit("typescript"))) == [(1, 180, "module_section", None), (161, 221, "impl", None)]
    blank = "\n".join(["x"] * 200 + [""] * 21)
    assert [c[:2] for c in chunks_of(spark, blank, lambda c: chunk.adaptive_chunks(c, F.lit("python")))] == [(1, 220)]
    assert chunks_of(spark, "a\nb", lambda c: chunk.adaptive_chunks(c, F.lit("x"))) == [(1, 2, "full_file", None)]
    assert chunks_of(spark, " \n ", lambda c: chunk.adaptive_chunks(c, F.lit("x"))) == []


def test_module_and_single_chunks(spark):
    text = "\n".join(str(i) for i in range(201))
    assert [c[:2] for c in chunks_of(spark, text, chunk.module_chunks)] == [(0, 200), (180, 201)]
    second = spark.createDataFrame([(text,)], "c string").select(chunk.module_chunks(F.col("c"))[1]["content"]).first()[0]
    assert second.startswith("// ...\n180")
    assert chunks_of(spark, "a\nb", chunk.single_chunk) == [(0, 2, "full_file", None)]


def test_heuristic_chunks(spark):
    ts = "import a from 'a'\n\nexport class User {}\nexport function runTask() {\n}\n"
    assert chunks_of(spark, ts, lambda c: chunk.heuristic_chunks(c, "typescript")) == [(1, 1, "imports", None), (3, 3, "types", "User"), (4, 6, "impl", "runTask")]
    rb = "require 'x'\n\nclass App\n  def call\n  end\nend"
    assert chunks_of(spark, rb, lambda c: chunk.heuristic_chunks(c, "ruby")) == [(1, 1, "imports", None), (3, 3, "types", "App"), (4, 6, "impl", "call")]
    assert chunks_of(spark, "import os\nx = 1\ny = 2", lambda c: chunk.heuristic_chunks(c, "python")) == [(1, 1, "imports", None), (2, 3, "impl", None)]
    assert chunks_of(spark, "x", lambda c: chunk.heuristic_chunks(c, "plaintext")) == []
    cs = "using System;\npublic interface IThing {}\npublic class Thing {\n  public void Run() {\n  }\n}"
    assert [c[2:] for c in chunks_of(spark, cs, lambda c: chunk.heuristic_chunks(c, "csharp"))] == [("imports", None), ("types", "IThing"), ("impl", "Thing"), ("impl", "Run")]


def test_windows_cover_every_line(spark):
    rows = spark.createDataFrame([(i, "\n".join(["x"] * i)) for i in range(1, 60)], "n int, text string")
    got = chunk.line_windows(rows, size=7, overlap=3).groupBy("n").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("start_line", "end_line")))).alias("lines"))
    assert all(len(r["lines"]) == r["n"] for r in got.collect())


SYMBOLS = "project_id string, snapshot_id string, file_path string, kind string, name string, exported boolean, start_line int, end_line int, signature string"


def test_search_attribution(spark):
    symbols = spark.createDataFrame([("p", "s", "auth.ts", "method", "loginAsUser", True, 2, 4, None), ("p", "s", "auth.ts", "method", "federateCallback", True, 6, 8, None)], SYMBOLS)
    vectors = spark.createDataFrame([("p", "s", "c1", "auth.ts", 2, 8, "h", "impl", "runTask", [1.0, 0.0])], "project_id string, snapshot_id string, chunk_id string, file_path string, start_line int, end_line int, content_hash string, chunk_type string, primary_symbol string, embedding array<float>")
    contents = spark.createDataFrame([("auth.ts", "\n".join(["class A {", "loginAsUser() {", "", "}", "", "federateCallback() {", "  return handleMagicLinkLogin();", "}"]))], "file_path string, content string")
    ask = lambda q, **k: search(vectors, symbols, q, [1.0, 0.0], project="p", snapshot="s", contents=contents, **k).collect()
    assert ask("magic link login")[0]["symbol"] == "federateCallback"
    assert ask("payments")[0]["symbol"] == "runTask"
    assert ask("payments", min_score=1.0)[0]["score"] == 1.0
    with pytest.raises(ValueError):
        ask("x", min_score=2)


def test_find_symbols_and_explain(spark):
    rows = [("p", "s", "src/a.ts", "function", "run", True, 1, 2, "run()"), ("p", "s", "src/a.ts", "class", "Runner", True, 4, 9, "class Runner"), ("p", "s", "src/b.ts", "class", "run", True, 1, 2, "class run"), ("p", "s", "tests/c.ts", "function", "run", True, 1, 2, "run()")]
    symbols = spark.createDataFrame(rows, SYMBOLS)
    deps = spark.createDataFrame(DEPS + [("x.ts", "./src/a", "src/a.ts", "internal"), ("src/a.ts", "./src/b", "src/b.ts", "internal")], "from_path string, to_specifier string, to_path string, dependency_type string")
    assert [(r["file_path"], r["name"]) for r in lookup.find_symbols(symbols, "run").collect()] == [("src/b.ts", "run"), ("src/a.ts", "run")]
    assert [r["name"] for r in lookup.find_symbols(symbols, "runn").collect()] == ["Runner"]
    got = {r["file_path"]: (r["callers"], r["callees"]) for r in lookup.explain(symbols, deps, "run").collect()}
    assert got == {"src/a.ts": (["x.ts"], ["src/b.ts"]), "src/b.ts": (["src/a.ts"], [])}
    assert [r["name"] for r in lookup.suggestions(symbols, "runEverything").collect()] == ["Runner", "run", "run", "run"]
    both = lookup.deps(spark.createDataFrame([("src/a.ts",), ("src/b.ts",), ("x.ts",)], "path string"), deps, "src/b.ts", depth=2)
    assert [(r["direction"], r["node"]) for r in both.collect()] == [("callers", "src/a.ts"), ("callers", "x.ts")]


def test_resolver(spark):
    files = spark.createDataFrame([(p,) for p in ["src/utils.ts", "src/lib/index.ts", "pkg/mod/__init__.py", "pkg/core.py", "Game/Core/Player.cs", "scripts/hero.gd", "lib/app.rb"]], "path string")
    asked = [("./utils.js", "src/a.ts"), ("./lib", "src/a.ts"), ("./missing", "src/a.ts"), ("react", "src/a.ts"), ("node:fs", "src/a.ts"), (".core", "pkg/x.py"), ("pkg.mod.thing", "y.py"), ("os", "y.py"), ("Game.Core", "z.cs"), ("System.Text", "z.cs"), ("res://scripts/hero.gd", "m.gd"), ("Hero", "m.gd"), ("hero", "m.gd"), ("../lib/app", "bin/r.rb"), ("json", "bin/r.rb")]
    got = {(r["to_specifier"], r["from_path"]): (r["to_path"], r["dependency_type"]) for r in resolve.resolve(spark.createDataFrame(asked, "to_specifier string, from_path string"), files).collect()}
    assert [got[a] for a in asked] == [("src/utils.ts", "internal"), ("src/lib/index.ts", "internal"), (None, "internal"), (None, "external"), (None, "builtin"), ("pkg/core.py", "internal"), ("pkg/mod/__init__.py", "internal"), (None, "builtin"), ("Game/Core/Player.cs", "internal"), (None, "external"), ("scripts/hero.gd", "internal"), (None, "external"), ("scripts/hero.gd", "internal"), ("lib/app.rb", "internal"), (None, "builtin")]


def test_extractors_and_errors(spark):
    files = spark.createDataFrame([("a.py", "import os\n\nclass A(B):\n    def f(self):\n        pass\n"), ("b.ts", "import x from './x'\nexport class K {\n  run(a: string): void {\n  }\n}\nexport type T = { a: 1 }\n"), ("c.txt", "hello"), ("d.py", "def broken(:\n  import os\n"), ("e.rb", None)], "path string, content string")
    got = {r["path"]: r for r in extract(files).collect()}
    assert [(s["kind"], s["name"], s["container_name"]) for s in got["a.py"]["symbols"]] == [("class", "A", None), ("method", "f", "A")]
    assert [(s["kind"], s["name"]) for s in got["b.ts"]["symbols"]] == [("class", "K"), ("method", "run"), ("type", "T")]
    assert [i["specifier"] for i in got["b.ts"]["imports"]] == ["./x"]
    assert got["c.txt"]["symbols"] == [] and all(r["error"] is None for r in got.values())
    assert parse_file("x.py", "from a import (\n b,\n c)\n").imports[0].specifier == "a"
    assert [c.chunk_type for c in function_chunks("import a from 'a'\ninterface I {}\nexport function f() {\n}\n")] == ["imports", "preamble", "declaration"]
    ruby = parse_file("x.rb", "class A\n  private\n  def hidden\n  end\n  public\n  def seen\n    if x\n    end\n  end\nend\n")
    assert [(s.name, s.exported) for s in ruby.symbols] == [("A", True), ("hidden", False), ("seen", True)]
    cs = parse_file("x.cs", "using A.B;\npublic class P : MonoBehaviour {\n  private void Start() { }\n  public int Get(int x) => x;\n}\n")
    assert [(s.kind, s.name, s.exported) for s in cs.symbols] == [("class", "P", True), ("method", "Start", False), ("method", "Get", True)]


def test_entry_points(spark):
    files = spark.createDataFrame([("src/main.ts", "typescript"), ("a/b/App.tsx", "typescript"), ("x/util.ts", "typescript"), ("manage.py", "python"), ("y/z.py", "python")], "path string, language_id string")
    assert [r["path"] for r in entry_points(files).collect()] == ["a/b/App.tsx", "src/main.ts", "manage.py"]


def test_git_parsers():
    got = git.parse_name_status("A\tnew.ts\nM\tupdated.ts\nD\tremoved.ts\nR100\told.ts\trenamed.ts\n")
    assert got == git.Changes(("new.ts", "renamed.ts"), ("updated.ts",), ("old.ts", "removed.ts"))
    assert git.parse_porcelain("M a.ts\n?? b.ts\n D c.ts\nR  d.ts -> e.ts\nA  f.ts\n") == git.Changes(("b.ts", "e.ts", "f.ts"), ("a.ts",), ("c.ts", "d.ts"))
    assert git.parse_numstat("10\t2\ta.ts\n3\t1\ta.ts\n-\t-\tb.png\n") == {"a.ts": 16, "b.png": 0}
    merged = git.merge_changes(git.Changes(added=("a",), deleted=("b",)), git.Changes(modified=("a",), added=("b",)), git.Changes(deleted=("c",)))
    assert merged == git.Changes(("a", "b"), (), ("c",))


def test_merge_log_against_the_fold(spark):
    rng = random.Random(5)
    log = [(rng.randrange(40), i, rng.choice(["added", "modified", "deleted"])) for i in range(300)]
    want: dict[int, str] = {}
    for key, _, state in log:
        want[key] = "added" if state == "modified" and want.get(key) == "added" else state
    got = git.merge_log(spark.createDataFrame(log, "key int, at int, state string"), key="key", state="state", order="at")
    assert {r["key"]: r["state"] for r in got.collect()} == want


def test_ignore_rules(spark):
    rules = ignore.read_patterns("# x\n\n!keep.js\nout/\ntmp?x\n")
    paths = ["node_modules/lodash/index.js", "src/index.ts", "app/main.pyc", "public/app.js", "keep.js", "out/a", "a/app.min.js", "tmpax"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string")
    assert [r[0] for r in rows.orderBy("i").select(ignore.is_ignored(F.col("path"), rules)).collect()] == [True, False, True, False, False, True, True, False]


def test_stale_and_kept_snapshots(spark):
    now = 10_000_000
    rows = spark.createDataFrame([("a", "indexing", now - 31 * 60_000, None), ("b", "indexing", now - 60_000, None), ("c", "completed", 0, None)], "id string, status string, created_at long, failure_reason string")
    assert {r["id"]: r["status"] for r in store.mark_stale(rows, now).collect()} == {"a": "failed", "b": "indexing", "c": "completed"}
    assert {r["id"] for r in store.kept_snapshots(rows, "c", now).collect()} == {"b", "c"}


def test_attribution_top_one_is_stable(spark):
    chunks = spark.createDataFrame([("f", 1, 10)], "file_path string, start_line int, end_line int")
    symbols = spark.createDataFrame([("f", "class", "Big", 1, 40), ("f", "function", "late", 6, 8), ("f", "function", "early", 2, 30), ("f", "function", "around", 0, 50)], "file_path string, kind string, name string, start_line int, end_line int")
    best = attribute.primary_symbols(chunks, symbols, keys=["file_path"], chunk_key=["file_path", "start_line", "end_line"])
    assert [r["s_name"] for r in best.collect()] == ["early"]


def test_dependents_of_links_of_any_length(spark, tmp_path):
    pages = [(1, "http://a.org/x", '<a href="/p"><a href="/long/path.html">'), (2, "http://b.org/y", '<a href="/long/path.html">'), (3, "http://c.org/", "none")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["href"]: r["dependents"] for r in QUERIES["dependents_lookup"](spark, str(tmp_path)).collect()}
    assert got == {"/p": "a.org", "/long/path.html": "a.org,b.org"}


def typescript_chunks(text, **sizes):
    from siltstone.operators import extract as x

    old = x._merge_segments
    try:
        x._merge_segments = lambda *given: old(*given, **sizes)
        return x.read_typescript(text, "inline.ts").chunks
    finally:
        x._merge_segments = old


def test_typescript_chunks_are_cut_and_merged():
    preamble = 'import { readFile } from "node:fs/promises";\nimport path from "node:path";\ntype GitDiff = { added: string[]; };\ntype IndexPlan = { ready: boolean; };\nconst value = readFile;'
    assert [c.chunk_type for c in typescript_chunks(preamble, target=200, most=200)] == ["preamble", "impl"]
    body = "\n".join(f'  const line{i} = "{"x" * 24}{i:02d}";' for i in range(40))
    cut = typescript_chunks("export function giantFunction() {\n" + body + "\n  return line0;\n}", target=30, most=40)
    assert len(cut) > 1 and all(c.chunk_type == "impl" and -(-len(c.content) // 4) <= 40 for c in cut)
    assert all(b.start_line <= a.end_line for a, b in zip(cut, cut[1:], strict=False)) and cut[-1].end_line == 43
    small = "\n".join(f"const value{i} = {i};" for i in range(8))
    (one,) = typescript_chunks(small, target=80, most=80)
    assert (one.start_line, one.end_line) == (1, 8)
    assert [(c.start_line, c.end_line) for c in typescript_chunks("\n".join(f"const v{i} = {i};" for i in range(100)), target=20, most=40)][:2] == [(1, 5), (6, 10)]
    assert typescript_chunks("  \n\n", target=80, most=80) == []


class Server:
    """A model server in this process: answers /api/embed unless told not to."""

    def __init__(self, refuse):
        import json
        import threading
        from http.server import BaseHTTPRequestHandler, HTTPServer

        asked = self.asked = []

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                asked.append((self.path, body.get("input") or body.get("prompt")))
                code = refuse(self.path, body)
                self.send_response(code)
                self.end_headers()
                answer = {"embeddings": [[1.0, 0.0] for _ in body["input"]]} if "input" in body else {"embedding": [0.0, 1.0]}
                self.wfile.write(json.dumps(answer).encode() if code == 200 else b"{}")

            def log_message(self, *_):
                pass

        self.server = HTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"


def test_model_server_fallbacks():
    from siltstone.functions.embed import HttpProvider

    old = Server(lambda path, body: 404 if path == "/api/embed" else 200)
    assert HttpProvider(old.url, "m", 2).embed(["a", "b"]) == [[0.0, 1.0], [0.0, 1.0]]
    assert old.asked == [("/api/embed", ["a", "b"]), ("/api/embeddings", "a"), ("/api/embeddings", "b")]
    tight = Server(lambda path, body: 400 if len(body["input"][0]) > 300 else 200)
    assert HttpProvider(tight.url, "m", 2, context=80).embed(["word " * 200]) == [[1.0, 0.0]]
    assert len(tight.asked) > 1


def test_file_budget_is_the_renderer_s(spark):
    paths = ["z.ts", "a/d.ts", "a/b/c/x.ts", "a/b/c/y.ts", "a/b.ts", "k/l.ts", "a.ts"]
    for most in (0, 1, 3, 4, 6, 100):
        lines = render.tree_lines(render.build_tree(paths), max_files=most)
        got = lookup.tree_budget(spark.createDataFrame([(p,) for p in paths], "path string"), most).collect()
        shown = [line.strip() for line in lines if line.strip().endswith(".ts")]
        assert sum(r["shown"] for r in got) == len(shown) and sum(r["shown"] + r["hidden"] for r in got) == len(paths)
        want = {}
        for p in ["a/b/c/x.ts", "a/b/c/y.ts", "a/b.ts", "a/d.ts", "k/l.ts", "a.ts", "z.ts"][:most]:
            want[p.rpartition("/")[0]] = want.get(p.rpartition("/")[0], 0) + 1
        assert {r["folder"]: r["shown"] for r in got if r["shown"]} == want


def test_commit_hook_is_added_once(tmp_path):
    assert not git.install_hook(str(tmp_path), "x")
    (tmp_path / ".git" / "hooks").mkdir(parents=True)
    hook = tmp_path / ".git" / "hooks" / "post-commit"
    hook.write_text("#!/bin/sh\necho mine\n")
    assert git.install_hook(str(tmp_path), "siltstone index") and not git.install_hook(str(tmp_path), "siltstone index")
    assert hook.read_text().startswith("#!/bin/sh\necho mine\n") and hook.read_text().count("siltstone index") == 1 and hook.stat().st_mode & 0o111


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 5))
    rows = [(i, v[i].tolist()) for i in range(60)] + [(100, None), (101, []), (102, [float("nan")] * 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    far = np.round(1 - unit @ unit.T, 9)
    np.fill_diagonal(far, np.inf)
    want = {(i, int(j), r + 1) for i in range(60) for r, j in enumerate(np.argsort(far[i], kind="stable")[:4])}
    for block in (7, 1000):
        got = vector.knn_graph(frame, 4, block_rows=block).collect()
        assert {(r["src"], r["dst"], r["rank"]) for r in got} == want
    asked = vector.knn_graph(frame, 4, block_rows=7, queries=F.col("vec_id") % 10 == 0)
    assert {(r["src"], r["dst"], r["rank"]) for r in asked.collect()} == {w for w in want if w[0] % 10 == 0}
