"""A small project, indexed, queried, changed and indexed again."""

import json
import os

import pytest

from siltstone.engine import Engine
from siltstone.plans import render
from siltstone.sources.config import Config, Registry, project_root, read_options
from siltstone.sources.files import scan_files
from siltstone.sources.log import log_to
from siltstone.sources.store import Store

FILES = {
    "src/auth/login.ts": "import { hash } from '../lib/hash';\n\nexport class LoginService {\n  loginAsUser(name: string): boolean {\n    return hash(name) !== '';\n  }\n}\n",
    "src/lib/hash.ts": "import crypto from 'crypto';\n\nexport function hash(text: string): string {\n  return text;\n}\n",
    "src/lib/noise.ts": "export const sprites = ['a', 'b'];\n\nexport function renderSprite(frame: number) {\n  return sprites[frame];\n}\n",
    "src/main.ts": "import { LoginService } from './auth/login';\nimport React from 'react';\n\nexport function main() {\n  return new LoginService();\n}\n",
    "tools/report.py": "import os\n\n\nclass Report(Base):\n    def write_summary(self):\n        return os.getcwd()\n",
    "node_modules/x/index.js": "module.exports = 1\n",
    "secret/skip.ts": "export const a = 1\n",
    ".gitignore": "secret/\n",
    "fixtures/f.ts": "export function fixture() {}\n",
}


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, content in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    return root


def test_index_query_change(spark, project, tmp_path):
    engine = Engine(spark, str(project), Store(spark, str(tmp_path / "store")), "demo")
    with pytest.raises(LookupError):
        engine.status()
    assert {r["change"]: r["n"] for r in engine.dry_run().collect()} == {"added": 6}
    first = engine.index()
    assert {r["path"] for r in engine.table("files").collect()} == {n for n in FILES if not n.startswith((".git", "node_modules", "secret"))}
    assert engine.index() == first, "nothing changed"
    deps = {(r["from_path"], r["to_specifier"]): (r["to_path"], r["dependency_type"]) for r in engine.table("dependencies").collect()}
    assert deps[("src/main.ts", "./auth/login")] == ("src/auth/login.ts", "internal")
    assert deps[("src/main.ts", "react")] == (None, "external") and deps[("src/lib/hash.ts", "crypto")] == (None, "builtin")
    found = engine.search("login as user", k=3, min_score=0.0).collect()
    assert found[0]["file_path"] == "src/auth/login.ts" and found[0]["symbol"] == "loginAsUser"
    assert render.search_lines(found)[0].endswith("loginAsUser")
    assert [(r["direction"], r["node"]) for r in engine.deps("src/lib/hash.ts", depth=2).collect()] == [("callers", "src/auth/login.ts"), ("callers", "src/main.ts")]
    shown = engine.explain("LoginService").collect()
    assert shown[0]["callers"] == ["src/main.ts"] and shown[0]["callees"] == ["src/lib/hash.ts"]
    assert "class LoginService src/auth/login.ts:3" in render.explain_lines(shown)[0]
    assert "fixtures/f.ts" not in {r["path"] for r in engine.structure().collect()}
    assert {r["name"] for r in engine.structure(prefix="tools/").collect()} == {"Report", "write_summary"}
    made = engine.architecture()
    assert {r["language"]: r["files"] for r in made.file_stats.collect()} == {"typescript": 4, "python": 1}
    lines = render.architecture_lines(made.file_stats.collect(), made.entry_points.collect(), made.dependency_map().collect(), made.cycles.collect())
    assert any("src/main.ts -> src/auth" in line for line in lines)

    (project / "src/lib/noise.ts").unlink()
    (project / "src/lib/extra.ts").write_text("import { hash } from './hash';\nexport const extra = () => hash('x');\n")
    second = engine.index()
    assert second != first
    paths = {r["path"] for r in engine.table("files").collect()}
    assert "src/lib/noise.ts" not in paths and "src/lib/extra.ts" in paths and "src/main.ts" in paths
    assert {r["file_path"] for r in engine.table("chunks").collect()} == paths
    assert [r["id"] for r in engine.store.snapshots().collect()] == [second]
    assert {r["what"]: r["n"] for r in engine.status().collect()}["files"] == 6


def test_reads_see_changes_of_the_working_tree(spark, tmp_path):
    root = tmp_path / "p"
    (root / "src").mkdir(parents=True)
    (root / "src/a.ts").write_text("import x from 'x';\n\nexport class Parser {\n  handle(text: string) {\n    return magicLink(text);\n  }\n}\n")
    engine = Engine(spark, str(root), Store(spark, str(tmp_path / "store")), "demo", config=Config(skipImportChunksInVectors=True))
    first = engine.index()
    assert engine.refresh() == first, "nothing changed"
    assert {r["chunk_type"] for r in engine.table("chunks").collect()} >= {"imports"} and "imports" not in {r["chunk_type"] for r in engine.table("vectors").collect()}
    assert engine.search("magic link", min_score=0.0).collect()[0]["symbol"] == "handle", "told from the body"
    (root / "src/b.ts").write_text("export function freshlyWritten() {}\n")
    assert [r["name"] for r in engine.explain("freshlyWritten").collect()] == ["freshlyWritten"]
    assert engine.store.latest_snapshot("demo") != first
    (root / "src/b.ts").unlink()
    assert "freshlyWritten" not in {r["name"] for r in engine.structure().collect()}
    still = Engine(spark, str(root), engine.store, "demo", auto_refresh=False)
    (root / "src/c.ts").write_text("export function unseen() {}\n")
    assert still.explain("unseen").count() == 0


def test_store_upserts_pages_and_crashed_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    old, new = store.create_snapshot("p", now_ms=1000), store.create_snapshot("p", now_ms=10_000_000)
    row = "project_id string, snapshot_id string, chunk_id string, file_path string, start_line int, end_line int, content_hash string, chunk_type string, primary_symbol string, embedding array<float>"
    rows = lambda snapshot, *ids: spark.createDataFrame([("p", snapshot, i, f, 1, 2, h, "impl", None, [1.0]) for i, f, h in ids], row)
    store.upsert("vectors", rows(old, ("a", "x", "1"), ("b", "y", "1")), ["chunk_id"])
    store.upsert("vectors", rows(new, ("a", "x", "1")), ["chunk_id"])
    store.upsert("vectors", rows(old, ("b", "y", "2"), ("c", "z", "1")), ["chunk_id"])
    assert sorted((r["chunk_id"], r["content_hash"]) for r in store.read("vectors", "p", old).collect()) == [("a", "1"), ("b", "2"), ("c", "1")]
    assert store.read("vectors", "p", new).count() == 1
    assert store.fail_stale("p", now_ms=10_000_000 + 60_000) == [old]
    assert {r["id"]: r["status"] for r in store.snapshots().collect()} == {old: "failed", new: "indexing"}
    assert [r["id"] for r in store.list_snapshots("p", 1).collect()] == [new] and [r["id"] for r in store.list_snapshots("p", 5, 1).collect()] == [old]
    store.remove_project("p")
    assert store.snapshots().count() == 0 and store.read("vectors", "p", new).count() == 0


def test_scan_leaves_ignored_folders_out(spark, tmp_path):
    for name in ("a.ts", "node_modules/x.ts", "lib/node_modules/y.ts", "lib/b c.py", "lib/d.txt", "build/e.ts", "keep/f.rb"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    got = scan_files(spark, str(tmp_path), ignore_text="keep/\n")
    assert {r["path"] for r in got.collect()} == {"a.ts", "lib/b c.py"}
    listed = scan_files(spark, str(tmp_path), content=False)
    assert {r["path"] for r in listed.collect()} == {"a.ts", "lib/b c.py", "keep/f.rb"} and listed.columns == ["path", "mtime_ms"]


def test_failed_index_keeps_the_old_snapshot(spark, project, tmp_path):
    class Broken:
        size = 4

        def embed(self, texts):
            raise RuntimeError("no model")

    store = Store(spark, str(tmp_path / "store"))
    good = Engine(spark, str(project), store, "demo").index()
    with pytest.raises(Exception, match="no model"):
        Engine(spark, str(project), store, "demo", provider=Broken()).index(full=True)
    assert store.latest_snapshot("demo") == good
    assert {r["status"] for r in store.snapshots().collect()} == {"completed", "failed"}


def test_config_registry_and_root(tmp_path):
    got = Config.read(json.dumps({"searchMinScore": 2, "indexBatchSize": 4, "excludePaths": ["a"], "logLevel": 3, "odd": 1}))
    assert (got.searchMinScore, got.indexBatchSize, got.excludePaths, got.logLevel) == (0.55, 4, ["a"], "error")
    assert Config.read("not json") == Config() == Config.read(Config().write())
    registry = Registry(str(tmp_path / "r" / "projects.json"))
    registry.add(str(tmp_path), name="one")
    registry.add(str(tmp_path), name="two")
    registry.add(str(tmp_path / "gone"))
    assert [p.get("name") for p in registry.list()] == ["two", None]
    assert registry.clean() == [os.path.realpath(tmp_path / "gone")] and len(registry.list()) == 1
    (tmp_path / ".git").mkdir()
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert project_root(str(tmp_path / "a" / "b")) == str(tmp_path)


def test_rendering():
    tree = render.build_tree(["a/b/c/x.ts", "a/b/c/y.ts", "a/d.ts", "z.ts"])
    assert render.tree_lines(tree) == ["a/", "  b/c/", "    x.ts", "    y.ts", "  d.ts", "z.ts"]
    assert render.tree_lines(tree, max_depth=1) == ["a/", "  b/c/ (2 files, 2 entries)", "  d.ts", "z.ts"]
    assert render.tree_lines(tree, max_files=1)[-1] == "... 3 more files"
    many = {f"packages/shared/components/{n}": "" for n in ("one.ts", "two.ts", "three.ts")}
    assert render.grouped(many)[0] == "packages/shared/components/"
    assert render.grouped({"a": "", "b": ""}) == ["a", "b"]


def test_options():
    assert read_options({}) == {"min_score": 0.55, "max_depth": None, "max_files": None, "depth": 1}
    assert read_options({"min_score": "0.2", "max_depth": "0", "max_files": "3", "depth": "9"}, Config(searchMinScore=0.1)) == {"min_score": 0.2, "max_depth": 0, "max_files": 3, "depth": 5}
    for bad in ({"min_score": "2"}, {"min_score": "nan"}, {"max_depth": "-1"}, {"max_files": "0"}, {"max_files": "x"}):
        with pytest.raises(ValueError, match="out of range"):
            read_options(bad)


def test_log_keeps_its_last_lines(tmp_path, capsys):
    logger = log_to(str(tmp_path), "info", "test")
    for i in range(130):
        logger.info("line %d", i)
    logger.debug("not this one")
    lines = (tmp_path / "log.txt").read_text().splitlines()
    assert len(lines) == 100 and lines[0].endswith("[test] [INFO] line 30") and lines[-1].endswith("line 129")
    log_to(str(tmp_path / "gone"), "odd", "test").error("to the console")
    assert "to the console" in capsys.readouterr().out


def test_transaction_is_seen_whole_or_not_at_all(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = lambda s, *paths: spark.createDataFrame([("p", s, x, "h", 0, 1, "python") for x in paths], "project_id string, snapshot_id string, path string, sha256 string, mtime_ms long, size long, language_id string")
    with store.transaction("p") as first:
        store.write("files", rows(first, "a.py"))
        assert store.latest_snapshot("p") is None
    assert store.latest_snapshot("p") == first
    with pytest.raises(RuntimeError, match="halfway"), store.transaction("p") as second:
        store.write("files", rows(second, "b.py"))
        raise RuntimeError("halfway")
    assert store.latest_snapshot("p") == first and store.read("files", "p", second).count() == 0
    assert {r["id"]: r["failure_reason"] for r in store.snapshots().collect()} == {first: None, second: "halfway"}
