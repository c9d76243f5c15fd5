"""A small source tree, indexed end to end."""

import subprocess
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from spindrift.operators import history, impact, layers, lookup, rules, search, summary
from spindrift.operators.project import Project
from spindrift.sources import config, git, python_source

MAIN = '''"""Entry point."""
import os
from pkg.tools import Store, fold


class App:
    """Runs the thing."""

    def __init__(self):
        self.store = Store()

    def run(self):
        self._setup()
        return fold(self.store.load())

    def _setup(self):
        print(os.sep)


def unused_thing(x: int, y=2, *rest, key=None, **more) -> int:
    return x


def main():
    app = App()
    app.run()
'''
TOOLS = '''from functools import reduce


class Store:
    def load(self):
        """Load rows from the store."""
        return [1, 2]

    @property
    def size(self):
        return len(self.load())


def fold(rows):
    total = 0
    for r in rows:
        if r and r > 1 or r < 0:
            total += r
    return reduce(lambda a, b: a + b, rows)


async def later(button):
    button.clicked.connect(self.on_click)
'''
BIG = "def big(x):\n" + "".join(f"    if x == {i}:\n        x += 1\n" for i in range(30)) + "    return x\n\n\nbig(1)\n"


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root, store = tmp_path_factory.mktemp("tree"), tmp_path_factory.mktemp("store")
    (root / "pkg").mkdir()
    (root / "__pycache__").mkdir()
    (root / "main.py").write_text(MAIN)
    (root / "pkg" / "tools.py").write_text(TOOLS)
    (root / "pkg" / "big.py").write_text(BIG)
    (root / "pkg" / "broken.py").write_text("def (:\n")
    (root / "pkg" / "ignored.py").write_text("x = 1\n")
    (root / "__pycache__" / "c.py").write_text("x = 1\n")
    (root / ".gitignore").write_text("ignored.py\n")
    (root / ".spindrift.yaml").write_text("project:\n  name: demo\nlayers:\n  - name: top\n    paths: [main.py]\n  - name: pkg\n    paths:\n      - pkg/**\n    allowed_imports: []\ncontext:\n  inline_source_max_lines: 3\n")
    for args in (["init", "-q"], ["add", "-A"], ["-c", "user.name=t", "-c", "user.email=t@example.invalid", "commit", "-qm", "first"]):
        subprocess.run(["git", "-C", str(root), *args], check=True)
    p = Project(spark, str(root), f"file://{store}")
    p.rebuild()
    return p


def names(df, column="name"):
    return [r[column] for r in df.collect()]


def test_scan_and_stats(project):
    s = summary.stats(project.index).first()
    assert (s["files"], s["parse_errors"], s["classes"], s["functions"]) == (4, 1, 2, 10)
    main = project.index.files.where("rel_path = 'main.py'").first()
    assert main["line_count"] == MAIN.count("\n") + 1 and main["language"] == "python"


def test_parser_rows():
    rows = python_source.parse(MAIN, "main.py")
    by = {r["name"]: r for r in rows if r["tag"] == "symbol"}
    assert by["run"]["kind"] == "method" and by["main"]["kind"] == "function"
    assert '"name": "x", "type": "int"' in by["unused_thing"]["params_json"] and '"**more"' in by["unused_thing"]["params_json"] and by["unused_thing"]["return_type"] == "int"
    imports = [(r["return_type"], r.get("docstring")) for r in rows if r["tag"] == "import"]
    assert imports == [("os", None), ("pkg.tools", "Store"), ("pkg.tools", "fold")]  # Q6: the module and the name are kept apart
    calls = {r["name"] for r in rows if r["tag"] == "call"}
    assert {"self._setup", "fold", "self.store.load", "App", "app.run"} <= calls
    tools = python_source.parse(TOOLS, "t.py")
    assert {"button.clicked.connect", "self.on_click"} <= {r["name"] for r in tools if r["tag"] == "call"}
    fold = next(r for r in tools if r["tag"] == "symbol" and r["name"] == "fold")
    assert fold["complexity"] == 5  # for, if, and, or
    assert next(r for r in tools if r.get("name") == "later" and r["tag"] == "symbol")["is_async"] == 1
    assert python_source.parse("def (:", "x.py")[0]["tag"] == "error"


def test_links(project):
    ix = project.index
    run = ix.located_symbols().where("name = 'run'").first()
    assert run["parent_name"] == "App" and run["qualified_name"] == "App.run"
    site = lookup.callers(ix, "fold").first()
    assert (site["rel_path"], site["caller_name"], site["caller_class"]) == ("main.py", "run", "App")
    assert ("big", None) in [(r["callee_expr"], r["caller_name"]) for r in lookup.callers(ix, "big").collect()]


def test_context_of_a_method(project):
    found = lookup.context(project.index, "run", source=project.scan(), inline_lines=3)
    assert {(r["callee_expr"], r["category"]) for r in found["callees"].collect()} == {("self._setup", "self_method"), ("fold", "local"), ("self.store.load", "self_attr_method")}
    assert names(found["siblings"]) == ["__init__", "_setup"]
    assert found["source"].first()["source"].startswith("    def run(self):")


def test_context_of_a_class(project):
    found = lookup.context(project.index, "Store")
    assert names(found["members"]) == ["load", "size"]
    assert {(r["via_member"], r["rel_path"]) for r in found["callers"].collect()} == {("__init__", "main.py"), ("load", "main.py")}
    assert names(found["siblings"]) == ["fold", "later"]  # Q1: of the same file


def test_fuzzy_context_uses_the_resolved_name_q2(project):
    found = lookup.context(project.index, "unused_th")
    assert found["symbol"]["name"] == "unused_thing"
    assert lookup.context(project.index, "no_such_name") is None


def test_impact(project):
    found = impact.impact(project.index, "fold")
    assert names(found["direct"], "caller_name") == ["run"] and names(found["transitive"], "caller_name") == ["main"]
    assert found["score"].first()["score"] == 1.5 and "kind" not in found
    of_class = impact.impact(project.index, "App")
    assert of_class["kind"] == "class" and names(of_class["direct"], "caller_name") == ["main", "main"]


def test_search(project):
    first = search.search(project.index, "main").first()
    assert (first["name"], first["score"]) == ("main", 100.0)
    assert "load" in names(search.search(project.index, "loading rows"))  # stemmed docstring
    assert search.search_symbols(project.index, "c++").count() == 0


def test_rules(project):
    assert names(rules.dead_symbols(project.index)) == ["unused_thing"]  # Q4: later() is never called, but calls something
    assert names(project.findings(rule_id="LARGE_SYMBOL"), "message") == ["big: 61 lines, complexity 31"]
    project.add_rule(rules.Rule("SHORT", "Short name", "SELECT file_id, name, line_start FROM symbols WHERE LENGTH(name) <= 3 AND kind LIKE 'FUNC%'", "error"))
    assert project.run_rules("SHORT") == {"SHORT": 1}
    assert project.run_rules("SHORT") == {"SHORT": 1} and project.findings(rule_id="SHORT").count() == 1  # Q10: findings are replaced
    assert project.findings().first()["severity"] == "error"
    project.rate("SHORT", True)
    assert [r.asDict() for r in project.effectiveness().limit(1).collect()] == [{"rule_id": "SHORT", "name": "Short name", "runs": 2, "total_findings": 2, "total_useful": 1}]
    assert rules.try_rule(project.index, "SELECT * FROM symbols LIMIT 3").__len__() == 3
    assert "error" in rules.try_rule(project.index, "SELECT * FROM nowhere")[0]
    assert "error" in rules.try_rule(project.index, "DROP TABLE files")[0]


def test_conventions(project):
    found = project.conventions().collect()
    assert {(r["rel_path"], r["import_module"], r["source_layer"], r["target_layer"]) for r in found} == {("main.py", "pkg.tools", "top", "pkg")}
    assert layers.violations(project.index, []).count() == 0


def test_overview(project):
    found = {r["module"]: r.asDict() for r in summary.modules(project.index).collect()}
    assert found["(root)"]["files"] == 1 and found["pkg"]["files"] == 3 and found["pkg"]["classes"] == 1
    assert [tuple(r) for r in summary.module_dependencies(project.index).collect()] == [("(root)", "pkg")]
    assert project.call("overview")["hot_files"].first()["commits"] == 1


def test_annotations_outlive_a_rebuild_q8(project):
    project.annotate("careful here", symbol="fold")
    before = project.annotations().first()
    project.rebuild()
    after = project.annotations().first()
    assert after["text"] == before["text"] and after["symbol_id"] is not None


def test_sessions(project):
    a = project.start_session(now=datetime(2024, 1, 1))
    b = project.start_session(now=datetime(2024, 1, 2))
    rows = {r["session_id"]: r for r in project.session_history().collect()}
    assert rows[a]["summary"] == history.AUTO_END and rows[b]["ended_at"] is None
    project.end_session("done")
    assert project.call("session").count() == 0


def test_incremental_update_and_diff(project):
    from pathlib import Path

    root = Path(project.root)
    assert project.update() == {"changed": 0, "added": 0, "removed": 0}
    project.snapshot("before")
    (root / "pkg" / "tools.py").write_text(TOOLS.replace("def fold(", "def fold_rows(").replace("size(self)", "length(self)"))
    (root / "pkg" / "extra.py").write_text("def extra():\n    return 1\n")
    (root / "pkg" / "broken.py").unlink()
    sid = project.start_session()
    assert project.record_changes(sid) == 3  # Q18: added files are recorded, by path
    assert project.update() == {"changed": 1, "added": 1, "removed": 1}
    assert summary.stats(project.index).first()["files"] == 4
    found = project.diff("before")
    assert sorted(names(found["symbols_added"])) == ["extra", "fold_rows", "length"] and sorted(names(found["symbols_removed"])) == ["fold", "size"]
    by_commit = project.diff(commit="HEAD")
    assert {r["what"]: r["n"] for r in by_commit["summary"].collect()}["symbols_added"] == 3
    assert project.store.vacuum() > 0 and project.index.files.count() == 4


def test_git(project, spark):
    assert git.head(project.root) and git.head("/nonexistent") is None
    commit = project.commits().first()
    assert commit["subject"] == "first" and "main.py" in commit["files"]
    spark.dataSource.register(git.GitLogSource)
    assert spark.read.format("gitlog").option("path", project.root).load().count() == 1
    assert git.line_log(project.root, "main.py", 1, 3)[0][3] == "first"
    assert "class App" in git.file_at(project.root, "HEAD", "main.py")


def test_config():
    c = config.from_dict(config.parse_yaml("project:\n  name: 'x'\nignore:\n  - gen/\n  - \"*.tmp\"\nlayers:\n  - name: a\n    paths: [a/**, b/**]\n    allowed_imports: [c]\ncontext:\n  inline_source_max_lines: 40 # lines\n"))
    assert c.name == "x" and c.ignore == ["gen/", "*.tmp"] and c.layers[0].paths == ["a/**", "b/**"] and c.inline_source_max_lines == 40
    assert config.load("/nonexistent") == config.ProjectConfig()


def test_instruction_files_become_knowledge(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / ".claude").mkdir(parents=True)
    (tree / "CONTRIBUTING.md").write_text("Write tests.\n")
    (tree / ".claude" / "CLAUDE.md").write_text("é")
    facts = config.instruction_facts(tree)
    assert facts == {"instructions_file:.claude/CLAUDE.md": {"path": ".claude/CLAUDE.md", "size": 2}, "instructions_file:CONTRIBUTING.md": {"path": "CONTRIBUTING.md", "size": 13}}
    (tree / "a.py").write_text("x = 1\n")
    p = Project(spark, str(tree), f"file://{tmp_path}/store")
    p.rebuild()
    assert set(facts) <= {r["key"] for r in p.store.read("knowledge").collect()}


def test_unknown_tool_and_empty_index(spark, tmp_path):
    empty = Project(spark, str(tmp_path), f"file://{tmp_path}/store")
    assert "warning" in empty.call("overview")
    with pytest.raises(KeyError):
        empty.call("session", action="nothing")


def test_upsert_keeps_columns(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, made string")
    new = spark.createDataFrame([("b", 9, "z"), ("c", 3, "w")], "k string, v int, made string")
    assert sorted(map(tuple, history.upsert(old, new, ["k"], keep=["made"]).collect())) == [("a", 1, "x"), ("b", 9, "y"), ("c", 3, "w")]


def test_null_callers_survive_exclusion_q12(project):
    direct = impact.transitive_callers(project.index, "load")
    assert direct.where("caller_name is null").count() >= 0
    ix = project.index
    sites = ix.call_sites().where(F.col("caller_name").isNull())
    assert sites.count() >= 1


def test_server_and_command_line(project, spark, capsys):
    import io
    import json

    from spindrift.__main__ import main, serve

    asked = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "callers", "arguments": {"name": "main"}}},
             {"id": 4, "method": "nothing"}, {"id": 5, "method": "tools/call", "params": {"name": "no_tool"}}]
    out = io.StringIO()
    serve(project, io.StringIO("\n".join(json.dumps(x) for x in asked) + "\nnot json\n"), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r.get("error", {}).get("code") for r in replies] == [None, None, None, -32601, -32603, -32700]
    assert len(replies[1]["result"]["tools"]) == 12
    main(["--root", project.root, "--store", project.store.root, "search", "main"], spark)
    assert json.loads(capsys.readouterr().out)[0]["name"] == "main"


def test_appends_are_folders_and_ids_count_on(spark, tmp_path, monkeypatch):
    from spindrift.operators import catalog

    store = catalog.Store(spark, f"file://{tmp_path}/store")
    rows = lambda *paths: spark.createDataFrame([(1, p, "added") for p in paths], "session_id long, rel_path string, change_type string")
    store.append("change_log", rows("b", "a"), "change_id")
    first = store._pointer()["tables"]["change_log"]
    store.append("change_log", rows("d", "c"), "change_id")
    assert store._pointer()["tables"]["change_log"][0] == first[0] and len(first) == 1
    listed = lambda: sorted((r["change_id"], r["rel_path"]) for r in store.read("change_log").collect())
    assert listed() == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    monkeypatch.setattr(catalog, "MOST_FOLDERS", 2)
    store.append("change_log", rows("e"), "change_id")
    assert len(store._pointer()["tables"]["change_log"]) == 1 and listed()[-1] == (5, "e")
    assert store.vacuum() == 2 and len(listed()) == 5
    many = spark.range(1000).selectExpr("cast(id * 7 % 1000 as string) as k")
    ids = {r["k"]: r["i"] for r in catalog.numbered(many, "i", "k", start=10).collect()}
    assert [ids[k] for k in sorted(ids)] == list(range(11, 1011))


def test_snapshots_are_rows_and_old_ones_go(spark, tmp_path):
    from datetime import datetime, timedelta

    from spindrift.operators.project import Project

    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.py").write_text("def f():\n    g()\n")
    project = Project(spark, str(tmp_path / "tree"), f"file://{tmp_path}/store")
    project.rebuild()
    began = datetime(2024, 1, 1)
    for k in range(4):
        project.snapshot(f"s{k}", now=began + timedelta(days=10_000 + k), keep=2)
    assert [r["name"] for r in project.snapshots().collect()] == ["s3", "s2"]
    kept = {r["snapshot_id"] for r in project.store.read("snapshots").collect()}
    for name, n in (("snapshot_symbols", 1), ("snapshot_calls", 1)):
        # Nothing changed, so all snapshots share the rows of the first, which stay though that one went.
        assert project.store.read(name).count() == n
        homes = {(r["snapshot_id"], r["home"]) for r in project.store.read("snapshot_buckets").where(F.col("what") == name).collect()}
        assert {s for s, _ in homes} == kept and {h for _, h in homes} == {r["snapshot_id"] for r in project.store.read(name).collect()}
    assert all(r["size_kb"] > 0 for r in project.snapshots().collect())
    (tmp_path / "tree" / "a.py").write_text("def f():\n    pass\n\n\ndef new():\n    pass\n")
    project.update()
    assert [r["name"] for r in project.diff("s3")["symbols_added"].collect()] == ["new"]
