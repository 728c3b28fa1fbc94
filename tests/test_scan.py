"""The way from a folder to its graph, on a small tree."""

import json
import os
import subprocess

import pytest

from lattice.extractors import markdown
from lattice.model import Graph
from lattice.plans import scan
from lattice.render import formats
from lattice.render.visible import Options
from lattice.sources import documents, files, topology

TREE = {
    "app/views.py": "from flask import Flask\nimport sqlalchemy\nimport requests\nfrom app import models\n\n@app.route('/users')\ndef users():\n    return requests.get('https://api.example.com/v1')\n",
    "app/models.py": "import app.views\n",
    "app/urls.py": "import os\nurlpatterns = [path('list/', f)]\n",
    "app/broken.py": "import redis\ndef (:\n",
    "__init__.py": "",
    "docs/a.md": "# A\n[[b|the other]] [[b#part]] `[[no]]` [c](../docs/c.md \"t\") [x](https://e.org/x.md)\n```\n[[fenced]]\n~~~\n```\n",
    "docs/b.md": "[a](a.md#top)",
    "tests/test_x.py": "import os",
    "node_modules/x.py": "import os",
    "pyproject.toml": "",
    "notes.txt": "no",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    (top / "link.py").symlink_to("app/views.py")
    return str(top)


@pytest.fixture(scope="module")
def graph(spark, root):
    return scan.scan(spark, root)


def test_listing(spark, root):
    found = {r["rel_path"]: r["skipped"] for r in files.listing(spark, root, [".py", ".md"]).collect()}
    assert found == {k: False for k in TREE if k.endswith((".py", ".md")) and not k.startswith(("tests", "node_modules"))} | {"link.py": True, "tests/test_x.py": True}
    first, cut = files.first_files(files.listing(spark, root, [".py"]), 2)
    assert {r["rel_path"] for r in first.collect()} == {"__init__.py", "app/broken.py"} and cut


def test_changes(spark, root):
    now = files.hashed(files.listing(spark, root, [".py"]).where("not skipped")).select("path", "mtime_ns", "hash")
    state = now.where("path not like '%models.py'").selectExpr("path", "mtime_ns - (path like '%views.py' or path like '%urls.py')::bigint mtime_ns", "if(path like '%urls.py', 'x', hash) hash")
    state = state.unionByName(spark.createDataFrame([(f"{root}/gone.py", 1, "y")], state.schema))
    got = {os.path.basename(r["path"]): r["status"] for r in files.changes(files.listing(spark, root, [".py"]), state).collect()}
    assert got == {"models.py": "added", "views.py": "unchanged", "urls.py": "modified", "broken.py": "unchanged", "__init__.py": "unchanged", "gone.py": "deleted"}


def test_graph(graph, root):
    nodes = {r["id"]: r for r in graph.nodes.collect()}
    assert {"mod:app/views", "mod:app/broken", "mod:__init__", "note:docs/a", "infra:database", "infra:cache", "infra:external_api", "service:api.example.com", "endpoint:app/views.py:6", "endpoint:app/urls.py:2"} <= set(nodes)
    assert nodes["endpoint:app/views.py:6"]["name"] == "ROUTE /users" and nodes["endpoint:app/views.py:6"]["properties"]["framework"] == "flask"
    assert nodes["endpoint:app/urls.py:2"]["name"] == "URL list/" and nodes["mod:app/views"]["path"] == "app"
    edges = {(r["source"], r["target"]): r["label"] for r in graph.edges.collect()}
    links = {t: label for (s, t), label in edges.items() if s == "note:docs/a"}
    assert links == {"wikilink:b": "the other", "wikilink:c": "c"}
    assert edges["mod:app/views", "service:api.example.com"] == "GET https://api.example.com/v1"
    found = {(r["source"], r["target"]) for r in scan.resolved(graph).collect()}
    assert ("note:docs/a", "note:docs/b") in found and ("note:docs/b", "note:docs/a") in found


def test_code_is_no_link():
    assert markdown.without_code("a ``b ` [[c]] `` d ` e") == "a " + " " * 14 + " d ` e"
    assert markdown.without_code("~~~\nx\n```\ny\n~~~\nz") == "\n\n\n\n\nz"


def test_large_file_is_a_stub(spark, tmp_path):
    (tmp_path / "big.py").write_text("import os\n" + "#" * (5 * 1024 * 1024))
    g = scan.scan(spark, str(tmp_path))
    assert [r["properties"]["skipped"] for r in g.nodes.collect()] == ["size"] and g.edges.count() == 0


def test_topology(spark, root):
    assert scan.project(spark, root)["topology"] == "unknown"
    none = dict.fromkeys([*topology.MARKERS.values(), "cmd_dirs", "manifests"], 0)
    for own, verdict in [({"pnpm": 1}, "monorepo"), ({"go_modules": 2}, "monorepo"), ({"dockerfiles": 2, "compose": 1}, "microservice"), ({"dockerfiles": 3}, "microservice"), ({"cmd_dirs": 2}, "monorepo"), ({"py_projects": 3}, "monorepo"), ({"go_modules": 1}, "monolith"), ({"dockerfiles": 2}, "unknown")]:
        assert topology.topology(none | own)[0] == verdict
    assert topology.lists_packages("packages:\n  - 'a/*'\n") and not topology.lists_packages("packages: [' ']") and not topology.lists_packages("{")


def test_snapshot_and_changes(spark, graph, tmp_path):
    file = str(tmp_path / "s.json")
    documents.save_snapshot(graph, file, label="one")
    assert json.load(open(file))["label"] == "one"
    again = documents.load_snapshot(spark, file)
    assert again.nodes.count() == graph.nodes.count() and again.edges.count() == graph.edges.count()
    less = Graph(again.nodes.where("id <> 'note:docs/b'"), again.edges.where("source <> 'note:docs/b'"))
    assert scan.changes(graph, again).where("category <> 'validation'").count() == 0
    text = scan.narrate(scan.changes(less, graph), "v1", "v2")
    assert text.startswith("Between v1 and v2: 1 component added, 1 dependency edge changed. Added: 1 note (docs/b).") and "Now in the graph: cycle(2 nodes): note:docs/a, note:docs/b" in text
    assert scan.report(scan.changes(less, graph)) == {"added": 3, "removed": 0, "modified": 0, "max_severity": "critical"}
    assert scan.changes_at_least(scan.changes(less, graph), "critical").count() == 1


def test_validate(spark, graph, tmp_path):
    file = str(tmp_path / "b.json")
    found = scan.validate(graph)
    cycle = "cycle(2 nodes): note:docs/a, note:docs/b"
    assert ("no_circular_dependencies", "critical", cycle) in {(r["rule"], r["severity"], r["subject"]) for r in found.collect()}
    documents.save_baseline(found.where("rule = 'no_circular_dependencies'"), file)
    new = scan.validate(graph, known=documents.load_baseline(spark, file)).where("is_new").collect()
    assert len(new) == found.count() - 1 and "no_circular_dependencies" not in {r["rule"] for r in new}


def test_explain(spark, graph, root):
    got = scan.explain(graph, scan.project(spark, root))
    assert "An HTTP API of 2 endpoints" in got["patterns"] and any("cycle" in r for r in got["risks"])
    assert any(d.startswith("Keeps data in Database, seen by") for d in got["decisions"]) and any(d.startswith("Written in markdown (") for d in got["decisions"])


def test_render(graph):
    shown = {kind: formats.render(graph, kind, Options(title="T", view_level="component")) for kind in formats.FORMATS}
    assert "note___docs__a([a])" in shown["mermaid"] and "mod___app__views --> infra___database" in shown["mermaid"]
    assert 'database "Database" as infra___database' in shown["plantuml"] and "note___docs__a\n" not in shown["plantuml"].split("-->")[0]
    assert 'ContainerDb(infra___database, "Database", "", "Data store")' in shown["c4"]
    assert json.loads(shown["json"])["view_level"] == "component"
    assert shown["drawio"].count("rounded=1") == graph.nodes.count() and shown["html"].startswith("<!DOCTYPE")
    assert '            infra___database = container "Database" "" "" {\n                tags "Database"' in shown["structurizr"] and shown["structurizr"].index("->") < shown["structurizr"].index("views {")
    scene = json.loads(shown["excalidraw"])["elements"]
    assert sum(e["type"] == "rectangle" for e in scene) == graph.nodes.count() and len({e["id"] for e in scene}) == len(scene)
    assert all(e["points"][0] == [0, 0] for e in scene if e["type"] == "arrow") and '"component": 0' in shown["forcegraph"]
    themed = formats.render(graph, "mermaid", Options(theme=("#000", "#ffffff"), view_level="component", group_depth=1))
    assert "'primaryColor': '#070707'" in themed and "dir___app" in themed and "'titleColor': '#ffffff'" in themed
    assert formats.render(graph, "mermaid", Options(max_chars=5)).startswith("---\nt\n...")
    with pytest.raises(ValueError):
        formats.render(graph, "svg")


def test_documents(spark, tmp_path):
    assert json.loads(documents.plain_json('{"a": "// no", /* x */ "b": [1, 2, ], // y\n}')) == {"a": "// no", "b": [1, 2]}
    r = documents.Registry(str(tmp_path / "state" / "r.json"))
    r.add("one", str(tmp_path))
    with pytest.raises(ValueError):
        r.add("../x", "/")
    assert [(x["alias"], x["stale"]) for x in documents.Registry(r.file).list()] == [("one", False)]
    (tmp_path / "rules.yaml").write_text("rules:\n- {name: a, type: no_dependency, from: {type: endpoint}, to: {path: 'db/**'}, severity: high}\n")
    assert documents.load_rules(str(tmp_path / "rules.yaml"))[0].severity == "high"
    for bad in ("", "-x", "a;b", "a b"):
        with pytest.raises(ValueError):
            documents.check_ref(bad)


def test_git(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@example.com", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init")
    for k, text in enumerate(["import os", "import sqlite3"]):
        (tmp_path / "m.py").write_text(text)
        git("add", ".")
        git("commit", "-m", f"step | {k}")
    assert [r["message"] for r in documents.commits(spark, str(tmp_path)).orderBy("seq").collect()] == ["step | 1", "step | 0"]
    got = {(r["change_type"], r["subject"]) for r in scan.drift_between(spark, str(tmp_path), "HEAD~1").collect()}
    assert ("added", "infra:database") in got


def test_rescan_reads_only_what_changed(spark, tmp_path, monkeypatch):
    for name, text in {"a.py": "import os", "b.py": "import sqlite3", "c.md": "[[a]]", "d.py": "import redis"}.items():
        (tmp_path / name).write_text(text)
    one = scan.scan_folder(spark, str(tmp_path))
    assert one.stats["files_analyzed"] == 4 and one.stats["files_cached"] == 0
    (tmp_path / "b.py").write_text("import redis, requests")
    (tmp_path / "d.py").unlink()
    os.utime(tmp_path / "c.md", ns=(5, 5))
    two = scan.scan_folder(spark, str(tmp_path), state=one.state)
    assert {k: two.stats[k] for k in ("files_analyzed", "files_cached", "files_changed", "files_invalidated")} == {"files_analyzed": 1, "files_cached": 2, "files_changed": 1, "files_invalidated": 0}
    fresh = scan.scan_folder(spark, str(tmp_path))
    rows = lambda g: sorted(map(str, g.nodes.select("id", "path", "type").collect() + g.edges.select("source", "target", "label").collect()))
    assert rows(two.graph) == rows(fresh.graph)
    from lattice.sources.state import State

    two.state.save(str(tmp_path / "state"))
    held = State.load(spark, str(tmp_path / "state"))
    stale = State(held.files.selectExpr("path", "rel_path", "ext", "mtime_ns", "hash", "if(ext = '.md', 'old', signature) signature"), held.rows)
    assert scan.scan_folder(spark, str(tmp_path), state=stale).stats["files_invalidated"] == 1
    assert held.remove(str(tmp_path / "a.py")).rows.where("rel_path = 'a.py'").count() == 0 < held.rows_of(str(tmp_path / "a.py")).count()


def test_limits(spark, root):
    cut = scan.scan_folder(spark, root, max_nodes=2)
    assert cut.truncated and cut.graph.nodes.count() == 2
    with pytest.raises(TimeoutError):
        scan.scan_folder(spark, root, timeout=0.01)
    assert not scan.scan_folder(spark, root, skip_dirs=["app", "docs"]).graph.nodes.where("path = 'app'").count()


def test_cache():
    from lattice.cache import Cache, key_of

    now = [0.0]
    c = Cache(10, 2, lambda: now[0])
    c.put("a", 1)
    now[0] = 1
    c.put("b", 2)
    c.put("c", 3)
    assert (c.get("a"), c.get("b"), c.get("c"), len(c)) == (None, 2, 3, 2)
    now[0] = 12
    assert c.get("b") is None
    assert key_of("/x", {"max_files": 1, "timeout": 5}) == key_of("/x", {"max_files": 1}) != key_of("/x", {})


def test_guards(tmp_path, monkeypatch):
    from lattice import safety

    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "in" / "link").symlink_to(tmp_path / "out")
    for bad in ("/etc", "/proc/self"):
        with pytest.raises(PermissionError):
            safety.scan_path(bad)
    assert safety.output_path(str(tmp_path / "in" / "new" / "x.json"), str(tmp_path / "in")).endswith("x.json")
    for bad in ("../x.json", "link/x.json"):
        with pytest.raises(PermissionError):
            safety.output_path(str(tmp_path / "in" / bad), str(tmp_path / "in"))
    monkeypatch.setenv(safety.ALLOWED, str(tmp_path / "in"))
    assert safety.scan_path(str(tmp_path / "in"))
    for bad in (tmp_path / "out", tmp_path / "in" / "link"):
        with pytest.raises(PermissionError):
            safety.scan_path(str(bad))
    monkeypatch.setenv(safety.ALLOWED, ":")
    with pytest.raises(PermissionError):
        safety.scan_path(str(tmp_path / "in"))


def test_service(spark, root, tmp_path, capsys):
    from lattice.__main__ import main
    from lattice.api import QUESTIONS, Service

    own = Service(spark, str(tmp_path / "registry.json"), str(tmp_path / "state"))
    assert len(QUESTIONS) == 19
    full = own.ask("arch_scan", path=root, detail="full", with_samples=True, max_detail_nodes=3)
    assert full["truncated"] and len(full["nodes"]) == 3 and full["node_count"] > 3 and full["summary"].startswith("Nodes: ")
    samples = {n["id"]: n.get("sample") for n in own.ask("arch_scan", path=root, detail="full", with_samples=True)["nodes"]}
    assert samples["endpoint:app/views.py:6"].startswith("@app.route('/users')") and samples["infra:database"] is None
    hit = own.ask("arch_blast_radius", path=root, target="docs/b")
    assert (hit["target_id"], hit["direct"], hit["dependents"][0]["path_back"]) == ("note:docs/b", 1, ["note:docs/a", "note:docs/b"])
    assert own.ask("arch_generate", path=root, format="plantuml", max_chars=20)["truncated"]
    assert own.ask("arch_metrics", path=root)["component_counts"]["note"] == 2
    assert own.ask("arch_boundaries", path=root)["boundaries"] == [{"name": os.path.basename(root), "path": ".", "type": "module", "markers": ["pyproject.toml"]}]
    assert not own.ask("arch_validate", path=root, baseline="write")["valid"] and own.ask("arch_validate", path=root, baseline="check")["valid"]
    assert own.ask("arch_recommend", path=root, focus="break_cycle")["recommendations"][0]["subjects"] == ["note:docs/a", "note:docs/b"]
    assert own.ask("arch_dataflow", path=root)["endpoints"] == ["URL list/", "ROUTE /users"]
    assert any(x.startswith("Risk: ") for x in own.ask("arch_explain", path=root)["evidence"])
    file = own.ask("arch_snapshot", path=root)["file"]
    assert own.ask("arch_diff", path=root, snapshot_file=os.path.basename(file))["added"] == 1  # the cycle that is there
    own.ask("arch_registry_add", path=root, alias="tree")
    assert own.ask("arch_focus", repo="tree")["node_count"] == full["node_count"]
    again = Service(spark, str(tmp_path / "registry.json"), str(tmp_path / "state"))
    assert again.ask("arch_scan", repo="tree")["stats"]["files_cached"] > 0 and again.ask("arch_registry_list")["repos"][0]["node_count"] == full["node_count"]
    both = own.ask("arch_scan", paths=[root, root])
    assert both["node_count"] == full["node_count"] and both["edge_count"] == 2 * full["edge_count"]
    assert own.ask("arch_dependencies", path=root)["internal"] == []
    for name, bad in (("arch_scan", {"path": root, "nonsense": 1}), ("arch_scan", {"path": root, "paths": [root]}), ("arch_scan", {"path": root, "max_files": -1}), ("arch_blast_radius", {"path": root}), ("arch_validate", {"path": root, "baseline": "x"}), ("nothing", {}), ("arch_scan", {"repo": "unknown"})):
        with pytest.raises(ValueError):
            own.ask(name, **bad)
    own.ask("arch_registry_remove", alias="tree")
    assert main(["scan", root, "--out", str(tmp_path / "g.json")], own) == 0 and json.load(open(tmp_path / "g.json"))["node_count"] == full["node_count"]
    assert main(["ask", "arch_metrics", f"path={root}"], own) == 0 and main(["scan"], own) == 2 and main(["ask", "arch_metrics", "path=/none"], own) == 1


def test_own_rules_need_leave(spark, tmp_path, monkeypatch):
    from lattice.api import ALLOW_RULES, Service

    (tmp_path / ".arch-rules.yaml").write_text("rules:\n- {name: a, type: no_dependency, from: {type: module}, to: {type: module}}\n")
    own = Service(spark, str(tmp_path / "r.json"), str(tmp_path / "s"))
    assert own.own_rules(str(tmp_path)) == []
    monkeypatch.setenv(ALLOW_RULES, "1")
    assert [r.name for r in own.own_rules(str(tmp_path))] == ["a"]
    (tmp_path / ".arch-rules.yaml").write_text("rules: [{}]")
    assert own.own_rules(str(tmp_path)) == []
