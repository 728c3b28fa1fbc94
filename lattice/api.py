"""The questions a client asks, by name, with plain arguments and JSON-ready answers.

A Service holds the session, the registry of aliases and the cache of scans. ask(name, **arguments) answers any question;
arguments that a question doesn't know, or of the wrong kind, are an error that names them. Rows that are shown are
bounded by a documented limit, and an answer says so when it was reached; counts are always of everything.
"""

from __future__ import annotations

import inspect
import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.cache import Cache, key_of
from lattice.model import Graph
from lattice.operators import dependencies, kernels, metrics, resolve, rules
from lattice.plans import scan
from lattice.render import formats
from lattice.render.visible import Options
from lattice.safety import output_path, scan_path
from lattice.sources import documents, samples
from lattice.sources.state import State

# Names of files in a scanned folder, limits, and the setting that lets a folder bring rules of its own.
BASELINE, SNAPSHOT, OWN_RULES = ".arch-known-violations.json", "architecture.snapshot.json", ".arch-rules.yaml"
ALLOW_RULES = "LATTICE_ALLOW_REPO_RULES"
DETAIL, CHARACTERS, TIMEOUT, MAX_SHOWN = 1000, 100_000, 120, 50_000
CONTROLS = {"max_files": 0, "max_nodes": 0, "skip_dirs": None, "skip_globs": None, "include_tests": False, "timeout": TIMEOUT}

log = logging.getLogger("lattice")
QUESTIONS: dict[str, Callable] = {}


def question(f: Callable) -> Callable:
    QUESTIONS[f.__name__] = f
    return f


def shown(df: DataFrame, limit: int = MAX_SHOWN) -> list[dict]:
    """Rows as dicts; more than limit are an error, never cut."""
    rows = df.limit(min(limit + 1, 2**31 - 1)).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} rows: ask about a part, or read the tables with the library")
    return [{k: v for k, v in r.asDict(True).items() if v is not None and k != "ord"} for r in rows]


class Service:
    def __init__(self, spark: SparkSession, registry: str | None = None, state_dir: str | None = None, shared: str | None = None):
        """registry: the file of aliases; state_dir: where scans by alias are kept; shared: a folder for git trees that
        executors share."""
        home = os.path.expanduser("~/.lattice")
        self.spark, self.shared = spark, shared
        self.registry = documents.Registry(registry or os.path.join(home, "registry.json"))
        self.state_dir = state_dir or os.path.join(home, "state")
        self.cache = Cache()

    def ask(self, name: str, **arguments):
        if name not in QUESTIONS:
            raise ValueError(f"unknown question {name!r}: {', '.join(sorted(QUESTIONS))}")
        f = QUESTIONS[name]
        known = {*inspect.signature(f).parameters} - {"self", "controls"} | ({*CONTROLS} if "controls" in inspect.signature(f).parameters else set())
        if extra := sorted({*arguments} - known):
            raise ValueError(f"{name} takes no {', '.join(extra)}; it takes {', '.join(sorted(known))}")
        for key in ("max_files", "max_nodes", "timeout", "limit", "max_depth", "max_chars", "min_degree", "group_depth", "sample_lines", "max_detail_nodes"):
            if arguments.get(key) is not None and (not isinstance(arguments[key], int) or arguments[key] < 0):
                raise ValueError(f"{key} has to be a whole number of 0 or more")
        return f(self, **arguments)

    # Finding and scanning

    def place(self, path: str = "", repo: str = "") -> tuple[str, str]:
        """The folder and its alias; a path goes before an alias."""
        if path:
            return scan_path(path), ""
        if not repo:
            raise ValueError("path or repo is required")
        if repo not in self.registry.repos:
            raise ValueError(f"no repository is called {repo!r}")
        return scan_path(self.registry.get(repo)["path"]), repo

    def scanned(self, path: str, alias: str = "", **controls) -> scan.Scanned:
        """From the cache, or anew; scans by alias read only what has changed since the last one."""
        options = {k: v if v is not None else CONTROLS[k] for k, v in (CONTROLS | controls).items()}
        key = key_of(path, options | {"alias": alias})
        if (held := self.cache.get(key)) is None:
            folder, state = os.path.join(self.state_dir, alias), None
            # A state of a scan with limits or other globs isn't whole, so only plain scans keep one.
            keeps = alias and not any(options[k] for k in ("max_files", "max_nodes", "skip_dirs", "skip_globs", "include_tests"))
            if keeps and os.path.isdir(os.path.join(folder, "rows")):
                state = State.load(self.spark, folder)
            held = scan.scan_folder(self.spark, path, state=state, **options)
            if keeps:
                held.state.save(folder)
                self.registry.update(alias, held.stats["nodes_found"], held.stats["edges_found"])
            self.cache.put(key, held)
        return held

    def graph(self, path: str, repo: str, controls: dict) -> tuple[str, Graph]:
        root, alias = self.place(path, repo)
        return root, self.scanned(root, alias, **controls).graph

    def own_rules(self, root: str) -> list[rules.Rule]:
        """Of the folder's rules file, if the user lets folders bring rules; else a scanned folder could excuse itself."""
        file = os.path.join(root, OWN_RULES)
        if not os.path.exists(file):
            return []
        if os.environ.get(ALLOW_RULES) != "1":
            log.warning("%s is passed over; set %s=1 for folders that are trusted", file, ALLOW_RULES)
            return []
        try:
            return documents.load_rules(file)
        except Exception as error:  # noqa: BLE001  a broken file is no reason to answer nothing
            log.warning("%s can't be read: %s", file, error)
            return []

    # Questions

    @question
    def arch_scan(self, path: str = "", repo: str = "", paths: list[str] | None = None, detail: str = "summary", with_samples: bool = False,
                  sample_lines: int = samples.LINES, max_detail_nodes: int = DETAIL, **controls) -> dict:
        if paths and (path or repo):
            raise ValueError("give path or paths, not both")
        if paths:
            got = scan.scan_all(self.spark, [scan_path(p) for p in paths], **{k: v for k, v in (CONTROLS | controls).items()})
            kind = "unknown"
        else:
            root, alias = self.place(path, repo)
            got, kind = self.scanned(root, alias, **controls), scan.project(self.spark, root)["topology"]
        g = got.graph
        out = {"root_path": got.root, "topology": kind, "node_count": g.nodes.count(), "edge_count": g.edges.count(),
               "summary": metrics.summary(g.nodes, g.edges).first()[0], "stats": got.stats, "truncated": got.truncated}
        if detail.lower() == "full":
            limit = max_detail_nodes or DETAIL
            nodes = samples.with_samples(g.nodes, got.root, sample_lines) if with_samples else g.nodes
            for name, df, order in (("nodes", nodes, ["id"]), ("edges", g.edges, ["ord"])):
                out[name] = shown(df.orderBy(*order).limit(limit), limit)
            out["truncated"] = got.truncated or out["node_count"] > limit or out["edge_count"] > limit
        return out

    @question
    def arch_focus(self, path: str = "", repo: str = "", **controls) -> dict:
        return self.arch_scan(path, repo, **controls)

    @question
    def arch_generate(self, path: str = "", repo: str = "", format: str = "mermaid", view_level: str = "", title: str = "", direction: str = "TB", theme_bg: str = "",
                      theme_fg: str = "", prune_threshold: float = 0.0, min_degree: int = 0, group_depth: int = 0, max_chars: int = CHARACTERS, **controls) -> dict:
        root, g = self.graph(path, repo, controls)
        options = Options(title=title or "Architecture", view_level=view_level or ("component" if format == "html" else "container"), direction=direction, theme=(theme_bg, theme_fg),
                          prune_threshold=prune_threshold, min_degree=min_degree, max_chars=0, root=root, group_depth=group_depth)
        text = formats.render(g, format, options)
        limit = max_chars or CHARACTERS
        out = {"format": format, "diagram": text[:limit], "summary": metrics.summary(g.nodes, g.edges).first()[0], "total_chars": len(text), "truncated": len(text) > limit, "notes": []}
        if out["truncated"]:
            out["notes"].append(f"{limit} of {len(text)} characters: a cut {format} diagram may not parse. Ask with max_chars={len(text)}, or for less: group_depth, min_degree, prune_threshold, view_level")
        if prune_threshold > 0:
            edges = resolve.resolved_edges(g.nodes, g.edges)
            gone = metrics.prune_super_nodes(*metrics.view(g.nodes, edges, options.view_level), prune_threshold)[2]
            out["pruned_nodes"] = [r["name"] for r in shown(gone.join(g.nodes.select("id", "name"), "id").orderBy("name"))]
        return out

    @question
    def arch_dependencies(self, path: str = "", repo: str = "", **controls) -> dict:
        root, g = self.graph(path, repo, controls)
        module = ""
        if os.path.isfile(os.path.join(root, "go.mod")):
            with open(os.path.join(root, "go.mod"), encoding="utf-8", errors="replace") as f:
                module = next((line.split(None, 1)[1].strip() for line in f if line.startswith("module ")), "")
        kinds = shown(dependencies.kinds(g.nodes, g.edges, module).orderBy("ord"))
        of = lambda kind: [r["label"] for r in kinds if r["kind"] == kind]
        return {"internal": [r["name"] for r in shown(dependencies.names_of(g.nodes, "package").orderBy("id"))], "external": of("external"), "infrastructure": of("infrastructure")}

    @question
    def arch_blast_radius(self, path: str = "", repo: str = "", target: str = "", max_depth: int = 50, **controls) -> dict:
        if not target:
            raise ValueError("target is required")
        _, g = self.graph(path, repo, controls)
        bound = resolve.target_binding(self.spark.createDataFrame([(target,)], "target string"), g.nodes).first()
        if bound is None:
            raise ValueError(f"nothing in the graph is called {target!r}; arch_scan with detail=full lists ids and paths")
        rounds, cut = kernels.dependents(scan.resolved(g), bound["id"], max_depth or 50)
        found = kernels.path_back(self.spark, rounds, bound["id"]).join(g.nodes.select("id", F.expr("nullif(name, '')").alias("name")), "id", "left")
        rows = shown(found.select(F.col("id").alias("node_id"), F.coalesce("name", "id").alias("node_name"), "depth", "path_back").orderBy("depth", "node_id"))
        return {"target": target, "target_id": bound["id"], "direct": sum(r["depth"] == 1 for r in rows), "total": len(rows), "max_depth_hit": cut, "dependents": rows}

    @question
    def arch_dataflow(self, path: str = "", repo: str = "", **controls) -> dict:
        _, g = self.graph(path, repo, controls)
        ends = [r["name"] for r in shown(dependencies.names_of(g.nodes, "endpoint").orderBy("id"))]
        paths = [r["path"] for r in shown(dependencies.data_paths(g.edges).orderBy("ord"))]
        traces = shown(kernels.traces(g.nodes, scan.resolved(g)).orderBy("entry", "chain"))
        return {"endpoints": ends, "data_paths": paths, "traces": traces, "summary": f"{len(ends)} endpoints, {len(paths)} data paths, {len(traces)} traces"}

    @question
    def arch_boundaries(self, path: str = "", repo: str = "", **controls) -> dict:
        root, alias = self.place(path, repo)
        about = scan.project(self.spark, root)
        rows = shown(about["boundaries"].orderBy("stage", "file").select("name", "path", "type", "markers"))
        out = {k: about[k] for k in ("topology", "signals", "reason", "ambiguous")} | {"boundaries": rows}
        text = f"{about['topology']}, {len(rows)} boundaries ({about['reason']}), {about['signals']['deployable_units']} deployed on their own"
        try:
            out["graph_signals"] = scan.graph_signals(self.scanned(root, alias, **controls).graph, about["boundaries"])
            text += f", {out['graph_signals']['cross_boundary_edges']} edges between them, shared databases: {', '.join(out['graph_signals']['shared_database_ids']) or 'none'}"
        except Exception as error:  # noqa: BLE001  markers alone are an answer, too
            log.warning("%s can't be scanned, so there are markers only: %s", root, error)
        return out | {"summary": text + ("; another verdict was near" if about["ambiguous"] else "")}

    @question
    def arch_diff(self, path: str = "", repo: str = "", snapshot_file: str = "") -> dict:
        if not snapshot_file:
            raise ValueError("snapshot_file is required")
        root, g = self.graph(path, repo, {})
        file = output_path(os.path.join(root, snapshot_file), root)
        return self._report(scan.changes(documents.load_snapshot(self.spark, file), g), snapshot_file, "current")

    def _report(self, found: DataFrame, base: str, head: str) -> dict:
        found = scan.stored(found, "changes")
        return {"base_ref": base, "head_ref": head, **scan.report(found), "changes": shown(found.orderBy("category", "change_type", "subject")), "summary": scan.narrate(found, base, head)}

    def _drift(self, path: str, repo: str, base_ref: str, head_ref: str, controls: dict) -> DataFrame:
        if not base_ref:
            raise ValueError("base_ref is required")
        root, _ = self.place(path, repo)
        return scan.drift_between(self.spark, root, base_ref, head_ref, self.shared, **controls)

    @question
    def arch_drift(self, path: str = "", repo: str = "", base_ref: str = "", head_ref: str = "HEAD", **controls) -> dict:
        return self._report(self._drift(path, repo, base_ref, head_ref, controls), base_ref, head_ref)

    @question
    def arch_drift_explain(self, path: str = "", repo: str = "", base_ref: str = "", head_ref: str = "HEAD", **controls) -> dict:
        found = scan.stored(self._drift(path, repo, base_ref, head_ref, controls), "changes")
        return {"narrative": scan.narrate(found, base_ref, head_ref), **scan.report(found)}

    @question
    def arch_validate(self, path: str = "", repo: str = "", baseline: str = "", baseline_file: str = "", **controls) -> dict:
        if baseline not in ("", "write", "check"):
            raise ValueError("baseline is write, check or nothing")
        root, g = self.graph(path, repo, controls)
        found = scan.stored(scan.validate(g, self.own_rules(root), root=root), "violations")
        text = lambda df: [f"[{r['severity']}] {r['rule']}: {r['detail']}" for r in shown(df.orderBy("place", "subject"))]
        every = text(found)
        out = {"valid": not every, "violations": every, "summary": f"{len(every)} violations"}
        if not baseline:
            return out
        file = output_path(os.path.join(root, baseline_file or BASELINE), root)
        if baseline == "write":
            documents.save_baseline(found, file)
            return out | {"baseline_file": file, "summary": f"{len(every)} violations are known from now on, in {file}"}
        if not os.path.exists(file):
            raise FileNotFoundError(f"{file}: write a baseline first")
        new = text(rules.split_known(found, documents.load_baseline(self.spark, file)).where("is_new"))
        return out | {"valid": not new, "new_violations": new, "grandfathered": len(every) - len(new), "baseline_file": file, "summary": f"{len(every)} violations, {len(new)} of them new"}

    @question
    def arch_history(self, path: str = "", repo: str = "", limit: int = 10, **controls) -> dict:
        root, _ = self.place(path, repo)
        entries = scan.history(self.spark, root, limit, self.shared, **controls)
        return {"entries": entries, "summary": f"{len(entries)} commits"}

    @question
    def arch_snapshot(self, path: str = "", repo: str = "", output_file: str = "", label: str = "", **controls) -> dict:
        root, g = self.graph(path, repo, controls)
        file = output_path(os.path.join(root, output_file or SNAPSHOT), root)
        documents.save_snapshot(g, file, root, scan.project(self.spark, root)["topology"], label)
        n, m = g.nodes.count(), g.edges.count()
        return {"file": file, "node_count": n, "edge_count": m, "summary": f"{n} nodes and {m} edges are in {file}"}

    def _metrics(self, g: Graph) -> dict:
        edges = scan.resolved(g)
        own = scan.stored(metrics.fan_in_out(g.nodes, edges), "metrics")
        rows, mean = shown(own), metrics.metrics_summary(g.nodes, edges).first()
        deep = kernels.depths(edges.where("type = 'dependency'")).join(own.select("id"), "id", "left_semi").agg(F.max("depth").alias("d")).first()["d"]
        by = lambda df: {r["type"]: r["n"] for r in shown(metrics.counts_by_type(df))}
        return {"component_counts": by(g.nodes), "edge_counts": by(edges), "coupling": {r["id"]: r["coupling"] for r in rows}, "instability": {r["id"]: r["instability"] for r in rows},
                "avg_coupling": mean["avg_coupling"] or 0.0, "avg_instability": mean["avg_instability"] or 0.0, "max_depth": deep or 0}

    @question
    def arch_metrics(self, path: str = "", repo: str = "", **controls) -> dict:
        m = self._metrics(self.graph(path, repo, controls)[1])
        return m | {"summary": f"{sum(m['component_counts'].values())} components: coupling {m['avg_coupling']:.1f}, instability {m['avg_instability']:.2f} on average, depth {m['max_depth']}"}

    @question
    def arch_explain(self, path: str = "", repo: str = "", question: str = "", **controls) -> dict:
        """The question is accepted and not used."""
        root, g = self.graph(path, repo, controls)
        got = scan.explain(g, scan.project(self.spark, root))
        return {"explanation": got["summary"][0], "evidence": [f"{title}: {x}" for title, key in (("Topology", "topology"), ("Pattern", "patterns"), ("Decision", "decisions"), ("Risk", "risks")) for x in got[key]]}

    @question
    def arch_recommend(self, path: str = "", repo: str = "", focus: str = "", **controls) -> dict:
        root, g = self.graph(path, repo, controls)
        found = scan.stored(scan.validate(g, self.own_rules(root), root=root), "violations")
        rows = shown(scan.recommend(g, found, focus).orderBy("rank"))
        return {"recommendations": rows, "summary": f"{len(rows)} recommendations for {root}", "metrics_snapshot": self._metrics(g)}

    @question
    def arch_registry_add(self, path: str = "", alias: str = "") -> dict:
        root = scan_path(path)
        self.registry.add(alias or os.path.basename(root), root)
        return {"alias": alias or os.path.basename(root), "path": root}

    @question
    def arch_registry_remove(self, alias: str = "") -> dict:
        if alias not in self.registry.repos:
            raise ValueError(f"no repository is called {alias!r}")
        self.registry.remove(alias)
        return {"alias": alias, "removed": True}

    @question
    def arch_registry_list(self) -> dict:
        return {"repos": self.registry.list()}


def as_json(answer: dict) -> str:
    return json.dumps(answer, indent=2, ensure_ascii=False, default=str)
