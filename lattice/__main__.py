"""python -m lattice scan FOLDER, or python -m lattice ask QUESTION key=value ...: answers as JSON on standard output.

Exit status: 0 if it was answered, 1 if it could not be, 2 if it was asked wrongly."""

from __future__ import annotations

import argparse
import json
import sys

from lattice.api import QUESTIONS, Service, as_json


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lattice", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan", help="the whole graph of a folder")
    s.add_argument("path", nargs="?", default="")
    s.add_argument("--repo", default="", help="an alias instead of a path")
    s.add_argument("--out", default="", help="write to this file")
    s.add_argument("--include-tests", action="store_true")
    s.add_argument("--samples", action="store_true", help="with the first lines of each node")
    for name in ("max-files", "max-nodes", "timeout"):
        s.add_argument(f"--{name}", type=int, default=None)
    for name in ("skip-dir", "skip-glob"):
        s.add_argument(f"--{name}", action="append", default=[])
    a = sub.add_parser("ask", help="any question")
    a.add_argument("question", choices=sorted(QUESTIONS))
    a.add_argument("arguments", nargs="*", help="key=value; values are JSON, or plain text")
    return top


def value_of(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def main(argv: list[str], service: Service | None = None) -> int:
    try:
        own = parser().parse_args(argv)
    except SystemExit as end:
        return 0 if end.code == 0 else 2
    if own.command == "scan" and bool(own.path) == bool(own.repo):
        print("scan needs a path or --repo", file=sys.stderr)
        return 2
    if service is None:
        from pyspark.sql import SparkSession

        service = Service(SparkSession.builder.appName("lattice").getOrCreate())
    try:
        if own.command == "ask":
            answer = service.ask(own.question, **{k: value_of(v) for k, _, v in (x.partition("=") for x in own.arguments)})
        else:
            answer = service.ask("arch_scan", path=own.path, repo=own.repo, detail="full", max_detail_nodes=2**31 - 2, with_samples=own.samples, include_tests=own.include_tests,
                                 max_files=own.max_files, max_nodes=own.max_nodes, timeout=own.timeout, skip_dirs=own.skip_dir, skip_globs=own.skip_glob)
        text = as_json(answer) + "\n"
        if own.command == "scan" and own.out:
            with open(own.out, "w", encoding="utf-8") as f:
                f.write(text)
            print(f"{answer['node_count']} nodes and {answer['edge_count']} edges are in {own.out}" + (", cut by a limit" if answer["truncated"] else ""))
        else:
            sys.stdout.write(text)
    except Exception as error:  # noqa: BLE001  said in one line, whatever it was
        print(f"{own.command} failed: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
