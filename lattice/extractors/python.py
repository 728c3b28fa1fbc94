"""Python modules: imports, infrastructure, routes and outbound calls, from the syntax tree.

A file that doesn't parse keeps its module and the imports that stand at the start of a line.
"""

from __future__ import annotations

import ast
import os
import re

from lattice.extractors.base import Extractor, Found, module_stub, register
from lattice.extractors.infra import host_of, mark_import

# Packages of each kind of infrastructure, route decorators, clients and their methods.
PACKAGES = {
    "database": ["sqlalchemy", "django.db", "pymongo", "psycopg2", "mysql.connector", "sqlite3", "tortoise", "peewee", "databases", "asyncpg"],
    "queue": ["celery", "kombu", "pika", "kafka", "rq", "dramatiq"],
    "cache": ["redis", "pymemcache", "aiocache", "django.core.cache", "cachetools"],
    "external_api": ["requests", "httpx", "aiohttp", "urllib3", "httplib2"],
}
ROUTES = {"route", "get", "post", "put", "delete", "patch", "options", "head"}
CLIENTS = {"requests", "httpx", "session", "client"}
CALLS = {"get", "post", "put", "delete", "patch", "head", "options", "request"}
IMPORT_LINE = re.compile(r"^(?:from[ \t]+(\.*[\w.]*)[ \t]+import\b|import[ \t]+([\w.]+))", re.M)


def imported(tree: ast.Module | None, text: str) -> list[str]:
    """The first name of each import statement at the top level."""
    if tree is None:
        return [m[1] or m[2] for m in IMPORT_LINE.finditer(text)]
    out = []
    for node in tree.body:
        if isinstance(node, ast.Import):
            out.append(node.names[0].name)
        elif isinstance(node, ast.ImportFrom):
            out.append("." * node.level + (node.module or ""))
    return out


def first_text(call: ast.Call) -> str:
    return next((a.value for a in call.args if isinstance(a, ast.Constant) and isinstance(a.value, str)), "")


def decorated_route(decorator: ast.expr) -> tuple[str, str] | None:
    for node in ast.walk(decorator):
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr.lower() in ROUTES and (route := first_text(node)):
            return node.func.attr.lower(), route
    return None


def read(found: Found, text: str) -> None:
    module_stub(found, {})
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        tree = None
    names = imported(tree, text)
    for name in names:
        found.edge(found.module, f"import:{name}", "dependency", name, 0.9)
        mark_import(found, name, PACKAGES, ".")
    if tree is None:
        return
    framework = next((f for n in names for f in ("fastapi", "flask") if n.startswith(f)), "")
    for node in ast.walk(tree):
        for decorator in getattr(node, "decorator_list", ()):
            if hit := decorated_route(decorator):
                # A decorated definition begins at its first decorator.
                found.route(*hit, node.decorator_list[0].lineno, framework or ("flask" if hit[0] == "route" else "fastapi"))
        if not isinstance(node, ast.Call) or not (value := first_text(node)):
            continue
        called = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")
        if called in ("path", "re_path") and os.path.basename(found.rel).endswith("urls.py"):
            found.route(called, value, node.lineno, "django", f"URL {value}")
        receiver = node.func.value if isinstance(node.func, ast.Attribute) else None
        if isinstance(receiver, ast.Name) and receiver.id in CLIENTS and called in CALLS and (host := host_of(value)):
            found.call(host, f"{called.upper()} {value}", value, node.lineno)


EXTRACTOR = register(Extractor("python", (".py",), read, module_stub))
