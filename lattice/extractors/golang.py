"""Go packages: imports, infrastructure, routes and outbound calls, from tokens.

A file without a package clause or with unpaired brackets counts as unreadable and has no rows.
"""

from __future__ import annotations

import os

from lattice.extractors.base import Extractor, Found, register
from lattice.extractors.infra import host_of
from lattice.extractors.lexer import Language, Source

LANGUAGE = Language(r'(?P<string>"(?:\\.|[^"\\\n])*")|(?P<raw>`[^`]*`)|(?P<char>\'(?:\\.|[^\'\\\n])+\')')
# Parts of import paths by group, frameworks, functions that register routes, clients' functions and the place of the URL.
GROUPS = [
    (["database/sql", "gorm.io", "pgx", "go-sql-driver", "sqlx"], "infra:database", "Database", "database", "read_write", "database access"),
    (["amqp", "kafka", "nats", "rabbitmq"], "infra:queue", "Message Queue", "queue", "publish", "message queue"),
    (["redis", "memcache"], "infra:cache", "Cache", "cache", "read_write", "cache access"),
]
FRAMEWORKS = {
    "github.com/gin-gonic/gin": "gin", "github.com/go-chi/chi": "chi", "github.com/go-chi/chi/v5": "chi", "github.com/labstack/echo": "echo", "github.com/labstack/echo/v4": "echo",
    "github.com/gofiber/fiber": "fiber", "github.com/gofiber/fiber/v2": "fiber", "github.com/gorilla/mux": "gorilla",
}
ALWAYS = {"HandleFunc", "Handle", "Group", "Route"}
VERBS = {"get", "post", "put", "delete", "patch"}
URL_PLACE = {"Get": 0, "Head": 0, "Post": 0, "PostForm": 0, "NewRequest": 1}
TEXT = ("string", "raw")


def imported(src: Source) -> list[str]:
    out, k = [], 2
    while src.text(k) in ("import", ";"):
        if src.text(k) == ";":
            k += 1
            continue
        end = src.ends.get(k + 1, k + (1 if src.kind(k + 1) in TEXT else 2))
        out += [t.text.strip('"') for t in src.tokens[k : end + 1] if t.kind in TEXT]
        k = end + 1
    return out


def mark(found: Found, name: str) -> None:
    for words, id_, label, kind, edge, why in GROUPS:
        if any(w in name for w in words):
            found.node(id_, label, kind, detected_via=name)
            found.edge(found.origin, id_, edge, why, 0.8)
            return
    if name == "net/http" and "client" in found.origin:
        found.node("infra:external_api", "External API", "external_api")
        found.edge(found.origin, "infra:external_api", "api_call", "HTTP client", 0.8)


def read(found: Found, text: str) -> None:
    src = Source(text.removeprefix("\ufeff"), LANGUAGE)
    if src.text(0) != "package" or src.kind(1) != "name" or not src.balanced:
        return
    folder, name = os.path.dirname(found.path), src.text(1)
    found.owner = f"pkg:{os.path.basename(folder)}/{name}"
    found.node(found.owner, name, "package", "go", folder)
    names = imported(src)
    for n in names:
        found.edge(found.owner, f"import:{n}", "dependency", n, 0.9)
        mark(found, n)
    framework = next((FRAMEWORKS[n] for n in names if n in FRAMEWORKS), "stdlib" if "net/http" in names else "unknown")
    for k, opening in sorted(src.calls(), key=lambda c: src.chain_start(c[0])):
        called, parts = src.text(k), src.parts(opening)
        values = [None if (v := src.literal(p, TEXT)) is None else v.strip('"') for p in parts]
        line = src.tokens[src.chain_start(k)].line
        verb = called.lower() in VERBS and called in (called.upper(), called.title())
        if values and values[0] is not None and (called in ALWAYS or verb and values[0].startswith("/")):
            found.route(called, values[0], line, framework)
        at = URL_PLACE.get(called, len(values))
        if at < len(values) and src.text(k - 1) == "." and src.text(k - 2) == "http" and src.text(k - 3) != "." and values[at] and (host := host_of(values[at])):
            method = values[0] if at and values[0] is not None else called.upper()
            found.call(host, f"{method} {values[at]}", values[at], line)


EXTRACTOR = register(Extractor("go", (".go",), read, None))
