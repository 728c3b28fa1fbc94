"""Rust modules: use declarations, infrastructure, route attributes and outbound calls, from tokens."""

from __future__ import annotations

from lattice.extractors.base import Extractor, Found, module_stub, register, uncapped_stub
from lattice.extractors.infra import host_of, mark_import
from lattice.extractors.lexer import Language, Source

LANGUAGE = Language(r'(?P<raw>b?r(?P<hashes>#*)".*?"(?P=hashes))|(?P<string>b?"(?:\\.|[^"\\])*")|(?P<char>b?\'(?:\\(?:u\{[^}\n]*\}|x..|.)|[^\'\\\n])\'|\'\w+)', nested=True)
# Crates of each kind of infrastructure, frameworks, verbs and clients.
PACKAGES = {
    "database": ["sqlx", "diesel", "mongodb", "postgres", "tokio_postgres", "mysql", "rusqlite", "sea_orm", "sled"],
    "queue": ["lapin", "rdkafka", "nats", "rumqttc", "amiquip"],
    "cache": ["redis", "memcache", "moka", "cached"],
    "external_api": ["reqwest", "hyper", "isahc", "ureq", "surf"],
}
FRAMEWORKS = {"actix_web": "actix-web", "axum": "axum", "rocket": "rocket", "warp": "warp"}
VERBS = {"get", "post", "put", "delete", "patch", "head", "options"}
CLIENTS = {"reqwest", "hyper", "ureq", "isahc"}


def imported(src: Source) -> list[str]:
    """The paths of top-level use declarations: up to a group, or without the last name. Renamings, wildcards and paths
    of one keyword name nothing."""
    out = []
    for k in range(len(src.tokens)):
        if src.depth[k] or src.text(k) != "use":
            continue
        end = k + 1
        while src.text(end) not in (";", "{", "") or src.kind(end) in ("string", "raw"):
            end += 1
        own = [t.text for t in src.tokens[k + 1 : end]]
        path = "".join(own)
        if src.text(end) == "{":
            path = path.removesuffix("::")
        elif "as" in own or "*" in own or path in ("crate", "self", "super"):
            path = ""
        else:
            path = path.rpartition("::")[0] or path
        if path:
            out.append(path)
    return out


def read(found: Found, text: str) -> None:
    module_stub(found, {})
    src = Source(text, LANGUAGE)
    names = imported(src)
    for name in names:
        found.edge(found.origin, f"import:{name}", "dependency", name, 0.9)
        mark_import(found, name, PACKAGES, "::")
    framework = next((label for n in names for start, label in FRAMEWORKS.items() if n.startswith(start)), "unknown")
    for k, opening in src.calls():
        called = src.text(k).lower()
        if called not in VERBS or not (value := src.first_string(opening)):
            continue
        if src.text(k - 1) == "[" and src.text(k - 2) == "#":
            found.route(called.upper(), value, src.tokens[k - 2].line, framework)
        first = k
        while src.text(first - 1) == "::" and src.kind(first - 2) == "name":
            first -= 2
        if first < k and src.text(first) in CLIENTS and src.text(first - 1) not in (".", "::") and (host := host_of(value)):
            found.call(host, f"{called.upper()} {value}", value, src.tokens[first].line)


EXTRACTOR = register(Extractor("rust", (".rs",), read, uncapped_stub))
