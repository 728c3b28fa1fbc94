"""Java modules: imports, infrastructure, route annotations and outbound calls, from tokens.

An import of a class that a file of the scanned folder declares targets that file's module. Looked at are the source
root of the importing file and src/*/java of the folder and of the folders in it.
"""

from __future__ import annotations

import functools
import glob
import os
from collections.abc import Callable

from lattice.extractors.base import Extractor, Found, module_stub, register, uncapped_stub
from lattice.extractors.infra import host_of, mark_import
from lattice.extractors.lexer import Language, Source

LANGUAGE = Language(r'(?P<raw>""".*?""")|(?P<string>"(?:\\.|[^"\\\n])*")|(?P<char>\'(?:\\.|[^\'\\\n])+\')')
# Packages of each kind of infrastructure, frameworks, annotations and their methods, clients and their calls.
PACKAGES = {
    "database": ["javax.persistence", "jakarta.persistence", "org.hibernate", "org.springframework.jdbc", "org.springframework.data", "com.mongodb", "org.mongodb", "com.mysql", "org.postgresql", "org.mybatis", "com.zaxxer.hikari", "java.sql"],
    "queue": ["org.springframework.amqp", "com.rabbitmq", "org.apache.kafka", "javax.jms", "jakarta.jms", "org.springframework.jms", "io.nats", "com.amazonaws.services.sqs"],
    "cache": ["org.springframework.cache", "com.github.benmanes.caffeine", "redis.clients", "net.spy.memcached", "org.ehcache"],
    "external_api": ["org.springframework.web.client", "org.springframework.web.reactive.function.client", "java.net.http", "okhttp3", "org.apache.http", "org.apache.hc", "feign", "retrofit2"],
}
FRAMEWORKS = [("org.springframework", "spring"), ("io.quarkus", "quarkus"), ("jakarta.ws.rs", "jax-rs"), ("javax.ws.rs", "jax-rs"), ("io.micronaut", "micronaut")]
ANNOTATIONS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": "", "GET": "GET", "POST": "POST", "PUT": "PUT", "DELETE": "DELETE", "PATCH": "PATCH"}
CLIENTS = {"restTemplate", "webClient", "httpClient", "client", "okHttpClient", "asyncRestTemplate"}
CALLS = {
    "get": "GET", "post": "POST", "put": "PUT", "delete": "DELETE", "patch": "PATCH", "getForObject": "GET", "getForEntity": "GET",
    "postForObject": "POST", "postForEntity": "POST", "postForLocation": "POST", "exchange": "ANY",
}


def source_roots(root: str) -> list[str]:
    return sorted(p for pattern in ("src/*/java", "*/src/*/java") for p in glob.glob(os.path.join(glob.escape(root), pattern)))


def statement(src: Source, k: int) -> list[str]:
    end = k + 1
    while src.kind(end) == "name" or src.text(end) in (".", "*"):
        end += 1
    return [t.text for t in src.tokens[k + 1 : end]]


def declared_in(found: Found, own_root: str, others: Callable[[], list[str]], name: str) -> str | None:
    """The file below the scanned folder that declares a class; names of inner classes and members may follow it."""
    names = name.split(".")
    for n in range(len(names), 1, -1):
        for top in [own_root, *others()]:
            path = os.path.join(top, *names[:n]) + ".java"
            if path.startswith(found.root + "/") and os.path.isfile(path):
                return path
    return None


def request_method(src: Source, opening: int) -> str:
    for k in range(opening, src.ends.get(opening, opening)):
        if src.text(k) == "RequestMethod" and src.text(k + 1) == "." and src.kind(k + 2) == "name":
            return src.text(k + 2).upper()
    return "ANY"


def read(found: Found, text: str) -> None:
    module_stub(found, {})
    src = Source(text, LANGUAGE)
    top = [k for k in range(len(src.tokens)) if not src.depth[k] and src.kind(k) == "name"]
    package = next(("".join(statement(src, k)) for k in top if src.text(k) == "package"), "")
    own_root = folder = os.path.dirname(found.path)
    if package and folder.endswith("/" + package.replace(".", "/")):
        own_root = folder[: -len(package) - 1]
    packages, others = [], functools.cache(lambda: source_roots(found.root))
    for k in top:
        if src.text(k) != "import":
            continue
        own = statement(src, k)
        own = own[1:] if own[:1] == ["static"] else own
        whole = own[-1:] != ["*"]
        name = "".join(own if whole else own[:-2])
        if not name:
            continue
        label = (name.rpartition(".")[0] or name) if whole else name
        file = declared_in(found, own_root, others, name) if whole else None
        target = f"mod:{file[len(found.root) + 1 : -len('.java')]}" if file else f"import:{label}"
        found.edge(found.origin, target, "dependency", label, 0.9)
        mark_import(found, label, PACKAGES, ".")
        packages.append(label)
    framework = next((label for p in packages for start, label in FRAMEWORKS if p.startswith(start)), "unknown")
    for k in range(len(src.tokens)):
        if src.text(k) == "@" and src.text(k + 1) in ANNOTATIONS and src.text(k + 2) != ".":
            inside = k + 2 if src.text(k + 2) == "(" else -1
            method = ANNOTATIONS[src.text(k + 1)] or request_method(src, inside)
            found.route(method, src.first_string(inside) or "/" if inside > 0 else "/", src.tokens[k].line, framework)
    for k, opening in src.calls():
        if src.text(k) in CALLS and src.text(k - 1) == "." and src.text(k - 2) in CLIENTS and src.text(k - 3) != ".":
            value = src.first_string(opening)
            if host := host_of(value):
                found.call(host, f"{CALLS[src.text(k)]} {value}", value, src.tokens[k - 2].line)


EXTRACTOR = register(Extractor("java", (".java",), read, uncapped_stub))
