"""TypeScript, TSX and Svelte modules: imports with their names, infrastructure, routes and outbound calls, from tokens.

URLs are read from literals, templates and sums of them; what is only known at run time is a star. Of a Svelte file
the script blocks count, and the form actions of its markup. Imports that name a source file of the folder, relatively or
by an alias, target its module.
"""

from __future__ import annotations

import os
import re

from lattice.extractors import aliases, nest
from lattice.extractors.base import Extractor, Found, register
from lattice.extractors.infra import host_of, mark_import
from lattice.extractors.lexer import INSERT, Language, Source, insert_end

LANGUAGE = Language(r'(?P<string>"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\')', templates=True)
SCRIPT = re.compile(r"(<script\b[^>]*>)(.*?)(</script\s*>)", re.S | re.I)
NOT_NEWLINE = re.compile(r"[^\n]")
ACTION = re.compile(r"""(?:^|\s)(?:form)?action\s*=\s*(?:"([^"]*)"|'([^']*)'|\{([^{}]*)\})""")
QUOTED = re.compile(r"""'[^']*'|"[^"]*\"""")
ACTION_NAME = re.compile(r"[A-Za-z_$][\w$-]*", re.A)
FORM = re.compile(r"<form\b([^>]*)>")
POSTS = re.compile(r"""(?:^|\s)method\s*=\s*["']?post\b""", re.I)
# Packages of each kind of infrastructure, frameworks, methods, receivers, clients and extensions.
PACKAGES = {
    "database": ["pg", "knex", "prisma", "@prisma/client", "typeorm", "sequelize", "mongoose", "mongodb", "mysql2", "better-sqlite3", "drizzle-orm", "mikro-orm"],
    "queue": ["amqplib", "kafkajs", "bullmq", "bull", "@google-cloud/pubsub", "nats", "@azure/service-bus"],
    "cache": ["redis", "ioredis", "@redis/client", "memcached", "keyv"],
    "external_api": ["axios", "node-fetch", "got", "undici", "superagent", "@apollo/client", "graphql-request"],
}
FRAMEWORKS = {"express": "express", "fastify": "fastify", "koa": "koa", "hapi": "hapi", "@hapi/hapi": "hapi", "restify": "restify", "@nestjs/common": "nestjs", "@nestjs/core": "nestjs"}
METHODS = {"get", "post", "put", "delete", "patch", "options", "head", "all", "use", "route"}
ROUTERS = {"app", "router", "server", "fastify", "route", "routes", "instance"}
CLIENTS = {"axios", "http", "client", "api"}
KIT_VERBS = {"GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD"}
SOURCES = (".ts", ".tsx", ".svelte")
COMPILED = {".js": [".ts", ".tsx"], ".jsx": [".tsx"], ".mjs": [".mts"], ".cjs": [".cts"]}


def without_extension(path: str) -> str:
    """A name like x.svelte.ts stays whole, as x.svelte may stand beside it."""
    stem = os.path.splitext(path)[0]
    return path if stem.endswith(".svelte") else stem


def scripts_only(text: str) -> str:
    """Everything but the script blocks blanked, line by line."""
    out, at = [], 0
    for m in SCRIPT.finditer(text):
        out += [NOT_NEWLINE.sub(" ", text[at : m.start(2)]), m[2]]
        at = m.end(2)
    return "".join([*out, NOT_NEWLINE.sub(" ", text[at:])])


def source_file(base: str) -> str | None:
    stem, ext = os.path.splitext(base)
    tried = [base] * (ext in SOURCES) + [stem + e for e in COMPILED.get(ext, [])] + [base + ".ts", base + ".tsx", base + "/index.ts", base + "/index.tsx"]
    return next(filter(os.path.isfile, tried), None)


def target(found: Found, own: list[aliases.Rule], spec: str) -> str:
    """The module that a specifier names, if a source file of the scanned folder is behind it."""
    if spec in (".", "..") or spec.startswith(("./", "../")):
        bases = [os.path.normpath(os.path.join(os.path.dirname(found.path), spec))]
    else:
        bases = aliases.bases(own, spec)
    path = next(filter(None, map(source_file, bases)), "")
    return "mod:" + without_extension(path[len(found.root) + 1 :]) if path.startswith(found.root + "/") else f"import:{spec}"


def specifiers(src: Source, opening: int) -> list[tuple[str, str]]:
    """(name there, name here) of the items in braces."""
    out = []
    for i, j in src.parts(opening):
        words = [t.text.strip("'\"") for t in src.tokens[i:j]]
        if len(words) > 1 and words[0] == "type" and words[1] != "as":
            words = words[1:]
        out.append((words[0], words[2] if words[1:2] == ["as"] and len(words) > 2 else words[0]))
    return out


def statements(src: Source) -> list[tuple[bool, str, list[str]]]:
    """Of top-level imports and exports from a module: (is an export, module, names)."""
    out = []
    for k in range(len(src.tokens)):
        word = src.text(k)
        if src.depth[k] or word not in ("import", "export") or src.text(k - 1) in (".", "?.") or src.text(k + 1) in ("(", "."):
            continue
        at = k + 1
        if src.text(at) == "type" and src.text(at + 1) not in ("from", ",", "="):
            at += 1
        names = []
        while src.kind(at) == "name" or src.text(at) in ("{", "*", ","):
            here = src.text(at)
            if here == "from" and src.kind(at + 1) == "string":
                at += 1
                break
            if here == "{":
                names += [f"{a}={b}" if word == "export" else a for a, b in specifiers(src, at)]
                at = src.ends.get(at, at)
            elif here == "*":
                renamed = src.text(at + 1) == "as"
                names.append(("*=" + (src.text(at + 2) if renamed else "*")) if word == "export" else "*")
                at += 2 * renamed
            elif here != ",":
                if word == "export":  # a declaration
                    break
                names.append("default")
            at += 1
        if src.kind(at) == "string" and (word == "import" or src.text(at - 1) == "from"):
            if path := src.tokens[at].text[1:-1]:
                out.append((word == "export", path, names))
    return out


def url_value(src: Source, part: tuple[int, int]) -> str | None:
    """A literal, a template or a sum that holds one; None for anything else."""
    pieces, known, k = [], False, part[0]
    while k < part[1]:
        t, end = src.tokens[k], k
        while end < part[1] and src.text(end) != "+":
            end = src.ends.get(end, end) + 1
        if end == k + 1 and t.kind == "string":
            pieces.append(t.text[1:-1])
            known = True
        elif end == k + 1 and t.kind == "template":
            inside, at, text = [], 1, t.text
            while (m := INSERT.search(text, at)) and m[0] != "`":
                inside += [text[at : m.start()], "*" if m[0] == "${" else m[0][1:]]
                at = insert_end(text, m.end()) if m[0] == "${" else m.end()
            pieces.append("".join([*inside, text[at:].removesuffix("`")]))
            known = True
        else:
            pieces.append("*")
        k = end + 1
    return "".join(pieces) if known else None


def is_route(receiver: str, route: str, n_args: int, in_app: bool) -> bool:
    """Other calls have the shape of a route, too: a path needs a router's name, a framework or a handler, and any other
    string a router's name and a handler."""
    if not route.startswith("/") and route != "*":
        return receiver in ROUTERS and n_args > 1
    if receiver in CLIENTS and not in_app:
        return False
    return receiver in ROUTERS or in_app or n_args > 1


def property_text(src: Source, part: tuple[int, int], key: str) -> str:
    """The string at a key of an object literal."""
    if src.text(part[0]) == "{" and src.ends.get(part[0]) == part[1] - 1:
        for i, j in src.parts(part[0]):
            if j == i + 3 and src.tokens[i].text.strip("'\"") == key and src.text(i + 1) == ":" and src.kind(i + 2) == "string":
                return src.tokens[i + 2].text[1:-1]
    return ""


def outbound(found: Found, method: str, url: str, line: int) -> None:
    if url.startswith("/") and not url.startswith("//"):
        path = re.split(r"[?#]", url, maxsplit=1)[0]
        found.edge(found.origin, f"route:{method} {path}", "api_call", f"{method} {url}", 0.7, url=url, line=str(line))
    elif host := host_of(url.replace("*", "x")):
        found.call(host, f"{method} {url}", url, line)


def kit_route(rel: str) -> str | None:
    """The path that a file below a routes folder serves; (groups) are no part of it."""
    folders = rel.split("/")[:-1]
    if "routes" not in folders:
        return None
    return "/" + "/".join(x for x in folders[folders.index("routes") + 1 :] if not (x.startswith("(") and x.endswith(")")))


def exported(src: Source) -> list[tuple[str, int]]:
    """Names of top-level exported declarations, and where they stand."""
    out = []
    for k in range(len(src.tokens)):
        if src.depth[k] or src.text(k) != "export":
            continue
        at = k + 1
        while src.text(at) in ("const", "let", "var", "async", "function", "*"):
            at += 1
        if at > k + 1 and src.kind(at) == "name":
            out.append((src.text(at), at))
        elif src.text(k + 1) == "{" and src.text(src.ends.get(k + 1, k) + 1) != "from":
            out += [(src.tokens[j - 1].text, j - 1) for _, j in src.parts(k + 1)]
    return out


def keys(src: Source, opening: int) -> list[tuple[str, int]]:
    out = []
    for i, j in src.parts(opening):
        while i < j - 1 and src.text(i) in ("async", "*") and src.text(i + 1) not in (":", "(", ","):
            i += 1
        if src.kind(i) in ("name", "string"):
            out.append((src.tokens[i].text.strip("'\""), src.tokens[i].line))
    return out


def kit_endpoint(found: Found, method: str, name: str, route: str, line: int, **more: str) -> None:
    id_ = found.endpoint_id(line)
    found.node(id_, name, "endpoint", "typescript", found.path, method=method.lower(), route=route, line=str(line), framework="sveltekit", **more)
    found.edge(found.origin, id_, "api_call", "serves", 0.9)


def kit_routes(found: Found, src: Source) -> None:
    base, route = without_extension(os.path.basename(found.rel)), kit_route(found.rel)
    if route is None or base not in ("+server", "+page.server"):
        return
    for name, at in exported(src):
        if base == "+server" and name in KIT_VERBS:
            kit_endpoint(found, name, f"{name} {route}", route, src.tokens[at].line)
        elif base == "+page.server" and name == "actions":
            while src.text(at) not in ("=", ";", ""):
                at += 1
            for action, line in keys(src, at + 1) if src.text(at + 1) == "{" else []:
                kit_endpoint(found, "POST", f"POST {route}" + (f"?/{action}" if action != "default" else ""), route, line, action=action)


def form_actions(found: Found, text: str) -> None:
    """An edge to each action that forms of the markup post to: quoted, in an expression of plain strings, or the default
    of a posting form without action, where no button names another."""
    markup = SCRIPT.sub(lambda m: NOT_NEWLINE.sub(" ", m[0]), text)
    uses = []
    for m in ACTION.finditer(markup):
        if m[3] is None:
            uses.append((m.start(), m[1] if m[1] is not None else m[2]))
        elif not re.search("[`+]", QUOTED.sub("", m[3])):
            uses += [(m.start(3) + q.start(), q[0][1:-1]) for q in QUOTED.finditer(m[3])]
    used = []
    for at, value in uses:
        page, cut, rest = value.partition("?/")
        name = ACTION_NAME.match(rest)
        if cut and name and "{" not in value and (not page or page.startswith("/") and not page.startswith("//")):
            used.append((at, page, name[0], value))
    if not re.search(r"\sformaction\s*=", markup):
        used += [(m.start(), "", "default", "") for m in FORM.finditer(markup) if POSTS.search(m[1]) and not re.search(r"\saction\s*=", m[1])]
    seen = set()
    for at, page, name, value in sorted(used):
        if (page, name) not in seen:
            seen.add((page, name))
            found.edge(found.origin, f"action:{page}?/{name}", "api_call", f"POST {page}?/{name}", 0.7, url=value, line=str(1 + markup.count("\n", 0, at)))


def stub(found: Found, properties: dict) -> None:
    found.owner = "mod:" + without_extension(found.rel)
    found.node(found.owner, without_extension(os.path.basename(found.rel)), "module", found.language, os.path.dirname(found.path), **properties)


def read(found: Found, text: str) -> None:
    stub(found, {})
    src = Source(scripts_only(text) if found.rel.endswith(".svelte") else text, LANGUAGE)
    edges: dict[str, tuple[str, dict[str, list[str]]]] = {}
    if found.rel.endswith(".svelte"):
        form_actions(found, text)
    refs = statements(src)
    own_aliases = aliases.rules(found.root, os.path.dirname(found.path)) if refs else []
    for is_export, path, names in refs:
        _, lists = edges.setdefault(target(found, own_aliases, path), (path, {}))
        own = lists.setdefault("reexports" if is_export else "names", [])
        own += [n for n in dict.fromkeys(names) if n not in own]
        mark_import(found, path, PACKAGES, "/")
    for id_, (path, lists) in edges.items():
        found.edge(found.origin, id_, "dependency", path, 0.9, **{k: ",".join(v) for k, v in lists.items()})
    framework = next((FRAMEWORKS[path] for is_export, path, _ in refs if not is_export and path in FRAMEWORKS), "unknown")
    served, called_out = [], []
    for k, opening in src.calls():
        parts, method = src.parts(opening), src.text(k).lower()
        member = src.text(k - 1) in (".", "?.")
        first = src.chain_start(k)
        line = src.tokens[first].line
        receiver = src.text(k - 2) if src.kind(k - 2) == "name" else ""
        if member and method in METHODS and parts and (route := src.literal(parts[0])) is not None and is_route(receiver, route[1:-1], len(parts), framework != "unknown"):
            served.append((first, method, route[1:-1], line))
        fetches = not member and src.text(k) == "fetch" and src.text(k - 1) != "function"
        asks = member and method in METHODS and receiver in CLIENTS and first == k - 2
        if (fetches or asks) and parts and (url := url_value(src, parts[0])) is not None:
            verb = (len(parts) > 1 and property_text(src, parts[1], "method").upper() or "GET") if fetches else method.upper()
            called_out.append((first, verb, url, line))
    for _, method, route, line in sorted(served):
        found.rows += route_rows(found, method, route, line, framework)
    kit_routes(found, src)
    for _, verb, url, line in sorted(called_out):
        outbound(found, verb, url, line)
    if framework == "nestjs":
        nest.read_classes(found, src, framework)


def route_rows(found: Found, method: str, route: str, line: int, framework: str) -> list[tuple]:
    """A route's rows; endpoints of Svelte scripts are TypeScript."""
    own = Found(found.path, found.rel, "typescript", owner=found.origin)
    own.rows = [*found.rows]  # so that places in the file go on
    own.route(method, route, line, framework)
    return own.rows[len(found.rows) :]


EXTRACTOR = register(Extractor("typescript", (".ts", ".tsx"), read, stub))
SVELTE = register(Extractor("svelte", (".svelte",), read, stub))
