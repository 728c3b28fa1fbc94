"""Controllers and injectable classes that decorators mark."""

from __future__ import annotations

from lattice.extractors.base import Found
from lattice.extractors.lexer import Source

# The decorators of methods that serve a route.
VERBS = {"Get", "Post", "Put", "Delete", "Patch", "All", "Head", "Options"}


def decorators(src: Source, k: int) -> tuple[list[tuple[str, str]], int]:
    """(name, first string) of the decorators that begin at a token, and the token behind them."""
    out = []
    while src.text(k) == "@":
        name, value, k = src.text(k + 1), "", k + 2
        while src.text(k) == ".":
            name, k = "", k + 2
        if src.text(k) == "(":
            value = next((v[1:-1] for p in src.parts(k) if (v := src.literal(p)) is not None), "")
            k = src.ends.get(k, k) + 1
        out.append((name, value))
    return out, k


def joined(base: str, route: str) -> str:
    base = base.removesuffix("/")
    if not route:
        return base or "/"
    return base + (route if route.startswith("/") else "/" + route)


def serves(found: Found, src: Source, body: int, base: str, framework: str) -> None:
    k, end = body + 1, src.ends.get(body, body)
    while k < end:
        marks, behind = decorators(src, k)
        m = behind
        while src.kind(m) == "name":
            m += 1
        hit = next(((name.upper(), value) for name, value in marks if name in VERBS), None)
        if hit and m > behind and src.text(m) in ("(", "<"):
            method, route, line = hit[0], joined(base, hit[1]), src.tokens[behind].line
            id_ = found.endpoint_id(line)
            found.node(id_, f"{method} {route}", "endpoint", "typescript", found.path, method=method.lower(), route=route, line=str(line), framework=framework)
            found.edge(found.origin, id_, "api_call", "serves", 0.85)
        k = max(behind, k + 1) if marks else src.ends.get(k, k) + 1


def read_classes(found: Found, src: Source, framework: str) -> None:
    k = 0
    while k < len(src.tokens):
        begin = k
        marks, k = decorators(src, k)
        is_exported = src.text(k) == "export"
        while src.text(k) in ("export", "default"):
            k += 1
        more, k = decorators(src, k) if is_exported else ([], k)
        if src.text(k) != "class" or src.kind(k + 1) != "name" or src.text(k - 1) == ".":
            k = max(k, begin + 1)
            continue
        marks += more
        body = k + 1
        while src.text(body) not in ("{", ""):
            body += 1
        base = next((value or "/" for name, value in marks if name == "Controller"), "")
        if base:
            serves(found, src, body, base, framework)
        elif any(name == "Injectable" for name, _ in marks):
            line = src.tokens[k if is_exported else begin].line
            id_ = f"service:{found.rel}:{line}"
            found.node(id_, src.text(k + 1), "module", "typescript", found.path, injectable="true", framework=framework, line=str(line))
            found.edge(found.origin, id_, "dependency", "provides", 0.85)
        k += 1
