"""Infrastructure that imports give away, and hosts in URLs."""

from __future__ import annotations

from urllib.parse import urlsplit

from lattice.extractors.base import Found

# The shared node of each group, in the order in which groups are tried.
GROUPS = {
    "database": ("infra:database", "Database", "read_write"),
    "queue": ("infra:queue", "Message Queue", "publish"),
    "cache": ("infra:cache", "Cache", "read_write"),
    "external_api": ("infra:external_api", "External API", "api_call"),
}


def mark_import(found: Found, name: str, packages: dict[str, list[str]], separator: str) -> None:
    """The first group with a package that the name is, or is inside of, gets a node and an edge."""
    for kind, (id_, label, edge) in GROUPS.items():
        if any(name == p or name.startswith(p + separator) for p in packages[kind]):
            found.node(id_, label, kind, detected_via=name)
            found.edge(found.origin, id_, edge, label, 0.8)
            return


def host_of(url: str) -> str:
    """The host of an absolute http address, else nothing."""
    try:
        parts = urlsplit(url)
        return (parts.hostname or "") if parts.scheme in ("", "http", "https") else ""
    except ValueError:
        return ""
