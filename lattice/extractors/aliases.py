"""Import aliases of TypeScript files: the paths of the nearest tsconfig.json, and the imports and $lib of the nearest
package.json. Files that can't be read or aren't objects give none; chains of extended configurations end after eight."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable, Iterator

from lattice.sources.documents import plain_json

MOST_EXTENDED = 8
Rule = tuple[str, list[str]]


def nearest(root: str, folder: str, name: str) -> str | None:
    """The file of a name in the folder or the closest one above it, up to root."""
    while folder == root or folder.startswith(root + "/"):
        if os.path.isfile(path := f"{folder}/{name}"):
            return path
        folder = os.path.dirname(folder)
    return None


def document(path: str) -> dict:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            found = json.loads(plain_json(f.read()))
    except (OSError, ValueError, RecursionError):
        return {}
    return found if isinstance(found, dict) else {}


def part(of: dict, key: str) -> dict:
    return found if isinstance(found := of.get(key), dict) else {}


def configured(path: str) -> list[Rule]:
    """The paths of a configuration, else those of the ones that it extends, the last one first."""
    todo = [(path, 0)]
    while todo:
        path, depth = todo.pop()
        config, folder = document(path), os.path.dirname(path)
        options = part(config, "compilerOptions")
        if paths := part(options, "paths"):
            base = os.path.join(folder, str(options.get("baseUrl") or ""))
            return [(k, [os.path.normpath(os.path.join(base, str(t))) for t in v]) for k, v in paths.items() if isinstance(v, list)]
        above = config.get("extends") or []
        for one in [above] if isinstance(above, str) else above if isinstance(above, list) else []:
            if isinstance(one, str) and one.startswith(("./", "../")) and depth < MOST_EXTENDED:
                file = os.path.normpath(os.path.join(folder, one))
                todo.append((file if file.endswith(".json") else file + ".json", depth + 1))
    return []


def packaged(path: str) -> list[Rule]:
    package, folder = document(path), os.path.dirname(path)
    out = []
    for pattern, to in part(package, "imports").items():
        choices = [to.get("default"), to.get("import")] if isinstance(to, dict) else [to]
        file = next((c for c in choices if isinstance(c, str) and c), "")
        if pattern.startswith("#") and file.startswith("./"):
            out.append((pattern, [os.path.normpath(os.path.join(folder, file))]))
    if any("@sveltejs/kit" in part(package, key) for key in ("dependencies", "devDependencies")):
        out += [("$lib", [f"{folder}/src/lib"]), ("$lib/*", [f"{folder}/src/lib/*"])]
    return out


@functools.lru_cache(maxsize=256)
def parsed(read: Callable[[str], list[Rule]], path: str, mtime_ns: int, size: int) -> list[Rule]:
    return read(path)


def rules(root: str, folder: str) -> list[Rule]:
    """Those in force in a folder, the ones with the longest literal beginning first."""
    out = []
    for name, read in (("tsconfig.json", configured), ("package.json", packaged)):
        if path := nearest(root, folder, name):
            info = os.stat(path)
            out += parsed(read, path, info.st_mtime_ns, info.st_size)
    return sorted(out, key=lambda rule: -len(rule[0].split("*", 1)[0]))


def bases(own: list[Rule], spec: str) -> Iterator[str]:
    """The paths that a specifier may stand for, in the order in which they are tried."""
    for pattern, targets in own:
        head, star, tail = pattern.partition("*")
        if not star and spec == pattern:
            yield from targets
        elif star and len(spec) >= len(head + tail) and spec.startswith(head) and spec.endswith(tail):
            inner = spec[len(head) : len(spec) - len(tail)]
            yield from (t.replace("*", inner, 1) for t in targets)
